"""Operations of a training-data pipeline: tokenising, search, deduplication, extraction, packing, scoring.

Every operator is a function from DataFrames to DataFrames; queries.py binds them to the test tables.
Nothing outside this package imports it.
"""
