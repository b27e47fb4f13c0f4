"""The stages of the pipeline: each on what the one before kept."""

from tests.llm.test_text_operators import plain_groups, plain_lines, plain_substrings


def test_stages(spark, data, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == columns
            after = [(r.doc_id, r.text) for r in out.collect()]
        if name == "toxicity":
            assert 0.8 * len(before) < len(after) <= len(before) and set(after) <= set(before)
        elif name == "line_dedup":
            assert sorted(after) == [(i, t) for i, _, _, t in plain_lines(before, 40, 5)]
        elif name == "jaccard_join":
            assert sorted(i for i, _ in after) == sorted(i for i, _, c in plain_groups(before) if i == c)
        elif name == "substring_dedup":
            assert sorted(after) == [(i, t) for i, _, _, t in plain_substrings(before, 13)]
        else:
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {i for i, _ in before}
        docs = out
    assert corpus_pipeline.run(spark, data).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_of_odd_tables(spark, data):
    """Nulls, empty texts, repeated rows, rows without doc_id, clashing names; and no rows at all."""
    import corpus_pipeline

    line = "this is a long line that many documents hold, here it is"
    rows = [(None, line), (None, None), (None, None), (1, None), (2, ""), (2, ""), (3, line), (3, line), (4, line + "\nown words of the fourth document"), (5, " "), (6, "x y " * 3000)]
    docs = spark.createDataFrame([(i, t, None, "s", 0, "a", 1, 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component string, bucket int, score double")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        found = out.collect()
        if name == "packing":
            assert len([r for r in found if r.start == 0]) == len(rows)
        else:
            assert out.columns == docs.columns and {r.component for r in found} == {"a"}
            assert len(found) == (len(rows) - 1 if name == "jaccard_join" else len(rows)) or name == "toxicity", name
            assert {r.doc_id for r in found} <= {i for i, _ in rows}
        assert stage(spark, docs.where("false"), data).count() == 0, name
