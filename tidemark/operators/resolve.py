"""Resolution of tags and artists to categories, and its evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import kernels as K


def centroids(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid): the mean of each component."""
    long = vectors.select(key, F.posexplode(vector).alias("i", "x"))
    means = long.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def embedded(tags: DataFrame, canonical: DataFrame, *, key: str, vector: str, floor: float = 0.55, window: float = 0.05, temperature: float = 0.1, most: int = 3) -> DataFrame:
    """Memberships (key, genre, weight, confidence): the categories nearest to a tag, weighted by a softmax.

    canonical (genre, centroid) is the taxonomy, a bounded dimension that is sent to every task.
    """
    near = tags.select(key, vector).crossJoin(F.broadcast(canonical)).withColumn("s", K.cosine(F.col(vector), F.col("centroid")))
    w = Window.partitionBy(key)
    near = near.withColumn("best", F.max("s").over(w)).where((F.col("s") >= floor) & (F.col("best") - F.col("s") <= window))
    near = near.withColumn("r", F.row_number().over(w.orderBy(F.col("s").desc(), "genre"))).where(F.col("r") <= most)
    e = F.exp((F.col("s") - F.col("best")) / temperature)
    return near.select(key, "genre", (e / F.sum(e).over(w)).alias("weight"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s"))).alias("confidence"))


def artist_memberships(evidence: DataFrame, mapping: DataFrame) -> DataFrame:
    """(artist, genre, weight, confidence): evidence (artist, tag, w) times mapping (tag, genre, weight, confidence).

    Unresolved tags (genre NULL) only count for artists without any resolved one; weights of an artist add up to 1.
    """
    own = evidence.join(mapping, "tag", "left")
    w = Window.partitionBy("artist")
    own = own.withColumn("some", F.max(F.col("genre").isNotNull()).over(w)).where(F.col("genre").isNotNull() | ~F.col("some"))
    share = F.col("w") * F.coalesce("weight", F.lit(1.0))
    by = own.groupBy("artist", "genre").agg(F.sum(share).alias("weight"), F.try_divide(F.sum(share * F.col("confidence")), F.sum(share)).alias("confidence"))
    return by.withColumn("weight", F.try_divide(F.col("weight"), F.sum("weight").over(w)))


def ladder(df: DataFrame, key: str, steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """df with (value, method) of the first step (name, frame of key and value) that has the key; unresolved else."""
    out = df
    values, methods = [], []
    for i, (name, frame) in enumerate(steps):
        out = out.join(frame.select(F.col(key), F.col("value").alias(f"_v{i}")), key, "left")
        values.append(F.col(f"_v{i}"))
        methods.append(F.when(F.col(f"_v{i}").isNotNull(), name))
    return out.select(*df.columns, F.coalesce(*values).alias("value"), F.coalesce(*methods, F.lit("unresolved")).alias("method"))


def agreement(df: DataFrame, strata: Sequence[str], predicted: str, actual: str) -> DataFrame:
    """(strata, tp, fp, fn, precision, recall); rows without a label do not count."""
    known = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    p, a = F.col(predicted), F.col(actual)
    out = known.groupBy(*strata).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    return out.withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))


def taxonomy_faults(taxonomy: DataFrame) -> DataFrame:
    """(fault, id) of a dimension (id, parent, name): duplicate ids and names, missing parents, cycles of any length.

    Few rows by definition. Every id's ancestor is doubled in distance until it is farther than there are rows: paths
    that have not ended by then are in a cycle, and the ancestors that they have reached are its members.
    """
    twice = lambda c: taxonomy.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(f"duplicate {c}").alias("fault"), F.col(c).cast("string").alias("id"))
    own = taxonomy.where("parent is not null")
    orphan = own.join(taxonomy.select(F.col("id").alias("p")), F.col("parent") == F.col("p"), "left_anti").select(F.lit("missing parent"), F.col("id").cast("string"))
    rows = taxonomy.count()
    jump = own.groupBy("id").agg(F.min("parent").alias("up"))
    for _ in range(max(rows, 1).bit_length()):
        jump = jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("upper")), "up").select("id", F.col("upper").alias("up"))
    cycle = jump.select(F.lit("cycle"), F.col("up").cast("string")).distinct()
    return twice("id").union(twice("name")).union(orphan).union(cycle)


def scene(categories: DataFrame) -> DataFrame:
    """(genre, x, y): places of categories (genre, centroid) by their two principal components; of fewer than three
    categories none. A component's direction is the one in which its largest loading is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    kind = categories.schema["genre"].dataType.simpleString()
    if categories.limit(3).count() < 3:
        return categories.sparkSession.createDataFrame([], f"genre {kind}, x double, y double")
    own = categories.withColumn("v", array_to_vector("centroid"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(own)
    loadings = model.pc.toArray()
    signs = [1.0 if column[abs(column).argmax()] >= 0 else -1.0 for column in loadings.T]
    out = model.transform(own).withColumn("p", vector_to_array("p"))
    return out.select("genre", (F.col("p")[0] * signs[0]).alias("x"), (F.col("p")[1] * signs[1]).alias("y"))
