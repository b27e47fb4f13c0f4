"""N-gram Jaccard join by vertical partitioning, and groups of near copies.

Documents with equal shingle sets form a class; only one document of each is joined. Buckets learn how many classes
hold each of their shingles (shards.py), which gives a global order of shingles, rarest first. A shingle of one class
only counts for no overlap, so that a class with too many of them links with nothing. Of the others, two can link only
if they share one of the first shingles of the order (prefix filter); classes connected by such shingles form a cluster.

The global order is cut into fragments of equal weight, and each class into its parts in them. Clusters are cut into
blocks; the blocks that share a prefix shingle meet in cells. A cell's overlaps are counted in every fragment apart,
and a second aggregation sums the fragments' counts for each pair and compares them with the exact bound. A cell returns
stars of its connected classes, not all its pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Layout, bucketed, checkpoint, trim
from tidemark.llm.components import components
from tidemark.llm.shards import ANSWER, MESSAGE, count_answers, count_classes, count_messages, message_table
from tidemark.llm.text import Hasher, hasher, laid_out, text_column

U = np.uint64
#: Fragments of the order, classes in a block, pairs from which on a shingle's are counted by a matrix product, and
#: pairs that are counted at once.
FRAGMENTS, BLOCK, HEAVY, PAIRS = 4, 512, 4096, 1 << 19
#: Levels of the order: floor(log2(classes that hold a shingle)), up to 15.
LEVELS = 16
FIRST, SECOND = 101, 102  # seeds of the hashes


def shingle_sets(column: pa.Array, k: int, hashers: list[Hasher]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """For slices of documents: the first one's row, bounds of the documents' sets, and the sets by each hasher, sorted
    by the first. A text of 1 to k - 1 words is one shingle."""
    for s in laid_out(column):
        count, doc = np.diff(s.bounds), s.doc
        per, at = [], []
        for own in hashers:
            words = own.ranges(s.data, s.starts, s.ends)
            parts, begins = [], []
            for n in range(1, k + 1):
                grams = own.grams(words, n)
                if not len(grams):
                    continue
                begin = np.flatnonzero(doc[: len(grams)] == doc[n - 1 :]) if n == k else s.bounds[:-1][count == n]
                parts.append(grams[begin])
                begins.append(begin)
            per.append(np.concatenate(parts or [np.zeros(0, U)]))
            at = np.concatenate(begins or [np.zeros(0, np.int64)]).astype(np.int64)
        owner = doc[at] if len(at) else at
        order = np.lexsort((per[0], owner))
        owner, per = owner[order], [p[order] for p in per]
        new = np.r_[True, (owner[1:] != owner[:-1]) | (per[0][1:] != per[0][:-1])][: len(owner)]
        owner, per = owner[new], [p[new] for p in per]
        yield s.first, np.searchsorted(owner, np.arange(len(count) + 1)), per


def _signatures(bucket: pa.Table, k: int) -> pa.Table:
    """(row doc_id, n_shingles, h1, h2): sets are equal if these are, but for collisions of 128 bits."""
    trim()
    n, one, two = [], [], []
    for _, bounds, (a, b) in shingle_sets(text_column(bucket["text"]), k, [hasher(FIRST, True), hasher(SECOND, True)]):
        n.append(np.diff(bounds))
        for total, out in ((a, one), (b, two)):
            sums = np.r_[np.zeros(1, U), np.cumsum(total)]
            out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return pa.table({"doc_id": bucket["doc_id"], "n_shingles": pa.array(np.concatenate(n).astype(np.int64)), "h1": pa.array(np.concatenate(one)), "h2": pa.array(np.concatenate(two))})


def _sets(bucket: pa.Table, members: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, bounds, shingles) of the bucket's rows that stand for a class: the first of each member's doc_id, number of
    shingles and h1. members: (doc_id, n_shingles, h1, node)."""
    ids = bucket["doc_id"]
    rows = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False) & np.isin(ids.fill_null(0).to_numpy(), members[:, 0]))
    own = bucket.take(pa.array(rows))
    wanted = {(d, n, h): node for d, n, h, node in members.tolist()}
    nodes, sizes, sets = [], [np.zeros(0, np.int64)], [np.zeros(0, U)]
    doc = own["doc_id"].to_numpy()
    for first, bounds, (a,) in shingle_sets(text_column(own["text"]), k, [hasher(FIRST, True)]):
        n, sums = np.diff(bounds), np.r_[np.zeros(1, U), np.cumsum(a)]
        h = (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)
        found = [wanted.pop(key, None) for key in zip(doc[first : first + len(n)].tolist(), n.tolist(), h.tolist(), strict=True)]
        here = np.array([x is not None for x in found], bool)
        nodes += [x for x in found if x is not None]
        sizes.append(n[here])
        sets.append(a[np.repeat(here, n)])
    return np.array(nodes, np.int64), np.r_[0, np.cumsum(np.concatenate(sizes))], np.concatenate(sets)


def near_copies(docs: DataFrame, *, shingle: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of docs.

    Documents link if 100 * intersection >= percent * union of their sets of `shingle`-word shingles (A-Z lower-cased;
    a shorter text is one shingle). Null, empty and wordless texts have no set and link with nothing. component_id is
    the smallest doc_id that links reach. Rows of one doc_id are one document if their texts' sets are equal and else
    one for each set; rows without doc_id take no part and have no component.
    """
    return grouped(docs, shingle=shingle, percent=percent).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, *, shingle: int = 5, percent: int = 75) -> DataFrame:
    """near_copies with text_hash and component, which is one number for each group: groups of different texts
    can have the same component_id if doc_ids repeat. Rows without a set have none."""
    dealt, sizes = bucketed(docs)
    hashed = dealt.withColumn("text_hash", F.xxhash64("text"))
    sign = lambda t: _signatures(t, shingle).append_column("text_hash", t["text_hash"])
    signed = checkpoint(hashed.groupBy("bucket").applyInArrow(sign, "doc_id long, n_shingles long, h1 long, h2 long, text_hash long"))
    keys = ["n_shingles", "h1", "h2"]
    # a class is known by a hash of its keys, as a doc_id can stand for several
    classes = signed.where("n_shingles > 0").groupBy(*keys).agg(F.min("doc_id").alias("class_id")).withColumn("node", F.xxhash64(*keys))
    linked = _linked_classes(dealt, sizes, classes.where("class_id is not null"), shingle, percent)
    least = linked.join(classes, "node").groupBy("component").agg(F.min("class_id").alias("least"))
    groups = classes.join(linked.join(least, "component"), "node", "left").select(*keys, F.coalesce("component", "node").alias("component"), F.coalesce("least", "class_id").alias("least"))
    out = signed.join(groups, keys, "left")
    return out.select("doc_id", "text_hash", "n_shingles", "component", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def _linked_classes(dealt: DataFrame, sizes: Layout, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) for the classes that link with another: component is the smallest node. Below, doc_id of a
    class is its node."""
    members = classes.select(F.pmod(F.xxhash64("class_id"), F.lit(sizes.buckets)).cast("int").alias("bucket"), F.col("class_id").alias("doc_id"), "n_shingles", "h1", "node")
    n = sizes.shards
    listed = lambda own: np.stack([own[c].to_numpy() for c in ("doc_id", "n_shingles", "h1", "node")], axis=1).astype("<i8")

    def send(bucket: pa.Table, own: pa.Table) -> pa.Table:
        trim()
        if not bucket.num_rows:
            return message_table([])
        _, _, sets = _sets(bucket, listed(own), k)
        hashes, count = np.unique(sets, return_counts=True)
        number = bucket["bucket"][0].as_py()
        note = [(-1 - number, number, listed(own).tobytes())] if own.num_rows else []
        return message_table([*count_messages(number, hashes, count, n), *note])

    def answer(received: pa.Table) -> pa.Table:
        trim()
        if received["shard"][0].as_py() < 0:
            return received.select(["bucket", "shard", "payload"])
        return count_answers(received)

    def sets_left(bucket: pa.Table, answers: pa.Table) -> pa.Table:
        """Classes that may link: their size, and their shingles of several classes, in the global order."""
        trim()
        notes = answers.filter(pa.array(answers["shard"].to_numpy() < 0))
        own = np.frombuffer(notes["payload"][0].as_py(), "<i8").reshape(-1, 4) if notes.num_rows else np.zeros((0, 4), np.int64)
        ids, bounds, sets = _sets(bucket, own, k) if bucket.num_rows else (np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, U))
        known = np.unique(sets)
        kind = count_classes(answers, known, n)[np.searchsorted(known, sets)]
        rows = []
        for i, doc_id in enumerate(ids.tolist()):
            part, level = sets[bounds[i] : bounds[i + 1]], kind[bounds[i] : bounds[i + 1]]
            shared = np.flatnonzero(level)
            if len(part) and 100 * len(shared) >= percent * len(part):
                order = shared[np.lexsort((part[shared], level[shared]))]
                rows.append((doc_id, len(part), np.bincount(level[shared], minlength=LEVELS).astype("<u4").tobytes(), part[order].astype("<u8").tobytes()))
        ids_, size, levels, tokens = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"doc_id": pa.array(ids_, pa.int64()), "n": pa.array(size, pa.int64()), "levels": pa.array(levels, pa.binary()), "tokens": pa.array(tokens, pa.binary())})

    sent = dealt.groupBy("bucket").cogroup(members.groupBy("bucket")).applyInArrow(send, MESSAGE)
    answered = sent.groupBy("shard").applyInArrow(answer, ANSWER)
    left = checkpoint(dealt.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(sets_left, "doc_id long, n long, levels binary, tokens binary"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, doc = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc_id, size, tokens in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "tokens")), strict=True):
                shared = np.frombuffer(tokens, "<i8")
                # shingles of this class only come first in the order
                longest = size - -(-percent * size // 100) + 1 - (size - len(shared))
                token.append(shared[: max(longest, 0)])
                doc.append(np.full(len(token[-1]), doc_id))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), pa.array(np.concatenate(doc))], ["token", "doc"])

    tokens = checkpoint(left.mapInArrow(prefixes, "token long, doc long"))
    # classes that prefix shingles connect, directly or over others, form a cluster; links are within clusters only
    first = tokens.groupBy("token").agg(F.min("doc").alias("a"), F.max("doc").alias("hi")).where("a < hi").select("token", "a")
    clusters = components(tokens.join(first, "token").select("a", F.col("doc").alias("b")).where("a <> b"))
    placed = checkpoint(_blocks(clusters, tokens))
    # blocks of a cluster meet if a prefix shingle lies in both, and each meets itself
    where = placed.select("block").distinct()
    lies = tokens.join(placed.where("not alone").select(F.col("doc_id").alias("doc"), "block"), "doc").select("token", "block").distinct()
    other = lies.select("token", F.col("block").alias("j"))
    pairs = lies.select("token", F.col("block").alias("i")).join(other, "token").where("i < j").select("i", "j").distinct()
    pairs = pairs.unionByName(where.select(F.col("block").alias("i"), F.col("block").alias("j")))
    ends = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    parts = _fragments(placed.join(left, "doc_id").select("block", "doc_id", "n", "levels", "tokens"), pivots(left))
    counted = parts.join(ends, "block").groupBy("i", "j", "fragment").applyInArrow(_count, "i long, j long, fragment int, classes binary, counts binary")
    links = counted.groupBy("i", "j").applyInArrow(lambda t: _decide(t, percent), "a long, b long")
    return components(links)


def _blocks(clusters: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, block, alone): at most about BLOCK classes a block; alone: its cluster has no other. Classes whose smallest
    prefix shingle (by its hash) is the same are put together, so that near copies share blocks and few blocks meet."""
    homes = tokens.groupBy(F.col("doc").alias("node")).agg(F.min("token").alias("home"))
    size = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("wanted"))
    own = clusters.join(size, "component").join(homes, "node").select(F.col("component").alias("cluster"), F.col("node").alias("doc_id"), F.pmod(F.xxhash64("home"), F.col("wanted")).alias("part"), "wanted")
    full = own.groupBy("cluster", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("pieces"))
    return own.join(full, ["cluster", "part"]).select("doc_id", F.xxhash64("cluster", "part", F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).alias("block"), ((F.col("wanted") == 1) & (F.col("pieces") == 1)).alias("alone"))


def pivots(left: DataFrame) -> list[tuple[int, int]]:
    """The (level, hash) at which the fragments after the first begin: they hold about as many of the classes' shingles
    each. Shingles of a level are spread evenly over the hashes; one number a level comes to the driver."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.frombuffer(b"".join(batch.column("levels").to_pylist()), "<u4").reshape(-1, LEVELS).sum(axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS, dtype=np.int32)), pa.array(n)], ["level", "n"])

    found = {r["level"]: r["total"] for r in left.select("levels").mapInArrow(totals, "level int, n long").groupBy("level").agg(F.sum("n").alias("total")).collect()}
    per = [found.get(i, 0) for i in range(LEVELS)]
    total, out = sum(per), []
    for j in range(1, FRAGMENTS):
        want, level = j * total // FRAGMENTS, 0
        while level < LEVELS - 1 and want >= per[level]:
            want -= per[level]
            level += 1
        out.append((level, min((want << 64) // max(per[level], 1), (1 << 64) - 1)))
    return out


def cut(levels: np.ndarray, tokens: np.ndarray, at: list[tuple[int, int]]) -> list[np.ndarray]:
    """A class's shingles, in the global order, by fragment."""
    bounds = np.r_[0, np.cumsum(levels)]
    edges = [int(bounds[level]) + int(np.searchsorted(tokens[bounds[level] : bounds[level + 1]], U(h))) for level, h in at]
    return np.split(tokens, edges)


def _fragments(classes: DataFrame, at: list[tuple[int, int]]) -> DataFrame:
    """(block, doc_id, n, fragment, part): every class once in each fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.repeat(np.arange(batch.num_rows), len(at) + 1)
            parts = [p.tobytes() for levels, tokens in zip(batch.column("levels").to_pylist(), batch.column("tokens").to_pylist(), strict=True) for p in cut(np.frombuffer(levels, "<u4").astype(np.int64), np.frombuffer(tokens, "<u8"), at)]
            kept = [batch.column(c).take(pa.array(rows)) for c in ("block", "doc_id", "n")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.tile(np.arange(len(at) + 1, dtype=np.int32), batch.num_rows)), pa.array(parts, pa.binary())], ["block", "doc_id", "n", "fragment", "part"])

    return classes.mapInArrow(run, "block long, doc_id long, n long, fragment int, part binary")


def overlaps(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Common elements of sets[:size] with sets[size:].

    Elements of few sets are counted pair by pair, those of many by one product of incidence matrices.
    """
    others = len(sets) - size
    total = np.zeros((size, others), np.int64)
    who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    part = np.concatenate(sets)
    if not len(part):
        return total
    order = np.argsort(part, kind="stable")
    part, who = part[order], who[order]
    number = np.cumsum(np.r_[True, part[1:] != part[:-1]]) - 1
    left = who < size
    n = number[-1] + 1
    a, b = np.bincount(number[left], minlength=n), np.bincount(number[~left], minlength=n)
    many, few = a * b > HEAVY, (a * b > 0) & (a * b <= HEAVY)
    place = np.cumsum(many) - 1
    heavy = many[number]
    for lo in range(0, int(many.sum()), 4096):  # sums of at most 4,096 are exact in single precision
        here = heavy & (place[number] >= lo) & (place[number] < lo + 4096)
        matrix = np.zeros((len(sets), 4096), np.float32)
        matrix[who[here], place[number[here]] - lo] = 1
        total += (matrix[:size] @ matrix[size:].T).astype(np.int64)
    x, y = np.flatnonzero(few[number] & left), np.flatnonzero(few[number] & ~left)
    begins = np.cumsum(b * few) - b * few
    ends = np.cumsum(b[number[x]])
    lo = 0
    while lo < len(x):  # slices of about PAIRS pairs
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")), lo + 1)
        own, repeat = x[lo:hi], b[number[x[lo:hi]]]
        at = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat - begins[number[own]], repeat)
        flat = np.repeat(who[own], repeat) * others + who[y[at]] - size
        total += np.bincount(flat, minlength=size * others).reshape(size, others)
        lo = hi
    return total


def _count(cell: pa.Table) -> pa.Table:
    """A cell's overlaps in one fragment: a matrix of its two blocks' classes, each block in order of doc_id. The first
    fragment also says which classes these are."""
    trim()
    fragment = cell["fragment"][0].as_py()
    ids, n, block = (cell[c].to_numpy() for c in ("doc_id", "n", "block"))
    sets = [np.frombuffer(x, "<u8") for x in cell["part"].to_pylist()]
    one, two = (np.flatnonzero(block == cell[e][0].as_py()) for e in ("i", "j"))
    one, two = one[np.argsort(ids[one])], two[np.argsort(ids[two])]
    both = overlaps([sets[i] for i in one] + [sets[i] for i in two], len(one))
    of = np.concatenate([[len(one)], ids[one], n[one], ids[two], n[two]]).astype("<i8") if fragment == 0 else np.zeros(0, "<i8")
    return pa.table({"i": cell["i"].slice(0, 1), "j": cell["j"].slice(0, 1), "fragment": cell["fragment"].slice(0, 1), "classes": pa.array([of.tobytes()], pa.binary()), "counts": pa.array([zlib.compress(both.astype("<u4").tobytes(), 1)], pa.binary())})


def _decide(fragments: pa.Table, percent: int) -> pa.Table:
    """A cell's links by the sums of its fragments' counts, as stars of its connected classes."""
    trim()
    of = np.frombuffer(next(x for x in fragments["classes"].to_pylist() if x), "<i8")
    size = int(of[0])
    one, n_one, (two, n_two) = of[1 : size + 1], of[size + 1 : 2 * size + 1], np.split(of[2 * size + 1 :], 2)
    both = np.zeros(size * len(two), np.int64)
    for counts in fragments["counts"].to_pylist():
        both += np.frombuffer(zlib.decompress(counts), "<u4")
    both = both.reshape(size, len(two))
    x, y = np.nonzero(100 * both >= percent * (n_one[:, None] + n_two[None, :] - both))
    ids = np.unique(np.concatenate([one, two]))
    x, y = np.searchsorted(ids, one[x]), np.searchsorted(ids, two[y])
    root = np.arange(len(ids))
    while True:  # smallest place that links reach
        least = root.copy()
        np.minimum.at(least, x, root[y])
        np.minimum.at(least, y, root[x])
        least = least[least]
        if (least == root).all():
            break
        root = least
    some = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"a": pa.array(ids[some], pa.int64()), "b": pa.array(ids[root[some]], pa.int64())})
