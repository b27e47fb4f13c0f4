"""Source divergence audit: how far the term shares of a language's sources are apart, and which terms set a source off.

Sort-based streaming in two rounds. A task sorts the term occurrences of its documents by (lang, term, source, document)
and scans the runs for document frequency and counts, so that a term that every document holds leaves a task as one row
for each source. These rows are dealt by (lang, term), sorted by (lang, term, source) within a partition, and scanned
once more: a run of (lang, term) has its whole frequency, and yields its rows only if the term is kept. In the second
round the kept rows are dealt by (lang, block of sources, range of terms) together with the totals of the language's
groups, which sort before them; the scan gives each run its shares and emits partial sums of pairs of sources and the
first terms of each source, which two small aggregations merge.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, parallelism, trim
from tidemark.llm.labelled import LETTER
from tidemark.llm.text import laid_out, text_column

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Texts are tokenised in slices of so many bytes; a task's rows are merged when there are so many.
SLICE_BYTES, MERGE_ROWS = 4 << 20, 1 << 20
#: Kept terms of a range, and sources of a block; cells of a matrix of terms x sources.
RANGE_TERMS, BLOCK_SOURCES, MATRIX = 4096, 512, 1 << 20
SCALE, PRIOR = 1_000_000_000, 5
#: Languages whose sizes are sent to every executor (some bytes each); with more, Spark joins them as it does any table.
SMALL = 100_000

OCCURRENCES = "lang string, term string, source string, documents long, occurrences long"
KEPT = "lang string, term string, source string, occurrences long, opens int"
PARTIAL = "lang string, source string, part string, item string, value long"


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / total) in whole numbers, digit by digit: exact for totals below 2**63 / 10."""
    rest, out = np.broadcast_arrays(np.asarray(count, np.int64) + PRIOR, np.asarray(total, np.int64))
    out, by = np.zeros(rest.shape, np.int64), out
    for _ in range(9):
        rest = rest * 10
        digit = rest // by
        out, rest = out * 10 + digit, rest - digit * by
    return out + 1


def _merged(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by(["lang", "term", "source"]).aggregate([("documents", "sum"), ("occurrences", "sum")]).rename_columns(["lang", "term", "source", "documents", "occurrences"])


def _runs(group: np.ndarray, texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Per slice of the texts: the group, term, documents and occurrences of each run of (term, group)."""
    for s in laid_out(texts, words=False, size=SLICE_BYTES):
        edge = np.flatnonzero(np.diff(LETTER[s.data], prepend=False))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        doc = np.searchsorted(s.begins, starts, "right") - 1
        letters = LOWER[s.data[LETTER[s.data]]]
        offsets = np.r_[0, np.cumsum(ends - starts)]
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)).dictionary_encode()
        term = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        source = group[s.first + doc]
        order = np.lexsort((doc, source, term))
        term, source, doc = term[order], source[order], doc[order]
        run = np.r_[True, (term[1:] != term[:-1]) | (source[1:] != source[:-1])]
        new = run | np.r_[True, doc[1:] != doc[:-1]]
        first = np.flatnonzero(run)
        yield source[first], words.dictionary.take(pa.array(term[first])), np.add.reduceat(new.astype(np.int64), first), np.diff(np.r_[first, len(term)])


def count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's part of the first round: (lang, text, source) in, OCCURRENCES out, one row for each (lang, term, source)
    as long as there are few; a document is a row."""
    trim()
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        names = pa.table({c: batch[c].cast(pa.string()) for c in ("lang", "source")}).group_by(["lang", "source"]).aggregate([])
        key = {(a, b): i for i, (a, b) in enumerate(zip(names["lang"].to_pylist(), names["source"].to_pylist(), strict=True))}
        group = np.array([key[x] for x in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True)], np.int64)
        for source, term, documents, occurrences in _runs(group, text_column(batch["text"])):
            at = pa.array(source)
            held.append(pa.table({"lang": names["lang"].take(at), "term": term.cast(pa.string()), "source": names["source"].take(at), "documents": pa.array(documents), "occurrences": pa.array(occurrences)}))
            rows += len(source)
            if rows > MERGE_ROWS:
                held = [_merged(held)]
                rows = held[0].num_rows
                if rows > MERGE_ROWS // 2:
                    yield from held[0].to_batches(1 << 16)
                    held, rows = [], 0
    if held:
        yield from _merged(held).to_batches(1 << 16)


def _same(column: pa.Array) -> np.ndarray:
    """Whether each value is that of the row before; false for the first."""
    return np.r_[False, pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)] if len(column) else np.zeros(0, bool)


def kept_runs(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sorted OCCURRENCES in, KEPT out: rows of (lang, term) runs with at least `least` documents in all, merged by source;
    opens is 1 in a run's first row. A run that goes on in the next batch waits for it, already merged."""
    rest: pa.Table | None = None
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("occurrences", pa.int64()), ("opens", pa.int32())])

    def scanned(t: pa.Table, whole: bool) -> tuple[pa.Table, pa.RecordBatch]:
        t = t.combine_chunks()
        lang, term, source = (t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c] for c in ("lang", "term", "source"))
        run = ~(_same(lang) & _same(term))
        row = run | ~_same(source)
        first = np.flatnonzero(row)
        documents, occurrences = (np.add.reduceat(t[c].to_numpy(), first) for c in ("documents", "occurrences"))
        opens = run[first]
        begin = np.flatnonzero(opens)
        end = len(first) if whole else int(begin[-1])
        at = pa.array(first)
        merged = pa.table({"lang": lang.take(at), "term": term.take(at), "source": source.take(at), "documents": pa.array(documents), "occurrences": pa.array(occurrences)})
        frequency = np.repeat(np.add.reduceat(documents, begin), np.diff(np.r_[begin, len(first)]))
        fine = np.flatnonzero((frequency >= least) & (np.arange(len(first)) < end))
        found = merged.take(pa.array(fine)).select(["lang", "term", "source", "occurrences"]).append_column("opens", pa.array(opens[fine].astype(np.int32)))
        return merged.slice(end), found.cast(schema).combine_chunks()

    for batch in batches:
        if batch.num_rows:
            own = pa.Table.from_batches([batch])
            own = own if rest is None else pa.concat_tables([rest.cast(own.schema), own])
            rest, found = scanned(own, False)
            yield from found.to_batches()
    if rest is not None and rest.num_rows:
        yield from scanned(rest, True)[1].to_batches()


@dataclass
class Sources:
    """The groups of a language: names in order, their denominators N + 5 V, and what a block of them has gathered."""

    lang: str
    lo: int  # of the block
    size: int  # sources of a block at most
    names: list[str] = field(default_factory=list)
    under: list[int] = field(default_factory=list)
    whole: int = 0  # the language's own denominator
    terms: int = 0  # kept terms of the language
    top: int = 50

    def open(self, first_range: bool) -> None:
        self.index = {s: i for i, s in enumerate(self.names)}
        self.by = np.array(self.under, np.int64)
        self.hi = min(self.lo + self.size, len(self.names))
        self.none = share(0, self.by) if self.terms else np.zeros(len(self.names), np.int64)
        own = np.arange(self.lo, self.hi)
        self.sums = np.zeros((len(own), len(self.names)), np.int64)
        if first_range:  # as if no source had any term; every term then changes what its sources' pairs are apart
            self.sums += self.terms * np.abs(self.none[own, None] - self.none) * (own[:, None] < np.arange(len(self.names)))
        self.best: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def add(self, row: np.ndarray, source: np.ndarray, count: np.ndarray, names: pa.Array) -> None:
        """Terms names[0..]; count occurrences of term row[i] in source[i]."""
        rows, n = len(names), len(self.names)
        table = np.zeros((rows, n), np.int64)
        table[row, source] = count
        shares = share(table, self.by)
        here = table > 0
        p = share(table.sum(axis=1), self.whole)
        for a in range(self.lo, self.hi):
            at = np.flatnonzero(here[:, a])
            if not len(at):
                continue
            # a pair's change is added by the smaller source that has the term
            own = shares[at, a]
            change = np.abs(own[:, None] - shares[at]) - np.abs(self.none[a] - self.none)
            self.sums[a - self.lo] += (change * (~here[at] | (np.arange(n) > a))).sum(axis=0)
            over = np.flatnonzero(own > p[at])
            if len(over):
                self.best.append((np.full(len(over), a), own[over] - p[at][over], names.take(pa.array(at[over]))))
        if sum(len(x) for x, _, _ in self.best) > MATRIX:
            self.prune()

    def prune(self) -> None:
        """Only the first `top` terms of each source are left."""
        if not self.best:
            return
        source, value = (np.concatenate([x[i] for x in self.best]) for i in (0, 1))
        names = pa.concat_arrays([x[2] for x in self.best])
        # terms come in ascending order
        order = np.lexsort((np.arange(len(source)), -value, source))
        first = np.r_[True, source[order][1:] != source[order][:-1]]
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        order = np.sort(order[rank < self.top])
        self.best = [(source[order], value[order], names.take(pa.array(order)))]

    def emitted(self) -> Iterator[pa.RecordBatch]:
        a, b = np.nonzero(np.arange(len(self.names)) != np.arange(self.lo, self.hi)[:, None])
        names = pa.array(self.names, pa.string())
        lo, hi = np.minimum(a + self.lo, b), np.maximum(a + self.lo, b)
        value = self.sums[a, b]
        # one row for each pair that got something, and for pairs in the order of their names, so that every pair has one
        some = np.flatnonzero((value != 0) | (a + self.lo < b))
        yield _partial(self.lang, names.take(pa.array(lo[some])), "pair", names.take(pa.array(hi[some])), value[some])
        self.prune()
        for source, worth, terms in self.best:
            yield _partial(self.lang, names.take(pa.array(source)), "term", terms, worth)


def _partial(lang: str, source: pa.Array, part: str, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
    n = len(value)
    return pa.record_batch([pa.array([lang] * n, pa.string()), source, pa.array([part] * n, pa.string()), item.cast(pa.string()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])


def compared(batches: Iterable[pa.RecordBatch], top: int, block_sources: int) -> Iterator[pa.RecordBatch]:
    """The second round's scan. Rows come sorted by lang, block, range, term and source; a range's first rows have no term
    and hold the language's groups (occurrences: N + 5 V of the group, whole: of the language, terms: V)."""
    trim()
    key, sources, header = None, None, True
    wait: list[tuple[str, int, int]] = []  # (term, source, occurrences) of runs not yet added

    def flush(keep_last: bool) -> None:
        nonlocal wait
        if not wait:
            return
        end = len(wait)
        if keep_last:
            while end and wait[end - 1][0] == wait[-1][0]:
                end -= 1
        terms, source, count = zip(*wait[:end], strict=True) if end else ((), (), ())
        if end:
            new = np.r_[True, np.array([a != b for a, b in zip(terms[1:], terms[:-1], strict=True)], bool)]
            sources.add(np.cumsum(new) - 1, np.array(source), np.array(count, np.int64), pa.array([t for t, x in zip(terms, new, strict=True) if x], pa.string()))
        wait = wait[end:]

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("lang", "block", "range", "term", "source", "occurrences", "whole", "terms")]
        for lang, block, part, term, source, n, whole, terms in zip(*columns, strict=True):
            if (lang, block, part) != key:
                if sources is not None:
                    if header:
                        sources.open(key[2] == 0)
                    flush(False)
                    yield from sources.emitted()
                key, sources, header = (lang, block, part), Sources(lang, block * block_sources, block_sources, top=top), True
            if term is None:
                sources.names.append(source)
                sources.under.append(n)
                sources.whole, sources.terms = whole, terms
                continue
            if header:
                sources.open(part == 0)
                header = False
            wait.append((term, sources.index[source], n))
            if len(wait) >= max(1 << 14, 2 * len(sources.names)) and wait[-2][0] != term:
                flush(True)
            elif len(wait) * len(sources.names) > 2 * MATRIX and wait[-2][0] != term:
                flush(True)
    if sources is not None:
        if header:
            sources.open(key[2] == 0)
        flush(False)
        yield from sources.emitted()


def audit_sources(docs: DataFrame, *, least_docs: int = 30, top: int = 50, range_terms: int = RANGE_TERMS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): for every (lang, source), the other sources of the language by the summed
    difference of term shares (part `pair`), and the `top` terms whose share is most above the language's (part `term`).

    Terms are runs of A-Z, a-z and non-ASCII characters, A-Z lower-cased; a language keeps those in at least least_docs of
    its documents. With c occurrences of a kept term in a group, N of all kept terms there and V kept terms, its share is
    1 + floor(10**9 * (c + 5) / (N + 5 V)), in whole numbers; differences are exact. Ranks begin at 1 for the largest value;
    ties go to the item first in UTF-8. Null text, lang and source are empty strings. Rows are documents: repeated rows
    count each, and doc_id takes no part. A language without kept terms has pairs of value 0; a table without rows gives
    none. Other columns of docs take no part, whatever their names.
    """

    def string(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    spark = docs.sparkSession
    own = docs.select(string("lang"), string("text"), string("source"))
    tasks = parallelism(spark)
    counted = own.mapInArrow(count_terms, OCCURRENCES).repartition(tasks, "lang", "term").sortWithinPartitions("lang", "term", "source")
    kept = checkpoint(counted.mapInArrow(lambda batches: kept_runs(batches, least_docs), KEPT))
    totals = kept.groupBy("lang", "source").agg(F.sum("occurrences").alias("n"), F.sum("opens").alias("v"))
    of_lang, zero = Window.partitionBy("lang"), F.lit(0).cast("long")
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    # a row for each group; a language's groups meet in its pairs anyway
    groups = groups.select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce(F.sum("n").over(of_lang), zero).alias("whole"), F.coalesce(F.sum("v").over(of_lang), zero).alias("terms"), F.count(F.lit(1)).over(of_lang).alias("sources"))
    groups = checkpoint(groups.select("*", F.ceil(F.col("sources") / block_sources).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("terms") / range_terms)).cast("int").alias("ranges")))
    sizes = groups.select("lang", "blocks", "ranges").distinct()
    if sizes.count() <= SMALL:
        sizes = F.broadcast(sizes)
    under = PRIOR * F.col("terms")
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    heads = groups.select("*", blocks).select("*", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("range"))
    heads = heads.select("lang", "block", "range", F.lit(None).cast("string").alias("term"), "source", (F.col("n") + under).alias("occurrences"), (F.col("whole") + under).alias("whole"), "terms")
    # a term's range is that of its hash
    rows = kept.join(sizes, "lang").select("*", blocks).select("lang", "block", F.pmod(F.xxhash64("term"), F.col("ranges")).cast("int").alias("range"), "term", "source", "occurrences", zero.alias("whole"), zero.alias("terms"))
    dealt = heads.unionByName(rows).repartition(tasks, "lang", "block", "range").sortWithinPartitions("lang", "block", "range", F.col("term").asc_nulls_first(), "source")
    partial = checkpoint(dealt.mapInArrow(lambda batches: compared(batches, top, block_sources), PARTIAL))
    pairs = partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("p"), "value").select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    terms = partial.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return both.withColumn("rank", F.row_number().over(order)).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
