"""Packing of tokenised documents into fixed-length sequences by harmonic classes.

A document's tokens are cut into pieces whose lengths are reciprocals of the capacity (capacity // k), or at most
`tail` tokens. A piece's class is k, the number of such pieces that fill a bin: every bin of a class takes exactly k
pieces, so that workers fill bins independently, without looking at each other's. The pieces of a worker that fill no
bin of their class, fewer than k of each, fill sequences together, longest first, each the fullest with room; those of
sequences that stay open are handed on, some hundred at most, whatever the worker's input. They meet those of FAN - 1
other workers, what is then open meets those of other groups, and so on, so that no task takes more than a bound.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_letters
from tidemark.llm.common import checkpoint, kept, trim

CAPACITY = 2048
#: Workers whose open sequences' pieces meet at once, and the part of a sequence's tokens that may stay free.
FAN, SLACK = 16, 0.01
#: Chunks of text that a Python worker remembers with their ids; beyond it, those not met lately are forgotten.
REMEMBERED = 300_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: Chunks of these letters are lower-cased and split alike by the library and by str.lower and SIMPLE_WORDS.
SIMPLE = re.compile(r"[\x21-\x7e\n\tÀ-ÖØ-öø-ÿ]*")
SIMPLE_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+", re.ASCII)


class Encoder:
    """Ids by the tokenizers library. Chunks between spaces are tokenised once and remembered.

    Only for vocabularies whose normaliser and pre-tokeniser never look across a space, such as those that drop white
    space; checked on construction. Chunks of simple letters are split here and their words given to the library's
    model, if that gives what the whole library gives on some probes; all others go through the whole library.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self._whole("ab cd  ef\n gh's") != self._whole("ab") + self._whole("cd") + self._whole("ef\n") + self._whole("gh's"):
            raise ValueError("the vocabulary's pre-tokeniser looks across spaces")
        self.letters = {b: c for c, b in byte_letters().items()}
        self.special = [a["content"][:2] for a in json.loads(vocabulary).get("added_tokens", [])]
        self.words: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        probes = ["Don't", "L'Été,\nça", "a1b22--c!'ve", "Straße'S", "ÀÖØÞ\tx'd'll", "|<>|_^`~\\", "ñÑüÜ's't're'm"]
        self.simple = all(self._simple(p) == self._whole(p) for p in probes)

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _simple(self, chunk: str) -> bytes:
        out, known = [], self.words
        for w in SIMPLE_WORDS.findall(chunk.lower()):
            ids = known.get(w)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                own = w.encode().decode("latin-1").translate(self.letters)
                ids = known[w] = np.array([t.id for t in self.tokenizer.model.tokenize(own)], "<u4").tobytes()
            out.append(ids)
        return b"".join(out)

    def _chunk(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            simple = self.simple and len(chunk) <= 1000 and SIMPLE.fullmatch(chunk) and not any(x in chunk for x in self.special)
            ids = self._simple(chunk) if simple else self._whole(chunk)
        if len(chunk) <= 100:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[chunk] = ids
        return ids

    def forget(self) -> None:
        """Gives up the chunks, at a task's end; words stay known."""
        self.young, self.old = {}, {}

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        chunks = text.split(" ")
        found = list(map(self.young.get, chunks))
        if None in found:
            found = [self._chunk(c) if f is None else f for c, f in zip(chunks, found, strict=True)]
        return b"".join(found)


def encoder(vocabulary: str) -> Encoder:
    return kept("encoder-" + hashlib.sha256(vocabulary.encode()).hexdigest(), lambda: Encoder(vocabulary))


def cuts(n: int, capacity: int = CAPACITY, tail: int = 32) -> list[int]:
    """Lengths of the pieces of n tokens: capacity // k for the smallest k that fits, until at most `tail` remain."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n > tail:
        k = -(-capacity // n)
        while capacity // k > n:
            k += 1
        out.append(capacity // k)
        n -= capacity // k
    return out + [n] * (n > 0)


def pieces(docs: DataFrame, vocabulary_path: str, *, end_id: int = 1, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the documents' tokens, end_id after each document, cut.

    A null text counts as empty: its document is the one token end_id. With keep_ids, a column ids (array<int>) too.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ending = encoder(vocabulary.value), np.array([end_id], "<u4").tobytes()
        known: dict[int, list[int]] = {}
        for batch in batches:
            rows: list[tuple] = []
            ids: list[np.ndarray] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                packed = own.encode(text.as_py() or "") + ending
                n, start = len(packed) // 4, 0
                view = memoryview(packed)
                for length in [capacity] * (n // capacity) + known.setdefault(n % capacity, cuts(n % capacity, capacity)):
                    part = view[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(part), n))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                    start += length
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)
            del columns, rows, ids
            batch = text = view = part = packed = None
        own.forget()
        trim()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, PIECE + ", ids array<int>" * keep_ids)


def _fill(table: pa.Table, capacity: int, first: int) -> tuple[pa.Table, int]:
    """Full bins of each class, in order of (class, doc_id, start): sequence_id counts from `first`; null where left over."""
    length = table["length"].to_numpy()
    table = table.take(pa.array(np.lexsort((table["start"].to_numpy(), table["ids_crc32"].to_numpy(), table["doc_id"].fill_null(-1 << 63).to_numpy(), length))))
    length = table["length"].to_numpy()
    begin = np.r_[True, length[1:] != length[:-1]] if len(length) else np.zeros(0, bool)
    group = np.cumsum(begin) - 1
    at = np.arange(len(length)) - np.flatnonzero(begin)[group] if len(length) else np.zeros(0, np.int64)
    count = np.bincount(group)[group] if len(length) else np.zeros(0, np.int64)
    k = np.maximum(capacity // np.maximum(length, 1), 1)
    full = at < count // k * k
    new = full & (at % k == 0)
    sequence = np.where(full, first + np.cumsum(new) - 1, 0)
    out = table.append_column("sequence_id", pa.array(sequence, pa.int64(), mask=~full)).append_column("offset", pa.array(at % k * length, pa.int64(), mask=~full))
    return out, int(new.sum())


def _together(table: pa.Table, capacity: int, first: int, slack: int | None) -> pa.Table:
    """Packs pieces of all lengths: longest first into the fullest sequence with room. Pieces of sequences with more than
    slack tokens free get none (sequence_id is null), if slack is given."""
    order = np.lexsort((table["ids_crc32"].to_numpy(), table["start"].to_numpy(), table["doc_id"].fill_null(-1 << 63).to_numpy(), -table["length"].to_numpy()))
    table = table.take(pa.array(order))
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, used = 0, []  # a bit for each number of free tokens that some sequence has
    sequence, offset = [], []
    for n in table["length"].to_pylist():
        fits = open_ >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            s = room[free].pop()
            if not room[free]:
                open_ ^= 1 << free
        else:
            used.append(0)
            free, s = capacity, len(used) - 1
        sequence.append(s)
        offset.append(used[s])
        used[s] += n
        if free > n:
            room[free - n].append(s)
            open_ |= 1 << (free - n)
    sequence = np.array(sequence, np.int64)
    waits = (capacity - np.array(used, np.int64) > slack)[sequence] if slack is not None and len(sequence) else np.zeros(len(sequence), bool)
    for name, values in (("sequence_id", first + sequence), ("offset", np.array(offset, np.int64))):
        table = table.set_column(table.schema.get_field_index(name), name, pa.array(values, pa.int64(), mask=waits))
    return table


def _meeting(capacity: int, level: int, slack: int | None) -> Callable[[pa.Table], pa.Table]:
    """What a group of workers does with the pieces that they hand on: its sequences' ids tell level and group."""
    return lambda t: _together(t, capacity, (1 << 62) + (level << 56) + (t["worker"][0].as_py() << 24), slack)


def pack(cut: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset (gapless from 0 in its sequence).

    cut is as `pieces` returns it, with a null doc_id or not. Ties and repeated rows are separate pieces; an empty table
    gives an empty one. The pieces are written out first, so that a lost executor's work is repeated on the same rows.
    Sequence ids are unique and not dense: a worker's number is in their upper bits.
    """
    cut = checkpoint(cut)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id bigint, offset bigint, worker int"
    slack = int(SLACK * capacity)

    def by_worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = None
        number = TaskContext.get().partitionId()
        first = (number + 1) << 36

        def named(t: pa.Table) -> list[pa.RecordBatch]:
            return t.append_column("worker", pa.array(np.full(t.num_rows, number, np.int32))).to_batches()

        for batch in batches:  # pieces left over meet those of the next batch
            new = pa.Table.from_batches([batch])
            table = new if table is None else pa.concat_tables([table, new])
            if table.num_rows < 50_000:
                continue
            out, n = _fill(table, capacity, first)
            first += n
            table = out.filter(out["sequence_id"].is_null()).drop_columns(["sequence_id", "offset"])
            yield from named(out.filter(out["sequence_id"].is_valid()))
        if table is not None:
            out, n = _fill(table, capacity, first)
            yield from named(out.filter(out["sequence_id"].is_valid()))
            yield from named(_together(out.filter(out["sequence_id"].is_null()), capacity, first + n, slack))

    filled = checkpoint(cut.mapInArrow(by_worker, schema))
    found = lambda df: df.where(F.col("sequence_id").isNotNull()).drop("worker")
    done, left, level = found(filled), filled.where(F.col("sequence_id").isNull()), 0
    workers = (left.agg(F.max("worker")).first()[0] or 0) + 1
    while True:
        workers, level = -(-workers // FAN), level + 1
        met = left.withColumn("worker", F.floor(F.col("worker") / FAN).cast("int")).groupBy("worker")
        again = met.applyInArrow(_meeting(capacity, level, slack if workers > 1 else None), schema)
        if workers == 1:
            return done.unionByName(found(again))
        again = checkpoint(again)
        done, left = done.unionByName(found(again)), again.where(F.col("sequence_id").isNull())


def packed_documents(docs: DataFrame, vocabulary_path: str, *, end_id: int = 1, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Whole texts are packed, null and empty ones as the one token end_id. Repeated rows, and rows without doc_id, are
    documents of their own; other columns of docs are not kept, whatever their names. An empty table gives an empty one.
    """
    return pack(pieces(docs, vocabulary_path, end_id=end_id, capacity=capacity, keep_ids=keep_ids), capacity=capacity)
