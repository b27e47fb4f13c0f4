"""Texts to vectors by any model: loaded once in a worker, asked in batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A model: texts to one row of numbers each.
Model = Callable[[Sequence[str]], np.ndarray]


class Hashed:
    """Words, split at single spaces, hashed into signed sums and scaled to length 1: a model without anything to load. A
    word's place and sign come from its md5."""

    def __init__(self, width: int = 64):
        self.width = width
        self.place = lru_cache(maxsize=1 << 16)(self._place)

    def _place(self, word: str) -> tuple[int, float]:
        n = int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:4], "big")
        return n % self.width, 1.0 if n // self.width % 2 else -1.0

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts, strict=True):
            for word in text.split(" "):
                if word:
                    at, sign = self.place(word)
                    row[at] += sign
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def hashed(width: int = 64) -> Model:
    return Hashed(width)


@lru_cache(maxsize=4)
def handle(load: Callable[..., Model], *arguments) -> Model:
    """The worker's own model: loaded at the first batch, kept for the tasks after it."""
    return load(*arguments)


def embedded(df: DataFrame, text: str, *, load: Callable[..., Model] = hashed, arguments: Sequence = (), batch: int = 256, out: str = "embedding") -> DataFrame:
    """df with `out`, an array of doubles: what load(*arguments) makes of the text. load is a function that workers can
    import, its arguments can be hashed. A NULL text has a NULL vector and is not given to the model; texts go to it whole,
    `batch` at a time."""
    own = df.drop(out)
    kind = own.select(text).schema[0].name
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields) + f", `{out}` array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for part in batches:
            texts = part.column(part.schema.get_field_index(kind)).to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None]
            vectors: list[np.ndarray | None] = [None] * len(texts)
            for lo in range(0, len(known), batch):
                model = model or handle(load, *arguments)
                rows = known[lo : lo + batch]
                found = np.asarray(model([texts[i] for i in rows]), float)
                if found.shape[:1] != (len(rows),) or found.ndim != 2:
                    raise ValueError("a model gives one row for each text")
                for i, v in zip(rows, found, strict=True):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float64()))], [*part.schema.names, out])

    return own.mapInArrow(run, schema)
