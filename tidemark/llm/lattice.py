"""Segmentation lattices of words over an existing subword vocabulary: forward and backward sums in log space.

A lattice's nodes are the places between a word's bytes; an arc is a vocabulary piece that stands in the word. A path
from the first node to the last is a segmentation, weighted by the product of its pieces' unigram probabilities. Many
words are worked through at once, node by node.
"""

from __future__ import annotations

import base64
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from tidemark.llm.text import Hasher, hasher

U = np.uint64
SEED = 1301
#: Bits of the filter that most spans without a piece fail.
FILTER_BITS = 22
#: Below so many arcs a step (few long words), arcs are taken one by one.
FEW = 48
NONE = -np.inf


def pieces_of(path: str) -> list[bytes]:
    """The pieces of a rank file (a line has a piece in base64 and its rank), by rank; all 256 single bytes are among them."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(piece)) for piece, rank in (line.split() for line in lines if line.strip()))
    found = [piece for _, piece in ranked]
    missing = set(range(256)) - {p[0] for p in found if len(p) == 1}
    if missing:
        raise ValueError(f"{path}: {len(missing)} single bytes are no pieces, so that some texts have no segmentation")
    return found


class Pieces:
    """Finds the pieces in bytes. Spans are known by 64-bit hashes."""

    def __init__(self, pieces: list[bytes], seed: int = SEED):
        self.count = len(pieces)
        self.hasher: Hasher = hasher(seed)
        ends = np.cumsum([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.r_[0, ends[:-1]]
        hashes = self.hasher.ranges(data, starts, ends)
        self.ids = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.ids]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("pieces repeat")
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> U(64 - FILTER_BITS)] = True
        self.lengths = np.unique(ends - starts)

    def arcs(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and pieces of all arcs in words data[begins[i]:begins[i + 1]], in no order."""
        last = np.repeat(begins[1:], np.diff(begins))
        at = np.arange(len(data))
        up, down = self.hasher.powers.to(len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        np.cumsum(self.hasher.values[data] * up[: len(data)], out=total[1:])
        found = []
        for length in self.lengths:
            at = at[at + length <= last[at]]
            if not len(at):
                break
            hashes = self.hasher.mixed(total, down, at, at + length)
            likely = self.filter[hashes >> U(64 - FILTER_BITS)]
            own, hashes = at[likely], hashes[likely]
            place = np.minimum(np.searchsorted(self.hashes, hashes), self.count - 1)
            real = self.hashes[place] == hashes
            found.append((own[real], own[real] + length, self.ids[place[real]]))
        return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The worker's own copy."""
    return Pieces(pieces_of(path))


def _summed(out: np.ndarray, come: np.ndarray, to: np.ndarray, step: np.ndarray, weight: np.ndarray) -> None:
    """out[t] = log of the sum of exp(out[come] + weight) over arcs with to = t; arcs are sorted by (step, to), and the
    nodes that they come from lie at smaller steps."""
    if not len(step):
        return
    edges = np.searchsorted(step, np.arange(1, step[-1] + 2))
    if len(step) < FEW * len(edges):
        value = out.tolist()
        for a, t, w in zip(come.tolist(), to.tolist(), weight.tolist(), strict=True):
            x, y = value[a] + w, value[t]
            if x > y:
                x, y = y, x
            value[t] = y + math.log1p(math.exp(x - y)) if x > NONE else y
        out[:] = value
        return
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi > lo:
            own = to[lo:hi]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            x = out[come[lo:hi]] + weight[lo:hi]
            most = np.maximum.reduceat(x, first)
            size = np.diff(np.r_[first, len(x)])
            out[own[first]] = most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, size)), first))


@dataclass
class Lattice:
    """Arcs of some words, in the order of the nodes they lead to: by distance from the word's begin, then by word."""

    begins: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    piece: np.ndarray
    step: np.ndarray  # of each arc: its end's distance from the word's begin

    @staticmethod
    def of(found: Pieces, data: np.ndarray, begins: np.ndarray) -> Lattice:
        # a node for each byte and one more for each word's end
        starts, ends, piece = found.arcs(data, begins)
        word = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[starts]
        step = ends - begins[word]
        order = np.lexsort((ends, step))
        return Lattice(begins, (starts + word)[order], (ends + word)[order], piece[order], step[order])

    @property
    def nodes(self) -> int:
        return int(self.begins[-1]) + len(self.begins) - 1

    def _first(self) -> np.ndarray:
        return self.begins[:-1] + np.arange(len(self.begins) - 1)

    def _last(self) -> np.ndarray:
        return self.begins[1:] + np.arange(len(self.begins) - 1)

    def _word(self) -> np.ndarray:
        return np.searchsorted(self._first(), self.starts, "right") - 1

    def forward(self, scores: np.ndarray) -> np.ndarray:
        """log of the summed weights of all paths to each node."""
        alpha = np.full(self.nodes, NONE)
        alpha[self._first()] = 0.0
        _summed(alpha, self.starts, self.ends, self.step, scores[self.piece])
        return alpha

    def backward(self, scores: np.ndarray) -> np.ndarray:
        """log of the summed weights of all paths from each node to its word's end."""
        beta = np.full(self.nodes, NONE)
        last = self._last()
        beta[last] = 0.0
        step = last[self._word()] - self.starts
        order = np.lexsort((self.starts, step))
        _summed(beta, self.ends[order], self.starts[order], step[order], scores[self.piece[order]])
        return beta

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        """log of the summed weights of all segmentations of each word."""
        return alpha[self._last()]

    def expected(self, scores: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
        """Expected uses of each piece in `counts` copies of the words."""
        alpha, beta = self.forward(scores), self.backward(scores)
        word = self._word()
        share = np.exp(alpha[self.starts] + scores[self.piece] + beta[self.ends] - self.totals(alpha)[word]) * counts[word]
        return np.bincount(self.piece, share, size)
