"""BPE encoding and decoding by a deterministic tokenization automaton.

The automaton's arcs are labelled with tokens; a path from the start spells a text, and exactly the token sequences
that BPE yields are paths. It is compiled merge by merge: for the merge (u, v) -> w the gadget gives u a new target
state, a copy of its old one without the arc v (u followed by v is no longer a token sequence), and gives each state
that has the arc u, if u's old target has the arc v, an arc w to v's target. All arcs of one label lead to one state, so
that the transition table is a bit for each state and label, and a target for each label.

Arcs that a state lacks because v was removed from it are v and the labels whose arcs were to be made from v's later.
With labels numbered along the tree of left parts, those made later first, they are one interval: a state is the state
it was copied from less an interval, and its row of the table is filled when it is first entered.

Encoding walks all paths at once: every beginning of a word is spelt by one path, so that each position has one state;
arcs from there are the labels found in the text whose bit is set. The path that ends with the word is BPE's result.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import document_rows, document_schema, with_rest

#: Fixed value: the byte-level pre-tokenizer's published pattern, for its classes of letters, numbers and white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{O}+|{S}+(?!{X})|{S}+"
#: Blocks of letters that are not probed: Han, Hangul, Han extension B. Above them, planes 4 to 16 have no letters.
KNOWN = (range(0x4E00, 0x9FA6), range(0xAC00, 0xD7A4), range(0xD800, 0xF900), range(0x20000, 0x2A6D7))
PROBED = 0x40000
#: Words that a Python worker remembers with their tokens; beyond it, those not met lately are forgotten.
REMEMBERED = 400_000
#: Rows of the transition table that a worker keeps (a bit a label each); beyond it, they are filled anew.
ROWS = 8192


def byte_letters() -> dict[str, int]:
    """The byte for each letter of a byte-level vocabulary: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def word_pattern(vocabulary: str) -> str:
    """The pre-tokenizer's pattern, with character classes as the library has them.

    Its Unicode tables can be of another version than those of Python's packages. Code points are put behind a letter,
    a digit and a sign: the library joins them with those of their own class only.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_str(vocabulary).pre_tokenizer.pre_tokenize_str
    points = [c for c in range(PROBED) if not any(c in block for block in KNOWN)]
    found: dict[str, set[int]] = {}
    for name, before in (("L", "a"), ("N", "1"), ("O", "!")):
        own = found[name] = set()
        for at in range(0, len(points), 1 << 14):
            part = points[at : at + (1 << 14)]
            begins = {start for _, (start, _) in split("".join(f"{before}{chr(c)}\n" for c in part))}
            own.update(c for i, c in enumerate(part) if 3 * i + 1 not in begins)
    found["S"] = set(points) - found["L"] - found["N"] - found.pop("O")
    texts = "".join(map(chr, points))
    classes = {}
    for name, usual in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s")):
        packaged = {ord(c) for c in regex.findall(usual, texts)}
        more, less = _ranges(found[name] - packaged), _ranges(packaged - found[name])
        classes[name] = f"[[{usual}{more}]--[{less}]]" if less else f"[{usual}{more}]"
    classes |= {"O": f"[^{classes['S']}{classes['L']}{classes['N']}]", "X": f"[^{classes['S']}]"}
    pattern = PATTERN
    for name, own in classes.items():
        pattern = pattern.replace(f"{{{name}}}", own)
    return f"(?V1){pattern}\n(?V1){classes['S']}"


def _ranges(points: set[int]) -> str:
    """For a character class: the runs of the points."""
    ordered = sorted(points)
    firsts = [c for c in ordered if c - 1 not in points]
    lasts = [c for c in ordered if c + 1 not in points]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts, strict=True))


class Automaton:
    """Compiled from a byte-level vocabulary file in the JSON format of the tokenizers library."""

    def __init__(self, vocabulary: str):
        data = json.loads(vocabulary)
        model, letters = data["model"], byte_letters()
        ids: dict[str, int] = model["vocab"]
        if model["type"] != "BPE" or data.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("a byte-level BPE vocabulary without normalizer, dropout and ignore_merges is expected")
        split = data.get("pre_tokenizer") or {}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("a byte-level pre-tokenizer with its own pattern and without a prefix space is expected")
        self.special = {a["content"]: a["id"] for a in data.get("added_tokens", [])}
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in data.get("added_tokens", [])):
            raise ValueError("added tokens that strip or join words are not handled")
        self.label = {i: bytes(letters[c] for c in t) for t, i in ids.items() if all(c in letters for c in t)}
        #: Left and right part and rank of merged tokens; the state that a token's arcs lead to.
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.target: dict[int, int] = {ids[c]: 0 for c in letters if c in ids}
        #: Each state: the one it was copied from, and the label and rank of the arc that it lost.
        self.copied: list[int] = [-1]
        self.lost: list[tuple[int, int]] = [(-1, -1)]
        #: Rank at which v was removed from the target of u; labels that have arcs.
        self.removed: dict[tuple[int, int], int] = {}
        self.alive = set(self.target)
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self._gadget(ids[left], ids[right], ids[left + right], rank)
        self._number()
        self.step, self.ends = self._trie()
        self.rows: dict[int, bytes] = {}
        self.label |= {i: c.encode() for c, i in self.special.items()}

    def _gadget(self, u: int, v: int, w: int, rank: int) -> None:
        if u not in self.target or v not in self.target or w in self.target:
            raise ValueError(f"merge {rank} comes before its parts or makes a token twice")
        if u in self.alive and v in self.alive and self._has_arc(u, v):
            self.alive.add(w)
        self.target[w] = self.target[v]
        self.parts[w] = (u, v, rank)
        self.copied.append(self.target[u])
        self.lost.append((v, rank))
        self.target[u] = len(self.copied) - 1
        self.removed[u, v] = rank

    def _has_arc(self, s: int, t: int) -> bool:
        """Whether the target of s has the arc t at this point of the compilation.

        The state was copied along s's right parts; the arc is missing if a label on t's left spine was removed there
        by the time the label above it was made (by the same merge too: in the copy, (u, u) finds no arc u).
        """
        removed, parts = self.removed, self.parts
        until = len(removed)
        while True:
            limit, x = until, t
            while True:
                rank = removed.get((s, x))
                if rank is not None and rank < until and rank < limit:
                    return False
                if x not in parts:
                    break
                x, _, made = parts[x]
                limit = made + 1
            if s not in parts:
                return True
            _, s, until = parts[s]

    def _number(self) -> None:
        """Numbers labels in the order of the trees of left parts, and turns each state's lost arcs into an interval."""
        later: dict[int, list[int]] = {}
        for w, (u, _, _) in reversed(self.parts.items()):  # made last comes first
            later.setdefault(u, []).append(w)
        self.order: list[int] = []
        self.place: dict[int, int] = {}
        behind: dict[int, int] = {}
        stack = [t for t in self.target if t not in self.parts]
        while stack:
            t = stack.pop()
            if t < 0:
                behind[~t] = len(self.order)
                continue
            self.place[t] = len(self.order)
            self.order.append(t)
            stack.append(~t)
            stack += reversed(later.get(t, []))
        self.spans = [(0, 0)]
        ranks = {v: [-self.parts[w][2] for w in ws] for v, ws in later.items()}
        for v, rank in self.lost[1:]:
            ws = later.get(v, [])
            n = bisect_right(ranks[v], -rank) if ws else 0  # those made at this rank or later
            self.spans.append((self.place[v], behind[ws[n - 1]] if n else self.place[v] + 1))
        self.goes = [self.target[t] for t in self.order]
        self.start = np.array([t in self.alive for t in self.order], bool)

    def row(self, state: int) -> bytes:
        """The state's row of the transition table: the bits of the labels (by number) that it has arcs for."""
        known = self.rows.get(state)
        if known is None:
            arcs, s = self.start.copy(), state
            while s:
                lo, hi = self.spans[s]
                arcs[lo:hi] = False
                s = self.copied[s]
            if len(self.rows) >= ROWS:
                self.rows.clear()
            known = self.rows[state] = np.packbits(arcs, bitorder="little").tobytes()
        return known

    def _trie(self) -> tuple[dict[int, int], list[int]]:
        """The arcs' labels by their bytes: nodes from (node * 256 + byte), and the number of the label that ends at each
        node, or -1."""
        step: dict[int, int] = {}
        ends = [-1]
        for t in self.alive:
            node = 0
            for byte in self.label[t]:
                key = node << 8 | byte
                if key not in step:
                    step[key] = len(ends)
                    ends.append(-1)
                node = step[key]
            ends[node] = self.place[t]
        return step, ends

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word: the labels of the one path that spells it."""
        step, ends, goes, row, n = self.step, self.ends, self.goes, self.row, len(word)
        came, label = [-1] * (n + 1), [0] * (n + 1)
        state = 0
        for at in range(n):
            if at:
                if came[at] < 0:
                    raise ValueError("a byte is not in the vocabulary")
                state = goes[label[at]]
            arcs, node = row(state), 0
            for i in range(at, n):
                node = step.get(node << 8 | word[i])
                if node is None:
                    break
                t = ends[node]
                if t >= 0 and arcs[t >> 3] >> (t & 7) & 1:
                    came[i + 1], label[i + 1] = at, t
        path, at = [], n
        while at:
            if came[at] < 0:
                raise ValueError("a byte is not in the vocabulary")
            path.append(self.order[label[at]])
            at = came[at]
        return path[::-1]


class Table:
    """Byte strings by id; many ids at once give their strings one after another."""

    def __init__(self, strings: dict[int, bytes]):
        n = max(strings, default=-1) + 1
        self.length = np.array([len(strings.get(i, b"")) for i in range(n)], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(strings.get(i, b"") for i in range(n)), np.uint8)

    def emit(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and where each id's string ends in them."""
        length = self.length[ids]
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - length), length)
        return self.data[at], ends


class Coder:
    """Encodes whole texts: added tokens first, then words, which it remembers in two generations."""

    def __init__(self, vocabulary: str, pattern: str | None = None):
        self.automaton = Automaton(vocabulary)
        words, space = (pattern or word_pattern(vocabulary)).split("\n")
        self.words = regex.compile(words)
        self.odd = regex.compile(f"(?V1) {space[5:]}|{space[5:]} ")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.automaton.special, key=len, reverse=True))) + ")") if self.automaton.special else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.labels = Table(self.automaton.label)
        self.decimals = Table({i: f"{i},".encode() for i in self.automaton.label})

    def _remember(self, chunk: str, ids: bytes) -> bytes:
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        if len(chunk) <= 100:
            self.young[chunk] = ids
        return ids

    def _word(self, word: str) -> bytes:
        return array("I", self.automaton.encode(word.encode())).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Packed ids of a chunk, which is split as a text of its own."""
        known = self.old.get(chunk)
        if known is not None:
            return self._remember(chunk, known)
        words = self.words.findall(chunk)
        if len(words) == 1:
            return self._remember(chunk, self._word(chunk))
        out = []
        for w in words:
            known = self.young.get(w) or self.old.get(w)
            out.append(self._remember(w, self._word(w)) if known is None else known)
        return self._remember(chunk, b"".join(out))

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.odd.search(text):
            chunks = self.words.findall(text)
        else:  # single spaces begin words, so that chunks can be split one by one
            first, *rest = text.split(" ")
            chunks = [first] * bool(first) + [f" {x}" for x in rest]
        found = list(map(self.young.get, chunks))
        if None in found:
            found = [self._chunk(c) if f is None else f for c, f in zip(chunks, found, strict=True)]
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit numbers."""
        if self.specials is None or not self.specials.search(text):
            return self._plain(text)
        parts = self.specials.split(text)
        return b"".join(array("I", [self.automaton.special[p]]).tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, ids: np.ndarray) -> str:
        """The arc labels of the ids, one after another, as text."""
        return self.labels.emit(ids)[0].tobytes().decode("utf-8", "replace")


_CODERS: dict[str, Coder] = {}


def coder(vocabulary: str, pattern: str) -> Coder:
    """The worker's own coder for a vocabulary; compiled once per Python worker."""
    key = hashlib.sha256((vocabulary + pattern).encode()).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = Coder(vocabulary, pattern)
    return _CODERS[key]


def encode_documents(docs: DataFrame, vocabulary_path: str, *, keep_ids: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>) and decoded.

    A null text is encoded as an empty one: no tokens, the digest of the empty string. Rows are independent: ties and
    repeated rows give equal results, an empty table gives an empty result; docs' own columns of the new names are
    replaced; rows without doc_id are encoded like others. Long texts are encoded whole. The driver reads the vocabulary file and sends its text (size bound: the vocabulary's, some MB).
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        text = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((text, word_pattern(text)))
    rows = document_rows(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(*shared.value)
        for batch in batches:
            texts = batch.column("text")
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for packed in _groups(own, texts):
                ids = np.frombuffer(b"".join(packed), np.uint32)
                ends = np.cumsum([len(p) // 4 for p in packed])
                (digits, digit_ends), (label, label_ends) = own.decimals.emit(ids), own.labels.emit(ids)
                digits, label = digits.tobytes(), label.tobytes()
                place = lambda by, n: int(by[n - 1]) if n else 0
                begin = 0
                for end in map(int, ends):
                    coded = digits[place(digit_ends, begin) : place(digit_ends, end)][:-1]
                    text = label[place(label_ends, begin) : place(label_ends, end)].decode("utf-8", "replace")
                    out["n_tokens"].append(end - begin)
                    out["ids_sha256"].append(hashlib.sha256(coded).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_ids:
                        out["ids"].append(ids[begin:end].astype(np.int32))
                        out["decoded"].append(text)
                    begin = end
            columns = {"doc_id": batch.column("doc_id")}
            if keep_ids:
                columns |= {"text": texts, "rest": batch.column("rest")}
            columns |= {"n_tokens": pa.array(out["n_tokens"], pa.int64())} | {k: pa.array(out[k], pa.string()) for k in ("ids_sha256", "decoded_sha256")}
            if keep_ids:
                columns |= {"ids": pa.array(out["ids"], pa.list_(pa.int32())), "decoded": pa.array(out["decoded"], pa.string())}
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    if not keep_ids:
        return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    out = rows.mapInArrow(run, document_schema(rows, "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"))
    return with_rest(out, docs, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")


def _groups(own: Coder, texts: pa.Array, size: int = 1 << 18) -> Iterator[list[bytes]]:
    """The packed ids of the texts, by groups of at most about `size` ids."""
    group: list[bytes] = []
    n = 0
    for text in texts:
        packed = own.encode(text.as_py() or "")
        if group and n + len(packed) // 4 > size:
            yield group
            group, n = [], 0
        group.append(packed)
        n += len(packed) // 4
    if group:
        yield group


def decode_ids(tokens: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, ids array<int>) to (doc_id, text); a null or empty list gives an empty text."""
    with open(vocabulary_path, encoding="utf-8") as f:
        text = f.read()
    shared = tokens.sparkSession.sparkContext.broadcast((text, word_pattern(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(*shared.value)
        for batch in batches:
            texts = [own.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
