"""Tokenising, packing, line and substring dedup and the n-gram join against plain versions."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import jaccard, packing
from tidemark.llm.bpe import Automaton, Coder, decode_ids, encode_documents
from tidemark.llm.components import components
from tidemark.llm.jaccard import near_copies
from tidemark.llm.linededup import PerfectHash, dedup_lines
from tidemark.llm.packing import Encoder, cuts, packed_documents
from tidemark.llm.queries import vocabulary
from tidemark.llm.substring import remove_repeats
from tidemark.llm.text import Hasher, laid_out, text_column

LOWER = {c: c + 32 for c in range(65, 91)}
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

ODD = ["  a  b\n\n c\t\td  ", "<|endoftext|>x<|endoftext|><|endoftext|>", "'s it's  't 　x  y", "aaaaaaa" * 30, " \n \n", "日本語🎉🎉 é́", "\r\n\r\nfoo \x00 bar\x85baz", "VBLCCCCE CCC", "a<|endoftext|", ""]


def tokenizer(name):
    t = Tokenizer.from_file(vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


def noise(n, letters="aabcdehtino  \n\t'.!<|>éÉß日🎉  0123", seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def edge(spark):
    """Nulls, empty texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [(1, None, 1, "a"), (2, "", 2, None), (2, "", 2, None), (3, " \t\n", 3, "a"), (4, "one Two three", 4, "a"), (5, "one two THREE", 5, "a"), (6, long, 6, "a"), (7, long + " end", 7, "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, bucket int, n_words string")


def test_bpe_equals_the_library():
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        coder = Coder(f.read())
    t = tokenizer("byte_bpe_50k.json")
    for text in ODD + noise(800):
        want = t.encode(text, add_special_tokens=False).ids
        packed = np.frombuffer(coder.encode(text), np.uint32)
        assert packed.tolist() == want, text
        assert coder.decode(packed) == t.decode(want, skip_special_tokens=False)


def test_bpe_splits_as_the_library_on_every_kind_of_character():
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        coder = Coder(f.read())
    t = tokenizer("byte_bpe_50k.json")
    for lo in range(0, 0x110000, 4096):
        text = "".join(f"a{chr(c)}1 {chr(c)}'ll{chr(c)} !" for c in range(lo, lo + 4096, 1 if lo < 0x4000 or 0x3D000 <= lo < 0x40000 else 7) if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(coder.encode(text), np.uint32).tolist() == t.encode(text, add_special_tokens=False).ids, hex(lo)


def test_automaton_rows():
    """Each state's row is what the gadgets make, on a small vocabulary built arc by arc."""
    letters = "abc"
    merges = ["a b", "a a", "aa b", "b c", "ab a", "bc b", "aa aa", "c ab"]
    vocab = {t: i for i, t in enumerate([*letters, *dict.fromkeys(m.replace(" ", "") for m in merges)])}
    data = {"model": {"type": "BPE", "vocab": vocab, "merges": merges}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}
    own = Automaton(json.dumps(data))
    arcs, target = [{vocab[c]: 0 for c in letters}], {vocab[c]: 0 for c in letters}
    for m in merges:
        u, v = (vocab[x] for x in m.split(" "))
        w, old = vocab[m.replace(" ", "")], target[vocab[m.split(" ")[0]]]
        whole = v in arcs[old]
        copy = {t: to for t, to in arcs[old].items() if t != v}
        arcs.append(copy)
        target[u], target[w] = len(arcs) - 1, target[v]
        for state in arcs:
            if u in state and whole:
                state[w] = target[w]
    for s, state in enumerate(arcs):
        bits = np.unpackbits(np.frombuffer(own.row(s), np.uint8), bitorder="little", count=len(own.order))
        assert {own.order[i] for i in np.flatnonzero(bits)} == set(state)
    assert own.target == target


def test_bpe_documents(spark, documents):
    t = tokenizer("byte_bpe_50k.json")
    for df in (documents, edge(spark)):
        out = encode_documents(df, vocabulary("byte_bpe_50k.json"))
        assert [c for c in out.columns if c in df.columns] == df.columns
        for r in out.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) == (len(ids), sha(",".join(map(str, ids))), sha(r.text or ""), ids)
    back = decode_ids(encode_documents(documents, vocabulary("byte_bpe_50k.json")), vocabulary("byte_bpe_50k.json"))
    assert sorted(rows_of(back)) == sorted(rows_of(documents))
    assert encode_documents(documents.where("false"), vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing_encoder_equals_the_library():
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        own = Encoder(f.read())
    t = tokenizer("word_bpe_49k.json")
    for text in ODD + noise(800, seed=4) + ["İstanbul ΣΑΣ <|startoftext|> x"]:
        assert own.encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_cuts():
    assert all(sum(cuts(n)) == n and max(cuts(n), default=0) <= 2048 for n in range(5000))


def test_packing(spark, documents, monkeypatch):
    t = tokenizer("word_bpe_49k.json")
    for df in (documents, edge(spark).dropDuplicates(["doc_id"])):
        found = packed_documents(df, vocabulary("word_bpe_49k.json")).collect()
        ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in rows_of(df)}
        by, sequences = collections.defaultdict(list), collections.defaultdict(list)
        for r in found:
            by[r.doc_id].append(r)
            sequences[r.sequence_id].append(r)
        assert by.keys() == ids.keys()
        for i, parts in by.items():
            at = 0
            for r in sorted(parts, key=lambda r: r.start):
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids[i]), zlib.crc32(ids[i][at : at + r.length].tobytes()))
                at += r.length
            assert at == len(ids[i])
        for parts in sequences.values():
            at = 0
            for r in sorted(parts, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 2048
        assert len(sequences) <= sum(map(len, ids.values())) / 2048 * 1.05 + 2
    assert packed_documents(documents.where("false"), vocabulary("word_bpe_49k.json")).count() == 0
    # repeated rows and rows without doc_id are documents of their own
    some = edge(spark).unionByName(spark.createDataFrame([(None, "a b", 1, None)] * 3 + [(None, None, 1, None)], "doc_id long, text string, bucket int, n_words string"))
    for fan in (16, 2):
        monkeypatch.setattr(packing, "FAN", fan)
        found = packed_documents(some.repartition(7), vocabulary("word_bpe_49k.json")).collect()
        assert len([r for r in found if r.start == 0]) == some.count() and len({(r.sequence_id, r.offset) for r in found}) == len(found)
    kept = packed_documents(edge(spark), vocabulary("word_bpe_49k.json"), keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in kept)


def test_word_hashes():
    texts = [*ODD, "A a", None]
    column = text_column(__import__("pyarrow").array(texts))
    seen = {}
    for s in laid_out(column, size=16):
        hashes = Hasher(1, True).ranges(s.data, s.starts, s.ends)
        for i in range(len(s.bounds) - 1):
            words = [w.lower() for w in (texts[s.first + i] or "").encode().split()]
            assert len(words) == s.bounds[i + 1] - s.bounds[i]
            for w, h in zip(words, hashes[s.bounds[i] : s.bounds[i + 1]].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    assert sorted(PerfectHash.build(keys).find(keys).tolist()) == list(range(n))


def plain_lines(rows, chars, least):
    key = lambda x: x.strip("\t\n\x0b\x0c\r ").translate(LOWER)
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars:
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= least and max(holders[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark, documents):
    line = ["Same Long line é" * 3, "same long LINE é" * 3 + "\t", "  " + "same long line é" * 3]
    small = spark.createDataFrame([(i, f"{line[i % 3]}\nown {i}\n" + line[0]) for i in range(7)] + [(20, None), (21, ""), (22, "x\n\nx")], "doc_id long, text string")
    for df, chars, least in ((documents, 40, 5), (small, 40, 5), (small, 2, 2), (edge(spark), 3, 2)):
        found = dedup_lines(df, least_chars=chars, least_docs=least)
        assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()) == plain_lines(rows_of(df), chars, least)
        assert all(r.kept_sha256 == sha(r.text) for r in found.collect())
    assert dedup_lines(small.where("false")).count() == 0


def plain_substrings(rows, k):
    first = {}
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = {q for p in range(len(w) - k + 1) if first[tuple(w[p : p + k])] < i for q in range(p, p + k)}
        out.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    return sorted(out)


def test_substring_dedup(spark, documents):
    r = random.Random(8)
    base = [[f"v{r.randint(0, 50)}" for _ in range(40)] for _ in range(4)]
    small = [(i * 3 % 101, " ".join(w for b in r.sample(base, 2) for w in b[r.randint(0, 20) :] + ["x"] * r.randint(0, 2))) for i in range(40)]
    repeated = [(i, "a b " * r.randint(0, 12)) for i in range(200, 220)]
    small = spark.createDataFrame([*small, *repeated, (300, None), (301, ""), (302, " q ")], "doc_id long, text string")
    for df, k in ((documents, 13), (small, 13), (small, 7), (edge(spark), 13)):
        found = remove_repeats(df, window=k).collect()
        assert sorted((x.doc_id, x.n_words, x.n_removed, x.text) for x in found) == plain_substrings(rows_of(df), k)
        assert all(x.kept_sha256 == sha(x.text) for x in found)
    assert remove_repeats(small.where("false")).count() == 0


def plain_groups(rows):
    sets, root = {}, {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        root[i] = i
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return sorted((i, len(sets[i]), root[i]) for i, _ in rows)


def near(spark):
    r = random.Random(5)
    rows = []
    for _ in range(6):
        base = [r.choice("abcdefghij") + r.choice("abcdefghij") for _ in range(r.choice([3, 7, 40, 80]))]
        for _ in range(15):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                w[r.randrange(len(w))] = r.choice("xyz") * 2
            rows.append((len(rows) * 3 % 997, " ".join(w)))
    return spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, " x\ty "), (1003, "x Y")], "doc_id long, text string")


@pytest.mark.parametrize(("block", "heavy"), [(512, 4096), (7, 10)])
def test_near_copies(spark, documents, monkeypatch, block, heavy):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    for df in (documents, near(spark), edge(spark).dropDuplicates(["doc_id"])):
        found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_copies(df).collect())
        assert found == plain_groups(rows_of(df))
    assert near_copies(documents.where("false")).count() == 0
    assert near_copies(edge(spark)).count() == edge(spark).count()


def test_near_copies_of_repeated_doc_ids(spark):
    import corpus_pipeline

    r = random.Random(9)
    base = [[f"{c}{r.randint(0, 999)}" for _ in range(60)] for c in "abcd"]
    rows = [(3, base[0]), (7, base[0]), (7, base[1]), (9, [*base[1][:-1], "x"]), (8, base[2]), (8, base[3]), (12, [*base[3][:-1], "x"]), (11, base[2][1:]), (12, base[0]), (5, base[3][2:]), (3, base[0])]
    rows = [(i, " ".join(w)) for i, w in rows]
    # brute force over rows: each row is a document of its own number
    groups = {n: c for n, _, c in plain_groups([(n, t) for n, (_, t) in enumerate(rows)])}
    least = {c: min(rows[n][0] for n in groups if groups[n] == c) for c in groups.values()}
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (4, None), (4, None)], "doc_id long, text string")
    found = sorted((x.doc_id, x.component_id) for x in near_copies(df).where("n_shingles > 0 and doc_id is not null").collect())
    assert found == sorted((rows[n][0], least[c]) for n, c in groups.items())
    kept = rows_of(corpus_pipeline.jaccard_join(spark, df, ""))
    assert sorted(i for i, t in kept if t and i is not None) == sorted(least.values())
    texts = {t: groups[n] for n, (_, t) in enumerate(rows)}
    assert len({texts[t] for i, t in kept if t and i is not None}) == len(least) and kept.count((4, None)) == 2 and (None, rows[0][1]) in kept


def test_rows_without_doc_id(spark):
    line = "this is a long line that many documents hold, here"
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(None, line)] * 3 + [(None, None)] * 2 + [(1, line + "\n" + words), (2, line), (2, line), (None, words), (None, words)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    lines = dedup_lines(df, least_docs=5)
    assert sorted((r.doc_id or 0, r.n_dropped, r.text) for r in lines.collect()) == sorted([(0, 1, "")] * 3 + [(0, 0, "")] * 2 + [(1, 1, words), (2, 0, line), (2, 0, line), (0, 0, words), (0, 0, words)])
    alone = dedup_lines(df.where("doc_id is null"), least_docs=3)
    assert sorted(r.text for r in alone.collect()) == sorted(["", "", words, words, line, line, line])
    cut = remove_repeats(df)
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in cut.collect()) == sorted([(0, 10, 0)] * 3 + [(0, 0, 0)] * 2 + [(1, 40, 0), (2, 10, 0), (2, 10, 0), (0, 30, 30), (0, 30, 30)])
    groups = near_copies(df)
    assert sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in groups.collect()), key=str) == sorted([(0, 6, None)] * 3 + [(0, 0, None)] * 2 + [(1, 36, 1), (2, 6, 2), (2, 6, 2), (0, 26, None), (0, 26, None)], key=str)
    assert encode_documents(df, vocabulary("byte_bpe_50k.json"), keep_ids=False).count() == 10


def test_overlaps():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 1 << 64, 50, np.uint64) // np.uint64(1 << 59)) for _ in range(9)]
    assert jaccard.overlaps(sets, 4).tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]


def test_links_of_large_sets_are_exact():
    # 671,097 common of 894,796 distinct shingles are exactly 75 %; one less common is below
    for common, links in ((671_097, 1), (671_096, 0)):
        a, b = np.arange(common, dtype="<u8"), np.arange(894_796, dtype="<u8")
        counted = []
        for f, (x, y) in enumerate(zip(np.array_split(a, 3), [b[:99], *np.array_split(b[99:], 2)], strict=True)):
            parts = ([a, b[:0], b[:0]][f], [b, b[:0], b[:0]][f]) if common % 2 else (x, np.intersect1d(b, x))
            cell = pa.table({"i": [5] * 2, "j": [6] * 2, "fragment": pa.array([f] * 2, pa.int32()), "block": [5, 6], "doc_id": [1, 2], "n": [common, 894_796], "part": [p.tobytes() for p in parts]})
            counted.append(jaccard._count(cell))
        assert jaccard._decide(pa.concat_tables(counted), 75).num_rows == links


def test_fragments_cut_the_order():
    r = np.random.default_rng(7)
    levels = np.array([0, 5, 9, 0, 6] + [0] * 11)
    tokens = np.concatenate([np.sort(r.integers(0, 1 << 64, n, np.uint64)) for n in levels])
    at = [(1, 1 << 63), (2, 0), (2, (1 << 64) - 1)]
    parts = jaccard.cut(levels, tokens, at)
    assert np.array_equal(np.concatenate(parts), tokens)
    keys = [(lv, int(t)) for lv, t in zip(np.repeat(np.arange(16), levels), tokens, strict=True)]
    assert [len(p) for p in parts] == [sum(sum(k >= e for e in at) == f for k in keys) for f in range(4)]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55), (7, 7), (None, 3)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 55: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    star = spark.range(1, 300).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert components(star).select("component").distinct().count() == 1
