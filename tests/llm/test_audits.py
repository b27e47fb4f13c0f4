"""Source divergence, filter interaction and lattice scoring against plain versions."""

import collections
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import divergence, lm
from tidemark.llm.divergence import audit_sources, share
from tidemark.llm.filteraudit import audit_filters, interactions
from tidemark.llm.lattice import Lattice, Pieces, pieces, pieces_of
from tidemark.llm.queries import ORACLES, QUERIES, vocabulary

LOWER = {c: c + 32 for c in range(65, 91)}
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, item int, term string, part string, score string"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash."""
    r = random.Random(5)
    words = ["the", "Über", "naïve", "x|y", "a#b", "ROOM", "日本", "e=mc2", "don't", "", "\x0b", " z"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randint(0, 300)), r.choice(["en", "de", None, ""]), r.choice(["a", "b", "c", None, ""]), 1, "t", "p", "s") for i in range(60)]
    rows += [(100 + i, rows[i % 7][1], "en", "copies", None, None, None, None) for i in range(20)]
    rows += [(200, None, None, None, None, None, None, None), (201, "", "en", "a", 1, "", "", ""), (200, None, None, None, None, None, None, None), (3, rows[3][1], "en", "a", 1, "", "", "")]
    rows += [(None, rows[4][1], "en", "a", 1, "", "", ""), (None, rows[4][1], "en", "lone", 1, "", "", ""), (300, "word " * 30_000, "en", "long", 1, "", "", ""), (301, "q" * 50_000, "xx", "only", 1, "", "", "")]
    return spark.createDataFrame(rows, DOCS)


def plain_divergence(rows, least, top):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    counts, frequency = collections.Counter(), collections.Counter()
    groups = set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = term.findall((text or "").translate(LOWER))
        frequency.update((lang, t) for t in set(found))
        counts.update((lang, source, t) for t in found)
    out = set()
    for lang in {a for a, _ in groups}:
        kept = sorted(t for (a, t), n in frequency.items() if a == lang and n >= least)
        own = sorted(s for a, s in groups if a == lang)
        total = {s: sum(counts[lang, s, t] for t in kept) for s in own}
        p = {(s, t): 1 + 10**9 * (counts[lang, s, t] + 5) // (total[s] + 5 * len(kept)) for s in own for t in kept}
        q = {t: 1 + 10**9 * (sum(counts[lang, s, t] for s in own) + 5) // (sum(total.values()) + 5 * len(kept)) for t in kept}
        for s in own:
            pairs = [(-sum(abs(p[s, t] - p[o, t]) for t in kept), o.encode(), o) for o in own if o != s]
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)}
            terms = [(q[t] - p[s, t], t.encode(), t) for t in kept if counts[lang, s, t] and p[s, t] > q[t]]
            out |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:top], 1)}
    return out


@pytest.mark.parametrize("sizes", [{}, {"range_terms": 2, "block_sources": 2}])
def test_divergence_of_odd_documents(spark, sizes):
    docs = odd(spark)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    for least, top in ((2, 3), (1, 50)):
        found = [tuple(r) for r in audit_sources(docs, least_docs=least, top=top, **sizes).collect()]
        assert len(found) == len(set(found))
        assert set(found) == plain_divergence(rows, least, top)
    nothing = audit_sources(docs, least_docs=10**6, **sizes).collect()
    assert nothing and all(r.part == "pair" and r.value == 0 for r in nothing)
    assert audit_sources(docs.where("false")).count() == 0


def test_divergence_slices_and_merges(monkeypatch):
    """A task's rows add up to the same, whether texts are cut into many slices or not."""
    texts = [" ".join(random.Random(i).choices("abcdefgh", k=50)) + " Ünï" for i in range(30)]
    table = pa.table({"lang": ["x", "y", "x"] * 10, "text": texts, "source": ["s"] * 15 + ["t"] * 15})

    def summed(size):
        total = collections.Counter()
        for b in divergence.count_terms(table.to_batches(size)):
            for r in b.to_pylist():
                total[r["lang"], r["term"], r["source"], "d"] += r["documents"]
                total[r["lang"], r["term"], r["source"], "o"] += r["occurrences"]
        return total

    want = summed(30)
    assert want["x", "Ünï", "s", "d"] == 10 and sum(n for k, n in want.items() if k[3] == "o") == 51 * 30
    monkeypatch.setattr(divergence, "SLICE_BYTES", 200)
    monkeypatch.setattr(divergence, "MERGE_ROWS", 20)
    assert summed(7) == want


def test_divergence_runs_over_batches():
    """In-task scans give the same rows however their input is cut."""
    rows = sorted((lang, t, s, 1, n) for lang in "ab" for n, t in enumerate("uvwxyz", 1) for s in "pqr" if (n + ord(s)) % 4)
    table = pa.table(list(map(list, zip(*rows, strict=True))), ["lang", "term", "source", "documents", "occurrences"])
    whole = None
    for size in (1, 2, 5, 100):
        out = [tuple(r.values()) for b in divergence.kept_runs(table.to_batches(size), 3) for r in b.to_pylist()]
        whole = whole or out
        assert out == whole
    assert {(a, t) for a, t, *_ in whole} == {(a, t) for a, t, *_ in rows if sum(x[:2] == (a, t) for x in rows) >= 3}


def test_shares_are_exact():
    r = random.Random(1)
    for _ in range(2000):
        total = r.randint(6, 9 * 10 ** r.randint(1, 17))
        count = r.randint(0, total - 5)
        assert share(np.int64(count), np.int64(total)) == 1 + 10**9 * (count + 5) // total


def plain_audit(rows, labels):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    out, cells = {}, collections.Counter()
    for doc_id, text, source in rows:
        text = text or ""
        words = WORDS.findall(text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and first[text] < doc_id,
        }
        cells[source or "", frozenset(f for f in fails if fails[f]), any(a == doc_id and q == 1 for a, q, _ in labels), any(a == doc_id and t == 1 for a, _, t in labels)] += 1
    parts = {p for p, *_ in cells}
    for part in parts:
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                row = collections.Counter()
                for (p, fails, good, toxic), n in cells.items():
                    if p != part:
                        continue
                    before = fails & set(order[: step - 1])
                    row["kept"] += n * (not before and f not in fails)
                    row["unique"] += n * (fails == {f})
                    if f in fails:
                        row["redundant" if before else "removed"] += n
                        row["good"] += n * (good and not before)
                        row["toxic"] += n * (toxic and not before)
                shapley[f] += row["removed"]
                out[part, "".join(order), step] = [row[k] for k in ("kept", "removed", "redundant", "unique", "good", "toxic")]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_filter_audit_of_odd_documents(spark):
    docs = odd(spark).withColumnRenamed("score", "mask")
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 2)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (200, 1, 1), (9999, 1, 1)]
    found = audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], [x for x in labels if x[0] is not None])
    assert len(found) == len(want)
    assert {tuple(r)[:3]: list(tuple(r)[3:]) for r in found} == want
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(docs.where("false"), empty).count() == 0
    assert audit_filters(docs, empty).agg({"good_lost": "max"}).first()[0] == 0


def test_interactions_of_other_chains(spark):
    cells = spark.createDataFrame([("p", 0, 5, 0, 0), ("p", 3, 2, 1, 0), ("p", 2, 4, 0, 4)], "part string, mask int, documents long, good long, toxic long")
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in interactions(cells, "XY").collect()}
    assert rows == {("XY", 1): (9, 2, 0, 0, 2), ("XY", 2): (5, 4, 2, 4, 10), ("YX", 1): (5, 6, 0, 4, 10), ("YX", 2): (5, 0, 2, 0, 2)}
    with pytest.raises(ValueError):
        interactions(cells, "XX")


def laid(words):
    data = np.frombuffer(b"".join(words), np.uint8)
    return data, np.r_[0, np.cumsum([len(w) for w in words])]


def segmentations(word, known):
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        if word[:n] in known:
            for rest in segmentations(word[n:], known):
                yield (word[:n], *rest)


def test_lattices_sum_over_all_segmentations():
    known = [b"a", b"b", b" ", b"ab", b"ba", b" a", b"aba", b" abab", b"bb"]
    found, scores = Pieces(known), np.log(np.linspace(0.02, 0.2, len(known)))
    r = random.Random(2)
    words = [b" " + bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(40)]
    counts = np.arange(1, len(words) + 1)
    total, uses = [], np.zeros(len(known))
    for word, n in zip(words, counts, strict=True):
        ways = list(segmentations(word, set(known)))
        weights = [math.prod(math.exp(scores[known.index(p)]) for p in way) for way in ways]
        total.append(math.log(sum(weights)))
        for way, weight in zip(ways, weights, strict=True):
            for p in way:
                uses[known.index(p)] += n * weight / sum(weights)
    for few in (0, 10**9):  # whole steps at once, and arc by arc
        lattice = Lattice.of(found, *laid(words))
        with pytest.MonkeyPatch.context() as m:
            m.setattr("tidemark.llm.lattice.FEW", few)
            assert np.allclose(lattice.totals(lattice.forward(scores)), total)
            assert np.allclose(lattice.expected(scores, counts, len(known)), uses)


def test_a_long_word_stays_finite():
    found = pieces(vocabulary(VOCABULARY))
    lattice = Lattice.of(found, *laid([b" " + b"ab\xff" * 30_000, b" the"]))
    total = lattice.totals(lattice.forward(lm.first_scores(found.count)[:-1]))
    assert np.isfinite(total).all() and total[0] < -50_000


def plain_scores(rows, known, rounds):
    """Unigram scores by expectation maximisation word by word, then both scores of every document."""
    tokens = [[w.encode() for w in WORDS.findall((t or "").translate(LOWER))] for _, t in rows]
    train = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    counts = collections.Counter(w for own, learned in zip(tokens, train, strict=True) if learned for w in own)
    ends, found = sum(train), Pieces(known)
    scores = lm.first_scores(len(known))
    for _ in range(rounds if ends else 0):
        total = np.zeros(len(known) + 1)
        for w, n in counts.items():
            total[:-1] += Lattice.of(found, *laid([b" " + w])).expected(scores[:-1], np.array([n]), len(known))
        total[-1] = ends
        scores = np.log((total + lm.SMOOTHING) / (total.sum() + lm.SMOOTHING * len(total)))
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for own in tokens:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own) + math.log10((ends + 1) / (n + v + 1))
        worth = scores[-1] + sum(float((x := Lattice.of(found, *laid([b" " + w]))).totals(x.forward(scores[:-1]))[0]) for w in own)
        out.append((len(own) + 1, sum(w in counts for w in own) + (ends > 0), n, base, worth / math.log(10)))
    return [not x for x in train], out


def test_lm_scores_of_odd_documents(spark, tmp_path):
    path = vocabulary(VOCABULARY)
    known = pieces_of(path)
    docs = odd(spark).where("doc_id is null or doc_id not in (300, 301)")
    docs = docs.unionByName(spark.createDataFrame([(400, "q" * 3000 + " the " * 50, "en", "a", 1, "", "", "")], DOCS))
    found = lm.score_texts(docs, path, rounds=2).orderBy("doc_id", "source").collect()
    assert list(found[0].asDict()) == [c for c in docs.columns if c != "score"] + ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = [(r.doc_id, r.text) for r in found]
    held, want = plain_scores(rows, known, 2)
    assert [r.held_out for r in found] == held
    for r, w in zip(found, want, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert math.isclose(r.base_score, w[3], rel_tol=1e-9)
        assert math.isclose(r.score, w[4], rel_tol=1e-4, abs_tol=1e-6)
    assert lm.score_texts(docs.where("false"), path).count() == 0
    unlearned = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert all(r.base_score == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in lm.score_texts(unlearned, path).collect())


def test_lm_scores_are_the_same_in_every_run_and_learn(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    path = vocabulary(VOCABULARY)
    run = lambda rounds, parts: {r.doc_id: (r.n_tokens, r.base_score, r.score, r.held_out) for r in lm.score_texts(docs.repartition(parts), path, rounds=rounds).collect()}
    one = run(4, 2)
    assert run(4, 3) == one
    per_token = lambda rows: sum(r[2] for r in rows.values() if r[3]) / sum(r[0] for r in rows.values() if r[3])
    assert per_token(one) > per_token(run(1, 2)) + 0.1


def test_base_scores_against_sql(spark, data):
    found = {r.doc_id: r for r in QUERIES["op13_lm_scoring"](spark, data).collect()}
    con = duckdb.connect()
    rows = con.execute(f"""
        WITH d AS (
            SELECT doc_id, list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), '') AS w
            FROM '{data}/documents.parquet'
        ) SELECT doc_id, w FROM d
    """).fetchall()
    train = collections.Counter(t for i, w in rows if zlib.crc32(str(i).encode()) % 7 != 2 for t in w)
    n, v = sum(train.values()), len(train)
    assert len(found) == len(rows)
    for i, w in rows:
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(t in train for t in w), n)
        assert math.isclose(r.base_score, sum(math.log10((train[t] + 1) / (n + v + 1)) for t in w), rel_tol=1e-9)


@pytest.mark.parametrize("name", ["op11_divergence", "op12_filter_audit"])
def test_audits_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    df = QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want
