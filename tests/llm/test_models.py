"""Vectors, pages and classifiers: brute force, labelled pages, held-out accuracy."""

import time
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import neardup, quality, toxicity
from tidemark.llm.htmlextract import blocks, extract_text, main_text, training_pages, trained
from tidemark.llm.neardup import near_vectors
from tidemark.llm.quality import score_quality
from tidemark.llm.text import text_column
from tidemark.llm.toxicity import SAMPLE, Calibration, Index, score_toxicity, text_terms, train
from tidemark.llm.topk import top_k

LETTERS = str.maketrans("0123456789", "ghijklmnop")
LARGER = "/root/testdata/sf0.1"
ODD = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, float("nan")], 1), (5, [1.0, None], 1), (6, [1.0, 2.0], None), (7, [1.0, 2.0], 1), (7, [1.0, 2.0], 1), (8, [2.0, 4.0, 0.0], 1), (None, [1.0, 2.0], 1)]


@pytest.fixture(scope="module")
def vectors(spark, data):
    return spark.read.parquet(f"{data}/embeddings.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "vec_id long, embedding array<double>, label int")


def test_top_k(spark, vectors):
    pdf = vectors.toPandas()
    x, ids = np.floor(256 * np.stack(pdf.embedding).astype(float)).astype(int), pdf.vec_id.to_numpy()
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(vectors, F.col("vec_id") % 50 == 0).collect()}
    want = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        best = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        want |= {(ids[i], n + 1): (ids[j], s[j]) for n, j in enumerate(best)}
    assert found == want


def test_top_k_of_odd_vectors(spark, odd):
    found = top_k(odd, F.col("vec_id") == 7).collect()
    # both rows of vec_id 7 ask, and each is the other's candidate
    assert sorted((r["rank"], r.vec_id, r.score) for r in found) == sorted(2 * [(1, 8, 655360), (2, 6, 327680), (3, 7, 327680), (4, 2, 0), (5, 3, 0)])
    other = spark.createDataFrame([(1, [1.0], "x"), (1, [3.0], "y"), (2, [2.0], None)], "vec_id long, embedding array<double>, score string")
    assert sorted((r["rank"], r.vec_id, r.score) for r in top_k(other, F.col("vec_id") == 1, scale=1.0).collect()) == [(1, 1, 3), (1, 2, 6), (2, 1, 3), (2, 2, 2)]
    assert top_k(odd.where("false"), F.lit(True)).count() == 0
    huge = spark.createDataFrame([(1, [1e300]), (2, [2e300]), (3, [-1e300])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in top_k(huge, F.col("vec_id") == 1).orderBy("rank").collect()] == [(2, 2**63 - 1), (3, -(2**63))]


def plain_links(pdf):
    x = np.stack(pdf.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = (x @ x.T >= 0.98) & (pdf.label.to_numpy()[:, None] == pdf.label.to_numpy())
    np.fill_diagonal(s, False)
    root = pdf.vec_id.to_numpy().copy()
    while True:
        new = np.minimum(root, np.where(s, root[None, :], 2**60).min(axis=1))
        if (new == root).all():
            return {i: (n, c) for i, n, c in zip(pdf.vec_id, s.sum(axis=1), root, strict=True)}
        root = new


@pytest.mark.parametrize("block", [2048, 37])
def test_near_vectors(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = np.random.default_rng(0)
    base = np.array(vectors.orderBy("vec_id").first().embedding)
    more = [(1000 + i, [float(z) for z in (base if i < 40 else base + r.normal(0, 0.012, len(base))).astype("f4")], 1) for i in range(160)]
    df = vectors.unionByName(spark.createDataFrame(more, vectors.schema))
    found = {x.vec_id: (x.n_links, x.component_id) for x in near_vectors(df).collect()}
    assert found == plain_links(df.toPandas())  # no link is missed: recall 1


def test_near_vectors_of_odd_vectors(odd):
    found = sorted(map(tuple, near_vectors(odd).collect()), key=str)
    assert found == sorted([(i, 0, i, True) for i in range(1, 7)] + [(7, 2, 7, True)] * 2 + [(8, 2, 7, False), (None, 0, None, True)], key=str)
    assert near_vectors(odd.where("false")).count() == 0 and near_vectors(odd.where("vec_id < 5")).count() == 4


def test_near_vectors_of_one_vec_id(spark):
    """Rows of one vec_id with different vectors have their own links and components."""
    rows = [(7, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (8, [1.0, 0.01], 1), (9, [0.01, 1.0], 1), (10, [0.0, 2.0], 1), (3, [0.0, 3.0], 2), (7, [1.0, 0.0], 2), (3, [1.0, 0.0], 2)]
    found = sorted(map(tuple, near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    assert found == sorted([(7, 1, 7, True), (7, 2, 7, True), (8, 1, 7, False), (9, 2, 7, False), (10, 2, 7, False), (3, 0, 3, True), (3, 1, 3, True), (7, 1, 3, False)])


@pytest.fixture(scope="module")
def model():
    return trained()


def test_labelled_pages(model):
    right = n = 0
    for page in training_pages(80, seed=77):
        found = blocks(page)
        right += sum(b.label == keep for b, keep in zip(found, model.decode(found), strict=True))
        n += len(found)
    assert right / n > 0.98


def test_pages(spark, data, model):
    page = '<body><nav><a href="x">Home</a></nav><article><h1>A &amp; B</h1><p>It is  1 < 2\n here.<p>"Yes" <b>it</b> is.</article><div class="comments"><p>I do not agree at all.</p></div><footer>&copy; x</footer>'
    assert main_text(page, model) == 'A & B\nIt is 1 < 2 here.\n"Yes" it is.'
    assert main_text("", model) == "" and main_text("<script>var a = '<p>x</p>'</script>", model) == ""
    odd = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, page, "t"), (3, page, "t"), (4, "<" * 3000 + "<div " * 3000, "t")], "page_id long, html string, text string")
    assert [(r.page_id, r.n_chars == len(r.text)) for r in extract_text(odd, model).orderBy("page_id").collect()] == [(1, True), (2, True), (3, True), (3, True), (4, True)]
    pages = spark.read.parquet(f"{data}/pages.parquet")
    out = extract_text(pages, model).toPandas()
    assert (out.n_chars > 0).mean() > 0.95 and not out.text.str.contains("©|<p>|&amp;").any()
    assert extract_text(pages.where("false"), model).count() == 0


@pytest.mark.parametrize("names", ["has-sidebar", "sidebar-right", "comments-open", "header-fixed", "with-ads", "newsletter-popup-enabled", "single has-sidebar sidebar-right no-banner"])
def test_pages_whose_outer_elements_name_other_parts(model, names):
    text = ["The first words of the day came from the town.", "They say that it is well, and so it is.", "It ends here, as it must."]
    inner = "".join(f"<p>{t}</p>" for t in text)
    menu, end = "<nav><a href=x>Home</a></nav>", "<footer>&copy; x</footer>"
    for page in (
        f'<body class="{names}"><article>{inner}</article>{end}',
        f'<body class="{names}">{menu}<article>{inner}</article>',
        f'<body><div class="{names}"><main>{inner}</main></div></body>',
        f'<body><div class="{names}">{menu}<div class="entry-content">{inner}</div></div>{end}',
        f'<body class="{names}"><div class="{names} entry-content">{inner}</div>{end}',
        f'<body class="{names}">{menu}<div class="entry-content">{inner}</div>',
    ):
        assert main_text(page, model) == "\n".join(text), page
    comments = f'<body class="{names}"><article><h1>One new day</h1><p>{text[0]}</p></article><section class="comments"><ol>{"<li>" + text[1] + "</li>" + "<li>" + text[2] + "</li>"}</ol></section>'
    assert main_text(comments, model) == "One new day\n" + text[0]


def test_a_last_paragraph_that_is_a_link(model):
    assert main_text("<body><article><p>It is well, they say.</p><p><a>See the full list of towns</a></p></article><footer>&copy; x.</footer>", model).endswith("\nSee the full list of towns")


@pytest.mark.parametrize("page", ["<div>" * 8000 + "</b>" * 8000, "<span>" * 8000 + "</i>" * 8000, "<a b" * 20000, "<b>" + "<div>" * 8000 + "</b>" * 8000, "<x-y>" * 8000 + "a</div>" * 8000, "<span>" * 8000 + "a</div>" * 8000, "</script" * 20000])
def test_long_malformed_pages_take_linear_time(page):
    def took(times):
        began = time.process_time()
        blocks(page * times)
        return time.process_time() - began

    took(1)
    assert took(8) < 40 * took(1) + 0.5


def test_pages_without_end_of_head_and_with_formulas(model):
    article = "<article><h1>A new day</h1><p>It is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here, they say.</p></article>"
    want = "A new day\nIt is x=2 here, they say."
    for start in ("<html><head><title>t</title></head><body>", "<html><head><title>t</title><body>", "<head><meta charset=utf-8><style>p{}</style>\n", "<head><title>t</title> Words"):
        found = blocks(start + article)
        assert "\n".join(b.text for b in found).endswith(want), start
    assert main_text("<html><head><title>t</title><body>" + article, model) == want


def test_pages_keep_what_an_article_holds(model):
    page = "<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><article><h1>A new day has come</h1><p>They say <math><mi>x</mi></math> is one of <svg><text>two</text></svg> numbers.</p><noscript><p>The full story is told here, they say.</p></noscript><p>It ends well.</p></article><div class=comments><article><p>I do not agree at all.</p></article></div></body></html>"
    assert main_text(page, model) == "A new day has come\nThey say x is one of two numbers.\nThe full story is told here, they say.\nIt ends well."


def test_pages_are_the_blocks_of_their_articles(spark, model):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        own = [b.text for b in blocks(r.html or "") if b.features & {"tag=article", "tag=main"}]
        assert main_text(r.html or "", model) == "\n".join(own)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = scored.predicted == 1
    assert hit[scored.toxic == 1].mean() > 0.93 and hit[scored.toxic == 0].mean() < 0.015
    assert all(len(e) for e, t in zip(scored.evidence, scored.text, strict=True) if (t or "").strip())


def test_toxicity_learns_from_all_of_its_sample(spark):
    # 2,000 toxic texts: more than the sample of 1,000 held
    words = lambda i, n: " ".join(f"{hashlib.md5(f'{i} {j}'.encode()).hexdigest()}".translate(LETTERS) for j in range(n))
    rows = [(i, f"{words(i, 6)} {'foulword' if i % 2 else 'kind'}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = train(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    foul = next(terms for _, _, _, terms in text_terms(text_column(pa.array(["foulword"]))))
    assert SAMPLE == {1: 2000, 0: 6000} and quality.SAMPLE == 3000 and np.isin(foul, model.vocabulary.value.terms).all() and 1000 < model.index.value.label.sum() <= 2000


def test_nearest_examples_are_those_of_a_full_scan(monkeypatch):
    r = np.random.default_rng(4)
    n, terms, queries = 700, 400, 150
    monkeypatch.setattr(toxicity, "BLOCK", 32)
    example, place = np.nonzero(r.random((n, terms)) < np.linspace(0.3, 0.002, terms))
    value = r.random(len(place)).astype(np.float32) ** 4
    index = Index(example, place.astype(np.int32), value, r.integers(0, 2, n), 0.5, terms)
    assert 0 < len(index.weights) < terms
    whole, asked = np.zeros((n, terms)), np.zeros((queries, terms))
    whole[example, place] = value
    of, own = np.nonzero(r.random((queries, terms)) < r.choice([0.004, 0.2], (queries, 1)))
    weight = (r.random(len(own)) ** 3).astype(np.float32)
    asked[of, own] = weight
    for without in (None, np.arange(queries)):
        scores = asked @ whole.T
        if without is not None:
            scores[np.arange(queries), without] = 0
        for s, (ids, near) in zip(scores, index.nearest(of, own.astype(np.int32), weight, queries, without), strict=True):
            want = [j for j in np.lexsort((np.arange(n), -np.round(s, 9))) if round(s[j], 9) > 0][:15]
            assert ids.tolist() == want and np.allclose(near, s[want])


def test_calibration_is_isotonic_regression():
    r = np.random.default_rng(3)
    raw, weight = r.integers(0, 30, 200) / 30, r.random(200) + 0.1
    label = (r.random(200) < raw).astype(int)
    found = Calibration.fit(raw, label, weight, 0.2, 0.1)
    values = np.unique(raw)
    y = np.array([weight[(raw == v) & (label > 0)].sum() / weight[raw == v].sum() for v in values])
    w = np.array([weight[raw == v].sum() for v in values])
    # least squares by the max-min formula
    mean = lambda a, b: (y[a:b] * w[a:b]).sum() / w[a:b].sum()
    plain = np.array([max(min(mean(a, b) for b in range(i + 1, len(y) + 1)) for a in range(i + 1)) for i in range(len(y))])
    pool = [w[np.isclose(plain, p)].sum() for p in plain]
    assert np.allclose([found.score(v) for v in values], [(p * t + 0.2) / (t + 1) for p, t in zip(plain, pool, strict=True)], atol=0.02)


def test_short_texts_of_few_words_are_told_apart(spark):
    r = np.random.default_rng(1)
    rows = [(i, " ".join([*r.choice([f"w{chr(97 + j)}x" for j in range(20)], 9), "bad" if i % 10 == 0 else "fine"])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = score_toxicity(docs, docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))).select("doc_id", "predicted").collect()
    assert sum(x.predicted == (x.doc_id % 10 == 0) for x in found) > 1480


def test_toxicity_does_not_depend_on_the_order_of_rows(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    first = docs.where("text <> ''").orderBy("doc_id").limit(1).crossJoin(spark.range(900000, 900004).withColumnRenamed("id", "copy"))
    docs = docs.unionByName(first.select(F.col("copy").alias("doc_id"), "text", "lang", "source", "n_chars"))
    labels = labels.select("doc_id", "toxic").unionByName(spark.range(900000, 900004).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic")))
    scores = [sorted((r.doc_id, r.score) for r in score_toxicity(d, x).collect()) for d, x in ((docs, labels), (docs.orderBy(F.desc("doc_id")), labels.orderBy(F.desc("doc_id"))))]
    assert scores[0] == scores[1]


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") > 0, 1).otherwise(2)
    scored = score_quality(docs, labels, grade, 3).join(labels, "doc_id").where("held_out").toPandas()
    assert scored.keep[scored.quality == 1].mean() > 0.98 and scored.keep[scored.quality == 0].mean() < 0.1
    means = scored.groupby("quality").expected_grade.mean()
    assert means[1] > means[0] + 1


def test_ordinal_regression_is_at_the_least_of_its_objective():
    r = np.random.default_rng(6)
    n, k, grades = 200, 5, 3
    x = r.normal(size=(n, k)) * (r.random((n, k)) < 0.7)
    grade = np.digitize(x @ np.array([1.5, -1, 0.5, 0, 2]) + r.logistic(size=n), [-0.5, 1.0])
    weight = r.random(n) + 0.5
    doc, place = np.nonzero(x)
    model = quality.Model.fit(doc, place, x[doc, place], grade, weight, grades, rounds=3000, penalty=1e-2, rate=0.02)

    def objective(w, t):
        up = 1 / (1 + np.exp(-((x @ w)[:, None] - t)))
        p = np.c_[np.ones(n), up][np.arange(n), grade] - np.c_[up, np.zeros(n)][np.arange(n), grade]
        return -(weight / weight.sum() * np.log(p)).sum() + 0.5e-2 * (w @ w)

    w, t = model.weights[:k], model.thresholds
    assert (np.diff(t) > 0).all() and not model.weights[k:].any()
    at, h = np.r_[w, t], 1e-4
    slope = [(objective(*np.split(at + h * e, [k])) - objective(*np.split(at - h * e, [k]))) / (2 * h) for e in np.eye(k + len(t))]
    assert np.abs(slope).max() < 2e-3
    assert np.allclose(model.above(x @ w), 1 / (1 + np.exp(-((x @ w)[:, None] - t))))


def test_classifiers_of_odd_rows(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5), (None, "a b", 5)], "doc_id long, text string, score int")
    for df in (score_toxicity(docs, labels), score_toxicity(docs, labels.where("false"))):
        found = df.collect()
        assert len(found) == 4 and all(0 <= r.score <= 1 for r in found) and len({r.score for r in found if not r.text}) == 1
    assert score_quality(docs, labels, F.col("quality"), 2).where("tail_probability between 0 and 1").count() == 4
    assert score_quality(docs, labels.where("false"), F.col("quality"), 2).where("keep").count() == 4
    assert score_toxicity(docs.where("false"), labels).count() == 0 and score_quality(docs.where("false"), labels, F.col("quality"), 2).count() == 0
