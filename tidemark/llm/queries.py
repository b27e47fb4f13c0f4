"""The operators bound to the test tables: one query opN_<name> for each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.bpe import encode_documents

    return encode_documents(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), keep_ids=False)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.htmlextract import extract_text

    return extract_text(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good; keep: likelier than not of a grade of at least 1."""
    from pyspark.sql import functions as F

    from tidemark.llm.quality import score_quality

    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") > 0, 1).when(F.col("quality") > 0, 2)
    scored = score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), grade, 3)
    return scored.select("doc_id", "held_out", "expected_grade", "tail_probability", "keep")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import packed_documents

    return packed_documents(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidemark.llm.topk import top_k

    return top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.neardup import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.linededup import dedup_lines

    return dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substring import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine is a weighted one: a term's inverse document frequency is multiplied by its squared log odds among the
    labelled examples."""
    from tidemark.llm.toxicity import score_toxicity

    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard import near_copies

    return near_copies(_read(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.divergence import audit_sources

    return audit_sources(_read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.filteraudit import audit_filters

    return audit_filters(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lm import score_texts

    scored = score_texts(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_topk": op2_topk,
    "op3_near_vectors": op3_near_vectors,
    "op4_line_dedup": op4_line_dedup,
    "op5_html": op5_html,
    "op6_packing": op6_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_divergence": op11_divergence,
    "op12_filter_audit": op12_filter_audit,
    "op13_lm_scoring": op13_lm_scoring,
}

#: DuckDB SQL for the queries that it can express.
ORACLES: dict[str, str] = {
    "op2_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op3_near_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), r AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
        ), c AS (
            SELECT a, min(b) AS component_id FROM r GROUP BY a
        ), n AS (
            SELECT a, count(*) AS n_links FROM l GROUP BY a
        )
        SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
    """,
    "op4_line_dedup": """
        WITH l AS (
            SELECT doc_id, i, line, lower_ascii AS k
            FROM (
                SELECT doc_id, i, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
                FROM (
                    SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line
                    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
                )
            )
        ), f AS (
            SELECT k, max(doc_id) AS owner FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
        ), m AS (
            SELECT l.doc_id, l.i, l.line, f.owner IS NOT NULL AND f.owner <> l.doc_id AS dropped FROM l LEFT JOIN f ON l.k = f.k
        )
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op7_substring_dedup": """
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
        ), w AS (
            SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS word, words FROM d
        ), g AS (
            SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 12), ' ')) AS h FROM w WHERE i + 12 <= len(words)
        ), f AS (
            SELECT h, min(doc_id) AS first_doc FROM g GROUP BY h
        ), c AS (
            SELECT DISTINCT doc_id, p FROM (SELECT g.doc_id, unnest(range(g.i, g.i + 13)) AS p FROM g JOIN f ON g.h = f.h WHERE f.first_doc < g.doc_id)
        ), m AS (
            SELECT w.doc_id, w.i, w.word, c.p IS NOT NULL AS removed FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.i = c.p
        ), s AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT removed) AS kept FROM m GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(coalesce(s.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
        FROM d LEFT JOIN s ON d.doc_id = s.doc_id
    """,
    "op10_jaccard_join": """
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))]
                ELSE list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(list_slice(w, i, i + 4), ' '))) END) AS g FROM d
        ), n AS (
            SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s
        ), u AS (
            SELECT doc_id, unnest(g) AS h FROM s
        ), o AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u AS a JOIN u AS b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), l AS (
            SELECT a, b FROM o JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
        ), e AS (
            SELECT a, b FROM l UNION ALL SELECT b, a FROM l
        ), r AS (
            SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
        )
        SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
    """,
    "op11_divergence": """
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        ), w AS (
            SELECT r, lang, source, unnest(regexp_extract_all(text, '[a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM d
        ), k AS (
            SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30
        ), v AS (
            SELECT lang, 5 * count(*) AS v FROM k GROUP BY lang
        ), c AS (
            SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term
        ), g AS (
            SELECT d.lang, d.source, coalesce(any_value(s.n), 0) AS n FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) AS s USING (lang, source) GROUP BY d.lang, d.source
        ), p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (g.n + v.v) AS p
            FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), q AS (
            SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(p.n) + 5)) // (any_value(t.n) + any_value(v.v)) AS q
            FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS n FROM g GROUP BY lang) AS t USING (lang) GROUP BY lang, term
        ), a AS (
            SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
            FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source
            LEFT JOIN (
                SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
            ) AS s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
            UNION ALL
            SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q.q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM a
        )
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
    """,
    "op12_filter_audit": """
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), l AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
        ), f AS (
            SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
                + (CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t) THEN 4 ELSE 0 END)
                + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
            FROM d LEFT JOIN l ON d.doc_id = l.doc_id
        ), c AS (
            SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask
        ), x AS (
            SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(f, bit)
        ), o AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM x AS a, x AS b, x AS c, x AS d, x AS e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
        ), s AS (
            SELECT filter_order, i AS step, bits[i] AS bit, CAST(coalesce(list_sum(list_slice(bits, 1, i - 1)), 0) AS INTEGER) AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS i FROM o)
        ), m AS (
            SELECT part, filter_order, step, bit,
                sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
                sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM c CROSS JOIN s GROUP BY part, filter_order, step, bit
        )
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
            CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM m
    """,
}
