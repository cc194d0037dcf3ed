"""The registered queries of this subpackage and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweave.llm import (
    decontaminate, divergence, langid, license, mtree, negatives, packing, pagetext, quality, simhash, tokencount, toxicity, urlfilter,
)
from storyweave.llm.batches import bucket, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_WHOLE = "list_transform(embedding, lambda x: floor(1024 * x::DOUBLE))"


@query("op1_exact_topk", f"""
    WITH v AS (
        SELECT vec_id, {_WHOLE} AS w FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
        FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license.digest(license.scan(docs, license.fit(docs)))


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.components(table(spark, sf_dir, "documents")))


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, table(spark, sf_dir, "labels"), *quality.site())


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op7_benchmark_decontamination", f"""
    WITH d AS (SELECT doc_id, {_WORDS.format('coalesce(text, chr(32))')} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS.format('coalesce(text, chr(32))')} AS w FROM benchmark),
    item_windows AS (
        SELECT DISTINCT item_id, size, array_to_string(w[pos + 1 : pos + size], ' ') AS k FROM (
            SELECT item_id, w, least(len(w), 10) AS size, unnest(range(len(w) - least(len(w), 10) + 1)) AS pos
            FROM b WHERE len(w) > 0)),
    doc_windows AS (
        SELECT doc_id, size, pos, array_to_string(w[pos + 1 : pos + size], ' ') AS k FROM (
            SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS pos
            FROM d, (SELECT DISTINCT size FROM item_windows) s WHERE len(w) >= size)),
    found AS (SELECT x.doc_id, x.size, x.pos, i.item_id FROM doc_windows x JOIN item_windows i ON i.k = x.k AND i.size = x.size),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM found) GROUP BY doc_id),
    items AS (
        SELECT doc_id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS h
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
           coalesce(items.h, sha256('')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"))


@query("op9_url_filter")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, urlfilter.fit(pages))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


_WHOLE_256 = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE))"


@query("op11_hard_negatives", f"""
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE_256} AS w FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.w, c.w) AS BIGINT) AS score
        FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
    p AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    r AS (
        SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
         AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, negatives.rotated())


_TERMS = rf"regexp_extract_all({_FOLDED.format('text')}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
_SHARE = "1 + CAST((1000000000::HUGEINT * ({} + 1)) // ({} + v) AS BIGINT)"


@query("op12_source_divergence", f"""
    WITH d AS (
        SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    t AS (SELECT k, lang, source, unnest({_TERMS}) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
    c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept ON kept.lang = t.lang AND kept.term = t.term GROUP BY ALL),
    v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
    g AS (
        SELECT d.lang, d.source, coalesce(any_value(v.v), 0) AS v, coalesce(any_value(v.total), 0) AS lang_total, coalesce(any_value(s.n), 0) AS total
        FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN v ON v.lang = d.lang
        LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s ON s.lang = d.lang AND s.source = d.source GROUP BY d.lang, d.source),
    p AS (
        SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, {_SHARE.format('coalesce(c.n, 0)', 'g.total')} AS p,
               {_SHARE.format('kept.n', 'g.lang_total')} AS q
        FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
    pairs AS (
        SELECT a.lang, a.source, b.source AS item, CAST(coalesce(any_value(x.value), 0) AS BIGINT) AS value
        FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
        LEFT JOIN (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL) x
          ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        GROUP BY a.lang, a.source, b.source),
    every AS (
        SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
        SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
    ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_html_extraction")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(table(spark, sf_dir, "pages"))
