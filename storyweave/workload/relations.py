"""Dedup, gate, grouping, scoring, health and catalogue jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweave import fixtures as fx
from storyweave.functions import text, urls, vectors
from storyweave.operators import calibrate, catalogue, gate, health, pairs, rank, scoring, stories as story_ops
from storyweave.operators.dedup import first_by_content, first_by_url, new_items
from storyweave.plans import jobs
from storyweave.session import cut_lineage
from storyweave.workload.registry import (
    AS_OF, query, sql_canonical_url, sql_cos, sql_entities, sql_jaccard, sql_keyword_hits, with_tables,
)

_HASH = "sha256(lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))))"


_SHARED = "'https://news' || ((doc_id - doc_id % 3) % 7) || '.example.com/a/' || (doc_id - doc_id % 3) || '?a=1&b=2'"


@query("first_by_url", f"""
    SELECT min(doc_id) AS item_id, sha256(u) AS url_hash, count(*) - 1 AS duplicates FROM (SELECT doc_id, {_SHARED} AS u FROM documents) GROUP BY u""")
def _first_by_url(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), fx.shared_link(F.col("doc_id")).alias("url"))
    return first_by_url(rows, "item_id").select("item_id", "url_hash", "duplicates")


@query("new_items", with_tables("items", body=f"""
    SELECT min(item_id) AS item_id FROM (SELECT item_id, pub, {sql_canonical_url('url')} AS u FROM items) i
    WHERE u NOT IN (SELECT {sql_canonical_url('url')} FROM items WHERE pub < 1704672000) AND (pub IS NULL OR pub >= 1704672000)
    GROUP BY u"""))
def _new_items(spark, sf):
    items = fx.items(spark, sf)
    old = items.where(F.col("published_at") < F.timestamp_seconds(F.lit(1704672000))).select(urls.url_hash(F.col("url")).alias("url_hash"))
    fresh = items.where(F.col("published_at").isNull() | (F.col("published_at") >= F.timestamp_seconds(F.lit(1704672000))))
    return new_items(first_by_url(fresh.select("item_id", "url"), "item_id"), old).select("item_id")


@query("first_by_content", f"""
    SELECT doc_id AS item_id, CASE WHEN doc_id = f THEN 'kept' ELSE 'duplicate content of item ' || f END AS outcome
    FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_HASH}) AS f FROM documents)""")
def _first_by_content(spark, sf):
    kept, failed = first_by_content(fx.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text"))
    return kept.select("item_id", F.lit("kept").alias("outcome")).unionByName(failed.select("item_id", F.col("error").alias("outcome")))


_JUDGED = {"judged": f"""
    SELECT i.*, {sql_cos('i.v', 't.topic')} AS cos, {sql_keyword_hits("title || chr(10) || chr(10) || text")} AS hits,
           CASE WHEN model_id = 'm2' THEN 0.05 ELSE 0.12 END AS threshold FROM items i, topic t"""}
_REASON = "printf('off-topic: cosine=%.3f (threshold %.3f), keyword_hits=%d', cos, threshold, hits)"
_GATE = {"cosine_threshold": 0.12, "cosine_thresholds": {"m2": 0.05}}


@query("relevance_gate", with_tables("items", "topic", extra=_JUDGED, body=f"""
    SELECT item_id, CASE WHEN cos >= threshold OR hits >= 1 THEN NULL ELSE {_REASON} END AS reject_reason FROM judged"""))
def relevance_gate(spark, sf):
    return jobs.relevance_verdicts(fx.items(spark, sf), fx.table(spark, sf, "embeddings"), **_GATE).select("item_id", "reject_reason")


# -- matching and grouping ------------------------------------------------

def _sql_match(as_of: int | None, threshold: float = 0.50) -> dict[str, str]:
    cut = f"AND (b.pub IS NULL OR b.pub >= {as_of} - 172800)" if as_of is not None else ""
    return {
        "sig": f"""SELECT item_id, source_id, pub, v, model_id, {sql_entities("title || ' ' || text")} AS ents,
            list_transform(links, lambda u: regexp_extract(u, '^https://([^?]*)', 1)) AS keys FROM items""",
        "cand": f"""SELECT a.item_id, b.item_id AS other, a.ents AS ea, b.ents AS eb, a.keys AS ka, b.keys AS kb,
            CASE WHEN a.pub IS NULL OR b.pub IS NULL THEN 1.0 ELSE greatest(0.0, 1 - abs(a.pub - b.pub) / 3600.0 / 48.0) END AS near,
            {sql_cos('a.v', 'b.v')} AS cos
            FROM sig a JOIN sig b ON b.item_id < a.item_id AND b.model_id = a.model_id
            AND (a.pub IS NULL OR b.pub IS NULL OR abs(a.pub - b.pub) <= 172800) {cut}""",
        "pairs": f"""SELECT item_id, other, round(least(1.0, 0.6 * cos + 0.4 * {sql_jaccard('ea', 'eb')} + 0.1 * {sql_jaccard('ka', 'kb')}) * near, 9) AS score
            FROM cand WHERE (0.6 * cos + 0.4 * least(len(ea), len(eb)) / greatest(1, len(ea), len(eb)) + 0.1) * near > {threshold - 0.04}""",
        "best": f"""SELECT item_id, other AS match_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, other) AS rn
            FROM pairs) WHERE rn = 1 AND score > {threshold - 0.03:.2f}""",
        "parents": f"""SELECT i.item_id, coalesce(b.match_id, i.item_id) AS parent FROM items i
            LEFT JOIN (SELECT * FROM best WHERE score >= {threshold + 0.03:.2f}) b ON b.item_id = i.item_id""",
        "walk": """SELECT item_id, parent AS hop FROM parents
            UNION SELECT w.item_id, p.parent FROM walk w JOIN parents p ON p.item_id = w.hop""",
        "roots": "SELECT item_id, min(hop) AS story_id FROM walk GROUP BY item_id",
    }


_VERDICT = "CASE WHEN score >= 0.53 THEN 'same' WHEN score <= 0.47 THEN 'different' ELSE 'ambiguous' END"


def _signalled(spark, sf) -> DataFrame:
    return cut_lineage(fx.signalled_items(spark, sf).withColumn("is_new", F.lit(True)).drop("text"))


@query("best_match", with_tables("items", recursive=True, extra=_sql_match(AS_OF), body=f"""
    SELECT item_id, match_id, round(score, 6) AS score, {_VERDICT} AS verdict FROM best"""))
def best_match(spark, sf):
    return pairs.best_matches(_signalled(spark, sf), as_of=fx.AS_OF).select(
        "item_id", "match_id", F.round("score", 6).alias("score"), "verdict")


@query("best_match_replay", with_tables("items", recursive=True, extra=_sql_match(None), body=f"""
    SELECT item_id, match_id, round(score, 6) AS score, {_VERDICT} AS verdict FROM best"""))
def best_match_replay(spark, sf):
    return pairs.best_matches(_signalled(spark, sf), as_of=None).select(
        "item_id", "match_id", F.round("score", 6).alias("score"), "verdict")


def _clustered(spark, sf) -> jobs.Clustered:
    return jobs.cluster(fx.signalled_items(spark, sf), fx.AS_OF, replay=True)


@query("assign_stories", with_tables("items", recursive=True, extra=_sql_match(None), body="SELECT item_id, story_id FROM roots"))
def assign_stories(spark, sf):
    return _clustered(spark, sf).members.select("item_id", "story_id")


@query("cluster", with_tables("items", recursive=True, extra=_sql_match(AS_OF), body=f"""
    SELECT r.story_id, arg_min(i.title, i.item_id) AS title, arg_min(coalesce(i.pub, {AS_OF}), i.item_id)::BIGINT AS first_seen,
           max(coalesce(i.pub, {AS_OF}))::BIGINT AS updated_at, count(*) AS item_count, count(DISTINCT i.source_id) AS outlet_count
    FROM roots r JOIN items i ON i.item_id = r.item_id GROUP BY r.story_id"""))
def cluster(spark, sf):
    return jobs.cluster(fx.signalled_items(spark, sf), fx.AS_OF).stories.select(
        "story_id", "title", F.unix_seconds("first_seen").alias("first_seen"), F.unix_seconds("updated_at").alias("updated_at"),
        "item_count", "outlet_count")


@query("story_rollup", with_tables("story_facts", body="""
    SELECT story_id, title, first_seen::BIGINT AS first_seen, updated_at::BIGINT AS updated_at, item_count, outlet_count, has_dated_item FROM story_facts"""))
def story_rollup(spark, sf):
    return story_ops.story_rollup(fx.members(spark, sf), fx.AS_OF).select(
        "story_id", "title", F.unix_seconds("first_seen").alias("first_seen"), F.unix_seconds("updated_at").alias("updated_at"),
        "item_count", "outlet_count", "has_dated_item")


@query("distinct_affected", with_tables("members", body="SELECT DISTINCT story_id FROM members WHERE pub >= 1705276800"))
def distinct_affected(spark, sf):
    """Stories that gained an item since a point in time."""
    fresh = fx.members(spark, sf).where(F.col("published_at") >= F.timestamp_seconds(F.lit(1705276800)))
    return fresh.select("story_id").distinct()


@query("story_centroids", with_tables("centroids", body="""
    SELECT story_id, round(list_sum(centroid), 5) AS total, round(list_dot_product(centroid, centroid), 5) AS norm2 FROM centroids"""))
def story_centroids(spark, sf):
    c = vectors.mean_vectors(fx.members(spark, sf), "story_id", "embedding")
    total = F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return c.select("story_id", F.round(total, 5).alias("total"), F.round(vectors.dot(F.col("centroid"), F.col("centroid")), 5).alias("norm2"))


# -- scoring ---------------------------------------------------------------

@query("story_authority", with_tables("authorities", body="SELECT story_id, round(authority, 6) AS authority FROM authorities"))
def story_authority(spark, sf):
    return scoring.story_authority(fx.members(spark, sf), fx.sources(spark, sf)).select("story_id", F.round("authority", 6).alias("authority"))


@query("story_authority_per_source", with_tables("members", "sources", body="""
    SELECT story_id, round(avg(authority), 6) AS authority FROM (SELECT DISTINCT m.story_id, s.source_id, s.authority
        FROM members m JOIN sources s ON s.source_id = m.source_id) GROUP BY story_id"""))
def story_authority_per_source(spark, sf):
    return scoring.story_authority(fx.members(spark, sf), fx.sources(spark, sf), per_source=True).select(
        "story_id", F.round("authority", 6).alias("authority"))


@query("velocity", with_tables("story_facts", body="""
    SELECT story_id, round(least(1.0, ln(1 + outlet_count) / ln(11)), 6) AS velocity FROM story_facts"""))
def velocity(spark, sf):
    outlets = story_ops.distinct_per_key(fx.members(spark, sf), "story_id", "source_id", "outlet_count")
    return outlets.select("story_id", F.round(scoring.velocity(F.col("outlet_count")), 6).alias("velocity"))


def _stories(spark, sf) -> DataFrame:
    return cut_lineage(story_ops.story_rollup(fx.members(spark, sf), fx.AS_OF))


@query("novelty", with_tables("story_facts", "peaks", body="""
    SELECT f.story_id, round(CASE WHEN p.peak IS NULL THEN 1.0 ELSE greatest(0.0, 1 - p.peak) END, 5) AS novelty
    FROM story_facts f LEFT JOIN peaks p ON p.story_id = f.story_id"""))
def novelty(spark, sf):
    return scoring.novelty(_stories(spark, sf)).select("story_id", F.round("novelty", 5).alias("novelty"))


@query("story_entity_weight", with_tables("members", body=f"""
    SELECT s.story_id, coalesce(w, 0.5) AS weight FROM (SELECT DISTINCT story_id FROM members) s LEFT JOIN (
        SELECT story_id, max(length(e)) / 100.0::DOUBLE AS w FROM (SELECT story_id, unnest({sql_entities('text')}) AS e FROM members) GROUP BY story_id) x
    ON x.story_id = s.story_id"""))
def story_entity_weight(spark, sf):
    bridge, entities = scoring.story_entity_tables(fx.members(spark, sf))
    stories = fx.members(spark, sf).select("story_id").distinct()
    weighted = entities.withColumn("weight", F.char_length("name") / F.lit(100.0))
    return scoring.story_entity_weight(stories, bridge, weighted).select("story_id", F.col("entity").alias("weight"))


@query("story_entities", with_tables("members", body=f"""
    SELECT e AS name, count(DISTINCT story_id) AS stories FROM (SELECT story_id, unnest({sql_entities('text')}) AS e FROM members) GROUP BY e"""))
def story_entities(spark, sf):
    return scoring.story_entity_tables(fx.members(spark, sf))[1].select("name", "stories")


def scored(spark, sf, digits: int = 6) -> DataFrame:
    data = scoring.ScoringInput(_stories(spark, sf), fx.members(spark, sf), fx.sources(spark, sf))
    return scoring.score_stories(data).withColumn("score", F.round("score", digits))


@query("score_stories", with_tables("scored", body="""
    SELECT story_id, score, round(authority, 5) AS authority, round(velocity, 5) AS velocity, round(novelty, 5) AS novelty FROM scored"""))
def score_stories(spark, sf):
    return scored(spark, sf).select("story_id", "score", *[
        F.round(f"score_breakdown.{n}", 5).alias(n) for n in ("authority", "velocity", "novelty")])


@query("top_stories", with_tables("items", "sources", recursive=True, extra={
    **_sql_match(None),
    "grouped": "SELECT r.story_id, i.* FROM roots r JOIN items i ON i.item_id = r.item_id",
    "facts": f"""SELECT story_id, arg_min(title, item_id) AS title, arg_min(coalesce(pub, {AS_OF}), item_id) AS first_seen,
        count(*) AS item_count, count(DISTINCT source_id) AS outlet_count FROM grouped GROUP BY story_id""",
    "cents": """SELECT story_id, list(m::FLOAT::DOUBLE ORDER BY pos) AS centroid FROM (SELECT story_id, pos, avg(x) AS m FROM (
        SELECT story_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM grouped) GROUP BY story_id, pos) GROUP BY story_id""",
    "tops": f"""SELECT s.story_id, max({sql_cos('cs.centroid', 'co.centroid')}) AS peak FROM facts s JOIN cents cs ON cs.story_id = s.story_id
        JOIN facts o ON o.first_seen < s.first_seen AND o.first_seen >= s.first_seen - 7776000 JOIN cents co ON co.story_id = o.story_id GROUP BY s.story_id""",
    "auth": "SELECT g.story_id, avg(DISTINCT s.authority) AS authority FROM grouped g JOIN sources s ON s.source_id = g.source_id GROUP BY g.story_id",
}, body="""
    SELECT story_id, title, item_count, outlet_count, score FROM (
        SELECT f.*, round(greatest(0.0, least(1.0, (0.25 * coalesce(a.authority, 0.5) + 0.40 * least(1.0, ln(1 + outlet_count) / ln(11))
            + 0.20 * CASE WHEN t.peak IS NULL THEN 1.0 ELSE greatest(0.0, 1 - t.peak) END) / 0.85)), 5) AS score
        FROM facts f LEFT JOIN tops t ON t.story_id = f.story_id LEFT JOIN auth a ON a.story_id = f.story_id)
    ORDER BY score DESC, story_id LIMIT 50"""))
def top_stories(spark, sf):
    clustered = _clustered(spark, sf)
    ranked = jobs.score(clustered, fx.sources(spark, sf)).withColumn("score", F.round("score", 5))
    return rank.top_stories(ranked, 50).select("story_id", "title", "item_count", "outlet_count", "score")


# -- sweep --------------------------------------------------------------------

def _sweep(spark, sf):
    members = fx.members(spark, sf)
    stories = scored(spark, sf).withColumn("category", F.lit(None).cast("string"))
    topic = vectors.unit_mean_centroid(fx.table(spark, sf, "embeddings"), "embedding")
    findings = gate.sweep_findings(members, stories, topic, **_GATE)
    return members, stories, findings


@query("relevance_sweep", with_tables("members", "scored", "topic", extra={**_JUDGED}, body=f"""
    SELECT j.item_id, j.source_id, s.story_id, s.title AS story_title, s.score AS story_score, {_REASON} AS reason
    FROM judged j JOIN scored s ON s.story_id = j.item_id // 5 WHERE NOT (cos >= threshold OR hits >= 1)"""))
def relevance_sweep(spark, sf):
    _, _, findings = _sweep(spark, sf)
    return findings.select("item_id", "source_id", "story_id", "story_title", "story_score", "reason")


@query("sweep_recompute", with_tables("members", "story_facts", "topic", extra={**_JUDGED,
    "off": "SELECT item_id, item_id // 5 AS story_id FROM judged WHERE NOT (cos >= threshold OR hits >= 1)",
    "rest": "SELECT m.* FROM members m WHERE item_id NOT IN (SELECT item_id FROM off)"}, body="""
    SELECT f.story_id, coalesce(r.n, 0) AS item_count, coalesce(r.o, 0) AS outlet_count,
           coalesce(CASE WHEN t.story_id IS NULL THEN f.updated_at ELSE coalesce(r.u, f.updated_at) END, 0)::BIGINT AS updated_at, r.n IS NULL AS deleted
    FROM story_facts f LEFT JOIN (SELECT DISTINCT story_id FROM off) t ON t.story_id = f.story_id
    LEFT JOIN (SELECT story_id, count(*) AS n, count(DISTINCT source_id) AS o, max(pub) AS u FROM rest GROUP BY story_id) r ON r.story_id = f.story_id"""))
def sweep_recompute(spark, sf):
    members, stories, findings = _sweep(spark, sf)
    findings = cut_lineage(findings)
    stories = cut_lineage(stories)
    left, deleted = gate.sweep_apply(members, stories, findings)
    gone = stories.join(deleted, "story_id", "left_semi").select(
        "story_id", F.lit(0).cast("long").alias("item_count"), F.lit(0).cast("long").alias("outlet_count"),
        F.unix_seconds("updated_at").alias("updated_at"), F.lit(True).alias("deleted"))
    return left.select("story_id", "item_count", "outlet_count", F.unix_seconds("updated_at").alias("updated_at"), F.lit(False).alias("deleted")).unionByName(gone)


# -- graph and calibration ------------------------------------------------------

_EDGES = {
    "edges": f"""SELECT a.vec_id AS i, b.vec_id AS j, round({sql_cos('a.e', 'b.e')}, 9) AS score, a.label = b.label AS same_label
        FROM vecs a JOIN vecs b ON a.vec_id < b.vec_id""",
}
_VECS = {"vecs": "SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings"}


@query("connected_components", with_tables(recursive=True, extra={**_VECS, **_EDGES,
    "strong": "SELECT i, j FROM edges WHERE score >= 0.35 UNION ALL SELECT j, i FROM edges WHERE score >= 0.35",
    "walk": "SELECT i AS node, i AS hop FROM strong UNION SELECT w.node, s.j FROM walk w JOIN strong s ON s.i = w.hop"}, body="""
    SELECT node, min(hop) AS component FROM walk GROUP BY node"""))
def connected_components(spark, sf):
    edges = cut_lineage(pairs.similarity_links(fx.table(spark, sf, "embeddings"), "vec_id", "embedding", 0.35))
    return story_ops.connected_components(edges)


def labelled_vectors(spark, sf) -> DataFrame:
    """Every vector and a distorted copy of it under one label, with entities
    of which the copy shares most."""
    k = F.col("vec_id")
    names = [F.concat(F.lit("e"), (k % 97).cast("string")), F.concat(F.lit("f"), (k % 61).cast("string")), F.concat(F.lit("g"), (k % 7).cast("string"))]
    v = F.col("embedding").cast("array<double>")
    twin = F.zip_with(v, F.reverse(v), lambda x, y: x + 0.5 * y)
    base = fx.table(spark, sf, "embeddings")
    return base.select((F.col("vec_id") * 2).alias("row_id"), F.col("vec_id").alias("label"), v.alias("embedding"), F.array(*names).alias("entities")).unionByName(
        base.select((F.col("vec_id") * 2 + 1).alias("row_id"), F.col("vec_id").alias("label"), twin.alias("embedding"), F.array(*names[:2], F.lit("own")).alias("entities")))


_TWINS = {
    "base": "SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings",
    "twins": """SELECT vec_id * 2 AS row_id, vec_id AS label, e, ['e' || (vec_id % 97), 'f' || (vec_id % 61), 'g' || (vec_id % 7)] AS names FROM base
        UNION ALL SELECT vec_id * 2 + 1, vec_id, list_transform(range(1, len(e) + 1), lambda k: e[k] + 0.5::DOUBLE * e[len(e) + 1 - k]),
            ['e' || (vec_id % 97), 'f' || (vec_id % 61), 'own'] FROM base""",
    "scored_twins": f"""SELECT a.label = b.label AS same_label, {sql_cos('a.e', 'b.e')} AS c, {sql_jaccard('a.names', 'b.names')} AS x
        FROM twins a JOIN twins b ON a.row_id < b.row_id""",
    "tied": """SELECT same_label, s.signal, round(s.a * c + s.b * x, 9) AS score
        FROM scored_twins, (VALUES ('cosine', 1.0::DOUBLE, 0.0::DOUBLE), ('entities', 0.0, 1.0), ('blend', 0.6, 0.4)) s(signal, a, b)""",
    "ends": "SELECT signal, min(score) FILTER (same_label) AS low, max(score) FILTER (NOT same_label) AS high FROM tied GROUP BY signal",
}
_SWEEP = "SELECT signal, t / 100.0::DOUBLE AS threshold, high < t / 100.0::DOUBLE AND low >= t / 100.0::DOUBLE AS passes FROM range(20, 95) r(t), ends"


def _sweep_points(spark, sf) -> DataFrame:
    labelled = labelled_vectors(spark, sf)
    inside = cut_lineage(pairs.similarity_forest(labelled, "row_id", "embedding", 0.20, "label", entities="entities", signals=pairs.SIGNALS))
    crossing = pairs.cosine_extremes(labelled, "row_id", "embedding", "label", entities="entities", signals=pairs.SIGNALS)
    return calibrate.threshold_sweep(inside, crossing, labelled.select("row_id", "label"))


@query("threshold_sweep", with_tables(extra=_TWINS, body=_SWEEP))
def threshold_sweep(spark, sf):
    return _sweep_points(spark, sf)


@query("calibrate_threshold", with_tables(extra=_TWINS, body=f"""
    SELECT e.signal, coalesce(min(threshold), 0) AS low, coalesce(max(threshold), 0) AS high, round(coalesce(max(threshold) - min(threshold), 0), 2) AS width
    FROM ends e LEFT JOIN (SELECT * FROM ({_SWEEP}) WHERE passes) p ON p.signal = e.signal GROUP BY e.signal"""))
def calibrate_threshold(spark, sf):
    return calibrate.safe_band(_sweep_points(spark, sf))


@query("separation_margin", with_tables(extra=_TWINS, body="""
    SELECT signal, round(low, 6) AS lowest_same, round(high, 6) AS highest_different, round(low - high, 6) AS margin FROM ends"""))
def separation_margin(spark, sf):
    ends = pairs.cosine_extremes(labelled_vectors(spark, sf), "row_id", "embedding", "label", entities="entities", signals=pairs.SIGNALS)
    return calibrate.separation_margin(ends).select("signal", *[F.round(c, 6).alias(c) for c in ("lowest_same", "highest_different", "margin")])


# -- health ------------------------------------------------------------------------

@query("failure_streaks", with_tables("collect_log", body="""
    SELECT source_id, count(*) FILTER (NOT ok AND (last_ok IS NULL OR run_id > last_ok)) AS consecutive_failures,
           epoch_us(max(run_ts) FILTER (ok)) AS last_run_at, arg_max(coalesce(error, ''), run_id) AS last_error
    FROM (SELECT *, max(run_id) FILTER (ok) OVER (PARTITION BY source_id) AS last_ok FROM collect_log) GROUP BY source_id"""))
def failure_streaks(spark, sf):
    return health.failure_streaks(fx.collect_log(spark, sf)).select(
        "source_id", "consecutive_failures", F.unix_micros("last_run_at").alias("last_run_at"), F.coalesce("last_error", F.lit("")).alias("last_error"))


@query("collect_counters", with_tables("collect_log", body="""
    SELECT source_id, coalesce(sum(new_items) FILTER (ok), 0)::BIGINT AS new_items, coalesce(sum(duplicates) FILTER (ok), 0)::BIGINT AS skipped_duplicates,
           count(*) FILTER (NOT ok) AS errors FROM collect_log GROUP BY ROLLUP (source_id)"""))
def collect_counters(spark, sf):
    return health.collect_counters(fx.collect_log(spark, sf))


@query("source_health_summary", with_tables("sources", body="""
    SELECT count(*) FILTER (enabled AND consecutive_failures = 0) AS healthy, count(*) FILTER (enabled AND consecutive_failures IN (1, 2)) AS degraded,
           count(*) FILTER (enabled AND consecutive_failures >= 3) AS failing, count(*) FILTER (NOT enabled) AS disabled FROM sources"""))
def source_health_summary(spark, sf):
    return health.source_health_summary(fx.sources(spark, sf))


@query("struggling_sources", with_tables("sources", body="SELECT source_id, consecutive_failures FROM sources WHERE enabled AND consecutive_failures >= 1"))
def struggling_sources(spark, sf):
    return health.struggling_sources(fx.sources(spark, sf)).select("source_id", "consecutive_failures")


PROVIDER_DAYS = with_tables("attempts", extra={
    "runs": """SELECT *, sum(CASE WHEN status = 429 THEN 0 ELSE 1 END) OVER (PARTITION BY provider, ts::DATE ORDER BY ts, attempt_id) AS run
        FROM attempts WHERE status <> 402""",
    "lens": "SELECT provider, ts::DATE AS day, run, count(*) FILTER (status = 429) AS len FROM runs GROUP BY ALL",
    "streaks": "SELECT provider, day, max(len) AS longest, arg_max(len, run) AS tail FROM lens GROUP BY ALL"}, body="""
    SELECT a.provider, CAST(a.ts::DATE AS VARCHAR) AS day, count(*) AS requests, count(*) FILTER (status < 400) AS successes,
           count(*) FILTER (status >= 400) AS failures, coalesce(any_value(s.tail), 0) AS consecutive_429,
           bool_or(status = 402) OR coalesce(any_value(s.longest), 0) >= 3 AS disabled
    FROM attempts a LEFT JOIN streaks s ON s.provider = a.provider AND s.day = a.ts::DATE GROUP BY a.provider, a.ts::DATE""")


@query("provider_daily_status", PROVIDER_DAYS)
def provider_daily_status(spark, sf):
    return health.provider_daily_status(fx.attempts(spark, sf)).withColumn("day", F.col("day").cast("string"))


def _outcomes(spark, sf) -> DataFrame:
    log = fx.fetch_log(spark, sf)
    image = text.meta_image(F.col("html"), F.col("url"))
    return log.withColumn("image_url", image).select(
        "source_id", text.classify_fetch(F.col("status"), F.col("exception"), F.col("image_url")).alias("outcome"), "image_url")


_OUTCOME = """CASE WHEN exception IS NOT NULL THEN 'network_error' WHEN status IN (403, 429) THEN 'blocked_' || status
    WHEN status >= 300 THEN 'http_' || status WHEN image IS NULL THEN 'no_og_tag' ELSE 'ok' END"""


@query("image_outcomes", with_tables("fetch_log", body=f"""
    SELECT source_id, count(*) AS attempted, count(*) FILTER (o = 'ok') AS gained, count(*) FILTER (o = 'no_og_tag') AS no_og_tag,
           count(*) FILTER (starts_with(o, 'blocked_')) AS blocked, count(*) FILTER (starts_with(o, 'http_')) AS http_error
    FROM (SELECT source_id, {_OUTCOME} AS o FROM fetch_log) WHERE o <> 'network_error' GROUP BY ROLLUP (source_id)"""))
def image_outcomes(spark, sf):
    return health.image_outcomes(_outcomes(spark, sf))


@query("image_outcome_counts", with_tables("fetch_log", body=f"""
    SELECT source_id, CASE WHEN o = 'ok' THEN 'gained' ELSE o END AS outcome, count(*) AS n
    FROM (SELECT source_id, {_OUTCOME} AS o FROM fetch_log) WHERE o <> 'network_error' GROUP BY ALL"""))
def image_outcome_counts(spark, sf):
    return health.image_outcome_counts(_outcomes(spark, sf))


@query("stage_counts", with_tables("items", body=f"""
    SELECT stage, count(*) AS items FROM (SELECT CASE WHEN item_id = f THEN 'normalized' ELSE 'failed' END AS stage FROM (
        SELECT item_id, min(item_id) OVER (PARTITION BY {_HASH}) AS f FROM items)) GROUP BY stage"""))
def stage_counts(spark, sf):
    kept, failed = first_by_content(fx.items(spark, sf).select("item_id", "text"))
    return health.stage_counts(kept.select(F.lit("normalized").alias("stage")).unionByName(failed.select(F.lit("failed").alias("stage"))))


@query("run_summary", with_tables("items", "topic", extra=_JUDGED, body=f"""
    SELECT 'normalize' AS stage, count(*) FILTER (item_id = f) AS processed, count(*) FILTER (item_id <> f) AS failed, 0 AS rejected, (count(*) + 99) // 100 + 1 AS rounds
    FROM (SELECT item_id, min(item_id) OVER (PARTITION BY {_HASH}) AS f FROM items)
    UNION ALL SELECT 'relevance', count(*), 0, count(*) FILTER (NOT (cos >= threshold OR hits >= 1)), (count(*) + 199) // 200 + 1 FROM judged"""))
def run_summary(spark, sf):
    items = fx.items(spark, sf)
    kept, failed = first_by_content(items.select("item_id", "text"))
    verdicts = jobs.relevance_verdicts(items, fx.table(spark, sf, "embeddings"), **_GATE).select(
        "item_id", F.lit("relevance").alias("stage"), F.when(F.col("reject_reason").isNull(), F.lit("processed")).otherwise(F.lit("rejected")).alias("outcome"))

    def tag(df, stage, outcome):
        return df.select("item_id", F.lit(stage).alias("stage"), F.lit(outcome).alias("outcome"))

    return health.run_summary(health.claim_rounds(
        tag(kept, "normalize", "processed").unionByName(tag(failed, "normalize", "failed"))
        .unionByName(verdicts), {"normalize": 100, "relevance": 200}))


@query("stats", with_tables("scored", "members", "items", "topic", extra={
    **_JUDGED,
    "titles": "SELECT story_id, arg_min(title, item_id) AS title FROM members GROUP BY story_id",
    "parts": f"""
        SELECT 'stage' AS part, CASE WHEN cos >= threshold OR hits >= 1 THEN 'relevant' ELSE 'rejected' END AS name, count(*)::DOUBLE AS value, NULL AS id FROM judged GROUP BY 2
        UNION ALL SELECT 'rejected', '', count(*), NULL FROM judged WHERE NOT (cos >= threshold OR hits >= 1)
        UNION ALL SELECT 'rejected_by_source', source_id, count(*), NULL FROM judged WHERE NOT (cos >= threshold OR hits >= 1) GROUP BY 2
        UNION ALL SELECT 'stories', '', count(*), NULL FROM scored
        UNION ALL (SELECT 'top_stories', t.title, score, s.story_id FROM scored s JOIN titles t ON t.story_id = s.story_id ORDER BY score DESC, s.story_id LIMIT 10)""",
}, body="""
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY value DESC, id, name) AS place, name, value FROM parts"""))
def stats(spark, sf):
    kept, off = jobs.relevance(fx.items(spark, sf), fx.table(spark, sf, "embeddings"), **_GATE)
    stages = kept.select(F.lit("relevant").alias("stage")).unionByName(off.select(F.lit("rejected").alias("stage")))
    return jobs.stats(stages, off, cut_lineage(scored(spark, sf)))


@query("rejected_by_source", with_tables("items", "topic", extra=_JUDGED, body="""
    SELECT source_id, count(*) AS rejected FROM judged WHERE NOT (cos >= threshold OR hits >= 1) GROUP BY source_id"""))
def rejected_by_source(spark, sf):
    _, off = jobs.relevance(fx.items(spark, sf), fx.table(spark, sf, "embeddings"), **_GATE)
    return health.rejected_by_source(off)


@query("coverage_warning", with_tables("items", "sources", extra={
    "win": f"SELECT *, {AS_OF} - coalesce(max_backfill_days, 30) * 86400 AS cap FROM sources",
    "due": "SELECT *, CASE WHEN last_run_at IS NULL THEN cap ELSE greatest(cap, last_run_at) END AS since, last_run_at IS NULL OR cap > last_run_at AS capped FROM win"},
    body="""
    SELECT d.source_id, count(i.pub) AS dated,
        nullif(concat_ws('; ', CASE WHEN any_value(capped) AND any_value(last_run_at) IS NULL THEN 'first run' WHEN any_value(capped) THEN 'gap' END,
            CASE WHEN count(i.pub) > 0 AND min(i.pub) > any_value(since) THEN 'all ' || count(i.pub) || ' dated' END), '') AS warning
    FROM due d LEFT JOIN items i ON i.source_id = d.source_id GROUP BY d.source_id"""))
def coverage_warning(spark, sf):
    since = jobs.due_sources(fx.sources(spark, sf).withColumn("enabled", F.lit(True)), fx.AS_OF, default_days=30, ignore_cadence=True)
    full = health.coverage_warning(fx.items(spark, sf).select("source_id", "published_at"), since)
    short = F.regexp_replace(F.regexp_replace(
        F.regexp_replace("coverage_warning", r"source=\S+: (first run|gap)[^;]*(?:; older history[^;]*)?", "$1"),
        r"rss source='[^']*': (all \d+ dated).*", "$1"), r"; *$", "")
    return full.select("source_id", "dated", short.alias("warning"))


@query("budget_used", with_tables("story_facts", body=f"""
    SELECT count(*) FILTER (updated_at >= {AS_OF}) AS used, greatest(0, 100 - count(*) FILTER (updated_at >= {AS_OF})) AS remaining FROM story_facts"""))
def budget_used(spark, sf):
    return health.budget_used(_stories(spark, sf).withColumn("analyzed_at", F.col("updated_at")), fx.AS_OF, 100).withColumn(
        "remaining", F.col("remaining").cast("long"))


# -- catalogue ------------------------------------------------------------------------

def wanted_catalogue(spark, sf) -> DataFrame:
    """The catalogue a sync would read: some sources gone, some changed, some
    new for every supplier nation."""
    k = F.col("k")
    base = fx.sources(spark, sf).where(k % 6 != 5).select(
        "source_id", "plugin", "territory", F.when(k % 4 == 1, F.lit(0.9)).otherwise(F.col("authority")).alias("authority"),
        "cadence_minutes", "enabled", "max_backfill_days")
    added = fx.table(spark, sf, "nation").select(
        F.concat(F.lit("nation"), "n_nationkey").alias("source_id"), F.lit("scraper").alias("plugin"),
        F.when(F.col("n_regionkey") == 0, F.lit("elsewhere")).otherwise(F.lit("policy")).alias("territory"),
        (F.col("n_nationkey") / F.lit(20.0)).alias("authority"), F.col("n_regionkey").cast("int").alias("cadence_minutes"),
        F.lit(True).alias("enabled"), F.lit(None).cast("int").alias("max_backfill_days"))
    return base.unionByName(added)


_WANTED = {"wanted": """
    SELECT source_id, 'rss' AS plugin, territory, CASE WHEN k % 4 = 1 THEN 0.9 ELSE authority END AS authority, cadence_minutes, enabled, max_backfill_days
    FROM sources WHERE k % 6 <> 5
    UNION ALL SELECT 'nation' || n_nationkey, 'scraper', CASE WHEN n_regionkey = 0 THEN 'elsewhere' ELSE 'policy' END, n_nationkey / 20.0::DOUBLE, n_regionkey, true, NULL FROM nation"""}


@query("scan_catalogue", with_tables("sources", extra=_WANTED, body="""
    SELECT source_id, unnest(list_filter([CASE WHEN cadence_minutes <= 0 THEN 'cadence_minutes must be positive' END,
        CASE WHEN authority NOT BETWEEN 0 AND 1 THEN 'authority outside [0, 1]' END,
        CASE WHEN territory IS NULL OR territory NOT IN ('research', 'industry', 'policy', 'infrastructure') THEN 'unknown territory' END],
        lambda x: x IS NOT NULL)) AS violation FROM wanted"""))
def scan_catalogue(spark, sf):
    return catalogue.catalogue_violations(wanted_catalogue(spark, sf))


def _item_counts(spark, sf) -> DataFrame:
    return fx.items(spark, sf).where(F.col("source_id") != "src5").groupBy("source_id").agg(F.count("*").alias("items"))


_DIFF = with_tables("sources", "items", extra={**_WANTED,
    "counts": "SELECT source_id, count(*) AS n FROM items WHERE source_id <> 'src5' GROUP BY source_id",
    "diff": """SELECT coalesce(s.source_id, w.source_id) AS source_id, s.source_id IS NOT NULL AS had, w.source_id IS NOT NULL AS wants,
        s.enabled AS was_enabled, c.n, w.source_id IS NOT NULL AND s.source_id IS NOT NULL AND w.authority <> s.authority AS changed
        FROM sources s FULL JOIN wanted w ON w.source_id = s.source_id LEFT JOIN counts c ON c.source_id = s.source_id""",
    "acts": """SELECT *, CASE WHEN NOT had THEN 'added' WHEN wants AND changed THEN 'updated' WHEN wants THEN 'unchanged'
        WHEN NOT was_enabled THEN 'untouched' WHEN n IS NULL THEN 'deleted' ELSE 'disabled' END AS action FROM diff"""}, body="")


@query("catalogue_diff", _DIFF + "SELECT source_id, action, had AND CASE WHEN wants THEN NOT was_enabled ELSE was_enabled END AS clears_health FROM acts")
def catalogue_diff(spark, sf):
    return catalogue.catalogue_diff(fx.sources(spark, sf), wanted_catalogue(spark, sf), _item_counts(spark, sf))


@query("catalogue_sync", _DIFF + """
    SELECT a.source_id, action, CASE WHEN action = 'disabled' THEN false WHEN wants THEN w.enabled ELSE s.enabled END AS enabled,
        CASE WHEN wants THEN w.authority ELSE s.authority END AS authority,
        CASE WHEN action = 'added' OR (had AND CASE WHEN wants THEN NOT was_enabled ELSE was_enabled END) THEN 0 ELSE s.consecutive_failures END AS consecutive_failures
    FROM acts a LEFT JOIN sources s ON s.source_id = a.source_id LEFT JOIN wanted w ON w.source_id = a.source_id WHERE action <> 'deleted'""")
def catalogue_sync(spark, sf):
    return catalogue.catalogue_sync(fx.sources(spark, sf), wanted_catalogue(spark, sf), _item_counts(spark, sf)).select(
        "source_id", "action", "enabled", "authority", "consecutive_failures")


@query("removed_sources", with_tables("sources", extra=_WANTED, body="SELECT source_id FROM sources EXCEPT SELECT source_id FROM wanted"))
def removed_sources(spark, sf):
    return catalogue.removed_sources(fx.sources(spark, sf), wanted_catalogue(spark, sf))


@query("unknown_source_ids", with_tables("sources", extra=_WANTED, body="SELECT source_id FROM wanted EXCEPT SELECT source_id FROM sources"))
def unknown_source_ids(spark, sf):
    return catalogue.unknown_source_ids(wanted_catalogue(spark, sf), fx.sources(spark, sf))
