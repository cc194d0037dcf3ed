"""Scalar, text and vector functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweave import fixtures as fx
from storyweave.functions import labels, text, urls, vectors
from storyweave.workload.registry import (
    AS_OF, query, sql_canonical_url, sql_cos, sql_entities, sql_jaccard, sql_keyword_hits, with_tables,
)

WS = r"'[ \t\r\n]+'"


@query("canonical_url", with_tables("items", body=f"""
    SELECT 'i' || item_id AS row_key, {sql_canonical_url('url')} AS canonical FROM items
    UNION ALL SELECT 'p' || page_id, {sql_canonical_url('url')} FROM pages"""))
def canonical_url(spark: SparkSession, sf: str) -> DataFrame:
    both = fx.items(spark, sf).select(F.concat(F.lit("i"), "item_id").alias("row_key"), "url").unionByName(
        fx.table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("row_key"), "url"))
    return both.select("row_key", urls.canonical_url(F.col("url")).alias("canonical"))


@query("url_hash", f"SELECT page_id, sha256({sql_canonical_url('url')}) AS url_hash FROM pages")
def url_hash(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", urls.url_hash(F.col("url")).alias("url_hash"))


@query("content_hash", f"SELECT doc_id, sha256(lower(trim(regexp_replace(text, {WS}, ' ', 'g')))) AS content_hash FROM documents")
def content_hash(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


SQL_PLAIN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'),
    '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'),
    '(?is)<nav\b[^>]*>.*?</nav\s*>', ' ', 'g'), '(?is)<head\b[^>]*>.*?</head\s*>', ' ', 'g'),
    '(?is)<footer\b[^>]*>.*?</footer\s*>', ' ', 'g'), '(?is)<[!/?a-z][^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query("html_to_text", f"SELECT page_id, {SQL_PLAIN} AS body FROM pages")
def html_to_text(spark, sf):
    return text.with_plain_text(fx.table(spark, sf, "pages").select("page_id", "html"), "html", "body").select("page_id", "body")


@query("choose_text", f"""
    SELECT page_id, chosen, length(chosen) < 20 AS too_short FROM (
        SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Summary of page ' || page_id || ', as the publisher wrote it'
            WHEN page_id % 7 = 1 THEN '' ELSE {SQL_PLAIN} END AS chosen FROM pages)""")
def choose_text(spark, sf):
    page = F.col("page_id")
    base = fx.table(spark, sf, "pages").select(
        "page_id",
        F.when(page % 3 == 0, F.format_string("<p>Summary of page %d,\n as the publisher <b>wrote it</b></p>", page))
        .when(page % 3 == 1, F.lit("  too short ")).alias("summary"),
        F.when((page % 7 == 1), F.format_string("https://arxiv.org/abs/2401.%05d", page)).otherwise(F.col("url")).alias("url"),
        text.html_to_text(F.col("html")).alias("page_text"),
    )
    return base.select(
        "page_id", text.choose_text(F.col("summary"), F.col("url"), F.col("page_text")).alias("chosen")
    ).withColumn("too_short", F.char_length("chosen") < text.MIN_TEXT_CHARS)


@query("embed_text", with_tables("items", body=r"""
    SELECT item_id, sha256(regexp_replace(title || chr(10) || chr(10) || text, '^\s+|\s+$', '', 'g')) AS body_hash FROM items"""))
def embed_text(spark, sf):
    return fx.items(spark, sf).select("item_id", F.sha2(text.embed_text(F.col("title"), F.col("text")), 256).alias("body_hash"))


@query("extract_entities", f"""
    SELECT doc_id, len(e) AS n_entities, sha256(array_to_string(list_sort(e), '|')) AS entity_hash
    FROM (SELECT doc_id, {sql_entities('text')} AS e FROM documents)""")
def extract_entities(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.extract_entities(F.col("text")).alias("e")).select(
        "doc_id", F.size("e").cast("long").alias("n_entities"),
        F.sha2(F.array_join(F.array_sort("e"), "|"), 256).alias("entity_hash"))


@query("keyword_hits", f"""
    SELECT doc_id, {sql_keyword_hits("text || CASE doc_id % 5 WHEN 0 THEN ' An AI chip by Nvidia.' WHEN 1 THEN ' éAI and GPT-4, llms' WHEN 2 THEN ' Deep Learning, deep  learning' ELSE '' END")} AS hits
    FROM documents""")
def keyword_hits(spark, sf):
    doc = F.col("doc_id") % 5
    body = F.concat("text", F.when(doc == 0, F.lit(" An AI chip by Nvidia.")).when(doc == 1, F.lit(" éAI and GPT-4, llms"))
                    .when(doc == 2, F.lit(" Deep Learning, deep  learning")).otherwise(F.lit("")))
    return fx.table(spark, sf, "documents").select("doc_id", text.keyword_hits(body).cast("long").alias("hits"))


@query("link_keys", with_tables("items", body="""
    SELECT item_id, array_to_string(list_transform(links, lambda u: regexp_extract(u, '^https://([^?]*)', 1)), '|') AS keys FROM items"""))
def link_keys(spark, sf):
    return fx.items(spark, sf).select("item_id", F.array_join(urls.link_keys(F.col("outbound_links")), "|").alias("keys"))


@query("meta_image", with_tables("fetch_log", body="SELECT page_id, image FROM fetch_log"))
def meta_image(spark, sf):
    return fx.fetch_log(spark, sf).select("page_id", text.meta_image(F.col("html"), F.col("url")).alias("image"))


@query("is_denied_host", """
    SELECT page_id, page_id % 4 IN (0, 1) AS denied FROM pages""")
def is_denied_host(spark, sf):
    page = F.col("page_id") % 4
    url = (F.when(page == 0, F.lit("https://FBCDN.net/x.png")).when(page == 1, F.lit("https://scontent.xx.fbcdn.net/y.png"))
           .when(page == 2, F.lit("https://notfbcdn.net/z.png")).otherwise(F.col("url")))
    return fx.table(spark, sf, "pages").select("page_id", urls.is_denied_host(url).alias("denied"))


@query("classify_fetch", with_tables("fetch_log", body="""
    SELECT page_id, CASE WHEN exception IS NOT NULL THEN 'network_error:' || exception WHEN status IN (403, 429) THEN 'blocked_' || status
        WHEN status >= 300 THEN 'http_' || status WHEN image IS NULL THEN 'no_og_tag' ELSE 'ok' END AS outcome FROM fetch_log"""))
def classify_fetch(spark, sf):
    image = text.meta_image(F.col("html"), F.col("url"))
    return fx.fetch_log(spark, sf).select("page_id", text.classify_fetch(F.col("status"), F.col("exception"), image).alias("outcome"))


@query("needs_image_fetch", """
    SELECT page_id, page_id % 3 <> 0 AND page_id % 5 <> 0 AND page_id % 7 <> 0 AS needed FROM pages""")
def needs_image_fetch(spark, sf):
    page = F.col("page_id")
    return fx.table(spark, sf, "pages").select("page_id", urls.needs_image_fetch(
        F.when(page % 3 == 0, F.lit("https://cdn.example.org/a.png")).when(page % 3 == 1, F.lit("")),
        F.when(page % 5 == 0, fx.as_of()),
        F.when(page % 7 == 0, F.lit("https://arxiv.org/abs/2401.00001")).otherwise(F.col("url")),
    ).alias("needed"))


@query("pick_feed_image", """
    SELECT page_id, CASE page_id % 6 WHEN 0 THEN url || '#m' WHEN 1 THEN url || '#m2' WHEN 2 THEN url || '#t' WHEN 3 THEN url || '#e'
        WHEN 4 THEN url || '#m' END AS image FROM pages""")
def pick_feed_image(spark, sf):
    kind = F.col("page_id") % 6

    def media(suffix: str, medium: str | None, mime: str | None):
        return F.struct(F.concat("url", F.lit(suffix)).alias("url"), F.lit(medium).cast("string").alias("medium"), F.lit(mime).cast("string").alias("type"))

    none = F.array().cast("array<struct<url:string,medium:string,type:string>>")
    thumbs = F.array(F.struct(F.concat("url", F.lit("#t")).alias("url")))
    files = F.array(
        F.struct(F.concat("url", F.lit("#a")).alias("url"), F.lit("audio/mpeg").alias("type")),
        F.struct(F.concat("url", F.lit("#e")).alias("url"), F.lit("IMAGE/png").alias("type")))
    return fx.table(spark, sf, "pages").select("page_id", urls.first_feed_image(
        F.when(kind == 0, F.array(media("#m", "image", None))).when(kind == 1, F.array(media("#v", "video", "video/mp4"), media("#m2", None, "image/webp")))
        .when(kind == 4, F.array(media("#m", None, None))).otherwise(none),
        F.when(kind.isin(0, 2), thumbs).otherwise(F.array().cast("array<struct<url:string>>")),
        F.when(kind.isin(2, 3), files).otherwise(F.array().cast("array<struct<url:string,type:string>>")),
    ).alias("image"))


@query("parse_loose_date", """
    SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL WHEN event_id % 7 IN (2, 4, 5) THEN epoch(date_trunc('day', ts))::BIGINT
        WHEN event_id % 7 = 3 THEN epoch(date_trunc('second', ts))::BIGINT - 7200 ELSE epoch(date_trunc('second', ts))::BIGINT END AS parsed
    FROM events""")
def parse_loose_date(spark, sf):
    ts, kind = fx.instant("ts"), F.col("event_id") % 7
    raw = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 1, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(kind == 2, F.date_format(ts, "MMMM d, yyyy"))
        .when(kind == 3, F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss '+0200'"))
        .when(kind == 4, F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == 5, F.date_format(ts, "'  'd MMM yyyy"))
        .otherwise(F.lit("sometime last week"))
    )
    return fx.table(spark, sf, "events").select("event_id", F.unix_seconds(text.parse_loose_date(raw)).alias("parsed"))


@query("strip_reasoning", r"""
    SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN regexp_replace(text, '^\s+|\s+$', '', 'g')
        ELSE regexp_replace(text || ' end', '^\s+|\s+$', '', 'g') END AS cleaned FROM conversations""")
def strip_reasoning(spark, sf):
    turn = F.col("turn") % 3
    wrapped = (
        F.when(turn == 0, F.concat(F.lit("<think>a\nb</think>"), "text", F.lit(" end<Reasoning>cut off")))
        .when(turn == 1, F.concat(F.lit("<THINKING>x<think>y</think></THINKING>"), "text", F.lit(" end")))
        .otherwise(F.concat("text", F.lit("<reflection>one</reflection> ")))
    )
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", text.strip_reasoning(wrapped).alias("cleaned"))


@query("parse_model_object", r"""
    SELECT conv_id, turn, turn % 4 < 2 AS valid, CASE WHEN turn % 4 < 2 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') END AS headline
    FROM conversations""")
def parse_model_object(spark, sf):
    turn = F.col("turn") % 4
    body = F.to_json(F.struct(F.col("text").alias("headline"), F.col("role").alias("category")))
    raw = (
        F.when(turn == 0, body).when(turn == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(turn == 2, F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.concat(F.lit("Sure: "), "text"))
    )
    parsed = text.parse_model_object(raw, "headline string, category string")
    return fx.table(spark, sf, "conversations").withColumn("p", parsed).select(
        "conv_id", "turn", F.col("p").isNotNull().alias("valid"), text.strip(F.col("p.headline")).alias("headline"))


@query("payload_hash", """
    SELECT doc_id, substr(sha256(to_json({'doc_id': doc_id, 'lang': lang, 'note': NULL::VARCHAR, 'text': text})::VARCHAR), 1, 16) AS hash
    FROM documents""")
def payload_hash(spark, sf):
    payload = F.to_json(
        F.struct("doc_id", "lang", F.lit(None).cast("string").alias("note"), "text"), {"ignoreNullFields": "false"})
    return fx.table(spark, sf, "documents").select("doc_id", text.payload_hash(payload).alias("hash"))


@query("effective_since", with_tables("sources", body=f"""
    SELECT source_id, CAST(CASE WHEN last_run_at IS NULL THEN cap ELSE greatest(cap, last_run_at) END AS BIGINT) AS since,
           last_run_at IS NULL OR cap > last_run_at AS capped, CAST({AS_OF} - 90 * 86400 AS BIGINT) AS repair_since
    FROM (SELECT *, {AS_OF} - coalesce(max_backfill_days, 0) * 86400 AS cap FROM sources)"""))
def effective_since(spark, sf):
    since, capped = labels.effective_since(F.col("last_run_at"), F.col("max_backfill_days"), fx.as_of(), 0)
    repair, _ = labels.effective_since(F.col("last_run_at"), F.col("max_backfill_days"), fx.as_of(), 2, 90)
    return fx.sources(spark, sf).select(
        "source_id", F.unix_seconds(since).alias("since"), capped.alias("capped"), F.unix_seconds(repair).alias("repair_since"))


@query("is_due", with_tables("sources", body=f"""
    SELECT source_id, enabled AND (last_run_at IS NULL OR {AS_OF} >= last_run_at + cadence_minutes * 60) AS due FROM sources"""))
def is_due(spark, sf):
    return fx.sources(spark, sf).select("source_id", labels.is_due(
        F.col("enabled"), F.col("last_run_at"), F.col("cadence_minutes"), fx.as_of()).alias("due"))


@query("source_status", with_tables("sources", body="""
    SELECT source_id, CASE WHEN NOT enabled THEN 'disabled' WHEN consecutive_failures >= 3 THEN 'failing'
        WHEN consecutive_failures > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM sources"""))
def source_status(spark, sf):
    return fx.sources(spark, sf).select("source_id", labels.source_status(F.col("enabled"), F.col("consecutive_failures")).alias("status"))


@query("importance_tier", """
    SELECT event_id, CASE WHEN s >= 0.55 THEN 'high' WHEN s >= 0.40 THEN 'medium' ELSE 'low' END AS tier,
           CAST(floor(s * 100 + 0.5) AS BIGINT) AS shown, CAST(greatest(1, least(10, floor(s * 10 + 0.5))) AS BIGINT) AS ticks
    FROM (SELECT event_id, least(1.0, value / 100.0) AS s FROM events)""")
def importance_tier(spark, sf):
    s = F.least(F.lit(1.0), F.col("value") / F.lit(100.0))
    return fx.table(spark, sf, "events").select(
        "event_id", labels.importance_tier(s).alias("tier"), labels.display_score(s).alias("shown"), labels.lit_ticks(s).cast("long").alias("ticks"))


@query("label_words", """
    SELECT o_orderkey, array_to_string(list_transform(regexp_split_to_array(lower(o_orderpriority), '[-_ ]+'),
        lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS label FROM orders""")
def label_words(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", text.label_words(F.lower("o_orderpriority")).alias("label"))


@query("hostname_of", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages")
def hostname_of(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", urls.hostname_of(F.col("url")).alias("host"))


@query("classify_error", with_tables("attempts", body="""
    SELECT attempt_id, CASE WHEN status = 429 THEN 'rate_limit' WHEN status = 402 THEN 'payment_required'
        WHEN status >= 500 THEN 'transient' END AS error FROM attempts"""))
def classify_error(spark, sf):
    return fx.attempts(spark, sf).select("attempt_id", labels.classify_error(F.col("status")).alias("error"))


@query("threshold_for", with_tables("items", body="SELECT item_id, CASE WHEN model_id = 'm2' THEN 0.35 ELSE 0.50 END::DOUBLE AS threshold FROM items"))
def threshold_for(spark, sf):
    return fx.items(spark, sf).select("item_id", vectors.threshold_for(F.col("model_id"), {"m2": 0.35}, 0.50).alias("threshold"))


_NEIGHBOURS = "embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@query("cosine", f"SELECT a.vec_id, round({sql_cos('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')}, 6) AS cos FROM {_NEIGHBOURS}")
def cosine(spark, sf):
    v = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cos"))


@query("topic_cosine", with_tables("topic", body=f"""
    SELECT vec_id, round({sql_cos('embedding::DOUBLE[]', 't.topic')}, 6) AS cos FROM embeddings, topic t"""))
def topic_cosine(spark, sf):
    v = fx.table(spark, sf, "embeddings")
    topic = vectors.unit_mean_centroid(v, "embedding")
    return v.withColumn("topic", topic.select("centroid").scalar()).select(
        "vec_id", F.round(vectors.cosine_to_unit(F.col("embedding"), F.col("topic")), 6).alias("cos"))


@query("mean_centroid", """
    SELECT label, pos, round(avg(x), 5) AS mean FROM (
        SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos""")
def mean_centroid(spark, sf):
    means = vectors.mean_vectors(fx.table(spark, sf, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("centroid").alias("pos", "x")).select(
        "label", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 5).alias("mean"))


def _neighbour_items(spark, sf) -> DataFrame:
    left = fx.signalled_items(spark, sf)
    right = left.select(
        (F.col("item_id") - 1).alias("item_id"), F.col("entities").alias("entities_b"), F.col("link_keys").alias("links_b"),
        F.col("embedding").alias("embedding_b"), F.col("published_at").alias("published_b"))
    return left.join(right, "item_id")


_SQL_PAIRS = with_tables("items", body="", extra={
    "sig": f"""SELECT item_id, pub, v, model_id, {sql_entities("title || ' ' || text")} AS ents,
        list_transform(links, lambda u: regexp_extract(u, '^https://([^?]*)', 1)) AS keys FROM items""",
    "scored": f"""SELECT a.item_id, {sql_jaccard('a.ents', 'b.ents')} AS ent, {sql_jaccard('a.keys', 'b.keys')} AS link,
        {sql_cos('a.v', 'b.v')} AS cos, CASE WHEN a.pub IS NOT NULL AND b.pub IS NOT NULL THEN greatest(0.0, 1 - abs(a.pub - b.pub) / 3600.0 / 48.0) END AS near
        FROM sig a JOIN sig b ON b.item_id = a.item_id + 1""",
})


@query("jaccard", _SQL_PAIRS + "SELECT item_id, round(ent, 6) AS entity_overlap, round(link, 6) AS link_overlap FROM scored")
def jaccard(spark, sf):
    return _neighbour_items(spark, sf).select(
        "item_id", F.round(vectors.jaccard(F.col("entities"), F.col("entities_b")), 6).alias("entity_overlap"),
        F.round(vectors.jaccard(F.col("link_keys"), F.col("links_b")), 6).alias("link_overlap"))


@query("pair_score", _SQL_PAIRS + """
    SELECT item_id, round(near, 6) AS proximity, round(s, 6) AS score,
           CASE WHEN s >= 0.13 THEN 'same' WHEN s <= 0.07 THEN 'different' ELSE 'ambiguous' END AS verdict
    FROM (SELECT item_id, near, round(least(1.0, 0.6 * cos + 0.4 * ent + 0.1 * link) * coalesce(near, 1.0), 9) AS s FROM scored)""")
def pair_score(spark, sf):
    p = _neighbour_items(spark, sf)
    s = F.round(vectors.pair_score(
        vectors.cosine(F.col("embedding"), F.col("embedding_b")), vectors.jaccard(F.col("entities"), F.col("entities_b")),
        vectors.jaccard(F.col("link_keys"), F.col("links_b")), F.col("published_at"), F.col("published_b")), 9)
    return p.withColumn("s", s).select(
        "item_id", F.round(vectors.time_proximity(
            F.col("published_at"), F.col("published_b"), 48), 6).alias("proximity"),
        F.round("s", 6).alias("score"), vectors.adjudicate(F.col("s"), F.lit(0.10)).alias("verdict"))


@query("finite_vector", "SELECT vec_id, vec_id % 3 NOT IN (1, 2) AS finite FROM embeddings")
def finite_vector(spark, sf):
    bad = (F.when(F.col("vec_id") % 3 == 1, F.array_append("embedding", F.lit(float("nan")).cast("float")))
           .when(F.col("vec_id") % 3 == 2, F.array_append("embedding", F.lit(float("-inf")).cast("float")))
           .otherwise(F.col("embedding")))
    return fx.table(spark, sf, "embeddings").select("vec_id", vectors.finite_vector(bad).alias("finite"))


@query("since_filter", with_tables("items", body="SELECT item_id FROM items WHERE pub IS NULL OR pub > 1705276800"))
def since_filter(spark, sf):
    return fx.items(spark, sf).where(labels.since_filter(F.col("published_at"), F.timestamp_seconds(F.lit(1705276800)))).select("item_id")
