"""Query registry and the SQL forms of the derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyweave.functions import text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


AS_OF = 1706659200  # 2024-01-31 00:00:00 UTC


def sql_entities(column: str) -> str:
    """Entity list of a text. RE2 only knows ASCII word edges, so letters
    outside ASCII become '_', a word character no pattern matches."""
    folded = rf"regexp_replace({column}, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]', '_', 'g')"
    first, second, third = (f"regexp_extract_all({folded}, '{p}')" for p in text.ENTITY_PATTERNS)
    found = f"list_concat(list_concat({first}, {second}), {third})"
    stop = ", ".join(f"'{w}'" for w in text.ENTITY_STOPWORDS)
    return (
        f"list_distinct(list_filter(list_transform({found}, lambda w: lower(w)), "
        f"lambda w: w NOT IN ({stop}) AND length(w) > 1))"
    )


def sql_keyword_hits(column: str) -> str:
    folded = rf"regexp_replace({column}, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]', '_', 'g')"
    listed = "|".join(text.KEYWORD_PHRASES)
    return (
        rf"(len(regexp_extract_all({folded}, '(?i)\b({listed})\b')) + len(regexp_extract_all({folded}, '\bAI\b')))"
    )


def sql_dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def sql_cos(a: str, b: str) -> str:
    return (
        f"coalesce(greatest(-1.0, least(1.0, {sql_dot(a, b)} / nullif(sqrt({sql_dot(a, a)} * {sql_dot(b, b)}), 0))), 0.0)"
    )


def sql_jaccard(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return f"coalesce({inter}::DOUBLE / nullif(len({a}) + len({b}) - {inter}, 0), 0.0)"


def sql_canonical_url(column: str) -> str:
    """Canonical form of URLs whose parameters need no escaping."""
    netloc = f"lower(regexp_extract({column}, '^[a-zA-Z]+://([^/?#]*)', 1))"
    path = f"regexp_replace(regexp_extract({column}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
    params = (
        f"list_sort(list_filter(string_split(regexp_extract({column}, '\\?([^#]*)', 1), '&'), "
        "lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND "
        "split_part(lower(p), '=', 1) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref_src')))"
    )
    return (
        f"('https://' || regexp_replace({netloc}, '^www\\.', '') || CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
        f"CASE WHEN len({params}) > 0 THEN '?' || array_to_string({params}, '&') ELSE '' END)"
    )


_TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "items": ((), f"""
        SELECT d.doc_id AS item_id, d.source AS source_id, split_part(d.text, chr(10), 1) AS title, d.text AS text,
               'http://WWW.s' || (d.doc_id % 7) || '.example.com/a/' || (d.doc_id % 613)
                   || '/?utm_source=x&b=2&a=' || (d.doc_id % 5) AS url,
               CASE WHEN d.doc_id % 17 <> 0
                    THEN 1704067200 + ((d.doc_id % 500) * 5184 + (d.doc_id // 500) * 1800) % 2592000 END AS pub,
               d.doc_id % c.vectors AS vec_id, CASE WHEN d.doc_id % 4 = 0 THEN 'm2' ELSE 'm1' END AS model_id,
               CASE WHEN d.doc_id % 3 = 0
                    THEN ['https://ref.example.org/p/' || (d.doc_id % 211) || '?x=' || d.doc_id] ELSE [] END AS links,
               e.embedding::DOUBLE[] AS v
        FROM documents d CROSS JOIN (SELECT count(*) AS vectors FROM embeddings) c JOIN embeddings e ON e.vec_id = d.doc_id % c.vectors"""),
    "sources": ((), f"""
        SELECT source_id, k, round(0.4::DOUBLE + 0.05::DOUBLE * (k % 8), 2) AS authority, 30 + (k % 4) * 15 AS cadence_minutes,
               CASE k % 5 WHEN 0 THEN 'research' WHEN 1 THEN 'industry' WHEN 2 THEN 'policy' WHEN 3 THEN 'infrastructure' END AS territory,
               k % 9 <> 8 AS enabled, k % 5 AS consecutive_failures,
               CASE WHEN k <> 7 THEN {AS_OF} - k * 1200 END AS last_run_at,
               CASE WHEN k % 6 = 0 THEN k % 3 + 1 END AS max_backfill_days,
               CASE WHEN k % 5 > 0 THEN repeat('error ' || k || ' ', 45) END AS last_error
        FROM (SELECT DISTINCT source AS source_id, CAST(substr(source, 4) AS INTEGER) AS k FROM documents)"""),
    "members": (("items",), "SELECT *, item_id // 5 AS story_id FROM items"),
    "story_facts": (("members",), f"""
        SELECT story_id, arg_min(title, item_id) AS title, arg_min(coalesce(pub, {AS_OF}), item_id) AS first_seen,
               max(coalesce(pub, {AS_OF})) AS updated_at, count(*) AS item_count,
               count(DISTINCT source_id) AS outlet_count, bool_or(pub IS NOT NULL) AS has_dated_item
        FROM members GROUP BY story_id"""),
    "centroids": (("members",), """
        SELECT story_id, list(m::FLOAT::DOUBLE ORDER BY pos) AS centroid FROM (
            SELECT story_id, pos, avg(x) AS m
            FROM (SELECT story_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM members)
            GROUP BY story_id, pos)
        GROUP BY story_id"""),
    "peaks": (("story_facts", "centroids"), f"""
        SELECT s.story_id, max({sql_cos('cs.centroid', 'co.centroid')}) AS peak
        FROM story_facts s JOIN centroids cs ON cs.story_id = s.story_id
        JOIN story_facts o ON o.first_seen < s.first_seen AND o.first_seen >= s.first_seen - 90 * 86400
        JOIN centroids co ON co.story_id = o.story_id
        GROUP BY s.story_id"""),
    "authorities": (("members", "sources"), """
        SELECT m.story_id, avg(DISTINCT s.authority) AS authority
        FROM members m JOIN sources s ON s.source_id = m.source_id GROUP BY m.story_id"""),
    "scored": (("story_facts", "centroids", "peaks", "authorities"), """
        SELECT f.*, c.centroid, coalesce(a.authority, 0.5) AS authority,
               least(1.0, ln(1 + f.outlet_count) / ln(11)) AS velocity,
               CASE WHEN p.peak IS NULL THEN 1.0 ELSE greatest(0.0, 1 - p.peak) END AS novelty,
               round(greatest(0.0, least(1.0, (0.25 * coalesce(a.authority, 0.5)
                   + 0.40 * least(1.0, ln(1 + f.outlet_count) / ln(11))
                   + 0.20 * CASE WHEN p.peak IS NULL THEN 1.0 ELSE greatest(0.0, 1 - p.peak) END) / 0.85)), 6) AS score
        FROM story_facts f JOIN centroids c ON c.story_id = f.story_id
        LEFT JOIN peaks p ON p.story_id = f.story_id LEFT JOIN authorities a ON a.story_id = f.story_id"""),
    "reader_signals": ((), """
        SELECT user_id AS reader_id, event_id AS seq, event_id % (SELECT greatest(1, (count(*) + 4) // 5) FROM documents) AS story_id,
               CASE event_type WHEN 'view' THEN 'open' WHEN 'purchase' THEN 'save' ELSE 'dismiss' END AS signal, ts,
               CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'm1' ELSE 'm2' END AS model_id
        FROM events WHERE event_type IN ('view', 'purchase', 'error')"""),
    "collect_log": ((), """
        SELECT event_id AS run_id, 'src' || (user_id % 20) AS source_id, ts AS run_ts, event_type <> 'error' AS ok,
               CASE WHEN event_type = 'error' THEN 'HTTPError: ' || event_id END AS error,
               CASE WHEN event_type <> 'error' THEN floor(value)::BIGINT ELSE 0 END AS new_items,
               CASE WHEN event_type <> 'error' THEN event_id % 3 ELSE 0 END AS duplicates
        FROM events"""),
    "attempts": ((), """
        SELECT event_id AS attempt_id, 'p' || (user_id % 5) AS provider, ts,
               CASE WHEN event_type = 'error' AND event_id % 50 = 0 THEN 402 WHEN event_type = 'error' THEN 429
                    WHEN event_type = 'signup' AND event_id % 7 = 0 THEN 503 ELSE 200 END AS status
        FROM events"""),
    "fetch_log": ((), """
        SELECT page_id, url, 'src' || (page_id % 20) AS source_id,
               CASE page_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 404 END AS status,
               CASE WHEN page_id % 6 = 5 THEN 'ConnectTimeout' END AS exception,
               CASE WHEN page_id % 6 < 2 THEN CASE page_id % 4
                   WHEN 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/img/a.png'
                   WHEN 1 THEN 'https://cdn.example.org/b.png' END END AS image
        FROM pages"""),
    "topic": ((), """
        SELECT list(m / norm ORDER BY pos) AS topic FROM (
            SELECT pos, m, sqrt(sum(m * m) OVER ()) AS norm FROM (
                SELECT pos, avg(x / n) AS m FROM (
                    SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos,
                           sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
                GROUP BY pos))"""),
}


def with_tables(*names: str, body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``body`` behind the named derived tables and what they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _TABLES[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    parts = [f"{n} AS MATERIALIZED ({_TABLES[n][1]})" for n in order]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body
