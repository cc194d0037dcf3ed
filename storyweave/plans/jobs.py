"""The jobs a user runs, each one a chain of operators.

A stage is the table a row is in: items that fail or are rejected leave with
a reason instead of changing a status column.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyweave.functions import labels, text, urls, vectors
from storyweave.operators import gate, health, pairs, scoring, stories as story_ops
from storyweave.operators.dedup import first_by_content, first_keys_by_url, new_items
from storyweave.operators.ordering import ordinal
from storyweave.operators.rank import top_stories
from storyweave.session import cut_lineage
from storyweave.sources.registry import read_landed, unreadable


def _now(as_of: datetime):
    return F.lit(as_of).cast("timestamp")


# -- collect ---------------------------------------------------------------

@dataclass
class Collected:
    items: DataFrame
    sources: DataFrame
    counters: DataFrame


def due_sources(
    sources: DataFrame, as_of: datetime, *, default_days: int = 2, backfill_days: int | None = None,
    ignore_cadence: bool = False, only_source_ids: list[str] | None = None,
) -> DataFrame:
    """Sources to poll with the start of their window. The last three
    arguments serve a repair: widen the reach, run off schedule, for some."""
    now = _now(as_of)
    chosen = F.col("enabled") if ignore_cadence else labels.is_due(
        F.col("enabled"), F.col("last_run_at"), F.col("cadence_minutes"), now
    )
    if only_source_ids is not None:
        chosen = chosen & F.col("source_id").isin(only_source_ids)
    since, capped = labels.effective_since(
        F.col("last_run_at"), F.col("max_backfill_days"), now, default_days, backfill_days
    )
    days = F.lit(backfill_days) if backfill_days is not None else F.coalesce("max_backfill_days", F.lit(default_days))
    return sources.where(chosen).select(
        "source_id", "last_run_at", since.alias("since"), capped.alias("capped"), days.cast("int").alias("cap_days")
    )


def collect(
    landed: DataFrame, sources: DataFrame, known: DataFrame, as_of: datetime, plugins: list[str],
    options: dict[str, dict] | None = None, **schedule,
) -> Collected:
    """landed (plugin, source_id, payload, error?) -> new items. A source
    whose landing failed, or whose payload does not parse, keeps its last_run_at
    and gains a failure; the rest advance together with their items. Coverage
    is judged on all entries of a payload, before the window cuts them."""
    due = due_sources(sources, as_of, **schedule)
    polled = landed.join(due.select("source_id", "since"), "source_id")
    if "error" not in landed.columns:
        polled = polled.withColumn("error", F.lit(None).cast("string"))
    failed_rows = polled.where(F.col("error").isNotNull()).select("source_id", "error").unionByName(
        unreadable(polled.where(F.col("error").isNull())))
    broken = cut_lineage(failed_rows.groupBy("source_id").agg(F.max("error").alias("_error")))
    usable = polled.join(broken, "source_id", "left_anti")
    whole = cut_lineage(read_landed(usable.drop("since"), plugins, options).withColumn("_row", F.monotonically_increasing_id()))
    raw = whole.join(due.select("source_id", "since"), "source_id").where(
        labels.since_filter(F.col("published_at"), F.col("since"))).drop("since")
    # which entries are new is told by their keys alone; texts move once, to the ids of those that are
    firsts = first_keys_by_url(raw.withColumn("_arrival", F.struct("source_id", "entry_no", "url", "_row")), "_arrival", "_row")
    fresh = new_items(firsts, known).drop("duplicates")
    start = F.coalesce(known.agg(F.max("item_id").alias("m")).select("m").scalar(), F.lit(0))
    numbered = cut_lineage(ordinal(fresh, F.col("_arrival").asc(), out="_n").select("_row", "url_hash", (F.col("_n") + start).alias("item_id")))
    items = raw.drop("entry_no").join(numbered, "_row").drop("_row").withColumn("fetched_at", _now(as_of))
    items = cut_lineage(items)
    seen = raw.groupBy("source_id").agg(F.count("*").alias("rows"))
    kept = items.groupBy("source_id").agg(F.count("*").alias("new_items"))
    counters = (
        due.select("source_id").join(seen, "source_id", "left").join(kept, "source_id", "left")
        .join(broken, "source_id", "left")
        .select(
            "source_id", F.coalesce("new_items", F.lit(0)).alias("new_items"),
            (F.coalesce("rows", F.lit(0)) - F.coalesce("new_items", F.lit(0))).alias("skipped_duplicates"),
            F.col("_error").alias("error"),
        )
    )
    warnings = health.coverage_warning(
        whole.drop("_row").join(sources.where(F.col("plugin") == "rss").select("source_id"), "source_id", "left_semi"), due
    )
    polled_ids = usable.select("source_id").distinct().withColumn("_ok", F.lit(True))
    after = (
        sources.drop("coverage_warning").join(polled_ids, "source_id", "left").join(broken, "source_id", "left")
        .join(warnings.select("source_id", F.col("coverage_warning").alias("_warning")), "source_id", "left")
    )
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    failed = F.col("_error").isNotNull()
    after = (
        after.withColumn("last_run_at", F.when(ok, _now(as_of)).otherwise(F.col("last_run_at")))
        .withColumn("consecutive_failures", F.when(ok, 0).when(failed, F.col("consecutive_failures") + 1)
                    .otherwise(F.col("consecutive_failures")))
        .withColumn("last_error", F.when(failed, F.col("_error")).when(~ok, F.col("last_error")))
        .withColumn("coverage_warning", F.when(ok, F.col("_warning")))
        .drop("_ok", "_error", "_warning")
    )
    return Collected(items, after, counters)


# -- normalize ---------------------------------------------------------------

@dataclass
class Split:
    kept: DataFrame
    failed: DataFrame


def normalize(items: DataFrame, pages: DataFrame, known: DataFrame | None = None) -> Split:
    """items with text, content_hash and a usable image; ``pages`` (url,
    html) are the fetched articles, ``known`` the content already stored."""
    keyed = items if "url_hash" in items.columns else items.withColumn("url_hash", urls.url_hash(F.col("url")))
    usable = text.usable_summary(F.col("summary"))
    # pages that no item reads are left before any of them moves
    readers = keyed.where(~usable & ~urls.is_paper_abstract(F.col("url"))).select("url_hash").distinct()
    articles = (
        pages.select("url", "html", urls.url_hash(F.col("url")).alias("url_hash")).join(readers, "url_hash", "left_semi")
        .groupBy("url_hash").agg(F.min_by("html", "url").alias("_html"))
    )
    joined = (
        keyed.join(articles, "url_hash", "left")
        .withColumn("_own", F.when(usable, F.col("summary")))
        .withColumn("_page", F.when(~usable & ~urls.is_paper_abstract(F.col("url")), F.col("_html")))
    )
    read = cut_lineage(
        text.with_plain_text(text.with_plain_text(joined, "_own"), "_page", or_markup=False)  # a page without text has none
        .withColumn("text", F.coalesce("_own", "_page", F.lit("")))
        .drop("_html", "_own", "_page")
        .withColumn("image_url", F.when(~urls.is_denied_host(F.col("image_url")), F.col("image_url")))
    )
    long_enough = F.char_length("text") >= text.MIN_TEXT_CHARS
    kept, repeated = first_by_content(read.where(long_enough), "text", known)
    # fixed value: the error text
    empty = read.where(~F.coalesce(long_enough, F.lit(False))).select(
        "item_id", F.concat(F.lit("no text extracted for "), F.col("url")).alias("error")
    )
    return Split(kept, repeated.select("item_id", "error").unionByName(empty))


def image_backfill(items: DataFrame, fetch_log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with images filled in, outcomes). ``fetch_log`` (url, status,
    html, exception, fetched_at) is matched by canonical URL."""
    wanted = items.where(urls.needs_image_fetch(F.col("image_url"), F.col("image_checked_at"), F.col("url")))
    log = fetch_log.withColumn("url_hash", urls.url_hash(F.col("url"))).groupBy("url_hash").agg(
        F.max_by(F.struct("url", "status", "html", "exception"), "fetched_at").alias("f"),
        F.max("fetched_at").alias("_at"),
    )
    outcomes = cut_lineage(
        wanted.select("item_id", "source_id", urls.url_hash(F.col("url")).alias("url_hash")).join(log, "url_hash")
        .withColumn("found", text.meta_image(F.col("f.html"), F.col("f.url")))
        .select(
            "item_id", "source_id", F.col("_at"),
            text.classify_fetch(F.col("f.status"), F.col("f.exception"), F.col("found")).alias("outcome"),
            F.col("found").alias("image_found"),
        )
    )
    done = outcomes.where(~F.col("outcome").startswith("network_error")).select(
        "item_id", F.col("_at"), F.when(F.col("outcome") == "ok", F.col("image_found")).alias("_image")
    )
    filled = (
        items.join(done, "item_id", "left")
        .withColumn("image_url", F.coalesce("_image", "image_url"))
        .withColumn("image_checked_at", F.coalesce("_at", "image_checked_at"))
        .drop("_at", "_image")
    )
    return filled, outcomes.select("item_id", "source_id", "outcome", F.col("image_found").alias("image_url"))


# -- cluster and score --------------------------------------------------------

def with_signals(items: DataFrame) -> DataFrame:
    """items + entities and link_keys, unless they come with both."""
    if {"entities", "link_keys"} <= set(items.columns):
        return items
    return items.withColumn(
        "entities", text.extract_entities(F.concat(F.col("title"), F.lit(" "), F.coalesce("text", F.lit(""))))
    ).withColumn("link_keys", urls.link_keys(F.col("outbound_links")))


@dataclass
class Clustered:
    members: DataFrame  # every member of the stories touched by this run
    stories: DataFrame  # those stories, rolled up again
    matches: DataFrame
    failed: DataFrame


def cluster(
    new: DataFrame, as_of: datetime, known: DataFrame | None = None, *, replay: bool = False,
    window_hours: float = 48.0, **settings,
) -> Clustered:
    """Group new items with each other and with ``known`` members (same
    columns plus story_id). ``replay`` lets every item look back from its own
    date instead of from ``as_of``.

    Of the known members only possible candidates are read for matching, and
    only stories that gain an item are rolled up, so a run costs what its new
    items cost and not what history holds."""
    finite = F.coalesce(vectors.finite_vector(F.col("embedding")), F.lit(False))
    failed = new.where(~finite).select(
        "item_id",
        F.concat(F.lit("cluster: embedding for item "), F.col("item_id").cast("string"),
                 F.lit(" contains non-finite values (nan/inf)")).alias("error"),
    )
    slim = ["item_id", "source_id", "title", "published_at", "model_id", "embedding", "outbound_links"]
    columns = [*slim, "entities", "link_keys"]
    pool = with_signals(new.where(finite)).select(*columns, F.lit(None).cast("long").alias("story_id"))
    if known is not None:
        active = known
        if not replay:
            oldest = F.unix_micros(_now(as_of)) - int(window_hours * pairs.HOUR_US)
            active = known.where(F.col("published_at").isNull() | (F.unix_micros("published_at") >= oldest))
        pool = pool.unionByName(with_signals(active.where(finite)).select(*columns, "story_id"))
    signalled = cut_lineage(pool.withColumn("is_new", F.col("story_id").isNull()))
    matches = cut_lineage(pairs.best_matches(
        signalled, as_of=None if replay else as_of, window_hours=window_hours, **settings
    ))
    assigned = story_ops.assign_stories(signalled.select("item_id", "story_id"), matches)
    members = signalled.where("is_new").select(*slim, "is_new").join(assigned, "item_id")
    if known is not None:
        members = cut_lineage(members)
        touched = members.select("story_id").distinct()
        earlier = known.join(touched, "story_id", "left_semi").select(*slim, "story_id", F.lit(False).alias("is_new"))
        members = members.unionByName(earlier)
    members = cut_lineage(members)
    return Clustered(members, story_ops.story_rollup(members, as_of), matches, failed)


def merge_stories(before: DataFrame, fresh: DataFrame) -> DataFrame:
    """The story table after a run: touched stories replaced, their enriched
    columns kept."""
    ours = [c for c in fresh.columns if c != "story_id"]
    kept = before.select("story_id", *[c for c in before.columns if c not in fresh.columns])
    updated = fresh.join(kept, "story_id", "left")
    untouched = before.join(fresh.select("story_id"), "story_id", "left_anti")
    return untouched.unionByName(updated.select("story_id", *ours, *[c for c in kept.columns if c != "story_id"]), allowMissingColumns=True)


def score(
    clustered: Clustered, sources: DataFrame, before: DataFrame | None = None, *, weights: dict[str, float] | None = None
) -> DataFrame:
    """Scores of the stories a run touched. ``before`` holds the other stories
    (story_id, first_seen, outlet_count, centroid) that count as prior art."""
    fresh = cut_lineage(clustered.stories)
    if before is None:
        return scoring.score_stories(scoring.ScoringInput(fresh, clustered.members, sources), weights)
    every = before.join(fresh.select("story_id"), "story_id", "left_anti").unionByName(fresh, allowMissingColumns=True)
    data = scoring.ScoringInput(every, clustered.members, sources, wanted=fresh.select("story_id"))
    return scoring.score_stories(data, weights)


def relevance_verdicts(items: DataFrame, topic_vectors: DataFrame | None, **settings) -> DataFrame:
    """items + reject_reason. ``topic_vectors`` holds one vector per reference
    sentence of the topic, from the same encoder as the items."""
    centroid = None if topic_vectors is None else vectors.unit_mean_centroid(topic_vectors, "embedding")
    return gate.gate_verdicts(items, centroid, **settings)


def relevance(items: DataFrame, topic_vectors: DataFrame | None, **settings) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected)."""
    centroid = None if topic_vectors is None else vectors.unit_mean_centroid(topic_vectors, "embedding")
    return gate.relevance_gate(items, centroid, **settings)


def stats(stages: DataFrame, rejected: DataFrame, stories: DataFrame) -> DataFrame:
    """One report of a run (part, place, name, value): items by stage, rejected
    items in all and by source with the most first, the number of stories, and
    the top stories with their score. ``stages`` holds a row per item (stage),
    ``rejected`` one per rejected item (source_id), ``stories`` story_id, title and score."""
    def part(rows: DataFrame, title: str, name: Column, value: Column, story: Column | None = None) -> DataFrame:
        return rows.select(F.lit(title).alias("part"), name.cast("string").alias("name"), value.cast("double").alias("value"), (F.lit(None) if story is None else story).cast("long").alias("_id"))

    none = F.lit("")
    report = [
        part(health.stage_counts(stages), "stage", F.col("stage"), F.col("items")),
        part(rejected.agg(F.count("*").alias("n")), "rejected", none, F.col("n")),
        part(health.rejected_by_source(rejected), "rejected_by_source", F.col("source_id"), F.col("rejected")),
        part(stories.agg(F.count("*").alias("n")), "stories", none, F.col("n")),
        part(top_stories(stories), "top_stories", F.col("title"), F.col("score"), F.col("story_id")),
    ]
    # a row per stage, source and top story; of equal scores the story with the least id comes first
    rows = reduce(DataFrame.unionByName, report)
    order = Window.partitionBy("part").orderBy(F.desc("value"), "_id", "name")
    return rows.withColumn("place", F.row_number().over(order)).select("part", "place", "name", "value")
