"""Source and provider health from run logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyweave.functions import labels, text
from storyweave.operators.ordering import ordinal_within


def failure_streaks(log: DataFrame) -> DataFrame:
    """Per source: failures since the last success, last success, and the
    error of the latest run. ``log`` holds run_id, source_id, run_ts, ok,
    error. Two aggregates instead of a window per source."""
    last_ok = log.where("ok").groupBy("source_id").agg(F.max(F.struct("run_ts", "run_id")).alias("last_ok"))
    at = F.struct("run_ts", "run_id")
    return (
        log.join(last_ok, "source_id", "left")
        .groupBy("source_id")
        .agg(
            F.count_if(~F.col("ok") & (F.col("last_ok").isNull() | (at > F.col("last_ok")))).alias("consecutive_failures"),
            F.max("last_ok.run_ts").alias("last_run_at"),
            F.max_by("error", at).alias("last_error"),
        )
    )


def collect_counters(log: DataFrame) -> DataFrame:
    """New, duplicate and error counts per source, with a total row (NULL
    source). A failed run commits nothing."""
    return (
        log.rollup("source_id")
        .agg(
            F.coalesce(F.sum(F.when(F.col("ok"), F.col("new_items"))), F.lit(0)).alias("new_items"),
            F.coalesce(F.sum(F.when(F.col("ok"), F.col("duplicates"))), F.lit(0)).alias("skipped_duplicates"),
            F.count_if(~F.col("ok")).alias("errors"),
        )
    )


def source_health_summary(sources: DataFrame) -> DataFrame:
    status = labels.source_status(F.col("enabled"), F.col("consecutive_failures"))
    return sources.agg(*[
        F.count_if(status == name).alias(name) for name in ("healthy", "degraded", "failing", "disabled")
    ])


def struggling_sources(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("enabled") & (F.col("consecutive_failures") >= 1))


def provider_minutes(log: DataFrame) -> DataFrame:
    """Per provider and minute, of attempts (attempt_id, provider, ts, status):
    counters, whether a 402 was met, and the runs of 429s in a form in which
    two stretches of time can be put together: breaks, the longest run, and the
    runs at the head and at the tail."""
    chunk = ["provider", "minute"]
    log = log.withColumn("minute", F.date_trunc("minute", "ts"))
    at = F.struct("ts", "attempt_id")
    counters = log.groupBy(*chunk).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") < 400).alias("successes"),
        F.count_if(F.col("status") >= 400).alias("failures"),
        F.coalesce(F.bool_or(F.col("status") == 402), F.lit(False)).alias("payment"),
        F.min(at).alias("first_at"), F.max(at).alias("last_at"),
    )
    limited = F.col("status") == 429
    order = Window.partitionBy(*chunk).orderBy("ts", "attempt_id")
    runs = (
        log.where(F.col("status") != 402)
        .withColumn("_run", F.count_if(~limited).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*chunk, "_run").agg(F.count_if(limited).alias("len"))
    )
    minutes = runs.groupBy(*chunk).agg(
        F.max("_run").alias("breaks"), F.max("len").alias("longest"),
        F.max(F.when(F.col("_run") == 0, F.col("len"))).alias("head"), F.max_by("len", "_run").alias("tail"),
    )
    none = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("breaks", "longest", "head", "tail")]
    return counters.join(minutes, chunk, "left").select(*counters.columns, *none)


def provider_days(minutes: DataFrame, disable_after: int = 3) -> DataFrame:
    """Days of at most 1,440 ``provider_minutes`` each."""
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("longest"))

    def extend(state: Column, minute: Column) -> Column:
        return F.struct(
            F.when(minute["breaks"] == 0, state["run"] + minute["tail"]).otherwise(minute["tail"]).alias("run"),
            F.greatest(state["longest"], minute["longest"], state["run"] + minute["head"]).alias("longest"),
        )

    return minutes.groupBy("provider", F.to_date("minute").alias("day")).agg(
        *[F.sum(c).alias(c) for c in ("requests", "successes", "failures")], F.bool_or("payment").alias("_payment"),
        F.array_sort(F.collect_list(F.struct("minute", "breaks", "longest", "head", "tail"))).alias("_minutes"),
    ).withColumn("_s", F.aggregate("_minutes", start, extend)).select(
        "provider", "day", "requests", "successes", "failures", F.col("_s.run").alias("consecutive_429"),
        (F.col("_payment") | (F.col("_s.longest") >= disable_after)).alias("disabled"),
    )


def provider_daily_status(log: DataFrame, disable_after: int = 3) -> DataFrame:
    """Per provider and UTC day: counters, trailing run of 429s, and whether
    the day's quota rule tripped. A 402 leaves the run as it is and trips at
    once; any other answer ends it.

    A provider may hold most of the log, so runs are first summarised per minute.
    """
    return provider_days(provider_minutes(log), disable_after)


def stage_counts(stages: DataFrame) -> DataFrame:
    return stages.groupBy("stage").agg(F.count("*").alias("items"))


def rejected_by_source(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("source_id").agg(F.count("*").alias("rejected")).orderBy(F.desc("rejected"), "source_id")


def claim_rounds(backlog: DataFrame, batch: dict[str, int], order: str = "item_id") -> DataFrame:
    """``backlog`` (stage, ``order``, ...) with the round in which each row is
    claimed when a stage takes ``batch[stage]`` rows at a time in that order. A
    row that fails leaves the backlog as one that advances does, so no row is
    claimed twice. Stages are numbered across range partitions, since one of
    them may hold most rows."""
    size = F.lit(None).cast("long")
    for stage, rows in batch.items():
        size = F.when(F.col("stage") == stage, F.lit(rows).cast("long")).otherwise(size)
    placed = ordinal_within(backlog, "stage", F.col(order).asc(), out="_place")
    return placed.withColumn("round", F.ceil(F.col("_place") / size)).drop("_place")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Processed, failed, rejected and rounds per stage from (stage, outcome,
    round?) rows. A rejected row counts as processed too. The last round finds
    nothing left and ends the stage; without rounds a stage ran once."""
    rounds = F.coalesce(F.max("round"), F.lit(0)) + 1 if "round" in outcomes.columns else F.lit(1)
    return outcomes.groupBy("stage").agg(
        F.count_if(F.col("outcome").isin("processed", "rejected")).alias("processed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("outcome") == "rejected").alias("rejected"),
        rounds.cast("long").alias("rounds"),
    )


# The warning texts.
_TRUNCATED = (
    "rss source='%s': all %d dated entries in this fetch postdate since=%s -- the feed's window may have rolled past "
    "older items between runs; coverage may be incomplete"
)
_FIRST_RUN = "source=%s: first run, backfill bounded to %dd (since=%s); older history, if any, was not fetched"
_GAP = (
    "source=%s: gap since last run (%s) exceeds max_backfill_days=%d; capped fetch to since=%s -- items older than that "
    "were skipped"
)


def coverage_warning(entries: DataFrame, since: DataFrame) -> DataFrame:
    """Sources whose every dated entry postdates the start of the fetch
    window: the feed has probably rolled past older items. ``since`` holds
    (source_id, since, capped, default text pieces)."""
    seen = entries.groupBy("source_id").agg(F.count("published_at").alias("dated"), F.min("published_at").alias("oldest"))
    truncated = F.when(
        F.col("since").isNotNull() & (F.col("dated") > 0) & (F.col("oldest") > F.col("since")),
        F.format_string(_TRUNCATED, "source_id", "dated", F.date_format("since", "yyyy-MM-dd'T'HH:mm:ssXXX")),
    )
    iso = "yyyy-MM-dd'T'HH:mm:ssXXX"
    capped = F.when(
        F.col("capped") & F.col("last_run_at").isNull(),
        F.format_string(_FIRST_RUN, "source_id", "cap_days", F.date_format("since", iso)),
    ).when(
        F.col("capped"),
        F.format_string(
            _GAP, "source_id", F.date_format("last_run_at", iso), "cap_days", F.date_format("since", iso),
        ),
    )
    parts = F.filter(F.array(capped, truncated), lambda w: w.isNotNull())
    return since.join(seen, "source_id", "left").select(
        "source_id", F.coalesce("dated", F.lit(0)).alias("dated"),
        text.none_if_blank(F.array_join(parts, "; ")).alias("coverage_warning"),
    )


def image_outcomes(log: DataFrame) -> DataFrame:
    """Outcome counts per source with totals (NULL source). ``log`` holds
    source_id, outcome, image_url; a transient failure is no attempt."""
    tried = log.where(~F.col("outcome").startswith("network_error"))
    return tried.rollup("source_id").agg(
        F.count("*").alias("attempted"),
        F.count_if(F.col("outcome") == "ok").alias("gained"),
        F.count_if(F.col("outcome") == "no_og_tag").alias("no_og_tag"),
        F.count_if(F.col("outcome").startswith("blocked_")).alias("blocked"),
        F.count_if(F.col("outcome").startswith("http_")).alias("http_error"),
    )


def image_outcome_counts(log: DataFrame) -> DataFrame:
    """Long form: one row per source and outcome."""
    return (
        log.where(~F.col("outcome").startswith("network_error"))
        .groupBy("source_id", F.when(F.col("outcome") == "ok", F.lit("gained")).otherwise(F.col("outcome")).alias("outcome"))
        .agg(F.count("*").alias("n"))
    )


def budget_used(stories: DataFrame, as_of: datetime, daily_budget: int = 20) -> DataFrame:
    midnight = F.date_trunc("DAY", F.lit(as_of).cast("timestamp"))
    return stories.agg(F.count_if(F.col("analyzed_at") >= midnight).alias("used")).select(
        "used", F.greatest(F.lit(0), F.lit(daily_budget) - F.col("used")).alias("remaining")
    )
