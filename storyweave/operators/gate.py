"""Off-topic gate and its retroactive sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweave.functions import text, vectors
from storyweave.session import cut_lineage


def judge_relevance(
    items: DataFrame, centroid: DataFrame, *, cosine_threshold: float = 0.12,
    cosine_thresholds: dict[str, float] | None = None, phrases: list[str] | None = None,
) -> DataFrame:
    """Add topic_cosine, keyword_hits and topic_threshold. ``centroid`` is the
    one-row topic vector."""
    return (
        items.withColumn("_topic", centroid.select("centroid").scalar())
        .withColumn("topic_cosine", vectors.cosine_to_unit(F.col("embedding"), F.col("_topic")))
        .withColumn("keyword_hits", text.keyword_hits(text.embed_text(F.col("title"), F.col("text")), phrases))
        .withColumn("topic_threshold", vectors.threshold_for(F.col("model_id"), cosine_thresholds or {}, cosine_threshold))
        .drop("_topic")
    )


def is_on_topic(min_hits: int = 1) -> Column:
    return (F.col("topic_cosine") >= F.col("topic_threshold")) | (F.col("keyword_hits") >= min_hits)


def reject_reason() -> Column:
    return F.format_string(
        "off-topic: cosine=%.3f (threshold %.3f), keyword_hits=%d",
        F.col("topic_cosine"), F.col("topic_threshold"), F.col("keyword_hits"),
    )


def gate_verdicts(
    items: DataFrame, centroid: DataFrame | None, *, enabled: bool = True, min_hits: int = 1, **settings
) -> DataFrame:
    """items + reject_reason, NULL for those kept; every text is read once.
    Both signals must fail for a reject; a disabled gate or a missing topic
    vector keeps everything."""
    if not enabled or centroid is None:
        return items.withColumn("reject_reason", F.lit(None).cast("string"))
    return (
        judge_relevance(items, centroid, **settings)
        .withColumn("reject_reason", F.when(~is_on_topic(min_hits), reject_reason()))
        .drop("topic_cosine", "keyword_hits", "topic_threshold")
    )


def relevance_gate(items: DataFrame, centroid: DataFrame | None, **settings) -> tuple[DataFrame, DataFrame]:
    """The verdicts as two tables, (kept, rejected)."""
    verdicts = gate_verdicts(items, centroid, **settings)
    kept = verdicts.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return kept, verdicts.where(F.col("reject_reason").isNotNull())


def sweep_findings(
    members: DataFrame, stories: DataFrame, centroid: DataFrame, *, source_ids: list[str] | None = None,
    min_hits: int = 1, **settings,
) -> DataFrame:
    """Off-topic items that already sit in a story, with their story."""
    scope = members.where(F.col("story_id").isNotNull() & F.col("embedding").isNotNull())
    if source_ids:
        scope = scope.where(F.col("source_id").isin(source_ids))
    # judged once into a slim table; a filter pushed below would judge again
    judged = cut_lineage(
        judge_relevance(scope, centroid, **settings)
        .select("item_id", "title", "source_id", "story_id", F.when(~is_on_topic(min_hits), reject_reason()).alias("reason"))
    )
    named = stories.select(
        "story_id", F.col("title").alias("story_title"), F.col("category").alias("story_category"),
        F.col("score").alias("story_score"),
    )
    return (
        judged.where(F.col("reason").isNotNull()).join(named, "story_id", "left")
    )


def sweep_apply(members: DataFrame, stories: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stories that remain, story ids deleted). Touched stories are counted
    again from what is left; undated members never move updated_at here."""
    rest = members.join(findings.select("item_id"), "item_id", "left_anti")
    touched = findings.select("story_id").distinct()
    left = rest.join(touched, "story_id", "left_semi")
    counts = left.groupBy("story_id").agg(
        F.count("*").alias("_items"), F.max("published_at").alias("_updated"),
    )
    outlets = left.select("story_id", "source_id").distinct().groupBy("story_id").agg(F.count("*").alias("_outlets"))
    centroids = vectors.mean_vectors(left, "story_id", "embedding", "_centroid")
    fresh = counts.join(outlets, "story_id").join(centroids, "story_id", "left")
    deleted = touched.join(left, "story_id", "left_anti")
    remaining = (
        stories.join(deleted, "story_id", "left_anti").join(fresh, "story_id", "left")
        .withColumn("item_count", F.coalesce("_items", "item_count"))
        .withColumn("outlet_count", F.coalesce("_outlets", "outlet_count"))
        .withColumn("updated_at", F.coalesce("_updated", "updated_at"))
        .withColumn("centroid", F.coalesce("_centroid", "centroid"))
        .drop("_items", "_updated", "_outlets", "_centroid")
    )
    return remaining, deleted
