"""Grouping items into stories."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweave.functions import vectors
from storyweave.session import cut_lineage


def resolve_roots(parents: DataFrame, node: str = "item_id", parent: str = "parent_id", max_rounds: int = 64) -> DataFrame:
    """(node, root) of a parent-pointer forest by pointer doubling: log2(depth)
    rounds. Rows that already point at a root leave the loop, so a root that
    owns most of the rows is joined once and never again."""
    is_root = F.col(node) == F.col(parent)
    links = parents.select(node, parent)
    roots = links.where(is_root)
    settled = roots.select(node, F.col(node).alias("root"))
    moving = links.where(~is_root)
    # every pointer still moving, by node; the join target shrinks each round
    for _ in range(max_rounds):
        known = settled.select(F.col(node).alias("_at"), "root")
        onward = moving.select(F.col(node).alias("_from"), F.col(parent).alias("_next"))
        step = cut_lineage(
            moving.join(known, F.col(parent) == F.col("_at"), "left")
            .join(onward, F.col(parent) == F.col("_from"), "left")
            .select(node, "root", F.coalesce("_next", parent).alias(parent))
        )
        settled = settled.unionByName(step.where(F.col("root").isNotNull()).select(node, "root"))
        moving = step.where(F.col("root").isNull()).select(node, parent)
        if moving.isEmpty():
            return settled
    raise RuntimeError(f"pointers unresolved after {max_rounds} rounds: the parents contain a cycle")


def _signature(edges: DataFrame) -> tuple:
    """Count and two hash sums of a set of rows: equal sets agree, and sets
    that differ practically never do."""
    first = F.xxhash64(*edges.columns)
    second = F.xxhash64(first, F.lit(1))
    row = edges.agg(
        F.count("*"), F.sum(first.cast("decimal(38,0)")), F.sum(second.cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def connected_components(
    edges: DataFrame, src: str = "i", dst: str = "j", key: str | None = None
) -> DataFrame:
    """(key?, node, component) with the least node id as component, by
    alternating large-star and small-star rounds. Only minima are aggregated,
    so a hub's neighbours are never collected."""
    keys = [key] if key else []
    current = cut_lineage(
        edges.where(F.col(src) != F.col(dst))
        .select(*keys, F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct()
    )
    nodes = edges.select(*keys, F.explode(F.array(src, dst)).alias("node")).distinct()
    before = _signature(current)
    while True:
        both = current.unionByName(current.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where(F.col("v") > F.col("u")).join(least, [*keys, "u"])
            .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        )
        stars = large.where(F.col("u") != F.col("v")).distinct()
        lowest = stars.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = stars.join(lowest, [*keys, "u"])
        step = cut_lineage(
            small.select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select(*keys, "u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        current, after = step, _signature(step)
        if after == before:
            break
        before = after
    return nodes.join(current.select(*keys, F.col("u").alias("node"), F.col("v").alias("_c")), [*keys, "node"], "left").select(
        *keys, "node", F.coalesce("_c", "node").alias("component")
    )


def assign_stories(items: DataFrame, matches: DataFrame) -> DataFrame:
    """(item_id, story_id): a new item joins the story of its best match when
    the verdict is SAME, else it seeds a story named after itself. ``items``
    holds item_id and story_id (NULL for new rows)."""
    same = matches.where(F.col("verdict") == "same").select("item_id", "match_id")
    known = items.where(F.col("story_id").isNotNull()).select("item_id", "story_id")
    pointers = (
        items.where(F.col("story_id").isNull()).select("item_id")
        .join(same, "item_id", "left")
        .select("item_id", F.coalesce("match_id", "item_id").alias("parent_id"))
        .unionByName(known.select("item_id", F.col("item_id").alias("parent_id")))
    )
    roots = resolve_roots(pointers)
    return (
        roots.join(known.select(F.col("item_id").alias("root"), "story_id"), "root", "left")
        .select("item_id", F.coalesce("story_id", "root").alias("story_id"))
    )


def distinct_per_key(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Exact distinct count per key in two partial aggregations, so that one
    key with most of the rows is first thinned to its distinct values."""
    return df.select(key, value).distinct().groupBy(key).agg(F.count(value).alias(out))


def last_updates(members: DataFrame, as_of: datetime) -> DataFrame:
    """(story_id, updated_at) as in ``story_rollup``, without the rest of it."""
    now = F.lit(as_of).cast("timestamp")
    return members.groupBy("story_id").agg(F.max(F.coalesce("published_at", now)).alias("updated_at"))


def story_rollup(members: DataFrame, as_of: datetime) -> DataFrame:
    """One row per story. ``members`` holds story_id, item_id, source_id,
    title, published_at and embedding. The seed, the lowest id, gives title
    and first_seen; undated members count as ``as_of``."""
    now = F.lit(as_of).cast("timestamp")
    when: Column = F.coalesce("published_at", now)
    facts = members.groupBy("story_id").agg(
        F.min_by(F.struct("title", when.alias("first_seen")), F.col("item_id")).alias("seed"),
        F.max(when).alias("updated_at"),
        F.count("*").alias("item_count"),
        F.bool_or(F.col("published_at").isNotNull()).alias("has_dated_item"),
    )
    outlets = distinct_per_key(members, "story_id", "source_id", "outlet_count")
    centroids = vectors.mean_vectors(members, "story_id", "embedding")
    return (
        facts.join(outlets, "story_id")
        .join(centroids, "story_id", "left")
        .select(
            "story_id", F.col("seed.title").alias("title"), F.col("seed.first_seen").alias("first_seen"),
            "updated_at", "item_count", "outlet_count", "has_dated_item", "centroid",
        )
    )
