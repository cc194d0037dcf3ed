"""Duplicate handling by URL and by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweave.functions import text, urls
from storyweave.session import cut_lineage


def first_keys_by_url(rows: DataFrame, arrival: str, key: str, url: str = "url") -> DataFrame:
    """(url_hash, ``key``, ``arrival``, duplicates) of the first arrival per
    canonical URL. ``key`` tells rows apart. Nothing else of the rows is read, so
    that their texts need not move before it is known which of them stay."""
    first = F.struct(F.col(arrival).alias("a"), F.col(key).alias("k"))
    return rows.select(urls.url_hash(F.col(url)).alias("url_hash"), first.alias("f")).groupBy("url_hash").agg(
        F.min("f").alias("f"), (F.count("*") - 1).alias("duplicates")
    ).select("url_hash", F.col("f.k").alias(key), F.col("f.a").alias(arrival), "duplicates")


def first_by_url(rows: DataFrame, arrival: str, url: str = "url") -> DataFrame:
    """First arrival per canonical URL, with the number of later spellings.
    An aggregate rather than a window: copies collapse before the shuffle. Rows
    with texts and a key of their own go by ``first_keys_by_url`` instead."""
    keyed = rows.withColumn("url_hash", urls.url_hash(F.col(url)))
    payload = [c for c in keyed.columns if c != "url_hash"]
    return (
        keyed.groupBy("url_hash")
        .agg(F.min_by(F.struct(*payload), F.col(arrival)).alias("r"), (F.count("*") - 1).alias("duplicates"))
        .select("url_hash", "r.*", "duplicates")
    )


def new_items(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming rows whose URL the store has never seen."""
    return incoming.join(known.select("url_hash").distinct(), "url_hash", "left_anti")


def first_by_content(items: DataFrame, body: str = "text", known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, failed): the lowest id per content advances, every other copy
    fails with the id it repeats (item_id, content_hash, error). ``known``
    holds (item_id, content_hash) rows that already advanced.

    Copies are found on ids and hashes alone: the texts themselves are never
    moved to the key of their content, which may be shared by most rows."""
    hashed = items.withColumn("content_hash", text.content_hash(F.col(body)))
    ids = cut_lineage(hashed.select("item_id", "content_hash"))
    firsts = ids.groupBy("content_hash").agg(F.min("item_id").alias("first_id"))
    if known is not None:
        stored = known.groupBy("content_hash").agg(F.min("item_id").alias("stored_id"))
        firsts = firsts.join(stored, "content_hash", "left").select(
            "content_hash", F.coalesce("stored_id", "first_id").alias("first_id")
        )
    # fixed value: the error text
    failed = ids.join(firsts, "content_hash").where(F.col("item_id") != F.col("first_id")).select(
        "item_id", "content_hash",
        F.concat(F.lit("duplicate content of item "), F.col("first_id").cast("string")).alias("error"),
    )
    return hashed.join(failed.select("item_id"), "item_id", "left_anti"), failed
