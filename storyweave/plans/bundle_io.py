"""Writing and reading the published bundle.

A run writes its tables under ``<out>/run=<id>`` and the manifest last; a
reader takes the newest run that has one, so a run that dies half-way is
never seen. Payload rows are content-addressed.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweave import schemas
from storyweave.operators import publish
from storyweave.session import cut_lineage


def publish_bundle(
    stories: DataFrame, members: DataFrame, sources: DataFrame, out: str, run_id: str, as_of: datetime, **settings
) -> publish.Bundle:
    """Build, check and write one bundle. A contract fault raises before
    anything is written."""
    bundle = publish.build_bundle(stories, members, sources, as_of, materialise=cut_lineage, **settings)
    base = f"{out}/run={run_id}"
    # without its manifest an earlier run of the same id is not read while it is replaced
    _delete(stories.sparkSession, f"{base}/manifest")
    bundle.details.select("id", "part", "part_count", "path", "hash", "payload").write.mode("overwrite").parquet(f"{base}/story")
    bundle.page_files.select("page", "path", "hash", "count", "payload").write.mode("overwrite").parquet(f"{base}/pages")
    bundle.embeddings.write.mode("overwrite").parquet(f"{base}/embeddings")
    bundle.sources.write.mode("overwrite").parquet(f"{base}/sources")
    bundle.manifest.write.mode("overwrite").parquet(f"{base}/manifest")
    return bundle


def _children(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _finished(spark: SparkSession, out: str) -> list[tuple[str, str]]:
    """(generated_at, run id) of the runs with a finished manifest, oldest first."""
    runs = [name[4:] for name in _children(spark, out) if name.startswith("run=")]
    done = [r for r in runs if "_SUCCESS" in _children(spark, f"{out}/run={r}/manifest")]
    return sorted((spark.read.parquet(f"{out}/run={r}/manifest").first()["generated_at"], r) for r in done)


def complete_runs(spark: SparkSession, out: str) -> list[str]:
    """Run ids with a finished manifest, oldest first by the time in it."""
    return [run for _, run in _finished(spark, out)]


def prune_runs(spark: SparkSession, out: str, keep: int = 1) -> list[str]:
    """Remove complete runs except the newest ``keep``; returns what went, oldest
    first. A run without a manifest may still be being written and stays."""
    done = complete_runs(spark, out)
    gone = done[: len(done) - keep] if keep else done
    for run in gone:
        _delete(spark, f"{out}/run={run}")
    return gone


def read_bundle(spark: SparkSession, out: str, run_id: str | None = None) -> dict[str, DataFrame]:
    """manifest, feed (flattened cards in feed order), story payloads and the
    details in them, pages, embeddings and sources of a run, the newest by default."""
    run = run_id or complete_runs(spark, out)[-1]
    base = f"{out}/run={run}"
    pages = spark.read.parquet(f"{base}/pages")
    schema = schemas.FEED_PAGE
    cards = (
        pages.select(F.from_json("payload", schema).alias("p"))
        .select("p.page", F.posexplode("p.stories").alias("place", "card"))
        .select("page", "place", "card.*")
    )
    return {
        "manifest": spark.read.parquet(f"{base}/manifest"),
        "feed": cards,
        "pages": pages,
        "stories": (stories := spark.read.parquet(f"{base}/story")),
        "details": stories.select("part", "part_count", F.from_json("payload", schemas.STORY_DETAIL).alias("d")).select("part", "part_count", "d.*"),
        "embeddings": spark.read.parquet(f"{base}/embeddings"),
        "sources": spark.read.parquet(f"{base}/sources"),
    }


def feed_vectors(bundle: dict[str, DataFrame]) -> DataFrame:
    """The feed's cards with the position and vector of those that have one."""
    return bundle["feed"].join(bundle["embeddings"], "id", "left")


def damaged_parts(bundle: dict[str, DataFrame]) -> DataFrame:
    """part, expected, found: what the manifest's hashes and counts don't fit."""
    head = bundle["manifest"]

    def compare(part: str, expected: str, found: DataFrame) -> DataFrame:
        return head.select(F.lit(part).alias("part"), F.col(expected).cast("string").alias("expected"), found.scalar().cast("string").alias("found"))

    out = compare("pages", "pages_hash", publish.pages_digest(bundle["pages"]))
    out = out.unionByName(compare("embeddings", "embeddings_hash", publish.embeddings_digest(bundle["embeddings"])))
    out = out.unionByName(compare("feed", "story_count", bundle["feed"].agg(F.count("*"))))
    return out.where(~F.col("expected").eqNullSafe(F.col("found")))
