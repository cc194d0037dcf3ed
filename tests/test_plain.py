"""Queries that need no score make none."""

import pytest
from conftest import DATA
from test_round3 import against_sql

from storyweave import fixtures as fx
from storyweave.operators import publish, scoring
from storyweave.workload import QUERIES, bundle


def refuse(*_, **__):
    raise AssertionError("not needed")


def tables(spark, folder):
    for name in ("documents", "embeddings", "events"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["story_territories", "dominant_model", "stories_per_source", "stories_per_territory", "publishable"])
def test_stories_are_published_without_peaks(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(scoring, "prior_peaks", refuse)
    against_sql(spark, tables(spark, tmp_path), name)


def test_every_story_has_a_score(spark):
    """What `_published_ids` takes for granted, with no vector, source, date or outlet known."""
    stories = spark.createDataFrame([(1, None, None, None), (2, None, [0.0, 0.0], 3)], "story_id long, first_seen timestamp, centroid array<float>, outlet_count long")
    members = spark.createDataFrame([], "story_id long, source_id string")
    sources = spark.createDataFrame([], "source_id string, authority double")
    assert scoring.score_stories(scoring.ScoringInput(stories, members, sources)).where("score IS NULL").count() == 0
    chosen = publish.publishable(bundle.stories(spark, DATA), fx.members(spark, DATA), fx.AS_OF, bundle.RETENTION)
    assert {r[0] for r in QUERIES["publishable"](spark, DATA).collect()} == {r.story_id for r in chosen.select("story_id").collect()}
