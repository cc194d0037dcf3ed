import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from storyweave import schemas
from storyweave.operators import publish, scoring
from storyweave.operators.ordering import ordinal, ordinal_within
from storyweave.plans import bundle_io

NOW = datetime(2024, 1, 10)


def tables(spark, n=7, extra_members=0):
    stories = spark.createDataFrame(
        [(i, f"title {i}", NOW - timedelta(hours=i), NOW - timedelta(hours=i), 1, 1, [float(i), 1.0] if i != 2 else None,
          None if i == 5 else 1.0 / i, f"summary {i}") for i in range(1, n + 1)],
        "story_id long, title string, first_seen timestamp, updated_at timestamp, item_count long, outlet_count long, centroid array<float>, score double, summary string")
    rows = [(10 * i, i, "a" if i % 2 else "b", f"t{i}", f"https://x.org/{i}", None if i == 4 else NOW, "m1", f"img{i}" if i % 3 else "", "secret body") for i in range(1, n + 1)]
    rows += [(1000 + k, 1, "b", "more", f"https://x.org/m{k}", NOW, "m2", "better", "secret body") for k in range(extra_members)]
    members = spark.createDataFrame(rows, "item_id long, story_id long, source_id string, title string, url string, published_at timestamp, model_id string, image_url string, text string")
    sources = spark.createDataFrame([("a", "rss", True, 30, None, 0, "e" * 400, None, "policy", 0.4), ("b", "rss", True, 30, NOW, 1, None, None, None, 0.9),
                                     ("off", "rss", False, 30, None, 9, None, None, None, 0.1)],
                                    "source_id string, plugin string, enabled boolean, cadence_minutes int, last_run_at timestamp, consecutive_failures int, last_error string, coverage_warning string, territory string, authority double")
    return stories, members, sources


def test_publishable_rules(spark):
    stories, members, _ = tables(spark)
    got = {r.story_id for r in publish.publishable(stories, members, NOW, 2).collect()}
    assert got == {1, 2, 3, 6, 7}  # 4 is all undated, 5 has no score
    assert publish.publishable(stories, members, NOW + timedelta(days=2), 2).count() == 0


def test_bundle_round_trip(spark, tmp_path):
    stories, members, sources = tables(spark, extra_members=3)
    out = str(tmp_path / "bundle")
    bundle_io.publish_bundle(stories, members, sources, out, "r1", NOW, page_size=2, part_rows=2)
    got = bundle_io.read_bundle(spark, out)
    feed = got["feed"].orderBy("page", "place").collect()
    assert [(r.page, r.place, r.id) for r in feed] == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 6), (2, 0, 7)]
    assert feed[0].source_ids == ["a", "b"] and feed[0].lead_image_url == "better"
    assert feed[0].updated_at == "2024-01-09T23:00:00+00:00"
    details = got["stories"].where("id = 1").orderBy("part").collect()
    assert [len(json.loads(r.payload)["evidence"]) for r in details] == [2, 2]
    assert [e["id"] for r in details for e in json.loads(r.payload)["evidence"]] == [10, 1000, 1001, 1002]
    assert all("secret" not in r.payload for r in got["stories"].collect())
    assert details[0].path == f"story/1-{details[0].hash}.json" == feed[0].detail_path
    vectors = got["embeddings"].orderBy("position").collect()
    assert [(r.position, r.id) for r in vectors] == [(0, 1), (1, 3), (2, 6), (3, 7)]
    m = got["manifest"].first()
    assert (m.story_count, m.page_count, m.embedding_model_id, m.embedding_dimensions, m.embedding_count) == (5, 3, "m1", 2, 4)
    assert [r.id for r in got["sources"].orderBy("id").collect()] == ["a", "b"]
    assert len(got["sources"].where("id = 'a'").first().last_error) == 303

    assert [(r.id, r.part, [e.id for e in r.evidence]) for r in got["details"].where("id = 1").orderBy("part").collect()] == [(1, 0, [10, 1000]), (1, 1, [1001, 1002])]
    joined = {r.id: (r.position, r.vector) for r in bundle_io.feed_vectors(got).collect()}
    assert {i: p for i, (p, _) in joined.items()} == {1: 0, 2: None, 3: 1, 6: 2, 7: 3}
    assert {r.id: r.vector for r in vectors} == {i: v for i, (p, v) in joined.items() if p is not None}
    assert bundle_io.damaged_parts(got).count() == 0
    moved = {**got, "embeddings": got["embeddings"].withColumn("position", 3 - F.col("position"))}
    assert [r.part for r in bundle_io.damaged_parts(moved).collect()] == ["embeddings"]

    again = bundle_io.publish_bundle(stories, members, sources, out, "r2", NOW, page_size=2, part_rows=2)
    assert {r.hash for r in again.details.collect()} == {r.hash for r in got["stories"].collect()}
    assert publish.stale_paths(got["stories"], again.details).count() == 0
    assert bundle_io.prune_runs(spark, out) == ["r1"] and bundle_io.complete_runs(spark, out) == ["r2"]


def test_no_stories_still_gives_one_page(spark, tmp_path):
    stories, members, sources = tables(spark)
    out = str(tmp_path / "empty")
    built = bundle_io.publish_bundle(stories.where("false"), members, sources, out, "r", NOW)
    pages = built.page_files.collect()
    assert len(pages) == 1 and json.loads(pages[0].payload) == {"page": 0, "page_count": 1, "stories": []}
    m = built.manifest.first()
    assert (m.story_count, m.page_count, m.embedding_dimensions) == (0, 1, None)


def test_contract_refuses_before_writing(spark, tmp_path):
    stories, members, sources = tables(spark)
    out = str(tmp_path / "bad")
    with pytest.raises(publish.ContractError):
        bundle_io.publish_bundle(stories.withColumn("title", F.when(F.col("story_id") != 3, F.col("title"))), members, sources, out, "r", NOW)
    with pytest.raises(publish.ContractError):
        bundle_io.publish_bundle(stories, members.withColumn("url", F.when(F.col("story_id") != 3, F.col("url"))), sources, out, "r", NOW)
    with pytest.raises(publish.ContractError, match="embedding: 1 rows"):
        bad = F.when(F.col("story_id") == 3, F.array(F.lit(float("nan")), F.lit(1.0))).otherwise(F.col("centroid"))
        bundle_io.publish_bundle(stories.withColumn("centroid", bad), members, sources, out, "r", NOW)
    assert bundle_io.complete_runs(spark, out) == []
    chosen = publish.publishable(stories, members, NOW)
    documents = publish.story_details(chosen, members, sources).drop("part", "part_count")
    for frame in (documents.withColumn("text", F.lit("x")), documents.drop("evidence"), documents.withColumn("score", F.lit("x"))):
        assert publish.contract_violations(frame, schemas.STORY_DETAIL, "d")
    assert publish.contract_violations(documents, schemas.STORY_DETAIL, "d") == []


def test_ordinal_is_global(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(9)
    got = ordinal(frame, F.col("v").desc()).collect()
    assert sorted((r.ordinal, r.v) for r in got) == [(i + 1, 999 - i) for i in range(1000)]
    grouped = frame.withColumn("g", F.when(F.col("v") < 900, 0).otherwise(F.col("v") % 3 + 1))
    rows = ordinal_within(grouped, "g", F.col("v").asc()).collect()
    for g in range(4):
        mine = sorted((r.v, r.position) for r in rows if r.g == g)
        assert [p for _, p in mine] == list(range(1, len(mine) + 1))


def test_scores(spark):
    stories = spark.createDataFrame(
        [(1, datetime(2024, 1, 1), 1, [1.0, 0.0]), (2, datetime(2024, 1, 2), 20, [-1.0, 0.0]), (3, datetime(2024, 1, 2), 2, [1.0, 0.0]),
         (4, datetime(2024, 6, 1), 0, [1.0, 0.0]), (5, datetime(2024, 1, 3), 1, None)],
        "story_id long, first_seen timestamp, outlet_count long, centroid array<float>")
    got = {r.story_id: r.novelty for r in scoring.novelty(stories).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 0.0, 4: 1.0, 5: 1.0}
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "c"), (2, "c")], "story_id long, source_id string")
    sources = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.8)], "source_id string, authority double")
    assert {r.story_id: round(r.authority, 6) for r in scoring.story_authority(members, sources).collect()} == {1: 0.65, 2: 0.8}
    assert {r.story_id: round(r.authority, 6) for r in scoring.story_authority(members, sources, per_source=True).collect()} == {1: 0.6, 2: 0.8}
    scored = {r.story_id: r for r in scoring.score_stories(scoring.ScoringInput(stories, members, sources)).collect()}
    assert scored[2].score == pytest.approx(min(1.0, (0.25 * 0.8 + 0.4 + 0.2 * 2.0) / 0.85))
    assert scored[5].score == pytest.approx((0.25 * 0.5 + 0.4 * 0.2890648263 + 0.2) / 0.85)
    some = scoring.score_stories(scoring.ScoringInput(stories, members, sources, wanted=stories.where("story_id = 3")))
    assert [(r.story_id, r.score_breakdown.novelty) for r in some.collect()] == [(3, 0.0)]
    assert spark.range(1).select(scoring.combine({"a": F.lit(1.0)}, {"a": 1.0, "b": 3.0}).alias("x")).first().x == 0.25
    assert spark.range(1).select(scoring.combine({}, {}).alias("x")).first().x == 0.0


def test_newest_run_is_the_latest_in_time(spark, tmp_path):
    stories, members, sources = tables(spark)
    out = str(tmp_path / "runs")
    for run, hours in (("9", 0), ("10", 1)):
        bundle_io.publish_bundle(stories, members, sources, out, run, NOW + timedelta(hours=hours))
    assert bundle_io.complete_runs(spark, out) == ["9", "10"]
    assert bundle_io.read_bundle(spark, out)["manifest"].first().generated_at.startswith("2024-01-10T01")
    assert bundle_io.prune_runs(spark, out, keep=1) == ["9"] and bundle_io.complete_runs(spark, out) == ["10"]


def test_lookup_returns_every_part(spark):
    stories, members, sources = tables(spark, extra_members=4)
    files = publish.detail_files(publish.story_details(stories, members, sources, part_rows=2))
    cards = stories.where("story_id < 3").select("story_id")
    wanted = spark.createDataFrame([(1, 1), (1, 3), (2, 99)], "reader_id long, story_id long")
    from storyweave.operators import reader

    rows = reader.story_lookup(cards, files, wanted).collect()
    parts = sorted((r.part, r.part_count, [e["id"] for e in json.loads(r.payload)["evidence"]]) for r in rows if r.found)
    assert parts == [(0, 3, [10, 1000]), (1, 3, [1001, 1002]), (2, 3, [1003])]
    assert sorted((r.reader_id, r.story_id) for r in rows if not r.found) == [(1, 3), (2, 99)]
