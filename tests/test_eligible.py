"""Readers of one selection are served together."""

from pyspark.sql import functions as F
from test_plain import refuse, tables
from test_round3 import against_sql

from storyweave.operators import reader, scoring


def test_source_filter_needs_no_peaks_and_no_row_per_reader_and_card(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scoring, "prior_peaks", refuse)
    monkeypatch.setattr(reader, "reader_feed_rows", refuse)
    against_sql(spark, tables(spark, tmp_path), "source_filter")


def test_eligible_rows_are_those_of_the_feed(spark):
    picks = [None, [], ["a"], ["b", "a"], ["a", "b", "a"], ["z"], [None], [None, "c"]]
    requests = spark.createDataFrame([(k, f"b{k % 3}", picks[k % 8]) for k in range(50)], "reader_id long, bundle_id string, selected array<string>")
    cards = spark.createDataFrame(
        [(f"b{k % 2}", k, [["a"], ["b", "c"], [], None, ["c", None]][k % 5]) for k in range(60)], "bundle_id string, story_id long, source_ids array<string>")
    want = sorted(tuple(r) for r in reader.reader_feed_rows(requests, cards).select("reader_id", "bundle_id", "story_id").collect())
    for sizes in ((7, 3), (1024, 512)):
        assert sorted(tuple(r) for r in reader.eligible_rows(requests, cards, *sizes).collect()) == want
    assert reader.eligible_rows(requests, cards.where(F.lit(False))).count() == 0


def test_rows_are_made_in_many_tasks(spark):
    requests = spark.range(400).select(F.col("id").alias("reader_id"), F.lit("b").alias("bundle_id"), F.array().cast("array<string>").alias("selected")).coalesce(1)
    cards = spark.range(100).select(F.lit("b").alias("bundle_id"), F.col("id").alias("story_id"), F.array(F.lit("s")).alias("source_ids")).coalesce(1)
    made = reader.eligible_rows(requests, cards, 10, 20).groupBy(F.spark_partition_id()).count().collect()
    assert len(made) > 1 and sum(r["count"] for r in made) == 40_000


def test_visible_rows_need_no_score(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scoring, "prior_peaks", refuse)
    against_sql(spark, tables(spark, tmp_path), "visibility_filter")


def test_blocks_are_filtered_before_readers_are_told_apart(spark):
    """Whatever order: a selection filters a block once, and a feed row is counted by nobody."""
    made = [("b", k, k * 7 % 5, k % 3, ["a"] if k % 2 else ["b", "c"], k + 1) for k in range(30)]
    cards = spark.createDataFrame(made, "bundle_id string, story_id long, updated_at long, outlet_count long, source_ids array<string>, feed_pos long")
    picks = [None, [], ["a"], ["b"], ["z"], [None, "c", "a"]]
    requests = spark.createDataFrame([(r, "b", picks[r % 6]) for r in range(24)], "reader_id long, bundle_id string, selected array<string>")
    hidden = [[(r, k) for r in range(24) for k in range(0, 30, 3 + r % 4 + side)] for side in (0, 1)]
    read, dismissed = (spark.createDataFrame(x, "reader_id long, story_id long") for x in hidden)
    orders = {"importance": lambda c: c[5], "recency": lambda c: (-c[2], c[5]), "outlets": lambda c: (-c[3], -c[2], c[5]), "unread": lambda c: (-c[2], c[5])}
    for mode, order in orders.items():
        want = set()
        for r in range(24):
            pick = {x for x in picks[r % 6] or [] if x}
            mine = sorted((c for c in made if (not picks[r % 6] or pick & set(c[4])) and (r, c[1]) not in hidden[1]), key=order)
            main, last = ([c[1] for c in mine if ((r, c[1]) in hidden[0]) == late] for late in (False, True))
            want |= {(r, k, at) for at, k in enumerate(main + (last if mode == "unread" else []), 1)}
        for sizes in ((4, 3), (4096, 512)):
            rows = reader.ordered_feed(requests, cards, read, dismissed, mode, *sizes)
            assert {(x.reader_id, x.story_id, x.position) for x in rows.collect()} == want
        plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
        readers = next(k for k, line in enumerate(plan) if "Generate explode(readers" in line)
        assert not any("filter(cards" in line for line in plan[:readers]) and any("filter(cards" in line for line in plan[readers:])
