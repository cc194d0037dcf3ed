import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from storyweave.operators import enrich, rank

NOW = datetime(2024, 1, 10)
STORY = ("story_id long, title string, score double, outlet_count long, updated_at timestamp, status string, summary string, "
         "category string, summary_provider string, analysis string, analysis_provider string, analyzed_at timestamp, "
         "importance_rank int, importance_band string, importance_reason string, ranked_by string, ranked_at timestamp")


def story(spark, *rows):
    names = [f.split()[0] for f in STORY.split(", ")]
    base = dict(title="t", score=0.5, outlet_count=1, updated_at=NOW, status="new")
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], STORY)


def run(spark, texts, allowed, top_n=50):
    answers = spark.createDataFrame([(f"r{i}", t, "p", "m") for i, t in enumerate(texts)], "run_id string, text string, provider string, model string")
    lists = spark.createDataFrame([(f"r{i}", a) for i in range(len(texts)) for a in allowed], "run_id string, story_id long")
    return {r.run_id: r for r in rank.accept_ranking(answers, lists, top_n).collect()}


def listed(row):
    return [(a.story_id, a.importance_rank, a.importance_band, a.importance_reason) for a in row.accepted]


def test_acceptance_by_hand(spark):
    ok = {"id": 1, "rank": 2, "band": "notable", "reason": " because "}
    cases = [
        ([ok, {"id": 2, "rank": 1, "band": "landmark"}], [(2, 1, "landmark", None), (1, 2, "notable", "because")], 0),
        ([ok, ok], [(1, 1, "notable", "because")], 1),  # a repeated id
        ([ok, {**ok, "id": 2}], [(1, 1, "notable", "because")], 1),  # a repeated rank
        ([{**ok, "id": 9}, {**ok, "band": "epic"}, {**ok, "rank": 0}, {**ok, "rank": None}, {**ok, "rank": "x"}, {**ok, "id": "1"}, 7, "noise", ok],
         [(1, 1, "notable", "because")], 8),
        ([{**ok, "rank": " 6 "}, {**ok, "id": 2, "rank": 3.7, "reason": ""}], [(2, 1, "notable", None), (1, 2, "notable", "because")], 0),
        ([{**ok, "id": 2.5}, {**ok, "id": None}], [], 2),
    ]
    got = run(spark, [json.dumps(c[0]) for c in cases], [1, 2, 3])
    for k, (_, accepted, refused) in enumerate(cases):
        assert (listed(got[f"r{k}"]), got[f"r{k}"].rejected) == (accepted, refused)


def test_acceptance_properties(spark):
    rng = random.Random(3)
    pool, answers = [1, 2, 3, 4, 5, 6, 99, "2", None, 2.5], []
    for _ in range(25):
        entries = [
            rng.choice([{"id": rng.choice(pool), "rank": rng.choice([1, 2, 3, 4, "3", 3.7, 0, None, "x"]), "band": rng.choice([*rank.BANDS, "epic"])}] * 4 + ["noise"])
            for _ in range(rng.randrange(2, 12))]
        answers.append(entries)
    whole = run(spark, [json.dumps(e) for e in answers], range(1, 7))
    prefix = run(spark, [json.dumps({"ranked": e[:-1]}) for e in answers], range(1, 7))
    clean = run(spark, [json.dumps([x for x in e if x != "noise"] or ["noise"]) for e in answers], range(1, 7))
    for k, entries in enumerate(answers):
        row = whole[f"r{k}"]
        ids = [a.story_id for a in row.accepted]
        assert len(set(ids)) == len(ids) and set(ids) <= set(range(1, 7))
        assert [a.importance_rank for a in row.accepted] == list(range(1, len(ids) + 1))
        assert len(ids) + row.rejected == len(entries)
        # what comes later takes nothing away, and refused entries change nothing
        assert {a.story_id for a in prefix[f"r{k}"].accepted} <= set(ids)
        assert listed(clean[f"r{k}"]) == listed(row)


def test_odd_answers(spark):
    good = {"id": 1, "rank": 1, "band": "notable", "reason": "x"}
    got = run(spark, ["not json", '{"other": []}', "[]", "```json\n" + json.dumps([good]) + "\n```",
                      "<think>[</think>" + json.dumps({"ranked": [{**good, "reason": 5}, good]})], [1])
    assert got["r0"].error and got["r1"].error and got["r2"].error
    assert len(got["r3"].accepted) == 1 and got["r3"].error is None
    assert got["r4"].rejected == 1 and len(got["r4"].accepted) == 1


def test_refused_entry_keeps_rank_and_id_free(spark):
    entries = [{"id": 1, "rank": 1, "band": "epic"}, {"id": 1, "rank": 1, "band": "notable"}, {"id": 2, "rank": 1, "band": "notable"},
               {"id": 2, "rank": 9, "band": "landmark"}]
    got = run(spark, [json.dumps(entries)], [1, 2])["r0"]
    assert [(a.story_id, a.importance_rank) for a in got.accepted] == [(1, 1), (2, 2)] and got.rejected == 2


def test_apply_rewrites_wholesale_and_failure_changes_nothing(spark):
    base = story(spark, {"story_id": 1, "importance_rank": 1, "importance_band": "notable", "ranked_by": "old:x"}, {"story_id": 2})
    answers = spark.createDataFrame([("r", json.dumps([{"id": 2, "rank": 4, "band": "landmark"}]), "p", "m")], "run_id string, text string, provider string, model string")
    lists = spark.createDataFrame([("r", 1), ("r", 2)], "run_id string, story_id long")
    done = {r.story_id: r for r in rank.apply_ranking(base, rank.accept_ranking(answers, lists), NOW).collect()}
    assert (done[1].importance_rank, done[1].importance_band, done[1].ranked_by) == (None, None, "old:x")
    assert (done[2].importance_rank, done[2].ranked_by, done[2].ranked_at) == (1, "p:m", NOW)
    bad = rank.accept_ranking(answers.withColumn("text", F.lit("no")), lists)
    kept = {r.story_id: r.importance_rank for r in rank.apply_ranking(base, bad, NOW).collect()}
    assert kept == {1: 1, 2: None}


def test_request_text(spark):
    rows = story(spark, {"story_id": 1, "title": " A ", "score": 0.4, "summary": "x" * 301}, {"story_id": 2, "title": "B", "score": 0.9, "outlet_count": 3},
                 {"story_id": 3, "score": None}, {"story_id": 4, "updated_at": datetime(2024, 1, 1)})
    got = rank.rank_request(rank.rank_shortlist(rows, NOW)).first()
    assert got.candidate_block == "- id=2 | outlets=3 | B\n- id=1 | outlets=1 | A\n    " + "x" * 300 + "..."
    assert "Below are 2 candidate stories" in got.prompt and "Choose the 2 most" in got.prompt and got.prompt.endswith("...\n")
    assert rank.rank_request(rank.rank_shortlist(rows.where("story_id > 2"), NOW)).count() == 0


def test_tier1(spark):
    rows = story(spark, {"story_id": 1, "title": "old"}, {"story_id": 2, "title": "old"}, {"story_id": 3, "status": "enriched"}, {"story_id": 4, "score": None})
    assert [r.story_id for r in enrich.tier1_backlog(rows).collect()] == [2, 1]
    answers = spark.createDataFrame([
        (1, '<think>hm</think>```json\n{"headline": " New ", "summary": "s", "category": " "}\n```', "p", "m"), (2, "sorry", "p", "m")],
        "story_id long, text string, provider string, model string")
    done = {r.story_id: r for r in enrich.apply_tier1(rows, answers).collect()}
    assert (done[1].title, done[1].summary, done[1].category, done[1].status, done[1].summary_provider) == ("New", "s", None, "enriched", "p:m")
    assert (done[2].title, done[2].status) == ("old", "new")
    twice = answers.unionByName(answers.withColumn("text", F.lit('{"headline": "Later", "summary": "z"}'))).where("story_id = 1")
    assert [r.story_id for r in enrich.apply_tier1(rows, twice).where("status = 'enriched' and story_id = 1").collect()] == [1]


def test_tier2_budget(spark):
    rows = story(spark, *[{"story_id": i, "status": "enriched", "score": 0.6 + i / 100} for i in range(1, 6)],
                 {"story_id": 9, "status": "analyzed", "analyzed_at": NOW}, {"story_id": 10, "status": "analyzed", "analyzed_at": datetime(2024, 1, 9, 23)})
    assert [r.story_id for r in enrich.tier2_candidates(rows, NOW, daily_budget=3).orderBy(F.desc("score")).collect()] == [5, 4]
    assert enrich.tier2_candidates(rows, NOW, daily_budget=1).count() == 0
    answers = spark.createDataFrame([(5, " deep ", "d", "x", False), (4, "thin", "b", "y", True)], "story_id long, text string, provider string, model string, degraded boolean")
    done = {r.story_id: r for r in enrich.apply_tier2(rows, answers, NOW).collect()}
    assert (done[5].status, done[5].analysis, done[4].status, done[4].analysis_provider) == ("analyzed", "deep", "retry", "b:y")


def test_headlines_keep_the_first(spark):
    members = spark.createDataFrame([(1, i, f"t{i}") for i in range(20, 0, -1)], "story_id long, item_id long, title string")
    assert enrich.story_headlines(members).first().headlines == "\n".join(f"- t{i}" for i in range(1, 9))
