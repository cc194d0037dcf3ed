import random
from datetime import datetime, timedelta

import pytest

from storyweave.operators import catalogue, health
from storyweave.plans import jobs
from storyweave.session import cut_lineage
from storyweave.streaming import state


def test_rounds_equal_claiming_in_batches(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["clean", "clean", "clean", "group"]), rng.choice(["processed", "failed", "rejected"])) for i in rng.sample(range(1000), 137)]
    batch = {"clean": 10, "group": 7, "never": 5}
    table = spark.createDataFrame(rows, "item_id long, stage string, outcome string")
    claimed = health.claim_rounds(table, batch)
    want, summary = {}, {}
    for stage in ("clean", "group"):
        left, rounds = sorted(r[0] for r in rows if r[1] == stage), 0
        while True:
            rounds += 1
            taken, left = left[: batch[stage]], left[batch[stage]:]
            want |= {i: rounds for i in taken}
            if not taken:
                break
        out = [r[2] for r in rows if r[1] == stage]
        summary[stage] = (len(out) - out.count("failed"), out.count("failed"), out.count("rejected"), rounds)
    assert {r.item_id: r["round"] for r in claimed.collect()} == want
    assert {r.stage: tuple(r)[1:] for r in health.run_summary(claimed).collect()} == summary
    assert {r.rounds for r in health.run_summary(table).collect()} == {1}
    assert health.claim_rounds(table.limit(0), batch).count() == 0


def test_stats(spark):
    stages = spark.createDataFrame([("kept",)] * 3 + [("rejected",)] * 4, "stage string")
    off = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "source_id string")
    stories = spark.createDataFrame([(k, f"t{k}", s) for k, s in enumerate([0.5, None, 0.9, 0.5] + [0.1] * 9)], "story_id long, title string, score double")
    got = {}
    for r in jobs.stats(stages, off, stories).orderBy("part", "place").collect():
        got.setdefault(r.part, []).append((r.name, r.value))
    assert got["stage"] == [("rejected", 4.0), ("kept", 3.0)] and got["rejected"] == [("", 4.0)] and got["stories"] == [("", 13.0)]
    assert got["rejected_by_source"] == [("c", 2.0), ("a", 1.0), ("b", 1.0)]
    assert got["top_stories"] == [("t2", 0.9), ("t0", 0.5), ("t3", 0.5)] + [(f"t{k}", 0.1) for k in range(4, 11)]


def test_provider_day_equals_loop(spark):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(i, rng.choice("ab"), start + timedelta(seconds=rng.randrange(2 * 86400)), rng.choice([200, 429, 429, 429, 402, 503, 404] if i % 3 else [200, 429])) for i in range(900)]
    want = {}
    for i, p, ts, status in sorted(rows, key=lambda r: (r[2], r[0])):
        d = want.setdefault((p, ts.date()), dict(n=0, ok=0, bad=0, run=0, off=False))
        d["n"] += 1
        d["ok" if status < 400 else "bad"] += 1
        if status == 402:
            d["off"] = True
        elif status == 429:
            d["run"] += 1
            d["off"] |= d["run"] >= 3
        else:
            d["run"] = 0
    got = health.provider_daily_status(spark.createDataFrame(rows, "attempt_id long, provider string, ts timestamp, status int"))
    assert {(r.provider, r.day): dict(n=r.requests, ok=r.successes, bad=r.failures, run=r.consecutive_429, off=r.disabled) for r in got.collect()} == want


def test_provider_streak_without_a_third(spark):
    rows = [(i, "p", datetime(2024, 1, 1, 0, i), s) for i, s in enumerate([429, 429, 200, 429, 402, 429])]
    got = health.provider_daily_status(spark.createDataFrame(rows, "attempt_id long, provider string, ts timestamp, status int")).first()
    assert (got.consecutive_429, got.disabled) == (2, True)
    calm = health.provider_daily_status(spark.createDataFrame(rows[:4], "attempt_id long, provider string, ts timestamp, status int")).first()
    assert (calm.consecutive_429, calm.disabled) == (1, False)


def make_log(seed, n=200):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ok = rng.random() < 0.5
        out.append((i, rng.choice(["a", "b", "c"]), datetime(2024, 1, 1) + timedelta(minutes=i), ok, None if ok else f"e{i}"))
    return out + [(n, "never", datetime(2024, 1, 2), False, "x"), (n + 1, "never", datetime(2024, 1, 3), False, "y")]


LOG = "run_id long, source_id string, run_ts timestamp, ok boolean, error string"


def sequential_health(log):
    out = {}
    for _, s, ts, ok, error in log:
        f, last, _ = out.get(s, (0, None, None))
        out[s] = (0, ts, None) if ok else (f + 1, last, error)
    return out


def test_failure_streaks(spark):
    log = make_log(1)
    got = health.failure_streaks(spark.createDataFrame(log, LOG)).collect()
    assert {r.source_id: (r.consecutive_failures, r.last_run_at, r.last_error) for r in got} == sequential_health(log)


def in_batches(spark, rows, schema, merge, kept, part, size):
    current = spark.createDataFrame([], kept)
    for start in range(0, len(rows), size):
        seen = spark.createDataFrame(rows[:start + size], schema).withColumn("log_part", part)
        own = spark.createDataFrame(rows[start:start + size], schema).withColumn("log_part", part)
        current = cut_lineage(merge(current, own, seen.join(own, seen.columns[0], "left_anti")))
    return current


@pytest.mark.parametrize("shuffled", [False, True])
def test_failure_streaks_in_batches(spark, shuffled):
    log = make_log(2)
    landed = random.Random(1).sample(log, len(log)) if shuffled else log
    current = in_batches(spark, landed, LOG, state.merge_source_state, state.SOURCE_STATE, state.by_key("source_id"), 60)
    assert {r.source_id: (r.consecutive_failures, r.last_run_at, r.last_error) for r in current.collect()} == sequential_health(log)


def sequential_providers(attempts):
    out = {}
    for _, provider, ts, status in sorted(attempts, key=lambda a: (a[2], a[0])):
        day = out.setdefault((provider, ts.date()), [0, 0, 0, 0, False])
        day[0] += 1
        day[1 if status < 400 else 2] += 1
        if status != 402:
            day[3] = day[3] + 1 if status == 429 else 0
        day[4] = day[4] or status == 402 or day[3] >= 3
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("shuffled", [False, True])
def test_provider_state_in_batches(spark, shuffled):
    rng = random.Random(9)
    attempts = [(i, rng.choice("pq"), datetime(2024, 1, 1, 23, 50) + timedelta(seconds=7 * (i // 2)),
                 rng.choices([429, 200, 503, 402], [8, 3, 1, 0.2])[0]) for i in range(240)]
    schema = "attempt_id long, provider string, ts timestamp, status int"

    def days(rows):
        return {(r.provider, r.day): (r.requests, r.successes, r.failures, r.consecutive_429, r.disabled) for r in rows.collect()}

    want = sequential_providers(attempts)
    assert days(health.provider_daily_status(spark.createDataFrame(attempts, schema))) == want
    landed = rng.sample(attempts, len(attempts)) if shuffled else attempts
    current = in_batches(spark, landed, schema, state.merge_provider_state, state.PROVIDER_STATE, state.by_day("ts"), 70)
    assert days(state.provider_status(current)) == want


def test_coverage_warning(spark):
    entries = spark.createDataFrame(
        [("all", datetime(2024, 1, 5)), ("all", None), ("mixed", datetime(2024, 1, 5)), ("mixed", datetime(2024, 1, 1)), ("undated", None)],
        "source_id string, published_at timestamp")
    t = datetime(2024, 1, 2)
    since = spark.createDataFrame(
        [(s, t, False, t, 2) for s in ("all", "mixed", "undated", "silent")] + [("first", t, True, None, 2), ("gap", t, True, datetime(2023, 1, 1), 3)],
        "source_id string, since timestamp, capped boolean, last_run_at timestamp, cap_days int")
    got = {r.source_id: r.coverage_warning for r in health.coverage_warning(entries, since).collect()}
    assert "all 1 dated entries" in got["all"] and got["mixed"] is got["undated"] is got["silent"] is None
    assert "first run, backfill bounded to 2d" in got["first"] and "max_backfill_days=3" in got["gap"]


ROW = "source_id string, plugin string, cadence_minutes int, authority double, territory string, enabled boolean, max_backfill_days int"


def test_sync(spark):
    base = ("rss", 30, 0.5, "policy")
    current = spark.createDataFrame(
        [(n, *base, on, None, "err", 2, "warn") for n, on in [("same", True), ("tuned", True), ("moved", True), ("woken", False), ("gone", True), ("empty", True), ("inert", False)]],
        ROW + ", last_error string, consecutive_failures int, coverage_warning string")
    wanted = spark.createDataFrame(
        [("same", *base, True, None), ("tuned", "rss", 60, 0.5, "policy", True, None), ("moved", "arxiv", 30, 0.5, "policy", True, None),
         ("woken", *base, True, None), ("new", *base, True, 5)], ROW)
    counts = spark.createDataFrame([("gone", 3), ("inert", 3)], "source_id string, items long")
    diff = {r.source_id: (r.action, r.clears_health) for r in catalogue.catalogue_diff(current, wanted, counts).collect()}
    assert diff == {"same": ("unchanged", False), "tuned": ("updated", False), "moved": ("updated", True), "woken": ("updated", True),
                    "gone": ("disabled", True), "empty": ("deleted", True), "inert": ("untouched", False), "new": ("added", False)}
    after = {r.source_id: r for r in catalogue.catalogue_sync(current, wanted, counts).collect()}
    assert "empty" not in after and not after["gone"].enabled and after["gone"].last_error is None
    assert after["tuned"].cadence_minutes == 60 and after["tuned"].last_error == "err"
    assert after["moved"].plugin == "arxiv" and after["moved"].consecutive_failures == 0
    assert after["inert"].last_error == "err" and after["new"].consecutive_failures == 0 and after["new"].max_backfill_days == 5


def test_catalogue_rules(spark):
    rows = [("a", "rss", 30, 0.5, "policy", True, None), ("a", "rss", 30, 0.5, "policy", True, None), ("b", "rss", 0, 1.5, "mars", True, 0), ("c", "rss", 1, 1.0, "research", True, 1)]
    got = sorted((r.source_id, r.violation) for r in catalogue.catalogue_violations(spark.createDataFrame(rows, ROW)).collect())
    assert got == [("a", "duplicate source id"), ("b", "authority outside [0, 1]"), ("b", "cadence_minutes must be positive"),
                   ("b", "max_backfill_days must be positive"), ("b", "unknown territory")]
