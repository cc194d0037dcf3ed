"""Grouping against a plain sequential loop."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from storyweave.operators import stories as story_ops
from storyweave.plans import jobs

SCHEMA = ("item_id long, source_id string, title string, text string, published_at timestamp, model_id string, "
          "embedding array<float>, outbound_links array<string>")
NOW = datetime(2024, 1, 10)
WORDS = ["Acme", "Borealis", "Cygnus", "Dorado", "Eridani", "Fornax"]


def make_items(n, seed, dims=6, hot=0.0):
    rng = random.Random(seed)
    gen = np.random.default_rng(seed)
    centres = gen.normal(size=(max(2, n // 6), dims))
    rows = []
    for i in range(1, n + 1):
        c = 0 if rng.random() < hot else rng.randrange(len(centres))
        vec = (centres[c] + 0.25 * gen.normal(size=dims)).astype(np.float32)
        when = None if rng.random() < 0.15 else NOW - timedelta(hours=rng.uniform(0, 90 if hot == 0 else 10))
        names = rng.sample(WORDS, rng.randrange(0, 4))
        links = [f"https://ref.org/{rng.randrange(4)}?x={i}"] if rng.random() < 0.4 else []
        rows.append((i, f"s{rng.randrange(4)}", " ".join(names) or "nothing", " and ".join(names), when,
                     rng.choice(["m1", "m1", "m2"]), [float(x) for x in vec], links))
    return rows


def cos(a, b):
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    d = (a @ a) * (b @ b)
    return 0.0 if d == 0 else float(np.clip(a @ b / np.sqrt(d), -1, 1))


def overlap(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def sequential(rows, known=(), replay=False, threshold=0.5, window=48.0):
    """One item after the other, against everything that has a story."""
    placed = [(r, s) for r, s in known]
    stories = {}
    for r in sorted(rows):
        best, target = float("-inf"), None
        for o, story in placed:
            if o[5] != r[5]:
                continue
            if not replay and o[4] is not None and o[4] < NOW - timedelta(hours=window):
                continue
            near = 1.0
            if r[4] and o[4]:
                gap = abs((r[4] - o[4]).total_seconds()) / 3600
                if gap > window:
                    continue
                near = max(0.0, 1 - gap / window)
            ents = overlap({w.lower() for w in r[2].split() + r[3].split() if w in WORDS},
                           {w.lower() for w in o[2].split() + o[3].split() if w in WORDS})
            links = overlap({u.split("?")[0] for u in r[7]}, {u.split("?")[0] for u in o[7]})
            score = round(min(1.0, 0.6 * cos(r[6], o[6]) + 0.4 * ents + 0.1 * links) * near, 9)
            if score > best or (score == best and o[0] < target[0]):
                best, target = score, (o[0], story)
        story = target[1] if target and best >= threshold + 0.03 else r[0]
        stories[r[0]] = story
        placed.append((r, story))
    return stories


def spark_stories(spark, rows, known=None, **settings):
    new = spark.createDataFrame(rows, SCHEMA)
    old = None if known is None else spark.createDataFrame([(*r, s) for r, s in known], SCHEMA + ", story_id long")
    done = jobs.cluster(new, NOW, old, **settings)
    return {r.item_id: r.story_id for r in done.members.collect()}, done


@pytest.mark.parametrize("seed,replay,tile", [(1, False, 1024), (2, True, 7), (3, True, 1024), (4, False, 5)])
def test_equals_sequential_loop(spark, seed, replay, tile):
    rows = make_items(90, seed)
    got, _ = spark_stories(spark, rows, replay=replay, tile_rows=tile)
    assert got == sequential(rows, replay=replay)


def test_one_hot_window_is_split_into_tiles(spark):
    rows = make_items(120, 11, hot=0.5)
    got, _ = spark_stories(spark, rows, replay=True, tile_rows=8)
    assert got == sequential(rows, replay=True)


def test_incremental_equals_one_run(spark):
    rows = make_items(80, 5)
    whole = sequential(rows)
    first, second = rows[:50], rows[50:]
    before, _ = spark_stories(spark, first)
    known = [(r, before[r[0]]) for r in first]
    after, done = spark_stories(spark, second, known)
    assert {**before, **after} == whole
    # only stories that gained an item come back, with all their members
    gained = {whole[r[0]] for r in second}
    assert {r.story_id: r.item_count for r in done.stories.collect()} == {
        s: sum(1 for v in whole.values() if v == s) for s in gained}


def test_incremental_scores_look_back_at_all_stories(spark):
    def item(i, vec, day):
        return (i, "s", "Acme", "", datetime(2024, 1, day), "m", vec, [])

    old = [item(1, [1.0, 0.0], 1)]
    _, first = spark_stories(spark, old)
    sources = spark.createDataFrame([("s", 0.5)], "source_id string, authority double")
    before = first.stories
    _, second = spark_stories(spark, [item(2, [1.0, 0.2], 9)], [(old[0], 1)])
    got = jobs.score(second, sources, before).collect()
    assert [r.story_id for r in got] == [2] and got[0].score_breakdown.novelty < 0.05
    merged = jobs.merge_stories(before.selectExpr("*", "'x' AS summary"), second.stories)
    assert {r.story_id: r.summary for r in merged.collect()} == {1: "x", 2: None}


def test_bad_vectors_fail_with_a_reason(spark):
    rows = make_items(5, 6)
    rows[2] = (*rows[2][:6], [float("nan")] * 6, rows[2][7])
    got, done = spark_stories(spark, rows)
    assert 3 not in got and len(got) == 4
    failed = done.failed.collect()
    assert [r.item_id for r in failed] == [3] and "non-finite" in failed[0].error


def test_rollup_of_undated_members(spark):
    v = [1.0, 0.0]
    rows = [(1, "a", "Acme", "", None, "m", v, []), (2, "b", "Acme", "", datetime(2024, 1, 9), "m", v, []),
            (3, "b", "Acme", "", datetime(2024, 1, 9, 1), "m", v, [])]
    _, done = spark_stories(spark, rows)
    story = done.stories.collect()
    assert len(story) == 1
    s = story[0]
    assert (s.story_id, s.item_count, s.outlet_count, s.updated_at, s.first_seen) == (1, 3, 2, NOW, NOW)
    assert s.centroid == [1.0, 0.0] and s.has_dated_item


def test_order_and_partitioning_do_not_matter(spark):
    rows = make_items(60, 9)
    got, _ = spark_stories(spark, rows, replay=True)
    shuffled = rows[:]
    random.Random(0).shuffle(shuffled)
    again = jobs.cluster(spark.createDataFrame(shuffled, SCHEMA).repartition(7), NOW, replay=True, tile_rows=11)
    assert {r.item_id: r.story_id for r in again.members.collect()} == got


def test_roots_of_chain_and_hub(spark):
    chain = [(i, max(0, i - 1)) for i in range(200)]
    hub = [(1000 + i, 1000) for i in range(300)]
    got = story_ops.resolve_roots(spark.createDataFrame(chain + hub, "item_id long, parent_id long"))
    roots = {r.item_id: r.root for r in got.collect()}
    assert len(roots) == 500
    assert all(roots[i] == 0 for i in range(200)) and all(roots[1000 + i] == 1000 for i in range(300))


def test_cycle_is_reported(spark):
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "item_id long, parent_id long")
    with pytest.raises(RuntimeError):
        story_ops.resolve_roots(loop, max_rounds=3)


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [
        (300, 300 + i) for i in range(1, 60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = story_ops.connected_components(spark.createDataFrame(edges, "i long, j long"))
    assert {r.node: r.component for r in got.collect()} == {n: find(n) for n in list(parent)}
