"""Pruned pair work against all pairs, on clustered and on shapeless vectors."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyweave.operators import pairs, pivots

START = datetime(2024, 1, 1)
ITEMS = "item_id long, model_id string, embedding array<double>, published_at timestamp, entities array<string>, link_keys array<string>, is_new boolean"


def crowd(seed, n, spread, clusters=8, dims=12):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, dims))
    which = draw.integers(0, clusters, n)
    return draw, which, centres[which] + spread * draw.normal(size=(n, dims))


def cosine(a, b):
    norm = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / norm) if norm else 0.0


def overlap(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0.0


def items_of(spark, seed, n, spread, vocabulary=30):
    draw, which, vectors = crowd(seed, n, spread)
    vectors[5] = 0.0
    rows = []
    for i in range(n):
        words = [f"e{which[i]}-{k}" if draw.random() < 0.5 else f"r{k}" for k in draw.integers(0, vocabulary, int(draw.integers(0, 6)))]
        links = [f"l{draw.integers(0, 9)}"] if draw.random() < 0.3 else []
        when = None if draw.random() < 0.1 else START + timedelta(hours=float(draw.uniform(0, 90)))
        rows.append((i, ["m", None][int(draw.random() < 0.2)], [float(x) for x in vectors[i]], when, words, links, bool(draw.random() < 0.8)))
    # like sets on vectors that have nothing in common
    far = [n + k for k in range(6)]
    for k, i in enumerate(far):
        rows.append((i, "m", [float(x) for x in draw.normal(size=12)], START + timedelta(hours=k), ["x", "y", "z", "w"], [], True))
    return rows, spark.createDataFrame(rows, ITEMS)


def plain_matches(rows, floor=0.47, window=48.0):
    best = {}
    for i, model, v, when, words, links, new in rows:
        for j, other, w, then, words2, links2, new2 in rows:
            if not new or i == j or model != other or (new2 and j > i):
                continue
            gap = abs((when - then).total_seconds()) / 3600 if when and then else None
            decay = 1.0 if gap is None else max(0.0, 1 - gap / window)
            score = min(1.0, 0.6 * cosine(np.array(v), np.array(w)) + 0.4 * overlap(words, words2) + 0.1 * overlap(links, links2)) * decay
            score = round(score, 9)
            if score > floor and (i not in best or (score, -j) > best[i]):
                best[i] = (score, -j)
    return {i: (round(s, 6), -j) for i, (s, j) in best.items()}


@pytest.mark.parametrize("seed, spread, tile_rows", [(1, 0.1, 16), (2, 0.3, 16), (3, 3.0, 16), (4, 0.1, 1024)])
def test_best_matches_equal_all_pairs(spark, seed, spread, tile_rows):
    rows, table = items_of(spark, seed, 150, spread)
    got = pairs.best_matches(table, as_of=None, tile_rows=tile_rows)
    assert {r.item_id: (round(r.score, 6), r.match_id) for r in got.collect()} == plain_matches(rows)


def test_matches_by_overlap_alone_come_from_the_set_join(spark):
    """Tiles too far apart in direction do not meet, and yet their like sets do."""
    draw = np.random.default_rng(3)
    rows = []
    for i in range(300):
        vector = np.eye(12)[{30: 6, 31: 7}.get(i, i % 6)] + 0.02 * draw.normal(size=12)
        words = ["p", "q", "s", "t"] if i in (30, 31) else [f"w{i}-{k}" for k in range(4)]
        rows.append((i, "m", [float(x) for x in vector], START, words, ["same"] if i in (30, 31) else [], True))
    table = spark.createDataFrame(rows, ITEMS)
    options = {"as_of": None, "merge_threshold": 0.43, "tile_rows": 20}
    work = {r.work: r.pairs for r in pairs.match_work(table, **options).collect()}
    assert work.get("overlap", 0) > work["matrix"]
    got = {r.item_id: (round(r.score, 6), r.match_id) for r in pairs.best_matches(table, **options).collect()}
    assert got == plain_matches(rows, 0.40) and got[31][1] == 30


def test_clustered_tiles_are_dropped(spark):
    """What is multiplied grows far slower than all pairs of tiles."""
    shares = []
    for n in (400, 1600):
        _, which, vectors = crowd(9, n, 0.05, clusters=16)
        rows = [(i, "m", [float(x) for x in v], START, [f"e{i}"], [], True) for i, v in enumerate(vectors)]
        work = {r.work: r.pairs for r in pairs.match_work(spark.createDataFrame(rows, ITEMS), as_of=None, tile_rows=25).collect()}
        shares.append(work["matrix"] / sum(work.values()))
    assert shares[0] < 0.3 and shares[1] < 0.2


@pytest.mark.parametrize("spread, tile_rows", [(0.1, 16), (2.0, 16), (0.1, 2048)])
def test_peaks_equal_all_pairs(spark, spread, tile_rows):
    draw, _, vectors = crowd(4, 200, spread)
    vectors[7] = 0.0
    days = [float(x) for x in draw.uniform(0, 200, 200)]
    rows = [(i, [float(x) for x in v], START + timedelta(days=d)) for i, (v, d) in enumerate(zip(vectors, days, strict=True))]
    table = spark.createDataFrame(rows, "story_id long, centroid array<double>, first_seen timestamp")
    want = {}
    for i, _, when in rows:
        seen = [cosine(vectors[i], vectors[j]) for j, _, then in rows if then < when and (when - then) <= timedelta(days=90)]
        if seen:
            want[i] = round(max(seen), 9)
    got = {r.story_id: round(r.peak, 9) for r in pairs.prior_peaks(table, tile_rows=tile_rows).collect()}
    assert got == want
    asked = pairs.prior_peaks(table, tile_rows=tile_rows, wanted=table.where("story_id % 20 = 0"))
    assert {r.story_id: round(r.peak, 9) for r in asked.collect()} == {i: p for i, p in want.items() if i % 20 == 0}
    if spread < 1 and tile_rows < 100:
        work = {r.work: r.pairs for r in pairs.peak_work(table, tile_rows=tile_rows).collect()}
        assert work.get("none", 0) > 0


@pytest.mark.parametrize("spread, tile_rows", [(0.1, 16), (2.0, 16), (0.1, 1024)])
def test_extremes_equal_all_pairs(spark, spread, tile_rows):
    draw, which, vectors = crowd(6, 160, spread)
    words = [[f"e{k}" for k in draw.integers(0, 12, int(draw.integers(0, 5)))] for _ in range(160)]
    rows = [(i, [float(x) for x in v], int(which[i]), words[i]) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "row_id long, vector array<double>, label int, words array<string>")
    want = {}
    for name, (a, b) in pairs.SIGNALS.items():
        score = {(i, j): a * cosine(vectors[i], vectors[j]) + b * overlap(words[i], words[j]) for i in range(160) for j in range(160) if i != j}
        same = min(s for (i, j), s in score.items() if which[i] == which[j])
        want[name] = (round(same, 7), round(max(s for (i, j), s in score.items() if which[i] != which[j]), 7))
    got = pairs.cosine_extremes(table, "row_id", "vector", "label", tile_rows, "words", pairs.SIGNALS).collect()
    assert {r.signal: (round(r.lowest_same, 7), round(r.highest_different, 7)) for r in got} == want
    if spread < 1 and tile_rows < 100:
        work = {r.work: r.pairs for r in pairs.extremes_work(table, "row_id", "vector", "label", tile_rows).collect()}
        assert work.get("none", 0) > work["matrix"]


def test_bounds_hold(spark):
    _, _, vectors = crowd(8, 300, 0.5)
    vectors[::50] = 0.0
    rows = [(i, [float(x) for x in v], f"t{i % 7}") for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "row_id long, vector array<double>, tile string")
    chosen = pivots.choose(table, "row_id", "vector", 6)
    found = pivots.ranges(table, "vector", chosen)
    met = found.alias("a").join(found.alias("b"), F.lit(True)).select("a.tile", F.col("b.tile").alias("other"), pivots.most_cosine("a", "b").alias("most"), pivots.least_cosine("a", "b").alias("least"))
    for r in met.collect():
        inside = [cosine(vectors[i], vectors[j]) for i in range(300) for j in range(300) if f"t{i % 7}" == r.tile and f"t{j % 7}" == r.other]
        assert r.least <= min(inside) and max(inside) <= r.most
