"""Large tiles, computed block by block, and how often a row travels."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_pivots import START, cosine, crowd, items_of, plain_matches

from storyweave.operators import kernels, pairs
from storyweave.sources import scans


@pytest.mark.parametrize("seed, spread", [(5, 0.2), (6, 3.0)])
def test_blocks_and_set_join_match_like_all_pairs(spark, monkeypatch, seed, spread):
    """Blocks smaller than a tile, and pairs of like sets by their prefixes, find what all pairs have."""
    for name, value in {"BLOCK": 7, "CHUNK": 9, "PAIRS": 5, "SET_JOIN_PAIRS": 0}.items():
        monkeypatch.setattr(kernels, name, value)
    rows, _ = items_of(spark, seed, 150, spread, vocabulary=9)
    kernel = kernels.best_match(0.6, 0.4, 48 * 3.6e9)

    def tile(chosen, name):
        key = {w: k for k, w in enumerate(sorted({w for r in rows for w in r[4] + r[5]}))}
        return pa.table({
            "item_id": [r[0] for r in chosen], "vec": pa.array([r[2] for r in chosen], pa.list_(pa.float64())),
            "ts": pa.array([r[3] and (r[3] - START).total_seconds() * 1e6 for r in chosen], pa.float64()),
            "entities": pa.array([sorted({key[w] for w in r[4]}) for r in chosen], pa.list_(pa.int64())),
            "links": pa.array([sorted({key[w] for w in r[5]}) for r in chosen], pa.list_(pa.int64())),
            "is_new": [r[6] for r in chosen], "is_candidate": [True] * len(chosen), "floor": [0.47] * len(chosen), "tile": [name] * len(chosen)})

    for split in (lambda r: True, lambda r: r[3] is not None, lambda r: r[0] % 2 == 0):
        a, b = [r for r in rows if split(r)], [r for r in rows if not split(r)]
        found = kernel(tile(a, "a"), tile(a, "a")).to_pylist()
        if b:
            found += kernel(tile(b, "b"), tile(b, "b")).to_pylist() + kernel(tile(a, "a"), tile(b, "b")).to_pylist()
        best = {}
        for f in found:
            best[f["item_id"]] = max(best.get(f["item_id"], (-1.0, 0)), (f["score"], -f["match_id"]))
        assert {i: (round(s, 6), -m) for i, (s, m) in best.items()} == plain_matches([(r[0], "m", *r[2:]) for r in rows])


def test_a_row_travels_a_bounded_number_of_times(spark):
    """Of four times the rows each is met by as many tiles."""
    copies = []
    for n in (20000, 80000):
        rows = spark.range(n).select(
            F.col("id").alias("item_id"), F.lit("m").alias("model_id"), F.array(F.rand(1), F.rand(2), F.rand(3)).alias("embedding"),
            F.lit(START).cast("timestamp").alias("published_at"), F.array(F.col("id").cast("string")).alias("entities"),
            F.array().cast("array<string>").alias("link_keys"), F.lit(True).alias("is_new"))
        tiled, planned, _ = pairs._match_plan(rows, as_of=None, merge_threshold=0.5)
        sizes = {r.tile: r["count"] for r in tiled.groupBy("tile").count().collect()}
        copies.append(sum(sizes[r.left_tile] + sizes[r.right_tile] for r in planned.collect()) / n)
    assert copies[1] < 1.5 * copies[0]


@pytest.mark.parametrize("split", [0, 2])
def test_peaks_of_blocks_equal_all_pairs(monkeypatch, split):
    for name, value in {"BLOCK": 7, "CHUNK": 9, "PAIRS": 5}.items():
        monkeypatch.setattr(kernels, name, value)
    _, _, vectors = crowd(4, 120, 0.3)
    vectors[7], vectors[9] = 0.0, vectors[8]
    days = np.random.default_rng(1).integers(0, 40, 120)  # many of the same time

    def tile(ids, name):
        return pa.table({"story_id": ids, "ts": [int(days[i]) for i in ids], "reach": [15] * len(ids), "asks": [i % 5 > 0 for i in ids],
                         "vec": pa.array([list(vectors[i]) for i in ids], pa.list_(pa.float64())), "tile": [name] * len(ids)})

    sides = [tile(s, str(k)) for k, s in enumerate([list(range(120))] if not split else [list(range(0, 120, 2)), list(range(1, 120, 2))])]
    got = {}
    for k, a in enumerate(sides):
        for b in sides[k:]:
            for r in kernels.prior_peak(a, b).to_pylist():
                got[r["story_id"]] = max(got.get(r["story_id"], -2.0), r["peak"])
    want = {i: max(seen) for i in range(120) if i % 5 and (
        seen := [cosine(vectors[i], vectors[j]) for j in range(120) if days[j] < days[i] <= days[j] + 15])}
    assert {i: round(p, 9) for i, p in got.items()} == {i: round(p, 9) for i, p in want.items()}


def test_prefixes_of_a_broken_feed_are_searched_once(spark):
    frame = spark.createDataFrame([("<rss><item><title>R&D</title></item><item><title>x</item>",)], "payload string")
    found = frame.select(scans._cut_entries(F.col("payload"), "item", scans._ITEM).alias("e"))
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("xmlns:[") == 1
    first, second = found.first().e
    assert first.title == "R&D" and second is None


@pytest.mark.parametrize("tile_rows", [16, 1000])
def test_links_connect_like_all_pairs(spark, tile_rows):
    """A large component, small ones and rows alone, over many tiles and in one."""
    draw, _, vectors = crowd(3, 160, 0.25, clusters=20)
    vectors[:70] = vectors[0] + 0.05 * draw.normal(size=(70, 12))
    vectors[150], vectors[151, 0] = 0.0, np.nan
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    links = pairs.similarity_links(spark.createDataFrame(rows, "row_id long, vec array<double>"), "row_id", "vec", 0.9, tile_rows).collect()
    assert len(links) < 160 * 12

    def groups(edges):
        parent = {}

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return {x: find(x) for x in list(parent)}

    want = groups((i, j) for i in range(160) for j in range(i) if {i, j}.isdisjoint({150, 151}) and cosine(vectors[i], vectors[j]) >= 0.9)
    assert groups((r.i, r.j) for r in links) == want
    assert 1 < len(set(want.values())) and len(want) < 160


def test_connected_rows_ask_no_more(spark):
    """Where nearly all rows hang together, the links stay few."""
    table = spark.range(3000).select(F.col("id").alias("row_id"), F.array(F.lit(1.0), F.rand(1) / 10).alias("vec"))
    assert pairs.similarity_links(table, "row_id", "vec", 0.9, 100).count() < 3 * 3000
