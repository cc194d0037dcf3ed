"""Hard negatives against all pairs, and that reading stops early."""

import math

import duckdb
import numpy as np
import pytest
from helpers import DATA
from hypothesis import given as examples
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyweave.llm import negatives
from storyweave.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string"


def plain(rows, every, scale=256):
    """rows: (id, vector, label), all taking part."""
    whole = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows]
    out = []
    for i, a, y in {(i, tuple(v), y) for i, v, y in whole if i % every == 0}:
        scored = sorted((-sum(p * q for p, q in zip(a, v, strict=True)), j, z == y) for j, v, z in whole if j != i and len(v) == len(a))
        for s, j, _ in [x for x in scored if x[2]][:5]:
            hard = [(-t, n) for t, n, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, rank, n, -s, t) for rank, (t, n) in enumerate(hard, 1)]
    return sorted(out)


def found(frame):
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = sorted(con.execute(ORACLES["op11_hard_negatives"]).fetchall())
    assert found(QUERIES["op11_hard_negatives"](spark, DATA)) == want and want


@pytest.mark.parametrize("shard_rows, seeds", [(7, 10), (16384, 4096)])
def test_ties_copies_and_odd_vectors(spark, shard_rows, seeds):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.integers(-2, 4, 4)], int(draw.integers(0, 3))) for i in range(90)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0], i % 2) for i in range(200, 240)]  # a crowd of copies of one vector
    rows += [(240, [1.0, 1.0, 1.0, 1.0], 0)] * 3  # a repeated anchor
    rows += [(300 + i, [0.5], 1) for i in range(4)] + [(304, [0.25], 2)]  # another length
    rows += [(400, [0.0] * 4, 1), (401, [3e9, 1.0, -2e9, 0.0], 1), (410, [3e9, 2.0, 0.0, 0.0], 2), (411, [2.9e9, 2.0, 0.0, 0.0], 1)]
    odd = [(500, None, 1), (501, [1.0, None, 0.0, 0.0], 1), (502, [float("nan")] * 4, 1), (503, [float("inf")] * 4, 2), (504, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], SCHEMA)
    want = [r for r in plain(rows, 10)]
    got = found(negatives.mine(table, F.col("vec_id") % 10 == 0, shard_rows=shard_rows, seeds=seeds))
    low, high = -(1 << 63), (1 << 63) - 1
    assert all(low <= s <= high for r in want for s in r[4:]) or max(s for r in want for s in r[4:]) > high
    assert [r for r in got if max(r[4:]) < high] == [r for r in want if max(r[4:]) < high]


def test_empty_table_and_no_partner(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(10, [1.0], 1, "x"), (11, [1.0], 2, "x")], SCHEMA)
    assert negatives.mine(alone, F.col("vec_id") % 10 == 0).count() == 0  # no other row of the label


@settings(max_examples=60, deadline=None)
@examples(st.integers(0, 10_000), st.integers(1, 400), st.integers(1, 6))
def test_a_shard_answers_exactly(seed, n, k):
    draw = np.random.default_rng(seed)
    vectors = draw.integers(-6, 7, (n, 3)).astype(float)
    labels = draw.integers(0, 3, n)
    lists = negatives.Lists(np.arange(n), labels, vectors)
    windows = [(-20, 30), (10, 12), (-negatives.LONG, negatives.LONG)]
    got = list(lists.search(0, vectors[0], int(labels[0]), windows, k))
    scores = vectors @ vectors[0]
    for w, (low, high) in enumerate(windows):
        want = sorted((-scores[i], i) for i in range(1, n) if labels[i] != labels[0] and low <= scores[i] <= high)[:k]
        assert [(-s, i) for v, i, s in got if v == w] == want


def test_reading_stops_early():
    """Where few rows stand out, most are never scored."""
    draw = np.random.default_rng(1)
    vectors = np.floor(draw.normal(size=(20_000, 4)) * 20)
    vectors[:30] = np.floor(200 + draw.normal(size=(30, 4)))
    lists = negatives.Lists(np.arange(len(vectors)), np.zeros(len(vectors), int), vectors)
    list(lists.search(0, vectors[0], None, [(-negatives.LONG, negatives.LONG)], 5))
    assert lists.read < 0.05 * len(vectors)
