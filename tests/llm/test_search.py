"""Exact top-k against all pairs, and that pages are pruned."""

import math

import duckdb
import numpy as np
import pytest
from helpers import DATA
from hypothesis import given as examples
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyweave.llm import mtree
from storyweave.llm.queries import ORACLES, QUERIES


def plain_top(rows, k, queries):
    out = []
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    for i, q in whole:
        if queries(i):
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i and len(v) == len(q))
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({ORACLES['op1_exact_topk']})").fetchall())
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in QUERIES["op1_exact_topk"](spark, DATA).collect())
    assert got == want and got


@pytest.mark.parametrize("tree_rows", [8, 2048])
def test_ties_copies_and_odd_vectors(spark, tree_rows):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.integers(-2, 3, 4)]) for i in range(120)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(200, 260)]  # many copies of one
    rows += [(300 + i, [0.5]) for i in range(3)]  # another length
    rows += [(404, [1e6] * 4), (410, [-2e5, 1.0, 3e5, 0.25]), (420, [1e5, 2e5, -1e5, 0.0])]  # need more than 32 bits a component
    odd = [(400, None), (401, [1.0, None, 0.0, 0.0]), (402, [float("nan")] * 4), (403, [float("inf")] * 4), (None, [1.0] * 4), (500, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, score string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in mtree.top_k(table, F.col("vec_id") % 10 == 0, 7, tree_rows, 5, 20).collect())
    assert got == plain_top(rows, 7, lambda i: i % 10 == 0)


def test_repeated_and_missing_rows(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(10, [1.0, 0.0]), (10, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0])]
    got = [tuple(r) for r in mtree.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") == 10).orderBy("rank").collect()]
    assert got == [(10, 1, 3, 2048 * 1024), (10, 2, 3, 2048 * 1024)]
    assert mtree.top_k(spark.createDataFrame([], schema), F.col("vec_id") == 10).count() == 0
    assert mtree.top_k(spark.createDataFrame([(10, [1.0])], schema), F.col("vec_id") == 10).count() == 0


def test_long_vectors_are_kept(spark):
    rows = [(1, [200000.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [-1e300, 1.0]), (5, [1.7e308, 1.7e308])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in mtree.top_k(table, F.lit(True), 4).collect()}
    most, least = (1 << 63) - 1, -(1 << 63)
    assert [got[2, n] for n in (1, 2, 3, 4)] == [(5, most), (1, 200000 * 1024 * 1024), (3, 0), (4, least)]
    assert [got[1, n] for n in (1, 2, 3, 4)] == [(5, most), (2, 200000 * 1024 * 1024), (3, 0), (4, least)]
    assert [got[5, n] for n in (1, 2, 3, 4)] == [(1, most), (2, most), (3, most), (4, least)]  # beyond a long: ties


@pytest.mark.parametrize("power", [18, 40, 300, 1000])
def test_a_tree_of_long_vectors_answers_exactly(power):
    draw = np.random.default_rng(power)
    small = draw.integers(-40, 40, (200, 3))
    vectors = np.array([[int(x) << (power if i % 2 else 20) for x in row] for i, row in enumerate(small.tolist())], object)
    for own in (vectors, small.astype(np.int64)):
        tree = mtree.Tree(np.arange(200), own, int((own * own).sum(axis=1).max()), capacity=8)
        tree = mtree.Tree.unpack(tree.pack())
        for q in (vectors[0], vectors[1], small[2].astype(np.int64)):
            scores = [max(mtree.LEAST_LONG, min(mtree.GREATEST_LONG, sum(int(a) * int(b) for a, b in zip(v, q, strict=True)))) for v in own]
            want = sorted(((s, i) for i, s in enumerate(scores) if i), key=lambda x: (-x[0], x[1]))[:7]
            assert tree.search(0, q, 7, None) == want
            assert tree.search(0, q, 7, want[-1][0]) == want


@settings(max_examples=60, deadline=None)
@examples(st.integers(0, 10_000), st.integers(1, 300), st.integers(1, 12))
def test_a_tree_answers_exactly(seed, n, k):
    draw = np.random.default_rng(seed)
    vectors = draw.integers(-40, 40, (n, 3)).astype(np.int64)
    ids = np.arange(n)
    tree = mtree.Tree(ids, vectors, int((vectors**2).sum(axis=1).max()), capacity=8)
    tree = mtree.Tree.unpack(tree.pack())
    q = vectors[0]
    want = sorted(((int(v @ q), int(i)) for i, v in zip(ids, vectors, strict=True) if i), key=lambda x: (-x[0], x[1]))[:k]
    assert tree.search(0, q, k, None) == want
    if want:
        assert tree.search(0, q, k, want[-1][0]) == want


def test_pages_are_pruned():
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(40, 16))
    vectors = np.floor(1024 * np.concatenate([c + 0.05 * draw.normal(size=(50, 16)) for c in centres])).astype(np.int64)
    tree = mtree.Tree(np.arange(len(vectors)), vectors, int((vectors**2).sum(axis=1).max()))
    for i in range(0, len(vectors), 100):
        tree.search(i, vectors[i], 10, None)
    assert tree.computed < 0.5 * 20 * len(vectors)
