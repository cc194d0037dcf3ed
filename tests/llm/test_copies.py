"""SimHash near-duplicates against all pairs, and their odd cases."""

import re

import numpy as np
import pytest
import xxhash
from helpers import DATA, ODD, docs, given
from hypothesis import given as examples
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyweave.llm import nearcopies, simhash
from storyweave.llm.queries import QUERIES


def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def reachable(prints, most=2):
    """Least key that links lead to, by a search over all pairs."""
    keys = sorted(prints)
    values = np.array([prints[k] for k in keys], np.uint64)
    out = {}
    for at, key in enumerate(keys):
        if key in out:
            continue
        todo = [at]
        out[key] = key
        while todo:
            for j in np.flatnonzero(np.bitwise_count(values ^ values[todo.pop()]) <= most).tolist():
                if keys[j] not in out:
                    out[keys[j]] = key
                    todo.append(j)
    return out


def test_query_equals_all_pairs(spark):
    rows = {r.doc_id: r for r in QUERIES["op3_simhash_near_dedup"](spark, DATA).collect()}
    prints = {i: plain_fingerprint(t) for i, t, *_ in given("documents")}
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in rows.items()} == reachable(prints)


@pytest.mark.parametrize("tile_rows", [3, 2048])
def test_crowded_fingerprints_link_like_all_pairs(spark, tile_rows):
    draw = np.random.default_rng(3)
    centre = 0x0123456789ABCDEF
    near = {centre}
    while len(near) < 150:
        flips = draw.integers(0, 64, draw.integers(1, 5))
        near.add(centre ^ int(np.bitwise_xor.reduce(np.uint64(1) << flips.astype(np.uint64))))
    values = np.array(sorted(near | {int(x) for x in draw.integers(0, 2**63, 60)}), np.uint64)
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    links = [(r.i, r.j) for r in simhash.links(table, 2, 5, tile_rows).collect()]
    assert len(links) < 6 * len(values) * (len(values) // tile_rows + 1)
    want = reachable({int(v): int(u) for v, u in zip(values.view(np.int64), values, strict=True)})
    root = {int(v): int(v) for v in values.view(np.int64)}

    def top(x):
        return x if root[x] == x else top(root[x])

    for i, j in links:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    assert {v: top(v) for v in root} == want


@settings(max_examples=60, deadline=None)
@examples(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=6), st.sampled_from([(2, 5), (2, 7), (3, 7), (1, 3)]))
def test_a_pair_within_the_budget_passes_some_chain(value, flips, shape):
    most, segments = shape
    other = value ^ sum(1 << b for b in flips)
    a, b = np.array([value], np.uint64), np.array([other], np.uint64)
    passed = False
    for chain in simhash.chain_masks(segments, most):
        equal = [m for m, allowed in chain if allowed == 0][-1]
        passed |= value & equal == other & equal and bool(simhash.near(a, b, chain)[0])
    assert passed == (len(flips) <= most)


def test_odd_rows(spark):
    found = simhash.components(docs(spark, ODD)).collect()
    assert len(found) == len(ODD)
    of = {r.doc_id: r for r in found}
    assert of[1].fp == of[2].fp == of[3].fp == 0 and {of[k].component_id for k in (1, 2, 3)} == {1}
    assert of[5].component_id == of[9].component_id == of[None].component_id == 5
    assert simhash.components(docs(spark, [])).count() == 0
    only = simhash.components(docs(spark, [(None, "a b c d")])).collect()
    assert [r.component_id for r in only] == [None]


def test_one_of_each_group_stays(spark):
    table = docs(spark, ODD)
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "7", "8", "None"]
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_least_of_each_component_stays(spark):
    kept = simhash.keep_one(spark.read.parquet(f"{DATA}/documents.parquet"))
    prints = {i: plain_fingerprint(t) for i, t, *_ in given("documents")}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(reachable(prints).values()))


def test_stages_carry_clashing_columns(spark):
    table = docs(spark, ODD + [(k, "the same few words in a row that is long enough", "en", "s") for k in (40, 41)])
    for name in ("Kept_Id", "kept_hash", "text_hash", "place", "_kept_id"):
        table = table.withColumn(name, F.lit(name))
    for kept in (simhash.keep_one(table), nearcopies.keep_one(table)):
        rows = kept.collect()
        assert kept.columns == table.columns and all(r.Kept_Id == "Kept_Id" and r._kept_id == "_kept_id" for r in rows)
        assert 40 in {r.doc_id for r in rows} and 41 not in {r.doc_id for r in rows}
