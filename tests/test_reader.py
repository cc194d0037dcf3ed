import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyweave.operators import reader
from storyweave.streaming import state

SIGNALS = "reader_id long, seq long, story_id long, signal string, model_id string"


def make_signals(seed, n=300, readers=4):
    rng = random.Random(seed)
    return [(rng.randrange(readers), i, rng.randrange(30), rng.choice(["open", "save", "dismiss"]),
             "m1" if i < n * rng.choice([0.3, 0.6, 0.6]) else "m2") for i in range(n)]


def sequential_centroids(signals, vectors):
    out = {}
    for r, _, story, signal, model in sorted(signals, key=lambda s: s[1]):
        if story not in vectors:
            continue
        s = out.get(r)
        if s is None or s["model"] != model:
            s = out[r] = {"model": model, "p": np.zeros(4), "n": np.zeros(4), "pw": 0.0, "nw": 0.0}
        w = reader.SIGNAL_WEIGHTS[signal]
        side = "n" if signal == "dismiss" else "p"
        s[side] += w * vectors[story]
        s[side + "w"] += w
    unit = lambda v, w: None if w == 0 else v / np.linalg.norm(v)
    return {r: (unit(s["p"], s["pw"]), unit(s["n"], s["nw"])) for r, s in out.items()}


@pytest.fixture(scope="module")
def story_vectors(spark):
    gen = np.random.default_rng(1)
    vectors = {i: gen.normal(size=4) for i in range(25)}
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "story_id long, vector array<double>")
    return vectors, frame


def same(rows, want):
    assert {r.reader_id for r in rows} == set(want)
    for r in rows:
        for got, expected in zip((r.positive_centroid, r.negative_centroid), want[r.reader_id]):
            assert (got is None) == (expected is None)
            if got is not None:
                np.testing.assert_allclose(got, expected, atol=1e-9)


@pytest.mark.parametrize("seed", [1, 2])
def test_centroids_reset_on_model_change(spark, story_vectors, seed):
    vectors, frame = story_vectors
    signals = make_signals(seed)
    got = reader.reader_centroids(spark.createDataFrame(signals, SIGNALS), frame).collect()
    same(got, sequential_centroids(signals, vectors))


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_of_batches_equals_one_pass(spark, story_vectors, tmp_path, shuffled):
    vectors, frame = story_vectors
    signals = make_signals(8)
    landed = random.Random(4).sample(signals, len(signals)) if shuffled else signals
    folder = str(tmp_path / "in")
    for start in range(0, len(landed), 120):
        spark.createDataFrame(landed[start:start + 120], SIGNALS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SIGNALS).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "state")
    merge = state.merge_reader_state(frame)
    state.state_stream(stream, merge, state.READER_STATE, state.by_key("reader_id"), out, out + "-log").awaitTermination()
    got = state.reader_state_centroids(state.latest_state(spark, out, state.READER_STATE)).collect()
    same(got, sequential_centroids(signals, vectors))


def test_late_signal_of_an_earlier_model(spark, story_vectors):
    vectors, frame = story_vectors
    merge = state.merge_reader_state(frame)

    def signals(*rows):
        return spark.createDataFrame([(1, seq, story, "save", model) for seq, story, model in rows], SIGNALS).withColumn(
            "log_part", state.by_key("reader_id"))

    first = signals((20, 3, "m2"), (10, 4, "m2"))
    held = merge(spark.createDataFrame([], state.READER_STATE), first, first.limit(0))
    # before all that counts, or between: then the state is split and read again
    for seq, want in ((5, [3, 4]), (15, [3])):
        got = merge(held, signals((seq, 5, "m1")), first).first()
        assert (got.model_id, got.reset_at, got.first_seq, got.last_seq) == ("m2", seq, 10 if seq == 5 else 20, 20)
        weight = reader.SIGNAL_WEIGHTS["save"]
        np.testing.assert_allclose(got.positive_sum, sum(weight * vectors[i] for i in want), atol=1e-9)


def reranked(spark, rows):
    frame = spark.createDataFrame(rows, "reader_id long, story_id long, score double, fit double, feed_pos long")
    places = {}
    for row in reader.rerank(frame).collect():
        places.setdefault(row.reader_id, {})[row.position] = row.story_id
    return {r: [p[k] for k in sorted(p)] for r, p in places.items() if sorted(p) == list(range(1, len(p) + 1))}


def test_rerank_by_hand(spark):
    # importance scales to 1 .. 0; card 1 fits worst and takes the one reserved place, after three others
    fits = [-1.0, 1.0, 0.0, 0.6, -0.5, 0.2, 0.9]
    first = [(1, k + 1, 0.7 - 0.1 * k, fit, k + 1) for k, fit in enumerate(fits)]
    # equal fits: none is a bad fit, so the most important card is reserved
    second = [(2, k + 1, 0.9 - 0.1 * k, 0.3, k + 1) for k in range(4)]
    # too few cards for a reserved place
    third = [(3, 1, 0.2, 0.1, 1), (3, 2, 0.1, 0.9, 2), (3, 3, 0.05, 0.8, 3)]
    got = reranked(spark, first + second + third)
    assert got[1] == [2, 4, 3, 1, 7, 6, 5]
    assert got[2] == [2, 1, 3, 4]
    assert sorted(got[3]) == [1, 2, 3] and got[3].index(2) < got[3].index(3)


def test_rerank_keeps_every_card_once(spark):
    rng = random.Random(2)
    rows, sizes = [], [1, 2, 5, 20, 41, 60]
    for r, n in enumerate(sizes):
        scores = sorted((round(rng.random(), 2) for _ in range(n)), reverse=True)
        rows += [(r, 100 * r + i, s, round(rng.uniform(-1, 1), 1), i + 1) for i, s in enumerate(scores)]
    got = reranked(spark, rows)
    assert {r: sorted(order) for r, order in got.items()} == {r: sorted(x[1] for x in rows if x[0] == r) for r in range(len(sizes))}


def test_reserved_places_are_evenly_apart(spark):
    rows = []
    for n in range(1, 120):
        reserved = math.floor(n * 0.15 + 0.5)
        rows += [(n, False, k, n - reserved, reserved) for k in range(1, n - reserved + 1)]
        rows += [(n, True, k, n - reserved, reserved) for k in range(1, reserved + 1)]
    frame = spark.createDataFrame(rows, "n long, reserved boolean, rank long, main long, taken long").withColumn(
        "p", reader.interleave_position(F.col("reserved"), F.col("rank"), F.col("main"), F.col("taken")))
    at = {}
    for r in frame.collect():
        at.setdefault(r.n, {})[r.reserved, r["rank"]] = int(r.p)
    for n, places in at.items():
        assert sorted(places.values()) == list(range(1, n + 1))
        for kind in (False, True):
            own = [places[k] for k in sorted(places) if k[0] == kind]
            assert own == sorted(own)
        held = sorted(p for (kind, _), p in places.items() if kind)
        gaps = {b - a for a, b in zip([0, *held], held)}
        # an equal number of other cards stands before each reserved one
        assert len(gaps) <= 1 or n - held[-1] < max(gaps)


def test_filters_come_before_ranking(spark):
    cards = spark.createDataFrame(
        [(1, 0.9, 3, 1, ["a"], "b", 1), (2, 0.8, 2, 5, ["b"], "b", 2), (3, 0.7, 1, 5, ["a", "c"], "b", 3), (4, 0.6, 9, 1, ["c"], "b", 4)],
        "story_id long, score double, updated_at long, outlet_count long, source_ids array<string>, bundle_id string, feed_pos long")
    asks = spark.createDataFrame([(1, "b", []), (2, "b", ["a"]), (3, "x", [])], "reader_id long, bundle_id string, selected array<string>")
    read = spark.createDataFrame([(1, 2)], "reader_id long, story_id long")
    gone = spark.createDataFrame([(1, 4)], "reader_id long, story_id long")

    def order(mode):
        out = {}
        for r in sorted(reader.reader_feed(asks, cards, read, gone, mode=mode, personalise=False).collect(), key=lambda x: x.position):
            out.setdefault(r.reader_id, []).append(r.story_id)
        return out

    assert order("importance") == {1: [1, 3], 2: [1, 3]}
    assert order("recency") == {1: [1, 3], 2: [1, 3]}
    assert order("outlets") == {1: [3, 1], 2: [3, 1]}
    assert order("unread") == {1: [1, 3, 2], 2: [1, 3]}


def test_saved_lists(spark):
    signals = spark.createDataFrame([(1, 1, 7, "save", "m"), (1, 2, 8, "save", "m"), (1, 3, 7, "save", "m"), (1, 4, 9, "save", "m")], SIGNALS)
    saved = reader.id_list(signals, "save")
    assert [r.story_id for r in saved.orderBy("position").collect()] == [9, 8, 7]
    cards = spark.createDataFrame([(8, "new")], "story_id long, card string")
    kept = spark.createDataFrame([(1, 8, "old"), (1, 7, "copy")], "reader_id long, story_id long, card string")
    got = {r.story_id: (r.card, r.origin) for r in reader.saved_with_fallback(saved, cards, kept).collect()}
    assert got == {8: ("new", "bundle"), 7: ("copy", "snapshot"), 9: (None, "placeholder")}
    assert [tuple(r) for r in reader.snapshot_refresh(saved, cards, kept).collect()] == [(1, 8, "new")]
