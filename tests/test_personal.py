"""Personal feeds: a bunch of readers meets the cards of its bundle, and no feed row is moved."""

import numpy as np
import pytest
from test_plain import refuse, tables
from test_round3 import against_sql

from storyweave.operators import personal, reader


@pytest.mark.parametrize("name", ["reader_feed", "reader_feed_page", "reader_fit"])
def test_no_row_per_reader_and_card_is_moved(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(reader, "reader_feed_rows", refuse)
    monkeypatch.setattr(reader, "rerank", refuse)
    against_sql(spark, tables(spark, tmp_path), name)


def test_personal_rows_equal_the_order_of_all_rows(spark):
    """Against fits by plain loops and ``rerank`` over all rows."""
    rng = np.random.default_rng(3)
    vecs = {k: rng.normal(size=4).round(2).tolist() for k in range(40)} | {3: None, 4: [0.0] * 4, 5: [1.0, float("nan"), 0.0, 0.0], 6: [1.0, 2.0]}
    del vecs[7]
    made = [(k, round(float(rng.integers(0, 9)) / 9, 6), [["a"], ["b", "c"], [], None, ["c", None]][k % 5], f"b{k % 2}") for k in range(40)]
    made = [(*c, place) for place, c in enumerate(sorted(made, key=lambda c: (-c[1], c[0])), 1)]
    picks = [None, [], ["a"], ["b", "a"], ["z"], [None, "c"]]
    asks = [(r, f"b{r % 3}", picks[r % 6]) for r in range(30)]
    sides = {r: [None if (r + s) % 4 == 0 else rng.normal(size=4) for s in (0, 1)] for r in range(29)}
    sides = {r: [None if x is None else (x / np.linalg.norm(x)).tolist() for x in s] for r, s in sides.items()}
    seen, gone = {(1, 1), (1, 3), (2, 2), (4, 99), (7, 15)}, {(1, 5), (3, 4), (9, 21), (2, 2)}
    ids = "reader_id long, story_id long"
    cards = spark.createDataFrame(made, "story_id long, score double, source_ids array<string>, bundle_id string, feed_pos long")
    requests = spark.createDataFrame(asks, "reader_id long, bundle_id string, selected array<string>")
    read, dismissed = (spark.createDataFrame(sorted(x), ids) for x in (seen, gone))
    centroids = spark.createDataFrame([(r, *s) for r, s in sides.items()], "reader_id long, positive_centroid array<double>, negative_centroid array<double>")
    vectors = spark.createDataFrame(list(vecs.items()), "story_id long, vector array<float>")

    def fit(r, story):
        v = vecs.get(story)
        if v is None or len(v) != 4 or not np.isfinite(v).all() or r not in sides or sides[r] == [None, None]:
            return 0.0
        v = np.array(v, np.float32).astype(float)
        unit = v / (np.linalg.norm(v) or 1.0)
        pos, neg = (1.0 if side is None else float(unit @ side) for side in sides[r])
        return round(pos - neg, 6) + 0.0

    rows = [(r, c[0], c[1], fit(r, c[0]), c[4]) for r, b, pick in asks for c in made
            if c[3] == b and (not pick or {x for x in pick if x} & set(c[2] or [])) and (r, c[0]) not in seen | gone]
    plain = reader.rerank(spark.createDataFrame(rows, ids + ", score double, fit double, feed_pos long"))
    want = {(x.reader_id, x.story_id): (x.score, x.feed_pos, x.fit, x.reserved, x.position) for x in plain.collect()}
    args = (requests, cards, read, dismissed, centroids, vectors)
    for readers in (1, 2048):
        got = reader.personal_rows(*args, fit_digits=6, missing=1.0, readers=readers).collect()
        assert len(got) == len(want) and {x.bundle_id for x in got} == {"b0", "b1"}
        assert {(x.reader_id, x.story_id): (x.score, x.feed_pos, x.fit, x.reserved, x.position) for x in got} == want
    first = reader.personal_rows(*args, fit_digits=6, missing=1.0, shown=3, columns=["reader_id", "story_id", "position"]).collect()
    assert sorted(map(tuple, first)) == sorted((*k, v[4]) for k, v in want.items() if v[4] <= 3)


def test_places_of_equal_and_unknown_scores():
    """As in the order by columns: the first of equal cards first, those without a score last."""
    card, _, reserved, at = personal.places(np.zeros(7), np.array([0.9, 0.9, 0.5, 0.5, np.nan, 0.1, 0.1]))
    assert card[reserved].tolist() == [0] and card[np.argsort(at)].tolist() == [1, 2, 3, 0, 5, 6, 4]
    assert personal.rounded(np.array([0.0000005, -0.0000005, -1e-9, 0.25]), 6).tolist() == [1e-6, -1e-6, 0.0, 0.25]
