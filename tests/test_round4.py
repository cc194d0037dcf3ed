"""Findings of round 4."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_round3 import DOCUMENT, against_sql

from storyweave.operators import pairs

#: Documents without a text or a first line; most ids lie in the window of the scans.
ODD = {401: "", 402: "", 403: "\n", 405: "\nAll rights reserved by everybody.", 406: "A.", 443: "", 447: "A", 448: "Part: A"}


def odd_texts(spark, folder):
    rows = [(k, ODD.get(k, f"Text {k}\nof a body that is long enough"), "en", f"src{k % 20}", 9) for k in range(360, 460)]
    spark.createDataFrame(rows, DOCUMENT).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_page_without_text_is_no_article(spark, tmp_path):
    against_sql(spark, odd_texts(spark, tmp_path), "normalize")


def test_scans_of_documents_without_a_first_line(spark, tmp_path):
    folder = odd_texts(spark, tmp_path)
    for name in ("scan_release_feed", "scan_rss", "scan_paper_feed"):
        against_sql(spark, folder, name)


def test_tiles_of_calibration_stay_few(spark, monkeypatch):
    """A row travels to every tile, so that their number must not grow with the rows."""
    met, plan = [], pairs._extreme_pairs

    def count(*args):
        met.append(plan(*args)[1].count())
        raise StopAsyncIteration

    monkeypatch.setattr(pairs, "_extreme_pairs", count)
    for n in (20_000, 80_000):
        rows = spark.range(n).select(F.col("id").alias("row_id"), F.floor(F.col("id") / 2).alias("label"), F.array(F.cos("id"), F.sin("id")).alias("vec"))
        with pytest.raises(StopAsyncIteration):
            pairs.cosine_extremes(rows, "row_id", "vec", "label")
    assert max(met) <= 20 * 21 // 2


def test_ends_of_large_tiles_and_of_a_tile_with_itself():
    """Blocks of any size, null labels and vectors of odd lengths, against all pairs."""
    rng = np.random.default_rng(5)
    n = 700
    tile = pd.DataFrame({
        "row_id": np.arange(n), "label": np.where(np.arange(n) % 50 == 0, np.nan, rng.integers(0, 300, n)), "vec": list(rng.normal(size=(n, 8))),
        "entities": [np.unique(rng.integers(0, 30, rng.integers(0, 4))) for _ in range(n)]})
    odd = tile.assign(vec=[v * 1e120 if k == 7 else v for k, v in enumerate(tile.vec)])
    for rows in (tile, odd):
        label = rows.label.to_numpy()
        same, pair = label[:, None] == label[None, :], ~np.eye(n, dtype=bool)
        want = {name: (np.min(x, where=same & pair, initial=np.inf), np.max(x, where=~same, initial=-np.inf))
                for name, x in pairs._signal_scores(rows, rows, pairs.SIGNALS).items()}
        for step in (16, 100, 1024):
            got = pairs._extremes_kernel(pairs.SIGNALS, step=step)(rows, rows)
            assert {r.signal: (r.lowest_same, r.highest_different) for r in got.itertuples()} == want
