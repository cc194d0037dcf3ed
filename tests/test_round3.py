"""Findings of round 3."""

import os

import duckdb
import numpy as np
import pandas as pd
from conftest import DATA
from pyspark.sql import functions as F

from storyweave import fixtures as fx
from storyweave.functions import text
from storyweave.operators import pairs, reader
from storyweave.sources import scans
from storyweave.workload import ORACLES, QUERIES


def in_pieces(spark, folder, rows, schema, pieces):
    """documents in ``pieces`` files, as a large table has them."""
    spark.createDataFrame(rows, schema).repartitionByRange(pieces, "doc_id").write.parquet(f"{folder}/documents.parquet")


def against_sql(spark, folder, name):
    con = duckdb.connect()
    for table in os.listdir(folder):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{table}/*.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, folder).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())


def test_references_end_with_a_semicolon(spark):
    rows = spark.createDataFrame([("<p>and&amp</p> b",), ("<p>&eacute;&#233;&#xe9;&nosuch;&ampx; &copy &amp;c</p>",)], "html string")
    direct = [r[0] for r in rows.select(text.html_to_text(F.col("html"))).collect()]
    assert direct == ["and&amp b", "ééé&nosuch;&ampx; &copy &c"]
    assert [r.html for r in text.with_plain_text(rows, "html").collect()] == direct


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def test_streams_batch_by_range_whatever_the_files(spark, tmp_path):
    # most of the files hold the last range: batches of equally many files would mix ranges
    ids = [*range(0, 30), *range(60, 180)]
    rows = [(k, f"Text {k % 50}\nbody", "en", f"src{(k * 7) % 20}", 9) for k in ids]
    in_pieces(spark, str(tmp_path), rows, DOCUMENT, 15)
    settings = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "64k"}  # a partition a file
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        against_sql(spark, str(tmp_path), "stage_stream")
        against_sql(spark, str(tmp_path), "ingest_stream")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_paper_ids_have_five_digits(spark):
    docs = spark.createDataFrame([(9, "a", "en", "src1", 1), (1234567, "b", "en", "src1", 1)], DOCUMENT)
    urls = sorted(r.url for r in scans.scan_paper_feed(fx.atom_payloads(docs)).collect())
    assert urls == ["https://arxiv.org/abs/2401.00008", "https://arxiv.org/abs/2401.12345"]


def test_literal_orders_by_blocks_of_cards(spark):
    """Seven cards in blocks of two, against a plain loop."""
    made = [(k, float(k % 3), k * 5 % 4, k % 2, [f"s{k % 3}", "s9"] if k % 4 else ["s5"], k + 1) for k in range(7)]
    cards = spark.createDataFrame([("b", *c) for c in made], "bundle_id string, story_id long, score double, updated_at long, outlet_count long, source_ids array<string>, feed_pos long")
    asks = [(1, "b", []), (2, "b", ["s0", "s1"]), (3, "b", None), (4, "none", [])]
    requests = spark.createDataFrame(asks, "reader_id long, bundle_id string, selected array<string>")
    seen, gone = {(1, 0), (1, 4), (2, 1), (3, 99)}, {(1, 6), (2, 3), (3, 4), (4, 0)}
    read, dismissed = (spark.createDataFrame(sorted(x), "reader_id long, story_id long") for x in (seen, gone))
    orders = {"importance": lambda r, c: c[5], "recency": lambda r, c: (-c[2], c[5]), "outlets": lambda r, c: (-c[3], -c[2], c[5]),
              "unread": lambda r, c: ((r, c[0]) in seen, -c[2], c[5])}
    every = set()
    for mode, order in orders.items():
        want = set()
        for r, bundle, selected in asks:
            mine = [c for c in made if bundle == "b" and (not selected or set(selected) & set(c[4])) and (r, c[0]) not in gone
                    and (mode == "unread" or (r, c[0]) not in seen)]
            want |= {(r, c[0], place) for place, c in enumerate(sorted(mine, key=lambda c: order(r, c)), 1)}
        got = reader.ordered_feed(requests, cards, read, dismissed, mode, block_rows=2)
        assert {(x.reader_id, x.story_id, x.position) for x in got.collect()} == want
        if mode == "importance":
            every = {(r, c) for r, c, _ in want}
    rows = reader.visible_rows(requests, cards, read, dismissed, block_rows=2).collect()
    assert len(rows) == len(every) and {(x.reader_id, x.story_id) for x in rows} == every


def test_fit_of_readers_without_a_side(spark, tmp_path):
    """Readers of even id dismiss nothing, every third opens and saves nothing."""
    folder, user = str(tmp_path), F.col("user_id")
    kept = ~((user % 2 == 0) & (F.col("event_type") == "error")) & ~((user % 3 == 0) & F.col("event_type").isin("view", "purchase"))
    for table in ("documents", "embeddings", "events"):
        rows = spark.read.parquet(f"{DATA}/{table}.parquet")
        (rows.where(kept) if table == "events" else rows).write.parquet(f"{folder}/{table}.parquet")
    against_sql(spark, folder, "reader_fit")
    against_sql(spark, folder, "reader_feed")


def test_ends_of_tiles_by_bounds(monkeypatch):
    """Equal to all pairs, and few pairs are computed in full once ends are known."""
    rng = np.random.default_rng(1)

    def tile(n, first):
        return pd.DataFrame({
            "row_id": np.arange(n) + first, "label": rng.integers(0, 90, n), "vec": list(rng.normal(size=(n, 16))),
            "entities": [np.unique(rng.integers(0, 40, rng.integers(0, 5))) for _ in range(n)], "tile": str(first)})

    signals = pairs.SIGNALS | {"negative": (-0.5, -0.7)}
    for left, right in ((tile(300, 0), tile(200, 100)), (tile(50, 0), tile(60, 500))):
        same = left.label.to_numpy()[:, None] == right.label.to_numpy()[None, :]
        pair = left.row_id.to_numpy()[:, None] != right.row_id.to_numpy()[None, :]
        want = {name: (np.min(x, where=same & pair, initial=np.inf), np.max(x, where=~same, initial=-np.inf))
                for name, x in pairs._signal_scores(left, right, signals).items()}
        got = pairs._extremes_kernel(signals, step=128)(left, right)
        assert {r.signal: (r.lowest_same, r.highest_different) for r in got.itertuples()} == want
        full, scores = [], pairs._exact_scores
        monkeypatch.setattr(pairs, "_exact_scores", lambda a, b, rows, *more: (full.append(len(rows)), scores(a, b, rows, *more))[1])
        known = {name: (low - 0.01, high + 0.01) for name, (low, high) in want.items()}
        later = pairs._extremes_kernel(signals, known)(left, right)
        assert np.isinf(later[["lowest_same", "highest_different"]].to_numpy()).all() and sum(full) < 0.02 * len(signals) * same.size
        monkeypatch.undo()
