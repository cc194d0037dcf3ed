"""Benchmark decontamination: a broadcast hash set of benchmark windows, a scan
of every document's windows against it, an exact check of each hit, and the
removal of the hit spans or of the documents.

Words are runs of ASCII letters and digits and of characters outside ASCII,
A-Z lower-cased. A window is ``n`` consecutive words of an item; an item of
fewer words, but at least one, is one window. A document word inside any
occurrence of a window is hit.

Defined cases: a null or empty text has no words and no hits; a null item text
gives no window; a null item id counts as the empty string; repeated items and
windows count once per distinct id; rows are judged one by one, so repeated
documents each get their answer; an empty benchmark hits nothing. Extra columns
are carried by ``remove`` and ignored by ``scan``.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweave.llm.batches import Step, map_batches, utf8
from storyweave.session import cut_lineage

#: One byte in, one byte out: A-Z lower-cased, everything that is no part of a word a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

SCAN_SCHEMA = "doc_id long, n_words long, spans array<struct<start:int,stop:int>>, item_ids array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Windows:
    """The windows of a bounded set of items. Per window length: the hashes of
    all windows, sorted, and under each window's own words the items it is in."""

    def __init__(self, items: Iterable[tuple[str, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.uint32)
            size = min(n, len(ids))
            for at in range(len(ids) - size + 1 if size else 0):
                found[size][ids[at : at + size].tobytes()].add(item)
        self.items = {size: dict(windows) for size, windows in found.items()}
        self.hashes = {
            size: np.unique(self._hash(np.frombuffer(b"".join(w), np.uint32).reshape(-1, size)))
            for size, w in self.items.items()
        }

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for column in range(rows.shape[1]):
            out = out * _MULTIPLIER + rows[:, column].astype(np.uint64)
        return out

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges that are hit, merged where they touch, and the items."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint32, len(words))
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        items: set[str] = set()
        ranges: list[tuple[int, int]] = []
        for size, hashes in self.hashes.items():
            if size > len(ids):
                continue
            starts = np.flatnonzero(unknown[size:] == unknown[: len(unknown) - size])
            if not len(starts):
                continue
            rows = np.lib.stride_tricks.sliding_window_view(ids, size)
            for block in np.array_split(starts, len(starts) // 65536 + 1):
                for at in block[np.isin(self._hash(rows[block]), hashes)].tolist():
                    if owners := self.items[size].get(rows[at].tobytes()):
                        items |= owners
                        ranges.append((at, at + size))
        merged: list[tuple[int, int]] = []
        for start, stop in sorted(ranges):
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
            else:
                merged.append((start, stop))
        return merged, items

    def cut(self, text: bytes) -> bytes:
        """The text without hit spans. What is left of two spans may form a
        window anew, so this goes on until none is found; each round takes words."""
        while spans := self.hits(words_of(text))[0]:
            places = [m.span() for m in _WORD.finditer(text)]
            kept, last = [], 0
            for start, stop in spans:
                kept.append(text[last : places[start][0]])
                last = places[stop - 1][1]
            text = b"\n".join(x.strip(b" ") for x in [*kept, text[last:]])
        return text


class Shards:
    """The items in lists of at most about ``max_bytes`` of text each, fetched
    one at a time and only after their total has been summed. A task's table of
    windows takes up to a hundred times the text."""

    def __init__(self, benchmark: DataFrame, max_bytes: int):
        self.rows = benchmark.select(
            F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text")
        ).where(F.col("text").isNotNull())
        total = self.rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.count = int(total // max_bytes) + 1

    def __iter__(self) -> Iterator[list[tuple[str, bytes]]]:
        for k in range(self.count):
            # an item's own windows may lie in several shards only if its text is repeated
            own = self.rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.count)) == k)
            yield [(r[0], bytes(r[1])) for r in own.toLocalIterator()]


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_bytes: int = 4_000_000) -> DataFrame:
    """doc_id, n_words, hit word ranges and the items that occur, per document.

    A benchmark of up to ``max_bytes`` of text is broadcast and the documents
    are read once without a shuffle. A larger one is cut into shards of that
    size; each is broadcast in its turn, its hits are written down, and the hits
    of a row meet by a key of the row, so ids may be missing or repeated."""
    spark = docs.sparkSession
    shards = Shards(benchmark, max_bytes)
    source = docs.select(F.col("doc_id").cast("long"), "text", F.lit(0).cast("long").alias("row"))
    if shards.count > 1:
        source = cut_lineage(source.withColumn("row", F.monotonically_increasing_id()))

    def one(items: list[tuple[str, bytes]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)

        def make() -> Step:
            windows = Windows(sent.value, n)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                counts, spans, items = [], [], []
                for text in utf8(batch.column("text")):
                    words = words_of(text or b"")
                    ranges, owners = windows.hits(words)
                    counts.append(len(words))
                    spans.append([{"start": a, "stop": b} for a, b in ranges])
                    items.append(sorted(owners))
                return pa.record_batch([
                    batch.column("doc_id"), pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                    pa.array(items, pa.list_(pa.string())), batch.column("row"),
                ], names=["doc_id", "n_words", "spans", "item_ids", "row"])

            return step

        return map_batches(source, make, f"{SCAN_SCHEMA}, row long")

    if shards.count == 1:
        return one(next(iter(shards))).drop("row")
    parts = [cut_lineage(one(items)) for items in shards]
    some = reduce(DataFrame.unionByName, (p.where(F.size("item_ids") > 0) for p in parts))
    hits = some.groupBy("row").agg(
        F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("i")
    )
    merged = F.aggregate(
        F.array_sort("s"), F.array().cast("array<struct<start:int,stop:int>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= x["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["start"].alias("start"),
                F.greatest(F.element_at(done, -1)["stop"], x["stop"]).alias("stop")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return (
        parts[0].select("doc_id", "n_words", "row").join(hits, "row", "left")
        .select("doc_id", "n_words", F.coalesce(F.when(F.size("s") > 0, merged), F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
                F.coalesce("i", F.array().cast("array<string>")).alias("item_ids"))
    )


def remove(docs: DataFrame, benchmark: DataFrame, n: int = 10, how: str = "spans", max_bytes: int = 4_000_000) -> DataFrame:
    """The documents without benchmark passages, all columns kept. ``spans``
    cuts the hit words out, puts a line break in their place, sets n_chars to
    the new length and drops a document that has no word left; ``documents``
    drops every document with a hit. Documents without a hit are untouched. A
    benchmark of several shards is gone over until none of them cuts."""
    if how not in ("spans", "documents"):
        raise ValueError(f"how is spans or documents, not {how}")
    spark, schema = docs.sparkSession, docs.schema

    def one(df: DataFrame, items: list[tuple[str, bytes]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)

        def make() -> Step:
            windows = Windows(sent.value, n)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                texts = batch.column("text").to_pylist()
                changed: dict[int, str | None] = {}
                for at, text in enumerate(texts):
                    raw = (text or "").encode()
                    if windows.hits(words_of(raw))[0]:
                        left = windows.cut(raw) if how == "spans" else b""
                        changed[at] = left.decode() if words_of(left) else None
                if not changed:
                    return batch
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                columns["text"] = pa.array([changed.get(k, t) for k, t in enumerate(texts)], batch.schema.field("text").type)
                if "n_chars" in columns:
                    lengths = columns["n_chars"].to_pylist()
                    columns["n_chars"] = pa.array(
                        [len(changed[k]) if changed.get(k) is not None else v for k, v in enumerate(lengths)],
                        batch.schema.field("n_chars").type,
                    )
                keep = pa.array([changed.get(k, "") is not None for k in range(len(texts))])
                return pa.record_batch(list(columns.values()), names=batch.schema.names).filter(keep)

            return step

        return map_batches(df, make, schema)

    shards = Shards(benchmark, max_bytes)
    if shards.count == 1:
        return one(docs, next(iter(shards)))
    while True:
        # each round takes words, so this ends
        for items in shards:
            docs = cut_lineage(one(docs, items))
        if how == "documents" or not scan(docs, benchmark, n, max_bytes).where(F.size("spans") > 0).limit(1).count():
            return docs


def digest(scanned: DataFrame) -> DataFrame:
    """The counts of ``scan`` and a hash of the items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["stop"] - x["start"]))
    return scanned.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def items_sha256(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
