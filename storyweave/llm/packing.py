"""Packing of tokenised documents into sequences of at most ``limit`` ids:
shortest-pack-first over the histogram of piece lengths.

A document is its token ids and the end id. It is cut into pieces of ``limit``
ids and a rest. The histogram of piece lengths has at most ``limit`` rows,
whatever the corpus; over it, lengths are placed longest first, each into the
packing pattern with the most room, so that only counts per pattern are kept.
Pieces then find their sequence by rank: the k-th piece of a length takes the
k-th place that the patterns hold for it. Ranks come from per-task counts and
their running sums, so one length with most of the pieces never meets in a task.

Defined cases: a null or empty text is the end id alone; a null doc_id is
carried; repeated rows are packed one by one; an empty table gives no
sequences. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyweave.llm.batches import Step, map_batches
from storyweave.llm.tokens import Encoder
from storyweave.session import cut_lineage

END = 1
LIMIT = 2048
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, place long"


def cuts(total: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids."""
    return [(at, min(limit, total - at)) for at in range(0, total, limit)]


def pieces(docs: DataFrame, limit: int = LIMIT, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per piece, with its number among the pieces of its length in its task."""

    def make() -> Step:
        encoder, seen, task = Encoder(ranks), np.zeros(limit + 1, np.int64), TaskContext.get().partitionId()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            owners, rows = [], []
            for at, ids in enumerate(encoder.encode(batch.column("text"))):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for start, length in cuts(len(ids), limit):
                    owners.append(at)
                    rows.append((start, length, zlib.crc32(ids[start : start + length]), len(ids), task, seen[length]))
                    seen[length] += 1
            columns = np.array(rows, np.int64).T
            return pa.record_batch(
                [batch.column("doc_id").take(pa.array(owners, pa.int64())), *(pa.array(columns[k]) for k in range(4)),
                 pa.array(columns[4].astype(np.int32)), pa.array(columns[5])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place"],
            )

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, PIECE_SCHEMA)


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of piece lengths, longest first, and how many sequences follow each."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = max((r for r in room if r >= length and room[r]), default=None)
            if most is None:
                each = min(limit // length, left)
                made = left // each
                room[limit - each * length].append(((length,) * each, made))
                left -= made * each
            else:
                pattern, count = room[most].pop()
                used = min(count, left)
                if count > used:
                    room[most].append((pattern, count - used))
                room[most - length].append(((*pattern, length), used))
                left -= used
    return [found for r in sorted(room) for found in room[r]]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length: rows of (first rank, sequence of that rank, offset); ranks
    go on until the next row, one sequence on with each."""
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            slots[length].append((ranks[length], sequence, offset))
            ranks[length] += count
            offset += length
        sequence += count
    return {length: np.array(rows, np.int64) for length, rows in slots.items()}


def pack(docs: DataFrame, limit: int = LIMIT, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece."""
    cut = cut_lineage(pieces(docs, limit, ranks))
    counted = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("n")).collect()}
    slots = places(shortest_pack_first(histogram, limit))
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    bases = counted.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["task", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("place")).alias("rank"))

    def make() -> Step:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lengths, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(lengths, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                table = slots[int(lengths[rows[0]])]
                at = np.searchsorted(table[:, 0], rank[rows], "right") - 1
                sequence[rows] = table[at, 1] + rank[rows] - table[at, 0]
                offset[rows] = table[at, 2]
            kept = batch.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            return pa.record_batch([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

        return step

    return map_batches(
        ranked, make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def sequences(docs: DataFrame, packed: DataFrame, limit: int = LIMIT, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """sequence_id and its ids, without padding. ``docs`` needs doc_id as a key."""

    def make() -> Step:
        encoder = Encoder(ranks)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            owners, starts, parts = [], [], []
            for at, ids in enumerate(encoder.encode(batch.column("text"))):
                ids = np.append(ids, np.uint32(END)).astype(np.int32)
                for start, length in cuts(len(ids), limit):
                    owners.append(at)
                    starts.append(start)
                    parts.append(ids[start : start + length])
            return pa.record_batch(
                [batch.column("doc_id").take(pa.array(owners, pa.int64())), pa.array(starts, pa.int64()), pa.array(parts, pa.list_(pa.int32()))],
                names=["doc_id", "start", "ids"],
            )

        return step

    cut = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, start long, ids array<int>")
    return (
        packed.join(cut, ["doc_id", "start"]).groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
        .select("sequence_id", F.flatten("p.ids").alias("ids"))
    )
