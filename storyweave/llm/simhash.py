"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has bit b set if over half of the document's shingle hashes have
it set. Shingles are ``words`` consecutive words (fewer: the whole sequence),
repeats included; a shingle's hash is its XXH64 with seed 42. Two fingerprints
link if at most ``max_bits`` bits differ; a document's component is the
smallest doc_id that links lead to.

Candidates. A fingerprint is a ring of ``segments`` = 2k+1 runs of bits. If two
differ in at most ``max_bits`` bits in all, some start on the ring exists from
which every chain of consecutive segments stays within its proportional budget,
length * max_bits / segments. Chains whose budget is under one bit make up the
join key: those segments are equal. The longer chains are tested, one after the
other, before the full distance.

Groups. Exact copies collapse to one row before anything is compared. A key
that many fingerprints share is cut into tiles, and two tiles meet in one task;
a task answers with one link per fingerprint to its group's representative,
never with pairs.

Defined cases: a null text, like one without words, has fingerprint zero, which
links like any other; a null doc_id keeps its fingerprint but lends its
component no name, and a component of null ids only has a null name; repeated
rows share fingerprint and component. Extra columns are ignored by
``components`` and carried by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyweave.llm.batches import Step, free_name, map_batches, utf8
from storyweave.operators.stories import connected_components
from storyweave.session import cut_lineage

SEED = 42


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """bytes.lower and bytes.split know ASCII letters and white space only."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    shingles = map(b" ".join, zip(*(parts[k:] for k in range(words)), strict=False)) if len(parts) >= words else iter([b" ".join(parts)])
    count = max(len(parts) - words + 1, 1)
    # in blocks, so that a text of any length takes little memory
    totals = np.zeros(64, np.int64)
    done = 0
    while done < count:
        size = min(count - done, 65536)
        totals += ones(shingles, size)
        done += size
    return majority(totals, count)


def ones(items: Iterable[bytes], size: int) -> np.ndarray:
    """How many of the next ``size`` items' hashes have each bit set, highest bit first."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, items, repeat(SEED, size)), np.uint64, size)
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(size, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(totals: np.ndarray, count: int) -> int:
    return int.from_bytes(np.packbits(totals * 2 > count).tobytes(), "big")


def word_fingerprint(text: bytes | None) -> int:
    """As ``fingerprint`` by single words, each distinct word once. A changed
    word breaks as many shingles as they have words, but one word only."""
    words = set((text or b"").lower().split())
    items, totals = iter(words), np.zeros(64, np.int64)
    for done in range(0, len(words), 65536):
        totals += ones(items, min(len(words) - done, 65536))
    return majority(totals, len(words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def make() -> Step:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = np.array([fingerprint(t, words) for t in utf8(batch.column("text"))], np.uint64).view(np.int64)
            return pa.record_batch([batch.column("doc_id"), pa.array(values)], names=["doc_id", "fp"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, fp long")


def ring(segments: int) -> list[int]:
    """Segment borders of 64 bits."""
    return [64 * k // segments for k in range(segments + 1)]


def chain_masks(segments: int, max_bits: int) -> list[list[tuple[int, int]]]:
    """Per start on the ring: (mask of the chain, bits it may differ in) for
    every chain length. Budgets are whole bits, so they are rounded down."""
    edges = ring(segments)
    masks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(segments)]
    out = []
    for start in range(segments):
        mask, chain = 0, []
        for length in range(1, segments + 1):
            mask |= masks[(start + length - 1) % segments]
            chain.append((mask, length * max_bits // segments))
        out.append(chain)
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def near(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs pass all chains; the last chain is the full distance."""
    left = a ^ b
    alive = np.arange(len(left))
    for at, (mask, allowed) in enumerate(chain):
        # a shorter chain of the same budget is implied by the longer one
        if allowed == 0 or (at + 1 < len(chain) and chain[at + 1][1] == allowed):
            continue
        ok = np.bitwise_count(left & np.uint64(mask)) <= allowed
        alive, left = alive[ok], left[ok]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def group_links(group: np.ndarray, start: np.ndarray, fps: np.ndarray, chains: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal ``group``: every fingerprint that is
    linked to others points at the first one its links lead to."""
    label = np.arange(len(fps))
    changed = True
    while changed:
        changed = False
        rows = np.arange(len(fps) - 1)
        shift = 1
        while len(rows := rows[rows + shift < len(fps)]) and len(rows := rows[group[rows] == group[rows + shift]]):
            # pairs that already share a label need no test
            open_ = rows[label[rows] != label[rows + shift]]
            for s in np.unique(start[open_]):
                mine = open_[start[open_] == s]
                linked = mine[near(fps[mine], fps[mine + shift], chains[s])]
                if len(linked):
                    low = np.minimum(label[linked], label[linked + shift])
                    np.minimum.at(label, label[linked], low)
                    np.minimum.at(label, label[linked + shift], low)
                    np.minimum.at(label, linked, low)
                    np.minimum.at(label, linked + shift, low)
                    changed = True
            shift += 1
        while (step := label[label] != label).any():
            label = np.where(step, label[label], label)
    child = np.flatnonzero(label != np.arange(len(fps)))
    return fps[child], fps[label[child]]


def links(distinct: DataFrame, max_bits: int = 2, segments: int = 5, tile_rows: int = 2048) -> DataFrame:
    """(i, j) fingerprints whose links connect exactly what all links within
    ``max_bits`` connect. ``distinct`` holds each fingerprint once, as fp."""
    chains = chain_masks(segments, max_bits)
    equal = [[mask for mask, allowed in chain if allowed == 0] for chain in chains]
    if not all(equal):
        raise ValueError("more segments are needed: a chain of one segment has to be equal")
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(s).alias("s"), F.col("fp").bitwiseAND(F.lit(_signed(masks[-1]))).alias("key"))
        for s, masks in enumerate(equal)
    ])).alias("k")).select("fp", "k.s", "k.key")
    shared = (
        keyed.groupBy("s", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        .select("s", "key", F.ceil(F.col("n") / tile_rows).cast("int").alias("tiles"))
    )
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiled = (
        keyed.join(shared, ["s", "key"]).withColumn("t", mine)
        .withColumn("u", F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(
            F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: x != F.col("t")))))
        .select("s", "key", F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b"), "fp")
    )
    dealt = tiled.repartition("s", "key", "a", "b").sortWithinPartitions("s", "key", "a", "b", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # whole groups only: the last one of a batch waits for the next batch
        held = None
        for batch in batches:
            arrays = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("s", "key", "a", "b", "fp")]
            if held is not None:
                arrays = [np.concatenate(x) for x in zip(held, arrays, strict=True)]
            same = np.logical_and.reduce([x[1:] == x[:-1] for x in arrays[:4]]) if len(arrays[0]) > 1 else np.zeros(0, bool)
            cuts = np.flatnonzero(~same) + 1
            last = cuts[-1] if len(cuts) else 0
            if last:
                yield answer([x[:last] for x in arrays])
            held = [x[last:] for x in arrays]
        if held is not None:
            yield answer(held)

    def answer(arrays: list[np.ndarray]) -> pa.RecordBatch:
        new = np.logical_or.reduce([x[1:] != x[:-1] for x in arrays[:4]])
        group = np.concatenate(([0], np.cumsum(new)))
        i, j = group_links(group, arrays[0], arrays[4].view(np.uint64), chains)
        return pa.record_batch([pa.array(i.view(np.int64)), pa.array(j.view(np.int64))], names=["i", "j"])

    return dealt.mapInArrow(run, "i long, j long").distinct()


def components(docs: DataFrame, words: int = 3, max_bits: int = 2, segments: int = 5, tile_rows: int = 2048) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    prints = cut_lineage(fingerprints(docs, words))
    named = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    edges = cut_lineage(links(named.select("fp"), max_bits, segments, tile_rows))
    roots = connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    joined = named.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = joined.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def digest(parts: DataFrame) -> DataFrame:
    return parts.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_rows(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """One row of each component, all columns kept. ``parts`` holds doc_id,
    text_hash and root of every row. The row with the smallest doc_id stays, of
    those with that id the one with the least hash of its text; rows of one
    doc_id in several components stand for each of them. Rows without a doc_id
    can't be told apart and stay."""
    columns = docs.columns
    at_id, at_hash, own, place = (free_name(n, columns) for n in ("kept_id", "kept_hash", "text_hash", "place"))
    kept = (
        parts.where(F.col("doc_id").isNotNull()).groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
        .select(F.col("k.doc_id").alias(at_id), F.col("k.text_hash").alias(at_hash))
    )
    found = docs.withColumn(own, F.xxhash64("text")).join(kept, (F.col("doc_id") == F.col(at_id)) & (F.col(own) == F.col(at_hash)))
    chosen = found.withColumn(place, F.row_number().over(W.partitionBy(at_id, at_hash).orderBy(F.length("text"))))
    return chosen.where(F.col(place) == 1).select(*columns).unionByName(docs.where(F.col("doc_id").isNull()))


def keep_one(docs: DataFrame, words: int = 3, max_bits: int = 2, segments: int = 5, tile_rows: int = 2048) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, all
    columns kept. Rows that share a doc_id count as one document, of which the
    row with the least hash of its text stays; rows without a doc_id can't be
    told apart and stay."""
    columns = docs.columns
    at_id, place = (free_name(n, columns) for n in ("kept_id", "place"))
    kept = (
        components(docs, words, max_bits, segments, tile_rows)
        .where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(at_id)).distinct()
    )
    order = W.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.length("text"))
    chosen = docs.join(kept, F.col("doc_id") == F.col(at_id)).withColumn(place, F.row_number().over(order))
    return chosen.where(F.col(place) == 1).select(*columns).unionByName(docs.where(F.col("doc_id").isNull()))
