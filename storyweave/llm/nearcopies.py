"""Near copies by exact Jaccard similarity of word shingles.

A document's set holds the XXH64, seed 42, of each run of ``words`` words
(fewer: the whole sequence). Two sets link if they share at least ``similarity``
of their union; a component is what links lead to.

Candidates. Equal sets collapse to one first. The SimHash fingerprints of the
sets' distinct words go through the pigeonring of ``simhash``: sets whose
fingerprints are linked within ``MAX_BITS`` bits form a group. A wider ring has
keys of few bits, on which most sets meet, so sets that the ring leaves apart
have a second way: ``BANDS`` keys of ``ROWS`` minima each are made of a set; two
sets of similarity s share no key with probability (1 - s^ROWS)^BANDS, 4e-9 at
0.8. A key whose sets all lie in one group of the ring is passed over.
Sets of one group, or that share a key, are compared by sketches,
one byte of ``SKETCH`` minima each: those of similarity 0.8 agree in fewer than
``AGREE`` of them with a probability of 3e-9. So a clump of texts that have
only boilerplate in common falls apart here, before whole texts are moved. Keys
with the same members are compared once, and a key of any size is cut into tiles.
Confirmation. Components of sketch links are cut into tiles of bounded rows and
bytes, two tiles meet in one task, and the task compares whole sets,
leaving out pairs that other links connect already, and answers with links.

Defined cases: a null text, like one without words, has the empty set, which is
a copy of itself only; a null doc_id links like any other, but doesn't stand for
its component; repeated rows are equal sets.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweave.llm.batches import Step, map_batches, utf8
from storyweave.llm.simhash import SEED, keep_rows, links, word_fingerprint
from storyweave.operators.stories import connected_components
from storyweave.session import cut_lineage

MAX_BITS, SEGMENTS = 5, 11
BANDS, ROWS = 64, 6
SKETCH, AGREE = 96, 52
_DRAW = np.random.default_rng(SEED)
_FACTORS = _DRAW.integers(0, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _DRAW.integers(0, 2**63, BANDS * ROWS).astype(np.uint64)
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_BAND = np.arange(BANDS, dtype=np.uint64)


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes; words as in ``simhash.fingerprint``."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(parts[k:] for k in range(words)), strict=False)) if len(parts) >= words else iter([b" ".join(parts)])
    count = max(len(parts) - words + 1, 1)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED, count)), np.uint64, count))


def bands(own: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The keys and the sketch of a set that isn't empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 512):
        np.minimum(least, (_FACTORS[:, None] * own[None, at : at + 512] + _SHIFTS[:, None]).min(axis=1), out=least)
    keys = _BAND
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * _FOLD
        keys ^= keys >> np.uint64(29)
    # every fourth minimum, so that a sketch draws on all bands
    return keys.view(np.int64), (least[:: len(least) // SKETCH] >> np.uint64(17)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, text_hash, size in bytes, node (a hash of the set, 0 if it is empty), fp of its words, keys and sketch of every row."""

    def make() -> Step:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = utf8(batch.column("text"))
            found = [shingles(t, words) for t in texts]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) if len(x) else 0 for x in found], np.uint64).view(np.int64)
            prints = np.array([word_fingerprint(t) for t in texts], np.uint64).view(np.int64)
            made = [bands(x) if len(x) else ([], b"") for x in found]
            return pa.record_batch(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(nodes),
                 pa.array(prints), pa.array([k for k, _ in made], pa.list_(pa.int64())), pa.array([m for _, m in made], pa.binary())],
                names=["doc_id", "text_hash", "size", "node", "fp", "keys", "sketch"])

        return step

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return map_batches(rows, make, "doc_id long, text_hash long, size long, node long, fp long, keys array<long>, sketch binary")


def set_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect exactly what all pairs of at least ``similarity`` connect."""
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    mark = np.zeros(len(distinct), bool)
    label = np.arange(len(sets))
    out = []
    for i in range(len(sets) - 1):
        # pairs that already share a label, or whose sizes rule it out, need no test
        open_ = (label != label[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9)
        open_[: i + 1] = False
        if not open_.any():
            continue
        own = codes[ends[i] - sizes[i] : ends[i]]
        mark[own] = True
        at = np.flatnonzero(open_[owner])
        common = np.bincount(owner[at[mark[codes[at]]]], minlength=len(sets))
        mark[own] = False
        linked = np.flatnonzero(open_ & (common >= similarity * (sizes + sizes[i] - common) - 1e-9))
        if len(linked):
            out += [(i, j) for j in linked.tolist()]
            label[np.isin(label, label[linked])] = label[i]
    return out


def sketch_links(rows: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all pairs of sketches with ``AGREE`` equal bytes connect."""
    label = np.arange(len(rows))
    out = []
    for i in range(len(rows) - 1):
        at = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if not len(at):
            continue
        linked = at[(rows[at] == rows[i]).sum(axis=1) >= AGREE]
        if len(linked):
            out += [(i, j) for j in linked.tolist()]
            label[np.isin(label, label[linked])] = label[i]
    return out


def tiled(rows: DataFrame, group: str, sizes: DataFrame) -> DataFrame:
    """Each row once for every pair of tiles, ``a`` and ``b``, of its group that it is to be seen in."""
    return (
        rows.join(sizes, group).withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        .withColumn("u", F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(
            F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: x != F.col("t")))))
        .withColumn("a", F.least("t", "u")).withColumn("b", F.greatest("t", "u")).drop("t", "u", "tiles")
    )


def linked(rows: DataFrame, group: list[str], column: str, find: Callable[[pa.Array], list[tuple[int, int]]]) -> DataFrame:
    """i and j of the links that ``find`` gives for the distinct nodes of each group."""

    def compare(table: pa.Table) -> pa.Table:
        nodes, at = np.unique(table.column("node").to_numpy(), return_index=True)
        found = find(table.column(column).take(pa.array(at)).combine_chunks())
        i, j = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"i": pa.array(nodes[i]), "j": pa.array(nodes[j])})

    return rows.select("node", *group, column).groupBy(*group).applyInArrow(compare, "i long, j long").distinct()


def ring_groups(named: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """node and ring, equal for sets that links of fingerprints within ``max_bits`` lead to."""
    prints = named.select("node", "fp")
    edges = cut_lineage(links(prints.select("fp").distinct(), max_bits, segments))
    roots = connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    return prints.join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("ring"))


def clusters_of(named: DataFrame, key_rows: int = 4096) -> DataFrame:
    """node and cluster of the sets that a sketch links to another one."""
    rings = cut_lineage(ring_groups(named))
    grouped = rings.select("node", F.col("ring").alias("key"))
    crowds = grouped.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # one exchange of (key, node) serves the count of a key's sets and their meeting
    keyed = named.select("node", F.explode("keys").alias("key")).where("key IS NOT NULL AND node IS NOT NULL").repartition("key")
    shared = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last"), F.bit_xor(F.xxhash64("node")).alias("all")
    ).where("n > 1")
    # keys with the same members tell the same
    once = shared.groupBy("n", "first", "last", "all").agg(F.min("key").alias("key"))
    # the sets of one group of the ring meet there
    members = cut_lineage(keyed.join(once.select("key"), "key").join(rings, "node"))
    apart = members.groupBy("key").agg(F.count("*").alias("n"), F.min("ring").alias("low"), F.max("ring").alias("high")).where("low < high")

    def meeting(rows: DataFrame, counts: DataFrame) -> DataFrame:
        return tiled(rows.select("node", "key"), "key", counts.select("key", F.ceil(F.col("n") / key_rows).cast("int").alias("tiles")))

    rows = meeting(grouped, crowds).unionByName(meeting(members, apart)).join(named.select("node", "sketch"), "node")
    width = SKETCH

    def find(sketches: pa.Array) -> list[tuple[int, int]]:
        return sketch_links(np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, width))

    edges = cut_lineage(linked(rows, ["key", "a", "b"], "sketch", find))
    return cut_lineage(connected_components(edges).withColumnRenamed("component", "cluster"))


def components(docs: DataFrame, words: int = 5, similarity: float = 0.8, tile_rows: int = 512, tile_bytes: int = 8_000_000) -> DataFrame:
    """doc_id, text_hash and root (equal within a component) of every row."""
    prints = cut_lineage(sketches(docs, words))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("one")
    named = cut_lineage(prints.where(F.size("keys") > 0).groupBy("node").agg(
        one, F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.max("size").alias("size")))
    clusters = clusters_of(named).join(named.select("node", "size", "one.doc_id", "one.text_hash"), "node")
    sizes = clusters.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / tile_rows), F.ceil(F.sum("size") / tile_bytes)).cast("int").alias("tiles"))
    meeting = tiled(clusters.select("node", "cluster"), "cluster", sizes)
    # one row speaks for all that have its set
    speakers = clusters.select(
        "node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_hash", F.xxhash64("text"))
    texts = source.join(speakers, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")

    def find(column: pa.Array) -> list[tuple[int, int]]:
        return set_links([shingles(t, words) for t in utf8(column)], similarity)

    confirmed = cut_lineage(linked(texts.join(meeting, "node"), ["cluster", "a", "b"], "text", find))
    roots = connected_components(confirmed).select("node", F.col("component").alias("root"))
    return prints.select("doc_id", "text_hash", "node").join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, tile_rows: int = 512) -> DataFrame:
    """One document of each component, as ``simhash.keep_rows`` chooses it."""
    return keep_rows(docs, components(docs, words, similarity, tile_rows))
