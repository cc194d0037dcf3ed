"""Bounds on cosines between tiles of vectors, by angles to a few pivots.

Angles between unit vectors obey the triangle inequality. A tile keeps, for
every pivot, the least and the largest angle of its rows; two tiles whose ranges
lie apart for some pivot are at least that far apart, so no pair of theirs has a
larger cosine. Rows are dealt to tiles by their nearest pivot, so that the
ranges are narrow; a group gets as many pivots as it needs tiles, and rows near
one pivot, however many, are salted further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Added to a bound so that rounding never drops a pair.
SLACK = 1e-6

Pivots = dict[int, np.ndarray]


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows have a direction at all."""
    with np.errstate(all="ignore"):
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        good = np.isfinite(norms) & (norms > 0)
        return np.where(good[:, None], vectors / np.where(good, norms, 1.0)[:, None], 0.0), good


def choose(rows: DataFrame, row_id: str, vector: str, most: int = 32) -> Pivots:
    """At most ``most`` unit vectors for each length of vectors, far from one
    another, out of a sample of 16 times as many rows that comes to the driver."""
    sample = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(row_id)).limit(16 * most).select(vector).collect()
    out: Pivots = {}
    for dims in {len(r[0]) for r in sample}:
        of_length = np.array([[np.nan if x is None else x for x in r[0]] for r in sample if len(r[0]) == dims], np.float64).reshape(-1, dims)
        vectors, good = unit(of_length)
        vectors = vectors[good]
        chosen: list[int] = []
        nearest = np.full(len(vectors), np.inf)
        while len(chosen) < min(most, len(vectors)):
            at = int(np.argmax(nearest)) if chosen else 0
            if nearest[at] < 1e-9:
                break
            chosen.append(at)
            nearest = np.minimum(nearest, 1.0 - vectors @ vectors[at])
        out[dims] = vectors[chosen]
    return out


def _angles(column: pa.Array, pivots: Pivots, dims: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles to the pivots, padded to ``most``; rows without a direction are marked."""
    vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    vectors, good = unit(vectors)
    own = pivots.get(dims, np.zeros((0, dims)))
    angles = np.zeros((len(vectors), most))
    angles[:, : len(own)] = np.arccos(np.clip(vectors @ own.T, -1.0, 1.0))
    return angles, good


def _by_length(batch: pa.RecordBatch, vector: str) -> Iterator[tuple[int, np.ndarray]]:
    lengths = batch.column(vector).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for dims in np.unique(lengths).tolist():
        if dims >= 0:
            yield dims, np.flatnonzero(lengths == dims)


def nearest(df: DataFrame, vector: str, limit: str, pivots: Pivots) -> DataFrame:
    """Add ``pivot``: the nearest of the first ``limit`` pivots, 0 without a direction."""
    most = max([1, *map(len, pivots.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int32)
            limits = batch.column(limit).to_numpy(zero_copy_only=False)
            for dims, at in _by_length(batch, vector):
                if not len(pivots.get(dims, ())):
                    continue
                angles, good = _angles(batch.column(vector).take(pa.array(at)), pivots, dims, most)
                angles[np.arange(most)[None, :] >= np.minimum(np.maximum(limits[at], 1), len(pivots[dims]))[:, None]] = np.inf
                out[at] = np.where(good, angles.argmin(axis=1), 0)
            yield pa.record_batch([*batch.columns, pa.array(out)], names=[*batch.schema.names, "pivot"])

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{fields}, pivot int")


def ranges(tiled: DataFrame, vector: str, pivots: Pivots) -> DataFrame:
    """tile, lo, hi: the least and largest angle of a tile's rows to every pivot."""
    most = max([1, *map(len, pivots.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("tile").to_numpy(zero_copy_only=False)
            for dims, at in _by_length(batch, vector):
                angles, good = _angles(batch.column(vector).take(pa.array(at)), pivots, dims, most)
                # what has no direction, like a pivot that isn't there, bounds nothing
                known = good[:, None] & (np.arange(most) < len(pivots.get(dims, ())))[None, :]
                low, high = np.where(known, angles, 0.0), np.where(known, angles, np.pi)
                tiles, owner = np.unique(names[at], return_inverse=True)
                lo, hi = np.full((len(tiles), most), np.pi), np.zeros((len(tiles), most))
                np.minimum.at(lo, owner, low)
                np.maximum.at(hi, owner, high)
                yield pa.record_batch(
                    [pa.array(tiles.astype(object), pa.string()), pa.array(list(lo), pa.list_(pa.float64())), pa.array(list(hi), pa.list_(pa.float64()))],
                    names=["tile", "lo", "hi"],
                )

    parts = tiled.select("tile", vector).mapInArrow(run, "tile string, lo array<double>, hi array<double>")
    each = parts.select("tile", F.posexplode(F.arrays_zip("lo", "hi")).alias("p", "r"))
    return (
        each.groupBy("tile", "p").agg(F.min("r.lo").alias("lo"), F.max("r.hi").alias("hi"))
        .groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("p", "lo", "hi"))).alias("r"))
        .select("tile", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))
    )


def bounded(stats: DataFrame, tiled: DataFrame, vector: str, pivots: Pivots) -> DataFrame:
    """Add the angles ``lo`` and ``hi`` of each tile to its row of ``stats``; without pivots nothing is bounded."""
    if pivots:
        return stats.join(ranges(tiled, vector, pivots), "tile")
    return stats.withColumns({"lo": F.array(F.lit(0.0)), "hi": F.array(F.lit(float(np.pi)))})


def most_cosine(a: str, b: str) -> Column:
    """No pair of rows of the tiles ``a`` and ``b`` has a larger cosine."""
    apart = F.zip_with(
        F.zip_with(F.col(f"{a}.lo"), F.col(f"{b}.hi"), lambda x, y: x - y),
        F.zip_with(F.col(f"{b}.lo"), F.col(f"{a}.hi"), lambda x, y: x - y), lambda x, y: F.greatest(x, y),
    )
    return F.cos(F.greatest(F.array_max(apart), F.lit(0.0))) + SLACK


def least_cosine(a: str, b: str) -> Column:
    """No pair of rows of the tiles has a smaller cosine."""
    widest = F.array_min(F.zip_with(F.col(f"{a}.hi"), F.col(f"{b}.hi"), lambda x, y: x + y))
    return F.cos(F.least(widest, F.lit(float(np.pi)))) - SLACK
