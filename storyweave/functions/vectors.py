"""Vector and similarity expressions (Column -> Column)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyweave.functions.binding import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


@F.arrow_udf(T.DoubleType())
def _batch_dot(a: pa.Array, b: pa.Array) -> pa.Array:
    out = np.full(len(a), np.nan)
    both = np.asarray(pc.and_(pc.is_valid(a), pc.is_valid(b)).to_numpy(zero_copy_only=False), dtype=bool)
    sizes = [pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False) for x in (a, b)]
    both &= sizes[0] == sizes[1]
    for dims in np.unique(sizes[0][both]):
        rows = np.flatnonzero(both & (sizes[0] == dims))
        m = [np.asarray(x.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)
             for x in (a, b)]
        out[rows] = np.einsum("ij,ij->i", *m)
    return pa.array(out, mask=~both)


def batch_dot(a: Column, b: Column) -> Column:
    """dot for hot paths: whole Arrow batches in one numpy product. NULL when
    a side is missing or the lengths differ."""
    return _batch_dot(a.cast("array<double>"), b.cast("array<double>"))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite_vector(vector: Column) -> Column:
    return F.forall(vector, lambda x: is_finite(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Double-precision cosine in [-1, 1]. A zero or non-finite vector is
    dissimilar to everything: NaN must be caught before any comparison, as
    Spark orders NaN above every number."""
    return let(
        F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))),
        lambda v: F.when(is_finite(v), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))).otherwise(F.lit(0.0)),
    )


def cosine_to_unit(vector: Column, unit: Column) -> Column:
    """Cosine against a vector already of length one."""
    # any NaN or infinity in the vector makes its norm non-finite
    return let(
        F.struct(dot(vector, unit).alias("d"), dot(vector, vector).alias("n")),
        lambda s: F.when(is_finite(s["n"]) & (s["n"] > 0), s["d"] / F.sqrt(F.nullif(s["n"], F.lit(0.0)))).otherwise(F.lit(0.0)),
    )


def unit(vector: Column) -> Column:
    return let(
        F.sqrt(dot(vector, vector)),
        lambda norm: F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(
            vector.cast("array<double>")),
    )


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")),
        F.lit(0.0),
    )


def hours_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / F.lit(3.6e9)


def time_proximity(a: Column, b: Column, window_hours: float) -> Column:
    """1 for the same instant, 0 at the window edge and beyond, NULL when a
    side is undated (greatest alone would skip the NULL and give 0)."""
    left = 1.0 - hours_between(a, b) / F.lit(float(window_hours))
    return F.when(left.isNotNull(), F.greatest(F.lit(0.0), left))


def pair_score(
    cos: Column, entities: Column, links: Column, left_time: Column, right_time: Column,
    *, cosine_weight: float = 0.6, entity_weight: float = 0.4, window_hours: float = 48.0,
) -> Column:
    """Blend of the four signals; time decays the score only when both sides
    are dated."""
    if abs(cosine_weight + entity_weight - 1.0) > 1e-9:
        raise ValueError("cosine_weight and entity_weight must sum to 1")
    blend = cosine_weight * cos + entity_weight * entities
    capped = F.least(F.lit(1.0), blend + 0.10 * links)
    return capped * F.coalesce(time_proximity(left_time, right_time, window_hours), F.lit(1.0))


def threshold_for(model_id: Column, overrides: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for name, value in overrides.items():
        out = F.when(model_id == name, F.lit(float(value))).otherwise(out)
    return out


def adjudicate(score: Column, threshold: Column, band: float = 0.06) -> Column:
    """Raw verdict with its uncertain band; AMBIGUOUS never merges."""
    return (
        F.when(score >= threshold + band / 2, F.lit("same"))
        .when(score <= threshold - band / 2, F.lit("different"))
        .otherwise(F.lit("ambiguous"))
    )


def mean_vectors(df: DataFrame, key: str, vector: str, out: str = "centroid") -> DataFrame:
    """Element-wise mean per key, stored as float. The summariser keeps one
    running mean per key and merges partial ones before the shuffle."""
    return (
        df.where(F.col(vector).isNotNull())
        .groupBy(key)
        .agg(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("m"))
        .select(key, vector_to_array("m").cast("array<float>").alias(out))
    )


def unit_mean_centroid(df: DataFrame, vector: str, out: str = "centroid") -> DataFrame:
    """One row: mean of the unit vectors, scaled back to length one."""
    units = df.select(array_to_vector(unit(F.col(vector)).cast("array<double>")).alias("u"))
    mean = units.agg(Summarizer.mean(F.col("u")).alias("m"))
    return mean.select(unit(vector_to_array("m")).alias(out))


def taste_direction(positive: Column, negative: Column) -> Column:
    """positive - negative of two unit centroids. The fit of a unit vector is
    its dot product with this direction, one product instead of two cosines."""
    return (
        F.when(negative.isNull(), positive)
        .when(positive.isNull(), F.transform(negative, lambda x: -x))
        .otherwise(F.zip_with(positive, negative, lambda x, y: x - y))
    )
