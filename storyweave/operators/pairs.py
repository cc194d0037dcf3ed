"""Best-match search over time windows.

Every new item looks for its best partner among items of the same model that
are close in time, or undated. The work is cut into bounded tiles: a group
(model, time slab) of any size is spread over as many tiles as it needs, by the
direction of the vectors; two tiles meet in one task, and that task returns at
most one row per item. Pairs are never materialised as rows.

Two tiles meet only if one of their pairs can count. Angles to pivots bound the
cosine of all their pairs, and set sizes and times bound the rest of the score.
Where the cosine is too small for a match without a large overlap, the tiles do
not meet either: such pairs are found by an exact set-similarity join, in which
items meet per entity of a prefix of their rarest ones.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyweave.functions import vectors
from storyweave.operators import kernels, pivots
from storyweave.operators.stories import connected_components
from storyweave.session import cut_lineage, shuffle_partitions

HOUR_US = 3_600_000_000
SCORE_DIGITS = kernels.SCORE_DIGITS

#: Rows of the largest tile of links that is made unasked.
MOST_ROWS = 1 << 15

#: Numbers in the vectors of the largest tile that is made unasked, 16 MB in single precision.
MOST_NUMBERS = 1 << 22

#: Signals that calibration compares: the weights of cosine and entity overlap.
SIGNALS = {"cosine": (1.0, 0.0), "entities": (0.0, 1.0), "blend": (0.6, 0.4)}


def with_tiles(df: DataFrame, group: list[str], row_id: str, tile_rows: int) -> DataFrame:
    """Add ``tile``: the group key plus a salt that keeps tiles near
    ``tile_rows`` rows however large the group is, and ``tiles``, their number."""
    sizes = df.groupBy(*group).agg(F.ceil(F.count("*") / tile_rows).alias("_tiles"))
    on = [F.col(f"d.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    salted = df.alias("d").join(sizes.alias("s"), condition).select("d.*", "s._tiles")
    key = [F.coalesce(F.col(g).cast("string"), F.lit("-")) for g in group]
    return salted.withColumn(
        "tile", F.concat_ws("|", *key, F.pmod(F.xxhash64(row_id), F.col("_tiles")).cast("string"))
    ).withColumnRenamed("_tiles", "tiles")


def with_pivot_tiles(
    df: DataFrame, group: list[str], row_id: str, vector: str, tile_rows: int | None, parts: int = 4, least: int = 1024
) -> tuple[DataFrame, pivots.Pivots]:
    """Tiles as of ``with_tiles``, whose rows point in a like direction where a
    group has several. Where each group is one tile, there is nothing to choose.

    Without ``tile_rows`` a tile holds what makes ``parts`` of the largest group or
    16 of all rows, whatever is more, of at least ``least`` rows and no more than
    ``MOST_NUMBERS``: a row travels once for each tile that its own meets, so that
    what is shuffled grows with the rows and not with their square."""
    df = cut_lineage(df)
    sizes = df.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.size(vector)).alias("numbers"))
    largest, every, numbers = (x or 0 for x in sizes.agg(F.max("n"), F.sum("n"), F.sum("numbers")).first())
    if tile_rows is None:
        most = MOST_NUMBERS * every // max(1, every, numbers)
        tile_rows = max(least, min(most, max(-(-largest // parts), -(-every // 16))))
    if largest <= tile_rows:
        key = [F.coalesce(F.col(g).cast("string"), F.lit("-")) for g in group]
        return df.withColumns({"pivot": F.lit(0), "tile": F.concat_ws("|", *key), "tiles": F.lit(1).cast("long")}), {}
    chosen = pivots.choose(df, row_id, vector)
    sizes = with_tiles(df, group, row_id, tile_rows).drop("tile").withColumn("tiles", F.col("tiles").cast("int"))
    placed = pivots.nearest(sizes, vector, "tiles", chosen).drop("tiles")
    return cut_lineage(with_tiles(placed, [*group, "pivot"], row_id, tile_rows)), chosen


def _meet(items: DataFrame, pairs: DataFrame, kernel: Callable, schema: str, arrow: bool = False) -> DataFrame:
    """Bring the rows of both tiles of every pair together in one task. A tile that meets itself travels once."""
    pairs = pairs.withColumn("pair", F.concat_ws(">", "left_tile", "right_tile"))
    left = items.join(pairs.select(F.col("left_tile").alias("tile"), "pair"), "tile")
    right = items.join(pairs.where("left_tile != right_tile").select(F.col("right_tile").alias("tile"), "pair"), "tile")
    right = right.toDF(*right.columns)  # fresh column ids: both sides stem from one table
    # a pair costs far more than its bytes suggest: a fixed number of partitions
    # keeps the runtime from merging them into a few tasks
    parts = shuffle_partitions(items.sparkSession)
    left, right = left.repartition(parts, "pair"), right.repartition(parts, "pair")
    met = left.groupBy("pair").cogroup(right.groupBy("pair"))

    # a tile of a pair is never empty, so nothing on the right says that both are one
    def both(left, right):
        return kernel(left, right if len(right) else left)

    return met.applyInArrow(both, schema) if arrow else met.applyInPandas(both, schema)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        cos = (a @ b.T) / np.sqrt(np.outer((a * a).sum(axis=1), (b * b).sum(axis=1)))
    return np.where(np.isfinite(cos), np.clip(cos, -1.0, 1.0), 0.0)


def _bitsets(sets: list[np.ndarray], shared: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), max(1, -(-len(shared) // 64)) * 64), dtype=np.uint8)
    for row, values in enumerate(sets):
        if len(values) and len(shared):
            at = np.searchsorted(shared, values)
            at[at == len(shared)] = 0
            out[row, at[shared[at] == values]] = 1
    return np.packbits(out, axis=1).view(np.uint64)


def _jaccards(a: list[np.ndarray], b: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Jaccard similarity of the chosen (row, col) pairs only."""
    size_a = np.array([len(x) for x in a])
    size_b = np.array([len(x) for x in b])
    flat = [np.unique(np.concatenate(x)) if x else np.empty(0, np.int64) for x in (a, b)]
    shared = np.intersect1d(*flat, assume_unique=True)
    bits_a, bits_b = _bitsets(a, shared), _bitsets(b, shared)
    common = np.empty(len(rows), dtype=np.int64)
    for start in range(0, len(rows), step):
        r, c = rows[start:start + step], cols[start:start + step]
        common[start:start + step] = np.bitwise_count(bits_a[r] & bits_b[c]).sum(axis=1)
    union = size_a[rows] + size_b[cols] - common
    return np.divide(common, union, out=np.zeros(len(rows)), where=union > 0)


def _match_plan(
    items: DataFrame, *, as_of: datetime | None, window_hours: float = 48.0, cosine_weight: float = 0.6, entity_weight: float = 0.4,
    merge_threshold: float = 0.50, merge_thresholds: dict[str, float] | None = None, band: float = 0.06, tile_rows: int | None = None,
) -> tuple[DataFrame, DataFrame, int]:
    """The tiled rows, the pairs of tiles with their ``work``, and the largest time between two dated rows that matter."""
    overrides = merge_thresholds or {}
    floor_of = [v - band / 2 for v in [merge_threshold, *overrides.values()]]
    reach_us = int(window_hours * HOUR_US * (1.0 - min(floor_of))) + 1
    ts = F.unix_micros("published_at")
    candidate = F.lit(True)
    if as_of is not None:
        candidate = F.col("published_at").isNull() | (ts >= F.unix_micros(F.lit(as_of)) - int(window_hours * HOUR_US))
    threshold = vectors.threshold_for(F.col("model_id"), overrides, merge_threshold)

    def hashed(column: str) -> Column:
        # 8-byte keys travel instead of strings; only equality is used
        return F.array_sort(F.array_distinct(F.transform(column, lambda e: F.xxhash64(e))))

    slim = (
        items.select(
            "item_id", "model_id", F.col("embedding").alias("vec"), ts.cast("double").alias("ts"),
            F.floor(ts / reach_us).alias("slab"), hashed("entities").alias("entities"),
            hashed("link_keys").alias("links"), "is_new", candidate.alias("is_candidate"),
            (threshold - band / 2).alias("floor"),
        )
        .where(F.col("is_new") | F.col("is_candidate"))
        .withColumn("dims", F.size("vec"))
    )
    window_us = window_hours * HOUR_US
    tiled, chosen = with_pivot_tiles(slim, ["model_id", "dims", "slab"], "item_id", "vec", tile_rows)
    planned = cut_lineage(_judged(
        _time_pairs(pivots.bounded(_match_stats(tiled), tiled, "vec", chosen), reach_us),
        cosine_weight, entity_weight, window_us,
    ))
    return tiled, planned, reach_us


#: Tile pairs of a smaller possible cosine than a match with this overlap of entities needs leave their pairs to the set join.
OVERLAP = kernels.OVERLAP


def _match_stats(tiled: DataFrame, *more: str) -> DataFrame:
    return tiled.groupBy("tile", "model_id", "dims", "slab", *more).agg(
        F.min("ts").alias("t0"), F.max("ts").alias("t1"),
        F.bool_or("is_new").alias("any_new"), F.bool_or("is_candidate").alias("any_candidate"),
        F.min("floor").alias("floor"), F.max(F.size("links")).alias("links"),
        F.min(F.size("entities")).alias("fewest"), F.max(F.size("entities")).alias("most"),
    )


def _judged(met: DataFrame, cosine_weight: float, entity_weight: float, window_us: float) -> DataFrame:
    """left_tile, right_tile and ``work``: what a pair of tiles needs, from bounds on all its pairs.
    `matrix`: they meet; `overlap`: only pairs with an overlap of ``OVERLAP`` or more can count; `none`."""
    gap = F.greatest(F.col("b.t0") - F.col("a.t1"), F.col("a.t0") - F.col("b.t1"), F.lit(0.0))
    # greatest() passes over nulls, so an undated side has no gap
    undated = F.col("a.slab").isNull() | F.col("b.slab").isNull()
    decay = F.when(undated, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - gap / window_us))
    cosine = cosine_weight * pivots.most_cosine("a", "b")
    overlap = F.least(F.col("a.most"), F.col("b.most")) / F.greatest(F.lit(1), F.col("a.fewest"), F.col("b.fewest"))
    link = F.when((F.col("a.links") > 0) & (F.col("b.links") > 0), 0.10).otherwise(0.0)
    floor = F.least("a.floor", "b.floor") - pivots.SLACK

    def reaches(entities: Column) -> Column:
        return F.least(F.lit(1.0), cosine + entity_weight * F.least(F.lit(1.0), entities) + link) * decay > floor

    work = F.when(~reaches(overlap), "none").when(reaches(F.least(overlap, F.lit(OVERLAP))), "matrix").otherwise("overlap")
    return met.select(F.col("a.tile").alias("left_tile"), F.col("b.tile").alias("right_tile"), work.alias("work"))


def match_work(items: DataFrame, **options) -> DataFrame:
    """How many pairs of tiles that are close in time ``best_matches`` multiplies, leaves to the set join, or drops: (work, pairs)."""
    return _match_plan(items, **options)[1].groupBy("work").agg(F.count("*").alias("pairs"))


def _prefixes(rows: DataFrame) -> DataFrame:
    """Rows once for each ``token`` of a prefix of their entities, rarest first: two sets with an
    overlap of ``OVERLAP`` or more have one of these in common."""
    tokens = rows.select("item_id", F.explode("entities").alias("token"))
    ordered = (
        tokens.join(tokens.groupBy("token").agg(F.count("*").alias("n")), "token")
        .groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("s"))
    )
    length = (F.size("s") - F.ceil(OVERLAP * F.size("s")) + 1).cast("int")
    prefix = ordered.select("item_id", F.explode(F.slice("s", F.lit(1), length)["token"]).alias("token"))
    return rows.join(prefix, "item_id")


def best_matches(
    items: DataFrame, *, as_of: datetime | None, window_hours: float = 48.0, cosine_weight: float = 0.6,
    entity_weight: float = 0.4, merge_threshold: float = 0.50, merge_thresholds: dict[str, float] | None = None,
    band: float = 0.06, tile_rows: int | None = None, adjudicator: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Best partner of every new item whose score can leave the DIFFERENT
    zone: (item_id, match_id, score, verdict).

    ``items`` holds item_id, model_id, embedding, published_at, entities,
    link_keys and is_new; rows that are not new already belong to a story. A
    dated candidate must lie inside the window before ``as_of``; with
    ``as_of=None`` that cut is left out, as in a replay of history.

    A score never exceeds its time factor, so only dated pairs closer than
    window * (1 - lowest threshold) can matter; that is the slab width, and
    such pairs lie in the same slab or in neighbouring ones.

    ``adjudicator`` (score, threshold) -> verdict replaces the threshold band.
    """
    decide = adjudicator or (lambda score, limit: vectors.adjudicate(score, limit, band))
    overrides = merge_thresholds or {}
    tiled, planned, reach_us = _match_plan(
        items, as_of=as_of, window_hours=window_hours, cosine_weight=cosine_weight, entity_weight=entity_weight,
        merge_threshold=merge_threshold, merge_thresholds=merge_thresholds, band=band, tile_rows=tile_rows,
    )
    kernel = kernels.best_match(cosine_weight, entity_weight, window_hours * HOUR_US)
    schema = "item_id long, score double, match_id long"
    found = _meet(tiled.drop("model_id", "dims", "slab", "pivot"), planned.where("work = 'matrix'"), kernel, schema, arrow=True)
    left_over = planned.where("work = 'overlap'")
    if left_over.limit(1).count():
        asked = left_over.select(F.explode(F.array("left_tile", "right_tile")).alias("tile")).distinct()
        rows = _prefixes(tiled.join(asked, "tile", "left_semi").drop("tile", "tiles", "pivot"))
        by_token = cut_lineage(with_tiles(rows, ["model_id", "dims", "token", "slab"], "item_id", tile_rows or 4096))
        met = _time_pairs(_match_stats(by_token, "token"), reach_us, "token")
        pairs = met.select(F.col("a.tile").alias("left_tile"), F.col("b.tile").alias("right_tile"))
        found = found.unionByName(_meet(by_token.drop("model_id", "dims", "slab", "token"), pairs, kernel, schema, arrow=True))
    best = found.groupBy("item_id").agg(
        F.max_by(F.struct("match_id", "score"), F.struct(F.col("score"), -F.col("match_id"))).alias("b")
    )
    return (
        best.select("item_id", "b.match_id", "b.score")
        .join(items.select("item_id", "model_id"), "item_id")
        .select(
            "item_id", "match_id", "score",
            decide(F.col("score"), vectors.threshold_for(F.col("model_id"), overrides, merge_threshold)).alias("verdict"),
        )
    )


def _time_pairs(stats: DataFrame, reach_us: int, *more: str) -> DataFrame:
    """Pairs of tiles, as a and b, that are close enough in time and agree in ``more``, from one row per tile."""
    useful = (
        (F.col("a.any_new") & F.col("b.any_candidate")) | (F.col("b.any_new") & F.col("a.any_candidate"))
    )
    same_kind = (F.col("a.model_id").eqNullSafe(F.col("b.model_id"))) & (F.col("a.dims") == F.col("b.dims"))
    for column in more:
        same_kind = same_kind & (F.col(f"a.{column}") == F.col(f"b.{column}"))
    columns = [F.struct(*(F.col(f"{side}.{c}") for c in stats.columns)).alias(side) for side in "ab"]
    dated = stats.where(F.col("slab").isNotNull())
    ahead = dated.withColumn("meets", F.explode(F.array(F.col("slab"), F.col("slab") + 1)))
    near = (F.col("b.t0") - F.col("a.t1") <= reach_us) & (F.col("a.t0") - F.col("b.t1") <= reach_us)
    both_dated = ahead.alias("a").join(
        dated.alias("b"),
        same_kind & (F.col("a.meets") == F.col("b.slab")) & near & useful
        & ((F.col("a.slab") < F.col("b.slab")) | (F.col("a.tile") <= F.col("b.tile"))),
    )
    undated = stats.where(F.col("slab").isNull())
    with_undated = undated.alias("a").join(
        stats.alias("b"),
        same_kind & useful & (F.col("b.slab").isNotNull() | (F.col("a.tile") <= F.col("b.tile"))),
    )
    return both_dated.select(*columns).unionByName(with_undated.select(*columns))


def _peak_rows(stories: DataFrame, days: int, wanted: DataFrame | None) -> tuple[DataFrame, int]:
    reach = days * 24 * HOUR_US
    ts = F.unix_micros("first_seen")
    slim = stories.where(F.col("centroid").isNotNull() & ts.isNotNull()).select(
        "story_id", F.col("centroid").alias("vec"), F.size("centroid").alias("dims"), ts.alias("ts"),
        F.floor(ts / reach).alias("slab"), F.lit(reach).alias("reach"),
    )
    if wanted is None:
        slim = slim.withColumn("asks", F.lit(True))
    else:
        marks = wanted.select("story_id").distinct().withColumn("asks", F.lit(True))
        slim = slim.join(marks, "story_id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    return slim, reach


def prior_peaks(
    stories: DataFrame, days: int = 90, tile_rows: int | None = None, wanted: DataFrame | None = None
) -> DataFrame:
    """(story_id, peak): highest cosine against any story first seen strictly
    earlier, at most ``days`` before. Stories without a prior are absent. Only
    the ``wanted`` stories ask when given; tile pairs nobody asks about drop."""
    slim, reach = _peak_rows(stories, days, wanted)
    tiled, chosen = with_pivot_tiles(slim, ["dims", "slab"], "story_id", "vec", tile_rows, parts=8)
    planned = _peak_pairs(tiled, chosen, reach)
    rows, schema = tiled.drop("dims", "slab", "pivot"), "story_id long, peak double"
    # tiles that may hold the closest vectors go first, and each tile with itself
    first = _meet(rows, planned.where("turn <= 2"), kernels.prior_peak, schema, arrow=True).groupBy("story_id").agg(F.max("peak").alias("peak"))
    later = planned.where("turn > 2")
    if not later.limit(1).count():
        return first
    first = cut_lineage(first)
    rest = _open_pairs(tiled, later, first)
    found = first.unionByName(_meet(rows, rest, kernels.prior_peak, schema, arrow=True))
    return found.groupBy("story_id").agg(F.max("peak").alias("peak"))


def _peak_pairs(tiled: DataFrame, chosen: pivots.Pivots, reach: int) -> DataFrame:
    """left_tile, right_tile, most (no cosine of theirs is larger) and turn: 1 for the
    pair of a tile that may hold its closest vectors, counting its own as the first."""
    stats = tiled.groupBy("tile", "dims", "slab").agg(
        F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.bool_or("asks").alias("asks")
    )
    stats = pivots.bounded(stats, tiled, "vec", chosen)
    ahead = stats.withColumn("meets", F.explode(F.array(F.col("slab"), F.col("slab") + 1)))
    pairs = ahead.alias("a").join(
        stats.alias("b"),
        (F.col("a.dims") == F.col("b.dims")) & (F.col("a.meets") == F.col("b.slab"))
        & (F.col("b.t0") - F.col("a.t1") <= reach) & (F.col("a.asks") | F.col("b.asks"))
        & ((F.col("a.slab") < F.col("b.slab")) | (F.col("a.tile") <= F.col("b.tile"))),
    ).select(F.col("a.tile").alias("left_tile"), F.col("b.tile").alias("right_tile"), pivots.most_cosine("a", "b").alias("most"))
    order = Window.partitionBy("left_tile").orderBy(F.desc(F.col("left_tile") == F.col("right_tile")), F.desc("most"), "right_tile")
    return cut_lineage(pairs.withColumn("turn", F.row_number().over(order)))


def _open_pairs(tiled: DataFrame, pairs: DataFrame, peaks: DataFrame) -> DataFrame:
    """The pairs of tiles in which a story that asks may find a larger peak than it has."""
    least = (
        tiled.where("asks").select("tile", "story_id").join(peaks, "story_id", "left")
        .groupBy("tile").agg(F.min(F.coalesce("peak", F.lit(-2.0))).alias("least"))
    )
    sides = [least.select(F.col("tile").alias(f"{s}_tile"), F.col("least").alias(f"{s}_least")) for s in ("left", "right")]
    bounded = pairs.join(sides[0], "left_tile", "left").join(sides[1], "right_tile", "left")
    # a tile in which nobody asks has no bound of its own
    return bounded.where((F.col("most") > F.col("left_least")) | (F.col("most") > F.col("right_least"))).select("left_tile", "right_tile")


def peak_work(stories: DataFrame, days: int = 90, tile_rows: int | None = None) -> DataFrame:
    """How many pairs of tiles ``prior_peaks`` multiplies and drops: (work, pairs)."""
    slim, reach = _peak_rows(stories, days, None)
    tiled, chosen = with_pivot_tiles(slim, ["dims", "slab"], "story_id", "vec", tile_rows, parts=8)
    planned = _peak_pairs(tiled, chosen, reach)
    first = _meet(tiled.drop("dims", "slab", "pivot"), planned.where("turn <= 2"), kernels.prior_peak, "story_id long, peak double", arrow=True)
    rest = _open_pairs(tiled, planned.where("turn > 2"), first.groupBy("story_id").agg(F.max("peak").alias("peak")))
    met = planned.where("turn <= 2").select("left_tile", "right_tile").unionByName(rest).withColumn("met", F.lit(True))
    return planned.join(met, ["left_tile", "right_tile"], "left").groupBy(
        F.when(F.col("met"), "matrix").otherwise("none").alias("work")).agg(F.count("*").alias("pairs"))


def _spanning_forest(weight: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest of a dense symmetric weight matrix;
    -inf marks a missing edge."""
    n = len(weight)
    best = np.full(n, -np.inf)
    link = np.full(n, -1)
    waiting = np.ones(n, dtype=bool)
    edges = []
    for _ in range(n):
        node = int(np.argmax(np.where(waiting, best, -np.inf)))
        if not waiting[node] or best[node] == -np.inf:
            node = int(np.argmax(waiting))  # nothing reachable: start the next tree
        elif link[node] >= 0:
            edges.append((int(link[node]), node))
        waiting[node] = False
        better = waiting & (weight[node] > best)
        best[better] = weight[node][better]
        link[better] = node
    return edges


def _signal_scores(left: pd.DataFrame, right: pd.DataFrame, signals: dict[str, tuple[float, float]]) -> dict[str, np.ndarray]:
    cos = _cosines(_matrix(left.vec), _matrix(right.vec))
    overlap = np.zeros(cos.shape)
    if any(weight for _, weight in signals.values()):
        rows, cols = np.indices(cos.shape).reshape(2, -1)
        overlap = _jaccards(left.entities.tolist(), right.entities.tolist(), rows, cols).reshape(cos.shape)
    return {name: np.round(a * cos + b * overlap, SCORE_DIGITS) for name, (a, b) in signals.items()}


def _forest_kernel(floor: float, signals: dict[str, tuple[float, float]]) -> Callable:
    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"signal": [], "i": [], "j": [], "score": [], "whole": []})
        whole = bool(left.tile.iloc[0] == right.tile.iloc[0] and left.tiles.iloc[0] == 1)
        found = [edges_of(left, right, score).assign(signal=name) for name, score in _signal_scores(left, right, signals).items()]
        return pd.concat(found, ignore_index=True).assign(whole=whole)[["signal", "i", "j", "score", "whole"]]

    def edges_of(left: pd.DataFrame, right: pd.DataFrame, cos: np.ndarray) -> pd.DataFrame:
        allowed = (cos >= floor) & (left.label.to_numpy()[:, None] == right.label.to_numpy()[None, :])
        if left.tile.iloc[0] == right.tile.iloc[0]:
            ids = left.row_id.to_numpy(np.int64)
            order = right.row_id.to_numpy(np.int64)
            place = np.argsort(order)[np.searchsorted(np.sort(order), ids)]
            weight = np.where(allowed, cos, -np.inf)[:, place]
            np.fill_diagonal(weight, -np.inf)
        else:
            ids = np.concatenate([left.row_id, right.row_id]).astype(np.int64)
            weight = np.full((len(ids), len(ids)), -np.inf)
            weight[:len(left), len(left):] = np.where(allowed, cos, -np.inf)
            weight[len(left):, :len(left)] = weight[:len(left), len(left):].T
        edges = _spanning_forest(weight)
        a, b = (np.array([e[k] for e in edges], dtype=np.int64) for k in (0, 1))
        return pd.DataFrame({
            "i": np.minimum(ids[a], ids[b]), "j": np.maximum(ids[a], ids[b]), "score": weight[a, b],
        })

    return kernel


def _all_tile_pairs(tiled: DataFrame) -> DataFrame:
    stats = tiled.groupBy("tile", "dims", "bucket").agg(F.count("*").alias("n"))
    return stats.alias("a").join(
        stats.alias("b"),
        (F.col("a.dims") == F.col("b.dims")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.tile") <= F.col("b.tile")),
    ).select(F.col("a.tile").alias("left_tile"), F.col("b.tile").alias("right_tile"))


def similarity_forest(
    df: DataFrame, row_id: str, vector: str, floor: float, label: str | None = None, tile_rows: int = 1024,
    entities: str | None = None, signals: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Edges (signal, i < j, score, whole) that connect the same rows as all
    pairs with a score >= ``floor`` do, at that and at every higher threshold;
    with ``label``, pairs inside one label only, and tiles are cut by label, so
    that tile pairs grow with the rows. The score is the cosine, or, for each of
    ``signals``, the weighted sum of the cosine and the overlap of ``entities``.
    ``whole`` says that a label's edges all come from one tile.

    A tile pair answers with a maximum spanning forest of its pairs, fewer
    edges than rows: leaving out the weakest edge of a cycle never changes
    which rows hang together."""
    slim = _labelled(df, row_id, vector, label, entities)
    if label:
        buckets = F.greatest(F.lit(1), F.ceil(F.lit(df.count()) / tile_rows))
        slim = slim.withColumn("bucket", F.pmod(F.xxhash64("label"), buckets))
    tiled = cut_lineage(with_tiles(slim, ["dims", "bucket"], "row_id", tile_rows))
    kernel = _forest_kernel(floor, signals or {"cosine": SIGNALS["cosine"]})
    return _meet(tiled.drop("dims", "bucket"), _all_tile_pairs(tiled), kernel, "signal string, i long, j long, score double, whole boolean")


def similarity_links(df: DataFrame, row_id: str, vector: str, floor: float, tile_rows: int | None = None) -> DataFrame:
    """Links (i < j) that connect the same rows as all pairs with a cosine >= ``floor`` do.

    First each tile meets itself and the first tile. Rows of the largest component
    that makes are connected, so only the others still ask: they meet its rows and one another."""
    slim = cut_lineage(df.where(F.col(vector).isNotNull()).select(
        F.col(row_id).alias("row_id"), F.col(vector).alias("vec"), F.size(vector).alias("dims")))
    if tile_rows is None:
        tile_rows = max(1024, min(MOST_ROWS, -(-slim.count() // 16)))
    kernel, schema = kernels.links(floor), "i long, j long"
    tiled = cut_lineage(with_tiles(slim, ["dims"], "row_id", tile_rows).withColumn("component", F.col("row_id")))
    tiles = tiled.select("dims", "tile").distinct()
    first = tiles.groupBy("dims").agg(F.min("tile").alias("left_tile"))
    near = tiles.select(F.col("tile").alias("left_tile"), F.col("tile").alias("right_tile")).unionByName(
        tiles.join(first, "dims").where("tile != left_tile").select("left_tile", F.col("tile").alias("right_tile")))
    found = cut_lineage(_meet(tiled.drop("dims", "tiles"), near, kernel, schema, arrow=True))
    if tiles.groupBy("dims").count().where("count > 2").isEmpty():
        return found
    parts = connected_components(found).select(F.col("node").alias("row_id"), "component")
    placed = cut_lineage(slim.join(parts, "row_id", "left").withColumn("component", F.coalesce("component", "row_id")))
    largest = placed.groupBy("component").count().orderBy(F.desc("count"), "component").first()[0]
    asks = F.col("component") != largest
    cut = cut_lineage(with_tiles(placed.withColumn("asks", asks), ["dims", "asks"], "row_id", tile_rows))
    sides = cut.select("dims", "asks", "tile").distinct()
    rest = sides.alias("a").join(sides.alias("b"), (F.col("a.dims") == F.col("b.dims")) & F.col("a.asks") & (
        ~F.col("b.asks") | (F.col("a.tile") <= F.col("b.tile")))).select(F.col("a.tile").alias("left_tile"), F.col("b.tile").alias("right_tile"))
    return found.unionByName(_meet(cut.drop("dims", "asks", "tiles"), rest, kernel, schema, arrow=True))


def _labelled(df: DataFrame, row_id: str, vector: str, label: str | None, entities: str | None) -> DataFrame:
    """row_id, vec, label, hashed entities in order, dims and one bucket."""
    known = F.coalesce(F.col(entities), F.array().cast("array<string>")) if entities else F.array().cast("array<string>")
    return df.select(
        F.col(row_id).alias("row_id"), F.col(vector).alias("vec"), (F.col(label) if label else F.lit(0)).alias("label"),
        F.array_sort(F.array_distinct(F.transform(known, lambda e: F.xxhash64(e)))).alias("entities"),
        F.size(vector).alias("dims"), F.lit(0).cast("long").alias("bucket"),
    )


Ends = dict[str, tuple[float, float]]

#: More than the error of a cosine in single precision.
_SINGLE = 2e-5


def _exact_scores(left: pd.DataFrame, right: pd.DataFrame, rows: np.ndarray, cols: np.ndarray, cosine: float, overlap: float) -> np.ndarray:
    """``_signal_scores`` of the chosen pairs only."""
    (i, r), (j, c) = np.unique(rows, return_inverse=True), np.unique(cols, return_inverse=True)
    left, right = left.iloc[i], right.iloc[j]
    a, b = _matrix(left.vec), _matrix(right.vec)
    lengths = [(x * x).sum(axis=1) for x in (a, b)]
    cos = np.empty(len(r))
    for at in range(0, len(r), 1 << 16):
        p, q = r[at:at + (1 << 16)], c[at:at + (1 << 16)]
        with np.errstate(all="ignore"):
            cos[at:at + (1 << 16)] = np.einsum("ij,ij->i", a[p], b[q]) / np.sqrt(lengths[0][p] * lengths[1][q])
    cos = np.where(np.isfinite(cos), np.clip(cos, -1.0, 1.0), 0.0)
    common = _jaccards(left.entities.tolist(), right.entities.tolist(), r, c) if overlap else 0.0
    return np.round(cosine * cos + overlap * common, SCORE_DIGITS)


class _Part(NamedTuple):
    """Rows of a tile that are multiplied at once, from ``first`` to before ``last``."""
    first: int
    last: int
    rows: pd.DataFrame
    units: np.ndarray | None
    labels: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray


def _parts(rows: pd.DataFrame, labels: np.ndarray, step: int) -> list[_Part]:
    out = []
    for at in range(0, len(rows), step):
        some = rows.iloc[at:at + step]
        sizes = np.array([len(x) for x in some.entities], np.float32)
        out.append(_Part(at, at + len(some), some, _singles(some), labels[at:at + len(some)], some.row_id.to_numpy(), sizes))
    return out


def _alike(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal labels; those below zero are unknown and equal to none."""
    order = np.argsort(right, kind="stable")
    first, last = (np.searchsorted(right[order], left, side) for side in ("left", "right"))
    which, place = kernels.spread_out(first, np.where(left >= 0, last - first, 0))
    return which, order[place]


def _extremes_kernel(signals: dict[str, tuple[float, float]], found: Ends | None = None, step: int = 1024) -> Callable:
    """Ends of the scores of two tiles. Cosines in single precision and set sizes bound all scores; only
    pairs that may lie beyond ``found`` and beyond what the bounds promise are computed in full. Blocks of
    ``step`` rows and four times as many columns are multiplied at once, however large the tiles are."""
    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ends = {name: (found or {}).get(name, (np.inf, -np.inf)) for name in signals}
        if not left.empty and not right.empty:
            labels = pd.factorize(np.concatenate([left.label.to_numpy(), right.label.to_numpy()]))[0]
            parts = _parts(right, labels[len(left):], 4 * step)
            if not found:  # a corner gives first ends, so that no large block is computed in full
                corner = _parts(left.iloc[:step // 4], labels, step)[0], _parts(right.iloc[:step], labels[len(left):], step)[0]
                ends = beyond(*corner, ends)
            for a in _parts(left, labels[:len(left)], step):
                for b in parts:
                    # of a tile that meets itself each pair is met once
                    if right is not left or b.last > a.first:
                        ends = beyond(a, b, ends)
        # an end that isn't here is left to the tiles it was found in
        known = {name: (low if (found or {}).get(name, (None, None))[0] != low else np.inf,
                        high if (found or {}).get(name, (None, None))[1] != high else -np.inf) for name, (low, high) in ends.items()}
        return pd.DataFrame([(name, *e) for name, e in known.items()], columns=["signal", "lowest_same", "highest_different"])

    def beyond(left: _Part, right: _Part, ends: Ends) -> Ends:
        if left.units is None or right.units is None:
            return {name: in_full(left, right, name, ends) for name in signals}
        cos = left.units @ right.units.T
        si, sj = _alike(left.labels, right.labels)
        inside = cos[si, sj]
        cos[si, sj] = 0.0  # only pairs of different labels are left
        sizes = left.sizes, right.sizes
        other = left.ids[si] != right.ids[sj]
        mi, mj, inside = si[other], sj[other], inside[other]

        def ratio(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """The overlap is no larger than the smaller set over the larger."""
            return np.minimum(sizes[0][i], sizes[1][j]) / np.maximum(1, np.maximum(sizes[0][i], sizes[1][j]))

        most = ratio(mi, mj)
        ends_of_cos = float(cos.min()), float(cos.max())
        out = {}
        for name, (a, b) in signals.items():
            low, high = ends[name]
            slack = _SINGLE * (abs(a) + abs(b))
            least, largest = a * inside + min(0.0, b) * most, a * inside + max(0.0, b) * most
            at = np.flatnonzero(least < min(low, largest.min(initial=np.inf) + slack) + slack)
            if len(at):
                low = min(low, float(_exact_scores(left.rows, right.rows, mi[at], mj[at], a, b).min()))
            out[name] = low, high
            if max(a * e for e in ends_of_cos) + max(0.0, b) + slack <= high or high >= round(abs(a) + max(0.0, b), SCORE_DIGITS):
                continue  # no score is larger than all of its parts at their largest
            if a > 0:  # most pairs are out by their cosine alone
                rows, cols = np.nonzero(cos > np.float32((high - slack - max(0.0, b)) / a - _SINGLE))
                top = a * cos[rows, cols] + max(0.0, b) * ratio(rows, cols)
            else:
                rows, cols = (x.ravel() for x in np.indices(cos.shape))
                top = a * cos.ravel() + max(0.0, b) * ratio(rows, cols)
            open_ = (top > high - slack) & ((left.labels[rows] != right.labels[cols]) | (left.labels[rows] < 0))
            rows, cols = rows[open_], cols[open_]
            if len(rows) > cos.size // 16:
                out[name] = low, in_full(left, right, name, ends)[1]
            elif len(rows):
                out[name] = low, max(high, float(_exact_scores(left.rows, right.rows, rows, cols, a, b).max()))
        return out

    def in_full(left: _Part, right: _Part, name: str, ends: Ends) -> tuple[float, float]:
        score = _signal_scores(left.rows, right.rows, {name: signals[name]})[name]
        same = (left.labels[:, None] == right.labels[None, :]) & (left.labels >= 0)[:, None]
        pair = left.ids[:, None] != right.ids[None, :]
        low, high = ends[name]
        return min(low, float(np.min(score, where=same & pair, initial=np.inf))), max(high, float(np.max(score, where=~same, initial=-np.inf)))

    return kernel


def _singles(rows: pd.DataFrame) -> np.ndarray | None:
    """Unit vectors in single precision, zero where there is no direction; none if lengths are too odd for that."""
    vectors_ = _matrix(rows.vec)
    with np.errstate(all="ignore"):
        squares = (vectors_ * vectors_).sum(axis=1)
    if not (np.isfinite(squares).all() and ((squares == 0) | ((squares > 1e-100) & (squares < 1e100))).all()):
        return None
    return (vectors_ / np.sqrt(np.where(squares > 0, squares, 1.0))[:, None]).astype(np.float32)


def _extreme_pairs(
    df: DataFrame, row_id: str, vector: str, label: str, tile_rows: int | None, entities: str | None
) -> tuple[DataFrame, DataFrame]:
    """The tiled rows, and for each pair of tiles bounds on all its pairs: ``most`` and ``least`` cosine, the
    largest ``overlap``, whether labels may be ``same`` or ``different``, and whether it is ``likely`` to hold an end."""
    tiled, chosen = with_pivot_tiles(_labelled(df, row_id, vector, label, entities), ["dims", "bucket"], "row_id", "vec", tile_rows, parts=8)
    stats = tiled.groupBy("tile", "dims", "bucket").agg(
        F.min(F.size("entities")).alias("fewest"), F.max(F.size("entities")).alias("most"),
        F.when((F.min("label") == F.max("label")) & (F.count("label") == F.count("*")), F.min("label")).alias("only"),
    )
    stats = pivots.bounded(stats, tiled, "vec", chosen)
    pairs = stats.alias("a").join(
        stats.alias("b"),
        (F.col("a.dims") == F.col("b.dims")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.tile") <= F.col("b.tile")),
    ).select(
        F.col("a.tile").alias("left_tile"), F.col("b.tile").alias("right_tile"),
        pivots.most_cosine("a", "b").alias("most"), pivots.least_cosine("a", "b").alias("least"),
        F.least(F.lit(1.0), F.least("a.most", "b.most") / F.greatest(F.lit(1), F.col("a.fewest"), F.col("b.fewest"))).alias("overlap"),
        F.coalesce(F.col("a.only") == F.col("b.only"), F.lit(True)).alias("same"),
        F.coalesce(F.col("a.only") != F.col("b.only"), F.lit(True)).alias("different"),
    )
    own = F.col("left_tile") == F.col("right_tile")
    nearest = Window.partitionBy("left_tile").orderBy(F.desc("different"), F.desc("most"), "right_tile")
    farthest = Window.partitionBy("left_tile").orderBy(F.desc("same"), "least", "right_tile")
    likely = own | (F.row_number().over(nearest) == 1) | (F.row_number().over(farthest) == 1)
    return tiled, cut_lineage(pairs.withColumn("likely", likely))


def _ends(found: DataFrame) -> Ends:
    """signal: lowest_same and highest_different, a row per signal."""
    return {r[0]: (r[1], r[2]) for r in found.groupBy("signal").agg(F.min("lowest_same"), F.max("highest_different")).collect()}


def _more_extreme(signals: dict[str, tuple[float, float]], found: DataFrame) -> Column:
    """Whether a pair of tiles may hold a lower score inside a label or a higher one between labels than was found."""
    ends = _ends(found)
    open_ = F.lit(False)
    for name, (cosine, overlap) in signals.items():
        lowest, highest = ends.get(name, (float("inf"), float("-inf")))
        ends_of = [F.col(c) * cosine for c in ("least", "most")]
        low, high = F.least(*ends_of) + min(0.0, overlap) * F.col("overlap"), F.greatest(*ends_of) + max(0.0, overlap) * F.col("overlap")
        open_ = open_ | (F.col("same") & (low < lowest + pivots.SLACK)) | (F.col("different") & (high > highest - pivots.SLACK))
    return open_


def extremes_work(
    df: DataFrame, row_id: str, vector: str, label: str, tile_rows: int | None = None,
    entities: str | None = None, signals: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """How many pairs of tiles ``cosine_extremes`` multiplies and drops: (work, pairs)."""
    signals = signals or {"cosine": SIGNALS["cosine"]}
    tiled, planned = _extreme_pairs(df, row_id, vector, label, tile_rows, entities)
    first = _meet(
        tiled.drop("dims", "bucket", "pivot"), planned.where("likely"), _extremes_kernel(signals),
        "signal string, lowest_same double, highest_different double",
    )
    work = F.when(F.col("likely") | _more_extreme(signals, first), "matrix").otherwise("none")
    return planned.groupBy(work.alias("work")).agg(F.count("*").alias("pairs"))


def cosine_extremes(
    df: DataFrame, row_id: str, vector: str, label: str, tile_rows: int | None = None,
    entities: str | None = None, signals: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """A row per signal: lowest score inside a label and highest between labels.
    Each tile pair answers with two numbers, no pair becomes a row. Unasked, the rows are
    cut into about 8 tiles, so that what is shuffled grows with them and not with their square."""
    signals = signals or {"cosine": SIGNALS["cosine"]}
    tiled, planned = _extreme_pairs(df, row_id, vector, label, tile_rows, entities)
    kernel, schema = _extremes_kernel(signals), "signal string, lowest_same double, highest_different double"
    rows = tiled.drop("dims", "bucket", "pivot")
    # pairs of tiles that may hold the ends go first; then only those that may hold more extreme ones
    found = _meet(rows, planned.where("likely"), kernel, schema)
    later = planned.where(~F.col("likely"))
    if later.limit(1).count():
        found = cut_lineage(found)
        found = found.unionByName(_meet(rows, later.where(_more_extreme(signals, found)), _extremes_kernel(signals, _ends(found)), schema))
    infinite = F.lit(float("inf"))
    return found.groupBy("signal").agg(F.min("lowest_same").alias("s"), F.max("highest_different").alias("d")).select(
        "signal",
        F.when(F.col("s") < infinite, F.col("s")).alias("lowest_same"),
        F.when(F.col("d") > -infinite, F.col("d")).alias("highest_different"),
    )
