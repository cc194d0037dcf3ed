"""Merge-threshold calibration on labelled items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyweave.operators.stories import connected_components
from storyweave.session import cut_lineage


def sweep_points(low: int = 20, high: int = 94) -> list[int]:
    """Thresholds in hundredths."""
    return list(range(low, high + 1))


def label_bottlenecks(inside: DataFrame, labelled: DataFrame, low: int = 20, high: int = 94) -> DataFrame:
    """(signal, bottleneck): up to which threshold every label hangs together;
    under 0 if one never does.

    A label whose edges come from one tile has a spanning tree or none, so its
    weakest edge tells. Only labels that were cut into several tiles are tried
    at each threshold."""
    sizes = labelled.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    edges = cut_lineage(inside.join(labelled.select(F.col("row_id").alias("i"), "label"), "i"))
    wanted = sizes.crossJoin(F.broadcast(inside.select("signal").distinct()))  # a handful of signals
    trees = edges.groupBy("signal", "label").agg(F.count("*").alias("n"), F.min("score").alias("weakest"), F.bool_and("whole").alias("whole"))
    known = cut_lineage(wanted.join(trees, ["signal", "label"], "left"))
    direct = known.where(F.coalesce("whole", F.lit(True))).select(
        "signal", F.when(F.col("n") == F.col("size") - 1, F.col("weakest")).otherwise(F.lit(-1.0)).alias("bottleneck"))
    cut = known.where(~F.col("whole")).select("signal", "label", "size")
    if not cut.isEmpty():
        points = F.array(*[F.lit(t) for t in sweep_points(low, high)])
        tried = edges.join(cut, ["signal", "label"], "left_semi").withColumn("t", F.explode(points)).where(
            F.col("score") >= F.col("t") / F.lit(100.0))
        parts = connected_components(tried.withColumn("k", F.concat_ws("|", "signal", "t")), key="k")
        merged = (
            parts.where(F.col("node") != F.col("component"))
            .join(labelled.select(F.col("row_id").alias("node"), "label"), "node").groupBy("k", "label").agg(F.count("*").alias("n"))
            .select(F.substring_index("k", "|", 1).alias("signal"), F.substring_index("k", "|", -1).cast("int").alias("t"), "label", "n")
        )
        best = cut.join(merged, ["signal", "label"], "left").groupBy("signal", "label").agg(
            F.max(F.when(F.col("n") == F.col("size") - 1, F.col("t") / F.lit(100.0))).alias("b"))
        direct = direct.unionByName(best.select("signal", F.coalesce("b", F.lit(-1.0)).alias("bottleneck")))
    return direct.groupBy("signal").agg(F.min("bottleneck").alias("bottleneck"))


def threshold_sweep(
    inside: DataFrame, crossing: DataFrame, labelled: DataFrame, low: int = 20, high: int = 94
) -> DataFrame:
    """(signal, threshold, passes): does linking every pair at or above the
    threshold give exactly the labelled groups? ``inside`` (signal, i, j, score,
    whole) connects the rows of each label as their pairs do, ``crossing`` is a
    row per signal with highest_different, ``labelled`` (row_id, label).

    A threshold passes when no link crosses two labels and every label hangs
    together, so all other pairs can be left out."""
    hundredth = F.col("t") / F.lit(100.0)
    ends = crossing.join(label_bottlenecks(inside, labelled, low, high), "signal", "left")
    return ends.withColumn("t", F.explode(F.array(*[F.lit(t) for t in sweep_points(low, high)]))).select(
        "signal", hundredth.alias("threshold"),
        # without a label of two rows nothing has to hang together
        ((F.coalesce("highest_different", F.lit(-1.0)) < hundredth) & (F.coalesce("bottleneck", F.lit(2.0)) >= hundredth)).alias("passes"),
    )


def safe_band(sweep: DataFrame) -> DataFrame:
    """(signal, low, high, width) of the widest unbroken run of passing
    thresholds of each signal; zeros when none passes. The sweep has one row
    per signal and hundredth."""
    step = F.round(F.col("threshold") * 100).cast("int")
    island = step - F.row_number().over(Window.partitionBy("signal").orderBy("threshold"))
    runs = sweep.where("passes").withColumn("_island", island).groupBy("signal", "_island").agg(
        F.min("threshold").alias("low"), F.max("threshold").alias("high")
    )
    best = runs.groupBy("signal").agg(
        F.max(F.struct(F.round(F.col("high") - F.col("low"), 2).alias("width"), -F.col("low"), "low", "high")).alias("b"))
    return sweep.select("signal").distinct().join(best, "signal", "left").select(
        "signal", *[F.coalesce(f"b.{n}", F.lit(0.0)).alias(n) for n in ("low", "high", "width")])


def separation_margin(extremes: DataFrame) -> DataFrame:
    """Per signal: lowest same-label score minus highest different-label score."""
    return extremes.select("signal", "lowest_same", "highest_different", (F.col("lowest_same") - F.col("highest_different")).alias("margin"))
