"""Global numbering without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyweave.session import cut_lineage


def ordinal(df: DataFrame, *order: Column, out: str = "ordinal") -> DataFrame:
    """Number the rows 1..n in ``order``. Rows are range-partitioned and
    numbered inside their partition; only the per-partition counts, one row
    per partition, are summed to give each partition its offset."""
    placed = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    # the high bits of the id name the partition, the low 33 the row in it
    part = F.shiftright("_mid", 33)
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    offsets = (
        placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .select("_part", "_before")
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_before") + local + 1).cast("long"))
        .drop("_mid", "_part", "_before")
    )


def ordinal_within(df: DataFrame, group: str, *order: Column, out: str = "position") -> DataFrame:
    """Number the rows 1..n inside each group; a group that holds most of the
    rows is spread over many range partitions instead of one task."""
    numbered = ordinal(df, F.col(group).asc(), *order, out="_global")
    starts = numbered.groupBy(group).agg(F.min("_global").alias("_start"))
    return (
        numbered.join(starts, group)
        .withColumn(out, F.col("_global") - F.col("_start") + 1)
        .drop("_global", "_start")
    )
