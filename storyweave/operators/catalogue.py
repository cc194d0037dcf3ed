"""Source catalogue: validation and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The coverage territories, in display order.
TERRITORIES = ["research", "industry", "policy", "infrastructure"]


def catalogue_violations(entries: DataFrame) -> DataFrame:
    """(source_id, violation) rows; an empty result means a valid catalogue."""
    rules = F.array(
        F.when(F.coalesce("cadence_minutes", F.lit(0)) <= 0, F.lit("cadence_minutes must be positive")),
        F.when(~F.coalesce(F.col("authority").between(0.0, 1.0), F.lit(False)), F.lit("authority outside [0, 1]")),
        F.when(~F.coalesce(F.col("territory").isin(TERRITORIES), F.lit(False)), F.lit("unknown territory")),
        F.when(F.col("max_backfill_days") <= 0, F.lit("max_backfill_days must be positive")),
    )
    ranged = entries.select(
        "source_id", F.explode(F.filter(rules, lambda v: v.isNotNull())).alias("violation")
    )
    repeated = (
        entries.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1")
        .select("source_id", F.lit("duplicate source id").alias("violation"))
    )
    return ranged.unionByName(repeated)


def catalogue_diff(current: DataFrame, wanted: DataFrame, item_counts: DataFrame) -> DataFrame:
    """(source_id, action, clears_health): added, updated, unchanged, deleted
    (never collected anything), disabled, or untouched (already inert)."""
    tracked = ["plugin", "config", "cadence_minutes", "authority", "max_backfill_days", "territory", "enabled"]
    tracked = [c for c in tracked if c in current.columns and c in wanted.columns]
    old = current.select("source_id", F.struct(*tracked).alias("old"))
    new = wanted.select("source_id", F.struct(*tracked).alias("new"))
    identity = [c for c in ("plugin", "config") if c in tracked]

    def differs(names: list[str]):
        out = F.lit(False)
        for n in names:
            out = out | ~F.col(f"old.{n}").eqNullSafe(F.col(f"new.{n}"))
        return out

    action = (
        F.when(F.col("old").isNull(), F.lit("added"))
        .when(F.col("new").isNotNull() & differs(tracked), F.lit("updated"))
        .when(F.col("new").isNotNull(), F.lit("unchanged"))
        .when(~F.col("old.enabled"), F.lit("untouched"))
        .when(F.coalesce("items", F.lit(0)) == 0, F.lit("deleted"))
        .otherwise(F.lit("disabled"))
    )
    clears = (
        F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), differs(identity) | ~F.col("old.enabled"))
        .otherwise(F.col("old").isNotNull() & F.col("new").isNull() & F.col("old.enabled"))
    )
    return (
        old.join(new, "source_id", "full_outer").join(item_counts, "source_id", "left")
        .select("source_id", action.alias("action"), clears.alias("clears_health"))
    )


def catalogue_sync(current: DataFrame, wanted: DataFrame, item_counts: DataFrame) -> DataFrame:
    """The source table after reconciliation, with the action taken."""
    diff = catalogue_diff(current, wanted, item_counts)
    settings = [c for c in current.columns if c in wanted.columns and c != "source_id"]
    health = {"last_error": "string", "consecutive_failures": "int", "coverage_warning": "string"}
    joined = (
        diff.join(current.alias("c"), "source_id", "left")
        .join(wanted.select("source_id", F.struct(*settings).alias("w")), "source_id", "left")
        .where(F.col("action") != "deleted")
    )
    from_catalogue = F.col("w").isNotNull()
    columns = [F.col("source_id")]
    for name in current.columns:
        if name == "source_id":
            continue
        value = F.col(f"c.{name}")
        if name in settings:
            value = F.when(from_catalogue, F.col(f"w.{name}")).otherwise(value)
        if name == "enabled":
            value = F.when(F.col("action") == "disabled", F.lit(False)).otherwise(value)
        if name in health:
            reset = F.lit(0) if name == "consecutive_failures" else F.lit(None).cast(health[name])
            value = F.when(F.col("clears_health") | (F.col("action") == "added"), reset).otherwise(value)
        columns.append(value.alias(name))
    return joined.select(*columns, "action")


def removed_sources(current: DataFrame, wanted: DataFrame) -> DataFrame:
    return current.select("source_id").join(wanted.select("source_id"), "source_id", "left_anti")


def unknown_source_ids(requested: DataFrame, known: DataFrame) -> DataFrame:
    return requested.select("source_id").exceptAll(known.select("source_id")).distinct()
