"""Small classification expressions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_status(enabled: Column, failures: Column) -> Column:
    return (
        F.when(~enabled, F.lit("disabled"))
        .when(failures >= 3, F.lit("failing"))
        .when(failures > 0, F.lit("degraded"))
        .otherwise(F.lit("healthy"))
    )


def importance_tier(score: Column) -> Column:
    return F.when(score >= 0.55, F.lit("high")).when(score >= 0.40, F.lit("medium")).otherwise(F.lit("low"))


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long")


def display_score(score: Column) -> Column:
    return round_half_up(score * 100)


def lit_ticks(score: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), round_half_up(score * 10)))


def classify_error(status: Column) -> Column:
    return (
        F.when(status == 429, F.lit("rate_limit"))
        .when(status == 402, F.lit("payment_required"))
        .when(status >= 500, F.lit("transient"))
        .when(status >= 400, F.lit("error"))
    )


def since_filter(published: Column, since: Column) -> Column:
    """Undated rows always pass; dated rows must be strictly newer."""
    return since.isNull() | published.isNull() | (published > since)


def is_due(enabled: Column, last_run_at: Column, cadence_minutes: Column, as_of: Column) -> Column:
    due_at = F.unix_micros(last_run_at) + cadence_minutes.cast("long") * F.lit(60_000_000)
    return enabled & (last_run_at.isNull() | (F.unix_micros(as_of) >= due_at))


def effective_since(
    last_run_at: Column, max_backfill_days: Column, as_of: Column,
    default_days: int = 2, override_days: int | None = None,
) -> tuple[Column, Column]:
    """Start of the fetch window and whether the cap narrowed it. An override
    ignores the last run: a repair reaches past it on purpose."""
    days = F.lit(override_days) if override_days is not None else F.coalesce(max_backfill_days, F.lit(default_days))
    cap = F.timestamp_micros(F.unix_micros(as_of) - days.cast("long") * F.lit(86_400_000_000))
    if override_days is not None:
        return cap, F.lit(True)
    return F.greatest(cap, last_run_at), last_run_at.isNull() | (cap > last_run_at)
