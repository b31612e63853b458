"""Time buckets, dense series, runs of days and presence classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Accepted window names and their durations.
WINDOWS = {"5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "6h": "6 hours", "24h": "1 day", "1d": "1 day"}
#: Hours from the epoch to Monday 2000-01-03, where buckets of hours are anchored.
_ANCHOR_HOURS = 10959 * 24


def tumbling(ts: Column, window: str) -> Column:
    if window not in WINDOWS:
        raise ValueError(f"unknown window {window!r}: one of {list(WINDOWS)}")
    return F.window(ts, WINDOWS[window])["start"]


def day(ts: Column) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def bucket(ts: Column, hours: int) -> Column:
    """Start of the bucket of so many hours, anchored on a Monday."""
    return F.window(ts, f"{hours} hours", f"{hours} hours", f"{_ANCHOR_HOURS % hours} hours")["start"]


def auto_bucket_hours(days: float) -> int:
    """Bucket size for a span of so many days."""
    return next((h for limit, h in ((1.5, 1), (4, 3), (8, 6), (16, 12)) if days <= limit), 24)


def fill_gaps(series: DataFrame, ts: str, step: str, keys: list[str], values: list[str]) -> DataFrame:
    """Every step between the first and last of the whole series for every key, zero where nothing was."""
    span = series.agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    # The one row of bounds is broadcast; each key lists its own steps.
    bounded = series.select(*keys).distinct().join(F.broadcast(span)) if keys else span
    dense = bounded.select(*keys, F.explode(F.expr(f"sequence(a, b, interval {step})")).alias(ts))
    return dense.join(series, [ts, *keys], "left").fillna(0, values)


def islands(days: DataFrame, keys: list[str], calendar: DataFrame, day: str = "day") -> DataFrame:
    """(keys, run_start, run_end, n_days): runs of consecutive collection days.

    Days without collection (absent from ``calendar``) don't interrupt a run.
    """
    numbered = calendar.select(day).distinct().withColumn("i", F.row_number().over(Window.orderBy(day)))
    placed = days.select(*keys, day).distinct().join(numbered, day)
    placed = placed.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(*keys).orderBy(day)))
    return placed.groupBy(*keys, "run").agg(F.min(day).alias("run_start"), F.max(day).alias("run_end"), F.count(F.lit(1)).alias("n_days")).drop("run")


def presence(seen: Column, days: Column) -> Column:
    """stable, new, left or unstable, over the collection days ``days`` (array, ascending)."""
    text = F.array_join(F.transform(days, lambda d: F.when(F.array_contains(seen, d), "1").otherwise("0")), "")
    return F.when(text.rlike("^1*$"), "stable").when(text.rlike("10+1"), "unstable").when(text.rlike("^0+1+$"), "new").when(text.rlike("^1+0+$"), "left").otherwise("unstable")


def reappearances(seen: Column, days: Column) -> Column:
    """How often something came back after it had gone."""
    flags = F.transform(days, lambda d: F.array_contains(seen, d))
    text = F.array_join(F.transform(flags, lambda x: F.when(x, "1").otherwise("0")), "")
    return F.size(F.regexp_extract_all(text, F.lit("10+(?=1)"), F.lit(0)))
