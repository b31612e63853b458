"""Reference tables over time: dated snapshots folded into validity intervals, one source at a time.

An interval of a key says from which snapshot to which it was there without a gap, and in how many of them. A new
snapshot is merged with the intervals that reached the snapshot before: those go on, others stay as they are, keys
that weren't there begin. Each date's intervals are written below that date, made from those of the date before, so a
date can be done again and an unfinished one changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .catalog import Catalog
from .tables import keep_history


def merge(intervals: DataFrame | None, snapshot: DataFrame, keys: list[str], date: str, before: str | None) -> DataFrame:
    """(keys, valid_from, valid_to, snapshots) with the snapshot of ``date``; ``before`` is the date of the last one."""
    there = snapshot.select(*keys).distinct()
    fresh = there.select(*keys, F.lit(date).alias("valid_from"), F.lit(date).alias("valid_to"), F.lit(1).cast("bigint").alias("snapshots"))
    if intervals is None:
        return fresh
    same = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
    going = intervals.where(F.col("valid_to") == before)
    met = going.alias("a").join(fresh.alias("b"), same, "full_outer")
    on, there_now = F.col("a.valid_from").isNotNull(), F.col("b.valid_from").isNotNull()
    rows = met.select(
        *[F.when(on, F.col(f"a.`{k}`")).otherwise(F.col(f"b.`{k}`")).alias(k) for k in keys], F.coalesce("a.valid_from", "b.valid_from").alias("valid_from"), F.coalesce("b.valid_to", "a.valid_to").alias("valid_to"),
        (F.coalesce("a.snapshots", F.lit(0)) + there_now.cast("bigint")).alias("snapshots"),
    )
    return rows.unionByName(intervals.where(F.col("valid_to") != before))


def presence(intervals: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """(keys, first_day, last_day, n_days, status, active) over snapshots from ``first`` to ``last``."""
    each = intervals.groupBy(*keys).agg(F.min("valid_from").alias("first_day"), F.max("valid_to").alias("last_day"), F.sum("snapshots").cast("int").alias("n_days"), F.count(F.lit(1)).alias("_runs"))
    one, begins, ends = F.col("_runs") == 1, F.col("first_day") == first, F.col("last_day") == last
    status = F.when(one & begins & ends, "stable").when(one & ends, "new").when(one & begins, "left").otherwise("unstable")
    return each.select(*keys, "first_day", "last_day", "n_days", status.alias("status"), ends.alias("active"))


class History:
    """Intervals of reference tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def dates(self, name: str) -> list[str]:
        """Dates of the snapshots of a table."""
        try:
            rows = self.spark.read.parquet(f"{self.folder}/{name}/dates")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted({r["date"] for r in rows.select("date").collect()})  # snapshots, not rows

    def intervals(self, name: str, date: str | None = None) -> DataFrame:
        """The intervals up to the snapshot of ``date``, the last one by default."""
        return self.spark.read.parquet(f"{self.folder}/{name}/intervals/{date or self.dates(name)[-1]}")

    def add(self, name: str, snapshot: DataFrame, keys: list[str], date: str) -> None:
        """Keep a dated copy and merge it. The date may be the last one again, but not an earlier one."""
        done = self.dates(name)
        if done and date < done[-1]:
            raise ValueError(f"{name}: {date} is before the last snapshot, {done[-1]}")
        earlier = [d for d in done if d < date]
        held = self.intervals(name, earlier[-1]) if earlier else None
        keep_history(snapshot, f"{self.folder}/{name}/snapshots", date)
        merge(held, snapshot, keys, date, earlier[-1] if earlier else None).write.mode("overwrite").parquet(f"{self.folder}/{name}/intervals/{date}")
        if date not in done:
            self.spark.createDataFrame([(date,)], "date string").coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}/dates")

    def presence(self, name: str, keys: list[str]) -> DataFrame:
        dates = self.dates(name)
        return presence(self.intervals(name), keys, dates[0], dates[-1])

    def sync(self, sources: dict[str, tuple[Callable[[], DataFrame], list[str]]], date: str, run_id: str) -> dict[str, int | str]:
        """Add the snapshot of each source (function, keys); one that fails is told by its error and leaves the others alone."""
        report: dict[str, int | str] = {}
        with Catalog(self.spark, f"{self.folder}/catalog").run(run_id, "reference") as state:
            for name, (read, keys) in sources.items():
                try:
                    self.add(name, read(), keys, date)
                    report[name] = self.intervals(name, date).where(F.col("valid_to") == date).count()
                except Exception as error:  # noqa: BLE001 - whatever it is, it concerns this source alone
                    report[name] = str(error)[:500]
            state["rows"] = sum(n for n in report.values() if isinstance(n, int))
        return report
