"""A detection run: every enabled detector by itself, its events added to a log, the failures told.

The log of events is only added to: a run writes below its own id, and of an event that several runs found the
row of the latest counts. So a run over other days, or one in which a detector fails or is disabled, takes
nothing away. Incidents are made anew from all events and stored with the run.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from pathlight.sources.catalog import Catalog
from pathlight.sources.tables import DataUnavailable

from . import detectors, incidents


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise DataUnavailable(f"{path}: no run has stored anything") from error


def events(spark: SparkSession, folder: str) -> DataFrame:
    """All events, each as the latest run that found it has it."""
    rows = _read(spark, f"{folder}/events")
    columns = [c for c in rows.columns if c != "event_id"]
    return rows.groupBy("event_id").agg(F.max_by(F.struct(*columns), F.struct("run_at", "run_id")).alias("x")).select("event_id", "x.*")


def incidents_of(spark: SparkSession, folder: str) -> DataFrame:
    """The incidents of the last run."""
    rows = _read(spark, f"{folder}/incidents")
    last = rows.agg(F.max(F.struct("run_at", "run_id")).alias("last"))  # one row
    return rows.join(F.broadcast(last)).where(F.struct("run_at", "run_id") == F.col("last")).drop("last")


def run(
    spark: SparkSession, found: dict[str, Callable[[], DataFrame]], folder: str, run_id: str, asns: DataFrame, coverage: DataFrame | None = None, african_only: bool = True, disabled: frozenset[str] = frozenset()
) -> dict[str, int | str]:
    """Events of each detector to the log ``folder``/events, the incidents of all events to ``folder``/incidents.

    ``found``: functions that return candidates. One that fails is told by its error and leaves the others
    alone. A run that is started again under its id replaces what it had stored. Returns rows or the error by detector, and
    the number of incidents.
    """
    report, now = {}, F.lit(datetime.now(timezone.utc))
    with Catalog(spark, f"{folder}/catalog").run(run_id, "detect") as state:
        for name, detect in found.items():
            if name in disabled:
                continue
            try:
                rows = detectors.finish(detect(), asns, coverage)
                if african_only:
                    rows = rows.where("country_iso2 is not null or african")
                path = f"{folder}/events/run_id={run_id}/detector_name={name}"
                rows.withColumn("run_at", now).write.mode("overwrite").parquet(path)
                report[name] = spark.read.parquet(path).count()
            except Exception as error:  # noqa: BLE001 - whatever it is, it concerns this detector alone
                report[name] = str(error)[:500]
        try:
            path = f"{folder}/incidents/run_id={run_id}"
            incidents.correlate(events(spark, folder)).withColumn("run_at", now).write.mode("overwrite").parquet(path)
            report["incidents"] = spark.read.parquet(path).count()
        except DataUnavailable:  # no detector has stored anything yet
            pass
        state["rows"] = sum(n for name, n in report.items() if isinstance(n, int) and name != "incidents")
    return report
