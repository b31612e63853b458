"""Run, ingestion and partition records as append-only tables; the latest row of a key counts."""

from __future__ import annotations

import time
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_RUNS = "run_id string, kind string, status string, rows bigint, seconds double, note string, at timestamp"
_PARTITIONS = "name string, date string, collector string, path string, rows bigint, bytes bigint, at timestamp"
_INGESTED = "url string, collector string, kind string, status string, bytes bigint, attempts int, at timestamp"


class Catalog:
    """Records below one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _append(self, name: str, schema: str, *rows: tuple) -> None:
        self.spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def _rows(self, name: str, schema: str) -> DataFrame:
        """All records of a kind; none if there is no table yet. Any other failing read is an error."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _latest(self, name: str, schema: str, key: str) -> DataFrame:
        rows = self._rows(name, schema)
        return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "at").alias("x")).select(key, "x.*")

    def runs(self) -> DataFrame:
        return self._latest("runs", _RUNS, "run_id")

    def ingested(self) -> DataFrame:
        """Latest state of each file with its attempts."""
        latest = self._latest("ingested", _INGESTED, "url").drop("attempts")
        tries = self._rows("ingested", _INGESTED).groupBy("url").agg(F.sum("attempts").cast("int").alias("attempts"))
        return latest.join(tries, "url")

    def record_file(self, url: str, collector: str, kind: str, status: str, size: int) -> None:
        self._append("ingested", _INGESTED, (url, collector, kind, status, size, 1, datetime.now(timezone.utc)))

    def record_partition(self, table: str, date: str, collector: str, path: str, rows: int, size: int) -> None:
        self.record_partitions([(table, date, collector, path, rows, size)])

    def record_partitions(self, found: list[tuple[str, str, str, str, int, int]]) -> None:
        """Record (table, date, collector, path, rows, bytes) of several partitions at once."""
        now = datetime.now(timezone.utc)
        if found:
            self._append("partitions", _PARTITIONS, *[(f"{x[0]}/{x[1]}/{x[2]}", *x[1:], now) for x in found])

    def registered(self) -> DataFrame:
        """(name, date, collector, path, rows, bytes, at): the latest record of each partition."""
        return self._latest("partitions", _PARTITIONS, "name")

    def coverage(self) -> DataFrame:
        """(collector, kind, files, bytes, failed)."""
        return self.ingested().groupBy("collector", "kind").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("status") == "failed").alias("failed"))

    @contextmanager
    def run(self, run_id: str, kind: str):
        """Record a run; the body may set rows on what it gets. A failure is recorded and raised again."""
        state = {"rows": 0}
        began = time.time()
        try:
            yield state
        except Exception as error:
            self._append("runs", _RUNS, (run_id, kind, "failed", state["rows"], time.time() - began, str(error)[:500], datetime.now(timezone.utc)))
            raise
        self._append("runs", _RUNS, (run_id, kind, "ok", state["rows"], time.time() - began, "", datetime.now(timezone.utc)))
