"""Stored metrics: ten tables by day, and a ledger of what each stored day was made from.

A build writes the asked days of each table below a version of its own and adds one ledger row for each
(table, day): the version, the number of rows, and the number and digest of the source's files as they
were before the build read them. A day is current while the source's files are the same; this is a join of
the ledger with a listing of files, elements aren't read for it. A reader gets the current days from the
versions that the ledger names and computes the others from their partitions alone. Nothing that a reader
may hold is overwritten: an unfinished build has no ledger row, and ``vacuum`` removes what no row names.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from pathlight.functions import windows
from pathlight.sources.catalog import Catalog

from . import metrics

_LEDGER = "name string, date string, version string, files bigint, digest bigint, rows bigint, at timestamp"


@dataclass(frozen=True)
class Inputs:
    """What the tables are made from; ``elements`` and ``rib`` hold the asked days."""

    elements: DataFrame
    rib: DataFrame
    asns: DataFrame
    roas: DataFrame
    roles: DataFrame
    window: str


@dataclass(frozen=True)
class Table:
    sources: tuple[str, ...]
    make: Callable[[Inputs], DataFrame]
    #: Columns that the rows of a day are sorted by.
    order: tuple[str, ...]


def _by_window(rows: DataFrame, start: str = "window_start") -> DataFrame:
    return rows.withColumn("day", windows.day(F.col(start)))


#: Windows must not cross midnight.
TABLES: dict[str, Table] = {
    "churn_prefix": Table(("elements",), lambda x: _by_window(metrics.churn_by_prefix(x.elements, x.window)), ("prefix", "window_start")),
    "churn_asn": Table(("elements",), lambda x: _by_window(metrics.churn_by_asn(x.elements, x.window)), ("origin_asn", "window_start")),
    "visibility": Table(("rib",), lambda x: _by_window(metrics.visibility(x.rib, x.roles), "snapshot_ts"), ("prefix", "snapshot_ts")),
    "path_evolution": Table(("elements",), lambda x: _by_window(metrics.path_evolution(x.elements, x.window)), ("prefix", "window_start")),
    "upstream": Table(("elements",), lambda x: _by_window(metrics.upstreams(x.elements, x.window)), ("origin_asn", "window_start")),
    "coverage": Table(("elements",), lambda x: metrics.coverage(x.elements, x.asns, by_day=True), ("country_iso2",)),
    "country": Table(("elements", "rib"), lambda x: metrics.country(x.elements, x.rib, x.asns, x.roles, x.window, by_day=True), ("country_iso2", "window_start")),
    "rpki_coverage": Table(("elements",), lambda x: metrics.rpki_coverage(x.elements, x.asns, x.roas, by_day=True), ("country_iso2",)),
    "daily_prefix_origin": Table(("elements",), lambda x: metrics.daily_prefix_origin(x.elements, detail=True), ("origin_asn", "prefix")),
    "daily_adjacency": Table(("elements",), lambda x: metrics.daily_adjacency(x.elements), ("asn", "neighbour")),
}


class Store:
    """Metric tables over the partitioned tables ``paths["elements"]`` and ``paths["rib"]`` (by date=)."""

    def __init__(self, spark: SparkSession, folder: str, paths: dict[str, str], asns: DataFrame, roas: DataFrame, roles: DataFrame, window: str = "1h", max_age: float = 60.0) -> None:
        """``max_age``: seconds for which a listing of the sources' files is believed."""
        self.spark, self.folder, self.paths, self.window, self.max_age = spark, folder, paths, window, max_age
        self._references = {"asns": asns, "roas": roas, "roles": roles}
        self._listed, self._days, self._current, self._dates, self._schemas = 0.0, set(), {}, {}, {}

    def source_files(self) -> DataFrame:
        """(source, date, path, modificationTime, length) of the sources' files, from their listing."""
        out = None
        for source, path in self.paths.items():
            try:
                files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue
            rows = files.select(F.lit(source).alias("source"), F.col("date").cast("string").alias("date"), "path", "modificationTime", "length")
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], "source string, date string, path string, modificationTime timestamp, length bigint") if out is None else out

    def _states(self) -> dict[tuple[str, str], tuple[int, int]]:
        """(files, digest) of each (table, day) as the sources are now; a row for each source and day is collected."""
        mark = F.pmod(F.xxhash64("path", "modificationTime", "length"), F.lit(1 << 40))
        by_day = self.source_files().groupBy("source", "date").agg(F.count(F.lit(1)).alias("files"), F.sum(mark).alias("digest")).collect()
        self._dates = {source: {r["date"] for r in by_day if r["source"] == source} for source in self.paths}
        out: dict[tuple[str, str], tuple[int, int]] = {}
        for name, t in TABLES.items():
            for r in by_day:
                if r["source"] in t.sources:
                    files, digest = out.get((name, r["date"]), (0, 0))
                    out[name, r["date"]] = files + r["files"], digest + r["digest"]
        return out

    def ledger(self) -> DataFrame:
        """The latest row of each (table, day)."""
        try:
            rows = self.spark.read.schema(_LEDGER).parquet(f"{self.folder}/ledger")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], _LEDGER)
        return rows.groupBy("name", "date").agg(F.max_by(F.struct("version", "files", "digest", "rows", "at"), "at").alias("x")).select("name", "date", "x.*")

    def refresh(self) -> None:
        """Look at the files and the ledger again."""
        states = self._states()
        self._days, self._current = {d for _, d in states}, {name: {} for name in TABLES}
        for r in self.ledger().collect():
            if states.get((r["name"], r["date"])) == (r["files"], r["digest"]):
                self._current[r["name"]][r["date"]] = (r["version"], r["rows"])
        self._listed = time.monotonic()

    def _fresh(self) -> None:
        if not self._listed or time.monotonic() - self._listed > self.max_age:
            self.refresh()

    def days(self) -> list[str]:
        """Days with elements or snapshots."""
        self._fresh()
        return sorted(self._days)

    def current(self, name: str) -> set[str]:
        """Days of a table that are stored and up to date."""
        self._fresh()
        return set(self._current[name])

    def _source(self, source: str, days: list[str]) -> DataFrame:
        """Rows of the days, from their partitions alone."""
        path = self.paths[source]
        if source not in self._schemas:
            self._schemas[source] = self.spark.read.parquet(path).schema
        held = [f"{path}/date={d}" for d in days if d in self._dates.get(source, ())]
        if not held:
            return self.spark.createDataFrame([], self._schemas[source]).drop("date")
        return self.spark.read.schema(self._schemas[source]).option("basePath", path).parquet(*held).drop("date")

    def elements(self, first: str, last: str) -> DataFrame:
        """Elements of the days from ``first`` to ``last``, from their partitions alone."""
        return self._source("elements", [d for d in self.days() if first <= d <= last])

    def _inputs(self, days: list[str]) -> Inputs:
        return Inputs(self._source("elements", days), self._source("rib", days), window=self.window, **self._references)

    def build(self, days: list[str] | None = None, names: list[str] | None = None, run_id: str | None = None) -> dict[str, int]:
        """Store the given days (default: all) of the given tables (default: all) anew; returns rows by table.

        The run and the stored partitions are recorded in the catalog beside the tables.
        """
        names, version = list(TABLES if names is None else names), uuid.uuid4().hex
        states = {key: state for key, state in self._states().items() if key[0] in names}
        wanted = sorted({d for _, d in states} & set(days) if days is not None else {d for _, d in states})
        catalog, written = Catalog(self.spark, f"{self.folder}/catalog"), {}
        with catalog.run(run_id or version, "metrics") as run:
            inputs = self._inputs(wanted)
            for name in names:
                path, order = f"{self.folder}/{name}/version={version}", TABLES[name].order
                rows = TABLES[name].make(inputs).withColumn("date", F.to_date("day"))
                rows.repartitionByRange("date", *order).sortWithinPartitions("date", *order).write.mode("overwrite").partitionBy("date").parquet(path)
                counted = dict.fromkeys(wanted, 0)
                counted |= {str(r["date"]): r["count"] for r in self.spark.read.schema(rows.schema).parquet(path).groupBy("date").count().collect()}
                now = datetime.now(timezone.utc)
                entries = [(name, d, version, *states[name, d], counted[d], now) for d in wanted if (name, d) in states]
                self.spark.createDataFrame(entries, _LEDGER).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")
                catalog.record_partitions([(name, d, "", f"{path}/date={d}", counted[d], 0) for d in wanted])
                written[name] = sum(counted.values())
            run["rows"] = sum(written.values())
        self._listed = 0.0
        return written

    def table(self, name: str, first: str | None = None, last: str | None = None) -> DataFrame:
        """Rows of the days from ``first`` to ``last``: stored where current, else computed from those days' partitions."""
        self._fresh()
        wanted = [d for d in self.days() if (first is None or d >= first) and (last is None or d <= last)]
        held = {d: self._current[name][d] for d in wanted if d in self._current[name]}
        missing = [d for d in wanted if d not in held]
        computed = TABLES[name].make(self._inputs(missing))
        paths = [f"{self.folder}/{name}/version={version}/date={d}" for d, (version, n) in held.items() if n]
        if not paths:
            return computed
        stored = self.spark.read.schema(computed.schema).parquet(*paths)
        return stored.unionByName(computed) if missing else stored

    def vacuum(self) -> int:
        """Remove the versions of which no day is the latest; returns how many. Not while others read or build."""
        named = {(r["name"], r["version"]) for r in self.ledger().select("name", "version").distinct().collect()}
        hadoop, gone = self.spark._jvm.org.apache.hadoop.fs, 0
        for name in TABLES:
            top = hadoop.Path(f"{self.folder}/{name}")
            system = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in system.listStatus(top) if system.exists(top) else ():
                if (name, status.getPath().getName().removeprefix("version=")) not in named:
                    gone += bool(system.delete(status.getPath(), True))
        self._listed = 0.0
        return gone
