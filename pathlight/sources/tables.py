"""Partitioned tables: pruned scans, journaled partition replacement, sorted rewrites, merge by sequence."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F


class DataUnavailable(LookupError):
    """A table or the asked partitions of it don't exist."""


KEYS = ["ts", "collector", "peer_asn", "peer_ip", "elem_type", "prefix"]
#: Bytes of a row group, small enough that a prefix's rows are a small part of a file.
ROW_GROUP = 8 << 20


def read_partitions(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, collectors: list[str] | None = None) -> DataFrame:
    """Rows of the partitions date=/collector= in the range; pruning is by partition values.

    Raises DataUnavailable if nothing matches.
    """
    try:
        rows = spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as error:  # anything else is no sign that the table isn't there
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise DataUnavailable(f"{path}: no such table") from error
    if "date" in rows.columns:
        rows = rows.withColumn("date", F.col("date").cast("string"))
        if first is not None:
            rows = rows.where(F.col("date") >= first)
        if last is not None:
            rows = rows.where(F.col("date") <= last)
    if collectors is not None:
        rows = rows.where(F.col("collector").isin(collectors))
    if rows.isEmpty():
        raise DataUnavailable(f"{path}: no rows from {first} to {last}")
    return rows


def write_elements(elements: DataFrame, path: str, ipv4_only: bool = False, max_rows: int = 500_000, row_group: int = ROW_GROUP) -> None:
    """Replace the partitions that occur in the rows, each sorted by (prefix, ts) for row-group skipping.

    Large partitions are spread over tasks by prefix ranges; within each file the order holds. Row groups have
    bloom filters of their prefixes, so that a look-up of one reads few of them.
    """
    if ipv4_only:
        elements = elements.where("prefix_ip_version = 4")
    rows = elements.withColumn("date", F.to_date("ts"))
    dealt = rows.repartitionByRange("date", "collector", "prefix").sortWithinPartitions("date", "collector", "prefix", "ts")
    layout = {"maxRecordsPerFile": max_rows, "parquet.block.size": row_group, "parquet.bloom.filter.enabled#prefix": "true", "partitionOverwriteMode": "dynamic"}
    dealt.write.mode("overwrite").options(**layout).partitionBy("date", "collector").parquet(path)


def rib_snapshots(elements: DataFrame) -> DataFrame:
    """Table dump rows, taken at the element's time."""
    return elements.where("elem_type = 'R'").select(F.col("ts").alias("snapshot_ts"), "collector", "peer_asn", "prefix", "prefix_ip_version", "prefix_len", "origin_asn", "as_path_dedup", "as_path_len")


def merge_window(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """Stored and new rows, one for each key: the last by ``sequence``, which the rows keep.

    A sequence is (time and path of the source file, offset of its block, row); ``new`` has the first three of it from
    its reader, and its rows stand in each block as they were read. Rows without a sequence come before those with one, and
    stored ones before new ones, which count as they are read then.
    """
    kind = "struct<time: timestamp, file: string, block: bigint, row: bigint>"
    at = F.struct(*[F.col(f"sequence.{c}").alias(c) for c in ("time", "file", "block")], F.monotonically_increasing_id().alias("row")) if "sequence" in new.columns else F.struct(
        F.lit(None).cast("timestamp").alias("time"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    rows = new.withColumn("sequence", at.cast(kind)).withColumn("_new", F.lit(1))
    if stored is not None:
        rows = stored.withColumn("_new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    order = [F.desc_nulls_last("sequence.time"), F.desc("_new"), F.desc("sequence.file"), F.desc("sequence.block"), F.desc("sequence.row")]
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*order))).where("_k = 1").drop("_k", "_new")


def _files(spark: SparkSession, path: str):
    """(file system, function from text to path) of a table's folder."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def swap(rows: DataFrame, path: str) -> list[str]:
    """Replace the partitions that occur in ``rows``, which may be made from them; returns date=/collector= of each.

    The new partitions are written beside the table first, under a name of their own. A journal then names them; from
    there on ``recover`` finishes the renames if this is stopped. Before, nothing has changed.
    """
    spark, token = rows.sparkSession, uuid.uuid4().hex
    recover(spark, path)
    write_elements(rows, f"{path}/_staging-{token}")
    return _commit(spark, path, token)


def _commit(spark: SparkSession, path: str, token: str) -> list[str]:
    """Write the journal of a staged swap and finish it."""
    system, at = _files(spark, path)
    keys = sorted(f"{d.getPath().getName()}/{c.getPath().getName()}" for d in system.listStatus(at(f"{path}/_staging-{token}")) if "=" in d.getPath().getName() for c in system.listStatus(d.getPath()))
    out = system.create(at(f"{path}/_writing-{token}"), True)
    out.write(bytearray("\n".join(keys).encode()))
    out.close()
    system.rename(at(f"{path}/_writing-{token}"), at(f"{path}/_journal-{token}"))
    _finish(spark, path, token)
    return keys


def _finish(spark: SparkSession, path: str, token: str) -> None:
    system, at = _files(spark, path)
    journal = at(f"{path}/_journal-{token}")
    stream = system.open(journal)
    keys = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")  # partitions of one swap
    stream.close()
    for key in keys:
        live, new, old = (at(f"{top}/{key}") for top in (path, f"{path}/_staging-{token}", f"{path}/_old-{token}"))
        if not system.exists(new):
            continue  # done before
        if system.exists(live):
            system.mkdirs(old.getParent())
            system.rename(live, old)
        system.mkdirs(live.getParent())
        if not system.rename(new, live):
            raise OSError(f"{new} can't be moved to {live}")
    system.delete(journal, False)
    for name in ("_old", "_staging"):
        system.delete(at(f"{path}/{name}-{token}"), True)


def recover(spark: SparkSession, path: str) -> int:
    """Finish the swaps that were stopped after their journal; returns how many."""
    system, at = _files(spark, path)
    found = [s.getPath().getName().removeprefix("_journal-") for s in (system.listStatus(at(path)) if system.exists(at(path)) else ()) if s.getPath().getName().startswith("_journal-")]
    for token in found:
        _finish(spark, path, token)
    return len(found)


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """(date, collector, rows, files) of the partitions that exist."""
    rows = spark.read.parquet(path).select(F.col("date").cast("string").alias("date"), "collector", F.col("_metadata.file_path").alias("file"))
    return rows.groupBy("date", "collector").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("file").alias("files"))


def drop_partitions(spark: SparkSession, path: str, keys: list[tuple[str, str]]) -> int:
    """Delete the partitions (date, collector) that exist among ``keys``; returns how many did."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    gone = 0
    for date, collector in keys:
        folder = hadoop.Path(f"{path}/date={date}/collector={collector}")
        gone += bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))
    return gone


def compact(spark: SparkSession, path: str, most_files: int = 1, file_rows: int = 5_000_000) -> int:
    """Rewrite the partitions with more than ``most_files`` files (and more than their rows need), sorted; returns how
    many there were. Again, it does nothing. A partition is dealt over tasks by ranges of prefixes, one file each."""
    found = partitions(spark, path).where(F.col("files") > F.greatest(F.lit(most_files), F.ceil(F.col("rows") / file_rows))).collect()  # partitions, not rows
    for r in found:
        folder = f"{path}/date={r['date']}/collector={r['collector']}"
        rows = spark.read.option("basePath", path).parquet(folder).drop("date")
        files = -(-r["rows"] // file_rows)
        dealt = rows.withColumn("date", F.lit(r["date"]).cast("date")).repartitionByRange(files, "prefix", "ts") if files > 1 else rows.withColumn("date", F.lit(r["date"]).cast("date")).coalesce(1)
        _swap_sorted(dealt, path)
    return len(found)


def _swap_sorted(dealt: DataFrame, path: str) -> None:
    """``swap`` of one partition's rows as they are dealt."""
    spark, token = dealt.sparkSession, uuid.uuid4().hex
    recover(spark, path)
    layout = {"parquet.block.size": ROW_GROUP, "parquet.bloom.filter.enabled#prefix": "true"}
    dealt.sortWithinPartitions("prefix", "ts").write.options(**layout).partitionBy("date", "collector").parquet(f"{path}/_staging-{token}")
    _commit(spark, path, token)


def curate(
    spark: SparkSession, parsed: DataFrame, path: str, rib_path: str, collectors: list[str] | None = None, ipv4_only: bool = True, first: str | None = None, last: str | None = None, catalog=None
) -> None:
    """The curation job: normalised messages to element partitions, table dump rows to snapshots.

    IPv6 rows and those of other collectors go where asked, and those outside of the days from ``first`` to ``last``.
    The partitions written are recorded in ``catalog``.
    """
    if collectors is not None:
        parsed = parsed.where(F.col("collector").isin(collectors))
    if first is not None:
        parsed = parsed.where(F.to_date("ts") >= F.lit(first).cast("date"))
    if last is not None:
        parsed = parsed.where(F.to_date("ts") <= F.lit(last).cast("date"))
    write_elements(parsed.where("elem_type <> 'R'"), path, ipv4_only)
    rows = rib_snapshots(parsed.where("prefix_ip_version = 4") if ipv4_only else parsed).withColumn("date", F.to_date("snapshot_ts"))
    dealt = rows.repartitionByRange("date", "collector", "prefix").sortWithinPartitions("date", "collector", "prefix")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "collector").parquet(rib_path)
    if catalog is not None:
        keys = parsed.select(F.to_date("ts").cast("string").alias("date"), "collector", (F.col("elem_type") == "R").alias("rib")).distinct().collect()  # partitions
        for table, top, rib in (("elements", path, False), ("rib_snapshots", rib_path, True)):
            register(spark, top, table, [f"date={r['date']}/collector={r['collector']}" for r in keys if r["rib"] == rib], catalog)


def register(spark: SparkSession, path: str, table: str, keys: list[str], catalog) -> None:
    """Record the rows and bytes of partitions date=/collector= in the catalog."""
    system, at = _files(spark, path)
    held = [k for k in keys if system.exists(at(f"{path}/{k}"))]
    if not held:
        return
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/{k}" for k in held])
    counted = {(str(r["date"]), str(r["collector"])): r["count"] for r in rows.groupBy("date", "collector").count().collect()}
    found = []
    for k in held:
        date, collector = (part.split("=", 1)[1] for part in k.split("/"))
        found.append((table, date, collector, f"{path}/{k}", counted.get((date, collector), 0), system.getContentSummary(at(f"{path}/{k}")).getLength()))
    catalog.record_partitions(found)


def keep_history(snapshot: DataFrame, path: str, date: str) -> None:
    """Store a dated copy of a reference table; the same date is replaced."""
    snapshot.withColumn("snapshot_date", F.lit(date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)
