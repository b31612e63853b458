"""Readers of raw routing and reference files. Each returns a lazy DataFrame; bad records are dropped, as stated."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pathlight.functions import paths, prefixes

LIVE = "timestamp double, peer string, peer_asn string, path array<string>, host string, announcements array<struct<next_hop: string, prefixes: array<string>>>, withdrawals array<string>"


def normalise(rows: DataFrame) -> DataFrame:
    """Rows (ts, collector, peer_asn, peer_ip, elem_type, prefix, path_text, next_hop) to message elements.

    Rows whose prefix is invalid go; withdrawals have no origin and empty paths.
    """
    kind = F.coalesce(F.upper(F.substring("elem_type", 1, 1)), F.lit("A"))
    empty = F.array().cast("array<bigint>")
    held = rows.where(prefixes.is_valid(F.col("prefix"))).withColumn("elem_type", kind)
    held = held.withColumn("as_path", F.when(F.col("elem_type") == "W", empty).otherwise(paths.parse_path(F.col("path_text"))))
    held = held.withColumn("as_path_dedup", paths.drop_prepends(F.col("as_path")))
    more = ["sequence"] if "sequence" in rows.columns else []
    return held.select(
        *more, "ts", "collector", "peer_asn", "peer_ip", "elem_type", "prefix", prefixes.version(F.col("prefix")).alias("prefix_ip_version"), prefixes.length(F.col("prefix")).alias("prefix_len"),
        paths.origin(F.col("as_path_dedup")).alias("origin_asn"), "as_path", "as_path_dedup", F.size("as_path_dedup").alias("as_path_len"),
        ((F.col("elem_type") != "W") & paths.has_as_set(F.col("path_text"))).alias("has_as_set"), "next_hop",
    )


def sequenced(rows: DataFrame) -> DataFrame:
    """Rows of files with the part of their sequence that the scan knows: (time, file, block)."""
    return rows.select("*", F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).alias("sequence"))


def live_elements(messages: DataFrame) -> DataFrame:
    """Live messages (schema LIVE, from JSON lines) to elements: one for each announced and withdrawn prefix."""
    more = ["sequence"] if "sequence" in messages.columns else []
    base = [
        *more,
        F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("bigint")).cast("timestamp_ntz").alias("ts"), F.split("host", r"\.")[0].alias("collector"), F.col("peer_asn").cast("bigint").alias("peer_asn"), F.col("peer").alias("peer_ip"),
    ]
    path = F.array_join("path", " ")
    seen = messages.select(*base, path.alias("path_text"), F.explode("announcements").alias("x"))
    seen = seen.select(*more, "ts", "collector", "peer_asn", "peer_ip", F.lit("A").alias("elem_type"), F.explode("x.prefixes").alias("prefix"), "path_text", "x.next_hop")
    gone = messages.select(*base, F.explode("withdrawals").alias("prefix")).withColumns({"elem_type": F.lit("W"), "path_text": F.lit(""), "next_hop": F.lit(None).cast("string")})
    return normalise(seen.unionByName(gone))


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """Elements of JSON-lines files; lines that aren't JSON are skipped."""
    return live_elements(sequenced(spark.read.schema(LIVE).option("mode", "DROPMALFORMED").json(path)))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) in file order; a file is one split, as order matters."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return whole


def read_table_dump(spark: SparkSession, path: str, collector: str, ts: str) -> DataFrame:
    """Fixed-width route dump: columns by the offsets of the header; a line without a prefix continues the last one."""
    lines = _numbered_lines(spark, path)
    header = lines.where(F.col("line").rlike("Network.*Next Hop.*Path")).groupBy("file").agg(F.min_by("line", "n").alias("header"), F.min("n").alias("first"))
    met = lines.join(F.broadcast(header), "file").where("n > first and line rlike '^[*r ]'")
    at = lambda name: F.instr("header", name)
    cut = lambda a, b: F.trim(F.substring("line", a, b - a))
    own = F.nullif(cut(at("Network"), at("Next Hop")), F.lit(""))
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    held = met.withColumn("prefix", F.last(own, ignorenulls=True).over(order)).where(F.trim("line") != "")
    path_text = F.regexp_replace(F.trim(F.substring("line", at("Path"), F.lit(10_000))), r"\s+[ie?]$", "")
    rows = held.select(
        F.lit(ts).cast("timestamp_ntz").alias("ts"), F.lit(collector).alias("collector"), F.lit("R").alias("elem_type"), F.when(F.col("prefix").contains("/"), F.col("prefix")).otherwise(_classful(F.col("prefix"))).alias("prefix"),
        path_text.alias("path_text"), cut(at("Next Hop"), at("Metric")).alias("next_hop"),
    )
    rows = rows.withColumns({"peer_asn": F.substring_index("path_text", " ", 1).try_cast("bigint"), "peer_ip": F.col("next_hop")})
    return normalise(rows.where("path_text rlike '^[0-9]'"))


def _classful(address: Column) -> Column:
    first = F.substring_index(address, ".", 1).try_cast("int")
    return F.concat(address, F.lit("/"), F.when(first < 128, "8").when(first < 192, "16").otherwise("24"))


def read_delegated(spark: SparkSession, path: str, registry: str) -> DataFrame:
    """(asn, country_iso2, rir, allocation_date) of an extended delegation file: allocated and assigned AS blocks, one row for each number."""
    rows = spark.read.text(path).select(F.split("value", r"\|").alias("f")).where("size(f) >= 7 and f[2] = 'asn' and f[6] in ('allocated', 'assigned')")
    block = rows.select(F.get("f", F.lit(1)).alias("country_iso2"), F.lit(registry).alias("rir"), F.get("f", F.lit(5)).alias("allocation_date"), F.get("f", F.lit(3)).cast("bigint").alias("a"), F.get("f", F.lit(4)).cast("bigint").alias("n"))
    return block.where("n > 0").select(F.explode(F.sequence("a", F.col("a") + F.col("n") - 1)).alias("asn"), "country_iso2", "rir", "allocation_date")


def build_registry(files: list[DataFrame], african: list[str], snapshot: str) -> DataFrame:
    """One row for each AS number, the first file's; is_african by registry or by country."""
    rows = None
    for i, f in enumerate(files):
        f = f.withColumn("i", F.lit(i))
        rows = f if rows is None else rows.unionByName(f)
    first = rows.groupBy("asn").agg(F.min_by(F.struct("country_iso2", "rir", "allocation_date"), "i").alias("x")).select("asn", "x.*")
    return first.withColumn("is_african", (F.col("rir") == "afrinic") | F.col("country_iso2").isin(african)).withColumn("snapshot_date", F.lit(snapshot))


def read_roas(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, asn, max_len, ta) of ROA JSON: wrapped in ``roas``, AS numbers with or without AS, either spelling of the maximum length."""
    entry = "prefix string, asn string, maxLength int, max_length int, ta string"
    rows = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", f"roas array<struct<{entry.replace(' ', ': ').replace(',:', ',')}>>")["roas"], F.from_json("value", f"array<struct<{entry.replace(' ', ': ').replace(',:', ',')}>>"))
    each = rows.select(F.explode(listed).alias("r")).select("r.*")
    longest = F.coalesce(F.nullif("maxLength", F.lit(0)), F.nullif("max_length", F.lit(0)), F.substring_index("prefix", "/", -1).try_cast("int"))
    return each.select("prefix", F.regexp_replace(F.upper("asn"), "^AS", "").try_cast("bigint").alias("asn"), longest.alias("max_len"), "ta").where(prefixes.is_valid(F.col("prefix")) & F.col("asn").isNotNull())


def read_relationships(spark: SparkSession, path: str) -> DataFrame:
    """(as_a, as_b, relationship): code 0 is p2p, any other p2c; comments are skipped, compression is by file name."""
    rows = spark.read.text(path).where("value not like '#%' and value like '%|%|%'").select(F.split("value", r"\|").alias("f"))
    return rows.select(F.get("f", F.lit(0)).cast("bigint").alias("as_a"), F.get("f", F.lit(1)).cast("bigint").alias("as_b"), F.when(F.get("f", F.lit(2)) == "0", "p2p").otherwise("p2c").alias("relationship"))


def read_organisations(spark: SparkSession, path: str) -> DataFrame:
    """(asn, asn_name, org_id, org_name) of a file with two sections, each begun by a format line."""
    lines = _numbered_lines(spark, path).where("trim(line) <> ''")
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    section = F.when(F.col("line").rlike(r"^#\s*format:\s*aut\|"), "as").when(F.col("line").rlike(r"^#\s*format:\s*org_id\|"), "org")
    held = lines.withColumn("section", F.last(section, ignorenulls=True).over(order)).where("line not like '#%'").select("section", F.split("line", r"\|").alias("f"))
    f = lambda i: F.get("f", F.lit(i))
    numbers = held.where("section = 'as'").select(f(0).try_cast("bigint").alias("asn"), f(2).alias("asn_name"), f(3).alias("org_id")).where("asn is not null")
    names = held.where("section = 'org'").select(f(0).alias("org_id"), f(2).alias("org_name")).dropDuplicates(["org_id"])
    return numbers.join(names, "org_id", "left").select("asn", "asn_name", "org_id", "org_name")


def read_anycast(spark: SparkSession, path: str) -> DataFrame:
    """(prefix) of a catalogue without header; the first column, invalid values dropped."""
    rows = spark.read.csv(path, header=False)
    return rows.select(F.trim(F.col(rows.columns[0])).alias("prefix")).where(prefixes.is_valid(F.col("prefix"))).distinct()


def read_irr_objects(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, asn, source) of landed route objects: attributes as name and value."""
    kind = "objects struct<object: array<struct<attributes: struct<attribute: array<struct<name: string, value: string>>>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)["objects"]["object"]).alias("o"))
    named = rows.select(F.map_from_entries(F.array_distinct(F.filter(F.transform("o.attributes.attribute", lambda a: F.struct(a["name"], F.trim(a["value"]))), lambda a: a["name"].isin("route", "route6", "origin", "source")))).alias("m"))
    out = named.select(F.coalesce(F.col("m")["route"], F.col("m")["route6"]).alias("prefix"), F.regexp_replace(F.upper(F.col("m")["origin"]), "^AS", "").try_cast("bigint").alias("asn"), F.col("m")["source"].alias("source"))
    return out.where(prefixes.is_valid(F.col("prefix")) & F.col("asn").isNotNull()).distinct()


def read_as_sets(spark: SparkSession, path: str) -> DataFrame:
    """(as_set, member) of landed as-set objects; ``members`` may be repeated and hold lists."""
    kind = "objects struct<object: array<struct<attributes: struct<attribute: array<struct<name: string, value: string>>>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)["objects"]["object"]).alias("o"))
    of = lambda name: F.transform(F.filter("o.attributes.attribute", lambda a: a["name"] == name), lambda a: F.upper(F.trim(a["value"])))
    named = rows.select(F.get(of("as-set"), F.lit(0)).alias("as_set"), F.explode(of("members")).alias("listed")).where("as_set is not null")
    return named.select("as_set", F.explode(F.split("listed", r"[,\s]+")).alias("member")).where("member <> ''").distinct()


def archive_times(spark: SparkSession, start: str, end: str, minutes: int) -> DataFrame:
    """(ts, name): times of the archive files of a cadence, the first one at or before ``start``."""
    floor = F.expr(f"timestamp_seconds(floor(unix_seconds(timestamp'{start}') / {minutes * 60}) * {minutes * 60})")
    steps = spark.range(1).select(F.explode(F.sequence(floor, F.lit(end).cast("timestamp"), F.expr(f"interval {minutes} minutes"))).alias("t"))
    return steps.select(F.col("t").cast("timestamp_ntz").alias("ts"), F.concat(F.lit("updates."), F.date_format("t", "yyyyMMdd.HHmm")).alias("name"))


def export_csv(rows: DataFrame, path: str) -> None:
    """Semicolon-separated quoted lines; each file begins with a byte order mark, as spreadsheets expect, and a header."""
    header = "\ufeff" + ";".join('"' + c.replace('"', '""') + '"' for c in rows.columns)
    lines = rows.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"sep": ";", "quoteAll": "true", "escape": '"'}).alias("value"))

    def headed(batches):
        first = True
        for batch in batches:
            if batch.num_rows and first:
                yield pa.RecordBatch.from_arrays([pa.array([header])], names=["value"])
                first = False
            yield batch

    lines.mapInArrow(headed, "value string").write.mode("overwrite").text(path)
