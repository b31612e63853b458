"""Scalar functions (X) and predicates (P) with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pathlight.functions import ids, paths, prefixes, windows

from . import projection as p
from .projection import BITS, CTE, VERSION
from .registry import query, uuid_sql


@query("x1_parse_path", """WITH t AS (SELECT o_orderkey AS k, concat(CAST(o_orderkey % 7 AS VARCHAR), ' {', CAST(o_custkey AS VARCHAR), ',12} ', CAST(o_orderkey % 3 AS VARCHAR), '.', CAST(o_custkey % 9 AS VARCHAR), ' x') AS s FROM orders)
 SELECT k, concat(CAST(k % 7 AS VARCHAR), ' ', split_part(split_part(s, '{', 2), ',', 1), ' 12 ', CAST((k % 3) * 65536 + CAST(split_part(split_part(s, '.', 2), ' ', 1) AS BIGINT) AS VARCHAR)) AS path, s LIKE '%{%' AS has_as_set FROM t""")
def x1(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    s = F.concat((F.col("o_orderkey") % 7).cast("string"), F.lit(" {"), F.col("o_custkey").cast("string"), F.lit(",12} "), (F.col("o_orderkey") % 3).cast("string"), F.lit("."), (F.col("o_custkey") % 9).cast("string"), F.lit(" x"))
    o = o.select(F.col("o_orderkey").alias("k"), s.alias("s"))
    return o.select("k", paths.path_text(paths.parse_path(F.col("s"))).alias("path"), paths.has_as_set(F.col("s")).alias("has_as_set"))


@query("x2_drop_prepends", CTE + " SELECT seq, array_to_string(path, ' ') AS path, coalesce(path[len(path)], -1) AS origin, coalesce(CASE WHEN len(path) >= 2 THEN path[len(path) - 1] END, -1) AS upstream FROM obs")
def x2(spark, d):
    e = p.elements(spark, d)
    return e.select("seq", paths.path_text(F.col("path")).alias("path"), F.coalesce(paths.origin(F.col("path")), F.lit(-1)).alias("origin"), F.coalesce(paths.upstream(F.col("path")), F.lit(-1)).alias("upstream"))


@query("x4_first_position", CTE + " SELECT seq, CAST(coalesce(list_position(path, 81), 0) AS BIGINT) AS at, coalesce(path[list_position(path, 81) + 1], -1) AS following FROM obs WHERE len(path) > 0")
def x4(spark, d):
    e = p.elements(spark, d).where("as_path_len > 0").select("seq", "path", F.array_position("path", F.lit(81)).alias("at"))
    return e.select("seq", "at", F.coalesce(F.when(F.col("at") > 0, F.get("path", F.col("at"))), F.lit(-1)).alias("following"))


@query("x7_orient", CTE + " SELECT seq, array_to_string(CASE WHEN len(list_filter(path, lambda x: x BETWEEN 80 AND 81)) = 0 THEN list_reverse(path) ELSE list_reverse(path)[1 : list_position(list_transform(list_reverse(path), lambda x: x BETWEEN 80 AND 81), true)] END, ' ') AS path FROM obs WHERE len(path) > 0")
def x7(spark, d):
    targets = F.array(F.lit(80).cast("bigint"), F.lit(81).cast("bigint"))
    return p.elements(spark, d).where("as_path_len > 0").select("seq", paths.path_text(paths.orient(F.col("path"), targets)).alias("path"))


@query("x8_links", CTE + " SELECT a, b, count(*) AS n FROM (SELECT path[i] AS a, path[i + 1] AS b FROM (SELECT path, unnest(range(1, len(path))) AS i FROM obs WHERE len(path) >= 2)) GROUP BY 1, 2")
def x8(spark, d):
    links = p.elements(spark, d).select(F.explode(paths.links(F.col("path"))).alias("l"))
    return links.groupBy(F.col("l.a").alias("a"), F.col("l.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("x10_prefix_parts", CTE + f" SELECT DISTINCT prefix, {VERSION} AS version, CAST(split_part(prefix, '/', 2) AS INTEGER) AS length, substr({BITS}, 1, CAST(split_part(prefix, '/', 2) AS INTEGER)) AS key FROM obs")
def x10(spark, d):
    held = p.elements(spark, d).select("prefix").distinct().where(prefixes.is_valid(F.col("prefix")))
    return held.select("prefix", prefixes.version(F.col("prefix")).alias("version"), prefixes.length(F.col("prefix")).alias("length"), prefixes.key(F.col("prefix")).alias("key"))


@query("x12_reserved_asn", "SELECT asn, asn IN (0, 23456) OR asn BETWEEN 64512 AND 65535 OR asn BETWEEN 4200000000 AND 4294967295 AS reserved FROM (SELECT DISTINCT (o_orderkey * 7919 * 31) % 4294967296 AS asn FROM orders UNION SELECT 64000 + o_orderkey FROM orders WHERE o_orderkey < 2000 UNION SELECT o_orderkey * 23456 FROM orders WHERE o_orderkey < 2)")
def x12(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    a = o.select(((F.col("o_orderkey") * 7919 * 31) % 4294967296).alias("asn")).union(o.where("o_orderkey < 2000").selectExpr("64000 + o_orderkey")).union(o.where("o_orderkey < 2").selectExpr("o_orderkey * 23456")).distinct()
    return a.select("asn", prefixes.reserved_asn(F.col("asn")).alias("reserved"))


@query("x13_epoch_floor", "SELECT event_id, make_timestamp((epoch_us(ts) // 300000000) * 300000000) AS file_window, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS day_number FROM events")
def x13(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.window("ts", "5 minutes")["start"].alias("file_window"), (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).cast("bigint").alias("day_number"))


@query("x16_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def x16(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("x18_short_id", CTE + " SELECT DISTINCT prefix, substr(sha1(prefix), 1, 16) AS id, sha256(prefix) AS digest FROM obs")
def x18(spark, d):
    return p.elements(spark, d).select("prefix").distinct().select("prefix", ids.short_id(F.col("prefix")).alias("id"), F.sha2("prefix", 256).alias("digest"))


@query("x17_uuid5", CTE + f" SELECT prefix, {uuid_sql(uuid.NAMESPACE_URL, 'prefix')} AS id FROM (SELECT DISTINCT prefix FROM obs)")
def x17(spark, d):
    held = p.elements(spark, d).select("prefix").distinct()
    return held.select("prefix", ids.uuid5(uuid.NAMESPACE_URL, F.col("prefix")).alias("id"))


@query("x19_clamp_round", "SELECT l_orderkey, l_linenumber, round(least(1.0, greatest(0.0, l_quantity / 40 - l_discount)), 3)::DOUBLE AS score FROM lineitem")
def x19(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("l_quantity") / 40 - F.col("l_discount"))), 3).alias("score"))


@query("p2_day_range", CTE + " SELECT collector, prefix, count(*) AS n FROM obs WHERE ts >= DATE '2024-01-05' AND ts < DATE '2024-01-09' + INTERVAL 1 DAY GROUP BY 1, 2")
def p2(spark, d):
    rows = p.elements(spark, d).where("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-09' + interval 1 day")
    return rows.groupBy("collector", "prefix").agg(F.count(F.lit(1)).alias("n"))


@query("p4_overlap", CTE + " SELECT prefix, origin_asn, collector, peer_asn, min(ts) AS first_seen, max(ts) AS last_seen FROM obs WHERE elem_type = 'A' GROUP BY 1, 2, 3, 4 HAVING max(ts) >= TIMESTAMP '2024-01-10' AND min(ts) <= TIMESTAMP '2024-01-12'")
def p4(spark, d):
    spans = p.elements(spark, d).where("elem_type = 'A'").groupBy("prefix", "origin_asn", "collector", "peer_asn").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return spans.where("last_seen >= timestamp_ntz'2024-01-10' and first_seen <= timestamp_ntz'2024-01-12'")


@query("p8_semi_join", CTE + " SELECT prefix, count(*) AS n FROM obs WHERE origin_asn IN (SELECT asn FROM ref_asn WHERE country_iso2 = 'NATION_5') AND list_contains(path, 81) GROUP BY 1 HAVING count(*) > 2")
def p8(spark, d):
    local = p.asns(spark, d).where("country_iso2 = 'NATION_5'").select(F.col("asn").alias("origin_asn"))
    rows = p.elements(spark, d).where(F.array_contains("path", F.lit(81).cast("bigint"))).join(local, "origin_asn", "left_semi")
    return rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 2")


@query("p15_role_default", CTE + " SELECT DISTINCT o.collector, coalesce(r.role, 'local') AS role FROM obs o LEFT JOIN roles r USING (collector)")
def p15(spark, d):
    return p.elements(spark, d).select("collector").distinct().join(p.roles(spark, d), "collector", "left").select("collector", F.coalesce("role", F.lit("local")).alias("role"))


@query("w4_auto_bucket", CTE + ", s AS (SELECT date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 AS n FROM obs) SELECT time_bucket(INTERVAL 24 HOUR, ts) AS bucket, count(*) AS n FROM obs, s WHERE s.n > 16 GROUP BY 1")
def w4(spark, d):
    e = p.elements(spark, d)
    span = e.agg((F.datediff(F.max(F.to_date("ts")), F.min(F.to_date("ts"))) + 1).alias("n")).first()["n"]
    return e.groupBy(windows.bucket(F.col("ts"), windows.auto_bucket_hours(span or 0)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
