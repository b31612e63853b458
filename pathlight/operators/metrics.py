"""Metric tables over message elements and table dumps. Every function returns one lazy DataFrame.

Only aggregations with partial combination and small reference joins; distinct counts are computed on
the grouping shuffle itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathlight.functions import paths, windows

from . import origin


def distinct_with_null(column: Column) -> Column:
    """Number of distinct values, null counting as one of them."""
    return F.count_distinct(column) + F.max(F.when(column.isNull(), 1).otherwise(0)).cast("bigint")


def _counts() -> list[Column]:
    return [F.count_if(F.col("elem_type") == "A").alias("announcements"), F.count_if(F.col("elem_type") == "W").alias("withdrawals"), F.count(F.lit(1)).alias("updates_total")]


def churn_by_prefix(elements: DataFrame, window: str = "1h") -> DataFrame:
    rows = elements.where("elem_type <> 'R'").withColumn("window_start", windows.tumbling(F.col("ts"), window))
    return rows.groupBy("window_start", "collector", "prefix").agg(*_counts(), F.count_distinct("peer_asn").alias("distinct_peers"), distinct_with_null(F.col("origin_asn")).alias("distinct_origins"))


def churn_by_asn(elements: DataFrame, window: str = "1h") -> DataFrame:
    rows = elements.where("elem_type <> 'R' and origin_asn is not null").withColumn("window_start", windows.tumbling(F.col("ts"), window))
    return rows.groupBy("window_start", "collector", "origin_asn").agg(*_counts(), F.count_distinct("prefix").alias("distinct_prefixes"))


def smallest_mode(column: str) -> Column:
    """The most frequent value, the smallest of several."""
    return F.expr(f"mode() within group (order by {column})")


def visibility(rib: DataFrame, roles: DataFrame) -> DataFrame:
    """Share of peers that see a prefix in each snapshot, over the collectors that see it, and by role."""
    totals = rib.groupBy("snapshot_ts", "collector").agg(F.count_distinct("peer_asn").alias("peers_total"))
    seen = rib.groupBy("snapshot_ts", "collector", "prefix").agg(
        F.count_distinct("peer_asn").alias("peers_seeing"), smallest_mode("origin_asn").alias("origin_asn"), F.median("as_path_len").alias("median_path_len")
    )
    joined = seen.join(totals, ["snapshot_ts", "collector"], "left").join(roles, "collector", "left")
    joined = joined.withColumn("ratio", F.col("peers_seeing") / F.col("peers_total")).withColumn("role", F.coalesce("role", F.lit("local")))
    by_role = lambda role: F.avg(F.when(F.col("role") == role, F.col("ratio")))
    out = joined.groupBy("snapshot_ts", "prefix").agg(
        F.sum("peers_seeing").alias("peers_seeing"), F.sum("peers_total").alias("peers_total"), F.count_distinct("collector").alias("collectors_seeing"), smallest_mode("origin_asn").alias("origin_asn"),
        F.median("median_path_len").alias("median_path_len"), by_role("local").alias("visibility_local"), by_role("external").alias("visibility_external"),
    )
    return out.withColumn("visibility_ratio", F.col("peers_seeing") / F.col("peers_total"))


def path_evolution(elements: DataFrame, window: str = "1h") -> DataFrame:
    rows = elements.where("elem_type = 'A' and origin_asn is not null").withColumn("window_start", windows.tumbling(F.col("ts"), window))
    return rows.groupBy("window_start", "prefix").agg(
        F.count_distinct(paths.path_text(F.col("path"))).alias("distinct_paths"), F.count_distinct("origin_asn").alias("distinct_origins"), F.array_sort(F.collect_set("origin_asn")).alias("origins"),
        F.median("as_path_len").alias("median_path_len"), F.max("as_path_len").alias("max_path_len"), F.bool_or("has_as_set").alias("has_as_set"), F.count(F.lit(1)).alias("announcements"),
        F.count_distinct("peer_asn").alias("peers"),
    )


def upstreams(elements: DataFrame, window: str = "1h") -> DataFrame:
    """Upstreams of each origin with the concentration (sum of squared shares) and the main one."""
    rows = elements.where("elem_type = 'A' and as_path_len >= 2").withColumn("upstream_asn", paths.upstream(F.col("path"))).where("upstream_asn is not null")
    rows = rows.withColumn("window_start", windows.tumbling(F.col("ts"), window))
    each = rows.groupBy("window_start", "origin_asn", "upstream_asn").agg(F.count(F.lit(1)).alias("n"))
    each = each.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("window_start", "origin_asn")))
    return each.groupBy("window_start", "origin_asn").agg(
        F.array_sort(F.collect_set("upstream_asn")).alias("upstreams"), F.count_distinct("upstream_asn").alias("upstream_count"),
        F.max_by("upstream_asn", F.struct("n", -F.col("upstream_asn"))).alias("primary_upstream"), F.sum(F.col("share") * F.col("share")).alias("hhi_transit"), F.sum("n").alias("observations"),
    )


def coverage(elements: DataFrame, asns: DataFrame, by_day: bool = False) -> DataFrame:
    """Observed and allocated AS numbers of each African country, over all elements or of each day by itself."""
    african, day = asns.where("is_african"), windows.day(F.col("ts")).alias("day")
    keys = ["day", "country_iso2"] if by_day else ["country_iso2"]
    seen = elements.where("origin_asn is not null").select(*[day] * by_day, F.col("origin_asn").alias("asn")).distinct().join(african, "asn").groupBy(*keys).agg(F.count_distinct("asn").alias("observed_asns"))
    total = african.groupBy("country_iso2").agg(F.count_distinct("asn").alias("allocated_asns"))
    if by_day:
        days = elements.agg(F.collect_set(day).alias("days"))  # one row
        total = total.join(F.broadcast(days)).select("country_iso2", "allocated_asns", F.explode("days").alias("day"))
    out = total.join(seen, keys, "left").withColumn("observed_asns", F.coalesce("observed_asns", F.lit(0).cast("bigint")))
    return out.withColumn("coverage_ratio", F.col("observed_asns") / F.col("allocated_asns"))


def country(elements: DataFrame, rib: DataFrame, asns: DataFrame, roles: DataFrame, window: str = "1h", by_day: bool = False) -> DataFrame:
    """Transit indicators of African countries by window, with mean visibility and coverage of the country: over all
    rows, or those of the window's day."""
    african = asns.where("is_african")
    up = upstreams(elements, window)
    flags = asns.select(F.col("asn").alias("primary_upstream"), F.col("is_african").alias("upstream_african"))
    rows = up.join(african.select(F.col("asn").alias("origin_asn"), "country_iso2"), "origin_asn").join(flags, "primary_upstream", "left")
    out = rows.groupBy("window_start", "country_iso2").agg(
        F.count_distinct("origin_asn").alias("asns"), F.avg("hhi_transit").alias("avg_hhi"), F.avg("upstream_count").alias("avg_upstreams"),
        (1 - F.avg(F.coalesce("upstream_african", F.lit(False)).cast("int"))).alias("transit_dependency_ratio"),
    )
    keys = ["day", "country_iso2"] if by_day else ["country_iso2"]
    seen = visibility(rib, roles).join(african.select(F.col("asn").alias("origin_asn"), "country_iso2"), "origin_asn")
    if by_day:
        out, seen = out.withColumn("day", windows.day(F.col("window_start"))), seen.withColumn("day", windows.day(F.col("snapshot_ts")))
    vis = seen.groupBy(*keys).agg(F.avg("visibility_ratio").alias("visibility"))
    return out.join(vis, keys, "left").join(coverage(elements, asns, by_day).select(*keys, "coverage_ratio"), keys, "left")


def rpki_coverage(elements: DataFrame, asns: DataFrame, roas: DataFrame, by_day: bool = False) -> DataFrame:
    """Announced prefixes of each African country by origin validity, over all elements or of each day by itself; a
    prefix may be in several classes."""
    announced = elements.where("elem_type = 'A' and origin_asn is not null")
    pairs = announced.select("prefix", "origin_asn").distinct()
    rows = origin.validate_rpki(pairs, roas).join(asns.where("is_african").select(F.col("asn").alias("origin_asn"), "country_iso2"), "origin_asn")
    keys = ["day", "country_iso2"] if by_day else ["country_iso2"]
    if by_day:
        rows = announced.select(windows.day(F.col("ts")).alias("day"), "prefix", "origin_asn").distinct().join(rows, ["prefix", "origin_asn"])
    of = lambda s: F.count_distinct(F.when(F.col("rpki_status") == s, F.col("prefix")))
    out = rows.groupBy(*keys).agg(F.count_distinct("prefix").alias("announced"), of("valid").alias("valid"), of("invalid").alias("invalid"), of("not-found").alias("not_found"))
    return out.withColumn("valid_ratio", F.col("valid") / F.col("announced"))


def daily_prefix_origin(elements: DataFrame, detail: bool = False) -> DataFrame:
    """Announcements, withdrawals and dump rows by day, prefix and origin; a null origin is a group.

    ``detail`` adds the address family and the time of the last message.
    """
    of = lambda t: F.count_if(F.col("elem_type") == t)
    more = [F.max("prefix_ip_version").alias("ip_version"), F.max(F.when(F.col("elem_type") != "R", F.col("ts"))).alias("last_update")] if detail else []
    return elements.groupBy(windows.day(F.col("ts")).alias("day"), "prefix", "origin_asn").agg(of("A").alias("announcements"), of("W").alias("withdrawals"), of("R").alias("rib_rows"), *more)


def daily_adjacency(elements: DataFrame) -> DataFrame:
    """Neighbours of each AS by day, at its first occurrence in a path. Paths are made distinct before they explode."""
    held = elements.where(F.size("path") >= 2).select(windows.day(F.col("ts")).alias("day"), F.col("prefix_ip_version").alias("ip_version"), "path").distinct()
    at = held.select("day", "ip_version", "path", F.posexplode("path").alias("pos", "asn")).where(F.array_position("path", F.col("asn")) == F.col("pos") + 1)
    both = at.select("day", "ip_version", "asn", F.explode(F.array(F.get("path", F.col("pos") - 1), F.get("path", F.col("pos") + 1))).alias("neighbour"))
    return both.where("neighbour is not null").distinct()
