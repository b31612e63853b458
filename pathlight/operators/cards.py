"""Cards and timelines: all that is shown of one AS, one prefix or one event, as named lazy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pathlight.functions import paths, windows

SHOWN_PREFIXES, SHOWN_PATHS, SHOWN_EVENTS = 200, 15, 50


def asn_card(asn: int, elements: DataFrame, asns: DataFrame, upstream: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """identity, prefixes that the AS announces, its main upstreams over all windows, and its latest events."""
    announced = elements.where((F.col("origin_asn") == asn) & (F.col("elem_type") == "A"))
    prefixes = announced.groupBy("prefix").agg(F.count(F.lit(1)).alias("updates"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_distinct("peer_asn").alias("peers"))
    main = upstream.where(F.col("origin_asn") == asn).groupBy("primary_upstream").agg(F.avg("hhi_transit").alias("hhi_transit"), F.max("upstream_count").alias("upstream_count"), F.count(F.lit(1)).alias("windows"))
    own = events.where(F.array_contains("asns", F.lit(asn).cast("bigint")))
    return {
        "identity": asns.where(F.col("asn") == asn), "prefixes": prefixes.orderBy(F.desc("updates"), "prefix").limit(SHOWN_PREFIXES),
        "upstreams": main.orderBy(F.desc("windows"), "primary_upstream"), "events": own.orderBy(F.desc("first_seen"), "event_id").limit(SHOWN_EVENTS),
    }


def prefix_card(prefix: str, elements: DataFrame, visibility: DataFrame, roas: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """origins, top_paths, visibility by snapshot, the authorisations of just this prefix, and its latest events."""
    announced = elements.where((F.col("prefix") == prefix) & (F.col("elem_type") == "A"))
    origins = announced.where("origin_asn is not null").groupBy("origin_asn").agg(F.count(F.lit(1)).alias("announcements"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_distinct("peer_asn").alias("peers"))
    top = announced.groupBy(paths.path_text(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("peer_asn").alias("peers"))
    seen = visibility.where(F.col("prefix") == prefix).select("snapshot_ts", "visibility_ratio", "peers_seeing", "peers_total", "collectors_seeing")
    return {
        "origins": origins.orderBy(F.desc("announcements"), "origin_asn"), "top_paths": top.orderBy(F.desc("observations"), "path").limit(SHOWN_PATHS), "visibility": seen.orderBy("snapshot_ts"),
        "roa": roas.where(F.col("prefix") == prefix), "events": events.where(F.col("prefix") == prefix).orderBy(F.desc("first_seen"), "event_id").limit(SHOWN_EVENTS),
    }


def event_timeline(event_id, events: DataFrame, incidents: DataFrame, churn: DataFrame, visibility: DataFrame) -> dict[str, DataFrame]:
    """event, the incident that it belongs to, the incident's other events by score, and its prefix's churn and visibility."""
    event = events.where(F.col("event_id") == event_id)
    incident = incidents.where(F.array_contains("event_ids", F.lit(event_id).cast(incidents.schema["event_ids"].dataType.elementType)))
    others = incident.select(F.explode("event_ids").alias("event_id")).where(F.col("event_id") != event_id)
    own = event.where("prefix is not null").select("prefix")
    updates = churn.join(F.broadcast(own), "prefix", "left_semi").groupBy(F.col("window_start").alias("ts"))  # one row
    return {
        "event": event, "incident": incident, "related": events.join(others, "event_id", "left_semi").orderBy(F.desc("score"), "event_id"),
        "churn": updates.agg(*[F.sum(c).alias(c) for c in ("announcements", "withdrawals", "updates_total")]).orderBy("ts"),
        "visibility": visibility.join(F.broadcast(own), "prefix", "left_semi").select(F.col("snapshot_ts").alias("ts"), "visibility_ratio", "visibility_local", "visibility_external", "peers_seeing", "peers_total").orderBy("ts"),
    }


def prefix_history(asn: int, prefix: str, daily: DataFrame) -> dict[str, DataFrame]:
    """runs of collection days on which the AS announced the prefix, and its announcements on each collection day, zero included."""
    own = daily.where((F.col("origin_asn") == asn) & (F.col("prefix") == prefix) & (F.col("announcements") > 0))
    days = daily.select("day").distinct()
    counted = own.groupBy("day").agg(F.sum("announcements").alias("observations"))
    return {"runs": windows.islands(own, ["prefix", "origin_asn"], daily), "daily": days.join(counted, "day", "left").fillna(0, ["observations"]).orderBy("day")}
