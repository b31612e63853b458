"""Cards, timelines and histories (Q6, Q8, Q19, Q32) by sub-table, and IPv6 (X10, J9, D2), with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathlight.functions import paths, prefixes
from pathlight.operators import cards, origin
from pathlight.sources import history

from . import projection as p, stored
from .explorer_queries import _EV, _TRANSIT, _daily, _events
from .metric_queries import _DAYS, _VIS
from .projection import CTE
from .registry import ORACLES, query

_PFX = "197.32.0.0/12"
#: Events with AS numbers and prefixes, and incidents as the events of one customer.
_FULL = f"""(SELECT e.*, [100 + event_id % 7, 80 + event_id % 4] AS asns, concat('197.', CAST((event_id % 6) * 32 AS VARCHAR), '.0.0/12') AS prefix, o.o_custkey AS owner FROM ({_EV}) e JOIN orders o ON o.o_orderkey = e.event_id)"""


def _full(spark, d):
    owner = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("owner"))
    rows = _events(spark, d).withColumn("asns", F.array(100 + F.col("event_id") % 7, 80 + F.col("event_id") % 4))
    return rows.withColumn("prefix", F.concat(F.lit("197."), (F.col("event_id") % 6 * 32).cast("string"), F.lit(".0.0/12"))).join(owner, "event_id")


def _asn(spark, d):
    return cards.asn_card(105, p.elements(spark, d), p.asns(spark, d), stored.table(spark, d, "upstream"), _full(spark, d))


def _prefix(spark, d):
    return cards.prefix_card(_PFX, p.elements(spark, d), stored.table(spark, d, "visibility"), p.roas(spark, d), _full(spark, d))


@query("q6_asn_identity", CTE + " SELECT * FROM ref_asn WHERE asn = 105")
def q6_identity(spark, d):
    return _asn(spark, d)["identity"]


@query("q6_asn_prefixes", CTE + " SELECT prefix, count(*) AS updates, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT peer_asn) AS peers FROM obs WHERE origin_asn = 105 AND elem_type = 'A' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def q6_prefixes(spark, d):
    return _asn(spark, d)["prefixes"]


@query("q6_asn_upstreams", CTE + _TRANSIT + " SELECT main AS primary_upstream, round(avg(hhi), 6) AS hhi_transit, max(k) AS upstream_count, count(*) AS windows FROM t2 WHERE origin_asn = 105 GROUP BY 1")
def q6_upstreams(spark, d):
    return _asn(spark, d)["upstreams"].withColumn("hhi_transit", F.round("hhi_transit", 6))


@query("q6_asn_events", f"SELECT event_id, detector, severity, score, prefix, first_seen FROM {_FULL} WHERE list_contains(asns, 105) ORDER BY first_seen DESC, event_id LIMIT 50")
def q6_events(spark, d):
    return _asn(spark, d)["events"].select("event_id", "detector", "severity", "score", "prefix", "first_seen")


@query("q8_prefix_origins", CTE + f" SELECT origin_asn, count(*) AS announcements, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT peer_asn) AS peers FROM obs WHERE prefix = '{_PFX}' AND elem_type = 'A' AND origin_asn IS NOT NULL GROUP BY 1")
def q8_origins(spark, d):
    return _prefix(spark, d)["origins"]


@query("q8_prefix_top_paths", CTE + f" SELECT array_to_string(path, ' ') AS path, count(*) AS observations, count(DISTINCT peer_asn) AS peers FROM obs WHERE prefix = '{_PFX}' AND elem_type = 'A' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def q8_paths(spark, d):
    return _prefix(spark, d)["top_paths"]


@query("q8_prefix_visibility", CTE + _VIS + f" SELECT snapshot_ts, round(visibility_ratio, 9) AS visibility_ratio, peers_seeing, peers_total, collectors_seeing FROM vis WHERE prefix = '{_PFX}'")
def q8_visibility(spark, d):
    return _prefix(spark, d)["visibility"].withColumn("visibility_ratio", F.round("visibility_ratio", 9))


@query("q8_prefix_roa", CTE + f" SELECT prefix, asn, max_len FROM ref_roa WHERE prefix = '{_PFX}'")
def q8_roa(spark, d):
    return _prefix(spark, d)["roa"]


@query("q8_prefix_events", f"SELECT event_id, detector, severity, score, first_seen FROM {_FULL} WHERE prefix = '{_PFX}' ORDER BY first_seen DESC, event_id LIMIT 50")
def q8_events(spark, d):
    return _prefix(spark, d)["events"].select("event_id", "detector", "severity", "score", "first_seen")


def _timeline(spark, d):
    events = _full(spark, d)
    incidents = events.groupBy("owner").agg(F.array_sort(F.collect_list("event_id")).alias("event_ids"), F.max("score").alias("score"))
    return cards.event_timeline(7, events, incidents, stored.table(spark, d, "churn_prefix"), stored.table(spark, d, "visibility"))


@query("q32_incident", f"SELECT owner, array_to_string(list_sort(list(event_id)), ' ') AS event_ids, max(score) AS score FROM {_FULL} GROUP BY 1 HAVING list_contains(list(event_id), 7)")
def q32_incident(spark, d):
    return _timeline(spark, d)["incident"].withColumn("event_ids", paths.path_text(F.col("event_ids")))


@query("q32_related_events", f"SELECT event_id, detector, severity, score FROM {_FULL} WHERE event_id <> 7 AND owner = (SELECT o_custkey FROM orders WHERE o_orderkey = 7)")
def q32_related(spark, d):
    return _timeline(spark, d)["related"].select("event_id", "detector", "severity", "score")


@query("q32_event_churn", CTE + " SELECT time_bucket(INTERVAL 1 DAY, ts) AS ts, CAST(count(*) FILTER (WHERE elem_type = 'A') AS BIGINT) AS announcements, CAST(count(*) FILTER (WHERE elem_type = 'W') AS BIGINT) AS withdrawals, count(*) AS updates_total FROM obs WHERE elem_type <> 'R' AND prefix = '197.32.0.0/12' GROUP BY 1")
def q32_churn(spark, d):
    return _timeline(spark, d)["churn"]


@query("q19_daily_observations", CTE + _DAYS + " SELECT cal.day, CAST(count(o.ts) AS BIGINT) AS observations FROM cal LEFT JOIN (SELECT ts, date_trunc('day', ts) AS day FROM obs WHERE elem_type = 'A' AND origin_asn = 107 AND prefix = '197.32.16.0/20') o ON o.day = cal.day GROUP BY 1")
def q19_daily(spark, d):
    return cards.prefix_history(107, "197.32.16.0/20", _daily(spark, d))["daily"]


@query("o8_filter_after_aggregation", CTE + ", a AS (SELECT prefix, count(*) AS updates, count(DISTINCT origin_asn) AS origins, max(ts) AS last_seen FROM obs WHERE elem_type <> 'R' GROUP BY 1), mo AS (SELECT prefix, origin_asn FROM (SELECT prefix, origin_asn, row_number() OVER (PARTITION BY prefix ORDER BY count(*) DESC, origin_asn) AS k FROM obs WHERE elem_type <> 'R' AND origin_asn IS NOT NULL GROUP BY 1, 2) WHERE k = 1) SELECT prefix, updates, origin_asn, origins, last_seen, (SELECT count(*) FROM a WHERE updates >= (SELECT count(*) / 50 FROM obs)) AS total FROM a JOIN mo USING (prefix) WHERE updates >= (SELECT count(*) / 50 FROM obs) ORDER BY updates DESC, prefix LIMIT 4 OFFSET 2")
def o8(spark, d):
    from pathlight.operators import explorer

    daily = _daily(spark, d)
    least = daily.agg(F.sum(F.col("announcements") + F.col("withdrawals") + F.col("rib_rows"))).first()[0] / 50
    return explorer.prefix_list(daily, 4, 2, least_updates=least, total=True)


@query("q14_roa_intervals", ORACLES["q14_roa_history"])
def q14_intervals(spark, d):
    """The history of q14 by merging one dated snapshot after the other."""
    held, rows = None, p.roas(spark, d)
    days = [f"2024-01-0{k + 1}" for k in range(5)]
    for k, day in enumerate(days):
        snapshot = rows.where(f"(asn + {k}) % 4 <> 1 or asn = 104")
        held = history.merge(held, snapshot, ["prefix", "asn"], day, days[k - 1] if k else None)
    return history.presence(held, ["prefix", "asn"], days[0], days[-1])


#: IPv6 prefixes from events, some of them written with an embedded IPv4 address, and authorisations from parts.
_V6 = """SELECT DISTINCT event_id % 40 AS k, event_id % 7 AS b, 32 + event_id % 3 * 8 AS len, 100 + event_id % 11 AS origin_asn,
 CASE WHEN event_id % 5 = 0 THEN concat('2c0f:', CAST(1000 + event_id % 40 AS VARCHAR(9)), ':', CAST(event_id % 7 AS VARCHAR(9)), '00:0:0:0:10.0.', CAST(event_id % 3 AS VARCHAR(9)), '.1/', CAST(32 + event_id % 3 * 8 AS VARCHAR(9)))
 ELSE concat('2C0F:', CAST(1000 + event_id % 40 AS VARCHAR(9)), ':', CAST(event_id % 7 AS VARCHAR(9)), '00::/', CAST(32 + event_id % 3 * 8 AS VARCHAR(9))) END AS prefix FROM events"""
_ROA6 = "SELECT DISTINCT concat('2c0f:', CAST(1000 + p_partkey % 40 AS VARCHAR(9)), '::/32') AS prefix, 100 + p_partkey % 40 % 11 AS asn, 32 + p_partkey % 40 % 2 * 8 AS max_len FROM part WHERE p_partkey % 40 % 4 <> 0"
_HEX = "CAST(concat('0x', CAST(1000 + k AS VARCHAR)) AS BIGINT)"


@query("x10_ipv6_keys", f"SELECT DISTINCT prefix, 6 AS version, CAST(len AS INTEGER) AS length, substr(concat('0010110000001111', lpad(bin({_HEX}), 16, '0'), lpad(bin(b * 256), 16, '0')), 1, CAST(len AS INTEGER)) AS key FROM ({_V6})")
def x10_ipv6(spark, d):
    rows = p._view(spark, d, _V6, "events").select("prefix").distinct().where(prefixes.is_valid(F.col("prefix")))
    return rows.select("prefix", prefixes.version(F.col("prefix")).alias("version"), prefixes.length(F.col("prefix")).alias("length"), prefixes.key(F.col("prefix")).alias("key"))


@query("d2_ipv6_validation", f"""WITH v AS ({_V6}), r AS ({_ROA6}) SELECT v.prefix, v.origin_asn, CASE WHEN count(r.asn) = 0 THEN 'not-found' WHEN bool_or(r.asn = v.origin_asn AND v.len <= r.max_len) THEN 'valid' ELSE 'invalid' END AS rpki_status
 FROM v LEFT JOIN r ON r.prefix = concat('2c0f:', CAST(1000 + v.k AS VARCHAR), '::/32') GROUP BY 1, 2""")
def d2_ipv6(spark, d):
    pairs = p._view(spark, d, _V6, "events").select("prefix", "origin_asn").distinct()
    return origin.validate_rpki(pairs, p._view(spark, d, _ROA6, "part")).select("prefix", "origin_asn", "rpki_status")
