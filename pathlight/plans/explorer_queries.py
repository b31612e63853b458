"""Read queries (Q) with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pathlight.functions import paths
from pathlight.operators import detectors, explorer, metrics

from . import projection as p
from . import stored
from .metric_queries import ADJ, NET, _DAYS, _VIS
from .projection import CTE
from .reference_queries import REL
from .registry import ORACLES, query

_NAMED = "CASE relation WHEN 'up' THEN 'provider' WHEN 'down' THEN 'customer' WHEN 'peer' THEN 'peer' ELSE 'unknown' END"
_STATUS = "CASE WHEN regexp_matches(s, '^1*$') THEN 'stable' WHEN regexp_matches(s, '10+1') THEN 'unstable' WHEN regexp_matches(s, '^0+1+$') THEN 'new' WHEN regexp_matches(s, '^1+0+$') THEN 'left' ELSE 'unstable' END"
_DPO = ", dpo AS (SELECT DISTINCT date_trunc('day', ts) AS day, prefix, origin_asn FROM obs WHERE elem_type <> 'W')"


@query("q1_health", CTE + " SELECT 'events' AS layer, count(*) AS n_rows, min(ts) AS first, max(ts) AS last FROM obs UNION ALL SELECT 'rib', count(*), min(date_trunc('day', ts)), max(date_trunc('day', ts)) FROM obs WHERE elem_type = 'R'")
def q1(spark, d):
    return explorer.health({"events": (p.elements(spark, d), "ts"), "rib": (p.rib(spark, d), "snapshot_ts")})


@query("q3_overview", CTE + " SELECT count(DISTINCT prefix) AS prefixes, count(DISTINCT origin_asn) AS asns, CAST(count(*) FILTER (WHERE elem_type <> 'R') AS BIGINT) AS updates FROM obs WHERE ts >= (SELECT max(ts) FROM obs) - INTERVAL 7 DAY")
def q3(spark, d):
    return explorer.overview(p.elements(spark, d), 7)


@query("q4_asn_names", CTE + " SELECT asn, coalesce(asn_name, org_name) AS name FROM ref_org")
def q4(spark, d):
    return p.orgs(spark, d).select("asn", F.coalesce("asn_name", "org_name").alias("name"))


@query("q5_asn_list", CTE + " SELECT o.origin_asn AS asn, count(DISTINCT prefix) AS prefixes, count(*) AS updates, any_value(a.country_iso2) AS country_iso2 FROM obs o LEFT JOIN ref_asn a ON a.asn = o.origin_asn WHERE o.origin_asn IS NOT NULL GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10 OFFSET 1")
def q5(spark, d):
    return explorer.asn_list(_daily(spark, d), p.asns(spark, d), 10, 1).drop("is_african")


_TRANSIT = """, t0 AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, origin_asn, path[len(path) - 1] AS u, count(*) AS n FROM obs WHERE elem_type = 'A' AND len(path) >= 2 GROUP BY 1, 2, 3),
 t1 AS (SELECT *, n / sum(n) OVER (PARTITION BY w, origin_asn) AS s FROM t0), t2 AS (SELECT w, origin_asn, count(*) AS k, arg_max(u, (n, -u)) AS main, sum(s * s) AS hhi, sum(n) AS n FROM t1 GROUP BY 1, 2),
 t3 AS (SELECT origin_asn AS asn, max(k) AS upstream_count, arg_max(main, (n, w)) AS primary_upstream, round(avg(hhi), 6) AS hhi_transit FROM t2 GROUP BY 1)"""


@query("q5_asn_page", CTE + _TRANSIT + """, base AS (SELECT o.origin_asn AS asn, a.country_iso2, a.is_african, count(DISTINCT prefix) AS prefixes, count(*) AS updates FROM obs o LEFT JOIN ref_asn a ON a.asn = o.origin_asn WHERE o.origin_asn IS NOT NULL AND a.is_african AND CAST(o.origin_asn AS VARCHAR) LIKE '%0%' GROUP BY 1, 2, 3),
 ev AS (SELECT asn, count(*) AS n FROM (SELECT unnest([100 + o_orderkey % 7, 80 + o_orderkey % 4]) AS asn FROM orders) GROUP BY 1)
 SELECT b.*, (SELECT count(*) FROM base) AS total, upstream_count, primary_upstream, hhi_transit, coalesce(ev.n, 0) AS open_events FROM (SELECT * FROM base ORDER BY updates DESC, asn LIMIT 50) b LEFT JOIN t3 USING (asn) LEFT JOIN ev USING (asn)""")
def q5b(spark, d):
    page = explorer.asn_list(_daily(spark, d), p.asns(spark, d), 50, african_only=True, text="0", total=True)
    events = spark.read.parquet(f"{d}/orders.parquet").select(F.array(100 + F.col("o_orderkey") % 7, 80 + F.col("o_orderkey") % 4).alias("asns"))
    return explorer.asn_details(page, stored.table(spark, d, "upstream"), events).withColumn("hhi_transit", F.round("hhi_transit", 6))


@query("q6_asn_card", CTE + " SELECT prefix, CAST(count(*) FILTER (WHERE elem_type = 'A') AS BIGINT) AS announcements, count(DISTINCT peer_asn) AS peers, max(ts) AS last_seen FROM obs WHERE origin_asn = 105 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def q6(spark, d):
    rows = p.elements(spark, d).where("origin_asn = 105").groupBy("prefix")
    return rows.agg(F.count_if(F.col("elem_type") == "A").alias("announcements"), F.count_distinct("peer_asn").alias("peers"), F.max("ts").alias("last_seen")).orderBy(F.desc("announcements"), "prefix").limit(200)


@query("q7_prefix_list", CTE + ", upd AS (SELECT * FROM obs WHERE elem_type <> 'R'), mo AS (SELECT prefix, origin_asn FROM (SELECT prefix, origin_asn, row_number() OVER (PARTITION BY prefix ORDER BY count(*) DESC, origin_asn) AS k FROM upd WHERE origin_asn IS NOT NULL GROUP BY 1, 2) WHERE k = 1) SELECT prefix, count(*) AS updates, any_value(mo.origin_asn) AS origin_asn, count(DISTINCT o.origin_asn) AS origins, max(ts) AS last_seen FROM upd o LEFT JOIN mo USING (prefix) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def q7(spark, d):
    return explorer.prefix_list(_daily(spark, d))


@query("q7_prefix_page", CTE + _VIS + """, base AS (SELECT prefix, min(origin_asn) AS origin_asn, count(*) AS updates, count(DISTINCT origin_asn) AS origins, max(ts) AS last_seen FROM obs WHERE elem_type <> 'R' AND origin_asn = 105 AND prefix LIKE '197.%' GROUP BY 1)
 SELECT b.*, (SELECT count(*) FROM base) AS total, round(v.visibility, 6) AS visibility FROM (SELECT * FROM base ORDER BY updates DESC, prefix LIMIT 50) b LEFT JOIN (SELECT prefix, avg(visibility_ratio) AS visibility FROM vis GROUP BY 1) v USING (prefix)""")
def q7b(spark, d):
    page = explorer.prefix_list(_daily(spark, d), 50, 0, "197.", 105, total=True)
    return explorer.prefix_details(page, stored.table(spark, d, "visibility")).withColumn("visibility", F.round("visibility", 6))


@query("q8_prefix_card", CTE + ", r AS (SELECT origin_asn, array_to_string(path, ' ') AS t, count(*) AS n, count(*) FILTER (WHERE true) AS m FROM obs WHERE prefix = '197.32.0.0/12' AND origin_asn IS NOT NULL GROUP BY 1, 2), t AS (SELECT origin_asn, count(*) AS paths, arg_max(t, (n, t)) AS main_path FROM r GROUP BY 1) SELECT o.origin_asn, count(*) AS observations, count(DISTINCT peer_asn) AS peers, min(ts) AS first_seen, max(ts) AS last_seen, any_value(main_path) AS main_path, any_value(paths) AS paths FROM obs o JOIN t ON t.origin_asn = o.origin_asn WHERE prefix = '197.32.0.0/12' GROUP BY 1")
def q8(spark, d):
    return explorer.prefix_card(p.elements(spark, d), "197.32.0.0/12")


@query("q8_prefix_paths", CTE + " SELECT array_to_string(path, ' ') AS path, count(*) AS n FROM obs WHERE prefix = '197.32.0.0/12' AND len(path) > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def q8b(spark, d):
    return explorer.prefix_paths(p.elements(spark, d), "197.32.0.0/12")


@query("q9_countries", CTE + _VIS + " SELECT a.country_iso2, round(avg(visibility_ratio), 6) AS visibility, max(peers_total) AS peers, count(*) AS snapshots FROM vis JOIN ref_asn a ON a.asn = vis.origin_asn GROUP BY 1")
def q9(spark, d):
    vis = metrics.visibility(p.rib(spark, d), p.roles(spark, d)).join(p.asns(spark, d).select(F.col("asn").alias("origin_asn"), "country_iso2"), "origin_asn")
    return vis.groupBy("country_iso2").agg(F.round(F.avg("visibility_ratio"), 6).alias("visibility"), F.max("peers_total").alias("peers"), F.count(F.lit(1)).alias("snapshots"))


@query("q9_country_indicators", f"""SELECT c.country_iso2, round(avg(transit_dependency_ratio), 4) AS transit_dependency_ratio, round(avg(avg_hhi), 4) AS hhi_transit, round(avg(avg_upstreams), 4) AS avg_upstreams, max(asns) AS asns, round(avg(visibility), 4) AS visibility,
 round(avg(coverage_ratio), 4) AS coverage_ratio, round(any_value(r.valid_ratio), 4) AS rpki_coverage_ratio FROM ({ORACLES['m6_country']}) c LEFT JOIN ({ORACLES['m8_rpki_coverage']}) r ON r.country_iso2 = c.country_iso2 GROUP BY 1""")
def q9b(spark, d):
    e, a = p.elements(spark, d), p.asns(spark, d)
    rows = explorer.countries(metrics.country(e, p.rib(spark, d), a, p.roles(spark, d), "1d"), metrics.rpki_coverage(e, a, p.roas(spark, d)))
    return rows.withColumns({c: F.round(c, 4) for c in ("transit_dependency_ratio", "hhi_transit", "avg_upstreams", "visibility", "coverage_ratio", "rpki_coverage_ratio")})


@query("q10_search", CTE + " SELECT kind, value FROM (SELECT 'asn' AS kind, CAST(asn AS VARCHAR) AS value FROM ref_asn UNION SELECT 'prefix', prefix FROM obs UNION SELECT 'country', country_iso2 FROM ref_asn) WHERE value LIKE '1%' ORDER BY 1, 2 LIMIT 20")
def q10(spark, d):
    return explorer.search(p.asns(spark, d), p.elements(spark, d), "1")


def _daily(spark, d) -> DataFrame:
    return stored.table(spark, d, "daily_prefix_origin")


def _one(spark, asn: int) -> DataFrame:
    return spark.range(asn, asn + 1).withColumnRenamed("id", "asn")


def _local(spark, d) -> DataFrame:
    return p.asns(spark, d).where("country_iso2 = 'NATION_5'")


@query("q11_prefix_series", CTE + _DPO + " SELECT day, count(DISTINCT prefix) AS prefixes FROM dpo JOIN ref_asn a ON a.asn = origin_asn AND a.country_iso2 = 'NATION_5' GROUP BY 1")
def q11(spark, d):
    return explorer.prefix_series(_daily(spark, d), _local(spark, d))


#: Pairs that only table dumps have are validated too.
_PT = CTE + NET.replace("elem_type = 'A'", "elem_type <> 'W'", 1) + _DAYS + _DPO + """, t AS (SELECT prefix, origin_asn, string_agg(CASE WHEN o.day IS NULL THEN '0' ELSE '1' END, '' ORDER BY cal.day) AS s, min(o.day) AS first_day, max(o.day) AS last_day, CAST(count(o.day) AS INTEGER) AS n_days FROM (SELECT DISTINCT prefix, origin_asn FROM dpo WHERE origin_asn IN (100, 105, 107)) k CROSS JOIN cal LEFT JOIN dpo o USING (prefix, origin_asn, day) GROUP BY 1, 2),
 pt AS (SELECT prefix, origin_asn, first_day, last_day, n_days, """ + _STATUS + " AS status, rpki_status, irr_status FROM t JOIN val USING (prefix, origin_asn))"


def _prefix_table(spark, d) -> DataFrame:
    return explorer.prefix_table(_daily(spark, d), p.asns(spark, d).where("asn in (100, 105, 107)"), p.roas(spark, d), p.irr_routes(spark, d))


@query("q12_prefix_table", _PT + " SELECT * FROM pt")
def q12(spark, d):
    return _prefix_table(spark, d)


@query("q13_prefix_facets", _PT + " SELECT 'status' AS facet, status AS value, count(*) AS n FROM pt GROUP BY 2 UNION ALL SELECT 'rpki_status', rpki_status, count(*) FROM pt GROUP BY 2")
def q13(spark, d):
    return explorer.facets(_prefix_table(spark, d), "status", "rpki_status")


@query("q14_roa_history", CTE + ", s AS (SELECT r.prefix, r.asn, CAST(DATE '2024-01-01' + CAST(x.k AS INTEGER) AS VARCHAR) AS d FROM ref_roa r, (SELECT unnest(range(0, 5)) AS k) x WHERE (r.asn + x.k) % 4 <> 1 OR r.asn = 104), t AS (SELECT prefix, asn, string_agg(CASE WHEN s.d IS NULL THEN '0' ELSE '1' END, '' ORDER BY c.d) AS s, min(s.d) AS first_day, max(s.d) AS last_day, CAST(count(s.d) AS INTEGER) AS n_days FROM (SELECT DISTINCT prefix, asn FROM s) k CROSS JOIN (SELECT DISTINCT d FROM s) c LEFT JOIN s USING (prefix, asn, d) GROUP BY 1, 2) SELECT prefix, asn, first_day, last_day, n_days, " + _STATUS + " AS status, last_day = (SELECT max(d) FROM s) AS active FROM t")
def q14(spark, d):
    r = p.roas(spark, d).select("prefix", "asn", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).where("(asn + k) % 4 <> 1 or asn = 104")
    return explorer.record_history(r.select("prefix", "asn", F.date_add(F.lit("2024-01-01").cast("date"), F.col("k")).cast("string").alias("snapshot_date")), ["prefix", "asn"])


def _neighbour_sql(members: str) -> str:
    return CTE + REL + ADJ + _DAYS.replace("FROM obs)", "FROM obs WHERE len(path) >= 2)") + f""", mem AS ({members}), nb AS (SELECT adj.*, {_NAMED} AS kind FROM adj JOIN mem USING (asn) LEFT JOIN orel ON orel.a = adj.asn AND orel.b = adj.neighbour)"""


_NT = """, nd AS (SELECT asn, neighbour, day, max(kind) AS kind, bool_or(ip_version = 4) AS v4, bool_or(ip_version = 6) AS v6 FROM nb GROUP BY 1, 2, 3),
 t AS (SELECT asn, neighbour, string_agg(CASE WHEN n.day IS NULL THEN '0' ELSE '1' END, '' ORDER BY cal.day) AS s, min(n.day) AS first_day, max(n.day) AS last_day, CAST(count(n.day) AS INTEGER) AS n_days, max(kind) AS kind, bool_or(v4) AS v4, bool_or(v6) AS v6 FROM (SELECT DISTINCT asn, neighbour FROM nb) k CROSS JOIN cal LEFT JOIN nd n USING (asn, neighbour, day) GROUP BY 1, 2)
 SELECT asn, neighbour, kind, v4, v6, first_day, last_day, n_days, """ + _STATUS + " AS status, coalesce(country_iso2, '') AS country_iso2 FROM t LEFT JOIN (SELECT asn AS neighbour, country_iso2 FROM ref_asn) a USING (neighbour)"


def _adj(spark, d) -> DataFrame:
    return stored.table(spark, d, "daily_adjacency")


@query("q15_neighbours", _neighbour_sql("SELECT CAST(81 AS BIGINT) AS asn") + _NT)
def q15(spark, d):
    return explorer.neighbour_table(_adj(spark, d), _one(spark, 81), p.relations(spark, d), p.asns(spark, d)).fillna("", ["country_iso2"])


_NS = " SELECT day" + "".join(f", CAST(count(DISTINCT (asn, neighbour)) FILTER (WHERE kind = '{k}') AS BIGINT) AS {k}" for k in ("provider", "customer", "peer", "unknown")) + " FROM nb GROUP BY 1"


@query("q16_neighbour_series", _neighbour_sql("SELECT CAST(81 AS BIGINT) AS asn") + _NS)
def q16(spark, d):
    return explorer.neighbour_series(_adj(spark, d), _one(spark, 81), p.relations(spark, d))


@query("q17_country_neighbours", _neighbour_sql("SELECT asn FROM ref_asn WHERE country_iso2 = 'NATION_5'") + _NT)
def q17(spark, d):
    return explorer.neighbour_table(_adj(spark, d), _local(spark, d), p.relations(spark, d), p.asns(spark, d)).fillna("", ["country_iso2"])


@query("q18_country_neighbour_series", _neighbour_sql("SELECT asn FROM ref_asn WHERE country_iso2 = 'NATION_5'") + _NS)
def q18(spark, d):
    return explorer.neighbour_series(_adj(spark, d), _local(spark, d), p.relations(spark, d))


@query("q19_prefix_history", CTE + _DAYS + _DPO + ", r AS (SELECT dpo.day, cal.i - row_number() OVER (ORDER BY dpo.day) AS g FROM dpo JOIN cal USING (day) WHERE origin_asn = 107 AND prefix = '197.32.16.0/20') SELECT '197.32.16.0/20' AS prefix, CAST(107 AS BIGINT) AS origin_asn, min(day) AS run_start, max(day) AS run_end, count(*) AS n_days FROM r GROUP BY g")
def q19(spark, d):
    return explorer.prefix_history(_daily(spark, d), 107, "197.32.16.0/20")


@query("q20_neighbour_history", CTE + ADJ + _DAYS.replace("FROM obs)", "FROM obs WHERE len(path) >= 2)") + ", r AS (SELECT DISTINCT ip_version, adj.day FROM adj WHERE asn = 81 AND neighbour = 92), r2 AS (SELECT r.*, cal.i - row_number() OVER (PARTITION BY ip_version ORDER BY r.day) AS g FROM r JOIN cal USING (day)) SELECT ip_version, min(day) AS run_start, max(day) AS run_end, count(*) AS n_days FROM r2 GROUP BY ip_version, g")
def q20(spark, d):
    return explorer.neighbour_history(_adj(spark, d), 81, 92)


@query("q21_country_relationships", CTE + REL + ", loc AS (SELECT asn FROM ref_asn WHERE country_iso2 = 'NATION_5') SELECT relation, b AS asn, array_to_string(list_sort(list(DISTINCT a)), ' ') AS local_asns FROM orel WHERE a IN (SELECT asn FROM loc) AND b NOT IN (SELECT asn FROM loc) GROUP BY 1, 2")
def q21(spark, d):
    return explorer.country_relationships(p.relations(spark, d), p.asns(spark, d), "NATION_5").withColumn("local_asns", paths.path_text(F.col("local_asns")))


@query("q25_churn_series", CTE + " SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, CAST(count(*) FILTER (WHERE elem_type = 'A') AS BIGINT) AS announcements, CAST(count(*) FILTER (WHERE elem_type = 'W') AS BIGINT) AS withdrawals FROM obs WHERE elem_type <> 'R' AND prefix = '197.32.0.0/12' GROUP BY 1 ORDER BY 1 LIMIT 2000")
def q25(spark, d):
    rows = metrics.churn_by_prefix(p.elements(spark, d), "1d").where("prefix = '197.32.0.0/12'")
    return rows.groupBy("window_start").agg(F.sum("announcements").alias("announcements"), F.sum("withdrawals").alias("withdrawals")).orderBy("window_start").limit(2000)


@query("q26_visibility_series", CTE + _VIS + " SELECT snapshot_ts, round(avg(visibility_ratio), 6) AS visibility FROM vis GROUP BY 1")
def q26(spark, d):
    return metrics.visibility(p.rib(spark, d), p.roles(spark, d)).groupBy("snapshot_ts").agg(F.round(F.avg("visibility_ratio"), 6).alias("visibility"))


@query("q28_upstream_series", CTE + " , u0 AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, path[len(path) - 1] AS u, count(*) AS n FROM obs WHERE elem_type = 'A' AND len(path) >= 2 AND origin_asn = 105 GROUP BY 1, 2), u1 AS (SELECT *, n / sum(n) OVER (PARTITION BY window_start) AS s FROM u0) SELECT window_start, round(sum(s * s), 6) AS hhi, CAST(sum(n) AS BIGINT) AS observations FROM u1 GROUP BY 1")
def q28(spark, d):
    return metrics.upstreams(p.elements(spark, d).where("origin_asn = 105"), "1d").select("window_start", F.round("hhi_transit", 6).alias("hhi"), "observations")


_EV = "SELECT o_orderkey AS event_id, CASE o_orderkey % 3 WHEN 0 THEN 'moas' WHEN 1 THEN 'bogon' ELSE 'churn_spike' END AS detector, CASE WHEN s >= 0.65 THEN 'critical' WHEN s >= 0.35 THEN 'watch' ELSE 'info' END AS severity, s AS score, o_orderdate AS first_seen, o_orderdate + INTERVAL 1 DAY AS last_seen FROM (SELECT *, round((o_custkey % 100) / 100.0, 2)::DOUBLE AS s FROM orders)"


def _events(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("score", F.round((F.col("o_custkey") % 100) / 100.0, 2))
    return o.select(
        F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderkey") % 3 == 0, "moas").when(F.col("o_orderkey") % 3 == 1, "bogon").otherwise("churn_spike").alias("detector"), detectors.severity(F.col("score")).alias("severity"), "score",
        F.col("o_orderdate").alias("first_seen"), (F.col("o_orderdate") + F.expr("interval 1 day")).alias("last_seen"),
    )


@query("q29_events", f"SELECT * FROM ({_EV}) WHERE detector IN ('moas', 'bogon') AND severity IN ('critical') AND score >= 0.7 ORDER BY score DESC, last_seen DESC, event_id LIMIT 100")
def q29(spark, d):
    return explorer.event_list(_events(spark, d), ["moas", "bogon"], ["critical"], min_score=0.7).limit(100)


@query("q3_overview_facts", CTE + _VIS + f""", e AS (SELECT * REPLACE (first_seen + INTERVAL 9000 DAY AS first_seen) FROM ({_EV})), since AS (SELECT max(ts) - INTERVAL 7 DAY AS s FROM obs), recent AS (SELECT * FROM e WHERE first_seen >= (SELECT s FROM since)),
 top AS (SELECT prefix, CAST(count(*) AS DOUBLE) AS u, CAST(count(DISTINCT origin_asn) AS DOUBLE) AS o, CAST(count(*) FILTER (WHERE elem_type = 'W') AS DOUBLE) AS w FROM obs WHERE ts >= (SELECT s FROM since) AND elem_type <> 'R' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
 SELECT 'countries' AS part, '' AS name, CAST(count(DISTINCT country_iso2) AS DOUBLE) AS value FROM ref_asn WHERE is_african UNION ALL SELECT 'median_visibility', '', median(visibility_ratio) FROM vis
 UNION ALL SELECT 'events_by_severity', severity, count(*) FROM recent GROUP BY 2 UNION ALL SELECT 'events_by_detector', detector, count(*) FROM recent GROUP BY 2
 UNION ALL SELECT 'top_updates', prefix, u FROM top UNION ALL SELECT 'top_origins', prefix, o FROM top UNION ALL SELECT 'top_withdrawals', prefix, w FROM top""")
def q3b(spark, d):
    e, events = p.elements(spark, d), _events(spark, d)
    events = events.withColumn("first_seen", F.col("first_seen") + F.expr("interval 9000 days"))  # around the elements' time
    return explorer.overview_facts(e, p.asns(spark, d), metrics.visibility(p.rib(spark, d), p.roles(spark, d)), events)


@query("q30_event_facets", f"WITH e AS ({_EV}) SELECT 'detector' AS facet, detector AS value, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM e GROUP BY 2")
def q30(spark, d):
    return explorer.facets(_events(spark, d), "detector", "severity")


@query("q31_event", f"SELECT * FROM ({_EV}) WHERE event_id = 7")
def q31(spark, d):
    return _events(spark, d).where("event_id = 7")


@query("q32_event_timeline", CTE + _VIS + ", ch AS (SELECT prefix, time_bucket(INTERVAL 6 HOUR, ts) AS t, count(*) AS n FROM obs WHERE elem_type <> 'R' GROUP BY 1, 2) SELECT 'churn' AS kind, t AS ts, CAST(n AS DOUBLE) AS value FROM ch WHERE prefix = '197.32.0.0/12' AND t BETWEEN TIMESTAMP '2024-01-09' AND TIMESTAMP '2024-01-12' UNION ALL SELECT 'visibility', snapshot_ts, visibility_ratio FROM vis WHERE prefix = '197.32.0.0/12' AND snapshot_ts BETWEEN TIMESTAMP '2024-01-09' AND TIMESTAMP '2024-01-12'")
def q32(spark, d):
    event = spark.sql("select '197.32.0.0/12' as prefix, timestamp_ntz'2024-01-10' as first_seen, timestamp_ntz'2024-01-11' as last_seen")
    return explorer.event_timeline(event, metrics.churn_by_prefix(p.elements(spark, d), "6h"), metrics.visibility(p.rib(spark, d), p.roles(spark, d)))


@query("q2_collectors", CTE + " SELECT r.collector, r.role, CAST(coalesce(c.files, 0) AS BIGINT) AS files, CAST(coalesce(c.bytes, 0) AS BIGINT) AS bytes FROM (SELECT * FROM roles UNION ALL SELECT 'c9', 'local') r LEFT JOIN (SELECT collector, count(DISTINCT date_trunc('day', ts)) AS files, sum(seq % 100) AS bytes FROM obs GROUP BY 1) c USING (collector)")
def q2(spark, d):
    e = p.elements(spark, d)
    configured = p.roles(spark, d).unionAll(spark.sql("select 'c9', 'local'"))
    coverage = e.groupBy("collector").agg(F.count_distinct(F.to_date("ts")).alias("files"), F.sum(F.col("seq") % 100).alias("bytes"))
    return explorer.collectors(configured, coverage)


@query("q27_country_series", CTE + " , u0 AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, origin_asn, path[len(path) - 1] AS u, count(*) AS n FROM obs WHERE elem_type = 'A' AND len(path) >= 2 GROUP BY 1, 2, 3), u1 AS (SELECT *, n / sum(n) OVER (PARTITION BY window_start, origin_asn) AS s FROM u0), u2 AS (SELECT window_start, origin_asn, sum(s * s) AS hhi FROM u1 GROUP BY 1, 2) SELECT window_start, round(avg(hhi), 6) AS avg_hhi, count(DISTINCT origin_asn) AS asns FROM u2 JOIN ref_asn a ON a.asn = origin_asn AND a.country_iso2 = 'NATION_5' GROUP BY 1")
def q27(spark, d):
    rows = metrics.country(p.elements(spark, d), p.rib(spark, d), p.asns(spark, d), p.roles(spark, d), "1d")
    return explorer.country_series(rows, "NATION_5").withColumn("avg_hhi", F.round("avg_hhi", 6))


@query("q33_incidents", f"SELECT event_id AS incident_id, severity, score, first_seen FROM ({_EV}) WHERE severity IN ('critical', 'watch') ORDER BY score DESC, first_seen, event_id LIMIT 50 OFFSET 10")
def q33(spark, d):
    rows = _events(spark, d).select(F.col("event_id").alias("incident_id"), "severity", "score", "first_seen")
    return explorer.incident_list(rows, ["critical", "watch"], 50, 10)
