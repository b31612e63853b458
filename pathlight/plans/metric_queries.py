"""Metric and aggregation queries (M, G, W) and their oracles."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from pathlight.functions import paths, windows
from pathlight.operators import metrics

from . import projection as p
from .projection import BITS, CTE, VERSION
from .registry import query

_CHURN = "CAST(count(*) FILTER (WHERE elem_type = 'A') AS BIGINT) AS announcements, CAST(count(*) FILTER (WHERE elem_type = 'W') AS BIGINT) AS withdrawals, count(*) AS updates_total"
_MODE = "(SELECT v FROM (SELECT unnest(list(origin_asn)) AS v) GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)"


@query("m1_churn_prefix", CTE + f" SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, collector, prefix, {_CHURN}, count(DISTINCT peer_asn) AS distinct_peers, count(DISTINCT origin_asn) + max(CASE WHEN origin_asn IS NULL THEN 1 ELSE 0 END) AS distinct_origins FROM obs WHERE elem_type <> 'R' GROUP BY 1, 2, 3")
def m1(spark, d):
    return metrics.churn_by_prefix(p.elements(spark, d), "1d")


@query("m2_churn_asn", CTE + f" SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, collector, origin_asn, {_CHURN}, count(DISTINCT prefix) AS distinct_prefixes FROM obs WHERE elem_type <> 'R' AND origin_asn IS NOT NULL GROUP BY 1, 2, 3")
def m2(spark, d):
    return metrics.churn_by_asn(p.elements(spark, d), "6h")


_VIS = """, rib AS (SELECT date_trunc('day', ts) AS snapshot_ts, * FROM obs WHERE elem_type = 'R'),
 tot AS (SELECT snapshot_ts, collector, count(DISTINCT peer_asn) AS peers_total FROM rib GROUP BY 1, 2),
 om AS (SELECT snapshot_ts, collector, prefix, origin_asn FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_ts, collector, prefix ORDER BY n DESC, origin_asn) AS k FROM (SELECT snapshot_ts, collector, prefix, origin_asn, count(*) AS n FROM rib GROUP BY 1, 2, 3, 4)) WHERE k = 1),
 seen AS (SELECT snapshot_ts, collector, prefix, count(DISTINCT peer_asn) AS peers_seeing, median(len(path)) AS mpl FROM rib GROUP BY 1, 2, 3),
 j AS (SELECT s.*, om.origin_asn, tot.peers_total, s.peers_seeing / tot.peers_total AS ratio, coalesce(r.role, 'local') AS role FROM seen s JOIN om USING (snapshot_ts, collector, prefix) JOIN tot USING (snapshot_ts, collector) LEFT JOIN roles r USING (collector)),
 om2 AS (SELECT snapshot_ts, prefix, origin_asn FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_ts, prefix ORDER BY n DESC, origin_asn) AS k FROM (SELECT snapshot_ts, prefix, origin_asn, count(*) AS n FROM j GROUP BY 1, 2, 3)) WHERE k = 1),
 vis AS (SELECT j.snapshot_ts, j.prefix, CAST(sum(peers_seeing) AS BIGINT) AS peers_seeing, CAST(sum(peers_total) AS BIGINT) AS peers_total, count(DISTINCT collector) AS collectors_seeing, any_value(om2.origin_asn) AS origin_asn,
   median(mpl) AS median_path_len, avg(ratio) FILTER (WHERE role = 'local') AS visibility_local, avg(ratio) FILTER (WHERE role = 'external') AS visibility_external, sum(peers_seeing) / sum(peers_total) AS visibility_ratio
   FROM j JOIN om2 ON j.snapshot_ts = om2.snapshot_ts AND j.prefix = om2.prefix GROUP BY 1, 2)"""


@query("m3_visibility", CTE + _VIS + " SELECT snapshot_ts, prefix, peers_seeing, peers_total, collectors_seeing, origin_asn, median_path_len, round(visibility_local, 6) AS visibility_local, round(visibility_external, 6) AS visibility_external, round(visibility_ratio, 6) AS visibility_ratio FROM vis")
def m3(spark, d):
    out = metrics.visibility(p.rib(spark, d), p.roles(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("visibility_local", "visibility_external", "visibility_ratio")})


@query("m4_path_evolution", CTE + " SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, prefix, count(DISTINCT array_to_string(path, ' ')) AS distinct_paths, count(DISTINCT origin_asn) AS distinct_origins, array_to_string(list_sort(list(DISTINCT origin_asn)), ' ') AS origins, median(len(path)) AS median_path_len, CAST(max(len(path)) AS INTEGER) AS max_path_len, bool_or(has_as_set) AS has_as_set, count(*) AS announcements, count(DISTINCT peer_asn) AS peers FROM obs WHERE elem_type = 'A' GROUP BY 1, 2")
def m4(spark, d):
    return metrics.path_evolution(p.elements(spark, d), "1d").withColumn("origins", paths.path_text(F.col("origins")))


_UP = """, up0 AS (SELECT {bucket} AS window_start, origin_asn, path[len(path) - 1] AS upstream_asn, count(*) AS n FROM obs WHERE elem_type = 'A' AND len(path) >= 2 GROUP BY 1, 2, 3),
 up1 AS (SELECT *, n / sum(n) OVER (PARTITION BY window_start, origin_asn) AS share, row_number() OVER (PARTITION BY window_start, origin_asn ORDER BY n DESC, upstream_asn) AS k FROM up0),
 up AS (SELECT window_start, origin_asn, list_sort(list(upstream_asn)) AS ups, count(*) AS upstream_count, max(CASE WHEN k = 1 THEN upstream_asn END) AS primary_upstream, sum(share * share) AS hhi, CAST(sum(n) AS BIGINT) AS observations FROM up1 GROUP BY 1, 2)"""


@query("m5_upstream", CTE + _UP.format(bucket="time_bucket(INTERVAL 1 DAY, ts)") + " SELECT window_start, origin_asn, array_to_string(ups, ' ') AS upstreams, upstream_count, primary_upstream, round(hhi, 6) AS hhi_transit, observations FROM up")
def m5(spark, d):
    return metrics.upstreams(p.elements(spark, d), "1d").withColumn("upstreams", paths.path_text(F.col("upstreams"))).withColumn("hhi_transit", F.round("hhi_transit", 6))


_COV = """, cov AS (SELECT a.country_iso2, count(DISTINCT a.asn) AS allocated_asns, count(DISTINCT o.origin_asn) AS observed_asns FROM ref_asn a LEFT JOIN (SELECT DISTINCT origin_asn FROM obs) o ON o.origin_asn = a.asn WHERE a.is_african GROUP BY 1)"""


@query("m6_country", CTE + _UP.format(bucket="time_bucket(INTERVAL 1 DAY, ts)") + _VIS + _COV + """, c AS (SELECT window_start, a.country_iso2, count(DISTINCT origin_asn) AS asns, avg(hhi) AS avg_hhi, avg(upstream_count) AS avg_upstreams, 1 - avg(CASE WHEN f.is_african THEN 1 ELSE 0 END) AS t FROM up JOIN ref_asn a ON a.asn = origin_asn AND a.is_african LEFT JOIN ref_asn f ON f.asn = primary_upstream GROUP BY 1, 2),
 v AS (SELECT a.country_iso2, avg(visibility_ratio) AS v FROM vis JOIN ref_asn a ON a.asn = origin_asn AND a.is_african GROUP BY 1)
 SELECT c.window_start, c.country_iso2, asns, round(avg_hhi, 6) AS avg_hhi, round(avg_upstreams, 6) AS avg_upstreams, round(t, 6) AS transit_dependency_ratio, round(v.v, 6) AS visibility, round(observed_asns / allocated_asns, 6) AS coverage_ratio FROM c LEFT JOIN v USING (country_iso2) LEFT JOIN cov USING (country_iso2)""")
def m6(spark, d):
    out = metrics.country(p.elements(spark, d), p.rib(spark, d), p.asns(spark, d), p.roles(spark, d), "1d")
    return out.withColumns({c: F.round(c, 6) for c in ("avg_hhi", "avg_upstreams", "transit_dependency_ratio", "visibility", "coverage_ratio")})


@query("m7_coverage", CTE + _COV + " SELECT country_iso2, allocated_asns, observed_asns, round(observed_asns / allocated_asns, 6) AS coverage_ratio FROM cov")
def m7(spark, d):
    return metrics.coverage(p.elements(spark, d), p.asns(spark, d)).withColumn("coverage_ratio", F.round("coverage_ratio", 6))


#: Containment in the oracle: equal leading bits.
NET = f""", pairs AS (SELECT DISTINCT prefix, origin_asn FROM obs WHERE elem_type = 'A'),
 num AS (SELECT prefix, v, len, substr(bits, 1, len) AS bits FROM (SELECT prefix, {VERSION} AS v, {BITS} AS bits, CAST(split_part(prefix, '/', 2) AS INT) AS len FROM (SELECT prefix FROM pairs UNION SELECT prefix FROM ref_roa UNION SELECT prefix FROM ref_irr UNION SELECT prefix FROM ref_anycast))),
 lens AS (SELECT DISTINCT v, len FROM num),
 cover AS (SELECT a.prefix, a.len AS own, b.prefix AS covering, b.len AS len FROM num a JOIN lens l ON l.v = a.v AND l.len <= a.len JOIN num b ON b.v = a.v AND b.len = l.len AND b.bits = substr(a.bits, 1, l.len)),
 roa_hit AS (SELECT p.prefix, p.origin_asn, bool_or(r.asn = p.origin_asn AND c.own <= r.max_len) AS ok FROM pairs p JOIN cover c USING (prefix) JOIN ref_roa r ON r.prefix = c.covering GROUP BY 1, 2),
 irr_hit AS (SELECT p.prefix, p.origin_asn, bool_or(r.asn = p.origin_asn) AS ok FROM pairs p JOIN cover c USING (prefix) JOIN ref_irr r ON r.prefix = c.covering GROUP BY 1, 2),
 val AS (SELECT p.prefix, p.origin_asn, CASE WHEN h.ok IS NULL THEN 'not-found' WHEN h.ok THEN 'valid' ELSE 'invalid' END AS rpki_status, CASE WHEN i.ok IS NULL THEN 'absent' WHEN i.ok THEN 'consistent' ELSE 'inconsistent' END AS irr_status
   FROM pairs p LEFT JOIN roa_hit h USING (prefix, origin_asn) LEFT JOIN irr_hit i USING (prefix, origin_asn))"""


@query("m8_rpki_coverage", CTE + NET + """ SELECT country_iso2, count(DISTINCT prefix) AS announced, count(DISTINCT prefix) FILTER (WHERE rpki_status = 'valid') AS valid, count(DISTINCT prefix) FILTER (WHERE rpki_status = 'invalid') AS invalid, count(DISTINCT prefix) FILTER (WHERE rpki_status = 'not-found') AS not_found,
 round(count(DISTINCT prefix) FILTER (WHERE rpki_status = 'valid') / count(DISTINCT prefix), 6) AS valid_ratio FROM val JOIN ref_asn a ON a.asn = origin_asn AND a.is_african GROUP BY 1""")
def m8(spark, d):
    return metrics.rpki_coverage(p.elements(spark, d), p.asns(spark, d), p.roas(spark, d)).withColumn("valid_ratio", F.round("valid_ratio", 6))


@query("m9_daily_prefix_origin", CTE + " SELECT date_trunc('day', ts) AS day, prefix, coalesce(origin_asn, -1) AS origin_asn, CAST(count(*) FILTER (WHERE elem_type = 'A') AS BIGINT) AS announcements, CAST(count(*) FILTER (WHERE elem_type = 'W') AS BIGINT) AS withdrawals, CAST(count(*) FILTER (WHERE elem_type = 'R') AS BIGINT) AS rib_rows FROM obs GROUP BY 1, 2, 3")
def m9(spark, d):
    return metrics.daily_prefix_origin(p.elements(spark, d)).fillna(-1, ["origin_asn"])


ADJ = """, adj0 AS (SELECT DISTINCT date_trunc('day', ts) AS day, prefix_ip_version AS ip_version, path FROM obs WHERE len(path) >= 2),
 adj1 AS (SELECT day, ip_version, path, unnest(range(1, len(path) + 1)) AS i FROM adj0),
 adj2 AS (SELECT * FROM adj1 WHERE list_position(path, path[i]) = i),
 adj AS (SELECT day, ip_version, path[i] AS asn, path[i - 1] AS neighbour FROM adj2 WHERE i > 1 UNION SELECT day, ip_version, path[i] AS asn, path[i + 1] AS neighbour FROM adj2 WHERE i < len(path))"""


@query("m10_daily_adjacency", CTE + ADJ + " SELECT day, ip_version, asn, neighbour FROM adj")
def m10(spark, d):
    return metrics.daily_adjacency(p.elements(spark, d))


@query("g4_mode", CTE + " SELECT prefix, origin_asn AS mode_origin FROM (SELECT prefix, origin_asn, row_number() OVER (PARTITION BY prefix ORDER BY count(*) DESC, origin_asn) AS k FROM obs WHERE origin_asn IS NOT NULL GROUP BY 1, 2) WHERE k = 1")
def g4(spark, d):
    return p.elements(spark, d).where("origin_asn is not null").groupBy("prefix").agg(metrics.smallest_mode("origin_asn").alias("mode_origin"))


@query("g3_distinct_tuples", CTE + " SELECT prefix, count(DISTINCT (collector, origin_asn)) AS pairs, count(DISTINCT origin_asn) + max(CASE WHEN origin_asn IS NULL THEN 1 ELSE 0 END) AS origins FROM obs GROUP BY 1")
def g3(spark, d):
    return p.elements(spark, d).groupBy("prefix").agg(F.count_distinct(F.struct("collector", "origin_asn")).alias("pairs"), metrics.distinct_with_null(F.col("origin_asn")).alias("origins"))


@query("g11_filtered_argmax", CTE + " SELECT collector, arg_max(prefix, seq) FILTER (WHERE elem_type = 'A') AS last_announced, arg_max(prefix, seq) FILTER (WHERE elem_type = 'W') AS last_withdrawn, median(len(path)) AS median_len, bool_or(has_as_set) AS any_set FROM obs GROUP BY 1")
def g11(spark, d):
    e = p.elements(spark, d)
    return e.groupBy("collector").agg(
        F.expr("max_by(prefix, seq) filter (where elem_type = 'A')").alias("last_announced"), F.expr("max_by(prefix, seq) filter (where elem_type = 'W')").alias("last_withdrawn"),
        F.median("as_path_len").alias("median_len"), F.bool_or("has_as_set").alias("any_set"),
    )


@query("w3_week_buckets", CTE + " SELECT time_bucket(INTERVAL 168 HOUR, ts) AS bucket, count(*) AS n FROM obs GROUP BY 1")
def w3(spark, d):
    return p.elements(spark, d).groupBy(windows.bucket(F.col("ts"), 168).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("w5_gap_fill", CTE + """, b AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS bucket, prefix, count(*) AS n FROM obs WHERE elem_type = 'W' GROUP BY 1, 2), s AS (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), INTERVAL 6 HOUR)) AS bucket)
 SELECT s.bucket, x.prefix, CAST(coalesce(b.n, 0) AS BIGINT) AS n FROM s CROSS JOIN (SELECT DISTINCT prefix FROM b) x LEFT JOIN b ON b.bucket = s.bucket AND b.prefix = x.prefix""")
def w5(spark, d):
    b = p.elements(spark, d).where("elem_type = 'W'").groupBy(windows.bucket(F.col("ts"), 6).alias("bucket"), "prefix").agg(F.count(F.lit(1)).alias("n"))
    return windows.fill_gaps(b, "bucket", "6 hours", ["prefix"], ["n"]).select("bucket", "prefix", "n")


@query("w6_share_of_window", CTE + " SELECT DISTINCT date_trunc('day', ts) AS day, prefix, round(count(*) OVER (PARTITION BY date_trunc('day', ts), prefix) / count(*) OVER (PARTITION BY date_trunc('day', ts)), 6) AS share FROM obs")
def w6(spark, d):
    each = p.elements(spark, d).groupBy(windows.day(F.col("ts")).alias("day"), "prefix").agg(F.count(F.lit(1)).alias("n"))
    return each.select("day", "prefix", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("day")), 6).alias("share"))


_DAYS = ", days AS (SELECT DISTINCT date_trunc('day', ts) AS day FROM obs), cal AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM days)"


@query("w7_islands", CTE + _DAYS + """, o AS (SELECT DISTINCT prefix, origin_asn, collector, peer_asn, date_trunc('day', ts) AS day FROM obs WHERE elem_type = 'A'), r AS (SELECT o.*, cal.i - row_number() OVER (PARTITION BY prefix, origin_asn, collector, peer_asn ORDER BY o.day) AS g FROM o JOIN cal USING (day))
 SELECT prefix, origin_asn, collector, peer_asn, min(day) AS run_start, max(day) AS run_end, count(*) AS n_days FROM r GROUP BY prefix, origin_asn, collector, peer_asn, g""")
def w7(spark, d):
    e = p.elements(spark, d).withColumn("day", windows.day(F.col("ts")))
    return windows.islands(e.where("elem_type = 'A'"), ["prefix", "origin_asn", "collector", "peer_asn"], e)


@query("d13_presence", CTE + _DAYS + """, o AS (SELECT DISTINCT prefix, origin_asn, date_trunc('day', ts) AS day FROM obs WHERE elem_type = 'A'), t AS (SELECT prefix, origin_asn, string_agg(CASE WHEN o.day IS NULL THEN '0' ELSE '1' END, '' ORDER BY cal.day) AS s FROM (SELECT DISTINCT prefix, origin_asn FROM o) k CROSS JOIN cal LEFT JOIN o USING (prefix, origin_asn, day) GROUP BY 1, 2)
 SELECT prefix, origin_asn, CASE WHEN regexp_matches(s, '^1*$') THEN 'stable' WHEN regexp_matches(s, '10+1') THEN 'unstable' WHEN regexp_matches(s, '^0+1+$') THEN 'new' WHEN regexp_matches(s, '^1+0+$') THEN 'left' ELSE 'unstable' END AS status,
 CAST(len(regexp_extract_all(s || 'x', '10+')) - CASE WHEN regexp_matches(s, '10+$') THEN 1 ELSE 0 END AS INTEGER) AS reappearances FROM t""")
def d13(spark, d):
    e = p.elements(spark, d).withColumn("day", windows.day(F.col("ts")))
    calendar = e.agg(F.array_sort(F.collect_set("day")).alias("days"))
    seen = e.where("elem_type = 'A'").groupBy("prefix", "origin_asn").agg(F.array_sort(F.collect_set("day")).alias("seen")).join(F.broadcast(calendar))
    return seen.select("prefix", "origin_asn", windows.presence(F.col("seen"), F.col("days")).alias("status"), windows.reappearances(F.col("seen"), F.col("days")).alias("reappearances"))
