"""Detectors, correlation and confirmation (A) with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pathlight.functions import paths
from pathlight.operators import detectors, incidents

from . import projection as p
from .metric_queries import NET
from .projection import CTE
from .reference_queries import LINKS, REL
from .registry import query, uuid_sql


def _shown(events: DataFrame) -> DataFrame:
    """Comparable columns of candidate events."""
    return events.select("detector", "prefix", paths.path_text(F.col("asns")).alias("asns"), "first_seen", "last_seen", F.round("score", 6).alias("score"), "confidence", F.array_join("collectors", ",").alias("collectors"))


_ANN = ", ann AS (SELECT prefix, origin_asn, count(DISTINCT peer_asn) AS peers, list_sort(list(DISTINCT collector)) AS cs, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM obs WHERE elem_type = 'A' GROUP BY 1, 2)"
_CONF = "CASE WHEN peers >= 5 AND len(cs) >= 2 THEN 'high' WHEN peers >= 3 OR len(cs) >= 2 THEN 'medium' ELSE 'low' END AS confidence, array_to_string(cs, ',') AS collectors"

_MOAS = CTE + NET + REL + _ANN + """, rk AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, origin_asn) AS k FROM ann),
 ch AS (SELECT c.*, i.origin_asn AS inc, i.n AS inc_n FROM rk c JOIN rk i ON i.prefix = c.prefix AND i.k = 1 WHERE c.k > 1 AND c.peers >= 2),
 ok AS (SELECT ch.*, v.rpki_status, v.irr_status FROM ch LEFT JOIN ref_org x ON x.asn = inc LEFT JOIN ref_org y ON y.asn = origin_asn JOIN val v USING (prefix, origin_asn)
   WHERE NOT coalesce(x.org_id = y.org_id, false) AND NOT EXISTS (SELECT 1 FROM orel WHERE a = inc AND b = origin_asn) AND v.rpki_status <> 'valid' AND NOT (v.rpki_status = 'not-found' AND v.irr_status = 'consistent')),
 any0 AS (SELECT DISTINCT c.prefix FROM cover c JOIN ref_anycast a ON a.prefix = c.covering),
 smp AS (SELECT DISTINCT prefix, origin_asn, path FROM obs WHERE elem_type = 'A'),
 sim AS (SELECT ok.prefix, ok.origin_asn, max(len(list_intersect(list_distinct(a.path[1 : len(a.path) - 1]), list_distinct(b.path[1 : len(b.path) - 1]))) / len(list_distinct(list_concat(a.path[1 : len(a.path) - 1], b.path[1 : len(b.path) - 1])))) AS s
   FROM ok JOIN smp a ON a.prefix = ok.prefix AND a.origin_asn = ok.inc JOIN smp b ON b.prefix = ok.prefix AND b.origin_asn = ok.origin_asn GROUP BY 1, 2),
 moas AS (SELECT ok.* FROM ok LEFT JOIN sim USING (prefix, origin_asn) WHERE NOT (ok.prefix IN (SELECT prefix FROM any0) AND coalesce(sim.s <= 0.5, false)))
 SELECT 'moas' AS detector, prefix, inc || ' ' || origin_asn AS asns, first_seen, last_seen, round(0.45 + CASE rpki_status WHEN 'invalid' THEN 0.35 ELSE 0 END + least(0.15, peers * 0.03) + CASE WHEN n < inc_n * 0.1 THEN 0.05 ELSE 0 END, 6)::DOUBLE AS score, """ + _CONF + " FROM moas"


def _moas(spark, d, held=None):
    e = p.elements(spark, d)
    return detectors.moas(e, p.roas(spark, d), p.irr_routes(spark, d), p.relations(spark, d), p.orgs(spark, d), p.anycast(spark, d), held=held)


@query("a1_moas", _MOAS)
def a1(spark, d):
    return _shown(_moas(spark, d))


@query("a1b_stable_pairs", CTE + " SELECT prefix, origin_asn FROM obs WHERE elem_type = 'A' AND CAST(ts AS DATE) < DATE '2024-01-15' AND CAST(ts AS DATE) >= DATE '2024-01-01' GROUP BY 1, 2 HAVING count(DISTINCT CAST(ts AS DATE)) >= 3")
def a1b(spark, d):
    return detectors.stable_pairs(p.elements(spark, d), F.to_date(F.lit("2024-01-15")))


_SUB = CTE + NET + _ANN + """, h AS (SELECT ann.*, rpki_status FROM ann JOIN val USING (prefix, origin_asn)),
 ex AS (SELECT * FROM (SELECT c.prefix, r.asn, row_number() OVER (PARTITION BY c.prefix ORDER BY c.len, r.asn) AS k FROM (SELECT DISTINCT prefix FROM ann) q JOIN cover c USING (prefix) JOIN ref_roa r ON r.prefix = c.covering WHERE c.own > r.max_len AND c.own > c.len) WHERE k = 1),
 uc AS (SELECT h.* FROM h WHERE prefix NOT IN (SELECT c.prefix FROM cover c JOIN ref_roa r ON r.prefix = c.covering)),
 ir AS (SELECT uc.prefix, uc.origin_asn, arg_min(r.asn, c.len * 1000000 + r.asn) AS asn FROM uc JOIN cover c ON c.prefix = uc.prefix AND c.own > c.len JOIN ref_irr r ON r.prefix = c.covering GROUP BY 1, 2 HAVING NOT bool_or(r.asn = uc.origin_asn))
 SELECT 'subprefix' AS detector, prefix, origin_asn || ' ' || ex.asn AS asns, first_seen, last_seen, round(0.6 + least(0.25, peers * 0.05), 6)::DOUBLE AS score, """ + _CONF + """ FROM h JOIN ex USING (prefix) WHERE rpki_status <> 'valid'
 UNION ALL SELECT 'subprefix', prefix, origin_asn || ' ' || ir.asn, first_seen, last_seen, round(0.4 + least(0.15, peers * 0.03), 6)::DOUBLE, """ + _CONF + " FROM uc JOIN ir USING (prefix, origin_asn)"


@query("a2_subprefix", _SUB)
def a2(spark, d):
    return _shown(detectors.subprefix(p.elements(spark, d), p.roas(spark, d), p.irr_routes(spark, d)))


_INVALID = CTE + NET + _ANN + """, au AS (SELECT c.prefix, list_sort(list(DISTINCT r.asn)) AS l FROM cover c JOIN ref_roa r ON r.prefix = c.covering GROUP BY 1)
 SELECT 'rpki_invalid' AS detector, prefix, array_to_string(list_concat([origin_asn], l[1:3]), ' ') AS asns, first_seen, last_seen, round(0.45 + least(0.2, peers * 0.02), 6)::DOUBLE AS score, """ + _CONF + " FROM ann JOIN val USING (prefix, origin_asn) JOIN au USING (prefix) WHERE rpki_status = 'invalid' AND peers >= 3"


@query("a3_rpki_invalid", _INVALID)
def a3(spark, d):
    return _shown(detectors.rpki_invalid(p.elements(spark, d), p.roas(spark, d)))


@query("a4_route_leaks", CTE + LINKS + """, hp AS (SELECT prefix, path, count(DISTINCT peer_asn) AS peers, list(DISTINCT collector) AS cs, min(ts) AS f, max(ts) AS l FROM obs WHERE elem_type = 'A' AND len(path) >= 3 GROUP BY 1, 2),
 lk2 AS (SELECT hp.*, path[violation + 1] AS leaker FROM hp JOIN vf USING (path) WHERE violation IS NOT NULL),
 g AS (SELECT prefix, leaker, CAST(sum(peers) AS BIGINT) AS peers, list_sort(list_distinct(flatten(list(cs)))) AS cs, min(f) AS first_seen, max(l) AS last_seen, min(path) AS fp FROM lk2 GROUP BY 1, 2)
 , ev AS (SELECT as_a AS a, as_b AS b FROM ref_rel WHERE (as_a + as_b) % 5 = 0 UNION SELECT as_b, as_a FROM ref_rel WHERE (as_a + as_b) % 5 = 0)
 SELECT 'valley_free' AS detector, prefix, CAST(leaker AS VARCHAR) AS asns, first_seen, last_seen, round(CASE WHEN EXISTS (SELECT 1 FROM ev WHERE ev.a = leaker AND ev.b = fp[list_position(fp, leaker) + 1]) THEN 0.4 + least(0.2, peers * 0.04) ELSE least(0.55, 0.4 + least(0.2, peers * 0.04)) END, 6)::DOUBLE AS score, """ + _CONF + " FROM g WHERE peers >= 2")
def a4(spark, d):
    links = p.relations(spark, d)
    evidence = links.where((F.col("as_a") + F.col("as_b")) % 5 == 0).withColumn("sources", F.array(F.lit("caida"), F.lit("ix")))
    return _shown(detectors.route_leaks(p.elements(spark, d), links, evidence))


_Z = """, ser AS (SELECT prefix, time_bucket(INTERVAL 6 HOUR, ts) AS w, count(*) AS updates, count(DISTINCT peer_asn) AS peers, list_sort(list(DISTINCT collector)) AS cs FROM obs WHERE elem_type <> 'R' GROUP BY 1, 2),
 md AS (SELECT prefix, median(updates) AS m, stddev_samp(updates) AS sd, count(*) AS k FROM ser GROUP BY 1), ad AS (SELECT ser.prefix, median(abs(updates - m)) AS mad FROM ser JOIN md USING (prefix) GROUP BY 1),
 zz AS (SELECT ser.*, md.k AS windows, CASE WHEN mad > 0 THEN 0.6745 * (updates - m) / mad WHEN sd > 0 THEN (updates - m) / sd ELSE 0.0 END AS z FROM ser JOIN md USING (prefix) JOIN ad USING (prefix))"""


@query("w9_robust_z", CTE + _Z + " SELECT prefix, w AS first_seen, updates, round(z, 6)::DOUBLE AS z FROM zz")
def w9(spark, d):
    from pathlight.functions import windows

    rows = p.elements(spark, d).where("elem_type <> 'R'").groupBy("prefix", windows.tumbling(F.col("ts"), "6h").alias("first_seen")).agg(F.count(F.lit(1)).alias("updates"))
    return detectors.robust_z(rows, ["prefix"], "updates").select("prefix", "first_seen", "updates", F.round("z", 6).alias("z"))


@query("a5_churn_spikes", CTE + _Z + ", mo AS (SELECT prefix, w, origin_asn FROM (SELECT prefix, time_bucket(INTERVAL 6 HOUR, ts) AS w, origin_asn, row_number() OVER (PARTITION BY prefix, time_bucket(INTERVAL 6 HOUR, ts) ORDER BY count(*) DESC, origin_asn) AS k FROM obs WHERE elem_type <> 'R' AND origin_asn IS NOT NULL GROUP BY 1, 2, 3) WHERE k = 1) SELECT 'churn_spike' AS detector, prefix, coalesce(CAST(mo.origin_asn AS VARCHAR), '') AS asns, w AS first_seen, w + INTERVAL 6 HOUR AS last_seen, round(least(0.75, 0.25 + z / 40), 6)::DOUBLE AS score, " + _CONF + " FROM zz LEFT JOIN mo USING (prefix, w) WHERE z >= 1 AND updates >= 5 AND windows >= 6")
def a5(spark, d):
    return _shown(detectors.churn_spikes(p.elements(spark, d), 1.0, 5, 6, "6h"))


@query("a6_visibility_drops", CTE + """, rib AS (SELECT date_trunc('day', ts) AS s, * FROM obs WHERE elem_type = 'R'), t0 AS (SELECT s, collector, count(DISTINCT peer_asn) AS n FROM rib GROUP BY 1, 2), t AS (SELECT s, sum(n) AS tot, count(*) AS act FROM t0 GROUP BY 1),
 tt AS (SELECT * FROM t WHERE act = (SELECT max(act) FROM t)), mo AS (SELECT s, prefix, origin_asn FROM (SELECT s, prefix, origin_asn, row_number() OVER (PARTITION BY s, prefix ORDER BY count(*) DESC, origin_asn) AS k FROM rib GROUP BY 1, 2, 3) WHERE k = 1),
 se AS (SELECT s, prefix, count(DISTINCT (collector, peer_asn)) AS peers, list_sort(list(DISTINCT collector)) AS cs FROM rib GROUP BY 1, 2), r AS (SELECT se.*, peers / tot AS ratio FROM se JOIN tt USING (s)),
 b AS (SELECT prefix, median(ratio) AS base FROM r GROUP BY 1 HAVING count(*) >= 3 AND median(ratio) >= 0.05)
 SELECT 'visibility_drop' AS detector, prefix, CAST(mo.origin_asn AS VARCHAR) AS asns, s AS first_seen, s + INTERVAL 8 HOUR AS last_seen, round(least(0.7, 0.3 + 0.5 * (1 - ratio / base)), 6)::DOUBLE AS score, 'medium' AS confidence, array_to_string(cs, ',') AS collectors FROM r JOIN b USING (prefix) JOIN mo USING (s, prefix) WHERE ratio < base * 0.6 AND len(cs) >= 2""")
def a6(spark, d):
    e = p.elements(spark, d)
    return _shown(detectors.visibility_drops(p.rib(spark, d), e, min_baseline=0.05))


@query("a7_bogon", CTE + _ANN + " SELECT 'bogon' AS detector, prefix, CAST(origin_asn AS VARCHAR) AS asns, first_seen, last_seen, 0.5::DOUBLE AS score, " + _CONF + " FROM (SELECT replace(prefix, '197.64', '10.64') AS prefix, * EXCLUDE (prefix) FROM ann) WHERE prefix LIKE '10.%'")
def a7(spark, d):
    e = p.elements(spark, d).withColumn("prefix", F.replace("prefix", F.lit("197.64"), F.lit("10.64")))
    return _shown(detectors.unroutable(e))


def _events(spark, d) -> DataFrame:
    e = p.elements(spark, d)
    held = detectors.announced(e)
    found = _moas(spark, d, held).unionByName(detectors.rpki_invalid(e, p.roas(spark, d), held=held)).unionByName(detectors.subprefix(e, p.roas(spark, d), p.irr_routes(spark, d), held=held))
    return detectors.finish(found, p.asns(spark, d))


_EVENTS = f"""WITH RECURSIVE raw AS (SELECT * FROM ({_MOAS}) UNION ALL SELECT * FROM ({_INVALID}) UNION ALL SELECT * FROM ({_SUB})), regs AS (SELECT * FROM ({CTE} SELECT * FROM ref_asn)),
 l AS (SELECT *, list_transform(string_split(asns, ' '), lambda x: CAST(x AS BIGINT)) AS own FROM raw),
 ev AS (SELECT l.*, {uuid_sql(detectors.NAMESPACE, "detector || '|' || prefix || '|' || array_to_string(list_sort(own), ',') || '|' || CAST(first_seen AS VARCHAR)")} AS event_id FROM l),
 co AS (SELECT event_id, arg_min(country_iso2, list_position(own, asn)) AS country_iso2, bool_or(is_african) AS african FROM ev, regs WHERE list_contains(own, regs.asn) GROUP BY 1)"""


@query("a8_region_events", _EVENTS + " SELECT event_id, detector, prefix, CASE WHEN score >= 0.65 THEN 'critical' WHEN score >= 0.35 THEN 'watch' ELSE 'info' END AS severity, country_iso2, african FROM ev JOIN co USING (event_id) WHERE country_iso2 IS NOT NULL OR african")
def a8(spark, d):
    found = _events(spark, d).where("country_iso2 is not null or african")
    return found.select("event_id", "detector", "prefix", "severity", F.coalesce("country_iso2", F.lit("")).alias("country_iso2"), "african")


_INCIDENTS = _EVENTS + """, e AS (SELECT prefix AS k, first_seen, last_seen, detector, event_id, score, row_number() OVER (PARTITION BY prefix ORDER BY first_seen, detector, event_id) AS i FROM ev),
 r AS (SELECT k, i, first_seen AS anchor FROM e WHERE i = 1 UNION ALL SELECT e.k, e.i, CASE WHEN e.first_seen - r.anchor <= INTERVAL 60 MINUTE THEN r.anchor ELSE e.first_seen END FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1),
 g AS (SELECT k AS prefix, anchor AS first_seen, max(last_seen) AS last_seen, count(*) AS n, list_sort(list(DISTINCT detector)) AS ds, max(score) AS top FROM r JOIN e USING (k, i) GROUP BY k, anchor),
 s AS (SELECT *, round(least(1.0, top + least(0.25, 0.08 * (len(ds) - 1))), 3)::DOUBLE AS score FROM g)
 SELECT substr(sha1(encode(prefix || '|' || CAST(first_seen AS VARCHAR))), 1, 16) AS incident_id, prefix, CASE WHEN score >= 0.65 THEN 'critical' WHEN score >= 0.35 THEN 'watch' ELSE 'info' END AS severity, score, first_seen, last_seen, CAST(n AS INTEGER) AS n_events, array_to_string(ds, ',') AS detectors FROM s"""


@query("a9_incidents", _INCIDENTS)
def a9(spark, d):
    out = incidents.correlate(_events(spark, d))
    return out.select("incident_id", "prefix", "severity", "score", "first_seen", "last_seen", F.size("event_ids").alias("n_events"), F.array_join("detectors", ",").alias("detectors"))


@query("a9_anchor_grouping", """WITH RECURSIVE e AS (SELECT user_id AS k, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'error'),
 r AS (SELECT k, i, ts, ts AS anchor, 1 AS g FROM e WHERE i = 1 UNION ALL SELECT e.k, e.i, e.ts, CASE WHEN e.ts - r.anchor <= INTERVAL 12 HOUR THEN r.anchor ELSE e.ts END, CASE WHEN e.ts - r.anchor <= INTERVAL 12 HOUR THEN r.g ELSE r.g + 1 END FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1)
 SELECT CAST(k AS VARCHAR) AS prefix, anchor AS first_seen, count(*) AS n_events FROM r GROUP BY k, g, anchor""")
def a9_anchor(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'error'")
    e = e.select(F.col("user_id").cast("string").alias("prefix"), F.col("ts").alias("first_seen"), F.lit("x").alias("detector"), F.col("event_id").cast("string").alias("event_id"), F.lit(0.5).alias("score"), F.col("ts").alias("last_seen"))
    return incidents.correlate(e, 720).select("prefix", "first_seen", F.size("event_ids").cast("bigint").alias("n_events"))


@query("a10_upsert", "SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def a10(spark, d):
    keys = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("event_id"))
    return incidents.upsert(keys.where("event_id % 2 = 0").withColumn("version", F.lit("old")), keys.where("event_id % 3 = 0").withColumn("version", F.lit("new")))


@query("a11_confirmation", "SELECT o_orderkey AS event_id, CASE WHEN v = 'contradicted' AND s = 'critical' THEN 'watch' ELSE s END AS severity, coalesce(CASE WHEN s <> 'info' THEN v END, '') AS dataplane FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'watch' ELSE 'info' END AS s, CASE WHEN o_orderkey % 4 = 0 THEN 'confirmed' WHEN o_orderkey % 4 = 1 THEN 'contradicted' ELSE 'inconclusive' END AS v FROM orders)")
def a11(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("event_id"))
    e = o.withColumn("severity", F.when(F.col("event_id") % 3 == 0, "critical").when(F.col("event_id") % 3 == 1, "watch").otherwise("info"))
    one = o.where("event_id % 4 < 3").withColumn("ok", F.when(F.col("event_id") % 4 == 2, F.lit(None).cast("boolean")).otherwise(F.col("event_id") % 4 == 0))
    two = o.where("event_id % 4 < 2").withColumn("ok", F.lit(False))
    return detectors.confirm(e, one.unionByName(two)).select("event_id", "severity", F.coalesce("dataplane", F.lit("")).alias("dataplane"))


@query("a12_recall", CTE + " SELECT count(*) AS planted, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS found, round(count(*) FILTER (WHERE hit) / count(*), 6) AS recall FROM (SELECT t.prefix, t.day, EXISTS (SELECT 1 FROM obs WHERE elem_type = 'W' AND obs.prefix = t.prefix AND CAST(obs.ts AS DATE) = t.day) AS hit FROM (SELECT DISTINCT prefix, CAST(ts AS DATE) AS day FROM obs WHERE elem_type = 'A') t)")
def a12(spark, d):
    e = p.elements(spark, d)
    truth = e.where("elem_type = 'A'").select("prefix", F.to_date("ts").alias("day")).distinct()
    return incidents.recall(truth, e.where("elem_type = 'W'").withColumnRenamed("ts", "first_seen")).withColumn("recall", F.round("recall", 6))
