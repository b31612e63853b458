"""Propagation and replay queries (R, Q22-Q24) with their oracles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pathlight.functions import paths
from pathlight.operators import graph, relations as rel, replay

from . import projection as p, stored
from .projection import CTE
from .reference_queries import LINKS, REL
from .registry import query

_PFX = "197.32.0.0/12"
_W = f", w AS (SELECT list_reverse(path) AS path, count(*) AS n FROM obs WHERE prefix = '{_PFX}' AND len(path) > 0 GROUP BY 1), l AS (SELECT DISTINCT path, n, path[i] AS a, path[i + 1] AS b FROM (SELECT path, n, unnest(range(1, len(path))) AS i FROM w))"


def _weights(spark, d):
    return graph.path_weights(p.elements(spark, d), _PFX)


@query("q22_propagation_edges", CTE + REL + _W + " SELECT l.a, l.b, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT path) AS paths, coalesce(any_value(o.relation), '') AS relation FROM l LEFT JOIN orel o ON o.a = l.b AND o.b = l.a GROUP BY 1, 2")
def q22(spark, d):
    return graph.edges(_weights(spark, d), p.relations(spark, d)).fillna("", ["relation"])


@query("q22_propagation_nodes", CTE + _W + ", x AS (SELECT path, n, unnest(range(1, len(path) + 1)) AS i FROM w) SELECT path[i] AS asn, CAST(sum(n) AS BIGINT) AS n, CAST(min(i) - 1 AS INTEGER) AS depth, CAST(greatest(0, count(DISTINCT path) - 3) AS INTEGER) AS hidden, array_to_string(list_sort(list(DISTINCT array_to_string(path, ' ')))[1:3], ',') AS sample FROM x GROUP BY 1")
def q22b(spark, d):
    return graph.nodes(_weights(spark, d)).withColumn("sample", F.array_join("sample", ","))


@query("q22_propagation_paths", CTE + _W + " SELECT array_to_string(path, ' ') AS path, n FROM w ORDER BY n DESC, w.path LIMIT 50")
def q22c(spark, d):
    return graph.ranked_paths(_weights(spark, d), 50).select(paths.path_text(F.col("path")).alias("path"), "n")


_AT = replay.span(datetime(2024, 1, 10), datetime(2024, 1, 13), 360)
_RP = f""", f AS (SELECT k, TIMESTAMP '2024-01-10' + INTERVAL 1 HOUR * (k * 6) AS frame FROM (SELECT unnest(range(0, 13)) AS k)), msg AS (SELECT * FROM obs WHERE prefix = '{_PFX}' AND ts >= TIMESTAMP '2024-01-09' AND ts <= TIMESTAMP '2024-01-13'),
 s AS (SELECT elem_type, list_reverse(path) AS path, ts, lead(ts) OVER (PARTITION BY collector, peer_ip ORDER BY ts, seq) AS nx FROM msg WHERE elem_type = 'W' OR len(path) > 0),
 st AS (SELECT k, frame, path FROM f JOIN s ON s.ts <= f.frame AND (s.nx IS NULL OR s.nx > f.frame) WHERE elem_type <> 'W'), fr AS (SELECT frame, path, count(*) AS peers FROM st GROUP BY 1, 2),
 ed AS (SELECT DISTINCT k, frame, path[i] AS source, path[i + 1] AS target FROM (SELECT k, frame, path, unnest(range(1, len(path))) AS i FROM st))"""


def _elements(spark, d):
    return stored.store(spark, d).elements("2024-01-09", "2024-01-13")


def _states(spark, d, **how):
    return replay.states(_elements(spark, d), _PFX, _AT, **how)


def _replay(spark, d):
    return replay.paths(_states(spark, d), _AT)


@query("q23_replay", CTE + _RP + " SELECT frame, array_to_string(path, ' ') AS path, peers FROM fr")
def q23(spark, d):
    return _replay(spark, d).withColumn("path", paths.path_text(F.col("path")))


@query("q23_replay_frames", CTE + _RP + """, c AS (SELECT k, CAST(count(*) FILTER (WHERE elem_type <> 'W') AS BIGINT) AS announcements, CAST(count(*) FILTER (WHERE elem_type = 'W') AS BIGINT) AS withdrawals FROM f JOIN msg ON msg.ts <= f.frame AND msg.ts > f.frame - INTERVAL 6 HOUR WHERE k > 0 GROUP BY 1)
 SELECT f.frame, coalesce(c.announcements, 0) AS announcements, coalesce(c.withdrawals, 0) AS withdrawals, (SELECT count(DISTINCT path) FROM st WHERE st.k = f.k) AS paths, (SELECT count(DISTINCT x) FROM (SELECT unnest(path) AS x FROM st WHERE st.k = f.k)) AS nodes, (SELECT count(*) FROM ed WHERE ed.k = f.k) AS edges FROM f LEFT JOIN c ON c.k = f.k""")
def q23b(spark, d):
    return replay.frames(_elements(spark, d), _states(spark, d), _PFX, _AT)


@query("q23_replay_origin", CTE + _RP + """, o AS (SELECT frame, path, list_position(list_transform(path, lambda x: x IN (80, 82)), true) AS i FROM st WHERE path[1] = 106) SELECT frame, array_to_string(CASE WHEN coalesce(i, 0) > 0 THEN path[1:i] ELSE path END, ' ') AS path, count(*) AS peers FROM o GROUP BY 1, 2""")
def q23c(spark, d):
    return replay.paths(_states(spark, d, origin=106, targets=[80, 82]), _AT).withColumn("path", paths.path_text(F.col("path")))


@query("r10_stable_edges", CTE + _RP + " SELECT source, target FROM ed GROUP BY 1, 2 HAVING count(*) = 13")
def r10b(spark, d):
    return replay.stable_edges(_states(spark, d), _AT)


@query("r10_edge_changes", CTE + _RP + """ SELECT frame, source, target, 'added' AS change FROM ed WHERE k > 0 AND NOT EXISTS (SELECT 1 FROM ed x WHERE x.source = ed.source AND x.target = ed.target AND x.k = ed.k - 1)
 UNION ALL SELECT f.frame, source, target, 'removed' FROM ed JOIN f ON f.k = ed.k + 1 WHERE NOT EXISTS (SELECT 1 FROM ed x WHERE x.source = ed.source AND x.target = ed.target AND x.k = ed.k + 1)""")
def r10c(spark, d):
    return replay.changes(_states(spark, d), _AT)


@query("r10_difference", CTE + _RP + """, e0 AS (SELECT source, target FROM ed WHERE k = 0) SELECT frame, source, target, 'added' AS change FROM ed WHERE (source, target) NOT IN (SELECT (source, target) FROM e0)
 UNION ALL SELECT f.frame, e0.source, e0.target, 'removed' FROM e0, f WHERE NOT EXISTS (SELECT 1 FROM ed x WHERE x.source = e0.source AND x.target = e0.target AND x.k = f.k)""")
def r10d(spark, d):
    return replay.difference(_states(spark, d), _AT)


@query("r10_frame_changes", CTE + _RP + ", n AS (SELECT path, dense_rank() OVER (ORDER BY frame) AS i FROM fr), fi AS (SELECT DISTINCT frame, dense_rank() OVER (ORDER BY frame) AS i FROM fr) SELECT fi.frame, array_to_string(path, ' ') AS path, change FROM (SELECT n.path, n.i, 'added' AS change FROM n WHERE i > 1 AND NOT EXISTS (SELECT 1 FROM n m WHERE m.path = n.path AND m.i = n.i - 1) UNION ALL SELECT n.path, n.i + 1, 'removed' FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.path = n.path AND m.i = n.i + 1)) c JOIN fi ON fi.i = c.i")
def r10(spark, d):
    return graph.frame_changes(_replay(spark, d)).withColumn("path", paths.path_text(F.col("path")))


@query("q24_upstreams_over_time", CTE + f", b AS (SELECT time_bucket(INTERVAL 24 HOUR, ts) AS bucket, path[len(path) - 1] AS upstream_asn, count(DISTINCT (collector, peer_ip)) AS peers FROM obs WHERE prefix = '{_PFX}' AND len(path) >= 2 GROUP BY 1, 2), s AS (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), INTERVAL 24 HOUR)) AS bucket) SELECT s.bucket, u.upstream_asn, CAST(coalesce(b.peers, 0) AS BIGINT) AS peers FROM s CROSS JOIN (SELECT DISTINCT upstream_asn FROM b) u LEFT JOIN b ON b.bucket = s.bucket AND b.upstream_asn = u.upstream_asn")
def q24(spark, d):
    return graph.upstream_series(p.elements(spark, d), _PFX, 24)


@query("q24_upstream_ranking", CTE + f", b AS (SELECT time_bucket(INTERVAL 24 HOUR, ts) AS bucket, path[len(path) - 1] AS upstream_asn, count(DISTINCT (collector, peer_ip)) AS peers FROM obs WHERE prefix = '{_PFX}' AND len(path) >= 2 AND elem_type = 'A' AND origin_asn = 101 GROUP BY 1, 2), k AS (SELECT upstream_asn, max(peers) AS peak, arg_min(bucket, (-peers, bucket)) AS peak_at, count(*) AS buckets FROM b GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY peak DESC, upstream_asn) AS INTEGER) AS rank FROM k")
def q24b(spark, d):
    return graph.upstream_ranking(graph.upstream_series(p.elements(spark, d), _PFX, 24, 101, ("A",)))


@query("r7_folded_depths", CTE + _W + """, e AS (SELECT DISTINCT coalesce(x.country_iso2, CAST(l.a AS VARCHAR)) AS a, coalesce(y.country_iso2, CAST(l.b AS VARCHAR)) AS b FROM l LEFT JOIN ref_asn x ON x.asn = l.a AND NOT x.is_african LEFT JOIN ref_asn y ON y.asn = l.b AND NOT y.is_african),
 o AS (SELECT DISTINCT coalesce(x.country_iso2, CAST(path[1] AS VARCHAR)) AS node FROM w LEFT JOIN ref_asn x ON x.asn = path[1] AND NOT x.is_african),
 d1 AS (SELECT DISTINCT b AS node FROM e WHERE a <> b AND a IN (SELECT node FROM o)), d2 AS (SELECT DISTINCT b AS node FROM e WHERE a <> b AND a IN (SELECT node FROM d1)), d3 AS (SELECT DISTINCT b AS node FROM e WHERE a <> b AND a IN (SELECT node FROM d2)), d4 AS (SELECT DISTINCT b AS node FROM e WHERE a <> b AND a IN (SELECT node FROM d3))
 SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT node, 0 AS depth FROM o UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2 UNION ALL SELECT node, 3 FROM d3 UNION ALL SELECT node, 4 FROM d4) GROUP BY 1""")
def r7(spark, d):
    groups = p.asns(spark, d).where("not is_african").select("asn", F.col("country_iso2").alias("node"))
    held = _weights(spark, d)
    roots = held.select(F.col("path")[0].alias("asn")).distinct().join(groups, "asn", "left").select(F.coalesce("node", F.col("asn").cast("string")).alias("node"))
    return graph.depths(graph.fold(graph.edges(held, p.relations(spark, d)), groups), roots)


@query("r5_offending_edges", CTE + LINKS + f" SELECT path[violation + 1] AS a, path[violation + 2] AS b, count(*) AS paths FROM vf WHERE violation IS NOT NULL AND path IN (SELECT path FROM obs WHERE prefix = '{_PFX}' AND elem_type = 'A') GROUP BY 1, 2")
def r5(spark, d):
    rows = p.elements(spark, d).where((F.col("prefix") == _PFX) & (F.col("elem_type") == "A") & (F.col("as_path_len") >= 3))
    bad = rel.valley_free(rows, p.relations(spark, d)).where("violation is not null")
    return bad.groupBy(F.get("path", F.col("violation")).alias("a"), F.get("path", F.col("violation") + 1).alias("b")).agg(F.count(F.lit(1)).alias("paths"))


@query("r6_folded_graph", CTE + _W + " SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM (SELECT coalesce(x.country_iso2, CAST(l.a AS VARCHAR)) AS a, coalesce(y.country_iso2, CAST(l.b AS VARCHAR)) AS b, n FROM l LEFT JOIN ref_asn x ON x.asn = l.a AND NOT x.is_african LEFT JOIN ref_asn y ON y.asn = l.b AND NOT y.is_african) WHERE a <> b GROUP BY 1, 2")
def r6(spark, d):
    groups = p.asns(spark, d).where("not is_african").select("asn", F.col("country_iso2").alias("node"))
    return graph.fold(graph.edges(_weights(spark, d), p.relations(spark, d)), groups)


@query("r9_paths_through", CTE + _W + " SELECT a, b, CAST(sum(n) AS BIGINT) AS n FROM l WHERE list_contains(path, 92) GROUP BY 1, 2")
def r9(spark, d):
    return graph.through(_weights(spark, d), 92)
