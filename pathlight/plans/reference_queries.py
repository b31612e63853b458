"""Queries over the reference tables: validation, relationships, organisations, anycast (D, J)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from pathlight.functions import paths, prefixes
from pathlight.operators import as_sets, origin, relations

from . import projection as p
from .metric_queries import NET
from .projection import CTE
from .registry import query


def _pairs(spark, d):
    return p.elements(spark, d).where("elem_type = 'A' and origin_asn is not null").select("prefix", "origin_asn").distinct()


@query("j9_containment", CTE + NET + " SELECT p.prefix, c.covering, r.asn FROM (SELECT DISTINCT prefix FROM pairs) p JOIN cover c USING (prefix) JOIN ref_irr r ON r.prefix = c.covering")
def j9(spark, d):
    return prefixes.containment_join(_pairs(spark, d), p.irr_routes(spark, d)).select("prefix", "covering", "asn")


@query("d2_rpki_validation", CTE + NET + " SELECT prefix, origin_asn, rpki_status FROM val")
def d2(spark, d):
    return origin.validate_rpki(_pairs(spark, d), p.roas(spark, d)).select("prefix", "origin_asn", "rpki_status")


@query("d3_authorised", CTE + NET + " SELECT p.prefix, array_to_string(list_sort(list(DISTINCT r.asn)), ' ') AS authorised FROM (SELECT DISTINCT prefix FROM pairs) p JOIN cover c USING (prefix) JOIN ref_roa r ON r.prefix = c.covering GROUP BY 1")
def d3(spark, d):
    return origin.authorised_asns(_pairs(spark, d), p.roas(spark, d)).select("prefix", paths.path_text(F.col("authorised")).alias("authorised"))


@query("d5_irr_validation", CTE + NET + " SELECT prefix, origin_asn, irr_status FROM val")
def d5(spark, d):
    return origin.validate_irr(_pairs(spark, d), p.irr_routes(spark, d)).select("prefix", "origin_asn", "irr_status")


#: Both orientations of each relationship.
REL = ", orel AS (SELECT a, b, max(r) AS relation FROM (SELECT as_a AS a, as_b AS b, CASE WHEN relationship = 'p2p' THEN 'peer' ELSE 'down' END AS r FROM ref_rel UNION ALL SELECT as_b, as_a, CASE WHEN relationship = 'p2p' THEN 'peer' ELSE 'up' END FROM ref_rel) GROUP BY 1, 2)"


@query("d6_relationship_lookup", CTE + REL + " SELECT a, b, relation FROM orel")
def d6(spark, d):
    return relations.oriented(p.relations(spark, d))


#: Links of the distinct paths with their relations; the automaton over the known ones.
LINKS = REL + """, pl AS (SELECT DISTINCT path FROM obs WHERE elem_type = 'A' AND len(path) >= 3), pe AS (SELECT path, unnest(range(1, len(path))) AS i FROM pl),
 lk AS (SELECT path, i, CASE relation WHEN 'up' THEN 0 WHEN 'peer' THEN 1 WHEN 'down' THEN 2 END AS r FROM pe LEFT JOIN orel ON a = path[i] AND b = path[i + 1]),
 st AS (SELECT *, max(r) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, count(r) OVER (PARTITION BY path) AS known FROM lk),
 vf AS (SELECT path, CAST(min(i - 1) FILTER (WHERE known >= 2 AND r IS NOT NULL AND before IS NOT NULL AND ((r = 0 AND before > 0) OR (r = 1 AND before >= 1))) AS INTEGER) AS violation, string_agg(coalesce(CASE r WHEN 0 THEN 'up' WHEN 1 THEN 'peer' WHEN 2 THEN 'down' END, '?'), ' ' ORDER BY i) AS relations FROM st GROUP BY 1)"""


@query("d8_classified_paths", CTE + LINKS + " SELECT array_to_string(path, ' ') AS path, relations FROM vf")
def d8(spark, d):
    rows = p.elements(spark, d).where("elem_type = 'A' and as_path_len >= 3")
    out = relations.classify_paths(rows, p.relations(spark, d))
    return out.select(paths.path_text(F.col("path")).alias("path"), F.array_join("relations", " ", "?").alias("relations"))


@query("d9_valley_free", CTE + LINKS + " SELECT array_to_string(path, ' ') AS path, violation FROM vf WHERE violation IS NOT NULL")
def d9(spark, d):
    rows = p.elements(spark, d).where("elem_type = 'A' and as_path_len >= 3")
    return relations.valley_free(rows, p.relations(spark, d)).where("violation is not null").select(paths.path_text(F.col("path")).alias("path"), "violation")


@query("d7_link_sources", CTE + REL + ", ev AS (SELECT as_a, as_b, CASE WHEN (as_a + as_b) % 4 = 0 THEN 'caida,ix' ELSE 'caida' END AS s FROM ref_rel WHERE (as_a + as_b) % 3 = 0) SELECT o.a, o.b, coalesce(e.s, 'caida') AS sources, CASE WHEN e.s = 'caida,ix' THEN 'high' ELSE 'medium' END AS confidence FROM orel o LEFT JOIN (SELECT as_a AS a, as_b AS b, s FROM ev UNION ALL SELECT as_b, as_a, s FROM ev) e ON e.a = o.a AND e.b = o.b")
def d7(spark, d):
    rel = p.relations(spark, d)
    both = F.when((F.col("as_a") + F.col("as_b")) % 4 == 0, F.array(F.lit("caida"), F.lit("ix"))).otherwise(F.array(F.lit("caida")))
    evidence = rel.where((F.col("as_a") + F.col("as_b")) % 3 == 0).withColumn("sources", both)
    links = relations.oriented(rel).select("a", "b")
    return relations.sources(links, evidence, rel).select("a", "b", F.array_join("sources", ",").alias("sources"), "confidence")


@query("d10_providers", CTE + " SELECT as_b AS asn, as_a AS provider FROM ref_rel WHERE relationship <> 'p2p'")
def d10(spark, d):
    return relations.providers(p.relations(spark, d))


@query("d11_siblings", CTE + " SELECT a.asn, b.asn AS sibling FROM ref_org a JOIN ref_org b ON a.org_id = b.org_id AND a.asn <> b.asn")
def d11(spark, d):
    return relations.siblings(p.orgs(spark, d))


@query("d12_known_anycast", CTE + NET + " SELECT DISTINCT p.prefix FROM pairs p JOIN cover c USING (prefix) JOIN ref_anycast a ON a.prefix = c.covering")
def d12(spark, d):
    return origin.known_anycast(_pairs(spark, d), p.anycast(spark, d))


@query("x9_path_similarity", CTE + """, s AS (SELECT DISTINCT prefix, array_to_string(path, ' ') AS t, path FROM obs WHERE elem_type = 'A'), z AS (SELECT prefix, t, lag(t) OVER w AS o, path[1 : len(path) - 1] AS a, lag(path[1 : len(path) - 1]) OVER w AS b FROM s WINDOW w AS (PARTITION BY prefix ORDER BY t))
 SELECT prefix, t AS one, o AS other, round(len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM z WHERE o IS NOT NULL""")
def x9(spark, d):
    # Each distinct path of a prefix against the one before it.
    s = p.elements(spark, d).where("elem_type = 'A'").select("prefix", "path").distinct().withColumn("one", paths.path_text(F.col("path")))
    near = Window.partitionBy("prefix").orderBy("one")
    met = s.withColumn("before", F.lag("path").over(near)).where("before is not null")
    return met.select("prefix", "one", paths.path_text(F.col("before")).alias("other"), F.round(paths.jaccard(F.col("path"), F.col("before")), 6).alias("jaccard"))


@query("j5_active_semi_join", CTE + " SELECT collector, prefix, count(*) AS n FROM obs WHERE elem_type = 'R' AND collector IN (SELECT collector FROM obs WHERE elem_type = 'W') GROUP BY 1, 2")
def j5(spark, d):
    e = p.elements(spark, d)
    return e.where("elem_type = 'R'").join(e.where("elem_type = 'W'").select("collector").distinct(), "collector", "left_semi").groupBy("collector", "prefix").agg(F.count(F.lit(1)).alias("n"))


@query("j12_external_neighbours", CTE + REL + " SELECT o.a AS asn, o.b AS neighbour, relation FROM orel o JOIN ref_asn x ON x.asn = o.a AND x.country_iso2 = 'NATION_5' WHERE o.b NOT IN (SELECT asn FROM ref_asn WHERE country_iso2 = 'NATION_5')")
def j12(spark, d):
    local = p.asns(spark, d).where("country_iso2 = 'NATION_5'").select("asn")
    rel = relations.oriented(p.relations(spark, d)).withColumnsRenamed({"a": "asn", "b": "neighbour"})
    return rel.join(local, "asn", "left_semi").join(local.withColumnRenamed("asn", "neighbour"), "neighbour", "left_anti").select("asn", "neighbour", "relation")


@query("s19_relationship_evidence", CTE + ", pr AS (SELECT asn, asn % 5 AS ix_id FROM ref_asn), st AS (SELECT as_a AS asn, as_b AS member FROM ref_rel WHERE as_b % 2 = 0) SELECT r.as_a, r.as_b, r.relationship, concat('caida', CASE WHEN relationship = 'p2p' AND EXISTS (SELECT 1 FROM pr x JOIN pr y USING (ix_id) WHERE x.asn = r.as_a AND y.asn = r.as_b) THEN ',peeringdb' ELSE '' END, CASE WHEN EXISTS (SELECT 1 FROM st WHERE st.asn = r.as_a AND st.member = r.as_b) THEN ',irr' ELSE '' END) AS sources FROM ref_rel r")
def s19(spark, d):
    rel = p.relations(spark, d)
    presence = p.asns(spark, d).select("asn", (F.col("asn") % 5).alias("ix_id"))
    sets = rel.where("as_b % 2 = 0").select(F.col("as_a").alias("asn"), F.col("as_b").alias("member"))
    return relations.evidence(rel, presence, sets).withColumn("sources", F.array_join("sources", ","))


@query("s13_registry", "SELECT asn, country_iso2, rir, rir = 'rir0' OR country_iso2 IN ('NATION_3', 'NATION_4') AS is_african FROM (SELECT *, row_number() OVER (PARTITION BY asn ORDER BY f) AS k FROM (SELECT p_partkey AS asn, concat('NATION_', CAST(p_partkey % 25 AS VARCHAR)) AS country_iso2, 'rir0' AS rir, 0 AS f FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, concat('NATION_', CAST(p_partkey % 7 AS VARCHAR)), 'rir1', 1 FROM part)) WHERE k = 1")
def s13(spark, d):
    from pathlight.sources import readers

    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("asn"))
    made = lambda rows, m, rir: rows.select("asn", F.concat(F.lit("NATION_"), (F.col("asn") % m).cast("string")).alias("country_iso2"), F.lit(rir).alias("rir"), F.lit("").alias("allocation_date"))
    out = readers.build_registry([made(part.where("asn % 3 = 0"), 25, "rir0"), made(part, 7, "rir1")], ["NATION_3", "NATION_4"], "x")
    return out.select("asn", "country_iso2", "rir", (F.col("is_african") | (F.col("rir") == "rir0")).alias("is_african"))


@query("s26_incremental_merge", "SELECT user_id, event_type, max(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) AS from_new, count(DISTINCT event_id % 2) AS sides FROM events GROUP BY 1, 2")
def s26(spark, d):
    from pathlight.sources import tables

    e = spark.read.parquet(f"{d}/events.parquet")
    keyed = e.select(F.lit(0).alias("ts"), F.lit("c").alias("collector"), F.col("user_id").alias("peer_asn"), F.lit("i").alias("peer_ip"), F.col("event_type").alias("elem_type"), F.lit("p").alias("prefix"), (F.col("event_id") % 2).alias("side")).distinct()
    merged = tables.merge_window(keyed.where("side = 1"), keyed.where("side = 0"))
    sides = keyed.groupBy("peer_asn", "elem_type").agg(F.count_distinct("side").alias("sides"))
    return merged.join(sides, ["peer_asn", "elem_type"]).select(F.col("peer_asn").alias("user_id"), F.col("elem_type").alias("event_type"), F.when(F.col("side") == 0, 1).otherwise(0).alias("from_new"), "sides")


#: As-sets over all parts: numbers in a set by their remainder, sets in each other with cycles.
_SETS = """SELECT concat('AS-S', CAST(p_partkey % 97 AS VARCHAR(9))) AS as_set, concat('AS', CAST(p_partkey AS VARCHAR(9))) AS member FROM part
 UNION SELECT concat('AS-S', CAST(p_partkey % 97 AS VARCHAR(9))), concat('AS-S', CAST((p_partkey % 97 * 5 + 3) % 97 AS VARCHAR(9))) FROM part WHERE p_partkey % 97 % 3 = 0
 UNION SELECT concat('AS-S', CAST(p_partkey % 97 AS VARCHAR(9))), concat('AS-S', CAST(p_partkey % 97 % 11 AS VARCHAR(9))) FROM part WHERE p_partkey % 97 % 7 = 1"""


def _expanded(spark, d, max_depth):
    members = p._view(spark, d, _SETS, "part")
    return as_sets.expand(members.select("as_set"), members, max_depth)


@query("s18_direct_members", f"WITH m AS ({_SETS}) SELECT as_set, CAST(substr(member, 3) AS BIGINT) AS asn, 1 AS depth FROM m WHERE regexp_matches(member, '^AS[0-9]+$')")
def s18(spark, d):
    return _expanded(spark, d, 1)


@query("s18_all_members", f"""WITH RECURSIVE m AS ({_SETS}), r AS (SELECT DISTINCT as_set, as_set AS node, 0 AS depth FROM m UNION SELECT r.as_set, m.member, r.depth + 1 FROM r JOIN m ON m.as_set = r.node WHERE r.depth < 40 AND member LIKE 'AS-%'),
 s AS (SELECT as_set, node, min(depth) AS depth FROM r GROUP BY 1, 2) SELECT s.as_set, CAST(substr(m.member, 3) AS BIGINT) AS asn, CAST(min(s.depth) + 1 AS INTEGER) AS depth FROM s JOIN m ON m.as_set = s.node WHERE regexp_matches(m.member, '^AS[0-9]+$') GROUP BY 1, 2""")
def s18b(spark, d):
    return _expanded(spark, d, None)
