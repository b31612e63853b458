"""The observation model over the tables of a data folder.

There is no routing data in the driver's tables; each relation of the model is a deterministic SELECT
over them, in SQL that both Spark and the oracle engine run. ``elements(spark, sf_dir)`` and the other
functions add what needs Spark's own functions (path arrays); ``CTE`` is the same for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathlight.functions import paths
from pathlight.session import keep

def _n(sql: str) -> str:
    return f"CAST({sql} AS VARCHAR(9))"


def _tail(t: str) -> str:
    """The prefix of number ``t`` of the long tail: every fourth one is IPv6."""
    v4 = f"concat({_n(f'102 + CAST(({t} - {t} % 65536) / 65536 AS BIGINT) % 24')}, '.', {_n(f'CAST(({t} - {t} % 256) / 256 AS BIGINT) % 256')}, '.', {_n(f'{t} % 256')}, '.0/24')"
    return f"CASE WHEN {t} % 4 = 3 THEN concat('2c0f:', {_n(f'1000 + CAST(({t} - {t} % 1000) / 1000 AS BIGINT) % 9000')}, ':', {_n(f'1000 + {t} % 1000')}, '::/48') ELSE {v4} END"


def _wide(t: str) -> str:
    """The /16 or /32 that the prefix of number ``t`` lies in."""
    return f"regexp_replace(regexp_replace({_tail(t)}, '[.][0-9]+[.]0/24', '.0.0/16'), ':[0-9]+::/48', '::/32')"


#: Message elements, from the table events. Two thirds of them are about twelve prefixes that are always busy (those of k >= 6
#: lie inside those of k - 6), the others about a tail that grows by 100 prefixes for 800 events, each with an origin of its own.
ELEMENTS = f"""
SELECT ts, event_id AS seq, concat('c', {_n("user_id % 3")}) AS collector, user_id % 12 + 64 AS peer_asn,
       concat('10.0.0.', {_n("user_id % 12")}) AS peer_ip, elem_type, prefix, prefix_ip_version, prefix_len,
       CASE WHEN elem_type = 'W' THEN NULL ELSE origin END AS origin_asn,
       CASE WHEN elem_type = 'W' THEN '' ELSE
         concat({_n("user_id % 12 + 64")}, ' ', {_n("80 + user_id % 4")}, ' ',
           CASE WHEN event_id % 3 = 0 THEN concat({_n("90 + event_id % 5")}, ' ', {_n("90 + event_id % 5")}, ' ') WHEN event_id % 3 = 1 THEN concat({_n("90 + user_id % 3")}, ' ') ELSE '' END, {_n("origin")}) END AS path_text,
       event_id % 29 = 0 AS has_as_set
FROM (SELECT *, CASE WHEN event_type = 'error' THEN 'W' WHEN event_type = 'signup' THEN 'R' ELSE 'A' END AS elem_type,
        CASE WHEN busy THEN concat('197.', {_n("(event_id % 6) * 32")}, '.', CASE WHEN event_id % 12 >= 6 THEN '16' ELSE '0' END, '.0/', CASE WHEN event_id % 12 >= 6 THEN '20' ELSE '12' END) ELSE {_tail("t")} END AS prefix,
        CASE WHEN NOT busy AND t % 4 = 3 THEN 6 ELSE 4 END AS prefix_ip_version,
        CASE WHEN busy THEN CASE WHEN event_id % 12 >= 6 THEN 20 ELSE 12 END WHEN t % 4 = 3 THEN 48 ELSE 24 END AS prefix_len,
        CASE WHEN busy AND event_id % 17 = 0 THEN 100 + (event_id + 5) % 12 WHEN busy THEN 100 + event_id % 12 WHEN event_id % 17 = 0 THEN 146 + t ELSE 141 + t END AS origin
      FROM (SELECT *, event_id % 36 < 24 AS busy, CAST((event_id - event_id % 800) / 8 AS BIGINT) + event_id % 100 AS t FROM events) AS e1) AS e2
"""
#: AS registry, from parts and nations.
ASNS = f"""
SELECT p.p_partkey AS asn, n.n_name AS country_iso2, concat('rir', {_n("n.n_regionkey")}) AS rir, n.n_regionkey = 0 AS is_african
FROM part p JOIN nation n ON p.p_partkey % 25 = n.n_nationkey
"""
#: One authorisation of each AS: five about the busy prefixes, later ones about the AS's own prefix, the wider one around it or unused space.
ROAS = f"""
SELECT CASE WHEN p_partkey BETWEEN 102 AND 106 THEN concat('197.', {_n("(p_partkey % 6) * 32")}, '.0.0/12') WHEN p_partkey > 140 AND p_partkey % 64 = 1 THEN {_wide("(p_partkey - 141)")}
            WHEN p_partkey > 140 AND p_partkey % 3 <> 2 THEN {_tail("(p_partkey - 141)")} ELSE concat('41.', {_n("CAST((p_partkey - p_partkey % 256) / 256 AS BIGINT) % 256")}, '.', {_n("p_partkey % 256")}, '.0/24') END AS prefix,
       p_partkey AS asn, CASE WHEN p_partkey > 140 AND p_partkey % 64 = 1 THEN 28 WHEN p_partkey > 140 THEN 48 - p_partkey % 5 % 2 * 24 WHEN p_partkey % 2 = 0 THEN 20 ELSE 12 END AS max_len
FROM part
"""
#: One route object of each AS, later ones for its own prefix or its neighbour's.
IRR_ROUTES = f"""
SELECT CASE WHEN p_partkey BETWEEN 100 AND 111 THEN concat('197.', {_n("(p_partkey % 6) * 32")}, '.', CASE WHEN p_partkey % 4 = 0 THEN '16.0/20' ELSE '0.0/12' END)
            WHEN p_partkey > 140 THEN {_tail("(p_partkey - 141 + CASE WHEN p_partkey % 5 = 2 THEN 4 ELSE 0 END)")} ELSE concat('41.200.', {_n("p_partkey")}, '.0/24') END AS prefix, p_partkey AS asn
FROM part
"""
#: Relationships: transit 80-83 above peers 64-75, 90-94 above some of 80-83 and below others, and above most origins; peers among 80-83.
RELATIONS = f"""
SELECT CAST(h.hub AS BIGINT) AS as_a, b.asn AS as_b, CASE WHEN b.grp = 'core' AND h.hub < 84 THEN 'p2p' ELSE 'p2c' END AS relationship
FROM (SELECT p_partkey AS asn, CASE WHEN p_partkey BETWEEN 64 AND 75 THEN 'peer' WHEN p_partkey BETWEEN 80 AND 83 THEN 'core' WHEN p_partkey BETWEEN 90 AND 94 THEN 'transit' WHEN p_partkey >= 100 THEN 'edge' END AS grp FROM part) b
JOIN (VALUES {", ".join(f"({hub}, '{grp}')" for grp, hubs in (("peer", (range(80, 84),)), ("core", (range(80, 84), range(90, 95))), ("transit", (range(80, 84), range(100, 112))), ("edge", (range(90, 95),))) for hub_range in hubs for hub in hub_range)}) AS h(hub, grp) ON h.grp = b.grp
WHERE (b.grp = 'peer' AND (h.hub + b.asn) % 2 = 0) OR (b.grp = 'core' AND h.hub < 84 AND h.hub < b.asn) OR (b.grp = 'core' AND h.hub >= 90 AND (h.hub + b.asn) % 3 = 0)
   OR (b.grp = 'transit' AND h.hub < 84 AND (h.hub + b.asn) % 3 = 1) OR (b.grp = 'transit' AND h.hub >= 100 AND (h.hub + b.asn) % 4 = 0) OR (b.grp = 'edge' AND (h.hub + b.asn) % 4 <> 0)
"""
#: Organisations of nine AS numbers, nine organisations in 81 numbers.
_ORG = _n("CAST((p_partkey - p_partkey % 81) / 9 AS BIGINT) + p_partkey % 9")
ORGS = f"SELECT p_partkey AS asn, concat('AS-', {_n('p_partkey')}) AS asn_name, concat('ORG-', {_ORG}) AS org_id, concat('Org ', {_ORG}) AS org_name FROM part"
#: Collector roles; the others are local.
ROLES = "SELECT 'c0' AS collector, 'external' AS role UNION ALL SELECT 'c1' AS collector, 'local' AS role"
#: Catalogue of anycast space.
ANYCAST = "SELECT '197.32.0.0/12' AS prefix UNION ALL SELECT '197.64.0.0/16' AS prefix"

_ORACLE = {"ref_asn": ASNS, "ref_roa": ROAS, "ref_irr": IRR_ROUTES, "ref_rel": RELATIONS, "ref_org": ORGS, "roles": ROLES, "ref_anycast": ANYCAST}

#: The oracle's version and bits of a prefix as the model writes it.
VERSION = "CASE WHEN contains(prefix, ':') THEN 6 ELSE 4 END"
BITS = """CASE WHEN contains(prefix, ':') THEN concat('0010110000001111', lpad(bin(CAST(concat('0x', split_part(prefix, ':', 2)) AS BIGINT)), 16, '0'), lpad(bin(CAST(concat('0x0', replace(split_part(prefix, ':', 3), '/', '')) AS BIGINT)), 16, '0'))
 ELSE concat(lpad(bin(CAST(split_part(prefix, '.', 1) AS BIGINT)), 8, '0'), lpad(bin(CAST(split_part(prefix, '.', 2) AS BIGINT)), 8, '0'), lpad(bin(CAST(split_part(prefix, '.', 3) AS BIGINT)), 8, '0'), '00000000') END"""

#: Common table expressions of the oracle: ``WITH`` and all relations.
CTE = (
    f"WITH elements0 AS ({ELEMENTS}), elements AS (SELECT *, CAST(string_split(path_text, ' ') AS BIGINT[]) AS as_path FROM (SELECT * REPLACE (nullif(path_text, '') AS path_text) FROM elements0)), "
    "obs AS (SELECT *, CASE WHEN as_path IS NULL THEN CAST([] AS BIGINT[]) ELSE list_filter(as_path, lambda x, i: i = 1 OR x <> as_path[i - 1]) END AS path FROM elements), "
    + ", ".join(f"{name} AS ({sql})" for name, sql in _ORACLE.items())
)


def _view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(_bind(sql, tables), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def _bind(sql: str, tables: tuple[str, ...]) -> str:
    out = sql.replace("VARCHAR(9)", "STRING")
    for t in tables:
        out = out.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}").replace(f", {t} ", f", {{{t}}} ")
    return out


_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def _reference(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """A reference relation as a table; made at its first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, sql)
    if key not in _KEPT:
        _KEPT[key] = keep(_view(spark, sf_dir, sql, *tables))
    return _KEPT[key]


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements with as_path, path (without prepends) and as_path_len."""
    rows = _view(spark, sf_dir, ELEMENTS, "events")
    rows = rows.withColumn("as_path", paths.parse_path(F.col("path_text")))
    return rows.withColumn("path", paths.drop_prepends(F.col("as_path"))).withColumn("as_path_len", F.size("path"))


def rib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table dump rows, one snapshot a day."""
    rows = elements(spark, sf_dir).where("elem_type = 'R'")
    return rows.withColumn("snapshot_ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))


def asns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reference(spark, sf_dir, ASNS, "part", "nation")


def roas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reference(spark, sf_dir, ROAS, "part")


def irr_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reference(spark, sf_dir, IRR_ROUTES, "part")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reference(spark, sf_dir, RELATIONS, "part")


def orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reference(spark, sf_dir, ORGS, "part")


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ROLES)


def anycast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ANYCAST)
