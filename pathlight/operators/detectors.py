"""Anomaly detectors: each a function of lazy DataFrames that returns candidate events.

Candidate columns: detector, prefix, asns array<bigint>, first_seen, last_seen, score, confidence,
collectors array<string>, evidence (JSON). Grouping keys are (prefix, origin) and the like; a hot prefix
is reduced by partial aggregation before its shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathlight.functions import ids, paths, prefixes, windows
from pathlight.session import keep, merged

from . import origin, relations as rel

#: Namespace of event identifiers.
NAMESPACE = uuid.UUID("8f0f5c5e-6f5b-4c55-9d4b-0d0c7d3f6a10")
CRITICAL, WATCH = 0.65, 0.35


def clamp(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def severity(score: Column) -> Column:
    return F.when(score >= CRITICAL, "critical").when(score >= WATCH, "watch").otherwise("info")


def confidence(peers: Column, collectors: Column) -> Column:
    return F.when((peers >= 5) & (collectors >= 2), "high").when((peers >= 3) | (collectors >= 2), "medium").otherwise("low")


def announced(elements: DataFrame) -> DataFrame:
    """One row for each prefix and origin that was announced, kept as a table: detectors may share it as their ``held``."""
    rows = elements.where("elem_type = 'A' and origin_asn is not null")
    return keep(
        rows.groupBy("prefix", "origin_asn").agg(
            F.count_distinct("peer_asn").alias("peers"), F.array_sort(F.collect_set("collector")).alias("collectors"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("announcements")
        )
    )


def _event(name: str, score: Column, asns: Column, peers: Column, sure: Column | None = None, **evidence: Column) -> list[Column]:
    """Columns of a candidate; ``sure``: its confidence, where that isn't judged by peers and collectors."""
    sure = confidence(peers, F.size("collectors")) if sure is None else sure
    return [
        F.lit(name).alias("detector"), "prefix", asns.cast("array<bigint>").alias("asns"), "first_seen", "last_seen", clamp(score).alias("score"),
        sure.alias("confidence"), "collectors", F.to_json(F.struct(*[c.alias(k) for k, c in evidence.items()])).alias("evidence"),
    ]


def stable_pairs(history: DataFrame, start: Column, days: int = 14, least: int = 3) -> DataFrame:
    """(prefix, origin_asn) announced on at least so many days of the days before ``start``."""
    day = F.to_date("ts")
    rows = history.where("elem_type = 'A' and origin_asn is not null").where((day < start) & (day >= F.date_sub(start, days)))
    return rows.groupBy("prefix", "origin_asn").agg(F.count_distinct(day).alias("n")).where(F.col("n") >= least).select("prefix", "origin_asn")


def moas(
    elements: DataFrame, roas: DataFrame, routes: DataFrame, relations: DataFrame, orgs: DataFrame, catalogue: DataFrame, stable: DataFrame | None = None, min_peers: int = 2, ceiling: float = 0.5, held: DataFrame | None = None
) -> DataFrame:
    """Prefixes with several origins: challengers of the most announced one that no filter finds legitimate.

    The cheap filters come first; path similarity is only computed for challengers inside known anycast space.
    """
    held = announced(elements) if held is None else held
    order = Window.partitionBy("prefix").orderBy(F.desc("announcements"), "origin_asn")
    ranked = held.withColumn("rank", F.row_number().over(order))
    first = ranked.where("rank = 1").select("prefix", F.col("origin_asn").alias("incumbent"), F.col("announcements").alias("incumbent_announcements"), F.col("peers").alias("incumbent_peers"))
    rows = ranked.where((F.col("rank") > 1) & (F.col("peers") >= min_peers)).join(merged(first), "prefix")
    org = merged(orgs.select("asn", "org_id"))
    rows = rows.join(org.withColumnsRenamed({"asn": "incumbent", "org_id": "org_a"}), "incumbent", "left").join(org.withColumnsRenamed({"asn": "origin_asn", "org_id": "org_b"}), "origin_asn", "left")
    rows = rows.where(~F.coalesce(F.col("org_a") == F.col("org_b"), F.lit(False))).drop("org_a", "org_b")
    direct = merged(rel.oriented(relations)).select(F.col("a").alias("incumbent"), F.col("b").alias("origin_asn"))
    rows = rows.join(direct, ["incumbent", "origin_asn"], "left_anti")
    if stable is not None:
        rows = rows.join(merged(stable), ["prefix", "origin_asn"], "left_anti")
    rows = origin.validate(keep(rows), roas, routes)
    rows = keep(rows.where("rpki_status <> 'valid' and not (rpki_status = 'not-found' and irr_status = 'consistent')"))
    known = rows.join(merged(origin.known_anycast(rows, catalogue)), "prefix", "left_semi")
    anycast = origin.divergent(known, elements.where("elem_type = 'A' and origin_asn is not null"), ceiling)
    rows = rows.join(merged(anycast), ["prefix", "incumbent", "origin_asn"], "left_anti")
    score = F.lit(0.45) + F.when(F.col("rpki_status") == "invalid", 0.35).when(F.col("rpki_status") == "valid", -0.25).otherwise(0.0) + F.least(F.lit(0.15), F.col("peers") * 0.03)
    score = score + F.when(F.col("announcements") < F.col("incumbent_announcements") * 0.1, 0.05).otherwise(0.0)
    return rows.select(*_event("moas", score, F.array("incumbent", "origin_asn"), F.col("peers"), competing_origin=F.col("origin_asn"), incumbent_origin=F.col("incumbent"), rpki_status=F.col("rpki_status")))


def subprefix(elements: DataFrame, roas: DataFrame, routes: DataFrame, min_excess: int = 1, held: DataFrame | None = None) -> DataFrame:
    """More-specific announcements beyond a covering authorisation, or beyond a covering route object of another AS."""
    held = keep(origin.validate_rpki(announced(elements) if held is None else held, roas))
    cover = prefixes.containment_join(held, roas)
    exceeded = cover.where((F.col("own") > F.col("max_len")) & (F.col("own") - F.col("len") >= min_excess))
    exceeded = exceeded.groupBy("prefix").agg(F.min_by(F.struct("covering", "asn", "max_len"), F.struct("len", "asn")).alias("cover"))
    by_roa = held.where("rpki_status <> 'valid'").join(merged(exceeded), "prefix")
    one = by_roa.select(*_event("subprefix", 0.6 + F.least(F.lit(0.25), F.col("peers") * 0.05), F.array("origin_asn", "cover.asn"), F.col("peers"), covering=F.col("cover.covering"), max_len=F.col("cover.max_len")))
    uncovered = held.join(merged(cover.select("prefix").distinct()), "prefix", "left_anti")
    irr = prefixes.containment_join(uncovered, routes).where("own > len").withColumnRenamed("asn", "route_asn")
    met = uncovered.join(merged(irr.select("prefix", "covering", "len", "route_asn")), "prefix")
    same = met.groupBy("prefix", "origin_asn").agg(F.bool_or(F.col("route_asn") == F.col("origin_asn")).alias("same"), F.min_by(F.struct("covering", F.col("route_asn").alias("asn")), F.struct("len", "route_asn")).alias("cover"))
    by_irr = uncovered.join(merged(same.where("not same")), ["prefix", "origin_asn"])
    two = by_irr.select(*_event("subprefix", 0.4 + F.least(F.lit(0.15), F.col("peers") * 0.03), F.array("origin_asn", "cover.asn"), F.col("peers"), covering=F.col("cover.covering"), max_len=F.lit(None).cast("int")))
    return one.unionByName(two)


def rpki_invalid(elements: DataFrame, roas: DataFrame, min_peers: int = 3, held: DataFrame | None = None) -> DataFrame:
    held = keep(origin.validate_rpki(announced(elements) if held is None else held, roas).where((F.col("rpki_status") == "invalid") & (F.col("peers") >= min_peers)))
    rows = held.join(merged(origin.authorised_asns(held, roas)), "prefix", "left")
    asns = F.concat(F.array("origin_asn"), F.slice(F.coalesce("authorised", F.array().cast("array<bigint>")), 1, 3))
    return rows.select(*_event("rpki_invalid", 0.45 + F.least(F.lit(0.2), F.col("peers") * 0.02), asns, F.col("peers"), announcements=F.col("announcements")))


def route_leaks(elements: DataFrame, relations: DataFrame, evidence: DataFrame | None = None, min_peers: int = 2) -> DataFrame:
    """Paths that go up or sideways after they went down, by prefix and leaking AS.

    The score is capped unless two sources know the link at which the path leaks (by default only the inferred
    relations do).
    """
    rows = elements.where("elem_type = 'A' and as_path_len >= 3")
    held = rows.groupBy("prefix", "path").agg(F.count_distinct("peer_asn").alias("peers"), F.array_sort(F.collect_set("collector")).alias("collectors"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    bad = rel.valley_free(rows, relations).where("violation is not null").select("path", "violation")
    met = held.join(bad, "path").withColumn("leaker", F.get("path", F.col("violation")))
    first = F.min_by(F.struct("path", "violation"), F.struct("path", "violation"))
    out = met.groupBy("prefix", "leaker").agg(
        F.sum("peers").alias("peers"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("collectors")))).alias("collectors"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), first.alias("first"), F.count(F.lit(1)).alias("n_paths")
    )
    out = out.where(F.col("peers") >= min_peers)
    score = 0.4 + F.least(F.lit(0.2), F.col("peers") * 0.04)
    if evidence is None:
        score = F.least(F.lit(0.55), score)
    else:
        out = out.withColumn("a", F.get("first.path", F.col("first.violation"))).withColumn("b", F.get("first.path", F.col("first.violation") + 1))
        out = rel.sources(out, evidence, relations)
        score = F.when(F.size("sources") < 2, F.least(F.lit(0.55), score)).otherwise(score)
    return out.select(*_event("valley_free", score, F.array("leaker"), F.col("peers"), path=paths.path_text(F.col("first.path")), n_paths=F.col("n_paths")))


def robust_z(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add median, z: distance from the median in scaled median deviations (standard deviations where those are zero)."""
    middle = series.groupBy(*keys).agg(F.median(value).alias("median"), F.stddev_samp(value).alias("std"))
    held = series.join(middle, keys)
    spread = held.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    held = held.join(spread, keys)
    z = F.when(F.col("mad") > 0, 0.6745 * (F.col(value) - F.col("median")) / F.col("mad")).when(F.col("std") > 0, (F.col(value) - F.col("median")) / F.col("std")).otherwise(F.lit(0.0))
    return held.withColumn("z", z).drop("mad", "std")


def churn_spikes(elements: DataFrame, threshold: float = 6.0, min_updates: int = 50, min_windows: int = 6, window: str = "1h") -> DataFrame:
    rows = elements.where("elem_type <> 'R'").withColumn("first_seen", windows.tumbling(F.col("ts"), window))
    series = rows.groupBy("prefix", "first_seen").agg(
        F.count(F.lit(1)).alias("updates"), F.count_distinct("peer_asn").alias("peers"), F.array_sort(F.collect_set("collector")).alias("collectors"), F.expr("mode() within group (order by origin_asn)").alias("origin_asn")
    )
    many = series.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_windows)
    held = robust_z(series.join(many, "prefix", "left_semi"), ["prefix"], "updates").where((F.col("z") >= threshold) & (F.col("updates") >= min_updates))
    held = held.withColumn("last_seen", F.col("first_seen") + F.expr(f"interval {windows.WINDOWS[window]}"))
    score = F.least(F.lit(0.75), 0.25 + F.col("z") / 40)
    return held.select(*_event("churn_spike", score, F.array_compact(F.array("origin_asn")), F.col("peers"), updates=F.col("updates"), baseline=F.col("median"), z=F.round("z", 2)))


def visibility_drops(rib: DataFrame, active: DataFrame, drop: float = 0.4, min_collectors: int = 2, min_baseline: float = 0.3) -> DataFrame:
    """Snapshots in which far fewer vantage points than usual see a prefix. ``active``: elements, for the collectors that report."""
    held = rib.join(active.select("collector").distinct(), "collector", "left_semi")
    totals = held.groupBy("snapshot_ts", "collector").agg(F.count_distinct("peer_asn").alias("n")).groupBy("snapshot_ts").agg(F.sum("n").alias("peers_total"), F.count(F.lit(1)).alias("active"))
    expected = totals.agg(F.max("active").alias("expected"))
    totals = totals.join(F.broadcast(expected)).where("active = expected")
    seen = held.groupBy("snapshot_ts", "prefix").agg(
        F.count_distinct("collector", "peer_asn").alias("peers"), F.array_sort(F.collect_set("collector")).alias("collectors"), F.expr("mode() within group (order by origin_asn)").alias("origin_asn")
    )
    rows = seen.join(totals, "snapshot_ts").withColumn("ratio", F.col("peers") / F.col("peers_total"))
    base = rows.groupBy("prefix").agg(F.median("ratio").alias("baseline"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= 3) & (F.col("baseline") >= min_baseline))
    alert = rows.join(base, "prefix").where((F.col("ratio") < F.col("baseline") * (1 - drop)) & (F.size("collectors") >= min_collectors))
    alert = alert.withColumn("first_seen", F.col("snapshot_ts")).withColumn("last_seen", F.col("snapshot_ts") + F.expr("interval 8 hours"))
    lost = 1 - F.col("ratio") / F.col("baseline")
    sure = F.when(F.size("collectors") >= min_collectors, "medium").otherwise("low")
    return alert.select(*_event("visibility_drop", F.least(F.lit(0.7), 0.3 + 0.5 * lost), F.array_compact(F.array("origin_asn")), F.col("peers"), sure, ratio=F.round("ratio", 4), baseline=F.round("baseline", 4)))


def unroutable(elements: DataFrame) -> DataFrame:
    held = origin.bogons(announced(elements)).where("is_bogon or is_reserved_asn")
    return held.select(*_event("bogon", F.lit(0.5), F.array("origin_asn"), F.col("peers"), is_bogon=F.col("is_bogon"), is_reserved_asn=F.col("is_reserved_asn")))


#: Share of a country's AS numbers that must be observed for high confidence.
LOW_COVERAGE = 0.3


def finish(candidates: DataFrame, asns: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Events: severity, country of the first known AS, deterministic id.

    ``coverage`` (country_iso2, coverage_ratio): high confidence falls to medium in countries of which little is observed.
    """
    candidates, known = keep(candidates), merged(asns.select("asn", "country_iso2", "is_african"))
    keyed = candidates.withColumn(
        "event_id",
        ids.uuid5(NAMESPACE, F.concat_ws("|", "detector", F.coalesce("prefix", F.lit("-")), F.array_join(F.transform(F.array_sort("asns"), lambda x: x.cast("string")), ","), F.col("first_seen").cast("string"))),
    )
    each = keyed.select("event_id", F.posexplode("asns").alias("i", "asn")).join(known, "asn")
    found = each.groupBy("event_id").agg(F.min_by("country_iso2", "i").alias("country_iso2"), F.bool_or("is_african").alias("african"))
    out = keyed.join(merged(found), "event_id", "left").withColumn("severity", severity(F.col("score"))).withColumn("african", F.coalesce("african", F.lit(False)))
    if coverage is None:
        return out
    few = coverage.where(F.col("coverage_ratio") < LOW_COVERAGE).select("country_iso2", F.lit(True).alias("_few"))
    out = out.join(few, "country_iso2", "left")
    low = (F.col("confidence") == "high") & F.col("_few").isNotNull()
    return out.withColumn("confidence", F.when(low, "medium").otherwise(F.col("confidence"))).drop("_few")


def confirm(events: DataFrame, signals: DataFrame) -> DataFrame:
    """Add dataplane from signals (event_id, ok boolean): confirmed, contradicted or inconclusive; contradicted critical events are watched."""
    votes = signals.groupBy("event_id").agg(F.bool_or("ok").alias("any_true"), F.count_if(F.col("ok").isNull()).alias("unknown"), F.count("ok").alias("known"))
    met = events.join(votes, "event_id", "left")
    verdict = F.when(F.col("any_true"), "confirmed").when((F.col("known") > 0) & (F.col("unknown") == 0), "contradicted").otherwise("inconclusive")
    met = met.withColumn("dataplane", F.when(F.col("severity") != "info", verdict))
    return met.withColumn("severity", F.when((F.col("dataplane") == "contradicted") & (F.col("severity") == "critical"), "watch").otherwise(F.col("severity"))).drop("any_true", "unknown", "known")
