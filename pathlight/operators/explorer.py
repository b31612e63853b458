"""Read queries over elements, daily summaries, metrics and events: one function, one lazy DataFrame.

Lists and tables of prefixes, AS numbers and neighbours read daily tables, stored or computed
(``store.Store.table``); both give the same rows.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from pathlight.functions import paths, windows
from pathlight.session import merged

from . import metrics, origin, relations as rel


def day_range(rows: DataFrame, first: date | None, last: date | None, ts: str = "ts") -> DataFrame:
    """Rows of whole days from ``first`` to ``last``, both included."""
    if first is not None:
        rows = rows.where(F.col(ts) >= F.lit(first.isoformat()).cast("timestamp_ntz"))
    if last is not None:
        rows = rows.where(F.col(ts) < F.lit((last + timedelta(days=1)).isoformat()).cast("timestamp_ntz"))
    return rows


def _with_presence(rows: DataFrame, keys: list[str], calendar: DataFrame) -> DataFrame:
    """(keys, first_day, last_day, n_days, status) of rows with a column day."""
    days = calendar.select("day").distinct().agg(F.array_sort(F.collect_list("day")).alias("days"))  # one row
    seen = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("day")).alias("seen"))
    out = seen.join(F.broadcast(days))
    return out.select(*keys, F.array_min("seen").alias("first_day"), F.array_max("seen").alias("last_day"), F.size("seen").alias("n_days"), windows.presence(F.col("seen"), F.col("days")).alias("status"))


def _page(rows: DataFrame, order: list, limit: int, offset: int, total: bool) -> DataFrame:
    """One page of at most 500 rows; with ``total``, each has the number of all rows."""
    page = rows.orderBy(*order).offset(offset).limit(min(limit, 500))
    return page.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))) if total else page  # one row


def of_family(rows: DataFrame, ip_version: int | None) -> DataFrame:
    """Rows of one address family, of both where it is None."""
    return rows if ip_version is None else rows.where(F.col("ip_version") == ip_version)


def asn_list(
    daily: DataFrame, asns: DataFrame, limit: int = 25, offset: int = 0, country: str | None = None, african_only: bool = False, text: str | None = None, total: bool = False
) -> DataFrame:
    """Origins with their prefixes and updates, most updates first; ``text`` may stand anywhere in the number.

    ``daily``: the daily table of prefixes and origins.
    """
    rows, known = daily.where("origin_asn is not null"), asns.select("asn", "country_iso2", "is_african")
    if text is not None:
        rows = rows.where(F.contains(F.col("origin_asn").cast("string"), F.lit(text)))
    each = rows.groupBy(F.col("origin_asn").alias("asn")).agg(F.count_distinct("prefix").alias("prefixes"), F.sum(F.col("announcements") + F.col("withdrawals") + F.col("rib_rows")).alias("updates"))
    if country is not None:
        known = known.where(F.col("country_iso2") == country)
    if african_only:
        known = known.where("is_african")
    out = each.join(known, "asn", "left" if country is None and not african_only else "inner").withColumn("is_african", F.coalesce("is_african", F.lit(False)))
    return _page(out, [F.desc("updates"), "asn"], limit, offset, total)


def asn_details(page: DataFrame, upstreams: DataFrame, events: DataFrame) -> DataFrame:
    """A page of AS numbers with their transit and their number of events.

    The main upstream is that of the window with the most observations, the later of equals. An AS without transit
    has nulls, one without events zero.
    """
    held = upstreams.withColumnRenamed("origin_asn", "asn").join(F.broadcast(page.select("asn")), "asn", "left_semi")  # at most 500 rows
    transit = held.groupBy("asn").agg(
        F.max("upstream_count").alias("upstream_count"), F.max_by("primary_upstream", F.struct("observations", "window_start")).alias("primary_upstream"), F.avg("hhi_transit").alias("hhi_transit")
    )
    open_events = events.select(F.explode(F.array_distinct("asns")).alias("asn")).groupBy("asn").agg(F.count(F.lit(1)).alias("open_events"))
    return page.join(transit, "asn", "left").join(open_events, "asn", "left").fillna(0, ["open_events"]).orderBy(F.desc("updates"), "asn")


def prefix_list(daily: DataFrame, limit: int = 25, offset: int = 0, text: str | None = None, origin_asn: int | None = None, ip_version: int | None = None, least_updates: int = 1, total: bool = False) -> DataFrame:
    """Prefixes by updates, with the origin seen most (the smallest of several) and the number of origins; ``text``
    begins the prefix. Prefixes with fewer updates than asked are left out once they are counted.

    ``daily``: the daily table of prefixes and origins, in detail.
    """
    held = of_family(daily, ip_version).where("announcements + withdrawals > 0")
    if text is not None:
        held = held.where(F.startswith("prefix", F.lit(text)))
    if origin_asn is not None:
        held = held.where(F.col("origin_asn") == origin_asn)
    each = held.groupBy("prefix", "origin_asn").agg(F.sum(F.col("announcements") + F.col("withdrawals")).alias("n"), F.max("last_update").alias("at"))
    main = F.max_by(F.when(F.col("origin_asn").isNotNull(), F.col("origin_asn")), F.when(F.col("origin_asn").isNotNull(), F.struct("n", -F.col("origin_asn"))))
    rows = each.groupBy("prefix").agg(F.sum("n").alias("updates"), main.alias("origin_asn"), F.count("origin_asn").alias("origins"), F.max("at").alias("last_seen")).where(F.col("updates") >= least_updates)
    return _page(rows, [F.desc("updates"), "prefix"], limit, offset, total)


def prefix_details(page: DataFrame, visibility: DataFrame) -> DataFrame:
    """A page of prefixes with their mean visibility, null where no snapshot has them."""
    held = visibility.join(F.broadcast(page.select("prefix")), "prefix", "left_semi")  # at most 500 rows
    return page.join(held.groupBy("prefix").agg(F.avg("visibility_ratio").alias("visibility")), "prefix", "left").orderBy(F.desc("updates"), "prefix")


def countries(country_metrics: DataFrame, rpki: DataFrame) -> DataFrame:
    """Means of the countries' indicators over all windows, with the share of announced prefixes that are valid."""
    rows = country_metrics.groupBy("country_iso2").agg(
        F.avg("transit_dependency_ratio").alias("transit_dependency_ratio"), F.avg("avg_hhi").alias("hhi_transit"), F.avg("avg_upstreams").alias("avg_upstreams"),
        F.max("asns").alias("asns"), F.avg("visibility").alias("visibility"), F.avg("coverage_ratio").alias("coverage_ratio"),
    )
    return rows.join(rpki.select("country_iso2", F.col("valid_ratio").alias("rpki_coverage_ratio")), "country_iso2", "left")


def prefix_card(elements: DataFrame, prefix: str) -> DataFrame:
    """Origins of one prefix with announcements, peers and the paths seen most."""
    rows = elements.where((F.col("prefix") == prefix) & F.col("origin_asn").isNotNull()).withColumn("text", paths.path_text(F.col("path")))
    each = rows.groupBy("origin_asn", "text").agg(F.count(F.lit(1)).alias("n"))
    top = each.groupBy("origin_asn").agg(F.max_by("text", F.struct("n", "text")).alias("main_path"), F.count(F.lit(1)).alias("paths"))
    who = rows.groupBy("origin_asn").agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("peer_asn").alias("peers"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return who.join(top, "origin_asn")


def prefix_paths(elements: DataFrame, prefix: str, limit: int = 15) -> DataFrame:
    rows = elements.where((F.col("prefix") == prefix) & (F.size("path") > 0))
    return rows.groupBy(paths.path_text(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").limit(limit)


def search(asns: DataFrame, prefixes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Hits on AS numbers, prefixes and countries that begin with the text."""
    one = asns.select(F.lit("asn").alias("kind"), F.col("asn").cast("string").alias("value"))
    two = prefixes.select(F.lit("prefix").alias("kind"), F.col("prefix").alias("value")).distinct()
    three = asns.select(F.lit("country").alias("kind"), F.col("country_iso2").alias("value")).distinct()
    return one.unionByName(two).unionByName(three).where(F.startswith("value", F.lit(text))).orderBy("kind", "value").limit(limit)


def prefix_series(daily: DataFrame, origins: DataFrame, ip_version: int | None = None) -> DataFrame:
    """Distinct prefixes by day of the given origins (asn), from the daily table."""
    own = of_family(daily, ip_version).where("announcements + rib_rows > 0").join(origins.select(F.col("asn").alias("origin_asn")), "origin_asn", "left_semi")
    return own.groupBy("day").agg(F.count_distinct("prefix").alias("prefixes"))


def prefix_table(daily: DataFrame, origins: DataFrame, roas: DataFrame, routes: DataFrame, ip_version: int | None = None) -> DataFrame:
    """Prefixes of the given origins with presence and validity."""
    own = of_family(daily, ip_version).where("announcements + rib_rows > 0").join(origins.select(F.col("asn").alias("origin_asn")), "origin_asn", "left_semi")
    return origin.validate(_with_presence(own, ["prefix", "origin_asn"], daily), roas, routes)


def facets(table: DataFrame, *columns: str) -> DataFrame:
    """(facet, value, n) of several columns in one aggregation."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return table.select(F.explode(pairs).alias("x")).groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))


def _neighbours(adjacency: DataFrame, members: DataFrame, relations: DataFrame) -> DataFrame:
    held = adjacency.join(members.select("asn"), "asn", "left_semi")
    # Relations grow with the registry; those of the members are taken before they are joined.
    kinds = rel.oriented(relations).select(F.col("a").alias("asn"), F.col("b").alias("neighbour"), "relation").join(members.select("asn"), "asn", "left_semi")
    named = F.when(F.col("relation") == "up", "provider").when(F.col("relation") == "down", "customer").when(F.col("relation") == "peer", "peer").otherwise("unknown")
    return held.join(merged(kinds), ["asn", "neighbour"], "left").withColumn("kind", named).drop("relation")


def neighbour_table(adjacency: DataFrame, members: DataFrame, relations: DataFrame, asns: DataFrame, ip_version: int | None = None) -> DataFrame:
    """Neighbours of the members with their kind, families, presence and country."""
    rows = _neighbours(of_family(adjacency, ip_version), members, relations)
    flags = rows.groupBy("asn", "neighbour").agg(F.max("kind").alias("kind"), F.bool_or(F.col("ip_version") == 4).alias("v4"), F.bool_or(F.col("ip_version") == 6).alias("v6"))
    held = _with_presence(rows, ["asn", "neighbour"], adjacency)
    return flags.join(held, ["asn", "neighbour"]).join(asns.select(F.col("asn").alias("neighbour"), "country_iso2"), "neighbour", "left")


def neighbour_series(adjacency: DataFrame, members: DataFrame, relations: DataFrame, ip_version: int | None = None) -> DataFrame:
    """Distinct (member, neighbour) pairs by day and kind, zero where there are none."""
    kinds = ["provider", "customer", "peer", "unknown"]
    rows = _neighbours(of_family(adjacency, ip_version), members, relations)
    return rows.groupBy("day").pivot("kind", kinds).agg(F.count_distinct(F.struct("asn", "neighbour"))).fillna(0, kinds)


def prefix_history(daily: DataFrame, asn: int, prefix: str) -> DataFrame:
    own = daily.where((F.col("origin_asn") == asn) & (F.col("prefix") == prefix) & (F.col("announcements") + F.col("rib_rows") > 0))
    return windows.islands(own, ["prefix", "origin_asn"], daily)


def neighbour_history(adjacency: DataFrame, asn: int, neighbour: int) -> DataFrame:
    own = adjacency.where((F.col("asn") == asn) & (F.col("neighbour") == neighbour))
    return windows.islands(own, ["ip_version"], adjacency)


def country_relationships(relations: DataFrame, asns: DataFrame, country: str) -> DataFrame:
    """External relations of a country: (relation, asn, local_asns)."""
    local = asns.where(F.col("country_iso2") == country).select("asn")
    rows = rel.oriented(relations).join(local.withColumnRenamed("asn", "a"), "a", "left_semi").join(local.withColumnRenamed("asn", "b"), "b", "left_anti")
    return rows.groupBy("relation", F.col("b").alias("asn")).agg(F.array_sort(F.collect_set("a")).alias("local_asns"))


def record_history(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Dated reference rows grouped by key: presence over the snapshots, and whether the last one has them."""
    held = _with_presence(snapshots.withColumn("day", F.col("snapshot_date")), keys, snapshots.select(F.col("snapshot_date").alias("day")))
    last = snapshots.agg(F.max("snapshot_date").alias("last"))
    return held.join(F.broadcast(last)).withColumn("active", F.col("last_day") == F.col("last")).drop("last")


def event_list(
    events: DataFrame, detectors: list[str] | None = None, severities: list[str] | None = None, country: str | None = None, asn: int | None = None, prefix: str | None = None, min_score: float | None = None, first=None, last=None, order: str = "score"
) -> DataFrame:
    """Events under the given conditions, in one of the orders score, recent and oldest."""
    conditions: list[Column] = []
    if detectors:
        conditions.append(F.col("detector").isin(detectors))
    if severities:
        conditions.append(F.col("severity").isin(severities))
    if country is not None:
        conditions.append(F.col("country_iso2") == country)
    if asn is not None:
        conditions.append(F.array_contains("asns", F.lit(asn).cast("bigint")))
    if prefix is not None:
        conditions.append(F.col("prefix") == prefix)
    if min_score is not None:
        conditions.append(F.col("score") >= min_score)
    if first is not None:
        conditions.append(F.col("last_seen") >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        conditions.append(F.col("first_seen") <= F.lit(last).cast("timestamp_ntz"))
    for c in conditions:
        events = events.where(c)
    orders = {"score": [F.desc("score"), F.desc("last_seen"), "event_id"], "recent": [F.desc("last_seen"), "event_id"], "oldest": ["first_seen", "event_id"]}
    return events.orderBy(*orders[order])


def event_timeline(event: DataFrame, churn: DataFrame, visibility: DataFrame, hours: int = 24) -> DataFrame:
    """(kind, ts, value) of the event's prefix around the event. ``event``: one row."""
    span = event.select("prefix", (F.col("first_seen") - F.expr(f"interval {hours} hours")).alias("a"), (F.col("last_seen") + F.expr(f"interval {hours} hours")).alias("b"))
    one = churn.groupBy("prefix", F.col("window_start").alias("ts")).agg(F.sum("updates_total").cast("double").alias("value")).withColumn("kind", F.lit("churn"))
    two = visibility.select("prefix", F.col("snapshot_ts").alias("ts"), F.col("visibility_ratio").alias("value"), F.lit("visibility").alias("kind"))
    return one.unionByName(two).join(F.broadcast(span), "prefix").where("ts >= a and ts <= b").select("kind", "ts", "value")


def health(layers: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(layer, n_rows, first, last) of named (table, time column)."""
    out = None
    for name, (table, ts) in layers.items():
        row = table.agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first"), F.max(ts).alias("last")).withColumn("layer", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def overview(elements: DataFrame, days: int = 7) -> DataFrame:
    """Distinct prefixes and origins, and updates, in the trailing window that ends with the last element."""
    last = elements.agg(F.max("ts").alias("last"))
    rows = elements.join(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr(f"interval {days} days"))
    return rows.agg(F.count_distinct("prefix").alias("prefixes"), F.count_distinct("origin_asn").alias("asns"), F.count_if(F.col("elem_type") != "R").alias("updates"))


def overview_facts(elements: DataFrame, asns: DataFrame, visibility: DataFrame, events: DataFrame, days: int = 7, limit: int = 10) -> DataFrame:
    """(part, name, value) beside ``overview``: African countries, median visibility, events of the trailing window by
    severity and detector, and the prefixes with the most updates in it with their origins and withdrawals."""
    last = F.broadcast(elements.agg((F.max("ts") - F.expr(f"interval {days} days")).alias("since")))  # one row
    countries = asns.where("is_african").agg(F.count_distinct("country_iso2").cast("double").alias("value")).select(F.lit("countries").alias("part"), F.lit("").alias("name"), "value")
    median = visibility.agg(F.median("visibility_ratio").alias("value")).select(F.lit("median_visibility").alias("part"), F.lit("").alias("name"), "value")
    found = facets(events.join(last).where("first_seen >= since"), "severity", "detector").select(F.concat(F.lit("events_by_"), "facet").alias("part"), F.col("value").alias("name"), F.col("n").cast("double").alias("value"))
    rows = elements.join(last).where("ts >= since and elem_type <> 'R'").groupBy("prefix").agg(F.count(F.lit(1)).alias("updates"), F.count_distinct("origin_asn").alias("origins"), F.count_if(F.col("elem_type") == "W").alias("withdrawals"))
    top = rows.orderBy(F.desc("updates"), "prefix").limit(limit)
    parts = F.array(*[F.struct(F.lit(f"top_{c}").alias("part"), F.col("prefix").alias("name"), F.col(c).cast("double").alias("value")) for c in ("updates", "origins", "withdrawals")])
    return countries.unionByName(median).unionByName(found).unionByName(top.select(F.inline(parts)))


def collectors(configured: DataFrame, coverage: DataFrame) -> DataFrame:
    """Configured collectors (collector, role) with their ingested files and bytes."""
    held = coverage.groupBy("collector").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    return configured.join(held, "collector", "left").fillna(0, ["files", "bytes"])


def country_series(country_metrics: DataFrame, country: str) -> DataFrame:
    """Indicators of one country by window."""
    return country_metrics.where(F.col("country_iso2") == country).groupBy("window_start").agg(F.avg("avg_hhi").alias("avg_hhi"), F.max("asns").alias("asns"))


def incident_list(rows: DataFrame, severities: list[str] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Incidents by score, the earliest first among equals."""
    held = rows if not severities else rows.where(F.col("severity").isin(severities))
    return held.orderBy(F.desc("score"), "first_seen", "incident_id").offset(offset).limit(min(limit, 500))
