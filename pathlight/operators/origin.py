"""Route origin validation and anycast, over the prefix-containment join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pathlight.functions import paths, prefixes
from pathlight.session import keep, merged

#: Tasks at most that meet the elements of one prefix and origin before these are reduced to distinct paths.
SHARES = 32


def _covering(pairs: DataFrame, reference: DataFrame, condition: Column) -> DataFrame:
    """(prefix, origin_asn, covered, matched) of each pair; a pair without covering row has covered null."""
    cover = prefixes.containment_join(pairs, reference).select("prefix", "own", "len", "asn", *(c for c in ("max_len",) if c in reference.columns))
    met = pairs.select("prefix", "origin_asn").distinct().join(merged(cover), "prefix", "left")
    return met.groupBy("prefix", "origin_asn").agg(F.bool_or(F.col("asn").isNotNull()).alias("covered"), F.bool_or(F.coalesce(condition, F.lit(False))).alias("matched"))


def _back(pairs: DataFrame, found: DataFrame, status: Column, name: str) -> DataFrame:
    found = found.select("prefix", F.coalesce("origin_asn", F.lit(-1)).alias("_o"), status.alias(name))
    out = pairs.withColumn("_o", F.coalesce("origin_asn", F.lit(-1))).join(merged(found), ["prefix", "_o"], "left").drop("_o")
    return out


def validate_rpki(pairs: DataFrame, roas: DataFrame) -> DataFrame:
    """Add rpki_status to rows with prefix and origin_asn: valid, invalid or not-found."""
    found = _covering(pairs, roas, (F.col("asn") == F.col("origin_asn")) & (F.col("own") <= F.col("max_len")))
    status = F.when(~F.col("covered") | F.col("origin_asn").isNull(), "not-found").when(F.col("matched"), "valid").otherwise("invalid")
    return _back(pairs, found, status, "rpki_status")


def validate_irr(pairs: DataFrame, routes: DataFrame) -> DataFrame:
    """Add irr_status: consistent if a covering route has the same AS, inconsistent if none has, absent without one."""
    found = _covering(pairs, routes, F.col("asn") == F.col("origin_asn"))
    status = F.when(~F.col("covered") | F.col("origin_asn").isNull(), "absent").when(F.col("matched"), "consistent").otherwise("inconsistent")
    return _back(pairs, found, status, "irr_status")


def validate(pairs: DataFrame, roas: DataFrame, routes: DataFrame) -> DataFrame:
    """Add rpki_status and irr_status by one containment join against both references."""
    tagged = roas.select("prefix", "asn", "max_len", F.lit(True).alias("roa")).unionByName(routes.select("prefix", "asn", F.lit(None).cast("int").alias("max_len"), F.lit(False).alias("roa")))
    cover = prefixes.containment_join(pairs, tagged).select("prefix", "own", "asn", "max_len", "roa")
    met = pairs.select("prefix", "origin_asn").distinct().join(merged(cover), "prefix", "left")
    same = F.coalesce(F.col("asn") == F.col("origin_asn"), F.lit(False))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    found = met.groupBy("prefix", "origin_asn").agg(
        any_of(F.col("roa")).alias("roa"), any_of(F.col("roa") & same & (F.col("own") <= F.col("max_len"))).alias("valid"), any_of(~F.col("roa")).alias("route"), any_of(~F.col("roa") & same).alias("consistent")
    )
    unknown = F.col("origin_asn").isNull()
    rpki = F.when(~F.col("roa") | unknown, "not-found").when(F.col("valid"), "valid").otherwise("invalid")
    irr = F.when(~F.col("route") | unknown, "absent").when(F.col("consistent"), "consistent").otherwise("inconsistent")
    found = found.select("prefix", F.coalesce("origin_asn", F.lit(-1)).alias("_o"), rpki.alias("rpki_status"), irr.alias("irr_status"))
    return pairs.withColumn("_o", F.coalesce("origin_asn", F.lit(-1))).join(merged(found), ["prefix", "_o"], "left").drop("_o")


def authorised_asns(pairs: DataFrame, roas: DataFrame) -> DataFrame:
    """(prefix, authorised array<bigint>): every AS of a covering authorisation."""
    return prefixes.containment_join(pairs, roas).groupBy("prefix").agg(F.array_sort(F.collect_set("asn")).alias("authorised"))


def known_anycast(pairs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Distinct prefixes that an entry of the catalogue covers."""
    return prefixes.containment_join(pairs, catalogue).select("prefix").distinct()


def divergent(pairs: DataFrame, elements: DataFrame, ceiling: float) -> DataFrame:
    """Those of ``pairs`` (prefix, incumbent, origin_asn) with paths of both origins, no two of which are more similar than ``ceiling``.

    Similarity is that of ``paths.jaccard``, ``ceiling`` 0 at least. All paths count, but only those are compared that may be
    similar: sets of n and m hops that exceed the ceiling share some least number of hops, so if each is put in order from
    its prefix's rarest hop, one of the first n - least + 1 is among the other's first m - least + 1.
    """
    pairs = keep(pairs.select("prefix", "incumbent", "origin_asn"))
    asked = pairs.select("prefix", "origin_asn").union(pairs.select("prefix", "incumbent")).distinct()
    asked = asked.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    own = elements.withColumn("_share", F.pmod(F.xxhash64("ts", "peer_asn"), F.lit(SHARES)).cast("int")).join(merged(asked), ["prefix", "origin_asn", "_share"], "left_semi").where("path is not null")
    sets = keep(own.select("prefix", "origin_asn", paths.hops(F.col("path")).alias("hops")).distinct())
    each = sets.withColumn("hop", F.explode("hops"))
    often = each.groupBy("prefix", "hop").agg(F.count(F.lit(1)).alias("sets"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sets", "hop"))), lambda x: x["hop"])
    held = each.join(merged(often), ["prefix", "hop"]).groupBy("prefix", "origin_asn", "hops").agg(ordered.alias("ordered"))
    sizes = sets.where("size(hops) > 0").agg(F.collect_set(F.size("hops")).alias("sizes"))
    held = held.join(F.broadcast(sizes)).select("*", F.size("hops").alias("n"), F.explode("sizes").alias("m"))  # one row: the lengths of paths
    similarity = lambda shared: shared / (F.col("n") + F.col("m") - shared)
    least = F.get(F.filter(F.sequence(F.lit(1), F.least("n", "m")), lambda shared: similarity(shared) > ceiling), F.lit(0))
    held = held.withColumn("least", least).where("least is not null")
    held = held.select("prefix", "origin_asn", "hops", "n", "m", F.explode(F.slice("ordered", F.lit(1), F.col("n") - F.col("least") + 1)).alias("hop"))
    others = held.select(*[F.col(c).alias(f"_{c}") for c in ("prefix", "origin_asn", "hops", "n", "m", "hop")])
    same = (F.col("prefix") == F.col("_prefix")) & (F.col("incumbent") == F.col("_origin_asn")) & (F.col("n") == F.col("_m")) & (F.col("m") == F.col("_n")) & (F.col("hop") == F.col("_hop"))
    above = similarity(F.size(F.array_intersect("hops", "_hops"))) > ceiling
    alike = held.join(merged(pairs), ["prefix", "origin_asn"]).join(merged(others), same & above, "left_semi").select("prefix", "incumbent", "origin_asn").distinct()
    seen = merged(sets.select("prefix", "origin_asn").distinct())
    both = pairs.join(seen, ["prefix", "origin_asn"], "left_semi").join(seen.withColumnRenamed("origin_asn", "incumbent"), ["prefix", "incumbent"], "left_semi")
    return both.join(merged(alike), ["prefix", "incumbent", "origin_asn"], "left_anti")


def bogons(elements: DataFrame) -> DataFrame:
    """Add is_bogon (unroutable space, or text that is no prefix) and is_reserved_asn."""
    held = elements.select("prefix").distinct()
    bad = prefixes.containment_join(held, prefixes.bogon_table(elements.sparkSession)).select("prefix").distinct().withColumn("_bogon", F.lit(True))
    out = elements.join(bad, "prefix", "left")
    return out.withColumn("is_bogon", F.coalesce("_bogon", ~prefixes.is_valid(F.col("prefix")))).withColumn("is_reserved_asn", prefixes.reserved_asn(F.col("origin_asn"))).drop("_bogon")
