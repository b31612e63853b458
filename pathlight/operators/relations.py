"""AS relationships: both orientations, paths classified link by link, siblings and corroboration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pathlight.functions import paths
from pathlight.session import merged


def oriented(relations: DataFrame) -> DataFrame:
    """(a, b, relation) both ways: down where a provides b, up where b provides a, peer."""
    kind = F.when(F.col("relationship") == "p2p", "peer")
    one = relations.select(F.col("as_a").alias("a"), F.col("as_b").alias("b"), F.coalesce(kind, F.lit("down")).alias("relation"))
    other = relations.select(F.col("as_b").alias("a"), F.col("as_a").alias("b"), F.coalesce(kind, F.lit("up")).alias("relation"))
    return one.unionAll(other).groupBy("a", "b").agg(F.max("relation").alias("relation"))


def classify_paths(rows: DataFrame, relations: DataFrame) -> DataFrame:
    """(path, relations array<string>) of the distinct paths: relation of each link, null where unknown."""
    held = rows.select("path").distinct().where(F.size("path") >= 2)
    each = held.select("path", F.posexplode(paths.links(F.col("path"))).alias("i", "link")).select("path", "i", F.col("link.a").alias("a"), F.col("link.b").alias("b"))
    met = each.join(merged(oriented(relations)), ["a", "b"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("i", "relation")))
    return met.groupBy("path").agg(F.transform(ordered, lambda x: x["relation"]).alias("relations"))


def valley_free(rows: DataFrame, relations: DataFrame) -> DataFrame:
    """(path, relations, violation): index of the offending link, null where the path conforms."""
    return classify_paths(rows, relations).withColumn("violation", paths.valley_free_violation(F.col("relations")))


def providers(relations: DataFrame) -> DataFrame:
    """(asn, provider)."""
    return relations.where("relationship <> 'p2p'").select(F.col("as_b").alias("asn"), F.col("as_a").alias("provider"))


def siblings(orgs: DataFrame) -> DataFrame:
    """(asn, sibling): AS numbers of the same organisation."""
    one, other = orgs.select("asn", "org_id"), orgs.select(F.col("asn").alias("sibling"), "org_id")
    return one.join(other, "org_id").where("asn <> sibling").select("asn", "sibling")


def sources(links: DataFrame, evidence: DataFrame, known: DataFrame) -> DataFrame:
    """Add sources and confidence to rows (a, b): corroborating sources of a link, caida alone if it is only known."""
    both = evidence.select(F.col("as_a").alias("a"), F.col("as_b").alias("b"), "sources").unionAll(evidence.select(F.col("as_b").alias("a"), F.col("as_a").alias("b"), "sources"))
    met = links.join(merged(both), ["a", "b"], "left").join(merged(oriented(known)), ["a", "b"], "left")
    own: Column = F.coalesce("sources", F.when(F.col("relation").isNotNull(), F.array(F.lit("caida"))).otherwise(F.array().cast("array<string>")))
    return met.withColumn("sources", own).withColumn("confidence", F.when(F.size("sources") >= 2, "high").otherwise("medium")).drop("relation")


def evidence(relations: DataFrame, presence: DataFrame, as_sets: DataFrame) -> DataFrame:
    """Corroborated relations: shared exchange points for peers, membership in the provider's set for customers.

    ``presence``: (asn, ix_id); ``as_sets``: (asn, member). Presence is joined by exchange, not by pairs of
    all members: only known relations are looked up.
    """
    p2p = relations.where("relationship = 'p2p'")
    a, b = presence.select(F.col("asn").alias("as_a"), "ix_id"), presence.select(F.col("asn").alias("as_b"), "ix_id")
    met = p2p.join(a, "as_a").join(b, ["as_b", "ix_id"]).select("as_a", "as_b").distinct().withColumn("ix", F.lit("peeringdb"))
    sets = as_sets.select(F.col("asn").alias("as_a"), F.col("member").alias("as_b")).distinct().withColumn("irr", F.lit("irr"))
    out = relations.join(met, ["as_a", "as_b"], "left").join(sets, ["as_a", "as_b"], "left")
    return out.select("as_a", "as_b", "relationship", F.array_compact(F.array(F.lit("caida"), "ix", "irr")).alias("sources"))
