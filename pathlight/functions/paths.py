"""AS-path expressions over array<bigint> columns; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def has_as_set(text: Column) -> Column:
    """Whether the path text holds a set (braces or brackets)."""
    return F.coalesce(text.rlike(r"[{\[]"), F.lit(False))


def parse_path(text: Column) -> Column:
    """Path text to ASNs: set members are kept in order, ``a.b`` notation is a * 65536 + b, other tokens go."""
    tokens = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[{}\[\](),\s]+", " "), " ")
    number = lambda x: F.when(
        x.contains("."), F.substring_index(x, ".", 1).cast("bigint") * 65536 + F.substring_index(x, ".", -1).cast("bigint")
    ).otherwise(x.cast("bigint"))
    return F.transform(F.filter(tokens, lambda x: x.rlike(r"^[0-9]+(\.[0-9]+)?$")), number)


def drop_prepends(path: Column) -> Column:
    """Remove consecutive repetitions."""
    return F.filter(path, lambda x, i: (i == 0) | (x != F.get(path, i - 1)))


def origin(path: Column) -> Column:
    return F.try_element_at(path, F.lit(-1))


def upstream(path: Column) -> Column:
    """The AS before the origin; null for shorter paths."""
    return F.try_element_at(path, F.lit(-2))


def path_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda x: x.cast("string")), " ")


def orient(path: Column, targets: Column) -> Column:
    """From the origin towards the peer, up to the first target AS (the whole path if none is met)."""
    turned = F.reverse(path)
    at = F.array_position(F.transform(turned, lambda x: F.array_contains(targets, x)), True)
    return F.when(at > 0, F.slice(turned, 1, at.cast("int"))).otherwise(turned)


def links(path: Column) -> Column:
    """Consecutive pairs as array<struct<a, b>>."""
    n = F.size(path)
    pairs = F.zip_with(F.slice(path, 1, F.greatest(n - 1, F.lit(0))), F.slice(path, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<struct<a: bigint, b: bigint>>"))


def _cut(path: Column) -> Column:
    """The path without its origin."""
    return F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))


def hops(path: Column) -> Column:
    """The AS numbers before the origin as a set: each once, ascending; null of a null path."""
    return F.array_sort(F.array_distinct(_cut(path)))


def jaccard(one: Column, other: Column) -> Column:
    """Similarity of two paths without their origins; 0 where both are empty then."""
    union = F.size(F.array_union(_cut(one), _cut(other)))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(_cut(one), _cut(other))) / union)


def valley_free_violation(relations: Column) -> Column:
    """Index of the first link that breaks up -> peer -> down; null if none, or if fewer than two links are known.

    ``relations``: array<string> along the path from the collector to the origin reversed, i.e. in the
    direction the route travelled: ``up``, ``peer``, ``down`` or null for unknown links.
    """
    start = F.struct(F.lit(0).alias("phase"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("at"), F.lit(0).alias("known"))

    def step(s: Column, r: Column) -> Column:
        rank = F.when(r == "up", 0).when(r == "peer", 1).when(r == "down", 2)
        breaks = rank.isNotNull() & (((rank == 0) & (s["phase"] > 0)) | ((rank == 1) & (s["phase"] >= 1)))
        return F.struct(
            F.when(rank.isNull(), s["phase"]).otherwise(F.greatest(s["phase"], F.when(rank == 1, 1).when(rank == 2, 2).otherwise(0))).alias("phase"),
            F.coalesce(s["bad"], F.when(breaks, s["at"])).alias("bad"),
            (s["at"] + 1).alias("at"),
            (s["known"] + F.when(rank.isNull(), 0).otherwise(1)).alias("known"),
        )

    return F.aggregate(relations, start, step, lambda s: F.when(s["known"] >= 2, s["bad"]))
