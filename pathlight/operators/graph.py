"""Propagation of a prefix: weighted path graph, its depths, changes of its paths, upstreams over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathlight.functions import paths, windows
from pathlight.session import cut

from . import relations as rel


def path_weights(elements: DataFrame, prefix: str, targets: Column | None = None) -> DataFrame:
    """(path, n): paths of the prefix turned from origin to peer, cut at the first target, with their observations."""
    rows = elements.where((F.col("prefix") == prefix) & (F.size("path") > 0))
    turned = paths.orient(F.col("path"), F.array().cast("array<bigint>") if targets is None else targets)
    return rows.groupBy(turned.alias("path")).agg(F.count(F.lit(1)).alias("n"))


def edges(weights: DataFrame, relations: DataFrame) -> DataFrame:
    """(a, b, n, paths, relation) of the graph: edges from the origin outwards, relation of b towards a."""
    each = weights.select("n", "path", F.explode(F.array_distinct(paths.links(F.col("path")))).alias("l"))
    out = each.groupBy(F.col("l.a").alias("a"), F.col("l.b").alias("b")).agg(F.sum("n").alias("n"), F.count_distinct("path").alias("paths"))
    towards = rel.oriented(relations).select(F.col("a").alias("b"), F.col("b").alias("a"), "relation")
    return out.join(towards, ["a", "b"], "left")


def nodes(weights: DataFrame, max_paths: int = 3) -> DataFrame:
    """(asn, n, depth, sample, hidden): observations through each AS, its least distance from the origin, some of its paths and the number of others."""
    each = weights.select("n", "path", F.posexplode("path").alias("depth", "asn"))
    out = each.groupBy("asn").agg(F.sum("n").alias("n"), F.min("depth").alias("depth"))
    # Paths are ranked before they are collected, so that no AS has more than its sample in a row.
    own = each.select("asn", paths.path_text(F.col("path")).alias("text")).distinct()
    first = own.withColumn("k", F.row_number().over(Window.partitionBy("asn").orderBy("text"))).where(F.col("k") <= max_paths)
    sample = first.groupBy("asn").agg(F.array_sort(F.collect_list("text")).alias("sample"))
    many = own.groupBy("asn").agg(F.greatest(F.lit(0), F.count(F.lit(1)) - max_paths).cast("int").alias("hidden"))
    return out.join(sample, "asn").join(many, "asn").select("asn", "n", "depth", "sample", "hidden")


def depths(edge_rows: DataFrame, roots: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(node, depth): least number of edges (a, b) from the ``roots`` (node) to each node that can be reached.

    Level by level: the newly reached nodes are joined with the edges, and what was reached before goes. Cycles end
    by themselves. Each level is materialised; nothing is collected.
    """
    out_of = cut(edge_rows.select("a", "b").distinct())
    level = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    reached = level
    for depth in range(1, max_depth + 1):
        found = out_of.join(level.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        level = cut(found.join(reached, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached


def ranked_paths(weights: DataFrame, limit: int = 500) -> DataFrame:
    return weights.orderBy(F.desc("n"), "path").limit(limit)


def fold(edge_rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Merge nodes by group (asn, node): parallel edges are added up, edges inside a group go."""
    a, b = groups.select(F.col("asn").alias("a"), F.col("node").alias("na")), groups.select(F.col("asn").alias("b"), F.col("node").alias("nb"))
    met = edge_rows.join(a, "a", "left").join(b, "b", "left")
    named = met.select(F.coalesce("na", F.col("a").cast("string")).alias("a"), F.coalesce("nb", F.col("b").cast("string")).alias("b"), "n")
    return named.where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))


def through(weights: DataFrame, asn: int) -> DataFrame:
    """Edges of the paths that pass an AS."""
    held = weights.where(F.array_contains("path", F.lit(asn).cast("bigint")))
    each = held.select("n", F.explode(F.array_distinct(paths.links(F.col("path")))).alias("l"))
    return each.groupBy(F.col("l.a").alias("a"), F.col("l.b").alias("b")).agg(F.sum("n").alias("n"))


def frame_changes(frames: DataFrame) -> DataFrame:
    """(frame, path, change) against the frame before: added and removed paths."""
    order = frames.select("frame").distinct().withColumn("i", F.row_number().over(Window.orderBy("frame")))
    held = frames.join(F.broadcast(order), "frame").select("path", "i")
    added = held.join(held.withColumn("i", F.col("i") + 1), ["path", "i"], "left_anti").withColumn("change", F.lit("added"))
    gone = held.withColumn("i", F.col("i") + 1).join(held, ["path", "i"], "left_anti").withColumn("change", F.lit("removed"))
    return added.where("i > 1").unionByName(gone).join(F.broadcast(order), "i").select("frame", "path", "change")


def upstream_series(elements: DataFrame, prefix: str, hours: int, origin: int | None = None, kinds: tuple[str, ...] = ("A", "R")) -> DataFrame:
    """(bucket, upstream_asn, peers): distinct vantage points by bucket and upstream, zero where there are none."""
    rows = elements.where((F.col("prefix") == prefix) & F.col("elem_type").isin(*kinds))
    if origin is not None:
        rows = rows.where(F.element_at("path", -1) == origin)
    rows = rows.withColumn("upstream_asn", paths.upstream(F.col("path"))).where("upstream_asn is not null")
    each = rows.groupBy(windows.bucket(F.col("ts"), hours).alias("bucket"), "upstream_asn").agg(F.count_distinct(F.struct("collector", "peer_ip")).alias("peers"))
    return windows.fill_gaps(each, "bucket", f"{hours} hours", ["upstream_asn"], ["peers"])


def upstream_ranking(series: DataFrame) -> DataFrame:
    """(upstream_asn, peak, peak_at, buckets, rank): upstreams of a series by the most peers that a bucket has."""
    seen = series.where("peers > 0").groupBy("upstream_asn").agg(F.max("peers").alias("peak"), F.max_by("bucket", F.struct("peers", -F.unix_micros(F.col("bucket").cast("timestamp")))).alias("peak_at"), F.count(F.lit(1)).alias("buckets"))
    # Upstreams of one prefix.
    return seen.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("peak"), "upstream_asn")))
