"""Connected components by alternating large-star and small-star steps.

Only DataFrame aggregations and joins over the link table; each round ends in a checkpoint, so a lost
executor repeats one round at most. The links of a node are dealt over ``SALTS`` parts: its least
neighbour is found within each part and then among the parts, and meets the links part by part, so that
the centre of a star of any size isn't one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .lineage import cut


SALTS = 64


def with_least(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Add ``name``, the least ``value`` of all rows with the same ``key``; a key with very many rows is spread."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c != key]), F.lit(SALTS)).cast("int"))
    parts = rows.groupBy(key, "_part").agg(F.min(value).alias(name))
    parts = parts.withColumn(name, F.min(name).over(Window.partitionBy(key)))  # SALTS rows of a key at most
    return rows.join(parts, [key, "_part"]).drop("_part")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = with_least(both, "a", "b", "m").where("b > a")
    return met.select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    met = with_least(down, "a", "b", "m")
    moved = F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a"))
    return met.select(moved.alias("a"), F.col("m").alias("b")).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Return (node, label) of every node that has a link; the label is the component's least node.

    ``links``: (a bigint, b bigint), in any direction, repeated or not; links with a null and links of
    a node to itself are ignored. An empty table gives an empty one.
    """
    links = cut(links.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    state = _state(links)
    for _ in range(max_rounds):
        if not state[0]:
            break
        links = cut(_small_star(_large_star(links)))
        before, state = state, _state(links)
        if before == state:
            break
    else:
        raise RuntimeError("the components did not settle")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
