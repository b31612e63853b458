"""AS numbers of as-sets, which may hold other as-sets, also each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pathlight.session import cut

_NUMBER = r"^AS[0-9]+$"


def expand(roots: DataFrame, members: DataFrame, max_depth: int | None = 1) -> DataFrame:
    """(as_set, asn, depth) of the ``roots`` (as_set): numbers that they hold, and how deep the least one stands.

    ``members``: (as_set, member). Depth 1 is direct members alone; None goes on until nothing new is found. Each
    round joins only the sets that the round before reached first, for each root; a set that was reached before is not followed
    again, so cycles end. Rounds are materialised; unknown sets and other names have no members.
    """
    held = cut(members.select(F.upper(F.trim("as_set")).alias("inner"), F.upper(F.trim("member")).alias("member")).distinct())
    level = cut(roots.select(F.upper(F.trim("as_set")).alias("as_set")).where("as_set is not null").distinct().withColumn("inner", F.col("as_set")))
    reached, found, depth = level, None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        met = cut(level.join(held, "inner").select("as_set", "member").distinct())
        numbers = met.where(F.col("member").rlike(_NUMBER)).select("as_set", F.expr("try_cast(substring(member, 3) as bigint)").alias("asn"), F.lit(depth).alias("depth")).where("asn is not null")
        found = numbers if found is None else found.unionByName(numbers)
        sets = met.where(~F.col("member").rlike(_NUMBER)).select("as_set", F.col("member").alias("inner"))
        level = cut(sets.join(reached, ["as_set", "inner"], "left_anti"))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    if found is None:
        return roots.sparkSession.createDataFrame([], "as_set string, asn bigint, depth int")
    return found.groupBy("as_set", "asn").agg(F.min("depth").alias("depth"))
