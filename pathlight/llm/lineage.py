"""Reliable checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from pathlight.session import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Plan nodes below which the rows of a partition come in the same order each time they are read.
_ORDERED = frozenset("Project Filter Relation LogicalRDD LocalRelation Union Generate".split())


def in_fixed_order(df: DataFrame) -> DataFrame:
    """``df`` itself if it only reads, filters and projects tables; else its rows, materialised.

    For operators that read their input twice: what comes out of a shuffle may come in another order then.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m.group(1) for line in plan.splitlines() if (m := re.match(r"[\s:+\-]*([A-Za-z]+)", line))}
    return df if nodes <= _ORDERED else cut(df)
