"""The observation model as partitioned tables with stored metrics, kept in the shared folder for a session.

The tables of a data folder become element and snapshot partitions once. A metric table is stored when a query
first asks for it, for all days but the newest, which would still be growing; a query pays for no other table. The
read queries take stored days and compute the newest one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathlight.operators.store import Store
from pathlight.session import shared_folder
from pathlight.sources import tables

from . import projection as p

#: Tables that are stored; the others are computed.
BUILT = ("daily_prefix_origin", "daily_adjacency", "churn_prefix", "upstream", "visibility")

_STORES: dict[tuple[str, str], Store] = {}


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The store of a data folder; made at the first call of a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        folder = f"{shared_folder(spark)}/observations-{uuid.uuid4().hex}"
        paths = {name: f"{folder}/{name}" for name in ("elements", "rib")}
        tables.write_elements(p.elements(spark, sf_dir), paths["elements"])
        p.rib(spark, sf_dir).withColumn("date", F.to_date("snapshot_ts")).repartitionByRange("date", "prefix").write.partitionBy("date").parquet(paths["rib"])
        # The tables don't change within a session; files of live tables would be listed again each minute.
        _STORES[key] = Store(spark, f"{folder}/metrics", paths, p.asns(spark, sf_dir), p.roas(spark, sf_dir), p.roles(spark, sf_dir), window="1d", max_age=float("inf"))
    return _STORES[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A metric table, stored at its first use."""
    held = store(spark, sf_dir)
    if name in BUILT and (days := held.days()[:-1]) and not held.current(name):
        held.build(days, [name])
    return held.table(name)
