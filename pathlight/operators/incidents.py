"""Events of a prefix that begin near each other form an incident; the gap is measured from the first one.

Which event begins an incident depends on the one before it, along the whole time line of a prefix. The line is
cut into ranges of hours. A range is summarised as a function: given the time up to which the incident that comes in
covers events, the time up to which the one that goes out does. What comes in began before the range and covers less
than one gap of it, so the function has a step for each time in the range's first gap at most. The functions of a
prefix are applied one after the other, a row for each range, and then each range groups its own events by what comes
into it. No task holds the events of more than one range of a prefix, so neither a prefix with very many events nor
the events without a prefix fall on one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pathlight.functions import ids
from pathlight.session import merged

from .detectors import severity

RANGE_HOURS = 24
#: Before all times.
_NEVER = np.iinfo(np.int64).min


def next_anchors(times: np.ndarray, gap: int) -> np.ndarray:
    """For each of the ascending ``times``, the first one that an incident beginning there doesn't cover."""
    return np.searchsorted(times, times + gap, "right")


def summarise(times: np.ndarray, gap: int, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """(upper, out): what is covered up to less than ``upper[k]`` (and no smaller step) goes out as ``out[k]``.

    ``begin``: of the range of ``times``. What covers all of the range goes out as it came in.
    """
    times = np.unique(times)
    last = np.arange(len(times))
    follow = np.append(next_anchors(times, gap), len(times))
    # The last incident that a chain from each event begins in the range, by doubling.
    jump = np.where(follow[: len(times)] < len(times), follow[: len(times)], last)
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    first = min(len(times), int(np.searchsorted(times, begin + gap, "right")) + 1)
    out = times[jump[:first]] + gap
    edge = np.flatnonzero(np.append(out[1:] != out[:-1], True))
    return times[edge], out[edge]


def apply(upper: np.ndarray, out: np.ndarray, covered: int) -> int:
    at = int(np.searchsorted(upper, covered, "right"))
    return covered if at == len(upper) else int(out[at])


def anchors(times: np.ndarray, gap: int, covered: int, anchor: int) -> np.ndarray:
    """The begin of the incident of each of the ascending ``times``; ``anchor`` covers those up to ``covered``."""
    out, at = np.empty(len(times), np.int64), int(np.searchsorted(times, covered, "right"))
    out[:at] = anchor
    while at < len(times):
        end = int(np.searchsorted(times, times[at] + gap, "right"))
        out[at:end] = times[at]
        at = end
    return out


def anchored(events: DataFrame, minutes: int = 60, range_hours: int = RANGE_HOURS) -> DataFrame:
    """``events`` (prefix not null) with ``anchor``: the microseconds at which its incident begins."""
    gap, width = minutes * 60_000_000, range_hours * 3_600_000_000
    rows = events.withColumn("_t", F.unix_micros(F.col("first_seen").cast("timestamp")))
    rows = rows.withColumn("_range", F.floor(F.col("_t") / width))

    def functions(table: pa.Table) -> pa.Table:
        upper, out = summarise(np.sort(table.column("_t").to_numpy()), gap, table.column("_range")[0].as_py() * width)
        return pa.table({"prefix": table.column("prefix")[:1], "_range": table.column("_range")[:1], "upper": pa.array([upper]), "out": pa.array([out])})

    def through(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(tables)).sort_by("_range")
        covered, into = _NEVER, []
        for upper, out in zip(held.column("upper"), held.column("out")):
            into.append(covered)
            covered = apply(np.array(upper.as_py(), np.int64), np.array(out.as_py(), np.int64), covered)
        yield pa.RecordBatch.from_arrays([held.column("prefix").combine_chunks(), held.column("_range").combine_chunks(), pa.array(into, pa.int64())], names=["prefix", "_range", "_covered"])

    keys = ["prefix", "_range"]
    steps = rows.select(*keys, "_t").distinct().groupBy(*keys).applyInArrow(functions, "prefix string, _range bigint, upper array<bigint>, out array<bigint>")
    into = steps.groupBy("prefix").applyInArrow(through, "prefix string, _range bigint, _covered bigint")
    times = rows.select(*keys, "_t").distinct().join(merged(into), keys)

    def placed(table: pa.Table) -> pa.Table:
        table = table.sort_by("_t")
        covered = table.column("_covered")[0].as_py()
        begin = anchors(table.column("_t").to_numpy(), gap, covered, covered - gap if covered != _NEVER else covered)
        return pa.table({"prefix": table.column("prefix"), "_range": table.column("_range"), "_t": table.column("_t"), "anchor": pa.array(begin)})

    found = times.groupBy(*keys).applyInArrow(placed, "prefix string, _range bigint, _t bigint, anchor bigint")
    return rows.join(merged(found), [*keys, "_t"]).drop("_range", "_t")


def correlate(events: DataFrame, minutes: int = 60, range_hours: int = RANGE_HOURS) -> DataFrame:
    """(incident_id, prefix, severity, score, first_seen, last_seen, event_ids, detectors) of event rows.

    Events without a prefix are those of the prefix "-".
    """
    held = anchored(events.select(F.coalesce("prefix", F.lit("-")).alias("prefix"), "first_seen", "detector", "event_id", "score", "last_seen"), minutes, range_hours)
    each = held.groupBy("prefix", "anchor").agg(
        F.max("score").alias("score"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.array_sort(F.collect_set("detector")).alias("detectors"),
        F.transform(F.array_sort(F.collect_list(F.struct("first_seen", "detector", "event_id"))), lambda e: e["event_id"]).alias("event_ids"),
    )
    score = F.col("score") + F.least(F.lit(0.25), 0.08 * (F.size("detectors") - 1))
    out = each.select("prefix", F.round(F.least(F.lit(1.0), score), 3).alias("score"), "first_seen", "last_seen", "event_ids", "detectors")
    key = F.concat_ws("|", "prefix", F.col("first_seen").cast("string"))
    return out.withColumn("incident_id", ids.short_id(key)).withColumn("severity", severity(F.col("score")))


def upsert(previous: DataFrame, new: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows of both, those of ``new`` where a key is in both."""
    return new.unionByName(previous.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def recall(truth: DataFrame, events: DataFrame) -> DataFrame:
    """(planted, found, recall): planted (prefix, day) that an event of the same prefix and day meets."""
    days = events.select("prefix", F.to_date("first_seen").alias("day")).distinct().withColumn("hit", F.lit(1))
    met = truth.join(days, ["prefix", "day"], "left")
    return met.agg(F.count(F.lit(1)).alias("planted"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("planted"))
