"""Replay of a prefix's propagation: the state of its peers at the end of each frame of a bounded span.

The state of a peer (collector, address) is the path of its last announcement until a withdrawal; an
announcement without a path leaves it. Frame 0 is the state at the start, frame k covers the messages after the
frame before; the last frame may be cut short. Messages are read from a warm-up before the start to the end and
no further, so a peer that was silent for longer is absent at first.

Each state is one interval of frame numbers. Paths and edges get the union of their intervals, and what is asked
of them (stable edges, changes from frame to frame, difference from the first frame) is read off the
intervals' borders; frames are only listed where the answer lists them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathlight.functions import paths as p

MAX_DAYS, WARM_UP_HOURS = 7, 24
#: Bounds beyond which a replay lists no paths: distinct ones, and those of all frames together.
MAX_PATHS, MAX_PATHS_IN_FRAMES = 3_000, 400_000


@dataclass(frozen=True)
class Span:
    """Frames from ``start`` to ``end``, every so many minutes."""

    start: datetime
    end: datetime
    minutes: int
    clamped: bool = False

    @property
    def last(self) -> int:
        """Number of the last frame."""
        return max(0, math.ceil((self.end - self.start) / timedelta(minutes=self.minutes)))


def span(start: datetime, end: datetime, minutes: int = 15, max_frames: int = 200, max_days: int = MAX_DAYS) -> Span:
    """The last ``max_days`` of the asked time, the step widened to whole minutes so that there are at most ``max_frames`` after the first."""
    clamped = end - start > timedelta(days=max_days)
    if clamped:
        start = end - timedelta(days=max_days)
    if end > start and math.ceil((end - start) / timedelta(minutes=minutes)) > max_frames:
        minutes = math.ceil((end - start).total_seconds() / 60 / max_frames)
    return Span(start, end, minutes, clamped)


def _micros(value: Column | datetime) -> Column:
    value = F.lit(value.isoformat()).cast("timestamp_ntz") if isinstance(value, datetime) else value
    return F.unix_micros(value.cast("timestamp"))


def messages(elements: DataFrame, prefix: str, at: Span, warm_up_hours: int = WARM_UP_HOURS) -> DataFrame:
    """The prefix's messages of the span and its warm-up; a ``date`` partition column prunes the scan too."""
    since = at.start - timedelta(hours=warm_up_hours)
    ts = lambda t: F.lit(t.isoformat()).cast("timestamp_ntz")
    rows = elements.where((F.col("prefix") == prefix) & (F.col("ts") >= ts(since)) & (F.col("ts") <= ts(at.end)))
    return rows.where(F.col("date").cast("date").between(since.date(), at.end.date())) if "date" in elements.columns else rows


def states(elements: DataFrame, prefix: str, at: Span, origin: int | None = None, targets: list[int] | None = None, warm_up_hours: int = WARM_UP_HOURS) -> DataFrame:
    """(collector, peer_ip, path, a, b): the frames ``a`` to ``b`` in which a peer has a path.

    Paths run from the origin to the peer, cut at the first of the ``targets``. ``origin`` is asked of the states, so that
    a peer which has turned to another origin is not at the old one.
    """
    rows = messages(elements, prefix, at, warm_up_hours).where((F.col("elem_type") == "W") | (F.size("path") > 0))
    peer = Window.partitionBy("collector", "peer_ip").orderBy("ts", "seq")
    held = rows.withColumn("until", F.lead("ts").over(peer)).where("elem_type <> 'W'")
    s, e, step, last = _micros(at.start), _micros(at.end), at.minutes * 60_000_000, F.lit(at.last).cast("bigint")
    number = lambda c: F.ceil((_micros(F.col(c)) - s) / step)
    first = F.greatest(F.lit(0), number("ts"))
    # A state that ends by the end of the last, shortened frame is over then.
    stop = F.when(F.col("until").isNull() | (_micros(F.col("until")) > e), last).otherwise(F.least(number("until"), last) - 1)
    if origin is not None:
        held = held.where(F.element_at("path", -1) == origin)
    wanted = F.array(*[F.lit(t).cast("bigint") for t in targets or ()]).cast("array<bigint>")
    return held.select("collector", "peer_ip", p.orient(F.col("path"), wanted).alias("path"), first.cast("int").alias("a"), stop.cast("int").alias("b")).where("a <= b")


def united(intervals: DataFrame, *keys: str) -> DataFrame:
    """(keys, a, b): the union of each key's intervals, as intervals that don't touch."""
    order = Window.partitionBy(*keys).orderBy("a", "b")
    reached = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.select(*keys, "a", "b").distinct().withColumn("_new", F.coalesce(F.col("a") > reached + 1, F.lit(True)).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_run")


def edges(held: DataFrame) -> DataFrame:
    """(source, target, a, b): the frames in which any state of ``states`` has the edge."""
    each = united(held, "path").select(F.explode(F.array_distinct(p.links(F.col("path")))).alias("l"), "a", "b")
    return united(each.select(F.col("l.a").alias("source"), F.col("l.b").alias("target"), "a", "b"), "source", "target")


def frame_time(number: Column, at: Span) -> Column:
    return F.timestamp_micros(F.least(_micros(at.end), _micros(at.start) + number.cast("bigint") * (at.minutes * 60_000_000))).cast("timestamp_ntz")


def _listed(rows: DataFrame, at: Span, first: Column | str = "a", last: Column | str = "b") -> DataFrame:
    return rows.withColumn("k", F.explode(F.sequence(first, last))).withColumn("frame", frame_time(F.col("k"), at))


def paths(held: DataFrame, at: Span, max_paths: int = MAX_PATHS, max_in_frames: int = MAX_PATHS_IN_FRAMES) -> DataFrame:
    """(frame, path, peers): the paths of each frame and the peers that have them; none at all beyond the bounds."""
    size = united(held, "path").agg(F.count_distinct("path").alias("_n"), F.sum(F.col("b") - F.col("a") + 1).alias("_m"))  # one row
    kept = held.join(F.broadcast(size)).where((F.col("_n") <= max_paths) & (F.col("_m") <= max_in_frames))
    return _listed(kept.select("path", "a", "b"), at).groupBy("frame", "path").agg(F.count(F.lit(1)).alias("peers"))


def frames(elements: DataFrame, held: DataFrame, prefix: str, at: Span) -> DataFrame:
    """(frame, announcements, withdrawals, paths, nodes, edges) of every frame; messages of any origin are counted."""
    s, step = _micros(at.start), at.minutes * 60_000_000
    rows = messages(elements, prefix, at, 0).where(_micros(F.col("ts")) > s)
    counted = rows.groupBy(F.ceil((_micros(F.col("ts")) - s) / step).cast("int").alias("k")).agg(F.count_if(F.col("elem_type") != "W").alias("announcements"), F.count_if(F.col("elem_type") == "W").alias("withdrawals"))
    own = united(held, "path")
    there = _listed(own, at).groupBy("k").agg(F.count(F.lit(1)).alias("paths"))
    nodes = united(own.select(F.explode("path").alias("asn"), "a", "b"), "asn")
    with_nodes = _listed(nodes, at).groupBy("k").agg(F.count(F.lit(1)).alias("nodes"))
    with_edges = _listed(edges(held), at).groupBy("k").agg(F.count(F.lit(1)).alias("edges"))
    every = elements.sparkSession.range(at.last + 1).select(F.col("id").cast("int").alias("k"))
    for part in (counted, there, with_nodes, with_edges):
        every = every.join(part, "k", "left")
    return every.withColumn("frame", frame_time(F.col("k"), at)).drop("k").fillna(0)


def stable_edges(held: DataFrame, at: Span) -> DataFrame:
    """(source, target) of the edges in all frames."""
    return edges(held).where((F.col("a") == 0) & (F.col("b") == at.last)).select("source", "target")


def changes(held: DataFrame, at: Span) -> DataFrame:
    """(frame, source, target, change): edges that a frame has and the one before hadn't, and the other way round."""
    border = F.array(F.struct(F.col("a").alias("k"), F.lit("added").alias("change")), F.struct((F.col("b") + 1).alias("k"), F.lit("removed").alias("change")))
    rows = edges(held).select("source", "target", F.inline(border)).where((F.col("k") > 0) & (F.col("k") <= at.last))
    return rows.select(frame_time(F.col("k"), at).alias("frame"), "source", "target", "change")


def difference(held: DataFrame, at: Span) -> DataFrame:
    """(frame, source, target, change) of each frame against the first: edges that have come and those that have gone."""
    own = Window.partitionBy("source", "target")
    rows = edges(held).withColumn("_first", F.min("a").over(own) == 0).withColumn("_next", F.lead("a").over(own.orderBy("a")))
    came = _listed(rows.where(~F.col("_first")), at).withColumn("change", F.lit("added"))
    gaps = rows.where("_first").select("source", "target", (F.col("b") + 1).alias("a"), (F.coalesce("_next", F.lit(at.last + 1)) - 1).alias("b")).where("a <= b")
    gone = _listed(gaps, at).withColumn("change", F.lit("removed"))
    columns = ["frame", "source", "target", "change"]
    return came.select(columns).unionByName(gone.select(columns))
