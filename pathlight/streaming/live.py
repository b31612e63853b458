"""Live ingestion with Structured Streaming: files of messages to merged element partitions and live state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pathlight.sources import readers, tables


def live_stream(spark: SparkSession, folder: str, files_per_batch: int = 50) -> DataFrame:
    """Elements of JSON-lines files as they arrive."""
    return readers.live_elements(readers.sequenced(spark.readStream.schema(readers.LIVE).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(folder)))


def land(stream: DataFrame, path: str, checkpoint: str, minutes: int = 5) -> StreamingQuery:
    """Write elements below the window of ``minutes`` in which their file arrived (window=yyyyMMddHHmm)."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds("sequence.time") / (minutes * 60)) * (minutes * 60))
    rows = stream.withColumn("window", F.date_format(start, "yyyyMMddHHmm"))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("window").trigger(availableNow=True).start()


def _merge_batch(path: str, after: Callable[[list[str]], None] | None = None, catalog=None) -> Callable[[DataFrame, int], None]:
    def merge(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        days = [str(r[0]) for r in batch.select(F.to_date("ts")).distinct().collect()]  # days of one micro-batch
        tables.recover(batch.sparkSession, path)
        try:
            stored = tables.read_partitions(batch.sparkSession, path, min(days), max(days)).drop("date")
        except tables.DataUnavailable:
            stored = None
        keys = tables.swap(tables.merge_window(stored, batch), path)
        if catalog is not None:
            tables.register(batch.sparkSession, path, "elements", keys, catalog)
        if after is not None:
            after(days)

    return merge


def merge_into(stream: DataFrame, path: str, checkpoint: str, catalog=None) -> StreamingQuery:
    """Merge each micro-batch into the partitions of its days; replays and late data change nothing twice.

    The partitions are recorded in ``catalog``.
    """
    return stream.writeStream.foreachBatch(_merge_batch(path, catalog=catalog)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(stream: DataFrame, path: str, checkpoint: str, detect: Callable[[list[str]], None]) -> StreamingQuery:
    """Merge each micro-batch and then run ``detect`` on the days that it touched; it may run again after a failure."""
    return stream.writeStream.foreachBatch(_merge_batch(path, detect)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Elements once by key, for bounded lateness."""
    return stream.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(tables.KEYS)


def churn(stream: DataFrame, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Updates by window and prefix, final once the watermark has passed."""
    timed = stream.where("elem_type <> 'R'").withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", lateness)
    return timed.groupBy(F.window("event_time", window).alias("w"), "prefix").agg(F.count(F.lit(1)).alias("updates")).select(F.col("w.start").alias("window_start"), "prefix", "updates")


#: Milliseconds for which a silent peer keeps its path, as a replay's warm-up does.
SILENCE_MS = 24 * 3_600_000
_STATE = "prefix string, collector string, peer_ip string, path string, micros bigint, reason string"


def _change(key: tuple, path: str, micros: int, reason: str) -> Row:
    return Row(prefix=key[0], collector=key[1], peer_ip=key[2], path=path, micros=micros, reason=reason)


class PeerState(StatefulProcessor):
    """The path in force of one peer for one prefix.

    Messages wait until the watermark has passed their time and are applied in the order of their times, so what
    comes out of order within the allowed lateness changes nothing. Of messages with the same time the last
    in the order (sequence) counts. A message older than the watermark or the state is ignored; an announcement without a path keeps it. A peer
    from which nothing came for ``silence_ms`` loses its path.
    """

    def __init__(self, silence_ms: int = SILENCE_MS) -> None:
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros bigint, path string")
        self.waiting = handle.getMapState("waiting", "micros bigint", "kind string, path string, place string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        done = max(self.last.get()[0] if self.last.exists() else 0, watermark * 1000)
        for r in rows:
            if r["micros"] < done:
                continue
            held = self.waiting.getValue((r["micros"],)) if self.waiting.containsKey((r["micros"],)) else None
            if held is None or held[2] <= r["place"]:
                self.waiting.updateValue((r["micros"],), (r["elem_type"], r["path"], r["place"]))
            self.handle.registerTimer(max(-(-r["micros"] // 1000), watermark + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((k[0] for k in self.waiting.keys() if -(-k[0] // 1000) <= now))
        for micros in due:
            kind, path, _ = self.waiting.getValue((micros,))
            self.waiting.removeKey((micros,))
            before = self.last.get()[1] if self.last.exists() else ""
            after = "" if kind == "W" else path or before
            self.last.update((micros, after))
            self.handle.registerTimer(micros // 1000 + self.silence_ms)
            if after != before:
                yield _change(key, after, micros, "announced" if after else "withdrawn")
        if not due and self.last.exists():
            micros, path = self.last.get()
            if micros // 1000 + self.silence_ms <= now and not any(True for _ in self.waiting.keys()):
                self.last.clear()
                if path:
                    yield _change(key, "", micros, "silent")


def live_state(stream: DataFrame, lateness: str = "10 minutes", silence_ms: int = SILENCE_MS) -> DataFrame:
    """(prefix, collector, peer_ip, path, micros, reason): each change of a peer's path, once the watermark has passed it.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    place = F.concat_ws("|", F.date_format("sequence.time", "yyyyMMddHHmmssSSSSSS"), "sequence.file", F.lpad(F.col("sequence.block").cast("string"), 20, "0")) if "sequence" in stream.columns else F.lit("")
    rows = stream.where("elem_type <> 'R'").withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", lateness)
    path = F.array_join(F.transform("as_path_dedup", lambda x: x.cast("string")), " ").alias("path")
    rows = rows.select("prefix", "collector", "peer_ip", F.unix_micros("event_time").alias("micros"), "event_time", "elem_type", path, place.alias("place"))
    return rows.groupBy("prefix", "collector", "peer_ip").transformWithState(PeerState(silence_ms), _STATE, "Append", "EventTime")
