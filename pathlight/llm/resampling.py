"""Importance resampling of documents towards a target distribution.

Features are all runs of one to ``runs`` consecutive words, hashed into buckets by CRC-32. A text is
scanned once: a ring keeps the running CRC states of the last ``runs`` starts, each word extends all of
them by a space and its bytes and opens a state of its own, and every state is a feature's bucket. A
document's weight is the mean log ratio of its buckets' shares in the target and in the source; a draw
without replacement adds Gumbel noise, seeded by the document's id, and takes the highest scores.

The scan's buckets are written once to the shared folder; counts and weights are read from there. Counts
are dense vectors of ``buckets`` numbers, whatever the input's size. Ranks need no global sort: a score
is a whole number of at most some 113,000 values (a log ratio of 64-bit counts lies within 44,000, the
noise between -3,100 and 23,000), so a histogram of scores gives the cut and the rank at which each score
begins, and only the drawn documents of one score are ordered among themselves.

Cases: null and empty texts have no features and weight 0; a null id is drawn under the noise of an empty
id and comes after equal scores; repeated rows are documents of their own, which share their noise; ties
go to the smaller id; an empty table gives an empty result, and with an empty target all gains follow
from zero counts; extra columns are ignored. Long texts are split a megabyte at a time.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections.abc import Iterable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import words as W
from .lineage import cut, shared_folder

RUNS = 2
BUCKETS = 10_000
#: Fewest words of a document that can be drawn, per cent drawn of those, seed of the noise.
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
_TABLE = W.word_table(W.NOT_ALNUM)
#: Bytes of buckets in one batch of results.
_FLUSH = 8 << 20


def ring(words: Iterable[bytes], states: list[int], runs: int, out: array) -> list[int]:
    """Append the CRC-32 of all runs that end at one of ``words`` to ``out``; ``states`` of the last starts come from
    the words before and are returned for the words behind."""
    longer = 1 - runs
    for word in words:
        tail = b" " + word
        states = [crc32(tail, state) for state in states[longer:]] if runs > 1 else []
        states.append(crc32(word))
        out.extend(states)
    return states


def feature_buckets(text: str | None, runs: int = RUNS, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each feature in the order of its last word."""
    out, states, n = array("I"), [], 0
    for part in W.lists_of_words(text, _TABLE):
        states = ring(part, states, runs, out)
        n += len(part)
    return n, (np.frombuffer(out, np.uint32) % np.uint32(buckets)).astype(np.uint32 if buckets > 1 << 16 else np.uint16)


def scan(docs: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets binary) of every document."""

    @W.released
    def run(batches):
        for batch in batches:
            ids, first, size, rows = batch.column("doc_id"), 0, 0, []
            for k, text in enumerate(batch.column("text")):
                n, found = feature_buckets(text.as_py(), runs, buckets)
                rows.append((n, len(found), found.tobytes()))
                size += found.nbytes
                if size > _FLUSH or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(rows)), *map(pa.array, zip(*rows))], names=["doc_id", "n_words", "n_features", "buckets"])
                    first, size, rows = k + 1, 0, []

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, buckets binary")


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs; one dense vector for each task comes together."""
    width = np.uint32 if buckets > 1 << 16 else np.uint16

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found in batch.column("buckets"):
                total += np.bincount(np.frombuffer(found.as_buffer(), width), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in scanned.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of each bucket's smoothed shares."""
    m, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + m) / (float(s + 1) * float(t_all + m)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weighted(scanned: DataFrame, gains: np.ndarray) -> DataFrame:
    held = scanned.sparkSession.sparkContext.broadcast(gains)
    width = np.uint32 if len(gains) > 1 << 16 else np.uint16

    @W.released
    def run(batches):
        for batch in batches:
            sums = [int(held.value[np.frombuffer(x.as_buffer(), width)].sum()) for x in batch.column("buckets")]
            n = batch.column("n_features").to_numpy()
            weight = np.array(sums, np.int64) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = scanned.schema["doc_id"].dataType.simpleString()
    return scanned.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def score_documents(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document, materialised."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/resampling-{uuid.uuid4().hex}"
    scan(docs, runs, buckets).write.parquet(folder)
    scanned = spark.read.parquet(folder)
    wanted = bucket_counts(scan(target.select(F.lit(0).cast("bigint").alias("doc_id"), "text"), runs, buckets), buckets)
    weighted = _weighted(scanned, bucket_gains(bucket_counts(scanned, buckets), wanted))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    return cut(weighted.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))))


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` with the rank of the drawn documents, null elsewhere."""
    spark = scored.sparkSession
    held = scored.where(F.col("n_words") >= least_words).groupBy("score").count().collect()
    wanted, before, begins = percent * sum(r["count"] for r in held) // 100, 0, []
    for score, n in sorted(held, reverse=True):
        if before >= wanted:
            break
        begins.append((score, before))
        before += n
    chance = (F.col("n_words") >= least_words) & (F.col("score") >= begins[-1][0]) if begins else F.lit(False)
    begins = spark.createDataFrame(begins, "score bigint, before bigint")
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())) + F.col("before")
    drawn = scored.where(chance).join(F.broadcast(begins), "score").withColumn("rank", place.cast("bigint"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return drawn.select(*scored.columns, "rank").unionByName(scored.where(~chance).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The drawn documents with all their columns; rows that repeat an id come and go together."""
    drawn = draw(score_documents(docs, target), percent=percent).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.join(drawn, F.col("row.doc_id").eqNullSafe(F.col("_drawn")), "left_semi").select("row.*")


def resampling_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Return (doc_id, n_features, weight, score, rank)."""
    return draw(score_documents(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")
