"""Benchmark decontamination by a Wu-Manber multi-pattern search over words.

Symbols of the search are words (lower case, ASCII letters, digits and all non-ASCII characters).
Every window of ``window`` consecutive item words is a pattern; an item with fewer words, but not
none, is one shorter pattern. A block is two consecutive words: a shift table over hashed blocks says
how far the search may jump, a block without shift leads to the bucket of the patterns that end in
it, and a direct comparison of the words confirms each occurrence.

The benchmark is a stated query set. It is indexed in blocks of at most ``block_words`` pattern
words, each of them broadcast, and all documents are searched for each block: documents are never
shuffled.

Cases: null or empty texts have no words and no hits; items without words and items with a null id
are left out; repeated items count once; extra columns of either table are ignored; empty tables give
empty results or documents without hits.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W

#: Words of patterns in one broadcast index (about 60 bytes each).
BLOCK_WORDS = 2_000_000
WINDOW = 10
#: Entries of a shift table, a power of two.
_TABLE = 1 << 20
#: The text is searched from this many places at once.
_LANES = 4096


def item_words(text: str | None) -> list[bytes]:
    """The words of an item, as documents are split too."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    data = W.LOWER[data]
    starts, ends, _ = W.split(data, np.array([0, len(data)]), W.NOT_ALNUM)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


class PatternIndex:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, patterns: dict[bytes, list[str]], length: int) -> None:
        """``patterns``: space-joined words -> item ids."""
        self.length, self.block = length, min(2, length)
        self.items = patterns
        blob = b" ".join(patterns)
        data = np.frombuffer(blob, np.uint8)
        starts, ends, _ = W.split(data, np.array([0, len(data)]), W.SPACES)
        h = W.hash_words(data, starts, ends).reshape(-1, length)
        blocks = h if self.block == 1 else W.join_hashes(h[:, :-1], h[:, 1:])
        last = blocks.shape[1] - 1
        self.shift = np.full(_TABLE, last + 1, np.uint16)
        for at in range(last + 1):
            self.shift[(blocks[:, at] & np.uint64(_TABLE - 1)).astype(np.int64)] = last - at
        # A bucket holds the patterns of one suffix block; inside it the prefix block tells them apart.
        self.bucket = np.unique(W.join_hashes(blocks[:, last], blocks[:, 0]))

    def ends(self, h: np.ndarray) -> np.ndarray:
        """Ends (exclusive word positions) where a bucket holds a pattern, to be confirmed."""
        n, size = len(h), self.length
        if n < size:
            return np.zeros(0, np.int64)
        lane = -(-n // _LANES)
        at = np.arange(size, n + 1, lane, dtype=np.int64)
        stop = np.minimum(at + lane, n + 1)
        found = []
        while len(at):
            suffix = h[at - 1] if self.block == 1 else W.join_hashes(h[at - 2], h[at - 1])
            jump = self.shift[(suffix & np.uint64(_TABLE - 1)).astype(np.int64)].astype(np.int64)
            hit = jump == 0
            if hit.any():
                end, tail = at[hit], suffix[hit]
                head = h[end - size] if self.block == 1 else W.join_hashes(h[end - size], h[end - size + 1])
                key = W.join_hashes(tail, head)
                place = np.minimum(np.searchsorted(self.bucket, key), len(self.bucket) - 1)
                found.append(end[self.bucket[place] == key])
            at = at + np.maximum(jump, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def build_index(items: list[tuple[str, str]], window: int = WINDOW) -> list[PatternIndex]:
    """Indexes by pattern length of (item id, text) pairs."""
    by_length: dict[int, dict[bytes, list[str]]] = {}
    for item_id, text in items:
        words = item_words(text)
        if not words:
            continue
        size = min(window, len(words))
        for i in range(len(words) - size + 1):
            owners = by_length.setdefault(size, {}).setdefault(b" ".join(words[i : i + size]), [])
            if item_id not in owners[-1:]:
                owners.append(item_id)
    return [PatternIndex(patterns, size) for size, patterns in sorted(by_length.items())]


def search(column: pa.Array, indexes: list[PatternIndex]) -> Iterator[tuple[int, np.ndarray, list]]:
    """Yield (n_words, hit word positions, item ids) for each text of the column."""
    for _, data, offsets in W.text_blocks(column):
        data = W.LOWER[data]
        starts, ends, text_of = W.split(data, offsets, W.NOT_ALNUM)
        h = W.hash_words(data, starts, ends)
        n_texts = len(offsets) - 1
        first = np.searchsorted(text_of, np.arange(n_texts + 1), "left")
        hit = np.zeros(len(h) + 1, np.int64)
        items: dict[int, set] = {}
        for index in indexes:
            for end in index.ends(h).tolist():
                begin = end - index.length
                if text_of[begin] != text_of[end - 1]:
                    continue
                words = b" ".join(data[starts[k] : ends[k]].tobytes() for k in range(begin, end))
                if (owners := index.items.get(words)) is not None:
                    hit[begin] += 1
                    hit[end] -= 1
                    items.setdefault(int(text_of[begin]), set()).update(owners)
        covered = np.cumsum(hit[:-1]) > 0
        for k in range(n_texts):
            inside = covered[first[k] : first[k + 1]]
            yield len(inside), np.flatnonzero(inside), sorted(items.get(k, ()))


def _index_blocks(benchmark: DataFrame, window: int, block_words: int) -> list:
    """Broadcast pickled indexes, each over at most about ``block_words`` pattern words."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.select(F.sum(F.size(F.split("text", r"\s+")).cast("long") * window)).first()[0] or 0
    n = max(1, -(-size // block_words))
    out = []
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).distinct().collect()
        if rows:
            out.append(spark.sparkContext.broadcast(pickle.dumps(build_index([tuple(r) for r in rows], window))))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Return (doc_id, text, n_words, hit_positions array<int>, item_ids array<string>) of every document.

    ``hit_positions`` are the word positions inside any occurrence of a pattern, ascending;
    ``item_ids`` the items with occurring patterns, ascending as strings.
    """
    out = docs.select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hit_positions"), F.array().cast("array<string>").alias("item_ids")
    )
    blocks = _index_blocks(benchmark, window, block_words)
    for held in blocks or [docs.sparkSession.sparkContext.broadcast(pickle.dumps([]))]:

        def run(batches, held=held):
            indexes = pickle.loads(held.value)
            for batch in batches:
                texts = batch.column("text")
                before = zip(batch.column("hit_positions").to_pylist(), batch.column("item_ids").to_pylist())
                counts, hits, ids = [], [], []
                for (n, at, items), (old_hits, old_items) in zip(search(texts, indexes), before):
                    counts.append(n)
                    hits.append(at.tolist() if not old_hits else sorted({*old_hits, *at.tolist()}))
                    ids.append(items if not old_items else sorted({*old_items, *items}))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), texts, pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))],
                    names=["doc_id", "text", "n_words", "hit_positions", "item_ids"],
                )

        out = out.mapInArrow(run, out.schema)
    return out


def contamination_report(found: DataFrame) -> DataFrame:
    """The digest columns of ``find_contamination``'s result."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_positions").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hit_positions") > 0).alias("contaminated"),
    )


def items_digest(item_ids: list[str]) -> str:
    """Digest of sorted item ids, as in the report."""
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, in which no benchmark window occurs."""
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    blocks = _index_blocks(benchmark, window, BLOCK_WORDS)
    for held in blocks:

        def run(batches, held=held):
            indexes = pickle.loads(held.value)
            for batch in batches:
                clean = [not len(at) for _, at, _ in search(batch.column("text"), indexes)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        packed = packed.mapInArrow(run, packed.schema)
    return packed.select("row.*")
