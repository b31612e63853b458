"""Substring deduplication by level-wise doubling.

Windows repeated at one length alone are extended to twice that length. The first level has half of
the final window (10 of 20 words): there it is enough to look at the minimizers, the windows whose hash
is least among the first-level windows of some final window. Equal final windows have equal minimizers,
so a final window can repeat only if its minimizers do; about a sixth of the windows is shuffled, and
nothing is lost. The final windows around repeated minimizers are the candidates of the next level. A
window of which an equal one starts earlier marks its words; marked words are removed.

Windows of one task are compared among themselves first: only the earliest of each content goes into
the shuffle, so a passage that a third of all documents share arrives once per block of texts.

Cases: doc_id may be of any integer type, others raise a TypeError; null and empty texts have no words; texts shorter than a window lose nothing; rows with a null
doc_id are kept whole and take away nothing; rows that repeat a doc_id with the same text are one document,
and with other texts variants of it, each with its own words (windows at equal positions of variants are not
earlier than each other); extra columns are kept by
``drop_repeated_words`` and ignored elsewhere; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType, LongType, StringType, StructType

from . import words as W
from .lineage import cut

WINDOW = 20
#: Variants of repeated ids up to which they are broadcast.
FEW_VARIANTS = 100_000
#: The hash of its minimizer and an independent one, of 64 bits each, identify a final window.
_SECOND = np.uint64(0xA24BAED4963EE407)


def _starts_in(text_of: np.ndarray, size: int) -> np.ndarray:
    """Whether a window of ``size`` words from each word stays within its text."""
    inside = np.zeros(len(text_of), bool)
    if len(text_of) >= size:
        inside[: len(text_of) - size + 1] = text_of[: len(text_of) - size + 1] == text_of[size - 1 :]
    return inside


def _anchors(h: np.ndarray, text_of: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the minimizers of all final windows."""
    half = (window + 1) // 2
    span = window - half + 1  # first-level windows inside a final one
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    level = W.window_hashes(h, half)
    least = W.sliding(level, span)
    least[~_starts_in(text_of, window)[: len(least)]] = 0  # no window starts here
    padded = np.concatenate((np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)))
    chosen = np.flatnonzero(W.sliding(padded, span, np.maximum)[: len(level)] == level)
    return chosen, level[chosen]


def _first_of_each(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(earliest index of each distinct key, for each index the earliest of its key); indexes in order."""
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return first, first[inverse]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs``; if ids have several texts, with a column ``_variant``: 0, or the number of the text among those of its id.

    Ids with one text, nearly all, are told by an aggregation of hashes; texts aren't shuffled for it.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text")).distinct()
    several = texts.groupBy("_id").agg(F.min("_text").alias("_a"), F.max("_text").alias("_b")).where("_a <> _b").select("_id")
    if several.isEmpty():
        return docs
    place = F.row_number().over(Window.partitionBy("_id").orderBy("_text"))
    variants = cut(texts.join(several, "_id", "left_semi").select("_id", "_text", place.alias("_variant")))
    if variants.count() <= FEW_VARIANTS:
        variants = F.broadcast(variants)
    on = (F.col("doc_id") == F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_text"))
    return docs.join(variants, on, "left").drop("_id", "_text").withColumn("_variant", F.coalesce("_variant", F.lit(0)))


def _keys(docs: DataFrame) -> list[str]:
    """What tells documents apart. A variant that is 0 everywhere would only widen what is shuffled."""
    return ["doc_id", "variant"] if "_variant" in docs.columns or "variant" in docs.columns else ["doc_id"]


def _variant(df: DataFrame):
    return F.col("variant") if "variant" in df.columns else F.lit(0).alias("variant")


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """(key, doc_id, variant if there are some, at, known): the earliest minimizer of each content in a block, and the others.

    ``known``: it is repeated within its block.
    """

    @W.released
    def run(batches):
        for batch in batches:
            ids, variants = _ids(batch), batch.column("variant").to_numpy()
            for row, data, offsets in W.text_blocks(batch.column("text")):
                starts, ends, text_of = W.split(data, offsets, W.SPACES)
                at, key = _anchors(W.hash_words(data, starts, ends), text_of, window)
                first, leader = _first_of_each(key)
                again = np.zeros(len(at), bool)
                follower = leader != np.arange(len(at))
                again[leader[follower]] = again[follower] = True
                word = at - np.searchsorted(text_of, text_of[at], "left")
                # Followers are repeated for sure; their key only spreads them.
                key = np.where(follower, W._mix(key + at.astype(np.uint64)), key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ids[row + text_of[at]]), pa.array(variants[row + text_of[at]]), pa.array(word.astype(np.int32)), pa.array(np.where(follower, 2, again).astype(np.int8))],
                    names=["key", "doc_id", "variant", "at", "known"],
                )

    rows = docs.select("doc_id", _variant(docs), "text").mapInArrow(run, "key bigint, doc_id bigint, variant int, at int, known tinyint")
    return rows.select("key", *_keys(docs), "at", "known")


def _repeated_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, variant, anchors array<int>): the minimizers that occur more than once."""
    rows = _anchor_rows(docs, window)
    same = Window.partitionBy("key", F.col("known") == 2)
    found = rows.withColumn("n", F.count(F.lit(1)).over(same)).where("known > 0 or n > 1")
    return found.groupBy(*_keys(docs)).agg(F.collect_list("at").alias("anchors"))


def _minimizer_of(level: np.ndarray, span: int) -> np.ndarray:
    """For each window start, the place of the first least value among ``span``."""
    least = W.sliding(level, span)
    at = np.zeros(len(least), np.int64)
    places = np.arange(len(least))
    for ahead in range(span - 1, -1, -1):
        same = level[ahead : ahead + len(least)] == least
        at[same] = places[same] + ahead
    return at


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of the maximal runs of consecutive integers."""
    edges = np.flatnonzero(np.concatenate(([True], np.diff(values) != 1, [True]))) if len(values) else np.zeros(1, np.int64)
    return edges[:-1], np.diff(edges)


def _window_rows(texts: DataFrame, anchored: DataFrame, window: int) -> DataFrame:
    """The final windows around repeated minimizers: (key, doc_id, variant, at, hashes array<bigint>, known int).

    A row holds the windows that share a minimizer of hash ``key``; they start at ``at`` and the words
    after it, and ``hashes`` (zero for a gap) are theirs. A row with ``known`` windows from ``at`` says
    that an equal window starts earlier in the same block of texts.
    """
    half = (window + 1) // 2
    span = window - half + 1

    @W.released
    def run(batches):
        for batch in batches:
            ids, variants = _ids(batch), batch.column("variant").to_numpy()
            anchors = batch.column("anchors")
            flat = anchors.flatten().to_numpy(zero_copy_only=False)
            counts = np.concatenate(([0], np.cumsum(anchors.value_lengths().to_numpy(zero_copy_only=False))))
            for row, data, offsets in W.text_blocks(batch.column("text")):
                starts, ends, text_of = W.split(data, offsets, W.SPACES)
                n_texts = len(offsets) - 1
                h = W.hash_words(data, starts, ends)
                if len(h) < window:
                    continue
                first = np.searchsorted(text_of, np.arange(n_texts), "left")
                level = W.window_hashes(h, half)
                repeated = np.zeros(len(level), bool)
                repeated[np.repeat(first, np.diff(counts[row : row + n_texts + 1])) + flat[counts[row] : counts[row + n_texts]]] = True
                minimizer = _minimizer_of(level, span)
                at = np.flatnonzero(repeated[minimizer] & _starts_in(text_of, window)[: len(minimizer)])
                if not len(at):
                    continue
                key, own = level[minimizer[at]], W.window_hashes(W._mix(h ^ _SECOND), window)[at] | np.uint64(1)
                word, doc, variant = at - first[text_of[at]], ids[row + text_of[at]], variants[row + text_of[at]]
                # The leader of a content is its earliest window by (doc_id, word): one row of it is sent, wherever it stands.
                order = np.lexsort((word, doc))
                _, early = _first_of_each(W.join_hashes(key, own)[order])
                leader = np.empty(len(at), np.int64)
                leader[order] = order[early]
                later = (key == key[leader]) & (own == own[leader]) & ((doc > doc[leader]) | (doc == doc[leader]) & (word > word[leader]))
                own[later] = 0
                # Rows of windows to compare with other blocks: one for each minimizer.
                edge = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(minimizer[at]) != 0))))
                size = np.diff(np.concatenate((edge, [len(at)])))
                some = np.add.reduceat(own != 0, edge) > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(own.view(np.int64)))
                yield _window_batch(key[edge], doc[edge], variant[edge], word[edge], lists, np.zeros(len(edge), np.int32)).filter(pa.array(some))
                # Rows of windows that are known to repeat; their key only spreads them.
                done = np.flatnonzero(later)
                begin, length = _runs(at[done] + text_of[at[done]])  # a step more from text to text
                lead = done[begin] if len(done) else done
                empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(lead) + 1, np.int32)), pa.array([], pa.int64()))
                yield _window_batch(W._mix(own[lead] + key[lead] + at[lead].astype(np.uint64)), doc[lead], variant[lead], word[lead], empty, length.astype(np.int32))

    found = texts.join(anchored, _keys(texts))
    found = found.select("doc_id", _variant(found), "text", "anchors")
    return found.mapInArrow(run, "key bigint, doc_id bigint, variant int, at int, hashes array<bigint>, known int").select("key", *_keys(texts), "at", "hashes", "known")


def _window_batch(key, doc, variant, at, lists, known) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(doc), pa.array(variant), pa.array(at.astype(np.int32)), lists, pa.array(known)], names=["key", "doc_id", "variant", "at", "hashes", "known"]
    )


def _later_starts(rows: pa.Table) -> pa.RecordBatch:
    """(doc_id, variant, starts) of each row's windows that an equal one precedes; ``rows`` has all rows of its keys."""
    key, doc, at = (rows.column(c).to_numpy() for c in ("key", "doc_id", "at"))
    lists = rows.column("hashes").combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    own = lists.flatten().to_numpy(zero_copy_only=False)
    of_row = np.repeat(np.arange(len(key)), size)
    start = at[of_row] + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    held = np.flatnonzero(own)
    of_row, start, own = of_row[held], start[held], own[held]
    order = np.lexsort((start, doc[of_row], own, key[of_row]))
    k, o, d, s = key[of_row][order], own[order], doc[of_row][order], start[order]
    head = np.ones(len(k), bool)
    head[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(len(k)), 0)) if len(k) else np.zeros(0, np.int64)
    later = np.zeros(len(k), bool)
    later[order] = (d != d[first]) | (s != s[first])
    known = rows.column("known").to_numpy().astype(np.int64)
    extra = np.repeat(np.arange(len(key)), known)
    of_row = np.concatenate((of_row[later], extra))
    start = np.concatenate((start[later], at[extra] + np.arange(len(extra)) - np.repeat(np.cumsum(known) - known, known)))
    order = np.argsort(of_row, kind="stable")
    of_row, start = of_row[order], start[order]
    cut = np.flatnonzero(np.diff(of_row, prepend=-1))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate((cut, [len(of_row)])).astype(np.int32)), pa.array(start.astype(np.int32)))
    variant = rows.column("variant").to_numpy()
    return pa.RecordBatch.from_arrays([pa.array(doc[of_row[cut]]), pa.array(variant[of_row[cut]]), lists], names=["doc_id", "variant", "starts"])


#: Rows of windows compared at once; more if one key has more.
_COMPARED = 200_000


def _told_apart(docs: DataFrame) -> DataFrame:
    """The columns of ``numbered`` documents that tell them apart, and the text."""
    return docs.select("doc_id", *[F.col("_variant").alias("variant")] * ("_variant" in docs.columns), "text")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Return (doc_id, variant if there are some, starts array<int>): word positions of windows that an equal window precedes.

    ``docs``: as ``numbered`` returns them.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer: the earlier of two documents is that of the smaller one")
    docs = _told_apart(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).where("doc_id is not null")
    rows = _window_rows(docs.repartition(*_keys(docs)), _repeated_anchors(docs, window), window)

    @W.released
    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < _COMPARED:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            whole = np.flatnonzero(key != key[-1])
            end = int(whole[-1]) + 1 if len(whole) else 0
            if end:
                yield _later_starts(rows.slice(0, end))
            held = rows.slice(end).to_batches()
            size -= end
        if size:
            yield _later_starts(pa.Table.from_batches(held))

    sorted_rows = rows.repartition("key").sortWithinPartitions("key")
    later = sorted_rows.select("key", "doc_id", _variant(rows), "at", "hashes", "known").mapInArrow(run, "doc_id bigint, variant int, starts array<int>")
    return later.groupBy(*_keys(docs)).agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    mark = np.zeros(n_words + window + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + window, -1)
    return np.cumsum(mark)[:n_words] > 0


def _kept_rows(batches, window: int, text_out: bool):
    for batch in batches:
        starts_list = batch.column("starts")
        counts, gone, out = [], [], []
        for k, text in enumerate(batch.column("text")):
            words = (text.as_py() or "").encode().split()
            starts = starts_list[k].as_py()
            if starts:
                cover = _covered(len(words), np.array(starts, np.int64), window)
                kept = [w for w, c in zip(words, cover.tolist()) if not c]
            else:
                kept = words
            counts.append(len(words))
            gone.append(len(words) - len(kept))
            joined = b" ".join(kept)
            out.append((joined.decode() if gone[-1] else text.as_py()) if text_out else hashlib.sha256(joined).hexdigest())
        first = batch.column("row") if text_out else batch.column("doc_id")
        yield pa.RecordBatch.from_arrays(
            [first, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())],
            names=["row" if text_out else "doc_id", "n_words", "n_removed", "kept_text" if text_out else "kept_sha256"],
        )


def removal_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Return (doc_id, n_words, n_removed, kept_sha256) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = numbered(docs.select("doc_id", "text"))
    texts = _told_apart(held).where("doc_id is not null").repartition(*_keys(held))
    marked = texts.join(repeated_windows(held, window), _keys(held), "left")
    marked = marked.unionByName(docs.select("doc_id", "text").where("doc_id is null"), allowMissingColumns=True)
    return marked.select("doc_id", "text", "starts").mapInArrow(
        lambda batches: _kept_rows(batches, window, False), f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string"
    )


def drop_repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated words removed; documents that lose all their words are left out.

    A changed text has its kept words joined by one space and ``n_chars``, if there is one, set anew;
    other texts stay as they are, those without any word too.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row")
    packed = numbered(docs.select("doc_id", "text", row))
    marked = packed.withColumnRenamed("_variant", "variant").join(repeated_windows(packed, window), _keys(packed), "left").select("row", "text", "starts")
    kind = StructType([packed.schema["row"]]).add("n_words", LongType()).add("n_removed", LongType()).add("kept_text", StringType())
    out = marked.mapInArrow(lambda batches: _kept_rows(batches, window, True), kind)
    out = out.where("n_removed = 0 or n_removed < n_words")
    columns = {c: F.col(f"row.`{c}`") for c in names if c != "text"} | {"text": F.col("kept_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*[columns[c].alias(c) for c in names])
