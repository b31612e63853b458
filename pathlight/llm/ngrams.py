"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a bigram model with interpolated absolute discounting over add-one unigrams:
p(w | v) = max(c(vw) - D, 0) / c(v) + D T(v) / c(v) p(w), with c(v) the training tokens that follow v,
T(v) their kinds and p(w) = (c(w) + 1) / (N + V + 1). Each text begins in a start context and ends with
an end token. An unseen context has p(w | v) = p(w).

Spark shuffles n-grams by shard, not texts. A block of texts numbers its distinct tokens and pairs and
sends each of them once, with its training count; a token or pair that a third of all texts share is one
entry for each block. Pairs are sharded by their context, so a shard owns whole contexts: it merges the
counts of all blocks, builds its trie, and answers each block's pairs by a search among the successors
of their context. The answers, packed in the block's own order, meet the block's numbered texts.

A shard's trie has Elias-Fano levels in one buffer: its words and contexts (ascending hashes), pointers
from contexts to their successors (monotone), and the successors (monotone, as word numbers relative to
the context). Discounted probabilities and backoff weights are quantised to bins of equal population.
Levels are decoded a block at a time, the only part that is ever unpacked, and once for the pairs of many
text blocks together.

The documents are read twice in the same order: those that come out of a shuffle are materialised first.

Cases: null and empty texts have the end token alone; rows with a null doc_id train, as texts that
aren't held out; every row of repeated ids trains and is scored by itself; an empty table gives an empty
result; where there is nothing to learn from, every token has the add-one probability one; texts of any
length are taken whole; extra columns are ignored. Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .lineage import cut, in_fixed_order

DISCOUNT = 0.75
#: Bins of quantised probabilities; bin 0 is for what was never seen.
BINS = 4096
#: Bytes of text in a block, and for which there is one shard.
BLOCK_BYTES = 24 << 20
SHARD_BYTES = 8 << 20
HELD_OUT = 2

_END = np.uint64(0x5851F42D4C957F2D)
_START = np.uint64(0x14057B7EF767814F)
_STEP = 1 << 16
#: Pairs that are looked up together in a shard's trie: each look-up decodes its levels once.
LOOK_UP_PAIRS = 1 << 20


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_ascending(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


class EliasFano:
    """A monotone sequence: low bits in fixed bytes, high bits in unary, with a sample at every step."""

    def __init__(self, values: np.ndarray) -> None:
        n = self.n = len(values)
        bound = int(values[-1]) + 1 if n else 1
        self.low_bytes = min(7, max(0, (bound // max(n, 1)).bit_length() - 1) // 8)
        shift = np.uint64(8 * self.low_bytes)
        # Whole bytes of low bits keep every entry addressable; the rest is unary.
        high = values >> shift
        if n and int(high[-1]) > 64 * n + 64:
            self.low_bytes += 1
            shift += np.uint64(8)
            high = values >> shift
        high = high.astype(np.int64)
        self.low = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.low_bytes]).tobytes()
        bits = np.zeros((int(high[-1]) if n else 0) + n + 1, np.uint8)
        at = high + np.arange(n)
        bits[at] = 1
        self.upper = np.packbits(bits, bitorder="little").tobytes()
        self.first = values[::_STEP]
        self.place = at[::_STEP]

    def decode(self, step: int) -> np.ndarray:
        """The values of one step."""
        a, b = step * _STEP, min(self.n, (step + 1) * _STEP)
        start = int(self.place[step])
        stop = int(self.place[step + 1]) if step + 1 < len(self.place) else len(self.upper) * 8
        upper = np.frombuffer(self.upper, np.uint8)[start // 8 : stop // 8 + 1]
        ones = np.flatnonzero(np.unpackbits(upper, bitorder="little")[start % 8 :])[: b - a] + start
        low = np.zeros((b - a, 8), np.uint8)
        low[:, : self.low_bytes] = np.frombuffer(self.low, np.uint8).reshape(self.n, -1)[a:b] if self.low_bytes else 0
        return (ones - np.arange(a, b)).astype(np.uint64) << np.uint64(8 * self.low_bytes) | low.view("<u8").ravel()

    def values(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *map(self.decode, range(len(self.place)))])

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted value, -1 where it is absent; values may come in any order."""
        out = np.full(len(wanted), -1, np.int64)
        if not self.n or not len(wanted):
            return out
        order = np.argsort(wanted, kind="stable")
        ordered = wanted[order]
        bounds = np.concatenate((np.searchsorted(ordered, self.first, "left"), [len(ordered)]))
        for step in range(len(self.place)):
            part = ordered[bounds[step] : bounds[step + 1]]
            if len(part):
                own = self.decode(step)
                at = np.minimum(np.searchsorted(own, part), len(own) - 1)
                out[order[bounds[step] : bounds[step + 1]]] = np.where(own[at] == part, at + step * _STEP, -1)
        return out


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, codebook): bins of equal population, each with its mean in the logarithm; code 0 is zero."""
    book = np.zeros(BINS)
    codes = np.zeros(len(values), np.uint16)
    some = np.flatnonzero(values > 0)
    if len(some):
        logs = np.log(values[some])
        kinds, inverse, counts = np.unique(logs, return_inverse=True, return_counts=True)
        middle = np.cumsum(counts) - counts / 2
        own = np.arange(len(kinds)) if len(kinds) < BINS else (middle * (BINS - 1) // len(logs)).astype(np.int64)
        codes[some] = own[inverse] + 1
        weight = np.bincount(own, counts, BINS - 1)
        book[1:] = np.where(weight > 0, np.exp(np.bincount(own, counts * kinds, BINS - 1) / np.maximum(weight, 1)), 0)
    return codes, book


class Trie:
    """Contexts with their successors, from pairs (context hash, word hash, training count)."""

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> None:
        """Pairs in ascending order, each once, with positive counts."""
        words = np.unique(word)
        contexts, first = np.unique(context, return_index=True)
        pointer = np.concatenate((first, [len(context)]))
        total = np.add.reduceat(count, first) if len(first) else np.zeros(0)
        rank = np.repeat(np.arange(len(contexts)), np.diff(pointer))
        self.n_words = max(1, len(words))
        self.words, self.contexts, self.pointers = EliasFano(words), EliasFano(contexts), EliasFano(pointer.astype(np.uint64))
        relative = rank.astype(np.uint64) * np.uint64(self.n_words) + np.searchsorted(words, word).astype(np.uint64)
        self.successors = EliasFano(relative)
        self.seen, self.seen_book = quantise((count - DISCOUNT) / total[rank] if len(rank) else np.zeros(0))
        self.backoff, self.backoff_book = quantise(DISCOUNT * np.diff(pointer) / total if len(first) else np.zeros(0))

    def look_up(self, context: np.ndarray, sizes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(seen probability of each pair, backoff weight of each context); ``sizes``: pairs of each context."""
        sizes = sizes.astype(np.int64)
        rank = self.contexts.find(context)
        backoff = np.where(rank >= 0, self.backoff_book[self.backoff[np.maximum(rank, 0)]] if len(self.backoff) else 1.0, 1.0)
        of_pair = np.repeat(rank, sizes)
        number = self.words.find(word)
        known = np.flatnonzero((of_pair >= 0) & (number >= 0))
        at = self.successors.find(of_pair[known].astype(np.uint64) * np.uint64(self.n_words) + number[known].astype(np.uint64))
        seen = np.zeros(len(word))
        seen[known] = np.where(at >= 0, self.seen_book[self.seen[np.maximum(at, 0)]] if len(self.seen) else 0.0, 0.0)
        return seen, backoff


class Block:
    """Numbered tokens and pairs of a block of texts. Numbers ascend by (shard, hash)."""

    def __init__(self, hashes: list[np.ndarray], train: list[bool], shards: int) -> None:
        sizes = np.array([len(h) + 1 for h in hashes])
        flat = np.concatenate([x for h in hashes for x in (h, [_END])]).astype(np.uint64)
        kinds = np.unique(np.concatenate((flat, [_START])).astype(np.uint64))
        order = np.lexsort((kinds, kinds % np.uint64(shards)))
        self.tokens = kinds[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.sequence = place[np.searchsorted(kinds, flat)]
        self.start = int(place[np.searchsorted(kinds, _START)])
        self.bounds = np.concatenate(([0], np.cumsum(sizes)))
        self.used = np.repeat(np.array(train, bool), sizes)
        shard = (self.tokens % np.uint64(shards)).astype(np.int64)
        self.shard_bounds = np.searchsorted(shard, np.arange(shards + 1))

    def token_counts(self) -> np.ndarray:
        return np.bincount(self.sequence[self.used], minlength=len(self.tokens))


def pairs_of(sequence: np.ndarray, bounds: np.ndarray, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pairs context * n + word in ascending order, the pair of each token)."""
    context = np.concatenate(([start], sequence[:-1]))
    context[bounds[:-1]] = start
    return np.unique(context * n + sequence, return_inverse=True)


def _blocks(batches: Iterator[pa.RecordBatch], shards: int, block_bytes: int):
    """Yield (block id, Block, rows) with rows a list of record batches."""
    hashes, train, rows, size, digest = [], [], [], 0, xxhash.xxh3_64()

    def done():
        return np.uint64(digest.intdigest()).astype(np.int64), Block(hashes, train, shards), rows

    for batch in batches:
        used = batch.column("train").to_numpy(zero_copy_only=False)
        for row, data, offsets in W.text_blocks(batch.column("text")):
            digest.update(data)
            digest.update(offsets.tobytes())
            data = W.LOWER[data]
            starts, ends, text_of = W.split(data, offsets, W.SPACES)
            h = W.hash_words(data, starts, ends)
            n_texts = len(offsets) - 1
            hashes += np.split(h, np.searchsorted(text_of, np.arange(1, n_texts)))
            train += used[row : row + n_texts].tolist()
            rows.append(batch.slice(row, n_texts))
            size += len(data)
            if size >= block_bytes:
                yield done()
                hashes, train, rows, size, digest = [], [], [], 0, xxhash.xxh3_64()
    if rows:
        yield done()


def _entries(docs: DataFrame, shards: int, block_bytes: int) -> DataFrame:
    """(shard, block, tokens, counts, contexts, sizes, words, pair_counts): packed n-grams of each block."""

    @W.released
    def run(batches):
        for block, b, _ in _blocks(batches, shards, block_bytes):
            n = len(b.tokens)
            counts = b.token_counts()
            pairs, of_token = pairs_of(b.sequence, b.bounds, b.start, n)
            pair_counts = np.bincount(of_token[b.used], minlength=len(pairs))
            context, word = pairs // n, pairs % n
            for s in range(shards):
                low, high = b.shard_bounds[s], b.shard_bounds[s + 1]
                if low == high:
                    continue
                first, last = np.searchsorted(pairs, [low * n, high * n])
                sizes = np.bincount(context[first:last] - low, minlength=high - low)
                packed = (pack_ascending(b.tokens[low:high]), pack(counts[low:high]), pack(sizes), pack(b.tokens[word[first:last]]), pack(pair_counts[first:last]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)],
                    names=["shard", "block", "tokens", "counts", "sizes", "words", "pair_counts"],
                )

    return docs.mapInArrow(run, "shard int, block bigint, tokens binary, counts binary, sizes binary, words binary, pair_counts binary")


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat, weight = np.concatenate(keys), np.concatenate(counts)
    held = weight > 0
    kinds, inverse = np.unique(flat[held], return_inverse=True)
    return kinds, np.bincount(inverse, weight[held], len(kinds)).astype(np.int64)


def _together(held: list[dict[str, np.ndarray]]) -> Iterator[list[dict[str, np.ndarray]]]:
    """Blocks in their order, in groups of about LOOK_UP_PAIRS pairs."""
    group, size = [], 0
    for r in held:
        group.append(r)
        size += len(r["words"])
        if size >= LOOK_UP_PAIRS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _answer(rows: pa.Table) -> pa.Table:
    """A shard's answers to its blocks: token counts, seen probabilities and backoff weights."""
    held = [{c: unpack(r[c]) for c in ("counts", "sizes", "words", "pair_counts")} | {"tokens": unpack_ascending(r["tokens"])} for r in rows.select(["tokens", "counts", "sizes", "words", "pair_counts"]).to_pylist()]
    kinds, counts = _merge([r["tokens"] for r in held], [r["counts"] for r in held])
    context = np.concatenate([np.repeat(r["tokens"], r["sizes"].astype(np.int64)) for r in held])
    word = np.concatenate([r["words"] for r in held])
    count = np.concatenate([r["pair_counts"] for r in held]).astype(np.float64)
    some = count > 0
    context, word, count = context[some], word[some], count[some]
    order = np.lexsort((word, context))
    context, word, count = context[order], word[order], count[order]
    head = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])))) if len(context) else np.zeros(0, np.int64)
    trie = Trie(context[head], word[head], np.add.reduceat(count, head) if len(head) else count)
    out = []
    for group in _together(held):
        seen, backoff = trie.look_up(*(np.concatenate([r[c] for r in group]) for c in ("tokens", "sizes", "words")))
        of_pairs, of_tokens = (np.cumsum([len(r[c]) for r in group])[:-1] for c in ("words", "tokens"))
        for r, own_seen, own_backoff in zip(group, np.split(seen, of_pairs), np.split(backoff, of_tokens)):
            at = np.minimum(np.searchsorted(kinds, r["tokens"]), max(len(kinds) - 1, 0))
            own = np.where(kinds[at] == r["tokens"], counts[at], 0) if len(kinds) else np.zeros(len(r["tokens"]), np.int64)
            out.append((pack(own), _pack_codes(own_seen), _pack_codes(own_backoff)))
    n = np.zeros(len(out), np.int64)
    n[0] = len(kinds)
    return pa.table(
        {
            "shard": rows.column("shard"), "block": rows.column("block"), "counts": pa.array([x[0] for x in out], pa.binary()), "seen": pa.array([x[1] for x in out], pa.binary()),
            "backoff": pa.array([x[2] for x in out], pa.binary()), "kinds": pa.array(n), "tokens": pa.array([int(counts.sum()), *[0] * (len(out) - 1)], pa.int64()),
        }
    )


def _pack_codes(values: np.ndarray) -> bytes:
    """Quantised values as their codebook and the codes."""
    book, codes = np.unique(values, return_inverse=True)
    return len(book).to_bytes(4, "little") + book.tobytes() + pack(codes)


def _unpack_codes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(data, np.float64, n, 4)[unpack(data[4 + 8 * n :]).astype(np.int64)]


def _sequences(docs: DataFrame, shards: int, block_bytes: int) -> DataFrame:
    """(block, doc_id, train, start, sequence): numbered tokens of every text."""

    @W.released
    def run(batches):
        for block, b, rows in _blocks(batches, shards, block_bytes):
            at = 0
            for part in rows:
                n = part.num_rows
                packed = [pack(b.sequence[b.bounds[k] : b.bounds[k + 1]]) for k in range(at, at + n)]
                at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), part.column("doc_id"), part.column("train"), pa.array(np.full(n, b.start)), pa.array(packed, pa.binary())], names=["block", "doc_id", "train", "start", "sequence"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"block bigint, doc_id {kind}, train boolean, start bigint, sequence binary")


def score_documents(docs: DataFrame, train: F.Column, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Return (doc_id, train, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``train``: condition on the columns of ``docs`` for the texts to learn from.
    """
    docs = in_fixed_order(docs.select("doc_id", "text", F.coalesce(train, F.lit(True)).alias("train")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    entries = _entries(docs, shards, block_bytes)
    answers = cut(
        entries.groupBy("shard").applyInArrow(_answer, "shard int, block bigint, counts binary, seen binary, backoff binary, kinds bigint, tokens bigint")
    )
    n, v = (int(x or 0) for x in answers.agg(F.sum("tokens"), F.sum("kinds")).first())

    def finish(texts: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("shard")
        first = np.flatnonzero(np.diff(found.column("shard").to_numpy(), prepend=-1))  # blocks of equal texts answer alike
        found = found.take(pa.array(first))
        counts, seen, backoff = (
            np.concatenate([np.zeros(0), *(f(x.as_py()) for x in found.column(c))]) for c, f in (("counts", unpack), ("seen", _unpack_codes), ("backoff", _unpack_codes))
        )
        rows = [unpack(x.as_py()).astype(np.int64) for x in texts.column("sequence")]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
        sequence = np.concatenate(rows)
        start = texts.column("start")[0].as_py()
        pairs, of_token = pairs_of(sequence, bounds, start, len(counts))
        if len(pairs) != len(seen) or len(counts) != len(backoff):
            raise RuntimeError("a block of texts doesn't meet its answers: the documents change while they are read")
        plain = (counts + 1) / (n + v + 1)
        logs = np.log10(seen + backoff[pairs // len(counts)] * plain[pairs % len(counts)])
        add = lambda x: np.add.reduceat(x, bounds[:-1])
        return pa.table(
            {
                "doc_id": texts.column("doc_id"), "train": texts.column("train"), "n_tokens": np.diff(bounds), "n_known": add((counts[sequence] > 0).astype(np.int64)),
                "train_tokens": np.full(len(rows), n, np.int64), "base_score": add(np.log10(plain)[sequence]), "score": add(logs[of_token]),
            }
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = _sequences(docs, shards, block_bytes)
    result = f"doc_id {kind}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, result)


def score_report(docs: DataFrame) -> DataFrame:
    """Return (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == HELD_OUT
    scored = score_documents(docs, ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
