"""Language identification by a linear-chain conditional random field over the words of a text.

Words are runs of letters. A word's features are its letter n-grams between boundary marks (those with a
mark are its affixes), hashed into one weight table, and the lexicons that hold it. Labels are the learned
languages; transitions between the labels of neighbouring words are weights like the others. Forward-backward
gives each word the probability of each language, so code-switched text is labelled word by word
(``label_words``); a text's language is the one with the largest mean probability over its words.

Training maximises the conditional likelihood of labelled sequences. Documents carry one label, which all
their words get; half of the training sequences are spliced from sequences of several languages, so that
transitions are learned too. The sample is bounded: ``SAMPLE_ROWS`` texts shared out evenly among the languages
(at least ``LEAST_ROWS`` each), distinct texts of least hash, each giving at most ``SAMPLE_SEQUENCES`` sequences
of ``SEQUENCE`` words spread evenly over the whole of it. Half of the sampled texts make the lexicons, the other
half fits the weights, so that lexicon weights hold for texts that the lexicons haven't seen.

Forward-backward over a block of texts is exact and has no loop over the words of a text: texts are cut into
segments, transfer matrices of all segments are multiplied up side by side, the states at segment borders follow
from them text by text, and the inner states from those. Its memory depends on the block, its steps on the longest
text over the segment's length.

Cases: a text that is null or has no letter is ``und`` with score 0; so are all texts where nothing can be
learned; rows with null text, lang or id aren't learned from; a null id isn't held out; repeated rows are
judged alike and learned from once; ties go to the smaller language; an empty table gives an empty result;
extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from . import words as W

#: Bounds of the sample that the field is fitted on.
SAMPLE_ROWS, LEAST_ROWS, SAMPLE_SEQUENCES, SEQUENCE = 1_600, 60, 8, 32
#: Lengths of the n-grams, boundary marks included; rows of the weight table.
GRAMS, TABLE = (2, 3, 4, 5), 1 << 17
#: Times that a word must stand in a language's half of the sample to be in its lexicon.
LEXICON_COUNT = 2
#: Share of words at which a spliced sequence turns to another text.
SPLICE = 0.12
STEPS, RATE, DECAY = 60, 0.1, 1e-3
#: Words of a segment; bytes of text handled at once with four languages.
SEGMENT, BLOCK_BYTES = 64, 2 << 20
UNKNOWN = "und"
_NOT_LETTER = W.byte_set((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_MARK = 0x20


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def gram_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, rows): the table row of each n-gram that begins at each byte of the marked words, by length; rows of
    n-grams that would leave their word are TABLE. ``starts`` are the words' first bytes."""
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    data = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(len(data))  # bytes left in the word
    rows = np.full((len(GRAMS), len(data)), TABLE, np.int32)
    h = data + np.uint64(1)
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint64(0x100000001B3) + data[n - 1 :] + np.uint64(1)
        if n in GRAMS and len(h):
            mixed = (W._mix(h + np.uint64(n)) & np.uint64(TABLE - 1)).astype(np.int32)
            rows[GRAMS.index(n), : len(h)] = np.where(room[: len(h)] >= n, mixed, TABLE)
    return ends - sizes, rows


class Field:
    """Weights of the random field."""

    def __init__(self, labels: list[str], lexicon: dict[bytes, np.ndarray]) -> None:
        n = len(labels)
        self.labels = labels
        self.lexicon = lexicon
        self.table = np.zeros((TABLE + 1, n), np.float32)
        self.lexical = np.zeros((n + 1, n))
        self.transitions = np.zeros((n, n))
        self.start = np.zeros(n)

    def membership(self, words: list[bytes]) -> np.ndarray:
        """The lexicons that hold each word; the last column says that none does."""
        none = np.zeros(len(self.labels) + 1)
        none[-1] = 1
        return np.array([self.lexicon.get(w, none) for w in words]).reshape(-1, len(none))

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Scores of each word's labels."""
        starts, rows = gram_rows(words)
        sums = self.table[rows[0]]
        for more in rows[1:]:
            sums += self.table[more]
        return np.add.reduceat(sums, starts, axis=0).astype(np.float64) + self.membership(words) @ self.lexical


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1e-300)


def marginals(field: Field, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Label probabilities of each word by forward-backward; ``scores`` of the words of consecutive texts of
    ``lengths`` (none of them 0)."""
    n = scores.shape[1]
    step, first = np.exp(field.transitions - field.transitions.max()), np.exp(field.start - field.start.max())
    per_text = -(-lengths // SEGMENT)
    text_of = np.repeat(np.arange(len(lengths)), per_text)
    rank = np.arange(len(text_of)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = np.repeat(np.cumsum(lengths) - lengths, per_text) + rank * SEGMENT
    size = np.minimum(SEGMENT, np.repeat(lengths, per_text) - rank * SEGMENT)
    place = begin[:, None] + np.arange(SEGMENT)
    inside = np.arange(SEGMENT) < size[:, None]
    local = np.exp(scores - scores.max(1, keepdims=True))[np.minimum(place, len(scores) - 1)]  # segment, word, label

    # What a segment does to the state before it, as a matrix.
    transfer = np.broadcast_to(np.eye(n), (len(rank), n, n)).copy()
    for k in range(SEGMENT):
        moved = transfer @ step
        if k == 0:
            moved[rank == 0] = np.eye(n)
        moved *= local[:, k, None, :]
        moved /= moved.max((1, 2), keepdims=True)
        transfer = np.where(inside[:, k, None, None], moved, transfer)
    before, after = np.empty((len(rank), n)), np.ones((len(rank), n))
    by_rank = np.argsort(rank, kind="stable")
    cuts = np.searchsorted(rank[by_rank], np.arange(rank.max() + 2))
    groups = [by_rank[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    before[groups[0]] = first
    for here in groups[1:]:
        before[here] = _normal(np.einsum("si,sij->sj", before[here - 1], transfer[here - 1]))
    for here in reversed(groups[1:]):
        after[here - 1] = _normal(np.einsum("sij,sj->si", transfer[here], after[here]))

    forward = np.empty(local.shape)
    state = before
    for k in range(SEGMENT):
        moved = state @ step
        if k == 0:
            moved[rank == 0] = state[rank == 0]
        moved = _normal(moved * local[:, k])
        state = np.where(inside[:, k, None], moved, state)
        forward[:, k] = state
    # A segment's end sees the next segment's first transition within that segment's matrix.
    state = after
    for k in range(SEGMENT - 1, -1, -1):
        forward[:, k] *= state
        moved = _normal((state * local[:, k]) @ step.T)
        state = np.where(inside[:, k, None], moved, state)
    return _normal(forward[inside])


def _gradient(field: Field, x: np.ndarray, y: np.ndarray, scores: np.ndarray):
    """Of the negative log likelihood of sequences ``x`` (indices into ``scores``) with labels ``y``: the gradients of
    scores, transitions and start."""
    n = scores.shape[1]
    step, local = np.exp(field.transitions), np.exp(scores - scores.max(1, keepdims=True))[x]
    alpha = np.empty(local.shape)
    state = _normal(np.exp(field.start) * local[:, 0])
    alpha[:, 0] = state
    for k in range(1, x.shape[1]):
        alpha[:, k] = state = _normal((state @ step) * local[:, k])
    beta, moves = np.ones((len(x), n)), np.zeros((n, n))
    d_scores = np.zeros(scores.shape)
    for k in range(x.shape[1] - 1, -1, -1):
        post = _normal(alpha[:, k] * beta)
        post[np.arange(len(x)), y[:, k]] -= 1
        for j in range(n):
            d_scores[:, j] += np.bincount(x[:, k], post[:, j], len(scores))
        if k:
            right = local[:, k] * beta
            both = alpha[:, k - 1, :, None] * step * right[:, None, :]
            moves += (both / both.sum((1, 2), keepdims=True)).sum(0)
            np.add.at(moves, (y[:, k - 1], y[:, k]), -1)
            beta = _normal(right @ step.T)
        else:
            d_start = post.sum(0)
    return d_scores, moves, d_start


class _Adam:
    def __init__(self, x: np.ndarray) -> None:
        self.x, self.m, self.v, self.t = x, np.zeros(x.shape, x.dtype), np.zeros(x.shape, x.dtype), 0

    def move(self, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient**2 - self.v)
        self.x -= RATE * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def fit(texts: list[tuple[str, int, list[list[bytes]]]]) -> Field | None:
    """Fit on (language, hash of the text, sequences of words)."""
    labels = sorted({lang for lang, _, parts in texts if parts})
    if not labels:
        return None
    texts = sorted(((labels.index(lang), h, parts) for lang, h, parts in texts if parts), key=lambda t: t[:2])
    half = np.zeros(len(texts), bool)  # every other text of a language makes the lexicon
    half[1::2] = True
    counts: dict[bytes, np.ndarray] = {}
    for (label, _, parts), own in zip(texts, half):
        for part in parts if own else ():
            for word in part:
                counts.setdefault(word, np.zeros(len(labels), np.int64))[label] += 1
    lexicon = {w: np.append((c >= LEXICON_COUNT).astype(float), 0.0) for w, c in counts.items() if c.max() >= LEXICON_COUNT}
    field = Field(labels, lexicon)
    rows = [(label, part) for (label, _, parts), own in zip(texts, half) for part in parts if not own or not half.any()]
    seen: dict[bytes, int] = {}
    x = np.full((len(rows), SEQUENCE), -1, np.int64)
    for k, (_, part) in enumerate(rows):
        whole = (part * -(-SEQUENCE // len(part)))[:SEQUENCE]  # short texts go round
        x[k] = [seen.setdefault(w, len(seen)) for w in whole]
    y = np.repeat(np.array([label for label, _ in rows])[:, None], SEQUENCE, 1)
    rng = np.random.default_rng(0)
    part_of = np.cumsum(rng.random(x.shape) < SPLICE, 1)
    source = rng.integers(0, len(x), (len(x), SEQUENCE + 1))[np.arange(len(x))[:, None], part_of]
    column = np.arange(SEQUENCE)
    x, y = np.concatenate([x, x[source, column]]), np.concatenate([y, y[source, column]])

    words, n = list(seen), len(labels)
    starts, grams = gram_rows(words)
    owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, grams.shape[1])))
    used, rank = np.unique(grams, return_inverse=True)
    rank = rank.reshape(grams.shape)
    member = field.membership(words)
    weights = [_Adam(np.zeros((len(used), n))), _Adam(field.lexical), _Adam(field.transitions), _Adam(field.start)]
    real = (used < TABLE)[:, None]
    for _ in range(STEPS):
        sums = sum(weights[0].x[r] for r in rank)
        scores = np.add.reduceat(sums, starts, axis=0) + member @ field.lexical
        d_scores, d_moves, d_start = _gradient(field, x, y, scores)
        d_table = np.zeros((len(used), n))
        for j in range(n):
            spread = d_scores[owner, j]
            for r in rank:
                d_table[:, j] += np.bincount(r, spread, len(used))
        weights[0].move(real * (d_table / len(x) + DECAY * weights[0].x))
        weights[1].move(member.T @ d_scores / len(x) + DECAY * field.lexical)
        weights[2].move(d_moves / len(x) + DECAY * field.transitions)
        weights[3].move(d_start / len(x) + DECAY * field.start)
    field.table[used] = weights[0].x
    return field


def is_held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _sequences(docs: DataFrame) -> DataFrame:
    """(_lang, _h, words): sequences of words spread over each text, joined by spaces."""

    def run(batches):
        for batch in batches:
            langs, hashes, found = [], [], []
            for lang, h, text in zip(batch.column("_lang").to_pylist(), batch.column("_h").to_pylist(), lowered(batch.column("text")).to_pylist()):
                words = [w for part in W.lists_of_words(text, W.word_table(_NOT_LETTER)) for w in part]
                n = min(SAMPLE_SEQUENCES, -(-len(words) // SEQUENCE))
                for k in range(n):
                    at = k * (len(words) - SEQUENCE) // max(1, n - 1) if len(words) > SEQUENCE else 0
                    langs.append(lang)
                    hashes.append(h)
                    found.append(b" ".join(words[at : at + SEQUENCE]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(hashes, pa.int64()), pa.array(found, pa.string())], names=["_lang", "_h", "words"])

    return docs.select("_lang", "_h", "text").mapInArrow(run, "_lang string, _h bigint, words string")


def fit_on(docs: DataFrame, train=None) -> Field | None:
    """Fit on a bounded sample of the rows that satisfy ``train`` (all with a text, lang and id by default)."""
    rows = docs.select("text", F.col("lang").cast("string").alias("_lang"), F.coalesce(~is_held_out() if train is None else train, F.lit(False)).alias("_train"))
    rows = rows.where("_train and text is not null and _lang is not null").select("_lang", "text", F.xxhash64("text").alias("_h"))
    sizes = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}
    if not sizes:
        return None
    each = max(LEAST_ROWS, SAMPLE_ROWS // len(sizes))
    # A hash range with several times the wanted texts goes on, so that what is dealt out doesn't grow with the table.
    limits = docs.sparkSession.createDataFrame([(lang, min(1 << 20, -(-(each * 8 << 20) // n))) for lang, n in sizes.items()], "_lang string, _limit bigint")
    near = rows.join(F.broadcast(limits), "_lang").where(F.pmod("_h", F.lit(1 << 20)) < F.col("_limit"))
    once = near.groupBy("_lang", "_h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.pmod("_h", F.lit(1 << 20)), "_h"))
    picked = once.withColumn("_place", place).where(F.col("_place") <= each)
    texts: dict[tuple[str, int], list[list[bytes]]] = {}
    for r in _sequences(picked).collect():
        texts.setdefault((r["_lang"], r["_h"]), []).append(r["words"].encode().split())
    return fit([(lang, h, sorted(parts)) for (lang, h), parts in texts.items()])


def tag_blocks(field: Field, column: pa.Array) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of rows: (rows, distinct words, word of each place, number of words of each row, probabilities)."""
    limit = max(1 << 16, 4 * BLOCK_BYTES // max(4, len(field.labels)))
    for _, data, offsets in W.text_blocks(lowered(column), limit):
        starts, ends, text_of = W.split(data, offsets, _NOT_LETTER)
        lengths = np.bincount(text_of, minlength=len(offsets) - 1)
        if not len(starts):
            yield len(lengths), [], text_of, lengths, np.zeros((0, len(field.labels)))
            continue
        _, first, word_of = np.unique(W.hash_words(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        scores = field.emissions(words)[word_of]
        yield len(lengths), words, word_of, lengths, marginals(field, scores, lengths[lengths > 0])


def _letters(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    some = pc.fill_null(pc.match_substring_regex(column.cast(pa.large_string()), r"\p{L}"), False)
    return some.to_numpy(zero_copy_only=False).astype(bool)


def predict(field: Field | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    langs, scores = [UNKNOWN] * len(column), np.zeros(len(column))
    if field is None or not len(column):
        return langs, scores
    letters, at = _letters(column), 0
    for rows, _, _, lengths, chances in tag_blocks(field, column):
        held = np.flatnonzero(lengths)
        if len(held):
            bounds = np.cumsum(lengths[held]) - lengths[held]
            mean = np.add.reduceat(chances, bounds, axis=0) / lengths[held, None]
            for k, best, score in zip((held + at).tolist(), mean.argmax(1).tolist(), mean.max(1).tolist()):
                if letters[k]:
                    langs[k], scores[k] = field.labels[best], min(1.0, score)
        at += rows
    return langs, scores


def label_words(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, words array<struct<word, lang, chance>>) of every document: the language of each word (in lower case)."""
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(field))
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("chance", pa.float64())]))

    @W.released
    def run(batches):
        own = pickle.loads(held.value)
        for batch in batches:
            at = 0
            for rows, words, word_of, lengths, chances in tag_blocks(own, batch.column("text")):
                told = [{"word": words[w].decode(), "lang": own.labels[b], "chance": c} for w, b, c in zip(word_of.tolist(), chances.argmax(1).tolist() if len(chances) else [], chances.max(1).tolist() if len(chances) else [])]
                ends = np.cumsum(lengths)
                parts = [told[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, rows), pa.array(parts, kind)], names=["doc_id", "words"])
                at += rows

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_kind}, words array<struct<word:string,lang:string,chance:double>>")


def language_report(docs: DataFrame) -> DataFrame:
    """Return (doc_id, held_out, lang_pred, score)."""
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fit_on(docs)))

    @W.released
    def run(batches):
        field = pickle.loads(held.value)
        for batch in batches:
            langs, scores = predict(field, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
