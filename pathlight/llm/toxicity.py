"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text. A text is cut into
windows of a few words; a window is toxic to the degree that it compresses better once the toxic
dictionary stands beside the ordinary one. The numbers of windows that gain at least so many bytes are
weighed by a logistic curve; weights and thresholds are calibrated on labelled rows that neither
dictionary has seen.

The labelled rows are grouped by their language for training, so that each language has dictionaries and
weights of its own. A score takes nothing but the text: a text goes to the language whose ordinary
dictionary compresses it best. A toxic dictionary is trained on what sets the toxic rows apart: the parts
of their words whose letter sequences are significantly more frequent among words of the language's toxic
rows than of its ordinary ones. Dictionaries and calibration use a bounded sample of labelled rows
(``SAMPLE_TOXIC``, ``SAMPLE_ORDINARY``, chosen by a hash of the id, none above ``SAMPLE_CHARS`` characters);
scoring covers all windows of all texts.

Cases: languages with few toxic rows, and texts without words, use a model of all languages; null and
empty texts have one empty window and get the score of a text without any gain; without labelled rows of
both kinds every score is the share of toxic labels; labels that are null are not used and repeated
labels of a document count as toxic if one of them is; a table without ``lang`` has one language; an empty
table gives an empty result; extra columns are kept by ``drop_toxic`` and ignored elsewhere.
"""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import words as W

#: Bounds of the labelled sample that the model is fitted on.
SAMPLE_TOXIC = 2_000
SAMPLE_ORDINARY = 6_000
SAMPLE_CHARS = 32_768
#: Bytes compressed at once to tell the language of a text.
CHUNK = 1_000
#: Words in a window, and from one window to the next.
WINDOW, STEP = 4, 2
THRESHOLD = 0.3
#: Bytes of the dictionaries.
ORDINARY_BYTES = 32_768
#: Tried for the toxic dictionary: bytes, and bytes of a segment.
TOXIC_BYTES, TOXIC_SEGMENTS = (1_024, 2_048, 4_096), (12, 16, 24, 32)
#: Lengths of the letter sequences that tell toxic words apart. So many toxic rows hold one; its likelihood ratio (as
#: chi-squared) and its share of a language's toxic words over its share of the ordinary ones are at least so large.
GRAMS, LEAST_ROWS, LEAST_LIKELIHOOD, LEAST_RATIO = (4, 5, 6, 7), 4, 20, 3
#: Toxic rows, and ordinary ones, that a language must have for a model of its own.
LEAST_TOXIC = 9
#: Gains in bytes at which windows are counted.
GAINS = (1, 2, 3, 4, 5, 6, 8)
LEVEL = 3


def windows(text: str | None) -> list[bytes]:
    """Windows of a text in lower case; one empty window if it has no words."""
    words = (text or "").lower().encode().split()
    return [b" %b " % b" ".join(words[i : i + WINDOW]) for i in range(0, max(1, len(words) - WINDOW + STEP), STEP)]


def _train(samples: list[bytes], size: int, segment: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(dict.fromkeys(samples))[:size]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=4, write_content_size=False, write_dict_id=False, write_checksum=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)


def _train_best(samples: list[bytes]) -> bytes:
    """The dictionary, of several sizes and segments, under which the samples are shortest."""
    if not samples:
        return b""
    tried = [_train(samples, size, segment) for size in TOXIC_BYTES for segment in TOXIC_SEGMENTS]
    return min(tried, key=lambda d: sum(len(c(x)) for c in [_compressor(d).compress] for x in samples))


def _toxic_parts(toxic: list[str], ordinary: list[str]) -> tuple[list[bytes], list[bytes]]:
    """For the toxic dictionary, the parts of words in toxic rows of a language that are made of sequences rarer in its
    ordinary rows; for the ordinary one, the ordinary rows without the few words that have such a sequence."""

    def words(text: str) -> list[str]:
        return [f" {w} " for w in sorted(set(text.lower().split()))]

    def grams(word: str) -> set[str]:
        return {word[i : i + n] for n in GRAMS for i in range(len(word) - n + 1)}

    def counted(texts: list[str], among: Counter | None = None) -> tuple[Counter, int]:
        held, found = Counter(w for t in texts for w in words(t)), Counter()
        for word, n in held.items():
            for g in grams(word):
                if among is None or g in among:
                    found[g] += n
        return found, held.total()

    here, n_here = counted(toxic)
    here = Counter({g: n for g, n in here.items() if n >= LEAST_ROWS})
    there, n_there = counted(ordinary, here)

    def is_strong(n: int, m: int) -> bool:
        share = (n + m) / (n_here + n_there)
        likelihood = 2 * (n * np.log(n / share / n_here) + (m * np.log(m / share / n_there) if m else 0))
        return n * n_there > LEAST_RATIO * (m + 0.5) * n_here and likelihood > LEAST_LIKELIHOOD

    strong = {g for g, n in here.items() if is_strong(n, there[g])}
    rows = Counter(g for t in toxic for g in {g for w in words(t) for g in grams(w) & strong})
    strong = {g for g in strong if rows[g] >= LEAST_ROWS}
    samples = []
    for text in toxic:
        parts = []
        for word in words(text):
            hits = [(i, i + n) for n in GRAMS for i in range(len(word) - n + 1) if word[i : i + n] in strong]
            if hits:
                parts.append(word[min(h[0] for h in hits) : max(h[1] for h in hits)].encode())
        if parts:
            samples.append(b" ".join(parts).center(8))  # the trainer passes over shorter samples
    return samples, [" ".join(w for w in t.lower().split() if strong.isdisjoint(grams(f" {w} "))).encode() for t in ordinary]


class Model:
    """Dictionaries, and the weights of the logistic curve."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.ordinary, self.toxic = ordinary, toxic
        self.weights, self.mean, self.scale = None, None, None

    def features(self, texts: list[str | None]) -> np.ndarray:
        plain, both = _compressor(self.ordinary).compress, _compressor(self.ordinary + self.toxic).compress
        rows = []
        for text in texts:
            cut = windows(text)
            gain = np.fromiter((len(plain(w)) - len(both(w)) for w in cut), np.int64, len(cut))
            counts = np.array([(gain >= g).sum() for g in GAINS])
            rows.append(np.concatenate((np.log1p(counts), np.log1p(1000 * counts / len(cut)), [np.log(len(cut)), gain.max()])))
        return np.array(rows).reshape(-1, 2 * len(GAINS) + 2)

    def calibrate(self, texts: list[str], labels: np.ndarray, ridge: float = 1.0, steps: int = 30) -> None:
        x = self.features(texts)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = np.hstack(((x - self.mean) / self.scale, np.ones((len(x), 1))))
        w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (p - labels) + penalty @ w
            w -= np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, slope)
        self.weights = w

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.hstack(((self.features(texts) - self.mean) / self.scale, np.ones((len(texts), 1))))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _fit(parts: list[bytes], plain: list[bytes], toxic: list[str], ordinary: list[str]) -> Model:
    """Train dictionaries and calibrate on the rows that they are not trained on."""
    (_, toxic_rest), (_, plain_rest) = _thirds(toxic), _thirds(ordinary)
    model = Model(_train(plain, ORDINARY_BYTES, 64), _train_best(parts))
    model.calibrate(toxic_rest + plain_rest, np.array([1.0] * len(toxic_rest) + [0.0] * len(plain_rest)))
    return model


def _thirds(rows: list) -> tuple[list, list]:
    """Two thirds of the rows for dictionaries, all others for calibration."""
    return [x for i, x in enumerate(rows) if i % 3], [x for i, x in enumerate(rows) if i % 3 == 0]


def fit(rows: list[tuple[str | None, str, int]]) -> dict[str | None, Model] | None:
    """Models by language of labelled rows (lang, text, toxic), that of all languages under None; None without rows of both kinds."""
    kinds = lambda held: tuple([text for _, text, label in held if label == k] for k in (1, 0))
    toxic, ordinary = kinds(rows)
    if not toxic or not ordinary:
        return None
    models: dict[str | None, Model] = {}
    all_parts, all_plain = [], []
    langs = sorted({r[0] for r in rows if r[0] is not None}) + [None] * any(r[0] is None for r in rows)
    for lang in langs:
        own_toxic, own_ordinary = kinds([r for r in rows if r[0] == lang])
        parts, plain = _toxic_parts(_thirds(own_toxic)[0] or own_toxic, _thirds(own_ordinary)[0] or own_ordinary)
        all_parts += parts
        all_plain += plain
        if lang is not None and parts and len(own_toxic) >= LEAST_TOXIC and len(own_ordinary) >= LEAST_TOXIC:
            models[lang] = _fit(parts, plain, own_toxic, own_ordinary)
    models[None] = _fit(all_parts, all_plain, toxic, ordinary)
    return models


def route(models: dict[str | None, Model], texts: list[str | None]) -> list[str | None]:
    """For each text the language whose ordinary dictionary compresses it best; None if it has no words or no
    language has a model of its own."""
    ordinary = {lang: _compressor(m.ordinary).compress for lang, m in models.items() if lang is not None}
    out = []
    for text in texts:
        data = (text or "").lower().encode()
        parts = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)] if ordinary and data.strip() else []
        out.append(min(ordinary, key=lambda x: sum(len(ordinary[x](p)) for p in parts)) if parts else None)
    return out


def score(models: dict[str | None, Model], texts: list[str | None]) -> np.ndarray:
    """Scores of texts by the models of the languages that they compress to."""
    out, at = np.zeros(len(texts)), {}
    for i, lang in enumerate(route(models, texts)):
        at.setdefault(lang, []).append(i)
    for lang, held in at.items():
        out[held] = models[lang].score([texts[i] for i in held])
    return out


def is_held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit_on(docs: DataFrame, labels: DataFrame) -> tuple[dict[str | None, Model] | None, float]:
    """Fit on a bounded sample of labelled documents that aren't held out; also their share of toxic labels."""
    known = labels.where("toxic is not null and doc_id is not null").where(~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = known.agg(F.avg("toxic"), F.count("*")).first()
    picked = None
    for value, bound in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY)):
        some = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        picked = some if picked is None else picked.unionByName(some)
    lang = (F.col("lang") if "lang" in docs.columns else F.lit("")).cast("string").alias("_lang")
    rows = docs.select("doc_id", "text", lang).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "_lang", "toxic").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([(r["_lang"], r["text"], r["toxic"]) for r in rows]), float(shares[0] or 0.0)


def score_documents(docs: DataFrame, labels: DataFrame, keep_row: bool = False) -> DataFrame:
    """Return (doc_id, score) of every document; with ``keep_row`` (row, score), row being the whole document."""
    models, share = fit_on(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(models))
    first = "row" if keep_row else "doc_id"
    source = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if keep_row else docs.select("doc_id", "text")

    @W.released
    def run(batches):
        own = pickle.loads(held.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = score(own, texts) if own is not None and texts else np.full(len(texts), share)
            yield pa.RecordBatch.from_arrays([batch.column(first), pa.array(scores, pa.float64())], names=[first, "score"])

    return source.mapInArrow(run, f"{first} {source.schema[first].dataType.simpleString()}, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Return (doc_id, held_out, score, predicted)."""
    scored = score_documents(docs, labels)
    return scored.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    return score_documents(docs, labels, keep_row=True).where(F.col("score") < THRESHOLD).select("row.*")
