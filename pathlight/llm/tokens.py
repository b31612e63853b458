"""Token counts by a map-side two-tier lookup.

Tier one is a table from frequent pre-tokens to their numbers of tokens: the pre-tokens that the vocabulary
holds whole, and the most frequent ones of a bounded sample of texts (chosen by a hash of the text). It is
broadcast compactly, as compressed names and one byte for each length, and becomes a hash table once in a
worker. Tier two encodes the pre-tokens that miss it and keeps their lengths in a bounded cache, which
belongs to the worker and the model and outlives a task. Pre-tokens are never shuffled, and neither table
changes a count.

Texts whose characters stand before U+0250 or are general punctuation are cut into pre-tokens by the
tokenizer's own pattern as a regular expression, where that is known to agree with the library; other
scripts by the library's pre-tokenizer. Only a text that holds one of the special strings is encoded by
the library as a whole.

Cases: null and empty texts have no tokens; texts of any length are taken whole; rows may repeat and ids
may be null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import pickle
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from . import words as W

LIMIT = 2048
#: Bounds: rows of the sample and characters of one, entries of the broadcast table and of a worker's cache.
SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 32_768
TABLE_ENTRIES = 131_072
CACHE_ENTRIES = 500_000

_KNOWN = regex.compile(r"[\x00-\x1B\x20-ɏ‐-‧‰-⁞€]*")
_PLAIN = regex.compile(r"[\x00-\x1B\x20-\x7FÀ-ÖØ-öø-ÿ]*")


class TokenCounter:
    """Counts tokens of texts for a tokenizer whose pre-tokens are encoded one by one."""

    def __init__(self, model: str) -> None:
        spec = json.loads(model)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"]:
            raise ValueError("the pre-tokenizer isn't one that keeps the matches of a pattern")
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.whole = [w[: -len(self.suffix)] for w in spec["model"]["vocab"] if self.suffix and w.endswith(self.suffix)]

    def pretokens(self, text: str) -> list[str] | None:
        """The pre-tokens, or None for a text with a special string, which the library cuts in its own way."""
        if any(s in text for s in self.special):
            return None
        if not _KNOWN.fullmatch(text):
            text = self.tokenizer.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        # Letters of this range have one lower-case character each, whatever stands beside them.
        text = text.lower() if _PLAIN.fullmatch(text) else self.tokenizer.normalizer.normalize_str(text)
        return self.pattern.findall(text)

    def lengths(self, pretokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pretokens, add_special_tokens=False)]

    def whole_text(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


class LengthTable:
    """Pre-tokens and their lengths, packed for the broadcast; lengths over 255 are left out."""

    def __init__(self, pretokens: list[str], lengths: list[int]) -> None:
        held = [(p, n) for p, n in zip(pretokens, lengths) if n <= 255]
        names = [p.encode() for p, _ in held]
        self.sizes = np.array([len(p) for p in names], np.uint16).tobytes()
        self.lengths = bytes(n for _, n in held)
        self.names = zstandard.ZstdCompressor(level=9).compress(b"".join(names))

    def pack(self) -> bytes:
        return pickle.dumps((self.names, self.sizes, self.lengths))


@lru_cache(maxsize=2)
def _counter(model: str) -> TokenCounter:
    return TokenCounter(model)


# These live in the module, which a worker imports once, and not in the function that a task unpickles.
@lru_cache(maxsize=2)
def _frequent(packed: bytes) -> dict[str, int]:
    """The hash table of a packed table."""
    names, sizes, lengths = pickle.loads(packed)
    data = zstandard.ZstdDecompressor().decompress(names)
    ends = np.cumsum(np.frombuffer(sizes, np.uint16), dtype=np.int64).tolist()
    return {data[a:b].decode(): n for a, b, n in zip([0, *ends], ends, lengths)}


@lru_cache(maxsize=2)
def _cache(model: str) -> dict[str, int]:
    """The worker's cache of a model's pre-token lengths."""
    return {}


def frequent_table(docs: DataFrame, model: str) -> LengthTable:
    """The table of tier one; its sample is bounded and chosen by a hash of the text."""
    counter = _counter(model)
    seen: Counter = Counter()
    size = docs.count()
    modulus = max(1, size // SAMPLE_ROWS)
    some = F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS) & (F.pmod(F.xxhash64("text"), F.lit(modulus)) == 0)
    rows = docs.select("text").where(some).orderBy(F.xxhash64("text")).limit(SAMPLE_ROWS)
    for row in rows.toLocalIterator():
        seen.update(counter.pretokens(row["text"]) or ())
    names = dict.fromkeys(p for p, _ in seen.most_common(TABLE_ENTRIES))
    for p in counter.whole:
        if len(names) >= TABLE_ENTRIES:
            break
        if p.isascii() and counter.pretokens(p) == [p]:
            names.setdefault(p)
    return LengthTable(list(names), counter.lengths(list(names)))


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """Return (doc_id, n_bytes, n_tokens) of every document, as the library for the model file counts."""
    with open(model_path) as f:
        model = f.read()
    held = docs.sparkSession.sparkContext.broadcast((model, frequent_table(docs, model).pack()))

    @W.released
    def run(batches):
        model, packed = held.value
        counter, frequent, cache = _counter(model), _frequent(packed), _cache(model)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            totals = np.zeros(len(texts), np.int64)
            waiting: list[tuple[int, list[str]]] = []
            missing: dict[str, None] = {}

            def settle():
                if missing:
                    names = list(missing)
                    if len(cache) + len(names) > CACHE_ENTRIES:
                        cache.clear()
                    own = dict(zip(names, counter.lengths(names)))
                    for at, tokens in waiting:
                        totals[at] += sum([own[t] for t in tokens])
                    if len(names) <= CACHE_ENTRIES:
                        cache.update(own)
                    missing.clear()
                waiting.clear()

            for at, text in enumerate(texts):
                found = counter.pretokens(text)
                if found is None:
                    totals[at] = counter.whole_text(text)
                    continue
                first = [frequent.get(t) for t in found]
                if None in first:
                    late = [t for t, n in zip(found, first) if n is None]
                    second = [cache.get(t) for t in late]
                    if None in second:
                        absent = [t for t, n in zip(late, second) if n is None]
                        missing.update(dict.fromkeys(absent))
                        waiting.append((at, absent))
                        second = [n for n in second if n is not None]
                    totals[at] += sum(second)
                    first = [n for n in first if n is not None]
                totals[at] += sum(first)
                if len(missing) > 50_000:
                    settle()
            settle()
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(totals)], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")


def token_report(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """Return (doc_id, n_bytes, n_tokens, over_limit)."""
    return count_tokens(docs, model_path).withColumn("over_limit", F.col("n_tokens") > limit)
