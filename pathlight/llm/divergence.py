"""Divergence of sources within a language, by the terms that set them apart.

Texts are counted in blocks, one row for each (lang, source, term) and block, and summed. Each language
keeps the terms that stand in at least ``LEAST_DOCUMENTS`` of its documents, each as its sparse vector of
counts by source. Terms with the same vector are one column: every pair of sources is evaluated once for
each distinct vector, times the number of its terms. Ranking goes over the terms themselves.

A term's share is p = 1 + floor(10^9 * (count + 2) / (N + 2 V)), N being the sum of counts of the kept terms
and V their number; two shares differ by floor((p - q)^2 / (p + q)). All arithmetic is on integers: the
division takes three steps of 10^3, so that no product leaves 64 bits while N + 2 V is below 9 * 10^15.

Scale: a common term has one row for each block and is summed before its sources meet, at most one row
for each source of the language then. Groups (lang, source) are collected to the driver for the pairs:
with K of them in a language the result has K (K - 1) rows by contract, so they are at most about the
square root of the result. No pair of documents or of terms is ever formed.

Cases: null text, lang or source is the empty string; a document is a row, so repeated rows count; groups
without terms have a row for every other source of their language; a language without kept terms has pairs
of value 0 and no terms; a language of one source has no pairs; ties of terms or sources go by their UTF-8 bytes;
an empty table gives an empty result; extra columns are ignored. Long texts are split a megabyte at a time.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import words as W
from .lineage import cut

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
SCALE_STEPS = (1000, 1000, 1000)
SMOOTH = 2
#: Separators of the terms [^\x00-\x40\x5B-\x60\x7B-\x7F]+
_NOT_TERM = W.byte_set((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_TABLE = W.word_table(_NOT_TERM)
#: Terms of a block's counters; vectors evaluated at once; values held for them.
BLOCK_TERMS = 250_000
_VECTORS = 4096
_CELLS = 1 << 22


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and the documents that hold it."""

    def emptied(held: dict) -> pa.RecordBatch:
        langs, sources, terms, n, in_docs = [], [], [], [], []
        for (lang, source), (counts, documents) in held.items():
            langs += [lang] * len(counts)
            sources += [source] * len(counts)
            terms += counts.keys()
            n += counts.values()
            in_docs += [documents[t] for t in counts]
        held.clear()
        text = lambda x: pa.array(x, pa.string())
        return pa.RecordBatch.from_arrays([text(langs), text(sources), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(in_docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    @W.released
    def run(batches):
        held, size = {}, 0
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, batch.column("text")):
                counts, documents = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(counts), set()
                for words in W.lists_of_words(text.as_py(), _TABLE):
                    counts.update(words)
                    own.update(words)
                documents.update(own)
                size += len(counts) - before
                if size > BLOCK_TERMS:
                    yield emptied(held)
                    size = 0
        yield emptied(held)

    parts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    rows = parts.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, vector array<struct<source, n>>) of the terms in at least ``least`` documents of a language."""
    vectors = count_terms(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return vectors.where(F.col("docs") >= least).select("lang", "term", "vector")


def source_groups(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(lang, source, n, n_lang, v) of every occurring group, from the distinct ``vectors`` (lang, vector, terms)."""
    here = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    entry = vectors.select("lang", "terms", F.explode("vector").alias("e"))
    sums = entry.groupBy("lang", F.col("e.source").alias("source")).agg(F.sum(F.col("e.n") * F.col("terms")).alias("n"))
    langs = vectors.groupBy("lang").agg(F.sum("terms").alias("v"), F.sum(F.col("terms") * F.aggregate("vector", F.lit(0).cast("bigint"), lambda a, e: a + e["n"])).alias("n_lang"))
    found = here.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    return found.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n", "n_lang", "v")])


def share(count, total):
    """p of a count, for numpy integers; ``total`` is N + 2 V."""
    whole, rest = np.divmod(np.asarray(count, np.int64) + SMOOTH, total)
    for step in SCALE_STEPS:
        more, rest = np.divmod(rest * step, total)
        whole = whole * step + more
    return whole + 1


def share_column(count: Column, total: Column) -> Column:
    """``share`` as an expression."""
    top = count + SMOOTH
    whole, rest = _div(top, total), top % total
    for step in SCALE_STEPS:
        whole, rest = whole * step + _div(rest * step, total), (rest * step) % total
    return whole + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def difference(p, q):
    return (p - q) ** 2 // (p + q)


def pair_values(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of each pair of sources a < b of a language with kept terms."""
    spark, sources = vectors.sparkSession, {}
    for r in groups.collect():
        sources.setdefault(r["lang"], []).append((r["source"], r["n"] + 2 * r["v"]))
    held = spark.sparkContext.broadcast({lang: sorted(x, key=lambda s: s[0].encode()) for lang, x in sources.items()})

    def evaluated(lang: str, rows: list) -> pa.RecordBatch:
        names, totals = [s for s, _ in held.value[lang]], np.array([t for _, t in held.value[lang]], np.int64)
        at = {s: k for k, s in enumerate(names)}
        out = np.zeros((len(names), len(names)), np.int64)
        step = max(1, _CELLS // len(names))
        for first in range(0, len(rows), step):
            some = rows[first : first + step]
            counts = np.zeros((len(some), len(names)), np.int64)
            for k, (vector, _) in enumerate(some):
                for e in vector:
                    counts[k, at[e["source"]]] = e["n"]
            p, times = share(counts, totals), np.array([[n] for _, n in some])
            for a in range(len(names) - 1):
                out[a, a + 1 :] += (difference(p[:, a : a + 1], p[:, a + 1 :]) * times).sum(0)
        a, b = np.triu_indices(len(names), 1)
        names = pa.array(names, pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(out[a, b])], names=["lang", "a", "b", "value"])

    @W.released
    def run(batches):
        waiting: dict[str, list] = {}
        for batch in batches:
            for lang, vector, terms in zip(*(batch.column(c).to_pylist() for c in ("lang", "vector", "terms"))):
                waiting.setdefault(lang, []).append((vector, terms))
                if len(waiting[lang]) == _VECTORS:
                    yield evaluated(lang, waiting.pop(lang))
        for lang, rows in waiting.items():
            yield evaluated(lang, rows)

    values = vectors.mapInArrow(run, "lang string, a string, b string, value bigint")
    return values.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def top_terms(kept: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank) of the terms that a source has more of than its language."""
    total = F.aggregate("vector", F.lit(0).cast("bigint"), lambda a, e: a + e["n"])
    entry = kept.select("lang", "term", total.alias("all"), F.explode("vector").alias("e")).select("lang", "term", "all", "e.*")
    known = entry.join(groups.select("lang", "source", F.col("n").alias("n_group"), "n_lang", "v"), ["lang", "source"])
    p, q = share_column(F.col("n"), F.col("n_group") + 2 * F.col("v")), share_column(F.col("all"), F.col("n_lang") + 2 * F.col("v"))
    found = known.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    valued = found.select("lang", "source", "item", _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    return valued.withColumn("rank", place).where(F.col("rank") <= top)


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """Return (lang, source, part, item, value, rank): each group's differences from the language's other sources
    (part ``pair``) and its most distinctive terms (part ``term``)."""
    kept = cut(kept_terms(docs, least))
    vectors = cut(kept.groupBy("lang", "vector").agg(F.count("*").alias("terms")))
    groups = cut(source_groups(docs, vectors))
    values = pair_values(vectors, groups)
    both = values.unionByName(values.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.groupBy("lang").agg(F.collect_list("source").alias("others"))
    each = groups.join(names, "lang").select("lang", "source", F.explode("others").alias("item")).where("source <> item")
    pairs = each.join(both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value"), ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("bigint")))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    found = pairs.withColumn("part", F.lit("pair")).withColumn("rank", place).select(columns)
    return found.unionByName(top_terms(kept, groups, top).withColumn("part", F.lit("term")).select(columns))
