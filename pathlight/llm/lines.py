"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, digits as 0, runs of white space as one space, trimmed) and hashed;
for each host (the document's source) and line the distinct documents with the line are counted. A line is
above the limit if more than ``max_docs`` documents of the host and more than ``max_share`` of them have it,
or ``any_docs`` documents, which is boilerplate on a host of any size. Lines above the limit are removed; a
document is rejected if less than ``min_left`` of its line characters are left. A line that very many
documents share is counted by document first, so that no task counts it alone.

Cases: null and empty texts have no words and lines and fail the base rule; a null source is a host of
its own; rows that repeat a doc_id are one document to the counts, a row without one is a document of its
own, and every row gets its own verdict; texts of any length are taken whole; empty tables give empty
results; extra columns are ignored by ``judge`` and kept by ``remove_frequent_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_DOCS = 3
MAX_SHARE = 0.02
ANY_DOCS = 10_000
MIN_LEFT = 0.3
MIN_WORDS = 50
_SPACE = r"[\x09-\x0D\x20]+"
_SPACES = " \t\n\v\f\r"


def normalised(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), _SPACE, " "))


def _barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once; a generator isn't merged with what reads it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def base_measures(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the documents' lines.

    ``docs`` has a column ``text``; ``_lines`` is array<string>, the lines that have a word.
    """
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(_SPACES))
    held = _barrier(
        docs,
        _words=F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE, -1)),
        _lines=F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, _SPACES, "") != ""),
    )
    n, words = F.size("_words"), F.col("_words")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at")))
    held = _barrier(held, _windows=F.when(n >= 3, F.sort_array(windows)).otherwise(F.array().cast("array<struct<h: bigint, at: int>>")))
    ordered, m = F.col("_windows"), F.size("_windows")
    again = F.filter(F.sequence(F.lit(0), m - 1), lambda k: (F.get(ordered, k)["h"] == F.get(ordered, k - 1)["h"]) | (F.get(ordered, k)["h"] == F.get(ordered, k + 1)["h"]))
    starts = F.sort_array(F.transform(again, lambda k: F.get(ordered, k)["at"]))
    held = _barrier(held, _starts=F.when(m > 0, starts).otherwise(F.array().cast("array<int>")))
    at = F.col("_starts")
    gaps = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
    long = lambda c: c.cast("bigint")
    held = _barrier(
        held,
        n_words=long(n),
        word_chars=long(F.length(F.translate(text, _SPACES, ""))),
        n_symbols=long(F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))),
        n_dup_lines=long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
        n_repeat_words=F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, x: s + x),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return held.withColumn("base_failed", failed).drop("_words", "_windows", "_starts")


def _hashed_lines(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.length(x).cast("bigint").alias("chars")))


def frequent_lines(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, any_docs: int = ANY_DOCS) -> DataFrame:
    """Return (host, h, n_docs): hashes of lines above the limit, with the documents that have them."""
    doc = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id")).alias("doc")
    docs = docs.select(F.coalesce(F.col(host), F.lit("")).alias("host"), doc, "text")
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, _SPACES, "") != "")
    rows = docs.select("host", "doc", F.explode(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(normalised(x))))).alias("h"))
    counts = rows.groupBy("host", "h").agg(F.count_distinct("doc").alias("n_docs")).where(F.col("n_docs") > min(max_docs, any_docs - 1))
    sizes = docs.groupBy("host").agg(F.count_distinct("doc").alias("host_docs"))
    n = F.col("n_docs")
    above = (n >= any_docs) | (n > max_docs) & (n > max_share * F.col("host_docs"))
    return counts.join(sizes, "host").where(above).select("host", "h", "n_docs")


def judge(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, any_docs: int = ANY_DOCS) -> DataFrame:
    """Return (doc_id, base columns, n_lines_removed, kept) of every row."""
    common = frequent_lines(docs, host, max_docs, max_share, any_docs)
    return _verdicts(docs, common, host, min_left).drop("_key")


def _verdicts(docs: DataFrame, common: DataFrame, host: str, min_left: float) -> DataFrame:
    """``judge``'s rows with ``_key``, the hash of id, host and text."""
    common = common.select("host", "h", F.lit(True).alias("common"))
    own = docs.select("doc_id", F.coalesce(F.col(host), F.lit("")).alias("host"), "text", F.monotonically_increasing_id().alias("row"), F.xxhash64("doc_id", F.coalesce(F.col(host), F.lit("")), "text").alias("_key"))
    measured = base_measures(own)
    base = F.struct("_key", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    nothing = F.array(F.struct(F.xxhash64("row").alias("h"), F.lit(0).cast("bigint").alias("chars")))
    # The first row of a document carries its measures (its h only spreads such rows), the others one line each.
    rows = measured.select("row", "host", base.alias("base"), F.posexplode(F.concat(nothing, _hashed_lines(F.col("_lines")))).alias("k", "line"))
    rows = rows.select("row", "host", F.when(F.col("k") == 0, F.col("base")).alias("base"), F.col("line.h").alias("h"), F.col("line.chars").alias("chars"))
    met = rows.join(common, ["host", "h"], "left")
    gone = F.coalesce("common", F.lit(False)) & F.col("base").isNull()
    whole = met.groupBy("row").agg(
        F.first("base", ignorenulls=True).alias("base"),
        F.sum("chars").alias("chars"),
        F.sum(F.when(gone, F.col("chars")).otherwise(F.lit(0).cast("bigint"))).alias("chars_removed"),
        F.count_if(gone).alias("n_lines_removed"),
    )
    left = F.col("chars") - F.col("chars_removed") >= min_left * F.col("chars")
    return whole.select("base.*", "n_lines_removed", (~F.col("base.base_failed") & left).alias("kept"))


def remove_frequent_lines(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, any_docs: int = ANY_DOCS) -> DataFrame:
    """The documents that pass, with all their columns, without the lines above the limit.

    Rows are matched to their lines by a hash of their id, host and text: rows alike in these fare alike.
    """
    common = frequent_lines(docs, host, max_docs, max_share, any_docs)
    key = F.xxhash64("doc_id", F.coalesce(F.col(host), F.lit("")), "text").alias("_key")
    each = docs.select(key, F.coalesce(F.col(host), F.lit("")).alias("host"), F.explode(_hashed_lines(F.split("text", "\n", -1))).alias("line"))
    gone = each.select("_key", "host", "line.h").join(common, ["host", "h"]).groupBy("_key").agg(F.collect_set("h").alias("_gone"))
    passed = _verdicts(docs, common, host, min_left).where("kept").select("_key").distinct()
    joined = docs.select("*", key).join(passed, "_key", "left_semi").join(gone, "_key", "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains("_gone", F.xxhash64(normalised(x)))), "\n")
    return joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)).select(docs.columns)
