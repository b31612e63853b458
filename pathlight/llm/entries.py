"""Queries of the training-data operators over the tables of a data folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import decontaminate, divergence, languages, licenses, lines, ngrams, pages, pieces, resampling, simhash, substrings, tokens, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_report(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judge(table(spark, sf_dir, "documents"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score_report(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_report(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_report(found)


def op11_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_report(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampling_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_substrings": op2_substrings,
        "op3_quality": op3_quality,
        "op4_tokens": op4_tokens,
        "op5_language_model": op5_language_model,
        "op6_pieces": op6_pieces,
        "op7_licenses": op7_licenses,
        "op8_html": op8_html,
        "op9_simhash": op9_simhash,
        "op10_decontamination": op10_decontamination,
        "op11_languages": op11_languages,
        "op12_resampling": op12_resampling,
        "op13_divergence": op13_divergence,
        "pipeline": corpus_pipeline.run,
    }


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f),
r AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, d.w, r.n, u.p FROM d LEFT JOIN r ON d.doc_id = r.doc_id, LATERAL (SELECT unnest(range(1, len(d.w) + 1)) AS p) u),
x AS (SELECT k.doc_id, string_agg(k.w[k.p], ' ' ORDER BY k.p) AS t FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.p = c.p WHERE c.p IS NULL GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(x.t, '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN x ON d.doc_id = x.doc_id
"""

OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('d' || doc_id, 'r' || row_number() OVER ()) AS doc, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(t, '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')) AS ls FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
a AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 3)) AS p FROM a) GROUP BY rid),
l AS (SELECT rid, x, trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\x09-\x0D\x20]+', ' ', 'g')) AS norm FROM (SELECT rid, unnest(ls) AS x FROM w)),
h AS (SELECT host, count(DISTINCT doc) AS n FROM d GROUP BY host),
f AS (SELECT host, norm FROM (SELECT d.host, l.norm, count(DISTINCT d.doc) AS n FROM l JOIN d ON l.rid = d.rid GROUP BY 1, 2) c JOIN h USING (host)
      WHERE c.n >= 10000 OR c.n > 3 AND c.n > 0.02 * h.n),
q AS (SELECT l.rid, sum(length(l.x)) AS chars, coalesce(sum(length(l.x)) FILTER (WHERE f.norm IS NOT NULL), 0) AS gone, count(f.norm) AS n
      FROM l JOIN d ON l.rid = d.rid LEFT JOIN f ON f.host = d.host AND f.norm = l.norm GROUP BY l.rid),
b AS (SELECT d.rid, d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(d.t, '[\x09-\x0D\x20]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(w.ls) - len(list_distinct(w.ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w ON d.rid = w.rid LEFT JOIN r ON d.rid = r.rid)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, CAST(coalesce(q.n, 0) AS BIGINT) AS n_lines_removed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(q.chars - q.gone >= 0.3 * q.chars, true) AS kept
FROM b LEFT JOIN q ON b.rid = q.rid
"""

OP10_SQL = r"""
WITH b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id,
         list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size,
         array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS pat
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT rid, i, size, array_to_string(w[i : i + size - 1], ' ') AS pat
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM p) WHERE len(w) >= size)),
m AS (SELECT g.rid, g.i, p.size, p.item_id FROM g JOIN p ON g.size = p.size AND g.pat = p.pat),
h AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + size)) AS pos FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.rid = h.rid LEFT JOIN t ON d.rid = t.rid
"""

OP12_SQL = r"""
WITH tab AS (
  SELECT list(c ORDER BY b) AS t
  FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))),
d AS (
  SELECT part, row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT 's' AS part, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark)),
f AS (
  SELECT part, rid, unnest(w) AS f FROM d
  UNION ALL SELECT part, rid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d),
n AS (SELECT part, rid, f, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM n)),
y AS (SELECT f, list_transform(range(1, len(h), 2), lambda i: 16 * (strpos('0123456789ABCDEF', h[i]) - 1) + strpos('0123456789ABCDEF', h[i + 1]) - 1) AS y FROM h),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295, y), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS b FROM y, tab),
m AS (SELECT part, rid, b, n FROM n JOIN b ON n.f = b.f),
c AS (SELECT b, coalesce(sum(n) FILTER (WHERE part = 's'), 0) AS s, coalesce(sum(n) FILTER (WHERE part = 't'), 0) AS t FROM m GROUP BY b),
z AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM c),
g AS (SELECT b, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM c, z),
q AS (SELECT rid, sum(n) AS n, CAST(floor(CAST(sum(n * g) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM m JOIN g ON m.b = g.b WHERE part = 's' GROUP BY rid),
r AS (
  SELECT doc_id, CAST(coalesce(q.n, 0) AS BIGINT) AS n_features, coalesce(q.weight, 0) AS weight, len(w) >= 20 AS chance,
         coalesce(q.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN q ON d.rid = q.rid WHERE part = 's'),
o AS (SELECT *, row_number() OVER (PARTITION BY chance ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER (PARTITION BY chance) // 100 AS wanted FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN chance AND place <= wanted THEN place END AS rank FROM o
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(list_filter(string_split_regex(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (WHERE k.term IS NOT NULL), 0) AS n
      FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source LEFT JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 2) // (s.n + 2 * v.v) AS p,
             1 + 1000000000 * (k.n + 2) // (v.n + 2 * v.v) AS q
      FROM s JOIN k ON s.lang = k.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM y)
SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substrings": OP2_SQL, "op3_quality": OP3_SQL, "op10_decontamination": OP10_SQL, "op12_resampling": OP12_SQL, "op13_divergence": OP13_SQL}
