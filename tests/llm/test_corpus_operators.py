"""Language identification, importance resampling and the divergence audit against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathlight.llm import divergence, languages, resampling

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, row string, _h bigint, score string"
PARTS = {"aa": "th er ing ou nd ea wh".split(), "bb": "sch ung ei ich ä zu pf".split(), "cc": "ció ñ que ll os ar ez".split()}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, say(rng, lang, rng.randrange(4, 160)), lang, f"s{min(rng.randrange(9), 4)}") for i in range(180) for lang in [rng.choice(list(PARTS))]]
    rows += [(200 + k, rows[0][1], rows[0][2], "s0") for k in range(40)]  # copies
    rows += [(300, None, "aa", "s1"), (301, "", "aa", None), (302, "12 34 -- 5", "bb", "s2"), (303, say(rng, "aa", 30_000), "aa", "s1"), (304, "x", None, "s1"), (305, "日本 語", None, ""), (306, "— “” 😀", "cc", "s9"), (307, None, None, None), (308, "Wort " * 50, "dd", "only")]
    rows += [rows[7], rows[7], (None, rows[8][1], "bb", "s0"), (None, None, None, None)]
    return spark.createDataFrame([(*r, None, 1, "clash", 5, "clash") for r in rows], SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text, pattern):
    return re.findall(pattern, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())


ALNUM, TERM = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


@pytest.mark.parametrize("runs", [1, 2, 4])
def test_ring_equals_hashing_each_run(runs):
    rng = random.Random(runs)
    text = " ".join(rng.choice(["Ab", "c1", "é", "日本", "zz-y", "q" * 50]) for _ in range(300))
    words = words_of(text, ALNUM)
    want = Counter(zlib.crc32(b" ".join(words[i : i + n])) % 997 for n in range(1, runs + 1) for i in range(len(words) - n + 1))
    n, got = resampling.feature_buckets(text, runs, 997)
    assert n == len(words) and Counter(got.tolist()) == want


def test_ring_goes_on_over_slices(monkeypatch):
    text = " ".join(str(k) for k in range(500))
    whole = resampling.feature_buckets(text)[1]
    original = resampling.W.lists_of_words
    monkeypatch.setattr(resampling.W, "lists_of_words", lambda t, table: original(t, table, 7))
    assert (resampling.feature_buckets(text)[1] == whole).all()


def brute_resampling(rows, target):
    features = lambda w: [*w, *(b" ".join(w[i : i + 2]) for i in range(len(w) - 1))]
    found = [(d, words_of(t, ALNUM)) for d, t in rows]
    s = Counter(zlib.crc32(f) % 10_000 for _, w in found for f in features(w))
    t = Counter(zlib.crc32(f) % 10_000 for x in target for f in features(words_of(x, ALNUM)))
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for d, w in found:
        f = features(w)
        weight = sum(gain(zlib.crc32(x) % 10_000) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = long[: 25 * len(long) // 100]
    ranked = Counter((x[0], *x[2:], k + 1) for k, x in enumerate(drawn))
    for x in out:
        ranked[(x[0], *x[2:], None)] += 1
    for x in drawn:
        ranked[(x[0], *x[2:], None)] -= 1
    return +ranked


def test_resampling(spark, docs):
    rng = random.Random(9)
    target = [say(rng, "bb", 60) for _ in range(5)] + [None, ""]
    items = spark.createDataFrame([(str(k), t) for k, t in enumerate(target)], "item_id string, text string")
    want = brute_resampling([(r["doc_id"], r["text"]) for r in docs.collect()], target)
    got = resampling.resampling_report(docs, items)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and [t for _, t in got.dtypes] == ["bigint"] * 5
    assert Counter(map(tuple, got.collect())) == want
    kept = resampling.resample(docs, items)
    drawn = {k[0] for k in want if k[-1] is not None}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == drawn
    held = Counter(r["lang"] for r in kept.select("lang").collect())
    every = Counter(r["lang"] for r in docs.select("lang").collect())
    assert held["bb"] / held.total() > 1.3 * every["bb"] / every.total()  # towards the target
    assert resampling.resampling_report(empty(spark), items).isEmpty()
    bare = items.where("item_id = 'none'")
    assert Counter(map(tuple, resampling.resampling_report(docs, bare).collect())) == brute_resampling([(r["doc_id"], r["text"]) for r in docs.collect()], [])


def brute_audit(rows, least, top):
    count, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        w = words_of(text, TERM)
        count[lang, source].update(w)
        in_docs[lang].update(set(w))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        n = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = lambda c, all_: 1 + 1_000_000_000 * (c + 2) // (all_ + 2 * len(kept))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            mine = {t: p(count[lang, s][t], n[s]) for t in kept}
            pairs = [(o, sum(f(mine[t], p(count[lang, o][t], n[o])) for t in kept)) for o in sources - {s}]
            whole = {t: p(sum(count[lang, o][t] for o in sources), sum(n.values())) for t in kept}
            terms = [(t.decode(), f(mine[t], whole[t])) for t in kept if count[lang, s][t] and mine[t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return Counter(out)


@pytest.mark.parametrize("least", [1, 10, 10_000])
def test_divergence(spark, docs, least, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 200)
    want = brute_audit([(r["text"], r["lang"], r["source"]) for r in docs.collect()], least, 10)
    got = divergence.audit(docs, least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and got.schema["rank"].dataType.simpleString() == "int"
    assert Counter(map(tuple, got.collect())) == want
    assert divergence.audit(empty(spark)).isEmpty()


def test_shares_are_exact():
    rng = random.Random(4)
    for _ in range(500):
        n = rng.randrange(1, 10**15)
        c = rng.randrange(0, n + 1)
        assert int(divergence.share(np.array([c]), np.array([n]))[0]) == 1 + 10**9 * (c + 2) // n


@pytest.mark.parametrize("segment", [1, 2, 3, 64])
def test_marginals_equal_summing_over_all_labellings(segment, monkeypatch):
    monkeypatch.setattr(languages, "SEGMENT", segment)
    rng = np.random.default_rng(segment)
    field = languages.Field(["a", "b", "c"], {})
    field.transitions[:], field.start[:] = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([1, 5, 2, 4, 7])
    scores, at = rng.normal(size=(lengths.sum(), 3)) * 2, 0
    got = languages.marginals(field, scores, lengths)
    for n in lengths:
        s, want = scores[at : at + n], np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            v = np.exp(field.start[path[0]] + sum(s[i, path[i]] for i in range(n)) + sum(field.transitions[a, b] for a, b in zip(path, path[1:])))
            want[np.arange(n), path] += v
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(2)
    field = languages.Field(["a", "b"], {})
    field.transitions[:], field.start[:] = rng.normal(size=(2, 2)), rng.normal(size=2)
    scores, x = rng.normal(size=(5, 2)), rng.integers(0, 5, (3, 4))
    y = rng.integers(0, 2, x.shape)

    def loss():
        total = 0
        for a, b in zip(x, y):
            value = lambda p: field.start[p[0]] + sum(scores[w, k] for w, k in zip(a, p)) + sum(field.transitions[i, j] for i, j in zip(p, p[1:]))
            total += np.log(sum(np.exp(value(p)) for p in itertools.product(range(2), repeat=len(a)))) - value(b)
        return total

    for array, gradient in zip((scores, field.transitions, field.start), languages._gradient(field, x, y, scores)):
        for at in np.ndindex(array.shape):
            old = array[at]
            array[at] = old + 1e-5
            up = loss()
            array[at] = old - 1e-5
            down = loss()
            array[at] = old
            assert abs((up - down) / 2e-5 - gradient[at]) < 1e-4


def test_languages(spark, docs):
    got = languages.language_report(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    found = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    for d, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    assert [found[d]["lang_pred"] for d in (300, 301, 302, 306, 307)] == ["und"] * 5 and found[305]["lang_pred"] != "und"
    held = [(r["doc_id"], r["lang"]) for r in docs.where("doc_id < 200 or doc_id = 303").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 20 and all(found[d]["lang_pred"] == lang for d, lang in held)
    assert {r["held_out"] for r in got.where("doc_id is null").collect()} == {False}
    assert languages.language_report(empty(spark)).isEmpty()
    unlabelled = docs.where("doc_id < 5").withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in languages.language_report(unlabelled).collect()} == {"und"}


def test_prediction_takes_nothing_but_the_text(spark, docs):
    field = languages.fit_on(docs)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    together = languages.predict(field, pa.array(texts, pa.string()))
    alone = [languages.predict(field, pa.array([t], pa.string())) for t in texts[::9]]
    assert [a[0][0] for a in alone] == together[0][::9] and np.allclose([a[1][0] for a in alone], together[1][::9])


def test_code_switched_words(spark, docs):
    field, rng = languages.fit_on(docs), random.Random(5)
    text = f"{say(rng, 'aa', 40)} {say(rng, 'cc', 30)}, {say(rng, 'bb', 50)}"
    rows = languages.label_words(spark.createDataFrame([(1, text), (2, None), (3, "…")], "doc_id bigint, text string"), field).collect()
    found = {r["doc_id"]: r["words"] for r in rows}
    langs = [w["lang"] for w in found[1]]
    right = sum(a == b for a, b in zip(langs, ["aa"] * 40 + ["cc"] * 30 + ["bb"] * 50))
    assert len(langs) == 120 and right >= 114 and found[2] == []
    assert [w["word"] for w in found[1]] == re.findall(r"[^\W\d_]+", text)
