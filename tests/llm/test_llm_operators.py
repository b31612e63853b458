"""The ten operators against brute force on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathlight.llm import components, decontaminate, licenses, lines, ngrams, pages, pieces, simhash, substrings, tokens, toxicity, words
from pathlight.llm.lineage import cut

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, hit_positions string, row string, fp int"
WORDS = "the of and tion ing er an re Éa ñ x1 foo bar".split()


def texts():
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    shared = say(45)
    rows = [say(rng.randrange(1, 120)) for _ in range(30)]
    rows += [say(20) + "\n" + shared + " " + say(10), shared, say(5) + " \t" + shared.replace(" ", "  "), rows[3], rows[3], rows[4] + " tail", "", None, "  \n ", "one", "a b", "w " * 400, say(3000)]
    rows += ["Line again\nLine again\nother line here\n" + say(60), "日本語 テキスト 😀 é <|endoftext|> don't"]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", "s" if i % 3 else None, None, "clash", "clash", 1) for i, t in enumerate(texts())]
    rows += [rows[5], (None, rows[6][1], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def test_word_windows():
    x = np.random.default_rng(0).integers(0, 9, 60).astype(np.uint64)
    for k in (1, 2, 3, 5, 10, 11, 20):
        h = words.window_hashes(np.concatenate([x, x]), k)
        assert len(h) == 121 - k and (h[: 61 - k] == h[60:]).all()
        assert (words.sliding(x, k) == [x[i : i + k].min() for i in range(61 - k)]).all()


def test_substrings(spark, docs):
    rows = [(r["doc_id"], split(r["text"])) for r in docs.select("doc_id", "text").distinct().collect() if r["doc_id"] is not None]
    first = {}
    for d, w in sorted(rows):
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (d, i))
    want = {}
    for d, w in rows:
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] != (d, i):
                gone |= set(range(i, i + 20))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    got = substrings.removal_report(docs).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: r[1:] for r in got if r["doc_id"] is not None} == want and sum(v[1] for v in want.values()) > 0
    assert [r[1] > 0 and r[2] == 0 for r in got if r["doc_id"] is None] == [True]
    assert substrings.removal_report(empty(spark)).isEmpty()
    kept = substrings.drop_repeated_words(docs)
    assert kept.columns == docs.columns and {r["doc_id"]: len(split(r["text"])) for r in kept.collect() if r["doc_id"] is not None} == {d: v[0] - v[1] for d, v in want.items() if v[0] == 0 or v[1] < v[0]}


def brute_substrings(rows):
    """(doc_id, n_words, n_removed, kept) of each row; an equal window starts earlier in a smaller id, or earlier in any row of the id."""
    found = [(d, split(t)) for d, t in rows]
    first = {}
    for d, w in found:
        for i in range(len(w) - 19):
            first[tuple(w[i : i + 20])] = min(first.get(tuple(w[i : i + 20]), (d, i)), (d, i))
    out = []
    for d, w in found:
        gone = {p for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] != (d, i) for p in range(i, i + 20)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return collections.Counter(out)


def test_substrings_of_repeated_ids_with_other_texts(spark):
    rng = random.Random(21)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    passage = say(30)
    rows = [(1, say(400) + " " + passage), (2, passage), (2, "short one"), (3, passage), (2, say(25) + " " + passage + " tail"), (2, passage), (4, None), (4, say(3) + " " + passage), (4, ""), (5, say(50)), (5, passage + " " + passage)]
    rows += [(6, rows[0][1]), (6, rows[0][1].replace(" ", "\n", 3)), (7, passage[:-1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, `a.b` int").repartition(5)
    got = collections.Counter(tuple(r) for r in substrings.removal_report(df).collect())
    assert got == brute_substrings(rows)
    kept = substrings.drop_repeated_words(df)
    assert kept.columns == df.columns
    want = collections.Counter((d, n - gone) for (d, n, gone, _), k in got.items() for _ in range(k) if n == 0 or gone < n)
    assert collections.Counter((r["doc_id"], len(split(r["text"]))) for r in kept.collect()) == want
    items = spark.createDataFrame([("1", passage)], "item_id string, text string")
    clean = decontaminate.drop_contaminated(df, items)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {2, 4, 5}


def brute_fingerprint(text):
    w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(min(len(w), 1), len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    rows = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect() if r["doc_id"] is not None}
    label = {d: d for d in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if (rows[a] ^ rows[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[a] == label[b] for a in rows for b in rows if (rows[a] ^ rows[b]).bit_count() <= 3):
            break
    got = simhash.near_duplicate_report(simhash.near_duplicates(docs)).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None} == {d: (f"{f:016x}", label[d]) for d, f in rows.items()}
    assert len(got) == docs.count()
    kept = [r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()]
    assert set(kept) == {None, *label.values()} and len(kept) == len(set(kept))
    assert simhash.near_duplicates(empty(spark)).isEmpty()


def test_trie_join_finds_all_close_pairs():
    rng = np.random.default_rng(2)
    u = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = u[:200] ^ (np.uint64(1) << rng.integers(0, 48, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 48, 200).astype(np.uint64))
    u = np.unique(np.concatenate([u, near]))
    got = set()
    for x, y in simhash._close_pairs(u, 3):
        got |= {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist()) if p[0] != p[1]}
    want = {(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if int(u[i] ^ u[j]).bit_count() <= 3 and u[i] >> np.uint64(48) == u[j] >> np.uint64(48)}
    assert got == want and len(want) > 100


def test_a_run_of_near_copies_is_linked_without_all_pairs():
    rng = np.random.default_rng(6)
    base = np.uint64(rng.integers(1 << 62))
    u = np.unique(np.array([base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a in range(48) for b in range(a)]))
    assert len(simhash._forest(u, 3)) == len(u) - 1
    linked, walked = simhash.Linked(len(u)), 0
    for x, y in simhash._close_pairs(u, 3, linked):
        linked.add(x, y)
        walked += len(x)
    every = sum(len(x) for x, _ in simhash._close_pairs(u, 3))
    assert walked <= every and len(set(linked.label.tolist())) == 1


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (5, 5), (None, 3)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


def alnum(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


@pytest.mark.parametrize("block_words", [1_000_000, 300])
def test_decontamination(spark, docs, block_words):
    all_texts = [t for t in texts() if t]
    items = [("i1", " ".join(all_texts[0].split()[:14])), ("i2", all_texts[31]), ("i3", "one"), ("i4", ""), (None, "foo"), ("i2", all_texts[31]), ("i5", "never ever seen in any of these texts at all ok"), ("i6", None), ("i7", "a b")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = alnum(t)
        for k in range(len(w) - min(10, len(w)) + 1):
            if i is not None and w:
                windows[tuple(w[k : k + min(10, len(w))])].add(i)
    want = collections.Counter()
    for r in docs.collect():
        w, hit, ids = alnum(r["text"]), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    ids |= own
        want[(r["doc_id"], len(w), len(hit), len(ids), decontaminate.items_digest(list(ids)), bool(hit))] += 1
    got = decontaminate.contamination_report(decontaminate.find_contamination(docs, benchmark, block_words=block_words))
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    clean = decontaminate.drop_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[-1])
    assert decontaminate.find_contamination(empty(spark), benchmark).isEmpty()
    assert not decontaminate.contamination_report(decontaminate.find_contamination(docs, benchmark.limit(0))).where("contaminated").count()


def test_language_model(spark, docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rows = [(r["doc_id"], [*(x.translate(bytes(words.LOWER)) for x in split(r["text"])), b"$"]) for r in docs.collect()]
    used = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 != 2
    c, pair, after, kinds = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for d, w in rows:
        if used(d):
            c.update(w)
            for a, b in zip([b"^", *w], w):
                pair[a, b] += 1
                after[a] += 1
                kinds[a].add(b)
    n, v = sum(c.values()), len(c)
    p1 = lambda x: (c[x] + 1) / (n + v + 1)
    p2 = lambda a, b: max(pair[a, b] - 0.75, 0) / after[a] + 0.75 * len(kinds[a]) / after[a] * p1(b) if a in after else p1(b)
    want = sorted((str(d), len(w), sum(x in c for x in w), round(sum(math.log10(p1(x)) for x in w), 6), round(sum(math.log10(p2(a, b)) for a, b in zip([b"^", *w], w)), 4)) for d, w in rows)
    got = ngrams.score_documents(cut(docs.coalesce(2)), ~held, block_bytes=9000, shard_bytes=8000).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 4)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    assert ngrams.score_documents(empty(spark), ~held).isEmpty()
    assert abs(sum(p2(b"theof", x) for x in c) + (0.75 * len(kinds[b"theof"]) / after[b"theof"] if b"theof" in after else 1) * (1 - sum(map(p1, c))) - 1) < 1e-9


def test_elias_fano():
    rng = np.random.default_rng(1)
    for high in (10, 1 << 20, 1 << 62):
        x = np.unique(rng.integers(0, high, 70_000, dtype=np.uint64))
        ef = ngrams.EliasFano(x)
        assert (ef.values() == x).all()
        probe = np.concatenate([x[::7], rng.integers(0, high, 500, dtype=np.uint64)])
        where = {int(k): i for i, k in enumerate(x)}
        assert ef.find(probe).tolist() == [where.get(int(k), -1) for k in probe]
    assert ngrams.EliasFano(np.zeros(0, np.uint64)).find(np.array([3], np.uint64)).tolist() == [-1]


def test_token_counts(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    counter = tokens._counter(open(path).read())
    other = ["日本語 テキスト 😀", "Ωμέγα ΣΟΦΟΣ οδός", "İstanbul ẞ ﬁn", "a\u0301b e\u0323\u0301 x", "नमस्ते दुनिया 123", "مرحبا بالعالم"]
    assert [sum(counter.lengths(counter.pretokens(t))) for t in other] == [len(library.encode(t, add_special_tokens=False).ids) for t in other]
    got = tokens.token_report(docs, path, limit=100)
    assert collections.Counter(tuple(r)[:3] for r in got.collect()) == want
    assert got.where("over_limit <> (n_tokens > 100)").isEmpty() and tokens.token_report(empty(spark), path).isEmpty()


def test_pieces(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = spark.createDataFrame([(-1, "  lead   many          spaces            x\n\n a\tb "), (-2, "y" * 150 + " z"), (-3, " " * 40), (-4, "\n")], "doc_id bigint, text string")
    held = cut(docs.select("doc_id", "text").unionByName(odd))  # the encoder wants texts that keep their order
    got = pieces.encode(held, path, block_bytes=4000)
    rows = {str(r["row"]): list(r["ids"]) for r in got.collect()}
    assert rows == {str(r["doc_id"]): library.encode(r["text"] or "") for r in held.collect()}
    back = {str(r["row"]): r["text"] for r in pieces.decode_table(got, path).collect()}
    assert back == {str(r["doc_id"]): r["text"] or "" for r in held.collect()}
    assert pieces.encode(empty(spark), path).isEmpty()


def test_viterbi_over_a_unigram_lattice(spark):
    table = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -4.5, "ba": -5.0, "aba": -6.2}
    ids = {p: i for i, p in enumerate(table)}
    word = "▁abab"
    edges = [(i + len(p), i, s, ids[p]) for p, s in table.items() for i in range(len(word)) if word.startswith(p, i)]
    df = spark.createDataFrame([(word, edges)], "w string, e array<struct<end: int, start: int, score: double, id: int>>")
    got = df.select(pieces.viterbi_segments(F.col("e"), F.length("w")).alias("x")).first()["x"]

    def best(i):
        return (0.0, []) if i == len(word) else max((s + best(i + len(p))[0], [ids[p], *best(i + len(p))[1]]) for p, s in table.items() if word.startswith(p, i))

    assert abs(got["score"] - best(0)[0]) < 1e-9 and sum(len(list(table)[i]) for i in got["path"]) == len(word)


def test_quality_rules(spark, docs):
    got = lines.judge(docs, max_docs=1, max_share=0.0).collect()
    assert len(got) == docs.count()
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
        own = [x for x in (r["text"] or "").split("\n") if x.strip(" \t\n\v\f\r")]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r["text"] or ""), len(own) - len(set(own)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert want in [tuple(g)[1:7] for g in got if g["doc_id"] == r["doc_id"]], r["doc_id"]
    assert lines.judge(empty(spark)).isEmpty()
    boiler = spark.createDataFrame([(i, "h", f"common line {i % 2}\n" + f"body of text {'abcdefgh'[i]} " * 2 + ("\n" + " ".join(chr(97 + i) + chr(97 + k % 26) + chr(97 + k // 26) for k in range(60)) if i else "")) for i in range(8)], "doc_id bigint, source string, text string")
    verdict = {r["doc_id"]: (r["n_lines_removed"], r["kept"]) for r in lines.judge(boiler, max_docs=3, max_share=0.0).collect()}
    assert verdict[0] == (1, False) and verdict[1] == (1, True)
    assert "common" not in lines.remove_frequent_lines(boiler, max_docs=3, max_share=0.0).where("doc_id = 1").first()["text"]
    no_ids = lines.remove_frequent_lines(boiler.withColumn("doc_id", F.lit(None).cast("bigint")), max_docs=3, max_share=0.0)
    assert no_ids.count() == 7 and no_ids.where(F.contains("text", F.lit("common"))).isEmpty()
    # Defaults: a line in more than three documents and two percent of them; rows of one document count once.
    assert {r["doc_id"]: r["n_lines_removed"] for r in lines.judge(boiler.unionByName(boiler)).collect()} == dict.fromkeys(range(8), 1)
    one = boiler.withColumn("doc_id", F.lit(1)).unionByName(boiler.where("doc_id < 2").withColumn("doc_id", F.col("doc_id") + 7))
    assert lines.judge(one).where("n_lines_removed > 0").isEmpty()
    assert lines.judge(boiler, max_docs=100, any_docs=4).where("n_lines_removed = 0").isEmpty()


def test_toxicity(spark):
    rng = random.Random(3)
    syllables = "the of and tion ing er an re ea nd st th".split()
    say = lambda n: [rng.choice(syllables) + rng.choice(syllables) + rng.choice(syllables) for _ in range(n)]
    rows = []
    for i in range(900):
        w = say(rng.randrange(30, 90))
        if i % 6 == 0:
            for _ in range(len(w) // 10 + 1):
                w[rng.randrange(len(w))] = rng.choice(["scoundrel", "numbskull", "dunderhead", "blockhead"])
        rows.append((i, " ".join(w), i % 6 == 0))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, None), (1001, ""), (None, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], int(r[2])) for r in rows] + [(1, None), (7000, 1)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_report(docs, labels).collect()}
    assert len(got) == 903 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {d for d, r in got.items() if r["held_out"]} >= {r[0] for r in held}
    right = sum(got[r[0]]["predicted"] == r[2] for r in held)
    assert right >= 0.9 * len(held), right / len(held)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert [r["score"] for r in toxicity.toxicity_report(docs.limit(1), labels.where("toxic = 0")).collect()] == [0.0]


def test_toxicity_of_every_language():
    rng = random.Random(5)
    syllables = {"en": "the of and tion ing er an re ea nd st th".split(), "de": "ver lich keit ung sch ein ge be tz pf".split(), "es": "cion mente os ado ez rr ll que ta mi".split()}
    insults = {"en": ["scoundrel", "numbskull"], "de": ["halunk", "schurk"], "es": ["payas", "bribon"]}
    rows = []
    for lang, own in syllables.items():
        say = lambda n: ["".join(rng.choices(own, k=3)) for _ in range(n)]  # noqa: B023, E731
        for i in range({"en": 900, "de": 450, "es": 450}[lang]):
            w = say(rng.randrange(40, 90))
            suffixed = lambda: rng.choice(insults[lang]) + rng.choice(own)  # noqa: B023, E731
            # Every fifth ordinary row has such a word by chance: no sequence is 40 times as frequent in toxic rows.
            for _ in range(len(w) // 10 + 1 if i % 6 == 0 else lang != "en" and i % 5 == 0):
                w[rng.randrange(len(w))] = suffixed()
            rows.append((lang, " ".join(w), int(i % 6 == 0)))
    rng.shuffle(rows)
    known, held = rows[::2], rows[1::2]
    models = toxicity.fit(known)
    assert set(models) == {None, "en", "de", "es"}
    assert sum(a == r[0] for a, r in zip(toxicity.route(models, [r[1] for r in held]), held)) >= 0.99 * len(held)
    scores = toxicity.score(models, [r[1] for r in held])
    for lang in syllables:
        got = [(label, s >= toxicity.THRESHOLD) for (own, _, label), s in zip(held, scores) if own == lang]
        toxic = [hit for label, hit in got if label]
        assert sum(toxic) >= 0.7 * len(toxic), lang
        assert sum(hit for label, hit in got if not label) <= 0.1 * len(got), lang
    assert toxicity.score(models, ["", None]).shape == (2,) and toxicity.route(models, ["", None, " "]) == [None] * 3


def test_toxicity_odd_rows(spark):
    rows = [(i, f"plain words of row {i} " * 9 + ("dunderhead " * 3 if i % 4 == 0 else ""), "en", "x") for i in range(60)]
    rows += [(61, "long " * 60_000, None, "x"), (62, None, "en", "x"), rows[0], rows[0], (None, "dunderhead", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)] * 2, "doc_id bigint, toxic int")
    got = toxicity.toxicity_report(docs, labels).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 0}) == 1
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.toxicity_report(docs.limit(0), labels).isEmpty()


def test_licenses(spark):
    docs = spark.createDataFrame(
        [(1, "some words here\nReleased under the MIT License.\nmore words"), (2, "Licensed under the Apache License, Version 2.0."), (3, "the mit students visited the university and the public library"), (4, None), (5, ""), (6, "This work is licensed under the GNU General Public License, version 3.")],
        "doc_id bigint, text string",
    )
    got = {r["doc_id"]: (r["n_found"], r["families"]) for r in licenses.license_report(docs).collect()}
    assert got == {1: (1, "mit"), 2: (1, "apache"), 3: (0, ""), 4: (0, ""), 5: (0, ""), 6: (1, "gpl")}


AGPL = "This program is free software: you can redistribute it and/or modify\n it under the terms of the GNU Affero General Public License\n as published by the Free Software Foundation, either version 3\n"
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n"


def license_texts():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    plain = [say(n) for n in (1, 24, 25, 36, 37, 90)] + ["", None, " \n\r\n ", "***\n\n***"]
    return plain + [say(300) + "\n" + AGPL + "\n" + say(30), "MIT License\nCopyright (c) " + say(4), say(50) + "\n\nMIT License\n\n" + say(3), BSD, "dual: released under the MIT License or licensed under the Apache License, Version 2.0, " + say(9), say(6000) + " Released under the ISC License " + say(2000)]


def test_licenses_in_wrapped_long_and_odd_texts(spark, docs):
    texts = license_texts()
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(12, texts[12], "x"), (None, texts[13], "x")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, families string")
    got = collections.defaultdict(list)
    for r in licenses.license_report(table).collect():
        got[r["doc_id"]].append((r["n_paragraphs"], r["families"]))
    assert [got[i][0][1] for i in range(10, 16)] == ["agpl", "mit", "mit", "bsd", "apache,mit", "isc"]
    assert all(not got[i][0][1] for i in range(10)) and [got[i][0][0] for i in range(6, 10)] == [0, 0, 0, 0]
    assert got[10][0][0] == 2 and got[12] == [(3, "mit")] * 2 and got[None] == [(1, "bsd")]
    assert licenses.license_report(empty(spark)).isEmpty()
    assert licenses.license_report(docs).count() == docs.count()
    models = [licenses.fit_on(docs.repartition(n)).weights for n in (1, 7)]
    assert (models[0] == models[1]).all()


def test_licenses_against_brute_force(spark):
    """Paragraphs, windows, sums of weights and shingles, one by one in plain Python."""
    texts = license_texts()
    model = licenses.fit([t for t in texts[:6] for _ in range(20)])

    def bucket(gram):
        data = np.frombuffer(" ".join(gram).encode(), np.uint8)
        starts, ends, _ = words.split(data, np.array([0, len(data)]), words.NOT_ALNUM)
        return int(words.window_hashes(words.hash_words(data, starts, ends), len(gram))[0] >> np.uint64(48))

    def windows_of(w):
        out, at = [], 0
        while True:
            out.append((at, min(at + licenses.WINDOW, len(w))))
            if at + licenses.WINDOW >= len(w):
                return out
            at += licenses.STEP

    def brute(text):
        found, n = [], 0
        for part in re.split(r"\n(?:\s*\n)+", text or ""):
            lines = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), x)) for x in part.split("\n")]
            whole = [w for x in lines for w in x]
            if not whole:
                continue
            spans, at = set(windows_of(whole)), 0
            for x in lines:
                spans |= {(a + at, b + at) for a, b in windows_of(x)} if x else set()
                at += len(x)
            best = {}
            for a, b in spans:
                grams = [bucket(whole[i : i + k]) for k in (1, 2, 3) for i in range(a, b - k + 1)]
                z = model.weights[grams].astype(float).sum(0) / max(len(grams), 1) ** 0.5 + model.bias
                p = 1 / (1 + np.exp(z[-1] - z[:-1]))
                near = whole[max(0, a - licenses.STEP) : b + licenses.STEP]
                own = {tuple(near[i : i + 3]) for i in range(max(1, len(near) - 2))} | ({tuple(whole[a:b])} if b - a < 3 else set())
                held = {}
                for f, templates in licenses.TEMPLATES.items():
                    for t in templates:
                        if len(own & t) >= licenses.CONFIRM * len(t) and (len(own & t) / len(t), len(own & t)) > held.get(f, (0, 0, 0))[:2]:
                            held[f] = (len(own & t) / len(t), len(own & t), own & t)
                for c, f in enumerate(licenses.FAMILIES):
                    if p[c] >= model.least[c] and f in held and not any(held[f][2] < x[2] for x in held.values()):
                        best[f] = max(best.get(f, 0), p[c])
            found += [(n, f, pytest.approx(x)) for f, x in sorted(best.items())]
            n += 1
        return n, found

    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()
    got = {r["doc_id"]: (r["n_paragraphs"], [(x["paragraph"], x["family"], x["probability"]) for x in r["found"]]) for r in rows}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert sum(len(x[1]) for x in got.values()) >= 6


def page(body, nav="<ul><li><a href=/a>A</a></li></ul>"):
    return f'<!DOCTYPE html><html><head><title>t</title><script>var x="</p>";</script></head><body><nav>{nav}</nav><div class="ad">Buy now</div>{body}<footer>&copy; all</footer></body></html>'


def test_pages(spark):
    rows = [(i, f"http://h.example/{i}", page(f"<article><h1>T{i}</h1><p>first &amp; <b>bold</b>ly {i}<br>x<p>second\n  part{i}<div class='comments'>me too</div></article>")) for i in range(9)]
    rows += [(20, "http://lone.example/", page("<main><p>alone</p></main>")), (21, None, None), (22, "http://h.example/22", ""), (23, "u", "plain text"), (0, rows[0][1], rows[0][2])]
    got = collections.defaultdict(list)
    for r in pages.page_report(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect():
        got[r["page_id"]].append((r["text"], r["n_chars"]))
    assert got[3] == [("T3 first & boldly 3 x second part3", 34)] and len(got[0]) == 2
    assert got[20] == [("alone", 5)] and got[21] == [("", 0)] and got[22] == [("", 0)] and got[23] == [("plain text", 10)]
    assert pages.page_report(spark.createDataFrame([], "page_id bigint, url string, html string")).isEmpty()


def test_page_templates_and_names(spark):
    notice = "<div><p>all rights of this host are reserved</p></div>"
    rows = [(i, f"http://h.example/{i}", page(f"<article><p>text {i}</p>{notice}</article>")) for i in range(5)] + [(5, "http://h.example/5", ""), (6, "http://h.example/6", None)]
    rows += [(7, "http://h.example/7", page("<article><p>no such page</p></article>"))]
    body = lambda i: f"<html><body class='has-sidebar search'><main class='comment-form'><p>words {i}</p><div class='search-result-item'><p>found {i}</p></div><div class='site-footer'>end</div></main></body></html>"
    rows += [(10 + i, f"http://b.example/{i}", body(i)) for i in range(4)] + [(20 + i, "http://copies.example/", page("<article><p>same</p></article>")) for i in range(4)]
    rows += [(30, "http://lone.example/", "<html><body><div class='widget'><p>in a widget</p></div></body></html>")]
    got = {r["page_id"]: r["text"] for r in pages.page_report(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i] for i in range(8)] == ["text 0", "text 1", "text 2", "text 3", "text 4", "", "", "no such page"]
    assert [got[10 + i] for i in range(4)] == [f"words {i} found {i}" for i in range(4)]
    assert {got[20 + i] for i in range(4)} == {"same"} and got[30] == "in a widget"


def test_page_templates_against_brute_force(spark):
    """Occurrence vectors of tokens, collected and compared one by one, give the same template tokens."""
    rng = random.Random(4)
    side = "<div class='box'><p>fixed side text</p></div>"
    rows = []
    for i in range(9):
        body = "".join(f"<section><p>{rng.choice('abc')} text {i} {k}</p></section>" for k in range(rng.randrange(1, 5)))
        rows.append((i, "http://h.example/x", f"<html><body>{side}<article><div class='lead'><p>{'word ' * 30}{i}</p></div>{body}{'<aside><p>seldom</p></aside>' * (i == 2)}</article></body></html>"))
    rows += [(20, "http://h.example/e", None)]
    vectors = collections.defaultdict(lambda: [0] * len(rows))
    for k, r in enumerate(rows):
        p = pages.Page(r[2])
        for path in p.paths if r[2] else ():
            vectors[path, None][k] += 1
        for at, text, _ in p.blocks:
            vectors[p.paths[at], pages._text_id(text)][k] += 1
    sizes = collections.Counter(tuple(v) for v in vectors.values())
    want = {t for t, v in vectors.items() if 2 * sum(x > 0 for x in v) >= 9 and (t[1] is not None or sizes[tuple(v)] > 1)}
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {(r["path"], r["block"]) for r in pages.template_tokens(df).where("in_template and host = 'h.example'").collect()}
    assert got == want and pages._text_id("fixed side text") in {b for _, b in got} and len(got) > 5
    text = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    for i, _, html in rows[:9]:
        inner = re.sub("<aside>.*</aside>", "", html[html.index("<article>") : html.index("</article>")])
        assert text[i] == " ".join(" ".join(re.sub("<[^>]*>", " ", inner).split()).split())


def test_page_odd_cases(spark):
    article = lambda inner: page(f"<article><p>start</p>{inner}<p>end</p></article>")
    rows = [(i, f"http://h.example/{i}", article(f"<p>own {i}</p>")) for i in range(6)]
    rows += [(6, "http://h.example/6", article("<div class='related-work'><p>Prior studies.</p></div><section class='hidden-costs'><p>Costs.</p></section><p>foo<img src=x>bar</p>"))]
    rows += [(7, "http://h.example/7", article("<p>" + "long text " * 40_000 + "</p>"))]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, html string, host string, block int")
    got = {r["page_id"]: r["text"] for r in pages.page_report(df).collect()}
    # Text in the main tag's own slot stays, on however many pages it stands.
    assert got[3] == "start own 3 end" and got[6] == "start Prior studies. Costs. foobar end" and len(got[7]) == 400_000 - 1 + len("start  end")


def test_article_text_stays(spark):
    """Neither text that other pages have too nor a name on a page's own container takes text out of the main slot."""
    shared = "<p>This sentence stands on half of the pages.</p>"
    odd = ["search", "hidden", "menu", "comment", "toolbar"]
    rows = []
    for i in range(12):
        inner = f"<p>{'own words ' * 9}{i}</p>" + shared * (i < 6) + f"<div class='notes-search'><p>note {i}</p></div>" + (f"<div class='{odd[i]}'><p>odd {i}</p></div>" if i < 5 else "")
        rows.append((i, "http://h.example/", page(f"<article>{inner}</article>")))
    got = {r["page_id"]: r["text"] for r in pages.page_report(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(12):
        want = [("own words " * 9) + str(i)] + ["This sentence stands on half of the pages."] * (i < 6) + [f"note {i}"] + [f"odd {i}"] * (i < 5)
        assert got[i] == " ".join(want)


def test_slots_of_hosts_without_article(spark):
    """The main slot by brute force over the collected pages: no article or main element, no telling names."""
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    rows, want = [], {}
    for host in range(3):
        for i in range(7):
            lead, parts = say(30), [say(rng.randrange(20, 60)) for _ in range(rng.randrange(1, 4))]
            body = f"<div class='k{host}x q'><p>{lead}</p>" + "".join(f"<section class=z><h2>{say(2)}</h2><p>{x}</p></section>" for x in parts) + "</div>"
            rows.append((host * 10 + i, f"http://host{host}.example/{i}", f"<html><body><div class=u1><p>same on all pages of {host}</p></div>{body}<div class=u2><p>{say(3)}</p></div><footer>{say(4)}</footer></body></html>"))
            want[host * 10 + i] = " ".join(re.sub("<[^>]*>", " ", body).split())
    got = {r["page_id"]: r["text"] for r in pages.page_report(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want
    # The chosen tag holds nearly all text outside of other elements, and no tag nested in it does.
    for host in range(3):
        text = collections.Counter()
        for k, _, source in rows:
            if k // 10 == host:
                p = pages.Page(source)
                for at, x, linked in p.blocks:
                    while True:
                        text[p.paths[at]] += (len(x) - linked) * (not p.outside[at])
                        if at == 0:
                            break
                        at = p.parents[at]
        chosen = next(r["main"] for r in pages.templates(spark.createDataFrame(rows, "page_id bigint, url string, html string")).where(f"host = 'host{host}.example'").collect())
        assert text[chosen] >= pages.NEARLY_ALL * text[0] and sum(x >= pages.NEARLY_ALL * text[0] for x in text.values()) == 4  # page, html, body, it


@pytest.mark.parametrize("source", ["<a " * 350_000, '<a "' * 250_000, "<a '\">' " * 120_000, '<a ">" ' * 140_000, "<!-- <p" * 120_000, "<" * 1_000_000, "<script>" * 120_000, "</div" * 200_000, "<div>" * 60_000 + "</section>" * 60_000 + "x", "<div><b><i>" * 40_000 + "</div></span>" * 40_000 + "x", "<div class='a" * 80_000, "<?" * 300_000, "&" * 1_000_000])
def test_broken_markup_is_scanned_once(source):
    began = time.perf_counter()
    pages.Page(source)
    assert time.perf_counter() - began < 4  # about a megabyte; what grows with the square takes minutes


def test_pieces_of_markup():
    read = lambda x: [b[1] for b in pages.Page(x).blocks]
    assert read("<p title='a > b'>one</p><!-- <p>no</p> -->two <3 & x<y") == ["one", "two <3 & x<y"]
    assert read("<p>a<script>if (1 < 2) '</p>'</script>b</p><style>p{}</style>") == ["ab"]
    assert read("x<!-- open <p>y") == ["x"] and read("x<script>y") == ["x"] and read("a <b unclosed") == ["a <b unclosed"]
    assert read("<DIV>a<br/>b</DIV>c<?php x ?>d<!DOCTYPE e>f") == ["a b", "cdf"]


def test_language_model_decodes_a_trie_once_for_many_blocks(monkeypatch):
    calls, look_up = [], ngrams.Trie.look_up
    monkeypatch.setattr(ngrams.Trie, "look_up", lambda self, *args: calls.append(1) or look_up(self, *args))
    blocks = [(np.array([3, 5 + k], np.uint64), np.array([1, 2], np.uint64), np.array([2, 1], np.uint64), np.array([7, 9 + k, 4], np.uint64), np.array([1, k % 3, 1], np.uint64)) for k in range(50)]
    names = ["tokens", "counts", "sizes", "words", "pair_counts"]
    packed = [[(ngrams.pack_ascending if name == "tokens" else ngrams.pack)(b[i]) for b in blocks] for i, name in enumerate(names)]
    table = pa.table({"shard": pa.array([0] * 50, pa.int32()), "block": pa.array(range(50), pa.int64()), **dict(zip(names, packed))})
    together = ngrams._answer(table)
    assert len(calls) == 1
    monkeypatch.setattr(ngrams, "LOOK_UP_PAIRS", 1)
    assert together.equals(ngrams._answer(table)) and len(calls) == 51
