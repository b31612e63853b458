"""Licence scans with a trained paragraph classifier.

A paragraph is a run of lines without a blank line between; a notice that is broken into lines stays
whole. A sparse logistic regression over hashed word n-grams (one to three words) gives each window of
a paragraph and of its lines (``WINDOW`` words, beginning every ``STEP`` words; a shorter one is one
window) the probabilities of the licence families and of an unknown class; a family's probability is
its share against the unknown class alone, so that two licences in one window don't hide each other. It is trained here, on the notices below
with words left out, cut and set into other text, against windows of the documents. The threshold of
each family is calibrated against windows of documents that were kept out of training. Every family
above its threshold is a prediction, so a paragraph may hold several; it counts once a template
comparison confirms it: enough of the three-word shingles of one of the family's notices occur within
``STEP`` words around the window, and no other family's notice explains all of them and more.

Training uses a bounded sample of documents (at most ``SAMPLE_PARAGRAPHS`` paragraphs, ordered by a hash
of their text, their first ``SAMPLE_CHARS`` characters); the scan covers every window of every text.

Cases: null and empty texts have no paragraphs; paragraphs of any length are taken whole, in bounded
memory; rows may repeat and ids may be null, each row is scanned by itself; without documents to sample,
the unknown class is learned from shuffled notice words; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W

# Notices by licence family.
NOTICES = {
    "agpl": ("GNU Affero General Public License version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Licensed under the AGPL-3.0", "GNU Affero General Public License"),
    "apache": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0", "Apache License", "Apache License, Version 2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "Use of this source code is governed by a BSD-style license", "Released under the BSD License", "BSD License", "BSD 3-Clause License", "BSD 2-Clause License"),
    "cc-by": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "This article is distributed under the terms of the Creative Commons Attribution License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution Non Commercial license"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    "cc0": ("Dedicated to the public domain under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "CC0 1.0 Universal Public Domain Dedication"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GPL version 2 or later", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU General Public License"),
    "isc": ("ISC License", "Released under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "lgpl": ("GNU Lesser General Public License version 2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the LGPL-3.0", "GNU Lesser General Public License"),
    "mit": ("MIT License", "The MIT License (MIT)", "Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "SPDX-License-Identifier: MIT"),
    "mpl": ("Mozilla Public License", "Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    "proprietary": ("All rights reserved", "This document is confidential and proprietary and may not be reproduced without prior written permission", "Unauthorized copying of this file, via any medium, is strictly prohibited"),
    "unlicense": ("The Unlicense", "This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary"),
}

SAMPLE_DOCS = 300
#: Paragraphs of the sample that train the unknown class, and the characters taken of each.
SAMPLE_PARAGRAPHS = 6_000
SAMPLE_CHARS = 2_000
COPIES = 120
#: Words of a window, and between the beginnings of two.
WINDOW = 24
STEP = 12
#: Share of a notice's shingles that confirms a prediction.
CONFIRM = 0.6
#: Share of the unknown windows that may pass a family's threshold in calibration.
ERRORS = 0.001
#: Windows scored at once; bounds the sums held for a very long paragraph.
_AT_ONCE = 4_096
_DIMS = 1 << 16
_GRAMS = (1, 2, 3)

FAMILIES = sorted(NOTICES)


def _buckets(h: np.ndarray, size: int) -> np.ndarray:
    return (W.window_hashes(h, size) >> np.uint64(48)).astype(np.int64)


def _of_paragraphs(paragraphs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each n-gram, its paragraph)."""
    parts = [p.encode() for p in paragraphs]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    data = W.LOWER[np.frombuffer(b"".join(parts), np.uint8)]
    starts, ends, of = W.split(data, offsets, W.NOT_ALNUM)
    h = W.hash_words(data, starts, ends)
    feature, paragraph = [], []
    for size in _GRAMS:
        g = _buckets(h, size)
        inside = of[: len(g)] == of[size - 1 :] if len(g) else np.zeros(0, bool)
        feature.append(g[inside])
        paragraph.append(of[: len(g)][inside])
    return np.concatenate(feature), np.concatenate(paragraph)


def _words(text: str) -> list[str]:
    data = W.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = W.split(data, np.array([0, len(data)]), W.NOT_ALNUM)
    raw = data.tobytes()
    return [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist())]


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


TEMPLATES = {family: [_shingles(_words(n)) for n in notices] for family, notices in NOTICES.items()}


def confirmed(words: list[str], line: list[str] = ()) -> set[str]:
    """Families of which the words hold enough of a notice that no other family's notice explains better.

    ``line``: words of a line; one that is too short for a shingle counts as one by itself.
    """
    own = _shingles(words) | (_shingles(line) if len(line) < 3 else set())
    held = {}
    for family, notices in TEMPLATES.items():
        best = max(((len(own & t) / len(t), own & t) for t in notices), key=lambda x: (x[0], len(x[1])))
        if best[0] >= CONFIRM:
            held[family] = best[1]
    return {f for f, seen in held.items() if not any(seen < other for other in held.values())}


def paragraph_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts begin and where a line with text follows a blank one, and the end."""
    lines = np.union1d(offsets, np.flatnonzero(data == 10) + 1).astype(np.int64)
    ink = np.concatenate(([0], np.cumsum(~W.SPACES[data])))
    filled = ink[lines[1:]] > ink[lines[:-1]]
    begins = filled & ~np.concatenate(([False], filled))[: len(filled)]
    return np.union1d(offsets, lines[:-1][begins]).astype(np.int64)


def windows(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after the last) of the windows of all parts; ``of``: each word's part."""
    first = np.flatnonzero(np.diff(of, prepend=-1))
    size = np.diff(first, append=len(of))
    number = 1 + np.maximum(0, -(-(size - WINDOW) // STEP))
    which = np.repeat(np.arange(len(first)), number)
    low = first[which] + STEP * (np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number))
    return low, np.minimum(low + WINDOW, (first + size)[which])


class Classifier:
    """Softmax regression over hashed n-grams; the last class is the unknown one."""

    def __init__(self) -> None:
        self.weights = np.zeros((_DIMS, len(FAMILIES) + 1), np.float32)
        self.bias = np.zeros(len(FAMILIES) + 1, np.float32)
        self.least = np.full(len(FAMILIES), 0.5)

    def probabilities(self, feature: np.ndarray, paragraph: np.ndarray, n: int) -> np.ndarray:
        """Class probabilities of ``n`` paragraphs."""
        size = np.bincount(paragraph, minlength=n)
        z = np.zeros((n, len(self.bias)), np.float32)
        for k in range(len(self.bias)):
            z[:, k] = np.bincount(paragraph, self.weights[:, k][feature], n)
        return self._normal(z, size)

    def _normal(self, z: np.ndarray, size: np.ndarray) -> np.ndarray:
        z = z / np.sqrt(np.maximum(size, 1))[:, None] + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    @staticmethod
    def against_unknown(p: np.ndarray) -> np.ndarray:
        """Each family's probability if it or the unknown class holds."""
        return p[:, :-1] / (p[:, :-1] + p[:, -1:])

    def of_windows(self, h: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Class probabilities of the windows of word hashes, by running sums of the n-grams' weights."""
        z, size = np.zeros((len(low), len(self.bias))), np.zeros(len(low), np.int64)
        for gram in _GRAMS:
            total = np.zeros((max(len(h) - gram + 1, 0) + 1, len(self.bias)))
            np.cumsum(self.weights[_buckets(h, gram)], axis=0, dtype=np.float64, out=total[1:])
            a = np.minimum(low, len(total) - 1)
            b = np.maximum(high - gram + 1, a)
            z += total[b] - total[a]
            size += b - a
        return self._normal(z, size)

    def train(self, paragraphs: list[str], labels: np.ndarray, rounds: int = 60, rate: float = 20.0) -> None:
        feature, paragraph = _of_paragraphs(paragraphs)
        n, k = len(paragraphs), len(self.bias)
        scale = 1 / np.sqrt(np.maximum(np.bincount(paragraph, minlength=n), 1))
        truth = np.eye(k, dtype=np.float32)[labels]
        balance = 1 / (np.maximum(truth.sum(0), 1) * k)
        used = np.unique(feature)
        for _ in range(rounds):
            miss = (truth - self.probabilities(feature, paragraph, n)) * balance[labels][:, None]
            slope = np.zeros_like(self.weights)
            for c in range(k):
                slope[:, c] = np.bincount(feature, (miss[:, c] * scale)[paragraph], _DIMS)
            self.weights[used] += rate * slope[used] - 1e-4 * self.weights[used]
            self.bias += rate * miss.sum(0) * 0.1

    def calibrate(self, unknown: list[str]) -> None:
        """The least probability of each family that at most a share of ``ERRORS`` of the unknown windows reaches."""
        p = self.against_unknown(self.probabilities(*_of_paragraphs(unknown), len(unknown)))
        for c in range(len(FAMILIES)):
            wrong = np.sort(p[:, c])[::-1]
            self.least[c] = min(0.99, max(0.5, float(wrong[int(ERRORS * len(wrong))]) + 1e-6)) if len(wrong) else 0.5


def _examples(unknown: list[str], seed: int, copies: int) -> tuple[list[str], np.ndarray]:
    """Windows of notices with words left out, cut and set into other text, and unknown windows."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for k, family in enumerate(FAMILIES):
        for i in range(copies):
            words = str(rng.choice(NOTICES[family])).split()
            keep = rng.random(len(words)) > (0.1 if i % 2 and len(words) > 8 else 0.0)
            words = [w for w, x in zip(words, keep) if x]
            if len(words) > WINDOW:
                at = int(rng.integers(len(words) - WINDOW + 1))
                words = words[at : at + WINDOW]
            if i % 4 and unknown:
                other = unknown[rng.integers(len(unknown))].split()[: WINDOW - len(words)]
                at = int(rng.integers(len(other) + 1))
                words = other[:at] + words + other[at:]
            texts.append(" ".join(words))
            labels.append(k)
    return texts + unknown, np.array(labels + [len(FAMILIES)] * len(unknown))


def fit(paragraphs: list[str]) -> Classifier:
    """Train and calibrate against windows of the given paragraphs; those that hold a notice are left out."""
    rng = np.random.default_rng(7)
    unknown = []
    for p in paragraphs:
        words = _words(p)
        at = int(rng.integers(max(1, len(words) - WINDOW + 1)))
        if words and not confirmed(words):
            unknown.append(" ".join(words[at : at + WINDOW]))
    bag = [w for notices in NOTICES.values() for n in notices for w in n.split()]
    unknown += [" ".join(rng.choice(bag, int(rng.integers(3, 12)))) for _ in range(200)]  # notice words alone are no notice
    model = Classifier()
    model.train(*_examples([p for i, p in enumerate(unknown) if i % 3], 1, COPIES))
    model.calibrate([p for i, p in enumerate(unknown) if i % 3 == 0])
    return model


def fit_on(docs: DataFrame) -> Classifier:
    """Fit on paragraphs of a bounded sample of documents, the same in any order of the rows."""
    texts = docs.select("text").where(F.col("text").isNotNull() & (F.col("text") != ""))
    rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(max(1, docs.count() // SAMPLE_DOCS))) == 0)
    found = rows.select(F.explode(F.split("text", "\n")).alias("part")).select(F.substring("part", 1, SAMPLE_CHARS).alias("part")).where(F.length(F.btrim("part")) > 0)
    return fit([r["part"] for r in found.distinct().orderBy(F.xxhash64("part"), "part").limit(SAMPLE_PARAGRAPHS).collect()])


def _found(model: Classifier, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
    """(number of paragraphs, confirmed families) of each text of a block."""
    n, data = len(offsets) - 1, W.LOWER[data]
    cuts = paragraph_cuts(data, offsets)
    starts, ends, of = W.split(data, cuts, W.NOT_ALNUM)
    rows: list[list[dict]] = [[] for _ in range(n)]
    if not len(of):
        return np.zeros(n, np.int64), rows
    kept, of = np.unique(of, return_inverse=True)
    doc = np.searchsorted(offsets, cuts[kept], "right") - 1
    first = np.searchsorted(doc, np.arange(n + 1), "left")
    bounds = np.searchsorted(of, np.arange(len(kept) + 1), "left")
    h = W.hash_words(data, starts, ends)
    line = np.searchsorted(np.union1d(cuts, np.flatnonzero(data == 10)), starts, "right")
    low, high = np.unique(np.concatenate([windows(of), windows(line)], axis=1), axis=1)
    best: dict[tuple[int, int], float] = {}
    for i in range(0, len(low), _AT_ONCE):
        a, b = low[i : i + _AT_ONCE], high[i : i + _AT_ONCE]
        p = model.against_unknown(model.of_windows(h[a[0] : b.max()], a - a[0], b - a[0]))
        passed = p >= model.least
        for w in np.flatnonzero(passed.any(1)).tolist():
            part = int(of[a[w]])
            x, y = max(int(a[w]) - STEP, int(bounds[part])), min(int(b[w]) + STEP, int(bounds[part + 1]))
            near = [data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace") for k in range(x, y)]
            families = confirmed(near, near[int(a[w]) - x : int(b[w]) - x])
            for c in np.flatnonzero(passed[w]).tolist():
                if FAMILIES[c] in families:
                    best[part, c] = max(best.get((part, c), 0.0), float(p[w, c]))
    for (part, c), probability in sorted(best.items()):
        rows[doc[part]].append({"paragraph": part - int(first[doc[part]]), "family": FAMILIES[c], "probability": probability})
    return np.diff(first), rows


def scan(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """Return (doc_id, n_paragraphs, found array<struct<paragraph: int, family: string, probability: double>>)."""
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model or fit_on(docs)))

    @W.released
    def run(batches):
        own = pickle.loads(held.value)
        kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64())]))
        for batch in batches:
            counts, out = [], []
            for _, data, offsets in W.text_blocks(batch.column("text"), 1 << 20):
                numbers, rows = _found(own, data, offsets)
                counts += numbers.tolist()
                out += rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(out, kind)], names=["doc_id", "n_paragraphs", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_paragraphs bigint, found array<struct<paragraph: int, family: string, probability: double>>")


def license_report(docs: DataFrame) -> DataFrame:
    """Return (doc_id, n_paragraphs, n_found, families): confirmed paragraphs and their families, comma-joined."""
    families = F.array_join(F.array_sort(F.array_distinct(F.col("found.family"))), ",")
    return scan(docs).select("doc_id", "n_paragraphs", F.size("found").cast("bigint").alias("n_found"), families.alias("families"))
