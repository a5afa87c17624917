"""License scans: a paragraph classifier with an unknown class, confirmed by template comparison.

Words are runs of ASCII letters and digits, small letters; paragraphs stand between blank lines.
Judged are a paragraph's lines of up to ``WINDOW`` words and, its lines joined, its windows of WINDOW
words, each ``STEP`` after the one before, so a sentence is found however its lines are wrapped and
whatever stands beside it. A multinomial logistic regression (Spark ML) over counts of words and word
pairs, those of the notices and sentences below, gives the probability of each licence family and of
``unknown``. It is trained on the notices, by pieces of ``PIECE`` words, alone and inside up to a window
of other words; as unknown, on every line and window of the corpus that holds less than half of any
notice, counted by their known words and pairs and together as heavy as ``UNKNOWN_WEIGHT`` rows, and on
prose *about* licences. One text in five (by its hash) is held out: over all of their lines and windows
the least probability is found at which at most ``FALSE_RATE`` of them are called a licence, and below
it a line or window stays unknown. What is called is confirmed if it holds ``COVER`` of the words of one
of the family's pieces.

The model is linear in counts, so a task looks up each word and pair once, and the scores of all
lines and windows are differences of running sums.

One row is returned for each paragraph and family that it is called, of its most similar line or
window: doc_id, paragraph (from 0; a run of blank lines divides once), family, probability,
similarity, confirmed. Null and empty texts and paragraphs without words have no rows; repeated
documents have their rows each; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwatch.llm.common import byte_table, byte_view, lean, query, row_slices, table, words_of, written

#: Weight of all lines and windows of the corpus against the notices; the share of held-out ones called
#: a licence; the share of a piece's words that confirms.
UNKNOWN_WEIGHT, FALSE_RATE, COVER = 8_000.0, 0.005, 0.7
#: Steps of probability in which the held-out calls are counted, and of texts, one in so many is held out.
BINS, HELD = 1 << 16, 5
UNKNOWN = "unknown"
#: Words of a window, from one window to the next, and of a piece of a notice (half of it and more
#: lies in some window, wherever it begins).
WINDOW, STEP, PIECE = 30, 15, 20
#: Lines and windows that are scored at a time.
_AT_ONCE = 1 << 14

# Notices by which public licences are applied to a work.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction. The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the Apache License. You may obtain a copy of the License "
        "at http://www.apache.org/licenses/LICENSE-2.0.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later "
        "version. You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation.",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license.",
        "Released under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
}
# Prose about licences, which is none.
ABOUT = [
    "The licence fee is due at the end of March and pays for the public broadcaster.",
    "She lost her driving licence after the accident and had to pass the test again.",
    "Copyright law is taught in the second year of the course.",
    "Many companies prefer a permissive license because it lets them keep their changes private.",
    "The court ruled that the software had been distributed without permission of its author.",
    "Our lawyers compared the terms of several open source licenses before the release.",
    "The museum put the photographs into the public domain last year.",
    "He read the licence agreement twice and still did not understand it.",
    "The foundation publishes free software and collects donations for its developers.",
    "A creative writing class meets in the commons room every Tuesday.",
    "The apache helicopter landed near the village in the early morning.",
    "Fishing without a license is punished with a fine in this county.",
    "The general public is invited to the opening of the new library.",
    "The author has written a version of the story for children.",
    "Students at MIT built a robot that follows the rules of the game.",
    "You may not park here except with written permission of the owner.",
    "A copy of the report was distributed with the minutes of the meeting.",
    "This project is funded by the state and supervised by the university.",
    "The source of the river lies in the mountains and its form changes with the seasons.",
    "All rights reserved is printed on the first page of nearly every book.",
]

FAMILIES = [UNKNOWN, *NOTICES]
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_WORD = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122)


def plain_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def _sentences() -> dict[str, list[str]]:
    """The sentences of each family's notices, long ones in pieces."""
    out: dict[str, list[str]] = {}
    for family, notices in NOTICES.items():
        pieces = set()
        for s in {s.strip() for n in notices for s in n.split(". ")}:
            words = s.split()
            n = -(-len(words) // PIECE)
            size = -(-len(words) // n)
            pieces |= {" ".join(words[i:i + size]) for i in range(0, len(words), size)}
        out[family] = sorted(p for p in pieces if len(p.split()) > 3)
    return out


def similarity(family: str, words: set[str]) -> float:
    """The largest share of a piece of the family that the words hold."""
    return max(len(own & words) / len(own) for own in _templates()[family])


def _templates(kept: dict[str, list[set[str]]] = {}) -> dict[str, list[set[str]]]:  # noqa: B006
    if not kept:
        kept.update({f: [set(plain_words(s)) for s in ss] for f, ss in _sentences().items()})
    return kept


# ---- lines and windows of a block of texts -------------------------------------------

def _units(data: np.ndarray, off: np.ndarray):
    """Lower-cased bytes; start and end of each word; first and last-but-one word, row and paragraph of
    each line and window."""
    low = _LOWER[data]
    start, end, row = words_of(low, off, _WORD)
    feeds = np.flatnonzero(low == 10)
    # A line feed with only blanks since the one before makes a blank line; one run of them divides once.
    solid = np.concatenate([[0], np.cumsum((low != 32) & (low != 9) & (low != 13) & (low != 10))])[feeds]
    same_row = np.searchsorted(off, feeds, side="right")
    blank = np.zeros(len(feeds), bool)
    blank[1:] = (solid[1:] == solid[:-1]) & (same_row[1:] == same_row[:-1])
    first = blank.copy()
    first[1:] &= ~blank[:-1] | (solid[1:] != solid[:-1])
    runs = np.concatenate([[0], np.cumsum(first)])  # runs of blank lines before each line feed
    by_word = runs[np.searchsorted(feeds, start)]
    by_row = runs[np.searchsorted(feeds, off[:-1])]
    n = len(start)
    if n == 0:
        return low, start, end, *(np.zeros(0, np.int64) for _ in range(4))
    line = np.searchsorted(feeds, start)

    def spans(key: np.ndarray):
        a = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]))
        return a, np.append(a[1:], n)

    p_first, p_end = spans(by_word)
    count = np.maximum(-(-(p_end - p_first - STEP) // STEP), 1)
    w_first = np.repeat(p_first, count) + STEP * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    w_end = np.minimum(w_first + WINDOW, np.repeat(p_end, count))
    l_first, l_end = spans(line)
    short = l_end - l_first <= WINDOW
    u_first, u_end = np.concatenate([w_first, l_first[short]]), np.concatenate([w_end, l_end[short]])
    both = np.unique(np.stack([u_first, u_end], axis=1), axis=0)  # a line that is a window counts once
    u_first, u_end = both[:, 0], both[:, 1]
    return low, start, end, u_first, u_end, row[u_first], by_word[u_first] - by_row[row[u_first]]


@dataclass
class Model:
    """Weights (grams by families) of a multinomial regression over counts of words and pairs."""

    words: list[str]
    word_weights: np.ndarray
    pairs: np.ndarray  # first word * len(words) + second word, ascending
    pair_weights: np.ndarray
    intercept: np.ndarray

    def gram_rows(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word its row of ``word_weights``, for each word and the next that of ``pair_weights``;
        the last row (of zeros) where the model has none."""
        step = np.zeros(len(low) + 1, np.int8)
        step[start] += 1
        step[end] -= 1
        own = np.ascontiguousarray(low[np.cumsum(step[:-1], dtype=np.int8).astype(bool)])
        at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(own)]).dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=pa.array(self.words, pa.large_string()))
        word = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy()]
        code = np.where((word[:-1] >= 0) & (word[1:] >= 0), word[:-1] * len(self.words) + word[1:], -1)
        place = np.searchsorted(self.pairs, code)
        found = np.append(self.pairs, -2)[place] == code
        return np.where(word >= 0, word, len(self.words)), np.append(np.where(found, place, len(self.pairs)), len(self.pairs))

    def probabilities(self, word: np.ndarray, pair: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each unit (words ``first`` up to ``end``), from running sums."""
        a = first.min()
        single = self.word_weights[word[a:end.max()]]
        double = self.pair_weights[pair[a:end.max()]]
        zero = np.zeros((1, single.shape[1]))
        singles = np.concatenate([zero, np.cumsum(single, axis=0)])
        doubles = np.concatenate([zero, np.cumsum(double, axis=0)])
        first, end = first - a, end - a
        logit = self.intercept + singles[end] - singles[first] + doubles[end - 1] - doubles[first]
        odds = np.exp(logit - logit.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


# ---- fitting -----------------------------------------------------------------------

def _known() -> Model:
    """The words and pairs of the notices and of the prose about licences, without weights."""
    bodies = [plain_words(t) for t in [*(x for xs in _sentences().values() for x in xs), *ABOUT]]
    words = sorted({w for b in bodies for w in b})
    at = {w: i for i, w in enumerate(words)}
    pairs = np.array(sorted({at[x] * len(words) + at[y] for b in bodies for x, y in zip(b, b[1:], strict=False)}), np.int64)
    k = len(FAMILIES)
    return Model(words, np.zeros((len(words) + 1, k)), pairs, np.zeros((len(pairs) + 1, k)), np.zeros(k))


def _grams(model: Model, word: np.ndarray, pair: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A row for each unit (words ``first`` up to ``end``): its known words, then len(words) + its known
    pairs, ascending, filled up with -1 in front."""
    at = first[:, None] + np.arange(WINDOW)
    w = np.where(at < end[:, None], word[np.minimum(at, len(word) - 1)], len(model.words))
    p = np.where(at + 1 < end[:, None], pair[np.minimum(at, len(pair) - 1)], len(model.pairs))
    both = np.concatenate([np.where(w < len(model.words), w, -1), np.where(p < len(model.pairs), p + len(model.words), -1)], axis=1)
    return np.sort(both.astype(np.int16), axis=1)


def _noticed(model: Model, grams: np.ndarray) -> np.ndarray:
    """Which rows hold half of the words of a piece of a notice, or more."""
    at = {w: i for i, w in enumerate(model.words)}
    pieces = [{at[w] for w in own} for pieces in _templates().values() for own in pieces]
    holds = np.zeros((len(model.words), len(pieces)), np.float32)
    for j, own in enumerate(pieces):
        holds[list(own), j] = 1 / len(own)
    has = np.zeros((len(grams), len(model.words) + 1), np.float32)
    has[np.arange(len(grams))[:, None], np.where((grams >= 0) & (grams < len(model.words)), grams, len(model.words))] = 1
    return ((has[:, :-1] @ holds) >= 0.5 - 1e-6).any(axis=1)


def _each_unit(column: pa.Array, model: Model) -> Iterator[tuple]:
    """Word and pair rows, and first and last-but-one words of up to _AT_ONCE units of a column of texts."""
    data, off = byte_view(column)
    for i, j in row_slices(off):
        low, start, end, first, last, _, _ = _units(data[off[i]:off[j]], off[i:j + 1] - off[i])
        if len(first):
            word, pair = model.gram_rows(low, start, end)
            for c in range(0, len(first), _AT_ONCE):
                yield word, pair, first[c:c + _AT_ONCE], last[c:c + _AT_ONCE]


def _is_held(text: str) -> F.Column:
    return F.pmod(F.xxhash64(text), F.lit(HELD)) == 0


def _unknown_rows(docs: DataFrame, known: Model, text: str) -> DataFrame:
    """The known words and pairs of the lines and windows of the texts that are not held out, and how
    many have the same (grams, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for word, pair, first, end in _each_unit(b.column(0), known):
                grams = _grams(known, word, pair, first, end)
                grams = np.ascontiguousarray(grams[~_noticed(known, grams)])
                rows, n = np.unique(grams.view(f"V{grams.shape[1] * 2}").ravel(), return_counts=True)
                grams = rows.view(np.int16).reshape(len(rows), -1)
                ends = np.concatenate([[0], np.cumsum((grams >= 0).sum(axis=1))])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(grams[grams >= 0], pa.int16())),
                                                  pa.array(n, pa.int64())], names=["grams", "n"])

    rows = docs.where(~_is_held(text)).select(text).mapInArrow(lean(run), "grams array<smallint>, n bigint")
    return rows.groupBy("grams").agg(F.sum("n").alias("n"))


def _examples() -> list[tuple[str, int]]:
    """Bodies and labels of the notices, alone and among other words, and of the prose about licences."""
    others = [(plain_words(ABOUT[k % len(ABOUT)]) + plain_words(ABOUT[(7 * k + 3) % len(ABOUT)]))[:WINDOW] if k % 2
              else ["0"] * WINDOW for k in range(64)]  # every other time words that are not known
    rows = [(b, 0) for b in ABOUT]
    for family, sentences in _sentences().items():
        for s in sentences:
            rows.append((s, FAMILIES.index(family)))
            for k, w in enumerate(others):  # among other words, before or behind
                cut = w[:2 + k % 9]
                rows.append((" ".join([*cut, s] if k % 4 < 2 else [s, *cut]), FAMILIES.index(family)))
                room = max(0, WINDOW - len(s.split()))  # a full window, at any place in it
                at = room * (k % 8) // 7
                rows.append((" ".join([*w[:at], s, *w[at:room]]), FAMILIES.index(family)))
    for b in ABOUT:
        rows += [(" ".join([b, *w[:k % 12]]), 0) for k, w in enumerate(others)]
    return rows


def fit(docs: DataFrame, text: str = "text") -> tuple[Model, float]:
    """The model, and the probability below which a line or window is unknown."""
    spark, known = docs.sparkSession, _known()
    fixed = []
    for body, label in _examples():
        data = np.frombuffer(" ".join(plain_words(body)[:WINDOW]).encode(), np.uint8)
        for word, pair, first, end in _each_unit(pa.array([data.tobytes().decode()]), known):
            row = _grams(known, word, pair, first[:1], end[:1])[0]
            fixed.append(([int(g) for g in row if g >= 0], label, 1.0))
    rows = written(_unknown_rows(docs, known, text), "license-rows")
    total = rows.agg(F.sum("n")).first()[0] or 1
    examples = spark.createDataFrame(fixed, "grams array<smallint>, label int, weight double").unionByName(
        rows.select("grams", F.lit(0).alias("label"), (F.col("n") * (UNKNOWN_WEIGHT / total)).alias("weight")))
    vocabulary = [str(i) for i in range(len(known.words) + len(known.pairs))]
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").transform(
        examples.withColumn("grams", F.col("grams").cast("array<string>")))
    fitted = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial",
                                regParam=0.001, maxIter=40).fit(counted)
    weights, zero = fitted.coefficientMatrix.toArray().T, np.zeros((1, len(FAMILIES)))
    model = Model(known.words, np.concatenate([weights[:len(known.words)], zero]), known.pairs,
                  np.concatenate([weights[len(known.words):], zero]), fitted.interceptVector.toArray())
    return model, _least(docs, model, text)


def _least(docs: DataFrame, model: Model, text: str) -> float:
    """The least step of probability, 0.5 at least, that at most FALSE_RATE of the held-out lines and
    windows reach; those that hold half of a notice are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for word, pair, first, end in _each_unit(b.column(0), model):
                plain = ~_noticed(model, _grams(model, word, pair, first, end))
                if plain.any():
                    called = 1 - model.probabilities(word, pair, first[plain], end[plain])[:, 0]
                    step, n = np.unique(np.maximum(np.floor(called * BINS), BINS // 2 - 1).astype(np.int64), return_counts=True)
                    yield pa.record_batch({"step": pa.array(step), "n": pa.array(n, pa.int64())})

    # At most BINS / 2 + 2 rows.
    counts = docs.where(_is_held(text)).select(text).mapInArrow(lean(run), "step bigint, n bigint").groupBy("step").agg(
        F.sum("n").alias("n")).collect()
    left = FALSE_RATE * sum(r["n"] for r in counts)
    for r in sorted(counts, key=lambda r: -r["step"]):
        left -= r["n"]
        if left < 0:
            return max(0.5, (r["step"] + 1) / BINS)  # the step above the first that is too many
    return 0.5


# ---- scanning -----------------------------------------------------------------------

def scan(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The paragraphs of ``docs`` that the model calls a licence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the size of the fixed texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            data, off = byte_view(b.column(1))
            for i, j in row_slices(off):
                low, start, end, first, last, row, paragraph = _units(data[off[i]:off[j]], off[i:j + 1] - off[i])
                if len(first) == 0:
                    continue
                word, pair = own.gram_rows(low, start, end)
                best: dict[tuple[int, int, int], tuple[float, float]] = {}
                for c in range(0, len(first), _AT_ONCE):
                    f, e = first[c:c + _AT_ONCE], last[c:c + _AT_ONCE]
                    p = own.probabilities(word, pair, f, e)
                    for u in np.flatnonzero(1 - p[:, 0] >= least):
                        family = int(p[u, 1:].argmax()) + 1
                        words = {low[start[x]:end[x]].tobytes().decode() for x in range(f[u], e[u])}
                        key = (int(row[c + u]), int(paragraph[c + u]), family)
                        found = (similarity(FAMILIES[family], words), float(p[u, family]))
                        best[key] = max(best.get(key, found), found)
                keys = sorted(best)
                yield pa.record_batch({
                    "doc_id": b.column(0).slice(i, j - i).take(pa.array([x[0] for x in keys], pa.int64())),
                    "paragraph": pa.array([x[1] for x in keys], pa.int64()),
                    "family": pa.array([FAMILIES[x[2]] for x in keys], pa.string()),
                    "probability": pa.array([best[x][1] for x in keys], pa.float64()),
                    "similarity": pa.array([best[x][0] for x in keys], pa.float64())})

    found = docs.select(F.col("doc_id").cast("bigint"), F.col(text)).mapInArrow(
        lean(run), "doc_id bigint, paragraph bigint, family string, probability double, similarity double")
    return found.withColumn("confirmed", F.col("similarity") >= COVER)


@query("op7_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, *fit(docs))
