"""The licence scan against a plain one (whole result), long notices, and prose about licences."""

import math
import random
import re

import pytest

from blockwatch.llm import license
from blockwatch.llm.common import prepare
from tests.conftest import SF_SMALL


def plain_units(text):
    """(paragraph, words) of each line of up to WINDOW words and each window."""
    out = set()
    for n, own in enumerate(re.split(r"\n(?:[ \t\r]*\n)+", text or "")):
        words = license.plain_words(own)
        places = [(i, min(i + license.WINDOW, len(words))) for i in range(0, max(len(words) - license.STEP, 1), license.STEP)]
        at = 0
        for line in own.split("\n"):
            k = len(license.plain_words(line))
            if k <= license.WINDOW:
                places.append((at, at + k))
            at += k
        out |= {(n, a, tuple(words[a:b])) for a, b in places if a < b}
    return out


def plain_scan(rows, model, least):
    at = {w: i for i, w in enumerate(model.words)}
    pair_at = {int(c): i for i, c in enumerate(model.pairs)}
    out = []
    for doc_id, text in rows:
        best = {}
        for n, _, words in plain_units(text):
            logit = list(model.intercept)
            for i, w in enumerate(words):
                if w in at:
                    logit = [x + y for x, y in zip(logit, model.word_weights[at[w]], strict=True)]
                if i + 1 < len(words) and w in at and words[i + 1] in at:
                    j = pair_at.get(at[w] * len(model.words) + at[words[i + 1]])
                    if j is not None:
                        logit = [x + y for x, y in zip(logit, model.pair_weights[j], strict=True)]
            odds = [math.exp(x - max(logit)) for x in logit]
            p = [x / sum(odds) for x in odds]
            if 1 - p[0] >= least:
                f = max(range(1, len(p)), key=p.__getitem__)
                found = (license.similarity(license.FAMILIES[f], set(words)), p[f])
                best[n, license.FAMILIES[f]] = max(best.get((n, license.FAMILIES[f]), found), found)
        out += [(doc_id, n, f, round(p, 6), round(s, 6), s >= license.COVER) for (n, f), (s, p) in best.items()]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def fitted(spark):
    prepare(spark)
    return license.fit(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))


def found(spark, rows, fitted):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, paragraph int, family string")
    return docs, license.scan(docs.repartition(3), *fitted)


def test_whole_result(spark, fitted):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("the of it lane more Stone, wateré and river by a license copy".split()) for _ in range(n))
    pieces = [s for ss in license._sentences().values() for s in ss]
    joins = [" ", "\n", "\n\n", "\n \t\r\n", "\n\n\n", "\r\n"]
    rows = [(None, pieces[0]), (1, None), (2, ""), (3, "\n\n"), (4, "\n\n" + pieces[1]), (5, "日本"), (5, pieces[2]), (5, pieces[2])]
    for i in range(60):
        parts = [rng.choice([prose(rng.randint(0, 50)), rng.choice(pieces)]) for _ in range(rng.randint(1, 6))]
        rows.append((10 + i, "".join(x + rng.choice(joins) for x in parts)))
    rows.append((99, prose(9000) + " " + pieces[3] + " " + prose(9000)))
    _, got = found(spark, rows, fitted)
    got = [tuple(r) for r in got.select("doc_id", "paragraph", "family", "probability", "similarity", "confirmed").collect()]
    want = plain_scan(rows, *fitted)
    assert sorted(((d, n, f, round(p, 6), round(s, 6), c) for d, n, f, p, s, c in got), key=repr) == want
    assert len(want) > 30 and any(w[0] == 99 and w[5] for w in want)


def test_whole_notices_in_long_lines(spark, fitted):
    """Notices of any length, their sentences over 30 words too, on one line between other words."""
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice("the of it lane more stone water and river by a".split()) for _ in range(n))
    rows = [(i, f"{prose(rng.randint(0, 90))} {n} {prose(40)}", f) for i, (f, n) in enumerate((f, n) for f, ns in license.NOTICES.items() for n in ns)]
    _, got = found(spark, [r[:2] for r in rows], fitted)
    got = {(r["doc_id"], r["family"]) for r in got.where("confirmed").collect()}
    want = {(i, f) for i, _, f in rows}
    assert len(got & want) >= 0.95 * len(want)


def test_prose_about_licences_is_not_confirmed(spark, fitted):
    """Sentences that the model did not see."""
    lines = ["A licence to fish costs less than a licence to drive in this country.",
             "The software is free, and its source code may be read by anyone who asks the author for a copy.",
             "Copyright holders sued the platform because users had uploaded their films without permission.",
             "Which license should I choose for my project, and what are the conditions of the more common ones?",
             "The public library keeps a copy of each work that is published in the state.",
             "Redistribution of wealth was the subject of the debate, with or without new taxes on land."]
    _, got = found(spark, [(i, t) for i, t in enumerate(lines)], fitted)
    assert got.where("confirmed").count() == 0


def test_every_text_trains_and_calibrates(spark):
    """Counts of all lines and windows of the texts that are not held out, and a threshold from all of
    those that are (both came from a bounded sample)."""
    from collections import Counter

    from pyspark.sql import functions as F
    prepare(spark)
    rng = random.Random(5)
    texts = ["\n".join(" ".join(rng.choice("the of free license stone river file you may lane public".split())
                                for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 4))) for _ in range(600)]
    texts += ["Released under the MIT License.", "", None, *texts[:20]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    known = license._known()
    at = {w: i for i, w in enumerate(known.words)}
    pair_at = {int(c): i + len(at) for i, c in enumerate(known.pairs)}
    train = [r["text"] for r in docs.where(~license._is_held("text")).select("text").collect()]
    want = Counter()
    for t in train:
        for _, _, words in plain_units(t):
            if max(license.similarity(f, set(words)) for f in license.NOTICES) < 0.5:
                ids = [at[w] for w in words if w in at]
                ids += [pair_at[c] for x, y in zip(words, words[1:], strict=False) if x in at and y in at
                        for c in [at[x] * len(at) + at[y]] if c in pair_at]
                want[tuple(sorted(ids))] += 1
    got = license._unknown_rows(docs, known, "text").collect()
    got = {tuple(r["grams"]): r["n"] for r in got}
    assert got == dict(want) and sum(want.values()) > 500
    model, least = license.fit(docs)
    held = [r["text"] for r in docs.where(license._is_held("text")).select(F.col("text")).collect()]
    called = []
    for t in held:
        for _, _, words in plain_units(t):
            if max(license.similarity(f, set(words)) for f in license.NOTICES) < 0.5:
                x = __import__("pyarrow").array([" ".join(words)])
                word, pair, first, end = next(license._each_unit(x, model))
                called.append(1 - model.probabilities(word, pair, first[:1], end[:1])[0, 0])
    over = sum(c >= least for c in called)
    assert over <= license.FALSE_RATE * len(called) and 0.5 <= least <= 1 + 1 / license.BINS
