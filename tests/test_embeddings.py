"""Trained word vectors against dense numpy: counts, PMI, singular space; the same for any partitions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwatch.operators import embeddings as E

SCHEMA = "block_id long, content string, term string, i int, n int, vec int"


@pytest.fixture(scope="module")
def contents():
    rng = random.Random(3)
    topics = [[f"{t}{i}" for i in range(12)] for t in "abc"]
    out = [" ".join(rng.choice(rng.choice(topics) if rng.random() < 0.2 else topics[k % 3]) for _ in range(rng.randint(0, 9))) for k in range(400)]
    return out + [None, "", "  ", "Lone", "a0 a0 a0", "A1\ta2"]


def _dense(contents, window):
    toks = [[t for t in (c or "").lower().split() if t] for c in contents]
    words = Counter(t for ts in toks for t in ts)
    names = sorted(words, key=lambda t: (-words[t], t))
    pairs = Counter()
    for ts in toks:
        for i, a in enumerate(ts):
            for b in ts[i + 1:i + 1 + window]:
                pairs[a, b] += 1
                pairs[b, a] += 1
    at = {t: i for i, t in enumerate(names)}
    c = np.zeros((len(names), len(names)))
    for (a, b), n in pairs.items():
        c[at[a], at[b]] = n
    m = np.zeros_like(c)
    s, total = c.sum(axis=1), c.sum()
    for i, j in zip(*np.nonzero(c), strict=True):
        m[i, j] = max(0.0, math.log(c[i, j] * total / (s[i] * s[j])))
    return names, c, m


def _lines(spark, contents, parts=4):
    return spark.createDataFrame([(i // 5, c, "x", 1, 2, 3) for i, c in enumerate(contents)], SCHEMA).repartition(parts)


def test_counts_and_pmi(spark, contents):
    names, c, m = _dense(contents, 4)
    lines = _lines(spark, contents)
    vocab = E.vocabulary(lines)
    assert [r["term"] for r in vocab.orderBy("idx").collect()] == names
    pairs = E.cooccurrence(lines)
    got = np.zeros_like(c)
    for r in pairs.collect():
        got[names.index(r["a"]), names.index(r["b"])] = r["n"]
    assert (got == c).all()
    got = np.zeros_like(m)
    for r in E.positive_pmi(pairs, vocab).collect():
        got[r["i"], r["j"]] = r["value"]
    assert np.allclose(got, m, atol=1e-12)


def test_singular_space(spark, contents):
    names, _, m = _dense(contents, 4)
    lines = _lines(spark, contents)
    matrix = E.positive_pmi(E.cooccurrence(lines), E.vocabulary(lines))
    vectors, values = E.truncated_svd(matrix, len(names), dim=6, power_steps=6)
    u, s, _ = np.linalg.svd(m)
    k = 3  # the topics' space; the values behind it lie close together, so they come less exactly
    assert s[2] > 3 * s[3]
    assert np.allclose(values[:k], s[:k], rtol=1e-9) and np.allclose(values, s[:6], rtol=1e-3)
    cosines = np.linalg.svd(u[:, :k].T @ vectors[:, :k], compute_uv=False)
    assert cosines.min() > 1 - 1e-6
    assert np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-9)
    # Words of one topic lie closer than words of different ones.
    w = vectors[:, :3] * np.sqrt(values[:3])
    w = w / np.linalg.norm(w, axis=1, keepdims=True)
    topic = np.array([n[0] for n in names])
    known = np.isin(topic, list("abc")) & np.array([n != "lone" for n in names])
    sim, same = (w @ w.T)[np.ix_(known, known)], (topic[:, None] == topic[None, :])[np.ix_(known, known)]
    assert sim[same].mean() > sim[~same].mean() + 0.5


def test_partitions_do_not_matter(spark, contents):
    got = []
    for parts in (1, 7):
        lines = _lines(spark, contents, parts)
        vectors = E.word_vectors(lines, dim=8)
        emb = E.embed_blocks(lines, vectors, dim=8)
        got.append(({r["term"]: tuple(r["vec"]) for r in vectors.collect()}, {r["block_id"]: r["embedding"] for r in emb.collect()}))
    assert got[0][0] == got[1][0]
    assert got[0][1].keys() == got[1][1].keys()
    assert all(np.allclose(got[0][1][b], got[1][1][b], atol=1e-12) for b in got[0][1])
    vecs = got[0][0]
    for b, v in got[0][1].items():
        toks = [t for c in contents[5 * b:5 * b + 5] for t in (c or "").lower().split()]
        want = np.mean([vecs[t] for t in toks], axis=0) if toks else np.zeros(8)
        assert np.allclose(v, want, atol=1e-12)


def test_small_and_empty(spark):
    lines = _lines(spark, ["x y", "x"], 1)
    vectors = E.word_vectors(lines, dim=8)
    assert all(len(r["vec"]) == 8 for r in vectors.collect()) and vectors.count() == 2
    none = lines.where(F.lit(False))
    assert E.word_vectors(none).count() == 0
    assert E.embed_blocks(lines, E.word_vectors(none), dim=32).select(F.array_max("embedding")).distinct().collect()[0][0] == 0.0
    with pytest.raises(ValueError):
        E.truncated_svd(lines, E.MAX_VOCAB + 1)
