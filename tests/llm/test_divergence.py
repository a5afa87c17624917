"""The divergence audit against whole-number arithmetic over dense counts."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from blockwatch.llm import divergence
from blockwatch.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, terms int, vector string, at int, p int, model string, n long, v long, no int"
EXTRA = [1, "v", 2, 3, "m", 4, 5, 6]


def plain(rows):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub(
        "[A-Z]", lambda m: m.group().lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in docs}:
        df = Counter(t for x in docs if x[0] == lang for t in set(x[2]))
        kept = sorted(t for t in df if df[t] >= 10)
        groups = {}
        for x in docs:
            if x[0] == lang:
                groups.setdefault(x[1], Counter()).update(t for t in x[2] if df[t] >= 10)
        whole = sum(groups.values(), Counter())
        share = lambda c, t: 1 + 1000000000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        far = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: {t: share(c, t) for t in kept} for s, c in groups.items()}
        q = {t: share(whole, t) for t in kept}
        for s, c in groups.items():
            pairs = [("pair", o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [("term", t, far(p[s][t], q[t])) for t in kept if c[t] and p[s][t] > q[t]]
            for part in (pairs, terms):
                part.sort(key=lambda x: (-x[2], x[1].encode()))
            out += [(lang, s, *x, i) for i, x in enumerate(pairs, 1)]
            out += [(lang, s, *x, i) for i, x in enumerate(terms[:10], 1)]
    return sorted(out)


def rows_of_all_kinds():
    rng = random.Random(11)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70)] + ["École", "naïve", "\U0001F600", "日本", "ABC", "İ"]
    out = [(None, None, None), ("", "en", "s0"), ("12 -- 3", "en", "wordless"), ("rare words here", "xx", "only"), ("one", "yy", "a"), ("one", "yy", "b")]
    for i in range(400):
        lang = ["en", "en", "de", None, "a\x1fb $1"][i % 5]
        source = "hot" if rng.random() < 0.4 else rng.choice([None, "", "s1", "s2", "é", "z\x1f", "S3"])
        out.append((" ".join(rng.choice(words) + rng.choice(["", ".", "1", "\x1f", "_"]) for _ in range(rng.randint(0, 30))), lang, source))
    out += [("same words " * 5, "tie", s) for s in "abcde" for _ in range(4)]
    return out + out[:40]


@pytest.fixture(scope="module")
def rows():
    return rows_of_all_kinds()


@pytest.fixture(scope="module")
def docs(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, *r, *EXTRA) for i, r in enumerate(rows)], SCHEMA).repartition(5)


def found(df):
    return sorted(tuple(r) for r in divergence.divergence(df).select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_dense_counts(docs, rows):
    want = plain(rows)
    assert found(docs) == want
    assert {w[2] for w in want} == {"pair", "term"} and any(w[4] == 0 for w in want)


def test_several_models_blocks_and_tiles(docs, rows, monkeypatch):
    for name, value in (("MODEL_TERMS", 60), ("ESTIMATE", 1), ("BLOCK_TERMS", 7), ("TILE", 3)):
        monkeypatch.setattr(divergence, name, value)
    terms = divergence._documents(docs)
    assert divergence._models_for(terms) > 2
    assert found(docs) == plain(rows)


def test_no_kept_terms_and_empty(spark, docs):
    few = docs.where("doc_id < 6")
    got = found(few)
    assert got == plain([tuple(r) for r in few.select("text", "lang", "source").collect()])
    assert got and all(g[4] == 0 for g in got)
    assert found(docs.limit(0)) == []


def test_shares_of_counts_beyond_a_product_of_64_bits(spark):
    cases = [(0, 0, 1), (5, 5, 1), (10 ** 15, 9 * 10 ** 15, 10 ** 9), (3 * 10 ** 12, 4 * 10 ** 12 + 7, 12345)]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10 ** 9 * (c + 2) // (n + 2 * v) for c, n, v in cases]


def test_a_chunk_hands_each_term_over_as_often_as_its_counts_need(spark):
    prepare(spark)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]
    docs = spark.createDataFrame([(i, " ".join(words), "en", "s") for i in range(400)], "doc_id long, text string, lang string, source string").coalesce(1)
    keys = divergence._documents(docs).select(F.sum(F.size("keys"))).first()[0]
    # Once for each document before (40,400 and more); now MIN_DOCS times for the fit, and by the digits of 400.
    assert keys <= (divergence.MIN_DOCS + 8) * 101


def test_rows_of_chunks_add_up(rows, monkeypatch):
    """Whatever the chunks and the cuts of their rows: documents count up to MIN_DOCS, occurrences in all."""
    import pyarrow as pa
    texts = [(t, l or "", s or "") for t, l, s in rows if (l or "").isalnum() or not l]
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t for t, _, _ in texts], pa.string()), "lang": [l for _, l, _ in texts],
                                        "source": [s for _, _, s in texts], "code": [l for _, l, _ in texts]})
    df, occurrences = Counter(), Counter()
    for t, lang, source in texts:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        df.update({f"{w}\x1f{lang}" for w in found} | {"\x1f"})
        occurrences.update((lang, source, f"{w}\x1f{lang}") for w in found)
    for chunk, keys in ((1 << 20, 2000), (1 << 20, 7), (500, 3), (1, 2000)):
        monkeypatch.setattr(divergence, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(divergence, "ROW_KEYS", keys)
        seen, sums, first = Counter(), Counter(), 0
        for out in divergence._chunks([batch]):
            for r in out.to_pylist():
                assert 0 < len(r["keys"]) <= keys and len(set(r["keys"])) == len(r["keys"])
                first += r["layer"] == -1
                for k in r["keys"]:
                    if r["layer"] < 0:
                        seen[k] += 1
                    elif k != "\x1f":
                        sums[r["lang"], r["source"], k] += 1 if r["layer"] == 0 else 2 ** (r["layer"] - 1)
        assert sums == occurrences and seen.keys() == df.keys()
        assert all((seen[k] >= 10) == (df[k] >= 10) and seen[k] <= df[k] for k in df) and first >= 10
