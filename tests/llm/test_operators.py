"""Each dealt operator against a plain version, on rows chosen to be awkward."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwatch.llm import bpe, decontaminate, fingerprint, html, license, near, pii, quality, substring, suffix
from blockwatch.llm.common import prepare
from tests.conftest import SF_MID, SF_SMALL
from tests.llm import brute

SCHEMA = ("doc_id long, text string, row string, body long, spans array<int>, items string, digest string, "
          "block int, kind string, n_words double, x double, label int, bucket int, ids long, n_chars int, class_id int")
#: Names of columns that a table may have beside doc_id and text.
EXTRA = ["r", 7, [1], None, "d", 3, "k", 0.5, 1.5, 1, 4, 9, None, 2]


def _texts() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = ["the", "of", "Été", "naïve", "x1", "日本語", "end.", "A,b", "--", "q!"] + [f"w{i}" for i in range(60)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long_ = some(60), some(4000)
    near_copy = passage.split()
    near_copy[3] = "changed"
    out = [
        (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "one"), (10, "a b c d"),
        (11, passage), (3, passage), (12, some(20) + "\n" + passage + "\n\n" + some(9)), (13, " ".join(near_copy)),
        (14, long_), (2, some(5) + " " + long_[:9000]), (15, "z" * 30000), (16, "z" * 200), (17, "ab" * 400 + "\x00" + "ab" * 90),
        (None, passage), (None, None), (3, passage), (18, "\U0001F600" * 70), (19, "\U0001F600" * 60 + " mail me: a.b@c.de."),
        (20, "card 4111 1111 1111 1111, iban DE89370400440532013000 phone +49 (30) 1234567; 10.0.0.255 1.2.3.256 a@b.c_d@e.fg"),
        (21, "1.2.3.4.5.6.7.8 +1+22 33 44 55 66 4111-1111-1111-1111-1 x@@y.z 000255.1.1.1 " + "9" * 5000 + "." * 50),
    ]
    return out + [(100 + i, some(rng.randint(1, 40))) for i in range(30)]


@pytest.fixture(scope="module")
def rows():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    prepare(spark)
    return spark.createDataFrame([], SCHEMA)


def _sorted(values):
    return sorted(values, key=repr)


def test_pii_base_spans_and_redaction(docs, rows, empty):
    got = pii.find_spans(docs).select("row.doc_id", F.col("row.text").alias("t"), "spans").collect()
    assert len(got) == len(rows)
    n = 0
    for r in got:
        base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "iban"]
        assert base == brute.base_spans(r["t"])
        n += len(base)
        if r["doc_id"] == 20:
            assert [s["kind"] for s in r["spans"]].count("iban") == 1
            assert {s["score"] for s in r["spans"] if s["kind"] == "card"} == {0.9}  # "card" stands before it
    assert n >= 8
    spans = {r["t"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in got}
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    want = [(d, t if t is None else brute.redact(t, spans[t])) for d, t in rows]
    assert _sorted((r["doc_id"], r["text"]) for r in clean.collect()) == _sorted(want)
    assert all(r["n_chars"] == len(r["text"]) for r in clean.where("text IS NOT NULL").collect())
    assert pii.redact(empty).count() == 0


def test_fingerprints(spark, docs, rows, empty):
    known = [(d, t) for d, t in rows if d is not None and d != 3]
    got = {r["doc_id"]: r for r in fingerprint.with_next_text(docs.where("doc_id <> 3"), 16).collect()}
    order = sorted(d for d, _ in known)
    texts = dict(known)
    for i, d in enumerate(order):
        assert got[d]["next_text"] == (texts[order[(i + 1) % len(order)]] or "")
    assert fingerprint.with_next_text(docs, 3).count() == len(rows)
    assert fingerprint.with_next_text(empty, 3).count() == 0
    pairs = spark.createDataFrame([("a\nb\n\nc", "a\nx\n\nc"), ("a\n\nb", "a\n\nb"), ("", "a"), ("a", "a\n\nb\nc")], "p string, q string")
    trees = pairs.select(fingerprint.paragraph_digests(F.col("p")).alias("p"), fingerprint.paragraph_digests(F.col("q")).alias("q"))
    out = trees.select((fingerprint.root(F.col("p")) == fingerprint.root(F.col("q"))).alias("same"),
                       fingerprint.differing_paragraphs(F.col("p"), F.col("q")).alias("at")).collect()
    assert [r["same"] for r in out] == [False, True, False, False]
    assert [[tuple(x) for x in r["at"]] for r in out] == [[(0, 1)], [], [(0, 0)], [(1, 0), (1, 1)]]


def test_likeness_follows_the_edit(spark):
    a, b = ("".join(f"{w}{i} stood there, and " for i in range(200)) for w in ("alpha", "omega"))
    half = a[:len(a) // 2] + b[:len(a) // 2]
    df = spark.createDataFrame([(a, half), (a, b), (a, "Yes. " + a)], "p string, q string")
    got = [r[0] for r in df.select(fingerprint.likeness(fingerprint.pieces(F.col("p")), fingerprint.pieces(F.col("q")))).collect()]
    assert 0.4 < got[0] < 0.6 and got[1] < 0.1 and got[2] > 0.95


def test_decontamination(spark, docs, rows, empty, monkeypatch):
    words = brute.plain_words(rows[14][1] or "") or brute.plain_words(rows[10][1])
    items = [(1, " ".join(brute.plain_words(rows[10][1])[100:130]).upper()), (2, "ONE!"), (3, None), (4, ""), (1, "a-b c D"),
             (None, " ".join(brute.plain_words(rows[10][1])[110:125])), (5, " ".join(words[:11])), (6, "the of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = _sorted((d, *brute.contained(t, items)) for d, t in rows)
    for bound in (decontaminate.PART_BYTES, 60):  # 60: several parts
        monkeypatch.setattr(decontaminate, "PART_BYTES", bound)
        got = decontaminate.contained_windows(docs, bench).select("row.doc_id", "n_words", "spans", "items").collect()
        assert _sorted((r["doc_id"], r["n_words"], sum(s["e"] - s["s"] for s in r["spans"]), r["items"]) for r in got) == want
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[3] for w in want) < len(rows)
    none = bench.limit(0)
    assert decontaminate.drop_contaminated(docs, none).count() == len(rows)
    assert decontaminate.drop_contaminated(empty, bench).count() == 0


def test_substring_dedup(docs, rows, empty):
    units = [brute.words(t) for _, t in rows]
    gone = brute.covered(units, [d for d, _ in rows], substring.WINDOW)
    want = _sorted((d, len(u), sum(g), " ".join(w for w, x in zip(u, g, strict=True) if not x))
                   for (d, _), u, g in zip(rows, units, gone, strict=True))
    got = _sorted(tuple(r) for r in substring.remove_repeats(docs).collect())
    assert got == want and any(w[2] for w in want)
    assert substring.remove_repeats(empty).count() == 0


def test_suffix_dedup(docs, rows, empty):
    units = [list((t or "").encode()) for _, t in rows]
    gone = brute.covered(units, [d for d, _ in rows], suffix.LENGTH)
    want = []
    for (d, _), u, g in zip(rows, units, gone, strict=True):
        spans = sum(x and not (i and g[i - 1]) for i, x in enumerate(g))
        want.append((d, len(u), sum(g), spans, bytes(b for b, x in zip(u, g, strict=True) if not x)))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix.remove_long_matches(docs).collect()]
    assert _sorted(got) == _sorted(want) and any(w[2] for w in want)
    assert suffix.remove_long_matches(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_dedup_of_small_alphabets(spark, seed, monkeypatch):
    """Repeats of every kind, over several blocks, with tiny blocks and indexes."""
    rng = random.Random(seed)
    from blockwatch.llm import blocks
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 900)
    monkeypatch.setattr(suffix, "INDEX_BYTES", 2000)
    monkeypatch.setattr(suffix, "SLICE_BYTES", 1500)
    pieces = ["".join(rng.choice("ab \x00") for _ in range(rng.randint(20, 90))) for _ in range(12)]
    data = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    prepare(spark)
    for operator, window, split in ((suffix.remove_long_matches, suffix.LENGTH, lambda t: list(t.encode())),
                                    (substring.remove_repeats, substring.WINDOW, brute.words)):
        gone = brute.covered([split(t) for _, t in data], [d for d, _ in data], window)
        got = {r["doc_id"]: r["n_removed"] for r in operator(df).collect()}
        assert got == {d: sum(g) for (d, _), g in zip(data, gone, strict=True)}


def test_suffix_dedup_of_a_hot_passage(spark, monkeypatch):
    """A passage that all documents share, each with other text beside it: no task holds its anchors whole."""
    from blockwatch.llm import blocks
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 12000)
    monkeypatch.setattr(suffix, "INDEX_BYTES", 4000)
    monkeypatch.setattr(suffix, "SLICE_BYTES", 8000)
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefghij klmn") for _ in range(n))
    passage, ends = some(90), [some(7) for _ in range(40)]
    data = [(i, some(60) + rng.choice(ends) + passage + rng.choice(ends) + some(60)) for i in range(700)]
    data += [(i % 900, passage[10:] + "x" * 60) for i in range(800, 920)]
    largest, marked = [], suffix._marked

    def measured(candidates):
        keys = [c for c in candidates.columns if c not in ("block", "n", "body")]
        largest.append(candidates.groupBy(*keys).agg(F.sum(F.length("body")).alias("b")).agg(F.max("b")).first()[0])
        return marked(candidates)

    monkeypatch.setattr(suffix, "_marked", measured)
    prepare(spark)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    gone = brute.covered([list(t.encode()) for _, t in data], [d for d, _ in data], suffix.LENGTH)
    got = _sorted((r["doc_id"], r["n_removed"]) for r in suffix.remove_long_matches(df).collect())
    assert got == _sorted((d, sum(g)) for (d, _), g in zip(data, gone, strict=True))
    assert largest[0] < 2 * 8000


def test_near_copies(spark, docs, rows, empty):
    want = _sorted((d, *c) for (d, _), c in zip(rows, brute.classes(rows), strict=True))
    want = _sorted((d, c if brute.words(t) else d, n) for (d, t), (c, n) in zip(rows, brute.classes(rows), strict=True))
    got = _sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in near.classes(docs).collect())
    assert got == want
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    classes = {brute.classes(rows)[i][0] if d is not None else d for i, (d, t) in enumerate(rows) if brute.words(t)}
    empties = sum(not brute.words(t) for _, t in rows)
    assert kept.count() == len(classes - {None}) + empties
    assert near.keep_one(empty).count() == 0 and near.classes(empty).count() == 0


def test_near_copies_in_parts(spark, monkeypatch):
    """A group larger than a part: every link is counted, the class is one."""
    monkeypatch.setattr(near, "PART_TEXTS", 8)
    base = [f"t{i}" for i in range(120)]
    data = []
    for i in range(60):
        own = list(base)
        own[i] = f"changed{i}"
        data.append((i, " ".join(own)))
    data += [(200 + i, f"alone{i} " * 7) for i in range(5)]
    prepare(spark)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {d: c for (d, _), c in zip(data, brute.classes(data), strict=True)}
    assert len({c for c, _ in got.values()}) < 10


def test_few_near_copies_in_many_parts(spark, monkeypatch):
    """Groups of 2 to 5 texts dealt to several parts, of which some stay empty: no link counts twice."""
    monkeypatch.setattr(near, "PART_BYTES", 400)
    data = []
    for g in range(24):
        for i in range(2 + g % 4):
            own = [f"g{g}t{j}" for j in range(120)]
            own[i] = f"changed{i}"
            data.append((100 * g + i, " ".join(own)))
    prepare(spark)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {d: c for (d, _), c in zip(data, brute.classes(data), strict=True)}


def test_forest_recall():
    assert near.prefix_depth() == 6
    assert near.prefix_depth(recall=0.5) > near.prefix_depth(recall=0.99999)


def test_html():
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>a b</nav>") == ""
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="ad">Buy this now.</div><article><h1>A &amp; B</h1><p><b>Bold&nbsp;text,
    of one <i>block</i>.<br><p>Next &lt;p&gt; it is, and on.<script>var t="</p>";</script><div class="comments"><p>First! A comment, it is.</div>
    </article><aside>Other, things. Here.</aside><form><p>Your name, please.</form><footer>&copy; x &middot; y</footer>"""
    assert html.main_text(page) == "A & B\n\nBold text, of one block.\n\nNext <p> it is, and on."
    assert html.main_text("plain words, with no markup. They stay here, all of them.").startswith("plain words")
    assert isinstance(html.main_text("<" * 20000 + "<a '" * 5000), str)


@pytest.mark.parametrize("around", ['div class="content with-sidebar"', 'div class="page-has-menu"', 'main class="layout-sidebar-right"',
                                    'div class="two-sidebar-page"', 'main class="sidebar"'])
def test_html_names_around_an_article(around):
    end = f"</{around.split()[0]}>"
    body = '<div class="post-header"><h1>Head line</h1></div><p>Text of it, and more.</p><div class="related-posts"><article>Other one, too.</article></div>'
    want = "Head line\n\nText of it, and more."
    assert html.main_text(f"<nav>Home</nav><{around}><article>{body}</article>{end}<footer>c</footer>") == want
    side = '<div class="sidebar-left"><p>Things, at the side. Here.</p></div><div class="site-header"><p>The site, its name.</p></div>'
    assert html.main_text(f"{side}<article>{body}</article>") == want


def test_html_sentence_marks_late_in_a_block():
    element = html._Element("div", 1, "", None)
    block = html._Block("word " * 100 + "It ends here. And here, too.", element, "div", 0)
    assert html._text_features(block)[html.TEXT_NAMES.index("stops")] == 1.0


def test_minimum_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 8)
        s, t = ([rng.random() for _ in range(n)] for _ in range(2))
        edges = [(rng.randrange(n), rng.randrange(n), rng.random()) for _ in range(2 * n)]

        def cost(side):
            return (sum(t[i] if side[i] else s[i] for i in range(n))
                    + sum(c for a, b, c in edges if a != b and side[a] != side[b]))

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html.minimum_cut(s, t, edges)) - best) < 1e-9


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (2, "u", "<p>Some text, and more of it.</p>", 1), (2, "u", "", 1)],
                                  "page_id long, url string, html string, row int")
    got = html.extract(pages).select("row.page_id", "text").collect()
    assert _sorted(tuple(r) for r in got) == _sorted([(1, ""), (2, "Some text, and more of it."), (2, "")])
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("words", [1, 5])
def test_chunks_are_encoded_as_the_whole(name, words, monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(bpe, "CHUNK_WORDS", words)
    tokenizer = Tokenizer.from_file(bpe.vocabulary(name))
    rng = random.Random(words)
    parts = ["a", "b", " ", "\n", "  ", "\n\n", "'s", "é", "́", "日本", "<|endoftext|>", "<|end", "oftext|>", "12", "!!", "\t", "Σ", "word ", "the "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    encoder = bpe.ChunkEncoder(tokenizer, cache_bytes=20000)  # chunks are forgotten between calls
    for some in (texts[:80], texts[80:], texts[:20]):
        raw = [t.encode() for t in some]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        got = encoder.encode(bpe.chunks_of(np.frombuffer(b"".join(raw), np.uint8), off))
        assert [g.tolist() for g in got] == [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)]
    assert encoder.reused > 0 and (encoder.repaired > 0 or name.startswith("word"))


def test_bpe(docs, rows, empty):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(bpe.vocabulary())
    want = []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), ids, tokenizer.decode(ids, skip_special_tokens=False)))
    got = bpe.encode(docs, bpe.vocabulary()).collect()
    assert _sorted((r["row"]["doc_id"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in got) == _sorted(want)
    assert bpe.encode(empty, bpe.vocabulary()).count() == 0


def test_licenses(spark, docs, empty):
    rng = random.Random(1)
    prose = lambda: " ".join(rng.choice("the of it lane more stone water and river by a".split()) for _ in range(30))
    own = [(i, prose() + "\n" + prose(), None) for i in range(60)]
    own += [(100, prose() + "\nReleased under the MIT License.", "MIT"), (101, "Licensed under the Apache License, Version 2.0.\n" + prose(), "Apache-2.0"),
            (102, "This work is licensed under the GNU General Public License, version 3.", "GPL"), (103, "Licensed under CC BY-NC 4.0.", "CC-BY-NC")]
    table = spark.createDataFrame([o[:2] for o in own], "doc_id long, text string")
    model, least = license.fit(table)
    got = license.scan(table, model, least).where("confirmed").collect()
    assert {(r["doc_id"], r["family"]) for r in got} == {(o[0], o[2]) for o in own if o[2]}
    assert license.scan(docs, model, least).where("confirmed").count() == 0
    assert license.scan(empty, *license.fit(empty)).count() == 0


def test_licenses_in_long_and_wrapped_lines(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("the of it lane more stone water and river by a".split()) for _ in range(n))
    planted = [(f, s) for f, ss in license._sentences().items() for s in ss if len(s.split()) <= 30]
    wrap = lambda s: "\n".join(" ".join(s.split()[i:i + 7]) for i in range(0, len(s.split()), 7))
    own = [(i, prose(30) + "\n\n" + prose(200), None) for i in range(60)]
    own += [(100 + i, f"{prose(rng.randint(50, 300))} {s} {prose(100)}", f) for i, (f, s) in enumerate(planted)]
    own += [(300 + i, f"{prose(30)}\n\n{wrap(s)}\n\n{prose(20)}", f) for i, (f, s) in enumerate(planted)]
    table = spark.createDataFrame([o[:2] for o in own], "doc_id long, text string")
    got = {(r["doc_id"], r["family"]) for r in license.scan(table, *license.fit(table)).where("confirmed").collect()}
    for first in (100, 300):
        want = {(d, f) for d, _, f in own if f and first <= d < first + 200}
        assert len(want & got) >= 0.95 * len(want)
    assert not {d for d, _ in got if d < 100}


def test_quality(spark, docs, rows, empty):
    documents, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    feats = quality.features(documents)
    model = quality.fit(feats, labels)
    got = (quality.score(feats, model).withColumn("held", quality.held_out("doc_id")).join(labels, "doc_id")
           .where("held").toPandas())
    assert len(got) > 50 and ((got.score >= quality.THRESHOLD) == (got.quality == 1)).mean() > 0.97
    scores = [r["score"] for r in quality.score(quality.features(docs), model).collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
    assert quality.keep_good(docs, model).columns == docs.columns
    odd = spark.createDataFrame([(None, 1), (5, None), (5, 3), (6, 1), (6, 1), (6, 0)], "doc_id long, quality int")
    blank = quality.fit(quality.features(docs), odd)
    assert {r["score"] for r in quality.score(quality.features(docs), blank).collect()} == {0.5}
    assert quality.keep_good(empty, model).count() == 0


def test_held_out_rows_do_not_train(spark):
    documents, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    feats = quality.features(documents)
    a = quality.fit(feats, labels)
    b = quality.fit(feats, labels.where(~quality.held_out("doc_id")))
    assert all(np.allclose(x, y) for x, y in zip(a.mean + a.factor, b.mean + b.factor, strict=True))
