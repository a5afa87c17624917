"""Hand-computed goldens (FIXTURES.md section 3), one per operator edge case."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from blockwatch.functions import lists, parsing, text, timefmt
from blockwatch.operators import blocks as B
from blockwatch.operators import evaluate as EV
from blockwatch.operators import features as FT
from blockwatch.operators import fusion as FU
from blockwatch.operators import keywords as KW
from blockwatch.operators import neighbors as NB
from blockwatch.operators import pseudo as PS
from blockwatch.operators import rules as R
from blockwatch.operators.position import split_positional, with_position
from blockwatch.operators.sampling import flip_label


def test_parse_log_line(spark):
    df = spark.createDataFrame([("- 2015-10-17 15:37:56,547 [main] INFO  hello",),
                                ("2015-10-17 15:37:56,547 [main] ERROR disk",),
                                ("2015-10-17 15:37:56,547 [main] FATAL x",),
                                ("    at java.lang.Thread",)], "value string")
    out = df.select(parsing.parse_log_line("value").alias("p"), parsing.is_log_line("value").alias("ok")).collect()
    assert out[0].p.ts_text == "2015-10-17 15:37:56,547"
    assert (out[0].p.level, out[0].p.content, out[0].p.status) == ("INFO", "hello", "success")
    assert out[1].p.status == "fail" and out[1].p.content == "disk"
    assert out[2].p is None and out[3].p is None
    assert [r.ok for r in out] == [True, True, False, False]


def test_mask_variables(spark):
    df = spark.createDataFrame([("from /10.1.2.3:50010: ok",)], "c string")
    assert df.select(parsing.mask_variables("c")).first()[0] == "from <*> ok"


def test_compact_datetime(spark):
    df = spark.createDataFrame([(81109, 3518), (991109, 0), (1234567, 0)], "d int, t int")
    out = [r[0] for r in df.select(timefmt.parse_compact_datetime("d", "t")).collect()]
    assert out[0] == dt.datetime(2008, 11, 9, 0, 35, 18)
    assert out[1].year == 1999
    assert out[2] is None


def test_coerce_datetime(spark):
    df = spark.createDataFrame([("2005.06.03", "15:42:50"), ("2005.06.03", "bad")], "d string, t string")
    out = [r[0] for r in df.select(timefmt.coerce_datetime("d", "t")).collect()]
    assert out[0] == dt.datetime(2005, 6, 3, 15, 42, 50) and out[1] is None


def test_intervals(spark):
    df = spark.createDataFrame([([dt.datetime(2020, 1, 1, 0, 0, 0), None, dt.datetime(2020, 1, 1, 0, 0, 5),
                                  dt.datetime(2020, 1, 1, 0, 0, 3)],)], "ts array<timestamp>")
    assert df.select(B.intervals_from_times(F.col("ts"))).first()[0] == [0.0, 0.0, 0.0, -2.0]


def test_parse_list_literal(spark):
    df = spark.createDataFrame([("['E1', 'E2']",), ("[1, 22]",), ("[]",), ("[1, oops",)], "s string")
    out = [r[0] for r in df.select(lists.parse_list_literal("s")).collect()]
    assert out == [["E1", "E2"], ["1", "22"], [], None]


def test_fixed_count_blocks(spark):
    lines = spark.range(45).select(F.col("id").alias("pos"), F.lit("-").alias("label"),
                                   F.lit("E1").alias("template_id"), F.lit("x").alias("content"),
                                   F.lit(None).cast("timestamp").alias("ts"))
    blocks = B.summarize_blocks(B.fixed_count_blocks(lines, 20), F.col("label") == "-")
    got = sorted((r.block_id, r.n_lines) for r in blocks.collect())
    assert got == [(1, 20), (2, 20), (3, 5)]


def test_all_normal(spark):
    df = spark.createDataFrame([(1, "-"), (1, "-"), (2, "-"), (2, "X"), (3, "-"), (3, None)], "b int, l string")
    out = dict(df.groupBy("b").agg(B.all_normal(F.col("l") == "-")).collect())
    assert out == {1: "success", 2: "fail", 3: "fail"}


def _offsets(spark, secs):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, base + dt.timedelta(seconds=s)) for i, s in enumerate(secs)],
                                 "line_no long, ts timestamp_ntz")


def test_tumbling_blocks(spark):
    rows = B.time_blocks(_offsets(spark, [0, 10, 1800, 5400]), "ts", 1800).collect()
    got = sorted((r.line_no, r.window_k, r.block_id) for r in rows)
    assert got == [(0, 0, 1), (1, 0, 1), (2, 1, 2)]


def test_hopping_blocks(spark):
    rows = B.window_index(_offsets(spark, [0, 700, 1900, 2000]), "ts", 1800, 600).collect()
    by_k = {}
    for r in rows:
        by_k.setdefault(r.window_k, set()).add(r.line_no)
    assert by_k == {0: {0, 1}, 1: {1, 2, 3}, 2: {2, 3}, 3: {2, 3}}


def test_gapped_blocks(spark):
    rows = B.window_index(_offsets(spark, [0, 50, 100, 110, 70]), "ts", 60, 100).collect()
    by_k = {}
    for r in rows:
        by_k.setdefault(r.window_k, set()).add(r.line_no)
    assert by_k == {0: {0, 1}, 1: {2, 3}}


def test_label_flip_and_split(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "s int")
    assert [r[0] for r in df.select(flip_label("s")).collect()] == [1, 0, 0]
    s = split_positional(spark.range(11).withColumnRenamed("id", "pos"), "pos", 0.8)
    counts = dict(s.groupBy("split").count().collect())
    assert counts == {"train": 8, "test": 3}


def test_tfidf(spark):
    blocks = spark.createDataFrame([(1, ["E1", "E1", "E2"]), (2, ["E1"])], "block_id long, event_list array<string>")
    terms = FT.block_terms(blocks)
    model = FT.fit_tfidf(terms, blocks)
    idf = {r.term: r.idf for r in model.collect()}
    assert idf["e1"] == pytest.approx(1.0) and idf["e2"] == pytest.approx(math.log(1.5) + 1)
    w = {(r.block_id, r.term): r.weight for r in FT.apply_tfidf(terms, model).collect()}
    assert w[(1, "e1")] == pytest.approx(0.818180, abs=1e-6)
    assert w[(1, "e2")] == pytest.approx(0.574961, abs=1e-6)
    assert w[(2, "e1")] == pytest.approx(1.0)


def test_pad_top3_minmax(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0],)], "v array<double>")
    assert [r[0] for r in df.select(lists.pad_or_truncate("v", 4)).collect()][0] == [1.0, 2.0, 0.0, 0.0]
    assert [r[0] for r in df.select(lists.pad_or_truncate("v", 2)).collect()][1] == [1.0, 2.0]
    e = spark.createDataFrame([([-0.1, 0.4, 0.2, 0.3],)], "e array<double>")
    assert e.select(lists.weighted_top3_error("e")).first()[0] == pytest.approx(61.0)
    mm = FT.minmax_scale(spark.createDataFrame([(2.0,), (4.0,), (6.0,)], "x double"), "x")
    assert sorted(r.x_scaled for r in mm.collect()) == [0.0, 0.5, 1.0]
    flat = FT.minmax_scale(spark.createDataFrame([(5.0,), (5.0,)], "x double"), "x")
    assert [r.x_scaled for r in flat.collect()] == [0.0, 0.0]


def test_knn(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 1.0], 0), (3, [0.0, 1.0], 1)],
                                  "block_id long, embedding array<double>, label int")
    q = spark.createDataFrame([(10, [1.0, 0.0])], "block_id long, embedding array<double>")
    nb = NB.top_k_neighbors(q, store, 2, max_rows=3).first()
    assert list(nb.nbr_ids) == [1, 2]
    assert NB.normal_probability(NB.top_k_neighbors(q, store, 2, max_rows=3)).first().prob == 0.5
    assert NB.anomaly_percent(NB.top_k_neighbors(q, store, 2, max_rows=3)).first().score == 50.0
    assert len(NB.top_k_neighbors(q, store, 20, max_rows=3).first().nbr_ids) == 3
    with pytest.raises(ValueError):
        NB.top_k_neighbors(q, store, 2, max_rows=2)


def test_knn_chunked_equals_single(spark):
    store = spark.range(50).select(F.col("id").alias("block_id"),
                                   F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("embedding"),
                                   (F.col("id") % 2).cast("int").alias("label"))
    q = spark.range(100, 110).select(F.col("id").alias("block_id"),
                                     F.array(F.cos("id"), F.sin("id"), F.lit(0.1)).alias("embedding"))
    one = {r.query_id: list(r.nbr_ids) for r in NB.top_k_neighbors(q, store, 5, max_rows=50).collect()}
    many = {r.query_id: list(r.nbr_ids)
            for r in NB.top_k_neighbors(q, store, 5, max_rows=50, max_broadcast_bytes=400).collect()}
    assert one == many
    alone = NB.top_k_neighbors(store, store, 3, max_rows=50, max_broadcast_bytes=600, exclude_self=True).collect()
    assert all(len(r.nbr_ids) == 3 and r.query_id not in r.nbr_ids for r in alone)
    with_self = NB.top_k_neighbors(store, store, 3, max_rows=50, max_broadcast_bytes=600).collect()
    assert all(r.nbr_sims[0] == pytest.approx(1.0) for r in with_self)


def test_percentile_filter(spark, monkeypatch):
    df = spark.range(10).select("id", F.col("id").cast("double").alias("d"))
    kept = sorted(r.d for r in PS.percentile_filter(df, "d", 70.0).collect())
    assert kept == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    from blockwatch.operators import position as P
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 3)
    assert P.exact_percentile(df, "d", "id", 70.0) == pytest.approx(6.3)
    assert P.exact_percentile(df, "d", "id", 100.0) == 9.0
    many = spark.range(1000).select("id", ((F.col("id") * 7919) % 1000 / 7.0).alias("d"))
    import numpy as np
    want = float(np.percentile([((i * 7919) % 1000) / 7.0 for i in range(1000)], 99.3))
    assert P.exact_percentile(many, "d", "id", 99.3) == pytest.approx(want, abs=1e-9)


def test_keywords(spark):
    df = spark.createDataFrame([(1, "panic x | error corrected"), (2, "detected"), (3, "error | corrected"),
                                (4, "ok")], "block_id int, content string")
    out = {r.block_id: (r.kw_score, r.kw_label) for r in KW.keyword_labels(df).collect()}
    assert out == {1: (1, 0), 2: (-1, 0), 3: (0, 1), 4: (0, 1)}
    d = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id int, v string, o int")
    assert KW.dedupe_last_wins(d, "id", "v", "o").first().v == "b"
    agree = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)], "id int, real int, fake int")
    rows = {r["class"]: r.accuracy for r in KW.label_agreement(agree, "fake", "real").collect()}
    assert rows[1] == 0.5


def _rule_sets(spark):
    container = spark.createDataFrame(
        [(1, ["A", "B"], 1), (2, ["A", "X"], 0), (3, ["X", "Y"], 0), (4, ["B", "A"], 0), (5, [], 0)],
        "block_id long, event_list array<string>, label int")
    normal = R.normal_template_set(container)
    return container, normal, R.abnormal_template_set(container, normal), R.known_bad_sequences(container, normal)


def test_rule_sets(spark):
    _, normal, abnormal, bad = _rule_sets(spark)
    assert {r.template for r in normal.collect()} == {"A", "B"}
    assert {r.template for r in abnormal.collect()} == {"X"}
    assert sorted(tuple(r.event_list) for r in bad.collect()) == [(), ("B", "A")]


def test_percentile_and_flag(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (5.0,), (9.0,)], "s double")
    t = df.select(F.percentile("s", F.lit(0.993))).first()[0]
    assert t == pytest.approx(8.916)
    one = spark.createDataFrame([(9.0,)], "s double")
    assert one.select(R.score_flag(F.col("s"), F.lit(9.0), True), R.score_flag(F.col("s"), F.lit(9.0), False)) \
        .first() == (True, False)


def test_verdict_cascade(spark):
    _, normal, abnormal, bad = _rule_sets(spark)
    blocks = spark.createDataFrame(
        [(1, ["B", "A"], 0.0), (2, ["A", "X"], 0.0), (3, ["A", "B"], 60.0), (4, ["A", "B"], 0.0),
         (5, ["Z"], 0.0), (6, None, 0.0)], "block_id long, event_list array<string>, score double")
    out = {r.block_id: (r.verdict, r.reason)
           for r in R.verdict_cascade(blocks, normal, abnormal, bad, F.lit(50.0)).collect()}
    assert out == {1: (0, "bad_sequence"), 2: (0, "bad_template"), 3: (0, "score"), 4: (1, "all_normal"),
                   5: (1, "default"), 6: (None, "unparseable")}


def test_fusion(spark):
    df = spark.createDataFrame([(1.0, 0.5)], "p double, e double")
    assert df.select(FU.fused_score(F.col("p"), F.col("e"), 0.8)).first()[0] == pytest.approx(0.9)
    s = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)], "s double, y int")
    best = FU.threshold_grid_search(s, "s", "y").first()
    assert best.train_f1 == 1.0 and best.threshold == pytest.approx(0.1 + 13 * 0.8 / 99, abs=1e-9)
    zero = spark.createDataFrame([(0.1, 0), (0.2, 0)], "s double, y int")
    z = FU.threshold_grid_search(zero, "s", "y").first()
    assert (z.train_f1, z.threshold) == (0.0, 0.0)


def test_fusion_weight_fit_prefers_informative_feature(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1), (0.0, 1.0, 0), (0.9, 0.2, 1), (0.1, 0.7, 0)],
                               "p double, e double, y int")
    assert FU.fit_fusion_weight(df, "p", "e", "y").first().w == 1.0


def test_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (0, 0)], "y int, p int")
    m = EV.binary_metrics(df, "y", "p").first()
    assert m.accuracy == 0.75 and m.precision == 1.0 and m.recall == pytest.approx(2 / 3)
    rep = {r.row: r for r in EV.classification_report(df, "y", "p").collect()}
    assert rep["1"].f1_score == pytest.approx(0.8) and rep["1"].support == 3
    assert rep["0"].precision == 0.5 and rep["0"].recall == 1.0
    assert rep["macro avg"].f1_score == pytest.approx(0.733333, abs=1e-6)
    assert rep["weighted avg"].f1_score == pytest.approx(0.766667, abs=1e-6)
    assert rep["accuracy"].f1_score == 0.75


def test_hashed_vector(spark):
    df = spark.createDataFrame([("A b",), ("",)], "t string")
    v = [r[0] for r in df.select(text.hashed_vector("t")).collect()]
    assert len(v[0]) == 32 and all(-1.0 <= x <= 1.0 for x in v[0])
    assert v[1] == [0.0] * 32


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_position_partition_independent(spark, parts, monkeypatch):
    from blockwatch.operators import position as P
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 10)  # force the sampled multi-bucket path
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.col("id")).repartition(7)
    pos = with_position(df, ["k", "id"], num_partitions=parts)
    rows = pos.select("k", "pos").collect()
    assert sorted(r.pos for r in rows) == list(range(1000))
    assert all(r.pos == r.k for r in rows)


def test_position_with_hot_key_and_timestamps(spark, monkeypatch):
    from blockwatch.operators import position as P
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 10)
    base = dt.datetime(2024, 1, 1)
    # a third of the rows share one timestamp: the unique (ts, id) key still splits them
    rows = [(i, base if i % 3 == 0 else base + dt.timedelta(seconds=i)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    got = {r.id: r.pos for r in with_position(df, ["ts", "id"], num_partitions=16).collect()}
    want = {i: p for p, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == want
    b = P.bucketed(df, ["ts", "id"], 16)
    sizes = [r["count"] for r in b.groupBy("_bw_bucket").count().collect()]
    assert max(sizes) < 200


def test_forward_fill(spark, monkeypatch):
    from blockwatch.operators import position as P
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 10)
    df = spark.range(300).select("id", F.when(F.col("id") % 50 == 0, F.col("id")).alias("v"))
    got = {r.id: r.v for r in P.forward_fill(df, "v", "id").collect()}
    assert all(got[i] == (i // 50) * 50 for i in range(300))


def test_encoder_hook_encodes_distinct_texts_once(spark):
    from blockwatch.operators import features as FT
    calls = spark.sparkContext.accumulator(0)

    def encoder(texts):
        calls.add(len(texts))
        return [[len(t), t.count("a")] for t in texts]

    lines = spark.createDataFrame([(1, "aa"), (1, "b"), (1, "aa"), (2, None), (3, "abc")] * 20, "block_id long, content string")
    got = {r.block_id: list(r.embedding) for r in FT.embed_with_encoder(lines, encoder, 2).collect()}
    assert got[1] == pytest.approx([5 / 3, 4 / 3]) and got[2] == [0.0, 0.0] and got[3] == [3.0, 1.0]
    assert calls.value == 4


def test_parse_keeps_what_is_no_line_feed(spark):
    """Against the pattern as Python reads it: any white space is a blank, only a line feed ends a line."""
    import re
    pattern = re.compile(r"([\-]?)\s*(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) \[.*?\] (INFO|ERROR|WARN|DEBUG)\s*(.*)")
    head = "2024-01-02 03:04:05,678 [t] INFO"
    values = [f"{m}{b}{head}{b}a{c}b" for m in ("", "-", "--") for b in (" ", "", "\u00a0", "\u3000 \t", "\u2028", "\x1c", "\x0b")
              for c in ("", " ", "\r", "\u0085", "\u2028", "\u2029", "\n", "\x0c")]
    values += [head.replace("[t]", f"[t{c}u]") for c in ("\r", "\u0085", "\u2028", "\n", "]")] + ["", "x", head + " "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string")
    got = {r["i"]: tuple(r["p"]) for r in df.select("i", parsing.parse_log_line("value").alias("p")).collect() if r["p"]}
    want = {}
    for i, v in enumerate(values):
        m = pattern.match(v)
        if m:
            want[i] = (m[2], m[3], m[4], "success" if m[1] == "-" else "fail")
    assert {i: (p[0], p[2], p[3], p[4]) for i, p in got.items()} == want
    lines = parsing.parse_lines(df).select("i", "p.content").collect()
    assert {r["i"]: r["content"] for r in lines} == {i: w[2] for i, w in want.items()}
