"""The multi-bucket (large-input) code paths, forced on small data and checked by brute force.

Every numbering uses sampled range buckets; here their number is patched up, so that a bucket
holds a few rows.
"""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from blockwatch.operators import blocks as B
from blockwatch.operators import rules as R
from blockwatch.operators import position as P


@pytest.fixture()
def small_buckets(monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 5)


def _events(spark):
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        user = 0 if i % 3 == 0 else (i % 7) + 1          # user 0 holds a third of the lines
        gap_hours = 7 if i % 50 == 0 else 0               # occasional long silences
        rows.append((i, base + dt.timedelta(minutes=13 * i + 60 * gap_hours * (i // 50)), user))
    return spark.createDataFrame(rows, "line_no long, ts timestamp_ntz, user_id long")


def _brute_sessions(pdf, gap_s):
    pdf = pdf.sort_values(["user_id", "ts", "pos"])
    prev = pdf.groupby("user_id")["ts"].shift()
    start = prev.isna() | ((pdf["ts"] - prev).dt.total_seconds() > gap_s)
    pdf = pdf.assign(sess=start.groupby(pdf["user_id"]).cumsum())
    first = pdf.groupby(["user_id", "sess"])["pos"].transform("min")
    order = sorted(first.unique())
    return dict(zip(pdf["line_no"], first.map({v: i + 1 for i, v in enumerate(order)})))


def test_idle_gap_sessions_hot_user(spark, small_buckets):
    lines = P.with_position(_events(spark), ["ts", "line_no"], num_partitions=6)
    got = {r.line_no: r.block_id for r in B.idle_gap_sessions(lines, "user_id", "ts", 3600).collect()}
    want = _brute_sessions(lines.toPandas(), 3600)
    assert got == want


def test_key_blocks_and_gaps(spark, small_buckets):
    lines = P.with_position(_events(spark), ["ts", "line_no"], num_partitions=6)
    kb = B.key_blocks(lines, ["user_id"])
    pdf = lines.toPandas()
    first = pdf.groupby("user_id")["pos"].min().sort_values()
    want_id = {u: i + 1 for i, u in enumerate(first.index)}
    got = {r.line_no: (r.user_id, r.block_id) for r in kb.collect()}
    assert all(want_id[u] == b for u, b in got.values())
    gaps = {r.line_no: r.interval_s for r in B.gap_to_previous_in_block(kb, "block_id", "pos", "ts").collect()}
    pdf = pdf.sort_values("pos")
    prev = pdf.groupby("user_id")["ts"].shift()
    want_gap = dict(zip(pdf["line_no"], (pdf["ts"] - prev).dt.total_seconds().fillna(0.0)))
    assert gaps == pytest.approx(want_gap)


def test_sequences_are_compared_item_by_item(spark):
    rows = [(b, p, t) for b, ts in ((1, "ab"), (2, "ba"), (3, "ab"), (4, "abb"), (5, "aa"), (6, "ax")) for p, t in enumerate(ts)]
    lines = spark.createDataFrame(rows, "block_id long, pos long, template string").repartition(7)
    one = lambda ts: spark.createDataFrame([(t,) for t in ts], "template string")
    facts = R.block_facts(lines, one("ab"), one("x"))
    assert {(r.block_id, r._bw_lines, r._bw_bad_tpl, r._bw_unknown) for r in facts.collect()} == {
        (1, 2, False, False), (2, 2, False, False), (3, 2, False, False), (4, 3, False, False), (5, 2, False, False),
        (6, 2, True, True)}
    bad = spark.createDataFrame([(["a", "b"],), (["a", "x"],)], "event_list array<string>")
    got = R.blocks_with_sequence(lines, facts, bad)
    assert {r.block_id for r in got.collect()} == {1, 3}

def test_forward_fill_and_position_many_buckets(spark, small_buckets):
    df = spark.range(500).select("id", F.when(F.col("id") % 37 == 0, F.col("id")).alias("v")).repartition(5)
    got = {r.id: r.v for r in P.forward_fill(df, "v", "id").collect()}
    assert all(got[i] == (i // 37) * 37 for i in range(500))
    pos = {r.id: r.pos for r in P.with_position(df, ["id"], num_partitions=9).collect()}
    assert pos == {i: i for i in range(500)}


def test_exact_percentile_matches_numpy(spark, small_buckets):
    import numpy as np
    vals = [((i * 37) % 101) / 3.0 for i in range(300)]
    df = spark.createDataFrame(list(enumerate(vals)), "id long, d double")
    for p in (0.0, 12.5, 70.0, 99.3, 100.0):
        assert P.exact_percentile(df, "d", "id", p) == pytest.approx(float(np.percentile(vals, p)), abs=1e-9)


def test_scoring_memory_does_not_follow_the_batch():
    """Neighbours leave a task a few queries at a time, whatever the rows of an Arrow batch."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from blockwatch.operators import neighbors as NB
    rng = np.random.default_rng(3)
    ids, labels, cmat = np.arange(50), rng.integers(0, 2, 50), rng.normal(size=(50, 4))
    n = 5 * NB.QUERY_ROWS + 7
    q = rng.normal(size=(n, 4))

    def lists(kind, rows):
        return pa.array(rows, pa.list_(kind))
    batch = pa.record_batch({"query_id": pa.array(range(n), pa.int64()), "vec": lists(pa.float64(), q.tolist()),
                             "nbr_ids": lists(pa.int64(), [[]] * n), "nbr_sims": lists(pa.float64(), [[]] * n),
                             "nbr_labels": lists(pa.int32(), [[]] * n)})
    out = list(NB._score_fn(SimpleNamespace(value=(ids, labels, cmat)), 5, "vec", False)(iter([batch])))
    assert max(b.num_rows for b in out) <= NB.QUERY_ROWS
    got = [r for b in out for r in b["nbr_ids"].to_pylist()]
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (cmat / np.linalg.norm(cmat, axis=1, keepdims=True)).T
    assert got == np.argsort(-cos, axis=1)[:, :5].tolist()
    assert [r for b in out for r in b["nbr_labels"].to_pylist()] == labels[np.array(got)].tolist()
