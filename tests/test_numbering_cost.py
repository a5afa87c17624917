"""F8: the steps that made pseudo_label_detector slow are taken once a row, and give the same."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwatch.operators import fusion as FU
from blockwatch.operators import neighbors as NB
from blockwatch.operators import position as P


def test_bucket_search_is_compiled_and_not_repeated(spark):
    """No lambda searches the bounds, and no filter inferred from the join searches them again."""
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    plan = P.with_position(df, ["k", "id"], num_partitions=9)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    assert not [line for line in plan.splitlines() if "Filter" in line]


@pytest.mark.parametrize("buckets", [1, 2, 3, 8, 9, 33])
def test_buckets_are_ranges_of_keys(spark, buckets):
    rows = [((i * 37) % 11 if i % 5 else 3, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, id long").repartition(6)
    order = [i for _, i in sorted(rows)]
    pos = {r.id: r.pos for r in P.with_position(df, ["k", "id"], num_partitions=buckets).collect()}
    assert pos == {i: p for p, i in enumerate(order)}
    placed = {r.id: r.own for r in P.bucketed(df, ["k", "id"], buckets, name="own").collect()}
    along = [placed[i] for i in order]
    assert along == sorted(along) and len(set(along)) > buckets // 2 and max(along) < buckets


def _best_of_all(sims, k):
    """Top k by (similarity of nine digits descending, column)."""
    return np.array([np.lexsort((np.arange(len(row)), -np.rint(row * 1e9)))[:k] for row in sims])


@pytest.mark.parametrize("digits", [1, 4, 9, 12])
def test_best_columns_with_ties(digits):
    rng = np.random.default_rng(digits)
    for n, k in ((1, 3), (40, 20), (1300, 20), (2000, 5), (700, 1)):
        sims = np.round(rng.uniform(-1, 1, size=(17, n)), digits) + rng.uniform(-1, 1, size=(17, n)) * 1e-10
        sims[3] = sims[3, 0]  # all alike
        sims[4, : n // 2] = -2.0
        assert NB._topk_rows(sims, np.arange(n), k).tolist() == _best_of_all(sims, min(k, n)).tolist()


def test_few_columns_of_a_row_are_ranked(monkeypatch):
    sims = np.random.default_rng(5).uniform(-1, 1, size=(NB.QUERY_ROWS, 5000))
    ranked, keys = [], NB._rank_keys
    monkeypatch.setattr(NB, "_rank_keys", lambda s, c, n: ranked.append(s.size) or keys(s, c, n))
    NB._topk_rows(sims, np.arange(5000), 20)
    assert sum(ranked) < sims.size // 50


@pytest.mark.parametrize("sigmoid", [False, True])
def test_weight_is_that_of_the_least_loss(spark, sigmoid):
    rows = [(0.1 * (i % 11), 0.07 * (i % 13), None if i == 5 else int(i % 3 > 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "p double, e double, y int")
    clog = lambda x: max(math.log(x), -100.0) if x > 0 else -100.0

    def loss(w):
        out = []
        for p, e, y in rows:
            if y is not None:
                s = w * p + (1 - w) * e
                s = 1 / (1 + math.exp(-s)) if sigmoid else min(max(s, 0.0), 1.0)
                out.append(-(y * clog(s) + (1 - y) * clog(1 - s)))
        return sum(out) / len(out)
    want = min((round(loss(i / 100), 9), i / 100) for i in range(101))
    fit = FU.fit_fusion_weight(df, "p", "e", "y", sigmoid=sigmoid)
    got = fit.first()
    assert (got.w, got.loss) == (want[1], pytest.approx(want[0], abs=1e-8))
    assert FU.fit_fusion_weight(df.where("y > 1"), "p", "e", "y", sigmoid=sigmoid).count() == 0
