"""Radix selection against numpy: ties, signs, infinities, tiny values, NULLs; no sort, no numbering."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwatch.operators import position as P

CASES = {
    "ties": [3.0] * 50 + [1.0] * 3 + [7.0] * 40,
    "signs": [random.Random(1).uniform(-5, 5) for _ in range(301)],
    "close": [1.0 + i * 2.0 ** -52 for i in range(100)] + [-1.0 - i * 2.0 ** -52 for i in range(100)],
    "wide": [(-1) ** i * 10.0 ** (i % 600 - 300) for i in range(800)],
    "tiny": [5e-324 * i for i in range(-20, 40)],
    "one": [2.5],
    "two": [1.0, 2.0],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_percentiles_are_numpys(spark, name):
    vals = CASES[name]
    df = spark.createDataFrame([(v, "x") for v in vals] + [(None, "y")] * 7, "v double, key string").repartition(3)
    for p in (0.0, 12.5, 50.0, 99.3, 100.0):
        assert P.exact_percentile(df, "v", None, p) == float(np.percentile(vals, p))


def test_infinities_and_nothing(spark):
    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in [inf, -inf, 0.0, inf, 1.0, -inf, None, -0.0]], "v double")
    ranks = sorted([inf, -inf, 0.0, inf, 1.0, -inf, -0.0])
    assert P.order_statistics(df, "v", lambda n: list(range(n))) == ranks
    assert P.exact_percentile(df, "v", None, 100.0) == inf and P.exact_percentile(df, "v", None, 0.0) == -inf
    assert P.exact_percentile(df.where("v IS NULL"), "v", None, 50.0) is None
    assert P.order_statistics(df.limit(0), "v", lambda n: [0]) == []


def test_plain_passes(spark):
    """A pass is a filter and one aggregate: no sort, no window, and a histogram that does not grow."""
    df = spark.range(
        200000).select((F.pmod(F.xxhash64("id"), F.lit(10 ** 9)) / 7e5 - 300).alias("v"))
    plan = df.select(P.ordered_bits(F.col("v")).alias("key")).groupBy(F.shiftright("key", 48)).count()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in text.replace("SortAggregate", "") and "Window" not in text
    vals = [r["v"] for r in df.collect()]
    assert P.exact_percentile(df, "v", None, 70.0) == float(np.percentile(vals, 70.0))
