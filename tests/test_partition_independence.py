
import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

QUERIES = ["blocks_by_key", "blocks_idle_gap", "mine_templates", "verdict_cascade", "fusion_detector",
           "split_hash"]


def _rows(df):
    cols = sorted(df.columns)
    norm = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_same_result_under_1_8_37_partitions(spark, name):
    results = []
    for parts in (1, 8, 37):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            results.append(_rows(E.queries()[name](spark, SF_SMALL)))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]
