"""Plan guards: no cartesian products or nested-loop joins in the main queries' plans."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

QUERIES = ["global_position", "blocks_fixed_20", "blocks_by_key", "blocks_tumbling_30m", "blocks_hopping",
           "blocks_idle_gap", "block_rows_annotated", "mine_templates", "preprocess_end_to_end",
           "tfidf_block_terms", "recon_error_top3", "knn_anomaly_pct", "verdict_cascade",
           "cascade_detector", "fusion_detector", "keyword_labelling", "half_split_by_class"]


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", QUERIES)
def test_no_cross_or_nested_loop_joins(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scan_is_pruned(spark):
    # pages has (page_id, url, html); masking needs two of them
    plan = _plan(E.queries()["mask_variables"](spark, SF_SMALL))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan


def test_neighbours_are_scored_once(spark):
    """The scores are written before the threshold and the join read them: no scoring is left in the plan."""
    import __spark_entry__ as E
    from tests.conftest import SF_SMALL
    for name in ("cascade_detector", "verdict_cascade", "score_flag"):
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" not in plan, name


def test_numbering_has_no_unpartitioned_window_over_lines(spark):
    """Windows without a partition stand only over tables of one row a bucket (above an aggregate)."""
    import re

    from blockwatch.operators.position import with_position
    plan = with_position(spark.range(100), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [row_number" in line:
            assert "_bw_bucket" in re.split(r"row_number\(\) windowspecdefinition\(", line)[1].split(",")[0]
