"""Model inference: distinct texts only, bounded batches, one load a worker; detectors take any encoder."""

import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwatch.operators import features as FT
from blockwatch.plans import detectors as D
from blockwatch.sources import views
from tests.conftest import SF_SMALL


def test_batches_and_loads(spark):
    n_loads, n_batches, texts = (spark.sparkContext.accumulator(0) for _ in range(3))

    def load():
        n_loads.add(1)

        def encode(batch):
            assert 0 < len(batch) <= 7
            n_batches.add(1)
            texts.add(len(batch))
            return np.array([[len(t), t.count("a")] for t in batch])
        return encode

    rows = [(i % 10, None if i % 50 == 0 else f"a{i % 40}") for i in range(2000)]
    lines = spark.createDataFrame(rows, "block_id long, content string").repartition(3)
    got = {r["block_id"]: r["embedding"] for r in FT.embed_with_encoder(lines, load=load, dim=2, batch=7).collect()}
    for b in range(10):
        own = [t or "" for k, t in rows if k == b]
        assert got[b] == pytest.approx(np.mean([[len(t), t.count("a")] for t in own], axis=0))
    distinct = len({t or "" for _, t in rows})
    assert texts.value == distinct and n_loads.value < n_batches.value


def test_an_empty_table(spark):
    lines = spark.createDataFrame([], "block_id long, content string")
    assert FT.embed_with_encoder(lines, encoder=lambda ts: [[0.0]] * len(ts), dim=1).count() == 0


@pytest.mark.parametrize("detector", [D.cascade_detector, D.fusion_detector])
def test_detectors_take_an_encoder(spark, detector):
    """An encoder that gives the hashed vectors leads to the same verdicts as the hashed form."""
    lines = views.session_lines(spark, SF_SMALL).withColumn("template", F.col("coarse")).withColumn("template_id", F.col("coarse"))
    from blockwatch.operators.blocks import block_status
    blocks = block_status(lines, F.col("label") == "-")

    def load():
        import hashlib

        def vector(text):
            toks = text.lower().split()
            return np.mean([[(int(c, 16) - 7.5) / 7.5 for c in hashlib.md5(t.encode()).hexdigest()] for t in toks], axis=0)
        return lambda texts: [vector(t) for t in texts]

    # Every content has five tokens, so the mean of the lines' means is the mean of the tokens.
    embed = functools.partial(FT.embed_with_encoder, load=load)
    kw = {"caps": {1: 60, 0: 40}, "k": 5}
    got, want = (sorted(tuple(r) for r in detector(blocks, lines, **kw, **e).collect()) for e in ({"embed": embed}, {}))
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-6) if all(isinstance(x, (int, float)) for x in a) else a == b
