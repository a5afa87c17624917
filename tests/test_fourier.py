"""The Fourier reconstruction against numpy; nested ranks, full rank, few rows, empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwatch.operators import features as FT
from blockwatch.operators import fourier as FO

SCHEMA = "block_id long, x array<double>, i int, row string, recon_error double"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 2))
    x = np.concatenate([np.sin(base @ rng.standard_normal((2, 4))), base ** 2], axis=1)
    df = spark.createDataFrame([(i, r.tolist(), 1, "r", 0.5) for i, r in enumerate(x)], SCHEMA).repartition(5)
    return x, df


def _errors(df, model):
    return np.array([r["recon_error"] for r in sorted(FO.fourier_reconstruction_error(df, model).collect(), key=lambda r: r["block_id"])])


def test_against_numpy(spark, data):
    x, df = data
    fit = df.where("block_id < 45")
    model = FO.fit_fourier(df, fit, 6, 20, scale=2.0)
    z = model.features(x)
    a, *_ = np.linalg.lstsq(z[:45], x[:45], rcond=None)
    want = ((x - z @ a) ** 2).mean(axis=1)
    assert np.allclose(_errors(df, model), want, atol=1e-7)
    again = FO.fit_fourier(df.repartition(1), fit, 6, 20, scale=2.0)
    assert np.allclose(again.decoder, model.decoder, atol=1e-6)


def test_error_falls_with_rank_to_nothing(data):
    x, df = data
    errors = [_errors(df, FO.fit_fourier(df, df, 6, m)).mean() for m in (0, 5, 15, 30, 80)]
    assert all(a >= b - 1e-12 for a, b in zip(errors, errors[1:], strict=False))
    assert errors[0] == pytest.approx(((x - x.mean(axis=0)) ** 2).mean())
    assert errors[-1] < 1e-8  # more features than rows
    assert _errors(df, FO.fit_fourier(df, df, 6, 3, linear=True)).max() < 1e-8


def test_edges(spark, data):
    x, df = data
    one = df.where("block_id = 7")
    assert _errors(one, FO.fit_fourier(df, one, 6, 4)).max() < 1e-12
    none = FO.fit_fourier(df, df.where(F.lit(False)), 6, 4)
    assert np.allclose(_errors(df, none), (x ** 2).mean(axis=1))
    assert FO.fourier_reconstruction_error(df.limit(0), none).count() == 0
    with pytest.raises(ValueError):
        FO.fit_fourier(df, df, 6, FO.MAX_FEATURES)


def test_pca_of_an_empty_table(spark, data):
    _, df = data
    assert FT.pca_reconstruction_error(df.limit(0), df.limit(0)).count() == 0


def test_pca_form_in_one_pass(spark):
    """Dense rows are placed, not looked up place by place, and the PCA form equals a plain one; rows
    without weights are zero, and one fit row is enough."""
    rng = np.random.default_rng(2)
    weights = [(b, int(i), float(rng.random())) for b in range(60) for i in rng.choice(9, rng.integers(0, 6), replace=False)]
    df = spark.createDataFrame(weights, "block_id long, idx long, weight double")
    ids = spark.range(60).withColumnRenamed("id", "block_id").repartition(3)
    x = FT.densify(df, ids, 9)
    assert "MapInArrow" in x._jdf.queryExecution().toString()
    want = np.zeros((60, 9))
    for b, i, w in weights:
        want[b, i] = w
    assert [r["x"] for r in x.orderBy("block_id").collect()] == want.tolist()
    mu = want[:40].mean(axis=0)
    v = np.linalg.eigh(np.cov(want[:40].T))[1][:, ::-1][:, :3]
    c = want - mu
    got = FT.pca_reconstruction_error(x, ids.where("block_id < 40"), k=3).orderBy("block_id").collect()
    assert np.allclose([r["recon_error"] for r in got], ((c - c @ v @ v.T) ** 2).mean(axis=1), atol=1e-9)
    one = FT.pca_reconstruction_error(x, ids.where("block_id = 7"), k=3).where("block_id = 7").first()
    assert abs(one["recon_error"]) < 1e-12
