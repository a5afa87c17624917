"""Invariants for the operators checked rows-only, and guards."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from blockwatch.operators import features as FT
from blockwatch.operators import fusion as FU
from blockwatch.operators import neighbors as NB
from blockwatch.operators import pseudo as PS
from blockwatch.operators.position import split_positional
from blockwatch.plans import detectors as D
from blockwatch.sources import views
from blockwatch.sources.tables import read_table
from tests.conftest import SF_SMALL


def test_missing_input_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        read_table(spark, str(tmp_path / "nowhere"), "events").count()


def _fine(spark):
    blocks = views.blocks20(spark, SF_SMALL)
    split = D.label_and_split(blocks)
    return split, split.filter(F.col("split") == "train")


def test_pca_error_non_increasing_in_k(spark):
    split, train = _fine(spark)
    terms = FT.block_terms(split)
    model = FT.fit_tfidf(terms, train)
    w = FT.apply_tfidf(terms, model)
    x = FT.densify(w, split, model.count())
    means = []
    for k in (1, 4, 16):
        err = FT.pca_reconstruction_error(x, train, k=k).join(train.select("block_id"), "block_id")
        means.append(err.agg(F.avg("recon_error")).first()[0])
    assert means[0] >= means[1] - 1e-12 >= means[2] - 2e-12
    mu = FT.fit_mean_vector(w, train, model)
    mean_form = FT.mean_reconstruction_error(w, train, mu).agg(F.avg("recon_error")).first()[0]
    assert means[0] <= mean_form + 1e-12


def test_kmeans_labels_and_majority(spark):
    vec = views.vectors(spark, SF_SMALL)
    train = split_positional(vec, "vec_id", 0.8).filter(F.col("split") == "train")
    clustered, centres = PS.kmeans_clusters(train, k=2, seed=42)
    assert len(centres) == 2
    lab = PS.majority_relabel(clustered)
    counts = {r.pseudo_label: r["count"] for r in lab.groupBy("pseudo_label").count().collect()}
    assert set(counts) <= {0, 1} and counts.get(1, 0) >= counts.get(0, 0)


def test_neighbor_probability_is_multiple_of_one_over_k(spark):
    vec = views.vectors(spark, SF_SMALL).withColumnRenamed("vec_id", "block_id")
    store = vec.filter(F.col("block_id") < 300)
    q = vec.filter(F.col("block_id") >= 300).select("block_id", "embedding")
    probs = [r.prob for r in NB.normal_probability(NB.top_k_neighbors(q, store, 20, max_rows=300)).collect()]
    assert probs and all(0.0 <= p <= 1.0 and abs(p * 20 - round(p * 20)) < 1e-9 for p in probs)


def test_best_threshold_dominates_grid(spark):
    h = F.abs(F.xxhash64("id"))
    df = spark.range(200).select(((h % 1000) / 1000.0).alias("s"),
                                 ((F.abs(F.xxhash64("id", F.lit(1))) % 10) > 2).cast("int").alias("y"))
    best = FU.threshold_grid_search(df, "s", "y").first()
    lo, hi = df.agg(F.min("s"), F.max("s")).first()
    rows = df.collect()
    for i in range(100):
        t = lo + i * ((hi - lo) / 99)
        tp = sum(1 for r in rows if r.s > t and r.y == 1)
        fp = sum(1 for r in rows if r.s > t and r.y != 1)
        fn = sum(1 for r in rows if not r.s > t and r.y == 1)
        f1 = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
        assert best.train_f1 >= f1 - 1e-12


def test_streaming_windows_equal_batch_on_closed_windows(spark):
    import __spark_entry__ as E
    stream = {r.window_start: (r.n_lines, r.status) for r in
              E.queries()["stream_blocks_tumbling_30m"](spark, SF_SMALL).collect()}
    lines = views.lines(spark, SF_SMALL, with_pos=False)
    batch = (lines.groupBy(F.window(F.col("ts").cast("timestamp"), "30 minutes").alias("w"))
             .agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("label") == "-").alias("ok")))
    want = {r.w.start.strftime("%Y-%m-%d %H:%M:%S"): (r.n, "success" if r.ok else "fail") for r in batch.collect()}
    assert stream and all(want[k] == v for k, v in stream.items())


def test_feature_cache_reuses_only_matching_fingerprint(spark):
    from blockwatch.session import scratch_path
    from blockwatch.sources import files
    base = scratch_path(spark, "cache-test")
    a = spark.range(5).withColumn("v", F.col("id") * 2)
    k1 = files.fingerprint("double", 5)
    first = files.materialize(a, base, k1)
    # same key: the written copy is read back even if the producing frame changes
    again = files.materialize(spark.range(3), base, k1)
    assert sorted(r.v for r in again.collect()) == [0, 2, 4, 6, 8] == sorted(r.v for r in first.collect())
    # a different fingerprint never reuses it
    k2 = files.fingerprint("double", 3)
    other = files.materialize(spark.range(3).withColumn("v", F.col("id") * 2), base, k2)
    assert sorted(r.v for r in other.collect()) == [0, 2, 4]
