"""Queries: TF-IDF, reconstruction errors, scaling, fusion fit, threshold search, metrics (F, T, P1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockwatch.functions import lists
from blockwatch.operators import embeddings as EM
from blockwatch.operators import evaluate as EV
from blockwatch.operators import features as FT
from blockwatch.operators import fourier as FO
from blockwatch.operators import fusion as FU
from blockwatch.plans import detectors as D
from blockwatch.plans.catalog import r6, register, sql
from blockwatch.plans.q_rules import _view
from blockwatch.plans.sqlviews import cte
from blockwatch.session import written
from blockwatch.sources import views

_TRAIN_IDS = "(SELECT block_id FROM fine_blocks WHERE split = 'train')"
_N_TRAIN = "(SELECT count(*) FROM fine_blocks WHERE split = 'train')::DOUBLE"

cte("fu_terms", r"""
SELECT block_id, unnest(regexp_extract_all(lower(array_to_string(event_list, ' ')), '\b\w\w+\b')) AS term
FROM fine_blocks""", "fine_blocks")
for scope, fit_filter, n_fit in (("tr", f"WHERE block_id IN {_TRAIN_IDS}", _N_TRAIN),
                                 ("all", "", "(SELECT count(*) FROM fine_blocks)::DOUBLE")):
    cte(f"fu_model_{scope}", f"""
SELECT term, idx, ln((1 + {n_fit}) / (1 + df)) + 1 AS idf FROM (
  SELECT term, df, row_number() OVER (ORDER BY cnt DESC, term) - 1 AS idx
  FROM (SELECT term, count(*) AS cnt, count(DISTINCT block_id) AS df FROM fu_terms {fit_filter} GROUP BY term))
WHERE idx < 400""", "fu_terms")
    cte(f"fu_w_{scope}", f"""
SELECT block_id, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY block_id)) AS weight
FROM (SELECT block_id, term, any_value(idx) AS idx, count(*) * any_value(idf) AS w
      FROM fu_terms JOIN fu_model_{scope} USING (term) GROUP BY block_id, term)""", f"fu_model_{scope}")
cte("fu_mu", f"""
SELECT m.term, m.idx, coalesce(s.sw, 0) / {_N_TRAIN} AS mu
FROM fu_model_tr m LEFT JOIN (SELECT term, sum(weight) AS sw FROM fu_w_tr WHERE block_id IN {_TRAIN_IDS}
                              GROUP BY term) s USING (term)""", "fu_w_tr")
cte("fu_err", """
SELECT b.block_id, b.split, b.label,
       (coalesce(p.part, 0) + (SELECT sum(mu * mu) FROM fu_mu)) / (SELECT count(*) FROM fu_mu) AS recon_error
FROM fine_blocks b LEFT JOIN (SELECT block_id, sum((weight - mu) * (weight - mu) - mu * mu) AS part
                              FROM fu_w_tr JOIN fu_mu USING (term) GROUP BY block_id) p USING (block_id)""",
    "fu_mu")
cte("fu_scaled", """
SELECT block_id, split, label, recon_error,
       CASE WHEN hi - lo > 0 THEN (recon_error - lo) / (hi - lo) ELSE 0.0 END AS e
FROM (SELECT *, min(recon_error) OVER (PARTITION BY split) AS lo, max(recon_error) OVER (PARTITION BY split) AS hi
      FROM fu_err)""", "fu_err")
cte("fu_container", """
SELECT block_id, label FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || block_id), block_id) AS rn
  FROM fine_blocks WHERE split = 'train') WHERE rn <= 1000""", "fine_blocks")
cte("fu_prob", """
SELECT qid AS block_id, avg(clabel) AS prob FROM (
  SELECT qid, clabel, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, cid) AS rnk
  FROM (SELECT qe.block_id AS qid, c.block_id AS cid, c.label AS clabel,
               CASE WHEN list_dot_product(qe.v, qe.v) > 0 AND list_dot_product(ce.v, ce.v) > 0
                    THEN list_dot_product(qe.v, ce.v) / (sqrt(list_dot_product(qe.v, qe.v))
                                                         * sqrt(list_dot_product(ce.v, ce.v)))
                    ELSE 0 END AS sim
        FROM fine_emb qe CROSS JOIN fu_container c JOIN fine_emb ce ON ce.block_id = c.block_id))
WHERE rnk <= 20 GROUP BY qid""", "fine_emb", "fu_container")
cte("fu_feats", """
SELECT s.block_id, s.split, s.label, s.recon_error, s.e, p.prob FROM fu_scaled s JOIN fu_prob p USING (block_id)""",
    "fu_scaled", "fu_prob")
for tag, sig in (("lin", False), ("sig", True)):
    s_expr = "(w * prob + (1 - w) * e)"
    if sig:
        s_expr = f"(1.0 / (1.0 + exp(-{s_expr})))"
    cte(f"fu_wfit_{tag}", f"""
SELECT w, loss FROM (
  SELECT w, avg(-(label * (CASE WHEN sc <= 0 THEN -100.0 ELSE greatest(ln(sc), -100.0) END)
                 + (1 - label) * (CASE WHEN 1 - sc <= 0 THEN -100.0 ELSE greatest(ln(1 - sc), -100.0) END))) AS loss
  FROM (SELECT w, label, least(greatest({s_expr}, 0.0), 1.0) AS sc
        FROM fu_feats, (SELECT i / 100 AS w FROM range(0, 101) r(i)) g WHERE split = 'train')
  GROUP BY w)
ORDER BY round(loss, 9), w LIMIT 1""", "fu_feats")
cte("fu_train_s", """
SELECT block_id, label, (SELECT w FROM fu_wfit_lin) * prob + (1 - (SELECT w FROM fu_wfit_lin)) * e AS s
FROM fu_feats WHERE split = 'train'""", "fu_wfit_lin")
cte("fu_tbest", """
SELECT CASE WHEN f1 > 0 THEN t ELSE 0.0 END AS threshold, f1 AS train_f1 FROM (
  SELECT i, t, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1
  FROM (SELECT i, t, count_if(s > t AND label = 1) AS tp, count_if(s > t AND label <> 1) AS fp,
               count_if(NOT (s > t) AND label = 1) AS fn
        FROM (SELECT i, CASE WHEN i = 99 THEN hi ELSE lo + i * ((hi - lo) / 99.0) END AS t
              FROM range(0, 100) r(i), (SELECT min(s) AS lo, max(s) AS hi FROM fu_train_s)), fu_train_s
        GROUP BY i, t))
ORDER BY round(f1, 12) DESC, i LIMIT 1""", "fu_train_s")
cte("fu_pred", """
SELECT block_id, label, s AS score, CASE WHEN s > (SELECT threshold FROM fu_tbest) THEN 1 ELSE 0 END AS pred
FROM (SELECT block_id, label, (SELECT w FROM fu_wfit_lin) * prob + (1 - (SELECT w FROM fu_wfit_lin)) * e AS s
      FROM fu_feats WHERE split = 'test')""", "fu_tbest")
cte("fu_metrics", """
SELECT count(*)::BIGINT AS n,
       round(CASE WHEN count(*) > 0 THEN count_if(label = pred) / count(*) ELSE 0.0 END, 6) AS accuracy,
       round(CASE WHEN count_if(pred = 1) > 0 THEN count_if(label = 1 AND pred = 1) / count_if(pred = 1) ELSE 0.0 END, 6)
         AS precision,
       round(CASE WHEN count_if(label = 1) > 0 THEN count_if(label = 1 AND pred = 1) / count_if(label = 1) ELSE 0.0 END, 6)
         AS recall,
       round(CASE WHEN 2 * count_if(label = 1 AND pred = 1) + count_if(label <> 1 AND pred = 1)
                       + count_if(label = 1 AND pred <> 1) > 0
                  THEN 2.0 * count_if(label = 1 AND pred = 1) / (2 * count_if(label = 1 AND pred = 1)
                       + count_if(label <> 1 AND pred = 1) + count_if(label = 1 AND pred <> 1)) ELSE 0.0 END, 6) AS f1
FROM fu_pred""", "fu_pred")


def _fine(spark, sf):
    blocks, lines = _view(spark, sf, "fine")
    split = D.label_and_split(blocks).checkpoint(eager=True)
    return split, lines


def _tfidf(spark, sf, scope="train"):
    split, lines = _fine(spark, sf)
    train = split.filter(F.col("split") == "train")
    terms = FT.terms_from_lines(lines)
    model = FT.fit_tfidf(terms, train if scope == "train" else split)
    return split, train, terms, model


@register("tfidf_vocabulary", sql("SELECT term, idx::BIGINT AS idx, round(idf, 6) AS idf FROM fu_model_tr",
                                  "fu_model_tr"))
def tfidf_vocabulary(spark, sf):
    _, _, _, model = _tfidf(spark, sf)
    return model.select("term", F.col("idx").cast("bigint"), r6("idf").alias("idf"))


@register("tfidf_block_terms", sql("""
SELECT block_id::BIGINT AS block_id, term, round(weight, 6) AS weight FROM fu_w_all""", "fu_w_all"))
def tfidf_block_terms(spark, sf):
    split, _, terms, model = _tfidf(spark, sf, scope="all")
    return FT.apply_tfidf(terms, model).select(F.col("block_id").cast("bigint"), "term",
                                               r6("weight").alias("weight"))


@register("tfidf_train_fit_test_apply", sql("""
SELECT block_id::BIGINT AS block_id, term, round(weight, 6) AS weight FROM fu_w_tr
WHERE block_id NOT IN (SELECT block_id FROM fine_blocks WHERE split = 'train')""", "fu_w_tr", "fine_blocks"))
def tfidf_train_fit_test_apply(spark, sf):
    split, _, terms, model = _tfidf(spark, sf)
    test_terms = terms.join(split.filter(F.col("split") == "test").select("block_id"), "block_id", "left_semi")
    return FT.apply_tfidf(test_terms, model).select(F.col("block_id").cast("bigint"), "term",
                                                    r6("weight").alias("weight"))


@register("recon_error_mean", sql("""
SELECT block_id::BIGINT AS block_id, split, round(recon_error, 6) AS recon_error FROM fu_err""", "fu_err"))
def recon_error_mean(spark, sf):
    split, train, terms, model = _tfidf(spark, sf)
    w = FT.apply_tfidf(terms, model)
    err = FT.mean_reconstruction_error(w, split, FT.fit_mean_vector(w, train, model))
    return split.select("block_id", "split").join(err, "block_id").select(
        F.col("block_id").cast("bigint"), "split", r6("recon_error").alias("recon_error"))


@register("recon_error_top3", sql("""
WITH d AS (SELECT b.block_id, m.idx, abs(coalesce(w.weight, 0) - m.mu) AS err
           FROM fine_blocks b CROSS JOIN fu_mu m LEFT JOIN fu_w_tr w ON w.block_id = b.block_id AND w.term = m.term),
r AS (SELECT block_id, err, row_number() OVER (PARTITION BY block_id ORDER BY err DESC, idx) AS rk FROM d)
SELECT block_id::BIGINT AS block_id,
       round(sum(CASE rk WHEN 1 THEN 50.0 WHEN 2 THEN 70.0 ELSE 100.0 END * err), 6) AS top3_error
FROM r WHERE rk <= 3 GROUP BY block_id""", "fine_blocks", "fu_mu", "fu_w_tr"))
def recon_error_top3(spark, sf):
    split, train, terms, model = _tfidf(spark, sf)
    w = FT.apply_tfidf(terms, model)
    mu = FT.fit_mean_vector(w, train, model).join(model.select("term", "idx"), "term")
    # The model is at most max_features (400) values: it travels as a literal array.
    mu_vec = [r["mu"] for r in mu.orderBy("idx").collect()]
    x = FT.densify(w, split, len(mu_vec))
    errs = F.zip_with("x", F.array(*[F.lit(float(m)) for m in mu_vec]), lambda a, b: a - b)
    return x.select(F.col("block_id").cast("bigint"), r6(lists.weighted_top3_error(errs)).alias("top3_error"))


@register("minmax_by_split", sql("""
SELECT block_id::BIGINT AS block_id, split, round(e, 6) AS e FROM fu_scaled""", "fu_scaled"))
def minmax_by_split(spark, sf):
    split, train, terms, model = _tfidf(spark, sf)
    w = FT.apply_tfidf(terms, model)
    err = FT.mean_reconstruction_error(w, split, FT.fit_mean_vector(w, train, model))
    scaled = FT.minmax_scale(split.select("block_id", "split").join(err, "block_id"), "recon_error",
                             group_col="split", out_col="e")
    return scaled.select(F.col("block_id").cast("bigint"), "split", r6("e").alias("e"))


def _features(spark, sf):
    blocks, lines = _view(spark, sf, "fine")
    return D.fusion_features(blocks, lines)


@register("fusion_features", sql("""
SELECT block_id::BIGINT AS block_id, split, label, round(prob, 6) AS prob, round(e, 6) AS e FROM fu_feats""",
                                 "fu_feats"))
def fusion_features(spark, sf):
    f = _features(spark, sf)
    return f.select(F.col("block_id").cast("bigint"), "split", "label", r6("prob").alias("prob"), r6("e").alias("e"))


@register("fused_score", sql("""
SELECT block_id::BIGINT AS block_id, round(0.3 * prob + (1 - 0.3) * e, 6) AS score FROM fu_feats""", "fu_feats"))
def fused_score(spark, sf):
    f = _features(spark, sf)
    return f.select(F.col("block_id").cast("bigint"),
                    r6(FU.fused_score(F.col("prob"), F.col("e"), 0.3)).alias("score"))


@register("fusion_weight_fit", sql("SELECT round(w, 6) AS w, round(loss, 6) AS loss FROM fu_wfit_lin", "fu_wfit_lin"))
def fusion_weight_fit(spark, sf):
    wrow = FU.fit_fusion_weight(_features(spark, sf).filter(F.col("split") == "train"), "prob", "e", "label")
    return wrow.select(r6("w").alias("w"), r6("loss").alias("loss"))


@register("fusion_weight_fit_sigmoid", sql("SELECT round(w, 6) AS w, round(loss, 6) AS loss FROM fu_wfit_sig",
                                           "fu_wfit_sig"))
def fusion_weight_fit_sigmoid(spark, sf):
    wrow = FU.fit_fusion_weight(_features(spark, sf).filter(F.col("split") == "train"), "prob", "e", "label",
                                sigmoid=True)
    return wrow.select(r6("w").alias("w"), r6("loss").alias("loss"))


@register("threshold_search", sql("""
SELECT round(threshold, 6) AS threshold, round(train_f1, 6) AS train_f1 FROM fu_tbest""", "fu_tbest"))
def threshold_search(spark, sf):
    _, trow = D.fit_fusion(_features(spark, sf))
    return trow.select(r6("threshold").alias("threshold"), r6("train_f1").alias("train_f1"))


@register("predict_with_threshold", sql("""
SELECT block_id::BIGINT AS block_id, label, round(score, 6) AS score, pred FROM fu_pred""", "fu_pred"))
def predict_with_threshold(spark, sf):
    p = D.fusion_predictions(_features(spark, sf))
    return p.select(F.col("block_id").cast("bigint"), "label", r6("score").alias("score"), "pred")


@register("binary_metrics", sql("SELECT * FROM fu_metrics", "fu_metrics"))
def binary_metrics(spark, sf):
    m = EV.binary_metrics(D.fusion_predictions(_features(spark, sf)), "label", "pred")
    return m.select("n", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@register("fusion_detector", sql("""
SELECT m.*, round((SELECT w FROM fu_wfit_lin), 6) AS w, round((SELECT threshold FROM fu_tbest), 6) AS threshold
FROM fu_metrics m""", "fu_metrics", "fu_wfit_lin", "fu_tbest"))
def fusion_detector(spark, sf):
    blocks, lines = _view(spark, sf, "fine")
    m = D.fusion_detector(blocks, lines)
    return m.select("n", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "w", "threshold")])


@register("fusion_from_block_table", sql("""
SELECT m.*, round((SELECT w FROM fu_wfit_lin), 6) AS w, round((SELECT threshold FROM fu_tbest), 6) AS threshold
FROM fu_metrics m""", "fu_metrics", "fu_wfit_lin", "fu_tbest"))
def fusion_from_block_table(spark, sf):
    from blockwatch.plans.q_rules import _block_table
    m = D.fusion_from_block_table(_block_table(spark, sf, "fine"))
    return m.select("n", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "w", "threshold")])


# ---- array scalars over the embeddings table ------------------------------------------------------

@register("pad_or_truncate", sql("""
SELECT vec_id, len(p80)::BIGINT AS len80, round(list_sum(p80), 6) AS sum80,
       len(p16)::BIGINT AS len16, round(list_sum(p16), 6) AS sum16
FROM (SELECT vec_id, list_concat(embedding, list_resize([0.0]::DOUBLE[], 16, 0.0)) AS p80,
             embedding[1:16] AS p16 FROM v_vec)""", "v_vec"))
def pad_or_truncate(spark, sf):
    v = views.vectors(spark, sf)
    p80, p16 = lists.pad_or_truncate("embedding", 80), lists.pad_or_truncate("embedding", 16)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return v.select("vec_id", F.size(p80).cast("bigint").alias("len80"), r6(total(p80)).alias("sum80"),
                    F.size(p16).cast("bigint").alias("len16"), r6(total(p16)).alias("sum16"))


@register("max_block_length", sql("""
SELECT max(len(event_list))::BIGINT AS max_len, min(len(event_list))::BIGINT AS min_len FROM v_sessions""",
                                  "v_sessions"))
def max_block_length(spark, sf):
    # a block's event-list length is its line count, a decomposable aggregate.
    s, _ = _view(spark, sf, "sess")
    return s.agg(F.max("n_lines").cast("bigint").alias("max_len"),
                 F.min("n_lines").cast("bigint").alias("min_len"))


@register("l2_normalize", sql("""
SELECT vec_id, round(list_sum(n), 6) AS sum_unit, round(sqrt(list_dot_product(n, n)), 6) AS norm FROM (
  SELECT vec_id, list_transform(embedding, lambda x: x / greatest(sqrt(list_dot_product(embedding, embedding)), 1e-12))
    AS n FROM v_vec)""", "v_vec"))
def l2_normalize(spark, sf):
    v = views.vectors(spark, sf)
    n = lists.l2_normalize("embedding")
    return v.select("vec_id", r6(F.aggregate(n, F.lit(0.0), lambda a, x: a + x)).alias("sum_unit"),
                    r6(lists.l2_norm(n)).alias("norm"))


@register("recon_error_pca")
def recon_error_pca(spark, sf):
    split, train, terms, model = _tfidf(spark, sf)
    w = FT.apply_tfidf(terms, model)
    x = FT.densify(w, split, model.count())
    err = FT.pca_reconstruction_error(x, train, k=32)
    return split.select("block_id", "split").join(err, "block_id").select(
        F.col("block_id").cast("bigint"), "split", r6("recon_error").alias("recon_error"))


@register("recon_error_fourier", sql(f"""
WITH p AS (SELECT block_id, term, weight FROM fu_w_tr WHERE block_id IN {_TRAIN_IDS}),
mu AS (SELECT term, sum(weight) / {_N_TRAIN} AS mu FROM p GROUP BY term),
tot AS (SELECT sum((weight - mu) * (weight - mu) - mu * mu) AS present FROM p JOIN mu USING (term)),
f AS (SELECT (present + {_N_TRAIN} * (SELECT sum(mu * mu) FROM mu)) / ({_N_TRAIN} * (SELECT count(*) FROM fu_model_tr)) AS e0 FROM tot)
SELECT rank::INT AS rank, CASE WHEN rank = 0 THEN round(e0, 6) WHEN rank = -1 THEN 0.0::DOUBLE END AS error, true AS falls
FROM f, (VALUES (0), (16), (64), (-1)) r(rank)""", "fu_w_tr", "fu_model_tr"))
def recon_error_fourier(spark, sf):
    """Mean error of the fit rows by the number of features: 0 is the mean form, errors fall, and with the
    inputs among the features (rank -1) nothing is left."""
    split, train, terms, model = _tfidf(spark, sf)
    dim = model.count()
    x = written(FT.densify(FT.apply_tfidf(terms, model), train, dim), "dense")
    out, last = [], float("inf")
    for rank in (0, 16, 64, -1):
        fitted = FO.fit_fourier(x, train, dim, max(rank, 0), linear=rank < 0)
        error = FO.fourier_reconstruction_error(x, fitted).agg(F.avg("recon_error").alias("e")).first()["e"]
        out.append((rank, round(error, 6) + 0.0 if rank < 1 else None, error <= last + 1e-12))
        last = error
    return spark.createDataFrame(out, "rank int, error double, falls boolean")


@register("embed_blocks_w2v")
def embed_blocks_w2v(spark, sf):
    split, _ = _fine(spark, sf)
    train = split.filter(F.col("split") == "train")
    emb = FT.word2vec_block_embeddings(views.blocks20(spark, sf), train)
    return emb.select(F.col("block_id").cast("bigint"), F.size("embedding").cast("bigint").alias("dim"),
                      r6(lists.l2_norm("embedding")).alias("norm"))


# ---- F7, trained: co-occurrence, positive PMI, singular vectors ------------------------------------

cte("v_pmi", """
SELECT a, b, n, ln(n * sum(n) OVER () / (sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b))) AS pmi
FROM (SELECT a, b, count(*)::DOUBLE AS n FROM (
        SELECT unnest([x, y]) AS a, unnest([y, x]) AS b FROM (
          SELECT toks[i] AS x, toks[j] AS y FROM (
            SELECT toks, i, unnest(range(i + 1, least(i + 4, len(toks)) + 1)) AS j FROM (
              SELECT toks, unnest(range(1, len(toks) + 1)) AS i FROM (
                SELECT list_filter(regexp_split_to_array(lower(content), '[ \\t\\n\\r\\f]+'), lambda t: t <> '') AS toks FROM v_lines)))))
      GROUP BY a, b)""", "v_lines")


@register("pmi_weights", sql("SELECT a, b, n::BIGINT AS n, round(pmi, 6) AS pmi FROM v_pmi WHERE pmi > 0", "v_pmi"))
def pmi_weights(spark, sf):
    lines = views.lines(spark, sf, with_pos=False)
    vocab = written(EM.vocabulary(lines), "vocabulary")
    pairs = written(EM.cooccurrence(lines), "cooccurrence")
    names = lambda c, i: vocab.select(F.col("term").alias(c), F.col("idx").alias(i))
    pmi = EM.positive_pmi(pairs, vocab).join(names("a", "i"), "i").join(names("b", "j"), "j").join(pairs, ["a", "b"])
    return pmi.select("a", "b", "n", r6("value").alias("pmi"))


@register("embed_blocks_trained", sql("""
SELECT (pos // 20 + 1)::BIGINT AS block_id, 32::BIGINT AS dim, true AS in_hull,
       (SELECT round(sum(pmi * pmi), 3) FROM v_pmi WHERE pmi > 0) AS squares, true AS captured
FROM v_lines GROUP BY 1""", "v_lines", "v_pmi"))
def embed_blocks_trained(spark, sf):
    """Block vectors from trained word vectors, with what must hold of them: a mean is no longer than the
    longest word vector, and singular values hold no more than the squares of the matrix."""
    lines = views.blocks20_lines(spark, sf)
    vocab = written(EM.vocabulary(lines), "vocabulary")
    matrix = written(EM.positive_pmi(EM.cooccurrence(lines), vocab), "pmi")
    squares = matrix.select(F.sum(F.col("value") * F.col("value")).alias("s")).scalar()
    vectors = written(EM.word_vectors(lines), "word-vectors")
    longest = vectors.select(F.max(lists.l2_norm("vec"))).scalar()
    _, values = EM.truncated_svd(matrix, vocab.count())
    emb = EM.embed_blocks(lines, vectors)
    return emb.select(F.col("block_id").cast("bigint"), F.size("embedding").cast("bigint").alias("dim"),
                      (lists.l2_norm("embedding") <= longest + 1e-9).alias("in_hull"), F.round(squares, 3).alias("squares"),
                      (F.lit(float((values ** 2).sum())) <= squares + 1e-6).alias("captured"))
