"""Queries: splits, samples, embeddings, neighbours, template rules, cascade, report.

The oracle side is parametrised by block view: ``fine`` = fixed 20-line blocks
with fine templates (exercises R2/R5), ``sess`` = (user, day) sessions with
coarse templates (exercises R3/R4).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from blockwatch.operators import evaluate as EV
from blockwatch.operators import features as FT
from blockwatch.operators import neighbors as NB
from blockwatch.operators import rules as R
from blockwatch.operators import sampling as S
from blockwatch.operators.position import split_hash
from blockwatch.plans import detectors as D
from blockwatch.plans.catalog import r6, register, sql
from blockwatch.plans.sqlviews import CTES, cte
from blockwatch.sources import views

# ---- oracle CTEs ------------------------------------------------------------------------

cte("v_fine_lines", "SELECT *, pos // 20 + 1 AS block_id FROM v_lines", "v_lines")

#: Settings whose whole cascade has an oracle of its own, on the 20-line blocks.
SETTING_QUERIES = ("bgl_100", "hadoop2", "spark2")
_TAGS = [("fine", "v_blocks20", "v_fine_lines", D.CASCADE_SETTINGS["default"]),
         ("sess", "v_sessions", "v_session_lines", D.CASCADE_SETTINGS["default"]),
         *((f"set_{name}", "v_blocks20", "v_fine_lines", D.CASCADE_SETTINGS[name]) for name in SETTING_QUERIES)]
for tag, view, lines_view, setting in _TAGS:
    ratio, caps = setting["ratio"], setting["caps"]
    passes = ">=" if setting["inclusive"] else ">"
    cte(f"{tag}_blocks", f"""
SELECT block_id, status, event_list, CASE WHEN lower(status) = 'success' THEN 1 ELSE 0 END AS label,
       CASE WHEN block_id - 1 < floor((SELECT count(*) FROM {view}) * {ratio}::DOUBLE) THEN 'train' ELSE 'test' END
         AS split
FROM {view}""", view)
    cte(f"{tag}_container", f"""
SELECT block_id, status, event_list, label FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || block_id), block_id) AS rn
  FROM {tag}_blocks WHERE split = 'train')
WHERE (label = 1 AND rn <= {caps[1]}) OR (label = 0 AND rn <= {caps[0]})""", f"{tag}_blocks")
    cte(f"{tag}_normal", f"""
SELECT DISTINCT unnest(event_list) AS template FROM {tag}_container WHERE label = 1""", f"{tag}_container")
    cte(f"{tag}_rem", f"""
SELECT DISTINCT block_id, t AS template
FROM (SELECT block_id, unnest(event_list) AS t FROM {tag}_container WHERE label = 0)
WHERE t NOT IN (SELECT template FROM {tag}_normal)""", f"{tag}_normal")
    cte(f"{tag}_abnormal", f"""
SELECT DISTINCT template FROM (SELECT block_id, min(template) AS template, count(*) AS n
                               FROM {tag}_rem GROUP BY block_id) WHERE n = 1""", f"{tag}_rem")
    cte(f"{tag}_badseq", f"""
SELECT DISTINCT event_list FROM {tag}_container
WHERE label = 0 AND block_id NOT IN (SELECT block_id FROM {tag}_rem)""", f"{tag}_rem")
    cte(f"{tag}_emb", f"""
SELECT block_id, list(s / n ORDER BY j) AS v FROM (
  SELECT block_id, j, sum((strpos('0123456789abcdef', substr(md5(t), j, 1)) - 1 - 7.5) / 7.5) AS s,
         count(*) AS n
  FROM (SELECT block_id, unnest(list_filter(regexp_split_to_array(lower(content), '[ \\t\\n\\r\\f]+'),
                                            lambda x: x <> '')) AS t FROM {lines_view}),
       range(1, 33) r(j)
  GROUP BY block_id, j)
GROUP BY block_id""", lines_view)
    cte(f"{tag}_nbrs", f"""
SELECT qid, cid, clabel, sim,
       row_number() OVER (PARTITION BY qid ORDER BY round(sim, 9) DESC, cid) AS rnk
FROM (SELECT q.block_id AS qid, c.block_id AS cid, c.label AS clabel,
             CASE WHEN list_dot_product(qe.v, qe.v) > 0 AND list_dot_product(ce.v, ce.v) > 0
                  THEN list_dot_product(qe.v, ce.v) / (sqrt(list_dot_product(qe.v, qe.v))
                                                       * sqrt(list_dot_product(ce.v, ce.v)))
                  ELSE 0 END AS sim
      FROM (SELECT block_id FROM {tag}_blocks WHERE split = 'test') q
      JOIN {tag}_emb qe ON qe.block_id = q.block_id
      CROSS JOIN {tag}_container c JOIN {tag}_emb ce ON ce.block_id = c.block_id)""",
        f"{tag}_blocks", f"{tag}_container", f"{tag}_emb")
    cte(f"{tag}_scores", f"""
SELECT qid AS block_id, 100.0 * (1 - avg(clabel)) AS score FROM {tag}_nbrs WHERE rnk <= 100 GROUP BY qid""",
        f"{tag}_nbrs")
    cte(f"{tag}_verdicts", f"""
WITH t AS (SELECT quantile_cont(score, {round(setting["percentile"] / 100, 6)}) AS thr FROM {tag}_scores),
tb AS (SELECT b.block_id, b.label, b.event_list, s.score FROM {tag}_blocks b
       LEFT JOIN {tag}_scores s USING (block_id) WHERE b.split = 'test'),
ex AS (SELECT block_id, unnest(event_list) AS template FROM tb),
badtpl AS (SELECT DISTINCT block_id FROM ex WHERE template IN (SELECT template FROM {tag}_abnormal)),
unknown AS (SELECT DISTINCT block_id FROM ex WHERE template NOT IN (SELECT template FROM {tag}_normal)),
badseq AS (SELECT DISTINCT '[' || array_to_string(event_list, chr(1)) || ']' AS k FROM {tag}_badseq),
r AS (SELECT tb.block_id, tb.label, tb.score,
             CASE WHEN tb.event_list IS NULL THEN 'unparseable'
                  WHEN '[' || array_to_string(tb.event_list, chr(1)) || ']' IN (SELECT k FROM badseq)
                    THEN 'bad_sequence'
                  WHEN tb.block_id IN (SELECT block_id FROM badtpl) THEN 'bad_template'
                  WHEN tb.score {passes} (SELECT thr FROM t) THEN 'score'
                  WHEN tb.block_id NOT IN (SELECT block_id FROM unknown) THEN 'all_normal'
                  ELSE 'default' END AS reason
      FROM tb)
SELECT block_id, label, score, reason,
       CASE WHEN reason = 'unparseable' THEN NULL
            WHEN reason IN ('bad_sequence', 'bad_template', 'score') THEN 0 ELSE 1 END AS verdict
FROM r""", f"{tag}_blocks", f"{tag}_scores", f"{tag}_abnormal", f"{tag}_normal", f"{tag}_badseq")


def report_sql(src: str, y: str = "label", p: str = "verdict") -> str:
    """Classification report over (y, p) of ``src`` (a CTE name)."""
    return f"""
WITH v AS (SELECT {y} AS y, {p} AS p FROM {src} WHERE {y} IS NOT NULL AND {p} IS NOT NULL),
cls AS (SELECT c, count_if(y = c AND p = c) AS tp, count_if(p = c) AS pred_n, count_if(y = c) AS support,
               (SELECT count(*) FROM v) AS total
        FROM v, (VALUES (0), (1)) cs(c) GROUP BY c),
pr AS (SELECT c::VARCHAR AS row,
              CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
              CASE WHEN pred_n + support > 0 THEN 2.0 * tp / (pred_n + support) ELSE 0.0 END AS f1_score,
              support, tp, total FROM cls)
SELECT row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       support::BIGINT AS support FROM pr
UNION ALL SELECT 'accuracy', NULL, NULL, round(CASE WHEN max(total) > 0 THEN sum(tp) / max(total) ELSE 0.0 END, 6),
       max(total)::BIGINT FROM pr
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6),
       max(total)::BIGINT FROM pr
UNION ALL SELECT 'weighted avg',
       round(CASE WHEN sum(support) > 0 THEN sum(precision * support) / sum(support) ELSE 0.0 END, 6),
       round(CASE WHEN sum(support) > 0 THEN sum(recall * support) / sum(support) ELSE 0.0 END, 6),
       round(CASE WHEN sum(support) > 0 THEN sum(f1_score * support) / sum(support) ELSE 0.0 END, 6),
       max(total)::BIGINT FROM pr"""


def report_out(df):
    return df.select("row", r6("precision").alias("precision"), r6("recall").alias("recall"),
                     r6("f1_score").alias("f1_score"), "support")


# ---- Spark side -------------------------------------------------------------------------


def _view(spark, sf, tag):
    """(block status table, block-assigned lines with a ``template`` column); no lists."""
    from blockwatch.operators.blocks import block_status
    if tag == "fine":
        lines = views.blocks20_lines(spark, sf).withColumn("template", F.col("template_id"))
    else:
        lines = views.session_lines(spark, sf).withColumn("template", F.col("coarse"))
    return block_status(lines, F.col("label") == "-"), lines


@register("split_positional", sql("SELECT block_id::BIGINT AS block_id, split FROM sess_blocks", "sess_blocks"))
def split_positional_q(spark, sf):
    blocks, _ = _view(spark, sf, "sess")
    return D.label_and_split(blocks).select(F.col("block_id").cast("bigint"), "split")


@register("split_hash", sql("""
SELECT block_id::BIGINT AS block_id,
       CASE WHEN row_number() OVER (ORDER BY md5('42:' || block_id), block_id) - 1
                 < floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split
FROM v_sessions""", "v_sessions"))
def split_hash_q(spark, sf):
    return split_hash(_view(spark, sf, "sess")[0].select("block_id"), "block_id", 0.8, seed=42) \
        .select(F.col("block_id").cast("bigint"), "split")


@register("container_sample", sql("""
SELECT block_id::BIGINT AS block_id, label FROM sess_container""", "sess_container"))
def container_sample(spark, sf):
    return D.cascade_parts(*_view(spark, sf, "sess"))["container"].select(
        F.col("block_id").cast("bigint"), "label")


# Bound of the container of the gather query, by class.
GATHER_CAPS = {0: 100, 1: 100}


@register("container_gather", sql("""
WITH tr AS (SELECT * FROM v_vec WHERE vec_id < floor((SELECT count(*) FROM v_vec) * 0.8::DOUBLE)),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) AS rn
                     FROM tr) WHERE rn <= 100)
SELECT vec_id, label, len(embedding)::BIGINT AS dim, round(list_sum(embedding), 6) AS emb_sum FROM s""", "v_vec"))
def container_gather(spark, sf):
    from blockwatch.operators.position import split_positional
    vec = views.vectors(spark, sf)
    train = split_positional(vec, "vec_id", 0.8).filter(F.col("split") == "train")
    ids = S.stratified_sample(train.select("vec_id", "label"), "vec_id", "label", GATHER_CAPS)
    g = S.gather(ids, vec, "vec_id")
    return g.select("vec_id", "label", F.size("embedding").cast("bigint").alias("dim"),
                    r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("emb_sum"))


@register("embed_blocks_hashed", sql("""
SELECT block_id::BIGINT AS block_id, round(list_sum(v), 6) AS emb_sum, round(v[1], 6) AS emb_1,
       round(v[32], 6) AS emb_32, round(sqrt(list_dot_product(v, v)), 6) AS emb_norm FROM sess_emb""", "sess_emb"))
def embed_blocks_hashed(spark, sf):
    e = FT.embed_lines_to_blocks(views.session_lines(spark, sf))
    from blockwatch.functions.lists import l2_norm
    return e.select(F.col("block_id").cast("bigint"),
                    r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("emb_sum"),
                    r6(F.col("embedding")[0]).alias("emb_1"), r6(F.col("embedding")[31]).alias("emb_32"),
                    r6(l2_norm("embedding")).alias("emb_norm"))


@register("embed_blocks_encoder", sql("""
SELECT block_id::BIGINT AS block_id, round(avg(length(content)), 6) AS x0,
       round(avg(length(regexp_replace(content, '[^0-9]', '', 'g'))), 6) AS x1,
       round(avg(length(content) - length(replace(content, 'e', ''))), 6) AS x2 FROM v_session_lines GROUP BY block_id""",
                                      "v_session_lines"))
def embed_blocks_encoder(spark, sf):
    """The encoder's path with a model that SQL can follow: a text's length, digits and letters e."""
    def load():
        def encode(texts):
            return [[len(t), sum(c.isdigit() for c in t), t.count("e")] for t in texts]
        return encode

    e = FT.embed_with_encoder(views.session_lines(spark, sf), load=load, dim=3)
    return e.select(F.col("block_id").cast("bigint"), *[r6(F.col("embedding")[j]).alias(f"x{j}") for j in range(3)])


def _nbrs(spark, sf, tag, k):
    blocks, lines = _view(spark, sf, tag)
    parts = D.cascade_parts(blocks, lines)
    _, nbrs = D.neighbor_scores(lines, parts["test"], parts["container"], k, sum(D.CASCADE_CAPS.values()))
    return nbrs


@register("knn_top20", sql("""
SELECT qid::BIGINT AS query_id, rnk::BIGINT AS rank, cid::BIGINT AS neighbor_id, round(sim, 6) AS similarity,
       clabel AS neighbor_label
FROM fine_nbrs WHERE rnk <= 20""", "fine_nbrs"))
def knn_top20(spark, sf):
    long = NB.neighbor_long(_nbrs(spark, sf, "fine", 20))
    return long.select(F.col("query_id").cast("bigint"), F.col("rank").cast("bigint"),
                       F.col("neighbor_id").cast("bigint"), r6("similarity").alias("similarity"),
                       "neighbor_label")


@register("knn_normal_prob", sql("""
SELECT qid::BIGINT AS query_id, round(avg(clabel), 6) AS prob FROM fine_nbrs WHERE rnk <= 20 GROUP BY qid""",
                                 "fine_nbrs"))
def knn_normal_prob(spark, sf):
    return NB.normal_probability(_nbrs(spark, sf, "fine", 20)).select(
        F.col("query_id").cast("bigint"), r6("prob").alias("prob"))


@register("knn_anomaly_pct", sql("""
SELECT block_id::BIGINT AS query_id, round(score, 6) AS score FROM sess_scores""", "sess_scores"))
def knn_anomaly_pct(spark, sf):
    return NB.anomaly_percent(_nbrs(spark, sf, "sess", 100)).select(
        F.col("query_id").cast("bigint"), r6("score").alias("score"))


@register("knn_similarity_profile", sql("""
SELECT qid::BIGINT AS query_id, count(*)::BIGINT AS n, round(min(sim), 6) AS min_sim, round(max(sim), 6) AS max_sim,
       round(sum(sim), 6) AS sum_sim
FROM fine_nbrs WHERE rnk <= 20 GROUP BY qid""", "fine_nbrs"))
def knn_similarity_profile(spark, sf):
    prof = NB.similarity_profile(_nbrs(spark, sf, "fine", 20))
    s = F.col("similarities")
    return prof.select(F.col("query_id").cast("bigint"), F.size(s).cast("bigint").alias("n"),
                       r6(F.get(s, 0)).alias("min_sim"), r6(F.element_at(s, -1)).alias("max_sim"),
                       r6(F.aggregate(s, F.lit(0.0), lambda a, x: a + x)).alias("sum_sim"))


@register("normal_template_set", sql("SELECT template FROM fine_normal", "fine_normal"))
def normal_template_set(spark, sf):
    return D.cascade_parts(*_view(spark, sf, "fine"))["normal"]


@register("abnormal_template_set", sql("SELECT template FROM fine_abnormal", "fine_abnormal"))
def abnormal_template_set(spark, sf):
    return D.cascade_parts(*_view(spark, sf, "fine"))["abnormal"]


@register("known_bad_sequences", sql("""
SELECT array_to_string(event_list, ' ') AS event_list FROM sess_badseq""", "sess_badseq"))
def known_bad_sequences(spark, sf):
    from blockwatch.operators.blocks import ordered_lists
    parts = D.cascade_parts(*_view(spark, sf, "sess"))
    # Lists are gathered only for the bad blocks: at most the anomalous cap of the container.
    bad_lines = parts["lines"].join(F.broadcast(parts["bad_blocks"]), "block_id", "left_semi")
    return ordered_lists(bad_lines).select(F.array_join("event_list", " ").alias("event_list")).distinct()


@register("percentile_threshold", sql("""
SELECT round(quantile_cont(score, 0.993), 6) AS threshold, count(*)::BIGINT AS n FROM sess_scores""",
                                      "sess_scores"))
def percentile_threshold(spark, sf):
    scores = NB.anomaly_percent(_nbrs(spark, sf, "sess", 100))
    return scores.agg(r6(F.percentile("score", F.lit(0.993))).alias("threshold"),
                      F.count(F.lit(1)).alias("n"))


@register("score_flag", sql("""
SELECT block_id::BIGINT AS block_id, score >= (SELECT quantile_cont(score, 0.993) FROM sess_scores) AS flag_inclusive,
       score > (SELECT quantile_cont(score, 0.993) FROM sess_scores) AS flag_exclusive
FROM sess_scores""", "sess_scores"))
def score_flag(spark, sf):
    # Read by the percentile and by the flags: scored once.
    scores = (NB.anomaly_percent(_nbrs(spark, sf, "sess", 100)).withColumnRenamed("query_id", "block_id")
              .checkpoint(eager=True))
    t = R.percentile_threshold(scores, "score", 99.3)
    return scores.select(F.col("block_id").cast("bigint"),
                         R.score_flag(F.col("score"), t, True).alias("flag_inclusive"),
                         R.score_flag(F.col("score"), t, False).alias("flag_exclusive"))


def _verdicts(spark, sf, tag):
    blocks, lines = _view(spark, sf, tag)
    return D.cascade_detector(blocks, lines)


@register("verdict_cascade", sql("""
SELECT block_id::BIGINT AS block_id, label, round(score, 6) AS score, reason, verdict FROM sess_verdicts""",
                                 "sess_verdicts"))
def verdict_cascade(spark, sf):
    v = _verdicts(spark, sf, "sess")
    return v.select(F.col("block_id").cast("bigint"), "label", r6("score").alias("score"), "reason", "verdict")


@register("verdict_cascade_fixed20", sql("""
SELECT block_id::BIGINT AS block_id, label, round(score, 6) AS score, reason, verdict FROM fine_verdicts""",
                                         "fine_verdicts"))
def verdict_cascade_fixed20(spark, sf):
    v = _verdicts(spark, sf, "fine")
    return v.select(F.col("block_id").cast("bigint"), "label", r6("score").alias("score"), "reason", "verdict")


def _block_table(spark, sf, tag, status=None):
    """Blocks as a table a user would have: status, event list as a literal, joined content. Of the
    session blocks, every tenth test block has a literal that is cut short."""
    blocks = (views.sessions if tag == "sess" else views.blocks20)(spark, sf)
    literal = F.concat(F.lit("['"), F.array_join("event_list", "', '"), F.lit("']"))
    t = blocks.select("block_id", (status if status is not None else F.col("status")).alias("status"), literal.alias("event_list"),
                      "content")
    if tag != "sess":
        return t
    cut = int(t.count() * 0.8)
    broken = (F.col("block_id") > cut) & (F.col("block_id") % 10 == 0)
    return t.withColumn("event_list", F.when(broken, F.expr("left(event_list, length(event_list) - 1)")).otherwise(F.col("event_list")))


@register("cascade_from_block_table", sql("""
SELECT block_id::BIGINT AS block_id, label, round(score, 6) AS score,
       CASE WHEN block_id % 10 = 0 THEN 'unparseable' ELSE reason END AS reason,
       CASE WHEN block_id % 10 = 0 THEN NULL ELSE verdict END AS verdict FROM sess_verdicts""", "sess_verdicts"))
def cascade_from_block_table(spark, sf):
    v = D.cascade_from_block_table(_block_table(spark, sf, "sess"))
    return v.select(F.col("block_id").cast("bigint"), "label", r6("score").alias("score"), "reason", "verdict")


_HADOOP = (CTES["fine_verdicts"][0].replace("quantile_cont(score, 0.993)", "quantile_cont(score, 0.9975)")
           .replace("tb.score >= (SELECT thr FROM t)", "tb.score > (SELECT thr FROM t)"))
cte("fine_hadoop", _HADOOP, *CTES["fine_verdicts"][1])


@register("cascade_hadoop_exclusive", sql("""
SELECT block_id::BIGINT AS block_id, label, round(score, 6) AS score, reason, verdict FROM fine_hadoop""", "fine_hadoop"))
def cascade_hadoop_exclusive(spark, sf):
    """Status 0 is normal, and only a score above the threshold counts (caps and split of the other
    queries, so that they share an oracle)."""
    t = _block_table(spark, sf, "fine", F.when(F.col("status") == "success", 0).otherwise(1))
    v = D.cascade_from_block_table(t, "hadoop", caps=D.CASCADE_CAPS, ratio=0.8)
    return v.select(F.col("block_id").cast("bigint"), "label", r6("score").alias("score"), "reason", "verdict")


def _register_setting(name):
    @register(f"cascade_setting_{name}", sql(f"""
SELECT block_id::BIGINT AS block_id, label, round(score, 6) AS score, reason, verdict FROM set_{name}_verdicts""",
                                            f"set_{name}_verdicts"))
    def run(spark, sf):
        zero = D.CASCADE_SETTINGS[name]["zero_is_normal"]
        status = F.when(F.col("status") == "success", 0).otherwise(1) if zero else None
        v = D.cascade_from_block_table(_block_table(spark, sf, "fine", status), name)
        return v.select(F.col("block_id").cast("bigint"), "label", r6("score").alias("score"), "reason", "verdict")


for _name in SETTING_QUERIES:
    _register_setting(_name)


@register("cascade_branch_counts", sql("""
SELECT reason, count(*)::BIGINT AS n_blocks FROM sess_verdicts GROUP BY reason""", "sess_verdicts"))
def cascade_branch_counts(spark, sf):
    return _verdicts(spark, sf, "sess").groupBy("reason").agg(F.count(F.lit(1)).alias("n_blocks"))


@register("classification_report", sql(report_sql("sess_verdicts"), "sess_verdicts"))
def classification_report(spark, sf):
    return report_out(EV.classification_report(_verdicts(spark, sf, "sess"), "label", "verdict"))


@register("cascade_detector", sql(report_sql("fine_verdicts"), "fine_verdicts"))
def cascade_detector(spark, sf):
    return report_out(EV.classification_report(_verdicts(spark, sf, "fine"), "label", "verdict"))
