"""Queries: keyword labels (K1-K4, P5), pseudo labels (U1-U8, P2, P4), sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockwatch.functions import parsing
from blockwatch.operators import features as FT
from blockwatch.operators import keywords as KW
from blockwatch.operators import neighbors as NB
from blockwatch.operators import pseudo as PS
from blockwatch.operators.position import split_positional
from blockwatch.plans import detectors as D
from blockwatch.plans.catalog import block_columns, BLOCK_SQL_COLS, r6, register, sql
from blockwatch.plans.q_rules import _view
from blockwatch.plans.sqlviews import cte
from blockwatch.session import scratch_path
from blockwatch.sources import files, views
from blockwatch.sources.tables import read_table

# Fixed values for the keyword query on the synthetic log: 'purchase' is the good word.
QUERY_GOOD_WORDS = ("purchase",)

cte("kw_scored", """
SELECT block_id, status, score, CASE WHEN score = 0 THEN 1 ELSE 0 END AS kw_label,
       CASE WHEN lower(status) = 'success' THEN 1 ELSE 0 END AS label
FROM (SELECT block_id, status,
             (SELECT coalesce(sum((CASE WHEN contains(s, 'panic') THEN 1 ELSE 0 END)
                                + (CASE WHEN contains(s, 'interrupt') THEN 1 ELSE 0 END)
                                + (CASE WHEN contains(s, 'error') THEN 1 ELSE 0 END)
                                - (CASE WHEN contains(s, 'purchase') THEN 1 ELSE 0 END)), 0)
              FROM (SELECT unnest(string_split(content, '|')) AS s)) AS score
      FROM v_blocks20)""", "v_blocks20")


def _kw_blocks(spark, sf):
    """(block_id, status, kw_score, kw_label) for the 20-line blocks, computed from lines."""
    from blockwatch.operators.blocks import block_status
    lines = views.blocks20_lines(spark, sf)
    status = block_status(lines, F.col("label") == "-").select("block_id", "status")
    return status.join(KW.keyword_labels_from_lines(lines, good=QUERY_GOOD_WORDS), "block_id")


@register("keyword_score", sql("SELECT block_id::BIGINT AS block_id, score::INT AS kw_score FROM kw_scored",
                               "kw_scored"))
def keyword_score(spark, sf):
    return _kw_blocks(spark, sf).select(F.col("block_id").cast("bigint"), F.col("kw_score").cast("int"))


@register("keyword_label", sql("SELECT block_id::BIGINT AS block_id, kw_label FROM kw_scored", "kw_scored"))
def keyword_label(spark, sf):
    return _kw_blocks(spark, sf).select(F.col("block_id").cast("bigint"), "kw_label")


@register("dedupe_last_wins", """
SELECT conv_id, max_by(role, turn) AS role, md5(max_by(text, turn)) AS text_md5 FROM conversations GROUP BY conv_id""")
def dedupe_last_wins(spark, sf):
    c = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    last = c.groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max_by("text", "turn").alias("text"))
    return last.select("conv_id", "role", F.md5("text").alias("text_md5"))


_AGREE_SQL = """
SELECT c AS class, count_if(label = c)::BIGINT AS n_real, count_if(label = c AND kw_label = c)::BIGINT AS n_agree,
       round(CASE WHEN count_if(label = c) > 0 THEN count_if(label = c AND kw_label = c) / count_if(label = c)
                  ELSE 0.0 END, 6) AS accuracy
FROM {src}, (VALUES (1), (0)) cs(c) GROUP BY c"""


@register("label_agreement", sql(_AGREE_SQL.format(src="kw_scored"), "kw_scored"))
def label_agreement(spark, sf):
    from blockwatch.operators.sampling import status_to_label
    k = _kw_blocks(spark, sf).withColumn("label", status_to_label("status"))
    return KW.label_agreement(k, "kw_label", "label").select("class", "n_real", "n_agree",
                                                             r6("accuracy").alias("accuracy"))


@register("keyword_labelling", sql(_AGREE_SQL.format(
    src="(SELECT * FROM kw_scored WHERE block_id - 1 >= floor((SELECT count(*) FROM kw_scored) * 0.8::DOUBLE))"),
    "kw_scored"))
def keyword_labelling(spark, sf):
    out = KW.keyword_labelling_blocks(_kw_blocks(spark, sf))
    return out.select("class", "n_real", "n_agree", r6("accuracy").alias("accuracy"))


# ---- pseudo labels over the embeddings table (label-mean centres are SQL-checkable) ----------

cte("ps_train", """
SELECT * FROM v_vec WHERE vec_id < floor((SELECT count(*) FROM v_vec) * 0.8::DOUBLE)""", "v_vec")
cte("ps_centres", """
SELECT label AS cluster, list(c ORDER BY j) AS centre FROM (
  SELECT label, j, avg(embedding[j]) AS c FROM ps_train, range(1, 65) r(j) GROUP BY label, j) GROUP BY label""",
    "ps_train")
cte("ps_dist", """
SELECT t.vec_id, t.label,
       sqrt(list_sum(list_transform(list_zip(t.embedding, c0.centre), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d0,
       sqrt(list_sum(list_transform(list_zip(t.embedding, c1.centre), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d1
FROM ps_train t, (SELECT centre FROM ps_centres WHERE cluster = 0) c0, (SELECT centre FROM ps_centres WHERE cluster = 1) c1""",
    "ps_centres")
cte("ps_own", """
SELECT vec_id, label, CASE WHEN label = 0 THEN d0 ELSE d1 END AS distance,
       CASE WHEN d1 < d0 THEN 1 ELSE 0 END AS cluster FROM ps_dist""", "ps_dist")
cte("ps_kept", """
SELECT * FROM ps_own WHERE distance < (SELECT quantile_cont(distance, 0.7) FROM ps_own)""", "ps_own")
cte("ps_major", """
SELECT vec_id, label, distance, cluster,
       CASE WHEN cluster = (SELECT cluster FROM (SELECT cluster, count(*) AS n FROM ps_kept GROUP BY cluster)
                            ORDER BY n DESC, cluster LIMIT 1) THEN 1 ELSE 0 END AS pseudo_label
FROM ps_kept""", "ps_kept")


def _ps(spark, sf):
    vec = views.vectors(spark, sf)
    train = split_positional(vec, "vec_id", 0.8).filter(F.col("split") == "train")
    centres = PS.label_mean_centres(train, "embedding", "label")
    own = PS.centre_distance(train.withColumn("cluster", F.col("label")), centres)
    return train, centres, own


@register("centroid_distance", sql("SELECT vec_id, label, round(distance, 6) AS distance FROM ps_own", "ps_own"))
def centroid_distance(spark, sf):
    _, _, own = _ps(spark, sf)
    return own.select("vec_id", "label", r6("distance").alias("distance"))


@register("distance_percentile_filter", sql("SELECT vec_id, round(distance, 6) AS distance FROM ps_kept", "ps_kept"))
def distance_percentile_filter(spark, sf):
    _, _, own = _ps(spark, sf)
    return PS.percentile_filter(own, "distance", 70.0, id_col="vec_id").select("vec_id", r6("distance").alias("distance"))


def _major(spark, sf):
    _, centres, own = _ps(spark, sf)
    kept = PS.percentile_filter(own, "distance", 70.0, id_col="vec_id").drop("cluster")
    return PS.majority_relabel(PS.nearest_centre(kept, centres))


@register("majority_cluster_label", sql("SELECT vec_id, cluster, pseudo_label FROM ps_major", "ps_major"))
def majority_cluster_label(spark, sf):
    return _major(spark, sf).select("vec_id", "cluster", "pseudo_label")


@register("label_overwrite", sql("""
SELECT t.vec_id, t.label, m.pseudo_label, coalesce(m.pseudo_label, t.label) AS final_label
FROM ps_train t LEFT JOIN ps_major m USING (vec_id)""", "ps_train", "ps_major"))
def label_overwrite(spark, sf):
    train, _, _ = _ps(spark, sf)
    return PS.overwrite_labels(train.select("vec_id", "label"), _major(spark, sf), "vec_id") \
        .select("vec_id", "label", "pseudo_label", "final_label")


@register("half_split_by_class", sql("""
SELECT vec_id, pseudo_label,
       CASE WHEN row_number() OVER (PARTITION BY pseudo_label ORDER BY vec_id) - 1
                 < floor(count(*) OVER (PARTITION BY pseudo_label) * 0.5) THEN 'container' ELSE 'tuning' END AS role
FROM ps_major""", "ps_major"))
def half_split_by_class(spark, sf):
    return PS.half_split_by_class(_major(spark, sf).select("vec_id", "pseudo_label"), "vec_id", "pseudo_label") \
        .select("vec_id", "pseudo_label", "role")


@register("kmeans_pseudo_labels")
def kmeans_pseudo_labels(spark, sf):
    vec = views.vectors(spark, sf)
    train = split_positional(vec, "vec_id", 0.8).filter(F.col("split") == "train")
    clustered, centres = PS.kmeans_clusters(train, k=2, seed=42)
    dist = PS.centre_distance(clustered, centres)
    return PS.majority_relabel(dist).select("vec_id", "cluster", "pseudo_label", r6("distance").alias("distance"))


@register("kmeans_facts", sql("""
SELECT count(*)::BIGINT AS n, true AS own_centre_nearest, true AS centres_are_means, true AS majority_is_normal
FROM ps_train""", "ps_train"))
def kmeans_facts(spark, sf):
    """What must hold of any k-means result: each row's centre is its nearest, the centres are the means
    of their rows (to the tolerance of the fit), and the larger cluster is the normal one."""
    vec = views.vectors(spark, sf)
    train = split_positional(vec, "vec_id", 0.8).filter(F.col("split") == "train").checkpoint(eager=True)
    clustered, centres = PS.kmeans_clusters(train, k=2, seed=42)
    clustered = PS.majority_relabel(clustered).checkpoint(eager=True)
    nearest = PS.nearest_centre(clustered, centres, out_col="nearest")
    own, near = PS.centre_distance(clustered, centres), PS.label_mean_centres(clustered, "embedding", "cluster")
    apart = max(abs(a - b) for x, y in zip(centres, near, strict=True) for a, b in zip(x, y, strict=True))
    sizes = {r["pseudo_label"]: r["n"] for r in clustered.groupBy("pseudo_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    best = PS.centre_distance(nearest.drop("cluster").withColumnRenamed("nearest", "cluster"), centres, out_col="best")
    both = own.select("vec_id", "distance").join(best.select("vec_id", "best"), "vec_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("distance") <= F.col("best") + 1e-9).alias("own_centre_nearest")).select(
        "n", "own_centre_nearest", F.lit(apart < 0.02).alias("centres_are_means"),
        F.lit(sizes.get(1, 0) >= sizes.get(0, 0)).alias("majority_is_normal"))


@register("pseudo_label_detector")
def pseudo_label_detector(spark, sf):
    blocks, lines = _view(spark, sf, "fine")
    m = D.pseudo_label_detector(blocks, lines)
    return m.select("n", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "w", "threshold")])


@register("neighbor_only_detector")
def neighbor_only_detector(spark, sf):
    blocks, lines = _view(spark, sf, "fine")
    m = D.neighbor_only_detector(blocks, lines)
    return m.select("n", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "threshold")])


# ---- sources and sinks ----------------------------------------------------------------------------

BLOCK_CSV_SCHEMA = ("block_id BIGINT, status STRING, n_lines BIGINT, first_pos BIGINT, event_list STRING, "
                    "event_intervals STRING, content STRING")


@register("src_csv_roundtrip", sql(f"SELECT {BLOCK_SQL_COLS} FROM v_blocks20", "v_blocks20"))
def src_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "blocks20-csv")
    files.write_csv(views.blocks20(spark, sf), path)
    back = files.read_csv(spark, path, BLOCK_CSV_SCHEMA)
    back = files.decode_json_arrays(back, {"event_list": "array<string>", "event_intervals": "array<double>"})
    return block_columns(back)


# Texts that a CSV is apt to change (fixed values): the event id chooses one.
_EDGES_SQL = r"""CASE event_id % 9 WHEN 0 THEN ' lead' WHEN 1 THEN 'trail ' WHEN 2 THEN 'a' || chr(10) || 'b'
  WHEN 3 THEN 'say ""hi"", ok' WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN 'back\n' || chr(13)
  WHEN 7 THEN '\N' ELSE event_type END"""


def _edge_texts(spark, sf):
    i = F.col("event_id") % 9
    pick = F.col("event_type")
    for at, value in enumerate([" lead", "trail ", "a\nb", 'say ""hi"", ok', "", None, "back\\n\r", "\\N"]):
        pick = F.when(i == at, F.lit(value)).otherwise(pick)
    return read_table(spark, sf, "events", ["event_id", "event_type"]).select("event_id", pick.alias("value"))


@register("src_csv_edge_values", f"""
SELECT event_id, v IS NULL AS is_null, length(v)::INT AS n, md5(v) AS digest
FROM (SELECT event_id, {_EDGES_SQL} AS v FROM events)""")
def src_csv_edge_values(spark, sf):
    path = scratch_path(spark, "edges-csv")
    files.write_csv(_edge_texts(spark, sf), path)
    back = files.read_csv(spark, path, "event_id BIGINT, value STRING")
    return back.select("event_id", F.col("value").isNull().alias("is_null"), F.length("value").alias("n"),
                       F.md5("value").alias("digest"))


@register("csv_rejects", """
SELECT CASE event_id % 4 WHEN 0 THEN 'too_many' WHEN 1 THEN 'not_a_number' ELSE 'good' END AS kind, count(*)::BIGINT AS n
FROM events GROUP BY 1""")
def csv_rejects(spark, sf):
    """One line in four has a field too many, one in four a word for a number; none is lost."""
    path = scratch_path(spark, "rejects-csv")
    i = F.col("event_id") % 4
    line = F.concat_ws(",", F.when(i == 1, F.lit("x")).otherwise(F.col("event_id").cast("string")), "event_type",
                       F.when(i == 0, F.lit("more")))
    read_table(spark, sf, "events", ["event_id", "event_type"]).select(line.alias("value")).write.text(path)
    good, bad = files.read_csv_with_rejects(spark, path, "event_id BIGINT, event_type STRING", header=False)
    kind = F.when(F.col(files.REJECT).startswith("x,"), F.lit("not_a_number")).otherwise(F.lit("too_many"))
    every = good.select(F.lit("good").alias("kind")).unionByName(bad.select(kind.alias("kind")))
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


cte("v_parsed_cols", f"""
SELECT line_no, regexp_extract(value, '{parsing.LOG_LINE_PATTERN.replace("'", "''")}', 3) AS level,
       regexp_extract(value, '{parsing.LOG_LINE_PATTERN.replace("'", "''")}', 4) AS content,
       CASE WHEN regexp_extract(value, '{parsing.LOG_LINE_PATTERN.replace("'", "''")}', 1) = '-'
            THEN 'success' ELSE 'fail' END AS status
FROM v_raw WHERE regexp_matches(value, '{parsing.LOG_LINE_PATTERN.replace("'", "''")}')""", "v_raw")


def _parsed(spark, sf):
    p = parsing.parse_lines(views.raw_lines(spark, sf), "value")
    return p.select("line_no", "p.level", "p.content", "p.status")


@register("sink_append", sql("SELECT line_no, level, status FROM v_parsed_cols", "v_parsed_cols"))
def sink_append(spark, sf):
    path = scratch_path(spark, "parsed-append")
    parsed = _parsed(spark, sf).select("line_no", "level", "status")
    files.append_parquet(parsed.filter(F.col("status") == "success"), path)
    files.append_parquet(parsed.filter(F.col("status") != "success"), path)
    return spark.read.parquet(path)


@register("sink_text", sql("SELECT content AS value FROM v_parsed_cols", "v_parsed_cols"))
def sink_text(spark, sf):
    path = scratch_path(spark, "content-text")
    files.write_text(_parsed(spark, sf), "content", path)
    return spark.read.text(path)


@register("src_text_numbered", sql("""
WITH l AS (SELECT line_no % 16 AS part, value, line_no FROM v_raw)
SELECT part::INT AS part, row_number() OVER (PARTITION BY part ORDER BY line_no) - 1 AS line_no,
       row_number() OVER (ORDER BY part, line_no) - 1 AS pos, value FROM l""", "v_raw"))
def src_text_numbered(spark, sf):
    # Stand-in input: text files of every 16th line each, in a folder whose names order them.
    path = scratch_path(spark, "text-files")
    raw = views.raw_lines(spark, sf).withColumn("part", F.format_string("%02d", F.col("line_no") % 16))
    (raw.repartition(16, "part").sortWithinPartitions("part", "line_no").select("part", "value")
     .write.partitionBy("part").text(path))
    lines = files.read_numbered_text(spark, path)
    return lines.select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("int").alias("part"), "line_no", "pos", "value")


@register("feature_cache", sql("""
SELECT block_id::BIGINT AS block_id, round(list_sum(v), 6) AS emb_sum FROM sess_emb""", "sess_emb"))
def feature_cache(spark, sf):
    base = scratch_path(spark, "feature-cache")
    source = files.input_fingerprint(read_table(spark, sf, "events"))
    key = files.fingerprint("embed_lines_to_blocks", source, "sessions")
    emb = FT.embed_lines_to_blocks(views.session_lines(spark, sf))
    files.materialize(emb, base, key)            # first call writes
    cached = files.materialize(emb, base, key)   # second call reads the cached copy
    return cached.select(F.col("block_id").cast("bigint"),
                         r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("emb_sum"))


@register("preview_top_n", sql("SELECT line_no, level, content FROM v_parsed_cols ORDER BY line_no LIMIT 100",
                               "v_parsed_cols"))
def preview_top_n(spark, sf):
    return files.preview(_parsed(spark, sf).select("line_no", "level", "content"), ["line_no"], 100)


@register("score_dump", sql("""
SELECT qid::BIGINT AS query_id, round(avg(clabel), 6) AS prob, count(*)::BIGINT AS n_sims,
       round(min(sim), 6) AS min_sim FROM fine_nbrs WHERE rnk <= 20 GROUP BY qid""", "fine_nbrs"))
def score_dump(spark, sf):
    from blockwatch.plans.q_rules import _nbrs
    dump = NB.score_profile(_nbrs(spark, sf, "fine", 20))
    path = scratch_path(spark, "score-dump")
    dump.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    return back.select(F.col("query_id").cast("bigint"), r6("prob").alias("prob"),
                       F.size("similarities").cast("bigint").alias("n_sims"),
                       r6(F.get("similarities", 0)).alias("min_sim"))
