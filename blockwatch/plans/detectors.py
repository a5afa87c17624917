"""End-to-end detectors (P0-P5): compositions of the operators, each a public function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwatch.functions import parsing
from blockwatch.functions.lists import parse_list_literal
from blockwatch.operators import blocks as B
from blockwatch.operators import templates as TP
from blockwatch.operators.position import with_position
from blockwatch.session import written


def preprocess(raw: DataFrame, block_size: int = 20, st: float = TP.DEFAULT_ST,
               depth: int = TP.DEFAULT_DEPTH) -> DataFrame:
    """Raw lines (line_no, value) -> parsed -> templates -> ids 'E<n>' -> fixed-count blocks.

    Two small tables meet the line-sized data: the template dictionary (joined
    back on the template text) and the partition offsets of the position step.
    """
    parsed = parsing.parse_lines(raw, "value").select("line_no", "p.ts", "p.level", "p.content", "p.status")
    # Read by the dictionary and by the join below.
    mined = written(TP.mine_templates(parsed), "mined-lines")
    ids = TP.number_templates(TP.template_dictionary(mined)).select("template", "template_id")
    lines = with_position(mined, ["line_no"]).join(ids, "template")
    lines = B.fixed_count_blocks(lines, block_size)
    return B.summarize_blocks(lines, F.col("status") == "success", template_col="template_id",
                              content_col="content", ts_col="ts")


# ---- P3: rule cascade ----------------------------------------------------------------------

from blockwatch.operators import features as FT  # noqa: E402
from blockwatch.operators import neighbors as NB  # noqa: E402
from blockwatch.operators import rules as R  # noqa: E402
from blockwatch.operators import sampling as S  # noqa: E402
from blockwatch.operators.position import split_positional  # noqa: E402

CASCADE_CAPS = {1: 5000, 0: 2000}  # normal / anomalous container caps
CASCADE_K = 100
CASCADE_PERCENTILE = 99.3


def label_and_split(blocks: DataFrame, ratio: float = 0.8) -> DataFrame:
    """E1 + E3: 1 = normal label and a positional train/test split by block id."""
    labeled = blocks.withColumn("label", S.status_to_label("status")) \
        .withColumn("_bw_bpos", F.col("block_id") - 1)
    return split_positional(labeled, "_bw_bpos", ratio).drop("_bw_bpos")


def cascade_parts(blocks: DataFrame, lines: DataFrame, *, ratio: float = 0.8,
                  caps: dict[int, int] | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """Split, container sample, the three template sets (R1-R3) and block signatures.

    ``blocks`` needs (block_id, status); ``lines`` needs (block_id, pos, template).
    Everything is computed from lines: no block is gathered into one row.
    """
    caps = caps or CASCADE_CAPS
    # Many branches below read the block table; one reliable checkpoint keeps the
    # plan small and means a lost executor never recomputes blocks from raw lines.
    split = label_and_split(blocks.select("block_id", "status"), ratio).checkpoint(eager=True)
    train = split.filter(F.col("split") == "train")
    test = split.filter(F.col("split") == "test")
    # The container is bounded by sum(caps) rows; materialise it once for all three sets.
    container = S.stratified_sample(train, "block_id", "label", caps, seed).checkpoint(eager=True)
    tl = lines.select("block_id", "pos", "template").filter(F.col("template").isNotNull())
    normal = R.normal_set_from_lines(container, tl)
    bad_blocks = R.bad_blocks_from_lines(container, tl, normal)
    return {"split": split, "train": train, "test": test, "container": container, "normal": normal,
            "abnormal": R.abnormal_set_from_lines(container, tl, normal),
            "bad_blocks": bad_blocks, "lines": tl}


#: From lines (block_id, content) to block vectors (block_id, embedding): the hashed form by default;
#: ``functools.partial(features.embed_with_encoder, load=..., dim=...)`` puts a model in its place.
Embed = Callable[[DataFrame], DataFrame]


def neighbor_scores(block_lines: DataFrame, queries: DataFrame, container: DataFrame, k: int,
                    max_rows: int, embed: Embed = FT.embed_lines_to_blocks) -> tuple[DataFrame, DataFrame]:
    """F7 + G1/G2: block embeddings and top-k neighbours of ``queries`` in ``container``.

    Only the blocks that are queried or stored are embedded; the embeddings (one vector a
    block) are read by three jobs (container check, container collect, scoring), so they
    are written once.
    """
    needed = queries.select("block_id").unionByName(container.select("block_id")).distinct()
    emb = embed(block_lines.join(needed, "block_id", "left_semi")).checkpoint(eager=True)
    q = queries.select("block_id").join(emb, "block_id")
    c = container.select("block_id", "label").join(emb, "block_id")
    nbrs = NB.top_k_neighbors(q, c, k, max_rows=max_rows)
    return emb, nbrs


def cascade_detector(blocks: DataFrame, block_lines: DataFrame, *, ratio: float = 0.8,
                     caps: dict[int, int] | None = None, seed: int = 42, k: int = CASCADE_K,
                     percentile: float = CASCADE_PERCENTILE, inclusive: bool = True,
                     embed: Embed = FT.embed_lines_to_blocks) -> DataFrame:
    """Verdicts for the test blocks (block_id, label, score, verdict, reason)."""
    caps = caps or CASCADE_CAPS
    parts = cascade_parts(blocks, block_lines, ratio=ratio, caps=caps, seed=seed)
    _, nbrs = neighbor_scores(block_lines, parts["test"], parts["container"], k, sum(caps.values()), embed)
    # Read by the threshold and by the join: written once, or every reader scores anew.
    scores = NB.anomaly_percent(nbrs).withColumnRenamed("query_id", "block_id").checkpoint(eager=True)
    threshold = R.percentile_threshold(scores, "score", percentile)
    test = parts["test"].join(scores, "block_id", "left")
    # Lists of the bad blocks only: at most the anomalous cap of the container.
    bad_lines = parts["lines"].join(parts["bad_blocks"], "block_id", "left_semi")
    bad_lists = B.ordered_lists(bad_lines).select("event_list").distinct().checkpoint(eager=True)
    return R.verdicts_from_lines(test, parts["lines"], parts["normal"], parts["abnormal"], bad_lists,
                                 threshold, inclusive=inclusive)


def _setting(percentile: float, caps: tuple[int, int] = (5000, 2000), ratio: float = 0.8, inclusive: bool = True,
             zero_is_normal: bool = False) -> dict:
    return {"caps": {1: caps[0], 0: caps[1]}, "ratio": ratio, "percentile": percentile, "inclusive": inclusive,
            "zero_is_normal": zero_is_normal}


# Named settings of the cascade (fixed values): percentile of the scores, caps of the container (normal,
# anomalous), share of the train split, whether a score at the threshold counts, whether status 0 means
# normal. The number behind a name is the lines of a block.
CASCADE_SETTINGS = {
    "default": _setting(CASCADE_PERCENTILE),
    "bgl_20": _setting(95.0),
    "bgl_100": _setting(95.8),
    "bgl_200": _setting(95.0),
    "hdfs": _setting(99.3, caps=(2000, 2000)),
    "hadoop": _setting(99.75, caps=(2000, 2000), ratio=0.9, inclusive=False, zero_is_normal=True),
    "hadoop2": _setting(97.35, caps=(2000, 2000), ratio=0.9, inclusive=False, zero_is_normal=True),
    "hadoop3": _setting(96.3, caps=(2000, 2000), ratio=0.9, inclusive=False, zero_is_normal=True),
    # At the highest percentile a score at the threshold counts.
    "spark2": _setting(100.0, caps=(2000, 2000), ratio=0.9, zero_is_normal=True),
    "spark3": _setting(100.0, caps=(2000, 2000), ratio=0.9, zero_is_normal=True),
    "thunderbird_20": _setting(100.0),
    "thunderbird_100": _setting(99.99),
    "thunderbird_200": _setting(100.0),
    "spirit_20": _setting(98.0),
    "spirit_100": _setting(99.0),
    "spirit_200": _setting(98.0),
}


def lines_from_block_table(table: DataFrame) -> DataFrame:
    """Lines (block_id, pos, template, content) of a block table (block_id, status, event_list as a
    list literal, content joined by ' | '). A literal that can't be parsed gives NULL templates."""
    events = F.coalesce(parse_list_literal("event_list"), F.array().cast("array<string>"))
    pieces = F.coalesce(F.split("content", r" \| ", -1), F.array().cast("array<string>"))
    both = F.arrays_zip(events.alias("template"), pieces.alias("content"))
    rows = table.select("block_id", F.posexplode(both).alias("pos", "z"))
    return rows.select("block_id", "pos", "z.template", "z.content")


def statuses(table: DataFrame, zero_is_normal: bool = False) -> DataFrame:
    """Block ids with a status text, from a text or from 0 and 1."""
    status = F.col("status")
    if zero_is_normal:
        status = F.when(S.flip_label(status.cast("int")) == 1, F.lit("success")).otherwise(F.lit("fail"))
    return table.select("block_id", status.alias("status"))


def cascade_from_block_table(table: DataFrame, setting: str = "default", **kw) -> DataFrame:
    """P3 from a block table. A block whose event list can't be parsed keeps its row, with the
    reason 'unparseable' and a NULL verdict (R10)."""
    own = {**CASCADE_SETTINGS[setting], **kw}
    lines = written(lines_from_block_table(table), "table-lines")
    verdicts = cascade_detector(statuses(table, own.pop("zero_is_normal")), lines, **own)
    broken = table.filter(parse_list_literal("event_list").isNull()).select("block_id", F.lit(True).alias("_bw_broken"))
    out = verdicts.join(broken, "block_id", "left").withColumn("_bw_broken", F.coalesce("_bw_broken", F.lit(False)))
    return (out.withColumn("reason", F.when(F.col("_bw_broken"), F.lit("unparseable")).otherwise(F.col("reason")))
            .withColumn("verdict", F.when(~F.col("_bw_broken"), F.col("verdict"))).drop("_bw_broken"))


# ---- P1: fusion detector --------------------------------------------------------------------

from blockwatch.operators import evaluate as EV  # noqa: E402
from blockwatch.operators import fusion as FU  # noqa: E402

FUSION_CAPS = {1: 1000, 0: 1000}
FUSION_K = 20


def fusion_features(blocks: DataFrame, block_lines: DataFrame, *, ratio: float = 0.8,
                    caps: dict[int, int] | None = None, seed: int = 42, k: int = FUSION_K,
                    fit_scope: str = "train", max_features: int = FT.DEFAULT_VOCAB,
                    embed: Embed = FT.embed_lines_to_blocks) -> DataFrame:
    """Per block (block_id, split, label, prob, recon_error, e).

    prob = G3 neighbour probability (k neighbours in a capped train container, all
    blocks queried); e = F11 mean-form reconstruction error min-max scaled per split.
    """
    caps = caps or FUSION_CAPS
    split = label_and_split(blocks.select("block_id", "status"), ratio).checkpoint(eager=True)
    train = split.filter(F.col("split") == "train")
    # Counts are read by the fit and the transform, weights by the mean and the error.
    terms = FT.count_terms(FT.terms_from_lines(block_lines)).checkpoint(eager=True)
    model = FT.fit_tfidf(terms, train if fit_scope == "train" else split, max_features=max_features).checkpoint(eager=True)
    weights = FT.apply_tfidf(terms, model).checkpoint(eager=True)
    mu = FT.fit_mean_vector(weights, train, model)
    err = FT.mean_reconstruction_error(weights, split, mu)
    err = FT.minmax_scale(split.select("block_id", "split", "label").join(err, "block_id"),
                          "recon_error", group_col="split", out_col="e")
    container = S.stratified_sample(train, "block_id", "label", caps, seed).checkpoint(eager=True)
    _, nbrs = neighbor_scores(block_lines, split, container, k, sum(caps.values()), embed)
    prob = NB.normal_probability(nbrs).withColumnRenamed("query_id", "block_id")
    return err.join(prob, "block_id").checkpoint(eager=True)


def fusion_from_block_table(table: DataFrame, **kw) -> DataFrame:
    """P1 from a block table (see ``lines_from_block_table``)."""
    return fusion_detector(statuses(table), written(lines_from_block_table(table), "table-lines"), **kw)


def fit_fusion(features: DataFrame, sigmoid: bool = False) -> tuple[DataFrame, DataFrame]:
    """T3 + T5/T6 on the train split: (weight row, threshold row)."""
    train = features.filter(F.col("split") == "train")
    wrow = FU.fit_fusion_weight(train, "prob", "e", "label", sigmoid=sigmoid)
    w = wrow.select("w").scalar()
    scored = train.withColumn("score", FU.fused_score(F.col("prob"), F.col("e"), w))
    return wrow, FU.threshold_grid_search(scored, "score", "label")


def fusion_predictions(features: DataFrame, sigmoid: bool = False,
                       fitted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """T7 on the test split: (block_id, label, score, pred)."""
    wrow, trow = fitted or fit_fusion(features, sigmoid)
    w, t = wrow.select("w").scalar(), trow.select("threshold").scalar()
    test = features.filter(F.col("split") == "test")
    scored = test.withColumn("score", FU.fused_score(F.col("prob"), F.col("e"), w))
    return FU.predict(scored, "score", t).select("block_id", "label", "score", "pred")


def fusion_detector(blocks: DataFrame, block_lines: DataFrame, **kw) -> DataFrame:
    """Test-split metrics of the fused detector, with the fitted weight and threshold."""
    feats = fusion_features(blocks, block_lines, **kw)
    # One-row results, used by both the prediction and the report.
    wrow, trow = (x.checkpoint(eager=True) for x in fit_fusion(feats))
    preds = fusion_predictions(feats, fitted=(wrow, trow))
    return (EV.binary_metrics(preds, "label", "pred")
            .withColumn("w", wrow.select("w").scalar())
            .withColumn("threshold", trow.select("threshold").scalar()))


# ---- P2 / P4: pseudo-label detectors -------------------------------------------------------------

from blockwatch.operators import pseudo as PS  # noqa: E402

# Bound of the pseudo-labelled rows that become the neighbour container, by class.
PSEUDO_CONTAINER_CAPS = {1: 2500, 0: 2500}
PSEUDO_SEED = 21
PSEUDO_PERCENTILE = 70.0


def pseudo_label_setup(blocks: DataFrame, block_lines: DataFrame, *, ratio: float = 0.8,
                       k: int = FUSION_K, caps: dict[int, int] | None = None,
                       embed: Embed = FT.embed_lines_to_blocks) -> dict[str, DataFrame]:
    """K-means pseudo labels on every train block, filtered by distance, majority
    relabelled, halved per class into a container and a tuning set; then neighbour
    probabilities for every block. Only the container, which goes to every task, is bounded
    (``caps`` rows of each pseudo label, drawn by hash).
    """
    caps = caps or PSEUDO_CONTAINER_CAPS
    split = label_and_split(blocks.select("block_id", "status"), ratio).checkpoint(eager=True)
    emb = embed(block_lines).checkpoint(eager=True)
    train = split.filter(F.col("split") == "train").select("block_id").join(emb, "block_id")
    clustered, centres = PS.kmeans_clusters(train, k=2, seed=42)
    # Read by the percentile, the majority and the halving: written once, without the vectors.
    dist = PS.centre_distance(clustered, centres).select("block_id", "cluster", "distance").checkpoint(eager=True)
    kept = PS.percentile_filter(dist, "distance", PSEUDO_PERCENTILE, id_col="block_id")
    labelled = PS.majority_relabel(kept)
    roles = PS.half_split_by_class(labelled.select("block_id", "pseudo_label"), "block_id",
                                   "pseudo_label").checkpoint(eager=True)
    stored = roles.filter(F.col("role") == "container").select(
        "block_id", F.col("pseudo_label").alias("label"))
    container = S.stratified_sample(stored, "block_id", "label", caps, PSEUDO_SEED)
    nbrs = NB.top_k_neighbors(split.select("block_id").join(emb, "block_id"),
                              container.join(emb, "block_id"), k, max_rows=sum(caps.values()))
    prob = NB.normal_probability(nbrs).withColumnRenamed("query_id", "block_id")
    return {"split": split, "roles": roles, "prob": prob.checkpoint(eager=True)}


def neighbor_only_detector(blocks: DataFrame, block_lines: DataFrame, **kw) -> DataFrame:
    """Threshold search directly on the neighbour probability of the tuning half
    (pseudo labels), applied to the test split (true labels)."""
    parts = pseudo_label_setup(blocks, block_lines, **kw)
    tuning = parts["roles"].filter(F.col("role") == "tuning").join(parts["prob"], "block_id")
    trow = FU.threshold_grid_search(tuning, "prob", "pseudo_label")
    t = trow.select("threshold").scalar()
    test = parts["split"].filter(F.col("split") == "test").join(parts["prob"], "block_id")
    preds = FU.predict(test, "prob", t)
    return EV.binary_metrics(preds, "label", "pred").withColumn("threshold", t)


def pseudo_label_detector(blocks: DataFrame, block_lines: DataFrame, **kw) -> DataFrame:
    """Fusion with pseudo labels: sigmoid-BCE weight fit (T4) and threshold search on
    the tuning half, evaluation on the test split with the true labels."""
    parts = pseudo_label_setup(blocks, block_lines, **kw)
    split = parts["split"]
    train = split.filter(F.col("split") == "train")
    terms = FT.count_terms(FT.terms_from_lines(block_lines)).checkpoint(eager=True)
    model = FT.fit_tfidf(terms, train).checkpoint(eager=True)
    weights = FT.apply_tfidf(terms, model).checkpoint(eager=True)
    err = FT.mean_reconstruction_error(weights, split, FT.fit_mean_vector(weights, train, model))
    err = FT.minmax_scale(split.select("block_id", "split", "label").join(err, "block_id"),
                          "recon_error", group_col="split", out_col="e")
    feats = err.join(parts["prob"], "block_id").checkpoint(eager=True)
    tuning = parts["roles"].filter(F.col("role") == "tuning").select("block_id", "pseudo_label") \
        .join(feats, "block_id")
    # One-row results, used by the search, the prediction and the report.
    w = FU.fit_fusion_weight(tuning, "prob", "e", "pseudo_label", sigmoid=True).checkpoint(eager=True).select("w").scalar()
    scored = tuning.withColumn("score", FU.fused_score(F.col("prob"), F.col("e"), w))
    t = FU.threshold_grid_search(scored, "score", "pseudo_label").checkpoint(eager=True).select("threshold").scalar()
    test = feats.filter(F.col("split") == "test").withColumn(
        "score", FU.fused_score(F.col("prob"), F.col("e"), w))
    preds = FU.predict(test, "score", t)
    return EV.binary_metrics(preds, "label", "pred").withColumn("w", w).withColumn("threshold", t)
