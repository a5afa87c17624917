"""Block features (hashed text vectors, TF-IDF, reconstruction errors, scaling).

Block-level features are aggregated from line-level values with decomposable
aggregates (sums and counts), so a block of any size is reduced by partial
aggregation and never gathered into one row or task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwatch.functions.text import HASH_DIM, tokens
from blockwatch.session import written

# ---- F7: hashed block embedding ------------------------------------------------------


def _hash_chunks(tok_col: str) -> list[Column]:
    """The md5 hex digest of a token as four 32-bit integers (projected once per token)."""
    h = F.md5(F.col(tok_col))
    return [F.conv(F.substring(h, 8 * c + 1, 8), 16, 10).cast("long").alias(f"_bw_c{c}") for c in range(4)]


def _digit_sums(tok_col: str) -> list[Column]:
    """32 codegen-friendly integer sums over rows carrying ``_hash_chunks``: hex digit j is
    ``(chunk >> 4 * (7 - j % 8)) & 15``; rows without a token add nothing. Integers do not
    depend on the order of addition."""
    out = []
    for j in range(HASH_DIM):
        digit = F.shiftright(F.col(f"_bw_c{j // 8}"), 4 * (7 - j % 8)).bitwiseAND(15)
        out.append(F.coalesce(F.sum(digit), F.lit(0)).alias(f"_bw_d{j}"))
    return out


def _mean_vector(n: Column) -> Column:
    # A digit d stands for (d - 7.5) / 7.5; scaled once, from the exact sums.
    return F.array(*[F.when(n > 0, (F.col(f"_bw_d{j}") * 2 - n * 15) / 15.0 / n).otherwise(F.lit(0.0))
                     for j in range(HASH_DIM)])


def embed_lines_to_blocks(lines: DataFrame, block_col: str = "block_id", content_col: str = "content",
                          out_col: str = "embedding") -> DataFrame:
    """mean hashed token vector over all tokens of all member lines (whole texts).

    Tokens are exploded inside the scan stage and reduced per block by 32 sums and
    a count with partial aggregation: a block of any size is never gathered into
    one row, and every expression stays in whole-stage codegen. A block with no
    tokens gets the zero vector.
    """
    tok = lines.select(block_col, F.explode_outer(tokens(content_col)).alias("_bw_t"))
    tok = tok.select(block_col, "_bw_t", *_hash_chunks("_bw_t"))
    summed = tok.groupBy(block_col).agg(*_digit_sums("_bw_t"), F.count("_bw_t").alias("_bw_n"))
    return summed.select(block_col, _mean_vector(F.col("_bw_n")).alias(out_col))


def encoder_column(load: Callable[[], Callable], batch: int = 256):
    """F8: a column function that encodes texts in batches of ``batch``. ``load`` returns the encoder (from
    a list of texts to an array of a row each); it runs once in each Python worker, not once a batch."""
    def make():
        import numpy as np
        encoder = load()

        def predict(texts):
            return np.asarray(encoder([str(t) for t in texts]), np.float64)
        return predict

    return predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch)


def embed_with_encoder(lines: DataFrame, encoder: Callable | None = None, dim: int = HASH_DIM, block_col: str = "block_id",
                       content_col: str = "content", batch: int = 256, out_col: str = "embedding",
                       load: Callable[[], Callable] | None = None) -> DataFrame:
    """F7/F8 with a model: ``encoder`` (a function from a list of texts to an array of ``dim`` columns),
    or ``load``, which makes one in each worker.

    Log lines repeat, so each distinct text is encoded once and its vector joined back; a
    block's vector is the mean over its lines, as ``dim`` sums reduced map-side. A NULL text
    counts as empty.
    """
    encode = encoder_column(load or (lambda: encoder), batch)
    text = F.coalesce(F.col(content_col), F.lit(""))
    own = lines.select(block_col, text.alias("_bw_text"))
    vectors = own.select("_bw_text").distinct().select("_bw_text", encode("_bw_text").alias("_bw_vec"))
    counted = own.groupBy(block_col, "_bw_text").agg(F.count(F.lit(1)).alias("_bw_n"))
    summed = counted.join(vectors, "_bw_text").groupBy(block_col).agg(
        *[F.sum(F.col("_bw_vec")[j] * F.col("_bw_n")).alias(f"_bw_d{j}") for j in range(dim)], F.sum("_bw_n").alias("_bw_n"))
    return summed.select(block_col, F.array(*[F.col(f"_bw_d{j}") / F.col("_bw_n") for j in range(dim)]).alias(out_col))


def embed_texts(df: DataFrame, id_col: str, text_col: str, out_col: str = "embedding") -> DataFrame:
    """F7 for whole documents: mean hashed token vector of each text, all tokens."""
    tok = df.select(id_col, F.explode_outer(tokens(text_col)).alias("_bw_t"))
    tok = tok.select(id_col, "_bw_t", *_hash_chunks("_bw_t"))
    summed = tok.groupBy(id_col).agg(*_digit_sums("_bw_t"), F.count("_bw_t").alias("_bw_n"))
    return summed.select(id_col, _mean_vector(F.col("_bw_n")).alias(out_col))


# ---- F13 ----------------------------------------------------------------------------------

def minmax_scale(df: DataFrame, value_col: str, group_col: str | None = None,
                 out_col: str | None = None) -> DataFrame:
    """(x - min) / (max - min) per group (e.g. per split); 0.0 when max == min.

    The min/max table has one row per group and is broadcast.
    """
    out_col = out_col or f"{value_col}_scaled"
    keys = [group_col] if group_col else []
    if keys:
        mm = df.groupBy(*keys).agg(F.min(value_col).alias("_bw_lo"), F.max(value_col).alias("_bw_hi"))
        joined = df.join(F.broadcast(mm), keys)
    else:
        lo = df.select(F.min(value_col)).scalar()
        hi = df.select(F.max(value_col)).scalar()
        joined = df.withColumn("_bw_lo", lo).withColumn("_bw_hi", hi)
    rng = F.col("_bw_hi") - F.col("_bw_lo")
    scaled = F.when(rng > 0, (F.col(value_col) - F.col("_bw_lo")) / rng).otherwise(F.lit(0.0))
    return joined.withColumn(out_col, scaled).drop("_bw_lo", "_bw_hi")


def max_list_length(df: DataFrame, list_col: str) -> Column:
    """longest list over all rows (scalar subquery)."""
    return df.select(F.max(F.size(list_col))).scalar()


# ---- F1-F4: TF-IDF as scikit-learn defines it, in long form --------------------------------

DENSE_ROWS = 2048  # rows that are made dense, or compared with their reconstruction, at a time
TOKEN_PATTERN = r"\b\w\w+\b"  # fixed value: tokens of two or more word characters
DEFAULT_VOCAB = 400


def block_terms(blocks: DataFrame, id_col: str = "block_id", list_col: str = "event_list") -> DataFrame:
    """F1 + C10: (block, term) rows: the event list joined by spaces, lower-cased,
    tokens of >= 2 word characters (single-character ids vanish, as surveyed)."""
    sentence = F.lower(F.array_join(F.col(list_col), " "))
    return blocks.select(id_col, F.explode(F.regexp_extract_all(sentence, F.lit(TOKEN_PATTERN), 0))
                         .alias("term"))


def count_terms(terms: DataFrame, id_col: str = "block_id") -> DataFrame:
    """(block, term, tf), for ``terms`` that are read more than once; counts already made are kept."""
    if "tf" in terms.columns:
        return terms
    return terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def fit_tfidf(terms: DataFrame, fit_ids: DataFrame, id_col: str = "block_id",
              max_features: int = DEFAULT_VOCAB) -> DataFrame:
    """F2 + F3 fit: vocabulary (top ``max_features`` by corpus count, ties by term) with
    idf = ln((1 + n) / (1 + df)) + 1, n = number of fit documents.

    Returns the model: (term, idx, idf) with at most ``max_features`` rows.
    """
    fit_terms = count_terms(terms, id_col).join(fit_ids.select(id_col), id_col, "left_semi")
    n_docs = fit_ids.select(F.count(F.lit(1))).scalar()
    # (block, term) counts first, then per-term sums: both combine map-side, so a term
    # present in every block never sends one row per block to a single task.
    stats = fit_terms.groupBy("term").agg(F.sum("tf").alias("cnt"), F.count(F.lit(1)).alias("df"))
    vocab = stats.orderBy(F.col("cnt").desc(), F.col("term")).limit(max_features)
    # At most max_features rows (the limit above): one small window numbers them.
    from pyspark.sql import Window
    vocab = vocab.withColumn("idx", (F.row_number().over(
        Window.orderBy(F.col("cnt").desc(), F.col("term"))) - 1).cast("bigint"))
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return vocab.select("term", "idx", idf.alias("idf"))


def apply_tfidf(terms: DataFrame, model: DataFrame, id_col: str = "block_id") -> DataFrame:
    """F3 transform: (block, term, idx, weight), L2-normalised per block over vocabulary terms.

    The model has at most ``max_features`` rows and is broadcast; a block then has at most that
    many terms, so they and their norm are taken from one group.
    """
    w = (count_terms(terms, id_col).join(F.broadcast(model), "term")
         .select(id_col, F.struct("term", "idx", (F.col("tf") * F.col("idf")).alias("w")).alias("t")))
    rows = w.groupBy(id_col).agg(F.sort_array(F.collect_list("t")).alias("ts"), F.sqrt(F.sum(F.col("t.w") * F.col("t.w"))).alias("norm"))
    out = rows.select(id_col, "norm", F.explode("ts").alias("t"))
    return out.select(id_col, "t.term", "t.idx", (F.col("t.w") / F.col("norm")).alias("weight"))


def densify(weights: DataFrame, ids: DataFrame, vocab_size: Column | int, id_col: str = "block_id",
            out_col: str = "x") -> DataFrame:
    """Dense vector of length V per block (V = vocabulary size, at most max_features);
    blocks without vocabulary terms get the zero vector."""
    v = F.lit(vocab_size) if isinstance(vocab_size, int) else vocab_size
    m = weights.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("idx", "weight"))).alias("_bw_m"))
    joined = ids.select(id_col).join(m, id_col, "left")
    if isinstance(vocab_size, int):
        # Entries are put in their places in one pass, not looked up place by place.
        return _placed(joined.select(id_col, F.map_keys("_bw_m").alias("_bw_i"), F.map_values("_bw_m").alias("_bw_w")), vocab_size,
                       id_col, out_col)
    return joined.select(
        id_col, F.transform(F.sequence(F.lit(0), v - 1),
                            lambda i: F.coalesce(F.col("_bw_m")[i.cast("bigint")], F.lit(0.0))).alias(out_col))


def _placed(sparse: DataFrame, size: int, id_col: str, out_col: str) -> DataFrame:
    """Dense rows of ``size`` values from lists of places and weights (NULL: none)."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, DENSE_ROWS):
                ids, places, weights = batch.slice(at, DENSE_ROWS).columns
                n = np.diff(places.offsets.to_numpy())
                x = np.zeros((len(ids), size))
                own = places.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(ids)), np.where(places.is_valid().to_numpy(zero_copy_only=False), n, 0))
                inside = own < size
                x[row[inside], own[inside]] = weights.flatten().to_numpy(zero_copy_only=False)[inside]
                ends = pa.array(np.arange(len(ids) + 1) * size, pa.int32())
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=[id_col, out_col])

    return sparse.mapInArrow(run, T.StructType([sparse.schema[id_col], T.StructField(out_col, T.ArrayType(T.DoubleType()))]))


# ---- F10 / F11: reconstruction error, mean form ------------------------------------------------

def fit_mean_vector(weights: DataFrame, fit_ids: DataFrame, model: DataFrame,
                    id_col: str = "block_id") -> DataFrame:
    """F10 (rank 0): the mean TF-IDF vector of the fit rows, as (term, mu); absent = 0."""
    n = fit_ids.select(F.count(F.lit(1))).scalar()
    sums = weights.join(fit_ids.select(id_col), id_col, "left_semi").groupBy("term") \
        .agg(F.sum("weight").alias("_bw_s"))
    return model.select("term").join(sums, "term", "left") \
        .select("term", (F.coalesce(F.col("_bw_s"), F.lit(0.0)) / n).alias("mu"))


def mean_reconstruction_error(weights: DataFrame, ids: DataFrame, mu: DataFrame,
                              id_col: str = "block_id") -> DataFrame:
    """mean over the V vocabulary terms of (x - mu)^2, in long form:
    (sum_present((w - mu)^2 - mu^2) + sum_all mu^2) / V. ``mu`` is vocabulary-sized."""
    tot = mu.select(F.sum(F.col("mu") * F.col("mu"))).scalar()
    v = mu.select(F.count(F.lit(1))).scalar()
    part = (weights.join(F.broadcast(mu), "term")
            .groupBy(id_col).agg(F.sum((F.col("weight") - F.col("mu")) ** 2 - F.col("mu") ** 2).alias("_bw_p")))
    return (ids.select(id_col).join(part, id_col, "left")
            .select(id_col, ((F.coalesce(F.col("_bw_p"), F.lit(0.0)) + tot) / v).alias("recon_error")))


# ---- F10 (PCA form) and F7 (Word2Vec option): Spark ML ----------------------------------------

def pca_reconstruction_error(dense: DataFrame, fit_ids: DataFrame, k: int = 32, id_col: str = "block_id",
                             x_col: str = "x") -> DataFrame:
    """F10/F11, PCA form: components from the fit rows, mu = mean of the fit rows, and
    error = mean((x - (mu + V V^T (x - mu)))^2) per row.

    Tasks sum up the Gram matrix of the rows and a constant (d x d with d = vocabulary size <=
    max_features), which holds their number, means and covariances; the components are its eigenvectors
    on the driver. The model (d x k plus d values) is broadcast into one ``mapInArrow`` pass over the
    rows. Without fit rows the errors are NULL.
    """
    import numpy as np
    import pyarrow as pa
    from blockwatch.operators.fourier import constant_gram

    dense = written(dense.select(id_col, x_col), "dense")  # read by the fit and the errors
    schema = T.StructType([dense.schema[id_col], T.StructField("recon_error", T.DoubleType())])
    dim = dense.select(F.max(F.size(x_col))).first()[0]
    gram = constant_gram(dense.join(fit_ids.select(id_col), id_col, "left_semi"), x_col, dim) if dim and dim > 0 else ()
    if len(gram) == 0:
        return dense.select(id_col, F.lit(None).cast("double").alias("recon_error"))
    n, mu = gram[0, 0], gram[0, 1:] / gram[0, 0]
    spread = gram[1:, 1:] / n - np.outer(mu, mu)
    comps = np.linalg.eigh((spread + spread.T) / 2)[1][:, ::-1][:, :max(1, min(k, dim))]  # d x k, largest first
    bc = dense.sparkSession.sparkContext.broadcast((comps, mu))

    def err(batches):
        v, m = bc.value
        for batch in batches:
            for at in range(0, batch.num_rows, DENSE_ROWS):
                ids, rows = batch.slice(at, DENSE_ROWS).columns
                c = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) - m
                yield pa.RecordBatch.from_arrays([ids, pa.array(((c - (c @ v) @ v.T) ** 2).mean(axis=1))], names=[id_col, "recon_error"])

    return dense.select(id_col, x_col).mapInArrow(err, schema)


def word2vec_block_embeddings(blocks: DataFrame, fit_ids: DataFrame, id_col: str = "block_id",
                              content_col: str = "content", dim: int = 32, seed: int = 42,
                              out_col: str = "embedding") -> DataFrame:
    """F7, trained option: Spark ML Word2Vec fitted on the fit blocks' tokens; a block
    vector is the mean of its token vectors (Word2Vec's transform)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array
    from blockwatch.functions.text import tokens as tok
    docs = blocks.select(id_col, tok(content_col).alias("_bw_tok"))
    w2v = Word2Vec(vectorSize=dim, minCount=1, seed=seed, inputCol="_bw_tok", outputCol="_bw_vec")
    model = w2v.fit(docs.join(fit_ids.select(id_col), id_col, "left_semi"))
    return model.transform(docs).select(id_col, vector_to_array("_bw_vec").alias(out_col))




def terms_from_lines(lines: DataFrame, block_col: str = "block_id", template_col: str = "template") -> DataFrame:
    """F1 from lines: the same (block, term) rows as ``block_terms`` on the joined event
    list (a space separates templates, so no token spans two), without gathering a block."""
    return lines.select(block_col, F.explode(F.regexp_extract_all(F.lower(F.col(template_col)),
                                                                  F.lit(TOKEN_PATTERN), 0)).alias("term"))


# Python task bodies in this module travel with the task (see session.ship_by_value).
from blockwatch.session import ship_by_value  # noqa: E402

ship_by_value(__name__)
