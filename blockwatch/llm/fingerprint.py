"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

Sections are what stands between blank lines, paragraphs the lines of a section. A paragraph's
digest is the SHA-256 of its text, a section's that of its paragraphs' digests, the root that of
the sections'. Equal texts have equal roots and, but for SHA-256 collisions, only those. Unequal
roots are told apart by walking to the paragraphs that differ (``differing_paragraphs``).

For likeness, texts are also cut into pieces at places that their own characters choose (after a
white space that follows punctuation or a final e or d; 96 code points at most), so an insertion
disturbs only the pieces around it. Likeness is the Dice coefficient of the sets of pieces; equal
roots have 1.

All of it is Spark SQL expressions. Null texts count as empty, an empty text is one empty section.
Documents with equal doc_id are ordered by the hash of their texts, null doc_ids come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockwatch.llm.common import query, table

SECTION, PARAGRAPH = "\n\n", "\n"
PIECE = r"[\s\S]{0,95}?(?:[^\p{L}\p{N} \t\n\r]|[ed])[ \t\n\r]|[\s\S]{1,96}"


def paragraph_digests(text: Column) -> Column:
    """The digests of the paragraphs of each section."""
    return F.transform(F.split(text, SECTION, -1),
                       lambda s: F.transform(F.split(s, PARAGRAPH, -1), lambda p: F.sha2(p, 256)))


def root(digests: Column) -> Column:
    """Root of a tree of paragraph digests."""
    sections = F.transform(digests, lambda s: F.sha2(F.array_join(s, ""), 256))
    return F.sha2(F.array_join(sections, ""), 256)


def pieces(text: Column) -> Column:
    """64-bit hashes of the pieces of a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of pieces; 0 where one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(2.0 * both, both + F.size(F.array_union(a, b))), F.lit(0.0))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Places (section, paragraph; from 0) at which two trees of digests differ: the edited branches.

    Sections with equal digests are left without looking at their paragraphs.
    """
    place = "array<struct<section:int,paragraph:int>>"

    def in_section(i: Column) -> Column:
        x, y = F.get(a, i), F.get(b, i)
        n = F.greatest(F.coalesce(F.size(x), F.lit(0)), F.coalesce(F.size(y), F.lit(0)))
        rows = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(
            i.alias("section"), j.alias("paragraph"), F.get(x, j).eqNullSafe(F.get(y, j)).alias("same")))
        kept = F.transform(F.filter(rows, lambda r: ~r["same"]),
                           lambda r: F.struct(r["section"].alias("section"), r["paragraph"].alias("paragraph")))
        return F.when(x.eqNullSafe(y), F.array().cast(place)).otherwise(kept)

    n = F.greatest(F.size(a), F.size(b))
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), in_section))


def with_next_text(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text, next_text: of the document with the next doc_id; of the first, after the last.

    Rows are dealt to equal ranges of doc_id, so that the text is shuffled once and no task sees
    all rows; the first row of each range, one a range, serves the last row of the range before.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ends = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    lo, hi = (0, 0) if ends["lo"] is None else (ends["lo"], ends["hi"])
    width = (hi - lo) // buckets + 1
    bucket = F.coalesce(F.expr(f"(doc_id - {lo}) div {width}"), F.lit(buckets))
    rows = rows.withColumn("bucket", bucket)
    tie = F.xxhash64("text")
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_last(), tie)
    # One row a bucket from here: the ids first (a few bytes for each of ``buckets``, so they may be
    # broadcast), then the texts of those ids.
    firsts = rows.groupBy("bucket").agg(F.min("doc_id").alias("first_id"))
    near = rows.join(F.broadcast(firsts), "bucket").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    heads = (near.withColumn("n", F.row_number().over(order)).where("n = 1")
             .select("bucket", F.col("text").alias("head")))
    ring = Window.orderBy("bucket")  # as many rows as there are buckets
    start = F.first("head").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edges = heads.select("bucket", F.coalesce(F.lead("head").over(ring), start).alias("edge"))
    led = rows.withColumn("led", F.lead("text").over(order))
    return (led.join(edges, "bucket")
            .select("doc_id", "text", F.coalesce("led", "edge").alias("next_text")))


_PIECES = r"regexp_extract_all({0}, '{1}')"
_DIGESTS = ("list_transform(string_split({0}, chr(10) || chr(10)), lambda s: "
            "list_transform(string_split(s, chr(10)), lambda p: sha256(p)))")
_ROOT = "sha256(array_to_string(list_transform({0}, lambda s: sha256(array_to_string(s, ''))), ''))"


def _sql_like(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return (f"CASE WHEN {both} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {both} / "
            f"(len(list_distinct({a})) + len(list_distinct({b}))) END")


_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n_chars,
        coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nx FROM d),
e AS (SELECT *, left(t, n_chars - n_chars // 2) || left(nx, n_chars // 2) AS ed FROM n),
f AS (SELECT *, {_DIGESTS.format('t')} AS dt, {_DIGESTS.format('ed')} AS de, {_DIGESTS.format('nx')} AS dn,
        {_PIECES.format('t', PIECE)} AS pt, {_PIECES.format('ed', PIECE)} AS pe, {_PIECES.format('nx', PIECE)} AS pn
      FROM e)
SELECT doc_id, n_chars, sha256(ed) AS edited_sha256, {_ROOT.format('dt')} AS fingerprint,
  {_ROOT.format('de')} AS edited_fingerprint,
  CASE WHEN t = ed THEN 1.0 ELSE {_sql_like('pt', 'pe')} END AS near_edited,
  CASE WHEN t = nx THEN 1.0 ELSE {_sql_like('pt', 'pn')} END AS near_next
FROM f
"""


@query("op2_fingerprint", _SQL)
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next_text(table(spark, sf_dir, "documents"), buckets)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))
    rows = rows.select("doc_id", "text", "next_text", edited.alias("edited"))
    trees = rows.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        *(root(paragraph_digests(F.col(c))).alias(f"root_{c}") for c in ("text", "edited", "next_text")),
        *(pieces(F.col(c)).alias(f"pieces_{c}") for c in ("text", "edited", "next_text")))
    near = lambda c: F.when(F.col("root_text") == F.col(f"root_{c}"), 1.0).otherwise(
        likeness(F.col("pieces_text"), F.col(f"pieces_{c}")))
    return trees.select("doc_id", "n_chars", "edited_sha256", F.col("root_text").alias("fingerprint"),
                        F.col("root_edited").alias("edited_fingerprint"),
                        near("edited").alias("near_edited"), near("next_text").alias("near_next"))
