"""File sources and sinks (CSV, text, parquet) and the feature cache.

CSV is always read with an explicit schema; inference costs a full extra pass
and gives types that change with the data. Nested columns are written to CSV as
JSON text, since CSV has no array type.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwatch.session import scratch_path, written


def _csv_ready(df: DataFrame) -> DataFrame:
    cols = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(field.name)).alias(field.name))
        else:
            cols.append(F.col(field.name))
    return df.select(*cols)


#: Written for NULL; an empty string is written as "". A text that is this mark itself is escaped.
CSV_NULL = "\\N"
_CSV = {"header": True, "escape": '"', "nullValue": CSV_NULL, "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False}
REJECT = "_reject"


def _escaped(c: Column) -> Column:
    """A text on one line: backslashes and line ends become escapes, so a file stays splittable."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def _unescaped(c: Column) -> Column:
    # Escaped backslashes step aside (as a character that no text has) while the others are read.
    c = F.replace(c, F.lit("\\\\"), F.lit("\uffff"))
    c = F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.replace(c, F.lit("\uffff"), F.lit("\\"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Overwrite (or append) CSV with a header; arrays become JSON text, texts are escaped."""
    ready = _csv_ready(df)
    cols = [_escaped(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in ready.schema.fields]
    ready.select(*cols).write.mode(mode).options(**_CSV).csv(path)


def read_csv_with_rejects(spark: SparkSession, path: str, schema: T.StructType | str,
                          escaped: bool = True, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a CSV with header and an explicit schema (never inferred).

    A line with too many or too few fields, or with a value that is not of its column's type, is a
    reject: its text, in ``_reject``. The file is parsed once, whole, into the shared folder: what a
    later query reads of it then can't change which lines are malformed. ``escaped`` undoes the
    escapes of ``write_csv``.
    """
    plain = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*plain.fields, T.StructField(REJECT, T.StringType())])
    every = (spark.read.schema(full).options(**_CSV | {"header": header}).option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", REJECT).option("enforceSchema", True).csv(path))
    cols = [_unescaped(F.col(f.name)).alias(f.name) if escaped and isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in plain.fields]
    parsed = scratch_path(spark, "csv-parsed")
    every.withColumn("_malformed", F.col(REJECT).isNotNull()).write.partitionBy("_malformed").parquet(parsed)
    back = spark.read.schema(T.StructType([*full.fields, T.StructField("_malformed", T.BooleanType())])).parquet(parsed)
    return back.filter(~F.col("_malformed")).select(*cols), back.filter(F.col("_malformed")).select(REJECT)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV as ``write_csv`` writes it. A malformed line is an error here, as nothing would show
    that it is missing; ``read_csv_with_rejects`` sets such lines apart."""
    plain = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(plain).options(**_CSV).option("mode", "FAILFAST").csv(path)
    return rows.select(*[_unescaped(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType)
                         else F.col(f.name) for f in plain.fields])


def decode_json_arrays(df: DataFrame, array_cols: dict[str, str]) -> DataFrame:
    """Turn JSON-text columns written by ``write_csv`` back into arrays."""
    for name, ddl in array_cols.items():
        df = df.withColumn(name, F.from_json(F.col(name), ddl))
    return df


def append_parquet(df: DataFrame, path: str) -> None:
    """Append sink. Each task writes its own files, so memory stays bounded."""
    df.write.mode("append").parquet(path)


def write_text(df: DataFrame, column: str | Column, path: str) -> None:
    """One text line per row from a single string column."""
    col = F.col(column) if isinstance(column, str) else column
    df.select(col.cast("string").alias("value")).write.mode("overwrite").text(path)


def read_numbered_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of text files with their numbers: file, line_no (from 0 in its file), pos (from
    0 over all files, in the order of their paths) and value. Line ends are LF, CRLF and CR; a missing
    last one changes nothing.

    Nothing is sorted. A first pass counts the lines of each split (a byte range of a file, read by one
    task from front to back); prefix sums over that table, one row a split, say where each split's lines
    begin. A line's number is that start plus its place in the split. Splits are made the same way every
    time: their number is pinned in the session, and a line that falls outside the counted range of its
    split (as when a file changed in between) is an error, not a wrong number.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_bw_start"),
        F.monotonically_increasing_id().alias("_bw_at"), "value")
    counted = lines.groupBy("file", "_bw_start").agg(F.count(F.lit(1)).alias("n"), F.min("_bw_at").alias("_bw_first"))
    counts = written(counted, "splits")
    in_file = Window.partitionBy("file").orderBy("_bw_start").rowsBetween(Window.unboundedPreceding, -1)
    files = counts.groupBy("file").agg(F.sum("n").alias("n"))
    before = files.select("file", F.coalesce(F.sum("n").over(
        Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_bw_before"))
    starts = (counts.withColumn("_bw_shift", F.coalesce(F.sum("n").over(in_file), F.lit(0))).join(before, "file"))
    starts = written(starts, "split-starts")  # its size is known now: small ones are broadcast
    place = F.col("_bw_at") - F.col("_bw_first")
    right = F.col("n").isNotNull() & (place >= 0) & (place < F.col("n"))
    place = F.when(right, place).otherwise(F.raise_error(F.concat(F.lit("lines were not counted: "), "file")).cast("bigint"))
    numbered = lines.join(starts, ["file", "_bw_start"], "left").withColumn("line_no", place + F.col("_bw_shift"))
    return numbered.select("file", "line_no", (F.col("line_no") + F.col("_bw_before")).alias("pos"), "value")


def fingerprint(*parts: object) -> str:
    blob = json.dumps([str(p) for p in parts], sort_keys=True).encode()
    return hashlib.sha1(blob).hexdigest()[:16]


def input_fingerprint(df: DataFrame) -> str:
    """A fingerprint of the files behind ``df``: their names, lengths and times."""
    spark, names = df.sparkSession, sorted(df.inputFiles())
    if not names:
        return fingerprint()
    stat = spark.read.format("binaryFile").load(names).select("path", "length", F.col("modificationTime").cast("string"))
    return fingerprint(*sorted(tuple(r) for r in stat.collect()))


def materialize(df: DataFrame, base_path: str, key: str) -> DataFrame:
    """Read the cached copy of ``df`` when a complete one with this key exists, else write it.

    The key is a fingerprint of whatever produced ``df`` (``input_fingerprint`` and the
    parameters), so a stale cache is never reused silently. A copy whose writer did not finish
    (no _SUCCESS) is written again; any other failure to read is an error. The written copy
    also cuts the lineage: a lost executor recomputes from parquet, not from the raw input.
    """
    spark = df.sparkSession
    path = f"{base_path.rstrip('/')}/key={key}"
    try:
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def preview(df: DataFrame, order_cols: list[str], n: int = 100) -> DataFrame:
    """The first ``n`` rows by an explicit order (a top-n, not a full sort)."""
    return df.orderBy(*order_cols).limit(n)
