"""Inputs as a user function should see them: Parquet files cut into pieces, and what files weigh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECE_ROWS = 65536


def _files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def piece_rows(spark: SparkSession, path: str, num_rows: int = PIECE_ROWS, glob: str | None = None) -> DataFrame:
    """The rows of the Parquet files with _file, _start and _row: their file, the first row of their piece, their place in the file."""
    if num_rows <= 0:
        raise ValueError("a piece has one row or more")
    at = F.col("_metadata.row_index")
    return _files(spark, path, glob).select("*", F.col("_metadata.file_path").alias("_file"), (F.floor(at / num_rows) * num_rows).alias("_start"), at.alias("_row"))


def pieces(spark: SparkSession, path: str, num_rows: int = PIECE_ROWS, glob: str | None = None) -> DataFrame:
    """name ({start}_{end}_{file name}), file, start and end of each piece of up to num_rows rows; only footers are read."""
    if num_rows <= 0:
        raise ValueError("a piece has one row or more")
    files = _files(spark, path, glob).groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("_name")).agg(F.count("*").alias("_n"))
    cut = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(num_rows).cast("long"))))
    cut = cut.withColumn("end", F.least(F.col("start") + num_rows, F.col("_n")))
    return cut.select(F.concat_ws("_", "start", "end", "_name").alias("name"), "file", "start", "end")


def table_pieces(spark: SparkSession, path: str, num_rows: int = PIECE_ROWS, glob: str | None = None) -> DataFrame:
    """start, end and parts of each piece of up to num_rows rows of all files as one table, in the order of their paths.

    Pieces go across files: parts is an array of (file, start, end), rows of a file each. A piece is in one part where a
    table is one file, as in pieces(). Only footers are read, and only counts of files meet in one window.
    """
    if num_rows <= 0:
        raise ValueError("a piece has one row or more")
    files = _files(spark, path, glob).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    placed = files.withColumn("_from", before)
    first, last = F.floor(F.col("_from") / num_rows), F.floor((F.col("_from") + F.col("_n") - 1) / num_rows)
    cut = placed.withColumn("_piece", F.explode(F.sequence(first, last)))
    a = F.greatest(F.col("_piece") * num_rows, F.col("_from"))
    b = F.least((F.col("_piece") + 1) * num_rows, F.col("_from") + F.col("_n"))
    parts = cut.select("_piece", a.alias("_a"), b.alias("_b"), F.struct("file", (a - F.col("_from")).alias("start"), (b - F.col("_from")).alias("end")).alias("_part"))
    whole = parts.groupBy("_piece").agg(F.min("_a").alias("start"), F.max("_b").alias("end"), F.array_sort(F.collect_list("_part")).alias("parts"))
    return whole.select("start", "end", "parts")


def reshard(spark: SparkSession, path: str, output: str, num_rows: int = PIECE_ROWS, glob: str | None = None) -> DataFrame:
    """Write each piece as a Parquet file of its own, with its rows in order; the table of pieces. One task has up to num_rows rows of a piece."""
    rows = piece_rows(spark, path, num_rows, glob)
    names = pieces(spark, path, num_rows, glob).select(F.col("name").alias("piece"), F.col("file").alias("_file"), F.col("start").alias("_start"))
    dealt = rows.join(names, ["_file", "_start"]).repartition("piece").sortWithinPartitions("piece", "_row")
    dealt.drop("_file", "_start", "_row").write.partitionBy("piece").parquet(output)
    return pieces(spark, path, num_rows, glob)


def _plain(path):
    return F.regexp_replace(path, "^file:/+", "/")


def file_weights(inputs: DataFrame, columns: list[str], files: DataFrame, key: str) -> DataFrame:
    """inputs with weight: the bytes of all files(path, length) that the columns (a path or an array of paths each) name.

    A value that names no file weighs nothing; a file with length 0 ends the job, if files has it (walk() leaves empty
    files out, as Spark's scans do). key must tell the inputs apart.
    """
    kinds = dict(inputs.dtypes)
    leaves = F.flatten(F.array(*[F.coalesce(F.col(c), F.array().cast(kinds[c])) if kinds[c].startswith("array") else F.array(c) for c in columns]))
    named = inputs.select(F.col(key).alias("_key"), F.explode(leaves).alias("_path")).withColumn("_path", _plain(F.col("_path")))
    length = F.when(F.col("length") > 0, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("an empty file: "), F.col("path"))))
    found = named.join(files, F.col("_path") == _plain(F.col("path"))).groupBy("_key").agg(F.sum(length).alias("weight"))
    out = inputs.join(found, F.col(key) == F.col("_key"), "left").drop("_key")
    return out.withColumn("weight", F.coalesce("weight", F.lit(0)).cast("long"))
