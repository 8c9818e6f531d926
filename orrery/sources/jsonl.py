"""JSON lines: strict, tolerant, and numbered scans, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def snapshot_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, source_line, line, sha256) with 1-based line numbers of each file and the digest of the very bytes that the lines were cut from.

    A file is read whole, in one task, as its digest runs through it: for
    contracts of at most 2 GB. numbered_lines() splits files.
    """
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    rows = files.select("path", F.sha2("content", 256).alias("sha256"), F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return rows.select("path", (F.col("i") + 1).cast("long").alias("source_line"), F.regexp_replace("line", "\r$", "").alias("line"), "sha256").where("line != ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, source_line, line) with 1-based line numbers of each file, read in splits of any size; blank lines keep their number.

    A first pass counts the lines of every split, a row a split; a line's
    number is its place in its split and the lines of the splits before.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = rows.groupBy("path", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = splits.select("path", "start", (earlier - F.col("first") + 1).alias("shift"))
    numbered = rows.join(known, ["path", "start"])
    return numbered.select("path", (F.col("at") + F.col("shift")).alias("source_line"), F.regexp_replace("line", "\r$", "").alias("line")).where("line != ''")


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a schema with path and source_line; anything but a JSON object (NaN and Infinity are no JSON) fails the job with its place."""
    lines = numbered_lines(spark, path)
    place = F.concat(F.col("path"), F.lit(":"), F.col("source_line").cast("string"))
    value = F.try_parse_json("line")
    good = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    checked = F.when(good, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("no JSON object at "), place)).cast("string"))
    return lines.select("path", "source_line", F.from_json(checked, schema).alias("row")).select("path", "source_line", "row.*")


def tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the faults (path, source_line, line)."""
    lines = numbered_lines(spark, path)
    value = F.try_parse_json("line")
    good = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    rows = lines.where(good).select("path", "source_line", F.from_json("line", schema).alias("row")).select("path", "source_line", "row.*")
    return rows, lines.where(~good).select("path", "source_line", "line")


def whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one JSON object each, with their path; a file that does not fit the schema fails the job."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def write(rows: DataFrame, path: str, *order: str, one_file: bool = False) -> None:
    """JSON lines under Spark's commit protocol, nulls kept; sorted by `order` where given."""
    rows = rows.orderBy(*order) if order else rows
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("ignoreNullFields", False).json(path)
