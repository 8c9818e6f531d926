"""Content-addressed blobs, release inventories and media references as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def put(blobs: DataFrame, path: str) -> None:
    """Add contents (column content) once each, under the first two digits of their digest."""
    keyed = blobs.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])
    old = keyed.sparkSession.read.parquet(path) if _exists(keyed.sparkSession, path) else None
    new = keyed if old is None else keyed.join(old.select("sha256"), "sha256", "left_anti")
    new.withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def get(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    """Contents of digests (column sha256); the prefix prunes folders."""
    wanted = digests.select("sha256", F.substring("sha256", 1, 2).alias("prefix")).distinct()
    return spark.read.schema("sha256 string, content binary, prefix string").parquet(path).join(wanted, ["prefix", "sha256"]).select("sha256", "content")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def verified(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries (path, length, sha256) against files: ok, missing, wrong_size, wrong_hash, or unlisted."""
    m = manifest.select("path", F.col("length").alias("want_length"), F.col("sha256").alias("want_sha256"))
    f = files.select("path", "length", "sha256")
    status = (
        F.when(F.col("want_sha256").isNull(), "unlisted")
        .when(F.col("sha256").isNull(), "missing")
        .when(F.col("length") != F.col("want_length"), "wrong_size")
        .when(F.col("sha256") != F.col("want_sha256"), "wrong_hash")
        .otherwise("ok")
    )
    return m.join(f, "path", "full").select("path", status.alias("status"))


def image_references(records: DataFrame, content: Column, *keys: str) -> DataFrame:
    """Paths of the images in message contents, with keys."""
    images = F.transform(F.filter(content, lambda c: c["type"] == "image"), lambda c: c["image"])
    return records.select(*keys, F.explode(images).alias("path"))


def unreferenced(files: DataFrame, references: DataFrame) -> DataFrame:
    """Files that nothing refers to; reported, not deleted."""
    return files.join(references.select("path").distinct(), "path", "left_anti")
