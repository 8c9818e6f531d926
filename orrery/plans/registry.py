"""Where queries and their SQL register, and the driver's tables as the library's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as placed boxes: (entity_id, region, x, y, z, hx, hy, hz)."""
    e = F.col("embedding")
    at = [(10 * e[i].cast("double")).alias(n) for i, n in enumerate("xyz")]
    half = [(10 * F.abs(e[i + 3].cast("double"))).alias(f"h{n}") for i, n in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity_id"), F.col("label").alias("region"), *at, *half)


ENTITIES_SQL = """entities AS (
  SELECT vec_id AS entity_id, label AS region,
    10 * CAST(embedding[1] AS DOUBLE) AS x, 10 * CAST(embedding[2] AS DOUBLE) AS y, 10 * CAST(embedding[3] AS DOUBLE) AS z,
    10 * abs(CAST(embedding[4] AS DOUBLE)) AS hx, 10 * abs(CAST(embedding[5] AS DOUBLE)) AS hy, 10 * abs(CAST(embedding[6] AS DOUBLE)) AS hz
  FROM embeddings)"""


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as sightings: (episode, step, entity, pixels), steps numbered by day from 0."""
    from pyspark.sql import Window as W

    days = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode"), F.to_date("ts").alias("day"), F.col("event_type").alias("entity"), "value")
    seen = days.groupBy("episode", "day", "entity").agg(F.sum("value").alias("pixels"))
    step = F.dense_rank().over(W.partitionBy("episode").orderBy("day")) - 1
    return seen.select("episode", step.cast("long").alias("step"), "entity", "pixels")


SIGHTINGS_SQL = """sightings AS (
  SELECT episode, CAST(dense_rank() OVER (PARTITION BY episode ORDER BY day) - 1 AS BIGINT) AS step, entity, pixels
  FROM (SELECT user_id AS episode, CAST(ts AS DATE) AS day, event_type AS entity, sum(value) AS pixels FROM events GROUP BY ALL))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8 x 8 frames of pixels: (view, y, x, r, g, b, depth_m, instance)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("view"), F.posexplode("embedding").alias("i", "v"))
    v = F.col("v").cast("double")
    level = F.pmod(F.floor(v * 1000), F.lit(256)).cast("int")
    return e.select(
        "view", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), level.alias("r"),
        F.pmod(level * 3, F.lit(256)).cast("int").alias("g"), F.pmod(level * 7, F.lit(256)).cast("int").alias("b"),
        (F.abs(v) * 4).alias("depth_m"), F.pmod(F.floor(v * 100), F.lit(6)).cast("int").alias("instance"),
    )


FRAMES_SQL = """pixels AS (
  SELECT vec_id AS view, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, level AS r, (level * 3) % 256 AS g, (level * 7) % 256 AS b,
    abs(v) * 4 AS depth_m, CAST(((floor(v * 100) % 6) + 6) % 6 AS INT) AS instance
  FROM (SELECT vec_id, i, v, CAST(((floor(v * 1000) % 256) + 256) % 256 AS INT) AS level FROM (
    SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)))"""
