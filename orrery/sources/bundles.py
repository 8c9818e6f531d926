"""Scenes, trajectories and observations from acquisition folders, as tables.

A bundle is a folder with scene.json, trajectory.json, render.json and
selection.json; bundle names are the folder paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources import jsonl

VECTOR = "array<double>"
SCENE = f"""scene_id string, regions array<struct<region_id: string, name: string>>, runtime_map map<string, string>,
  entities array<struct<entity_id: string, raw_label: string, region_id: string, translation_m: {VECTOR}, rotation_xyzw: {VECTOR}, half_extents_m: {VECTOR}>>"""
TRAJECTORY = f"trajectory_class string, views array<struct<view_id: string, step: int, translation_m: {VECTOR}, rotation_xyzw: {VECTOR}>>"
RENDER = "observations array<struct<view_id: string, visible_entity_ids: array<string>, sha256: string>>"
REQUIRED = ("scene.json", "trajectory.json", "render.json", "selection.json")


def _bundle(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]+$", "")


def _files(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    return jsonl.whole(spark, f"{root}/*/{name}", schema).withColumn("bundle", _bundle(F.col("path"))).drop("path")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(bundle, file, length, sha256) of all files, read as bytes."""
    files = spark.read.format("binaryFile").load(f"{root}/*/*")
    return files.select(_bundle(F.col("path")).alias("bundle"), F.regexp_extract("path", "[^/]+$", 0).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def rejections(files: DataFrame) -> DataFrame:
    """A row for each required file that a bundle lacks: (bundle, reason_code, detail)."""
    have = files.groupBy("bundle").agg(F.collect_set("file").alias("have"))
    gone = F.array_except(F.array(*map(F.lit, REQUIRED)), F.col("have"))
    return have.select("bundle", F.lit("missing_file").alias("reason_code"), F.explode(gone).alias("detail"))


def entities(spark: SparkSession, root: str) -> DataFrame:
    """One row an entity: centre, extent (twice the half extents), region (blank ones 'unassigned')."""
    e = _files(spark, root, "scene.json", SCENE).select("bundle", "scene_id", F.explode("entities").alias("e"))
    region = F.when(F.coalesce(F.btrim("e.region_id"), F.lit("")) == "", "unassigned").otherwise(F.col("e.region_id"))
    return e.select("bundle", "scene_id", "e.entity_id", "e.raw_label", region.alias("region_id"), F.col("e.translation_m").alias("centre_m"), F.transform("e.half_extents_m", lambda x: 2 * x).alias("extent_m"))


def runtime_map(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark, root, "scene.json", SCENE).select("bundle", F.explode("runtime_map").alias("runtime_id", "entity_id"))


def views(spark: SparkSession, root: str) -> DataFrame:
    """Planned views joined to their observations: (bundle, step, view_id, translation_m, rotation_xyzw, visible_entity_ids)."""
    plan = _files(spark, root, "trajectory.json", TRAJECTORY).select("bundle", "trajectory_class", F.explode("views").alias("v")).select("bundle", "trajectory_class", "v.*")
    seen = _files(spark, root, "render.json", RENDER).select("bundle", F.explode("observations").alias("o")).select("bundle", "o.view_id", "o.visible_entity_ids", "o.sha256")
    return plan.join(seen, ["bundle", "view_id"])


def visibility(view_rows: DataFrame) -> DataFrame:
    """The fact table of sightings: (episode, step, view, entity)."""
    return view_rows.select(F.col("bundle").alias("episode"), F.col("step").cast("long").alias("step"), F.col("view_id").alias("view"), F.explode("visible_entity_ids").alias("entity"))


def broken_steps(view_rows: DataFrame) -> DataFrame:
    """Bundles whose steps are not 0 to n-1, each once."""
    n = view_rows.groupBy("bundle").agg(F.count("*").alias("n"), F.min("step").alias("low"), F.max("step").alias("high"), F.count_distinct("step").alias("k"))
    return n.where("low <> 0 or high <> n - 1 or k <> n")


def trajectory_class(plan: Column, selection: Column, n_views: Column) -> Column:
    """The plan's class, else the selection's, else T1 for eleven views."""
    return F.coalesce(plan, selection, F.when(n_views == 11, "T1"))


def jobs(sweeps: DataFrame, accepted: tuple[str, ...] = ("passed",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of sweep plans (sweep, jobs array of job_id, status, bundle): accepted jobs, rejections, counts by status."""
    j = sweeps.select("sweep", F.explode("jobs").alias("j")).select("sweep", "j.*")
    good = F.coalesce(F.col("status").isin(*accepted), F.lit(False))
    rejected = j.where(~good).select("sweep", "job_id", F.concat(F.lit("status_"), F.coalesce("status", F.lit("missing"))).alias("reason_code"))
    return j.where(good), rejected, j.groupBy("sweep", "status").agg(F.count("*").alias("n"))


def split_conflicts(episodes: DataFrame) -> DataFrame:
    """Scenes that a parent release puts into more than one split."""
    return episodes.groupBy("scene_id").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def unparented(bundles: DataFrame, parents: DataFrame, key: str = "bundle") -> DataFrame:
    return bundles.join(parents.select(key).distinct(), key, "left_anti").select(key, F.lit("not_in_parent_release").alias("reason_code"))
