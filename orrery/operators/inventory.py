"""Inventories of scenes and object models, with what they can be used for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.gates import placement, scene_class


def scene_domain(name):
    """The domain of a scene by its name's first part."""
    part = F.split(name, "_")[0]
    return F.when(part.isin("house", "home", "apartment", "condo"), "home").when(part.isin("office", "school", "shop", "restaurant", "hotel", "hall"), "public").otherwise("other")


def scenes(objects: DataFrame) -> DataFrame:
    """objects: (scene, room, category, movable): rooms, objects, categories, movable ones, class and domain of each scene."""
    n = objects.groupBy("scene").agg(F.count_distinct("room").alias("n_rooms"), F.count("*").alias("n_objects"), F.count_distinct("category").alias("n_categories"), F.count_if("movable").alias("n_movable"))
    return n.withColumn("scene_class", scene_class(F.col("n_rooms"), F.col("n_objects"), F.col("n_categories"))).withColumn("domain", scene_domain(F.col("scene")))


def models(rows: DataFrame, least_side: float = 0.03) -> DataFrame:
    """rows: (category, model, dims array, rigid): eligibility with reasons, and placement."""
    good = F.forall("dims", lambda x: x.isNotNull() & (x > 0))
    reasons = F.array_compact(F.array(F.when(~F.coalesce("rigid", F.lit(False)), "not_rigid"), F.when(~F.coalesce(good, F.lit(False)), "bad_dimensions"), F.when(F.array_max("dims") < least_side, "too_small")))
    out = rows.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)
    return out.withColumn("placement", placement(F.col("dims"), F.col("eligible")))


def sweep_summary(jobs: DataFrame) -> DataFrame:
    """Jobs by sweep and in all: (sweep, n, n_passed, pass_rate), the sum of all under a null sweep."""
    r = jobs.rollup("sweep").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "passed").alias("n_passed"))
    return r.withColumn("pass_rate", F.round(F.col("n_passed") / F.col("n"), 4))


def capability_coverage(rows: DataFrame, flags: dict[str, str]) -> DataFrame:
    """How many records have each capability: (capability, n_true, n)."""
    pairs = F.array(*[F.struct(F.lit(name).alias("capability"), F.coalesce(F.expr(cond), F.lit(False)).alias("on")) for name, cond in flags.items()])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.capability").agg(F.count_if("p.on").alias("n_true"), F.count("*").alias("n"))


def inventory_views(questions: DataFrame, inventory: DataFrame) -> DataFrame:
    """Questions' views looked up in an inventory by bundle and view: (question, bundle_root, view_id, status).

    questions: (question, bundle_root, view_id); inventory: (bundle_root,
    view_id). Roots are compared without a trailing slash, doubled slashes or
    /./ steps. status: found, absent or repeated (the inventory lists it more than once).
    """
    root = lambda c: F.regexp_replace(F.regexp_replace(c, r"/+(?:\./+)*", "/"), r"(?<=.)/\.?$", "")
    listed = inventory.groupBy(root(F.col("bundle_root")).alias("bundle_root"), "view_id").agg(F.count("*").alias("n"))
    rows = questions.withColumn("bundle_root", root(F.col("bundle_root"))).join(listed, ["bundle_root", "view_id"], "left")
    return rows.select("question", "bundle_root", "view_id", F.when(F.col("n").isNull(), "absent").when(F.col("n") > 1, "repeated").otherwise("found").alias("status"))
