"""Which view proves what: categories that can be confused, clean witnesses, sources for a target.

Masks are rows (episode, step, entity, label, pixels, min_side, outer_share,
border), one for each entity that a view shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.plans.durable import parts


def grouped_labels(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the confusable group of their label (groups: label, group); a label without one is its own."""
    return rows.join(groups.select("label", "group"), "label", "left").withColumn("group", F.coalesce("group", "label"))


def absent_categories(masks: DataFrame, wanted: DataFrame, pixels: int = 64, side: int = 8) -> DataFrame:
    """Of wanted (episode, step, group): those no mask of the group contradicts, neither by pixels nor by size."""
    shown = masks.where((F.col("pixels") >= pixels) | (F.col("min_side") >= side)).select("episode", "step", "group").distinct()
    return wanted.join(shown, ["episode", "step", "group"], "left_anti")


def unambiguous(masks: DataFrame) -> DataFrame:
    """Views and groups with exactly one candidate: (episode, step, group, entity).

    The least and the greatest candidate tell, so no set is held; tasks are as
    many as the masks need.
    """
    keys = ["episode", "step", "group"]
    n = masks.select(*keys, "entity").repartition(parts(masks), *keys).groupBy(*keys).agg(F.min("entity").alias("entity"), F.max("entity").alias("last"))
    return n.where("entity = last").drop("last")


def bound_everywhere(masks: DataFrame, required: DataFrame) -> DataFrame:
    """Whether every required view (question, episode, step, group) has exactly one candidate: (question, bound)."""
    joined = required.join(unambiguous(masks).withColumn("one", F.lit(True)), ["episode", "step", "group"], "left")
    return joined.groupBy("question").agg(F.bool_and(F.coalesce("one", F.lit(False))).alias("bound"))


def witness_score() -> Column:
    """Larger is better: off the border, little in the outer ring, large, many pixels, earlier."""
    return F.struct(~F.col("border"), -F.col("outer_share"), F.col("min_side"), F.col("pixels"), -F.col("step"))


def best_witness(masks: DataFrame) -> DataFrame:
    """The best view of each entity: (episode, entity, step)."""
    return masks.groupBy("episode", "entity").agg(F.max_by("step", witness_score()).alias("step"))


def well_seen(masks: DataFrame, pixels: int = 256) -> DataFrame:
    """The first view of each entity with enough pixels: (episode, entity, step)."""
    return masks.where(F.col("pixels") >= pixels).groupBy("episode", "entity").agg(F.min("step").alias("step"))


def references(masks: DataFrame) -> DataFrame:
    """How an entity can be named: by its label alone where no other has it, else with the earliest view that shows one of the label.

    Rows (episode, entity, label, step): step is null for a unique label;
    entities that no view singles out are left out.
    """
    labels = masks.groupBy("episode", "label").agg(F.count_distinct("entity").alias("n"))
    alone = masks.groupBy("episode", "step", "label").agg(F.count_distinct("entity").alias("k"), F.min("entity").alias("entity")).where("k = 1")
    first = alone.groupBy("episode", "entity", "label").agg(F.min("step").alias("first"))
    return first.join(labels, ["episode", "label"]).select("episode", "entity", "label", F.when(F.col("n") > 1, F.col("first")).alias("step"))


def reference_phrase(label: Column, step: Column) -> Column:
    return F.when(step.isNull(), F.concat(F.lit("the "), label)).otherwise(F.concat(F.lit("the "), label, F.lit(" in image "), (step + 1).cast("string")))


def image_position(x: Column, width: Column) -> Column:
    """Third of the image in which a median column lies."""
    share = x / width
    return F.when(share < 0.38, "left").when(share > 0.62, "right").otherwise("middle")


def nearest_sources(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """For each target view (scene, view, x, y), the source view of its scene that is nearest in the plane, then earliest.

    Scenes have a bounded number of views, so the join by scene is bounded.
    """
    s = sources.select("scene", F.col("view").alias("source"), F.col("step").alias("s_step"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    d = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))
    best = targets.join(s, "scene").groupBy("scene", "view").agg(F.min(F.struct(F.round(d, 9).alias("distance"), "s_step", "source")).alias("b"))
    return best.select("scene", "view", "b.source", "b.distance")


def best_sources(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """For each target bundle, the source bundle of its scene with most shared entities, most kinds, the lower rank, then the later id.

    targets: (scene, target, entity); sources: (scene, source, rank, entity, label).
    """
    both = targets.join(sources, ["scene", "entity"]).groupBy("scene", "target", "source", "rank").agg(F.count_distinct("entity").alias("n"), F.count_distinct("label").alias("k"))
    return both.groupBy("scene", "target").agg(F.max(F.struct("n", "k", (-F.col("rank")).alias("m"), "source")).alias("b")).select("scene", "target", "b.source", "b.n")


def frame_pairs(views: DataFrame, least: float = 30.0) -> DataFrame:
    """Of each episode and pair (subject, reference), two views turned apart that give different relations: those furthest apart.

    views: (episode, step, yaw_deg, subject, reference, relation).
    """
    keys = ["episode", "subject", "reference"]
    a = views.select(*keys, F.col("step").alias("a"), F.col("yaw_deg").alias("ya"), F.col("relation").alias("ra"))
    b = views.select(*keys, F.col("step").alias("b"), F.col("yaw_deg").alias("yb"), F.col("relation").alias("rb"))
    pairs = a.join(b, keys).where("a < b and ra <> rb").withColumn("turn_deg", G.circular_delta(F.col("ya"), F.col("yb"))).where(F.col("turn_deg") >= least)
    best = pairs.groupBy(*keys).agg(F.max(F.struct(F.round("turn_deg", 9).alias("turn_deg"), (-F.col("a")).alias("ma"), (-F.col("b")).alias("mb"), "ra", "rb")).alias("p"))
    return best.select(*keys, (-F.col("p.ma")).alias("a"), (-F.col("p.mb")).alias("b"), "p.turn_deg", F.col("p.ra").alias("relation_a"), F.col("p.rb").alias("relation_b"))


def aux_capped(rows: DataFrame, key: str, order: list[Column], aux: Column, cap: int) -> DataFrame:
    by = W.partitionBy(key).orderBy(*order)
    n = F.sum(aux.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_n", n).where(~aux | (F.col("_n") <= cap)).drop("_n")
