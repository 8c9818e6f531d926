"""Ordered state over sightings: rows (episode, step, entity, ...), one view a step.

Windows run within one episode; an episode's views are bounded by its
trajectory, not by the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import geometry as G


def _episode():
    return W.partitionBy("episode")


def _entity():
    return W.partitionBy("episode", "entity")


def belief_deltas(seen: DataFrame) -> DataFrame:
    """Rows (episode, step, entity, change): added at the first sighting, reobserved after."""
    first = F.min("step").over(_entity())
    return seen.select("episode", "step", "entity", F.when(F.col("step") == first, "added").otherwise("reobserved").alias("change"))


def state_deltas(seen: DataFrame) -> DataFrame:
    """One row a step: the entities added and reobserved, sorted; occluded is kept empty, as no view tells of it."""
    d = belief_deltas(seen).groupBy("episode", "step").agg(*[F.array_sort(F.collect_set(F.when(F.col("change") == c, F.col("entity")))).alias(c) for c in ("added", "reobserved")])
    return d.withColumn("occluded", F.array().cast("array<string>"))


def beliefs(seen: DataFrame) -> DataFrame:
    """One row an entity: first_step, last_step, n_views, evidence (sorted steps), visible_now."""
    end = seen.groupBy("episode").agg(F.max("step").alias("end"))
    each = seen.groupBy("episode", "entity").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count_distinct("step").alias("n_views"), F.array_sort(F.collect_set("step")).alias("evidence"))
    return each.join(end, "episode").withColumn("visible_now", F.col("last_step") == F.col("end")).drop("end")


def numbered_entities(seen: DataFrame, prefix: str = "ent-") -> DataFrame:
    """Entities by first sighting, then name: ent-000, ent-001, ..."""
    first = seen.groupBy("episode", "entity").agg(F.min("step").alias("first_step"))
    nth = F.row_number().over(_episode().orderBy("first_step", "entity")) - 1
    return first.withColumn("observable_id", F.concat(F.lit(prefix), F.lpad(nth.cast("string"), 3, "0")))


def reappearances(seen: DataFrame) -> DataFrame:
    """Sightings after a gap: (episode, entity, step, gap), gap over 1."""
    gap = F.col("step") - F.lag("step").over(_entity().orderBy("step"))
    return seen.select("episode", "entity", "step", gap.alias("gap")).where("gap > 1")


def new_per_view(seen: DataFrame) -> DataFrame:
    d = belief_deltas(seen)
    return d.groupBy("episode", "step").agg(F.count_if(F.col("change") == "added").alias("n_new"), F.count("*").alias("n_seen"))


def views(seen: DataFrame) -> DataFrame:
    """One row a step with the sorted set of its entities."""
    return seen.groupBy("episode", "step").agg(F.array_sort(F.collect_set("entity")).alias("entities"))


def first_entry(seen: DataFrame) -> DataFrame:
    """For each episode, the first step whose view has exactly one entity that the view before lacks."""
    before = F.lag("entities").over(_episode().orderBy("step"))
    new = views(seen).withColumn("new", F.array_except("entities", before)).where(F.size("new") == 1)
    return new.groupBy("episode").agg(F.min(F.struct("step", F.col("new")[0].alias("entity"))).alias("e")).select("episode", "e.step", "e.entity")


def covisible_pairs(seen: DataFrame) -> DataFrame:
    """Pairs of entities of an episode that share views: (episode, a, b, n_views)."""
    a = seen.select("episode", "step", F.col("entity").alias("a")).distinct()
    b = a.withColumnRenamed("a", "b")
    return a.join(b, ["episode", "step"]).where("a < b").groupBy("episode", "a", "b").agg(F.count("*").alias("n_views"))


def never_covisible_pairs(seen: DataFrame) -> DataFrame:
    a = seen.select("episode", F.col("entity").alias("a")).distinct()
    pairs = a.join(a.withColumnRenamed("a", "b"), "episode").where("a < b")
    return pairs.join(covisible_pairs(seen), ["episode", "a", "b"], "left_anti")


def views_with_all(seen: DataFrame, wanted: list[str]) -> DataFrame:
    """Views that show all of the wanted entities."""
    few = seen.where(F.col("entity").isin(*wanted)).groupBy("episode", "step").agg(F.count_distinct("entity").alias("n"))
    return few.where(F.col("n") == len(set(wanted))).drop("n")


def view_pair_overlap(seen: DataFrame, high: float = 0.5) -> DataFrame:
    """Of each episode and overlap class (high, low, zero), the pair of views furthest apart: Jaccard of their entities."""
    v = views(seen)
    a = v.select("episode", F.col("step").alias("a"), F.col("entities").alias("ea"))
    b = v.select("episode", F.col("step").alias("b"), F.col("entities").alias("eb"))
    share = F.size(F.array_intersect("ea", "eb")) / F.size(F.array_union("ea", "eb"))
    pairs = a.join(b, "episode").where("a < b").withColumn("jaccard", share)
    kind = F.when(F.col("jaccard") == 0, "zero").when(F.col("jaccard") >= high, "high").otherwise("low")
    best = pairs.withColumn("overlap", kind).groupBy("episode", "overlap").agg(F.max(F.struct((F.col("b") - F.col("a")).alias("gap"), (-F.col("a")).alias("m"), "b", "jaccard")).alias("p"), F.count("*").alias("n_pairs"))
    return best.select("episode", "overlap", "n_pairs", (-F.col("p.m")).alias("a"), F.col("p.b").alias("b"), "p.jaccard")


def view_subsets(seen: DataFrame, size: int = 3) -> DataFrame:
    """All ascending subsets of `size` of an episode's views with what all of them show: (episode, steps, shared).

    Their number is set by the views of one trajectory.
    """
    v = views(seen)
    out = v.select("episode", F.array("step").alias("steps"), F.col("entities").alias("shared"))
    for _ in range(size - 1):
        more = v.select("episode", F.col("step").alias("s"), F.col("entities").alias("e"))
        out = out.join(more, "episode").where(F.col("s") > F.element_at("steps", -1))
        out = out.select("episode", F.array_append("steps", F.col("s")).alias("steps"), F.array_intersect("shared", "e").alias("shared"))
    return out


def circular_coverage(angles: DataFrame, key: str, angle: str) -> DataFrame:
    """For each key, 360 less the largest gap between its neighbouring angles, round the circle."""
    by = W.partitionBy(key).orderBy(angle)
    first = F.min(angle).over(W.partitionBy(key))
    gap = F.coalesce(F.lead(angle).over(by), first + 360) - F.col(angle)
    return angles.select(key, angle).distinct().withColumn("gap", gap).groupBy(key).agg(F.max("gap").alias("largest_gap"), F.count("*").alias("n_angles")).withColumn("coverage_deg", 360 - F.col("largest_gap"))


def cumulative_path(points: DataFrame, key: str, step: str, x: str, y: str) -> DataFrame:
    """Points with the distance from the one before and the length so far."""
    by = W.partitionBy(key).orderBy(step)
    leg = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(by), F.col(y) - F.lag(y).over(by)), F.lit(0.0))
    return points.withColumn("leg", leg).withColumn("travelled", F.sum("leg").over(by.rowsBetween(W.unboundedPreceding, 0)))


def trajectory_contract(path: DataFrame, key: str, step: str, x: str, y: str, tolerance: float = 1e-6) -> DataFrame:
    """One row a key: contiguous (steps 0..n-1), closed (last point at the first), n_steps."""
    ends = path.groupBy(key).agg(
        F.min_by(F.struct(x, y), step).alias("a"), F.max_by(F.struct(x, y), step).alias("b"), F.count("*").alias("n_steps"),
        ((F.min(step) == 0) & (F.max(step) == F.count("*") - 1) & (F.count_distinct(step) == F.count("*"))).alias("contiguous"),
    )
    near = F.greatest(F.abs(F.col(f"a.{x}") - F.col(f"b.{x}")), F.abs(F.col(f"a.{y}") - F.col(f"b.{y}"))) <= tolerance
    return ends.select(key, "n_steps", "contiguous", near.alias("closed"))


def resampled(path: DataFrame, key: str, x: str, y: str, count: int) -> DataFrame:
    """`count` points at equal distances along each path (see cumulative_path), by linear interpolation."""
    by = W.partitionBy(key).orderBy("travelled")
    legs = path.select(key, "travelled", x, y, F.lead("travelled").over(by).alias("to"), F.lead(x).over(by).alias("x2"), F.lead(y).over(by).alias("y2"))
    length = path.groupBy(key).agg(F.max("travelled").alias("length"))
    targets = length.select(key, "length", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"))
    # the last target is the end itself, whatever rounding says
    targets = targets.withColumn("t", F.when(F.col("i") == count - 1, F.col("length")).otherwise(F.col("length") * F.col("i") / (count - 1)))
    # the leg that holds the target: at a corner the one before it
    on = legs.where("to > travelled").join(targets, key).where("t >= travelled and t <= to")
    part = (F.col("t") - F.col("travelled")) / (F.col("to") - F.col("travelled"))
    found = on.select(key, "i", "travelled", (F.col(x) + part * (F.col("x2") - F.col(x))).alias("px"), (F.col(y) + part * (F.col("y2") - F.col(y))).alias("py"))
    return found.groupBy(key, "i").agg(F.min(F.struct("travelled", "px", "py")).alias("p")).select(key, "i", F.col("p.px").alias(x), F.col("p.py").alias(y))


def run_lengths(rows: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """States without consecutive repeats: (key, nth, state, n)."""
    by = W.partitionBy(key).orderBy(*order)
    change = F.coalesce(~F.col(state).eqNullSafe(F.lag(state).over(by)) | (F.row_number().over(by) == 1), F.lit(True))
    nth = F.sum(change.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)) - 1
    return rows.select(key, F.col(state).alias("state"), nth.alias("nth")).groupBy(key, "nth", "state").agg(F.count("*").alias("n"))


def turns(poses: DataFrame, key: str, step: str, yaw: str, least: float = 175.0) -> DataFrame:
    """Steps at which the yaw turns about between the view before and the one after."""
    by = W.partitionBy(key).orderBy(step)
    delta = F.abs(F.pmod(F.lead(yaw).over(by) - F.lag(yaw).over(by) + 180, F.lit(360.0)) - 180)
    return poses.select(key, step, delta.alias("turn_deg")).where(F.col("turn_deg") >= least)


def known_before(seen: DataFrame) -> DataFrame:
    """One row a step: how many of the view's entities earlier views had, and how many were ever seen until then."""
    first = seen.groupBy("episode", "entity").agg(F.min("step").alias("first_step"))
    new = first.groupBy("episode", F.col("first_step").alias("step")).agg(F.count("*").alias("n_new"))
    per = views(seen).select("episode", "step", F.size("entities").alias("n_seen")).join(new, ["episode", "step"], "left").fillna(0, ["n_new"])
    total = F.sum("n_new").over(_episode().orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    return per.withColumn("known_after", total).withColumn("n_known", F.col("n_seen") - F.col("n_new"))


def release_faults(released: DataFrame, used: DataFrame) -> DataFrame:
    """Evidence used before its release, views released twice, views never released: (episode, view, fault).

    released: (episode, view, round); used: (episode, view, round).
    """
    first = released.groupBy("episode", "view").agg(F.min("round").alias("first"), F.count("*").alias("times"))
    twice = first.where("times > 1").select("episode", "view", F.lit("released twice").alias("fault"))
    joined = used.join(first, ["episode", "view"], "left")
    early = joined.where("first > round").select("episode", "view", F.lit("used before release").alias("fault")).distinct()
    never = joined.where("first is null").select("episode", "view", F.lit("never released").alias("fault")).distinct()
    return twice.unionByName(early).unionByName(never)


def gone_entities(seen: DataFrame) -> DataFrame:
    """Entities last seen before their episode's end: (episode, entity, last_step, end)."""
    end = seen.groupBy("episode").agg(F.max("step").alias("end"))
    last = seen.groupBy("episode", "entity").agg(F.max("step").alias("last_step"))
    return last.join(end, "episode").where("last_step < end")


def view_links(seen: DataFrame, shared: int = 2) -> DataFrame:
    """Links between views of an episode that share at least so many entities: (episode, a, b)."""
    a = seen.select("episode", "entity", F.col("step").alias("a")).distinct()
    b = a.withColumnRenamed("a", "b")
    return a.join(b, ["episode", "entity"]).where("a < b").groupBy("episode", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= shared).drop("n")


def visibility_status(first: Column, last: Column, end: Column) -> Column:
    return F.when(last == end, "visible").when(first.isNull(), "unknown").otherwise("remembered")


def named_visible(seen: DataFrame, least: int = 256) -> DataFrame:
    """Entities of a view with at least so many pixels, placed from 1 by most pixels, then id. seen: (episode, step, entity, pixels)."""
    place = F.row_number().over(W.partitionBy("episode", "step").orderBy(F.desc("pixels"), "entity"))
    return seen.where(F.col("pixels") >= least).select("episode", "step", "entity", "pixels", place.alias("place"))


def turn_events(poses: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Each view and the one before: the change of yaw, and whether it is a turnaround. poses: (episode, step, yaw_deg)."""
    before = F.lag("yaw_deg").over(W.partitionBy("episode").orderBy("step"))
    change = poses.withColumn("yaw_change_deg", G.wrap_degrees(F.col("yaw_deg") - before)).where("yaw_change_deg is not null")
    verified = F.abs(F.abs("yaw_change_deg") - 180.0) <= tolerance
    return change.select("episode", "step", F.round("yaw_change_deg", 6).alias("yaw_change_deg"), F.when(verified, "turnaround").otherwise("heading_change").alias("event"), verified.alias("verified"))
