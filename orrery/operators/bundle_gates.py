"""Gates of whole trajectories, by class: rows (episode, gate, measured, required, passed).

seen: (episode, step, entity); poses: (episode, step, yaw_deg or bearing or height).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.operators.visibility import circular_coverage, views


def _gates(rows: DataFrame, *checks: tuple[str, Column, float]) -> DataFrame:
    """Named least values, as rows; a null measure fails."""
    made = [F.struct(F.lit(n).alias("gate"), m.cast("double").alias("measured"), F.lit(float(r)).alias("required"), F.coalesce(m >= r, F.lit(False)).alias("passed")) for n, m, r in checks]
    return rows.select("episode", F.explode(F.array(*made)).alias("g")).select("episode", "g.*")


def rotation_gate(seen: DataFrame, poses: DataFrame, structural: Column | None = None, panorama: int = 8, rear_only: int = 2, baseline_m: float = 1e-6) -> DataFrame:
    """A turn on the spot. poses: (episode, step, yaw_deg, x, y, z), and depth_questions_forbidden where the plan says so.

    Front is less than 90 degrees from the first yaw and rear more; no pose
    may leave the first position by more than baseline_m; all views together
    must show `panorama` entities that are no structure, and the rear alone
    `rear_only`; questions of depth must be forbidden; every yaw needs its view.
    """
    first = poses.groupBy("episode").agg(F.min_by(F.struct("yaw_deg", "x", "y", "z"), "step").alias("o"))
    at = poses.join(first, "episode").withColumn("turn", F.abs(G.wrap_degrees(F.col("yaw_deg") - F.col("o.yaw_deg"))))
    away = F.sqrt(sum((F.col(c) - F.col(f"o.{c}")) ** 2 for c in "xyz"))
    told = F.col("depth_questions_forbidden") if "depth_questions_forbidden" in poses.columns else F.lit(False)
    n = at.groupBy("episode").agg(F.max(away).alias("baseline"), F.min(told.cast("int")).alias("told"), F.count("yaw_deg").alias("yaws"))
    core = seen if structural is None else seen.where(~structural)
    shown = core.join(at.select("episode", "step", "turn"), ["episode", "step"]).groupBy("episode", "entity").agg(F.max((F.col("turn") < 90).cast("int")).alias("f"), F.max((F.col("turn") > 90).cast("int")).alias("r"))
    kinds = shown.groupBy("episode").agg(F.count("*").alias("core"), F.count_if((F.col("r") == 1) & (F.col("f") == 0)).alias("only"))
    views_of = seen.groupBy("episode").agg(F.count_distinct("step").alias("views"))
    rows = n.join(kinds, "episode", "left").join(views_of, "episode", "left")
    return _gates(
        rows, ("zero_parallax", -F.col("baseline"), -baseline_m), ("panorama_core_entities", F.coalesce("core", F.lit(0)), panorama),
        ("rear_only_core_entities", F.coalesce("only", F.lit(0)), rear_only), ("depth_questions_forbidden", F.col("told"), 1), ("yaw_sequence_matches_views", (F.col("yaws") == F.col("views")).cast("int"), 1),
    )


def orbit_gate(seen: DataFrame, poses: DataFrame, focus: str, coverage: float = 240.0, share: float = 0.8) -> DataFrame:
    """A walk round an object: arc that its views cover, and the share of views that show it."""
    arc = circular_coverage(poses.withColumn("bearing", F.pmod(F.col("bearing"), F.lit(360.0))), "episode", "bearing")
    hit = seen.where(F.col("entity") == focus).groupBy("episode").agg(F.count_distinct("step").alias("hit"))
    total = poses.groupBy("episode").agg(F.count_distinct("step").alias("n"))
    rows = total.join(hit, "episode", "left").join(arc.select("episode", "coverage_deg"), "episode")
    return _gates(rows, ("arc_deg", F.col("coverage_deg"), coverage), ("focus_share", F.coalesce("hit", F.lit(0)) / F.col("n"), share))


def elevation_gate(seen: DataFrame, poses: DataFrame, span: float = 0.5, shared: int = 2) -> DataFrame:
    """Views from low and high: difference of height, and entities that all views show."""
    height = poses.groupBy("episode").agg((F.max("height") - F.min("height")).alias("span"), F.count_distinct("step").alias("n"))
    every = seen.groupBy("episode", "entity").agg(F.count_distinct("step").alias("k")).join(height.select("episode", "n"), "episode")
    common = every.groupBy("episode").agg(F.count_if(F.col("k") == F.col("n")).alias("common"))
    return _gates(height.join(common, "episode", "left"), ("height_span", F.col("span"), span), ("shared_entities", F.col("common"), shared))


def occlusion_gate(seen: DataFrame, target: str, hidden: int = 2) -> DataFrame:
    """A hidden target: views before it first shows, and whether it shows."""
    first = seen.where(F.col("entity") == target).groupBy("episode").agg(F.min("step").alias("first"))
    all_views = views(seen).select("episode", "step")
    rows = all_views.join(first, "episode", "left").groupBy("episode").agg(F.count_if(F.coalesce(F.col("step") < F.col("first"), F.lit(True))).alias("before"), F.max(F.col("first").isNotNull().cast("int")).alias("shows"))
    return _gates(rows, ("hidden_views", F.col("before"), hidden), ("shown", F.col("shows"), 1))


def target_view_gate(seen: DataFrame, target: str, anchors: int = 2) -> DataFrame:
    """A last view to predict: whether it shows the target, and how many of its entities earlier views had."""
    end = seen.groupBy("episode").agg(F.max("step").alias("end"))
    at = seen.join(end, "episode")
    early = at.where("step < end").select("episode", "entity").distinct().withColumn("known", F.lit(1))
    last = at.where("step = end").select("episode", "entity").distinct().join(early, ["episode", "entity"], "left")
    rows = last.groupBy("episode").agg(F.max((F.col("entity") == target).cast("int")).alias("shows"), F.count("known").alias("anchors"))
    return _gates(rows, ("target_shown", F.col("shows"), 1), ("known_anchors", F.col("anchors"), anchors))


def layout_gate(seen: DataFrame, least_views: int = 2, kinds: int = 5) -> DataFrame:
    """A layout of several objects: how many are seen in enough views."""
    n = seen.groupBy("episode", "entity").agg(F.count_distinct("step").alias("k"))
    return _gates(n.groupBy("episode").agg(F.count_if(F.col("k") >= least_views).alias("ok")), ("objects_seen", F.col("ok"), kinds))


def evidence_counts(seen: DataFrame) -> DataFrame:
    """What a trajectory offers: views, entities, reappearances, entries and pairs never seen together."""
    from orrery.operators.visibility import never_covisible_pairs, reappearances

    base = seen.groupBy("episode").agg(F.count_distinct("step").alias("n_views"), F.count_distinct("entity").alias("n_entities"))
    gaps = reappearances(seen).groupBy("episode").agg(F.count("*").alias("n_gaps"))
    apart = never_covisible_pairs(seen).groupBy("episode").agg(F.count("*").alias("n_never_together"))
    return base.join(gaps, "episode", "left").join(apart, "episode", "left").fillna(0, ["n_gaps", "n_never_together"])
