"""Named quality gates: every check keeps what it measured, so a rejected row keeps its reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import raster


def reasons(*checks: tuple[str, Column]) -> Column:
    """Codes of the checks that fail (a null check fails), in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise(code) for code, ok in checks]))


def gated(rows: DataFrame, *checks: tuple[str, Column]) -> DataFrame:
    """Rows with reasons and passed."""
    return rows.withColumn("reasons", reasons(*checks)).withColumn("passed", F.size("reasons") == 0)


# Limits of a model frame.
DOMINANT_COLOUR, LEAST_ENTROPY = 0.60, 2.75
NEAR_THINGS, NEAR_ANY, CLOSE_GEOMETRY = 0.35, 0.90, 0.90
ENCLOSURE, ENCLOSURE_MEDIAN_M, ENCLOSURE_SPREAD_M = 0.95, 0.90, 0.60
FOREGROUND, FOREGROUND_MEDIAN_M, FOREGROUND_SIDES = 0.60, 0.75, ("left", "right", "top")


def frame_evidence(pixels: DataFrame, width: int, height: int, structural: Column, enclosing: Column) -> DataFrame:
    """One row a view: colour, collision and depth statistics, the share of enclosing pixels, and the largest instance that is no structure (ties to the smaller number).

    structural, enclosing: conditions on a pixel's instance.
    """
    colour, collision = raster.colour_stats(pixels), raster.collision_stats(pixels, height, structural=structural)
    context = raster.context_stats(pixels, width=width, height=height).select("view", "p10", "p50", "p90", "close_share")
    walls = pixels.groupBy("view").agg(F.avg(enclosing.cast("int")).alias("enclosing_share"), F.count("*").alias("frame_pixels"))
    depth = F.when((F.col("depth_m") > 0) & ~F.isnan("depth_m"), F.col("depth_m"))
    things = pixels.where(~structural)
    things = things.groupBy("view", "instance").agg(
        F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.percentile(depth, 0.5).alias("median_m")
    )
    sides = F.array_compact(F.array(*[F.when(c, n) for n, c in (("left", F.col("x0") == 0), ("right", F.col("x1") == width - 1), ("top", F.col("y0") == 0), ("bottom", F.col("y1") == height - 1))]))
    first = things.groupBy("view").agg(F.max_by(F.struct("n", sides.alias("sides"), "median_m"), F.struct("n", -F.col("instance"))).alias("f"))
    rows = colour.join(collision, "view").join(context, "view").join(walls, "view").join(first, "view", "left")
    return rows.withColumn("foreground_share", F.col("f.n") / F.col("frame_pixels")).withColumn("foreground_sides", F.col("f.sides")).withColumn("foreground_m", F.col("f.median_m")).drop("f")


def frame_checks() -> tuple[tuple[str, Column], ...]:
    """Checks on a row of frame_evidence(); what has no valid depth counts as 0."""

    def no(*conditions: Column) -> Column:
        return ~reduce(Column.__and__, [F.coalesce(c, F.lit(False)) for c in conditions])

    zero = lambda c: F.coalesce(c, F.lit(0.0))
    all_sides = F.size(F.array_intersect("foreground_sides", F.array(*map(F.lit, FOREGROUND_SIDES)))) == len(FOREGROUND_SIDES)
    return (
        ("degenerate_rgb", no(F.col("dominant_share") >= DOMINANT_COLOUR, F.col("entropy_bits") < LEAST_ENTROPY)),
        ("camera_collision", (zero("near_thing_share") < NEAR_THINGS) & (zero("near_share") < NEAR_ANY)),
        ("near_surface_saturation", zero("close_share") < CLOSE_GEOMETRY),
        ("near_enclosure", no(F.col("enclosing_share") >= ENCLOSURE, zero("p50") <= ENCLOSURE_MEDIAN_M, zero(F.col("p90") - F.col("p10")) <= ENCLOSURE_SPREAD_M)),
        ("foreground_occlusion", no(F.col("foreground_share") >= FOREGROUND, all_sides, F.col("foreground_m") <= FOREGROUND_MEDIAN_M)),
    )


def referent_checks(pixels: int, side: int, outer: float, fill: float) -> tuple[tuple[str, Column], ...]:
    """Checks that an instance can be recognised."""
    return (
        ("too_few_pixels", F.col("pixels") >= pixels),
        ("too_thin", F.col("min_side") >= side),
        ("at_border", F.col("outer_share") < outer),
        ("sparse", F.col("fill_ratio") >= fill),
        ("cut_on_two_sides", F.size("sides") < 2),
    )


def tier(status: Column, quality: Column, audit: Column) -> Column:
    """excluded, audit_only or candidate."""
    return F.when(status != "passed", "excluded").when(~F.coalesce(quality, F.lit(False)), "excluded").when(~F.coalesce(audit, F.lit(False)), "audit_only").otherwise("candidate")


def decided(automatic: Column, decision: Column) -> Column:
    """An accept cannot lift an exclusion; a reject always excludes; without a decision nothing changes."""
    return F.when(decision == "reject", "excluded").when((decision == "accept") & (automatic != "excluded"), "candidate").otherwise(automatic)


def adjudicated(integrity: Column, evidence: Column, visual: Column, review: Column) -> Column:
    """The first ground that applies: integrity, typed evidence, visual, review, else accept."""
    return F.when(~integrity, "reject_integrity").when(~evidence, "reject_evidence").when(~visual, "reject_visual").when(review, "needs_review").otherwise("accept")


def reason_code(detail: Column, codes: tuple[tuple[str, str], ...], otherwise: str = "other") -> Column:
    """The code of the first fragment that a failure's text holds."""
    out = F.lit(otherwise)
    for fragment, code in reversed(codes):
        out = F.when(F.contains(F.lower(detail), F.lit(fragment)), code).otherwise(out)
    return out


def yaw_bin(angle: Column) -> Column:
    return F.when(F.abs(angle) < 45, "small").when(F.abs(angle) <= 120, "medium").otherwise("large")


def scene_class(rooms: Column, objects: Column, categories: Column) -> Column:
    rich = (objects >= 20) & (categories >= 8)
    return F.when(rich & (rooms >= 2), "multi_room_rich").when(rich, "single_room_rich").otherwise("sparse")


def placement(dims: Column, fit: Column) -> Column:
    """Where an object can be put, by its largest side and volume."""
    side = F.array_max(dims)
    volume = F.aggregate(dims, F.lit(1.0), lambda a, x: a * x)
    return F.when(~fit, "exclude").when((side <= 0.45) & (volume <= 0.03), "tabletop").when(side <= 1.2, "floor").when(side <= 2.5, "large_floor").otherwise("exclude")


def requires(have: Column, need: Column) -> Column:
    """Whether nothing needed is missing."""
    return F.size(F.array_except(need, have)) == 0


def signal(value: Column, low: float, high: float) -> Column:
    """0 at low, 1 at high, straight between; null counts as no risk."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low))), F.lit(0.0))


def risk(*signals: Column) -> Column:
    return F.greatest(*signals)


def visual_blockers(views: DataFrame) -> DataFrame:
    """Views that carry too little to learn from, with reasons; flat texture alone is no reason.

    views: any keys, rgb_std, rgb_p99, rgb_p01, sharpness, instances. A null measure blocks.
    """
    checks = (
        ("near_uniform_rgb", F.col("rgb_std") >= 5.0),
        ("severe_underexposure", F.col("rgb_p99") >= 20.0),
        ("severe_overexposure", F.col("rgb_p01") <= 235.0),
        ("low_information_or_camera_collision", (F.col("sharpness") >= 1.5) | (F.col("instances") > 2)),
    )
    return gated(views, *checks).where("not passed").drop("passed")


def anchor_checks(pixels: int = 2000, side: int = 40, outer: float = 0.80) -> tuple[tuple[str, Column], ...]:
    """Checks, after referent_checks(), that an instance stands out enough to anchor a question about another view."""
    return (("anchor_pixels", F.col("pixels") >= pixels), ("anchor_side", F.col("min_side") >= side), ("anchor_border", F.col("outer_share") < outer))


def pair_tier(job: Column, base_integrity: Column, base_visual: Column, variant_integrity: Column, variant_visual: Column) -> Column:
    """Tier and reasons of a pair of renders, before any human decision; what is null is no pass."""
    sound = lambda c: F.coalesce(c == "pass", F.lit(False))
    broken = F.array_compact(F.array(*[F.when(~sound(c), f"{n} sensor integrity is not a full pass") for n, c in (("base", base_integrity), ("variant", variant_integrity))]))
    made = lambda tier, why: F.struct(F.lit(tier).alias("tier"), why.alias("reasons"))
    one = lambda text: F.array(text if isinstance(text, Column) else F.lit(text))
    return (
        F.when(~F.coalesce(job.isin("certified", "needs_review"), F.lit(False)), made("excluded", one(F.concat(F.lit("intervention job status is "), F.coalesce(job, F.lit("unknown"))))))
        .when(F.size(broken) > 0, made("audit_only", broken))
        .when(~sound(base_visual) | ~sound(variant_visual), made("candidate", one("base or variant visual warning requires human review")))
        .otherwise(made("candidate", one("awaiting explicit pair-level human acceptance")))
    )


def degenerate_views(questions: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows (question, bad_views): the views of a question, in its order, whose frame did not pass; none: an empty list.

    questions: (question, views: array); frames: (view, passed). A view without a frame has not passed.
    """
    asked = questions.select("question", F.posexplode_outer("views").alias("at", "view"))
    judged = asked.join(frames.select("view", "passed"), "view", "left")
    bad = F.when(F.col("view").isNotNull() & ~F.coalesce("passed", F.lit(False)), F.struct("at", "view"))
    return judged.groupBy("question").agg(F.transform(F.array_sort(F.collect_list(bad)), lambda x: x["view"]).alias("bad_views"))


def adjudication_counts(jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows (decision, jobs, scenes). jobs: (job, scene); decisions: (job, decision); a job without one is unavailable_no_quality_report."""
    of = F.coalesce("decision", F.lit("unavailable_no_quality_report"))
    return jobs.join(decisions, "job", "left").groupBy(of.alias("decision")).agg(F.count("*").alias("jobs"), F.count_distinct("scene").alias("scenes"))
