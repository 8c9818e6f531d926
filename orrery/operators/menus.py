"""Questions about layouts around an anchor, and menus that choose among them alike for every variant of a family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.plans.durable import cut

LEAST_CENTER_DEG = 15.0
LEAST_EFFECTIVE_DEG = 8.0
FORMS = ("cross_view_relation", "object_anchored_perspective")


def layout_questions(layouts: DataFrame, satellites: DataFrame, center: float = LEAST_CENTER_DEG, effective: float = LEAST_EFFECTIVE_DEG) -> DataFrame:
    """Directions between the objects around an anchor, in the first view's frame and from one of them facing the anchor.

    layouts: (family, variant, anchor_x, anchor_y, frame_yaw); satellites:
    (family, variant, name, category, x, y, radius, view), a handful a layout.
    Rows (family, variant, task, subject, reference, label, margin_deg,
    effective_deg, subject_view, reference_view), categories for subject and
    reference; only directions clear by both margins, of two objects that are
    shown in different views. An object at the anchor's place has no
    perspective of its own.
    """
    keys = ["family", "variant"]
    names = ("name", "category", "x", "y", "radius", "view")
    # the handful of a layout is paired in its row
    held = satellites.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("all"))
    both = held.select(*keys, "all", F.explode("all").alias("s")).select(*keys, "s", F.explode("all").alias("r")).where("s.name <> r.name and s.view <> r.view")
    pairs = both.select(*keys, *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "sr" for c in names]).join(layouts, keys)
    facing = F.atan2(-(F.col("anchor_x") - F.col("r_x")), F.col("anchor_y") - F.col("r_y"))
    apart = F.hypot(F.col("anchor_x") - F.col("r_x"), F.col("anchor_y") - F.col("r_y")) > 1e-9
    yaws = F.array(F.struct(F.lit(FORMS[0]).alias("task"), F.col("frame_yaw").alias("yaw")), F.struct(F.lit(FORMS[1]).alias("task"), F.when(apart, facing).alias("yaw")))
    each = pairs.select("*", F.explode(yaws).alias("q")).where("q.yaw is not null")
    measured = each.withColumn("d", G.direction(F.col("s_x"), F.col("s_y"), F.col("r_x"), F.col("r_y"), F.col("q.yaw"), F.col("s_radius") + F.col("r_radius")))
    clear = measured.where((F.round("d.margin_deg", 9) >= center) & (F.round("d.effective_margin_deg", 9) >= effective))
    return clear.select(
        *keys, "q.task", F.col("s_category").alias("subject"), F.col("r_category").alias("reference"), "d.label", F.col("d.margin_deg").alias("margin_deg"),
        F.col("d.effective_margin_deg").alias("effective_deg"), F.col("s_view").alias("subject_view"), F.col("r_view").alias("reference_view"),
    )


def query_menu(questions: DataFrame, variants: tuple[str, ...], per_family: int, identity: str = "identity") -> DataFrame:
    """The same per_family questions for every variant of a family, spread over tasks and labels.

    questions: (family, variant, task, subject, reference, label), any number
    of a family. A question takes part if every variant has it. Tasks share
    the budget evenly, the first by name getting what is over. Within a task,
    labels (of the identity variant) take turns in their order, which begins at
    a place that the family's hash names, and each gives its questions by hash.
    A family that cannot fill its budget gives none; repeated questions count
    once. Rows (family, place, variant, task, subject, reference, label), place
    from 0.
    """
    keys = ["family", "task", "subject", "reference"]
    wanted = cut(questions.where(F.col("variant").isin(*variants)).select(*keys, "variant", "label"))
    shared = wanted.groupBy(*keys).agg(F.count_distinct("variant").alias("n"), F.min(F.when(F.col("variant") == identity, F.col("label"))).alias("own")).where((F.col("n") == len(set(variants))) & F.col("own").isNotNull()).drop("n")
    tasks = shared.groupBy("family").agg(F.sort_array(F.collect_set("task")).alias("tasks"))
    labels = shared.groupBy("family", "task").agg(F.sort_array(F.collect_set("own")).alias("labels"))
    first = F.conv(F.substring(F.sha2(F.col("family").cast("string"), 256), 1, 8), 16, 10).cast("long")
    n_tasks, n_labels = F.size("tasks"), F.size("labels")
    nth_task = F.array_position("tasks", F.col("task")) - 1
    budget = F.floor(F.lit(per_family) / n_tasks) + F.when(nth_task < F.lit(per_family) % n_tasks, 1).otherwise(0)
    turn = F.pmod(F.array_position("labels", F.col("own")) - 1 - first % n_labels, n_labels)
    rows = shared.join(tasks, "family").join(labels, ["family", "task"]).select(*keys, "own", nth_task.alias("nth_task"), budget.alias("budget"), turn.alias("turn"))
    order = F.sha2(F.concat_ws("|", F.lit("query-menu"), *[F.col(k).cast("string") for k in keys]), 256)
    # a question's place within its label, then the place of its turn within the task
    rows = rows.withColumn("round", F.row_number().over(W.partitionBy("family", "task", "own").orderBy(order)))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("family", "task").orderBy("round", "turn"))).where(F.col("nth") <= F.col("budget"))
    by = W.partitionBy("family")
    rows = rows.withColumn("chosen", F.count("*").over(by)).withColumn("place", F.row_number().over(by.orderBy("nth_task", "nth")) - 1).where(F.col("chosen") == per_family)
    told = wanted.groupBy(*keys, "variant").agg(F.min("label").alias("label"))
    return rows.select(*keys, F.col("place").cast("long").alias("place")).join(told, keys).select("family", "place", "variant", "task", "subject", "reference", "label")
