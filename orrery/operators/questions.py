"""Question records from sightings and placed objects, each with the views that prove it.

A question is a row (episode, task_type, family, variant, ...). Families are
built whole: all variants of one come out of one row by explode, so none can
stand alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.operators.visibility import views

#: Fixed values: (task type, program id, signature).
PROGRAMS = (
    ("grounding_presence", "grounding_presence.v1", "G(view,entity_hint)->V_presence"),
    ("last_seen_memory", "last_seen_memory.v1", "G(sequence,entity_hint)->B_temporal->V_last_seen"),
    ("metric_distance", "metric_distance.v1", "G(view_set,a)+G(view_set,b)->M_distance->V_tolerance"),
    ("egocentric_relation", "egocentric_relation.v1", "G(view,a)+G(view,b)->F_ego(camera)->R->V"),
    ("cross_view_relation", "cross_view_register_relation.v1", "G(view_a,a)+G(view_b,b)->F*_cross_view->B_global->R_canonical->V"),
    ("counterfactual_verification", "counterfactual_cross_view.v1", "G(view_a,a)+G(view_b,b)->F*_cross_view->B_global->R_canonical->V_claim"),
    ("cross_view_unknown", "cross_view_evidence_unknown.v1", "G(view_set,a,b)->B_partial->V_unknown"),
    ("evidence_presence_unknown", "evidence_presence_unknown.v1", "G(view_set,entity_hint)->B_partial->V_unknown"),
    ("evidence_presence_reveal", "evidence_presence_reveal.v1", "G(view_set,entity_hint)->B_update->V_presence"),
    ("object_centric_perspective", "object_centric_perspective.v1", "G(view_set,o)+G(view_set,f)+G(view_set,t)->B_global->F_query(o,f)->P(t)->V"),
    ("unknown_abstention", "unknown_abstention.v1", "G(observed_views)->B_observed->V_unknown"),
    ("rotation_change_detection", "rotation_change_detection.v1", "G(view_before)+G(view_after)->F_rotate->V_entered"),
    ("orbit_identity", "orbit_identity.v1", "G(view_a,focus)+G(view_b,focus)->F_object(azimuths)->V_identity"),
    ("elevation_relation_transfer", "elevation_relation_transfer.v1", "G(low,a,b)+G(high,a,b)->F_elevation->R_canonical->V_relation"),
    ("occlusion_unknown", "occlusion_unknown.v1", "G(prefix)->B_occluded->V_unknown"),
    ("occlusion_reveal", "occlusion_reveal.v1", "G(prefix)->B_occluded+G(decisive)->B_reveal->V"),
    ("target_view_prediction", "target_view_prediction.v1", "B_global->F_query(origin,facing)->P_visibility(target)->V_render"),
)


def programs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROGRAMS), "task_type string, program_id string, signature string")


def program_atoms(signature: Column) -> Column:
    """The operations of a signature in order: letters before an argument list, a mark or an arrow."""
    return F.regexp_extract_all(signature, F.lit(r"(?:^|->|\+)([GFBMRPV])"), F.lit(1))


def program_faults(nodes: DataFrame, externals: DataFrame) -> DataFrame:
    """Faults of typed programs in single-assignment order: (program_id, node_id, fault).

    nodes: (program_id, place, node_id, inputs array<struct(name, type)>,
    output_type); externals: (program_id, name, type). An input must be an
    external or an earlier node and have its type; ids are unique.
    """
    made = nodes.select("program_id", F.col("node_id").alias("name"), F.col("output_type").alias("made"), F.col("place").alias("at"))
    given = externals.select("program_id", "name", F.col("type").alias("made"), F.lit(-1).alias("at"))
    used = nodes.select("program_id", "node_id", "place", F.explode("inputs").alias("i")).select("program_id", "node_id", "place", F.col("i.name").alias("name"), F.col("i.type").alias("want"))
    joined = used.join(made.unionByName(given), ["program_id", "name"], "left")
    fault = F.when(F.col("made").isNull(), "unknown input").when(F.col("at") >= F.col("place"), "input made later").when(F.col("made") != F.col("want"), "wrong type")
    bad = joined.withColumn("fault", fault).where("fault is not null").select("program_id", "node_id", "fault")
    twice = nodes.groupBy("program_id", "node_id").agg(F.count("*").alias("n")).where("n > 1").select("program_id", "node_id", F.lit("made twice").alias("fault"))
    return bad.unionByName(twice)


def legal(rows: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions whose task is allowed for their trajectory class, and the rejections."""
    keys = ["trajectory_class", "task_type"]
    return rows.join(rules.select(*keys).distinct(), keys, "left_semi"), rows.join(rules.select(*keys), keys, "left_anti").withColumn("reason_code", F.lit("trajectory_illegal_task"))


def grounding_pairs(seen: DataFrame) -> DataFrame:
    """Presence questions at each episode's first view, with a negative sibling: the first entity by name that the episode has and the view lacks."""
    first = seen.groupBy("episode").agg(F.min("step").alias("step"))
    shown = seen.join(first, ["episode", "step"]).groupBy("episode", "step").agg(F.min("entity").alias("present"))
    absent = seen.select("episode", "entity").distinct().join(seen.join(first, ["episode", "step"]).select("episode", "entity"), ["episode", "entity"], "left_anti")
    both = shown.join(absent.groupBy("episode").agg(F.min("entity").alias("absent")), "episode", "left")
    variants = F.array_compact(F.array(F.struct(F.col("present").alias("entity"), F.lit(True).alias("answer")), F.when(F.col("absent").isNotNull(), F.struct(F.col("absent").alias("entity"), F.lit(False).alias("answer")))))
    return both.select("episode", "step", F.explode(variants).alias("v")).select("episode", F.lit("grounding_presence").alias("task_type"), "step", "v.entity", "v.answer")


def presence_families(seen: DataFrame) -> DataFrame:
    """Evidence triples of two views: unknown from a prefix, revealed by the entity's first view, unknown again with that view replaced.

    Rows (episode, entity, variant, steps, answer). The entity must be missing
    from the first view and from another view later than it appears.
    """
    ends = seen.groupBy("episode").agg(F.max("step").alias("end"))
    first = seen.groupBy("episode", "entity").agg(F.min("step").alias("shown")).where("shown >= 2")
    later = first.join(ends, "episode").select("episode", "entity", "shown", F.explode(F.sequence("shown", "end")).alias("step"))
    free = later.join(seen.select("episode", "entity", "step"), ["episode", "entity", "step"], "left_anti")
    swap = free.groupBy("episode", "entity", "shown").agg(F.min("step").alias("other"))
    at = lambda name, b, answer: F.struct(F.lit(name).alias("variant"), F.array(F.lit(0).cast("long"), b).alias("steps"), F.lit(answer).alias("answer"))
    v = F.array(at("prefix_unknown", F.lit(1).cast("long"), "unknown"), at("revealed", F.col("shown"), "present"), at("decisive_deleted", F.col("other"), "unknown"))
    return swap.select("episode", "entity", F.explode(v).alias("v")).select("episode", "entity", "v.*")


def claim_pairs(relations: DataFrame) -> DataFrame:
    """Two claims of a relation: the inverse, which is false, and the relation, which is true."""
    from orrery.operators.relations import inverse

    v = F.array(F.struct(F.lit("claim_false").alias("variant"), inverse(F.col("relation")).alias("claimed"), F.lit(False).alias("claim_correct")), F.struct(F.lit("claim_true").alias("variant"), F.col("relation").alias("claimed"), F.lit(True).alias("claim_correct")))
    return relations.select("subject", "reference", "relation", F.explode(v).alias("v")).select("subject", "reference", "relation", "v.*")


def last_seen_questions(seen: DataFrame) -> DataFrame:
    """Of each episode, the entity that was gone longest at the end, and the step of its last sighting."""
    end = seen.groupBy("episode").agg(F.max("step").alias("end"))
    last = seen.groupBy("episode", "entity").agg(F.max("step").alias("last_step")).join(end, "episode").where("last_step < end")
    return last.groupBy("episode").agg(F.min(F.struct("last_step", "entity")).alias("b")).select("episode", F.lit("last_seen_memory").alias("task_type"), "b.entity", F.col("b.last_step").alias("answer_step"))


def cross_view_questions(seen: DataFrame) -> DataFrame:
    """For each pair of entities that never share a view, the first view of either."""
    from orrery.operators.visibility import never_covisible_pairs

    first = seen.groupBy("episode", "entity").agg(F.min("step").alias("step"))
    a, b = (first.select("episode", F.col("entity").alias(k), F.col("step").alias(f"{k}_step")) for k in "ab")
    return never_covisible_pairs(seen).join(a, ["episode", "a"]).join(b, ["episode", "b"])


def orbit_identity(sights: DataFrame, least: float = 120.0) -> DataFrame:
    """Of each episode and entity, the two views whose bearings are furthest apart (column bearing, degrees), at least so far."""
    a = sights.select("episode", "entity", F.col("step").alias("a"), F.col("bearing").alias("ba"))
    b = sights.select("episode", "entity", F.col("step").alias("b"), F.col("bearing").alias("bb"))
    pairs = a.join(b, ["episode", "entity"]).where("a < b").withColumn("apart", G.angular_separation(F.col("ba"), F.col("bb"))).where(F.col("apart") >= least)
    best = pairs.groupBy("episode", "entity").agg(F.max(F.struct("apart", (-F.col("a")).alias("ma"), (-F.col("b")).alias("mb"))).alias("p"))
    return best.select("episode", "entity", (-F.col("p.ma")).alias("a"), (-F.col("p.mb")).alias("b"), F.col("p.apart").alias("apart"))


def occlusion_families(seen: DataFrame) -> DataFrame:
    """For each entity with three views that lack it: unknown from two of them, revealed by its first view, unknown from the third."""
    v = views(seen).select("episode", "step", "entities")
    ents = seen.groupBy("episode", "entity").agg(F.min("step").alias("shown"))
    free = ents.join(v, "episode").where(~F.array_contains("entities", F.col("entity")))
    nth = F.row_number().over(W.partitionBy("episode", "entity").orderBy("step"))
    three = free.withColumn("n", nth).where("n <= 3").groupBy("episode", "entity", "shown").agg(F.array_sort(F.collect_list("step")).alias("s")).where(F.size("s") == 3)
    at = lambda name, *steps, answer: F.struct(F.lit(name).alias("variant"), F.array(*steps).alias("steps"), F.lit(answer).alias("answer"))
    s = F.col("s")
    variants = F.array(at("occlusion_unknown", s[0], s[1], answer="unknown"), at("occlusion_reveal", s[0], F.col("shown"), answer="present"), at("decisive_deleted", s[0], s[2], answer="unknown"))
    return three.select("episode", "entity", F.explode(variants).alias("v")).select("episode", "entity", "v.*")


def elevation_pairs(heights: DataFrame, seen: DataFrame) -> DataFrame:
    """The first pair of entities, by name, that both the lowest and the highest view of an episode show (heights: episode, step, height)."""
    ends = heights.groupBy("episode").agg(F.min(F.struct("height", "step")).alias("lo"), F.max(F.struct("height", (-F.col("step")).alias("m"))).alias("hi"))
    ends = ends.select("episode", F.col("lo.step").alias("low"), (-F.col("hi.m")).alias("high")).where("low <> high")
    v = views(seen)
    low = ends.join(v.select("episode", F.col("step").alias("low"), F.col("entities").alias("el")), ["episode", "low"])
    both = low.join(v.select("episode", F.col("step").alias("high"), F.col("entities").alias("eh")), ["episode", "high"]).withColumn("c", F.array_sort(F.array_intersect("el", "eh"))).where(F.size("c") >= 2)
    return both.select("episode", "low", "high", F.col("c")[0].alias("a"), F.col("c")[1].alias("b"))


def self_rotations(poses: DataFrame, turns_deg: tuple[float, ...] = (-90.0, 90.0, 180.0)) -> DataFrame:
    """Where a target lies after turning on the spot: poses (id, target, right, front), clockwise turns."""
    rows = poses.select("*", F.explode(F.array(*map(F.lit, turns_deg))).alias("turn_deg"))
    bearing = G.wrap_degrees(G.bearing_deg(F.col("right"), F.col("front")) - F.col("turn_deg"))
    options = F.array(*[F.struct(G.circular_delta(bearing, F.lit(m)).alias("off"), F.lit(i).alias("i"), F.lit(n).alias("label")) for i, (n, m) in enumerate(G.SECTORS)])
    return rows.withColumn("bearing_after", bearing).withColumn("label", F.array_min(options)["label"])


def surfaces(facts: DataFrame, texts: Column, per_fact: int = 2) -> DataFrame:
    """The first few wordings of each fact as records: (.., surface_index, surface)."""
    return facts.select("*", F.posexplode(F.slice(texts, 1, per_fact)).alias("surface_index", "surface"))


def sweep_plan(scenes: DataFrame, variants: DataFrame, labels: tuple[str, ...], seed: int) -> DataFrame:
    """A job for each scene and variant (variants: a configured few), labels rotated by variant, with running seeds."""
    few = variants.select("variant", "place")
    jobs = scenes.select("scene").join(F.broadcast(few), F.lit(True))  # a handful of variants from a configuration
    order = F.row_number().over(W.partitionBy("scene").orderBy("place")) - 1
    turned = G.rotate_list(F.array(*map(F.lit, labels)), F.col("place"))
    return jobs.withColumn("labels", turned).withColumn("seed", F.lit(seed) + F.abs(F.hash("scene")) % 100_000 * 100 + order).withColumn("job_id", F.concat_ws("-", "scene", "variant"))


def refreshed(jobs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Jobs with the status that their receipts show: passed, failed, or planned without one."""
    r = receipts.groupBy("job_id").agg(F.bool_and("ok").alias("ok"))
    return jobs.join(r, "job_id", "left").withColumn("status", F.when(F.col("ok").isNull(), "planned").when(F.col("ok"), "passed").otherwise("failed")).drop("ok")


def replayed_responses(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded responses of requests by their hash; nothing is called. Missing ones and conflicts are marked."""
    r = recorded.groupBy("request_hash").agg(F.min("response").alias("response"), F.count_distinct("response").alias("k"))
    status = F.when(F.col("k").isNull(), "missing").when(F.col("k") > 1, "conflict").otherwise("replayed")
    return requests.join(r, "request_hash", "left").withColumn("status", status).drop("k")


def composed(t1: DataFrame, t10: DataFrame) -> DataFrame:
    """Memory and prediction of one scene joined on the objects they share, of each scene the pair with the most."""
    both = t1.select("scene", F.col("bundle").alias("source"), "entity").join(t10.select("scene", F.col("bundle").alias("target"), "entity"), ["scene", "entity"])
    n = both.groupBy("scene", "source", "target").agg(F.count_distinct("entity").alias("n_shared"))
    return n.groupBy("scene").agg(F.max(F.struct("n_shared", "source", "target")).alias("b")).select("scene", "b.*")


def grouped(questions: DataFrame, keys: list[str], priority: Column, most: int = 6) -> DataFrame:
    """Questions of one group by priority, the first `most` of them: (.., place)."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(priority, "fact_id"))
    return questions.withColumn("place", nth).where(F.col("place") <= most)


#: Tasks whose question reads the same with more views around it (fixed values).
LIFTED_TASKS = (
    "metric_distance", "egocentric_relation", "cross_view_relation", "counterfactual_verification", "last_seen_memory",
    "orbit_identity", "rotation_change_detection", "elevation_relation_transfer", "object_centric_perspective", "target_view_prediction",
)
REPEATED_VARIANTS = ("claim_true", "frame_b")


def context_lift(questions: DataFrame, excluded: DataFrame, held_out: tuple[str, ...] = (), tasks: tuple[str, ...] = LIFTED_TASKS, evaluation: bool = False) -> DataFrame:
    """Questions that an episode's batch may ask of all its views: (episode, fact_id, place), place from 0.

    questions: (episode, fact_id, task_type, program_id, variant, group,
    models, all_views, score), group empty or null for none, score an
    orderable column, smaller first, ties by fact_id; excluded: (fact_id). Out go
    excluded facts, programs held out for evaluation, tasks that do not lift (an
    unknown_abstention does if it reads all views in order and is canonical)
    and variants that repeat another; then, in order, a task or group that the batch has already.

    What is taken depends on what came before, but a batch takes a task once,
    so a task's first row without a group and its first rows of as many groups
    as there are tasks decide; the fold runs over these alone.
    """
    whole = (F.col("task_type") == "unknown_abstention") & F.col("models").eqNullSafe(F.col("all_views")) & (F.col("variant") == "canonical")
    rows = questions.where(F.col("task_type").isin(*tasks) | F.coalesce(whole, F.lit(False)))
    rows = rows.where(~F.coalesce(F.col("variant").isin(*REPEATED_VARIANTS), F.lit(False)))
    if not evaluation and held_out:
        rows = rows.where(~F.coalesce(F.col("program_id").isin(*held_out), F.lit(False)))
    rows = rows.join(excluded.select("fact_id").distinct(), "fact_id", "left_anti").withColumn("group", F.coalesce("group", F.lit("")))
    row = F.struct("score", "fact_id", F.col("task_type").alias("task"), "group")
    first = rows.groupBy("episode", "task_type", "group").agg(F.min(row).alias("q"))
    nth = F.row_number().over(W.partitionBy("episode", "task_type").orderBy("q"))
    few = first.withColumn("nth", nth).where(F.col("nth") <= len(tasks) + 2).groupBy("episode").agg(F.array_sort(F.collect_list("q")).alias("qs"))
    kind = few.schema["qs"].dataType.simpleString()

    def take(taken: Column, q: Column) -> Column:
        had = F.exists(taken, lambda t: (t["task"] == q["task"]) | ((q["group"] != "") & (t["group"] == q["group"])))
        return F.when(had, taken).otherwise(F.array_append(taken, q))

    out = few.select("episode", F.posexplode(F.aggregate("qs", F.array().cast(kind), take)).alias("place", "q"))
    return out.select("episode", "q.fact_id", "place")


def rationale(task: Column, steps: Column, answer: Column) -> Column:
    """Why an answer holds, from the views (steps from 0) that show it: one sentence by task, and the answer; other tasks have the answer alone."""
    name = lambda s: F.concat(F.lit("view "), (s + 1).cast("string"))
    span = F.concat(name(steps[0]), F.lit(" to "), name(F.element_at(steps, -1)))
    seen = F.when(F.size(steps) > 3, span).otherwise(F.array_join(F.transform(steps, name), ", "))
    told = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit("; "), answer)
    return (
        F.when(task == "cross_view_relation", told("The two objects are shown by ", seen, ", and no view shows both; both are placed on one plane and compared"))
        .when(task == "counterfactual_verification", told("The relation is rebuilt from ", seen, " and compared with the claim"))
        .when(task == "object_centric_perspective", told("Standpoint, facing and target are bound by ", seen, " and seen from there"))
        .when(task == "last_seen_memory", told("The object is followed through the views in order, and those after its last are checked"))
        .when(task == "metric_distance", told("Both objects are bound in ", seen, " and their centres compared"))
        .when(task == "unknown_abstention", told("Only the views given are checked; what they do not show may still be there"))
        .otherwise(answer)
    )
