"""Replay of every kind of question: targets and admission are computed anew from objects, poses and masks.

A question is a row (question, episode, task_type, entities, evidence, models,
claimed, target_episode, target_view): entities in the order of their roles,
evidence and models as arrays of views (models null or empty: every view of
the episode). The sheets and entities of an episode meet its questions as
arrays; what a question asks of its views is gathered within its row, so
nothing is shuffled for each question and view. A task type then is an
expression over what was gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.plans.durable import parts

#: Labels behind which anything may stand (fixed values).
UNSAFE_LABELS = ("fixed_window", "openable_window", "window")
#: Tallest plausible box of a label, in metres (fixed values).
MOST_HEIGHT_M = (("coffee_table", 0.65),)
#: Operations with the types they take and make (fixed values).
SIGNATURES = (
    ("G", ("view",), "entity_set"), ("G", ("view", "entity"), "entity"), ("F", ("frame", "frame"), "transform"),
    ("B", ("belief", "entity_set", "transform"), "belief"), ("B", ("belief", "entity", "transform"), "belief"),
    ("M", ("entity", "entity", "frame"), "metric"), ("R", ("entity", "entity", "frame"), "relation"), ("P", ("belief", "view"), "view_prediction"),
    ("V", ("entity",), "boolean"), ("V", ("entity_set",), "boolean"), ("V", ("belief",), "boolean"),
    ("V", ("metric",), "boolean"), ("V", ("relation",), "boolean"), ("V", ("view_prediction",), "boolean"),
)
#: Tasks about certain instances, and those about one instance through all views.
INSTANCE_TASKS = (
    "last_seen_memory", "metric_distance", "egocentric_relation", "cross_view_relation",
    "counterfactual_verification", "object_centric_perspective", "orbit_identity", "target_view_prediction",
)
TRACKING_TASKS = ("last_seen_memory", "orbit_identity")
CANONICAL_TASKS = ("cross_view_relation", "counterfactual_verification", "elevation_relation_transfer")
MOST_ERROR_M = 0.11
LEAST_RATIO = 1.25


def mask_checks(limits: dict[str, float | Column] | None = None) -> tuple[tuple[str, Column], ...]:
    """Checks that a mask shows its object well enough; their columns are those of a mask with its image and box.

    pixels, box_w, box_h, fill_ratio, image_w, image_h, outer_share, sides
    (array of the borders that it touches), frame_passed, label, height_m. A
    limit may be a column, so that each row brings its own.
    """
    of = {"pixels": 1000, "side": 28, "fill": 0.10, "outer_two": 0.35, "outer_one": 0.30, "axis": 0.20} | (limits or {})
    limit = {k: v if isinstance(v, Column) else F.lit(v) for k, v in of.items()}
    outer, n = F.col("outer_share"), F.size("sides")
    axis = F.least(F.col("box_w") / F.greatest("image_w", F.lit(1)), F.col("box_h") / F.greatest("image_h", F.lit(1)))
    spans = (n >= 3) & F.array_contains("sides", "top") & F.array_contains("sides", "bottom")
    cropped = spans | ((n >= 2) & (outer >= limit["outer_two"])) | ((n >= 1) & (outer >= limit["outer_one"]) & (axis < limit["axis"]))
    tallest = F.create_map(*[F.lit(x) for pair in MOST_HEIGHT_M for x in pair])[F.col("label")]
    return (
        ("too_few_pixels", F.col("pixels") >= limit["pixels"]),
        ("too_thin", F.least("box_w", "box_h") >= limit["side"]),
        ("fragmented", F.col("fill_ratio") >= limit["fill"]),
        ("severely_cropped", ~cropped),
        ("frame_inadmissible", F.col("frame_passed")),
        ("implausible_height", tallest.isNull() | (F.col("height_m") <= tallest)),
    )


def salient_checks(limits: dict[str, float | Column] | None = None) -> tuple[tuple[str, Column], ...]:
    """What a mask must pass besides mask_checks() to anchor a question about another view."""
    of = {"anchor_pixels": 2000, "anchor_side": 40, "anchor_outer": 0.80} | (limits or {})
    limit = {k: v if isinstance(v, Column) else F.lit(v) for k, v in of.items()}
    return (
        ("anchor_pixels", F.col("pixels") >= limit["anchor_pixels"]),
        ("anchor_side", F.least("box_w", "box_h") >= limit["anchor_side"]),
        ("anchor_border", F.col("outer_share") < limit["anchor_outer"]),
    )


def passes(checks: tuple[tuple[str, Column], ...]) -> Column:
    """Whether all checks hold; an unknown one does not."""
    out = F.lit(True)
    for _, holds in checks:
        out = out & F.coalesce(holds, F.lit(False))
    return out


def failed(checks: tuple[tuple[str, Column], ...]) -> Column:
    """Names of the checks that do not hold, in their order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in checks]))


def replay_masks(certificates: DataFrame, masks: DataFrame) -> DataFrame:
    """Certificates of masks checked by their own limits: (certificate, episode, view, entity, stored, passed, failures, status).

    certificates: (certificate, episode, view, entity, limits map<string,
    double>, stored boolean). A limit that a certificate does not name is the
    usual one. status: ok, differs, no_mask.
    """
    own = {k: F.coalesce(F.col("limits")[k], F.lit(float(v))) for k, v in (("pixels", 1000), ("side", 28), ("fill", 0.10), ("outer_two", 0.35), ("outer_one", 0.30), ("axis", 0.20))}
    checks = mask_checks(own)
    rows = certificates.join(masks.withColumn("found", F.lit(True)), ["episode", "view", "entity"], "left")
    rows = rows.withColumn("passed", F.when(F.col("found"), passes(checks))).withColumn("failures", F.when(F.col("found"), failed(checks)))
    status = F.when(F.col("found").isNull(), "no_mask").when(F.col("passed").eqNullSafe(F.col("stored")), "ok").otherwise("differs")
    return rows.select("certificate", "episode", "view", "entity", "stored", "passed", "failures", status.alias("status"))


def view_sheets(views: DataFrame, masks: DataFrame, pixels: int = 64, side: int = 8) -> DataFrame:
    """One row a view: episode, view, step, yaw, passed, and what it shows.

    views: (episode, view, step, yaw, passed); masks: (episode, view, entity,
    label, group, pixels, box_w, box_h, clear, salient), group being the
    label's confusable group. shown: entities and labels; groups: those with
    enough raw pixels, or a mask large enough, that their absence cannot be
    claimed. A view without a mask has empty arrays.
    """
    least = F.least("box_w", "box_h")
    strong = masks.groupBy("episode", "view", "group").agg(F.sum("pixels").alias("p"), F.max(least).alias("s")).where((F.col("p") >= pixels) | (F.col("s") >= side))
    groups = strong.groupBy("episode", "view").agg(F.sort_array(F.collect_list("group")).alias("groups"))
    of = F.struct("entity", "label", "group")
    shown = masks.groupBy("episode", "view").agg(
        F.sort_array(F.collect_set(of)).alias("shown"),
        F.sort_array(F.collect_set(F.when(F.col("clear"), of))).alias("clear"),
        F.sort_array(F.collect_set(F.when(F.col("salient"), of))).alias("salient"),
    )
    out = views.join(shown, ["episode", "view"], "left").join(groups, ["episode", "view"], "left")
    kind = "array<struct<entity:{0},label:string,group:string>>".format(masks.schema["entity"].dataType.simpleString())
    empty = [F.coalesce(c, F.array().cast(kind)).alias(c) for c in ("shown", "clear", "salient")]
    return out.select("episode", "view", "step", "yaw", F.coalesce("passed", F.lit(False)).alias("passed"), *empty, F.coalesce("groups", F.array().cast("array<string>")).alias("groups"))


def _shows(sheet: Column, entity: Column) -> Column:
    return F.exists(sheet, lambda m: m["entity"] == entity)


def _alike(sheet: Column, group: Column) -> Column:
    return F.transform(F.filter(sheet, lambda m: m["group"] == group), lambda m: m["entity"])


def gathered(questions: DataFrame, entities: DataFrame, sheets: DataFrame) -> DataFrame:
    """Questions with what their views show of their entities, one row each.

    entities: (episode, entity, label, group, x, y, z). Adds e0, e1, e2
    (structs, null where there is no such entity), missing (how many entities
    are unknown), and the facts that recompute() and admission() name.
    """
    every = sheets.groupBy("episode").agg(F.sort_array(F.collect_list(F.struct("step", "view", "yaw", "passed", "shown", "clear", "salient", "groups"))).alias("all_views"))
    things = entities.groupBy("episode").agg(F.collect_list(F.struct("entity", "label", "group", "x", "y", "z")).alias("things"))
    return gathered_within(questions.join(every, "episode", "left").join(things, "episode", "left")).drop("all_views", "things")


def gathered_within(rows: DataFrame) -> DataFrame:
    """gathered() of questions that hold the sheets and entities of their episode already.

    all_views: array<struct(step, view, yaw, passed, shown, clear, salient, groups)> in order of steps; things:
    array<struct(entity, label, group, x, y, z)>.
    """
    known = F.filter("things", lambda t: t["label"].isNotNull())
    rows = rows.withColumn("known", F.coalesce(known, F.array().cast(rows.schema["things"].dataType)))
    slot = lambda k: F.array_max(F.filter("known", lambda t: t["entity"] == F.get("entities", F.lit(k))))
    slots = {f"e{k}": slot(k) for k in range(3)}
    missing = F.size(F.filter("entities", lambda e: ~F.coalesce(F.exists("known", lambda t: t["entity"] == e), F.lit(False))))
    first = F.get(F.filter("all_views", lambda v: v["step"].isNotNull()), F.lit(0))["yaw"]
    models = F.when(F.coalesce(F.size("models"), F.lit(0)) > 0, F.col("models")).otherwise(F.transform("all_views", lambda v: v["view"]))
    base = rows.withColumns(slots | {"missing": missing, "first_yaw": first, "models": models}).drop("known")

    tracked = F.col("task_type").isin(*TRACKING_TASKS)
    salient = F.col("task_type") == "target_view_prediction"
    no = F.lit(False)
    sheet = lambda v: F.get(F.filter("all_views", lambda s: s["view"] == v), F.lit(0))
    looks = F.transform(F.array_union("evidence", "models"), lambda v: F.struct(
        (F.array_position("evidence", v) - 1).alias("at"), F.array_contains("models", v).alias("in_models"), sheet(v).alias("s"),
    ))

    def told(v: Column) -> Column:
        s, in_evidence = v["s"], v["at"] >= 0
        out = [
            v["at"].alias("at"), s["step"].alias("step"), s["yaw"].alias("yaw"), F.coalesce(s["passed"], no).alias("passed"), in_evidence.alias("in_evidence"), v["in_models"].alias("in_models"),
            F.when(F.col("task_type") == "last_seen_memory", v["in_models"]).otherwise(in_evidence).alias("binding"), s["clear"].alias("clear"), s["groups"].alias("groups"),
            F.coalesce(F.exists(s["shown"], lambda m: m["label"] == F.col("e0.label")), no).alias("labelled"),
        ]
        for k in range(3):
            e = F.col(f"e{k}")
            shown = F.coalesce(_shows(s["shown"], e["entity"]), no)
            usable = _alike(F.when(salient, s["salient"]).otherwise(s["clear"]), e["group"])
            # a view that binds an entity has it alone among what could be taken for it
            alone = (F.size(usable) == 1) & (F.get(usable, F.lit(0)) == e["entity"])
            out += [shown.alias(f"shown_{k}"), F.coalesce(_shows(s["clear"], e["entity"]), no).alias(f"clear_{k}")]
            out += [F.coalesce(e["label"].isin(*UNSAFE_LABELS) | F.array_contains(s["groups"], e["group"]), no).alias(f"confusing_{k}")]
            out += [F.when(shown, alone).otherwise(~tracked | (F.size(usable) == 0)).alias(f"alone_{k}")]
        return F.struct(*out)

    rows = base.withColumn("looks", looks).withColumn("looks", F.transform("looks", told))
    any_of = lambda when, *c: F.coalesce(F.exists("looks", lambda v: reduce(Column.__and__, [v[when], *[v[x] for x in c]])), no)
    all_of = lambda when, *c: F.forall("looks", lambda v: F.coalesce(F.when(v[when], reduce(Column.__and__, [v[x] for x in c])), F.lit(True)))
    at = lambda k: F.get(F.filter("looks", lambda v: v["at"] == k), F.lit(0))
    facts = {
        "unknown_views": F.size(F.filter("looks", lambda v: v["step"].isNull())),
        "frames_passed": all_of("in_models", "passed"),
        "last_step": F.array_max(F.transform(F.filter("looks", lambda v: v["in_models"] & v["shown_0"]), lambda v: v["step"])),
        "label_in_evidence": any_of("in_evidence", "labelled"),
        "label_in_models": any_of("in_models", "labelled"),
        "confusing_evidence": any_of("in_evidence", "confusing_0"),
        "clear_in_evidence": any_of("in_evidence", "shown_0", "clear_0"),
        "clear_in_models": any_of("in_models", "shown_0", "clear_0"),
        "shown_everywhere": all_of("in_evidence", "shown_0"),
        "clear_everywhere": all_of("in_evidence", "shown_0", "clear_0"),
        **{f"seen_{k}": any_of("in_models", f"shown_{k}") for k in range(2)},
        **{f"confusing_{k}": any_of("in_models", f"confusing_{k}") for k in range(2)},
        **{f"clear_at_{k}": at(k)["clear"] for k in range(2)},
        "groups_at_0": at(0)["groups"],
        "yaw": at(0)["yaw"],
        **{f"bound_{k}": F.col(f"e{k}").isNull() | (any_of("binding", f"shown_{k}") & all_of("binding", f"alone_{k}")) for k in range(3)},
        **{f"all_clear_{k}": F.col(f"e{k}").isNull() | all_of("in_evidence", f"clear_{k}") for k in range(3)},
    }
    # without a view nothing is told
    return rows.withColumns({name: F.when(F.size("looks") > 0, fact) for name, fact in facts.items()}).drop("looks")


def entrants(question_facts: tuple[str, str] = ("clear_at_0", "clear_at_1")) -> Column:
    """What the second view shows clearly and the first does not."""
    before, after = (F.col(c) for c in question_facts)
    return F.filter(after, lambda m: ~F.exists(before, lambda b: b["entity"] == m["entity"]))


def _planar(yaw: Column) -> tuple[Column, Column]:
    """(right, front) of the first entity from the second, in a frame with this yaw."""
    return G.camera_components(F.col("e0.x"), F.col("e0.y"), F.col("e1.x"), F.col("e1.y"), yaw)


def tenths_apart(a: Column, b: Column) -> Column:
    """Distance of two placed structs with one decimal: tenths are rounded after the product, as SQL engines do (7.6499999999999995 gives 7.7)."""
    return F.round(10 * F.sqrt(sum((a[k] - b[k]) ** 2 for k in "xyz")), 0) / 10


def _relation(yaw: Column) -> Column:
    right, front = _planar(yaw)
    return G.dominant_relation(right, front)["relation"]


def recompute(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Facts (see gathered) with actual, struct(value, number, error): what the question's answer must be.

    targets: sheets of held-out views. value is text: true or false, a step
    from 1, a relation or quadrant, a label, unknown, present:label, or
    true:relation and false:relation of a claim; number is a distance with
    one decimal; error says why there is no answer.
    """
    held = targets.select(F.col("episode").alias("target_episode"), F.col("view").alias("target_view"), F.transform("shown", lambda m: m["entity"]).alias("target_shown"))
    return answered(facts.join(held, ["target_episode", "target_view"], "left")).drop("target_shown")


def answered(rows: DataFrame) -> DataFrame:
    """recompute() of facts that hold the entities that their target view shows (target_shown)."""
    e0, e1, e2 = (F.col(f"e{k}") for k in range(3))
    value = lambda c: F.struct(c.cast("string").alias("value"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("error"))
    wrong = lambda why: F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("number"), (why if isinstance(why, Column) else F.lit(why)).alias("error"))
    number = lambda c: F.struct(F.lit(None).cast("string").alias("value"), c.alias("number"), F.lit(None).cast("string").alias("error"))
    task = lambda *names: F.col("task_type").isin(*names)
    apart = tenths_apart(e0, e1)
    canonical = _relation(F.col("first_yaw"))
    right, front = G.object_components(e0["x"], e0["y"], e1["x"], e1["y"], e2["x"], e2["y"])
    seen_once = F.col("seen_0") != F.col("seen_1")
    lost = F.when(F.col("seen_0"), F.col("confusing_1")).otherwise(F.col("confusing_0"))
    entered = entrants()
    confused = entered[0]["label"].isin(*UNSAFE_LABELS) | F.array_contains("groups_at_0", entered[0]["group"])
    actual = (
        F.when(F.col("missing") > 0, wrong("no such entity"))
        .when(F.col("unknown_views") > 0, wrong("no such view"))
        .when(task("grounding_presence"), value(F.col("label_in_evidence")))
        .when(task("last_seen_memory"), F.when(F.col("last_step").isNull(), wrong("never shown")).otherwise(value(F.col("last_step") + 1)))
        .when(task("metric_distance"), number(apart))
        .when(task("egocentric_relation"), F.when(F.col("yaw").isNull(), wrong("no evidence view")).otherwise(value(_relation(F.col("yaw")))))
        .when(task("cross_view_relation", "elevation_relation_transfer"), value(canonical))
        .when(task("cross_view_unknown"), F.when(~seen_once, wrong("not exactly one is shown")).when(lost, wrong("a confusable category is shown")).otherwise(value(F.lit("unknown"))))
        .when(task("evidence_presence_unknown", "occlusion_unknown", "unknown_abstention"), F.when(F.col("confusing_0"), wrong("a confusable category is shown")).otherwise(value(F.lit("unknown"))))
        .when(task("evidence_presence_reveal", "occlusion_reveal"), F.when(F.col("label_in_models"), value(F.concat(F.lit("present:"), e0["label"]))).otherwise(wrong("the revealed category is absent")))
        .when(task("counterfactual_verification"), value(F.concat((F.col("claimed") == canonical).cast("string"), F.lit(":"), canonical)))
        .when(task("object_centric_perspective"), F.when(right.isNull(), wrong("origin and facing coincide")).otherwise(value(F.concat(F.when(front >= 0, "front_").otherwise("back_"), F.when(right >= 0, "right").otherwise("left")))))
        .when(
            task("rotation_change_detection"),
            F.when(F.coalesce(F.size(entered), F.lit(0)) != 1, wrong(F.concat(F.lit("entrants: "), F.coalesce(F.size(entered), F.lit(0)).cast("string"))))
            .when(confused, wrong("the entrant could be taken for what was there")).otherwise(value(entered[0]["label"])),
        )
        .when(task("orbit_identity"), value(F.col("shown_everywhere")))
        .when(task("target_view_prediction"), F.when(F.col("target_shown").isNull(), wrong("no such target view")).otherwise(value(F.array_contains("target_shown", F.coalesce(e2["entity"], e0["entity"])))))
        .otherwise(wrong("unsupported task"))
    )
    return rows.withColumn("actual", actual)


def admission() -> Column:
    """The first ground against a question's evidence, of gathered() facts; null if it is admitted."""
    task = lambda *names: F.col("task_type").isin(*names)
    e0 = F.col("e0")
    entered = entrants()
    singleton = (F.size(entered) == 1) & (entered[0]["entity"] == e0["entity"])
    right, front = _planar(F.when(task("egocentric_relation"), F.col("yaw")).otherwise(F.col("first_yaw")))
    aside = G.object_components(e0["x"], e0["y"], F.col("e1.x"), F.col("e1.y"), F.col("e2.x"), F.col("e2.y"))
    unclear = lambda a, b: ~F.coalesce(G.is_dominant(a, b, LEAST_RATIO), F.lit(True))
    compared = F.col("all_clear_0") & F.col("all_clear_1") & F.col("all_clear_2")
    return (
        F.when(~F.col("frames_passed"), "inadmissible_frame")
        .when(task(*INSTANCE_TASKS) & ~(F.col("bound_0") & F.col("bound_1") & F.col("bound_2")), "no_unique_witness")
        .when(task("grounding_presence") & (F.col("stored") == "true") & ~F.col("clear_in_evidence"), "positive_without_witness")
        .when(task("evidence_presence_reveal", "occlusion_reveal") & ~F.col("clear_in_models"), "revealed_not_recognisable")
        .when(task("rotation_change_detection") & ~F.coalesce(singleton, F.lit(False)), "entrant_not_the_claimed_one")
        .when(task("orbit_identity", "elevation_relation_transfer") & ~compared, "not_clear_in_every_view")
        .when(task("last_seen_memory") & ~F.col("clear_everywhere"), "unclear_track")
        .when(task("grounding_presence") & (F.col("stored") == "false") & F.col("confusing_evidence"), "negative_with_confusable")
        .when(task("egocentric_relation", *CANONICAL_TASKS) & unclear(right, front), "direction_unclear")
        .when(task("object_centric_perspective") & unclear(*aside), "direction_unclear")
    )


def replay(questions: DataFrame, entities: DataFrame, sheets: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Rows (question, task_type, stored, stored_number, value, number, refusal, status) of questions with stored answers.

    status: ok, differs, refused (the evidence is not admitted; refusal says
    why) or error (value is then null and refusal the error). Numbers may
    differ by MOST_ERROR_M. Questions with the same id are taken for one
    another's evidence: ids have to be unique.
    """
    return judged(recompute(gathered(questions, entities, sheets), sheets if targets is None else targets))


def judged(rows: DataFrame) -> DataFrame:
    """replay() of recomputed facts."""
    rows = rows.withColumn("refused", admission())
    a = F.col("actual")
    near = F.coalesce(F.abs(F.col("stored_number") - a["number"]) <= MOST_ERROR_M, F.lit(False))
    same = F.when(F.col("task_type") == "metric_distance", near).otherwise(F.col("stored").eqNullSafe(a["value"]))
    status = F.when(F.col("refused").isNotNull(), "refused").when(a["error"].isNotNull(), "error").when(same, "ok").otherwise("differs")
    why = F.coalesce("refused", a["error"])
    return rows.select("question", "task_type", "stored", "stored_number", a["value"].alias("value"), a["number"].alias("number"), why.alias("refusal"), status.alias("status"))


def graph_faults(nodes: DataFrame, externals: DataFrame, answers: DataFrame) -> DataFrame:
    """Faults of operation graphs, in whatever order their nodes come: (graph, node, fault).

    nodes: (graph, node, operation, inputs array<string>, output_type);
    externals: (graph, name, type); answers: (graph, answer). Faults: made
    twice, missing input, in a cycle, wrong signature, no such answer, answer
    is no boolean V. What needs a node of a cycle is named too. Of a node that
    is made twice every form has to hold.

    All rows of a graph meet once, by one shuffle; a task holds one graph and a
    batch of rows at a time. Cycles are found by taking away the nodes all of
    whose inputs are there, which looks at every input once.
    """
    blank = lambda kind: F.lit(None).cast(kind)
    rows = nodes.select("graph", F.lit(0).alias("kind"), F.col("node").alias("name"), "operation", "inputs", F.col("output_type").alias("type"))
    rows = rows.unionByName(externals.select("graph", F.lit(1).alias("kind"), "name", blank("string").alias("operation"), blank("array<string>").alias("inputs"), "type"))
    rows = rows.unionByName(answers.select("graph", F.lit(2).alias("kind"), F.col("answer").alias("name"), *[blank(k).alias(c) for c, k in (("operation", "string"), ("inputs", "array<string>"), ("type", "string"))]))
    dealt = rows.repartition(parts(rows), "graph").sortWithinPartitions("graph")
    return dealt.mapInArrow(_faulty_graphs, f"graph {rows.schema['graph'].dataType.simpleString()}, node string, fault string")


def _faulty_graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """faults_of() of rows that are sorted by graph; the last graph of a batch may go on in the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        graph = batch.column("graph").dictionary_encode(null_encoding="encode").indices.to_numpy()
        start = int((graph == graph[-1]).argmax())
        if start:
            yield faults_of(pa.concat_batches([*held, batch.slice(0, start)]))
            held = []
        held.append(batch.slice(start))
    if held:
        yield faults_of(pa.concat_batches(held))


def _encoded(values: pa.Array) -> tuple[np.ndarray, list[str | None]]:
    """Codes in the order of the strings, null last, and the strings."""
    held = values.dictionary_encode(null_encoding="encode")
    words = held.dictionary.to_pylist()
    order = sorted(range(len(words)), key=lambda i: (words[i] is None, words[i] or ""))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    return rank[held.indices.to_numpy()], [words[i] for i in order]


def faults_of(rows: pa.RecordBatch) -> pa.RecordBatch:
    """graph_faults() of whole graphs: rows (graph, kind, name, operation, inputs, type), kind 0 a node, 1 an external, 2 an answer."""
    n, inputs = len(rows), rows.column("inputs")
    graph = rows.column("graph").dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
    kind = rows.column("kind").to_numpy()
    node, given, asked = (np.flatnonzero(kind == k) for k in range(3))
    sizes = pc.fill_null(pc.list_value_length(inputs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    by = np.repeat(np.arange(n), sizes)
    slot = np.arange(len(by)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # a name and its graph as one number; a null of either is equal to none
    names = pa.concat_arrays([rows.column("name"), inputs.flatten()])
    name = names.dictionary_encode(null_encoding="encode")
    known = names.is_valid().to_numpy(zero_copy_only=False) & rows.column("graph").is_valid().to_numpy(zero_copy_only=False)[np.concatenate([np.arange(n), by])]
    key = graph[np.concatenate([np.arange(n), by])] * len(name.dictionary) + name.indices.to_numpy()
    keys, of = np.unique(key[:n], return_inverse=True)
    first, real = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    first[of], real[of] = np.arange(n), known[:n]
    count = lambda at, weights=None: np.bincount(of[at], weights, len(keys))
    n_made = count(node)

    kinds, types = _encoded(rows.column("type"))
    none = len(types)
    kinds[~rows.column("type").is_valid().to_numpy(zero_copy_only=False)] = none
    least = np.full(len(keys), none)
    np.minimum.at(least, of[kind < 2], kinds[kind < 2])
    place = np.minimum(np.searchsorted(keys, key[n:]), len(keys) - 1)
    found = (keys[place] == key[n:]) & known[n:]
    takes = np.where(found, least[place], none)

    ops, operations = _encoded(rows.column("operation"))
    form, at = np.unique((of[by] * len(operations) + ops[by]) * (none + 1) + kinds[by], return_inverse=True)
    rank = np.lexsort((takes, slot, at))
    long = np.bincount(at, minlength=len(form))
    begin, fits = np.cumsum(long) - long, np.zeros(len(form), bool)
    form_of, op, out = form // (none + 1) // len(operations), form // (none + 1) % len(operations), form % (none + 1)
    for name_of, wanted, made in SIGNATURES:
        if name_of not in operations or not {*wanted, made} <= set(types):
            continue
        same = np.flatnonzero((op == operations.index(name_of)) & (out == types.index(made)) & (long == len(wanted)))
        for k, t in enumerate(wanted):
            same = same[takes[rank[begin[same] + k]] == types.index(t)]
        fits[same] = True
    whole = np.bincount(at, takes == none, len(form)) == 0
    empty = np.flatnonzero((kind == 0) & (sizes == 0) & inputs.is_valid().to_numpy(zero_copy_only=False))

    v = np.array([o == "V" for o in operations], bool)[ops] & np.array([t == "boolean" for t in types] + [False], bool)[kinds]
    unsure = ~v & ~((np.array([o not in (None, "V") for o in operations], bool)[ops]) | np.array([t not in (None, "boolean") for t in types] + [False], bool)[kinds])
    judged = count(node[~unsure[node]]) * real
    bad = count(node[~unsure[node] & ~v[node]]) > 0
    ends = of[asked]
    inner = found & (n_made[place] > 0)
    told = (
        ("made twice", np.flatnonzero((n_made > 1) | (n_made > 0) & (count(given) > 0) & real)), ("missing input", np.unique(of[by[takes == none]])), ("in a cycle", unresolved(of[by[inner]], place[inner], len(keys))),
        ("wrong signature", np.unique(np.concatenate([form_of[whole & ~fits], of[empty]]))), ("no such answer", ends[judged[ends] == 0]), ("answer is no boolean V", ends[(judged[ends] > 0) & bad[ends]]),
    )
    at = pa.array(first[np.concatenate([k for _, k in told])])
    fault = pa.array([f for f, _ in told]).take(pa.array(np.repeat(np.arange(len(told)), [len(k) for _, k in told])))
    return pa.RecordBatch.from_arrays([rows.column("graph").take(at), rows.column("name").take(at), fault], names=["graph", "node", "fault"])


def unresolved(user: np.ndarray, used: np.ndarray, n: int) -> np.ndarray:
    """Of n nodes those on a cycle of the inputs (user needs used), or behind one."""
    waits = np.bincount(user, minlength=n)
    user, many = user[np.argsort(used, kind="stable")], np.bincount(used, minlength=n)
    begin, ready = np.cumsum(many) - many, np.flatnonzero(waits == 0)
    while len(ready):
        ready = ready[many[ready] > 0]
        long = many[ready]
        freed, times = np.unique(user[np.repeat(begin[ready] - (np.cumsum(long) - long), long) + np.arange(long.sum())], return_counts=True)
        waits[freed] -= times
        ready = freed[waits[freed] == 0]
    return np.flatnonzero(waits)
