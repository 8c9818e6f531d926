"""Pairs of renders that differ in one object: certificates, and the check of a release of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import geometry as G

LEAST_MARGIN_M = 0.4
MOST_DRIFT_M = 0.02
MOST_CENTER_DRIFT_M = 0.08
KINDS = ("single_object_relation_flip", "single_object_model_swap")
#: Files that an accepted or candidate pair must list (fixed values).
REQUIRED = (
    "render_report.json", "trajectory_plan.json", "scene_snapshot.json", "scene_ir.json", "spatial_episode.json",
    "quality_report.json", "reasoning_tasks.json", "reasoning_audit.json", "intervention_execution.json", "minimal_pair.json",
)


def _list(*named: tuple[str, Column]) -> Column:
    """Names whose condition is not known to hold, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in named]))


def certify_pairs(proposals: DataFrame, episodes: DataFrame, entities: DataFrame, seen: DataFrame) -> DataFrame:
    """One certificate a proposal: (proposal, pair_id, status, failed, signal, relation_before, relation_after, margin_before, margin_after, movement_m, drift_m).

    proposals: (proposal, kind, base, variant, target, anchor, planned_before,
    planned_after, yaw, source_model, new_model, category, executed), base and
    variant naming episodes; yaw null: the relation is along the world's axes.
    episodes: (episode, scene, family, trajectory_sha256); entities: (episode,
    entity, x, y, z, model, category); seen: (episode, entity).

    The two sides' objects are compared outer to outer, so an object that only
    one side has is found, and a moved one that is not the target. failed names
    every check that does not hold, in a set order; status is certified
    without any. pair_id digests family, proposal and both episodes; a failed
    pair has none.
    """
    side = lambda p: proposals.select("proposal", "target", F.col(p).alias("episode")).join(entities, "episode").select("proposal", "target", "entity", *[F.col(c).alias(f"{p}_{c}") for c in ("x", "y", "z", "model", "category")], F.lit(True).alias(f"in_{p}"))
    both = side("base").join(side("variant"), ["proposal", "target", "entity"], "full").join(proposals.select("proposal", "anchor"), "proposal")
    moved = F.sqrt(sum((F.col(f"base_{k}") - F.col(f"variant_{k}")) ** 2 for k in "xyz"))
    whole = F.struct(*[F.col(f"{p}_{c}").alias(f"{p}_{c}") for p in ("base", "variant") for c in ("x", "y", "z", "model", "category")])
    facts = both.groupBy("proposal").agg(
        F.count_if(F.col("in_base").isNull() | F.col("in_variant").isNull()).alias("unmatched"),
        F.max(F.when(F.col("entity") != F.col("target"), moved)).alias("drift"),
        F.max(F.when(F.col("entity") == F.col("target"), moved)).alias("movement"),
        F.max(F.when(F.col("entity") == F.col("target"), whole)).alias("t"),
        F.max(F.when(F.col("entity") == F.col("anchor"), whole)).alias("a"),
    )
    wanted = proposals.select("proposal", F.explode(F.array(*[F.struct(F.col(p).alias("episode"), F.col(w).alias("entity")) for p in ("base", "variant") for w in ("target", "anchor")])).alias("w"))
    shown = wanted.select("proposal", "w.*").distinct().join(seen.select("episode", "entity").distinct().withColumn("here", F.lit(True)), ["episode", "entity"], "left")
    evidence = shown.groupBy("proposal").agg(F.bool_and(F.coalesce("here", F.lit(False))).alias("evidence"))
    of = lambda p: episodes.select(F.col("episode").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("scene", "family", "trajectory_sha256")])
    rows = proposals.join(facts, "proposal", "left").join(evidence, "proposal", "left").join(of("base"), "base", "left").join(of("variant"), "variant", "left")

    def relation(p: str) -> Column:
        yaw = F.coalesce(F.col("yaw"), F.lit(0.0))
        right, front = G.camera_components(*[F.col(f"{w}.{p}_{k}") for w in "ta" for k in "xy"], yaw)
        across, along = F.abs(right), F.abs(front)
        label = G.dominant_relation(right, front)["relation"]
        return F.when(right.isNotNull() & front.isNotNull(), F.struct(label.alias("relation"), F.abs(across - along).alias("margin")))

    rows = rows.withColumn("before", relation("base")).withColumn("after", relation("variant"))
    swap = F.col("kind") == KINDS[1]
    changed = F.col("before.relation") != F.col("after.relation")
    models = (F.col("t.base_model"), F.col("t.variant_model"))
    failed = _list(
        ("executed", F.col("executed")),
        ("known_kind", F.col("kind").isin(*KINDS)),
        ("same_entities", F.col("unmatched") == 0),
        ("target_and_anchor_present", F.col("t").isNotNull() & F.col("a").isNotNull()),
        ("same_scene_identity", F.col("base_scene") == F.col("variant_scene")),
        ("same_episode_family", F.col("base_family") == F.col("variant_family")),
        ("same_camera_trajectory", F.col("base_trajectory_sha256") == F.col("variant_trajectory_sha256")),
        ("single_mutable_entity", F.coalesce("drift", F.lit(0.0)) <= MOST_DRIFT_M),
        ("evidence_available_both_sides", F.col("evidence")),
        ("relation_before_matches_plan", F.col("before.relation") == F.col("planned_before")),
        ("relation_after_matches_plan", F.col("after.relation") == F.col("planned_after")),
        ("axis_margin_before_m", F.col("before.margin") >= LEAST_MARGIN_M),
        ("axis_margin_after_m", F.col("after.margin") >= LEAST_MARGIN_M),
        ("answers_flip", swap | changed),
        ("source_model_matches_plan", ~swap | (models[0] == F.col("source_model"))),
        ("replacement_model_matches_plan", ~swap | (models[1] == F.col("new_model"))),
        ("asset_model_changed", ~swap | (models[0] != models[1])),
        ("semantic_category_invariant", ~swap | ((F.col("t.base_category") == F.col("category")) & (F.col("t.variant_category") == F.col("category")))),
        ("target_center_invariance_m", ~swap | (F.col("movement") <= MOST_CENTER_DRIFT_M)),
        ("answers_invariant", ~swap | ~changed),
    )
    text = lambda c: F.col(c).cast("string")
    key = F.to_json(F.struct(text("base").alias("base_episode_id"), text("base_family").alias("family_id"), text("proposal").alias("proposal_id"), text("variant").alias("variant_episode_id")))
    rows = rows.withColumn("failed", failed)
    sound = F.size("failed") == 0
    return rows.select(
        "proposal", F.when(sound, F.concat(F.lit("pair-"), F.substring(F.sha2(key, 256), 1, 20))).alias("pair_id"), F.when(sound, "certified").otherwise("failed").alias("status"), "failed",
        F.when(swap, "answer_invariance").otherwise("answer_flip").alias("signal"), F.col("before.relation").alias("relation_before"), F.col("after.relation").alias("relation_after"),
        F.col("before.margin").alias("margin_before"), F.col("after.margin").alias("margin_after"), F.col("movement").alias("movement_m"), F.coalesce("drift", F.lit(0.0)).alias("drift_m"),
    )


def pair_release_faults(records: DataFrame, listed: DataFrame, files: DataFrame, certificates: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(job, passed, errors) of each record of a pair release, against the files that are there.

    records: (job, base_path, variant_path, tier, decision, pair_id,
    episode_split_group, split_group, scene_model), paths relative to their
    roots; listed: (job, name, path, byte_size, sha256), the artifacts that a
    record declares; files: (variant_path, name, byte_size, sha256), what is
    there; certificates: (variant_path, pair_id, split_group). A path that
    leaves its root or names another file, a missing, changed or shortened
    file, a required one that is not listed, an accepted pair without an
    accept, a certificate of another pair or group, and a repeated job are
    errors.
    """
    escapes = lambda c: F.col(c).startswith("/") | F.array_contains(F.split(c, "/"), "..")
    have = listed.groupBy("job").agg(F.collect_set("name").alias("names"))
    on = listed.join(records.select("job", "variant_path").distinct(), "job").join(files.select("variant_path", "name", F.col("byte_size").alias("size_now"), F.col("sha256").alias("sha_now")), ["variant_path", "name"], "left")
    unsafe = F.col("path") != F.col("name")
    fault = F.when(unsafe | F.contains("name", F.lit("/")), "unsafe-artifact-path:").when(F.col("sha_now").isNull(), "missing:").when(F.col("size_now") != F.col("byte_size"), "size:").when(F.col("sha_now") != F.col("sha256"), "sha256:")
    bad = on.withColumn("fault", fault).where("fault is not null").groupBy("job").agg(F.sort_array(F.collect_set(F.concat("fault", "name"))).alias("artifacts"))
    twice = records.groupBy("job").agg((F.count("*") > 1).alias("twice"))
    held = certificates.select("variant_path", F.col("pair_id").alias("c_pair"), F.col("split_group").alias("c_group"), F.lit(True).alias("certified"))
    rows = records.join(have, "job", "left").join(bad, "job", "left").join(twice, "job").join(held, "variant_path", "left")
    needs = F.col("tier").isin("accepted", "candidate")
    none = F.array().cast("array<string>")
    missing = F.when(needs, F.transform(F.array_except(F.array(*map(F.lit, sorted(required))), F.coalesce("names", none)), lambda n: F.concat(F.lit("required:"), n))).otherwise(none)
    known = F.coalesce("certified", F.lit(False))
    own = _list(
        ("base path escapes its root", ~escapes("base_path")),
        ("variant path escapes its root", ~escapes("variant_path")),
        ("accepted without an accept", (F.col("tier") != "accepted") | (F.coalesce("decision", F.lit("")) == "accept")),
        ("certificate of another pair", ~known | F.col("c_pair").eqNullSafe(F.col("pair_id"))),
        ("certificate of another split group", ~known | F.col("c_group").eqNullSafe(F.col("episode_split_group"))),
        ("split group is not the scene's", F.col("split_group") == F.concat(F.lit("scene:"), "scene_model")),
        ("repeated job", ~F.col("twice")),
    )
    errors = F.concat(own, missing, F.coalesce("artifacts", none))
    return rows.select("job", (F.size(errors) == 0).alias("passed"), errors.alias("errors"))
