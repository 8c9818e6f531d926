"""Replay, graphs, families, menus, pairs and resampling against plain Python, on edges that the tables do not hold."""

from __future__ import annotations

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import evaluation, families, menus, pairs, relations, replay
from orrery.sources import jsonl


class TestGraphs:
    def faults(self, spark, nodes, externals=(("view", "view"), ("hint", "entity"), ("frame", "frame")), answer="v"):
        table = spark.createDataFrame([("g", *n) for n in nodes], "graph string, node string, operation string, inputs array<string>, output_type string")
        given = spark.createDataFrame([("g", *e) for e in externals], "graph string, name string, type string")
        ends = spark.createDataFrame([("g", answer)], "graph string, answer string")
        return sorted((r["node"], r["fault"]) for r in replay.graph_faults(table, given, ends).collect())

    GOOD = (("a", "G", ["view", "hint"], "entity"), ("r", "R", ["a", "hint", "frame"], "relation"), ("v", "V", ["r"], "boolean"))

    def test_good_in_any_order(self, spark):
        assert self.faults(spark, self.GOOD) == [] and self.faults(spark, self.GOOD[::-1]) == []

    def test_cycles_name_what_waits_for_them(self, spark):
        nodes = (("a", "V", ["b"], "boolean"), ("b", "V", ["a"], "boolean"), ("v", "V", ["b"], "boolean"), ("z", "G", ["view", "hint"], "entity"), ("s", "V", ["s"], "boolean"))
        assert [f for f in self.faults(spark, nodes) if f[1] == "in a cycle"] == [(n, "in a cycle") for n in "absv"]

    @pytest.mark.parametrize(
        "nodes, answer, want",
        [
            ((*GOOD, GOOD[0]), "v", {("a", "made twice")}),
            ((*GOOD, ("view", "G", ["view", "hint"], "entity")), "v", {("view", "made twice")}),
            ((("v", "V", ["lost"], "boolean"),), "v", {("v", "missing input")}),
            ((GOOD[0], ("v", "V", ["a"], "metric")), "v", {("v", "wrong signature"), ("v", "answer is no boolean V")}),
            ((*GOOD, ("e", "G", [], "entity")), "v", {("e", "wrong signature")}),
            (GOOD, "none", {("none", "no such answer")}),
            (GOOD, "r", {("r", "answer is no boolean V")}),
        ],
    )
    def test_faults(self, spark, nodes, answer, want):
        assert want <= set(self.faults(spark, nodes, answer=answer))


class TestReplay:
    VIEWS = [("e", "v0", 0, 0.0, True), ("e", "v1", 1, math.pi / 2, True), ("e", "v2", 2, 0.0, True), ("bad", "w", 0, 0.0, False)]
    THINGS = [("e", "a", "sofa", "sofa", 0.0, 0.0, 0.0), ("e", "b", "lamp", "lamp", 3.0, 1.0, 0.0), ("e", "c", "desk", "table", 1.0, 4.0, 2.0), ("e", "d", "fixed_window", "fixed_window", 9.0, 9.0, 0.0), ("bad", "a", "sofa", "sofa", 0.0, 0.0, 0.0)]
    MASKS = [("v0", "a", 5000, True), ("v0", "b", 5000, True), ("v1", "a", 5000, True), ("v1", "c", 5000, True), ("v2", "c", 70, False)]

    def run(self, spark, rows):
        of = {t[1]: t for t in self.THINGS if t[0] == "e"}
        masks = [("e", v, x, of[x][2], of[x][3], n, 50 if ok else 9, 50 if ok else 9, ok, ok) for v, x, n, ok in self.MASKS]
        views = spark.createDataFrame(self.VIEWS, "episode string, view string, step int, yaw double, passed boolean")
        sheets = replay.view_sheets(views, spark.createDataFrame(masks, "episode string, view string, entity string, label string, `group` string, pixels int, box_w int, box_h int, clear boolean, salient boolean"))
        things = spark.createDataFrame(self.THINGS, "episode string, entity string, label string, `group` string, x double, y double, z double")
        full = [(i, r.get("episode", "e"), r["task"], r["entities"], r.get("evidence", []), r.get("models"), r.get("claimed"), r.get("target", (None, None))[0], r.get("target", (None, None))[1], r.get("stored"), r.get("number")) for i, r in enumerate(rows)]
        asked = spark.createDataFrame(full, "question int, episode string, task_type string, entities array<string>, evidence array<string>, models array<string>, claimed string, target_episode string, target_view string, stored string, stored_number double")
        return [(r["value"] if r["number"] is None else r["number"], r["refusal"], r["status"]) for r in sorted(replay.replay(asked, things, sheets).collect(), key=lambda r: r["question"])]

    def test_tasks(self, spark):
        rows = [
            {"task": "grounding_presence", "entities": ["a"], "evidence": ["v0"], "stored": "true"},
            {"task": "grounding_presence", "entities": ["c"], "evidence": ["v0"], "stored": "false"},
            {"task": "last_seen_memory", "entities": ["a"], "evidence": ["v1"], "stored": "2"},
            {"task": "metric_distance", "entities": ["a", "b"], "evidence": ["v0"], "number": 3.25},
            {"task": "metric_distance", "entities": ["a", "b"], "evidence": ["v0"], "number": 3.5},
            {"task": "egocentric_relation", "entities": ["a", "c"], "evidence": ["v1"], "stored": "left_of"},
            {"task": "cross_view_relation", "entities": ["b", "a"], "evidence": ["v0"], "stored": "right_of"},
            {"task": "cross_view_unknown", "entities": ["a", "c"], "evidence": ["v0"], "models": ["v0"], "stored": "unknown"},
            {"task": "cross_view_unknown", "entities": ["a", "b"], "evidence": ["v0"], "models": ["v0"], "stored": "unknown"},
            {"task": "evidence_presence_unknown", "entities": ["c"], "models": ["v0"], "stored": "unknown"},
            {"task": "evidence_presence_unknown", "entities": ["c"], "models": ["v2"], "stored": "unknown"},
            {"task": "occlusion_unknown", "entities": ["d"], "models": ["v0"], "stored": "unknown"},
            {"task": "evidence_presence_reveal", "entities": ["c"], "stored": "present:desk"},
            {"task": "occlusion_reveal", "entities": ["c"], "models": ["v2"], "stored": "present:desk"},
            {"task": "counterfactual_verification", "entities": ["b", "a"], "evidence": ["v0"], "claimed": "left_of", "stored": "false:right_of"},
            {"task": "object_centric_perspective", "entities": ["a", "b"], "evidence": ["v0"]},
            {"task": "rotation_change_detection", "entities": ["c"], "evidence": ["v0", "v1"], "stored": "desk"},
            {"task": "rotation_change_detection", "entities": ["b"], "evidence": ["v0", "v1"], "stored": "lamp"},
            {"task": "orbit_identity", "entities": ["a"], "evidence": ["v0", "v1"], "stored": "true"},
            {"task": "elevation_relation_transfer", "entities": ["b", "a"], "evidence": ["v0"], "stored": "right_of"},
            {"task": "target_view_prediction", "entities": ["a", "b", "c"], "evidence": ["v0", "v1"], "target": ("e", "v2"), "stored": "true"},
            {"task": "target_view_prediction", "entities": ["a"], "evidence": ["v0"], "target": ("e", "v9"), "stored": "true"},
            {"task": "no_such_task", "entities": ["a"]},
            {"task": "grounding_presence", "entities": ["zz"], "evidence": ["v0"]},
            {"task": "grounding_presence", "entities": ["a"], "evidence": ["v9"], "models": ["v0"]},
            {"task": "grounding_presence", "episode": "bad", "entities": ["a"], "evidence": ["w"], "stored": "false"},
        ]
        assert self.run(spark, rows) == [
            ("true", None, "ok"), ("false", None, "ok"), ("2", None, "ok"), (3.2, None, "ok"), (3.2, None, "differs"), ("left_of", None, "ok"), ("right_of", None, "ok"), ("unknown", None, "ok"),
            (None, "not exactly one is shown", "error"), ("unknown", None, "ok"), (None, "a confusable category is shown", "error"), (None, "a confusable category is shown", "error"), ("present:desk", None, "ok"),
            ("present:desk", "revealed_not_recognisable", "refused"), ("false:right_of", None, "ok"), (None, "origin and facing coincide", "error"), ("desk", None, "ok"), ("desk", "entrant_not_the_claimed_one", "refused"),
            ("true", None, "ok"), ("right_of", None, "ok"), ("true", None, "ok"), (None, "no such target view", "error"), (None, "unsupported task", "error"), (None, "no such entity", "error"), (None, "no such view", "error"),
            ("false", "inadmissible_frame", "refused"),
        ]


def test_mask_limits_are_the_certificates_own(spark):
    masks = spark.createDataFrame([("e", "v", "a", 900, 40, 40, 0.5, 640, 480, 0.1, [], True, "sofa", 0.5), ("e", "v", "t", 5000, 40, 40, 0.5, 640, 480, 0.1, [], True, "coffee_table", 0.9)], "episode string, view string, entity string, pixels int, box_w int, box_h int, fill_ratio double, image_w int, image_h int, outer_share double, sides array<string>, frame_passed boolean, label string, height_m double")
    told = spark.createDataFrame([(1, "e", "v", "a", {}, False), (2, "e", "v", "a", {"pixels": 800.0}, True), (3, "e", "v", "a", {"pixels": 800.0}, False), (4, "e", "v", "t", {}, False), (5, "e", "v", "gone", {}, True)], "certificate int, episode string, view string, entity string, limits map<string,double>, stored boolean")
    got = {r["certificate"]: (r["status"], r["failures"]) for r in replay.replay_masks(told, masks).collect()}
    assert got == {1: ("ok", ["too_few_pixels"]), 2: ("ok", []), 3: ("differs", []), 4: ("ok", ["implausible_height"]), 5: ("no_mask", None)}


@pytest.mark.parametrize("seed", range(3))
def test_best_family_is_that_of_all_pairs(spark, seed):
    r = random.Random(seed)
    views = [("e", f"v{i}", i, r.uniform(-3, 3), True) for i in range(6)]
    things = [("e", i, r.uniform(-4, 4), r.uniform(-4, 4)) for i in range(12)]
    bound = [("e", v[1], v[2], v[3], t[1], f"l{t[1] % 5}", r.choice([1000, 2000, 3000]), r.choice([30, 40, 50])) for v in views for t in things if r.random() < 0.5]
    got = families.best_families(spark.createDataFrame(bound, "episode string, view string, step int, yaw double, entity int, label string, pixels int, side int"), spark.createDataFrame(things, "episode string, entity int, x double, y double"), seeds=1 + seed).collect()
    at = {t[1]: t[2:] for t in things}
    best = None
    for s, t in itertools.combinations(sorted(at), 2):
        for a, b in itertools.combinations(range(6), 2):
            held = {(x[4], x[2]): x for x in bound}
            four = [held.get((o, v)) for o in (s, t) for v in (a, b)]
            if None in four or four[0][5] == four[2][5]:
                continue
            turn = abs(math.degrees(views[a][3] - views[b][3])) % 360
            turn = min(turn, 360 - turn)
            sides, ratios = [], []
            for v in (a, b):
                dx, dy, yaw = at[s][0] - at[t][0], at[s][1] - at[t][1], views[v][3]
                right, front = dx * math.cos(yaw) + dy * math.sin(yaw), -dx * math.sin(yaw) + dy * math.cos(yaw)
                ratios.append(max(abs(right), abs(front)) / max(min(abs(right), abs(front)), 1e-12))
                sides.append(("right_of" if right > 0 else "left_of") if abs(right) >= abs(front) else ("in_front_of" if front > 0 else "behind"))
            if turn < 30 or min(ratios) < 1.25 or sides[0] == sides[1]:
                continue
            score = (min(x[7] for x in four), min(x[6] for x in four), round(min(ratios), 9), round(turn, 9), -a, -b, s, t)
            best = max(best, (score, sides)) if best else (score, sides)
    assert [(r["side"], r["pixels"], r["ratio"], r["turn_deg"], r["subject"], r["reference"], [r["relation_a"], r["relation_b"]]) for r in got] == ([(*best[0][:2], pytest.approx(best[0][2]), pytest.approx(best[0][3]), *best[0][6:], best[1])] if best else [])


def test_pose_instruction(spark):
    rows = spark.createDataFrame([(1.04, -0.2, 30.4), (0.01, 0.04, -0.2), (-2.0, 3.0, -90.0)], "r double, f double, y double")
    got = [r[0] for r in rows.select(families.pose_instruction(F.col("r"), F.col("f"), F.col("y"))).collect()]
    assert got == ["move 1.0 m right, move 0.2 m back, turn 30 degrees left", "stay in line, stay in depth, keep facing the same way", "move 2.0 m left, move 3.0 m forward, turn 90 degrees right"]


@pytest.mark.parametrize("seed", range(3))
def test_quotas_equal_the_loop(spark, seed):
    r = random.Random(seed)
    names = [f"r{i}" for i in range(6)]
    rows = [("e", k, r.randrange(9), r.randrange(9), r.choice(names[: 2 + 2 * seed]), 1.0) for k in range(400)]
    rows = [x for x in rows if x[2] != x[3]]
    seen = [("e", s, x) for s in range(5) for x in range(8) if r.random() < 0.4]
    views = {x: sorted(s for _, s, y in seen if y == x) for x in range(9)}
    want, used, count = [], set(), {}
    for _, k, s, t, name, _ in rows:
        pair = frozenset((s, t))
        if not views[s] or not views[t] or pair in used or count.get(name, 0) >= 2:
            continue
        both = sorted(set(views[s]) & set(views[t]))
        want.append((k, both[:1] or [views[s][0], views[t][0]]))
        used.add(pair)
        count[name] = count.get(name, 0) + 1
    got = families.quota_queries(spark.createDataFrame(rows, "episode string, place int, subject int, reference int, relation string, margin double"), spark.createDataFrame(seen, "episode string, step int, entity int"))
    assert sorted((r["place"], r["evidence"]) for r in got.collect()) == want


def test_menu_takes_turns_and_needs_every_variant(spark):
    rows = [(f, v, t, s, s + "x", lab) for f in ("one", "two") for v in ("identity", "mirror") for t, s, lab in [("A", f"a{i}", "front" if i < 5 else "left") for i in range(7)] + [("B", f"b{i}", "back") for i in range(3)]]
    rows = [x for x in rows if x[:2] != ("two", "mirror") or x[2] == "A"] + rows[:3]
    got = menus.query_menu(spark.createDataFrame(rows, "family string, variant string, task string, subject string, reference string, label string"), ("identity", "mirror"), 5).collect()
    assert {r["family"] for r in got} == {"one", "two"} and len(got) == 20
    first = sorted((r["place"], r["task"], r["label"], r["subject"]) for r in got if r["family"] == "one" and r["variant"] == "identity")
    offset = int(hashlib.sha256(b"one").hexdigest()[:8], 16)
    turns = lambda labels: labels[offset % len(labels) :] + labels[: offset % len(labels)]
    queues = {lab: sorted((s for _, t, s, l2 in {(x[0], x[2], x[3], x[5]) for x in rows if x[0] == "one"} if l2 == lab), key=lambda s: hashlib.sha256(f"query-menu|one|{'B' if s[0] == 'b' else 'A'}|{s}|{s}x".encode()).hexdigest()) for lab in ("front", "left", "back")}
    want = [("A", lab, queues[lab].pop(0)) for lab in itertools.islice(itertools.cycle(turns(["front", "left"])), 3)] + [("B", "back", queues["back"].pop(0)) for _ in range(2)]
    assert [x[1:] for x in first] == want
    assert menus.query_menu(spark.createDataFrame(rows, "family string, variant string, task string, subject string, reference string, label string"), ("identity", "mirror", "turned"), 5).collect() == []


class TestPairs:
    def certify(self, spark, kind=pairs.KINDS[0], after=(3.0, 0.0), other=(0.0, 0.0), lost=False, plan="right_of", model="m", seen=True):
        things = [("b", "t", -3.0, 0.0, 0.0, "m", "sofa"), ("b", "a", 0.0, 0.0, 0.0, "k", "lamp"), ("v", "t", *after, 0.0, model, "sofa"), ("v", "a", *other, 0.0, "k", "lamp")][: 3 if lost else 4]
        table = spark.createDataFrame(things, "episode string, entity string, x double, y double, z double, model string, category string")
        ends = spark.createDataFrame([(e, "scene", "family", "sha") for e in "bv"], "episode string, scene string, family string, trajectory_sha256 string")
        shown = spark.createDataFrame([(e, x) for e in "bv" for x in "ta" if seen or (e, x) != ("v", "t")], "episode string, entity string")
        ask = spark.createDataFrame([("p", kind, "b", "v", "t", "a", "left_of", plan, None, "m", "n", "sofa", True)], "proposal string, kind string, base string, variant string, target string, anchor string, planned_before string, planned_after string, yaw double, source_model string, new_model string, category string, executed boolean")
        return pairs.certify_pairs(ask, ends, table, shown).first()

    def test_certified(self, spark):
        got = self.certify(spark)
        key = '{"base_episode_id":"b","family_id":"family","proposal_id":"p","variant_episode_id":"v"}'
        assert got["failed"] == [] and got["status"] == "certified" and got["pair_id"] == "pair-" + hashlib.sha256(key.encode()).hexdigest()[:20] and got["movement_m"] == 6.0
        swapped = self.certify(spark, pairs.KINDS[1], after=(-3.05, 0.0), plan="left_of", model="n")
        assert swapped["failed"] == [] and swapped["signal"] == "answer_invariance"

    @pytest.mark.parametrize(
        "change, fault",
        [({"other": (0.0, 0.1)}, "single_mutable_entity"), ({"lost": True}, "same_entities"), ({"after": (-2.0, 0.0)}, "answers_flip"), ({"after": (3.0, 2.9)}, "axis_margin_after_m"), ({"seen": False}, "evidence_available_both_sides"),
         ({"plan": "behind"}, "relation_after_matches_plan"), ({"kind": pairs.KINDS[1], "after": (-3.05, 0.0), "plan": "left_of"}, "asset_model_changed"), ({"kind": pairs.KINDS[1], "after": (-3.2, 0.0), "plan": "left_of", "model": "n"}, "target_center_invariance_m"), ({"kind": "else"}, "known_kind")],
    )
    def test_faults(self, spark, change, fault):
        got = self.certify(spark, **change)
        assert fault in got["failed"] and got["pair_id"] is None

    def test_release(self, spark):
        names = pairs.REQUIRED
        records = [("ok", "b/1", "v/1", "accepted", "accept", "p1", "g1", "scene:s", "s"), ("bad", "../b", "v/2", "accepted", "reject", "p2", "g2", "scene:x", "s"), ("twice", "b", "v/3", "audit_only", None, None, None, "scene:s", "s"), ("twice", "b", "v/3", "audit_only", None, None, None, "scene:s", "s")]
        listed = [("ok", n, n, 1, "s") for n in names] + [("bad", n, n if n != "scene_ir.json" else "../x", 1, "s") for n in names if n != "minimal_pair.json"]
        files = [("v/1", n, 1, "s") for n in names] + [("v/2", n, 1 + (n == "render_report.json"), "other" if n == "quality_report.json" else "s") for n in names if n != "trajectory_plan.json"]
        got = pairs.pair_release_faults(
            spark.createDataFrame(records, "job string, base_path string, variant_path string, tier string, decision string, pair_id string, episode_split_group string, split_group string, scene_model string"),
            spark.createDataFrame(listed, "job string, name string, path string, byte_size long, sha256 string"), spark.createDataFrame(files, "variant_path string, name string, byte_size long, sha256 string"),
            spark.createDataFrame([("v/1", "p1", "g1"), ("v/2", "p9", "g2")], "variant_path string, pair_id string, split_group string"),
        )
        got = {r["job"]: r["errors"] for r in got.collect()}
        assert got["ok"] == [] and got["twice"] == ["repeated job"]
        assert got["bad"] == ["base path escapes its root", "accepted without an accept", "certificate of another pair", "split group is not the scene's", "required:minimal_pair.json", "missing:trajectory_plan.json", "sha256:quality_report.json", "size:render_report.json", "unsafe-artifact-path:scene_ir.json"]


def test_resampling_draws_as_many_as_there_are(spark):
    r = random.Random(5)
    rows = [(f"c{r.randrange(40)}", r.random() < 0.6, r.random() < 0.5) for _ in range(600)]
    table = spark.createDataFrame(rows, "c string, a boolean, b boolean")
    got = evaluation.bootstrap_draws(table, "c", F.col("a"), F.col("b")).first()
    names = sorted({x[0] for x in rows})
    d = np.array([sum(b - a for c, a, b in rows if c == n) for n in names])
    n = np.array([sum(c == m for c, _, _ in rows) for m in names])
    draws = np.random.default_rng(1).integers(0, len(names), (10_000, len(names)))
    deltas = d[draws].sum(axis=1) / n[draws].sum(axis=1)
    assert got["observed"] == pytest.approx(d.sum() / n.sum()) and (got["records"], got["clusters"]) == (600, len(names))
    assert got["low"] == pytest.approx(np.quantile(deltas, 0.025), abs=0.006) and got["high"] == pytest.approx(np.quantile(deltas, 0.975), abs=0.006)
    with pytest.raises(ValueError):
        evaluation.bootstrap_draws(table.where("c = 'c1'"), "c", F.col("a"), F.col("b"))


def test_far_neighbours_are_found(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0), (2, 0, 100.0, 0.0, 0.0), (3, 0, 100.0, 300.0, 0.0), (4, 1, 0.0, 0.0, 0.0), (5, None, 0.0, 0.0, 0.0), (6, None, 0.5, 0.0, 0.0)]
    table = spark.createDataFrame([(*x, 1.0, 1.0, 1.0) for x in rows], "entity_id int, region int, x double, y double, z double, hx double, hy double, hz double")
    assert {r["entity_id"]: (r["nearest"], r["distance"]) for r in relations.nearest(table).collect()} == {1: (2, 100.0), 2: (1, 100.0), 3: (2, 300.0), 5: (6, 0.5), 6: (5, 0.5)}
    got = {r["entity_id"]: (r["overlaps"], r["least_clearance"]) for r in relations.clearances(table).collect()}
    assert got == {1: (0, 98.0), 2: (0, 98.0), 3: (0, 298.0), 4: (0, 99.0), 5: (1, 99.0), 6: (1, 99.0)}
    assert relations.nearest(table.limit(0)).collect() == [] and relations.clearances(table.limit(0)).collect() == []


def test_lines_of_split_files_are_numbered(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.jsonl").write_text("".join("\n" if i % 7 == 3 else f'{{"n": {i}, "é": "{"x" * (i % 40)}"}}\n' for i in range(400)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "700b")
    try:
        lines = jsonl.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        got = sorted((r["path"][-8:], r["source_line"], r["line"]) for r in lines.collect())
        assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set(key, before)
    whole = sorted((r["path"][-8:], r["source_line"], r["line"]) for r in jsonl.snapshot_lines(spark, str(tmp_path)).collect())
    assert got == whole and len(got) > 1000


@pytest.mark.parametrize("seed", range(3))
def test_batches_equal_the_loop(spark, seed):
    from orrery.operators import questions as Q

    r = random.Random(seed)
    tasks = [*Q.LIFTED_TASKS, "unknown_abstention", "grounding_presence"]
    rows = []
    for i in range(300):
        n = r.randrange(len(tasks))
        rows.append((f"e{i % 2}", f"f{i:03d}", tasks[n], f"p{r.randrange(6)}", r.choice(["canonical", "canonical", "claim_true"]), r.choice([None, "", *[f"g{k}" for k in range(5)]]), r.choice([["a"], ["a", "b"]]), ["a", "b"], n))
    out = {f"f{i:03d}" for i in range(0, 300, 9)}
    want = []
    for e in ("e0", "e1"):
        had, groups = set(), set()
        for x in sorted((x for x in rows if x[0] == e), key=lambda x: (x[8], x[1])):
            whole = x[2] == "unknown_abstention" and x[6] == x[7] and x[4] == "canonical"
            if x[1] in out or x[3] == "p1" or (x[2] not in Q.LIFTED_TASKS and not whole) or x[2] in had or (x[5] and x[5] in groups) or x[4] == "claim_true":
                continue
            had.add(x[2])
            groups |= {x[5]} - {None, ""}
            want.append((e, x[1]))
    asked = spark.createDataFrame(rows, "episode string, fact_id string, task_type string, program_id string, variant string, `group` string, models array<string>, all_views array<string>, score int")
    got = Q.context_lift(asked, spark.createDataFrame([(x,) for x in out], "fact_id string"), ("p1",))
    assert [(x["episode"], x["fact_id"]) for x in sorted(got.collect(), key=lambda x: (x["episode"], x["place"]))] == want


def test_arm_faults(spark):
    from orrery.operators import verify

    of = lambda rows: spark.createDataFrame(rows, "comparison string, facts array<int>, images array<string>")
    whole = of([("ok", [1, 1, 2], ["i"]), ("twice", [1], ["i"]), ("twice", [1], ["i"]), ("alone", [1], ["i"]), ("counts", [1, 1], ["i"]), ("image", [1], ["i", "j"]), (None, [1], ["i"])])
    single = of([("ok", [1], ["i"]), ("ok", [2], ["i"]), ("ok", [1], ["i"]), ("twice", [1], ["i"]), ("counts", [1], ["i"]), ("image", [1], ["j", "i"]), ("strange", [1, 2], ["i"]), ("many", [1, 2], ["i"])])
    got = sorted((r["comparison"] or "", r["fault"]) for r in verify.arm_faults(whole, single).collect())
    assert got == [("", "no comparison"), ("alone", "missing in isolated"), ("counts", "other facts"), ("image", "other images"), ("many", "missing in episodes"), ("many", "more than one fact"), ("strange", "missing in episodes"), ("strange", "more than one fact"), ("twice", "repeated comparison")]


class TestDialogues:
    THINGS = [("e", "bed", 0.0, 0.0), ("e", "desk", 3.0, 0.5), ("e", "lamp", 1.0, 4.0), ("e", "sofa", -4.0, 1.0)]

    def rounds(self, spark, shown, closed=True, unseen="oven", n=11):
        from orrery.operators import dialogue

        things = spark.createDataFrame([(*t, 0.1, 0.1) for t in self.THINGS], "episode string, label string, x double, y double, hx double, hy double")
        seen = spark.createDataFrame([("e", s, x, p) for s, x, p in shown], "episode string, step int, label string, pixels int")
        ends = spark.createDataFrame([("e", n, closed, unseen)], "episode string, n_views long, closed boolean, unseen string")
        return [(r["round"], r["kind"], r["released"], r["evidence"], r["objects"], r["answer"]) for r in sorted(dialogue.scene_dialogues(things, seen, ends).collect(), key=lambda r: r["round"])]

    def test_all_seven(self, spark):
        shown = [(0, "bed", 900), (0, "desk", 900), (1, "bed", 900), (2, "desk", 900), (5, "lamp", 900), (8, "sofa", 900), (9, "lamp", 900), (10, "bed", 900)]
        got = self.rounds(spark, shown)
        assert [r[1] for r in got] == ["inventory", "covis_relation", "temporal", "crossview", "perspective", "epistemic_loop", "layout"]
        assert got[0] == (1, "inventory", [0], [0], ["bed", "desk"], "bed, desk")
        assert got[1] == (2, "covis_relation", [1, 2], [0], ["bed", "desk"], "left_of")
        assert got[2] == (3, "temporal", [3, 4], [1], ["bed"], "2")
        # lamp and bed are 3 m clear, the first by name goes first, and left_of was used
        assert got[3][4:] == (["bed", "lamp"], "behind") and got[3][2] == [5, 6, 7] and got[3][3] == [0, 1, 5]
        assert got[4][4][:2] in (["bed", "desk"], ["desk", "bed"]) and got[5] == (6, "epistemic_loop", [10], [0, 10], ["oven", "bed"], "unknown") and got[6][2:4] == ([], [])

    def test_views_of_a_skipped_round_go_to_the_next(self, spark):
        shown = [(0, "bed", 900), (0, "desk", 100), (1, "bed", 900), (5, "lamp", 900), (6, "desk", 900), (6, "lamp", 900), (10, "bed", 900)]
        got = self.rounds(spark, shown)
        assert [r[1] for r in got][:2] != ["inventory", "covis_relation"] and got[0][2][0] == 0
        assert [s for r in got for s in r[2]] == sorted(s for r in got for s in r[2])

    def test_refused(self, spark):
        assert self.rounds(spark, [(0, "bed", 900), (0, "desk", 900)], closed=False) == []
        assert self.rounds(spark, [(0, "bed", 900), (0, "desk", 900)], n=10) == []
