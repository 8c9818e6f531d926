"""Faults that larger tables showed: ties, groups of one key, and what a step holds or sorts."""

from __future__ import annotations

import itertools
import math
import random
import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.operators import claims, dedup, families, menus, relations, replay, schedule, verify, witness
from orrery.plans import durable, layouts, scenes
from tests.oracle import database, DATA


def test_distances_round_as_in_sql(spark):
    rows = [(-3.1, 3.6799999999999997, 0.08000000000000007, -3.46, 2.01, 1.86), (-2.41, -2.08, -2.69, -2.39, 0.47, 0.41), (0.0, 3.0, 0.0, 4.0, 0.0, 0.0)]
    table = spark.createDataFrame(rows, "ax double, bx double, ay double, by double, az double, bz double")
    side = lambda s: F.struct(*[F.col(f"{s}{k}").alias(k) for k in "xyz"])
    got = [r[0] for r in table.select(replay.tenths_apart(side("a"), side("b"))).collect()]
    con = database(DATA)
    want = [con.execute("select round(sqrt((? - ?) ** 2 + (? - ?) ** 2 + (? - ?) ** 2), 1)", list(r)).fetchall()[0][0] for r in rows]
    assert got == want == [7.7, 0.5, 5.0]


def test_points_in_one_line_have_the_sign_of_the_sql(spark):
    ox, oy, fx, fy, tx, ty = 2.13, -3.1799999999999997, -1.63, -4.62, -0.03000000000000025, 2.46
    right, front = spark.range(1).select(*G.object_components(*map(F.lit, (ox, oy, fx, fy, tx, ty)))).first()
    assert front == 0.0 and right > 6


BOX = "entity_id int, region int, x double, y double, z double, hx double, hy double, hz double"


def crowd(spark, n=150, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice((0, 0, 0, None)), *[rng.gauss(0, 2) for _ in "xy"], rng.gauss(0, 1), *[rng.choice((0.05, 0.1, 0.7)) for _ in "xyz"]) for i in range(n)]
    return rows, spark.createDataFrame(rows, BOX).coalesce(1)


def test_moves_in_a_crowd(spark, monkeypatch):
    """The boxes that are tried first change nothing, and few moves are left to the join."""
    rows, table = crowd(spark)
    want, moves = set(), 0
    for a, b in itertools.permutations(rows, 2):
        if a[1] != b[1] or ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 > 3.0:
            continue
        moves += 1
        across = abs(a[2] - b[2]) >= abs(a[3] - b[3])
        at = (2 * b[2] - a[2] if across else a[2], a[3] if across else 2 * b[3] - a[3], a[4])
        if not any(o[1] == a[1] and o[0] not in (a[0], b[0]) and all(abs(o[2 + k] - at[k]) < o[5 + k] + a[5 + k] + 0.03 for k in range(3)) for o in rows):
            want.add((a[0], b[0]))
    left = []
    monkeypatch.setattr(relations, "cut", lambda df: left.append(df.count()) or df)
    got = {(r["target"], r["anchor"]) for r in relations.flip_moves(table).collect()}
    assert got == want and len(want) < left[0] < 0.7 * moves


def test_only_rows_that_can_be_first_are_sorted(spark, monkeypatch):
    _, table = crowd(spark, 400)
    sorted_rows, plain = [], relations.top_per
    monkeypatch.setattr(relations, "top_per", lambda rows, *rest: sorted_rows.append(rows.count()) or plain(rows, *rest))
    key = lambda r: (r["relation"], r["subject"], r["reference"])
    some = sorted(map(key, relations.relation_candidates(table, per_relation=5).collect()))
    every = relations.relation_candidates(table, per_relation=None)
    assert some == sorted(map(key, plain(every, ["relation"], [relations.candidate_id(), F.col("subject"), F.col("reference")], 5).collect()))
    assert sorted_rows[-1] < every.count() / 20


def test_texts_with_common_ends_are_not_all_paired(spark, monkeypatch):
    """Like urls: what they share is common, and only near copies are compared."""
    rng = random.Random(2)
    rows = [(i, "http://site.example.net/en/" + "".join(rng.choice("0123456789") for _ in range(9)) + "?page=2&ref=x") for i in range(300)]
    rows += [(1000 + i, t[:-1] + "y") for i, t in rows[:20]]
    grams = {k: {t[j : j + 4] for j in range(len(t) - 3)} for k, t in rows}
    alike = lambda a, b: 2 * len(grams[a] & grams[b]) / (len(grams[a]) + len(grams[b])) >= 0.85
    want = {(a, b) for (a, _), (b, _) in itertools.combinations(rows, 2) if alike(a, b)}
    plain = dedup.dice
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counter = spark.sparkContext.accumulator(0)
        monkeypatch.setattr(dedup, "dice", lambda x, y: plain(x, y) + F.udf(lambda: counter.add(1) or 0.0, "double").asNondeterministic()())
        got = {(r["a"], r["b"]) for r in dedup.near_duplicates(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == want and len(want) >= 20
    assert counter.value < 4 * len(want) + 200


def test_pairs_of_a_scene_are_not_shuffled(spark, monkeypatch):
    """The same as quota_queries of all pairs: ties, objects in one place, objects never shown, scenes of one or none."""
    rng = random.Random(4)
    rows = [(f"e{e}", rng.randrange(-50, 50) * 100 + k, rng.choice((0.0, 1.0, 2.5, 3.25)), rng.choice((0.0, 1.0, 4.5)), sorted(s for s in range(5) if rng.random() < 0.3)) for e in range(40) for k in range(e % 13)]
    things = spark.createDataFrame(rows, "episode string, entity long, x double, y double, steps array<long>")
    side = lambda p: things.select("episode", F.col("entity").alias(p), F.col("x").alias(f"{p}_x"), F.col("y").alias(f"{p}_y"))
    dx, dy = F.col("subject_x") - F.col("reference_x"), F.col("subject_y") - F.col("reference_y")
    pairs = side("subject").join(side("reference"), "episode").where("subject <> reference")
    pairs = pairs.select("episode", "subject", "reference", G.dominant_relation(dx, dy)["relation"].alias("relation"), F.round(F.abs(F.abs(dx) - F.abs(dy)), 9).alias("margin"))
    placed = pairs.withColumn("place", F.row_number().over(W.partitionBy("episode").orderBy(F.col("margin").desc(), "subject", "reference")).cast("long"))
    key = lambda df: sorted(map(str, df.select("episode", "place", "subject", "reference", "relation", "margin", "evidence").collect()))
    want = key(families.quota_queries(placed, things.select("episode", "entity", F.explode("steps").alias("step"))))
    monkeypatch.setattr(families, "PAIRS", 300)
    got = families.scene_queries(things.groupBy("episode").agg(F.collect_list(F.struct("steps", "y", "x", "entity")).alias("things")).unionByName(spark.createDataFrame([("none", [])], "episode string, things array<struct<steps: array<long>, y: double, x: double, entity: long>>")))
    assert key(got) == want and len(want) > 100
    plan = scenes.oracle_queries(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "subject" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_nearest_in_a_crowd_and_in_one_place(spark, monkeypatch):
    """Objects in one place are not paired with each other, and a crowd is searched from a small reach on."""
    rng = random.Random(6)
    rows = [(i, rng.choice((0, 1, None)), rng.gauss(0, 0.4), rng.gauss(0, 0.4)) for i in range(500)]
    rows += [(1000 + i, rng.choice((0, None)), 0.5, -0.25) for i in range(200)] + [(2000, 1, 60.0, 1.0), (2001, 7, 0.0, 0.0), (2002, 1, None, 0.0)]
    tenth = [(3000 + i, 9, float(i % 3), 0.0 + 1e-10 * (i % 2)) for i in range(12)]
    rows += tenth
    want = {}
    for k, g, x, y in rows:
        near = [(round(((x - u) ** 2 + (y - v) ** 2) ** 0.5, 9), i) for i, h, u, v in rows if h == g and i != k and None not in (x, u)]
        if near:
            want[k] = min(near)
    tried, plain = [], relations._around
    monkeypatch.setattr(relations, "_around", lambda some, all_, reach, cols: tried.append(plain(some, all_, reach, cols)) or tried[-1])
    table = spark.createDataFrame(rows, "entity_id int, region int, x double, y double").withColumn("z", F.lit(0.0))
    got = {r["entity_id"]: (r["distance"], r["nearest"]) for r in relations.nearest(table).collect()}
    assert got == want
    assert tried[0].count() < 40 * len(rows)


def test_masks_are_replayed_from_two_readings_of_the_lines(spark):
    """One for the masks and one for their certificates; what was stored before is known from the order."""
    plan = scenes.mask_replay(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 2


def test_swaps_in_a_crowd_and_of_one_form(spark, monkeypatch):
    """Objects of one form are not paired with each other; distances are taken of few pairs; rows as of all pairs."""
    rng = random.Random(8)
    rows = [(i, rng.choice((0, 1, None)), *[2.0 + rng.random() for _ in "xyz"]) for i in range(400)] + [(1000 + i, 0, 0.5, 0.5, 0.25) for i in range(150)]
    rows += [(2000 + i, 1, 1.0, 1.0, 1.0 + 0.2 * i) for i in range(4)] + [(3000, 0, 0.0, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "entity_id int, region int, hx double, hy double, hz double")
    logs = {r[0]: [math.log(x) for x in r[2:]] for r in rows if min(r[2:]) > 0}
    group = {r[0]: (r[1], math.floor(sum(logs[r[0]]) / 1.5)) for r in rows if r[0] in logs and r[1] is not None}
    flat = {k: [x - sum(v) / 3 for x in v] for k, v in logs.items()}
    want = set()
    for k, g in group.items():
        near = [(max(abs(x - y) for x, y in zip(flat[k], flat[o], strict=True)), o) for o, h in group.items() if h == g and o != k]
        want |= {(k, o) for _, o in sorted((round(d, 9), o) for d, o in near if d <= 0.35)[:3]}
    starts, plain = [], relations.start_reach
    monkeypatch.setattr(relations, "start_reach", lambda points, *rest: starts.append((points.count(), plain(points, *rest))) or starts[-1][1])
    got = {(r["target"], r["candidate"]) for r in relations.swap_candidates(table).collect()}
    assert got == want and len(want) > 800
    assert starts[0][0] < 420 and starts[0][1] < 0.2


def test_replayed_relations_stay_where_they_are_while_objects_are_few(spark):
    rows = spark.createDataFrame([(i, i % 2, i / 3.0, i % 5 / 2.0, i % 3 * 1.0, 1.0, 1.0, 1.0) for i in range(60)], "entity_id long, region int, x double, y double, z double, hx double, hy double, hz double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = relations.relation_candidates(rows, per_relation=None)
        out = verify.replay_relations(stored, rows)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r["status"]: r["count"] for r in out.groupBy("status").count().collect()} == {"ok": stored.count()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bindings_and_families_get_more_tasks_with_more_rows(spark, monkeypatch):
    monkeypatch.setattr(durable, "TASK_ROWS", 10)
    rows = [(e, e % 3, "g", None if e % 7 == 0 else e) for e in range(400)] + [(1, 1, "g", 9), (2, 2, "g", 2)]
    got = witness.unambiguous(spark.createDataFrame(rows, "episode int, step int, `group` string, entity int"))
    assert got.rdd.getNumPartitions() == 41
    assert {r["episode"] for r in got.collect()} == {e for e in range(400) if e % 7 and e != 1}
    facts = spark.createDataFrame([(i // 4, i % 101) for i in range(400)], "g int, f int")
    out = claims.excluded_families(facts, facts.where("f = 3"), "g", "f")
    assert ", 40)" in out._jdf.queryExecution().executedPlan().toString()
    groups = {i // 4 for i in range(400) if i % 101 == 3}
    assert {r["f"] for r in out.collect()} == {i % 101 for i in range(400) if i // 4 in groups}


def test_arms_are_counted_without_a_join_and_nulls_match_nothing(spark):
    a = spark.createDataFrame([(1, 5), (1, 5), (1, None), (2, 7), (3, 1), (None, 4)], "k int, f int")
    b = spark.createDataFrame([(1, 5), (1, 5), (1, None), (2, 7), (4, 1), (None, 4)], "k int, f int")
    out = schedule.arm_pairs(a, b, "k", "f")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: tuple(r)[1:] for r in out.collect()} == {1: (3, 3, False), 2: (1, 1, True), 3: (1, 0, False), 4: (0, 1, False), None: (1, 1, False)}


def test_satellites_of_a_layout_are_paired_in_their_row(spark):
    layouts = spark.createDataFrame([(1, "F", 0.0, 0.0, 0.0)], "family int, variant string, anchor_x double, anchor_y double, frame_yaw double")
    around = spark.createDataFrame([(1, "F", n, f"c{n}", x, y, 0.1, n) for n, x, y in ((1, 0.0, 4.0), (2, 0.0, -4.0))], "family int, variant string, name int, category string, x double, y double, radius double, view int")
    out = menus.layout_questions(layouts, around)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert {(r["task"], r["subject"], r["label"]) for r in out.collect() if r["task"] == menus.FORMS[0]} == {(menus.FORMS[0], "c1", "front"), (menus.FORMS[0], "c2", "back")}


def scenes_of(spark, n=12, seed=4):
    from orrery.operators import dialogue

    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(9)]
    things = [(e, a, round(rng.uniform(-5, 5), 2), round(rng.uniform(-5, 5), 2), 0.1, 0.15) for e in range(n) for a in names]
    shown = [(e, s, a, rng.choice((100, 900, 900))) for e in range(n) for s in range(11) for a in rng.sample(names, 3)]
    ends = [(e, 11 if e % 3 else 10, bool(e % 2), "n99" if e % 4 else None) for e in range(n)]
    tables = (spark.createDataFrame(things, "episode int, label string, x double, y double, hx double, hy double"), spark.createDataFrame(shown, "episode int, step int, label string, pixels int"), spark.createDataFrame(ends, "episode int, n_views int, closed boolean, unseen string"))
    return things, shown, dialogue.scene_dialogues(*tables)


def test_pairs_and_triples_of_a_dialogue_are_not_shuffled(spark):
    _, _, out = scenes_of(spark)
    plan = out._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and all("label" not in line.split("hashpartitioning(")[1].split(")")[0] for line in moved) and len(moved) <= 7
    rows = out.collect()
    assert rows and all(r["episode"] % 3 for r in rows)


def test_the_clearest_quadrant_is_that_of_a_loop(monkeypatch):
    import numpy as np

    from orrery.operators import dialogue

    rng = np.random.default_rng(3)
    for _ in range(30):
        x, y = rng.integers(-300, 300, (2, 7)) / 100
        half = np.full(7, 0.1)
        shown = rng.random((5, 7)) < 0.35
        clear = shown & (rng.random((5, 7)) < 0.8)
        best = None
        for o, f, t in itertools.permutations(range(7), 3):
            both = clear[:, o] & clear[:, f]
            long = math.hypot(x[f] - x[o], y[f] - y[o])
            if not both.any() or not clear[:, t].any() or long < 1e-6:
                continue
            ux, uy, vx, vy = (x[f] - x[o]) / long, (y[f] - y[o]) / long, x[t] - x[o], y[t] - y[o]
            qx, qy = vx * uy - vy * ux, vx * ux + vy * uy
            angle = math.degrees(min(math.atan2(abs(qx), abs(qy)), math.atan2(abs(qy), abs(qx))))
            if angle < 20 or abs(qx) <= 0.1 * (abs(ux) + abs(uy)) or abs(qy) <= 0.1 * (abs(ux) + abs(uy)):
                continue
            key = (bool((both & shown[:, t]).any()), -round(angle, 2), o, f, t)
            if best is None or key < best[0]:
                best = key, ("front" if qy >= 0 else "back") + ("-right" if qx >= 0 else "-left")
        want = best and (*best[0][2:], best[1])
        for trips in (1, 20, 1 << 20):
            monkeypatch.setattr(dialogue, "TRIPS", trips)
            assert dialogue._view_round(x, y, half, half, shown, clear) == want


def graphs_of(seed=8, n=60):
    rng = random.Random(seed)
    types = ("entity", "metric", "boolean", "relation", None)
    rows = []
    for g in [*range(n), None]:
        names = [f"n{i}" for i in range(5)]
        for _ in range(rng.randrange(1, 7)):
            inputs = rng.choice([None, [], *[[rng.choice([*names, "hint", "frame", "lost", None]) for _ in range(rng.randrange(1, 4))] for _ in range(6)]])
            rows.append((g, 0, rng.choice(names + [None]), rng.choice(("V", "R", "G", None)), inputs, rng.choice(types)))
        rows += [(g, 1, "hint", None, None, "entity"), (g, 1, "frame", None, None, "frame")]
        if rng.random() < 0.3:
            rows.append((g, 1, rng.choice(names), None, None, "metric"))
        rows += [(g, 2, rng.choice(names + ["none"]), None, None, None)]
    return rows


def faults_in(rows):
    out = []
    for g in {r[0] for r in rows}:
        of = [r for r in rows if r[0] == g]
        nodes, given = [r for r in of if r[1] == 0], [r for r in of if r[1] == 1]
        hit = lambda x, among: g is not None and x is not None and any(r[2] == x for r in among)
        kind = lambda x: min((r[5] for r in nodes + given if r[2] == x and r[5] is not None), default=None) if hit(x, nodes + given) else None
        bad = set()
        for x in {r[2] for r in nodes}:
            if sum(r[2] == x for r in nodes) > 1 or hit(x, given):
                bad.add((x, "made twice"))
            if any(kind(i) is None for r in nodes if r[2] == x for i in r[4] or ()):
                bad.add((x, "missing input"))
            if any(r[4] == [] for r in nodes if r[2] == x):
                bad.add((x, "wrong signature"))
            for form in {(r[3], r[5]) for r in nodes if r[2] == x and r[4]}:
                takes = sorted(((s, kind(i) or "") for r in nodes if r[2] == x and (r[3], r[5]) == form for s, i in enumerate(r[4] or ())))
                if all(t for _, t in takes) and (form[0], tuple(t for _, t in takes), form[1]) not in replay.SIGNATURES:
                    bad.add((x, "wrong signature"))
        edges = {(r[2], i) for r in nodes for i in r[4] or () if hit(i, nodes)}
        while (rest := {e for e in edges if e[1] in {a for a, _ in edges}}) != edges:
            edges = rest
        out += [(g, *b) for b in bad] + [(g, x, "in a cycle") for x in {a for a, _ in edges}]
        for r in of:
            if r[1] == 2:
                says = [False if m[3] not in (None, "V") or m[5] not in (None, "boolean") else True if m[3] == "V" and m[5] == "boolean" else None for m in nodes if m[2] == r[2]] if hit(r[2], nodes) else []
                says = [s for s in says if s is not None]
                out += [(g, r[2], "no such answer")] if not says else [] if all(says) else [(g, r[2], "answer is no boolean V")]
    return sorted(out, key=repr)


def test_faults_of_graphs_of_any_shape_and_split(spark):
    import pyarrow as pa

    rows = graphs_of()
    kind = "graph int, kind int, name string, operation string, inputs array<string>, type string"
    table = spark.createDataFrame(rows, kind)
    of = [table.where(f"kind = {k}") for k in range(3)]
    out = replay.graph_faults(of[0].selectExpr("graph", "name as node", "operation", "inputs", "type as output_type"), of[1].select("graph", "name", "type"), of[2].selectExpr("graph", "name as answer"))
    # every row is shuffled once, and no round of the search for cycles is a job of its own
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(map(tuple, out.collect()), key=repr) == faults_in(rows)
    whole = pa.Table.from_pylist([dict(zip([c.split()[0] for c in kind.split(", ")], r, strict=True)) for r in sorted(rows, key=lambda r: (r[0] is not None, r[0]))], pa.schema([("graph", pa.int32()), ("kind", pa.int32()), *[(c, pa.string()) for c in ("name", "operation")], ("inputs", pa.list_(pa.string())), ("type", pa.string())]))
    for size in (1, 7, 50):
        got = [tuple(r.values()) for b in replay._faulty_graphs(iter(whole.to_batches(size))) for r in b.to_pylist()]
        assert sorted(got, key=repr) == faults_in(rows)


def test_a_long_chain_ends(spark):
    rows = [(1, f"n{i}", "V", [f"n{i + 1}" if i < 4999 else "seen"], "boolean") for i in range(5000)] + [(2, f"n{i}", "V", [f"n{(i + 1) % 3000}"], "boolean") for i in range(3000)]
    nodes = spark.createDataFrame(rows, "graph int, node string, operation string, inputs array<string>, output_type string")
    given = spark.createDataFrame([(1, "seen", "entity")], "graph int, name string, type string")
    ends = spark.createDataFrame([(1, "n0"), (2, "n0")], "graph int, answer string")
    got = replay.graph_faults(nodes, given, ends).where("fault = 'in a cycle'").collect()
    assert len(got) == 3000 and {r["graph"] for r in got} == {2}


def test_questions_of_a_replay_are_not_shuffled(spark):
    """Lines and orders meet by order, then views by customer; what the questions ask of them stays within a row, and nothing is written between."""
    plan = scenes.question_replay(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan and "hashpartitioning(question" not in plan
    assert plan.count("hashpartitioning(") <= 4


def test_both_sides_of_a_mask_replay_read_the_same(spark):
    """The same columns and filters, so the sums are shuffled once."""
    plan = scenes.mask_replay(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    for name in ("orders", "lineitem", "supplier"):
        scans = [line for line in plan.splitlines() if f"{name}.parquet" in line]
        assert len(scans) == 2 and len({re.sub(r"#\d+L?", "", line).split("FileScan")[1] for line in scans}) == 1


def test_masks_of_frame_families_are_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(scenes, "cut", lambda df: written.append(df) or df)
    assert scenes.frame_families(spark, DATA).columns[0] == "ep" and not written


def test_long_texts_of_one_language_are_not_all_compared(spark, monkeypatch):
    """They share most of their grams and some rare ones; copies with a few other words are found among them, and little else is compared."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7))) for _ in range(250)]
    texts = [[rng.choice(words) for _ in range(90)] for _ in range(160)]
    for t in texts[:20]:
        texts.append([*t[:40], "zebra", *t[41:]])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    grams = {k: {t[j : j + 4] for j in range(len(t) - 3)} for k, t in rows}
    want = {(a, b) for (a, _), (b, _) in itertools.combinations(rows, 2) if 2 * len(grams[a] & grams[b]) >= 0.85 * (len(grams[a]) + len(grams[b]))}
    plain = dedup.dice
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counter = spark.sparkContext.accumulator(0)
        monkeypatch.setattr(dedup, "dice", lambda x, y: plain(x, y) + F.udf(lambda: counter.add(1) or 0.0, "double").asNondeterministic()())
        got = {(r["a"], r["b"]) for r in dedup.near_duplicates(spark.createDataFrame(rows, "k long, t string"), "k", "t", words=16).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == want and len(want) >= 20
    assert counter.value < 4 * len(want)


def test_pair_certificates_read_the_lines_once(spark, monkeypatch):
    read, plain = [], layouts.lines
    monkeypatch.setattr(layouts, "lines", lambda *args: read.append(args) or plain(*args))
    assert layouts.pair_certificates(spark, DATA).columns[0] == "proposal" and len(read) == 1
