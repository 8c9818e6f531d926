from __future__ import annotations

import json
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.operators import audit as A
from orrery.operators import dedup
from orrery.operators import evaluation as E
from orrery.operators import gates as Q
from orrery.operators import raster as R
from orrery.operators import relations as L
from orrery.operators import sampling as S
from orrery.operators import schedule as X
from orrery.operators import visibility as V
from orrery.operators.graph import connected_components
from orrery.sources import arrays, bundles, jsonl, store
from orrery.streaming import sightings


class TestEvaluation:
    """Nine records: a claim pair, two evidence triples (one in validation), one alone."""

    ROWS = [
        ("claim-false", "test", "c1", "claim_false"), ("claim-true", "test", "c1", "claim_true"), ("e1-prefix", "test", "e1", "prefix_unknown"), ("e1-revealed", "test", "e1", "revealed"),
        ("e1-deleted", "test", "e1", "decisive_deleted"), ("e2-prefix", "validation", "e2", "prefix_unknown"), ("e2-revealed", "validation", "e2", "revealed"), ("e2-deleted", "validation", "e2", "decisive_deleted"), ("single", "test", None, "canonical"),
    ]
    TRIPLE = ("prefix_unknown", "revealed", "decisive_deleted")

    def rows(self, spark, wrong):
        return spark.createDataFrame([(*r, r[0] not in wrong) for r in self.ROWS], "record_id string, split string, grp string, variant string, ok boolean")

    def test_metrics(self, spark):
        rows = self.rows(spark, {"single", "e2-revealed", "claim-false"})
        sets = {(r["grouping"], r["key"]): (r["correct"], r["total"]) for r in E.accuracy_sets(rows, F.col("ok"), ["split"]).collect()}
        assert sets == {("all", None): (6, 9), ("split", "test"): (4, 6), ("split", "validation"): (2, 3)}
        assert E.family_exact_match(rows, "grp", "variant", F.col("ok"), self.TRIPLE).first()["accuracy"] == 0.5
        assert E.family_exact_match(rows, "grp", "variant", F.col("ok"), ("claim_false", "claim_true")).first()["accuracy"] == 0.0
        aces = E.conditional_success(rows, "grp", "variant", F.col("ok"), self.TRIPLE, "revealed").first()
        assert (aces["correct"], aces["total"], aces["status"]) == (1, 1, "OK")

    def test_no_case(self, spark):
        rows = self.rows(spark, {"e1-revealed", "e2-revealed"})
        aces = E.conditional_success(rows, "grp", "variant", F.col("ok"), self.TRIPLE, "revealed").first()
        assert aces["accuracy"] is None and aces["status"] == "NA_ZERO_DENOMINATOR"

    def test_coverage(self, spark):
        bench = spark.createDataFrame([("a",), ("b",), ("c",)], "record_id string")
        said = spark.createDataFrame([("a",), ("b",), ("b",), ("x",), (None,)], "record_id string")
        got = {r["record_id"]: (r["n_predictions"], r["reason"]) for r in E.coverage(bench, said).collect()}
        assert got == {"a": (1, "matched"), "b": (2, "duplicate_prediction"), "c": (0, "missing"), "x": (1, "extra"), None: (1, "missing_record_id")}

    def test_pairs_with_two_wrong_labels(self, spark):
        rows = spark.createDataFrame([("f", "a", "left", "front"), ("f", "b", "right", "back")], "grp string, variant string, said string, truth string")
        m = E.pair_metrics(rows, "grp", "variant", "said", "truth", ("a", "b")).first()
        assert (m["pairs"], m["exact"], m["change_required"], m["changed"]) == (1, 0, 1, 1)


class TestSchedules:
    def test_exact_weights_and_parity(self, spark):
        arms = spark.createDataFrame([("iso-a", "ab", "a", 2), ("iso-b", "ab", "b", 2), ("iso-c", "c", "c", 1), ("iso-t", "t", "t", 3)], "record_id string, cmp string, fact string, repeats int")
        draws = X.expanded(arms, "repeats", "image_matched", "23").cache()
        assert draws.count() == 8
        for r in X.fact_weights(draws, "fact", 6).collect():
            assert r["exact"] and Fraction(r["weight"], r["unit"]) == 1
        again = X.expanded(arms.repartition(3), "repeats", "image_matched", "23")
        assert sorted(map(tuple, draws.collect())) == sorted(map(tuple, again.collect()))
        other = arms.withColumn("fact", F.when(F.col("fact") == "a", "z").otherwise(F.col("fact")))
        same = {r["cmp"]: r["same_facts"] for r in X.arm_pairs(arms, other, "cmp", "fact").collect()}
        assert same == {"ab": False, "c": True, "t": True}

    def test_pixel_exposure(self, spark):
        seen = spark.createDataFrame([("e", "A"), ("e", "B"), ("f", "A"), ("f", "?")], "arm string, path string")
        sizes = spark.createDataFrame([("A", 4, 3), ("B", 2, 5)], "path string, width int, height int")
        assert {r["arm"]: r["pixels"] for r in X.pixel_exposure(seen, sizes, "arm", "path").collect()} == {"e": 22, "f": None}

    def test_answer_segments(self, spark):
        rows = spark.createDataFrame([(1, "1. é\n\nlast")], "k int, text string")
        assert [(r["line"], r["start"], r["end"]) for r in X.answer_segments(rows, "text", "k").orderBy("line").collect()] == [(0, 0, 4), (1, 5, 5), (2, 6, 10)]


class TestSampling:
    def test_exact_counts_and_strata(self, spark):
        scenes = spark.createDataFrame([(f"s{i}", "home" if i < 10 else "office") for i in range(20)], "scene string, domain string")
        of = lambda: {r["scene"]: (r["domain"], r["split"]) for r in S.stratified_split(scenes, "scene", "domain", "x", (("test", 4), ("val", 3))).collect()}
        got = of()
        n = pd.Series([s for _, s in got.values()]).value_counts().to_dict()
        assert n == {"train": 13, "test": 4, "val": 3} and {d for d, s in got.values() if s == "test"} == {"home", "office"} and got == of()

    def test_quotas_add_up_and_stay_below(self, spark):
        for counts, target in (({"a": 1, "b": 50, "c": 49}, 60), ({"a": 3, "b": 3}, 99), ({"a": 5, "b": 2, "c": 9}, 7)):
            df = spark.createDataFrame(list(counts.items()), "k string, n long")
            q = {r["k"]: r["quota"] for r in S.largest_remainder(df, "k", "n", target).collect()}
            assert sum(q.values()) == min(target, sum(counts.values())) and all(q[k] <= counts[k] for k in counts)

    def test_greedy(self, spark):
        c = spark.createDataFrame([(1, 1, 2, "l", 0), (1, 2, 1, "r", 1), (1, 3, 4, "l", 2), (1, 5, 6, "l", 3), (1, 7, 8, "r", 4)], "scene long, a long, b long, rel string, o int")
        got = [(r["a"], r["b"]) for r in S.greedy_pairs(c, "scene", "a", "b", "rel", "o").orderBy("o").collect()]
        assert got == [(1, 2), (3, 4), (7, 8)]

    def test_balanced_relation_counts_cross_scenes(self, spark):
        c = spark.createDataFrame([(s, rel, m) for s in range(4) for rel, m in (("l", 2.0), ("r", 1.0))], "scene long, rel string, m double")
        got = {r["scene"]: r["rel"] for r in S.balanced_choices(c, "scene", "rel", "m").collect()}
        assert got == {0: "l", 1: "r", 2: "l", 3: "r"}

    def test_round_robin_equals_turns(self, spark):
        rng = random.Random(1)
        rows = [(f"b{rng.randrange(4)}", i) for i in range(40)]
        got = [(r["b"], r["i"]) for r in S.round_robin(spark.createDataFrame(rows, "b string, i int"), "b", [F.col("i")], 17).collect()]
        buckets = {b: sorted(i for x, i in rows if x == b) for b in sorted({b for b, _ in rows})}
        want = [(b, v[t]) for t in range(40) for b, v in buckets.items() if t < len(v)][:17]
        assert sorted(got) == sorted(want)


class TestVisibility:
    ROWS = [(1, 0, "a"), (1, 0, "b"), (1, 1, "b"), (1, 1, "c"), (1, 3, "a"), (2, 0, "a")]

    def seen(self, spark):
        return spark.createDataFrame(self.ROWS, "episode long, step long, entity string")

    def test_deltas(self, spark):
        got = {tuple(r) for r in V.belief_deltas(self.seen(spark)).collect()}
        assert got == {(1, 0, "a", "added"), (1, 0, "b", "added"), (1, 1, "b", "reobserved"), (1, 1, "c", "added"), (1, 3, "a", "reobserved"), (2, 0, "a", "added")}
        assert [tuple(r) for r in V.reappearances(self.seen(spark)).collect()] == [(1, "a", 3, 3)]
        assert [tuple(r) for r in V.first_entry(self.seen(spark)).collect()] == [(1, 1, "c")]
        assert {(r["a"], r["b"]) for r in V.never_covisible_pairs(self.seen(spark)).collect()} == {("a", "c")}

    def test_resampling_a_corner(self, spark):
        path = V.cumulative_path(spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 2.0, 0.0), (1, 2, 2.0, 2.0)], "k long, s long, x double, y double"), "k", "s", "x", "y")
        got = [(r["x"], r["y"]) for r in V.resampled(path, "k", "x", "y", 5).orderBy("i").collect()]
        assert got == [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2)]

    def test_coverage_wraps(self, spark):
        rows = spark.createDataFrame([(1, 0.0), (1, 90.0), (1, 180.0), (2, 5.0)], "k long, a double")
        assert {r["k"]: r["coverage_deg"] for r in V.circular_coverage(rows, "k", "a").collect()} == {1: 180.0, 2: 0.0}

    def test_stream_equals_batch(self, spark, tmp_path):
        rows = [(i % 3, f"e{i % 4}", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i)) for i in range(40)]
        spark.createDataFrame(pd.DataFrame(rows, columns=["user_id", "event_type", "ts"])).coalesce(1).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("user_id long, event_type string, ts timestamp").parquet(str(tmp_path / "in"))
        q = sightings.belief_deltas(stream, "user_id", "event_type", "ts").writeStream.format("memory").queryName("deltas").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        got = {(r["episode"], r["entity"], r["change"]): r["n"] for r in spark.table("deltas").groupBy("episode", "entity", "change").agg(F.count("*").alias("n")).collect()}
        keys = {(u, e) for u, e, _ in rows}
        assert all(got[(*k, "added")] == 1 for k in keys) and sum(got.values()) == 40


class TestRelations:
    def entities(self, spark, n=120, seed=2):
        rng = random.Random(seed)
        rows = [(i, rng.choice((1, 2, None)), *[rng.uniform(-6, 6) for _ in range(3)], *[rng.uniform(0.05, 1.2) for _ in range(3)]) for i in range(n)]
        return rows, spark.createDataFrame(rows, "entity_id long, region long, x double, y double, z double, hx double, hy double, hz double")

    def test_near_pairs_equal_all_pairs(self, spark):
        rows, df = self.entities(spark)
        got = {(r["a_id"], r["b_id"]) for r in L.near_pairs(df, 2.5).collect()}
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and np.hypot(a[2] - b[2], a[3] - b[3]) <= 2.5}
        assert got == want

    def test_both_directions(self, spark):
        df = spark.createDataFrame([(1, 7, 0.0, 0.0, 0.0, 0.1, 0.1, 0.1), (2, 7, 2.0, 0.1, 0.0, 0.1, 0.1, 0.1), (3, 7, 0.0, 0.0, 1.0, 0.1, 0.1, 0.1)], "entity_id long, region long, x double, y double, z double, hx double, hy double, hz double")
        got = {(r["subject"], r["reference"], r["relation"]) for r in L.relation_candidates(df).collect()}
        assert {(2, 1, "right_of"), (1, 2, "left_of"), (3, 1, "above"), (1, 3, "below")} <= got
        assert all((b, a, dict(L.INVERSE)[r]) in got for a, b, r in got)

    def test_drift(self, spark):
        _, base = self.entities(spark, 5)
        moved = base.where("entity_id <> 4").withColumn("x", F.col("x") + F.when(F.col("entity_id") == 2, 3.0).otherwise(0.0))
        got = {r["entity_id"]: (r["status"], r["drift_m"]) for r in L.pair_drift(base, moved, F.col("entity_id") == 2).collect()}
        assert got[2][1] == pytest.approx(3) and got[4][0] == "removed" and got[0] == ("kept", 0.0)


class TestRaster:
    """One 8 x 10 frame: depth 1 but for near patches; chair 10, wall 20, two alarms 30 and 31."""

    def frame(self, spark):
        rows = []
        for y in range(8):
            for x in range(10):
                inst = 10 if y < 2 and x < 5 else 30 if 2 <= y < 4 and x < 2 else 31 if y >= 5 and x >= 6 else 20
                depth = 0.2 if y < 2 and x < 5 else 0.0 if (y, x) == (7, 9) else float("nan") if (y, x) == (7, 8) else 1.0
                rows.append((1, y, x, 10 * y, 20, 30, depth, inst))
        return spark.createDataFrame(rows, "view long, y int, x int, r int, g int, b int, depth_m double, instance int")

    def test_statistics(self, spark):
        df = self.frame(spark)
        c = R.collision_stats(df, 8, structural=F.col("instance") == 20).first()
        assert (c["top_half"], c["valid"], c["near"], c["near_things"]) == (40, 40, 10, 10)
        x = R.context_stats(df, width=10, height=8).first()
        assert x["close_share"] == pytest.approx(10 / 78) and x["dominant"] == 20
        s = {r["instance"]: r for r in R.instance_stats(df, 10, 8).collect()}
        assert s[10]["pixels"] == 10 and s[10]["sides"] == ["left", "top"] and s[10]["fill_ratio"] == 1 and s[31]["min_side"] == 3
        labels = spark.createDataFrame([(30, "alarm"), (31, "alarm")], "instance int, label string")
        a = R.category_stats(df, labels).first()
        assert (a["pixels"], a["instances"], a["max_min_side"]) == (16, 2, 3)

    def test_entropy_and_sharpness(self, spark):
        df = self.frame(spark)
        bins = np.bincount([10 * y // 16 for y in range(8) for _ in range(10)])
        p = bins[bins > 0] / 80
        got = R.colour_stats(df).first()
        assert got["entropy_bits"] == pytest.approx(float(-(p * np.log2(p)).sum())) and got["dominant_share"] == pytest.approx(p.max())
        assert R.sharpness(df).first()["sharpness"] == pytest.approx(0, abs=1e-9)

    def test_gates(self, spark):
        row = spark.range(1).select(F.lit(5).alias("a"), F.lit(None).cast("int").alias("b"))
        got = Q.gated(row, ("a_small", F.col("a") > 9), ("b_none", F.col("b") > 0), ("fine", F.lit(True))).first()
        assert got["reasons"] == ["a_small", "b_none"] and not got["passed"]


class TestAudit:
    def test_single_replacement(self, spark):
        a = lambda *v: F.array(*map(F.lit, v))
        row = spark.range(1).select(A.single_replacement(a("0", "1"), a("0", "2"), a("0", "3")).alias("x"), A.single_replacement(a("0", "1"), a("0", "2"), a("0", "2")).alias("y"), A.disjoint(a("1"), a("2"), a("1")).alias("z")).first()
        assert tuple(row) == (True, False, False)

    def test_missing_and_dependencies(self, spark):
        rows = spark.createDataFrame([(1, "a", None), (2, None, 1), (3, "a", 2)], "i long, k string, v int")
        assert {r["field"]: (r["n_missing"], r["first"]) for r in A.missing_fields(rows, ["k", "v", "i"], "i").collect()} == {"k": (1, [2]), "v": (1, [1]), "i": (0, [])}
        assert A.broken_dependencies(rows.na.fill(0), ["k"], "v").count() == 1

    def test_family_atomic(self, spark):
        rows = spark.createDataFrame([(1, "g", True), (2, "g", False), (3, None, False), (4, None, True), (5, "h", False)], "i int, g string, bad boolean")
        assert sorted(r["i"] for r in A.family_atomic(rows, "g", F.col("bad")).collect()) == [3, 5]


class TestDedup:
    def test_equals_all_pairs(self, spark):
        rng = random.Random(3)
        base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 60))) for _ in range(15)]
        rows = [(i, b[:k] + "x" + b[k:] if i % 2 else b) for i, b in enumerate(base * 4) for k in (rng.randrange(len(b) + 1),)] + [(900, None), (901, "")]
        grams = lambda t: {t[i : i + 4] for i in range(len(t) - 3)} if len(t) > 4 else {t} - {""}
        first = {}
        for i, t in rows:
            if t is not None:
                first.setdefault(t, i)
        want = set()
        for t, i in first.items():
            for u, j in first.items():
                if i < j and grams(t) and grams(u) and 2 * len(grams(t) & grams(u)) / (len(grams(t)) + len(grams(u))) >= 0.85:
                    want.add((i, j))
        got = {(r["a"], r["b"]) for r in dedup.near_duplicates(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
        assert got == want

    def test_normalized(self, spark):
        rows = spark.createDataFrame([("Ｆｕｌｌ Ｗidth ①!",), (None,)], "t string")
        assert [r["n"] for r in dedup.normalized(rows, "t", "n").collect()] == ["fullwidth1", None]


class TestSources:
    def test_json_lines(self, spark, tmp_path):
        f = tmp_path / "a.jsonl"
        f.write_text('{"a": 1}\n\n{"a": 2}\r\nnot json\n{"a": NaN}\n[1]\n')
        good, bad = jsonl.tolerant(spark, str(f), "a int")
        assert [(r["source_line"], r["a"]) for r in good.orderBy("source_line").collect()] == [(1, 1), (3, 2)]
        assert sorted(r["source_line"] for r in bad.collect()) == [4, 5, 6]
        with pytest.raises(Exception, match=r"a\.jsonl:4|a\.jsonl:5|a\.jsonl:6"):
            jsonl.strict(spark, str(f), "a int").collect()
        jsonl.write(good.select("a"), str(tmp_path / "out"), "a", one_file=True)
        assert [r["a"] for r in spark.read.json(str(tmp_path / "out")).orderBy("a").collect()] == [1, 2]

    def test_bundles(self, spark, tmp_path):
        b = tmp_path / "root" / "b1"
        b.mkdir(parents=True)
        scene = {"scene_id": "s", "regions": [], "runtime_map": {"7": "chair"}, "entities": [{"entity_id": "chair", "raw_label": "chair", "region_id": " ", "translation_m": [-1, 1, 0.5], "rotation_xyzw": [0, 0, 0, 1], "half_extents_m": [0.5, 0.25, 1]}]}
        (b / "scene.json").write_text(json.dumps(scene))
        (b / "trajectory.json").write_text(json.dumps({"trajectory_class": "T1", "views": [{"view_id": f"view-00{i}", "step": i, "translation_m": [0, 0, 0], "rotation_xyzw": [0, 0, 0, 1]} for i in (1, 0)]}))
        (b / "render.json").write_text(json.dumps({"observations": [{"view_id": f"view-00{i}", "visible_entity_ids": ["chair"] * (i == 1), "sha256": "x"} for i in range(2)]}))
        root = str(tmp_path / "root")
        e = bundles.entities(spark, root).first()
        assert e["extent_m"] == [1, 0.5, 2] and e["region_id"] == "unassigned"
        v = bundles.views(spark, root)
        assert v.count() == 2 and bundles.broken_steps(v).count() == 0
        assert [(r["step"], r["entity"]) for r in bundles.visibility(v).collect()] == [(1, "chair")]
        assert [r["detail"] for r in bundles.rejections(bundles.inventory(spark, root)).collect()] == ["selection.json"]
        assert bundles.runtime_map(spark, root).first()["entity_id"] == "chair"

    def test_arrays(self, spark, tmp_path):
        np.savez(tmp_path / "v1.npz", rgb=np.arange(18, dtype=np.uint8).reshape(2, 3, 3), depth_m=np.ones((2, 3), np.float32), instance_id=np.full((2, 3), 4, np.uint32))
        rows = arrays.views_of(arrays.pixels(spark, str(tmp_path))).orderBy("y", "x").collect()
        assert len(rows) == 6 and (rows[-1]["r"], rows[-1]["g"], rows[-1]["b"]) == (15, 16, 17) and rows[0]["view"] == "v1"

    def test_store(self, spark, tmp_path):
        path = str(tmp_path / "blobs")
        df = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"two"),), (bytearray(b"one"),)], "content binary")
        store.put(df, path)
        store.put(df.limit(2), path)
        assert spark.read.parquet(path).count() == 2
        digest = df.limit(1).select(F.sha2("content", 256).alias("sha256"))
        assert bytes(store.get(spark, path, digest).first()["content"]) == b"one"
        m = spark.createDataFrame([("a", 3, "h"), ("b", 3, "h"), ("c", 3, "h"), ("d", 3, "h")], "path string, length long, sha256 string")
        f = spark.createDataFrame([("a", 3, "h"), ("b", 4, "h"), ("c", 3, "i"), ("e", 1, "h")], "path string, length long, sha256 string")
        assert {r["path"]: r["status"] for r in store.verified(m, f).collect()} == {"a": "ok", "b": "wrong_size", "c": "wrong_hash", "d": "missing", "e": "unlisted"}


def test_components_of_names(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("z", "z"), (None, "q")], "a string, b string")
    assert {r["node"]: r["component"] for r in connected_components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r["component"] for r in connected_components(edges).collect()} == {0}


class TestQuestions:
    def test_program_faults(self, spark):
        from orrery.operators import questions as K

        i = "array<struct<name: string, type: string>>"
        nodes = spark.createDataFrame(
            [("p", 0, "e", [("v", "view")], "entity"), ("p", 1, "a", [("e", "entity")], "boolean"), ("q", 0, "a", [("b", "x")], "y"), ("q", 1, "b", [("v", "frame"), ("z", "t")], "x"), ("r", 0, "d", [], "x"), ("r", 1, "d", [], "x")],
            f"program_id string, place int, node_id string, inputs {i}, output_type string",
        )
        given = spark.createDataFrame([("p", "v", "view"), ("q", "v", "view")], "program_id string, name string, type string")
        got = {tuple(r) for r in K.program_faults(nodes, given).collect()}
        assert got == {("q", "a", "input made later"), ("q", "b", "wrong type"), ("q", "b", "unknown input"), ("r", "d", "made twice")}

    def test_legal_tasks_and_replay(self, spark):
        from orrery.operators import questions as K

        rows = spark.createDataFrame([("T1", "a"), ("T1", "b"), ("T2", "a")], "trajectory_class string, task_type string")
        good, bad = K.legal(rows, spark.createDataFrame([("T1", "a")], "trajectory_class string, task_type string"))
        assert [tuple(r) for r in good.collect()] == [("T1", "a")] and bad.count() == 2
        asked = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "request_hash string")
        told = spark.createDataFrame([("h1", "x"), ("h1", "x"), ("h2", "x"), ("h2", "y")], "request_hash string, response string")
        assert {r["request_hash"]: r["status"] for r in K.replayed_responses(asked, told).collect()} == {"h1": "replayed", "h2": "conflict", "h3": "missing"}

    def test_relations_replay_and_inverses(self, spark):
        from orrery.operators import verify

        df = spark.createDataFrame([(1, 7, 0.0, 0.0, 0.0, 0.1, 0.1, 0.1), (2, 7, 2.0, 0.1, 0.0, 0.1, 0.1, 0.1)], "entity_id long, region long, x double, y double, z double, hx double, hy double, hz double")
        found = L.relation_candidates(df)
        assert verify.inverses_hold(found).count() == 0
        wrong = found.withColumn("relation", F.lit("above")).limit(1).unionByName(found.withColumn("subject", F.lit(99)).limit(1))
        assert sorted(r["status"] for r in verify.replay_relations(found.unionByName(wrong), df).collect()) == ["no_such_pair", "ok", "ok", "wrong_relation"]
        same = verify.same_rows(found, found).first()
        assert same["same"] and not verify.same_rows(found, found.limit(1)).first()["same"]


class TestReleases:
    def test_inputs_and_oracle_share_the_id_alone(self, spark):
        from orrery.operators import release

        q = spark.createDataFrame([("a", "test", "x?", "1", "t", None), ("b", "train", "y?", "2", "t", False), ("c", "test", "z?", "3", "t", True)], "record_id string, split string, question string, answer string, task_type string, training_only boolean")
        inputs, oracle = release.benchmark_export(q)
        assert set(inputs.columns) & set(oracle.columns) == {"record_id"} and [r["record_id"] for r in inputs.collect()] == ["a"]
        assert release.oracle_predictions(oracle).first()["answer_value"] == "1"

    def test_capabilities_and_content(self, spark):
        from orrery.functions import text
        from orrery.operators import release

        rows = spark.createDataFrame([(1, ["F", "AUX"]), (1, ["G", "F"])], "k int, c array<string>")
        assert release.capabilities(rows, "k", "c").first()["capabilities"] == ["F", "G"]
        made = spark.range(1).select(release.content(F.lit("hi"), F.array(F.lit("v0"), F.lit("v1"))).alias("c"))
        assert tuple(made.select(text.message_text(F.col("c")), text.message_images(F.col("c"))).first()) == ("hi", ["v0", "v1"])

    def test_evidence_is_released_first(self, spark):
        from orrery.operators import dialogue

        seen = spark.createDataFrame([(1, s, e) for s, e in ((0, "a"), (1, "b"), (2, "b"), (3, "c"), (4, "a"), (5, "c"))], "episode long, step long, entity string")
        released, rounds = dialogue.releases(seen), dialogue.memory_rounds(seen)
        assert dialogue.evidence_faults(rounds, released).count() == 0
        early = rounds.withColumn("evidence", F.lit(5).cast("long")).where("round = 1")
        assert dialogue.evidence_faults(early, released).count() == 1
        turns = dialogue.messages(rounds.withColumn("q", F.lit("?")).withColumn("a", F.col("entity")), "q", "a").orderBy("turn").collect()
        assert [(r["turn"], r["role"]) for r in turns] == [(0, "user"), (1, "assistant"), (2, "user"), (3, "assistant")] and turns[1]["text"] == "a"

    def test_bound_everywhere_and_sources(self, spark):
        from orrery.operators import witness

        m = spark.createDataFrame([(1, 0, "g", "x"), (1, 1, "g", "x"), (1, 1, "g", "y")], "episode long, step long, group string, entity string")
        need = spark.createDataFrame([("q", 1, 0, "g"), ("r", 1, 0, "g"), ("r", 1, 1, "g")], "question string, episode long, step long, group string")
        assert {r["question"]: r["bound"] for r in witness.bound_everywhere(m, need).collect()} == {"q": True, "r": False}
        t = spark.createDataFrame([("s", "t", "a"), ("s", "t", "b")], "scene string, target string, entity string")
        s = spark.createDataFrame([("s", "one", 1, "a", "l"), ("s", "two", 2, "a", "l"), ("s", "two", 2, "b", "k")], "scene string, source string, rank int, entity string, label string")
        assert witness.best_sources(t, s).first()["source"] == "two"

    def test_reports(self, spark, tmp_path):
        from orrery.sources import reports

        df = spark.createDataFrame([("a|b", 0.5, None)], "name string, share double, n1 int")
        text = reports.markdown("T", {"part": df})
        assert text == "# T\n\n## part\n\n| name | share | n1 |\n|---|---|---|\n| a\\|b | 0.5 |  |\n"
        assert "\\newcommand{\\xShare}{0.5}" in reports.latex_macros("x", df) and "\\xNb}" in reports.latex_macros("x", df)
        reports.write_text(df, text, str(tmp_path / "r"))
        assert spark.read.text(str(tmp_path / "r"), wholetext=True).first()[0].strip() == text.strip()
        assert '"name":"share"' in reports.schemas({"t": df})["t"]


class TestClaims:
    def test_sheets_and_texts(self, spark):
        from orrery.operators import claims as C

        rows = spark.createDataFrame([(1, 2, "left_of", 1.5, 2.349), (3, 4, "above", 2.0, 10.0)], "subject long, reference long, relation string, margin double, distance double")
        sheets = C.sheet(C.relation_claims(rows, F.array(F.lit("v1"), F.lit("v0")))).cache()
        held = {r["question_id"]: (r["claims"], r["views"]) for r in sheets.collect()}
        assert held["1:2:left_of"] == ({"relation": "left_of", "margin_m": "1.5", "distance_m": "2.35"}, ["v0", "v1"]) and held["3:4:above"][0]["margin_m"] == "2"
        texts = spark.createDataFrame([("1:2:left_of", "It is left of it by 1.5 m."), ("3:4:above", "It is behind, 3 m away."), ("x", "?")], "question_id string, text string")
        assert {tuple(r) for r in C.text_faults(texts, sheets).collect()} == {("3:4:above", "unlisted_number", "3"), ("3:4:above", "unclaimed_direction", "behind"), ("x", "no_sheet", "")}
        exposed = spark.createDataFrame([("1:2:left_of", "v0"), ("1:2:left_of", "v1"), ("3:4:above", "v0")], "question_id string, view string")
        assert [tuple(r) for r in C.unexposed(sheets, exposed).collect()] == [("3:4:above", "v1")]
        hidden = {r["question_id"]: r["slots"] for r in C.blueprint(sheets, "{{margin_m}}", ("relation",)).collect()}
        assert "relation" not in hidden["3:4:above"] and hidden["3:4:above"]["distance_m"] == "10"

    def test_families(self, spark):
        from orrery.operators import claims as C

        f = spark.createDataFrame([("g", 1), ("g", 2), ("h", 3), (None, 4)], "g string, f long")
        assert sorted(map(tuple, C.related(f, "g", "f").collect())) == [(1, 2), (2, 1)]
        out = spark.createDataFrame([(2,), (4,)], "f long")
        assert sorted(r["f"] for r in C.excluded_families(f, out, "g", "f").collect()) == [1, 2, 4]
        q = spark.createDataFrame([("b", "a")], "x string, y string")
        p = spark.createDataFrame([("a", "b", "p2"), ("b", "a", "p1")], "x string, y string, proof string")
        assert C.linked_by_pair(q, p, "x", "y").first()["proof"] == "p1"
