"""Contracts of answers, targets, exports and schedules, on small cases with their edges."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import ids, structs
from orrery.functions import text as T
from orrery.operators import audit as A
from orrery.operators import evaluation as E
from orrery.operators import relations as R
from orrery.operators import release as L
from orrery.operators import sampling as S
from orrery.operators import schedule as C


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_the_last_answer_tag_decides_the_direction_and_the_trace_never_does(spark):
    said = ["<cue>左侧</cue><answer>前方</answer>", "左侧\n右侧 ", "<answer>左侧</answer><answer>后方</answer> 前方", "左侧\n不知道", "", None]
    assert values(spark, [(x,) for x in said], "s string", T.direction_label(F.col("s"))) == ["front", "right", "back", None, None, None]


def test_a_response_of_words_against_its_option_is_inconsistent(spark):
    q = "哪里？A. 前方 B.右侧 C. 后方 D. 左侧"
    rows = [("<answer>A. 右侧</answer>", q), ("<answer>A</answer>", q), ("", q), (None, q), ("<answer>A</answer>", "没有选项")]
    out = values(spark, rows, "r string, q string", T.response_score(F.col("r"), F.col("q"), F.lit("A"), F.lit("front")))
    assert [(x["prediction"], x["semantic_label"], x["correct"], x["semantic_correct"], x["option_text_consistent"]) for x in out] == [
        ("A", "right", True, False, False), ("A", "front", True, True, None), (None, None, False, False, None), (None, None, False, False, None), ("A", None, True, False, None),
    ]


def test_unknown_answers_deny_nothing(spark):
    said = ["不代表不存在，但无法确定。", "灯不存在，无法确定。", "房间里没有灯，证据不足", "房间里没有看到灯，证据不足", "房间里有没有灯无法判断", "也许"]
    assert values(spark, [(x,) for x in said], "s string", T.unknown_faults(F.col("s"))) == [[], ["existence_denied"], ["scene_absence"], [], [], ["no_uncertainty"]]


def test_a_longer_name_is_no_anchor_of_a_shorter_one(spark):
    rows = [("第4个视角里看到的床头柜", "床"), ("第4个视角里看到的床头柜", "床头柜"), ("第4个视角里看到的床头柜和第4个视角里看到的床", "床"), ("床", "床"), ("第4个视角里看到的a.b", "axb"), (None, "床")]
    found = T.surface_anchored(F.col("q"), F.array(F.lit("第4个视角里看到的")), F.col("n"), F.array(F.lit("床"), F.lit("床头柜"), F.lit("a.b")))
    assert values(spark, rows, "q string, n string", found) == [False, True, True, False, False, None]
    assert values(spark, [("见床", "床")], "q string, n string", T.surface_anchored(F.col("q"), F.array().cast("array<string>"), F.col("n"), F.array(F.col("n")))) == [False]


def test_fields_open_objects_and_keep_lists(spark):
    texts = ['{"b": {"y": [1, {"a": 2}], "x": null}, "a": {}}', "[1]", "3", "no json", None, "{}"]
    got = [[(f["path"], f["value"]) for f in x] for x in values(spark, [(t,) for t in texts], "t string", structs.fields(F.col("t")))]
    assert got == [[("value.a", "{}"), ("value.b.x", "null"), ("value.b.y", '[1,{"a":2}]')], [("value", "[1]")], [("value", "3")], [], [], [("value", "{}")]]


def test_a_status_is_json_and_a_null_one_counts(spark):
    rows = spark.createDataFrame([("k", 'a"b', "1"), ("k", None, None)], "k string, s string, v string")
    got = {(r["path"], r["value"]): r["n"] for r in A.field_marginals(rows, ["k"], "s", "v").collect()}
    assert got == {("status", '"a\\"b"'): 1, ("status", "null"): 1, ("value", "1"): 1}


def test_digests_do_not_depend_on_order(spark):
    a, b = values(spark, [(['{"a": 1, "b": 2}', "3"],), (["3", '{"b":2,"a":1}'],)], "s array<string>", ids.set_digest(F.col("s")))
    assert a == b
    x, y = values(spark, [('{"a": 1, "b": 2}',), ('{"b": 2, "a": 1}',)], "s string", ids.semantic_digest(F.col("s")))
    assert x == y


def brute_layout(facts, most=3, per=2):
    named, subjects, relations, out = set(), set(), [], []
    for m, s, r, l in sorted((-m, s, r, l) for s, r, l, m in facts if m >= 0.5):
        if s in subjects or (s in named and r in named) or relations.count(l) >= per or len(out) == most:
            continue
        out.append((s, r, l, -m))
        named |= {s, r}
        subjects.add(s)
        relations.append(l)
    return out if len(out) >= 2 else []


def test_layout_facts_equal_a_loop_over_the_ordered_facts(spark):
    draw = random.Random(5)
    rows = [(scene, *pair, draw.choice(["left_of", "behind"]), draw.choice([0.4, 0.5, 0.7, 0.9])) for scene in [*range(40), None] for pair in {tuple(sorted(draw.sample("abcdef", 2))) for _ in range(draw.randrange(9))}]
    df = spark.createDataFrame(rows, "scene int, subject string, reference string, relation string, margin double")
    got = {}
    for r in df.transform(S.layout_facts, "scene").orderBy("scene", "place").collect():
        got.setdefault(r["scene"], []).append((r["subject"], r["reference"], r["relation"], r["margin"]))
    want = {scene: f for scene in {r[0] for r in rows} if (f := brute_layout([r[1:] for r in rows if r[0] == scene]))}
    assert got == want
    assert S.layout_facts(df.limit(0), "scene").count() == 0


def test_partitions_without_a_whole_target_have_no_accuracy(spark):
    rows = spark.createDataFrame([("a", None, 1, "x"), ("b", "s", 1, "x"), ("b", "s", 1, "x"), ("b", "s", 1, "y"), (None, "s", 1, "x")], "p string, split string, task int, target string")
    got = {r["p"]: (r["n_records"], r["n_valid"], r["no_split"], r["n_majority"], r["majority_accuracy"]) for r in A.partition_targets(rows, "p", "split", "task", "target").collect()}
    assert got == {"a": (1, 0, 1, 0, None), "b": (3, 3, 0, 2, 2 / 3), None: (1, 1, 0, 1, 1.0)}


def test_an_endpoint_without_rows_is_null(spark):
    rows = spark.createDataFrame([(c, c % 2 == 0, True) for c in range(20)], "c long, a boolean, b boolean")
    got = {r["endpoint"]: r["mean"] for r in E.bootstrap_endpoints(rows, "c", F.col("a"), F.col("b"), {"all": F.lit(True), "none": F.lit(False)}).collect()}
    assert got["none"] is None and got["all"] == pytest.approx(0.5, abs=0.05)


def test_spans_without_a_message_and_messages_without_a_span(spark):
    messages = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 3, "assistant", None)], "record_id int, message_index int, role string, text string")
    sha = F.sha2(F.lit("a"), 256)
    spans = spark.createDataFrame([(1, 0, "t0"), (1, 1, "t1"), (1, 9, None)], "record_id int, message_index int, turn_id string").select("*", sha.alias("answer_sha256"), F.lit(True).alias("supervise_eos"))
    got = {r["message_index"]: r["faults"] for r in C.span_faults(spans, messages).collect()}
    assert got == {0: ["not_assistant"], 3: ["no_span"], 9: ["not_assistant", "turn_id"]}


def test_a_prompt_that_tells_its_answer_is_an_error(spark):
    row = (1, 1, 1, "canonical", None, "p", "train", ["v"], "the oracle says left", "string", None)
    rows = spark.createDataFrame([row], "scene_id int, episode_id int, fact_id int, family_variant string, consistency_group string, program_id string, split string, view_ids array<string>, question string, answer_kind string, tolerance double")
    with pytest.raises(Exception, match="tells its answer"):
        L.rlvr_records(rows, "s").collect()
    good = L.rlvr_records(rows.withColumn("question", F.lit("where?")), "s").collect()
    assert good[0]["family_id"].startswith("family-") and json.loads(json.dumps(good[0]["prompt"][1]["content"][-1].asDict()))["text"] == "where?"


def test_an_arm_that_is_not_known_is_an_error(spark):
    with pytest.raises(ValueError):
        L.sft_records(spark.range(1), "both")


def test_layouts_of_regions_equal_those_of_all_their_relations(spark):
    draw = random.Random(8)
    spot = lambda s: [round(draw.uniform(-s, s), 1) for _ in "xyz"]
    sizes = ((None, 30, 2.0), (1, 60, 3.0), (2, 3, 1.0), (3, 1, 1.0), (4, 25, 0.4), (5, 12, 6.0))
    rows = [(region, *at) for region, n, s in sizes for at in [spot(s) for _ in range(n)]]
    # many copies of a few places, with ids before and after one another
    rows += [(6, *at) for at in ([0.0, 0.0, 0.0], [4.0, 0.1, 0.0], [0.0, 0.0, -3.0]) for _ in range(15)] + [(7, 0.0, 0.0, 0.0)] + [(7, 4.4, 0.0, 0.0)] * 40
    ids = draw.sample(range(1000), len(rows))
    df = spark.createDataFrame([(i, *r, 1.0, 1.0, draw.choice([1.0, 1.0, 1.0, 3.0])) for i, r in zip(ids, rows, strict=True)], "entity_id long, region int, x double, y double, z double, hx double, hy double, hz double")
    every = R.relation_candidates(df, per_relation=None, keep=("region",)).where("subject < reference").withColumn("margin", F.round("margin", 9))
    told = lambda out: sorted((str(r["region"]), *r[1:]) for r in out.select("region", "place", "subject", "reference", "relation", "margin").collect())
    assert told(S.relation_layouts(df)) == told(S.layout_facts(every, "region"))
    assert S.relation_layouts(df.limit(0)).count() == 0


def test_draws_of_a_cluster_are_those_of_the_plain_hash():
    r = np.arange(400, dtype=np.int64)
    for h in (0, 1, 12_345, E._PRIME - 1):
        x = (h + r * 69_621 + 1) % E._PRIME
        for shift, factor in E._STEPS:
            x = ((x ^ x >> shift) * factor) % E._PRIME
        want = np.searchsorted(E._POISSON, x / E._PRIME, side="right")
        got = E._times(h, ((r * 69_621 + 1) % E._PRIME).astype(np.uint32), [np.uint32(x) for x in E._thresholds()])
        assert got.tolist() == want.tolist()
