from __future__ import annotations

import hashlib
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.functions import ids
from orrery.functions import text as T


def value(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


def test_wrap(spark):
    assert value(spark, *[G.wrap_degrees(c) for c in lit(0, 180, 270, -181)]) == (0, -180, -90, 179)
    assert value(spark, G.angular_separation(*lit(350, 20)), G.circular_delta(*lit(10, 350))) == (30, 20)


def test_direction(spark):
    d = value(spark, G.direction(*lit(0, 2, 0, 0, 0, 0)))
    assert d["label"] == "front" and d["front_m"] == 2
    d = value(spark, G.direction(*lit(0, 2, 0, 0, -math.pi / 2, 0)))
    assert d["label"] == "left" and d["right_m"] == pytest.approx(-2) and d["front_m"] == pytest.approx(0, abs=1e-9)
    plain = value(spark, G.direction(*lit(1, 2, 0, 0, 0, 0)))
    wide = value(spark, G.direction(*lit(1, 2, 0, 0, 0), G.obb_radius(*lit(1, 1))))
    assert plain["label"] == wide["label"] and wide["effective_margin_deg"] < plain["effective_margin_deg"]


def test_direction_does_not_change_with_the_world(spark):
    rng = random.Random(1)
    for _ in range(5):
        px, py, ox, oy, yaw = (rng.uniform(-3, 3) for _ in range(5))
        a = value(spark, G.direction(*lit(px, py, ox, oy, yaw, 0.2)))
        b = value(spark, G.direction(*lit(-py, px, -oy, ox, yaw + math.pi / 2, 0.2)))
        assert a["label"] == b["label"] and a["bearing_deg"] == pytest.approx(b["bearing_deg"])


def test_rotations(spark):
    q = G.yaw_pitch_quaternion(*lit(40, 25))
    v = G.vec(*lit(0.3, -1, 2))
    m = value(spark, G.bind(q, G.quat_matrix))
    turned = G.bind(q, lambda p: G.quat_rotate(p, v))
    there = G.bind(q, lambda p: G.bind(G.quat_rotate(p, v), lambda u: G.quat_rotate(G.quat_conjugate(p), u)))
    turned, back = value(spark, turned, there)
    assert tuple(turned) == pytest.approx([sum(m[i][k] * x for k, x in enumerate((0.3, -1, 2))) for i in range(3)])
    assert tuple(back) == pytest.approx((0.3, -1, 2))
    assert value(spark, G.bind(q, lambda p: G.quat_angle_deg(p, p))) == pytest.approx(0, abs=1e-5)
    assert value(spark, G.yaw_of(G.yaw_quaternion(F.lit(0.7)))) == pytest.approx(0.7)
    with pytest.raises(Exception, match="zero quaternion"):
        value(spark, G.quat_normalize(G.quat(*lit(0, 0, 0, 0))))


def test_transforms(spark):
    t = F.struct(F.lit("w").alias("parent"), F.lit("a").alias("child"), G.vec(*lit(1, 2, 3)).alias("translation"), G.yaw_quaternion(F.lit(0.4)).alias("rotation"))
    p = G.vec(*lit(0.5, -2, 1))
    there = G.transform_apply(G.transform_inverse(t), G.transform_apply(t, p))
    same = G.transform_compose(t, G.transform_inverse(t))
    got, whole = value(spark, there, same)
    assert tuple(got) == pytest.approx((0.5, -2, 1)) and tuple(whole["translation"]) == pytest.approx((0, 0, 0), abs=1e-9)
    with pytest.raises(Exception, match="frames do not meet"):
        value(spark, G.transform_compose(t, t))


def test_facing_and_relations(spark):
    assert value(spark, G.yaw_facing(*lit(0, 0, 0, 5))) == pytest.approx(0)
    with pytest.raises(Exception, match="coincident"):
        value(spark, G.yaw_facing(*lit(1, 1, 1, 1)))
    assert value(spark, G.is_dominant(*lit(1.25, 1)), G.is_dominant(*lit(1.2, 1)), G.is_dominant(*lit(1, 0))) == (True, False, True)
    assert value(spark, G.vertical_relation(*lit(2, 0.5, 1, 0.3)), G.vertical_relation(*lit(1, 0.3, 2, 0.5)), G.vertical_relation(*lit(1, 1, 1, 1))) == ("above", "below", None)
    assert value(spark, G.bearing_phrase(F.lit(44.0)), G.bearing_phrase(F.lit(-178.0))) == ("ahead right", "behind")


def test_bins_round_halves_to_even(spark):
    xs = (0.5, 1.5, 2.5, -0.5, -1.5)
    assert value(spark, *[G.quantize(c, 1.0) for c in lit(*xs)]) == tuple(round(x) for x in xs)


def test_lists(spark):
    a = F.array(*map(F.lit, "abcd"))
    assert value(spark, G.rotate_list(a, F.lit(1)), G.rotate_list(a, F.lit(6)), G.rotate_list(F.array().cast("array<string>"), F.lit(2))) == (list("bcda"), list("cdab"), [])
    assert value(spark, G.aspect_distance(F.array(*lit(1, 2, 4)), F.array(*lit(2, 4, 8)))) == pytest.approx(0)


def test_ids(spark):
    sep = "\x1f"
    assert value(spark, ids.stable_id("ns", F.lit("a"), F.lit(3))) == "ns-" + hashlib.sha256(sep.join(("ns", "a", "3")).encode()).hexdigest()[:20]
    assert value(spark, ids.prefixed_id("ns", F.lit("a"))) == "ns-" + hashlib.sha256(b"a").hexdigest()[:20]
    for name in ("scene:x", "é", ""):
        assert value(spark, ids.uuid5(uuid.NAMESPACE_URL, F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert value(spark, ids.view_number(F.lit("view-004"))) == 5
    assert value(spark, ids.canonical_json(F.lit('{"b": 1, "a": [2, null]}'))) == '{"a":[2,null],"b":1}'
    with pytest.raises(Exception, match="null"):
        value(spark, ids.stable_id("ns", F.lit(None)))


ANSWERS = [
    ("egocentric_relation", "餐桌在书架右侧。", ("right_of", None, None)),
    ("egocentric_relation", "左前方", None),
    ("egocentric_relation", "在左侧，不，实际上在右侧。", ("right_of", None, None)),
    ("egocentric_relation", '```json\n{"relation": "behind"}\n```', ("behind", None, None)),
    ("egocentric_relation", "", None),
    ("counterfactual_verification", "不对；实际在前方。", ("in_front_of", False, None)),
    ("counterfactual_verification", "对。", None),
    ("counterfactual_verification", '{"claim_correct": true, "relation": "left_of"}', ("left_of", True, None)),
    ("evidence_presence_unknown", "证据不足，还不能确定。", (None, None, None)),
    ("evidence_presence_unknown", "没有看到。", None),
    ("evidence_presence_unknown", "null", (None, None, None)),
    ("evidence_presence_reveal", "能确定，画面中能看到钢琴。", (None, None, None)),
    ("evidence_presence_reveal", "不存在。", None),
    ("target_view_prediction", "看不到。", (None, None, False)),
    ("target_view_prediction", "能看到", (None, None, True)),
    ("target_view_prediction", "最终答案：false", (None, None, False)),
    ("target_view_prediction", "无法确定", None),
    ("no_such_task", "看不到。", None),
]


def test_answers(spark):
    df = spark.createDataFrame([(i, t, a) for i, (t, a, _) in enumerate(ANSWERS)], "i int, task string, said string")
    got = {r["i"]: r["p"] for r in df.select("i", T.parse_answer(F.col("task"), F.col("said"), F.lit("钢琴")).alias("p")).collect()}
    for i, (task, said, want) in enumerate(ANSWERS):
        p = got[i]
        assert p["parsed"] == (want is not None), (task, said)
        if want:
            assert (p["relation"], p["claim_correct"], p["visible"]) == want, (task, said)
    assert got[8]["is_null"] and got[11]["category"] == "钢琴" and not got[13]["is_null"]


def test_choices(spark):
    choices = F.array(*map(F.lit, ("red box", "blue box")))
    for said, want in (("<answer>a</answer> then <answer>C</answer>", "C"), ("Answer: B.", "B"), ("well\nD. left", "D"), ("it is the blue box", "B"), ("A cat", None), ("", None), ("red box or blue box", None)):
        assert value(spark, T.choice(F.lit(said), choices)) == want, said


def test_ngrams(spark):
    of = lambda s: T.ngrams(F.lit(s))
    assert sorted(value(spark, of("abcdeabcde"))) == sorted({"abcd", "bcde", "cdea", "deab", "eabc"})
    assert value(spark, of("abc"), of("")) == (["abc"], [])
    assert value(spark, T.dice(of("abcde"), of("abcdf"))) == 0.5 and value(spark, T.dice(of(""), of(""))) == 1.0


def test_templates_and_leaks(spark):
    t = F.lit("{{a}} and {{b}}")
    assert value(spark, T.rendered(t, {"a": F.lit("x"), "b": F.lit("y")}), T.rendered(F.lit("{{a}} {{a}}"), {"a": F.lit("x")})) == ("x and y", None)
    assert value(spark, T.leaks(F.lit('{"text": "the Scene_IR says"}')), T.leaks(F.lit('{"text": "target"}')), T.leaks(F.lit("123e4567-e89b-12d3-a456-426614174000"))) == (True, False, True)
    keys = lambda s: value(spark, T.answer_keys(F.lit(s)))
    assert keys('{"a": [{"Expected Answer": {"x": "answer"}}], "claim_sheet_id": 1, "claiming": ":", "q": "\\"oracle\\": 1"}') == ["Expected Answer", "claim_sheet_id"]
    pointer = value(spark, T.lfs_pointer(F.lit("version https://x/v1\noid sha256:" + "a" * 64 + "\nsize 12\n")))
    assert pointer["size"] == 12 and value(spark, T.lfs_pointer(F.lit("no")))["oid"] is None
    assert value(spark, ids.redact_paths(F.lit("at /home/me/x/file.py, fine"))) == "at <path>/file.py, fine"


def test_structured_equality(spark):
    from orrery.functions import structs

    rows = [
        ('{"a": 1.0}', '{"a": 1.0000001}', True), ('{"a": true}', '{"a": 1}', False), ("[1, 2]", "[2, 1]", False), ("null", "null", True), ("null", "false", False),
        ("NaN", "NaN", False), ('"x"', '"x"', True), ("not json", "not json", False), (None, None, False), ('{"a": {"b": [1]}}', '{"a": {"b": [1]}}', True), ('{"a": 1}', '{"a": 1, "b": 2}', False),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string").coalesce(1)
    got = [r[0] for r in df.select(structs.structured_equal(F.col("a"), F.col("b"), F.lit(1e-6))).collect()]
    assert got == [w for _, _, w in rows]
    assert value(spark, *[structs.tolerance_of(c) for c in (F.lit(0.2), F.lit(-1.0), F.lit(float("nan")), F.lit(None).cast("double"))]) == (0.2, 1e-6, 1e-6, 1e-6)


def test_json_walks_and_schemas(spark):
    from orrery.functions import structs

    text = F.lit('{"a": ["x", {"ratio": 2}], "ratio": 1.5, "b": true}')
    found, ratios = value(spark, structs.strings(text), structs.numbers_under(text, "ratio"))
    assert [(r["path"], r["text"]) for r in found] == [("$.a[0]", "x")] and sorted(ratios) == [1.5, 2.0]
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"enum": ["p"]}}}}
    assert structs.schema_errors({"a": 1, "b": ["p"]}, schema) == []
    assert len(structs.schema_errors({"a": True, "b": ["q"], "c": 1}, schema)) == 3 and structs.schema_errors({}, schema) == ["$.a: missing"]
    assert value(spark, structs.schema_faults(F.lit('{"a": -1}'), schema)) == ["$.a: out of bounds"]
    assert structs.merged({"a": {"b": 1}, "c": 2}, {"a": {"b": 3}}) == {"a": {"b": 3}, "c": 2}
    with pytest.raises(KeyError, match="a.z"):
        structs.merged({"a": {"b": 1}}, {"a": {"z": 1}})
    good, bad = value(spark, structs.reviewed_at(F.lit("2024-01-02T03:04:05Z")), structs.reviewed_at(F.lit("2024-01-02T03:04:05")))
    assert good is not None and bad is None


def test_words_numbers_and_turns(spark):
    assert value(spark, T.lexicon_hits(F.lit("A wall_lamp, wall and Floor."), ("wall", "floor", "lamp"))) == ["floor", "wall"]
    assert value(spark, T.unlisted_numbers(F.lit("2 chairs, 3.5 m, v2"), F.array(F.lit("2")))) == ["3.5"]
    assert value(spark, T.directions_in(F.lit("front left of it, then behind"))) == ["front left", "behind"]
    assert value(spark, *[T.turn_phrase(c) for c in lit(90, -45, 180, 1)]) == ("turn right by 90 degrees", "turn left by 45 degrees", "turn around", "keep facing ahead")
    assert value(spark, T.choice_labels(F.lit("Where?\nA. front\nB. left \n"))) == {"A": "front", "B": "left"}
