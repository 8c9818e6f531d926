from __future__ import annotations

import itertools
import random

from orrery import catalogue
from orrery.operators import relations as R

BOX = "entity_id long, region long, x double, y double, z double, hx double, hy double, hz double"


def test_flip_moves_try_both_objects_and_see_large_obstacles(spark):
    small = lambda i, r, x, y: (i, r, x, y, 0.0, 0.1, 0.1, 0.1)
    rows = [
        small(1, 0, 0.0, 0.0), small(2, 0, 2.0, 0.5), (3, 0, 30.0, 0.5, 0.0, 26.5, 0.2, 1.0),  # the large box reaches x = 3.5
        small(4, 1, 0.0, 0.0), small(5, 1, 0.2, 2.0),
    ]
    got = {(r["target"], r["anchor"]): (r["relation"], r["new_relation"], r["new_x"], r["new_y"]) for r in R.flip_moves(spark.createDataFrame(rows, BOX)).collect()}
    assert got == {
        (1, 2): ("left_of", "right_of", 4.0, 0.0),
        (2, 1): ("right_of", "left_of", -2.0, 0.5),
        (4, 5): ("behind", "in_front_of", 0.0, 4.0),
        (5, 4): ("in_front_of", "behind", 0.2, -2.0),
    }
    rows[2] = (3, 0, 30.0, 0.0, 0.0, 26.5, 0.2, 1.0)
    got = {(r["target"], r["anchor"]) for r in R.flip_moves(spark.createDataFrame(rows, BOX)).collect()}
    assert got == {(2, 1), (4, 5), (5, 4)}


def test_greedy_pairs_reach_every_region(spark, tmp_path):
    rows = [(2 * r + k, r, [0.1 * k + 0.0001 * r, 0.0, 0.0, 0.01, 0.01, 0.01]) for r in range(700) for k in range(2)]
    # in one more region the clearest pairs come first
    rows += [(5000 + k, 900, [0.03 * k * k, 0.0, 0.0, 0.001, 0.001, 0.001]) for k in range(4)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.queries()["greedy_unique_pairs"](spark, str(tmp_path)).collect()
    assert {r["region"] for r in got} == {*range(700), 900}
    # gaps: 0-1 0.3, 0-2 1.2, 0-3 2.7, 1-2 0.9, 1-3 2.4, 2-3 1.5
    clear = sorted(round(r["margin"], 3) for r in got if r["region"] == 900)
    assert clear == [1.2, 1.5, 2.4, 2.7]


def test_near_duplicate_turns_against_all_pairs(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    rows = []
    for c in range(12):
        base = [rng.choice(words) for _ in range(60)]
        for t in range(4):
            copy = list(base)
            for _ in range(2 * t):
                copy[rng.randrange(60)] = rng.choice(words)
            rows.append((c, t, " ".join(copy)))
    rows += [(50, 0, rows[0][2]), (51, 0, None), (52, 0, "")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["a"], r["b"]) for r in catalogue.queries()["near_duplicate_turns"](spark, str(tmp_path)).collect()}
    grams = {}
    for c, t, text in rows:
        if text and (len(text) > 0) and not any(text == o for o, _ in grams.values()):
            grams[f"{c}:{t}"] = (text, {text[i : i + 4] for i in range(len(text) - 3)})
    want = {(a, b) for a, b in itertools.combinations(sorted(grams), 2) if 2 * len(grams[a][1] & grams[b][1]) >= 0.85 * (len(grams[a][1]) + len(grams[b][1]))}
    assert got == want and 10 < len(want)
