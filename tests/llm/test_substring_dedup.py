from __future__ import annotations

import hashlib
import random

import pytest

from orrery.llm import substring_dedup as S

SCHEMA = "doc_id long, text string, bucket string, n_words string, data int"


def brute(rows, window=20):
    """Removed word flags of (id, text) rows: a window goes if one with its words starts at a smaller (id, start)."""
    first = {}
    big = S.LAST
    for i, t in rows:
        words = (t or "").encode().split()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            at = (big if i is None else i, s)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] != (big if i is None else i, s):
                gone[s : s + window] = [True] * window
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((i, len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "b", "x", 1) for i, t in rows], SCHEMA)


def check(spark, rows, chunk=None, monkeypatch=None):
    got = S.dedup_substrings(rows_of(spark, rows).repartition(3)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def corpus(seed, docs=60, vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(15, 70))] for _ in range(8)]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += [rng.choice(words) for _ in range(rng.randrange(0, 40))]
            p = rng.choice(passages)
            a = rng.randrange(0, 8)
            parts += p[a : len(p) - rng.randrange(0, 8)]
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    check(spark, corpus(seed))


def test_nulls_empties_repeats_and_ties(spark):
    long = " ".join(f"a{i % 37}" for i in range(6000))
    a = " ".join(f"q{i}" for i in range(45))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, a), (4, a), (4, "x " + a), (5, a), (None, a), (None, a), (7, long), (8, "one two"), (9, "same " * 50), (10, "é ü " * 30)]
    check(spark, rows)


def test_runs_of_one_word_and_copies(spark):
    check(spark, [(i, "spam " * (20 + i % 3)) for i in range(30)] + [(100 + i, " ".join(f"k{j}" for j in range(30))) for i in range(40)])


def test_clean_text_keeps_what_is_kept(spark):
    a = " ".join(f"q{i}" for i in range(30))
    rows = [(1, f"start\n{a}\nend"), (2, f"  other\n\n{a} tail\nlast  "), (3, "left  as\tit is\n"), (4, None)]
    got = {r["doc_id"]: r for r in S.dedup_substrings(rows_of(spark, rows)).collect()}
    assert got[1]["clean_text"] == rows[0][1]
    assert got[2]["clean_text"] == "  other\n\ntail\nlast  "
    assert got[2]["removed_spans"][0].asDict() == {"start": 1, "end": 31}
    assert got[3]["clean_text"] == rows[2][1] and got[4]["clean_text"] is None
    assert got[1]["bucket"] == "b" and got[1]["data"] == 1 and got[1]["n_words"] == 32


def test_stage_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a " * 50, 100, "own"), (2, "b c", 3, "own"), (3, None, None, "own")], "doc_id long, text string, n_chars long, clean_text string")
    out = {r["doc_id"]: r for r in S.substring_dedup_stage(docs).collect()}
    assert S.substring_dedup_stage(docs).columns == docs.columns and all(r["clean_text"] == "own" for r in out.values())
    assert out[2]["text"] == "b c" and out[2]["n_chars"] == 3 and out[3]["text"] is None
    assert len(out[1]["text"]) == out[1]["n_chars"] < 100
    assert S.dedup_substrings(rows_of(spark, [])).collect() == []


def test_packed_places():
    import numpy as np

    ids, tags, places = np.array([5, 5, -3, 5, -3, 5]), np.array([7, 7, 1, 7, 1, 8]), np.array([9, 8, 70_000, 1, 2, 10])
    got = S.unpack_places([S.pack_places(ids, tags, places), S.pack_places(ids[:1], tags[:1], places[:1])])
    rows = sorted(zip(*[x.tolist() for x in got], strict=True))
    assert rows == [(-3, 1, 2, 1), (-3, 1, 70_000, 1), (5, 7, 1, 1), (5, 7, 8, 2), (5, 7, 9, 1), (5, 8, 10, 1)]


def test_rows_of_one_id_keep_their_own_words(spark):
    """Texts of one id whose hashes agree in their low 16 bits, or low 32."""
    from pyspark.sql import functions as F

    shared = " ".join(f"s{i}" for i in range(40))
    texts = spark.range(60_000).select(F.concat(F.lit("u"), F.col("id"), *[F.lit(f" own{i}") for i in range(39)]).alias("text"))
    low = F.xxhash64("text").bitwiseAND(0xFFFF)
    # 300,000 texts hold pairs that share 32 bits
    bits = F.xxhash64("text").bitwiseAND(0xFFFFFFFF)
    many = spark.range(300_000).select(F.concat(F.lit("v"), F.col("id"), *[F.lit(f" pair{i}") for i in range(39)]).alias("text"))
    twins = [r["ts"] for r in many.groupBy(bits.alias("b")).agg(F.collect_list("text").alias("ts")).where("size(ts) > 1").limit(3).collect()]
    assert twins
    want = spark.createDataFrame([(shared,)], "text string").select(low).first()[0]
    same = [r["text"] for r in texts.where(low == want).limit(1).collect()]
    docs = spark.createDataFrame([(0, shared), (1, shared), *[(1, t) for t in same]], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in S.dedup_substrings(docs).collect())
    assert got == [(0, 0), *[(1, 0)] * len(same), (1, 40)]
    for a, b in twins:
        for i in (7, None):
            pair = spark.createDataFrame([(0, a), (i, a), (i, b.replace("pair", "own"))], "doc_id long, text string")
            kept = spark.createDataFrame([(0, a), (i, a), (i, b)], "doc_id long, text string")
            assert sorted(r["n_removed"] for r in S.dedup_substrings(pair).collect()) == [0, 0, 40]
            # b shares all words but the first with a
            assert sorted(r["n_removed"] for r in S.dedup_substrings(kept).collect()) == [0, 39, 40]
