from __future__ import annotations

import itertools
import random

import numpy as np

import corpus_pipeline as P
from orrery.llm import near_dedup as N
from tests.llm.test_simhash import brute as simhash_brute


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    """Ids that stay: the smallest of each component over pairs of a Jaccard similarity of 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        same = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
        if same and root[i] != root[j]:
            old = root[j]
            root = [root[i] if r == old else r for r in root]
    return {min(rows[m][0] for m in range(len(rows)) if root[m] == root[k]) for k in range(len(rows))}


def edited(seed=1, bases=25, copies=6, most=8):
    rng = random.Random(seed)
    words = [f"W{i}é" for i in range(400)]
    rows = []
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(rng.randrange(120, 300))]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(0, most)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    return rows + [(9000, None), (9001, ""), (9002, "one two"), (9003, "ONE  two"), (9004, "one two three four five"), (9005, rows[0][1].upper())]


def test_pipeline_drops_edited_copies(spark):
    rows = edited()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(0, rows[0][1], 1)], "doc_id long, text string, node int")
    kept = sorted(r["doc_id"] for r in dict(P.STAGES)["near_dedup"](spark, docs, "").collect())
    assert kept == sorted(brute(rows))
    # fingerprints within two bits let many of them stay
    assert len({c for _, _, c in simhash_brute(rows)}) > 1.3 * len(kept)


def test_links_connect_the_same_as_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.permutation(4000)
    for size in (60, 100, 140):
        sets = [np.unique(np.concatenate([base[:size][rng.random(size) > rng.choice((0.03, 0.12, 0.2))], rng.integers(5000, 9000, rng.integers(0, 12))])) for _ in range(80)]
        left, right = N.similar(sets)
        assert all(5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b])) for a, b in zip(left, right, strict=True))
        pairs = [(a, b) for a, b in itertools.combinations(range(80), 2) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
        every = N.forest(80, *(np.array([p[k] for p in pairs], np.int64) for k in (0, 1)))
        assert N.forest(80, left, right).tolist() == every.tolist() and 1 < len(set(every.tolist())) < 80


def test_pairs_at_the_limit_share_a_key():
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(1000):
        x = rng.integers(0, 1 << 63, 110).astype(np.uint64)
        a, b = N.band_keys([np.sort(x[:99]), np.sort(x[11:])])  # 88 of 110
        missed += not (a == b).any()
    assert missed <= 2


def test_empty_table(spark):
    assert N.near_dedup_stage(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_fingerprints_find_what_shares_no_key(spark, monkeypatch):
    """Copies are found by the fingerprints of op8 where no key is shared, and are still checked exactly."""
    rows = edited(seed=3, most=3)
    same = [" ".join(f"x{i}" for i in range(40)) + end for end in (" last", " ends", " last last")]
    rows += [(7000 + i, t) for i, t in enumerate(same)]
    monkeypatch.setattr(N, "_keyed", lambda buckets: lambda batches: iter(()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = {k: c for k, _, c in simhash_brute(rows)}
    kept = {r["doc_id"] for r in N.near_dedup_stage(docs).collect()}
    sets = {k: shingles(t) for k, t in rows}
    close = [(a, b) for a, b in itertools.combinations(sets, 2) if of[a] == of[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    different = [(a, b) for a, b in close if sets[a] != sets[b]]
    assert len(different) > 10 and all(b not in kept for _, b in close)
    assert all(k in kept for k in brute(rows))
