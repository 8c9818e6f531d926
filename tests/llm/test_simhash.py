from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash

from orrery.llm import simhash as S


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2 and root[i] != root[j]:
            old = root[j]
            root = [root[i] if r == old else r for r in root]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root[m] == root[k] and rows[m][0] is not None]
        out.append((i, f"{prints[k]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def texts(seed=1):
    rng = random.Random(seed)
    words = [f"W{i}é" for i in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(150, 400))]
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    return rows


def test_equals_brute_force(spark):
    rows = texts() + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "one two"), (905, "ONE two"), (905, "ONE two"), (None, None), (None, "lonely words here"), (906, "x " * 3000)]
    docs = spark.createDataFrame([(i, t, "z", 3) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = S.near_groups(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_golay_words_near_each_other_share_an_index():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.randrange(1 << 23)
        b = a
        for bit in rng.sample(range(23), rng.randrange(3)):
            b ^= 1 << bit
        of = lambda w: set(S.golay_indices(np.array([w]))[1].tolist())
        assert of(a) & of(b)
    assert all(w.bit_count() <= 3 for w in S.golay_tables()[1][:, 0].tolist())


def test_prints_within_two_bits_share_a_key():
    rng = random.Random(3)
    for _ in range(200):
        a = rng.randrange(1 << 64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(3)):
            b ^= 1 << bit
        of = lambda w: set(S.fingerprint_keys(np.array([w], np.uint64))[1].tolist())
        assert of(a) & of(b)


def test_large_groups_are_linked_through_words_between(monkeypatch):
    rng = random.Random(4)
    base = rng.randrange(1 << 63)
    prints = {base}
    for _ in range(400):
        p = rng.choice(sorted(prints))
        prints.add(p ^ 1 << rng.randrange(43) ^ (1 << rng.randrange(43)))
    nodes = np.array(sorted(prints), np.int64)
    owner, keys = S.fingerprint_keys(nodes.view(np.uint64))
    table = pa.table({"data": [S.pack(keys, nodes[owner])]})
    few = S._linked(table).to_pydict()
    monkeypatch.setattr(S, "PAIRWISE", 1)
    monkeypatch.setattr(S, "BETWEEN", 500)
    assert S._linked(table).to_pydict() == few


def test_stage_keeps_one_of_each_group(spark):
    rows = texts(5)
    docs = spark.createDataFrame(rows + rows[:3] + [(None, "null id text alone " * 5)], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in S.near_dedup_stage(docs).collect() if r["doc_id"] is not None)
    assert kept == sorted({c for _, _, c in brute(rows)})


def test_empty_table(spark):
    assert S.near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
