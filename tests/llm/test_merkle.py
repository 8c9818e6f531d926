from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from orrery.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def proof(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 3 * 3
        out.append((level[first:i], level[i + 1 : first + 3]))
        i //= 3
    return out


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text), one source after another, hashing every path anew."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, levels_of([leaf(r) for r in own])))
    top = levels_of([t[1][-1][0] for t in trees])
    out = []
    for k, (own, levels) in enumerate(trees):
        above = proof(top, k)
        for i, row in enumerate(own):
            steps = proof(levels, i) + above
            even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            digest = leaf((*row[:4], row[4].replace("\n", "") if even and row[4] is not None else row[4]))
            for left, right in steps:
                digest = H(*left, digest, *right)
            out.append((row[0], leaf(row), levels[-1][0], top[-1][0], H(*[x for left, right in steps for x in left + right]), digest, digest == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def got(docs):
    return sorted(map(tuple, merkle.digests(merkle.manifest(docs, changed=merkle.without_line_ends)).collect()), key=repr)


def test_edges(spark):
    rows = [(i, "a", "en", i, f"line\n{i}") for i in range(11)]
    rows += [(None, None, None, None, None), (None, None, None, None, "x\n"), (5, "", "", 0, ""), (5, "", "", 0, ""), (5, "", "", 0, "a\nb"), (-3, "é", "fr", 9, "long\ntext " * 200_000), (1, "v", "n", 1, "-"), (2, "v", "n", None, "é\n")]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("own").alias(n) for n in ("TEXT", "tree", "pos", "digest", "c0", "Leaf")])
    assert got(docs) == brute(rows)
    assert {r[6] for r in got(docs)} == {True, False}


def test_one_row_and_none(spark):
    for rows in ([(4, "s", "en", 3, "a\nb")], []):
        assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows) if rows else got(spark.createDataFrame(rows, SCHEMA)) == []


def test_whole_blocks_and_many_sources(spark):
    """More leaves and more sources than a block holds, ids in no order, one id a third of the rows."""
    rows = [(i * 7919 % 7000, "hot", "en", i, f"t\n{i}") for i in range(6561)] + [(77, "one", "en", 1, f"{i % 3}") for i in range(2500)] + [(i, f"s{i}", "de", i, "x") for i in range(2300)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(7)) == brute(rows)


def test_proofs_fold_by_hand(spark):
    rows = [(i, f"s{i % 4}", "en", i, f"t{i}") for i in range(100)]
    proofs = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in proofs:
        digest = r["leaf"]
        for left, right in zip(r["lefts"], r["rights"], strict=True):
            digest = H(left, digest, right)
        assert digest == r["root"] == r["folded_root"] and r["verified"]


def test_folding_hashes_nothing_to_the_left(monkeypatch):
    parent = merkle.Parent([b"a" * 64, b"b" * 64, b"c" * 64])
    assert parent.fold(1, b"x" * 64).decode() == H("a" * 64, "x" * 64, "c" * 64)
    parent.kids[0] = b"no longer read"
    assert parent.fold(1, b"x" * 64).decode() == H("a" * 64, "x" * 64, "c" * 64)
    assert parent.siblings(2) == (b"no longer read" + b"b" * 64, b"")
