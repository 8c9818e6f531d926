from __future__ import annotations

import random

import pytest

import corpus_pipeline as P
from orrery.llm import decontamination as D
from orrery.llm import toxicity as T
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_substring_dedup import brute as substring_brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with insults, near copies, a passage that several share, and benchmark items."""
    rng = random.Random(11)
    words = ["".join(rng.choice(("an", "er", "th", "in", "on", "re", "ed", "nd")) for _ in range(rng.randrange(2, 5))) for _ in range(2500)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    passage, items = say(60), [(j, " ".join(say(30))) for j in range(10)]
    docs, labels = [], []
    for i in range(240):
        text = say(rng.randrange(60, 220))
        if i % 8 == 1:
            for _ in range(4 + len(text) // 20):
                text.insert(rng.randrange(len(text)), rng.choice(("grobfool", "nitwitty", "dunderhead")))
            labels.append((i, 0, 1))
        else:
            labels.append((i, 1, 0))
        if i % 8 == 2:
            text[20:20] = passage
        if i % 24 == 3:
            text[10:10] = items[i // 24][1].split()
        docs.append((i, " ".join(text), "en", f"src{i % 4}", 0))
    for k in range(12):
        i, t = 8 * k + 4, docs[8 * k + 4][1]
        docs.append((1000 + k, t if k % 2 else t.replace(" ", " ", 1) + " extra", "en", "src0", 0))
    docs += [(2000, None, None, None, None), (2001, "", "en", "src1", 0)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s, _ in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before, counts = docs.columns, {}, {}
    for name, stage in P.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "mixing" or after.columns == columns
        before = {r["doc_id"]: r for r in docs.collect()}
        kept = {r["doc_id"]: r for r in after.collect()}
        counts[name] = (len(before), len(kept))
        if name == "toxicity":
            model = T.fit_on_labels(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            score = T.scorer(model)
            assert set(kept) == {i for i, r in before.items() if score((r["text"] or "").encode()) < 0.5}
            assert sum(1 for i in before if i < 240 and i % 8 == 1 and i not in kept) >= 27
        elif name == "near_dedup":
            assert set(kept) == near_brute([(i, r["text"]) for i, r in before.items()])
        elif name == "substring_dedup":
            want = {i: n - gone for i, n, gone, _ in substring_brute([(i, r["text"]) for i, r in before.items()])}
            assert {i: len((r["text"] or "").encode().split()) for i, r in kept.items()} == want
            assert all(r["text"] == before[i]["text"] for i, r in kept.items() if want[i] == len((before[i]["text"] or "").encode().split()))
        elif name == "decontamination":
            items = [D.word_hashes(r["text"].encode()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            for i, r in before.items():
                hashes = D.word_hashes((r["text"] or "").encode())
                held = any(D.check(h, h[-D.ANSWER_WORDS :], hashes, w) for h in items for w in range(max(1, -(-len(hashes) // D.BLOCK))))
                assert (i in kept) != held
        else:
            assert all(r["copies"] in (1, 2) and r["text"] == before[i]["text"] and r["taken"] == r["copies"] * r["size"] for i, r in kept.items())
        docs = after
    assert all(0 < b <= a for a, b in counts.values()) and counts["near_dedup"][1] < counts["near_dedup"][0]


def test_run_gives_the_last_stage(spark, folder):
    out = P.run(spark, folder)
    assert {"doc_id", "text", "copies"} <= set(out.columns) and out.count() > 0
