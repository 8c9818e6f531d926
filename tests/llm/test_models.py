from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from orrery.llm import decontamination as D
from orrery.llm import toxicity as T


class TestToxicity:
    def corpus(self, n=400, seed=1):
        rng = random.Random(seed)
        parts = ["an", "er", "th", "in", "on", "re", "ed", "nd", "ha", "en", "of", "es"]
        words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(800)]
        bad = ["grobfool", "nitwitty", "dunderhead", "blockheads"]
        rows = []
        for i in range(n):
            y = int(i % 4 == 0)
            text = [rng.choice(words) for _ in range(rng.randrange(40, 160))]
            if y:
                for _ in range(4 + len(text) // 25):
                    text.insert(rng.randrange(len(text)), rng.choice(bad))
            rows.append((i, " ".join(text), y))
        return rows

    def test_held_out_accuracy(self, spark):
        rows = self.corpus()
        docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(9001, None, "x"), (9002, "", "x"), (None, "words", "x"), (9003, "long " * 20_000, "x")], "doc_id long, text string, score string")
        labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (777_777, 1)], "doc_id long, toxic int")
        out = {r["doc_id"]: r for r in T.toxicity(docs, T.fit_on_labels(docs, labels)).collect()}
        assert len(out) == len(rows) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
        held = [(y, out[i]["predicted"]) for i, _, y in rows if out[i]["held_out"]]
        assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
        assert sum(y == p for y, p in held) >= 0.9 * len(held)
        kept = {r["doc_id"] for r in T.toxicity_stage(docs, labels).collect()}
        assert kept == {i for i, r in out.items() if not r["predicted"]} and T.toxicity_stage(docs, labels).columns == docs.columns

    def test_labels_of_one_kind_or_none(self, spark):
        docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
        none = spark.createDataFrame([], "doc_id long, toxic int")
        assert [r["score"] for r in T.toxicity(docs, T.fit_on_labels(docs, none)).collect()] == [0.0, 0.0]
        one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
        assert {r["score"] for r in T.toxicity(docs, T.fit_on_labels(docs, one)).collect()} == {1.0}
        assert T.toxicity(docs.limit(0), T.Model()).collect() == []

    def test_windows_cover_the_text(self):
        text = " ".join(f"W{i}," for i in range(51)).encode() + b" " + b"x" * 200
        found = T.windows(text)
        assert b"".join(found).split() == [*(f"w{i}".encode() for i in range(51)), *[b"x" * 48] * 4, b"x" * 8]
        assert all(w[:2] == w[-2:] == b"  " for w in found) and T.windows(b"") == T.windows(b" .,; ") == [b"    "]

    def test_scores_equal_a_slow_version(self, spark):
        rows = self.corpus(120, 3)
        docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
        labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
        model = T.fit_on_labels(docs, labels)
        made = [[T.compressor(x) for x in pair] for pair in model.pairs[:2]]
        size = lambda by, w: len(by(T.MARK + w))
        nothing = lambda w: any(size(x, w) - len(w) >= size(x, T.PROBE) - len(T.PROBE) for _, x in made)
        for i, t, s in [(r["doc_id"], r["text"], r["score"]) for r in T.toxicity(docs, model).collect()]:
            saved = [0 if nothing(w) else max(0, min(size(o, w) for o, _ in made) - max(size(x, w) for _, x in made)) for w in T.windows(t.encode())]
            counts = [sum(n >= k for n in saved) for k in T.SAVED]
            x = [*[np.log1p(c) for c in counts], *[c / len(saved) for c in counts], max(saved), np.mean(saved), np.log(len(saved))]
            z = model.weights[0] + (np.array(x) - model.mean) / model.scale @ model.weights[1:]
            assert abs(s - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9

    def test_dictionaries_are_trained_apart(self, spark):
        rows = self.corpus(200, 4)
        docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
        labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
        pairs = T.fit_on_labels(docs, labels).pairs
        assert len(pairs) == T.FOLDS and len(set(pairs)) == T.FOLDS
        for ordinary, toxic in pairs:
            assert b"grobfool" not in ordinary and b"grobfool" in toxic and len(ordinary) <= T.ORDINARY_BYTES and len(toxic) <= T.TOXIC_BYTES
        assert T.fit_on_labels(docs.repartition(7), labels.repartition(3)).pairs == pairs

    def test_the_sample_is_bounded_by_rows(self, spark):
        rows = [(i % 5, f"text {i}") for i in range(300)] + [(1, "same")] * 40
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        labels = spark.createDataFrame([(i, i % 2) for i in range(5)] * 2 + [(1, 0)], "doc_id long, toxic int")
        got = T.labelled_sample(docs, labels, "doc_id", "text", 7).collect()
        assert sorted(r["y"] for r in got) == [0] * 7 + [1] * 7 and len({(r["text"], r["y"]) for r in got}) == 14

    def test_repeated_rows_and_clashing_names(self, spark):
        rows = [(1, "a b", 1, "x"), (1, "a b", 1, "x"), (2, None, 2, "y")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, Score int, scored_text string")
        out = T.toxicity(docs, T.Model(prior=0.25))
        assert out.columns == ["doc_id", "text", "scored_text", "held_out", "score", "predicted"] and out.count() == 3
        labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
        stage = T.toxicity_stage(docs, labels)
        assert stage.columns == docs.columns and sorted(map(tuple, stage.collect()), key=repr) == sorted(rows, key=repr)
        assert T.toxicity_stage(docs.limit(0), labels).collect() == []


class TestDecontamination:
    def corpus(self, seed=1):
        rng = random.Random(seed)
        words = [f"v{i}" for i in range(3000)]
        items = [(j, " ".join(rng.choice(words) for _ in range(rng.randrange(16, 60)))) for j in range(25)]
        rows, truth = [], set()
        for i in range(200):
            text = [rng.choice(words) for _ in range(rng.randrange(0, 400))]
            if i % 5 == 0:
                j, item = items[i // 5 % 25]
                said = item.split()
                if i % 10 == 0:  # every fifth word another, the end as it was
                    said = [rng.choice(words) if k % 5 == 2 and k < len(said) - 8 else w for k, w in enumerate(said)]
                at = rng.randrange(len(text) + 1)
                text[at:at] = [w.upper() + "," for w in said]
                truth.add((i, j))
            rows.append((i, " ".join(text)))
        return rows, items, truth

    def test_finds_copies_and_paraphrases_only(self, spark):
        rows, items, truth = self.corpus()
        docs = spark.createDataFrame([(*r, 1) for r in rows] + [(900, None, 1), (901, "", 1), (902, "the " * 9000, 1), (0, rows[0][1], 1)], "doc_id long, text string, kind int")
        bench = spark.createDataFrame(items + [(90, None), (91, "not there"), (None, "a b c d e f g h i j k")], "item_id long, text string")
        got = D.contaminated(docs, bench).collect()
        pairs = {(r["doc_id"], r["item_id"]) for r in got}
        assert pairs == truth and len(got) == len(truth) + 1
        stage = {r["doc_id"] for r in D.decontamination_stage(docs, bench).collect()}
        assert stage == ({i for i, _ in rows} | {900, 901, 902}) - {i for i, _ in truth}

    def test_recall_of_the_index_against_brute_force(self, spark):
        rows, items, _ = self.corpus(2)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        bench = spark.createDataFrame(items, "item_id long, text string")
        found = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, bench).collect()}
        want = set()
        for i, t in rows:
            hashes = D.word_hashes(t.encode())
            for j, item in items:
                h = D.word_hashes(item.encode())
                if any(D.check(h, h[-D.ANSWER_WORDS :], hashes, w) for w in range(max(1, -(-len(hashes) // D.BLOCK)))):
                    want.add((i, j))
        assert len(found & want) >= 0.9 * len(want) and found <= want

    def test_recall_by_length_band(self, spark):
        """Verbatim items of 1 to 2,000 words and paraphrased ones of 16 to 2,000, against the check at every place."""
        rng = random.Random(9)
        words = [f"v{i}" for i in range(5000)]
        lengths = [1, 2, 3, 5, 7, 8, 9, 12, 16, 24, 40, 59, 64, 65, 90, 150, 300, 600, 1200, 2000]
        items = [(j, " ".join(rng.choice(words) + ("x" if n < 3 else "") for _ in range(n))) for j, n in enumerate(lengths)]
        rows = []
        for j, t in items:
            for k in range(4):
                said = t.split()
                if k > 1 and len(said) >= 16:
                    said = [rng.choice(words) if i % 6 == 3 and i < len(said) - 8 else w for i, w in enumerate(said)]
                text = [rng.choice(words) for _ in range(rng.randrange(0, 300))]
                at = rng.randrange(len(text) + 1)
                rows.append((4 * j + k, " ".join(text[:at] + said + text[at:])))
        got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
        assert got <= {(i, i // 4) for i, _ in rows}
        for low, high in ((1, 7), (8, 15), (16, 64), (65, 300), (301, 2000)):
            band = [(4 * j + k, j) for j, n in enumerate(lengths) if low <= n <= high for k in range(4)]
            assert sum(p in got for p in band) >= 0.9 * len(band), (low, high)

    def test_size_of_the_benchmark_is_checked(self, spark, monkeypatch):
        monkeypatch.setattr(D, "BENCHMARK_BYTES", 100)
        with pytest.raises(ValueError, match="parts"):
            D.benchmark_items(spark.createDataFrame([(1, "word " * 30)], "item_id long, text string"))

    def test_short_items_in_the_stage(self, spark):
        docs = spark.createDataFrame([(1, "one two three four"), (1, "one two"), (2, None)], "doc_id long, text string")
        bench = spark.createDataFrame([(1, "One two"), (2, "two, THREE four"), (3, " ")], "item_id long, text string")
        assert sorted((r["doc_id"], r["item_id"], r["start_word"]) for r in D.contaminated(docs, bench).collect()) == [(1, 1, 0), (1, 1, 0), (1, 2, 1)]
        assert sorted(map(tuple, D.decontamination_stage(docs, bench, least_words=3).collect()), key=repr) == [(1, "one two"), (2, None)]
        # by default items of one and two words count too
        assert sorted(map(tuple, D.decontamination_stage(docs, bench).collect()), key=repr) == [(2, None)]

    def test_empty_tables(self, spark):
        docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
        bench = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
        assert D.contaminated(docs.limit(0), bench).collect() == []
        assert D.contaminated(docs, bench.limit(0)).collect() == []

    def test_common_subsequence(self):
        rng = np.random.default_rng(3)
        for _ in range(30):
            a, b = rng.integers(0, 5, 20), rng.integers(0, 5, 30)
            table = np.zeros((21, 31), int)
            for i in range(20):
                for j in range(30):
                    table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
            assert D.common_subsequence(a, b) == table[-1, -1]
