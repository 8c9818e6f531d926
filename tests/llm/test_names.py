"""Columns whose names clash with those that the operators add or use, in any case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orrery.llm import chat_format, decontamination, licenses, mixing, near_dedup, quality_rules, simhash, substring_dedup, toxicity, warc
from orrery.llm.token_counts import token_counts

NAMES = ("N_WORDS", "Score", "Kept", "N_TOKENS", "orrery_row_key", "orrery_row_id", "copies", "Size", "source_size", "label", "c0", "key", "number", "s")
TEXT = " ".join(f"w{i}" for i in range(60)) + "."
ROWS = [(1, TEXT, "a"), (1, TEXT, "a"), (2, None, None), (None, "", "b"), (3, "long " * 30_000, "a"), (4, TEXT + " more", "b")]


def docs_of(spark, rows=ROWS):
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return table.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "no such words here"), (2, None)], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")


@pytest.mark.parametrize("rows", [ROWS, ROWS[:0]], ids=["rows", "empty"])
class TestNames:
    def keeps(self, out, docs, added):
        kept = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
        assert out.columns == [*kept, *added]
        got = [r[: len(kept)] for r in out.collect()]
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, docs.select(*[F.col(f"`{c}`") for c in kept]).collect()), key=repr)

    def test_operators(self, spark, rows):
        docs = docs_of(spark, rows)
        self.keeps(substring_dedup.dedup_substrings(docs), docs, substring_dedup.ADDED)
        self.keeps(token_counts(docs), docs, ("n_bytes", "n_tokens", "over_limit"))
        self.keeps(toxicity.toxicity(docs, toxicity.Model()), docs, ("held_out", "score", "predicted"))
        self.keeps(quality_rules.quality(docs), docs, quality_rules.ADDED)
        for out in (mixing.mix(docs), simhash.near_groups(docs), near_dedup.near_groups(docs), licenses.license_scan(docs)):
            assert out.count() == len(rows)

    def test_stages(self, spark, rows, benchmark, labels):
        docs = docs_of(spark, rows)
        once = sorted({tuple(r) for r in docs.collect()}, key=repr)
        assert sorted(map(tuple, toxicity.toxicity_stage(docs, labels).collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
        assert sorted(map(tuple, decontamination.decontamination_stage(docs, benchmark).collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
        for stage in (near_dedup.near_dedup_stage, simhash.near_dedup_stage):
            out = stage(docs)
            kept = [tuple(r) for r in out.collect()]
            assert out.columns == docs.columns and set(kept) <= set(once) and len(kept) == len(set(kept)) and (not rows or {r[0] for r in kept} >= {1, 2, 3})
        cut = substring_dedup.substring_dedup_stage(docs)
        assert cut.columns == docs.columns and cut.count() == len(rows)
        mixed = mixing.mixing_stage(docs)
        assert mixed.columns == [c for c in docs.columns if c.lower() not in ("copies", "size", "source_size")] + ["copies", "size", "source_size", "target", "taken"]
        assert {r["doc_id"] for r in mixed.collect()} <= {r[0] for r in rows} and (mixed.count() > 0) == bool(rows)

    def test_pages(self, spark, tmp_path, rows):
        pages = docs_of(spark, rows).select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *[F.col(f"`{n}`") for n in NAMES])
        warc.write_warc(warc.warc_records(pages), str(tmp_path / "w"))
        assert warc.read_warc(spark, str(tmp_path / "w")).count() == len(rows)

    def test_turns(self, spark, rows):
        turns = [(1, 0, "user", "q"), (1, 1, "assistant", "long " * 200_000), (None, 0, None, None)] if rows else []
        plain = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
        own = plain.select(*[F.lit("own").alias(n) for n in ("TEXT", "Role", "CONV_ID", "turn_", "t", "ts", "parts")], "*")
        read = lambda t: sorted(map(tuple, chat_format.conversation_digests(chat_format.chat_examples(t)).collect()), key=repr)
        assert read(own) == read(plain) and len(read(own)) == len({t[0] for t in turns})

    def test_labels(self, spark, rows):
        docs = docs_of(spark, rows)
        labels = spark.createDataFrame([(1, 0, "x", 5), (2, 1, "x", 5)], "doc_id long, toxic int, TOXIC string, Doc_Id int")
        assert toxicity.toxicity(docs, toxicity.fit_on_labels(docs, labels)).count() == len(rows)
