from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from orrery.llm import chat_format, licenses, mixing, quality_rules, warc
from orrery.llm.token_counts import Tokenizer, model_path, split_text, token_counts

DOCS = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x y z"), (4, "ü é\n" * 3000), (5, "<s> </s> ▁▁ a  b   c"), (6, "tail ")]


def docs_of(spark, rows=DOCS):
    return spark.createDataFrame([(i, t, 9, "c") for i, t in rows], "doc_id long, text string, n_tokens int, score string")


class TestTokens:
    def test_equals_the_library(self, spark):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path())
        got = token_counts(docs_of(spark)).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
        want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in DOCS]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)

    def test_parts_add_up(self):
        tokenizer = Tokenizer(model_path())
        assert tokenizer.splits
        texts = ["word and, more\nlines\t here  with   runs " * 2000, "no_spaces" * 9000, " " * 40_000, "a▁ b ▁c " * 9000, "é x " * 9000 + " "]
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path())
        assert tokenizer.counts(texts) == [len(model.encode(t)) for t in texts]
        assert len(split_text(texts[0])) > 2 and split_text("short") == ["short"]

    def test_other_library(self):
        assert Tokenizer(model_path("byte_bpe_50k.json")).counts(["hello world", ""]) == [2, 0]

    def test_empty_table(self, spark):
        assert token_counts(docs_of(spark, [])).collect() == []


class TestQuality:
    def brute(self, text):
        data = (text or "").encode()
        words = data.split()
        tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        hit = {i + k for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)

    def test_equals_brute_force(self, spark):
        good = " ".join(f"word{i}" for i in range(60)) + "."
        rows = DOCS + [(7, good), (8, "a b c " * 40), (9, good + "\n" + good), (10, "\n".join(["Menu | Home | About"] * 9 + [good])), (11, "WOW!! " * 60), (12, "All rights reserved.\n" + good)]
        got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.quality(docs_of(spark, rows)).collect()}
        for i, t in rows:
            want = self.brute(t)
            r = got[i, want[0]]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        kept = {k[0] for k, r in got.items() if r["kept"]}
        assert kept == {7, 12} and got[12, 63]["clean_text"] == good and got[7, 60]["clean_text"] == good

    def test_empty_table(self, spark):
        assert quality_rules.quality(docs_of(spark, [])).collect() == []


class TestMixing:
    def targets(self, sizes, weights=(3, 1, 2)):
        names = sorted(sizes, key=lambda s: (s is None, s))
        w = {s: weights[i % 3] for i, s in enumerate(names)}
        left, budget, out = set(names), 1.5 * sum(sizes.values()), {}
        while left:
            over = [s for s in left if budget * w[s] > 2 * sizes[s] * sum(w[x] for x in left)]
            for s in over:
                out[s] = 2.0 * sizes[s]
            left -= set(over)
            budget = 1.5 * sum(sizes.values()) - sum(v for v in out.values())
            if not over:
                break
        total = sum(w[s] for s in left)
        return out | {s: budget * w[s] / total for s in left}

    def test_targets_and_taken(self, spark):
        rows = [(i, "w " * (1 + i % 9), ("a", "b", "c", "hot", "hot", None)[i % 6]) for i in range(4000)] + [(9001, None, "empty"), (9002, "", "empty")]
        got = mixing.mix(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")).collect()
        sizes, taken, target = Counter(), Counter(), {}
        source = {r[0]: r[2] for r in rows}
        for r in got:
            s = source[r["doc_id"]]
            sizes[s] += r["size"]
            taken[s] += r["taken"]
            target[s] = r["target"]
            assert r["taken"] in (0, r["size"], 2 * r["size"])
        want = self.targets(dict(sizes))
        for s, t in want.items():
            assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= max(9, 0.01 * sizes[s])
        assert len(got) == len(rows)

    def test_reruns_agree_and_ties(self, spark):
        docs = spark.createDataFrame([(i % 3, "a b", "s") for i in range(30)] + [(None, "c", None)] * 3, "doc_id long, text string, source string")
        of = lambda: sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
        assert of() == of() and len(of()) == 33

    def test_stage_and_empty_table(self, spark):
        docs = spark.createDataFrame([(i, "a b c", "s", 7) for i in range(20)], "doc_id long, text string, source string, n_chars long")
        out = mixing.mixing_stage(docs).collect()
        assert {r["doc_id"] for r in out} <= set(range(20)) and all(r["copies"] >= 1 and r["n_chars"] == 7 for r in out)
        assert mixing.mix(docs.limit(0)).collect() == []


class TestWarc:
    def test_round_trip(self, spark, tmp_path):
        big = "<p>é\r\n\r\nWARC/1.1\r\n\r\n" + "x" * 200
        pages = [(5, "http://a/1", big), (3, "http://a/2\nX: y", big), (9, None, big), (9, None, big), (None, "http://n", big), (1, "u", "small"), (2, "u", "small"), (7, "v", None), (8, "v", ""), (6, "w", "q" * 100)]
        df = spark.createDataFrame([(*p, "k", 1) for p in pages], "page_id long, url string, html string, digest string, o int")
        for compression in ("gzip", "none"):
            folder = str(tmp_path / compression)
            warc.write_warc(warc.warc_records(df, "2020-01-01T00:00:00Z"), folder, compression)
            got = warc.read_warc(spark, folder).collect()
            assert len(got) == len(pages)
            sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
            assert Counter((r["page_id"], r["payload_digest"], r["payload_bytes"]) for r in got) == Counter((i, sha(h), len((h or "").encode())) for i, _, h in pages)
            same = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_digest"] == sha(big)), key=repr)
            assert same == sorted([(3, "response", None), (5, "revisit", 3), (9, "revisit", 3), (9, "revisit", 3), (None, "revisit", 3)], key=repr)
            assert all(r["record_type"] == "response" and r["refers_to"] is None for r in got if r["payload_bytes"] <= 100 and r["payload_digest"] != sha(big))
            assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)

    def test_one_response_of_repeated_rows(self, spark, tmp_path):
        rows = [(4, "u", "z" * 150)] * 3
        warc.write_warc(warc.warc_records(spark.createDataFrame(rows, "page_id long, url string, html string")), str(tmp_path / "w"))
        got = warc.read_warc(spark, str(tmp_path / "w")).collect()
        assert sorted(r["record_type"] for r in got) == ["response", "revisit", "revisit"]

    def test_files_are_cut_by_bytes_and_each_record_is_a_member(self, spark, tmp_path, monkeypatch):
        monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
        rng = random.Random(2)
        noise = lambda n: "".join(rng.choice("abcdefghijklmnop0123456789") for _ in range(n))
        pages = [(i, f"u{i}", noise(9_000)) for i in range(30)] + [(90, "big", "x" * (17 << 20)), (91, "again", "x" * (17 << 20))]
        warc.write_warc(warc.warc_records(spark.createDataFrame([(*p, 1, 2) for p in pages], "page_id long, URL string, html string, key int, original int").coalesce(2)), str(tmp_path / "w"))
        files = sorted((tmp_path / "w").rglob("*.warc.gz"))
        assert len(files) >= 8 and all(f.read_bytes()[:3] == b"\x1f\x8b\x08" and f.read_bytes()[-1:] == b"\0" for f in files)
        for f in files:
            data, kinds = f.read_bytes(), []
            while data:  # member by member, as a reader with an index does
                one = zlib.decompressobj(31)
                record = one.decompress(data)
                data = one.unused_data
                if record:
                    kinds.append(next(warc.parse_warc(record))[0]["warc-type"])
                    assert len(list(warc.parse_warc(record))) == 1
            assert kinds.count("warcinfo") == 1 and len(kinds) > 1
        got = {r["page_id"]: r for r in warc.read_warc(spark, str(tmp_path / "w")).drop("payload").collect()}
        assert len(got) == 32 and got[91]["refers_to"] == 90 and got[90]["payload_bytes"] == 17 << 20

    def test_payloads_stay_where_they_are(self, spark):
        pages = spark.createDataFrame([(i, "u", "p" * (150 + i % 3)) for i in range(9)], "page_id long, url string, html string")
        plan = warc.warc_records(pages)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan

    def test_empty_table(self, spark, tmp_path):
        warc.write_warc(warc.warc_records(spark.createDataFrame([], "page_id long, url string, html string")), str(tmp_path / "w"))
        assert warc.read_warc(spark, str(tmp_path / "w")).collect() == []

    def test_cut_record(self):
        with pytest.raises(ValueError):
            list(warc.parse_warc(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort"))


class TestChat:
    TURNS = [
        (1, 0, "system", "be <|im_end|> good"), (1, 1, "user", "a\\<|b\n"), (1, 2, "assistant", "<|im_start|>assistant\nok \\\\<\\|"), (1, 3, "user", "q"), (1, 4, "assistant", ""),
        (2, 0, "user", None), (2, 1, None, "x"), (3, 0, "assistant", "ü" * 5), (None, 0, "assistant", "n"), (4, 1, "assistant", "second"), (4, None, "user", "first"),
        (5, 0, "as\nsistant", "role with a line end"), (6, 0, "assistant", "same"), (6, 0, "assistant", "same"),
    ]

    def turns(self, spark, rows=None):
        return spark.createDataFrame([(*r, "p") for r in (self.TURNS if rows is None else rows)], "conv_id long, turn long, role string, text string, parts string")

    def test_read_back(self, spark):
        got = {r["conv_id"]: r for r in chat_format.conversation_digests(chat_format.chat_examples(self.turns(spark))).collect()}
        for conv in {r[0] for r in self.TURNS}:
            turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in self.TURNS if c == conv))
            whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
            loss = "".join(x for _, _, r, x in turns if r == "assistant")
            r = got[conv]
            assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
            assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())

    def test_every_reply_is_an_example_of_its_own(self, spark):
        rows = chat_format.chat_examples(self.turns(spark)).where("conv_id = 1").orderBy("target").collect()
        assert [r["target"] for r in rows] == [2, 4]
        first = rows[0]
        assert first["text"].count("<|im_start|>") == 3 and rows[1]["text"].startswith(first["text"])
        held = first["text"][first["loss_start"] : first["loss_start"] + first["loss_chars"]]
        assert held.replace("<\\|", "<|").replace("\\\\", "\\") == self.TURNS[2][3]
        assert "<|im_end|> good" not in first["text"]

    def test_escape_is_undone(self, spark):
        rows = [(s,) for s in ("<|", "\\<|", "<\\|", "\\\\", "<\\\\|", "<|<|\\", "|<", "", "<\\", "\\|")]
        df = spark.createDataFrame(rows, "s string")
        e = chat_format.escaped(F.col("s"))
        for s, esc, back in df.select("s", e, chat_format.unescaped(e)).collect():
            assert back == s and "<|" not in esc

    def test_empty_table(self, spark):
        assert chat_format.chat_examples(self.turns(spark, [])).collect() == []


class TestLicenses:
    def test_lookup(self, spark):
        mit = "Copyright (c) 2020 Someone\n\n" + licenses._MIT.replace("free of charge", "FREE of  charge").replace("sublicense", "sub-license").replace(",", " ,")
        rows = [(1, mit), (2, mit + "\nextra"), (3, "text\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0.\n"), (4, None), (5, ""), (6, "word " * 9000), (7, "© 2021 X"), (3, "text\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0.\n")]
        df = spark.createDataFrame([(*r, "l", "n") for r in rows], "doc_id long, text string, license string, notices string")
        got = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
        assert got[1]["license"] == "MIT" and got[2]["license"] is None
        assert got[3]["notices"] == "CC-BY-NC-4.0,MIT" and got[4]["notices"] == ""
        assert got[4]["canonical_digest"] == got[5]["canonical_digest"] == got[7]["canonical_digest"]
        assert licenses.license_scan(df).count() == len(rows)
        assert licenses.license_scan(df.limit(0)).collect() == []

    def test_whole_licences_with_other_spelling(self, spark):
        """Changed case, punctuation, holders, line ends and spellings."""
        texts = {n: t for n, t in licenses.KNOWN if len(t) > 500}
        folder = "/usr/share/common-licenses"
        if os.path.isdir(folder):
            texts |= {n: open(f"{folder}/{f}", encoding="utf-8").read() for f, n in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("MPL-2.0", "MPL-2.0")) if os.path.exists(f"{folder}/{f}")}
        changed = lambda t: "Copyright (c) 2024 Other Holder\nAll rights reserved.\n\n" + re.sub(r"(?i)\blicense\b", "LICENCE", t).replace(" ", "  ").replace(",", " ,").upper().replace("ORGANIZATION", "ORGANISATION")
        wrapped = lambda t: re.sub(r"(.{60}\S*) ", r"\1\r\n", t)
        rows = [(n, f(t)) for n, t in texts.items() for f in ((changed, wrapped) if len(t) < 5000 else (changed,))]  # long ones name holders inside lines, which must stay there + [("none", t + " x") for t in texts.values()]
        got = licenses.license_scan(spark.createDataFrame(rows, "doc_id string, text string"))
        assert sorted((r["doc_id"], r["license"] or "none") for r in got.collect()) == sorted((n, n) for n, _ in rows)

    def test_adjacent_spellings_and_line_ends(self, spark):
        texts = ["licence licence licence", "foo\rcopyright 2020 bar\nbaz", "a\u2028copyright (c) x\nb\u0085(c) y", "COPYRIGHT HOLDERS be liable\nAll rights reserved.\nAll rights reserved by us", "non commercial non commercial"]
        for t, c in spark.createDataFrame([(t,) for t in texts], "t string").select("t", licenses.canonical_column(F.col("t"))).collect():
            assert c == licenses.canonical(t)
            assert c == duckdb.sql(f"SELECT {licenses.oracle_sql().split('sha256(')[-1].split(') = k.d')[0]} FROM (SELECT ? AS t)", params=[t]).fetchall()[0][0]
        assert licenses.canonical(texts[0]) == "license license license" and "copyright 2020 bar" in licenses.canonical(texts[1])

    def test_notices_alone(self, spark):
        rows = [(1, "x\n  Li'cenced under the MIT License!\ny"), (2, "SPDX-License-Identifier: Apache-2.0\n\nSPDX-License-Identifier: MIT")]
        got = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, License string, names int")
        assert {r["doc_id"]: r["notices"] for r in licenses.license_scan(got).collect()} == {1: "MIT", 2: "Apache-2.0,MIT"}

    def test_both_forms_agree(self, spark):
        texts = [t for _, t in licenses.KNOWN] + ["Éa ﬁ  Programme—whilst\n(c) gone\nper   cent", "don't"]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        for t, c in df.select("t", licenses.canonical_column(F.col("t"))).collect():
            assert c == licenses.canonical(t)

    def test_known_digests_differ(self):
        assert len(licenses.known_digests()) >= len({n for n, _ in licenses.KNOWN})


def test_boilerplate_pattern_is_literal():
    assert re.escape("terms of use") == "terms\\ of\\ use"
