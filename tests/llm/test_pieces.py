from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm.piece_encoding import decode_ids, digests, encode_texts
from orrery.llm.piece_model import PieceModel
from orrery.llm.token_counts import model_path

ODD = [
    "", " ", "  ", "\n", "<s> </s> ▁▁ a  b   c", "▁", "▁ ▁ a", " a", "a ", "<0x41>", "\t\t\t", "�", "😀😀 ü\u0000 x", "no_spaces" * 900, "é x " * 900 + " ", " " * 40_000,
    *(" " * k + "the" + " " * j for k in (1, 15, 16, 17, 33) for j in (0, 1, 17)),
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def model():
    return PieceModel(model_path())


def same(library, model, texts):
    ids, starts = model.encode(texts)
    want = [[*library.encode(t), 2] for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == want
    assert model.decode(ids, starts) == [library.decode(w) for w in want]


def test_odd_texts(library, model):
    same(library, model, ODD)


def test_runs_of_spaces(library, model):
    same(library, model, [" " * k + end for k in range(70) for end in ("", "the", "\n", "é x")])
    same(library, model, [" " * 300_000 + "end"])


@pytest.mark.parametrize("c", "aexz=-_*/#.0\n\t!一é<")
def test_long_runs_of_a_character(library, model, c):
    same(library, model, [c * 100_000])


@pytest.mark.parametrize("kind", ["spaced", "joined", "repeated", "few letters", "scripts"])
def test_random_texts(library, model, kind):
    r = random.Random(kind)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32_000)]
    make = {
        "spaced": lambda: "".join(r.choice(pieces) for _ in range(r.randint(1, 40))),
        "joined": lambda: "".join(r.choice(pieces).strip() for _ in range(r.randint(1, 40))),
        "repeated": lambda: "".join(r.choice(pieces).strip() for _ in range(r.randint(1, 3))) * r.randint(2, 60),
        "few letters": lambda: "".join(r.choice("abcdefi ") for _ in range(r.randint(1, 200))),
        "scripts": lambda: "".join(chr(r.choice([r.randint(32, 0x24F), r.randint(0x400, 0x4FF), r.randint(0x3000, 0x9FFF), r.randint(0x1F300, 0x1F6FF)])) for _ in range(50)),
    }[kind]
    same(library, model, [make() for _ in range(1500)])


def test_forgetting_words_changes_nothing(library, monkeypatch):
    from orrery.llm import piece_model

    monkeypatch.setattr(piece_model, "WORDS_KEPT", 3)
    monkeypatch.setattr(piece_model, "PART_CHARS", 50)
    same(library, PieceModel(model_path()), ODD)


def test_any_ids_decode(library, model):
    r = random.Random(2)
    runs = [[r.randrange(32_000) for _ in range(r.randint(0, 30))] for _ in range(1000)] + [[r.choice([0, 1, 2, 13, *range(3, 259)]) for _ in range(12)] for _ in range(2000)]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in runs])))
    assert model.decode(np.array(sum(runs, [])), starts) == [library.decode(x) for x in runs]


def test_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x y z"), (4, "long text " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c0", F.lit("own")).withColumn("DECODED", F.lit(1)).withColumn("Ids", F.lit(2))
    coded = decode_ids(encode_texts(docs))
    assert coded.columns == ["doc_id", "text", "c0", "ids", "decoded"]
    got = sorted(map(tuple, digests(coded).collect()), key=repr)
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(i, [*library.encode(t or ""), 2]) for i, t in rows]
    assert got == sorted(((i, len(x), h(" ".join(map(str, x))), h(library.decode(x))) for i, x in ids), key=repr)


def test_null_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [None, 1000, None])], "n int, ids array<int>")
    got = {r["n"]: r["decoded"] for r in decode_ids(rows).collect()}
    assert got[1] == got[2] == "" and got[3]
    assert encode_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert decode_ids(spark.createDataFrame([], "ids array<int>")).collect() == []


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"")
    with pytest.raises(ValueError):
        PieceModel(str(tmp_path / "m"))
