"""Token counts: batches balanced by bytes go to the tokenizer, and lengths alone come back.

Long texts are split where no token can span: at a single space between two
characters that are not spaces, in a vocabulary whose pieces have the space
mark only in front. The tokenizer puts a space mark before each part, which
stands for the space left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orrery.llm.columns import numbered, others, place
from orrery.llm.words import slices
from orrery.plans.durable import bounded_batches

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
BATCH_BYTES = 1 << 20
PART_CHARS = 16_384
ADDED = ("n_bytes", "n_tokens", "over_limit")
_MARK = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_text(text: str, most: int = PART_CHARS) -> list[str]:
    """Parts of about so many characters whose token counts add up to the text's; a text without a safe boundary stays whole."""
    parts, start = [], 0
    at = most
    while at < len(text):
        at = text.find(" ", at)
        if at < 0 or at + 1 >= len(text):
            break
        if text[at - 1] not in (" ", _MARK) and text[at + 1] not in (" ", _MARK) and at > start:
            parts.append(text[start:at])
            start = at + 1
            at += most
        else:
            at += 1
    parts.append(text[start:])
    return parts


class Tokenizer:
    """Token counts of the library that the file's ending names, without special tokens."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
            self.splits = model.encode(["a b"], out_type=str) == [[f"{_MARK}a", f"{_MARK}b"]] and not any(_MARK in p.lstrip(_MARK) for p in pieces)
        else:
            from tokenizers import Tokenizer as Fast

            model = Fast.from_file(path)
            model.no_padding()
            model.no_truncation()
            self._encode = lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]
            self.splits = False

    def counts(self, texts: list[str]) -> list[int]:
        parts = [split_text(t) if self.splits and len(t) > PART_CHARS else [t] for t in texts]
        lengths = iter(self._encode([p for ps in parts for p in ps]))
        return [sum(next(lengths) for _ in ps) for ps in parts]


def token_counts(docs: DataFrame, text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Every row of docs with n_bytes, n_tokens (long) and over_limit after its columns.

    Null and empty texts have 0 bytes and as many tokens as the library gives
    the empty text. Rows are otherwise kept as they are, repeated ones too;
    columns of the added names, in whatever case, are replaced, and any other
    name may be used. Any length: one text must fit in a task's memory. An
    empty table gives an empty result.
    """
    path = path or model_path()
    bounded_batches(docs.sparkSession)
    kept = others(docs, ADDED)
    text = place(docs, text_col)
    base = numbered(docs).select(*dict.fromkeys((*kept, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(path)
        for batch in slices(batches, text, BATCH_BYTES):
            texts = [x or "" for x in batch.column(text).to_pylist()]
            sizes = np.array([len(x.encode()) for x in texts], np.int64)
            counts = np.array(tokenizer.counts(texts), np.int64)
            cols = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes), pa.array(counts), pa.array(counts > limit)], names=[*kept, *ADDED])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in base.schema if f.name in kept)
    return base.mapInArrow(run, f"{kinds}n_bytes long, n_tokens long, over_limit boolean").toDF(*kept.values(), *ADDED)
