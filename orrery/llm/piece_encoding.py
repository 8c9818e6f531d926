"""SentencePiece encoding and decoding of whole texts, by vectorised merge rounds in Arrow batches (see piece_model)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.columns import numbered, others, place
from orrery.llm.piece_model import PieceModel
from orrery.llm.token_counts import model_path
from orrery.llm.words import slices
from orrery.plans.durable import bounded_batches

BATCH_BYTES = 2 << 20
#: Ids of a batch that are decoded at a time.
DECODED_IDS = 1 << 20


def _mapped(docs: DataFrame, column: str, added: str, kind: str, run) -> DataFrame:
    """The rows with one column after their own, which run makes from batches of the named one."""
    bounded_batches(docs.sparkSession)
    kept, source = others(docs, (added,)), place(docs, column)
    base = numbered(docs).select(*dict.fromkeys((*kept, source)))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, made in run(parts, source):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], made], names=[*kept, added])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in base.schema if f.name in kept)
    return base.mapInArrow(batches, f"{kinds}{added} {kind}").toDF(*kept.values(), added)


def encode_texts(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Every row of docs with ids array<int> after its columns: the library's ids of the whole text, and the end id.

    Null and empty texts have the end id alone. Rows are otherwise kept as
    they are, repeated ones too; a column named ids, in whatever case, is
    replaced, and any other name may be used. Any length: one text must fit in
    a task's memory. An empty table gives an empty result. Models other than
    BPE with byte pieces and without normalisation are an error.
    """
    path = path or model_path()

    def run(parts, source):
        model = PieceModel(path)
        for batch in slices(parts, source, BATCH_BYTES):
            ids, starts = model.encode([x or "" for x in batch.column(source).to_pylist()])
            yield batch, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))

    return _mapped(docs, text_col, "ids", "array<int>", run)


def decode_ids(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Every row with decoded (string) after its columns: what the library's decode gives for the ids.

    Null and empty arrays are the empty text, and so is a null id among
    others; an id outside of the vocabulary is an error. A column named
    decoded, in whatever case, is replaced, and any other name may be used.
    An empty table gives an empty result.
    """
    path = path or model_path()

    def run(parts, source):
        model = PieceModel(path)
        for whole in parts:
            for batch in _by_ids(whole, source):
                column = batch.column(source)
                sizes = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
                flat = column.flatten()
                starts = np.concatenate(([0], np.cumsum(sizes)))
                if flat.null_count:
                    valid = np.asarray(flat.is_valid())
                    starts = np.concatenate(([0], np.cumsum(valid)))[starts]
                    flat = flat.drop_null()
                yield batch, pa.array(model.decode(flat.to_numpy(zero_copy_only=False).astype(np.int64), starts), pa.string())

    return _mapped(rows, ids_col, "decoded", "string", run)


def _by_ids(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many ids (a longer array stands alone)."""
    start = held = 0
    for i, n in enumerate(pc.list_value_length(batch.column(column)).to_pylist()):
        if held and held + (n or 0) > DECODED_IDS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if batch.num_rows > start:
        yield batch.slice(start, batch.num_rows - start)


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids in decimal, joined by one space) and decoded_sha256 of rows with ids and decoded."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
