"""Exact substring dedup with fixed-block anchors.

A window of 20 words always holds one whole block of 10 words that starts at
a multiple of 10. So non-overlapping blocks are indexed, every rolling window
of 10 words probes them, and each hit is extended to the windows of 20 words
around it, whose union is the set of maximal exact repeats.

1. Anchors. Each chunk of texts sends every distinct 10-word hash once, to the
   bucket that its high bits name; a hash that a chunk holds twice is a hit
   already. A bucket reports the hashes that came from two chunks, one of them
   at a block start. A passage that a third of all documents share costs one
   entry a chunk.
2. Extension. Around hits, 20-word windows are keyed by 80 hash bits and the bucket. Again a
   chunk settles its own repeats and sends only the earliest place of each key.
3. Removal. Words covered by a window that also starts earlier go.

Texts move once, by document; hashes move as packed arrays. The buckets follow
spark.sql.shuffle.partitions, which has to grow with the input.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.columns import numbered, others, place
from orrery.llm.words import WordHashes, chunks, hashed_words, mix, raw, run_spans, runs, second_hashes, slices, window_hashes
from orrery.plans.durable import bounded_batches, shuffle_partitions

WINDOW = 20
CHUNK_BYTES = 4 << 20
#: Stands for a null id in the order of documents: after all others.
LAST = (1 << 63) - 1
#: A row's key: its id and 64 bits of its text's hash, which tell rows of one id apart.
_ID, _TAG = "orrery_row_id", "orrery_row_tag"
ADDED = ("n_words", "n_removed", "kept_sha256", "removed_spans", "clean_text")
_MESSAGE = "bucket long, kind int, data binary"
_FOUND = "bucket long, data binary"


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Every row of docs with its columns and, after them:

    n_words, n_removed: long; kept_sha256: digest of the kept words joined by
    one space; removed_spans: array of (start, end) in words; clean_text: the
    text without the removed words (unchanged, white space included, where
    none goes; null stays null).

    A word goes if a window of `window` words that covers it has the same
    words as a window that starts earlier: in a smaller document, or earlier
    in the same one. Null and empty texts have no words. A null id counts as
    the largest. Rows that repeat an id are never earlier than each other at
    the same start, so an id's repeated rows share their fate. Columns of the
    added names, in whatever case, are replaced, and any other name may be
    used. Texts of any length are handled whole; one text must fit in a task's
    memory. An empty table gives an empty result.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    kept, text = others(docs, ADDED), place(docs, text_col)
    base = numbered(docs).select(*dict.fromkeys((*kept, text)), F.coalesce(F.col(place(docs, id_col)).cast("long"), F.lit(LAST)).alias(_ID))
    keyed = base.withColumn(_TAG, F.xxhash64(text))
    buckets = shuffle_partitions(docs.sparkSession)
    bounded_batches(docs.sparkSession)

    def gathered(found: DataFrame) -> DataFrame:
        return found.groupBy("bucket").applyInArrow(_gathered, f"{_ID} long, {_TAG} long, orrery_places binary")

    anchors = keyed.select(_ID, _TAG, F.col(text).alias("text")).mapInArrow(_anchors(window // 2, buckets), _MESSAGE)
    hits = gathered(anchors.groupBy("bucket").applyInArrow(_matched(window // 2, buckets), _FOUND))
    # both joins take the same columns, so that texts are shuffled once
    windows = keyed.join(hits, [_ID, _TAG], "left").mapInArrow(_extended(text, window, buckets), _MESSAGE)
    removed = gathered(windows.groupBy("bucket").applyInArrow(_repeated(buckets), _FOUND))

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in base.schema if f.name in kept)
    extra = "n_words long, n_removed long, kept_sha256 string, removed_spans array<struct<start: long, end: long>>, clean_text string"
    return keyed.join(removed, [_ID, _TAG], "left").mapInArrow(_cut_out(list(kept), text, window), kinds + extra).toDF(*kept.values(), *ADDED)


def substring_dedup_stage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Docs with the repeated words cut out of the texts, and n_chars, where it is a column, counted anew for them; no row goes.

    Nulls stay null and count as no words; repeated rows of one id share their
    fate, a null id is the largest. All columns stay as they are otherwise,
    whatever their names. Texts of any length are cut whole; an empty table
    stays empty.
    """
    text = place(docs, text_col)
    out = dedup_substrings(numbered(docs), place(docs, id_col), text).withColumn(text, F.col("clean_text"))
    if "n_chars" in docs.columns:
        chars = place(docs, "n_chars")
        out = out.withColumn(chars, F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(chars)))
    return out.drop(*ADDED).toDF(*docs.columns)


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays one after another, each with its type and length, their bytes apart by place so that small numbers compress."""
    out = []
    for a in arrays:
        out.append(struct.pack("<2sI", a.dtype.str[1:].encode(), len(a)))
        out.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes())
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n = struct.unpack_from("<2sI", data, at)
        kind = np.dtype("<" + kind.decode())
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at + 6).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += 6 + n * kind.itemsize
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint16) if not len(a) or a.max() < 1 << 16 else a.astype(np.uint32)


def _steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences of ascending values, anew at each first."""
    out = np.diff(values, prepend=0)
    out[first] = values[first]
    return narrow(out)


def _summed(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What _steps() was made from."""
    total = np.cumsum(steps.astype(np.int64))
    first = np.cumsum(counts) - counts
    return total - np.repeat(total[first] - steps[first], counts)


def _changes(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before (the first does)."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for x in sorted_columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def pack_places(ids: np.ndarray, tags: np.ndarray, places: np.ndarray) -> bytes:
    """Places of rows, in any order, as runs of consecutive places."""
    order = np.lexsort((places, tags, ids))
    ids, tags, places = ids[order], tags[order], places[order]
    row = _changes(ids, tags)
    new = row.copy()
    new[1:] |= places[1:] > places[:-1] + 1
    at = np.flatnonzero(new)
    last = places[np.append(at[1:], len(places)) - 1]
    rows = np.flatnonzero(row[at])
    counts = np.diff(np.append(rows, len(at)))
    return pack(ids[at][rows], tags[at][rows], narrow(counts), _steps(places[at], rows), narrow(last - places[at] + 1))


def unpack_places(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, tag, first place, length) of each run."""
    parts = []
    for ids, tags, counts, steps, n in map(unpack, data):
        counts = counts.astype(np.int64)
        parts.append((np.repeat(ids, counts), np.repeat(tags, counts), _summed(steps, counts), n.astype(np.int64)))
    ids, tags, starts, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
    return ids, tags, starts, lengths


def _spread(ids: np.ndarray, tags: np.ndarray, places: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Places of rows, packed by the bucket of the row."""
    bucket = (mix(ids.astype(np.uint64) ^ tags.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    for a, b in run_spans(bucket[order]):
        pick = order[a:b]
        yield int(bucket[pick[0]]), pack_places(ids[pick], tags[pick], places[pick])


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "kind", "data"])


def _bucketed(bucket: np.ndarray, doc: np.ndarray, place: np.ndarray, per_row: tuple[np.ndarray, ...], per_entry: tuple[np.ndarray, ...]) -> Iterator[tuple[int, int, bytes]]:
    """Messages with a bucket's entries: entries of each row, places, columns by row, columns by entry."""
    order = np.argsort(bucket, kind="stable")
    for a, b in run_spans(bucket[order]):
        pick = order[a:b]
        first = runs(doc[pick])
        counts = np.diff(np.append(first, len(pick)))
        of = doc[pick][first]
        yield int(bucket[pick[0]]), 0, pack(narrow(counts), _steps(place[pick], first), *[x[of] for x in per_row], *[x[pick] for x in per_entry])


def _entries(data: list[bytes], per_row: int) -> list[np.ndarray]:
    """The entries of all messages: places, then columns by row and by entry."""
    parts = []
    for counts, steps, *rest in map(unpack, data):
        counts = counts.astype(np.int64)
        parts.append([_summed(steps, counts), *[np.repeat(x, counts) for x in rest[:per_row]], *rest[per_row:]])
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _split(table: pa.Table) -> tuple[list[tuple[int, bytes]], list[bytes]]:
    """What a chunk has settled itself, with its bucket, to be passed on; and the messages to be matched."""
    rows = list(zip(*[table.column(c).to_pylist() for c in ("bucket", "kind", "data")], strict=True))
    return [(b, d) for b, k, d in rows if k], [d for _, k, d in rows if not k]


def _found(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "data": pa.array([d for _, d in rows], pa.binary())})


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array(batch.column(c).to_pylist(), np.int64) for c in (_ID, _TAG))


def _anchors(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in chunks(batches, "text", CHUNK_BYTES):
            ids, tags = _keys(batch)
            hashes, ends = hashed_words(raw(batch.column("text")), cache)
            h = window_hashes(hashes, width)
            doc = np.repeat(np.arange(len(ids)), np.diff(ends))[: len(h)]
            at = np.flatnonzero(np.arange(len(h)) + width <= ends[doc + 1]) if len(h) else np.empty(0, np.int64)
            if not len(at):
                continue
            h, doc = h[at], doc[at]
            place = at - ends[doc]
            order = np.argsort(h)
            starts = runs(h[order])
            counts = np.diff(np.append(starts, len(order)))
            # of equal hashes, one at a block start stands for all, else any
            rank = np.where(place[order] % width == 0, 0, 1 << 40) + order
            lead = np.minimum.reduceat(rank, starts) & ((1 << 40) - 1)
            by_place = np.argsort(lead)
            known = counts[by_place] > 1
            lead = lead[by_place]
            bucket = ((h[lead] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            rows = list(_bucketed(bucket, doc[lead], place[lead], (ids, tags), (h[lead].astype(np.uint32), known.astype(np.uint8))))
            own = order[np.repeat(counts > 1, counts)]
            rows += [(b, 1, d) for b, d in _spread(ids[doc[own]], tags[doc[own]], place[own], buckets)]
            yield _messages(rows)

    return run


def _matched(width: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        own, data = _split(table)
        if data:
            place, ids, tags, h, known = _entries(data, 2)
            order = np.argsort(h)
            starts = runs(h[order])
            counts = np.diff(np.append(starts, len(order)))
            anchored = np.logical_or.reduceat(place[order] % width == 0, starts) & (counts > 1)
            hit = order[np.repeat(anchored, counts)]
            hit = hit[known[hit] == 0]
            own += _spread(ids[hit], tags[hit], place[hit], buckets)
        return _found(own)

    return run


def _gathered(table: pa.Table) -> pa.Table:
    """One row for each document that has places: its runs, as starts and lengths."""
    ids, tags, starts, lengths = unpack_places(table.column("data").to_pylist())
    order = np.lexsort((starts, tags, ids))
    at = np.flatnonzero(_changes(ids[order], tags[order]))
    rows = [order[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True)]
    data = [pack(starts[r].astype(np.uint32), lengths[r].astype(np.uint32)) for r in rows]
    return pa.table({_ID: pa.array(ids[order[at]], pa.int64()), _TAG: pa.array(tags[order[at]], pa.int64()), "orrery_places": pa.array(data, pa.binary())})


def _covered(places: bytes | None, n: int, before: int, after: int) -> np.ndarray:
    """Which of n positions lie from `before` below to `after` above one of the places."""
    if places is None:
        return np.zeros(n, bool)
    starts, lengths = (x.astype(np.int64) for x in unpack(places))
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(starts - before, 0), 1)
    np.add.at(edge, np.minimum(starts + lengths + after, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _earliest(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries that start first under their key (more than one if ids repeat), and the others."""
    order = np.lexsort((place, ids, h2, h1))
    a, b = h1[order], h2[order]
    starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    least = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
    later = (ids[order] != ids[least]) | (place[order] != place[least])
    return np.sort(order[~later]), order[later]


def _extended(text: str, window: int, buckets: int):
    half = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in chunks(batches, text, CHUNK_BYTES):
            batch = batch.filter(pc.is_valid(batch.column("orrery_places")))
            ids, tags = _keys(batch)
            hashes, ends = hashed_words(raw(batch.column(text)), cache)
            h1 = window_hashes(hashes, window)
            if not len(h1):
                continue
            near = [_covered(p, int(n), half - 1, 0) for p, n in zip(batch.column("orrery_places").to_pylist(), np.diff(ends), strict=True)]
            doc = np.repeat(np.arange(len(ids)), np.diff(ends))[: len(h1)]
            at = np.flatnonzero((np.arange(len(h1)) + window <= ends[doc + 1]) & np.concatenate(near)[: len(h1)])
            if not len(at):
                continue
            h2 = window_hashes(second_hashes(hashes), window)[at]
            h1, doc = h1[at], doc[at]
            place = at - ends[doc]
            send, gone = _earliest(h1, h2, ids[doc], place)
            bucket = ((h2[send] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            rows = list(_bucketed(bucket, doc[send], place[send], (ids, tags), (h1[send], h2[send].astype(np.uint16))))
            rows += [(b, 1, d) for b, d in _spread(ids[doc[gone]], tags[doc[gone]], place[gone], buckets)]
            yield _messages(rows)

    return run


def _repeated(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        own, data = _split(table)
        if data:
            place, ids, tags, h1, h2 = _entries(data, 2)
            gone = _earliest(h1, h2, ids, place)[1]
            own += _spread(ids[gone], tags[gone], place[gone], buckets)
        return _found(own)

    return run


def _cut_out(names: list[str], text_col: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, CHUNK_BYTES):
            texts, found = batch.column(text_col).to_pylist(), batch.column("orrery_places").to_pylist()
            cols = {"n_words": [], "n_removed": [], "kept_sha256": [], "removed_spans": [], "clean_text": []}
            for text, hits in zip(texts, found, strict=True):
                data = (text or "").encode()
                words = data.split()
                spans, kept, clean = [], words, text
                if hits:
                    gone = _covered(hits, len(words), 0, window - 1)
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    clean = _without(data, words, spans).decode()
                cols["n_words"].append(len(words))
                cols["n_removed"].append(len(words) - len(kept))
                cols["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
                cols["removed_spans"].append(spans)
                cols["clean_text"].append(clean)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.string(), span, pa.string()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True)]], names=[*names, *cols])

    return run


def _without(data: bytes, words: list[bytes], spans: list[dict]) -> bytes:
    """The text without the words of the spans and the white space after each of these words."""
    begins, at = [], 0
    for w in words:
        at = data.find(w, at)
        begins.append(at)
        at += len(w)
    begins.append(len(data))
    out, last = [], 0
    for s in spans:
        out.append(data[last : begins[s["start"]]])
        last = begins[s["end"]]
    out.append(data[last:])
    return b"".join(out)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 19], ' ')) AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
later AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS words
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
