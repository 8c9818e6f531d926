"""SimHash near-dedup with Golay-code fuzzy hashing.

The perfect binary Golay code has one codeword within distance 3 of every
23-bit word. A word keeps as indices all codewords within distance 4: one if
it lies within 2 of its codeword, six if at 3. Two words that differ in at
most two bits share an index: the word between them decodes to it.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. If two
fingerprints differ in at most 2 bits, one segment has no error and the next
one at most 2, so a key of an exact segment and an index of the next one is
shared: three tables, about 16 keys a fingerprint, 33 bits and more each.
Candidates are verified by their differing bits. Equal fingerprints are one
node, whatever the number of documents; a large group under one key is linked
through the words between its members, not by pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.columns import numbered, place, row_key
from orrery.llm.substring_dedup import pack, unpack
from orrery.llm.words import raw, run_spans, runs, slices
from orrery.operators.graph import connected_components, forest
from orrery.plans.durable import bounded_batches, cut, shuffle_partitions

BITS = 2
SEED = 42
SHINGLE = 3
SEGMENTS = ((42, 22), (21, 21), (0, 21))
CHUNK_BYTES = 1 << 20
#: Groups under one key above this size are linked through words between members.
PAIRWISE = 48
#: Entries that linking through words between holds at a time.
BETWEEN = 2_000_000
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_GENERATOR = 0xC75
_KEY = "orrery_row_key"


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - 11)
    return word


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits; for each remainder the six differences to the codewords near, and how many count."""
    high = np.array([_remainder(x << 11) for x in range(1 << 12)], np.int32)
    single = [_remainder(1 << b) for b in range(23)]
    error = {0: 0}
    for a in range(23):
        error[single[a]] = 1 << a
        for b in range(a):
            error[single[a] ^ single[b]] = 1 << a | 1 << b
            for c in range(b):
                error[single[a] ^ single[b] ^ single[c]] = 1 << a | 1 << b | 1 << c
    near = np.zeros((1 << 11, 6), np.int32)
    count = np.ones(1 << 11, np.int8)
    for s, e in error.items():
        found = [e]
        if e.bit_count() == 3:
            found += sorted({f for b in range(23) if (f := error[s ^ single[b]] ^ 1 << b).bit_count() == 4})
        near[s, : len(found)] = found
        count[s] = len(found)
    return high, near, count


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, index) of every codeword within distance 4 of each 23-bit word."""
    high, near, count = golay_tables()
    syndrome = high[words >> 11] ^ (words & 0x7FF)
    owner = np.repeat(np.arange(len(words)), count[syndrome])
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count[syndrome].astype(np.int64)) - count[syndrome], count[syndrome])
    return owner, (words[owner] ^ near[syndrome[owner], nth]) >> 11


def fingerprint_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key): what two fingerprints that differ in at most 2 bits share at least once."""
    owners, keys = [], []
    parts = [((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64) for shift, width in SEGMENTS]
    for t in range(3):
        owner, index = golay_indices(parts[(t + 1) % 3])
        owners.append(owner)
        keys.append(t << 34 | parts[t][owner] << 12 | index)
    return np.concatenate(owners), np.concatenate(keys)


def fingerprint(text: bytes) -> int:
    """The SimHash of one text, as the batch form below gives it."""
    return int(_fingerprints([text])[0])


def _fingerprints(texts: list[bytes]) -> np.ndarray:
    digests, counts = [], []
    hashed = xxhash.xxh64_digest
    for text in texts:
        words = text.lower().split()
        n = len(words)
        if n <= SHINGLE:
            counts.append(bool(n))
            if n:
                digests.append(hashed(b" ".join(words), SEED))
            continue
        flat = b" ".join(words)
        begins = [0]
        at = 0
        for w in words:
            at += len(w) + 1
            begins.append(at)
        digests += [hashed(flat[a : b - 1], SEED) for a, b in zip(begins, begins[SHINGLE:])]
        counts.append(n - SHINGLE + 1)
    out = np.zeros(len(texts), np.uint64)
    counts = np.array(counts, np.int64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
    starts = (np.cumsum(counts) - counts)[some]
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * ones > counts[some, None], axis=1).view(">u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: orrery_row_key, doc_id, fingerprint as long. Null and wordless texts: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            prints = _fingerprints(raw(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column(_KEY), batch.column("doc_id"), pa.array(prints.view(np.int64))], names=[_KEY, "doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    number, text = place(docs, id_col), place(docs, text_col)
    rows = numbered(docs).select(row_key(number, text).alias(_KEY), F.col(number).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"{_KEY} binary, doc_id long, fp long")


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all of the distinct fingerprints (column fp) that differ in at most 2 bits."""
    buckets = shuffle_partitions(prints.sparkSession)
    return prints.select("fp").mapInArrow(_keyed(buckets), "bucket long, data binary").groupBy("bucket").applyInArrow(_linked, "a long, b long")


def _keyed(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array(batch.column("fp").to_pylist(), np.int64)
            owner, keys = fingerprint_keys(prints.view(np.uint64))
            bucket = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            names, data = [], []
            for a, b in run_spans(bucket[order]):
                pick = order[a:b]
                names.append(int(bucket[pick[0]]))
                data.append(pack(keys[pick], prints[owner[pick]]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "data"])

    return run


def _linked(table: pa.Table) -> pa.Table:
    parts = [unpack(x) for x in table.column("data").to_pylist()]
    keys, prints = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    nodes, at = np.unique(prints, return_inverse=True)
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    starts = runs(keys)
    sizes = np.diff(np.append(starts, len(keys)))
    size = np.repeat(sizes, sizes)
    left, right = [], []
    small = np.flatnonzero((size > 1) & (size <= PAIRWISE))
    for step in range(1, PAIRWISE):
        here = small[small + step < len(keys)]
        here = here[keys[here] == keys[here + step]]
        if not len(here):
            break
        a, b = at[here], at[here + step]
        near = np.bitwise_count((nodes[a] ^ nodes[b]).view(np.uint64)) <= BITS
        left.append(a[near])
        right.append(b[near])
    for start, n in zip(starts[sizes > PAIRWISE].tolist(), sizes[sizes > PAIRWISE].tolist(), strict=True):
        for a, b in between_links(nodes, at[start : start + n]):
            left.append(a)
            right.append(b)
    root = forest(len(nodes), np.concatenate(left or [at[:0]]), np.concatenate(right or [at[:0]]))
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table({"a": pa.array(nodes[moved], pa.int64()), "b": pa.array(nodes[root[moved]], pa.int64())})


def between_links(nodes: np.ndarray, members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all members that differ in at most 2 bits: all that lie within one bit of the same word do."""
    values = nodes[members].view(np.uint64)
    varying = np.bitwise_or.reduce(values ^ values[0])
    flips = np.array([0, *[1 << b for b in range(64) if int(varying) >> b & 1]], np.uint64)
    passes = 1 + len(members) * len(flips) // BETWEEN
    for part in range(passes):
        words, owners = [], []
        for flip in flips:
            word = values ^ flip
            mine = np.flatnonzero((word * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(passes) == part) if passes > 1 else np.arange(len(word))
            words.append(word[mine])
            owners.append(members[mine])
        word, owner = np.concatenate(words), np.concatenate(owners)
        order = np.argsort(word)
        starts = runs(word[order])
        lead = np.repeat(owner[order][starts], np.diff(np.append(starts, len(order))))
        other = lead != owner[order]
        yield lead[other], owner[order][other]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: orrery_row_key, doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints over 3-word shingles, repeats included, of the text with A-Z
    in lower case; two documents are linked if their fingerprints differ in at
    most 2 bits; component_id is the smallest id that can be reached, itself
    included. Null texts have no words; texts without words have fingerprint
    zero and link like any other. Null ids are never the smallest; a component
    of null ids alone has a null component_id. Repeated rows are kept; further
    columns, of whatever names, are not looked at. An empty table gives an empty result.
    """
    marks = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    parts = connected_components(fingerprint_links(distinct))
    labelled = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("label"))
    labelled = cut(labelled)
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of = labelled.join(least, "label").select("fp", "component_id")
    return marks.join(of, "fp").select(_KEY, "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup_stage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Docs with one document of each group, that of the smallest id (nulls last), and their columns as they are, whatever the names.

    Of rows that repeat an id and a text one stays; of several texts under the
    smallest id, the one whose key is least. Wordless and null texts are one
    group. Texts of any length count whole; an empty table stays empty.
    """
    groups = cut(near_groups(docs, id_col, text_col))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col(_KEY).alias("k"))
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("print "), "fingerprint"))
    kept = groups.groupBy(group.alias("g")).agg(F.min(order).alias("first")).select(F.col("first.k").alias(_KEY))
    keyed = numbered(docs).withColumn(_KEY, row_key(place(docs, id_col), place(docs, text_col)))
    return keyed.join(kept, _KEY, "left_semi").dropDuplicates([_KEY]).drop(_KEY).toDF(*docs.columns)
