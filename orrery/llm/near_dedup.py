"""Near-dedup of the pipeline: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Sketches. The SimHash fingerprint of op8, and BANDS keys of ROWS minima
   each, of the shingle hashes under different permutations: a pair at 0.8
   shares a key with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.99994, a
   closer one more often.
2. Clusters. Components over fingerprints that differ in at most 2 bits
   (Golay-coded segments, see simhash) and over shared keys; every document in
   one with others sends its shingles once, so a hot key costs what its
   documents cost. Fingerprints alone would miss edited copies, which differ
   in more bits; keys alone miss one pair in some 16,000 at the limit.
3. Checks. Within a cluster exact similarities decide. The distance 1 - J is a
   metric: what is farther than twice the limit from a pivot is too far from
   all that the pivot holds, so a large group of near copies is compared with
   its pivot and not by pairs, with the same components.

Equal sets are one node, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import simhash
from orrery.llm.columns import numbered, place, row_key
from orrery.llm.substring_dedup import pack, unpack
from orrery.llm.words import WordHashes, hashed_words, raw, run_spans, runs, slices, window_hashes
from orrery.operators.graph import connected_components, forest
from orrery.plans.durable import bounded_batches, cut, shuffle_partitions

SHINGLE = 5
#: Least Jaccard similarity of near copies, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 32, 6
CHUNK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_KEY = "orrery_row_key"


def shingle_sets(texts: list[bytes], cache: WordHashes) -> list[np.ndarray]:
    """The sorted hashes of the shingles of each text, A-Z in lower case; a shorter text is one shingle, a wordless one none."""
    hashes, ends = hashed_words([t.lower() for t in texts], cache)
    windows = window_hashes(hashes, SHINGLE)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out.append(np.unique(windows[a : b - SHINGLE + 1] if b - a >= SHINGLE else window_hashes(hashes[a:b], b - a) if b > a else windows[:0]))
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set, none of them empty."""
    draw = np.random.default_rng(5)
    flips, odds = (draw.integers(0, 1 << 32, BANDS * ROWS, np.uint32) for _ in range(2))
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for k, (flip, odd) in enumerate(zip(flips, odds | np.uint32(1), strict=True)):
        least = np.minimum.reduceat((flat ^ flip) * odd, starts).astype(np.uint64)
        keys[:, k // ROWS] = (keys[:, k // ROWS] ^ least ^ np.uint64(k // ROWS << 40)) * _ODD
        keys[:, k // ROWS] ^= keys[:, k // ROWS] >> np.uint64(29)
    return keys.view(np.int64)


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: orrery_row_key, doc_id, node (of the shingle set), keys (packed; empty for wordless texts), fp (of op8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches, "text", CHUNK_BYTES):
            texts = raw(batch.column("text"))
            sets = shingle_sets(texts, cache)
            prints = simhash._fingerprints(texts)
            some = [i for i, s in enumerate(sets) if len(s)]
            keys = [b""] * len(sets)
            for i, row in zip(some, band_keys([sets[i] for i in some]) if some else (), strict=True):
                keys[i] = row.tobytes()
            nodes = pa.array([node_of(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(_KEY), batch.column("doc_id"), nodes, pa.array(keys, pa.binary()), pa.array(prints.view(np.int64))], names=[_KEY, "doc_id", "node", "keys", "fp"])

    bounded_batches(docs.sparkSession)
    number, text = place(docs, id_col), place(docs, text_col)
    rows = numbered(docs).select(row_key(number, text).alias(_KEY), F.col(number).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"{_KEY} binary, doc_id long, node long, keys binary, fp long")


def _buckets(values: np.ndarray, buckets: int) -> np.ndarray:
    return (values.view(np.uint64) * _ODD >> np.uint64(33)).astype(np.int64) % buckets


def _keyed(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {n: k for n, k in zip(batch.column("node").to_pylist(), batch.column("keys").to_pylist(), strict=True) if k}
            nodes = np.repeat(np.array(list(of), np.int64), BANDS)
            keys = np.frombuffer(b"".join(of.values()), np.int64)
            bucket = _buckets(keys, buckets)
            order = np.argsort(bucket, kind="stable")
            names, data = [], []
            for a, b in run_spans(bucket[order]):
                names.append(int(bucket[order[a]]))
                data.append(pack(keys[order[a:b]], nodes[order[a:b]]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "data"])

    return run


def fingerprint_edges(marks: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the nodes of sketches() whose fingerprints link as in op8: equal ones, and those that differ in at most 2 bits, step by step."""
    some = marks.where(F.length("keys") > 0).select("node", "fp").distinct()
    parts = connected_components(simhash.fingerprint_links(some.select("fp").distinct()))
    of = some.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("node", F.coalesce("component", "fp").alias("part"))
    least = of.groupBy("part").agg(F.min("node").alias("b"))
    return of.join(least, "part").where("node <> b").select(F.col("node").alias("a"), "b")


def _edges(nodes: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.Table:
    root = forest(len(nodes), left, right)
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table({"a": pa.array(nodes[moved], pa.int64()), "b": pa.array(nodes[root[moved]], pa.int64())})


def _shared(table: pa.Table) -> pa.Table:
    parts = [unpack(x) for x in table.column("data").to_pylist()]
    keys, nodes = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    nodes, at = np.unique(nodes, return_inverse=True)
    order = np.argsort(keys, kind="stable")
    starts = runs(keys[order])
    lead = np.repeat(at[order][starts], np.diff(np.append(starts, len(keys))))
    return _edges(nodes, lead, at[order])


def similar(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all of the sets whose Jaccard similarity is at least LEAST, and no others."""
    up, down = LEAST
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    mark = np.zeros(int(codes.max()) + 1, bool)

    def against(one: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of what one set has in common with each of the others, and of the unions."""
        own = codes[ends[one] - sizes[one] : ends[one]]
        mark[own] = True
        inner = np.array([np.count_nonzero(mark[codes[ends[o] - sizes[o] : ends[o]]]) for o in others.tolist()], np.int64)
        mark[own] = False
        return inner, sizes[one] + sizes[others] - inner

    left, right = [], []
    open_ = np.arange(len(sets))
    while len(open_) > 1:
        pivot, open_ = int(open_[0]), open_[1:]
        inner, union = against(pivot, open_)
        near = down * inner >= up * union
        held = open_[near]
        left += [pivot] * len(held)
        right += held.tolist()
        # 1 - J of twice the limit at most
        between = open_[~near & (down * inner >= (2 * up - down) * union)]
        for one in held.tolist():
            if not len(between):
                break
            inner, union = against(one, between)
            linked = down * inner >= up * union
            left += [one] * int(linked.sum())
            right += between[linked].tolist()
            between = between[~linked]
        open_ = open_[~near]
    return np.array(left, np.int64), np.array(right, np.int64)


def _with_sets(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches, "text", CHUNK_BYTES):
            sets = shingle_sets(raw(batch.column("text")), cache)
            cluster, node = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("cluster", "node"))
            bucket = _buckets(cluster, buckets)
            order = np.argsort(bucket, kind="stable")
            names, data = [], []
            for a, b in run_spans(bucket[order]):
                pick = order[a:b]
                names.append(int(bucket[pick[0]]))
                data.append(pack(cluster[pick], node[pick], np.array([len(sets[i]) for i in pick.tolist()], np.int64), np.concatenate([sets[i] for i in pick.tolist()]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "data"])

    return run


def _checked(table: pa.Table) -> pa.Table:
    clusters: dict[int, dict[int, np.ndarray]] = {}
    for data in table.column("data").to_pylist():
        cluster, node, size, flat = unpack(data)
        for c, n, s in zip(cluster.tolist(), node.tolist(), np.split(flat, np.cumsum(size)[:-1]), strict=True):
            clusters.setdefault(c, {})[n] = s
    out = []
    for c in sorted(clusters):
        nodes = np.array(sorted(clusters[c]), np.int64)
        out.append(_edges(nodes, *similar([clusters[c][n] for n in nodes.tolist()])))
    return pa.concat_tables(out)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: orrery_row_key, doc_id, node, label (of its component), component_id.

    component_id is the smallest id that can be reached over pairs of a Jaccard
    similarity of at least LEAST, itself included; wordless and null texts are
    one group. Null ids are never the smallest; a component of null ids alone
    has a null component_id. Repeated rows are kept; further columns, of
    whatever names, are not looked at; an empty table gives an empty result.
    """
    buckets = shuffle_partitions(docs.sparkSession)
    marks = cut(sketches(docs, id_col, text_col))
    shared = marks.select("node", "keys").mapInArrow(_keyed(buckets), "bucket long, data binary").groupBy("bucket").applyInArrow(_shared, "a long, b long")
    clusters = connected_components(shared.unionByName(fingerprint_edges(marks))).withColumnRenamed("component", "cluster")
    one = marks.join(clusters, "node").groupBy("node", "cluster").agg(F.min(_KEY).alias(_KEY))
    text = place(docs, text_col)
    texts = numbered(docs).select(row_key(place(docs, id_col), text).alias(_KEY), F.col(text).alias("text")).join(one, _KEY)
    links = texts.select("cluster", "node", "text").mapInArrow(_with_sets(buckets), "bucket long, data binary").groupBy("bucket").applyInArrow(_checked, "a long, b long")
    parts = connected_components(links)
    distinct = marks.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    labelled = cut(distinct.join(parts, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("label")))
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of = labelled.join(least, "label").select("node", "label", "component_id")
    return marks.join(of, "node").select(_KEY, "doc_id", "node", "label", "component_id")


def near_dedup_stage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Docs with one document of each group, that of the smallest id (nulls last), and their columns as they are, whatever the names.

    Of rows that repeat an id and a text one stays; of several texts under the
    smallest id, the one whose key is least. Wordless and null texts are one
    group. Texts of any length count whole; an empty table stays empty.
    """
    groups = cut(near_groups(docs, id_col, text_col))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col(_KEY).alias("k"))
    kept = groups.groupBy("label").agg(F.min(order).alias("first")).select(F.col("first.k").alias(_KEY))
    keyed = numbered(docs).withColumn(_KEY, row_key(place(docs, id_col), place(docs, text_col)))
    return keyed.join(kept, _KEY, "left_semi").dropDuplicates([_KEY]).drop(_KEY).toDF(*docs.columns)
