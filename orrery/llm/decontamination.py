"""Benchmark decontamination by latent semantic retrieval.

1. Words. Each text becomes the 32-bit hashes of its words (lower case, outer
   punctuation off), written once; passages of 48 words that hold each of
   FEATURES hashed terms are counted over all texts.
2. Spaces. A randomised SVD of TF-IDF rows (at most SPACE_ROWS item passages
   and all corpus passages) gives RANK latent dimensions; more items make more
   spaces, so each holds its items whatever their number. Tasks project every
   passage on a random matrix and sum two small products, once; the driver adds
   those of a space's items and takes its basis, whose size is set by FEATURES
   and RANK alone. Items longer than ONE_PASSAGE are several passages of a
   window each.
3. Candidates. Every window of 48 words, 16 apart, of every text is projected
   into every space and compared with its items, in blocks; the cosine is taken against the
   whole TF-IDF length of the window.
4. Checks. The longest common subsequence of item and surroundings, in words,
   must hold most of the item; a weaker one must hold its answer too.

Items of fewer than SHORT words hold too few terms for a cosine; they are found
exactly, as word sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.columns import by_keys, numbered, place, row_key
from orrery.llm.words import raw, slices, window_hashes
from orrery.plans.durable import bounded_batches, cut

FEATURES = 1 << 14
RANK, OVERSAMPLE = 128, 16
BLOCK, BLOCKS = 16, 3
WINDOW = BLOCK * BLOCKS
#: All corpus passages weigh no more in a basis than so many, however many they are; else they would drown a space's items.
CORPUS_ROWS = 10_000
ITEM_WEIGHT = 4.0
#: Item passages that one space of RANK dimensions holds, and spaces (8 MB each) that a pass over the corpus compares with.
SPACE_ROWS, SPACES = 256, 8
#: An item of more words is indexed as passages of a window each.
ONE_PASSAGE = WINDOW + BLOCK
ITEM_BLOCK = 1024
#: Least cosine of a candidate with an item as long as a window; a shorter item fills less of it, so less by the root of its share.
COSINE = 0.34
#: Share of an item's words, in order, that marks a copy; or, with the answer, a paraphrase.
COPY, PARAPHRASE, ANSWER = 0.8, 0.55, 0.6
#: Items of fewer words are searched for as exact sequences of words.
SHORT = 8
#: The benchmark is a query set that the driver and every task hold: at most so many bytes of text.
BENCHMARK_BYTES = 64 << 20
#: Items of fewer words are reported but make no document go; 1 leaves none out.
LEAST_WORDS = 1
#: Words at the end of an item that stand for its answer where none is given.
ANSWER_WORDS = 8
CHUNK_BYTES = 1 << 20
#: Blocks, or windows, that are projected at a time.
PROJECTED = 1024
#: Passages whose products are summed at a time.
SUMMED = 32
_OUTER = b".,;:!?\"'()[]{}|*#$%&<>-"
#: Blocks in which the sums over tasks are made.
SUM_BLOCKS = 32
_FAN = 256


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(word.strip(_OUTER))
        return h


def word_hashes(text: bytes, cache: dict | None = None) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map((_Hashes() if cache is None else cache).__getitem__, words), np.uint32, len(words))


@dataclass
class Space:
    """A basis and the item passages in it: the number of the item, its least cosine, its latent row."""

    basis: np.ndarray
    item: np.ndarray
    least: np.ndarray
    latent: np.ndarray


@dataclass
class Index:
    """The items of one pass over the corpus by number, their spaces, and short items by length: hashes in order with the number of each."""

    items: dict[int, tuple[int, np.ndarray, np.ndarray]]
    idf: np.ndarray
    spaces: list[Space]
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def passages(item: np.ndarray) -> list[np.ndarray]:
    """The item, or for a long one windows that cover it, the last at its end."""
    if len(item) <= ONE_PASSAGE:
        return [item]
    return [item[a : a + WINDOW] for a in (*range(0, len(item) - WINDOW, WINDOW), len(item) - WINDOW)]


def passage_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of kind 0: a row of docs (row_key, doc_id) with its packed word hashes. Rows of kind 1: a task's passage counts by term (part: the task, doc_id: its passages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts, passages = _Hashes(), np.zeros(FEATURES, np.int64), 0
        for batch in slices(batches, "text", CHUNK_BYTES):
            words = [word_hashes(t, cache) for t in raw(batch.column("text"))]
            data = [w.tobytes() for w in words]
            base = 0
            keys = []
            for w in words:
                keys.append((np.arange(len(w)) // WINDOW + base) * FEATURES + w % FEATURES)
                base += -(-len(w) // WINDOW)
            passages += base
            counts += np.bincount(np.unique(np.concatenate(keys)) % FEATURES, minlength=FEATURES)
            kind = pa.array(np.zeros(len(data), np.int32))
            none = pa.nulls(len(data), pa.int64())
            yield pa.RecordBatch.from_arrays([kind, batch.column("row_key"), batch.column("doc_id"), none, pa.array(data, pa.binary())], names=names)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([1], pa.int32()), pa.nulls(1, pa.binary()), pa.array([passages], pa.int64()), pa.array([task], pa.int64()), pa.array([counts.tobytes()], pa.binary())], names=names
        )

    names = ["kind", "row_key", "doc_id", "part", "data"]
    bounded_batches(docs.sparkSession)
    number, text = place(docs, id_col), place(docs, text_col)
    rows = numbered(docs).select(row_key(number, text).alias("row_key"), F.col(number).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "kind int, row_key binary, doc_id long, part long, data binary")


def _sums(rows: DataFrame, dtype: type) -> np.ndarray:
    """The sum of packed arrays that come in blocks (columns part, block, data): by some parts, over parts, and the blocks joined in order."""

    def total(key: tuple, table: pa.Table) -> pa.Table:
        out = 0
        for x in table.column("data").to_pylist():
            out = out + np.frombuffer(x, dtype)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([out.tobytes()], pa.binary())})

    once = rows.groupBy("block", (F.col("part") % _FAN).alias("p")).applyInArrow(total, "block long, data binary")
    found = once.groupBy("block").applyInArrow(total, "block long, data binary").collect()
    return np.concatenate([np.frombuffer(r["data"], dtype) for r in sorted(found, key=lambda r: r["block"])]) if found else np.zeros(0, dtype)


def _weights(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a passage and their unit-length TF-IDF weights."""
    terms, counts = np.unique(hashes % FEATURES, return_counts=True)
    w = counts * idf[terms]
    return terms, w / max(np.sqrt((w * w).sum()), 1e-12)


def passage_terms(texts: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of each passage of the texts, filled up with FEATURES, and the lengths of their TF-IDF rows."""
    sizes = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    begin = (np.cumsum(sizes) - sizes) * WINDOW
    terms = np.full(int(sizes.sum()) * WINDOW, FEATURES, np.int32)
    for t, at in zip(texts, begin.tolist(), strict=True):
        terms[at : at + len(t)] = t % FEATURES
    terms = np.sort(terms.reshape(-1, WINDOW), axis=1)
    # the k-th of equal terms, from 0, counts 2k + 1: together the square of their number
    place = np.arange(WINDOW)
    new = np.ones(terms.shape, bool)
    new[:, 1:] = terms[:, 1:] != terms[:, :-1]
    repeat = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
    squares = np.append(idf**2, 0).astype(np.float32)[terms] * (2 * repeat + 1)
    return terms, np.maximum(np.sqrt(squares.sum(1)), 1e-12)


def add_products(terms: np.ndarray, length: np.ndarray, omega: np.ndarray, gram: np.ndarray, back: np.ndarray) -> None:
    """Add to gram and back what passages (see passage_terms) give; omega holds the weight of each term, by which back is still to be multiplied."""
    of, at = np.unique(terms, return_inverse=True)
    n, k = len(terms), len(of)
    w = np.bincount((at.reshape(n, -1) + np.arange(n)[:, None] * k).ravel(), minlength=n * k).reshape(n, k).astype(np.float32) / length[:, None].astype(np.float32)
    y = w @ omega[of]
    gram += y.T @ y
    back[of] += w.T @ y


def _random_matrix() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((FEATURES, RANK + OVERSAMPLE), np.float32)


def fit_indexes(words: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]]) -> list[Index]:
    """The latent spaces of the corpus words (see passage_words) and the items (id, word hashes, answer hashes), one index for each pass over the corpus."""
    tasks = words.where("kind = 1")
    count = tasks.agg(F.sum("doc_id")).first()[0] or 0
    df = _sums(tasks.select("part", F.lit(0).cast("long").alias("block"), "data"), np.int64)
    idf = np.log((count + 1.0) / ((df if len(df) else np.zeros(FEATURES)) + 1.0)).astype(np.float32) + 0.05
    size = RANK + OVERSAMPLE

    def summed(rows: Iterator[np.ndarray], weight: float) -> tuple[np.ndarray, np.ndarray]:
        omega = _random_matrix()
        gram, back = np.zeros((size, size), np.float32), np.zeros((FEATURES, size), np.float32)
        for hashes in rows:
            terms, w = _weights(hashes, idf)
            w = (weight * w).astype(np.float32)
            y = w @ omega[terms]
            gram += np.outer(y, y)
            back[terms] += np.outer(w, y)
        return gram, back

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = np.vstack([_random_matrix() * idf[:, None], np.zeros((1, size), np.float32)])
        gram, back = np.zeros((size, size)), np.zeros((FEATURES + 1, size), np.float32)
        for batch in slices(batches, "data", CHUNK_BYTES):
            terms, length = passage_terms([np.frombuffer(x, np.uint32) for x in batch.column("data").to_pylist()], idf)
            for at in range(0, len(terms), SUMMED):
                add_products(terms[at : at + SUMMED], length[at : at + SUMMED], omega, gram, back)
        gram, back = gram.astype(np.float32), back[:FEATURES] * idf[:, None]
        blocks = [gram, *np.split(back, SUM_BLOCKS)]
        part = pa.array([TaskContext.get().partitionId()] * len(blocks), pa.int64())
        data = pa.array([x.tobytes() for x in blocks], pa.binary())
        yield pa.RecordBatch.from_arrays([part, pa.array(range(len(blocks)), pa.int64()), data], names=["part", "block", "data"])

    short: dict[int, list[int]] = {}
    passes, full = [], SPACES * SPACE_ROWS
    for i, (_, hashes, _) in enumerate(items):
        if len(hashes) < SHORT:
            short.setdefault(len(hashes), []).append(i)
            continue
        rows = [(i, p) for p in passages(hashes)]
        if passes and len(passes[-1]) + len(rows) <= full:
            passes[-1] += rows
        else:
            passes.append(rows)
    exact = {}
    for n, of in short.items():
        keys = np.concatenate([window_hashes(items[i][1].astype(np.uint64), n) for i in of])
        order = np.argsort(keys, kind="stable")
        exact[n] = (keys[order], np.array(of)[order])
    few = {i: items[i] for of in short.values() for i in of}
    if not passes:
        return [Index(few, idf, [], exact)] if few else []
    # a task's sums have one size, whatever it reads, so tasks follow the cores
    texts = words.where("kind = 0").select("data").coalesce(max(8, 2 * words.sparkSession.sparkContext.defaultParallelism))
    both = _sums(texts.mapInArrow(products, "part long, block long, data binary"), np.float32).astype(np.float64) * min(1.0, CORPUS_ROWS / max(1, count))
    if not len(both):
        both = np.zeros(size * size + FEATURES * size)

    def space(mine: list[tuple[int, np.ndarray]]) -> Space:
        gram, back = summed((p for _, p in mine), ITEM_WEIGHT)
        basis = _basis(both[: size * size].reshape(size, size) + gram, both[size * size :].reshape(FEATURES, size) + back)
        latent = np.zeros((len(mine), basis.shape[1]), np.float32)
        for i, (_, hashes) in enumerate(mine):
            terms, w = _weights(hashes, idf)
            latent[i] = w @ basis[terms]
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        least = COSINE * np.sqrt(np.minimum(1, np.array([len(p) for _, p in mine]) / WINDOW))
        return Space(basis, np.array([i for i, _ in mine]), least, latent)

    out = []
    for rows in passes:
        parts = np.array_split(np.arange(len(rows)), -(-len(rows) // SPACE_ROWS))
        mine = {i: items[i] for i, _ in rows} | ({} if out else few)
        out.append(Index(mine, idf, [space([rows[i] for i in part.tolist()]) for part in parts], {} if out else exact))
    return out


def _basis(gram: np.ndarray, back: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(gram)
    good = values > max(values.max(), 1e-12) * 1e-6
    projected = back @ (vectors[:, good] / np.sqrt(values[good]))
    inner, turn = np.linalg.eigh(projected.T @ projected)
    top = np.argsort(-inner)[:RANK]
    top = top[inner[top] > 1e-9]
    return (projected @ (turn[:, top] / np.sqrt(inner[top]))).astype(np.float32)


def window_candidates(index: Index, tables: list[np.ndarray], texts: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(text, window, item) where the cosine reaches the least one of a passage of the item.

    tables: for each space, the weighted basis of each term, and zeros for the
    filling after a text's last word. Repeated terms count together within a block, for a
    length that is never too long, so no window is missed.
    """
    if not texts or not index.spaces:
        return
    sizes = np.array([max(BLOCKS, -(-len(t) // BLOCK)) for t in texts])
    begin = np.cumsum(sizes) - sizes
    terms = np.full(int(sizes.sum()) * BLOCK, FEATURES, np.int32)
    for t, at in zip(texts, begin.tolist(), strict=True):
        terms[at * BLOCK : at * BLOCK + len(t)] = t % FEATURES
    terms = terms.reshape(-1, BLOCK)
    squares = np.append(index.idf**2, 0).astype(np.float32)[terms]
    length = squares.sum(1)
    for s in range(1, BLOCK):
        length += 2 * np.where(terms[:, s:] == terms[:, :-s], squares[:, s:], 0).sum(1)
    count = len(terms) - BLOCKS + 1
    root = np.sqrt(np.maximum(sum(length[k : k + count] for k in range(BLOCKS)), 1e-9))[:, None]
    text = np.repeat(np.arange(len(texts)), sizes)
    whole = text[:count] == text[BLOCKS - 1 :]
    for space, table in zip(index.spaces, tables, strict=True):
        blocks = np.concatenate([table[terms[i : i + PROJECTED]].sum(1) for i in range(0, len(terms), PROJECTED)])
        z = sum(blocks[k : k + count] for k in range(BLOCKS))
        z /= root
        for at in range(0, len(space.item), ITEM_BLOCK):
            for w in range(0, count, PROJECTED):
                win, row = np.nonzero((z[w : w + PROJECTED] @ space.latent[at : at + ITEM_BLOCK].T >= space.least[at : at + ITEM_BLOCK]) & whole[w : w + PROJECTED, None])
                win += w
                yield from zip(text[win].tolist(), (win - begin[text[win]]).tolist(), space.item[row + at].tolist(), strict=True)


def exact_places(index: Index, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(item, first word) of each short item that the text holds word by word."""
    for n, (keys, items) in index.short.items():
        found = window_hashes(hashes.astype(np.uint64), n)
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == found)
        for key, place in zip(*np.unique(found[hit], return_index=True), strict=True):
            first = int(hit[place])
            for i in items[np.searchsorted(keys, key) : np.searchsorted(keys, key, "right")].tolist():
                if np.array_equal(index.items[i][1], hashes[first : first + n]):
                    yield i, first


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, in bit vectors."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        hit = v & places.get(x, 0)
        if hit:
            v = (v + hit | v - hit) & full
    return len(a) - v.bit_count()


def check(item: np.ndarray, answer: np.ndarray, hashes: np.ndarray, window: int) -> tuple[float, float] | None:
    """Shares of the item and of its answer found around a window, if they are enough."""
    begin = window * BLOCK
    near = hashes[max(0, begin - len(item)) : begin + WINDOW + len(item)]
    if np.isin(item, near).sum() < PARAPHRASE * len(item):
        return None
    share = common_subsequence(item, near) / len(item)
    said = common_subsequence(answer, near) / max(1, len(answer))
    return (share, said) if share >= COPY or share >= PARAPHRASE and said >= ANSWER else None


def benchmark_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", answer_col: str | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(item id, word hashes, answer hashes), for items with an id and a word; more than BENCHMARK_BYTES of text are refused."""
    answer = F.col(place(benchmark, answer_col)) if answer_col else F.lit(None).cast("string")
    rows = numbered(benchmark).select(F.col(place(benchmark, item_col)).cast("long").alias("i"), F.col(place(benchmark, text_col)).alias("t"), answer.alias("a")).where("i is not null and t is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("a"), F.lit(0)) + 16)).first()[0] or 0
    if size > BENCHMARK_BYTES:
        raise ValueError(f"a benchmark of {size} bytes: search for it in parts of {BENCHMARK_BYTES}")
    out = []
    for r in sorted(rows.collect(), key=lambda r: (r["i"], r["t"], r["a"] or "")):
        hashes = word_hashes(r["t"].encode())
        if len(hashes):
            out.append((r["i"], hashes, word_hashes(r["a"].encode()) if r["a"] else hashes[-ANSWER_WORDS:]))
    return out


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.vstack([s.basis * index.idf[:, None], np.zeros((1, s.basis.shape[1]), np.float32)]) for s in index.spaces]
        for batch in slices(batches, "data", CHUNK_BYTES):
            texts = [np.frombuffer(x, np.uint32) for x in batch.column("data").to_pylist()]
            best: dict[tuple[int, int], tuple] = {}
            for text, window, i in window_candidates(index, tables, texts):
                _, item, answer = index.items[i]
                share, said, start = best.get((text, i), (0, 0, 0))
                if share == said == 1 and start >= -window * BLOCK:
                    continue  # nothing does better than a whole copy that is found earlier
                if shares := check(item, answer, texts[text], window):
                    best[text, i] = max(best.get((text, i), (0, 0, 0)), (*shares, -window * BLOCK))
            for text, hashes in enumerate(texts):
                for i, first in exact_places(index, hashes):
                    best[text, i] = (1.0, 1.0, -first)
            keys, docs_of = batch.column("row_key").to_pylist(), batch.column("doc_id").to_pylist()
            found = [(keys[t], docs_of[t], index.items[i][0], s, a, -w) for (t, i), (s, a, w) in sorted(best.items())]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=["orrery_row_key", "doc_id", "item_id", "item_share", "answer_share", "start_word"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """Rows (orrery_row_key, doc_id, item_id, item_share, answer_share, start_word): a benchmark item that a row of docs holds, where it does best.

    Null and empty texts and items hold nothing. Repeated rows and repeated
    items are each reported. Texts and items of any length are searched whole;
    of places where an item does equally well the first is told. Further
    columns, of whatever names, are not looked at. The benchmark is a query
    set held in memory, whose size is checked. Empty tables give an empty
    result.
    """
    words = cut(passage_words(docs, id_col, text_col))
    indexes = fit_indexes(words, benchmark_items(benchmark, text_col="text", answer_col=answer_col))

    texts = words.where("kind = 0").select("row_key", "doc_id", "data")
    kept = "orrery_row_key binary, doc_id long, item_id long, item_share double, answer_share double, start_word long"
    found = [texts.mapInArrow(_search(i), kept) for i in indexes]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], kept)


def decontamination_stage(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Docs that hold no benchmark item, with their columns as they are, whatever the names.

    An item of fewer than least_words words makes no document go; by default
    every item counts, of one word too. Null and empty texts hold nothing and stay; rows that
    repeat an id and a text go together; rows of one id with different texts
    are judged apart. Texts of any length are searched whole; empty tables
    take nothing away.
    """
    text = place(benchmark, "text")
    items = numbered(benchmark).withColumn(text, F.when(F.size(F.split(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), " ")) >= least_words, F.col(text))).toDF(*benchmark.columns)
    found = cut(contaminated(docs, items, id_col, text_col).select("orrery_row_key").distinct())
    keyed = numbered(docs).withColumn("orrery_row_key", row_key(place(docs, id_col), place(docs, text_col)))
    return by_keys(keyed, found, "orrery_row_key", "left_anti").drop("orrery_row_key").toDF(*docs.columns)
