"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window.

A window is two words. Each dictionary is trained by zstandard on windows of
its own class alone. Most of a toxic text is ordinary prose, so the toxic
dictionary starts from all windows of toxic texts and is trained again, ROUNDS
times, on those that the dictionaries of other folds find toxic; ordinary
windows that these find toxic count HARD times when the ordinary dictionary is
trained again. No word is chosen, only windows, by lengths.

What two dictionaries share by chance differs from fold to fold, so a window
counts by the least length under two ordinary dictionaries less the greatest
under two toxic ones. The saved lengths of a text are counted at several
thresholds; a logistic curve, fitted on texts that the dictionaries of the
other folds measured, calibrates the counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.columns import numbered, others, place, row_key
from orrery.llm.words import raw, slices
from orrery.plans.durable import bounded_batches, cut

#: Labelled texts that a model is fitted on, of each class.
SAMPLE = 3000
#: Windows of one such text that dictionaries are trained on, evenly over the whole text (scores and the curve take all windows).
TEXT_WINDOWS = 512
FOLDS, ROUNDS, HARD = 3, 3, 5
WINDOW_WORDS = 2
#: Longer words are taken in pieces of so many bytes.
WORD_BYTES = 48
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 4_096
#: Size of the first toxic dictionary, trained on all windows of toxic texts.
FIRST_BYTES = 4 * TOXIC_BYTES
#: Segment and match length of zstandard's trainer.
SEGMENT, TRAINED_MATCH = 32, 6
MATCH = 6
#: Bytes that no text in lower case holds: what a window without any match costs is measured on them.
PROBE = bytes(range(65, 91))
#: Stands before every window and at the end of every dictionary: a frame's fixed cost is paid on it, not on the words.
MARK = bytes((*range(1, 9), *range(14, 30)))
SAVED = (1, 2, 3, 4, 5, 6, 7, 8, 10)
#: Share of ordinary windows that counts besides those seen, when the threshold of a round is set.
DOUBT = 1e-4
REMEMBERED = 200_000
_TRIM = b".,;:!?|%$#&*()\"'"
CHUNK_BYTES = 4 << 20
_DICTIONARIES = "fold int, ordinary binary, toxic binary"

Pair = tuple[bytes, bytes]


@dataclass
class Model:
    """Ordinary and toxic dictionaries of the folds, and the curve over features(); without weights, a constant."""

    pairs: list[Pair] = field(default_factory=list)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    prior: float = 0.0


def windows(text: bytes) -> list[bytes]:
    """The words of the text in lower case (ASCII), outer punctuation off, two by two; a text without any is one blank window."""
    words = [w for w in (x.strip(_TRIM) for x in text.lower().split()) if w]
    if any(len(w) > WORD_BYTES for w in words):
        words = [w[i : i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]
    return [b"  %b  " % b"  ".join(words[i : i + WINDOW_WORDS]) for i in range(0, max(1, len(words)), WINDOW_WORDS)]


def compressor(content: bytes) -> Callable[[bytes], bytes]:
    params = zstandard.ZstdCompressionParameters.from_level(
        1, min_match=MATCH, strategy=zstandard.STRATEGY_BTOPT, search_log=2, hash_log=18, chain_log=17, target_length=64, window_log=17,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    held = zstandard.ZstdCompressionDict(content + MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary that zstandard trains on the samples; where they are too few to train on, themselves."""
    order = sorted(range(len(samples)), key=lambda i: (i * 0x9E3779B97F4A7C15 & (1 << 64) - 1, i))
    try:
        return zstandard.train_dictionary(size + 1024, [samples[i] for i in order], k=SEGMENT, d=TRAINED_MATCH).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def measure(pairs: list[Pair]) -> Callable[[bytes], int]:
    """For a window, the bytes that every toxic dictionary saves over every ordinary one; 0 where a toxic one finds nothing in it."""
    made = []
    for ordinary, toxic in pairs:
        shorter = compressor(toxic)
        made.append((compressor(ordinary), shorter, len(shorter(MARK + PROBE)) - len(PROBE)))
    known: dict[bytes, int] = {}

    def saved(window: bytes) -> int:
        if (n := known.get(window)) is not None:
            return n
        marked, least, most = MARK + window, 1 << 30, 0
        for ordinary, toxic, nothing in made:
            n = len(toxic(marked))
            most = max(most, n)
            if n >= len(window) + nothing or most >= least:
                least = 0
                break
            least = min(least, len(ordinary(marked)))
            if most >= least:
                break
        if len(known) >= REMEMBERED:
            known.clear()
        known[window] = n = max(0, least - most)
        return n

    return saved


def features(saved: list[int]) -> list[float]:
    n, of = len(saved), np.bincount(np.minimum(saved, SAVED[-1]), minlength=SAVED[-1] + 1)
    counts = [int(of[k:].sum()) for k in SAVED]
    return [*map(math.log1p, counts), *[c / n for c in counts], float(max(saved)), sum(saved) / n, math.log(n)]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    z = np.column_stack([np.ones(len(x)), x])
    b, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ b)
    return b


def scorer(model: Model) -> Callable[[bytes], float]:
    """Text to score, with the dictionaries of two folds, as when the curve was fitted."""
    if model.weights is None:
        return lambda text: model.prior
    saved = measure(model.pairs[: FOLDS - 1])

    def score(text: bytes) -> float:
        x = (np.array(features([saved(w) for w in windows(text)])) - model.mean) / model.scale
        return float(1 / (1 + np.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -30, 30))))

    return score


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """Rows (k, fold, y, text): of each class at most `sample` different labelled rows that are not held out, the first by hash."""
    known = numbered(labels).select(F.col(place(labels, "doc_id")).alias("i"), F.col(place(labels, "toxic")).cast("int").alias("y")).where("i is not null and y in (0, 1)").where(~held_out(F.col("i"))).distinct()
    rows = numbered(docs).select(F.col(place(docs, id_col)).alias("i"), F.col(place(docs, text_col)).alias("text")).where("i is not null and text is not null")
    keyed = rows.withColumn("k", row_key("i", "text"))
    keys = keyed.select("i", "k").distinct().join(known, "i").select("k", "y")
    picked = [keys.where(F.col("y") == y).orderBy("k").limit(sample) for y in (0, 1)]
    # at most 2 * sample keys of 16 bytes
    found = keyed.join(F.broadcast(picked[0].unionAll(picked[1])), "k").dropDuplicates(["k", "y"])
    return found.select("k", F.pmod(F.xxhash64("k"), F.lit(FOLDS)).cast("int").alias("fold"), "y", "text")


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", CHUNK_BYTES):
        data = []
        for text in raw(batch.column("text")):
            all_of = windows(text)
            n = min(len(all_of), TEXT_WINDOWS)
            data.append(b"\n".join(all_of[i * len(all_of) // n] for i in range(n)))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("k", "fold", "y")], pa.array(data, pa.binary())], names=["k", "fold", "y", "data"])


def _measured(pairs: dict[int, Pair]):
    """Adds to the windows of each text how many bytes each saves under the dictionaries of the other folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {f: measure([p for g, p in sorted(pairs.items()) if g != f]) for f in range(FOLDS)}
        for batch in batches:
            saved = [bytes(min(of[f](w), 255) for w in data.split(b"\n")) for f, data in zip(batch.column("fold").to_pylist(), batch.column("data").to_pylist(), strict=True)]
            yield batch.append_column("saved", pa.array(saved, pa.binary()))

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 256), np.int64)
    for batch in batches:
        for y, saved in zip(batch.column("y").to_pylist(), batch.column("saved").to_pylist(), strict=True):
            total[y] += np.bincount(np.frombuffer(saved, np.uint8), minlength=256)
    y, n = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(n, pa.int32()), pa.array(total[y, n])], names=["y", "saved", "n"])


def _threshold(measured: DataFrame) -> int:
    """The saved bytes from where toxic windows stand out most from ordinary ones."""
    counts = np.zeros((2, 256))
    for r in measured.select("y", "saved").mapInArrow(_counted, "y int, saved int, n long").groupBy("y", "saved").agg(F.sum("n").alias("n")).collect():
        counts[r["y"], r["saved"]] = r["n"]
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] / np.maximum(counts.sum(1, keepdims=True), 1)
    return 1 + int(np.argmax(((above[1] - above[0]) / np.sqrt(above[0] + DOUBT))[1:12]))


def _train(least: int | None, before: dict[int, Pair]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        fold = key[0].as_py()
        rows = sorted(table.to_pylist(), key=lambda r: (r["k"], r["y"]))
        ordinary, toxic = [], []
        for r in rows:
            found = r["data"].split(b"\n")
            saved = r["saved"] if least else None
            if not r["y"]:
                ordinary += found + [w for w, n in zip(found, saved or (), strict=False) if n for _ in range(HARD)]
            else:
                toxic += [w for w, n in zip(found, saved, strict=True) if n >= least] if least else found
        plain = trained(ordinary, ORDINARY_BYTES)
        marked = trained(toxic, TOXIC_BYTES if least else FIRST_BYTES) if toxic or not least else before[fold][1]
        return pa.table({"fold": pa.array([fold], pa.int32()), "ordinary": pa.array([plain], pa.binary()), "toxic": pa.array([marked], pa.binary())})

    return run


def train_dictionaries(sample: DataFrame) -> dict[int, Pair]:
    """The ordinary and the toxic dictionary of each fold of the sample, each trained in a task of its own; the driver sees dictionaries and counts alone."""
    texts = cut(sample.mapInArrow(_windows_of, "k binary, fold int, y int, data binary").repartition(4 * FOLDS, "k"))

    def dictionaries(rows: DataFrame, least: int | None, before: dict[int, Pair]) -> dict[int, Pair]:
        found = {r["fold"]: (r["ordinary"], r["toxic"]) for r in rows.groupBy("fold").applyInArrow(_train(least, before), _DICTIONARIES).collect()}
        return {f: found.get(f, (b"", b"")) for f in range(FOLDS)}

    pairs = dictionaries(texts, None, {})
    for _ in range(ROUNDS):
        measured = cut(texts.mapInArrow(_measured(pairs), "k binary, fold int, y int, data binary, saved binary"))
        pairs = dictionaries(measured, _threshold(measured), pairs)
    return pairs


def fit_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model of the labelled documents that are not held out: of each class at most `sample`, the first by hash, and of these whole texts of any length.

    Null labels, ids and texts are left out. Repeated rows count once; an id
    with several texts, or both labels, gives a row for each. Labels of one
    kind only, or none, give a constant. Further columns are not looked at.
    """
    bounded_batches(docs.sparkSession)
    rows = cut(labelled_sample(docs, labels, id_col, text_col, sample))
    kinds = [r["y"] for r in rows.select("y").distinct().collect()]
    if len(kinds) < 2:
        return Model(prior=float(kinds[0]) if kinds else 0.0)
    pairs = train_dictionaries(rows)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {f: measure([p for g, p in sorted(pairs.items()) if g != f]) for f in range(FOLDS)}
        for batch in slices(batches, "text", CHUNK_BYTES):
            x = [features([of[f](w) for w in windows(t)]) for f, t in zip(batch.column("fold").to_pylist(), raw(batch.column("text")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["k", "y", "x"])

    # at most 2 * sample rows of some twenty numbers
    found = rows.repartition(4 * FOLDS, "k").mapInArrow(measured, "k binary, y int, x array<double>").collect()
    found.sort(key=lambda r: (r["k"], r["y"]))
    x, y = np.array([r["x"] for r in found]), np.array([r["y"] for r in found])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return Model([pairs[f] for f in range(FOLDS)], mean, scale, _logistic((x - mean) / scale, y))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with held_out, score and predicted after its columns.

    The whole text counts, whatever its length; null and empty texts are
    scored as one blank window. Only the text goes into the score. Repeated
    rows are scored alike; a null id is never held out. Columns of the added
    names, in whatever case, are replaced; any other name may be used. An
    empty table gives an empty result.
    """
    kept = others(docs, ("held_out", "score", "predicted"))
    text = place(docs, text_col)
    base = numbered(docs)
    base = base.select(*dict.fromkeys((*kept, text)), held_out(F.col(place(docs, id_col))).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in slices(batches, text, CHUNK_BYTES):
            scores = np.array([score(t) for t in raw(batch.column(text))], np.float64)
            own = [batch.column(c) for c in (*kept, "held_out")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*kept, "held_out", "score", "predicted"])

    bounded_batches(docs.sparkSession)
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in base.schema if f.name in kept)
    return base.mapInArrow(run, f"{kinds}held_out boolean, score double, predicted int").toDF(*kept.values(), "held_out", "score", "predicted")


def toxicity_stage(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Docs that are not predicted toxic, with their columns as they are, whatever the names.

    Null and empty texts are scored as one blank window, repeated rows alike;
    without labels of both kinds a constant decides. Texts of any length are
    scored whole. An empty table stays empty.
    """
    model = fit_on_labels(docs, labels, id_col, text_col)
    kept = toxicity(numbered(docs), model, place(docs, id_col), place(docs, text_col)).where("predicted = 0")
    return kept.drop("held_out", "score", "predicted").toDF(*docs.columns)
