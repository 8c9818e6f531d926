"""Centroid clustering with exact integer distances from bit planes.

A vector of 64 components is quantised to integers and packed: plane k holds
bit k of all components in one 64-bit word, the last plane is the sign. A dot
product is a sum over pairs of planes of a power of two times the number of
bits in their conjunction, negative where one of the two is a sign plane.

Packed vectors are written once and read in every round. A round sends eight
centroids to the tasks and gets back counts and sums of each cluster, added
up in the tasks first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.columns import place
from orrery.plans.durable import cut

WIDTH = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SEED = 3
#: A squared distance of 64 components below this fits a long.
LIMIT = 1 << 27
ROWS_AT_ONCE = 8192


def to_planes(values: np.ndarray) -> np.ndarray:
    """Rows of 64 integers as bit planes of one uint64 each, as many as the largest needs, the sign plane last."""
    most = int(max(values.max(initial=0), ~values.min(initial=0)))
    count = most.bit_length() + 1
    shifted = (values[:, None, :] >> np.arange(count)[:, None]) & 1
    return np.packbits(shifted.astype(np.uint8), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def widened(planes: np.ndarray, count: int) -> np.ndarray:
    """The same integers with at least so many planes: the sign repeats."""
    return np.concatenate((planes, np.repeat(planes[:, -1:], max(count - planes.shape[1], 0), axis=1)), axis=1)


def plane_weights(count: int) -> np.ndarray:
    weights = 1 << np.arange(count, dtype=np.int64)
    weights[-1] = -weights[-1]
    return weights


def from_planes(planes: np.ndarray) -> np.ndarray:
    """Rows of 64 integers of bit planes."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")
    return np.einsum("k,nkc->nc", plane_weights(planes.shape[1]), bits.astype(np.int64))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of all rows of a with one row b: weighted counts of the bits that two planes share."""
    wa, wb = plane_weights(a.shape[1]), plane_weights(len(b))
    out = np.zeros(len(a), np.int64)
    for plane, weight in zip(b, wb.tolist(), strict=True):
        if plane:
            out += weight * (np.bitwise_count(a & plane).astype(np.int64) @ wa)
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (ties: the smaller), and the squared distance."""
    middle = to_planes(centroids)
    own = np.zeros(len(planes), np.int64)
    weights = plane_weights(planes.shape[1])
    for k, weight in enumerate(weights.tolist()):
        own += weight * (np.bitwise_count(planes & planes[:, k : k + 1]).astype(np.int64) @ weights)
    far = np.stack([own - 2 * dots(planes, m) + int(dots(m[None, :], m)[0]) for m in middle], axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(far)), best]


def _planes(column: pa.Array) -> np.ndarray:
    """Planes of a batch, all with as many as the longest row has."""
    rows = column.to_pylist()
    count = max(map(len, rows)) // 8
    sizes = np.array([len(r) // 8 for r in rows])
    out = np.empty((len(rows), count), np.uint64)
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        out[at] = widened(np.frombuffer(b"".join([rows[i] for i in at.tolist()]), np.uint64).reshape(len(at), n), count)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def packed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and planes (binary) of the vectors that count: 64 components, none of them null, infinite or NaN.

    Components become floor(1024 x). One of 2^27 or more (either sign) is an
    error, as a long could not hold its distances. Rows of other lengths, null
    vectors and vectors with null or non-finite components are left out;
    repeated rows are kept, null ids too; further columns are left out.
    """
    base = vectors.toDF(*[f"c{i}" for i in range(len(vectors.columns))])
    x = F.col(place(vectors, vector_col)).cast("array<double>")
    whole = (F.size(x) == WIDTH) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = base.filter(F.coalesce(whole, F.lit(False))).select(F.col(place(vectors, id_col)).cast("long").alias("vec_id"), x.alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            values = np.floor(SCALE * batch.column("x").flatten().to_numpy().reshape(-1, WIDTH))
            if np.abs(values).max(initial=0) >= LIMIT:
                raise ValueError(f"a component of {LIMIT / SCALE:.0f} or more")
            planes = to_planes(values.astype(np.int64))
            size = planes.shape[1] * 8
            raw = planes.tobytes()
            rows = [raw[i * size : (i + 1) * size] for i in range(len(planes))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(rows, pa.binary())], names=["vec_id", "planes"])

    return kept.mapInArrow(pack, "vec_id long, planes binary")


def first_centroids(vectors: DataFrame, count: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors with the least SHA-256 of seed:id, in that order (equal ids: by their planes; null ids last)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), F.col("planes")).limit(count).collect()
    return np.concatenate([from_planes(np.frombuffer(bytes(r["planes"]), np.uint64)[None, :]) for r in rows]) if rows else np.empty((0, WIDTH), np.int64)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """Cluster, count and component sums of the vectors nearest to each centroid: at most a row a centroid."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids), np.int64)
        total = np.zeros((len(centroids), WIDTH), np.int64)
        for batch in _pieces(batches):
            planes = _planes(batch.column("planes"))
            best, _ = nearest(planes, centroids)
            values = from_planes(planes)
            for c in np.unique(best).tolist():
                total[c] += values[best == c].sum(axis=0)
            count += np.bincount(best, minlength=len(centroids))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(centroids)), WIDTH), pa.int32()), pa.array(np.tile(np.arange(WIDTH), len(centroids)), pa.int32()), pa.array(np.repeat(count, WIDTH)), pa.array(total.ravel())],
            names=["cluster", "component", "n", "s"],
        )

    parts = vectors.mapInArrow(sums, "cluster int, component int, n long, s long").groupBy("cluster", "component")
    rows = parts.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found: dict[int, list[int]] = {}
    counts = {}
    for r in rows:
        found.setdefault(r["cluster"], [0] * WIDTH)[r["component"]] = int(r["s"])
        counts[r["cluster"]] = r["n"]
    return [(c, counts[c], s) for c, s in found.items()]


def fit(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids (integers) after so many rounds of assignment and floor means; an empty cluster keeps its centroid."""
    centroids = first_centroids(vectors, count, seed)
    for _ in range(rounds if len(centroids) else 0):
        before = centroids.copy()
        for c, n, sums in cluster_sums(vectors, centroids):
            if n:
                centroids[c] = [s // n for s in sums]
        if (before == centroids).all():
            break
    return centroids


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance (squared) of packed vectors."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            best, far = nearest(_planes(batch.column("planes")), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(assign, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (array<long>) of every vector that counts (see packed).

    Fewer vectors than centroids make fewer clusters; an empty table, or one
    without a vector that counts, gives an empty result. Equal vectors are
    rows of their own with equal clusters. Centroids that stay the same in a
    round stay so for good, so the rounds may end there.
    """
    spark = vectors.sparkSession
    held = cut(packed(vectors, id_col, vector_col))
    centroids = fit(held, count, rounds, seed)
    rows = assigned(held, centroids)
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(sums.values())
    told = [(c, s, whole, centroids[c].tolist()) for c, s in sums.items()]
    ends = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digests(rows: DataFrame) -> DataFrame:
    """The rows with centroid_sha256 (components in decimal, joined by a comma) in place of the centroid."""
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def oracle_sql(rounds: int = ROUNDS) -> str:
    """The same clustering in DuckDB, a table of components and a chain of rounds."""
    near = """SELECT i, c, far FROM (
    SELECT i, c, far, row_number() OVER (PARTITION BY i ORDER BY far, c) AS nth FROM (
      SELECT v.i, m.c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS far FROM v JOIN m{0} AS m USING (k) GROUP BY v.i, m.c)) WHERE nth = 1"""
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS i, vec_id, e FROM (SELECT vec_id, [CAST(y AS DOUBLE) FOR y IN embedding] AS e FROM embeddings)
  WHERE len(e) = {WIDTH} AND len([1 FOR y IN e IF y IS NULL OR NOT isfinite(y)]) = 0)""",
        f"v AS (SELECT i, vec_id, k, CAST(floor({SCALE} * e[k]) AS BIGINT) AS x FROM kept, (SELECT unnest(range(1, {WIDTH + 1})) AS k))",
        f"""m0 AS (SELECT c, k, x FROM v JOIN (SELECT i, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM kept
    ORDER BY sha256('{SEED}:' || vec_id) LIMIT {CENTROIDS}) USING (i))""",
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r)})")
        steps.append(
            f"""m{r + 1} AS MATERIALIZED (SELECT c, k, CASE WHEN n IS NULL THEN m.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM m{r} AS m
    LEFT JOIN (SELECT c, k, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{r} USING (i) GROUP BY c, k) USING (c, k))"""
        )
    steps.append(f"a AS MATERIALIZED ({near.format(rounds)})")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, far AS distance, CAST(sum(far) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(far) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a JOIN kept USING (i) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY k)) AS h FROM m{rounds} GROUP BY c) AS d ON d.c = a.c"""


ORACLE_SQL = oracle_sql()
