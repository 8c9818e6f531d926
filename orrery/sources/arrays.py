"""Sensor arrays (NPZ) as long pixel tables, read by Spark as bytes."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 100_000


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, y, x, r, g, b, depth_m, instance) of NPZ files with rgb (H, W, 3), depth_m and instance_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with np.load(io.BytesIO(content.as_py())) as held:
                    rgb, depth, instance = held["rgb"], held["depth_m"], held["instance_id"]
                h, w = depth.shape
                y, x = np.divmod(np.arange(h * w), w)
                flat = rgb.reshape(-1, 3).astype(np.int32)
                cols = [y.astype(np.int32), x.astype(np.int32), *flat.T, depth.ravel().astype(np.float64), instance.ravel().astype(np.int64)]
                for a in range(0, h * w, ROWS):
                    part = [pa.array(np.ascontiguousarray(c[a : a + ROWS])) for c in cols]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part[0])), *part], names=["path", "y", "x", "r", "g", "b", "depth_m", "instance"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, y int, x int, r int, g int, b int, depth_m double, instance long")


def views_of(rows: DataFrame) -> DataFrame:
    """Pixels with the file's name as view."""
    return rows.withColumn("view", F.regexp_extract("path", r"([^/]+)\.npz$", 1))
