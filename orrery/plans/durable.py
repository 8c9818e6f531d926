"""Cut points that survive the loss of an executor."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, a folder of our own in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="orrery-checkpoint-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder, so that what follows neither recomputes nor loses them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that a broadcast may have, counted first.
BROADCAST_ROWS = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """The same rows, to be broadcast if they are few enough when counted; else joins shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Rows that a task gets to aggregate or sort at once, on average.
TASK_ROWS = 1 << 19


def parts(rows: DataFrame) -> int:
    """Partitions in which a task gets TASK_ROWS of the rows at most, on average; they are counted."""
    return max(shuffle_partitions(rows.sparkSession), -(-rows.count() // TASK_ROWS))


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let Arrow batches to Python hold at most so many bytes in this session: long texts would make batches of 10,000 rows large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or int(now.rstrip("b")) > most or int(now.rstrip("b")) <= 0:
        spark.conf.set(key, f"{most}b")
