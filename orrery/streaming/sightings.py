"""Sightings as a stream. An addition of this library: belief deltas and counts as data arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sightings in tumbling windows; those later than the watermark are left out."""
    w = F.window(time, window)
    return events.withWatermark(time, late).groupBy(w, key).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), key, "n", "value")


def belief_deltas(events: DataFrame, episode: str, entity: str, time: str) -> DataFrame:
    """(episode, entity, ts, change) in arrival order: added when an episode first sees an entity, reobserved after.

    State is one flag for each episode and entity, so no group grows.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.exists
        for rows in batches:
            rows = rows.sort_values(time)
            change = ["reobserved"] * len(rows)
            if not known and len(rows):
                change[0], known = "added", True
            yield pd.DataFrame({"episode": key[0], "entity": key[1], "ts": rows[time], "change": change})
        if known and not state.exists:
            state.update((True,))

    rows = events.select(F.col(episode).alias("episode"), F.col(entity).alias("entity"), time)
    return rows.groupBy("episode", "entity").applyInPandasWithState(run, "episode long, entity string, ts timestamp, change string", "seen boolean", "append", GroupStateTimeout.NoTimeout)
