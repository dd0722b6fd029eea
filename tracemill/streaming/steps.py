"""Streaming variants of two trace operators. An extension: batch queries do not need it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str, late: str) -> DataFrame:
    """Counts and sums per kind and tumbling window; rows later than ``late`` behind the watermark are left out."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def transitions(events: DataFrame, key: str, step: str, state: str) -> DataFrame:
    """(key, step, previous, state): each row with the state one step before it, 'START' if there is none.

    Keeps one (step, state) per key; rows of a key are taken in order of step within a batch.
    """

    def run(k, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, previous = held.get if held.exists else (None, "START")
        out = []
        rows = pd.concat(batches).sort_values(step)
        for at, now in zip(rows[step].tolist(), rows[state].tolist(), strict=True):
            out.append((k[0], at, previous if last is not None and at == last + 1 else "START", now))
            last, previous = at, now
        held.update((last, previous))
        yield pd.DataFrame(out, columns=[key, "step", "previous", "state"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, step long, previous string, state string", "step long, state string", "append", GroupStateTimeout.NoTimeout)
