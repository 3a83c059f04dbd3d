"""Streaming forms: tumbling and sliding windows, sessions (runs with gaps), and run
lengths with custom state, over a stream of events (ts timestamp, node, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_any(events: DataFrame, length: str, late: str, least: int = 0) -> DataFrame:
    """1 where a window holds more than ``least`` events of a node."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length), "node").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "node", (F.col("n") > least).cast("long").alias("any"), "n")


def sliding_mean(events: DataFrame, length: str, step: str, late: str) -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length, step), "node").agg(F.avg("value").alias("mean"))
    return w.select(F.col("window.start").alias("start"), "node", "mean")


def bursts(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Runs of events of a node with no pause of ``gap`` or more: session windows."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "node").agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "node", "n")


def running_lengths(events: DataFrame) -> DataFrame:
    """Length of each node's current run of positive values, by custom state: rows of a
    batch go in time order and the count survives batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (length,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for ts, value in zip(rows["ts"], rows["value"]):
            length = length + 1 if value > 0 else 0
            out.append((key[0], ts, length))
        state.update((length,))
        yield pd.DataFrame(out, columns=["node", "ts", "length"])

    return events.groupBy("node").applyInPandasWithState(step, "node long, ts timestamp, length long", "length long", "append", "NoTimeout")
