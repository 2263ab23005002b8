"""Streams of task states and logs: emit on change, newest per key, once per content."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def emit_on_change(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Rows whose value is not the key's last one. ``events`` is a stream; state is one value per key."""
    out = events.select(key, *order, value).schema

    def step(_key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        seen = state.exists
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        before = pdf[value].shift()
        fresh = pdf[value] != before
        fresh.iloc[0] = not seen or pdf[value].iloc[0] != last
        state.update((pdf[value].iloc[-1],))
        yield pdf[fresh][[key, *order, value]]

    return events.select(key, *order, value).groupBy(key).applyInPandasWithState(step, out, events.select(value).schema, "append", "NoTimeout")


def newest(log: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Per key the value of the largest entry so far; entries may come in any order (update mode)."""
    return log.groupBy(key).agg(F.max_by(F.col(value), F.struct(*order)).alias(value), F.count("*").alias("entries"))


def best_status(log: DataFrame, node: str, status: str, rank) -> DataFrame:
    """Highest status per node: a late failure never hides a success (update mode)."""
    return log.groupBy(node).agg(F.max_by(F.col(status), rank(F.col(status))).alias(status))


def once(stream: DataFrame, content: list[str], at: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each content once; with an event time, state older than ``late`` is dropped."""
    return stream.dropDuplicates(content) if at is None else stream.withWatermark(at, late).dropDuplicatesWithinWatermark(content)


def windowed(events: DataFrame, at: str, key: str, size: str = "30 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per key and window of event time, final once the watermark has passed."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, late).groupBy(w, key).agg(F.count("*").alias("n"))


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Take in all that is there now, into Parquet, and stop: an inbox read once."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
