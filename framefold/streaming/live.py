"""Folds, windows and sinks over streams of frames.

A fold's state lives in the state store as bytes, by stream; its step is the one that batches run. Rows of a micro-batch
are taken in order, and rows at or behind a stream's last one are late: they are dropped, so a replayed batch changes
nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framefold.operators.folds import Fold, as_frame, as_rows


def run_stream(frames: DataFrame, fold: Fold, key: str = "stream_id", order: str = "seq") -> DataFrame:
    """The fold over a stream of frames, rows in append mode. Rows of `fold.end` come only from batches, as streams have no end."""
    schema = f"{key} long, {fold.schema}"

    def update(keys: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, last = pickle.loads(held.get[0]) if held.exists else (fold.start(), None)
        frame = pd.concat(list(parts))
        out = []
        for row in as_rows(frame, order):
            if last is None or row[order] > last:
                out += [{key: keys[0]} | r for r in fold.step(state, row)]
                last = row[order]
        held.update((pickle.dumps((state, last)),))
        yield as_frame(out, schema)

    return frames.groupBy(key).applyInPandasWithState(update, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def telemetry_stream(samples: DataFrame, at: str, value: str, window: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Per tumbling window the samples, their mean and their greatest; late rows wait as long as the watermark says."""
    grouped = samples.withWatermark(at, late).groupBy(F.window(at, window))
    return grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most")).select(F.col("window.start").alias("window_start"), "n", "mean", "most")


def gap_sessions(frames: DataFrame, at: str, gap: str, late: str, key: str = "stream_id") -> DataFrame:
    """Sessions that a gap in event time ends; the rules of games need the session fold."""
    grouped = frames.withWatermark(at, late).groupBy(key, F.session_window(at, gap))
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def once(games: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """At-least-once deliveries of games made single by key, for as long as the watermark remembers."""
    return games.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def fan_out(frames: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, failed: Callable[[str, Exception], None]) -> StreamingQuery:
    """Each micro-batch to every sink; one sink's failure is told to `failed` and leaves the others alone."""

    def deliver(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(batch, number)
                except Exception as e:  # a sink is outside of our hands
                    failed(name, e)
        finally:
            batch.unpersist()

    return frames.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deliver).start()


def upsert_games(folder: str, key: str = "game_id") -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch's games under its number, so that a repeated batch overwrites itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return sink
