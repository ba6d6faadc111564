"""Streams of requests and decisions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arbitra.operators.decide import Question, ask
from arbitra.sources.logs import hard_cases


def _per_batch(path: str, make: Callable[[DataFrame], DataFrame], partitions: Sequence[str] = ()):
    """Sink that writes batch n to ``batch_id=n``. A batch replayed after a
    failure overwrites its own folder, so its rows appear exactly once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        make(batch).write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/batch_id={batch_id}")

    return write


def _start(stream: DataFrame, sink, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def ask_stream(
    stream: DataFrame,
    question: Question,
    id_col: str,
    text_col: str,
    path: str,
    checkpoint: str,
    keep: Sequence[str] = (),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Decide a stream of requests with a fixed model.

    Each micro-batch runs the batch plan without a shuffle: texts are counted and looked up in their rows, in a model that is
    sent once for all batches. No state is kept between batches.
    """
    sink = _per_batch(path, lambda b: ask(b, question, id_col, text_col, keep))
    return _start(stream, sink, checkpoint, trigger)


def monitor(
    decisions: DataFrame,
    ts: str,
    window: str = "10 minutes",
    slide: str | None = None,
    late: str = "30 minutes",
    by: Sequence[str] = ("question", "action"),
    energy: str = "energy",
) -> DataFrame:
    """Action mix and energy per event-time window; works on streams and on
    tables. Rows later than ``late`` are dropped from a stream."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    if dict(decisions.dtypes)[ts] == "timestamp_ntz":  # a watermark needs a zoned time
        decisions = decisions.withColumn(ts, F.col(ts).cast("timestamp"))
    return (
        decisions.withWatermark(ts, late)
        .groupBy(span.alias("w"), *by)
        .agg(
            F.count("*").alias("n"),
            F.avg(energy).alias("mean_energy"),
            F.min(energy).alias("min_energy"),
            F.max(energy).alias("max_energy"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "mean_energy", "min_energy", "max_energy")
    )


def log_stream(
    decisions: DataFrame,
    path: str,
    checkpoint: str,
    truth: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append hard cases of a decision stream to the training log, exactly once
    per batch."""
    return _start(decisions, _per_batch(path, lambda b: hard_cases(b, truth=truth), ["reason"]), checkpoint, trigger)
