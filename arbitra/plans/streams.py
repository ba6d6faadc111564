"""Streams: each query replays a whole table as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbitra.plans.base import query, r6, rounded, table, with_sql
from arbitra.plans.scoring import _ACTION, quality_question
from arbitra.plans.weights import QUALITY_SQL
from arbitra.session import scratch_dir
from arbitra.streaming import ask_stream, log_stream, monitor


def stream_of(spark, sf, name):
    """A table, one file or a folder of files, as a file stream. A path that is a pattern may be either."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _ask_stream(spark, sf) -> str:
    out = scratch_dir(spark, "decisions")
    q = ask_stream(
        stream_of(spark, sf, "documents"), quality_question(spark, sf), "doc_id", "text", out, scratch_dir(spark, "cp"), ["lang"]
    )
    q.awaitTermination()
    return out


@query(
    "ask_stream",
    with_sql(QUALITY_SQL, f"SELECT doc_id, lang, label, round(confidence, 6) AS confidence, round(energy, 6) AS energy, {_ACTION} AS action FROM dec JOIN documents USING (doc_id)"),
)
def q_ask_stream(spark, sf):
    return rounded(spark.read.parquet(_ask_stream(spark, sf)).drop("batch_id"), "confidence", "energy")


def _event_decisions(df):
    v = F.col("value")
    action = F.when(v >= 40, "act").when(v >= 10, "review").otherwise("escalate")
    return df.select("event_id", "ts", F.col("event_type").alias("question"), action.alias("action"), v.alias("energy"))


_MON = (
    "SELECT {w} AS window_start, event_type AS question, CASE WHEN value >= 40 THEN 'act' WHEN value >= 10 THEN 'review' ELSE 'escalate' END AS action, value "
    "FROM events"
)


def _mon_sql(src: str) -> str:
    return (
        "SELECT CAST(epoch(window_start) AS BIGINT) AS window_start, question, action, count(*) AS n, round(avg(value), 6) AS mean_energy, min(value) AS min_energy, max(value) AS max_energy "
        f"FROM ({src}) GROUP BY ALL"
    )


def _mon_cols(df):
    return df.select(
        F.unix_timestamp("window_start").alias("window_start"), "question", "action", "n", r6("mean_energy").alias("mean_energy"), "min_energy", "max_energy"
    )


def _monitored(spark, agg):
    """Run a monitor to the end of its input. Each batch writes only the windows that it changed, under its number (a repeated batch
    replaces itself), and state leaves with the watermark. The last row of a window is its value."""
    out = scratch_dir(spark, "monitor")
    write = agg.writeStream.outputMode("update").option("checkpointLocation", scratch_dir(spark, "cp"))
    q = write.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).trigger(availableNow=True).start()
    q.awaitTermination()
    values = F.struct("batch", "n", "mean_energy", "min_energy", "max_energy")
    last = spark.read.parquet(out).groupBy("window_start", "question", "action").agg(F.max(values).alias("v"))
    return last.select("window_start", "question", "action", "v.*").drop("batch")


@query("monitor_stream", _mon_sql(_MON.format(w="date_trunc('day', ts)")))
def q_monitor_stream(spark, sf):
    return _mon_cols(_monitored(spark, monitor(_event_decisions(stream_of(spark, sf, "events")), "ts", "1 day")))


@query(
    "monitor_sliding",
    _mon_sql(
        _MON.format(w="date_trunc('day', ts)")
        + " UNION ALL "
        + _MON.format(w="date_trunc('day', ts + INTERVAL 12 HOUR) - INTERVAL 12 HOUR")
    ),
)
def q_monitor_sliding(spark, sf):
    return _mon_cols(_monitored(spark, monitor(_event_decisions(stream_of(spark, sf, "events")), "ts", "1 day", "12 hours")))


@query(
    "log_stream",
    "SELECT event_id, 'escalate' AS reason FROM events WHERE value < 10",
)
def q_log_stream(spark, sf):
    out = scratch_dir(spark, "hardlog")
    log_stream(_event_decisions(stream_of(spark, sf, "events")), out, scratch_dir(spark, "cp")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "reason")
