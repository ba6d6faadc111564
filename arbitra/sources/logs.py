"""Hard-case logs and evaluation reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.sources.commits import CommitLog

HARD_ACTIONS = ("abstain", "escalate")


def hard_cases(decisions: DataFrame, label: str = "label", truth: str | None = "truth", action: str = "action") -> DataFrame:
    """Abstained and escalated decisions and, where the truth is known, misses."""
    missed: Column = F.lit(False)
    if truth is not None:
        missed = F.coalesce(F.col(label) != F.col(truth), F.lit(False))
    reason = F.when(missed, F.lit("miss")).when(F.col(action).isin(*HARD_ACTIONS), F.col(action))
    return decisions.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def log_hard_cases(decisions: DataFrame, path: str, label: str = "label", truth: str | None = "truth", run_id: str | None = None) -> bool:
    """Append hard cases to the next training set, one folder per reason.

    With a ``run_id`` the append happens once: the rows of an attempt go to a folder of their own, and the run is noted in the
    log's commits with the folder of the attempt that ended first. A run that is noted is not written again and False is
    returned. ``read_log`` gives the rows of noted runs alone.
    """
    cases = hard_cases(decisions, label, truth)
    if run_id is None:
        cases.write.mode("append").partitionBy("reason").parquet(path)
        return True
    log = CommitLog(decisions.sparkSession, f"{path}/_commits")
    if log.done(run_id) is not None:
        return False
    folder = f"run={uuid.uuid4().hex}"
    cases.write.partitionBy("reason").parquet(f"{path}/{folder}")
    return log.once(run_id, {"folder": folder})


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The hard cases of all noted runs; None where there are none."""
    log = CommitLog(spark, f"{path}/_commits")
    folders = [f"{path}/{note['folder']}" for note in log.notes()]
    return spark.read.option("basePath", path).parquet(*folders).drop("run") if folders else None


def write_report(metrics: DataFrame, path: str, name: str = "evaluation", mode: str = "append") -> None:
    """Append a metrics table as timestamped JSON."""
    stamped = metrics.select(
        F.lit(name).alias("name"),
        F.unix_timestamp(F.current_timestamp()).alias("timestamp_unix"),
        F.struct(*metrics.columns).alias("metrics"),
    )
    stamped.write.mode(mode).json(path)
