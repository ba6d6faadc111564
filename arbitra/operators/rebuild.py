"""The rebuild of a question as one job that resumes: union, augment, train, calibrate, gate, promote, manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.operators.calibrate import calibrate
from arbitra.operators.decide import Policy, Question, ask
from arbitra.operators.model import LinearModel
from arbitra.operators.registry import StoredRegistry, calibration_gate, eval_gate, gate_open, manifest, models_table
from arbitra.operators.splits import split_frac, union_sources
from arbitra.operators.train import train_tfidf
from arbitra.sources.commits import CommitLog
from arbitra.sources.models import load_model, save_model, version_path


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows in any order, repeated rows included."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]))
    one, two = (F.sum(F.xxhash64(F.lit(i), row).cast("decimal(38,0)")) for i in range(2))
    return "-".join(str(v) for v in df.agg(F.count("*"), one, two).first())


class StageLog:
    """Stages of a job under ``root``: each is written once per key and read from there ever after.

    A stage's rows go to a folder of their own and count when the stage is noted in the commit log. A job that was lost before
    the note does that stage again; one that comes after it reads the noted folder.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/_stages")
        self.made: list[str] = []

    def _stage(self, name: str, key: str, write: Callable[[str], None]) -> str:
        key = f"{name}:{key}"
        note = self.log.done(key)
        if note is None:
            path = f"{self.root}/{name}-{uuid.uuid4().hex}"
            write(path)
            self.log.once(key, {"path": path})
            self.made.append(name)
            note = self.log.done(key)
        return note["path"]

    def table(self, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self.spark.read.parquet(self._stage(name, key, lambda path: make().write.parquet(path)))

    def model(self, name: str, key: str, make: Callable[[], LinearModel]) -> LinearModel:
        return load_model(self.spark, self._stage(name, key, lambda path: save_model(make(), path)))


def rebuild(
    spark: SparkSession,
    root: str,
    question: str,
    sources: Mapping[str, DataFrame],
    suites: Mapping[str, DataFrame],
    rules: Mapping[str, Mapping[str, float]],
    *,
    augment: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
    policy: Policy | None = None,
    share: float = 0.8,
    seed: int = 7,
    max_ece: float | None = None,
    **options,
) -> tuple[DataFrame, StageLog]:
    """Union the sources, add framings of the training rows, train, calibrate, gate and promote; returns the manifest and the stages.

    ``sources`` and ``suites`` are tables ``(id, text, label)``; ids are unique within their source. ``augment`` maps a name to a function
    of the training rows that gives more rows of the same columns; validation rows are never framed. The version is promoted
    when every suite meets its rule in ``rules`` and, with ``max_ece``, the calibration gate is open; models of earlier versions stay.

    Each stage is keyed by the contents of its inputs and its settings. A call that ends half way is repeated with the same arguments
    and goes on after the last stage that was noted; a finished one changes nothing, and its version stays the same.
    """
    stages = StageLog(spark, f"{root}/rebuild/{question}")
    settings = json.dumps({"share": share, "seed": seed, "augment": sorted(augment or {}), **options}, sort_keys=True)
    inputs = {name: fingerprint(df) for name, df in sorted(sources.items())}
    key = json.dumps([inputs, settings])

    def examples() -> DataFrame:
        rows = union_sources({n: d.select(F.concat_ws(":", F.lit(n), F.col("id").cast("string")).alias("id"), "text", "label") for n, d in sources.items()})
        return split_frac(rows.withColumn("_cell", F.concat_ws("|", "source", "label")), "id", "_cell", share, seed).drop("_cell")

    rows = stages.table("union", key, examples)

    def framed() -> DataFrame:
        base = rows.where("split = 'train'").select("id", "text", "label")
        out = rows
        for name, f in sorted((augment or {}).items()):
            more = f(base).select(F.concat(F.lit(f"{name}:"), F.col("id")).alias("id"), "text", "label")
            out = out.unionByName(more.select("*", F.lit(name).alias("source"), F.lit("train").alias("split")))
        return out

    data = stages.table("augment", key, framed)
    train, held = data.where("split = 'train'"), data.where("split = 'validation'")
    raw = stages.model("train", key, lambda: train_tfidf(train, "id", "text", "label", model_id=question, **options))
    model = stages.model("calibrate", key, lambda: calibrate(raw, held, "id", "text", "label"))
    asked = {name: fingerprint(df) for name, df in sorted(suites.items())}
    gate_key = json.dumps([key, asked, rules, max_ece], sort_keys=True)

    def gate() -> DataFrame:
        q = Question(question, policy or Policy(), model)
        answers = [
            ask(d.select("id", "text", F.col("label").alias("expect")), q, "id", "text", ["expect"]).select(F.lit(name).alias("suite"), "label", "expect")
            for name, d in suites.items()
        ]
        results = answers[0]
        for more in answers[1:]:
            results = results.unionByName(more)
        checks = eval_gate(results, rules).select("suite", "pass")
        if max_ece is not None:
            own = calibration_gate(models_table(spark, [model]), max_ece).select(F.lit("calibration").alias("suite"), "pass")
            checks = checks.unionByName(own)
        return checks

    checks = stages.table("gate", gate_key, gate)
    registry = StoredRegistry(spark, f"{root}/registry")

    def promoted() -> DataFrame:
        at = registry.log.head()
        done = stages.log.done(f"version:{gate_key}")
        if done is None:
            version = max([n["version"] for n in stages.log.notes() if n["key"].startswith("version:")], default=0) + 1
            stages.log.once(f"version:{gate_key}", {"version": version})
            done = stages.log.done(f"version:{gate_key}")
        version = done["version"]
        known = registry.pointers().where((F.col("question") == question) & (F.col("version") == version))
        is_open = bool(gate_open(checks).first()["promote"])
        if is_open and known.isEmpty():
            path = f"{version_path(f'{root}/models', question, version)}"
            if stages.log.done(f"saved:{gate_key}") is None:
                save_model(model, path, "overwrite")  # of an attempt that was lost before its note
                stages.log.once(f"saved:{gate_key}")
            registry.promote(question, version, checks, after=at)
        return spark.createDataFrame([(question, version, is_open)], "question string, version bigint, promoted boolean")

    version = stages.table("promote", gate_key, promoted)

    def summary() -> DataFrame:
        sizes = manifest(data.withColumn("question", F.lit(question)), models_table(spark, [model]))
        return sizes.join(version, "question")

    return stages.table("manifest", gate_key, summary), stages
