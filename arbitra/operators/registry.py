"""Question registry, gates, promotion and manifests as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.operators.decide import Policy, Question
from arbitra.operators.inputs import validate_policies
from arbitra.operators.model import LinearModel, model_meta
from arbitra.sources.commits import CommitLog

REGISTRY_SCHEMA = (
    "name string, input_schema string, output_schema string, "
    "policy struct<act_above:double,review_low:double,review_high:double,abstain_energy_above:double>, "
    "model_id string, seq bigint"
)


def question_row(q: Question, seq: int) -> tuple:
    p = q.policy
    return (
        q.name, q.input_schema, q.output_schema,
        (p.act_above, p.review_low, p.review_high, p.abstain_energy_above),
        q.model.model_id if q.model else None, seq,
    )


def registry(spark: SparkSession, questions: Sequence[Question] = (), seq: int = 0) -> DataFrame:
    """Registry rows, one per definition, in the order given."""
    return spark.createDataFrame([question_row(q, seq + i) for i, q in enumerate(questions)], REGISTRY_SCHEMA)


def define(current: DataFrame, rows: DataFrame) -> DataFrame:
    """Append definitions; the latest one of a name replaces the earlier."""
    both = current.unionByName(rows)
    others = F.struct(*[c for c in both.columns if c != "name"])
    latest = both.groupBy("name").agg(F.max_by(others, "seq").alias("_r"))
    return latest.select("name", "_r.*")


def list_questions(current: DataFrame) -> DataFrame:
    return current.select("name").distinct().orderBy("name")


def check_registry(current: DataFrame) -> DataFrame:
    """Definitions whose policy is not valid, with the reason."""
    flat = current.select("name", "policy.*")
    return validate_policies(flat).filter("error is not null")


def metrics(current: DataFrame, models: DataFrame) -> DataFrame:
    """One row per question: trained, classes, temperature, ECE before/after."""
    meta = models.select("model_id", "classes", "temperature", "ece_before", "ece_after", "ece_split")
    return current.join(meta, "model_id", "left").select(
        "name",
        F.col("classes").isNotNull().alias("trained"),
        F.coalesce("classes", F.array().cast("array<string>")).alias("classes"),
        F.coalesce("temperature", F.lit(1.0)).alias("temperature"),
        "ece_before",
        "ece_after",
        "ece_split",
    )


# The promotion gate's suites and the calibration bound.
GATE_RULES = {"probe": {"min_correct": 16}, "aug_val": {"min_correct": 15}, "test": {"min_rate": 0.985}}
MAX_ECE = 0.12


def eval_gate(results: DataFrame, rules: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """One row per required suite: correct, answered, skipped, pass.

    ``results`` is (suite, label, expect); a null label was skipped and any
    skip fails the suite, as does a suite without rows.
    """
    spark = results.sparkSession
    wanted = spark.createDataFrame(
        [(s, float(r["min_correct"]) if "min_correct" in r else None, float(r["min_rate"]) if "min_rate" in r else None)
         for s, r in (rules or GATE_RULES).items()],
        "suite string, min_correct double, min_rate double",
    )
    counts = results.groupBy("suite").agg(
        F.count_if(F.col("label") == F.col("expect")).alias("correct"),
        F.count_if(F.col("label").isNotNull()).alias("answered"),
        F.count_if(F.col("label").isNull()).alias("skipped"),
    )
    table = wanted.join(counts, "suite", "left").fillna(0, ["correct", "answered", "skipped"])
    rate = F.col("correct") / F.greatest(F.col("answered"), F.lit(1))
    enough = (F.col("min_correct").isNull() | (F.col("correct") >= F.col("min_correct"))) & (
        F.col("min_rate").isNull() | (rate >= F.col("min_rate"))
    )
    return table.select(
        "suite", "correct", "answered", "skipped", rate.alias("rate"), (enough & (F.col("skipped") == 0)).alias("pass")
    )


def gate_open(gate: DataFrame) -> DataFrame:
    """One row: whether every check passed, and the names of those that did not."""
    name = gate.columns[0]
    return gate.agg(
        F.coalesce(F.bool_and("pass"), F.lit(False)).alias("promote"),
        F.sort_array(F.collect_list(F.when(~F.col("pass"), F.col(name)))).alias("failed"),
    )


def calibration_gate(models: DataFrame, max_ece: float = MAX_ECE) -> DataFrame:
    """Per model: temperature fitted (set and not 1), ECE within bounds and not
    worse than before."""
    t, before, after = F.col("temperature"), F.coalesce("ece_before", F.lit(1.0)), F.col("ece_after")
    ok = t.isNotNull() & (t != 1.0) & after.isNotNull() & (after <= max_ece) & (after <= before + 1e-9)
    return models.select("model_id", "temperature", "ece_before", "ece_after", F.coalesce(ok, F.lit(False)).alias("pass"))


POINTER_SCHEMA = "question string, version bigint, seq bigint, note string"


def next_version(versions: DataFrame, question: str) -> int:
    top = versions.filter(F.col("question") == question).agg(F.max("version")).first()[0]
    return 1 if top is None else int(top) + 1


def promote(pointers: DataFrame, question: str, version: int, gate: DataFrame) -> tuple[DataFrame, bool]:
    """Append a pointer to ``version`` if the gate is open; older versions stay."""
    open_ = bool(gate_open(gate).first()["promote"])
    if not open_:
        return pointers, False
    return _append_pointer(pointers, question, version, "promote"), True


def rollback(pointers: DataFrame, question: str) -> DataFrame:
    """Point back at the version promoted before the one in production.

    The way back follows the promotions alone: rollbacks on the log only tell how far
    it has been gone, so a second rollback goes one promotion further.
    """
    log = pointers.filter(F.col("question") == question)
    now = current_version(log).first()
    if now is None:
        raise ValueError(f"nothing to roll back for {question!r}")
    promoted = log.filter("note = 'promote'")
    here = promoted.filter(F.col("version") == now["version"]).agg(F.max("seq")).first()[0]
    earlier = promoted.filter((F.col("seq") < here) & (F.col("version") != now["version"])).orderBy(F.desc("seq")).first()
    if earlier is None:
        raise ValueError(f"no earlier version of {question!r}")
    return _append_pointer(pointers, question, earlier["version"], "rollback")


def _append_pointer(pointers: DataFrame, question: str, version: int, note: str) -> DataFrame:
    last = pointers.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    row = pointers.sparkSession.createDataFrame([(question, int(version), int(last) + 1, note)], POINTER_SCHEMA)
    return pointers.unionByName(row)


def current_version(pointers: DataFrame) -> DataFrame:
    """(question, version) now in production."""
    return pointers.groupBy("question").agg(F.max_by("version", "seq").alias("version"))


def manifest(examples: DataFrame, models: DataFrame, question: str = "question", split: str = "split") -> DataFrame:
    """Per question: training and validation rows and the temperature."""
    sizes = examples.groupBy(question).agg(
        F.count_if(F.col(split) == "train").alias("train"), F.count_if(F.col(split) == "validation").alias("val")
    )
    temps = models.select(F.col("model_id").alias(question), F.col("temperature").alias("T"))
    return sizes.join(temps, question, "left")


def policy_column(p: Policy) -> Column:
    """A policy as the struct column ``apply_policy`` reads."""
    return F.struct(
        F.lit(p.act_above).alias("act_above"),
        F.lit(p.review_low).alias("review_low"),
        F.lit(p.review_high).alias("review_high"),
        F.lit(p.abstain_energy_above).cast("double").alias("abstain_energy_above"),
    )


def models_table(spark: SparkSession, models: Sequence[LinearModel]) -> DataFrame:
    return model_meta(spark, models)


class StoredRegistry:
    """Questions and production pointers in a commit log, shared by all sessions that read ``path``.

    Every definition, promotion and rollback is one record. A change is written behind the record it was decided on, so of two
    changes at once the second fails with ``Conflict`` and decides anew.
    """

    SCHEMA = (
        "kind string, question string, version bigint, input_schema string, output_schema string, "
        "policy struct<act_above:double,review_low:double,review_high:double,abstain_energy_above:double>, model_id string"
    )

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, CommitLog(spark, path)

    def define(self, question: Question) -> int:
        """Add a definition; the latest one of a name counts. Returns its number."""
        name, given, output, policy, model_id, _ = question_row(question, 0)
        names = "act_above", "review_low", "review_high", "abstain_energy_above"
        row = {"input_schema": given, "output_schema": output, "policy": dict(zip(names, policy, strict=True)), "model_id": model_id}
        return self.log.append({"kind": "define", "question": name, **row})

    def questions(self) -> DataFrame:
        """The latest definition of each question, as registry rows whose ``seq`` is the record's number."""
        rows = self.log.table(self.SCHEMA).where("kind = 'define'")
        rows = rows.select(F.col("question").alias("name"), "input_schema", "output_schema", "policy", "model_id", F.col("number").alias("seq"))
        return define(rows.limit(0), rows)

    def pointers(self) -> DataFrame:
        rows = self.log.table(self.SCHEMA).where("kind <> 'define'")
        return rows.select("question", "version", F.col("number").alias("seq"), F.col("kind").alias("note"))

    def current(self) -> DataFrame:
        """(question, version) now in production."""
        return current_version(self.pointers())

    def promote(self, question: str, version: int, gate: DataFrame, after: int | None = None) -> bool:
        """Point at ``version`` if the gate is open. ``after`` is the record on which the caller decided, by default the last one."""
        at = self.log.head() if after is None else after
        if not gate_open(gate).first()["promote"]:
            return False
        self.log.append({"kind": "promote", "question": question, "version": int(version)}, after=at)
        return True

    def rollback(self, question: str) -> int:
        """Point back at the version promoted before the one in production, and return it."""
        at = self.log.head()
        moved = rollback(self.pointers(), question)
        version = current_version(moved.where(F.col("question") == question)).first()["version"]
        self.log.append({"kind": "rollback", "question": question, "version": int(version)}, after=at)
        return int(version)
