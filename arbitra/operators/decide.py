"""From logits to decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions import prob as P
from arbitra.operators.model import Model
from arbitra.operators.score import score, score_each, score_models
from arbitra.session import written


@dataclass(frozen=True)
class Policy:
    """Thresholds that turn a confidence into an action."""

    act_above: float = P.ACT_ABOVE
    review_low: float = P.REVIEW_LOW
    review_high: float = P.REVIEW_HIGH
    abstain_energy_above: float | None = None

    def __post_init__(self):
        bounds = self.review_low, self.review_high, self.act_above
        if any(not 0.0 <= v <= 1.0 for v in bounds):
            raise ValueError(f"policy thresholds are probabilities, each must be in [0,1]: {bounds}")
        if list(bounds) != sorted(bounds):
            raise ValueError(f"policy thresholds must be <= the next in the order review_low, review_high, act_above: {bounds}")
        e = self.abstain_energy_above
        if e is not None and not (float("-inf") < e < float("inf")):
            raise ValueError("abstain_energy_above must be finite")

    def action(self, confidence: Column, energy: Column | None) -> Column:
        return P.policy_action(confidence, energy, self.act_above, self.review_low, self.abstain_energy_above)


@dataclass(frozen=True)
class Question:
    """A named question with its policy and, once trained, its model."""

    name: str
    policy: Policy = field(default_factory=Policy)
    model: Model | None = None
    input_schema: str = "{}"
    output_schema: str = "{}"

    def __post_init__(self):
        if not self.name:
            raise ValueError("question name must not be empty")


def predict(
    df: DataFrame,
    classes: Column | Sequence[str],
    temperature: Column | float = 1.0,
    logits: str = "logits",
    with_energy: Column | bool = True,
) -> DataFrame:
    """Add ``p``, ``label``, ``confidence`` and ``energy`` to scored rows.

    The last of tied classes wins. Energy comes from the raw logits, before
    the temperature; it is null where the scorer reports none.
    """
    names = classes if isinstance(classes, Column) else P.array_literal(classes)
    wanted = with_energy if isinstance(with_energy, Column) else F.lit(with_energy)
    return (
        df.withColumn("p", P.softmax(F.col(logits), temperature))
        .withColumn("label", F.get(names, P.argmax_last(F.col("p"))))
        .withColumn("confidence", P.checked_probability(F.array_max("p")))
        .withColumn("energy", F.when(wanted, P.energy(F.col(logits))))
    )


def apply_policy(df: DataFrame, policy: Policy | str) -> DataFrame:
    """Add ``action``. A string names a struct column that holds the policy."""
    if isinstance(policy, Policy):
        return df.withColumn("action", policy.action(F.col("confidence"), F.col("energy")))
    s = F.col(policy)
    return df.withColumn(
        "action",
        P.policy_action(F.col("confidence"), F.col("energy"), s["act_above"], s["review_low"], s["abstain_energy_above"]),
    )


def _trained(question: Question) -> Model:
    if question.model is None:
        raise ValueError(f'question "{question.name}" has no trained model')
    return question.model


def distribution(df: DataFrame, question: Question, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep, logits, p, label, confidence, energy). Hashed and hidden-layer models report
    no energy."""
    model = _trained(question)
    scored = score(df, model, id_col, text_col, keep)
    return predict(scored, model.classes, model.temperature, with_energy=model.has_energy)


def ask(df: DataFrame, question: Question, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Decide a table of texts: label, confidence, energy, action."""
    decided = apply_policy(distribution(df, question, id_col, text_col, keep), question.policy)
    return decided.select(id_col, *keep, "label", "confidence", "energy", "action")


def _check_noul(item: Mapping[str, str], where: str, classes: Sequence[str]) -> None:
    for name in ("statement", "class"):
        if not isinstance(item.get(name), str) or not item[name].strip():
            raise ValueError(f'{where}: noul "{name}" must not be empty')
    if item["class"] not in classes:
        raise ValueError(f"{where}: class {item['class']!r} is not one of {list(classes)}")


def _check_items(items: Sequence[Mapping[str, str]], classes: Sequence[str]) -> list[tuple]:
    """All items or none: the first bad one stops the batch."""
    if isinstance(items, (str, Mapping)) or not isinstance(items, Sequence):
        raise ValueError('"questions" must be an array of items')
    if not items:
        raise ValueError('"questions" must not be empty')
    rows = []
    for i, item in enumerate(items):
        where = f"questions[{i}]"
        if not isinstance(item.get("id"), str) or not item["id"]:
            raise ValueError(f'{where}: missing non-empty "id"')
        kind = item.get("kind", "choice")
        kind = kind if isinstance(kind, str) else "choice"
        if kind not in ("choice", "noul"):
            raise ValueError(f"{where}: unknown kind {kind!r}")
        if kind == "noul":
            _check_noul(item, where, classes)
        noul = kind == "noul"
        rows.append((i, item["id"], kind, item["statement"] if noul else None, item["class"] if noul else None))
    return rows


def yes_no(p_true: Column, energy: Column | None, policy: Policy) -> dict[str, Column]:
    """Yes/no reading of one class's probability, under the same policy."""
    p = P.checked_probability(p_true, "p_true")
    confidence = F.greatest(p, 1.0 - p)
    return {
        "p_true": p,
        "prediction": F.when(p >= 0.5, F.lit("yes")).otherwise(F.lit("no")),
        "confidence": confidence,
        "action": policy.action(confidence, energy),
    }


def ask_batch(
    df: DataFrame,
    items: Sequence[Mapping[str, str]],
    question: Question,
    id_col: str,
    text_col: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Answer several choice and yes/no items about every input.

    Inputs are scored once; the items, a short list, are exploded beside each
    scored row. ``pos`` keeps their order.
    """
    model = _trained(question)
    rows = _check_items(items, model.classes)
    literal = F.array(
        *[
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(item).alias("item_id"),
                F.lit(kind).alias("kind"),
                F.lit(st).cast("string").alias("statement"),
                F.lit(cl).cast("string").alias("class"),
            )
            for i, item, kind, st, cl in rows
        ]
    )
    names = P.array_literal(model.classes)
    scored = distribution(df, question, id_col, text_col, keep)
    each = scored.withColumn("_item", F.explode(literal)).select("*", "_item.*").drop("_item")
    noul = F.col("kind") == "noul"
    p_true = F.coalesce(P.prob_of(names, F.col("p"), F.col("class")), F.lit(0.0))
    answer = yes_no(p_true, F.col("energy"), question.policy)
    choice_action = question.policy.action(F.col("confidence"), F.col("energy"))
    return each.select(
        id_col,
        *keep,
        "pos",
        "item_id",
        "kind",
        "statement",
        F.when(~noul, F.col("label")).alias("label"),
        F.when(noul, answer["p_true"]).alias("p_true"),
        F.when(noul, answer["prediction"]).alias("prediction"),
        F.when(noul, answer["confidence"]).otherwise(F.col("confidence")).alias("confidence"),
        F.when(noul, answer["action"]).otherwise(choice_action).alias("action"),
        "energy",
    )


def noul(
    df: DataFrame,
    items: Sequence[Mapping[str, str]],
    question: Question,
    id_col: str,
    text_col: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Yes/no answers read off the choice distribution."""
    if isinstance(items, Sequence) and not isinstance(items, str):
        items = [{**item, "kind": "noul"} for item in items]
    return ask_batch(df, items, question, id_col, text_col, keep).drop("label")


def settings(spark, questions: Sequence[Question]) -> DataFrame:
    """``(question, classes, temperature, policy, has_energy)``: what turns a question's logits into decisions; one row per question."""
    rows = [
        (
            q.name, list(q.model.classes) if q.model else None, float(q.model.temperature) if q.model else None,
            (q.policy.act_above, q.policy.review_low, q.policy.review_high, q.policy.abstain_energy_above), bool(q.model and q.model.has_energy),
        )
        for q in questions
    ]
    return spark.createDataFrame(
        rows,
        "question string, classes array<string>, temperature double, "
        "policy struct<act_above:double,review_low:double,review_high:double,abstain_energy_above:double>, has_energy boolean",
    )


def answer(scored: DataFrame, known: DataFrame, question_col: str = "question") -> DataFrame:
    """Decisions from a table ``(id, question, logits)`` of any engine and a ``settings`` table, joined by question.

    Adds ``p``, ``label``, ``confidence``, ``energy`` and ``action``; rows of an unknown question are left out. Settings are one
    row per question, so they are broadcast.
    """
    s = known.select(F.col("question").alias(question_col), F.struct("classes", "temperature", "policy", "has_energy").alias("_s"))
    rows = scored.join(F.broadcast(s), question_col).withColumn("_policy", F.col("_s.policy"))
    decided = predict(rows, F.col("_s.classes"), F.col("_s.temperature"), with_energy=F.col("_s.has_energy"))
    return apply_policy(decided, "_policy").drop("_s", "_policy")


def ask_routed(
    df: DataFrame,
    questions: Sequence[Question],
    id_col: str,
    text_col: str,
    question_col: str = "question",
    keep: Sequence[str] = (),
    default_output: str = "",
    default_confidence: float = 0.0,
) -> DataFrame:
    """Send each row to the question it names.

    A question without a model gives the default decision under its own
    policy; an unknown question puts the row in error.
    """
    if not 0.0 <= default_confidence <= 1.0:
        raise ValueError("default_confidence must be in [0,1]")
    known = {q.name: q for q in questions}
    trained = [q for q in known.values() if q.model is not None]
    # The model id of a routed row is its question, so questions may share a model.
    models = [q.model.with_(model_id=q.name) for q in trained]
    cols = [id_col, *keep]
    name = F.col(question_col)

    out = [*cols, question_col, "label", "confidence", "energy", "action", "error"]
    asked_of = df.sparkSession.createDataFrame([(q.name,) for q in trained], "_served string")
    tagged = df.join(F.broadcast(asked_of), name == F.col("_served"), "left")
    unserved = tagged.filter("_served IS NULL").select(
        *cols,
        question_col,
        F.lit(default_output).alias("label"),
        F.lit(float(default_confidence)).alias("confidence"),
        F.lit(None).cast("double").alias("energy"),
    )
    policies = settings(df.sparkSession, list(known.values())).select(F.col("question").alias(question_col), F.col("policy").alias("_policy"))
    is_known = F.col("_policy").isNotNull()
    fallback = apply_policy(unserved.join(F.broadcast(policies), question_col, "left"), "_policy").withColumn(
        "error", F.when(~is_known, F.concat(F.lit("unknown question: "), F.coalesce(name, F.lit("null"))))
    )
    for c in ("label", "confidence", "action"):
        fallback = fallback.withColumn(c, F.when(F.col("error").isNull(), F.col(c)))
    if not trained:
        return fallback.select(*out)
    asked = tagged.filter("_served IS NOT NULL").withColumn("model_id", name)
    scored = score_models(asked, models, id_col, text_col, [*keep, question_col])
    answered = answer(scored, settings(df.sparkSession, trained), question_col).withColumn("error", F.lit(None).cast("string"))
    return answered.select(*out).unionByName(fallback.select(*out))


def decompose(
    df: DataFrame,
    verdict: Question,
    signals: Sequence[Question],
    id_col: str,
    text_col: str,
    positive: str = "phishing",
    fired: str = "true",
    need: int = 2,
    rules: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Ask a verdict and several signal questions of every row, and compare.

    ``agree`` says whether the verdict is ``positive`` exactly when at least
    ``need`` signals fired. Any models will do; all TF-IDF models are scored in
    one pass over the texts.
    """
    questions = [verdict, *signals]
    models = [_trained(q).with_(model_id=q.name) for q in questions]
    rules = dict(rules or {})
    src = df.select(id_col, text_col, *[c.alias(n) for n, c in rules.items()])
    scored = score_each(src, models, id_col, text_col, list(rules)).withColumnRenamed("model_id", "question")
    answers = answer(scored, settings(df.sparkSession, questions))
    is_verdict = F.col("question") == verdict.name
    hit = ~is_verdict & (F.col("label") == fired)
    out = answers.groupBy(id_col, *rules).agg(
        F.max(F.when(is_verdict, F.col("label"))).alias("verdict"),
        F.max(F.when(is_verdict, F.round("confidence", 3))).alias("confidence"),
        F.max(F.when(is_verdict, F.col("action"))).alias("action"),
        F.max(F.when(is_verdict, F.col("energy"))).alias("energy"),
        F.sort_array(F.collect_list(F.when(hit, F.col("question")))).alias("signals_fired"),
        F.sort_array(
            F.collect_list(
                F.when(
                    ~is_verdict,
                    F.struct(
                        F.col("question").alias("id"), "label", F.round("confidence", 3).alias("confidence"), "action"
                    ),
                )
            )
        ).alias("signals"),
    )
    return out.withColumn("agree", (F.col("verdict") == positive) == (F.size("signals_fired") >= need))


def ask_hybrid(
    df: DataFrame, fast: Question, slow: Question, id_col: str, text_col: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Keep the fast answer where it acts; ask the second model about the rest
    and keep both. Only those rows are scored twice."""
    first = ask(df, fast, id_col, text_col, keep)
    renamed = first.select(id_col, *keep, *[F.col(c).alias(f"fast_{c}") for c in ("label", "confidence", "action")])
    renamed = written(renamed, "fast-answers")  # read by both routes
    sure = F.col("fast_action") == "act"
    base = [id_col, *keep, "fast_label", "fast_confidence", "fast_action"]

    def plain(d: DataFrame, note: str | None) -> DataFrame:
        return d.select(
            *base,
            F.lit(None).cast("string").alias("slow_label"),
            F.lit(None).cast("double").alias("slow_confidence"),
            F.lit("fast").alias("route"),
            F.lit(note).cast("string").alias("note"),
        )

    if slow.model is None:
        return plain(renamed.filter(sure), None).unionByName(plain(renamed.filter(~sure), "no labels for fallback"))
    rest = df.select(id_col, text_col).join(renamed.filter(~sure), id_col)
    second = ask(rest, slow, id_col, text_col, base[1:])
    slow_rows = second.select(
        *base,
        F.col("label").alias("slow_label"),
        F.col("confidence").alias("slow_confidence"),
        F.lit("slow").alias("route"),
        F.lit(None).cast("string").alias("note"),
    )
    return plain(renamed.filter(sure), None).unionByName(slow_rows)


# Margin and confidence under which a rule answers instead.
MIN_GAP, MIN_CONFIDENCE = 3.0, 0.70


def guard(
    df: DataFrame,
    rule_label: str,
    gap: str,
    in_range: Column | None = None,
    min_gap: float = MIN_GAP,
    min_conf: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Let a rule's answer replace the model's on an out-of-range state, a near
    tie or a low confidence. Adds ``final``, ``reason`` and, where the model
    was used, ``agree``."""
    ok = in_range if in_range is not None else F.lit(True)
    reason = (
        F.when(~F.coalesce(ok, F.lit(False)), F.lit("out_of_range"))
        .when(F.col(gap).isNull() | (F.col(gap) < min_gap), F.lit("near_tie"))
        .when(F.col("confidence") < min_conf, F.lit("low_confidence"))
        .otherwise(F.lit("model"))
    )
    used = F.col("reason") == "model"
    return (
        df.withColumn("reason", reason)
        .withColumn("final", F.when(used, F.col("label")).otherwise(F.col(rule_label)))
        .withColumn("agree", F.when(used, F.col("label") == F.col(rule_label)))
    )


def guard_report(guarded: DataFrame) -> DataFrame:
    """Rows per reason, and how often model and rule agreed."""
    return guarded.groupBy("reason").agg(
        F.count("*").alias("n"), F.count_if(F.col("agree")).alias("n_agree")
    )
