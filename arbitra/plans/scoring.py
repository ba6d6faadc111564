"""Scoring and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbitra.functions import prob as P
from arbitra.operators import decide as D
from arbitra.operators.score import score_hashed, score_tfidf
from arbitra.plans.base import EMB, EMB_CLASSES, LABELLED, documents, emb_logits, labelled, query, r6, rounded, with_sql
from arbitra.plans.weights import HASHED_SQL, QUALITY_SQL, TOXIC_SQL, quality_hashed, quality_model, toxic_model

POLICY = D.Policy(0.9, 0.6, 0.9, abstain_energy_above=0.3)
_ACTION = (
    "CASE WHEN energy > 0.3 THEN 'abstain' WHEN confidence >= 0.9 THEN 'act' WHEN confidence >= 0.6 THEN 'review' ELSE 'escalate' END"
)


def quality_question(spark, sf, policy=POLICY):
    return D.Question("quality", policy, quality_model(spark, sf))


def quality_decisions(spark, sf, policy=POLICY):
    """Decisions about the labelled documents, with their truth."""
    return D.ask(labelled(spark, sf), quality_question(spark, sf, policy), "doc_id", "text", ["truth", "toxic", "lang"])


@query(
    "score_hashed",
    with_sql([LABELLED, *HASHED_SQL], "SELECT doc_id, round(z0, 6) AS z0, round(z1, 6) AS z1 FROM hm_z"),
)
def q_score_hashed(spark, sf):
    z = score_hashed(documents(spark, sf), quality_hashed(spark, sf), "doc_id", "text")
    return z.select("doc_id", r6(F.get("logits", F.lit(0))).alias("z0"), r6(F.get("logits", F.lit(1))).alias("z1"))


@query("score_tfidf", with_sql(QUALITY_SQL, "SELECT doc_id, round(z0, 6) AS z0, round(z1, 6) AS z1 FROM qm_z"))
def q_score_tfidf(spark, sf):
    z = score_tfidf(documents(spark, sf), quality_model(spark, sf), "doc_id", "text")
    return z.select("doc_id", r6(F.get("logits", F.lit(0))).alias("z0"), r6(F.get("logits", F.lit(1))).alias("z1"))


@query("softmax", with_sql(EMB, "SELECT vec_id, CAST(i AS INTEGER) AS i, round(p[i + 1], 6) AS p FROM d, range(0, 10) AS r(i)"))
def q_softmax(spark, sf):
    e = emb_logits(spark, sf).select("vec_id", F.posexplode(P.softmax(F.col("logits"))).alias("i", "p"))
    return rounded(e, "p")


@query("predict", with_sql(EMB, "SELECT vec_id, CAST(label AS VARCHAR) AS label, round(confidence, 6) AS confidence FROM d"))
def q_predict(spark, sf):
    return rounded(D.predict(emb_logits(spark, sf), EMB_CLASSES).select("vec_id", "label", "confidence"), "confidence")


@query("energy", with_sql(EMB, "SELECT vec_id, round(energy, 6) AS energy FROM d"))
def q_energy(spark, sf):
    return emb_logits(spark, sf).select("vec_id", r6(P.energy(F.col("logits"))).alias("energy"))


@query("prob_of", with_sql(EMB, "SELECT vec_id, round(p[4], 6) AS p_three, CAST(NULL AS DOUBLE) AS p_none FROM d"))
def q_prob_of(spark, sf):
    names = P.array_literal(EMB_CLASSES)
    e = emb_logits(spark, sf).withColumn("p", P.softmax(F.col("logits")))
    return e.select("vec_id", r6(P.prob_of(names, F.col("p"), "3")).alias("p_three"), P.prob_of(names, F.col("p"), "none").alias("p_none"))


@query(
    "apply_policy",
    with_sql(EMB, "SELECT vec_id, CASE WHEN energy > -3.2 THEN 'abstain' WHEN confidence >= 0.7 THEN 'act' WHEN confidence >= 0.4 THEN 'review' ELSE 'escalate' END AS action FROM d"),
)
def q_apply_policy(spark, sf):
    d = D.predict(emb_logits(spark, sf), EMB_CLASSES)
    return D.apply_policy(d, D.Policy(0.7, 0.4, 0.7, -3.2)).select("vec_id", "action")


@query(
    "ask",
    with_sql(QUALITY_SQL, f"SELECT doc_id, label, round(confidence, 6) AS confidence, round(energy, 6) AS energy, {_ACTION} AS action FROM dec"),
)
def q_ask(spark, sf):
    d = D.ask(documents(spark, sf), quality_question(spark, sf), "doc_id", "text")
    return rounded(d, "confidence", "energy")


@query(
    "decision_mix",
    with_sql(QUALITY_SQL, f"SELECT action, label, truth, count(*) AS n FROM (SELECT doc_id, label, {_ACTION} AS action FROM dec) JOIN labelled USING (doc_id) GROUP BY ALL"),
)
def q_decision_mix(spark, sf):
    return quality_decisions(spark, sf).groupBy("action", "label", "truth").agg(F.count("*").alias("n"))


_ITEMS = [
    {"kind": "choice", "id": "quality"},
    {"kind": "noul", "id": "is_poor", "statement": "This text is poor", "class": "poor"},
    {"kind": "noul", "id": "is_good", "statement": "This text is good", "class": "good"},
]


def _noul_sql(pos: int, item: str, p: str, statement: str) -> str:
    yes = f"CASE WHEN {p} >= 0.5 THEN 'yes' ELSE 'no' END"
    conf = f"greatest({p}, 1 - {p})"
    action = _ACTION.replace("confidence", conf)
    return (
        f"SELECT doc_id, CAST({pos} AS INTEGER) AS pos, '{item}' AS item_id, 'noul' AS kind, '{statement}' AS statement, CAST(NULL AS VARCHAR) AS label, "
        f"round({p}, 6) AS p_true, {yes} AS prediction, round({conf}, 6) AS confidence, {action} AS action, round(energy, 6) AS energy FROM dec"
    )


_BATCH = (
    "SELECT doc_id, CAST(0 AS INTEGER) AS pos, 'quality' AS item_id, 'choice' AS kind, CAST(NULL AS VARCHAR) AS statement, label, CAST(NULL AS DOUBLE) AS p_true, "
    f"CAST(NULL AS VARCHAR) AS prediction, round(confidence, 6) AS confidence, {_ACTION} AS action, round(energy, 6) AS energy FROM dec UNION ALL "
    + _noul_sql(1, "is_poor", "p1", "This text is poor")
    + " UNION ALL "
    + _noul_sql(2, "is_good", "p0", "This text is good")
)


@query("ask_batch", with_sql(QUALITY_SQL, _BATCH))
def q_ask_batch(spark, sf):
    d = D.ask_batch(documents(spark, sf), _ITEMS, quality_question(spark, sf), "doc_id", "text")
    return rounded(d, "p_true", "confidence", "energy")


@query("noul", with_sql(QUALITY_SQL, f"SELECT * EXCLUDE (label, pos), CAST(pos - 1 AS INTEGER) AS pos FROM ({_BATCH}) WHERE kind = 'noul'"))
def q_noul(spark, sf):
    d = D.noul(documents(spark, sf), _ITEMS[1:], quality_question(spark, sf), "doc_id", "text")
    return rounded(d, "p_true", "confidence", "energy")


_ROUTED = """SELECT doc_id, question, CASE question WHEN 'quality' THEN q.label WHEN 'toxic' THEN t.label WHEN 'hashed' THEN h.label WHEN 'untrained' THEN '' END AS label,
round(CASE question WHEN 'quality' THEN q.confidence WHEN 'toxic' THEN t.confidence WHEN 'hashed' THEN h.confidence WHEN 'untrained' THEN 0.0::DOUBLE END, 6) AS confidence,
round(CASE question WHEN 'quality' THEN q.energy WHEN 'toxic' THEN t.energy END, 6) AS energy,
CASE WHEN question = 'nobody' THEN 'unknown question: nobody' END AS error
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'quality' WHEN 1 THEN 'toxic' WHEN 2 THEN 'hashed' WHEN 3 THEN 'untrained' ELSE 'nobody' END AS question FROM documents)
JOIN dec q USING (doc_id) JOIN tox t USING (doc_id) JOIN hdec h USING (doc_id)"""


@query("ask_routed", with_sql([*QUALITY_SQL, *TOXIC_SQL, *HASHED_SQL], _ROUTED))
def q_ask_routed(spark, sf):
    names = F.array(*[F.lit(n) for n in ("quality", "toxic", "hashed", "untrained", "nobody")])
    d = documents(spark, sf).withColumn("question", F.get(names, (F.col("doc_id") % 5).cast("int")))
    questions = [
        quality_question(spark, sf),
        D.Question("toxic", model=toxic_model(spark, sf)),
        D.Question("hashed", model=quality_hashed(spark, sf)),
        D.Question("untrained"),
    ]
    out = D.ask_routed(d, questions, "doc_id", "text")
    return rounded(out.select("doc_id", "question", "label", "confidence", "energy", "error"), "confidence", "energy")


@query(
    "decompose",
    with_sql(
        [*QUALITY_SQL, *TOXIC_SQL],
        "SELECT doc_id, v.label AS verdict, round(v.confidence, 3) AS confidence, round(v.energy, 6) AS energy, "
        "CASE WHEN t.label = 'true' THEN 'toxic_a,toxic_b' ELSE '' END AS fired, (v.label = 'poor') = (t.label = 'true') AS agree, lang = 'en' AS english_rule "
        "FROM dec v JOIN tox t USING (doc_id) JOIN documents USING (doc_id)",
    ),
)
def q_decompose(spark, sf):
    m = toxic_model(spark, sf)
    out = D.decompose(
        documents(spark, sf), quality_question(spark, sf),
        [D.Question("toxic_a", model=m), D.Question("toxic_b", model=m)],
        "doc_id", "text", positive="poor", rules={"english_rule": F.col("lang") == "en"},
    )
    fired = F.array_join("signals_fired", ",").alias("fired")
    return out.select("doc_id", "verdict", "confidence", r6("energy").alias("energy"), fired, "agree", "english_rule")


@query(
    "ask_hybrid",
    with_sql(
        [*QUALITY_SQL, *HASHED_SQL],
        f"SELECT doc_id, f.label AS fast_label, round(f.confidence, 6) AS fast_confidence, f.action AS fast_action, "
        "CASE WHEN f.action <> 'act' THEN h.label END AS slow_label, round(CASE WHEN f.action <> 'act' THEN h.confidence END, 6) AS slow_confidence, "
        "CASE WHEN f.action = 'act' THEN 'fast' ELSE 'slow' END AS route, CAST(NULL AS VARCHAR) AS note "
        f"FROM (SELECT *, {_ACTION} AS action FROM dec) f JOIN hdec h USING (doc_id)",
    ),
)
def q_ask_hybrid(spark, sf):
    slow = D.Question("slow", model=quality_hashed(spark, sf))
    d = D.ask_hybrid(documents(spark, sf), quality_question(spark, sf), slow, "doc_id", "text")
    return rounded(d, "fast_confidence", "slow_confidence")


_GUARD = (
    "g AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(truth AS VARCHAR) AS truth, confidence, "
    "list_sort(z, 'DESC')[1] - list_sort(z, 'DESC')[2] AS gap FROM d)",
    "h AS (SELECT vec_id, label, truth, CASE WHEN vec_id % 10 = 0 THEN 'out_of_range' WHEN gap < 0.5 THEN 'near_tie' WHEN confidence < 0.4 THEN 'low_confidence' ELSE 'model' END AS reason FROM g)",
)


def _guarded(spark, sf):
    d = D.predict(emb_logits(spark, sf), EMB_CLASSES)
    top = F.sort_array("logits", asc=False)
    d = d.withColumn("gap", F.get(top, F.lit(0)) - F.get(top, F.lit(1)))
    return D.guard(d, "truth", "gap", F.col("vec_id") % 10 != 0, min_gap=0.5, min_conf=0.4)


@query("guard", with_sql([*EMB, *_GUARD], "SELECT vec_id, reason, CASE WHEN reason = 'model' THEN label ELSE truth END AS final, CASE WHEN reason = 'model' THEN CAST(label = truth AS VARCHAR) END AS agree FROM h"))
def q_guard(spark, sf):
    return _guarded(spark, sf).select("vec_id", "reason", "final", F.col("agree").cast("string").alias("agree"))


@query("guard_report", with_sql([*EMB, *_GUARD], "SELECT reason, count(*) AS n, count(*) FILTER (reason = 'model' AND label = truth) AS n_agree FROM h GROUP BY reason"))
def q_guard_report(spark, sf):
    return D.guard_report(_guarded(spark, sf))
