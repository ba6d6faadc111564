"""Calibration and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbitra.functions import prob as P
from arbitra.operators import calibrate as C
from arbitra.operators import evaluate as E
from arbitra.operators.decide import ask, predict
from arbitra.plans.base import EMB, EMB_CLASSES, documents, emb_logits, labelled, query, r6, rounded, table, with_sql
from arbitra.plans.scoring import _ACTION, quality_decisions, quality_question
from arbitra.plans.weights import QUALITY_SQL, quality_model

_GRID = "grid AS (SELECT CAST(r.i AS INTEGER) AS i, 0.05::DOUBLE * pow(200.0::DOUBLE, r.i / 79.0::DOUBLE) AS t FROM range(0, 80) AS r(i))"
_P_TRUE = "exp((z[truth + 1] - list_max(z)) / t) / list_sum(list_transform(z, lambda v: exp((v - list_max(z)) / t)))"
_LOSS = f"loss AS (SELECT i, t, avg(-ln(greatest(least({_P_TRUE}, 1.0), 1e-15))) AS nll FROM d, grid GROUP BY i, t)"


def _targets(spark, sf):
    return emb_logits(spark, sf).withColumn("target", F.col("truth").cast("int"))


@query("temperature_losses", with_sql([*EMB, _GRID, _LOSS], "SELECT i, round(t, 6) AS temperature, round(nll, 6) AS nll FROM loss"))
def q_temperature_losses(spark, sf):
    return rounded(C.temperature_losses(_targets(spark, sf)), "temperature", "nll")


@query(
    "fit_temperature",
    with_sql([*EMB, _GRID, _LOSS], "SELECT round(t, 6) AS temperature, round(nll, 6) AS nll FROM loss ORDER BY loss.nll, i LIMIT 1"),
)
def q_fit_temperature(spark, sf):
    return rounded(C.fit_temperature(_targets(spark, sf)), "temperature", "nll")


def _ece_sql(name: str, t: str) -> list[str]:
    p = f"1 / (1 + exp((least(z0, z1) - greatest(z0, z1)) / {t}))"
    return [
        f"{name}_c AS (SELECT {p} AS c, CAST(label = truth AS DOUBLE) AS ok FROM v, best)",
        f"{name}_b AS (SELECT least(CAST(floor(c * 10) AS INTEGER), 9) AS b, count(*) AS n, abs(avg(ok) - avg(c)) AS gap FROM {name}_c GROUP BY 1)",
        f"{name} AS (SELECT sum(n * gap) / sum(n) AS ece FROM {name}_b)",
    ]


@query(
    "calibrate",
    with_sql(
        [
            *QUALITY_SQL,
            "v AS MATERIALIZED (SELECT z0, z1, label, truth, CASE truth WHEN 'good' THEN z0 - z1 ELSE z1 - z0 END AS margin FROM dec JOIN labelled USING (doc_id))",
            _GRID,
            "best AS (SELECT t FROM (SELECT i, t, avg(-ln(greatest(1 / (1 + exp(-margin / t)), 1e-15))) AS nll FROM v, grid GROUP BY i, t) ORDER BY nll, i LIMIT 1)",
            *_ece_sql("eb", "1.0"),
            *_ece_sql("ea", "t"),
        ],
        "SELECT round(t, 6) AS temperature, round(eb.ece, 6) AS ece_before, round(ea.ece, 6) AS ece_after FROM best, eb, ea",
    ),
)
def q_calibrate(spark, sf):
    m = C.calibrate(quality_model(spark, sf), labelled(spark, sf), "doc_id", "text", "truth")
    return rounded(
        spark.createDataFrame([(m.temperature, m.ece_before, m.ece_after)], "temperature double, ece_before double, ece_after double"),
        "temperature", "ece_before", "ece_after",
    )


def _judged(spark, sf):
    d = predict(emb_logits(spark, sf), EMB_CLASSES)
    return d.withColumn("correct", F.col("label") == F.col("truth"))


_REL = "rel AS (SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(CAST(label = truth AS DOUBLE)) AS accuracy, avg(confidence) AS mean_confidence FROM d GROUP BY 1)"


@query("ece", with_sql([*EMB, _REL], "SELECT round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 6) AS ece FROM rel"))
def q_ece(spark, sf):
    return rounded(C.ece(_judged(spark, sf)), "ece")


@query("reliability", with_sql([*EMB, _REL], "SELECT bin, n, round(accuracy, 6) AS accuracy, round(mean_confidence, 6) AS mean_confidence FROM rel"))
def q_reliability(spark, sf):
    return rounded(C.reliability(_judged(spark, sf)), "accuracy", "mean_confidence")


@query(
    "ece_half",
    with_sql(
        [
            *EMB,
            "edges AS (SELECT r.b, 0.5::DOUBLE + r.b * 0.05::DOUBLE AS lo, 0.5::DOUBLE + (r.b + 1) * 0.05::DOUBLE AS hi FROM range(0, 10) AS r(b))",
            "bins AS (SELECT b, count(*) AS n, abs(avg(CAST(label = truth AS DOUBLE)) - avg(confidence)) AS gap FROM d, edges "
            "WHERE confidence >= lo AND (confidence < hi OR (b = 9 AND confidence <= hi)) GROUP BY b)",
        ],
        "SELECT round(sum(n * gap) / (SELECT count(*) FROM d), 6) AS ece FROM bins",
    ),
)
def q_ece_half(spark, sf):
    return rounded(C.ece_half(_judged(spark, sf)), "ece")


@query("fit_abstain", with_sql(EMB, "SELECT round(quantile_cont(energy, 0.95), 6) AS threshold FROM d"))
def q_fit_abstain(spark, sf):
    return rounded(C.fit_abstain(_judged(spark, sf), 0.95), "threshold")


@query("fit_abstain_by_type", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS threshold FROM events GROUP BY event_type")
def q_fit_abstain_by_type(spark, sf):
    return rounded(C.fit_abstain(table(spark, sf, "events"), 0.95, "value", by=["event_type"]), "threshold")


@query(
    "selective_report",
    with_sql(
        [*QUALITY_SQL, f"r AS (SELECT lang = 'en' AS inside, {_ACTION} <> 'abstain' AS kept, label = truth AS hit FROM dec JOIN labelled USING (doc_id))"],
        "SELECT count(*) AS n, round(avg(CAST(hit AS DOUBLE)) FILTER (inside AND kept), 6) AS answered_accuracy, "
        "round(avg(CAST(hit AND kept AS DOUBLE)) FILTER (inside), 6) AS accuracy_abstain_wrong, "
        "round(avg(CAST(NOT kept AS DOUBLE)) FILTER (inside), 6) AS abstain_rate, round(avg(CAST(kept AS DOUBLE)) FILTER (inside), 6) AS in_task_kept, "
        "round(avg(CAST(NOT kept AS DOUBLE)) FILTER (NOT inside), 6) AS out_of_task_abstained FROM r",
    ),
)
def q_selective_report(spark, sf):
    rep = C.selective_report(quality_decisions(spark, sf), in_task=F.col("lang") == "en")
    return rounded(rep, "answered_accuracy", "accuracy_abstain_wrong", "abstain_rate", "in_task_kept", "out_of_task_abstained")


@query(
    "energy_report",
    with_sql(
        [*EMB, "j AS (SELECT energy, label = truth AS ok, threshold FROM d, (VALUES (-6.0::DOUBLE), (-4.0::DOUBLE), (-3.0::DOUBLE)) AS t(threshold))"],
        "SELECT threshold, CAST(count_if(energy > threshold AND NOT ok) AS BIGINT) AS misses_converted, CAST(count_if(energy > threshold AND ok) AS BIGINT) AS correct_lost, "
        "CAST(count_if(NOT ok) AS BIGINT) AS misses, CAST(count_if(ok) AS BIGINT) AS correct, round(min(energy) FILTER (NOT ok), 6) AS miss_min, round(max(energy) FILTER (NOT ok), 6) AS miss_max, "
        "round(min(energy) FILTER (ok), 6) AS correct_min, round(max(energy) FILTER (ok), 6) AS correct_max FROM j GROUP BY threshold",
    ),
)
def q_energy_report(spark, sf):
    rep = C.energy_report(_judged(spark, sf), [-6.0, -4.0, -3.0])
    return rounded(rep, "miss_min", "miss_max", "correct_min", "correct_max")


@query(
    "energy_spread",
    with_sql(
        [*EMB, "l AS (SELECT label = truth AS correct, count(*) AS n, list_sort(list(energy)) AS v FROM d GROUP BY 1)"],
        "SELECT correct, n, round(v[CAST(ceil(0.05::DOUBLE * n) AS BIGINT)], 6) AS q5, round(v[CAST(ceil(0.5::DOUBLE * n) AS BIGINT)], 6) AS q50, round(v[CAST(ceil(0.95::DOUBLE * n) AS BIGINT)], 6) AS q95 FROM l",
    ),
)
def q_energy_spread(spark, sf):
    return rounded(C.energy_spread(_judged(spark, sf)), "q5", "q50", "q95")


# --- metrics ----------------------------------------------------------------


@query("confusion", with_sql(EMB, "SELECT CAST(truth AS VARCHAR) AS truth, CAST(label AS VARCHAR) AS label, count(*) AS n FROM d GROUP BY ALL"))
def q_confusion(spark, sf):
    return E.confusion(_judged(spark, sf))


@query(
    "binary_metrics",
    with_sql(
        [
            *QUALITY_SQL,
            "k AS (SELECT CAST(count_if(truth = 'poor' AND label = 'poor') AS BIGINT) AS tp, CAST(count_if(truth <> 'poor' AND label = 'poor') AS BIGINT) AS fp, "
            "CAST(count_if(truth = 'poor' AND label <> 'poor') AS BIGINT) AS fn, CAST(count_if(truth <> 'poor' AND label <> 'poor') AS BIGINT) AS tn FROM dec JOIN labelled USING (doc_id))",
        ],
        "SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision, "
        "round(fp / (fp + tn), 6) AS false_positive_rate, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM k",
    ),
)
def q_binary_metrics(spark, sf):
    m = E.binary_metrics(quality_decisions(spark, sf), "poor")
    return rounded(m, "accuracy", "recall", "precision", "false_positive_rate", "f1")


@query("accuracy", with_sql(EMB, "SELECT count(*) AS n, round(avg(CAST(label = truth AS DOUBLE)), 6) AS accuracy FROM d"))
def q_accuracy(spark, sf):
    return rounded(E.accuracy(_judged(spark, sf)), "accuracy")


_F1 = [
    "cl AS (SELECT truth AS class FROM d UNION SELECT label FROM d)",
    "f AS (SELECT class, count_if(truth = class) AS support, 2.0::DOUBLE * count_if(truth = class AND label = class) / (count_if(truth = class) + count_if(label = class)) AS f1 FROM cl, d GROUP BY class)",
]


@query("class_f1", with_sql([*EMB, *_F1], "SELECT CAST(class AS VARCHAR) AS class, CAST(support AS BIGINT) AS support, round(f1, 6) AS f1 FROM f"))
def q_class_f1(spark, sf):
    return rounded(E.class_f1(_judged(spark, sf)), "f1")


@query("macro_f1", with_sql([*EMB, *_F1], "SELECT count(*) AS n_classes, round(avg(f1), 6) AS macro_f1 FROM f"))
def q_macro_f1(spark, sf):
    return rounded(E.macro_f1(_judged(spark, sf)), "macro_f1")


def _auroc_sql(src: str, score: str, pos: str, by: str | None = None) -> str:
    part, tie = (f"PARTITION BY {by} ", f"{by}, {score}") if by else ("", score)
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return (
        f"SELECT {head}round((sum(r) FILTER (pos) - count_if(pos) * (count_if(pos) + 1) / 2) / (count_if(pos) * count_if(NOT pos)), 6) AS auroc "
        f"FROM (SELECT {head}{pos} AS pos, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER (PARTITION BY {tie}) - 1) / 2 AS r FROM {src}){tail}"
    )


@query("auroc", with_sql(QUALITY_SQL, _auroc_sql("dec JOIN labelled USING (doc_id)", "p1", "truth = 'poor'")))
def q_auroc(spark, sf):
    q = quality_question(spark, sf)
    from arbitra.operators.decide import distribution

    d = distribution(labelled(spark, sf), q, "doc_id", "text", ["truth"])
    d = d.withColumn("score", P.prob_of(P.array_literal(q.model.classes), F.col("p"), "poor"))
    return rounded(E.auroc(d, "score", F.col("truth") == "poor"), "auroc")


@query("auroc_by_type", _auroc_sql("events", "value", "event_id % 3 = 0", "event_type"))
def q_auroc_by_type(spark, sf):
    return rounded(E.auroc(table(spark, sf, "events"), "value", F.col("event_id") % 3 == 0, ["event_type"]), "auroc")


@query(
    "wilson",
    "WITH k AS (SELECT event_type, count_if(value > 20) AS k, count(*) AS n, count_if(value > 20) / count(*) AS p, 1.959963984540054::DOUBLE AS z FROM events GROUP BY event_type) "
    "SELECT event_type, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS low, "
    "round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS high FROM k",
)
def q_wilson(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 20).alias("k"), F.count("*").alias("n"))
    return rounded(E.wilson(counts, "k", "n").select("event_type", "low", "high"), "low", "high")


_LATS = "WITH l AS (SELECT event_type, count(*) AS n, list_sort(list(value)) AS v, avg(value) AS mean, sum(value) AS total FROM events GROUP BY event_type) "
_AT = {
    "ceil": "CAST(ceil(0.9::DOUBLE * n) AS BIGINT)",
    "round": "CAST(floor(0.9::DOUBLE * (n - 1) + 0.5) AS BIGINT) + 1",
    "trunc": "CAST(floor(n * 0.9::DOUBLE) AS BIGINT) + 1",
}


def _percentile(method):
    @query(f"percentile_{method}", _LATS + f"SELECT event_type, n, v[{_AT[method]}] AS value FROM l")
    def run(spark, sf):
        return E.percentile_rank(table(spark, sf, "events"), "value", 0.9, method, ["event_type"])

    return run


for _m in _AT:
    _percentile(_m)


@query(
    "latency_summary",
    _LATS + "SELECT event_type, n, v[CAST(ceil(0.5::DOUBLE * n) AS BIGINT)] AS p50, v[CAST(ceil(0.99::DOUBLE * n) AS BIGINT)] AS p99, round(mean, 6) AS mean, round(n / total, 6) AS throughput FROM l",
)
def q_latency_summary(spark, sf):
    return rounded(E.latency_summary(table(spark, sf, "events"), "value", ["event_type"]), "mean", "throughput")


_ENGINES = [
    "l AS (SELECT doc_id, n_chars, lang, toxic = 1 AS flip, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS expect FROM documents JOIN labels USING (doc_id))",
    "a AS (SELECT doc_id, 'length' AS engine, CASE WHEN n_chars >= 500 THEN 'good' ELSE 'poor' END AS label, flip, expect FROM l UNION ALL "
    "SELECT doc_id, 'lang', CASE lang WHEN 'en' THEN 'good' WHEN 'de' THEN NULL ELSE 'poor' END, flip, expect FROM l)",
]


@query(
    "compare_engines",
    with_sql(
        _ENGINES,
        "SELECT engine, coalesce(CAST(flip AS VARCHAR), 'all') AS subset, count(*) AS n, count(label) AS answered, CAST(count_if(label = expect) AS BIGINT) AS correct, CAST(count_if(label IS NULL) AS BIGINT) AS errors "
        "FROM a GROUP BY ROLLUP (engine, flip) HAVING engine IS NOT NULL",
    ),
)
def q_compare_engines(spark, sf):
    truth = labelled(spark, sf).select("doc_id", F.col("truth").alias("expect"), (F.col("toxic") == 1).alias("flip"), "n_chars", "lang")
    by_length = F.when(F.col("n_chars") >= 500, "good").otherwise("poor")
    by_lang = F.when(F.col("lang") == "en", "good").when(F.col("lang") != "de", "poor")
    answers = truth.select("doc_id", F.lit("length").alias("engine"), by_length.alias("label")).unionByName(
        truth.select("doc_id", F.lit("lang").alias("engine"), by_lang.alias("label"))
    )
    out = E.compare_engines(answers, truth, "doc_id")
    return out.withColumn("subset", F.coalesce(F.col("flip").cast("string"), F.lit("all"))).drop("flip")


@query(
    "agreement",
    with_sql(
        [*EMB, "g AS (SELECT list_transform(z, lambda v: floor(v)) AS y, label, z FROM d)"],
        "SELECT count(*) AS n, round(avg(CAST(label = 10 - list_position(list_reverse(y), list_max(y)) AS DOUBLE)), 6) AS agree, "
        "round(max(list_max(list_transform(range(1, 11), lambda i: abs(z[i] - y[i])))), 6) AS max_logit_diff FROM g",
    ),
)
def q_agreement(spark, sf):
    a = _judged(spark, sf)
    coarse = emb_logits(spark, sf).withColumn("logits", F.transform("logits", lambda z: F.floor(z).cast("double")))
    return rounded(E.agreement(a, predict(coarse, EMB_CLASSES), "vec_id"), "agree", "max_logit_diff")


@query("class_balance", "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type")
def q_class_balance(spark, sf):
    return rounded(E.class_balance(table(spark, sf, "events"), "event_type"), "share")


@query(
    "positive_rate",
    "SELECT lang, count(*) AS n, CAST(count_if(toxic = 1) AS BIGINT) AS n_positive, round(avg(CAST(toxic = 1 AS DOUBLE)), 6) AS positive_rate FROM documents JOIN labels USING (doc_id) GROUP BY lang",
)
def q_positive_rate(spark, sf):
    rows = labelled(spark, sf).withColumn("flag", F.col("toxic").cast("string"))
    return rounded(E.class_balance(rows, "flag", ["lang"], positive="1"), "positive_rate")


_FEATURES = ("l_quantity", "l_discount", "l_extendedprice")
_LONG = "\nUNION ALL ".join(
    f"SELECT {i} AS ord, '{f}' AS feature, {f} AS value, l_returnflag = 'R' AS pos, l_orderkey % 2 = 0 AS train FROM lineitem"
    for i, f in enumerate(_FEATURES)
)


@query(
    "best_stump",
    with_sql(
        [
            f"long AS MATERIALIZED ({_LONG})",
            "rk AS (SELECT ord, feature, pos, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r FROM long WHERE train)",
            "au AS (SELECT ord, feature, (sum(r) FILTER (pos) - count_if(pos) * (count_if(pos) + 1) / 2) / (count_if(pos) * count_if(NOT pos)) AS auroc FROM rk GROUP BY ord, feature)",
            "bf AS (SELECT feature, auroc FROM au ORDER BY auroc DESC, ord LIMIT 1)",
            "dv AS (SELECT value, sum(CAST(pos AS INT)) AS p, sum(CAST(NOT pos AS INT)) AS n FROM long JOIN bf USING (feature) WHERE train GROUP BY value)",
            "cv AS (SELECT value, lag(value) OVER (ORDER BY value) AS prev, coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + "
            "sum(p) OVER (ORDER BY value ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hits FROM dv)",
            "cand AS (SELECT (value + prev) / 2 AS threshold, hits FROM cv WHERE prev IS NOT NULL UNION ALL SELECT 0.5, sum(CASE WHEN value >= 0.5 THEN p ELSE n END) FROM dv)",
            "ch AS (SELECT threshold FROM cand ORDER BY hits DESC, threshold LIMIT 1)",
        ],
        "SELECT feature, round(any_value(auroc), 6) AS auroc, round(any_value(threshold), 6) AS threshold, count(*) AS n_test, round(avg(CAST((value >= threshold) = pos AS DOUBLE)), 6) AS test_accuracy "
        "FROM long JOIN bf USING (feature), ch WHERE NOT train GROUP BY feature",
    ),
)
def q_best_stump(spark, sf):
    li = table(spark, sf, "lineitem")
    even = F.col("l_orderkey") % 2 == 0
    out = E.best_stump(li.filter(even), li.filter(~even), _FEATURES, F.col("l_returnflag") == "R")
    return rounded(out, "auroc", "threshold", "test_accuracy")


@query(
    "hard_reviews",
    with_sql(QUALITY_SQL, f"SELECT {_ACTION} AS action, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM dec GROUP BY 1"),
)
def q_hard_reviews(spark, sf):
    d = ask(documents(spark, sf), quality_question(spark, sf), "doc_id", "text")
    return d.groupBy("action").agg(F.count("*").alias("n"), r6(F.avg("confidence")).alias("mean_confidence"))
