"""Registry, gates, promotion and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbitra.operators import registry as G
from arbitra.operators.decide import Policy, Question, predict
from arbitra.operators.ranks import hash_rank
from arbitra.operators.rebuild import rebuild
from arbitra.plans.base import EMB, EMB_CLASSES, LABELLED, emb_logits, labelled, query, rounded, table, with_sql
from arbitra.session import scratch_dir, written

_NAME = "event_type || '_' || (user_id % 10)"
_DEFS = (
    f"SELECT {_NAME} AS name, event_id AS seq, round(0.5 + (event_id % 6) / 10.0, 6) AS act_above, event_id % 4 AS low4 FROM events"
)


def _definitions(spark, sf):
    e = table(spark, sf, "events")
    policy = F.struct(
        F.round(0.5 + (F.col("event_id") % 6) / 10.0, 6).alias("act_above"),
        ((F.col("event_id") % 4) / 10.0).alias("review_low"),
        F.lit(0.55).alias("review_high"),
        F.lit(None).cast("double").alias("abstain_energy_above"),
    )
    return e.select(
        F.concat_ws("_", "event_type", (F.col("user_id") % 10).cast("string")).alias("name"),
        F.lit("{}").alias("input_schema"), F.lit("{}").alias("output_schema"), policy.alias("policy"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("model_id"), F.col("event_id").alias("seq"),
    )


def _defined(spark, sf):
    d = _definitions(spark, sf)
    return G.define(d.filter(F.col("seq") % 2 == 0), d.filter(F.col("seq") % 2 == 1))


_LATEST = f"latest AS (SELECT name, max(seq) AS seq, arg_max(act_above, seq) AS act_above, arg_max(low4, seq) AS low4 FROM ({_DEFS}) GROUP BY name)"


@query("define", with_sql([_LATEST], "SELECT name, seq, CAST(act_above AS DOUBLE) AS act_above FROM latest"))
def q_define(spark, sf):
    return _defined(spark, sf).select("name", "seq", F.col("policy.act_above").alias("act_above"))


@query("list_questions", f"SELECT DISTINCT {_NAME} AS name FROM events")
def q_list_questions(spark, sf):
    return G.list_questions(_defined(spark, sf))


@query(
    "check_registry",
    with_sql([_LATEST], "SELECT name, 'review_high must be <= act_above' AS error FROM latest WHERE act_above < 0.55"),
)
def q_check_registry(spark, sf):
    return G.check_registry(_defined(spark, sf)).select("name", "error")


def _models(spark, sf):
    """One settings row per event type."""
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("model_id")).agg(
        F.array_sort(F.collect_set((F.col("user_id") % 3).cast("string"))).alias("classes"),
        F.round(F.avg("value") / 20, 6).alias("temperature"),
        F.round(F.avg("value") / 200, 6).alias("ece_before"),
        F.round(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))) / 210, 6).alias("ece_after"),
        F.lit("validation").alias("ece_split"),
    )


_MODELS = (
    "models AS (SELECT event_type AS model_id, '0,1,2' AS classes, round(avg(value) / 20, 6) AS temperature, round(avg(value) / 200, 6) AS ece_before, "
    "round(avg(value) FILTER (event_id % 2 = 0) / 210, 6) AS ece_after FROM events GROUP BY event_type)"
)


@query(
    "metrics",
    with_sql(
        [_LATEST, _MODELS, "r AS (SELECT name, CASE WHEN seq % 3 <> 0 THEN split_part(name, '_', 1) END AS model_id FROM latest)"],
        "SELECT name, classes IS NOT NULL AS trained, coalesce(classes, '') AS classes, coalesce(temperature, 1.0) AS temperature, ece_before, ece_after FROM r LEFT JOIN models USING (model_id)",
    ),
)
def q_metrics(spark, sf):
    m = G.metrics(_defined(spark, sf), _models(spark, sf))
    return m.withColumn("classes", F.array_join("classes", ",")).drop("ece_split")


_RULES = {"a": {"min_correct": 40}, "b": {"min_rate": 0.3}, "c": {"min_rate": 0.1}, "missing": {"min_correct": 1}}


def _results(spark, sf):
    d = predict(emb_logits(spark, sf), EMB_CLASSES)
    suite = F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("vec_id") % 3).cast("int"))
    skipped = (F.col("vec_id") % 90 == 2)
    return d.select(suite.alias("suite"), F.when(~skipped, F.col("label")).alias("label"), F.col("truth").alias("expect"))


_GATE = [
    *EMB,
    "res AS (SELECT ['a', 'b', 'c'][vec_id % 3 + 1] AS suite, CASE WHEN vec_id % 90 <> 2 THEN label END AS label, truth AS expect FROM d)",
    "k AS (SELECT suite, count_if(label = expect) AS correct, count(label) AS answered, count_if(label IS NULL) AS skipped FROM res GROUP BY suite)",
    "rules AS (SELECT * FROM (VALUES ('a', 40, 0.0), ('b', 0, 0.3), ('c', 0, 0.1), ('missing', 1, 0.0)) AS t(suite, mc, mr))",
    "gate AS (SELECT suite, CAST(coalesce(correct, 0) AS BIGINT) AS correct, CAST(coalesce(answered, 0) AS BIGINT) AS answered, CAST(coalesce(skipped, 0) AS BIGINT) AS skipped, "
    "coalesce(correct, 0) / greatest(coalesce(answered, 0), 1) AS rate, mc, mr FROM rules LEFT JOIN k USING (suite))",
    "gated AS (SELECT suite, correct, answered, skipped, round(rate, 6) AS rate, correct >= mc AND rate >= mr AND skipped = 0 AS pass FROM gate)",
]


@query("eval_gate", with_sql(_GATE, "SELECT * FROM gated"))
def q_eval_gate(spark, sf):
    return rounded(G.eval_gate(_results(spark, sf), _RULES), "rate")


@query(
    "gate_open",
    with_sql(_GATE, "SELECT bool_and(pass) AS promote, coalesce(string_agg(suite, ',' ORDER BY suite) FILTER (NOT pass), '') AS failed FROM gated"),
)
def q_gate_open(spark, sf):
    return G.gate_open(G.eval_gate(_results(spark, sf), _RULES)).withColumn("failed", F.array_join("failed", ","))


@query(
    "calibration_gate",
    with_sql([_MODELS], "SELECT model_id, temperature, ece_before, ece_after, temperature <> 1 AND ece_after <= 0.12 AND ece_after <= ece_before + 1e-9 AS pass FROM models"),
)
def q_calibration_gate(spark, sf):
    return G.calibration_gate(_models(spark, sf))


@query(
    "current_version",
    "SELECT event_type AS question, arg_max(user_id, event_id) AS version FROM events GROUP BY event_type",
)
def q_current_version(spark, sf):
    e = table(spark, sf, "events")
    return G.current_version(e.select(F.col("event_type").alias("question"), F.col("user_id").alias("version"), F.col("event_id").alias("seq")))


@query(
    "promote_and_rollback",
    "WITH l AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events), "
    "now AS (SELECT user_id AS v FROM l WHERE event_type = 'click' AND r = 1) "
    "SELECT CASE WHEN event_type = 'click' THEN 'click' ELSE event_type END AS question, "
    "CASE WHEN event_type = 'view' THEN 900 WHEN event_type = 'click' THEN (SELECT user_id FROM l, now WHERE event_type = 'click' AND user_id <> v ORDER BY event_id DESC LIMIT 1) ELSE user_id END AS version "
    "FROM l WHERE r = 1",
)
def q_promote_and_rollback(spark, sf):
    e = table(spark, sf, "events")
    log = e.select(
        F.col("event_type").alias("question"), F.col("user_id").alias("version"),
        F.col("event_id").alias("seq"), F.lit("promote").alias("note"),
    )
    gate = G.eval_gate(_results(spark, sf), {"b": {"min_rate": 0.01}})
    log, _ = G.promote(log, "view", 900, gate)
    log, refused = G.promote(log, "error", 901, G.eval_gate(_results(spark, sf), _RULES))
    return G.current_version(G.rollback(log, "click"))


@query(
    "manifest",
    with_sql(
        [
            _MODELS,
            "h AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('3:' || event_id), event_id) AS r, count(*) OVER (PARTITION BY event_type) AS t FROM events)",
        ],
        "SELECT event_type AS question, CAST(count_if(r <= t // 2) AS BIGINT) AS train, CAST(count_if(r > t // 2) AS BIGINT) AS val, any_value(temperature) AS \"T\" "
        "FROM h LEFT JOIN models ON event_type = model_id GROUP BY event_type",
    ),
)
def q_manifest(spark, sf):
    e = hash_rank(table(spark, sf, "events"), ["event_id"], 3, ["event_type"], total="t")
    e = e.select(F.col("event_type").alias("question"), F.when(F.col("rank") <= F.floor(F.col("t") / 2), "train").otherwise("validation").alias("split"))
    return G.manifest(e, _models(spark, sf))


@query(
    "stored_registry",
    "SELECT event_type AS question, CAST(CASE WHEN event_type = 'click' THEN count(*) ELSE max(user_id) END AS BIGINT) AS version, "
    "round(least(0.99, 0.9 + count(*) / 1000000.0), 6) AS act_above FROM events GROUP BY event_type",
)
def q_stored_registry(spark, sf):
    """Define, promote and roll back on disk, then read all of it with another session."""
    path = scratch_dir(spark, "registry")
    kinds = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("user_id").alias("top")).collect()
    open_ = spark.createDataFrame([("suite", True)], "suite string, pass boolean")
    store = G.StoredRegistry(spark, path)
    for k in kinds:
        store.define(Question(k["event_type"], Policy(1.0, 0.6, 0.9)))
        store.define(Question(k["event_type"], Policy(min(0.99, 0.9 + k["n"] / 1e6), 0.6, 0.9)))
        store.promote(k["event_type"], k["n"], open_)
        store.promote(k["event_type"], k["top"], open_)
    store.promote("click", 1, spark.createDataFrame([("suite", False)], "suite string, pass boolean"))
    store.rollback("click")
    again = G.StoredRegistry(spark.newSession(), path)
    known = again.questions().select(F.col("name").alias("question"), F.col("policy.act_above").alias("act_above"))
    return rounded(known.join(again.current(), "question").select("question", "version", "act_above"), "act_above")


@query(
    "rebuild",
    with_sql(
        [
            LABELLED,
            "h AS (SELECT doc_id, truth, row_number() OVER (PARTITION BY lang, truth ORDER BY md5('7:' || lang || ':' || doc_id), doc_id) AS r, "
            "count(*) OVER (PARTITION BY lang, truth) AS t FROM labelled)",
            "s AS (SELECT truth, r <= greatest(1, floor(t * 0.8)) AS train FROM h)",
        ],
        "SELECT 'quality' AS question, CAST(count_if(train) + count_if(train AND truth = 'poor') AS BIGINT) AS train, CAST(count_if(NOT train) AS BIGINT) AS val, "
        "CAST(1 AS BIGINT) AS version, true AS promoted FROM s",
    ),
)
def q_rebuild(spark, sf):
    """One source per language, poor texts framed once more; the manifest of the whole job, read back from a second call."""
    root = scratch_dir(spark, "rebuild")
    rows = written(labelled(spark, sf).select("doc_id", "text", "truth", "lang"), "labelled")
    sources = {r[0]: rows.where(F.col("lang") == r[0]).select(F.col("doc_id").alias("id"), "text", F.col("truth").alias("label")) for r in rows.select("lang").distinct().collect()}
    framing = {"notice": lambda d: d.where("label = 'poor'").withColumn("text", F.concat(F.lit("Quoted as an example of poor text: "), "text"))}
    suite = {"all": rows.select(F.col("doc_id").alias("id"), "text", F.col("truth").alias("label"))}
    for _ in range(2):
        out, _stages = rebuild(spark, root, "quality", sources, suite, {"all": {"min_rate": 0.5}}, augment=framing, n_max=1)
    return out.drop("T")
