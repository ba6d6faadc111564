"""Sources and sinks: whole tables written in the format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbitra.operators.inputs import serialize_fields
from arbitra.plans.base import LABELLED, labelled, query, r6, rounded, table, with_sql
from arbitra.plans.scoring import _ACTION, quality_decisions
from arbitra.plans.weights import QUALITY_SQL, quality_model
from arbitra.session import scratch_dir
from arbitra.sources import examples as S
from arbitra.sources import logs as L
from arbitra.sources import models as M


def _digest(c):
    return F.md5(F.col(c).cast("binary"))


@query("read_examples", with_sql([LABELLED], "SELECT md5(text) AS digest, truth AS label FROM labelled"))
def q_read_examples(spark, sf):
    path = scratch_dir(spark, "examples")
    labelled(spark, sf).select(F.col("text").alias("input"), F.col("truth").alias("label")).write.json(path)
    return S.read_examples(spark, path).select(_digest("input").alias("digest"), "label")


@query("read_corpus", "SELECT item_id, md5(text) AS digest FROM benchmark")
def q_read_corpus(spark, sf):
    path = scratch_dir(spark, "corpus")
    chunk = table(spark, sf, "benchmark").withColumn("chunk", F.floor(F.col("item_id") / 1000))
    arrays = chunk.groupBy("chunk").agg(F.to_json(F.collect_list(F.struct("item_id", F.col("text").alias("passage")))).alias("value"))
    arrays.write.partitionBy("chunk").text(path)
    return S.read_corpus(spark, path, "passage", "item_id bigint").select("item_id", _digest("text").alias("digest"))


_EMAIL = (
    "SELECT doc_id, CAST(toxic AS INTEGER) AS y, CASE WHEN toxic = 1 THEN 'phishing' ELSE 'legitimate' END AS label, "
    "'from: ' || source || '@' || lang || ' sender: ' || source || ' subject: \"Doc, ' || doc_id || '\" link_text: go link_url: http://' || lang || '.example.com body: ' || text AS t FROM labelled"
)


def emails_csv(spark, sf) -> str:
    path = scratch_dir(spark, "emails")
    content = F.struct(
        F.col("source").alias("sender"),
        F.concat("source", F.lit("@"), "lang").alias("from"),
        F.concat(F.lit('"Doc, '), F.col("doc_id").cast("string"), F.lit('"')).alias("subject"),
        F.col("text").alias("body"),
        F.lit("go").alias("link_display_text"),
        F.concat(F.lit("http://"), "lang", F.lit(".example.com")).alias("link_url"),
    )
    rows = labelled(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"), F.to_json(content).alias("email_content"), F.col("toxic").alias("phish_label")
    )
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


@query("read_emails", with_sql([LABELLED, f"m AS ({_EMAIL})"], "SELECT CAST(doc_id AS VARCHAR) AS id, y, label, md5(t) AS digest FROM m"))
def q_read_emails(spark, sf):
    mails = S.read_emails(spark, emails_csv(spark, sf), labelled(spark, sf).count())
    text = serialize_fields(mails, S.email_text(), "t")
    return text.select("id", "y", "label", _digest("t").alias("digest"))


@query("write_splits", with_sql([LABELLED], "SELECT CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'val' ELSE 'test' END AS split, md5(text) AS digest, truth AS label FROM labelled"))
def q_write_splits(spark, sf):
    path = scratch_dir(spark, "splits")
    part = F.col("doc_id") % 5
    split = F.when(part < 3, "train").when(part == 3, "val").otherwise("test")
    rows = labelled(spark, sf).select(split.alias("split"), F.col("text").alias("input"), F.col("truth").alias("label"))
    S.write_splits(rows, path)
    parts = [S.read_split(spark, path, s).withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("split", _digest("input").alias("digest"), "label")


_TERMS = "SELECT term, round(idf, 6) AS idf, round(c0, 6) AS c0, round(c1, 6) AS c1 FROM qm_v"


def _terms(model):
    return model.terms.select(
        "term", r6("idf").alias("idf"), r6(F.get("coef", F.lit(0))).alias("c0"), r6(F.get("coef", F.lit(1))).alias("c1")
    )


@query("save_and_load_model", with_sql(QUALITY_SQL, _TERMS))
def q_save_and_load_model(spark, sf):
    path = scratch_dir(spark, "model")
    M.save_model(quality_model(spark, sf), path)
    return _terms(M.load_model(spark, path))


@query("import_artifact", with_sql(QUALITY_SQL, _TERMS))
def q_import_artifact(spark, sf):
    path = scratch_dir(spark, "artifact")
    M.export_artifact(quality_model(spark, sf), path)
    return _terms(M.import_artifact(spark, path))


_HARD = f"SELECT doc_id, CASE WHEN label <> truth THEN 'miss' ELSE action END AS reason FROM (SELECT doc_id, label, truth, {_ACTION} AS action FROM dec JOIN labelled USING (doc_id)) WHERE label <> truth OR action IN ('abstain', 'escalate')"


@query("log_hard_cases", with_sql(QUALITY_SQL, _HARD))
def q_log_hard_cases(spark, sf):
    path = scratch_dir(spark, "hard")
    L.log_hard_cases(quality_decisions(spark, sf), path)
    return spark.read.parquet(path).select("doc_id", "reason")


@query("write_report", "SELECT 'evaluation' AS name, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def q_write_report(spark, sf):
    path = scratch_dir(spark, "report")
    e = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    L.write_report(e, path)
    schema = "name string, timestamp_unix bigint, metrics struct<event_type:string,n:bigint,mean:double>"
    back = spark.read.schema(schema).json(path).filter("timestamp_unix > 0")
    return rounded(back.select("name", "metrics.*"), "mean")
