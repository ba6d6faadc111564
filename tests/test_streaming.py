import pytest
from pyspark.sql import functions as F

from arbitra.operators.decide import Policy, Question, ask
from arbitra.operators.model import LinearModel
from arbitra.streaming import ask_stream, log_stream, monitor


@pytest.fixture(scope="module")
def question(spark):
    terms = spark.createDataFrame([("ab", 2.0, [2.0, -2.0]), ("cd", 2.0, [-2.0, 2.0])], "term string, idf double, coef array<double>")
    return Question("q", Policy(0.9, 0.6, 0.9, -1.0), LinearModel("m", "tfidf", ("a", "b"), (0.0, 0.0), terms, 2))


def test_stream_decides_like_a_batch(spark, tmp_path, question):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    batches = [[(1, "ab ab"), (2, "zzz")], [(3, "cd"), (4, "")]]
    for rows in batches:
        spark.createDataFrame(rows, "id int, text string").write.mode("append").parquet(src)
        stream = spark.readStream.schema("id int, text string").parquet(src)
        ask_stream(stream, question, "id", "text", out, cp).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).drop("batch_id").collect()))
    want = sorted(map(tuple, ask(spark.read.parquet(src), question, "id", "text").collect()))
    assert got == want and len(got) == 4


def _decisions(spark):
    rows = [
        (1, "2024-01-01 00:01:00", "q", "act", -2.0), (2, "2024-01-01 00:02:00", "q", "abstain", -0.5),
        (3, "2024-01-01 00:11:00", "q", "act", -3.0), (4, "2024-01-01 00:03:00", "q", "act", -4.0),
    ]
    df = spark.createDataFrame(rows, "id int, t string, question string, action string, energy double")
    return df.withColumn("ts", F.to_timestamp("t")).drop("t")


def test_monitor_windows(spark):
    rows = monitor(_decisions(spark), "ts").orderBy("window_start", "action").collect()
    assert [(r["action"], r["n"], r["mean_energy"]) for r in rows] == [("abstain", 1, -0.5), ("act", 2, -3.0), ("act", 1, -3.0)]
    assert monitor(_decisions(spark), "ts", "10 minutes", "5 minutes").agg(F.sum("n")).first()[0] == 8


def test_late_rows_are_dropped_from_a_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = _decisions(spark).schema
    late = _decisions(spark).limit(1)
    for df in (_decisions(spark), _decisions(spark).withColumn("ts", F.to_timestamp(F.lit("2024-01-01 03:00:00"))), late, late.withColumn("ts", F.to_timestamp(F.lit("2024-01-01 09:00:00")))):
        df.coalesce(1).write.mode("append").parquet(src)
        agg = monitor(spark.readStream.schema(schema).parquet(src), "ts", late="10 minutes")
        q = agg.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", cp)
        q.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).filter("window_start < timestamp'2024-01-01 01:00:00'").collect()
    assert sum(r["n"] for r in rows) == 4


def test_hard_cases_of_a_stream_are_logged_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = _decisions(spark).schema
    for _ in range(2):
        _decisions(spark).write.mode("append").parquet(src)
        for _ in range(2):  # the second run finds nothing new
            log_stream(spark.readStream.schema(schema).parquet(src), out, cp).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert [(r["id"], r["reason"]) for r in rows] == [(2, "abstain")] * 2


def test_replayed_batch_overwrites_itself(spark, tmp_path, question):
    from arbitra.streaming.decisions import _per_batch

    df = spark.createDataFrame([(1, "ab")], "id int, text string")
    sink = _per_batch(str(tmp_path / "out"), lambda b: ask(b, question, "id", "text"))
    sink(df, 7)
    sink(df, 7)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


@pytest.mark.parametrize("folder", [False, True])
def test_query_streams_a_table_of_one_file_or_of_a_folder(spark, tmp_path, folder):
    import os
    import shutil

    from arbitra.plans.streams import stream_of

    sf, made = tmp_path / "sf", tmp_path / "made"
    sf.mkdir()
    spark.range(10).repartition(2 if folder else 1).write.parquet(str(made))
    spark.range(3).write.parquet(str(sf / "others.parquet"))
    if folder:
        shutil.copytree(made, sf / "rows.parquet")
    else:
        (part,) = (n for n in os.listdir(made) if n.startswith("part"))
        shutil.copy(made / part, sf / "rows.parquet")
    out = str(tmp_path / "out")
    q = stream_of(spark, str(sf), "rows").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(10))
