"""Models on disk: a term table and a settings table, and JSON artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.operators.model import LinearModel, model_meta
from arbitra.session import written


def save_model(model: LinearModel, path: str, mode: str = "errorifexists") -> None:
    """Write ``<path>/terms`` and ``<path>/meta`` as Parquet."""
    model.terms.write.mode(mode).parquet(f"{path}/terms")
    model_meta(model.terms.sparkSession, [model]).coalesce(1).write.mode(mode).parquet(f"{path}/meta")


def _check_terms(terms: DataFrame, n_classes: int, key: str) -> int:
    """Row count of a term table whose rows all have one weight per class."""
    bad = (F.size("coef") != n_classes) | F.col(key).isNull()
    stats = terms.agg(F.count("*").alias("n"), F.max(F.when(bad, F.col(key).cast("string"))).alias("bad")).first()
    if stats["bad"] is not None:
        raise ValueError(f"vocab entry {stats['bad']!r} does not have {n_classes} coefficients")
    return stats["n"]


def load_model(spark: SparkSession, path: str) -> LinearModel:
    """Read a saved model, refusing a malformed one."""
    meta = spark.read.parquet(f"{path}/meta").limit(2).collect()
    if len(meta) != 1:
        raise ValueError(f"{path}: expected one settings row, got {len(meta)}")
    m = meta[0].asDict()
    terms = spark.read.parquet(f"{path}/terms")
    key = "term" if m["kind"] == "tfidf" else "bucket"
    m["n_terms"] = _check_terms(terms, len(m["classes"] or []), key)
    return LinearModel(
        **{**m, "classes": tuple(m["classes"] or ()), "intercept": tuple(m["intercept"] or ()), "terms": terms}
    )


def version_path(root: str, question: str, version: int) -> str:
    return f"{root}/question={question}/version={version}"


def save_version(model: LinearModel, root: str, question: str, version: int) -> None:
    """Keep a model beside its earlier versions; an existing one is never
    overwritten."""
    save_model(model, version_path(root, question, version))


def load_version(spark: SparkSession, root: str, question: str, version: int) -> LinearModel:
    return load_model(spark, version_path(root, question, version))


_HEAD_SCHEMA = (
    "model_id string, classes array<string>, temperature double, intercept array<double>, "
    "eval struct<ece_before:double,ece_after:double>"
)
ARTIFACT_SCHEMA = _HEAD_SCHEMA + ", vocab map<string,array<double>>"
# An exported artifact says of itself that each vocab entry is a line. Own choice: the most entries of one file.
LINES = "one vocab entry a line"
ENTRIES_PER_FILE = 1_000_000
_OPEN, _CLOSE = '"vocab":{', "}}"


def _artifact_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """The lines of an exported artifact; None for JSON that is laid out otherwise."""
    lines = spark.read.option("lineSep", "\n").text(path)
    opens = F.col("value").startswith("{") & F.col("value").endswith(_OPEN) & F.contains("value", F.lit(f'"layout":"{LINES}"'))
    return None if lines.where(opens).isEmpty() else lines.where("value <> ''").withColumn("opens", opens)


def _read_lines(path: str, lines: DataFrame) -> tuple[list, DataFrame]:
    """Head rows (two at most) and (term, w) of an artifact with one entry a line; refused when a line is no entry or the end is missing."""
    closes = F.col("value") == _CLOSE
    ends = lines.agg(F.count_if("opens").alias("heads"), F.count_if(closes).alias("tails")).first()
    if ends["heads"] != 1:
        raise ValueError(f"{path}: expected one artifact, got {ends['heads']}")
    if ends["tails"] != 1:
        raise ValueError(f"{path}: the artifact does not end once")
    opened = F.when(F.col("opens"), F.concat("value", F.lit(_CLOSE)))
    head = lines.select(F.from_json(opened, _HEAD_SCHEMA, {"mode": "FAILFAST"}).alias("h")).where("h IS NOT NULL").select("h.*")
    entries = lines.select(F.when(~F.col("opens") & ~closes, _entry(F.col("value"))).alias("e")).where("e IS NOT NULL")
    return head.collect(), entries.select("e.*")


def _entry(line: Column) -> Column:
    """Term and weights of a line ``"term":[1.0,2.0],``; a term's own quotes are escaped, so the last ``":[`` ends it."""
    numbers = F.substring_index(line, '":[', -1)
    key = F.substring(line, F.lit(2), F.length(line) - F.length(numbers) - 4)
    term = F.when(F.contains(key, F.lit("\\")), F.get(F.from_json(F.concat(F.lit('["'), key, F.lit('"]')), "array<string>", {"mode": "FAILFAST"}), F.lit(0))).otherwise(key)
    each = F.split(F.translate(F.rtrim(numbers, F.lit("],")), '"', ""), ",")
    w = F.transform(each, lambda x: F.when(x != "null", x.cast("double")))
    wrong = F.raise_error(F.concat(F.lit("not a vocab entry: "), F.substring(line, 1, 100)))
    return F.when(line.rlike(r'^".*":\[[^\[\]]+\],?$'), F.struct(term.alias("term"), w.alias("w"))).otherwise(wrong)


def import_artifact(spark: SparkSession, path: str) -> LinearModel:
    """Read a JSON model artifact whose ``vocab`` maps a term to its idf and
    one coefficient per class.

    Artifacts of ``export_artifact`` are read by many tasks, entry by entry; JSON in any other layout is one object that one task parses.
    """
    lines = _artifact_lines(spark, path)
    if lines is not None:
        head, vocab = _read_lines(path, lines)
    else:
        art = spark.read.schema(ARTIFACT_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
        head = art.select("model_id", "classes", "temperature", "intercept", "eval").limit(2).collect()
        if len(head) != 1:
            raise ValueError(f"{path}: expected one artifact, got {len(head)}")
        vocab = art.select(F.explode("vocab").alias("term", "w"))
    h = head[0]
    classes, intercept = tuple(h["classes"] or ()), tuple(h["intercept"] or ())
    if not classes:
        raise ValueError("model artifact has no classes")
    if h["temperature"] is None:
        raise ValueError("model artifact has no temperature")
    n = len(classes)
    k = F.size("w")
    read = written(vocab.select("term", F.get("w", F.lit(0)).alias("idf"), F.slice("w", 2, n).alias("coef"), k.alias("k")), "artifact")
    found = read.agg(F.count("*").alias("n"), F.max(F.when(F.col("k") != n + 1, F.struct("term", "k"))).alias("wrong")).first()
    if found["wrong"] is not None:
        raise ValueError(f"vocab entry {found['wrong']['term']!r} has {found['wrong']['k']} weights, expected {n + 1}")
    terms = read.drop("k")
    ev = h["eval"]
    return LinearModel(
        h["model_id"], "tfidf", classes, intercept, terms, found["n"], float(h["temperature"]),
        ece_before=ev["ece_before"] if ev else None, ece_after=ev["ece_after"] if ev else None,
        ece_split="artifact" if ev else None,
    )


def export_artifact(model: LinearModel, path: str) -> None:
    """Write a TF-IDF model as one JSON artifact with one vocab entry a line.

    Up to ``ENTRIES_PER_FILE`` entries are one file, sorted by term. More are written by as many tasks as read the terms, in files that
    joined by name are the one object.
    """
    if model.kind != "tfidf":
        raise ValueError("only tfidf models have an artifact form")
    spark = model.terms.sparkSession
    # a null or repeated term is an error, as in a map of all terms
    known = model.terms.agg(F.count("*").alias("n"), F.count("term").alias("terms"), F.max("term").alias("last")).first()
    if known["terms"] != known["n"]:
        raise ValueError("a term of the model is null")
    hashes = model.terms.select(F.xxhash64("term")).distinct().count()
    if hashes != known["n"] and not model.terms.groupBy("term").count().where("count > 1").isEmpty():
        raise ValueError("a term of the model occurs twice")
    head = spark.createDataFrame(
        [(LINES, *(model.meta()[k] for k in ("model_id", "classes", "temperature", "intercept")), (model.ece_before, model.ece_after))],
        f"layout string, {_HEAD_SCHEMA}",
    )
    opened = head.select(F.to_json(F.struct("*")).alias("j")).select(
        F.lit(0).alias("part"), F.lit("").alias("term"), F.concat(F.substr("j", F.lit(1), F.length("j") - 1), F.lit(f",{_OPEN}")).alias("value")
    )
    entry = F.to_json(F.create_map("term", F.concat(F.array("idf"), F.col("coef"))))
    line = F.substr(entry, F.lit(2), F.length(entry) - 2)
    last = F.col("term") == F.lit(known["last"])  # without a comma, so it comes after all others
    entries = model.terms.where(~last).select(F.lit(1).alias("part"), "term", F.concat(line, F.lit(",")).alias("value"))
    final = model.terms.where(last).select(F.lit(2).alias("part"), "term", line.alias("value"))
    closed = spark.range(1).select(F.lit(3).alias("part"), F.lit("").alias("term"), F.lit(_CLOSE).alias("value"))
    tail = final.unionAll(closed).repartition(1).sortWithinPartitions("part")
    ordered = opened.coalesce(1).unionAll(entries).unionAll(tail)  # files are named in this order
    if known["n"] <= ENTRIES_PER_FILE:
        ordered = ordered.repartition(1).sortWithinPartitions("part", "term")
    ordered.select("value").write.text(path)
