"""Models for the queries whose weights SQL can restate.

The coefficient of a term is the smoothed log share of a class's documents that
contain it, less its mean over the classes; the intercept is the log share of
the class.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.functions.text import bucket_counts, ngrams, tokens_word
from arbitra.operators.model import LinearModel
from arbitra.plans.base import LABELLED, bigrams_sql, alnum_sql, bucket_sql, labelled, words_sql
from arbitra.session import written

TEMPERATURE = 2.0
_fitted: dict[tuple, LinearModel] = {}


def log_share_model(df: DataFrame, text: str, label: str, kind: str, model_id: str) -> LinearModel:
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    classes, n = sorted(sizes), sum(sizes.values())
    if kind == "tfidf":
        keys = F.array_distinct(ngrams(tokens_word(text), 1, 2))
        key = "term"
    else:
        keys = F.transform(bucket_counts(text), lambda t: t["key"])
        key = "bucket"
    rows = df.select(F.explode(keys).alias(key), label)
    counted = rows.groupBy(key).agg(
        F.count("*").alias("df"), *[F.count_if(F.col(label) == c).alias(f"n{i}") for i, c in enumerate(classes)]
    )
    shares = [F.log((F.col(f"n{i}") + 1) / F.lit(sizes[c] + 2.0)) for i, c in enumerate(classes)]
    mean = sum(shares[1:], shares[0]) / len(classes)
    coef = F.array(*[s - mean for s in shares])
    idf = [(F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")] if kind == "tfidf" else []
    terms = written(counted.select(key, *idf, coef.alias("coef")), f"{model_id}-terms")
    intercept = tuple(math.log(sizes[c] / n) for c in classes)
    return LinearModel(model_id, kind, tuple(classes), intercept, terms, terms.count(), temperature=TEMPERATURE)


def _once(spark: SparkSession, sf: str, name: str, fit) -> LinearModel:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _fitted:
        _fitted[key] = fit()
    return _fitted[key]


def quality_model(spark: SparkSession, sf: str) -> LinearModel:
    """TF-IDF model of the documents' quality label."""
    return _once(
        spark, sf, "quality", lambda: log_share_model(labelled(spark, sf), "text", "truth", "tfidf", "quality")
    )


def quality_hashed(spark: SparkSession, sf: str) -> LinearModel:
    """Hashed model of the same label."""
    return _once(
        spark, sf, "quality_hashed", lambda: log_share_model(labelled(spark, sf), "text", "truth", "hashed", "quality_hashed")
    )


def toxic_model(spark: SparkSession, sf: str) -> LinearModel:
    """TF-IDF model of the toxic label, with classes ``false`` and ``true``."""
    rows = labelled(spark, sf).withColumn("flag", (F.col("toxic") == 1).cast("string"))
    return _once(spark, sf, "toxic", lambda: log_share_model(rows, "text", "flag", "tfidf", "toxic"))


def _sizes(n0: str, n1: str, src: str) -> str:
    return f"c AS (SELECT count(*) AS n, count_if({n0}) AS m0, count_if({n1}) AS m1 FROM {src})"


GRAM_COUNTS = [
    f"toks AS (SELECT doc_id, {words_sql('text')} AS t FROM documents)",
    f"tc AS MATERIALIZED (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({bigrams_sql('t')}) AS term FROM toks) GROUP BY ALL)",
]


def tfidf_model_sql(name: str, first: str, second: str) -> list[str]:
    """CTEs ``<name>_v`` (term, idf, c0, c1) and ``<name>_z`` (doc_id, z0, z1).

    ``first`` and ``second`` are the conditions of the two classes, in order.
    """
    return [
        f"{name}_n AS (SELECT count(*) AS n, count_if({first}) AS m0, count_if({second}) AS m1 FROM labelled)",
        f"{name}_t AS (SELECT term, count(*) AS df, count_if({first}) AS k0, count_if({second}) AS k1 "
        "FROM tc JOIN labelled USING (doc_id) GROUP BY term)",
        f"{name}_v AS MATERIALIZED (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf, (ln((k0 + 1) / (m0 + 2.0)) - ln((k1 + 1) / (m1 + 2.0))) / 2 AS c0, "
        f"-(ln((k0 + 1) / (m0 + 2.0)) - ln((k1 + 1) / (m1 + 2.0))) / 2 AS c1 FROM {name}_t, {name}_n)",
        f"{name}_x AS (SELECT doc_id, (1 + ln(n)) * idf AS x, c0, c1 FROM tc JOIN {name}_v USING (term))",
        f"{name}_s AS (SELECT doc_id, sum(x * x) AS sq, sum(x * c0) AS s0, sum(x * c1) AS s1 FROM {name}_x GROUP BY doc_id)",
        f"{name}_z AS MATERIALIZED (SELECT doc_id, ln(m0 / n) + coalesce(s0 / sqrt(sq), 0) AS z0, ln(m1 / n) + coalesce(s1 / sqrt(sq), 0) AS z1 "
        f"FROM documents LEFT JOIN {name}_s USING (doc_id), {name}_n)",
    ]


def decided_sql(name: str, z: str, l0: str, l1: str, energy: bool = True, temperature: float = TEMPERATURE) -> str:
    """CTE (doc_id, z0, z1, p0, p1, label, confidence, energy) from (doc_id, z0, z1)."""
    t = temperature
    e = "-(greatest(z0, z1) + ln(exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))))" if energy else "CAST(NULL AS DOUBLE)"
    p = f"1 / (1 + exp((z1 - z0) / {t}))", f"1 / (1 + exp((z0 - z1) / {t}))"
    return (
        f"{name} AS MATERIALIZED (SELECT doc_id, z0, z1, {p[0]} AS p0, {p[1]} AS p1, CASE WHEN z1 >= z0 THEN '{l1}' ELSE '{l0}' END AS label, "
        f"greatest({p[0]}, {p[1]}) AS confidence, {e} AS energy FROM {z})"
    )


QUALITY_SQL = [LABELLED, *GRAM_COUNTS, *tfidf_model_sql("qm", "truth = 'good'", "truth = 'poor'"), decided_sql("dec", "qm_z", "good", "poor")]
TOXIC_SQL = [*tfidf_model_sql("tm", "toxic <> 1", "toxic = 1"), decided_sql("tox", "tm_z", "false", "true")]

BUCKET_COUNTS = [
    f"atoks AS (SELECT doc_id, unnest({alnum_sql('text')}) AS tok FROM documents)",
    f"codes AS MATERIALIZED (SELECT tok, {bucket_sql('tok')} AS bucket FROM (SELECT DISTINCT tok FROM atoks))",
    "bc AS MATERIALIZED (SELECT doc_id, bucket, count(*) AS n FROM atoks JOIN codes USING (tok) GROUP BY ALL)",
]
HASHED_SQL = [
    *BUCKET_COUNTS,
    "hm_n AS (SELECT count(*) AS n, count_if(truth = 'good') AS m0, count_if(truth = 'poor') AS m1 FROM labelled)",
    "hm_t AS (SELECT bucket, count_if(truth = 'good') AS k0, count_if(truth = 'poor') AS k1 FROM bc JOIN labelled USING (doc_id) GROUP BY bucket)",
    "hm_v AS (SELECT bucket, (ln((k0 + 1) / (m0 + 2.0)) - ln((k1 + 1) / (m1 + 2.0))) / 2 AS c0, -(ln((k0 + 1) / (m0 + 2.0)) - ln((k1 + 1) / (m1 + 2.0))) / 2 AS c1 FROM hm_t, hm_n)",
    "hm_s AS (SELECT doc_id, sum(n * c0) AS s0, sum(n * c1) AS s1 FROM bc JOIN hm_v USING (bucket) GROUP BY doc_id)",
    "hm_z AS MATERIALIZED (SELECT doc_id, ln(m0 / n) + coalesce(s0, 0) AS z0, ln(m1 / n) + coalesce(s1, 0) AS z1 "
    "FROM documents LEFT JOIN hm_s USING (doc_id), hm_n)",
    decided_sql("hdec", "hm_z", "good", "poor", energy=False),
]
