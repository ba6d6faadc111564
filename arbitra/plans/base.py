"""Query registry and shared pieces."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL when there is one."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


def r6(c: Column | str) -> Column:
    """Rounded for comparison across engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def with_sql(ctes: Sequence[str], final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


# --- SQL pieces -------------------------------------------------------------

WORDS = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
ALNUM = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"


def words_sql(c: str) -> str:
    return WORDS.format(c=c)


def alnum_sql(c: str) -> str:
    return ALNUM.format(c=c)


def bigrams_sql(t: str) -> str:
    return f"list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


def hex_int_sql(h: str) -> str:
    """The first seven hex digits of a digest as a number."""
    return f"CAST('0x' || substr({h}, 1, 7) AS BIGINT)"


HEX = "'0123456789ABCDEF'"


def bucket_sql(tok: str) -> str:
    """Low 14 bits of FNV-1a over the UTF-8 bytes of a token."""
    digit = f"(instr({HEX}, substr(hex({tok}), 2 * i + 1, 1)) - 1) * 16 + instr({HEX}, substr(hex({tok}), 2 * i + 2, 1)) - 1"
    octets = f"list_transform(range(0, CAST(len(hex({tok})) / 2 AS BIGINT)), lambda i: CAST({digit} AS BIGINT))"
    return f"list_reduce(list_prepend(8997::BIGINT, {octets}), lambda h, b: (xor(h, b) * 435) & 16383)"


# Quality label of the labelled documents.
LABELLED = (
    "labelled AS (SELECT doc_id, text, lang, source, n_chars, toxic, "
    "CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS truth FROM documents JOIN labels USING (doc_id))"
)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a quality label."""
    return (
        documents(spark, sf)
        .join(table(spark, sf, "labels"), "doc_id")
        .select(
            "doc_id", "text", "lang", "source", "n_chars", "toxic",
            F.when(F.col("quality") == 1, "good").otherwise("poor").alias("truth"),
        )
    )


# Embeddings as raw logits of ten classes: EMB_SCALE times the product of all 64 values
# with the mean vector of each class.
EMB_CLASSES = [str(i) for i in range(10)]
EMB_SCALE = 40.0
EMB = [
    "means AS (SELECT label, list(m ORDER BY i) AS w FROM (SELECT label, i, round(avg(embedding[i]::DOUBLE), 9) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL) GROUP BY label)",
    f"e AS (SELECT vec_id, truth, list(v ORDER BY k) AS z FROM (SELECT vec_id, e.label AS truth, m.label AS k, {EMB_SCALE} * list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * w[i])) AS v FROM embeddings e, means m) GROUP BY ALL)",
    "s AS (SELECT *, list_max(z) AS m FROM e)",
    "x AS (SELECT *, list_transform(z, lambda v: exp(v - m)) AS ex FROM s)",
    "y AS (SELECT *, list_sum(ex) AS tot FROM x)",
    "q AS (SELECT *, list_transform(ex, lambda v: v / tot) AS p FROM y)",
    "d AS (SELECT vec_id, truth, z, p, list_max(p) AS confidence, 10 - list_position(list_reverse(p), list_max(p)) AS label, "
    "-(m + ln(tot)) AS energy FROM q)",
]


def emb_logits(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, truth, logits). Ten mean vectors of 64 numbers go into the plan as one constant."""
    e = table(spark, sf, "embeddings")
    means = e.groupBy("label").agg(*[F.round(F.avg(F.get("embedding", F.lit(i)).cast("double")), 9) for i in range(64)]).orderBy("label").collect()
    w = F.from_json(F.lit(json.dumps([list(r[1:]) for r in means])), "array<array<double>>")
    dot = lambda m: F.aggregate(F.zip_with("embedding", m, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, b: a + b)
    return e.select("vec_id", F.col("label").cast("string").alias("truth"), F.transform(w, lambda m: dot(m) * EMB_SCALE).alias("logits"))
