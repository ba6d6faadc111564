"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.llm.common import Scratch, table

SEED = 42
# A source's mean is split into equal parts of at most this size. A sum of
# independent Poisson counts is Poisson, and a small mean never underflows exp().
PART = 8.0
# Values of a count of mean PART at most that have a probability above 2^-60.
TERMS = 48
# Rows of the per-source table under which it is small enough to broadcast (100 bytes each).
BROADCAST_SOURCES = 100_000
SALTS = 32


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from the MD5 of the parts joined by colons: 52 bits of it, at the middle of their step."""
    key = F.concat_ws(":", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def poisson_table(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS of a Poisson variable, as an array."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.array(F.exp(-mean)),
        lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) * mean / k)),
    )
    return F.aggregate(
        F.slice(terms, 2, TERMS), F.slice(terms, 1, 1), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p))
    )


def rates(docs: DataFrame, source: str, size: Column, weights: Mapping[str, float] | None, alpha: float, epochs: float) -> DataFrame:
    """``(source, size, rate)``: how often each source has to be repeated on average.

    The target share of a source is its given weight over all weights, or, without weights, its own
    size to the power ``alpha`` (1 keeps the natural mix, 0 makes all sources equal).
    """
    scratch = Scratch(docs.sparkSession)
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("double").alias("size"))
    if weights is None:
        wanted = sizes.withColumn("weight", F.pow("size", F.lit(float(alpha))))
    elif not weights:
        raise ValueError("weights must name a source")
    else:
        if any(not (w >= 0) for w in weights.values()):
            raise ValueError("weights must not be negative")
        spark = docs.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        wanted = sizes.join(F.broadcast(given), sizes["source"].eqNullSafe(given["source"]), "left").select(
            sizes["source"], "size", F.coalesce("weight", F.lit(0.0)).alias("weight")
        )
    wanted = scratch.write(wanted, "mix-sizes")
    total = wanted.agg(F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("w"), F.sum("size").alias("n")).first()
    rate = F.col("weight") / F.lit(total.w) * F.lit(total.n) * F.lit(float(epochs)) / F.col("size")
    return wanted.select(
        "source",
        "size",
        F.when(F.lit(weights is not None) & (F.col("weight") == 0), 0.0).when(F.col("size") > 0, rate).otherwise(F.lit(float(epochs))).alias("rate"),
    )


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    *,
    alpha: float = 0.5,
    epochs: float = 1.0,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Repeat every document a Poisson number of times so that sources reach their target shares, in global random order.

    The mean count of a source is ``target share * total size * epochs / its size`` (size: UTF-8 bytes of the text). A
    document's count is found by inverting the Poisson distribution at a number hashed from seed and id, so it does not
    depend on partitioning and a lost task is repeated with the same result. Each row is exploded by its count; a hash of
    (seed, id, copy) then deals all copies over the partitions and orders them within.

    Returns the columns of ``docs`` and ``mix_rate``, ``mix_copy`` (from 0) and ``mix_key`` (the hash); columns of those
    names in the input are replaced. Null and empty texts have size 0; a source of size 0 has the mean ``epochs``. A null
    source is a source of its own, a null id hashes as an empty one. Repeated rows get equal counts each. With given weights,
    a source without one is left out. Empty tables give no rows.
    """
    added = ["mix_rate", "mix_copy", "mix_key"]
    docs = docs.drop(*[c for c in added if c in docs.columns])
    spark, names = docs.sparkSession, docs.columns
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    per = rates(docs, source, size, weights, alpha, epochs)
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    per = Scratch(spark).write(
        per.select(
            F.col("source").alias("__source"), F.col("rate").alias("mix_rate"), parts.alias("__parts"),
            poisson_table(F.col("rate") / parts).alias("__cdf"),
        ),
        "mix-rates",
    )
    if per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(per), F.col(source).eqNullSafe(F.col("__source")))
    else:  # a source's rows are dealt over SALTS keys
        salt = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(SALTS))
        salted = per.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        joined = docs.withColumn("__own", salt).join(
            salted, (F.col("__own") == F.col("__salt")) & F.col(source).eqNullSafe(F.col("__source"))
        )
    key = F.col(doc_id).cast("string")
    draws = F.transform(
        F.sequence(F.lit(1), F.col("__parts")),
        lambda i: uniform(F.lit(str(seed)), key, i.cast("string")),
    )
    # Parts after part: how many steps of the distribution lie at or below the drawn number.
    count = F.aggregate(
        draws, F.lit(0), lambda n, u: n + F.aggregate(F.col("__cdf"), F.lit(0), lambda m, p: m + (p <= u).cast("int"))
    )
    copies = joined.withColumn("__n", count).where("__n > 0").select(
        *[F.col(c) for c in names],
        "mix_rate",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n").cast("bigint") - 1)).alias("mix_copy"),
    )
    keyed = copies.withColumn(
        "mix_key", F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.coalesce(key, F.lit("")), F.col("mix_copy").cast("string")))
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "mix_key").sortWithinPartitions("mix_key").select(*names, *added)


def op1_poisson_mix(spark, sf: str) -> DataFrame:
    """All documents, mixed so that each source's share of bytes is in proportion to the square root of its size."""
    return mix(table(spark, sf, "documents"), alpha=0.5).withColumn("mix_rate", F.round("mix_rate", 9))


_UNIFORM = "(CAST('0x' || substr(md5('42:' || d.doc_id || ':' || i), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"
OP1_SQL = f"""
WITH sizes AS (SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
rates AS (SELECT source, pow(size, 0.5) / sum(pow(size, 0.5)) OVER () * sum(size) OVER () / size AS rate FROM sizes),
parts AS (SELECT source, rate, greatest(CAST(ceil(rate / {PART}) AS BIGINT), 1) AS n_parts FROM rates),
terms AS (SELECT source, k, exp(-rate / n_parts) * pow(rate / n_parts, k) / gamma(k + 1.0) AS p FROM parts, range(0, {TERMS} + 1) t(k)),
cdf AS (SELECT source, list(c ORDER BY k) AS c FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source),
counted AS (
  SELECT d.*, rate, CAST(list_sum(list_transform(range(1, n_parts + 1), lambda i: len(list_filter(c, lambda x: x <= {_UNIFORM})))) AS BIGINT) AS n
  FROM documents d JOIN parts USING (source) JOIN cdf USING (source)
)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS mix_rate, j AS mix_copy, md5('42-order:' || doc_id || ':' || j) AS mix_key
FROM (SELECT *, unnest(range(0, n)) AS j FROM counted)
"""
