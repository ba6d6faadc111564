"""Exact ranks and running totals without putting a group into one task.

A window over one key sends every row of that key to one task. Here each key is
first cut into ordered buckets, the bucket totals (few rows) give each bucket
its offset, and the sorting window runs per bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbitra.functions.ordering import seeded
from arbitra.session import written


def _group_keys(by: Sequence[str]) -> dict[str, Column]:
    # Non-null copies, so that plain equality joins keep rows with a null key.
    return {f"_k{i}": F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for i, c in enumerate(by)}


def hash_rank(
    df: DataFrame,
    key: Sequence[str],
    seed: int | str,
    by: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
    limit: int | None = None,
    digits: int = 3,
) -> DataFrame:
    """1-based rank in seeded order within each ``by`` group.

    ``key`` must identify a row. Buckets are the first hex digits of the
    digest, so they are even whatever the data is. ``limit`` keeps ranks up to
    that number and drops the later buckets before anything is sorted.

    The input is read twice, the first time for its keys alone; give it a table
    on disk rather than the result of a costly query.
    """
    groups = _group_keys(by)
    d = df.withColumn("_h", seeded(seed, *key)).withColumns({**groups, "_b": F.substring("_h", 1, digits)})
    ks = list(groups)
    counts = d.groupBy(*ks, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumns(
        {
            "_off": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_tot": F.sum("_n").over(Window.partitionBy(*ks)),
        }
    ).drop("_n")
    if limit is not None:
        offsets = offsets.filter(F.col("_off") < limit)
    if not ks:
        offsets = F.broadcast(offsets)  # at most 16^digits rows
    w = Window.partitionBy(*ks, "_b").orderBy("_h", *key)
    ranked = d.join(offsets, [*ks, "_b"]).withColumn(rank, F.row_number().over(w) + F.col("_off"))
    if limit is not None:
        ranked = ranked.filter(F.col(rank) <= limit)
    if total:
        ranked = ranked.withColumn(total, F.col("_tot"))
    return ranked.drop("_h", "_b", "_off", "_tot", *ks)


# Own choices: distinct values one window task may hold, and the most buckets.
BUCKET_ROWS = 500_000
MAX_BUCKETS = 4096


def value_buckets(df: DataFrame, value: str, out: str, buckets: int) -> DataFrame:
    """``df`` with the number of the ordered bucket a value falls in, for values of any type that has an order.

    Spark samples splitters and deals the rows by range: buckets hold about equally many rows, and equal values share one. The
    dealt rows are written, so that the numbers stay when executors are lost.
    """
    return written(df.repartitionByRange(buckets, value).withColumn(out, F.spark_partition_id()), "buckets")


def running_totals(
    df: DataFrame,
    value: str,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    buckets: int | None = None,
    previous: str | None = None,
) -> DataFrame:
    """Distinct values of ``value`` per group with sums, and the sums over all
    smaller values.

    Output: ``by``, ``value``, each name of ``sums``, ``<name>_below`` and
    ``<name>_total``, and under the name ``previous`` the next smaller value.
    Null values are left out.
    """
    names = list(sums)
    v = df.filter(F.col(value).isNotNull())
    # Read several times below: written once, so that the input runs once.
    distinct = written(v.groupBy(*by, value).agg(*[c.alias(n) for n, c in sums.items()]), "distinct")
    groups = _group_keys(by)
    ks = list(groups)
    if buckets is None:
        buckets = min(MAX_BUCKETS, distinct.count() // BUCKET_ROWS + 1)
    if buckets == 1:  # few enough values for one window per group
        d, parts = distinct.withColumns(groups), ks
    else:
        d, parts = value_buckets(distinct, value, "_b", buckets).withColumns(groups), [*ks, "_b"]
    ordered = Window.partitionBy(*parts).orderBy(value)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    below = {n: F.coalesce(F.sum(n).over(before), F.lit(0)) for n in names}
    prior = F.lag(value).over(ordered)
    if buckets == 1:
        total = {n: F.sum(n).over(Window.partitionBy(*ks)) for n in names}
    else:
        offsets = d.groupBy(*parts).agg(
            F.max(value).alias("_top"), *[F.sum(n).alias(f"_s{i}") for i, n in enumerate(names)]
        )
        earlier = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = offsets.select(
            *parts,
            F.max("_top").over(earlier).alias("_edge"),
            *[F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)).alias(f"_off{i}") for i in range(len(names))],
            *[F.sum(f"_s{i}").over(Window.partitionBy(*ks)).alias(f"_tot{i}") for i in range(len(names))],
        )
        if not ks:
            offsets = F.broadcast(offsets)  # one row per bucket
        d = d.join(offsets, parts)
        below = {n: c + F.col(f"_off{i}") for i, (n, c) in enumerate(below.items())}
        total = {n: F.col(f"_tot{i}") for i, n in enumerate(names)}
        prior = F.coalesce(prior, F.col("_edge"))
    return d.select(
        *by,
        value,
        *names,
        *[c.alias(f"{n}_below") for n, c in below.items()],
        *[c.alias(f"{n}_total") for n, c in total.items()],
        *([prior.alias(previous)] if previous else []),
    )


def value_at_index(
    df: DataFrame, value: str, indexes: Mapping[str, Column], by: Sequence[str] = (), count: str = "_n"
) -> DataFrame:
    """Order statistics: for each name the value at a 0-based index of the
    sorted values. An index expression may use ``count``, the group's size."""
    totals = running_totals(df, value, {"_c": F.count("*")}, by).withColumnRenamed("_c_total", count)
    picks = []
    for name, index in indexes.items():
        at = F.greatest(F.least(index.cast("bigint"), F.col(count) - 1), F.lit(0))
        hit = (F.col("_c_below") <= at) & (at < F.col("_c_below") + F.col("_c"))
        picks.append(F.max(F.when(hit, F.col(value))).alias(name))
    return totals.groupBy(*by).agg(F.max(count).alias(count), *picks)


def heavy_keys(df: DataFrame, key: str, parts: int = 1000) -> DataFrame:
    """Keys holding more than 1/``parts`` of all rows; fewer than ``parts`` rows
    by construction, so always safe to broadcast."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    return counts.filter(F.col("_n") * parts > counts.agg(F.sum("_n")).scalar()).select(key)


def join_per_key(df: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """Inner join of ``df`` with one row per key, safe when a few keys hold
    most rows: those are joined by broadcast and never shuffled, the rest by
    an ordinary equi-join. Reads ``df`` more than once; give it a table on disk."""
    heavy = heavy_keys(df, key)
    hot_side = F.broadcast(per_key.join(F.broadcast(heavy), key, "left_semi"))
    hot = df.join(hot_side, key)
    cold = df.join(F.broadcast(heavy), key, "left_anti").join(per_key, key)
    return hot.unionByName(cold)
