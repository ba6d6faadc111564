"""Seeded splits, sampling and set checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions.ordering import seeded_int, seeded_unit
from arbitra.functions.text import tokens_word
from arbitra.operators.ranks import hash_rank, join_per_key


def shuffle(df: DataFrame, key: str, seed: int, out: str = "position") -> DataFrame:
    """Seeded random order as a 0-based position column."""
    return hash_rank(df, [key], seed, rank=out).withColumn(out, F.col(out) - 1)


def split_halves(df: DataFrame, key: str, label: str, seed: int, out: str = "half") -> DataFrame:
    """Stratified halves A and B; of n rows of a label, ``n // 2`` go to A."""
    r = hash_rank(df, [key], seed, [label], rank="_r", total="_t")
    return r.withColumn(out, F.when(F.col("_r") <= F.floor(F.col("_t") / 2), F.lit("A")).otherwise(F.lit("B"))).drop(
        "_r", "_t"
    )


def split_fixed(df: DataFrame, key: str, label: str, n: int, seed: int, out: str = "split") -> DataFrame:
    """The first ``n`` rows per label train, the rest validate."""
    r = hash_rank(df, [key], seed, [label], rank="_r")
    return r.withColumn(out, F.when(F.col("_r") <= n, F.lit("train")).otherwise(F.lit("validation"))).drop("_r")


def split_frac(df: DataFrame, key: str, label: str, frac: float, seed: int, out: str = "split") -> DataFrame:
    """Per label ``max(1, int(n * frac))`` rows train; a lone row trains."""
    r = hash_rank(df, [key], seed, [label], rank="_r", total="_t")
    n_train = F.greatest(F.lit(1), F.floor(F.col("_t") * F.lit(frac)))
    return r.withColumn(out, F.when(F.col("_r") <= n_train, F.lit("train")).otherwise(F.lit("validation"))).drop(
        "_r", "_t"
    )


def split_head(df: DataFrame, key: str, seed: int, least: int = 500, share: int = 10, out: str = "split") -> DataFrame:
    """Hold out the first ``max(least, N // share)`` rows in seeded order."""
    r = hash_rank(df, [key], seed, rank="_r", total="_t")
    held = F.greatest(F.lit(least), F.floor(F.col("_t") / share))
    return r.withColumn(out, F.when(F.col("_r") <= held, F.lit("validation")).otherwise(F.lit("train"))).drop("_r", "_t")


def min_support(df: DataFrame, label: str, n: int = 30) -> DataFrame:
    """Keep the classes with at least ``n`` rows.

    The class sizes are a partial aggregate and large classes are looked up by
    broadcast, so a large class is never gathered in one place.
    """
    kept = df.groupBy(label).agg(F.count("*").alias("_n")).filter(F.col("_n") >= n).select(label)
    return join_per_key(df, kept, label)


def cap_per_class(df: DataFrame, key: str, label: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows per class, the first in seeded order."""
    return hash_rank(df, [key], seed, [label], rank="_r", limit=n).drop("_r")


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of a corpus, the first in seeded order."""
    return hash_rank(df, [key], seed, rank="_r", limit=n).drop("_r")


def split_overlap(splits: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Keys found in more than one split, with the splits' names."""
    parts = [d.select(F.col(key), F.lit(name).alias("split")) for name, d in splits.items()]
    seen = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return seen.filter(F.size("splits") > 1)


def assert_disjoint(splits: Mapping[str, DataFrame], key: str) -> None:
    """Raise when a key is in two splits."""
    shared = split_overlap(splits, key).limit(1).collect()
    if shared:
        raise ValueError(f"leakage between splits {shared[0]['splits']}: {key} = {shared[0][key]!r}")


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All training sources in one table with a ``source`` column."""
    return reduce(DataFrame.unionByName, [d.withColumn("source", F.lit(name)) for name, d in sources.items()])


def source_counts(unioned: DataFrame, label: str) -> DataFrame:
    return unioned.groupBy("source", label).agg(F.count("*").alias("n"))


def normalized(text: Column | str) -> Column:
    """Lowercased words joined by one space."""
    return F.array_join(tokens_word(text), " ")


def drop_probe_overlap(df: DataFrame, probe: DataFrame, text: str, probe_text: str | None = None) -> DataFrame:
    """Drop rows whose normalised text equals a probe's."""
    taken = probe.select(F.sha2(normalized(probe_text or text), 256).alias("_k")).distinct()
    return df.withColumn("_k", F.sha2(normalized(text), 256)).join(taken, "_k", "left_anti").drop("_k")


def build_pairs(df: DataFrame, group: str, key: str, score: str, text: str, gap: float = 3.0, seed: int = 11) -> DataFrame:
    """One comparison per group: its best candidate against the strongest one
    that is at least ``gap`` worse.

    Sides are swapped by seeded coin and ``label`` names the better side. Both
    picks are partial aggregates; the join between them shuffles no hot group.
    Groups without such a pair drop out.
    """
    cand = F.struct(F.col(score).alias("s"), (-F.col(key)).alias("k"), F.col(text).alias("t"))
    best = df.groupBy(group).agg(F.max(cand).alias("_best"))
    joined = join_per_key(df, best, group)
    second = (
        joined.filter(F.col("_best.s") - F.col(score) >= gap)
        .groupBy(group)
        .agg(F.max(cand).alias("_other"), F.max("_best").alias("_best"))
    )
    swap = seeded_int(seed, group) % 2 == 1
    first, last = F.when(swap, F.col("_other")).otherwise(F.col("_best")), F.when(swap, F.col("_best")).otherwise(F.col("_other"))
    return second.select(
        group,
        F.concat(F.lit("A "), first["t"], F.lit(" || B "), last["t"]).alias("text"),
        F.when(swap, F.lit("B")).otherwise(F.lit("A")).alias("label"),
        F.col("_best.s").alias("best_score"),
        F.col("_other.s").alias("other_score"),
    )
