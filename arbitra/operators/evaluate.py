"""Metrics of labelled decisions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbitra.operators.ranks import running_totals, value_at_index


def confusion(df: DataFrame, truth: str = "truth", label: str = "label") -> DataFrame:
    """(truth, label, n) for every pair that occurs."""
    return df.groupBy(truth, label).agg(F.count("*").alias("n"))


def binary_metrics(df: DataFrame, positive: str, truth: str = "truth", label: str = "label") -> DataFrame:
    """tp, fp, fn, tn and the ratios over them; a ratio over nothing is null."""
    t, p = F.col(truth) == positive, F.col(label) == positive
    counts = df.agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "*",
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(fp, fp + tn).alias("false_positive_rate"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def accuracy(df: DataFrame, truth: str = "truth", label: str = "label") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(label)).cast("double")).alias("accuracy"))


def class_f1(df: DataFrame, truth: str = "truth", label: str = "label") -> DataFrame:
    """(class, support, f1) for every class seen as truth or as answer.

    Works on the confusion counts, so only a K x K table is exploded.
    """
    table = confusion(df, truth, label)
    sides = table.select(
        F.explode(F.array(F.struct(F.col(truth).alias("class"), F.lit("t").alias("side")), F.struct(F.col(label).alias("class"), F.lit("p").alias("side")))).alias("s"),
        (F.col(truth) == F.col(label)).alias("hit"),
        "n",
    ).select("s.class", "s.side", "hit", "n")
    n = F.col("n")
    return (
        sides.groupBy("class")
        .agg(
            F.coalesce(F.sum(F.when(F.col("side") == "t", n)), F.lit(0)).alias("support"),
            F.coalesce(F.sum(F.when((F.col("side") == "t") & F.col("hit"), n)), F.lit(0)).alias("_tp"),
            F.sum("n").alias("_all"),
        )
        .select("class", "support", (2 * F.col("_tp") / F.col("_all")).alias("f1"))
    )


def macro_f1(df: DataFrame, truth: str = "truth", label: str = "label") -> DataFrame:
    """Mean of the per-class F1."""
    return class_f1(df, truth, label).agg(F.count("*").alias("n_classes"), F.avg("f1").alias("macro_f1"))


def auroc(df: DataFrame, score: str = "score", positive: Column | str = "positive", by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney AUROC, ties counted half; NaN where one class is missing.

    Rows are first reduced to counts per distinct score; the running count of
    negatives is then taken over ordered buckets of scores.
    """
    pos = F.col(positive) if isinstance(positive, str) else positive
    totals = running_totals(
        df, score, {"p": F.sum(F.when(pos, 1).otherwise(0)), "n": F.sum(F.when(pos, 0).otherwise(1))}, by
    )
    wins = F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2.0))
    pairs = F.max("p_total") * F.max("n_total")
    return totals.groupBy(*by).agg(
        F.when(pairs > 0, wins / pairs).otherwise(F.lit(float("nan"))).alias("auroc")
    )


def wilson(df: DataFrame, k: str, n: str, z: float = 1.959963984540054) -> DataFrame:
    """Add the Wilson interval of ``k`` successes in ``n``."""
    p, m, zz = F.col(k) / F.col(n), F.col(n), z * z
    centre = (p + zz / (2 * m)) / (1 + zz / m)
    half = z * F.sqrt(p * (1 - p) / m + zz / (4 * m * m)) / (1 + zz / m)
    return df.withColumn("low", centre - half).withColumn("high", centre + half)


def rank_index(p: float, method: str, n: str = "n") -> Column:
    """0-based index of a percentile under one of three conventions."""
    size = F.col(n)
    if method == "ceil":
        return F.ceil(F.lit(p) * size) - 1
    if method == "round":
        return F.floor(F.lit(p) * (size - 1) + 0.5)
    if method == "trunc":
        return F.floor(size * F.lit(p))
    raise ValueError(f"unknown percentile method {method!r}")


def percentile_rank(df: DataFrame, value: str, p: float, method: str = "ceil", by: Sequence[str] = ()) -> DataFrame:
    """The sorted value at the percentile's index; exact at any size."""
    return value_at_index(df, value, {"value": rank_index(p, method)}, by, count="n")


def latency_summary(log: DataFrame, latency: str, by: Sequence[str] = ()) -> DataFrame:
    """p50, p99, mean and throughput (decisions per unit of time spent)."""
    totals = running_totals(
        log, latency, {"_c": F.count("*"), "_w": F.sum(latency)}, by
    )
    n = F.max("_c_total")
    picked = totals.withColumn("n", F.col("_c_total"))
    picks = []
    for name, p in (("p50", 0.50), ("p99", 0.99)):
        at = F.greatest(rank_index(p, "ceil"), F.lit(0))
        hit = (F.col("_c_below") <= at) & (at < F.col("_c_below") + F.col("_c"))
        picks.append(F.max(F.when(hit, F.col(latency))).alias(name))
    return picked.groupBy(*by).agg(
        n.alias("n"), *picks, (F.sum("_w") / n).alias("mean"), F.try_divide(n.cast("double"), F.sum("_w")).alias("throughput")
    )


def compare_engines(answers: DataFrame, truth: DataFrame, id_col: str = "id", subset: str = "flip") -> DataFrame:
    """Correct answers per engine, overall (subset null) and by subset flag.

    ``answers`` is (id, engine, label); a null label is an error and counted
    apart. ``truth`` is (id, expect, subset).
    """
    joined = answers.join(truth.select(id_col, "expect", subset), id_col)
    return (
        joined.rollup("engine", subset)
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("label").isNotNull()).alias("answered"),
            F.count_if(F.col("label") == F.col("expect")).alias("correct"),
            F.count_if(F.col("label").isNull()).alias("errors"),
        )
        .filter(F.col("engine").isNotNull())
    )


def agreement(a: DataFrame, b: DataFrame, id_col: str, label: str = "label", logits: str = "logits") -> DataFrame:
    """Share of equal labels and the largest absolute logit difference."""
    other = b.select(id_col, F.col(label).alias("_l"), F.col(logits).alias("_z"))
    gap = F.array_max(F.transform(F.arrays_zip(F.col(logits).alias("x"), F.col("_z").alias("y")), lambda e: F.abs(e["x"] - e["y"])))
    return a.join(other, id_col).agg(
        F.count("*").alias("n"),
        F.avg((F.col(label) == F.col("_l")).cast("double")).alias("agree"),
        F.max(gap).alias("max_logit_diff"),
    )


def class_balance(df: DataFrame, label: str, by: Sequence[str] = (), positive: str | None = None) -> DataFrame:
    """Rows per class with their share, or per group the positive rate."""
    if positive is not None:
        return df.groupBy(*by).agg(
            F.count("*").alias("n"),
            F.count_if(F.col(label) == positive).alias("n_positive"),
            F.avg((F.col(label) == positive).cast("double")).alias("positive_rate"),
        )
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def _long(df: DataFrame, features: Sequence[str], positive: Column) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(F.explode(pairs).alias("e"), positive.alias("_pos")).select("e.feature", "e.value", "_pos")


def best_stump(train: DataFrame, test: DataFrame, features: Sequence[str], positive: Column) -> DataFrame:
    """The best one-feature threshold rule of ``train``, judged on ``test``.

    The feature of highest AUROC is cut where ``value >= threshold`` is most
    accurate; candidates are 0.5 and the midpoints of neighbouring values. The
    earlier feature, and the lower threshold, win a tie.
    """
    order = F.array(*[F.lit(f) for f in features])
    long = _long(train, features, positive)
    totals = running_totals(
        long, "value", {"p": F.sum(F.col("_pos").cast("int")), "n": F.sum(1 - F.col("_pos").cast("int"))}, ["feature"],
        previous="prev",
    )
    by_feature = totals.groupBy("feature").agg(
        (F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2.0)) / (F.max("p_total") * F.max("n_total"))).alias("auroc")
    )
    best = by_feature.orderBy(F.desc("auroc"), F.array_position(order, F.col("feature"))).limit(1)
    mine = totals.join(F.broadcast(best), "feature")
    # Cut below each value: everything at or above it is called positive.
    right = F.col("p_total") - F.col("p_below") + F.col("n_below")
    cuts = mine.filter(F.col("prev").isNotNull()).select(
        "feature", "auroc", ((F.col("value") + F.col("prev")) / 2).alias("threshold"), right.alias("hits")
    )
    half = mine.groupBy("feature", "auroc").agg(
        F.lit(0.5).alias("threshold"),
        F.sum(F.when(F.col("value") >= 0.5, F.col("p")).otherwise(F.col("n"))).alias("hits"),
    )
    chosen = cuts.unionByName(half).orderBy(F.desc("hits"), "threshold").limit(1)
    judged = _long(test, features, positive).join(F.broadcast(chosen), "feature")
    return judged.groupBy("feature", "auroc", "threshold").agg(
        F.count("*").alias("n_test"),
        F.avg(((F.col("value") >= F.col("threshold")) == F.col("_pos")).cast("double")).alias("test_accuracy"),
    )


def ablate(
    df: DataFrame, field_sets: dict[str, Sequence[str]], run: Callable[[DataFrame, str], DataFrame], text: str = "text"
) -> DataFrame:
    """Train and evaluate once per field subset; ``run`` gets the table with its
    serialised text and returns one row of metrics."""
    from arbitra.operators.inputs import serialize_fields

    rows = [
        run(serialize_fields(df, [(f, f) for f in fields], text), name).withColumn("fields", F.lit(name))
        for name, fields in field_sets.items()
    ]
    return reduce(DataFrame.unionByName, rows)
