"""Temperature scaling, calibration error and the abstain threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions import prob as P
from arbitra.operators.model import LinearModel
from arbitra.operators.ranks import value_at_index
from arbitra.operators.score import score
from arbitra.session import written

# The temperature grid, 80 points spaced evenly in the logarithm
# from 0.05 to 10.
TEMPERATURES = tuple(0.05 * 200.0 ** (i / 79) for i in range(80))


def temperature_losses(df: DataFrame, logits: str = "logits", target: str = "target") -> DataFrame:
    """(i, temperature, nll): mean loss at every grid point.

    The grid is exploded beside each row, so one pass leaves 80 partial sums
    per task.
    """
    grid = F.array(*[F.lit(t) for t in TEMPERATURES])
    each = df.select(logits, target, F.posexplode(grid).alias("i", "temperature"))
    return each.groupBy("i", "temperature").agg(
        F.avg(P.neg_log_likelihood(F.col(logits), F.col(target), F.col("temperature"))).alias("nll")
    )


def fit_temperature(df: DataFrame, logits: str = "logits", target: str = "target") -> DataFrame:
    """One row: the grid temperature of least mean loss; the first wins a tie."""
    return temperature_losses(df, logits, target).orderBy("nll", "i").limit(1).select("temperature", "nll")


def _binned(df: DataFrame, bin_of: Column, bins: int, confidence: str, correct: str) -> DataFrame:
    return (
        df.withColumn("bin", bin_of)
        .groupBy("bin")
        .agg(
            F.count("*").alias("n"),
            F.avg(F.col(correct).cast("double")).alias("accuracy"),
            F.avg(confidence).alias("mean_confidence"),
        )
    )


def unit_bin(confidence: Column, bins: int = 10) -> Column:
    """Equal bins over [0, 1], the last one closed."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    return F.least(F.floor(inside * bins), F.lit(bins - 1)).cast("int")


def reliability(df: DataFrame, bins: int = 10, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """Rows, accuracy and mean confidence per occupied bin."""
    return _binned(df, unit_bin(F.col(confidence), bins), bins, confidence, correct)


def _gap_sum(table: DataFrame) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))
    total = F.sum("n")
    inside = F.sum(F.when(F.col("bin").isNotNull(), gap))
    return table.agg(F.when(total > 0, F.coalesce(inside, F.lit(0.0)) / total).otherwise(F.lit(0.0)).alias("ece"))


def ece(df: DataFrame, bins: int = 10, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """Expected calibration error; 0 for an empty table."""
    return _gap_sum(reliability(df, bins, confidence, correct))


def ece_half(df: DataFrame, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """ECE over ten bins of [0.5, 1]. Rows below fall in no bin but count in
    the denominator."""
    c = F.col(confidence)
    edges = [0.5 + b * 0.05 for b in range(11)]
    bin_of = F.lit(None).cast("int")
    for b in range(10):
        upper = c <= edges[b + 1] if b == 9 else c < edges[b + 1]
        bin_of = F.when((c >= edges[b]) & upper, F.lit(b)).otherwise(bin_of)
    return _gap_sum(_binned(df, bin_of, 10, confidence, correct))


def judged(df: DataFrame, classes: Sequence[str], temperature: float, label: str, logits: str = "logits") -> DataFrame:
    """(confidence, correct) of scored rows at a temperature."""
    p = P.softmax(F.col(logits), temperature)
    return df.withColumn("_p", p).select(
        F.array_max("_p").alias("confidence"),
        (F.get(P.array_literal(classes), P.argmax_last(F.col("_p"))) == F.col(label)).alias("correct"),
    )


def calibrate_logits(df: DataFrame, classes: Sequence[str], label: str = "label", logits: str = "logits") -> dict:
    """Fit the temperature on scored rows and measure ECE before and after.

    "Before" is always at temperature 1. An empty table or a label outside
    ``classes`` is an error.
    """
    known = P.array_literal(classes)
    stats = df.agg(
        F.count("*").alias("n"), F.max(F.when(~F.coalesce(F.col(label).isin(list(classes)), F.lit(False)), F.coalesce(F.col(label), F.lit("null")))).alias("unknown")
    ).first()
    if not stats["n"]:
        raise ValueError("calibrate: no validation examples")
    if stats["unknown"] is not None:
        raise ValueError(f"calibrate: unknown label {stats['unknown']!r} (not seen in training)")
    targets = df.withColumn("target", (F.array_position(known, F.col(label)) - 1).cast("int"))
    temperature = float(fit_temperature(targets, logits).first()["temperature"])
    before = ece(judged(df, classes, 1.0, label, logits)).first()["ece"]
    after = ece(judged(df, classes, temperature, label, logits)).first()["ece"]
    return {"temperature": temperature, "ece_before": before, "ece_after": after}


def calibrate(model: LinearModel, validation: DataFrame, id_col: str, text_col: str, label: str) -> LinearModel:
    """The model with its temperature fitted on held-out rows."""
    scored = written(score(validation, model, id_col, text_col, [label]).select(label, "logits"), "calibrate")
    fit = calibrate_logits(scored, model.classes, label)
    return model.with_(**fit, ece_split="validation")


def fit_abstain(df: DataFrame, q: float = 0.95, energy: str = "energy", exact: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Abstain threshold: a percentile of held-out energies.

    Exact: linear interpolation between the two neighbouring order statistics.
    Otherwise Spark's approximate percentile, one pass with a bounded sketch.
    """
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must be in [0,1]")
    if not exact:
        return df.groupBy(*by).agg(F.percentile_approx(energy, q, 10000).alias("threshold"))
    place = F.lit(q) * (F.col("_n") - 1)
    stats = value_at_index(df, energy, {"_lo": F.floor(place), "_hi": F.ceil(place)}, by)
    share = place - F.floor(place)
    return stats.select(*by, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias("threshold"))


def selective_report(
    df: DataFrame, label: str = "label", truth: str = "truth", action: str = "action", in_task: Column | None = None
) -> DataFrame:
    """One row: accuracy of the answered, accuracy with abstain counted wrong,
    abstain rate, and per cohort how much is kept or turned away."""
    inside = F.coalesce(in_task, F.lit(False)) if in_task is not None else F.lit(True)
    kept = F.col(action) != "abstain"
    hit = (F.col(label) == F.col(truth)).cast("double")
    flag = kept.cast("double")
    return df.select(inside.alias("_in"), kept.alias("_kept"), hit.alias("_hit"), flag.alias("_flag")).agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("_in") & F.col("_kept"), F.col("_hit"))).alias("answered_accuracy"),
        F.avg(F.when(F.col("_in"), F.col("_hit") * F.col("_flag"))).alias("accuracy_abstain_wrong"),
        F.avg(F.when(F.col("_in"), 1 - F.col("_flag"))).alias("abstain_rate"),
        F.avg(F.when(F.col("_in"), F.col("_flag"))).alias("in_task_kept"),
        F.avg(F.when(~F.col("_in"), 1 - F.col("_flag"))).alias("out_of_task_abstained"),
    )


def energy_report(df: DataFrame, thresholds: Sequence[float], correct: str = "correct", energy: str = "energy") -> DataFrame:
    """Per abstain threshold: misses it would turn into abstentions, correct
    answers it would lose, and the energy range of both."""
    c, e = F.col(correct), F.col(energy)
    each = df.select(c.alias("_c"), e.alias("_e"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    over = F.col("_e") > F.col("threshold")
    return each.groupBy("threshold").agg(
        F.count_if(over & ~F.col("_c")).alias("misses_converted"),
        F.count_if(over & F.col("_c")).alias("correct_lost"),
        F.count_if(~F.col("_c")).alias("misses"),
        F.count_if(F.col("_c")).alias("correct"),
        F.min(F.when(~F.col("_c"), F.col("_e"))).alias("miss_min"),
        F.max(F.when(~F.col("_c"), F.col("_e"))).alias("miss_max"),
        F.min(F.when(F.col("_c"), F.col("_e"))).alias("correct_min"),
        F.max(F.when(F.col("_c"), F.col("_e"))).alias("correct_max"),
    )


def energy_spread(df: DataFrame, qs: Sequence[float] = (0.05, 0.5, 0.95), correct: str = "correct", energy: str = "energy") -> DataFrame:
    """Exact energy quantiles of hits and misses (the value at
    ``ceil(q * n) - 1`` of the sorted energies)."""
    places = {f"q{int(round(q * 100))}": F.ceil(F.lit(q) * F.col("n")) - 1 for q in qs}
    return value_at_index(df, energy, places, [correct], count="n")
