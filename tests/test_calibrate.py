import math
import random

import pytest
from pyspark.sql import functions as F

from arbitra.operators import calibrate as C


def _judged(spark, rows):
    return spark.createDataFrame(rows, "confidence double, correct boolean")


def _softmax(z, t):
    m = max(z)
    e = [math.exp((v - m) / t) for v in z]
    return [v / sum(e) for v in e]


def test_grid():
    assert len(C.TEMPERATURES) == 80
    assert C.TEMPERATURES[0] == 0.05 and math.isclose(C.TEMPERATURES[-1], 10.0)


def test_fitted_temperature_matches_a_plain_search(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(150):
        z = [rng.gauss(0, 4) for _ in range(3)]
        y = z.index(max(z)) if rng.random() < 0.6 else rng.randrange(3)
        rows.append((z, y))
    df = spark.createDataFrame(rows, "logits array<double>, target int")

    def loss(t):
        return sum(-math.log(max(_softmax(z, t)[y], 1e-15)) for z, y in rows) / len(rows)

    best = min(C.TEMPERATURES, key=loss)
    got = C.fit_temperature(df).first()
    assert got["temperature"] == best and math.isclose(got["nll"], loss(best), rel_tol=1e-9)
    labelled = df.withColumn("label", F.col("target").cast("string"))
    fit = C.calibrate_logits(labelled, ["0", "1", "2"])
    assert fit["temperature"] == best and fit["ece_after"] < fit["ece_before"]


def test_probability_floor_and_first_of_ties(spark):
    df = spark.createDataFrame([([500.0, -500.0], 1)], "logits array<double>, target int")
    losses = {r["i"]: r["nll"] for r in C.temperature_losses(df).collect()}
    assert losses[0] == pytest.approx(-math.log(1e-15))
    flat = spark.createDataFrame([([1.0, 1.0], 0)], "logits array<double>, target int")
    assert C.fit_temperature(flat).first()["temperature"] == C.TEMPERATURES[0]


def test_ece(spark):
    assert C.ece(_judged(spark, [])).first()[0] == 0.0
    assert C.ece(_judged(spark, [(0.9, True), (0.8, True), (0.7, True)])).first()[0] == pytest.approx(0.2)
    # 1.0 belongs to the last bin, together with 0.95.
    assert C.reliability(_judged(spark, [(1.0, True), (0.95, False)])).count() == 1


def test_half_range_ece(spark):
    assert C.ece_half(_judged(spark, [(0.9, True), (0.9, False)])).first()[0] == pytest.approx(0.4)
    assert C.ece_half(_judged(spark, [(1.0, True)])).first()[0] == pytest.approx(0.0)
    # A row below 0.5 is in no bin but in the denominator.
    assert C.ece_half(_judged(spark, [(0.9, False), (0.2, True)])).first()[0] == pytest.approx(0.45)


def test_calibration_refuses_bad_rows(spark):
    df = spark.createDataFrame([([1.0, 0.0], "x")], "logits array<double>, label string")
    with pytest.raises(ValueError, match="unknown label"):
        C.calibrate_logits(df, ["a", "b"])
    with pytest.raises(ValueError, match="no validation"):
        C.calibrate_logits(df.filter("false"), ["a", "b"])


def test_selective_report(spark):
    rows = [("a", "a", "act", True), ("a", "b", "act", True), ("a", "a", "abstain", True), ("b", "b", "review", True), ("a", None, "abstain", False), ("a", None, "act", False)]
    df = spark.createDataFrame(rows, "label string, truth string, action string, inside boolean")
    r = C.selective_report(df, in_task=F.col("inside")).first()
    assert r["answered_accuracy"] == pytest.approx(2 / 3)
    assert r["accuracy_abstain_wrong"] == pytest.approx(0.5)
    assert (r["abstain_rate"], r["in_task_kept"], r["out_of_task_abstained"]) == (0.25, 0.75, 0.5)


def test_energy_gate_report(spark):
    rows = [(-0.69, False), (-0.69, False), (-0.9, True), (-1.5, True)]
    df = spark.createDataFrame(rows, "energy double, correct boolean")
    r = C.energy_report(df, [-0.6985]).first()
    assert (r["misses_converted"], r["correct_lost"]) == (2, 0)
    spread = {x["correct"]: x for x in C.energy_spread(df).collect()}
    assert spread[True]["q50"] == -1.5 and spread[False]["q95"] == -0.69
