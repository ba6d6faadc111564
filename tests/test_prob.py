import math

import pytest
from pyspark.sql import functions as F

from arbitra.functions import prob as P
from arbitra.operators.decide import Policy


def _one(spark, *cols):
    return spark.range(1).select(*cols).first()


def _arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_energy_of_flat_and_peaked_logits(spark):
    flat, peaked = _one(spark, P.energy(_arr(0, 0, 0, 0)), P.energy(_arr(10, 0, 0, 0)))
    assert math.isclose(flat, -math.log(4), abs_tol=1e-12)
    assert peaked < flat


def test_softmax_is_shift_safe_and_softened_by_temperature(spark):
    a, b, huge = _one(spark, P.softmax(_arr(2, 0), 1.0), P.softmax(_arr(2, 0), 2.0), P.softmax(_arr(1000, 999)))
    assert math.isclose(sum(a), 1.0) and math.isclose(a[0], 1 / (1 + math.exp(-2)))
    assert max(b) < max(a)
    assert math.isclose(huge[0], 1 / (1 + math.exp(-1)))


def test_last_maximum_wins(spark):
    assert tuple(_one(spark, P.argmax_last(_arr(1, 3, 3)), P.argmax_last(_arr(2, 1)), P.argmax_last(_arr(5, 5, 5)))) == (2, 0, 2)


def test_probability_of_a_class(spark):
    names = P.array_literal(["bug", "docs"])
    row = _one(spark, *[P.prob_of(names, _arr(0.7, 0.3), c) for c in ("bug", "docs", "nope")])
    assert tuple(row) == (0.7, 0.3, None)


@pytest.mark.parametrize("confidence,action", [(0.95, "act"), (0.9, "act"), (0.8999, "review"), (0.6, "review"), (0.5999, "escalate"), (0.0, "escalate"), (1.0, "act")])
def test_policy_boundaries(spark, confidence, action):
    assert _one(spark, Policy().action(F.lit(confidence), None))[0] == action


@pytest.mark.parametrize(
    "confidence,energy,limit,action",
    [
        (0.99, -1.2, -1.5, "abstain"), (0.99, -1.8, -1.5, "act"), (0.7, -1.8, -1.5, "review"), (0.3, -1.8, -1.5, "escalate"),
        (0.99, -1.5, -1.5, "act"), (0.99, -1.0, None, "act"), (0.99, None, -1.5, "act"),
    ],
)
def test_energy_gate_comes_first(spark, confidence, energy, limit, action):
    policy = Policy(abstain_energy_above=limit)
    assert _one(spark, policy.action(F.lit(confidence), F.lit(energy).cast("double")))[0] == action


@pytest.mark.parametrize("bad", [(1.5, 0.6, 0.9), (0.9, -0.1, 0.9), (0.9, 0.8, 0.7), (0.8, 0.6, 0.9), (float("nan"), 0.6, 0.9)])
def test_bad_policies_are_refused(bad):
    with pytest.raises(ValueError):
        Policy(*bad)


def test_confidence_outside_the_unit_interval_fails(spark):
    with pytest.raises(Exception, match="must be in"):
        _one(spark, P.checked_probability(F.lit(1.5)))
