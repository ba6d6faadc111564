"""Distributions over classes, confidence, energy and the action policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbitra.functions.arrays import array_sum, let

# The default policy.
ACT_ABOVE, REVIEW_LOW, REVIEW_HIGH = 0.9, 0.6, 0.9
ACTIONS = ("act", "review", "escalate", "abstain")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Softmax of ``logits / temperature``, shifted by the maximum."""
    t = _col(temperature).cast("double")

    def normalised(e: Column) -> Column:
        return let(array_sum(e), lambda total: F.transform(e, lambda x: x / total))

    return let(
        F.transform(logits, lambda z: z / t),
        lambda s: let(F.array_max(s), lambda top: let(F.transform(s, lambda z: F.exp(z - top)), normalised)),
    )


def energy(logits: Column) -> Column:
    """``-logsumexp`` of the raw logits: higher means less like the task."""
    return let(
        F.array_max(logits), lambda top: -(top + F.log(array_sum(F.transform(logits, lambda z: F.exp(z - top)))))
    )


def argmax_last(p: Column) -> Column:
    """0-based position of the maximum; the last one wins a tie."""
    return let(p, lambda a: (F.size(a) - F.array_position(F.reverse(a), F.array_max(a))).cast("int"))


def prob_of(classes: Column, p: Column, name: Column | str) -> Column:
    """Probability of a named class, null when the model has no such class."""
    at = F.array_position(classes, _col(name))
    return F.when(at > 0, F.get(p, (at - 1).cast("int")))


def policy_action(
    confidence: Column,
    energy_score: Column | None,
    act_above: Column | float = ACT_ABOVE,
    review_low: Column | float = REVIEW_LOW,
    abstain_above: Column | float | None = None,
) -> Column:
    """Abstain on a strictly higher energy first; then act, review, escalate.

    The upper review bound is validated with the policy but plays no part here.
    """
    e = _col(energy_score).cast("double")
    limit = _col(abstain_above).cast("double")
    return (
        F.when(e > limit, F.lit("abstain"))
        .when(confidence >= _col(act_above), F.lit("act"))
        .when(confidence >= _col(review_low), F.lit("review"))
        .otherwise(F.lit("escalate"))
    )


def checked_probability(p: Column, what: str = "confidence") -> Column:
    """``p``, failing the job when it lies outside [0, 1]."""
    return F.when((p >= 0.0) & (p <= 1.0), p).otherwise(
        F.raise_error(F.concat(F.lit(f"{what} must be in [0,1], got "), F.coalesce(p.cast("string"), F.lit("null")))).cast(
            "double"
        )
    )


def neg_log_likelihood(logits: Column, target: Column, temperature: Column) -> Column:
    """``-ln p[target]`` at a temperature, the probability floored at 1e-15."""
    p = F.get(softmax(logits, temperature), target)
    return -F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-15)))


def array_literal(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])
