"""Shaping and checking inputs before they are featurised."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions import jsontext as J


def with_text(df: DataFrame, json_col: str, out: str = "text") -> DataFrame:
    """Text of a JSON column; rows that are not JSON get an ``error``."""
    v = J.as_variant(json_col)
    return df.withColumn(out, J.extract_text(v)).withColumn(
        "error", F.when(v.isNull(), F.concat(F.lit("invalid JSON in "), F.lit(json_col)))
    )


def with_state(df: DataFrame, json_col: str, out: str = "state_text") -> DataFrame:
    """State object of a JSON column as sorted ``key: value`` lines."""
    return df.withColumn(out, J.render_state(J.as_variant(json_col)))


def compose_input(df: DataFrame, input_col: str, state_col: str, out: str = "composed") -> DataFrame:
    """State lines, a newline, then the text; either part alone if the other is
    empty. A missing or null state leaves the text as it is, and a state that
    is no object puts the row in error."""
    raw = J.as_variant(F.coalesce(F.col(input_col), F.lit("{}")))
    state = J.as_variant(state_col)
    text, lines = J.extract_text(raw), J.render_state(state)
    no_state = F.col(state_col).isNull() | F.coalesce(J.is_null(state), F.lit(False))
    combined = F.concat_ws("\n", F.when(lines != "", lines), F.when(text != "", text))
    bad_state = ~no_state & ~F.coalesce(J.is_object(state), F.lit(False))
    error = F.when(raw.isNull(), F.lit("input is not valid JSON")).when(bad_state, F.lit("state must be an object"))
    return df.withColumn("error", error).withColumn(
        out, F.when(F.col("error").isNull(), F.when(no_state, text).otherwise(combined))
    )


def serialize_fields(df: DataFrame, fields: Sequence[tuple[str, Column | str]], out: str = "text") -> DataFrame:
    """``tag: value`` parts joined by one space; a null value becomes empty."""
    parts = [
        F.concat(F.lit(f"{tag}: "), F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))
        for tag, c in fields
    ]
    return df.withColumn(out, F.concat_ws(" ", *parts))


def field_value(text: Column | str, tag: str, next_tag: str | None, default: Column | str | None) -> Column:
    """Value after the first ``tag: `` up to ``next_tag`` (or the end)."""
    text = F.col(text) if isinstance(text, str) else text
    mark = f"{tag}: "
    rest = F.substring(text, F.locate(mark, text) + F.lit(len(mark)), F.length(text))
    value = F.substring_index(rest, next_tag, 1) if next_tag else rest
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.when(F.contains(text, F.lit(mark)), value).otherwise(fallback)


def parse_fields(
    df: DataFrame, text_col: str, tags: Sequence[str], defaults: Mapping[str, str | None] | None = None
) -> DataFrame:
    """Pull serialised fields back out, one column per tag, in their order.

    A field ends where the next tag of ``tags`` begins.
    """
    defaults = defaults or {}
    following = [f" {t}:" for t in tags[1:]] + [None]
    return df.select(
        "*",
        *[field_value(text_col, t, nxt, defaults.get(t)).alias(t) for t, nxt in zip(tags, following, strict=True)],
    )


def validate_examples(df: DataFrame, input_json: str = "input", label_json: str = "label") -> tuple[DataFrame, DataFrame]:
    """Split examples into (good, bad). ``input`` must be present and ``label``
    a JSON string; both columns hold JSON. Bad rows say why. An empty table is
    an error."""
    if df.limit(1).isEmpty():
        raise ValueError("examples must not be empty")
    raw, lab = J.as_variant(input_json), J.as_variant(label_json)
    checked = df.withColumn(
        "error",
        F.when(raw.isNull(), F.lit('missing field "input"')).when(
            lab.isNull() | ~J.is_string(lab), F.lit('"label" must be a string')
        ),
    )
    good = checked.filter("error is null").select(
        *[c for c in df.columns if c not in (input_json, label_json)],
        J.extract_text(raw).alias("input"),
        lab.cast("string").alias("label"),
    )
    return good, checked.filter("error is not null")


def validate_policies(
    df: DataFrame,
    act: str = "act_above",
    low: str = "review_low",
    high: str = "review_high",
    energy: str = "abstain_energy_above",
) -> DataFrame:
    """Add ``error``: thresholds within [0, 1], low <= high <= act, and an
    energy threshold that is absent or finite."""

    def outside(c: str) -> Column:
        x = F.col(c)
        return x.isNull() | F.isnan(x) | (x < 0) | (x > 1)

    e = F.col(energy)
    cases = F.lit(None).cast("string")
    infinite = e.isNotNull() & (F.isnan(e) | (F.abs(e) == float("inf")))
    checks = [(outside(c), f"{c} must be in [0,1]") for c in (act, low, high)] + [
        (F.col(low) > F.col(high), f"{low} must be <= {high}"),
        (F.col(high) > F.col(act), f"{high} must be <= {act}"),
        (infinite, f"{energy} must be finite"),
    ]
    for cond, message in reversed(checks):
        cases = F.when(cond, F.lit(message)).otherwise(cases)
    return df.withColumn("error", cases)


def signed_token(c: Column) -> Column:
    """``n3`` for -3, ``p3`` for 3, ``zero`` for 0."""
    n = F.abs(c).cast("bigint").cast("string")
    return F.when(c < 0, F.concat(F.lit("n"), n)).when(c > 0, F.concat(F.lit("p"), n)).otherwise(F.lit("zero"))


def bucket_token(c: Column, bounds: Sequence[tuple[float, str]], above: str) -> Column:
    """First name whose bound is not exceeded, else ``above``."""
    out = F.lit(above)
    for bound, name in reversed(list(bounds)):
        out = F.when(c <= bound, F.lit(name)).otherwise(out)
    return out


# The two bucketings of numeric facts.
DISTANCE_BUCKETS = ((2, "C"), (6, "M")), "F"
SPACE_BUCKETS = ((15, "T"), (50, "R")), "O"


def tokenize_facts(df: DataFrame, specs: Sequence[tuple[str, Column | str, str]], out: str = "facts") -> DataFrame:
    """Encode numeric facts as words bound to their owner.

    ``specs`` holds (owner, column, kind) with kind ``signed``, ``distance``,
    ``space`` or ``plain``; owner and token are joined by ``_``, which both the
    word tokenizer and a reader see as one word.
    """
    kinds = {
        "signed": signed_token,
        "distance": lambda c: bucket_token(c, *DISTANCE_BUCKETS),
        "space": lambda c: bucket_token(c, *SPACE_BUCKETS),
        "plain": lambda c: c.cast("string"),
    }
    words = []
    for owner, c, kind in specs:
        if not re.fullmatch(r"\w+", owner):
            raise ValueError(f"owner {owner!r} must be one word")
        words.append(F.concat_ws("_", F.lit(owner), kinds[kind](F.col(c) if isinstance(c, str) else c)))
    return df.withColumn(out, F.concat_ws(" ", *words))
