"""Seeded order: the same choice on every run and every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded(seed: int | str, *keys: Column | str) -> Column:
    """Hex digest that orders rows at random, fixed by ``seed``."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary"))


def seeded_int(seed: int | str, *keys: Column | str) -> Column:
    """Non-negative integer below 2^28 from the same digest."""
    return F.conv(F.substring(seeded(seed, *keys), 1, 7), 16, 10).cast("bigint")


def seeded_unit(seed: int | str, *keys: Column | str) -> Column:
    """Number in [0, 1) from the same digest."""
    return seeded_int(seed, *keys) / F.lit(float(1 << 28))
