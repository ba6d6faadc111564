"""Small building blocks over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use inside ``body``.

    Without the binding the optimizer may inline a costly expression into a
    lambda and evaluate it per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def run_lengths(arr: Column) -> Column:
    """array<T> -> array<struct<key T, n int>>: each distinct element with its count.

    Sort, keep the last position of every run, subtract neighbouring positions:
    O(n log n) inside the row, so counting terms of a text needs no shuffle.
    """

    def count_runs(s: Column) -> Column:
        # A run ends where the next element differs; past the end it is null.
        ends = F.transform(s, lambda x, i: F.when(x == F.get(s, i + 1), F.lit(None)).otherwise(i + 1))
        return let(
            F.array_compact(ends),
            lambda e: F.transform(
                e,
                lambda end, i: F.struct(
                    F.get(s, end - 1).alias("key"), (end - F.coalesce(F.get(e, i - 1), F.lit(0))).alias("n")
                ),
            ),
        )

    return let(F.sort_array(arr), count_runs)
