"""Operations on ordered rows: sort, merge, shuffle, remove, reverse, rotate; and running steps by what they need."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_rows(df: DataFrame, *order: str) -> DataFrame:
    """In total order, by range partitions."""
    return df.orderBy(*order)


def merged(a: DataFrame, b: DataFrame, *order: str) -> DataFrame:
    return a.unionByName(b).orderBy(*order)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """In an order that depends on key and seed alone, so a lost task gives the same rows again."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def without(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def reversed_rows(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*(F.desc(c) for c in order))


def rotated(df: DataFrame, position: str, by: int, n: int) -> DataFrame:
    """Positions 0 to n - 1 moved so that row `by` becomes the first."""
    return df.withColumn(position, F.pmod(F.col(position) - by, F.lit(n)))


def run_steps(steps: Mapping[str, tuple[Sequence[str], Callable[..., DataFrame]]]) -> dict[str, DataFrame]:
    """Results of named steps (needs, function of their results), each after what it needs; a cycle raises."""
    out: dict[str, DataFrame] = {}
    for name in TopologicalSorter({k: needs for k, (needs, _) in steps.items()}).static_order():
        needs, f = steps[name]
        out[name] = f(*(out[n] for n in needs))
    return out
