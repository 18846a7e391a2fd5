"""Joins that plain equality does not express, as equality joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def or_join(left: DataFrame, right: DataFrame, on: list[tuple[Column, Column]]) -> DataFrame:
    """Rows where any of the pairs of keys is equal, each pair of rows once, as `a = b OR c = d` gives them: one equality join for each pair of keys,
    which leaves out what an earlier one has found.
    """
    found = []
    for i, (a, b) in enumerate(on):
        earlier = [F.coalesce(x == y, F.lit(False)) for x, y in on[:i]]
        found.append(left.join(right, reduce(lambda p, q: p & ~q, earlier, a == b)))
    return reduce(DataFrame.unionByName, found)


def prefix_join(left: DataFrame, right: DataFrame, a: Column, b: Column, n: int, how: str = "inner") -> DataFrame:
    """Keys that agree in their first n characters."""
    return left.join(right, F.left(a, F.lit(n)) == F.left(b, F.lit(n)), how)


def prefer_exact(df: DataFrame, keys: list[str], exact: Column, value: str) -> DataFrame:
    """One value for each key: the greatest of the exact matches, else the greatest of all."""
    return df.groupBy(*keys).agg(F.coalesce(F.max(F.when(exact, F.col(value))), F.max(value)).alias(value))


def valid_at(facts: DataFrame, ranges: DataFrame, key: str, date: Column, start: Column, end: Column) -> DataFrame:
    """Left join to the ranges of the fact's key that hold its date; an open end (null) holds all later dates."""
    other = ranges.withColumnRenamed(key, "_key")
    return facts.join(other, (facts[key] == F.col("_key")) & (date >= start) & (date <= F.coalesce(end, F.to_date(F.lit("9999-12-31")))), "left").drop("_key")


def cycles_between(df: DataFrame, first: Column, last: Column, cycles: list[int], all_cycles: int = -1) -> DataFrame:
    """A row for each listed cycle from first to last year, and one for all of them; by an exploded array, not a range join."""
    hit = F.filter(F.array(*[F.lit(c) for c in cycles]), lambda c: (c >= first) & (c <= last))
    return df.withColumn("cycle", F.explode(F.concat(hit, F.array(F.lit(all_cycles)))))


def nearest(df: DataFrame, distance: Column, n: int, tie: list[str]) -> DataFrame:
    """The n rows of least distance; ties by the named columns."""
    return df.withColumn("distance", distance).filter("distance is not null").orderBy("distance", *tie).limit(n)
