"""Set operations and differences of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_then_all(first: list[DataFrame], then: list[DataFrame]) -> DataFrame:
    """`a union b union all c`, read from the left: only what comes before `all` is made distinct."""
    return reduce(DataFrame.unionByName, then, reduce(DataFrame.unionByName, first).distinct())


def except_chain(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(DataFrame.subtract, others, first)


def table_diff(old: DataFrame, new: DataFrame, key: str, compare_nulls: bool = False) -> DataFrame:
    """Columns key, change: insert, delete or update. Without compare_nulls a change from or to null is none, as `!=` has it."""
    values = [c for c in old.columns if c != key]
    o = old.select(F.col(key).alias("_old"), *[F.col(c).alias(f"o_{c}") for c in values])
    n = new.select(F.col(key).alias("_new"), *[F.col(c).alias(f"n_{c}") for c in values])
    differ = [~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")) if compare_nulls else F.coalesce(F.col(f"o_{c}") != F.col(f"n_{c}"), F.lit(False)) for c in values]
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(reduce(lambda a, b: a | b, differ, F.lit(False)), "update")
    return o.join(n, F.col("_old") == F.col("_new"), "full").select(F.coalesce("_old", "_new").alias(key), change.alias("change")).filter("change is not null")


def apply_diff(old: DataFrame, new: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """old with the changes made: deleted and updated rows out, inserted and updated ones in from new."""
    gone = changes.filter(F.col("change").isin("delete", "update")).select(key)
    come = changes.filter(F.col("change").isin("insert", "update")).select(key)
    return old.join(gone, key, "left_anti").unionByName(new.join(come, key, "left_semi"))


def refresh_cycles(old: DataFrame, new: DataFrame, dirty: DataFrame, cycle: str = "cycle") -> DataFrame:
    """Rows of dirty cycles from new, all others from old."""
    return old.join(dirty.select(cycle).distinct(), cycle, "left_anti").unionByName(new.join(dirty.select(cycle).distinct(), cycle, "left_semi"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a unique constraint would reject."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows that a foreign key would reject; null keys pass."""
    return df.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
