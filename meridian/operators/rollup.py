"""Per-cycle and all-cycle totals, pivots, breakdowns and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.cycles import ALL_CYCLES


def with_all_cycles(df: DataFrame, keys: list[str], measures: dict[str, Column], cycle: str = "cycle") -> DataFrame:
    """Totals by keys and cycle, and over all cycles as cycle -1, from one pass.

    Measures may be anything that can be computed over either grouping (sums, counts, minima, distinct counts).
    """
    sets = df.groupingSets([[*keys, cycle], list(keys)], *keys, cycle).agg(F.grouping(cycle).alias("_all"), *[m.alias(n) for n, m in measures.items()])
    return sets.select(*keys, F.when(F.col("_all") == 1, ALL_CYCLES).otherwise(F.col(cycle)).cast("int").alias(cycle), *measures)


def repeat_for_all_cycles(df: DataFrame, cycle: str = "cycle") -> DataFrame:
    """Every row twice, for its cycle and for -1: for ranks over rows that are not aggregated."""
    return df.withColumn(cycle, F.explode(F.array(F.col(cycle).cast("int"), F.lit(ALL_CYCLES))))


def full_join(parts: list[DataFrame], keys: list[str], zero: list[str]) -> DataFrame:
    """Full outer join of several branches on keys; missing figures are 0. Null keys match nothing, as in SQL."""
    joined = reduce(lambda a, b: a.join(b, keys, "full"), parts)
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def pivot_sum(df: DataFrame, keys: list[str], by: str, values: dict, amount: str) -> DataFrame:
    """Count and amount of each of the values of a column, side by side; one pass where a full join of branches would take several."""
    out = []
    for value, name in values.items():
        hit = F.col(by) == F.lit(value)
        out += [F.count_if(hit).alias(f"{name}_count"), F.coalesce(F.sum(F.when(hit, F.col(amount))), F.lit(0)).alias(f"{name}_amount")]
    return df.groupBy(*keys).agg(*out)


def unpivot(df: DataFrame, ids: list[str], values: dict[str, str], kind: str, amount: str) -> DataFrame:
    """A row for each named column of each row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(label).alias(kind), F.col(c).alias(amount)) for c, label in values.items()]))
    return df.select(*ids, pairs.alias("_x")).select(*ids, f"_x.{kind}", f"_x.{amount}")


def pie(df: DataFrame, keys: list[str], category: str, labels: dict[str, str], amount: str, default: str | None = None) -> DataFrame:
    """Count and amount by labelled category; with a default all unknown categories are one, without it they keep their names."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col(category)]
    label = F.coalesce(known, F.lit(default) if default is not None else F.col(category))
    return df.groupBy(*keys, label.alias("category")).agg(F.count("*").alias("count"), F.sum(amount).alias("amount"))


def summary(rollup: DataFrame, breakout: DataFrame, key: str, child: list[str], amount: str = "amount", most: int = 10) -> DataFrame:
    """rollup with its largest breakout rows as an array, largest first; of children of one group at most `most` are kept in any partition."""
    from meridian.operators.ranking import top_n

    best = top_n(breakout, [key], [F.desc(amount), *[F.col(c).asc_nulls_first() for c in child]], most)
    children = best.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", *child, F.col(amount)))).alias("children"))
    return rollup.join(children, key, "left")


def concentration(df: DataFrame, keys: list[str], by: str, amount: str) -> DataFrame:
    """Sum of squared shares of a group's amount: 1 if one member has all."""
    each = df.groupBy(*keys, by).agg(F.sum(amount).cast("double").alias("_x"))
    return each.groupBy(*keys).agg((F.sum(F.col("_x") * F.col("_x")) / (F.sum("_x") * F.sum("_x"))).alias("concentration"), F.count("*").alias("members"))


def histogram(df: DataFrame, value: Column, width: float) -> DataFrame:
    return df.groupBy((F.floor(value / width) * width).cast("long").alias("bucket")).agg(F.count("*").alias("count"))


def cumulative(df: DataFrame, part: list[str], order: str, amount: str, name: str = "cumulative") -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn(name, F.sum(amount).over(Window.partitionBy(*part).orderBy(order)))


def gap_filled(df: DataFrame, part: list[str], step: str, value: str) -> DataFrame:
    """A row for every whole step from a part's first to its last; missing values are the largest so far."""
    from pyspark.sql import Window

    spine = df.groupBy(*part).agg(F.explode(F.sequence(F.min(step), F.max(step))).alias(step))
    return spine.join(df, [*part, step], "left").withColumn(value, F.max(value).over(Window.partitionBy(*part).orderBy(step)))
