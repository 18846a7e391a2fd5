"""Top rows of groups, ranks, latest and most frequent rows."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, part: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """rank() over each part; equal rows share a rank."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*part).orderBy(*order)))


def top_n(df: DataFrame, part: list[str], order: list[Column], n: int = 10, name: str = "rank") -> DataFrame:
    """Rows of rank n at most; ties at the end are kept. The filter on the rank lets Spark drop rows before they are shuffled."""
    return ranked(df, part, order, name).filter(F.col(name) <= n)


def dual_ranked(df: DataFrame, part: list[str], by_count: Column, by_amount: Column) -> DataFrame:
    return ranked(ranked(df, part, [by_count], "rank_by_count"), part, [by_amount], "rank_by_amount")


def rank_within(df: DataFrame, part: list[str], value: str, name: str = "rank") -> DataFrame:
    """rank() within each part by a number, greatest first and null last, without bringing a part together.

    Equal numbers of a part are counted first, so ties make no large group. A number's rank is the rows in greater buckets plus the rows with greater numbers in its own one; a
    bucket is a monotone step of the number's logarithm (some tens of thousands for all numbers), so a part with any number of rows makes groups of few.
    """
    keys = [*part, value]
    bucket = F.coalesce(F.signum(value) * F.floor(F.log1p(F.abs(F.col(value).cast("double"))) * 512), F.lit(-1e9)).cast("int")
    distinct = df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_bucket", bucket)
    above = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = distinct.groupBy(*part, "_bucket").agg(F.sum("_n").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(above(*part).orderBy(F.desc("_bucket"))), F.lit(0))).drop("_m")
    own = F.coalesce(F.sum("_n").over(above(*part, "_bucket").orderBy(F.desc_nulls_last(value))), F.lit(0))
    placed = equal_join(distinct.withColumn("_own", own), sums, [*part, "_bucket"])
    return equal_join(df, placed.select(*keys, (F.col("_own") + F.col("_before") + 1).cast("int").alias(name)), keys)


def equal_join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """a joined with b where all of on are equal, null with null; columns of a, then the others of b."""
    other = b.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in b.columns if c not in on])
    return a.join(other, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]), how).drop(*[f"_on_{c}" for c in on])


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in a total order: an aggregate of one row for each key and partition, not a sort of groups.

    order: columns whose greatest value is wanted, most important first; nulls come last.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def most_frequent(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The most frequent combination of values for each key; of equally frequent ones the least."""
    counted = df.groupBy(*keys, *values).agg(F.count("*").alias("_n"))
    best = F.min_by(F.struct(*values, "_n"), F.struct((-F.col("_n")).alias("n"), F.struct(*values)))
    return counted.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col(f"_row.`{v}`").alias(v) for v in values], F.col("_row._n").alias("n"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed and kept in the shared folder that the session names; a local folder only where none is set and all runs in this process, as in tests."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="meridian-"))
    return df.checkpoint()


#: Rows that a page by number may skip on the driver; pages further on are cut by numbers of sorted ranges.
NEAR = 100_000


def page(df: DataFrame, order: list[Column], skip: int, size: int) -> DataFrame:
    """Rows skip + 1 to skip + size in an order. At most NEAR + size rows come together on the driver, however far the page is."""
    if skip <= NEAR:
        return df.orderBy(*order).offset(skip).limit(size)
    return global_rank(df, order, "_at", ties=False).filter(F.col("_at").between(skip + 1, skip + size)).orderBy("_at").drop("_at")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", ties: bool = True) -> DataFrame:
    """rank() over all rows, or without ties row_number(), without a single-partition window: ranges are sorted apart, and each range starts from the rows before it.

    The rows of each range are counted first; only these few counts come together. Ranges are cut by a sample, so the dealt rows are checkpointed:
    counts and ranks must see the same ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))  # equal order keys lie in one range
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    own = (F.rank() if ties else F.row_number()).over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).drop("_part", "_own", "_before")
