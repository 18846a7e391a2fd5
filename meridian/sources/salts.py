"""Salts of records: made-up second records, one for each, that stay the same from run to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.operators.ranking import equal_join
from meridian.sources import versions

#: The least and the largest part of an amount that a salt takes, and how many days before its record it lies.
LEAST, MOST, FIRST_DAY, DAYS = 10, 500, 15, 31
BUCKETS = 4096


def numbered(df: DataFrame, part: str, key: str, name: str) -> DataFrame:
    """Rows of each part numbered from 1 in an order that a hash of the key gives; rows of a part come together in buckets, never all of them."""
    b = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    sizes = b.groupBy(part, "_b").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(part, "_b").orderBy(F.xxhash64(key), key))
    both = equal_join(b.withColumn("_own", own), sizes.select(part, "_b", before.alias("_before")), [part, "_b"])
    return both.withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_b")


def salted(records: DataFrame, pool: DataFrame, store: str, key: str = "contributionid") -> DataFrame:
    """records and their salts. store: a versioned table of the salts that were given, which gets the new ones before this returns.

    records: key, contributor_name, contributor_city, contributor_state, contributor_zipcode, amount (a decimal), date and others. pool: id, contributor_name, contributor_city,
    contributor_state, contributor_zipcode: names to give, each once, to records of its state. A record that has a salt keeps it, whatever the order of runs and rows; a new
    one takes the next name of its state that is free, if there is one. A salt has the negative key, a hundredth of the amount (LEAST to MOST) and a date up to FIRST_DAY + DAYS - 1 days before;
    its record's amount is less by as much. A record that comes twice is one: the least row of a key stands.
    """
    spark = records.sparkSession
    fields = ["contributor_name", "contributor_city", "contributor_state", "contributor_zipcode"]
    rest = [c for c in records.columns if c != key]
    once = records.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])
    known = versions.current(spark, store) if versions.pointer(spark, store) else None
    waiting, free = once, pool
    if known is not None:
        waiting = once.join(known.select(F.col("record").alias(key)), key, "left_anti")
        free = pool.join(known.select("id"), "id", "left_anti")
    portion = lambda amount: F.greatest(F.least(F.round(amount / 100, 0), F.lit(MOST)), F.lit(LEAST)).cast(records.schema["amount"].dataType)
    asked = numbered(waiting.select(F.col(key).alias("record"), F.coalesce("contributor_state", F.lit("")).alias("_s"), portion(F.col("amount")).alias("amount"), "date"), "_s", "record", "_n")
    given = numbered(free.select("id", *fields, F.coalesce("contributor_state", F.lit("")).alias("_s")), "_s", "id", "_n")
    back = FIRST_DAY + F.pmod(F.xxhash64("record"), F.lit(DAYS)).cast("int")
    new = asked.join(given, ["_s", "_n"]).select("record", "id", *fields, "amount", F.date_sub("date", back).alias("date"))
    versions.publish(new if known is None else known.unionByName(new), store)
    salts = versions.current(spark, store)
    mine = once.join(salts.select(F.col("record").alias(key), F.struct(*fields, "amount", "date").alias("_salt")), key, "left")
    own = mine.withColumn("amount", F.col("amount") - F.coalesce(F.col("_salt.amount"), F.lit(0).cast(records.schema["amount"].dataType))).drop("_salt")
    other = mine.filter("_salt is not null").select(*[_field(c, key, fields) for c in records.columns])
    return own.select(*records.columns).unionByName(other.select(*records.columns))


def _field(name: str, key: str, fields: list[str]) -> Column:
    if name == key:
        return (-F.col(key)).alias(key)
    return F.col(f"_salt.{name}").alias(name) if name in (*fields, "amount", "date") else F.col(name)
