"""Links of records to entities: arrays of entity ids beside each record, one for each role that the record names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.operators.ranking import checkpointed

#: Parts that records without a key are dealt to.
SPREAD = 64
#: Keys and ids that a kept look-up may have together to be broadcast, whatever Spark's limit: under a megabyte.
FEW = 10_000


def typed(t: dict[str, DataFrame], *kinds: str) -> DataFrame:
    """Ids of the entities of some types."""
    return t["entity"].filter(F.col("type").isin(*kinds)).select(F.col("id").alias("entity_id"))


def lookup(rows: DataFrame, key: Column, distinct: bool = False) -> DataFrame:
    """_key and _ids: the entities of each key; distinct: each once."""
    collect = F.collect_set if distinct else F.collect_list
    return rows.select(key.alias("_key"), "entity_id").filter("_key is not null").groupBy("_key").agg(collect("entity_id").alias("_ids"))


def aliases(t: dict[str, DataFrame], key=F.lower, kinds: tuple[str, ...] = ("organization",), distinct: bool = False) -> DataFrame:
    """Entities by their aliases. An entity that has an alias twice is there twice, unless distinct."""
    return lookup(t["alias"].join(typed(t, *kinds), "entity_id"), key(F.col("alias")), distinct)


def attributes(t: dict[str, DataFrame], *namespaces: str, key: Column | None = None, distinct: bool = False) -> DataFrame:
    """Entities by the values of their attributes in some namespaces."""
    return lookup(t["attribute"].filter(F.col("namespace").isin(*namespaces)), F.col("value") if key is None else key, distinct)


def kept(found: DataFrame, kind: str) -> dict[str, DataFrame]:
    """Look-ups of several kinds (columns kind, _key, _ids) that are computed and kept together, so that their sizes are known: those with few keys and ids are broadcast, and large records
    needn't be dealt by a handful of keys."""
    rows = checkpointed(found)
    weight = {r[0]: r[1] for r in rows.groupBy(kind).agg(F.sum(F.size("_ids") + 1)).collect()}  # a row for each kind

    class Kept(dict):
        def __missing__(self, k):
            own = rows.filter(F.col(kind) == k)
            return F.broadcast(own) if weight.get(k, 0) <= FEW else own

    return Kept()


def with_ids(records: DataFrame, found: DataFrame, key: Column, into: str, spread: str) -> DataFrame:
    """records with the entities of a key in the array `into`, empty where there is none.

    A record without a key matches nothing; it is dealt by the column `spread`, so such records don't meet in one task.
    """
    none = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(spread), F.lit(SPREAD)).cast("string"))
    columns = records.columns
    keyed = records.withColumn("_key", F.coalesce(key.cast("string"), none))
    other = found.withColumn("_key", F.col("_key").cast("string"))
    empty = F.expr("array()").cast(found.schema["_ids"].dataType)
    return keyed.join(other, "_key", "left").select(*columns, F.coalesce("_ids", empty).alias(into))


def exploded(linked: DataFrame, ids: str | Column, *keep: str, outer: bool = False, name: str = "entity_id") -> DataFrame:
    """A row for each entity of an array, with the kept columns; outer: one with null where there is none."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return linked.select(*keep, (F.explode_outer if outer else F.explode)(ids).alias(name))
