"""Entities, their aliases and attributes, and their links to records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.operators.ranking import checkpointed


def associate(facts: DataFrame, record: str, rules: list[tuple[Column, DataFrame, str]]) -> DataFrame:
    """Distinct (entity_id, record) links by any of several rules; a rule: key of the fact, table of (key, entity_id), name of its key.

    Each rule is an equality join over two columns of the facts, so only keys and ids are shuffled.
    """
    found = []
    for key, table, column in rules:
        f = facts.select(F.col(record), key.alias("_key")).filter("_key is not null and _key <> ''")
        t = table.select(F.col(column).alias("_key"), "entity_id")
        found.append(f.join(t, "_key").select("entity_id", record))
    return reduce(DataFrame.unionByName, found).distinct()


def by_alias(facts: DataFrame, record: str, name: str, aliases: DataFrame) -> DataFrame:
    """Links by name, whatever its case."""
    return associate(facts, record, [(F.lower(name), aliases.withColumn("_alias", F.lower("alias")), "_alias")])


def discover(facts: DataFrame, name: str, aliases: DataFrame, blacklist: list[str], least: int = 1) -> DataFrame:
    """Names that no alias has and no list forbids, with how often they occur."""
    fresh = facts.select(F.trim(name).alias("name"), F.lower(F.trim(name)).alias("_key")).filter("name is not null and name <> ''")
    known = aliases.select(F.lower("alias").alias("_key")).distinct()
    return fresh.filter(~F.col("_key").isin(*blacklist)).join(known, "_key", "left_anti").groupBy("_key").agg(F.min("name").alias("name"), F.count("*").alias("n")).filter(F.col("n") >= least).select("name", "n")


def stale(entities: DataFrame, *links: DataFrame) -> DataFrame:
    """Entities that no link names."""
    used = reduce(DataFrame.unionByName, [x.select("entity_id") for x in links]).distinct()
    return entities.join(used, entities["id"] == used["entity_id"], "left_anti")


def merge(entities: DataFrame, aliases: DataFrame, attributes: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """merges: columns old, target. Aliases and attributes of old ones go to their target, once each; the old id becomes an attribute of the target.

    Merges of entities of different types are left out. Where a target is merged itself, all go to the last of the chain; merges in a circle are an error.
    """
    kinds = entities.select("id", "type")
    ok = (
        merges.filter("old <> target").join(kinds.select(F.col("id").alias("old"), F.col("type").alias("_a")), "old")
        .join(kinds.select(F.col("id").alias("target"), F.col("type").alias("_b")), "target").filter("_a = _b").select("old", "target")
    )
    kept = ok.select(F.col("target").alias("entity_id"), F.lit("urn:merged").alias("namespace"), F.col("old").cast("string").alias("value"))
    for _ in range(20):  # each doubles the length of the chains that are resolved
        further = ok.select(F.col("old").alias("target"), F.col("target").alias("_next"))
        if ok.join(further, "target", "left_semi").isEmpty():
            break
        ok = checkpointed(ok.join(further, "target", "left").select("old", F.coalesce("_next", "target").alias("target")))
    else:
        raise ValueError("merges in a circle")
    moved = lambda t: t.join(ok, t["entity_id"] == ok["old"], "left").withColumn("entity_id", F.coalesce("target", "entity_id")).drop("old", "target").distinct()
    return entities.join(ok, entities["id"] == ok["old"], "left_anti"), moved(aliases), moved(attributes.unionByName(kept))


def build_entities(rows: DataFrame, id_: str, name: str, type_: str, attributes: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, an alias for each (its name) and its attributes that are not empty."""
    entities = rows.select(F.col(id_).alias("id"), F.col(name).alias("name"), F.lit(type_).alias("type"))
    aliases = rows.select(F.col(id_).alias("entity_id"), F.col(name).alias("alias"))
    pairs = F.array(*[F.struct(F.lit(ns).alias("namespace"), F.col(c).cast("string").alias("value")) for c, ns in attributes.items()])
    attrs = rows.select(F.col(id_).alias("entity_id"), F.explode(pairs).alias("_a")).select("entity_id", "_a.namespace", "_a.value").filter("value is not null and value <> ''")
    return entities, aliases, attrs


def fill_from(df: DataFrame, key: str, source: DataFrame, columns: list[str], only_null: bool = True) -> DataFrame:
    """UPDATE … FROM: columns from the row of source with the same key; source has one row for each key."""
    s = source.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    pick = (lambda c: F.coalesce(c, f"_{c}")) if only_null else (lambda c: F.coalesce(f"_{c}", c))
    return df.join(s, key, "left").withColumns({c: pick(c) for c in columns}).drop(*[f"_{c}" for c in columns])
