"""People by fuzzily equal names: pairs by keys that any two equal names share, and the only politician of a name.

A frequent last name is split by what first names may agree in: the name itself, its nickname family, its initial where one side has no more. So bearers of one last name don't
meet in one task, and pairs that cannot be equal are not made; only a name without any first name meets all bearers of its last name, as it equals them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.persons import Switches, alias_parts, person_parts, same_person
from meridian.operators.ranking import checkpointed

#: Text between the parts of a key.
_SEP = "|"


def parsed(people: DataFrame, nicknames: DataFrame | None = None, alias: bool = False) -> DataFrame:
    """people (id, name and others) with p: the parts of the name and the nickname families of first and middle name. nicknames: name (upper case), family."""
    d = people.withColumn("_p", (alias_parts if alias else person_parts)(F.col("name")))
    of = F.lit(None).cast("array<string>")
    found = {"first": of, "middle": of}
    if nicknames is not None:
        family = nicknames.groupBy(F.col("name").alias("_name")).agg(F.collect_set(F.col("family").cast("string")).alias("_f"))
        for part in found:
            d = d.join(family.select(F.col("_name").alias(f"_n_{part}"), F.col("_f").alias(f"_f_{part}")), F.col(f"_p.{part}") == F.col(f"_n_{part}"), "left")
            found[part] = F.col(f"_f_{part}")
    families = F.struct(*[c.alias(k) for k, c in found.items()]).alias("families")
    return d.select(*people.columns, F.struct("_p.*", families).alias("p"))


def _keys(d: DataFrame, side: int) -> DataFrame:
    """Keys of a side: equal names of the two sides have one in common, whatever the switches."""
    p = F.col("p")
    values = F.filter(F.concat(F.array(p["first"], p["middle"]), F.coalesce(p["nicks"], F.array().cast("array<string>"))), lambda x: x.isNotNull())
    families = F.concat(*[F.coalesce(p["families"][f], F.array().cast("array<string>")) for f in ("first", "middle")])
    # a single letter meets names that begin with it, on the other side; names in full don't meet by their initials
    letter = lambda x: F.when(F.length(x) == 1, F.lit(str(side))).otherwise(F.lit(str(1 - side)))
    named = F.concat(F.transform(values, lambda x: F.concat(F.lit("n"), x)), F.transform(families, lambda x: F.concat(F.lit("f"), x)), F.transform(values, lambda x: F.concat(F.lit("i"), letter(x), F.left(x, F.lit(1)))))
    bare = p["first"].isNull() & p["middle"].isNull()
    last = F.transform(F.concat(named, F.array(F.lit(f"l{side}")), F.when(bare, F.array(F.lit(f"l{1 - side}"))).otherwise(F.array().cast("array<string>"))), lambda x: F.concat(p["last"], F.lit(_SEP), x))
    every = F.concat(F.array(F.concat(F.lit("w" + _SEP), p["whole"])), F.coalesce(last, F.array().cast("array<string>")))
    # who has no first name offers the other side's `all of this last name`; who has one only offers to be found by it
    return d.withColumn("_key", F.explode(F.array_distinct(F.filter(every, lambda x: x.isNotNull()))))


def equal_people(left: DataFrame, right: DataFrame, switches: Switches = Switches()) -> DataFrame:
    """Columns left_id, right_id of people (from parsed(), ids distinct on each side) whose names may be one person's, each pair once. People without a name equal nobody."""
    l = _keys(left, 0).select("_key", F.col("id").alias("left_id"), F.col("p").alias("_a"))  # noqa: E741
    r = _keys(right, 1).select("_key", F.col("id").alias("right_id"), F.col("p").alias("_b"))
    pairs = l.join(r, "_key").filter(same_person(F.col("_a"), F.col("_b"), switches))
    return pairs.select("left_id", "right_id").distinct()


def only_politician(names: DataFrame, aliases: DataFrame, nicknames: DataFrame | None = None) -> DataFrame:
    """Columns id, entity_id, alias: for each name (id, name) the politician whom it means, if all politicians of that name may be one.

    aliases: entity_id, entity_name, alias. A politician's alias that equals the name is taken, the least of several; of several politicians the first by name, then id,
    stands, if each of the others has an alias that equals one of the first one's. Otherwise the name is not unique and gives no row.
    """
    a = checkpointed(parsed(aliases.filter("alias is not null").dropDuplicates(["entity_id", "alias"]).select(F.struct("entity_id", "alias").alias("id"), F.col("alias").alias("name"), "entity_name"), nicknames, alias=True))
    hits = equal_people(a, parsed(names, nicknames)).select(F.col("right_id").alias("id"), "left_id.entity_id", "left_id.alias")
    hits = hits.groupBy("id", "entity_id").agg(F.min("alias").alias("alias"))
    called = aliases.groupBy("entity_id").agg(F.min("entity_name").alias("entity_name"))
    order = F.struct("entity_name", "entity_id")
    hits = checkpointed(hits.join(called, "entity_id").withColumn("_first", F.min(order).over(Window.partitionBy("id"))["entity_id"]))
    others = hits.filter("entity_id <> _first").select("_first", "entity_id").distinct()
    names_of = lambda e, p: a.select(F.col("id.entity_id").alias(e), F.col("p").alias(p))
    agree = others.join(names_of("_first", "_a"), "_first").join(names_of("entity_id", "_b"), "entity_id").filter(same_person(F.col("_a"), F.col("_b"))).select("_first", "entity_id").distinct()
    apart = hits.filter("entity_id <> _first").join(agree, ["_first", "entity_id"], "left_anti").select("id").distinct()
    return hits.filter("entity_id = _first").join(apart, "id", "left_anti").select("id", "entity_id", "alias")
