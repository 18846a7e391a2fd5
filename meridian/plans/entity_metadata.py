"""Metadata of entities: what the records say of organizations, politicians and people, by cycle.

What was once a chain of updates over one table is one aggregate here: each source gives rows (entity, cycle, fields) with a rank, and of each field the value of the best
source stands. Tables as in contributions and lobbying, and committee_profile (committee_id, cycle, committee_type, interest_group), navigation_bin (entity_id, navigation_bin).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.cycles import even_year
from meridian.operators.ranking import checkpointed, first_row
from meridian.plans import contributions as ct
from meridian.plans import lobbying as lb

Tables = dict[str, DataFrame]
#: Interest groups of committees.
INTERESTS = {"is_corporation": "C", "is_labor_org": "L", "is_membership_org": "M", "is_trade_assoc": "T", "is_cooperative": "V", "is_corp_w_o_capital_stock": "W"}


def merged(sources: list[tuple[DataFrame, dict[str, Column]]], keys: list[str], fields: dict[str, str]) -> DataFrame:
    """Rows of keys with each field from the first source that has a value for it; one union and one aggregate, however many sources there are.

    sources: DataFrames in order of precedence, with the fields that each fills. fields: name to type. Within a source of several rows for one key the least value stands
    (so false before true): sources that should decide otherwise aggregate before. A key that only has empty fields is kept.
    """
    rows = []
    for rank, (df, own) in enumerate(sources):
        filled = [own[f].cast(k).alias(f) if f in own else F.lit(None).cast(k).alias(f) for f, k in fields.items()]
        rows.append(df.select(*keys, F.lit(rank).alias("_rank"), *filled))
    best = lambda f: F.min(F.when(F.col(f).isNotNull(), F.struct("_rank", f)))[f].alias(f)
    return reduce(DataFrame.unionByName, rows).groupBy(*keys).agg(*[best(f) for f in fields])


def _most(df: DataFrame, keys: list[str], values: list[str], measure: Column) -> DataFrame:
    """The values that occur most with each key; of equally frequent ones the least, null last."""
    counted = df.groupBy(*keys, *values).agg(measure.alias("_n"))
    order = F.struct((-F.col("_n")).alias("n"), *[F.struct(F.col(v).isNull().alias("none"), F.col(v).alias("v")).alias(v) for v in values])
    best = counted.groupBy(*keys).agg(F.min(order).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{v}.v").alias(v) for v in values])


def _lobbying(t: Tables, role: str, *keep: str) -> DataFrame:
    return lb.reports(t).select(F.explode(f"{role}_ids").alias("entity_id"), "cycle", *keep)


def parents_by_contributions(t: Tables) -> DataFrame:
    """The parent that most records of an organization and cycle name; none counts as a parent too, and an organization is not its own."""
    rows = ct.linked(t, "organization", "parent").select(F.explode("organization_ids").alias("entity_id"), "cycle", F.explode_outer("parent_ids").alias("parent_entity_id"))
    rows = rows.filter("parent_entity_id is null or entity_id <> parent_entity_id")
    return _most(rows, ["entity_id", "cycle"], ["parent_entity_id"], F.count("*"))


def parents_by_lobbying(t: Tables) -> DataFrame:
    rows = _lobbying(t, "client", "parent_ids").withColumn("parent_entity_id", F.explode("parent_ids")).filter("entity_id <> parent_entity_id")
    return _most(rows, ["entity_id", "cycle"], ["parent_entity_id"], F.count("*"))


def industries_by_contributions(t: Tables) -> DataFrame:
    """The industry and subindustry that most records of an organization and cycle have, from the subindustry's category code up to its order's industry."""
    a = t["attribute"]
    sub = a.filter("namespace = 'urn:crp:subindustry'").select(F.col("entity_id").alias("subindustry_entity_id"), F.col("value").alias("catcode"))
    top = a.filter("namespace = 'urn:crp:industry'").select(F.col("entity_id").alias("industry_entity_id"), F.col("value").alias("catorder"))
    pairs = sub.join(t["category"].select("catcode", "catorder"), "catcode").join(top, "catorder").select("subindustry_entity_id", "industry_entity_id")
    rows = ct.linked(t, "organization", "industry").select("transaction_id", "cycle", F.explode("organization_ids").alias("entity_id"), "industry_ids")
    rows = rows.withColumn("subindustry_entity_id", F.explode("industry_ids")).join(pairs, "subindustry_entity_id")
    return _most(rows, ["entity_id", "cycle"], ["industry_entity_id", "subindustry_entity_id"], F.countDistinct("transaction_id"))


def committee_profiles(t: Tables) -> DataFrame:
    """Interests of an organization's committees by cycle, true if any committee has them, and whether one is of type O."""
    ids = t["attribute"].filter("namespace = 'urn:fec:committee'").select("entity_id", F.col("value").alias("committee_id"))
    rows = ids.join(t["committee_profile"], "committee_id")
    any_of = {name: F.max(F.coalesce(F.col("interest_group") == code, F.lit(False))).alias(name) for name, code in INTERESTS.items()}
    return rows.groupBy("entity_id", "cycle").agg(*any_of.values(), F.max(F.when(F.col("committee_type") == "O", True)).alias("is_superpac"), F.lit(True).alias("has_fec_profile"))


FIELDS = {"lobbying_firm": "boolean", "parent_entity_id": "long", "industry_entity_id": "long", "subindustry_entity_id": "long", "is_superpac": "boolean", **dict.fromkeys(INTERESTS, "boolean"), "has_fec_profile": "boolean"}


def organization_metadata(t: Tables) -> DataFrame:
    """Organizations by cycle, -1 for all: lobbying firm, parent, industry, committees' kinds, and how navigation shows them.

    Rows: organizations that registered, hired, or are a parent in lobbying, or that have figures in contributions. A parent from contributions goes before one from lobbying; an
    organization whose parent is no entity is left out, as is one that is none itself. Cycle -1 has the values of the latest cycle. Of equally
    frequent values the least stands (any, in the original); of several committees each interest that any has (that of any one of them, in the original).
    """
    key = ["entity_id", "cycle"]
    orgs = t["entity"].filter("type = 'organization'").select(F.col("id").alias("entity_id"))
    figures = ct.entity_totals(t).select("entity_id", "cycle").join(orgs, "entity_id", "left_semi")
    firms = _lobbying(t, "registrant", "registrant_is_firm").groupBy(*key).agg(F.coalesce(F.max("registrant_is_firm"), F.lit(False)).alias("lobbying_firm"))
    rows = reduce(DataFrame.unionByName, [firms.select(*key), figures, _lobbying(t, "client"), _lobbying(t, "parent")]).withColumn("cycle", F.col("cycle").cast("int"))
    rows, firms = checkpointed(rows.distinct()), checkpointed(firms)
    same = lambda df, *names: (checkpointed(df), {n: F.col(n) for n in names})  # noqa: E731  a source is a job of its own: one plan of all would be too large for a small driver
    made = merged([
        (rows, {}), same(firms, "lobbying_firm"), same(parents_by_contributions(t), "parent_entity_id"), same(parents_by_lobbying(t), "parent_entity_id"),
        same(industries_by_contributions(t), "industry_entity_id", "subindustry_entity_id"), same(committee_profiles(t), "is_superpac", *INTERESTS, "has_fec_profile"),
        (rows, {"lobbying_firm": F.lit(False)}),
    ], key, FIELDS)
    listed = made.filter("lobbying_firm is not null")  # what only a later source knows is no row
    bins = t["navigation_bin"].groupBy("entity_id").agg(F.max(F.when(F.col("navigation_bin").isin("a", "b", "u"), True)).alias("is_org"), F.max(F.when(F.col("navigation_bin") == "p", True)).alias("is_pol_group"))
    listed = listed.join(bins, "entity_id", "left")
    known = t["entity"].select(F.col("id").alias("_known"))
    listed = listed.join(known, F.col("entity_id") == F.col("_known"), "left_semi").join(known.select("_known", F.lit(True).alias("_there")), F.col("parent_entity_id") == F.col("_known"), "left")
    kept = checkpointed(listed.filter("parent_entity_id is null or _there").drop("_known", "_there"))
    fields = [c for c in kept.columns if c not in key]
    latest = first_row(kept, ["entity_id"], [F.col("cycle")]).select("entity_id", F.struct(*fields).alias("_latest"))
    whole = kept.filter("cycle = -1").select("entity_id", "cycle").join(latest, "entity_id").select("entity_id", "cycle", "_latest.*")
    return kept.filter("cycle <> -1").unionByName(whole)


PLACES = ("state", "state_held", "district", "district_held", "party", "seat", "seat_held", "seat_status", "seat_result")


def politician_metadata(t: Tables, columns: dict[str, str]) -> DataFrame:
    """The most frequent state, party, seat and so on of each politician and cycle, over all records that name the politician. columns: output to the record's name."""
    politicians = t["entity"].filter("type = 'politician'").select(F.col("id").alias("entity_id"))
    rows = ct.linked(t, "recipient").select(F.explode("recipient_ids").alias("entity_id"), even_year(F.col("cycle")).alias("cycle"), *[F.col(c).alias(n) for n, c in columns.items()])
    return _most(rows.join(politicians, "entity_id", "left_semi"), ["entity_id", "cycle"], list(columns), F.count("*"))


def individual_metadata(t: Tables) -> DataFrame:
    """People, and whether they gave or lobbied."""
    people = t["entity"].filter("type = 'individual'").select(F.col("id").alias("entity_id"))
    gave = ct.linked(t, "contributor").select(F.explode("contributor_ids").alias("entity_id"))
    told = lambda df, name: (df, {name: F.lit(True)})
    flags = merged([(people, {}), told(gave, "is_contributor"), told(lb.lobbyists(t).select("entity_id"), "is_lobbyist")], ["entity_id"], {"is_contributor": "boolean", "is_lobbyist": "boolean"})
    return flags.join(people, "entity_id", "left_semi").fillna(False)


def affiliations(t: Tables) -> DataFrame:
    """individual_entity_id, organization_entity_id: people and the organizations on their contributions, each pair once."""
    people = t["entity"].filter("type = 'individual'").select(F.col("id").alias("individual_entity_id"))
    known = t["entity"].select(F.col("id").alias("organization_entity_id"))
    rows = ct.linked(t, "contributor", "organization").select(F.explode("contributor_ids").alias("individual_entity_id"), "organization_ids")
    pairs = rows.select("individual_entity_id", F.explode("organization_ids").alias("organization_entity_id")).distinct()
    return pairs.join(people, "individual_entity_id", "left_semi").join(known, "organization_entity_id", "left_semi").select("individual_entity_id", "organization_entity_id")


def revolving_door(t: Tables) -> DataFrame:
    """politician_entity_id, lobbyist_entity_id: lobbyists whose record has a politician's id, each pair once; a lobbyist's ids agree in 11 characters."""
    a = t["attribute"]
    politicians = a.filter("namespace = 'urn:crp:recipient'").select(F.col("entity_id").alias("politician_entity_id"), F.col("value").alias("candidate_ext_id"))
    people = a.filter("namespace = 'urn:crp:individual'").select(F.col("entity_id").alias("lobbyist_entity_id"), F.left("value", F.lit(11)).alias("_id"))
    pairs = t["lobbyist"].select("candidate_ext_id", F.left("lobbyist_ext_id", F.lit(11)).alias("_id")).distinct()
    return pairs.join(politicians, "candidate_ext_id").join(people, "_id").select("politician_entity_id", "lobbyist_entity_id").distinct()


def latest_cycle(metadata: DataFrame) -> DataFrame:
    """The row of each entity's latest cycle."""
    return first_row(metadata, ["entity_id"], [F.col("cycle")])
