"""Contribution subsets, associations, aggregates, rankings and summaries.

Records are classified in one pass, and one scan carries all links of a record: each look-up gives arrays of entity ids by equality joins on a name or
an id, which Spark broadcasts while a look-up is small and deals by key, splitting hot ones, when it is not. Figures explode these arrays; nothing
is joined back by transaction. Per-cycle and all-cycle figures come from one grouping-sets aggregate, so a rank over them is one window.

Inputs (a dict of DataFrames; `linked` may be there besides, see linked()): contribution, entity, alias, attribute, category, zip, org_metadata, individual_metadata, politician_metadata,
industry_metadata. transaction_id is the key of contribution, id of entity, zipcode of zip, catcode of category.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.cycles import even_year
from meridian.operators import links
from meridian.operators.ranking import dual_ranked, ranked as with_rank, top_n, rank_within
from meridian.operators.rollup import with_all_cycles

# Record types that count, by who gives.
FROM_PERSON = ("", "10", "11", "15", "15e", "15j", "22y")
FROM_GROUP = ("", "24k", "24r", "24z")
# Categories whose records are in no total.
SUPPRESSED_CATEGORIES = (
    "Z0000", "Z1000", "Z1100", "Z1200", "Z1300", "Z1400", "Z2100", "Z2200", "Z2300", "Z2400", "Z4100", "Z4200", "Z4300", "Z5000", "Z5100", "Z5200", "Z5300",
    "Z7777", "Z8888", "Z9100", "Z9500", "Z9600", "Z9700", "Z9800", "Z9999",
)
# What people state as their employer that is no organization.
SUPPRESSED_NAMES = (
    "retired", "homemaker", "attorney", "[24i contribution]", "self-employed", "physician", "self", "information requested", "self employed",
    "[24t contribution]", "consultant", "investor", "[candidate contribution]", "n/a", "farmer", "real estate", "none", "writer", "dentist",
    "info requested", "business owner", "accountant", "artist", "rancher", "student", "realtor", "investments", "real estate developer", "unemployed",
    "requested", "owner", "developer", "businessman", "contractor", "president", "engineer", "n", "psychologist", "real estate broker", "executive",
    "private investor", "architect", "sales", "real estate investor", "selfemployed", "philanthropist", "not employed", "author", "builder",
    "insurance agent", "volunteer", "construction", "insurance", "entrepreneur", "lobbyist", "ceo", "n.a", "actor", "photographer", "musician",
    "interior designer", "restaurant owner", "teacher", "designer", "surgeon", "social worker", "veterinarian", "psychiatrist", "chiropractor",
    "auto dealer", "small business owner", "optometrist", "producer", "business", ".information requested", "financial advisor", "pharmacist",
    "psychotherapist", "manager", "management consultant", "general contractor", "finance", "orthodontist", "actress", "n.a.", "restauranteur",
    "property management", "home builder", "oil & gas", "real estate investments", "geologist", "professor", "farming", "real estate agent", "na",
    "financial planner", "community volunteer", "property manager", "political consultant", "public relations", "business consultant", "publisher",
    "insurance broker", "educator", "nurse", "orthopedic surgeon", "editor", "marketing", "dairy farmer", "investment advisor", "freelance writer",
    "investment banker", "trader", "computer consultant", "banker", "oral surgeon", "business executive", "unknown", "civic volunteer", "filmmaker",
    "economist", "",
)
FEDERAL, STATE = "urn:fec:transaction", "urn:nimsp:transaction"
#: Where ids of federal and of state records come from.
SOURCES = {FEDERAL: "urn:crp:", STATE: "urn:nimsp:"}
TOP_N = 10

Tables = dict[str, DataFrame]


def relevant(t: Tables) -> DataFrame:
    """contributions_all_relevant: even cycles, and the subset each record belongs to; all others are left out.

    individual: person to politician; individual_to_organization: person to committee; organization: group to politician; org_to_pac: group to committee.
    Records with a null type, category or recipient category are in no subset, nor are those of suppressed categories, to recipients of
    Z4 categories, of other namespaces, or of an odd cycle whose next even one has no records of its own.
    """
    c = t["contribution"]
    cycles = c.select(F.col("cycle").alias("_cycle")).distinct()  # years: one row each
    c = c.withColumn("cycle", even_year(F.col("cycle")))
    person = F.coalesce("contributor_type", F.lit("")).isin("", "I") & F.col("transaction_type").isin(*FROM_PERSON)
    group = (F.col("contributor_type") == "C") & F.col("transaction_type").isin(*FROM_GROUP)
    to = F.col("recipient_type")
    subset = F.when(person & (to == "P"), "individual").when(person & (to == "C"), "individual_to_organization").when(group & (to == "P"), "organization").when(group & (to == "C"), "org_to_pac")
    c = c.filter(~F.col("contributor_category").isin(*SUPPRESSED_CATEGORIES) & ~F.col("recipient_category").startswith("Z4") & F.col("transaction_namespace").isin(FEDERAL, STATE))
    return c.withColumn("subset", subset).filter("subset is not null").join(cycles, F.col("cycle") == F.col("_cycle"), "left_semi")


def subset(t: Tables, name: str) -> DataFrame:
    return relevant(t).filter(F.col("subset") == name)


# --- links: arrays of entity ids


def _arrays(rows: DataFrame, *keys: str, repeats: bool = False) -> DataFrame:
    return rows.groupBy(*keys).agg((F.collect_list if repeats else F.collect_set)("entity_id").alias("_ids"))


def _of_type(t: Tables, kind: str) -> DataFrame:
    return t["entity"].filter(F.col("type") == kind).select(F.col("id").alias("entity_id"))


def _aliases(t: Tables) -> DataFrame:
    """Organizations by namespace of the record and lower-cased name; an alias without a namespace is for both."""
    of = F.coalesce("namespace", F.lit(""))
    where = F.when(of == "", F.array(F.lit(FEDERAL), F.lit(STATE)))
    for ns, prefix in SOURCES.items():
        where = where.when(of.startswith(prefix), F.array(F.lit(ns)))
    rows = t["alias"].join(_of_type(t, "organization"), "entity_id").select("entity_id", F.explode(where).alias("_ns"), F.lower("alias").alias("_key"))
    return _arrays(rows, "_ns", "_key")


def _ids(t: Tables, kind: str) -> DataFrame:
    """Entities by namespace of the record and id, from attributes of one kind."""
    of = F.col("namespace")
    where = reduce(lambda w, x: w.when(of == x[1] + kind, x[0]), SOURCES.items(), F.when(F.lit(False), ""))
    return t["attribute"].filter("value <> ''").select("entity_id", where.alias("_ns"), F.col("value").alias("_key")).filter("_ns is not null")


def _joined(c: DataFrame, lookup: DataFrame, key: Column, into: str, ns: bool = True) -> DataFrame:
    """c with the look-up's ids in the array `into`, after those that are there already."""
    columns = c.columns
    found = c.select("*", key.alias("_key"), *([F.col("transaction_namespace").alias("_ns")] if ns else []))
    both = found.join(lookup, ["_ns", "_key"] if ns else ["_key"], "left")
    ids = F.coalesce("_ids", F.expr("array()").cast(lookup.schema["_ids"].dataType))
    if into in columns:
        ids = F.array_distinct(F.concat(F.col(into), ids))
    return both.select(*[x for x in columns if x != into], ids.alias(into))


def _individuals(t: Tables) -> DataFrame:
    """Individuals by id; a zero as twelfth digit of a federal id may be missing in the record."""
    rows = _ids(t, "individual").join(_of_type(t, "individual"), "entity_id")
    short = (F.col("_ns") == FEDERAL) & (F.length("_key") == 12) & F.col("_key").endswith("0")
    keys = F.when(short, F.array("_key", F.left("_key", F.lit(11)))).otherwise(F.array("_key"))
    return rows.select("entity_id", "_ns", F.explode(keys).alias("_key"))


def _person_id() -> Column:
    """The record's id where it may be a person's."""
    kind = F.col("contributor_type")
    return F.when(F.when(F.col("transaction_namespace") == FEDERAL, kind == "I").otherwise(kind.isNull() | (kind != "C")), F.col("contributor_ext_id"))


def _contributors(t: Tables, c: DataFrame) -> DataFrame:
    """Organizations by name or id, people by id, and people by name within a metropolitan area where their id was seen under that name."""
    people = _arrays(_individuals(t), "_ns", "_key")
    zips = t["zip"].select(F.col("zipcode").alias("_zip"), F.col("msa_id").alias("_msa"))
    seen = _joined(relevant(t).select(*_KEYS["contributor"]).distinct(), people, _person_id(), "_seen")
    seen = seen.select(F.explode("_seen").alias("entity_id"), F.lower("contributor_name").alias("_key"), "contributor_zipcode")
    names = seen.select("entity_id", "_key").filter("_key is not null").distinct()
    places = seen.join(zips, F.col("contributor_zipcode") == F.col("_zip")).select("entity_id", "_msa").distinct()
    near = _arrays(names.join(places, "entity_id"), "_key", "_msa")
    c = _joined(c, _aliases(t), F.lower("contributor_name"), "contributor_ids")
    c = _joined(c, _arrays(_ids(t, "organization"), "_ns", "_key"), F.when(F.col("contributor_type") == "C", F.col("contributor_ext_id")), "contributor_ids")
    c = _joined(c, people, _person_id(), "contributor_ids")
    here = c.join(zips, F.col("contributor_zipcode") == F.col("_zip"), "left").select(*c.columns, "_msa", F.lower("contributor_name").alias("_key")).join(near, ["_key", "_msa"], "left")
    ids = F.array_distinct(F.concat("contributor_ids", F.coalesce("_ids", F.expr("array()").cast(near.schema["_ids"].dataType))))
    return here.select(*[x for x in c.columns if x != "contributor_ids"], ids.alias("contributor_ids"))


def _organizations(prefix: str, into: str):
    def add(t: Tables, c: DataFrame) -> DataFrame:
        c = _joined(c, _aliases(t), F.lower(f"{prefix}_name"), into)
        return _joined(c, _arrays(_ids(t, "organization"), "_ns", "_key"), F.col(f"{prefix}_ext_id"), into)

    return add


def _industries(t: Tables, c: DataFrame) -> DataFrame:
    """Industries by the category's order, and by the category itself, one after the other: an industry that both name is there twice."""
    values = t["attribute"].join(_of_type(t, "industry"), "entity_id").select("entity_id", F.lower("value").alias("_value"))
    codes = t["category"].select(F.lower("catcode").alias("_key"), F.lower("catorder").alias("_value"))
    both = codes.join(values, "_value").select("entity_id", "_key").unionByName(values.withColumnRenamed("_value", "_key"))
    return _joined(c, _arrays(both, "_key", repeats=True), F.lower("contributor_category"), "industry_ids", ns=False)


def _recipients(t: Tables, c: DataFrame) -> DataFrame:
    """Organizations by name; politicians, who all have ids, by those."""
    c = _joined(c, _aliases(t), F.lower("recipient_name"), "recipient_ids")
    known = _ids(t, "recipient").join(t["entity"].select(F.col("id").alias("entity_id")), "entity_id")
    return _joined(c, _arrays(known, "_ns", "_key"), F.when(F.col("recipient_type") == "P", F.col("recipient_ext_id")), "recipient_ids")


#: The columns that tell the entities of each kind.
_KEYS = {
    "contributor": ("transaction_namespace", "contributor_type", "contributor_ext_id", "contributor_name", "contributor_zipcode"), "organization": ("transaction_namespace", "organization_name", "organization_ext_id"),
    "parent": ("transaction_namespace", "parent_organization_name", "parent_organization_ext_id"), "industry": ("contributor_category",),
    "recipient": ("transaction_namespace", "recipient_type", "recipient_name", "recipient_ext_id"),
}
_LINKS = {"contributor": _contributors, "organization": _organizations("organization", "organization_ids"), "parent": _organizations("parent_organization", "parent_ids"), "industry": _industries, "recipient": _recipients}


def _with_links(c: DataFrame, kind: str, found: DataFrame) -> DataFrame:
    """c with the kind's entities, from found: _key (the columns that tell them, as an array) and _ids. A record that names nobody matches nothing and is dealt by its number."""
    columns = list(_KEYS[kind])
    nobody = reduce(Column.__and__, [F.col(x).isNull() for x in columns if x.endswith(("_name", "_ext_id", "_category"))])
    key = F.when(nobody, F.array(F.pmod(F.xxhash64("transaction_id"), F.lit(links.SPREAD)).cast("string"))).otherwise(F.array(*[F.col(x).cast("string") for x in columns], F.lit(kind)))
    both = c.withColumn("_key", key).join(found, "_key", "left")
    return both.select(*c.columns, F.coalesce("_ids", F.expr("array()").cast(found.schema["_ids"].dataType)).alias(f"{kind}_ids"))


def _combinations(t: Tables, records: DataFrame, kind: str) -> DataFrame:
    """_key and _ids of each combination of the columns that tell a kind's entities, where there are any."""
    found = _LINKS[kind](t, records.select(*_KEYS[kind]).distinct())
    return found.select(F.array(*[F.col(x).cast("string") for x in _KEYS[kind]], F.lit(kind)).alias("_key"), F.col(f"{kind}_ids").alias("_ids")).filter(F.size("_ids") > 0)


def linked(t: Tables, *kinds: str, where: str = "true") -> DataFrame:
    """The relevant records that meet a condition, with an array of entity ids for each kind: contributor, organization, parent, industry, recipient.

    Where the tables hold `linked`, which is linked() of all kinds as stored once for all figures, it is read instead.

    Entities are looked up once for each combination of the columns that tell them, not for each record; so records are joined once for each kind. The combinations of all kinds but
    contributors, of which there are as many as people, are kept in one job: where they are few, records are not dealt by a handful of names at all.
    """
    if "linked" in t:
        return t["linked"].filter(where)
    records = relevant(t).filter(where)
    found = {k: _combinations(t, records, k) for k in kinds}
    if named := [k for k in kinds if k != "contributor"]:
        every = links.kept(reduce(DataFrame.unionByName, [found[k].withColumn("_kind", F.lit(k)) for k in named]), "_kind")
        found |= {k: every[k].select("_key", "_ids") for k in named}
    return reduce(lambda c, kind: _with_links(c, kind, found[kind]), kinds, records)


KINDS_OF_LINKS = tuple(_LINKS)


def association(t: Tables, kind: str) -> DataFrame:
    """Links entity_id, transaction_id of a kind: each pair once, but industries as often as they are found."""
    return linked(t, kind).select(F.explode(f"{kind}_ids").alias("entity_id"), "transaction_id")


#: A record's parents where it has any, else its organizations. Several organizations repeat each parent, as a full join of both links gives it.
BIGGEST = "if(size(parent_ids) = 0, organization_ids, flatten(array_repeat(parent_ids, greatest(size(organization_ids), 1))))"


def biggest_association(t: Tables) -> DataFrame:
    return linked(t, "organization", "parent").select(F.explode(F.expr(BIGGEST)).alias("entity_id"), "transaction_id")


# --- aggregates

KINDS = {"organization": ("organization", "parent"), "individual": ("contributor",), "industry": ("industry",)}
GIVERS = {"organization": "array_union(organization_ids, parent_ids)", "individual": "contributor_ids", "industry": "industry_ids"}
#: What aggregates leave out besides.
COUNTED = "contributor_category not like 'Z90%'"
IN_STATE = "case when contributor_state = recipient_state then 'in-state' when contributor_state = '' then '' else 'out-of-state' end"


def _named(t: Tables, facts: DataFrame, key: str, name: str) -> DataFrame:
    return facts.join(t["entity"].select(F.col("id").alias(key), F.col("name").alias(name)), key, "left")


def _seated(t: Tables, facts: DataFrame) -> DataFrame:
    """A row for each recipient_id that was a politician in that cycle, but not for the presidency."""
    seats = t["politician_metadata"].filter("seat <> 'federal:president'").select(F.col("entity_id").alias("recipient_id"), "cycle")
    return facts.withColumn("recipient_id", F.explode("recipient_ids")).join(seats, ["recipient_id", "cycle"])


def aggregate(t: Tables, who: str, by: str) -> DataFrame:
    """Columns entity_id, the dimension, cycle (-1 for all), count, amount, and the ranks of the dimension's values within entity and cycle.

    who: organization, individual or industry. by: party, seat, recipient_type, state_fed, indiv_pac (not of individuals) or in_state (of individuals).
    A record counts for each recipient that it is linked to, except in the figures of individuals by party, seat and recipient type, where it counts once; by
    in_state only recipients with a seat, other than the presidency, in that cycle. indiv_pac has both values for each entity and cycle.
    """
    people = who == "individual"
    simple = people and by in ("party", "seat", "recipient_type")
    condition = COUNTED + (" and subset = 'individual'" if by == "in_state" else " and subset like 'individual%'" if people else "")
    facts = linked(t, *KINDS[who], *([] if simple else ["recipient"]), where=condition)
    if by == "in_state":
        facts = _seated(t, facts)
    times = F.lit(1) if simple or by == "in_state" else F.greatest(F.size("recipient_ids"), F.lit(1))
    dimension = {
        "party": F.col("recipient_party"), "seat": F.col("seat"), "recipient_type": F.col("recipient_type"), "in_state": F.expr(IN_STATE),
        "state_fed": F.when(F.col("transaction_namespace") == FEDERAL, "federal").when(F.col("transaction_namespace") == STATE, "state").otherwise("other"),
        "indiv_pac": F.col("subset").isin("organization", "org_to_pac"),
    }[by]
    facts = facts.select(F.explode(F.expr(GIVERS[who])).alias("entity_id"), "cycle", dimension.alias(by), times.cast("long").alias("_n"), (F.col("amount") * times).alias("amount"))
    if by == "indiv_pac":
        side = lambda c, x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0))
        sums = {f"{n}_{x}": side(F.col(by) if n == "direct" else ~F.col(by), c) for n in ("direct", "indiv") for x, c in (("count", "_n"), ("amount", "amount"))}
        wide = with_all_cycles(facts, ["entity_id"], sums).join(t["entity"].select(F.col("id").alias("entity_id")), "entity_id")
        g = wide.select("entity_id", "cycle", F.inline(F.array(*[F.struct(F.lit(n).alias(by), F.col(f"{n}_count").alias("count"), F.col(f"{n}_amount").alias("amount")) for n in ("direct", "indiv")])))
    else:
        g = with_all_cycles(facts, ["entity_id", by], {"count": F.sum("_n"), "amount": F.sum("amount")})
    return dual_ranked(g, ["entity_id", "cycle"], F.desc("count"), F.desc("amount"))


def two_sided(facts: DataFrame, keys: list[str], nullable: str) -> DataFrame:
    """Figures of both sides (_direct or not) by keys, per cycle and in all.

    A null id has a row for each side in a cycle, because the full join of the sides that this stands for does not match nulls; over all cycles they are one.
    """
    direct = F.col("_direct")
    zero = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0))
    cycles = facts.groupBy(*keys, "cycle", F.when(F.col(nullable).isNull(), direct).alias("_side")).agg(
        F.count("*").alias("total_count"), F.count_if(direct).alias("pacs_count"), F.count_if(~direct).alias("indivs_count"),
        F.sum("amount").alias("total_amount"), zero(direct).alias("pacs_amount"), zero(~direct).alias("indivs_amount"),
    ).drop("_side")
    figures = [c for c in cycles.columns if c not in (*keys, "cycle")]
    total = cycles.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in figures]).withColumn("cycle", F.lit(-1))
    return cycles.unionByName(total)


def pivot(t: Tables, who: str, to: str) -> DataFrame:
    """What each entity gave to each recipient, directly and through its people, per cycle and in all: one pass over facts that carry both sides.

    to: candidates or pacs. Records without a recipient link go under the recipient's name alone; else the name is the entity's. Those of individuals have
    no direct side.
    """
    direct, people = ("organization", "individual") if to == "candidates" else ("org_to_pac", "individual_to_organization")
    both = f"subset = '{people}'" if who == "individual" else f"{COUNTED} and subset in ('{direct}', '{people}')"
    facts = linked(t, *KINDS[who], "recipient", where=both).select(F.explode(F.expr(GIVERS[who])).alias("entity_id"), "recipient_ids", "cycle", "amount", "recipient_name", (F.col("subset") == direct).alias("_direct"))
    facts = facts.withColumn("recipient_id", F.explode_outer("recipient_ids"))
    facts = _named(t, facts, "recipient_id", "_name").withColumn("recipient_name", F.coalesce("_name", "recipient_name"))
    return two_sided(facts, ["entity_id", "recipient_name", "recipient_id"], "recipient_id")


def top_recipients(t: Tables, who: str, to: str, n: int = TOP_N) -> DataFrame:
    return top_n(pivot(t, who, to), ["entity_id", "cycle"], [F.desc("total_amount")], n)


def _sided_givers(t: Tables, facts: DataFrame, ids: Column, own: Column, keys: list[str]) -> DataFrame:
    """Facts with organization_entity and organization_name: the entity's name, or where there is no entity, own."""
    facts = facts.withColumn("_own", own).withColumn("organization_entity", F.explode_outer(ids))
    return _named(t, facts, "organization_entity", "_name").select(*keys, "cycle", "amount", "organization_entity", F.coalesce("_name", "_own").alias("organization_name"), (F.col("subset") == "organization").alias("_direct"))


def top_orgs_by_industry(t: Tables, n: int = TOP_N) -> DataFrame:
    """agg_top_orgs_by_industry: the organizations that gave most in each industry (entity_id), per cycle and in all.

    Groups' records count as direct under the organization's or the contributor's name, people's under the organization's.
    """
    facts = linked(t, "organization", "industry", where="subset <> 'org_to_pac'").withColumn("entity_id", F.explode("industry_ids"))
    own = F.when(F.col("subset") == "organization", F.col("contributor_name")).otherwise(F.col("organization_name"))
    facts = _sided_givers(t, facts, F.col("organization_ids"), own, ["entity_id"]).filter("organization_name <> ''")
    return top_n(two_sided(facts, ["entity_id", "organization_name", "organization_entity"], "organization_entity"), ["entity_id", "cycle"], [F.desc("total_amount")], n).drop("rank")


def top_orgs_to_politician(t: Tables, n: int = TOP_N) -> DataFrame:
    """agg_orgs_to_cand: the organizations that gave most to each recipient (entity_id), per cycle and in all; a record's parents stand for its organizations.

    Records whose stated organization is a suppressed name are left out; a person's record without one goes by the person's name.
    """
    stated = F.when(F.col("subset") == "organization", F.col("organization_name")).otherwise(F.when(F.col("organization_name") != "", F.col("organization_name")).otherwise(F.col("contributor_name")))
    facts = linked(t, "organization", "parent", "recipient", where="subset in ('organization', 'individual')").filter(~F.lower(stated).isin(*SUPPRESSED_NAMES)).withColumn("entity_id", F.explode("recipient_ids"))
    facts = _sided_givers(t, facts, F.expr(BIGGEST), F.when(F.col("subset") == "organization", F.col("contributor_name")).otherwise(stated), ["entity_id"])
    return top_n(two_sided(facts, ["entity_id", "organization_name", "organization_entity"], "organization_entity"), ["entity_id", "cycle"], [F.desc("total_amount")], n).drop("rank")


def top_industries_to_politician(t: Tables, n: int = TOP_N) -> DataFrame:
    """agg_industries_to_cand: the industries that gave most to each recipient (entity_id), per cycle and in all; a record without one counts for the entity of code Y00.

    A record counts for each attribute of its industry in the industries' namespace, and for its industry if that has no attribute at all; categories that begin with Y
    or Z or are empty are left out.
    """
    facts = linked(t, "industry", "recipient", where="subset in ('organization', 'individual') and left(contributor_category, 1) not in ('', 'Y', 'Z')")
    unknown = t["attribute"].filter("value = 'Y00'").agg(F.min("entity_id")).scalar()
    marks = t["attribute"].groupBy("entity_id").agg(F.count_if(F.coalesce("namespace", F.lit("urn:crp:industry")) == "urn:crp:industry").alias("_marks")).select(F.col("entity_id").alias("industry_id"), "_marks")
    facts = facts.select(F.explode("recipient_ids").alias("entity_id"), "industry_ids", "cycle", "amount").withColumn("industry_id", F.explode_outer("industry_ids"))
    facts = _named(t, facts.join(marks, "industry_id", "left"), "industry_id", "_name")
    times = F.coalesce("_marks", F.lit(1))
    facts = facts.filter(times > 0).select("entity_id", F.coalesce(F.col("industry_id"), unknown).alias("industry_entity"), F.coalesce("_name", F.lit("UNKNOWN")).alias("industry"), "industry_id", "cycle", times.alias("_n"), (F.col("amount") * times).alias("amount"))
    g = with_all_cycles(facts, ["entity_id", "industry_id", "industry_entity", "industry"], {"count": F.sum("_n"), "amount": F.sum("amount")})
    return top_n(g, ["entity_id", "cycle"], [F.desc("amount")], n).drop("rank", "industry_id")


def unknown_industries_to_politician(t: Tables) -> DataFrame:
    """agg_unknown_industries_to_cand: what each recipient (entity_id) got in categories that begin with Y or Z or are empty."""
    facts = linked(t, "recipient", where="subset in ('organization', 'individual') and left(contributor_category, 1) in ('', 'Y', 'Z')")
    return with_all_cycles(facts.select(F.explode("recipient_ids").alias("entity_id"), "cycle", "amount"), ["entity_id"], {"count": F.count("*"), "amount": F.sum("amount")})


def politician_sources(t: Tables, by: str, top: int | None = None) -> DataFrame:
    """What each recipient got, by sector, contributor type or place, per cycle and in all. by: sector, contributor_type or in_state."""
    facts = linked(t, "recipient", where="subset = 'individual'" if by == "in_state" else "subset in ('individual', 'organization')")
    if by == "sector":
        codes = t["category"].select(F.col("catcode").alias("contributor_category"), F.left("catorder", F.lit(1)).alias("_sector"))
        facts = facts.join(codes, "contributor_category", "left")
    value = {"sector": "coalesce(_sector, 'Y')", "contributor_type": "coalesce(contributor_type, '')", "in_state": IN_STATE}[by]
    facts = facts.select(F.explode("recipient_ids").alias("entity_id"), F.expr(value).alias(by), "cycle", "amount")
    g = with_all_cycles(facts, ["entity_id", by], {"count": F.count("*"), "amount": F.sum("amount")})
    return g if top is None else top_n(g, ["entity_id", "cycle"], [F.desc("amount")], top)


def politician_from_organizations(t: Tables) -> DataFrame:
    """aggregate_politician_from_organizations: by recipient (entity_id) and organization, with both ranks; names are the entity's."""
    facts = linked(t, "organization", "parent", "recipient", where=f"{COUNTED} and subset in ('organization', 'individual')").withColumn("entity_id", F.explode("recipient_ids"))
    facts = facts.withColumn("organization_entity", F.explode(F.expr(GIVERS["organization"])))
    facts = _named(t, facts, "organization_entity", "_name").withColumn("organization_name", F.coalesce("_name", "contributor_name")).withColumn("_direct", F.col("subset") == "organization")
    facts = facts.filter("not _direct or organization_name <> ''")
    g = two_sided(facts, ["entity_id", "organization_entity", "organization_name"], "organization_entity")
    return dual_ranked(g, ["entity_id", "cycle"], F.desc("total_count"), F.desc("total_amount"))


def politician_from_individuals(t: Tables) -> DataFrame:
    """aggregate_politician_from_individuals: by recipient (entity_id) and individual, of records without an organization, with both ranks."""
    facts = linked(t, "contributor", "organization", "parent", "recipient", where=f"{COUNTED} and subset = 'individual'").filter("size(organization_ids) = 0 and size(parent_ids) = 0")
    people = t["entity"].filter("type = 'individual'").select(F.col("id").alias("individual_entity"), F.col("name").alias("individual_name"))
    facts = facts.withColumn("entity_id", F.explode("recipient_ids")).withColumn("individual_entity", F.explode("contributor_ids")).join(people, "individual_entity")
    g = with_all_cycles(facts, ["entity_id", "individual_entity", "individual_name"], {"count": F.count("*"), "amount": F.sum("amount")})
    return dual_ranked(g, ["entity_id", "cycle"], F.desc("count"), F.desc("amount"))


def politician_from_industries(t: Tables) -> DataFrame:
    """aggregate_politician_from_industries: by recipient (entity_id) and industry, with the rank by amount."""
    facts = linked(t, "industry", "recipient", where=f"{COUNTED} and subset in ('organization', 'individual')").withColumn("entity_id", F.explode("recipient_ids"))
    facts = facts.withColumn("industry_entity", F.explode("industry_ids")).withColumn("_direct", F.col("subset") == "organization")
    named = t["entity"].select(F.col("id").alias("industry_entity"), F.col("name").alias("industry_name"))
    g = two_sided(facts.join(named, "industry_entity"), ["entity_id", "industry_entity", "industry_name"], "industry_entity")
    return with_rank(g, ["entity_id", "cycle"], [F.desc("total_amount")])


def politician_by_org_pac_indiv(t: Tables) -> DataFrame:
    """aggregate_politician_by_org_pac_indiv: what each politician (entity_id) got from groups, from their people and from others."""
    orgs, people = politician_from_organizations(t), politician_from_individuals(t)
    row = lambda n, c, a: F.struct(F.lit(n).alias("org_pac_indiv"), F.col(c).cast("long").alias("count"), F.col(a).alias("amount"))
    parts = orgs.select("entity_id", "cycle", F.inline(F.array(row("org_pac", "pacs_count", "pacs_amount"), row("org_indiv", "indivs_count", "indivs_amount"))))
    parts = parts.unionByName(people.select("entity_id", "cycle", F.lit("indiv").alias("org_pac_indiv"), "count", "amount"))
    return parts.groupBy("entity_id", "cycle", "org_pac_indiv").agg(F.sum("count").alias("count"), F.sum("amount").alias("amount")).join(t["entity"].select(F.col("id").alias("entity_id")), "entity_id")


def politician_by_in_state(t: Tables) -> DataFrame:
    """aggregate_politician_from_individuals_by_in_state_out_of_state: people's records to each politician (entity_id) with a seat in that cycle, other than the presidency.

    A record counts for each of its contributors. Ranks are within politician, cycle and place, hence 1.
    """
    facts = _seated(t, linked(t, "contributor", "recipient", where=f"{COUNTED} and subset = 'individual'"))
    facts = facts.withColumn("contributor_id", F.explode("contributor_ids")).join(t["entity"].select(F.col("id").alias("contributor_id")), "contributor_id")
    g = with_all_cycles(facts.select(F.col("recipient_id").alias("entity_id"), F.expr(IN_STATE).alias("in_state"), "cycle", "amount"), ["entity_id", "in_state"], {"count": F.count("*"), "amount": F.sum("amount")})
    return g.withColumns({"rank_by_count": F.lit(1), "rank_by_amount": F.lit(1)})


def entity_totals(t: Tables) -> DataFrame:
    """agg_entities: given and received of every entity, per cycle and in all. Industries count as often as they are found."""
    facts = linked(t, "contributor", "organization", "parent", "industry", "recipient")
    givers = F.concat(F.array_union(F.array_union("contributor_ids", "organization_ids"), F.col("parent_ids")), F.col("industry_ids"))
    side = lambda ids, given: F.transform(ids, lambda x: F.struct(x.alias("entity_id"), F.lit(given).alias("given")))
    both = facts.select("cycle", "amount", F.inline(F.concat(side(givers, True), side(F.col("recipient_ids"), False))))
    g, amount = F.col("given"), F.col("amount")
    return with_all_cycles(both, ["entity_id"], {
        "contributor_count": F.count_if(g), "recipient_count": F.count_if(~g),
        "contributor_amount": F.coalesce(F.sum(F.when(g, amount)), F.lit(0)), "recipient_amount": F.coalesce(F.sum(F.when(~g, amount)), F.lit(0)),
    })


# --- rankings and summaries: one template

_ORG = lambda condition: lambda t: t["org_metadata"].filter(f"{condition} and parent_entity_id is null").select("entity_id", "cycle")
#: Whose ranking it is, and its members: by entity, for organizations by entity and cycle.
GROUPS: dict[str, tuple[str, Callable[[Tables], DataFrame]]] = {
    "parentmost_orgs": ("organization", _ORG("is_org")),
    "lobbying_orgs": ("organization", _ORG("lobbying_firm")),
    "pol_groups": ("organization", _ORG("is_pol_group")),
    "individuals": ("individual", lambda t: t["entity"].select(F.col("id").alias("entity_id"))),
    "lobbyists": ("individual", lambda t: t["individual_metadata"].filter("is_lobbyist").select("entity_id")),
    "industries": ("industry", lambda t: t["industry_metadata"].filter("parent_industry_id is null and should_show_entity").select("entity_id").join(t["entity"].filter("name <> 'UNKNOWN'").select(F.col("id").alias("entity_id")), "entity_id")),
    "politicians": ("politician", lambda t: t["entity"].select(F.col("id").alias("entity_id"))),
}
BY = {
    "parentmost_orgs": ("party", "state_fed", "seat", "recipient_type", "indiv_pac"), "lobbying_orgs": ("party", "state_fed", "seat", "recipient_type", "indiv_pac"),
    "pol_groups": ("party", "state_fed", "seat", "recipient_type", "indiv_pac"), "individuals": ("party", "state_fed", "seat", "recipient_type", "in_state"),
    "lobbyists": ("party", "state_fed", "seat", "recipient_type", "in_state"), "industries": ("party", "state_fed", "recipient_type", "indiv_pac"),
    "politicians": ("org_pac_indiv", "in_state"),
}


def _members(t: Tables, group: str, by: str) -> DataFrame:
    """Figures of a group's entities by value of the dimension and cycle. Empty values are left out; parties are D, R and Other."""
    who, members = GROUPS[group]
    if who == "politician":
        g = politician_by_org_pac_indiv(t) if by == "org_pac_indiv" else politician_by_in_state(t)
    else:
        g = aggregate(t, who, by)
    m = members(t)
    g = g.drop("rank_by_count", "rank_by_amount").join(m.distinct(), [c for c in m.columns]).filter(F.col(by) != "")
    if by == "party":
        g = g.withColumn(by, F.when(F.col(by).isin("D", "R"), F.col(by)).otherwise("Other")).groupBy("entity_id", by, "cycle").agg(F.sum("count").alias("count"), F.sum("amount").alias("amount"))
    return g.select("entity_id", by, "cycle", "count", "amount")


def ranked(t: Tables, group: str, by: str) -> DataFrame:
    """Entities of a group ranked by count and by amount within each value of the dimension and cycle; no value's entities come together in one task."""
    return rank_within(rank_within(_members(t, group, by), [by, "cycle"], "count", "rank_by_count"), [by, "cycle"], "amount", "rank_by_amount")


def summary(t: Tables, group: str, by: str, n: int = TOP_N) -> DataFrame:
    """The n largest by amount of each value and cycle, with the value's totals over all of the group. Only those n are ranked by amount; ranks by count come from the counts of equal counts."""
    rows = _members(t, group, by)
    totals = rows.groupBy(by, "cycle").agg(F.sum("count").alias("total_count"), F.sum("amount").alias("total_amount"))
    best = top_n(rank_within(rows, [by, "cycle"], "count", "rank_by_count"), [by, "cycle"], [F.desc("amount")], n, "rank_by_amount")
    return best.join(totals, [by, "cycle"])


def entity_types(t: Tables) -> DataFrame:
    """summary_entity_types: for each group per cycle, records, amount and members, from the rankings by state or federal (politicians: by who gives)."""
    label = {"industries": "industry", "parentmost_orgs": "org", "pol_groups": "pol_group", "lobbying_orgs": "lobbying_org", "individuals": "individual", "lobbyists": "lobbyist", "politicians": "pol"}
    parts = []
    for group, name in label.items():
        r = ranked(t, group, "org_pac_indiv" if group == "politicians" else "state_fed")
        parts.append(r.groupBy("cycle").agg(F.lit(name).alias("entity_type"), F.sum("count").alias("contributions_count"), F.sum("amount").alias("contributions_amount"), F.countDistinct("entity_id").alias("entity_count")))
    return reduce(DataFrame.unionByName, parts)
