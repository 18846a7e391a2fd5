"""Lobbying: links of reports to clients, their parents, firms and industries, and of lobbyists to people; totals by year and cycle; the top lists of clients,
lobbyists and firms; issues and bills across the biggest organizations.

One scan of the reports carries all links as arrays (`linked`); every list explodes those that it needs. Tables: lobbying (transaction_id, year, amount, use, registrant_name,
registrant_is_firm, client_name, client_parent_name, client_category, include_in_industry_totals, filing_included_nsfs, filing_type), lobbyist (id, transaction_id,
lobbyist_name, lobbyist_ext_id), issue (id, transaction_id, general_issue), bill (issue_id, congress_no, bill_type, bill_no, bill_name), entity, alias, attribute, category, org_metadata.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.cycles import even_year
from meridian.operators import links
from meridian.operators.joins import prefer_exact, prefix_join
from meridian.operators.ranking import checkpointed, rank_within, top_n
from meridian.operators.rollup import with_all_cycles

TOP_N = 10
Tables = dict[str, DataFrame]
BILL = ("bill_type", "bill_no", "congress_no", "bill_name")
BILL_KEY = ("congress_no", "bill_type", "bill_no")

# --- links


def _industries(t: Tables) -> DataFrame:
    """Industries by category code: by its order and by the code itself, each once."""
    values = t["attribute"].join(links.typed(t, "industry"), "entity_id").select("entity_id", "value")
    by_order = t["category"].join(values, F.col("catorder") == F.col("value")).select("entity_id", F.lower("catcode").alias("key"))
    return links.lookup(by_order.unionByName(values.select("entity_id", F.lower("value").alias("key"))), F.col("key"), distinct=True)


def linked(t: Tables) -> DataFrame:
    """Every lobbying record with client_ids, parent_ids, registrant_ids and industry_ids. An entity with two equal aliases is there twice, as its links are."""
    if "lobbying_linked" in t:
        return t["lobbying_linked"]
    names, r = links.aliases(t), t["lobbying"]
    for column, into in (("client_name", "client_ids"), ("client_parent_name", "parent_ids"), ("registrant_name", "registrant_ids")):
        r = links.with_ids(r, names, F.lower(column), into, "transaction_id")
    return links.with_ids(r, _industries(t), F.lower("client_category"), "industry_ids", "transaction_id")


#: The biggest clients: parents where there are any, else clients, each once.
BIGGEST = "array_distinct(if(size(parent_ids) > 0, parent_ids, client_ids))"


def association(t: Tables, kind: str) -> DataFrame:
    """entity_id, transaction_id: client, parent, registrant, industry; or biggest, where several clients repeat each parent and the other way round."""
    ids = "if(size(parent_ids) = 0, client_ids, flatten(array_repeat(parent_ids, greatest(size(client_ids), 1))))" if kind == "biggest" else f"{kind}_ids"
    return links.exploded(linked(t), F.expr(ids), "transaction_id")


def lobbyists(t: Tables) -> DataFrame:
    """entity_id, id: the lobbyists' rows that have the id of a person; of ids equal in 11 characters the one that is equal as a whole, else the greatest."""
    people = t["attribute"].filter("namespace = 'urn:crp:individual'").select("entity_id", "value")
    ids = t["lobbyist"].select("lobbyist_ext_id").filter("lobbyist_ext_id is not null").distinct()  # once for each id, not for each row
    chosen = prefer_exact(prefix_join(people, ids, F.col("value"), F.col("lobbyist_ext_id"), 11), ["entity_id"], F.col("value") == F.col("lobbyist_ext_id"), "lobbyist_ext_id")
    return chosen.join(t["lobbyist"].select("id", "lobbyist_ext_id"), "lobbyist_ext_id").select("entity_id", "id")


def reports(t: Tables) -> DataFrame:
    """Linked records in use, by even cycle."""
    return linked(t).filter("use").withColumn("cycle", even_year(F.col("year")))


# --- totals


def by_entity_year(t: Tables) -> DataFrame:
    """Of each entity and year: reports, spending on lobbying other than as a firm, and a firm's income, apart by whether they count for industries, by the kind of filing and so on.

    Four figures are joined in full by entity and year: as lobbyist, as firm, as its own registrant, as a firm's client. Spending of one's own goes before a firm's client's.
    """
    r = reports(t)
    keys = ["entity_id", "year"]
    people = t["lobbyist"].select("id", "transaction_id").join(lobbyists(t), "id")
    count = F.count("*").cast("long")
    as_lobbyist = people.join(r.select("transaction_id", "year"), "transaction_id").groupBy(*keys).agg(count.alias("c0"))
    as_registrant = links.exploded(r, "registrant_ids", "year", "amount", "registrant_is_firm", "include_in_industry_totals", "filing_included_nsfs", "filing_type")
    firm = as_registrant.filter("registrant_is_firm").groupBy(*keys, F.col("include_in_industry_totals").alias("i1")).agg(count.alias("c1"), F.sum("amount").alias("a1"))
    by = lambda n: [F.col("include_in_industry_totals").alias(f"i{n}"), F.col("filing_included_nsfs").alias(f"s{n}"), F.col("filing_type").alias(f"f{n}")]
    own = as_registrant.filter("not registrant_is_firm").groupBy(*keys, *by(2)).agg(count.alias("c2"), F.sum("amount").alias("a2"))
    clients = links.exploded(r.filter("registrant_is_firm"), "client_ids", "year", "amount", "include_in_industry_totals", "filing_included_nsfs", "filing_type")
    client = clients.groupBy(*keys, *by(3)).agg(count.alias("c3"), F.sum("amount").alias("a3"))
    both = reduce(lambda a, b: a.join(b, keys, "full"), (as_lobbyist, firm, own, client))
    flags = [F.coalesce("i1", "i2", "i3", F.lit(False)).alias("include_in_industry_totals"), F.coalesce("s2", "s3", F.lit(False)).alias("include_nsfs"), F.coalesce("f2", "f3", F.lit("")).alias("filing_type")]
    return both.groupBy(*keys, *flags).agg(
        F.sum(F.coalesce("c0", "c1", "c2", "c3", F.lit(0))).alias("count"), F.sum(F.coalesce("a2", "a3", F.lit(0))).alias("non_firm_spending"), F.sum(F.coalesce("a1", F.lit(0))).alias("firm_income")
    )


FIGURES = ("count", "non_firm_spending", "firm_income")


def by_year_rolled_up(t: Tables) -> DataFrame:
    """Figures of entities with those of their children, and of industries and subindustries, by year.

    A child's filing counts for its parent if it is of type b, or if the parent filed for its children in that year (include_nsfs) or filed of type n.
    """
    meta = t["org_metadata"].select("entity_id", "cycle", "parent_entity_id", "industry_entity_id", "subindustry_entity_id")
    own = checkpointed(by_entity_year(t).withColumn("cycle", even_year(F.col("year"))).join(meta, ["entity_id", "cycle"], "left"))  # read five times
    files = own.filter("include_nsfs or filing_type = 'n'").select(F.col("entity_id").alias("parent_entity_id"), "year").distinct().withColumn("files", F.lit(True))
    child = own.filter("parent_entity_id is not null").join(files, ["parent_entity_id", "year"], "left").filter("filing_type = 'b' or files")
    up = own.select("entity_id", "year", *FIGURES).unionByName(child.select(F.col("parent_entity_id").alias("entity_id"), "year", *FIGURES))
    for c in ("industry_entity_id", "subindustry_entity_id"):
        up = up.unionByName(own.filter(f"{c} is not null and include_in_industry_totals").select(F.col(c).alias("entity_id"), "year", *FIGURES))
    return up.groupBy("entity_id", "year").agg(*[F.sum(c).alias(c) for c in FIGURES])


def by_cycle_rolled_up(t: Tables) -> DataFrame:
    return with_all_cycles(by_year_rolled_up(t).withColumn("cycle", even_year(F.col("year"))), ["entity_id"], {c: F.sum(c) for c in FIGURES})


# --- top lists: facts of an entity, what is listed, and how it is ordered

#: Clients of a report: organizations and their parents once, industries where the report counts for them.
CLIENTS = "concat(array_union(client_ids, parent_ids), if(coalesce(include_in_industry_totals, false), industry_ids, array()))"


def _facts(t: Tables, whose: str) -> DataFrame:
    """Reports of each client, firm or lobbyist: entity_id beside the report's columns."""
    r = reports(t)
    keep = ("transaction_id", "cycle", "amount", "registrant_name", "registrant_is_firm", "client_name", "client_ids", "registrant_ids")
    if whose == "lobbyist":
        return t["lobbyist"].select("id", "transaction_id").join(lobbyists(t), "id").drop("id").join(r.select(*keep), "transaction_id")
    return links.exploded(r, F.expr(CLIENTS) if whose == "client" else "registrant_ids", *keep)


def _with_issues(t: Tables, facts: DataFrame) -> DataFrame:
    return facts.join(t["issue"].select("id", "transaction_id", F.col("general_issue").alias("issue")), "transaction_id")


def _with_bills(t: Tables, facts: DataFrame) -> DataFrame:
    return _with_issues(t, facts).join(t["bill"], F.col("id") == F.col("issue_id"))


def _with_lobbyists(t: Tables, facts: DataFrame) -> DataFrame:
    who = t["lobbyist"].select("id", "transaction_id", F.upper("lobbyist_name").alias("lobbyist_name"))
    return facts.join(who.join(lobbyists(t).withColumnRenamed("entity_id", "lobbyist_entity"), "id", "left"), "transaction_id")


def _with_registrants(t: Tables, facts: DataFrame) -> DataFrame:
    return facts.withColumn("registrant_entity", F.explode_outer("registrant_ids"))


def _with_clients(t: Tables, facts: DataFrame) -> DataFrame:
    return facts.withColumn("client_entity", F.explode_outer("client_ids"))


_BY_AMOUNT = ("-amount", "-count")
#: List to whose it is, what is listed, its columns, its order, and which reports it leaves out.
LISTS = {
    "registrants_for_client": ("client", _with_registrants, ("registrant_name", "registrant_entity"), _BY_AMOUNT, "not registrant_is_firm"),
    "issues_for_client": ("client", _with_issues, ("issue",), ("-count", "issue"), None),
    "bills_for_client": ("client", _with_bills, BILL, ("-count", "bill_type", "bill_no", "congress_no", "bill_name"), None),
    "lobbyists_for_client": ("client", _with_lobbyists, ("lobbyist_name", "lobbyist_entity"), ("-count", "lobbyist_name"), None),
    "registrants_for_lobbyist": ("lobbyist", _with_registrants, ("registrant_name", "registrant_entity"), ("-count", "registrant_name"), None),
    "issues_for_lobbyist": ("lobbyist", _with_issues, ("issue",), ("-count", "issue"), None),
    "clients_for_lobbyist": ("lobbyist", _with_clients, ("client_name", "client_entity"), ("-count", "client_name"), None),
    "clients_for_registrant": ("registrant", _with_clients, ("client_name", "client_entity"), _BY_AMOUNT, None),
    "issues_for_registrant": ("registrant", _with_issues, ("issue",), ("-count", "issue"), None),
    "bills_for_registrant": ("registrant", _with_bills, BILL, ("-count", "bill_type", "bill_no", "congress_no", "bill_name"), None),
    "lobbyists_for_registrant": ("registrant", _with_lobbyists, ("lobbyist_name", "lobbyist_entity"), ("-count", "lobbyist_name"), None),
}


def top_list(t: Tables, name: str, n: int = TOP_N) -> DataFrame:
    """entity_id, cycle, what is listed, count and, where it orders the list, amount: the first n of each entity and cycle and of all cycles, ties at the end included.

    The list of a client's registrants takes reports whose registrant is not a firm, as the original does.
    """
    whose, what, columns, order, where = LISTS[name]
    facts = _facts(t, whose)
    facts = what(t, facts.filter(where) if where else facts)
    measures = {"count": F.count("*")} | ({"amount": F.sum("amount")} if order is _BY_AMOUNT else {})
    by = [F.desc_nulls_first(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in order]
    return top_n(with_all_cycles(facts, ["entity_id", *columns], measures), ["entity_id", "cycle"], by, n).drop("rank")


# --- issues and bills across the biggest organizations


def _topics(t: Tables, what: str) -> tuple[DataFrame, list[str]]:
    """Each report with its amount, biggest clients and topics, a topic once."""
    r = reports(t).select("transaction_id", "cycle", "amount", F.expr(BIGGEST).alias("biggest")).filter("size(biggest) > 0")
    keys = ["issue"] if what == "issues" else list(BILL_KEY)
    listed = t["issue"].select("id", "transaction_id", F.col("general_issue").alias("issue"))
    listed = listed if what == "issues" else listed.join(t["bill"], F.col("id") == F.col("issue_id"))
    return r.join(listed.select("transaction_id", *keys).distinct(), "transaction_id"), keys


def _sums() -> dict[str, Column]:
    return {"count": F.count("*"), "amount": F.sum("amount")}


def topics_across(t: Tables, what: str) -> DataFrame:
    """Issues or bills of all biggest organizations, ranked by amount and by count in each cycle and in all; no cycle's topics come together."""
    rows, keys = _topics(t, what)
    totals = with_all_cycles(rows, keys, _sums())
    return rank_within(rank_within(totals, ["cycle"], "amount", "rank_by_amount"), ["cycle"], "count", "rank_by_count")


def orgs_for_topics(t: Tables, what: str) -> DataFrame:
    """The biggest organizations of each issue or bill, ranked within it."""
    rows, keys = _topics(t, what)
    totals = with_all_cycles(links.exploded(rows, "biggest", *keys, "cycle", "amount", name="client_entity"), [*keys, "client_entity"], _sums())
    return rank_within(rank_within(totals, ["cycle", *keys], "amount", "rank_by_amount"), ["cycle", *keys], "count", "rank_by_count")


def top_orgs_for_top_topics(t: Tables, what: str, n: int = TOP_N) -> DataFrame:
    """The n largest topics of each cycle by amount, and the n largest organizations of each.

    Topics are cut first; organizations are added up and ranked only for those that are left.
    """
    rows, keys = _topics(t, what)
    totals = rank_within(with_all_cycles(rows, keys, _sums()), ["cycle"], "count", "topic_rank_by_count")
    best = top_n(totals, ["cycle"], [F.desc("amount")], n, "topic_rank_by_amount")
    best = best.withColumnsRenamed({"count": "topic_total_count", "amount": "topic_total_amount"})
    both = rows.withColumn("cycle", F.explode(F.array(F.col("cycle").cast("int"), F.lit(-1))))
    orgs = links.exploded(both.join(best.select("cycle", *keys), ["cycle", *keys], "left_semi"), "biggest", *keys, "cycle", "amount", name="id")
    orgs = orgs.groupBy(*keys, "cycle", "id").agg(F.count("*").alias("client_count"), F.sum("amount").alias("client_amount"))
    ranked = top_n(rank_within(orgs, ["cycle", *keys], "client_count", "client_rank_by_count"), ["cycle", *keys], [F.desc("client_amount")], n, "client_rank_by_amount")
    named = ranked.join(t["entity"].select("id", "name"), "id")
    return named.join(best, ["cycle", *keys])


