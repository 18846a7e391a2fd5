"""Parameterised look-ups over the warehouse's tables: top lists, single rows, breakdowns, summaries.

An endpoint names a table, its output fields, an order and what it filters by; `lookup` applies the request's parameters. Tables come as a dict of DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.cycles import ALL_CYCLES
from meridian.operators.ranking import checkpointed
from meridian.operators.rollup import summary
from meridian.plans import contributions as ct
from meridian.plans import elections as el
from meridian.plans import entity_metadata as em
from meridian.plans import lobbying as lb
from meridian.plans import public_records as pr

DEFAULT_LIMIT, DEFAULT_SUMMARY_CYCLE = 10, 2012
# Codes and the labels that look-ups give them.
PARTIES = {"R": "Republicans", "D": "Democrats"}
LEVELS = {"federal": "Federal", "state": "State"}
SEATS = {
    "state:judicial": "State Judicial", "state:lower": "State Lower House", "state:upper": "State Upper House", "state:governor": "Governor", "state:office": "State Office",
    "federal:house": "US House", "federal:senate": "US Senate", "federal:president": "President",
}
KINDS = {"P": "Politician", "C": "Committee"}
SOURCES = {"direct": "Org PAC", "indiv": "Org Individuals"}
GIFTS = {"org_pac": "Org PACs", "org_indiv": "Org Individuals", "indiv": "Unaffiliated Individuals"}
PLACES = {"in-state": "In-State", "out-of-state": "Out-of-State"}


@dataclass(frozen=True)
class Join:
    """A look-up table that an endpoint's rows are joined with: its columns come in, an inner join also cuts rows."""

    table: str
    left: str
    right: str
    columns: tuple[str, ...] = ()
    how: str = "left"
    where: str = "true"


@dataclass(frozen=True)
class Endpoint:
    table: str
    fields: dict[str, str]  # output name to column
    kind: str = "top"  # top, rank (ties at the end are kept), one, pie
    key: str | None = "entity_id"  # the column that the entity (party, area) of the route is compared with; None for lists over all entities
    order: tuple[str, ...] = ()  # `-column` is descending
    category: str = ""
    labels: dict[str, str] = field(default_factory=dict)
    default: str | None = None
    joins: tuple[Join, ...] = ()
    where: str = "true"
    sums: dict[str, str] = field(default_factory=dict)  # name to expression: rows are grouped by all fields that are none of these


def _top(table: str, order: tuple[str, ...], key: str | None = "entity_id", joins: tuple[Join, ...] = (), where: str = "true", kind: str = "top", sums: dict[str, str] | None = None, **fields: str) -> Endpoint:
    return Endpoint(table, fields, kind, key, order, joins=joins, where=where, sums=sums or {})


def _pie(table: str, category: str, labels: dict[str, str], default: str | None = None, key: str = "entity_id") -> Endpoint:
    return Endpoint(table, {}, "pie", key, (), category, labels, default)


_GIVEN = {"total_count": "total_count", "direct_count": "pacs_count", "employee_count": "indivs_count", "total_amount": "total_amount", "direct_amount": "pacs_amount", "employee_amount": "indivs_amount"}
_LARGEST = ("-total_amount", "-total_count")
_LATEST = (Join("politician_latest", "recipient_id", "entity_id", ("state", "party")),)
_NAMED = lambda *types, also="true": Join("entity", "entity_id", "id", ("name", "type"), "inner", "type in (" + ", ".join(f"'{t}'" for t in types) + f") and {also}")
_SHOWN = Join("industry_metadata", "entity_id", "entity_id", ("should_show_entity", "parent_industry_id"))
_AMOUNT = {"count": "count", "amount": "amount"}
_DOCKETS = {"agency": "agency", "docket": "docket", "year": "year", "count": "count", "title": "title"}
_TITLED = (Join("docket", "docket", "docket_id", ("title",), "inner"),)
_BILL = {c: c for c in ("bill_type", "bill_no", "congress_no", "bill_name", "count")}
_INDEXP = {c: c for c in ("candidate_id", "candidate_name", "spender_id", "spender_name", "election_type", "candidate_state", "candidate_district", "candidate_office", "candidate_party", "amount", "aggregate_amount", "support_oppose", "purpose", "payee", "filing_number", "amendment", "transaction_id", "image_number", "received_date")}
_BUNDLE_NAMES = {"recipient_name": "recipient_name", "recipient_id": "recipient_id", "firm_name": "firm_name", "firm_id": "firm_id", "lobbyist_name": "lobbyist_name", "lobbyist_id": "lobbyist_id"}
_TOTAL = {"total": "sum(amount)", "count": "count(*)"}
#: Route to endpoint.
ENDPOINTS = {
    # contributions
    "pol/contributors": _top("top_orgs_to_politician", _LARGEST, name="organization_name", id="organization_entity", **_GIVEN),
    "pol/contributors/industries": _top("top_industries_to_politician", ("-amount",), joins=(Join("industry_metadata", "industry_entity", "entity_id", ("should_show_entity",)),), name="industry", id="industry_entity", should_show_entity="coalesce(should_show_entity, true)", **_AMOUNT),
    "pol/contributors/industries_unknown": Endpoint("unknown_industries_to_politician", _AMOUNT, "one"),
    "pol/contributors/sectors": _top("politician_by_sector", ("-amount",), sector="sector", **_AMOUNT),
    "pol/contributors/local_breakdown": _pie("politician_by_in_state", "in_state", PLACES, "Unknown"),
    "pol/contributors/type_breakdown": _pie("politician_by_contributor_type", "contributor_type", {"I": "Individuals", "C": "PACs"}, "Unknown"),
    "indiv/recipient_pols": _top("individuals_to_candidates", _LARGEST, joins=_LATEST, recipient_name="recipient_name", recipient_entity="recipient_id", party="party", state="state", count="total_count", amount="total_amount"),
    "indiv/recipient_orgs": _top("individuals_to_pacs", _LARGEST, recipient_name="recipient_name", recipient_entity="recipient_id", count="total_count", amount="total_amount"),
    "indiv/recipients/party_breakdown": _pie("individual_by_party", "party", PARTIES, "Other"),
    "org/recipients": _top("orgs_to_candidates", _LARGEST, joins=_LATEST, name="recipient_name", id="recipient_id", party="party", state="state", **_GIVEN),
    "org/recipient_pacs": _top("orgs_to_pacs", _LARGEST, name="recipient_name", id="recipient_id", **_GIVEN),
    "org/recipients/party_breakdown": _pie("organization_by_party", "party", PARTIES, "Other"),
    "org/recipients/level_breakdown": _pie("organization_by_state_fed", "state_fed", LEVELS),
    "industry/orgs": _top("top_orgs_by_industry", _LARGEST, name="organization_name", id="organization_entity", **_GIVEN),
    "entity/totals": Endpoint("entity_totals", {c: c for c in ("contributor_count", "recipient_count", "contributor_amount", "recipient_amount")}, "one"),
    "pols/top": _top("entity_totals", ("-recipient_amount", "-recipient_count"), None, (_NAMED("politician"), Join("politician_latest", "entity_id", "entity_id", ("state", "party", "seat"))), name="name", id="entity_id", count="recipient_count", amount="recipient_amount", state="state", party="party", seat="seat"),
    "orgs/top": _top("entity_totals", ("-contributor_amount", "-contributor_count"), None, (_NAMED("organization"),), name="name", id="entity_id", count="contributor_count", amount="contributor_amount"),
    "indivs/top": _top("entity_totals", ("-contributor_amount", "-contributor_count"), None, (_NAMED("individual"),), name="name", id="entity_id", count="contributor_count", amount="contributor_amount"),
    "industries/top": _top("entity_totals", ("-contributor_amount", "-contributor_count"), None, (_NAMED("industry"), _SHOWN), "coalesce(should_show_entity, true) and parent_industry_id is null", name="name", id="entity_id", count="contributor_count", amount="contributor_amount", should_show_entity="coalesce(should_show_entity, true)"),
    "givers/top": _top("entity_totals", ("-contributor_amount", "-contributor_count"), None, id="entity_id", count="contributor_count", amount="contributor_amount"),
    "indivs/party/top": _top("individual_by_party", ("-amount", "-count"), "party", (_NAMED("individual"),), kind="rank", entity_id="entity_id", name="name", **_AMOUNT),
    "indivs/area/top": _top("individual_by_state_fed", ("-amount", "-count"), "state_fed", (_NAMED("individual"),), kind="rank", entity_id="entity_id", name="name", **_AMOUNT),
    "industries/party/top": _top("industry_by_party", ("-amount", "-count"), "party", (_NAMED("industry", also="lower(name) not like '%unknown%' and lower(name) not like '%retired%' and lower(name) not like '%self%' and lower(name) not like '%own campaign%'"), Join("industry_ids", "entity_id", "entity_id", (), "left_semi")), kind="rank", entity_id="entity_id", name="name", **_AMOUNT),
    # lobbying
    "org/registrants": _top("registrants_for_client", ("-amount",), registrant_name="registrant_name", registrant_entity="registrant_entity", **_AMOUNT),
    "org/issues": _top("issues_for_client", ("-count",), issue="issue", count="count"),
    "org/bills": _top("bills_for_client", ("-count",), **_BILL),
    "org/lobbyists": _top("lobbyists_for_client", ("-count",), lobbyist_name="lobbyist_name", lobbyist_entity="lobbyist_entity", count="count"),
    "indiv/registrants": _top("registrants_for_lobbyist", ("-count",), registrant_name="registrant_name", registrant_entity="registrant_entity", count="count"),
    "indiv/issues": _top("issues_for_lobbyist", ("-count",), issue="issue", count="count"),
    "indiv/clients": _top("clients_for_lobbyist", ("-count",), client_name="client_name", client_entity="client_entity", count="count"),
    "org/registrant/issues": _top("issues_for_registrant", ("-count",), issue="issue", count="count"),
    "org/registrant/bills": _top("bills_for_registrant", ("-count",), **_BILL),
    "org/registrant/clients": _top("clients_for_registrant", ("-amount",), client_name="client_name", client_entity="client_entity", **_AMOUNT),
    "org/registrant/lobbyists": _top("lobbyists_for_registrant", ("-count",), lobbyist_name="lobbyist_name", lobbyist_entity="lobbyist_entity", count="count"),
    "orgs/lobbying/top": _top("lobbying_by_cycle", ("-non_firm_spending",), None, (_NAMED("organization"),), "non_firm_spending > 0", name="name", entity_id="entity_id", amount="non_firm_spending"),
    "industries/lobbying/top": _top("lobbying_by_cycle", ("-non_firm_spending",), None, (_NAMED("industry"), Join("industry_ids", "entity_id", "entity_id", (), "left_semi")), "non_firm_spending > 0", name="name", entity_id="entity_id", amount="non_firm_spending"),
    "industries/lobbying/all": _top("lobbying_by_cycle", ("-non_firm_spending",), None, (_NAMED("industry"),), "non_firm_spending > 0", name="name", entity_id="entity_id", amount="non_firm_spending"),
    "orgs/lobbying_firms/top": _top("lobbying_by_cycle", ("-firm_income",), None, (_NAMED("organization", "individual", "politician", "industry"),), "firm_income > 0", name="name", entity_id="entity_id", amount="firm_income"),
    # bundled contributions
    "bundles/of_recipient": _top("bundling", ("-amount",), "recipient_id", (Join("entity", "recipient_id", "id", ("type",)),), sums={"amount": "sum(coalesce(amount, 0))"}, **_BUNDLE_NAMES, recipient_type="type"),
    "bundles/of_firm": _top("bundling", ("-amount",), "firm_id", (Join("entity", "recipient_id", "id", ("type",)),), sums={"amount": "sum(coalesce(amount, 0))"}, **_BUNDLE_NAMES, recipient_type="type"),
    "bundles/of_lobbyist": _top("bundling", ("-amount",), "lobbyist_id", (Join("entity", "recipient_id", "id", ("type",)),), sums={"amount": "sum(coalesce(amount, 0))"}, **_BUNDLE_NAMES, recipient_type="type"),
    "lobbyist_bundling/recipients": _top("bundling", ("-total",), None, sums=_TOTAL, recipient_name="recipient_name", recipient_id="recipient_id"),
    "lobbyist_bundling/firms": _top("bundling", ("-total",), None, sums=_TOTAL, firm_name="firm_name", firm_id="firm_id"),
    "lobbyist_bundling/transactions": _top("bundling", ("-total",), None, sums=_TOTAL, **_BUNDLE_NAMES),
    "indivs/lobbyist_bundlers/top": _top("bundling", ("-amount", "-count"), None, (Join("entity", "lobbyist_id", "id", ("name",), "inner"),), sums={"count": "count(*)", "amount": "sum(amount)"}, entity_id="lobbyist_id", name="name"),
    # spending, earmarks, enforcement, misconduct, advisory committees, regulations
    "org/fed_spending": _top("top_spending", ("-amount",), recipient_name="recipient_name", type="spending_type", fiscal_year="fiscal_year", agency_name="agency_name", description="description", amount="amount"),
    "pol/earmarks": _top("top_earmarks", ("-amount", "-fiscal_year"), fiscal_year="fiscal_year", amount="amount", description="description", members="array_join(members, ' ')", recipients="array_join(recipients, ' ')"),
    "pol/earmarks/local_breakdown": _pie("earmarks_local", "local", {**PLACES, "unknown": "Unknown"}),
    "org/epa_enforcement_actions": _top("top_enforcement", ("rank",), case_id="case_num", case_name="case_name", defendant_name="defendant_name", defendants_count="num_defendants", other_defendants="defendants", locations="locations", location_addresses="location_addresses", amount="penalty", year="year", date_significance="last_date_significance"),
    "org/contractor_misconduct": _top("top_misconduct", ("-penalty_amount", "-year"), "contractor_entity", year="year", date_significance="date_significance", contractor="contractor", penalty_amount="penalty_amount", contracting_party="contracting_party", instance="instance", disposition="disposition", misconduct_type="misconduct_type", misconduct_url="misconduct_url"),
    "org/faca": _top("advisory_records", ("-end_date",), committee="committee", start="start_date", end="end_date", affiliation="affiliation"),
    "org/regulations_text": _top("regulations_text", ("-count",), joins=_TITLED, **_DOCKETS),
    "org/regulations_submitter": _top("regulations_submitter", ("-count",), joins=_TITLED, **_DOCKETS),
    "orgs/regulations/submitters/top": _top("regulations_text_totals", ("-document_count",), None, (_NAMED("organization", also="lower(name) not in ('network', 'impact', 'member')"),), entity_id="entity_id", name="name", count="document_count"),
    # election filings and independent spending
    "pol/fec_summary": Endpoint("fec_candidate_summaries", {c: c for c in ("total_raised", "office", "total_receipts_rank", "total_disbursements_rank", "cash_on_hand_rank", "max_rank", "contributions_indiv", "contributions_pac", "contributions_party", "contributions_candidate", "transfers_in", "disbursements", "cash_on_hand", "date")}, "one"),
    "org/fec_summary": Endpoint("fec_committee_summaries", {c: c for c in (*el.COMMITTEE_SUMS, "first_filing_date", "last_filing_date", "num_committee_filings")}, "one"),
    "pol/fec_local_breakdown": _pie("fec_candidate_places", "local", {}),
    "pol/fec_itemized": _top("fec_candidate_itemized", ("-amount",), **{c: c for c in ("contributor_name", "date", "amount", "contributor_type", "transaction_type")}, organization="employer", **{c: c for c in ("occupation", "city", "state", "zipcode", "candidate_name", "party", "race", "status")}),
    "org/fec_top_contribs": _top("fec_top_contributors", ("-amount",), contributor_name="contributor_name", transaction_type="transaction_type", **_AMOUNT),
    "pols/office/top": _top("fec_by_office", ("rank",), "office", name="candidate_name", entity_id="entity_id", amount="total_receipts"),
    "pol/fec_timeline": _top("candidate_timeline", ("week",), week="week", count="count", amount="amount", cumulative="cumulative"),
    "pol/fec_indexp": _top("independent_spending", ("-amount",), "candidate_entity", committee_name="committee_name", committee_entity="committee_entity", support_oppose="support_oppose", amount="amount"),
    "org/fec_indexp": _top("independent_spending", ("-amount",), "committee_entity", candidate_name="candidate_name", candidate_entity="candidate_entity", support_oppose="support_oppose", amount="amount"),
    "pol/fec_indexp_itemized": _top("independent_spending_of_candidates", ("spender_name", "date", "-amount"), **_INDEXP),
    "org/fec_indexp_itemized": _top("independent_spending_of_committees", ("candidate_name", "date", "-amount"), **_INDEXP, date="date"),
    "orgs/indexp/top": _top("independent_spending_totals", ("-spending_amount",), None, (_NAMED("organization", "individual", "politician", "industry"),), name="name", entity_id="entity_id", amount="spending_amount"),
    "pols/indexp/top": _top("independent_spending", ("-total_amount",), "seat", (Join("entity", "candidate_entity", "id", ("name",), "inner"), Join("politician_latest", "candidate_entity", "entity_id", ("seat",), "inner", "seat in ('federal:house', 'federal:senate', 'federal:president')")), sums={
        "support_amount": "sum(if(lower(support_oppose) = 'support', amount, 0))", "oppose_amount": "sum(if(lower(support_oppose) = 'oppose', amount, 0))", "total_amount": "sum(if(lower(support_oppose) in ('support', 'oppose'), amount, 0))"}, entity_id="candidate_entity", name="name"),
}
#: Labels of each dimension's summary; the default gathers all other values.
SUMMARIES = {"party": (PARTIES, "Other"), "state_fed": (LEVELS, None), "seat": (SEATS, None), "recipient_type": (KINDS, None), "indiv_pac": (SOURCES, None), "in_state": (PLACES, None), "org_pac_indiv": (GIFTS, None)}


class NotFound(KeyError):
    pass


def _of_cycle(tables, e: Endpoint, cycle: int) -> DataFrame:
    df = tables[e.table]
    if "cycle" in df.columns and not (e.sums and cycle == ALL_CYCLES):  # rows that are summed here have no row for all cycles
        df = df.filter(F.col("cycle") == cycle)
    return df


def _rows(tables, e: Endpoint, cycle: int, key=None, df: DataFrame | None = None) -> DataFrame:
    """An endpoint's rows with its fields, _key and _0, _1 and so on to order by. Filters go down to the scans, so only the asked entity's and cycle's rows are read.

    df: the cycle's rows of the endpoint's table, where they are computed already.
    """
    df = _of_cycle(tables, e, cycle) if df is None else df
    for i, j in enumerate(e.joins):
        other = tables[j.table].filter(j.where).select(F.col(j.right).alias(f"_on{i}"), *j.columns)
        df = df.drop(*[c for c in j.columns if c not in (j.left, e.key)]).join(other, F.col(j.left) == F.col(f"_on{i}"), j.how).drop(f"_on{i}")
    df = df.filter(e.where)
    if key is not None:
        df = df.filter(F.col(e.key) == F.lit(key))
    own = F.col(e.key) if e.key else F.lit(None).cast("long")
    if e.kind == "pie":
        known = F.create_map(*[F.lit(x) for kv in e.labels.items() for x in kv])[F.col(e.category)] if e.labels else F.lit(None).cast("string")
        label = F.coalesce(known, F.lit(e.default) if e.default else F.col(e.category))
        return df.groupBy(own.alias("_key"), label.alias("category")).agg(F.sum("count").alias("count"), F.sum("amount").alias("amount"))
    if e.sums:
        df = df.groupBy(own.alias("_key"), *[F.expr(c).alias(n) for n, c in e.fields.items()]).agg(*[F.expr(x).alias(n) for n, x in e.sums.items()])
    else:
        df = df.select("*", own.alias("_key"))
    columns = {n: n for n in (*e.fields, *e.sums)} if e.sums else e.fields
    order = [F.col(c.lstrip("-")).alias(f"_{i}") for i, c in enumerate(e.order)]
    return df.select("_key", *[F.expr(c).alias(n) for n, c in columns.items()], *order)


def _ordered(e: Endpoint, names: list[str], ties: bool = True) -> list[Column]:
    order = [F.col(f"_{i}").desc_nulls_last() if c.startswith("-") else F.col(f"_{i}").asc_nulls_last() for i, c in enumerate(e.order)]
    return order + ([F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])] if ties else [])


def lookup(tables: Mapping[str, DataFrame], route: str, entity_id=None, cycle: int = ALL_CYCLES, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Rows of an endpoint for one entity (or party, area: what its key is); ties go by the fields as text. A null entity finds nothing where the route needs one."""
    if route not in ENDPOINTS:
        raise NotFound(route)
    e = ENDPOINTS[route]
    if e.key and entity_id is None:
        raise ValueError(f"{route} needs its {e.key}")
    df = _rows(tables, e, cycle, entity_id if e.key else None)
    if e.kind == "pie":
        return df.drop("_key")
    names = [*e.fields, *e.sums]
    if e.kind == "one":
        return df.select(*names).limit(1)
    if e.kind == "rank":
        return df.withColumn("rank", F.rank().over(Window.partitionBy("_key").orderBy(*_ordered(e, names, ties=False)))).filter(F.col("rank") <= limit).select(*names, "rank")
    return df.orderBy(*_ordered(e, names)).limit(limit).select(*names)


def bulk(tables: Mapping[str, DataFrame], routes: list[str], cycle: int = ALL_CYCLES, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The responses of routes for every entity at once: route, entity, position (rank, for lists that keep ties; null for breakdowns and single rows), and fields, a map of text.

    Each entity's first rows are cut in every partition before they are dealt. Lists over all entities have a null entity. A table that is built here and that several routes read is
    computed once and kept in the shared folder.
    """
    out, built = [], [e.table for e in map(ENDPOINTS.get, routes) if e.table in BUILDERS and e.table not in tables]
    kept = {(e.table, bool(e.sums)): None for e in map(ENDPOINTS.get, routes) if built.count(e.table) > 1}
    for route in routes:
        e = ENDPOINTS[route]
        at = e.table, bool(e.sums)
        if at in kept and kept[at] is None:
            kept[at] = checkpointed(_of_cycle(tables, e, cycle))
        df = _rows(tables, e, cycle, df=kept.get(at))
        names = ["category", "count", "amount"] if e.kind == "pie" else [*e.fields, *e.sums]
        if e.kind in ("top", "rank"):
            number = F.row_number() if e.kind == "top" else F.rank()
            df = df.filter("_key is not null") if e.key else df
            df = df.withColumn("position", number.over(Window.partitionBy("_key").orderBy(*_ordered(e, names, e.kind == "top")))).filter(F.col("position") <= limit)
        else:
            df = df.withColumn("position", F.lit(None).cast("int"))
        fields = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])
        out.append(df.select(F.lit(route).alias("route"), F.col("_key").cast("string").alias("entity"), F.col("position").cast("int").alias("position"), fields.alias("fields")))
    return reduce(DataFrame.unionByName, out)


def summarise(ranked_summary: DataFrame, by: str, cycle: int = DEFAULT_SUMMARY_CYCLE, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """A summary table's cycle as labelled totals with the largest members of each value.

    Totals are repeated on every row of the table; each value's are taken once. Values outside the labels go to the default, if there is one.
    """
    labels, default = SUMMARIES[by]
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col(by)]
    rows = ranked_summary.filter(F.col("cycle") == cycle).withColumn("name", F.coalesce(known, F.lit(default) if default else F.col(by)))
    once = rows.select("name", by, "total_count", "total_amount").distinct().groupBy("name").agg(F.sum("total_count").alias("count"), F.sum("total_amount").alias("amount"))
    children = rows.select("name", F.col("entity_id").alias("id"), F.col("amount").alias("given"))
    return summary(once, children, "name", ["id"], "given", limit).orderBy(F.desc("amount"))


def summary_rows(t: Mapping[str, DataFrame], group: str) -> DataFrame:
    """All summaries of a group in every cycle: dimension, cycle, name (the label), count and amount over the whole group, and its largest members with position, entity_id, given.

    A value without a label keeps its name, or goes to the dimension's default, whose members of all such values are the ten largest together.
    """
    out = []
    for by in ct.BY[group]:
        labels, default = SUMMARIES[by]
        known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col(by)]
        rows = ct.summary(t, group, by).withColumn("name", F.coalesce(known, F.lit(default) if default else F.col(by)))
        once = rows.groupBy("cycle", "name", by).agg(F.first("total_count").alias("c"), F.first("total_amount").alias("a")).groupBy("cycle", "name").agg(F.sum("c").alias("count"), F.sum("a").alias("amount"))
        place = F.row_number().over(Window.partitionBy("cycle", "name").orderBy(F.desc("amount"), "entity_id", by))
        children = rows.withColumn("position", place)
        children = children.filter((F.col("name") != default) | (F.col("position") <= DEFAULT_LIMIT)) if default else children
        out.append(once.join(children.select("cycle", "name", "position", "entity_id", F.col("amount").alias("given")), ["cycle", "name"]).select(F.lit(by).alias("dimension"), "cycle", "name", "count", "amount", "position", "entity_id", "given"))
    return reduce(DataFrame.unionByName, out)


def pairwise(contributions: DataFrame, givers: DataFrame, receivers: DataFrame, giver_id, receiver_id, cycle: int = ALL_CYCLES) -> DataFrame:
    """What one entity gave to another: both link tables as semi joins."""
    if cycle != ALL_CYCLES:
        contributions = contributions.filter(F.col("cycle") == cycle)
    one = lambda links, i: links.filter(F.col("entity_id") == F.lit(i)).select("transaction_id")
    rows = contributions.join(one(givers, giver_id), "transaction_id", "left_semi").join(one(receivers, receiver_id), "transaction_id", "left_semi")
    return rows.agg(F.sum("amount").alias("amount"), F.count("*").alias("count"))


# --- the warehouse that look-ups read


def _ids(t, namespace: str, name: str) -> DataFrame:
    return t["attribute"].filter(F.col("namespace") == namespace).select("entity_id", F.col("value").alias(name))


BUILDERS: dict[str, Callable[[Mapping[str, DataFrame]], DataFrame]] = {
    "orgs_to_candidates": lambda t: ct.top_recipients(t, "organization", "candidates"), "orgs_to_pacs": lambda t: ct.top_recipients(t, "organization", "pacs"),
    "individuals_to_candidates": lambda t: ct.top_recipients(t, "individual", "candidates"), "individuals_to_pacs": lambda t: ct.top_recipients(t, "individual", "pacs"),
    "top_orgs_to_politician": ct.top_orgs_to_politician, "top_industries_to_politician": ct.top_industries_to_politician, "unknown_industries_to_politician": ct.unknown_industries_to_politician,
    "top_orgs_by_industry": ct.top_orgs_by_industry, "entity_totals": ct.entity_totals,
    **{f"politician_by_{by}": lambda t, by=by: ct.politician_sources(t, by) for by in ("sector", "contributor_type", "in_state")},
    **{f"{who}_by_{by}": lambda t, who=who, by=by: ct.aggregate(t, who, by) for who in ("organization", "individual", "industry") for by in ("party", "state_fed")},
    "politician_latest": lambda t: em.latest_cycle(t["politician_state"]), "industry_ids": lambda t: _ids(t, "urn:crp:industry", "value").select("entity_id").distinct(),
    **{name: lambda t, name=name: lb.top_list(t, name) for name in lb.LISTS}, "lobbying_by_cycle": lb.by_cycle_rolled_up,
    "bundling": pr.bundling, "top_spending": pr.top_spending, "top_earmarks": pr.top_earmarks, "earmarks_local": pr.earmarks_local, "top_enforcement": pr.top_enforcement, "top_misconduct": pr.top_misconduct,
    **{f"regulations_{k}": lambda t, k=k: pr.top_dockets(t, k) for k in ("text", "submitter")}, "regulations_text_totals": lambda t: pr.docket_totals(t, "text"),
    "fec_candidate_summaries": el.candidate_summaries, "fec_committee_summaries": el.committee_summaries, "fec_candidate_places": el.candidate_places, "fec_candidate_itemized": lambda t: el.candidate_itemized(t).join(_ids(t, "urn:fec:candidate", "candidate_id"), "candidate_id"),
    "fec_top_contributors": el.top_contributors, "fec_by_office": el.by_office, "independent_spending": el.independent_spending, "independent_spending_totals": el.independent_totals,
    "independent_spending_of_candidates": lambda t: el.of_candidates(t), "independent_spending_of_committees": lambda t: el.of_committees(t),
}


class Warehouse(dict):
    """Tables by name; those that are not there are built from the others when they are first asked for."""

    def __missing__(self, name: str) -> DataFrame:
        if name not in BUILDERS:
            raise NotFound(name)
        self[name] = BUILDERS[name](self)
        return self[name]
