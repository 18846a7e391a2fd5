"""Spending, enforcement, misconduct, earmarks, regulations and bundled contributions: links of their records to entities, totals and top lists.

Each record set is read once, with its links as arrays of entity ids beside the record; totals and lists explode those that they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.cycles import even_year, odd_down, semi_annual
from meridian.functions.text import standard_orgname
from meridian.operators import links
from meridian.operators.ranking import first_row, top_n
from meridian.operators.rollup import repeat_for_all_cycles, with_all_cycles

TOP_N = 10
Tables = dict[str, DataFrame]

# --- spending

#: Smaller grants and contracts are not linked.
LEAST_SPENDING = 1_000_000
_LOAN = "asst_cat_type in ('l', 'i')"
KINDS_OF_SPENDING = {"grant": "g", "contract": "c", "loan": "l"}


def grant_records(t: Tables) -> DataFrame:
    """Grants and loans: a loan's amount is its face value, a grant's the federal funding."""
    g = t["grant"]
    kind = F.when(F.expr(_LOAN), "l").otherwise("g")
    amount = F.when(F.expr(_LOAN), F.col("face_loan_guran")).otherwise(F.col("fed_funding_amount"))
    return g.select("id", "recipient_name", even_year(F.col("fiscal_year")).alias("cycle"), kind.alias("spending_type"), "fiscal_year", "agency_name", F.col("project_description").alias("description"), amount.alias("amount"))


def contract_records(t: Tables) -> DataFrame:
    c, agencies = t["contract"], t["agency"].select(F.col("id").alias("agencyid"), F.col("name").alias("_agency"))
    c = c.join(agencies, "agencyid", "left")
    return c.select("id", F.col("vendorname").alias("recipient_name"), even_year(F.col("fiscal_year")).alias("cycle"), F.lit("c").alias("spending_type"), "fiscal_year", F.coalesce("_agency", F.lit("")).alias("agency_name"), F.col("descriptionofcontractrequirement").alias("description"), F.col("obligatedamount").alias("amount"))


def spending_linked(t: Tables) -> DataFrame:
    """Grants, loans and contracts of a million and more with the organizations of equal standard name, each once."""
    if "spending_linked" in t:
        return t["spending_linked"]
    rows = grant_records(t).unionByName(contract_records(t)).filter(F.col("amount") >= LEAST_SPENDING)
    return links.with_ids(rows, links.aliases(t, key=standard_orgname, distinct=True), standard_orgname(F.col("recipient_name")), "entity_ids", "id")


def spending_links(t: Tables, kind: str) -> DataFrame:
    """entity_id, transaction_id of grants (with loans) or contracts."""
    rows = spending_linked(t).filter("spending_type = 'c'" if kind == "contract" else "spending_type <> 'c'")
    return links.exploded(rows, "entity_ids", "id").withColumnRenamed("id", "transaction_id")


def spending_totals(t: Tables) -> DataFrame:
    """Counts and amounts of grants, contracts and loans of each entity, per cycle and in all: conditional sums where branches would be joined in full."""
    rows, measures = links.exploded(spending_linked(t), "entity_ids", "cycle", "amount", "spending_type"), {}
    for name, code in KINDS_OF_SPENDING.items():
        hit = F.col("spending_type") == code
        measures |= {f"{name}_count": F.count_if(hit), f"{name}_amount": F.coalesce(F.sum(F.when(hit, F.col("amount"))), F.lit(0))}
    return with_all_cycles(rows, ["entity_id"], measures)


def top_spending(t: Tables, n: int = TOP_N) -> DataFrame:
    """The n largest grants, loans and contracts of each entity and cycle, and of all cycles."""
    rows = links.exploded(spending_linked(t), "entity_ids", "recipient_name", "spending_type", "cycle", "fiscal_year", "agency_name", "description", "amount")
    return top_n(repeat_for_all_cycles(rows), ["entity_id", "cycle"], [F.desc("amount")], n).drop("rank")


# --- enforcement

#: The kinds of penalties that are added up, and those that are only shown.
PENALTIES = ("enfccaa", "enfcraa", "enfotpa", "enfotsa")
SHOWN = ("enfops", *PENALTIES, "enfcslp")


def _texts(parts: list[str | Column]) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _listed(value: Column, by: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(value)), by)


def enforcement_actions(t: Tables) -> DataFrame:
    """Each case with first and last milestone, penalties, defendants and places: one grouped join for each child table. Of milestones of one day the least significance is named."""
    c = F.col
    cases = t["case"].groupBy("activity_id", c("enfocnu").alias("case_num")).agg(F.max("enfornm").alias("case_name"))
    first, last = F.struct(c("subacad"), c("subacty")), F.struct(F.datediff(F.lit("2200-01-01"), "subacad").alias("d"), c("subacty"))
    known = t["milestone"].filter("subacad is not null")
    stones = known.groupBy("activity_id").agg(
        F.min("subacad").alias("first_date"), F.max("subacad").alias("last_date"), F.min(first)["subacty"].alias("first_date_significance"), F.min(last)["subacty"].alias("last_date_significance")
    )
    zero = lambda p: F.coalesce(p, F.lit(0))
    total = sum((zero(p) for p in PENALTIES[1:]), zero(PENALTIES[0]))
    fines = t["penalty"].groupBy("activity_id").agg(F.sum(total).alias("penalty"), *[F.sum(zero(p)).alias(f"penalty_{p}") for p in SHOWN])
    people = t["defendant"].groupBy("activity_id").agg(F.countDistinct("defennm").alias("num_defendants"), _listed(c("defennm"), ", ").alias("defendants"))
    places = t["facility"].groupBy("activity_id").agg(
        _listed(_texts([c("fcltcit"), ", ", c("fcltstc")]), "; ").alias("locations"),
        _listed(_texts([c("fcltyad"), ", ", c("fcltcit"), ", ", c("fcltstc"), " ", c("fcltpst")]), "; ").alias("location_addresses"),
    )
    for child in (stones, fines, people, places):
        cases = cases.join(child, "activity_id", "left")
    return cases.withColumn("num_defendants", F.coalesce("num_defendants", F.lit(0)))


def relevant_actions(t: Tables, after: int = 2000, least: int = 1_000_000) -> DataFrame:
    """Actions that began after a year and cost more than an amount, by the cycle of their last day."""
    return enforcement_actions(t).filter((F.year("first_date") > after) & (F.col("penalty") > least)).withColumn("cycle", even_year(F.year("last_date")))


def enforcement_links(t: Tables) -> DataFrame:
    """activity_id, case_num, defendant_name, entity_id: defendants whose mapped organization, or its ultimate parent, is named like an entity."""
    names = t["org_map"].select("defendant_name", F.explode(F.array("org_name", "ultorg_name")).alias("name")).distinct()
    known = names.join(t["entity"].select("id", "name"), "name").select(F.col("id").alias("entity_id"), "defendant_name").distinct()
    found = t["defendant"].select("activity_id", F.col("defennm").alias("defendant_name")).distinct().join(known, "defendant_name")
    return found.join(relevant_actions(t).select("activity_id", "case_num"), "activity_id").groupBy("activity_id", "case_num", "entity_id").agg(F.max("defendant_name").alias("defendant_name"))


def enforcement_totals(t: Tables) -> DataFrame:
    rows = relevant_actions(t).select("activity_id", "cycle", "penalty").join(enforcement_links(t), "activity_id")
    return with_all_cycles(rows, ["entity_id"], {"count": F.count("*"), "amount": F.sum("penalty")})


def top_enforcement(t: Tables, n: int = TOP_N) -> DataFrame:
    """The n actions of each entity, by cycle and in all: those with one defendant by penalty, then the others, the larger their penalty the earlier."""
    keep = ("case_num", "case_name", "num_defendants", "defendants", "locations", "location_addresses", "penalty", "last_date_significance")
    rows = relevant_actions(t).select(*keep, "cycle", F.year("last_date").alias("year")).join(enforcement_links(t).select("case_num", "defendant_name", "entity_id"), "case_num")
    weight = F.when(F.col("num_defendants") == 1, F.col("penalty").cast("double")).otherwise(-1.0 / F.col("penalty").cast("double"))
    return top_n(repeat_for_all_cycles(rows), ["entity_id", "cycle"], [weight.desc()], n)


# --- misconduct of contractors


def misconduct_links(t: Tables) -> DataFrame:
    """entity_id, misconduct_id, by the contractor's outside id."""
    ids = t["attribute"].filter("namespace = 'urn:pogo:contractor'").select("entity_id", F.col("value").try_cast("int").alias("contractor_ext_id"))
    contractors = t["contractor"].select(F.col("id").alias("contractor_id"), "contractor_ext_id").join(ids, "contractor_ext_id").select("contractor_id", "entity_id")
    return t["misconduct"].select(F.col("id").alias("misconduct_id"), "contractor_id").join(contractors, "contractor_id").select("entity_id", "misconduct_id").distinct()


def _misconduct(t: Tables) -> DataFrame:
    rows = t["misconduct"].withColumn("cycle", even_year(F.col("date_year"))).withColumnRenamed("id", "misconduct_id")
    return rows.join(misconduct_links(t).join(t["entity"].select(F.col("id").alias("entity_id")), "entity_id"), "misconduct_id")


def misconduct_totals(t: Tables) -> DataFrame:
    return with_all_cycles(_misconduct(t), ["entity_id"], {"count": F.count("*"), "amount": F.sum("penalty_amount")})


def top_misconduct(t: Tables, n: int = TOP_N) -> DataFrame:
    """The n costliest instances of each contractor: in a cycle instances of equal cost follow each other by name, in all they share a rank."""
    names = t["contractor"].select(F.col("id").alias("contractor_id"), F.col("name").alias("contractor"))
    rows = repeat_for_all_cycles(_misconduct(t).join(names, "contractor_id"))
    tie = F.when(F.col("cycle") > 0, F.col("instance"))
    best = top_n(rows, ["entity_id", "cycle"], [F.desc_nulls_first("penalty_amount"), tie.asc_nulls_last()], n)
    return best.select("cycle", F.col("date_year").alias("year"), "date_significance", F.col("entity_id").alias("contractor_entity"), "contractor", "contracting_party", "penalty_amount", "instance", "disposition", "misconduct_type", F.col("url").alias("misconduct_url"))


# --- earmarks


def earmarks_by_cycle(t: Tables) -> DataFrame:
    """Earmarks that are not the president's, by even cycle: an odd fiscal year counts with the year before."""
    return t["earmark"].filter("presidential = ''").withColumn("cycle", odd_down(F.col("fiscal_year")))


def earmark_members(t: Tables) -> DataFrame:
    """entity_id, member_id, earmark_id, by the member's id in campaign records."""
    ids = t["attribute"].filter("namespace = 'urn:crp:recipient'").select("entity_id", F.col("value").alias("crp_id"))
    return t["earmark_member"].select(F.col("id").alias("member_id"), "earmark_id", "crp_id").join(ids, "crp_id").select("entity_id", "member_id", "earmark_id")


def earmark_recipients(t: Tables) -> DataFrame:
    """entity_id, recipient_id, earmark_id: organizations named like the recipient."""
    orgs = t["entity"].filter("type = 'organization'").select(F.col("id").alias("entity_id"), F.col("name").alias("standardized_recipient"))
    return t["earmark_recipient"].select(F.col("id").alias("recipient_id"), "earmark_id", "standardized_recipient").join(orgs, "standardized_recipient").select("entity_id", "recipient_id", "earmark_id")


def members_with_metadata(t: Tables) -> DataFrame:
    """Members with the state, seat and party of their entity's latest cycle, or as the earmark has them."""
    m = t["earmark_member"].withColumnRenamed("id", "member_id").join(earmark_members(t).drop("earmark_id"), "member_id", "left")
    meta = first_row(t["politician_state"], ["entity_id"], [F.col("cycle")]).select("entity_id", *[F.col(c).alias(f"_{c}") for c in ("state", "seat", "party")])
    m = m.join(meta, "entity_id", "left")
    return m.select("earmark_id", "member_id", "entity_id", F.col("standardized_name").alias("name"), F.coalesce("_state", "state").alias("state"), F.coalesce("_seat", "chamber").alias("seat"), F.coalesce("_party", "party").alias("party"))


def _quoted(**fields: Column) -> Column:
    """A small object as text, as look-ups print it; null where a field is."""
    parts: list[str | Column] = []
    for i, (k, v) in enumerate(fields.items()):
        parts += [("{" if not i else "") + f'"{k}":"', v, '"}' if i == len(fields) - 1 else '", ']
    return _texts(parts)


def earmarks_flattened(t: Tables) -> DataFrame:
    """Earmarks with their members and recipients as arrays of printed objects, in order; an earmark without any has empty arrays."""
    ident = F.coalesce(F.col("entity_id").cast("string"), F.lit(""))
    listed = lambda df, row, name: df.select("earmark_id", row.alias("_x")).groupBy("earmark_id").agg(F.array_sort(F.collect_list("_x")).alias(name))
    members = listed(members_with_metadata(t), _quoted(name=F.col("name"), id=ident, party=F.col("party"), state=F.col("state")), "members")
    r = t["earmark_recipient"].withColumnRenamed("id", "recipient_id").join(earmark_recipients(t).drop("earmark_id"), "recipient_id", "left")
    name = F.when(F.col("standardized_recipient") != "", F.col("standardized_recipient")).otherwise(F.col("raw_recipient"))
    recipients = listed(r, _quoted(name=name, id=ident), "recipients")
    e = earmarks_by_cycle(t).select(F.col("id").alias("earmark_id"), "cycle", "fiscal_year", "final_amount", "description")
    none = F.array().cast("array<string>")
    return e.join(members, "earmark_id", "left").join(recipients, "earmark_id", "left").withColumns({c: F.coalesce(c, none) for c in ("members", "recipients")})


def _earmark_entities(t: Tables) -> DataFrame:
    """entity_id, earmark_id, kind: members and recipients."""
    return earmark_members(t).select("entity_id", "earmark_id", F.lit("member").alias("kind")).unionByName(earmark_recipients(t).select("entity_id", "earmark_id", F.lit("recipient").alias("kind")))


def earmark_totals(t: Tables) -> DataFrame:
    """Count and amount of each entity's earmarks, as member and as recipient apart within a cycle and together in all."""
    e = earmarks_by_cycle(t).select(F.col("id").alias("earmark_id"), "cycle", "final_amount").join(_earmark_entities(t), "earmark_id")
    measures = {"count": F.count("*"), "amount": F.sum("final_amount")}
    per = e.groupBy("entity_id", "cycle", "kind").agg(*[m.alias(n) for n, m in measures.items()]).drop("kind")
    every = per.groupBy("entity_id").agg(F.lit(-1).alias("cycle"), F.sum("count").alias("count"), F.sum("amount").alias("amount"))
    return per.unionByName(every)


def top_earmarks(t: Tables, n: int = TOP_N) -> DataFrame:
    """The n largest earmarks of each entity with their members and recipients. Only those are flattened."""
    e = earmarks_by_cycle(t).select(F.col("id").alias("earmark_id"), "cycle", F.col("final_amount").alias("amount")).join(_earmark_entities(t), "earmark_id")
    part = F.when(F.col("cycle") > 0, F.col("kind"))  # a cycle's are ranked as member and as recipient apart
    best = top_n(repeat_for_all_cycles(e).withColumn("kind", part), ["entity_id", "cycle", "kind"], [F.desc("amount")], n).drop("kind", "rank")
    return best.join(earmarks_flattened(t).select("earmark_id", "fiscal_year", "description", "members", "recipients"), "earmark_id")


def earmarks_local(t: Tables) -> DataFrame:
    """Members' earmarks for places in their state, outside, or nowhere known."""
    places = t["earmark_location"].groupBy("earmark_id").agg(F.collect_set("state").alias("states"), F.lit(True).alias("placed"))
    e = earmarks_by_cycle(t).select(F.col("id").alias("earmark_id"), "cycle", "final_amount").join(members_with_metadata(t), "earmark_id").join(places, "earmark_id", "left")
    local = F.when(F.col("placed").isNull(), "unknown").when(F.array_contains("states", F.col("state")), "in-state").otherwise("out-of-state")
    return with_all_cycles(e.withColumn("local", local), ["entity_id", "local"], {"count": F.count("*"), "amount": F.sum("final_amount")})


# --- regulations: documents that mention an entity, and those that it submitted


def document_matches(t: Tables, kind: str) -> DataFrame:
    """document_id, entity_id of people and organizations, each pair once. kind: text or submitter."""
    return t[f"{kind}_match"].select("document_id", "entity_id").distinct().join(links.typed(t, "individual", "organization"), "entity_id").select("document_id", "entity_id")


def _dockets(t: Tables, kind: str) -> DataFrame:
    docs = t["comment"].select("document_id", "docket_id").join(document_matches(t, kind), "document_id").join(t["docket"].select("docket_id", "title", "agency", "year"), "docket_id")
    return docs.groupBy("entity_id", "docket_id", *(["title"] if kind == "text" else []), "agency", "year").agg(F.count("*").alias("count"))


def top_dockets(t: Tables, kind: str, n: int = TOP_N) -> DataFrame:
    """The dockets with most documents of each entity, in the docket's cycle and in all."""
    rows = repeat_for_all_cycles(_dockets(t, kind).withColumn("cycle", even_year(F.col("year"))))
    return top_n(rows, ["entity_id", "cycle"], [F.desc("count")], n).select("entity_id", "cycle", "agency", F.col("docket_id").alias("docket"), "year", "count")


def docket_totals(t: Tables, kind: str, since: int = 1989) -> DataFrame:
    """Dockets and documents of each entity; cycles begin with a year, the total does not."""
    rows = _dockets(t, kind).withColumn("cycle", even_year(F.col("year")))
    rows = rows.withColumn("cycle", F.explode(F.when(F.col("year") >= since, F.array("cycle", F.lit(-1))).otherwise(F.array(F.lit(-1)))))
    return rows.groupBy("entity_id", "cycle").agg(F.countDistinct("docket_id").alias("docket_count"), F.sum("count").alias("document_count"))


# --- bundled contributions


def latest_bundles(t: Tables) -> DataFrame:
    """The filing in force of each committee and half-year: of amended ones that with the latest end, then the latest filed, then the greatest number."""
    b = t["bundle"].withColumn("half", semi_annual(F.col("end_date")))
    return first_row(b, ["committee_fec_id", "half"], [F.col("end_date"), F.col("filing_date"), F.col("file_num")]).drop("half")


def bundle_recipients(t: Tables) -> DataFrame:
    """file_num, entity_id: the recipient of the committee in the report's cycle."""
    c = t["bundle_committee"].select(F.col("committee_id").alias("committee_fec_id"), F.col("cycle").alias("_cycle"), "recipient_id")
    ids = t["attribute"].filter("namespace in ('urn:crp:recipient', 'urn:fec:committee')").select("entity_id", F.col("value").alias("recipient_id"))
    b = latest_bundles(t).select("file_num", "committee_fec_id", even_year(F.col("report_year")).alias("_cycle"))
    return b.join(c, ["committee_fec_id", "_cycle"]).join(ids, "recipient_id").select("file_num", "entity_id")


def bundler_links(t: Tables, kind: str) -> DataFrame:
    """bundle_id, entity_id, each once. kind: firm (an organization by the bundler's name or employer) or lobbyist (a person by name)."""
    found = t["bundler_match"].join(links.typed(t, "organization" if kind == "firm" else "individual"), "entity_id").select("name", "entity_id").distinct()
    b = t["lobbyist_bundle"].join(latest_bundles(t).select("file_num"), "file_num", "left_semi").select(F.col("id").alias("bundle_id"), "name", "employer")
    names = F.array_distinct(F.array("name", "employer")) if kind == "firm" else F.array("name")
    return b.select("bundle_id", F.explode(names).alias("name")).join(found, "name").select("bundle_id", "entity_id").distinct()


def bundles_denormalized(t: Tables) -> DataFrame:
    """Bundlers of filings in force with recipient, lobbyist and firm; a half-year's amount of 0 is none.

    Filings in force are found once, with their committee's recipients; bundlers are read and dealt by filing once, and carry their lobbyists and firms as arrays.
    """
    b = latest_bundles(t).select("file_num", "committee_name", "committee_fec_id", "report_year", "report_type", "start_date", "end_date", "pdf_url", even_year(F.col("report_year")).alias("_cycle"))
    ids = t["attribute"].filter("namespace in ('urn:crp:recipient', 'urn:fec:committee')").select("entity_id", F.col("value").alias("recipient_id"))
    c = t["bundle_committee"].select(F.col("committee_id").alias("committee_fec_id"), F.col("cycle").alias("_cycle"), "recipient_id").join(ids, "recipient_id")
    b = b.join(c.groupBy("committee_fec_id", "_cycle").agg(F.collect_list("entity_id").alias("_recipients")), ["committee_fec_id", "_cycle"], "left").drop("_cycle")
    l = t["lobbyist_bundle"].withColumn("semi_annual_amount", F.when(F.col("semi_annual_amount") != 0, F.col("semi_annual_amount")))  # noqa: E741
    rows = b.join(l.withColumnsRenamed({"id": "bundle_id", "name": "bundler_name", "employer": "bundler_employer", "amount": "period_amount"}), "file_num")
    columns = ["bundle_id", "file_num", *[x for x in rows.columns if x not in ("bundle_id", "file_num", "_recipients")]]
    firms, people = (links.lookup(t["bundler_match"].join(links.typed(t, kind), "entity_id"), F.col("name"), distinct=True) for kind in ("organization", "individual"))
    for found, key, into in ((people, "bundler_name", "_lobbyists"), (firms, "bundler_name", "_by_name"), (firms, "bundler_employer", "_by_employer")):
        rows = links.with_ids(rows, found, F.col(key), into, "bundle_id")
    rows = rows.withColumn("_firms", F.array_union("_by_name", "_by_employer"))
    for who, ids in (("recipient", "_recipients"), ("lobbyist", "_lobbyists"), ("firm", "_firms")):
        rows = rows.withColumn(f"{who}_id", F.explode_outer(ids))
        rows = rows.join(t["entity"].select(F.col("id").alias(f"{who}_id"), F.col("name").alias(f"standardized_{who}_name")), f"{who}_id", "left")
    return rows.select(*columns, *[x for who in ("recipient", "lobbyist", "firm") for x in (f"{who}_id", f"standardized_{who}_name")])


def bundling(t: Tables) -> DataFrame:
    """Amounts by recipient, firm, lobbyist and cycle. A firm without entity is the employer or the bundler, a lobbyist without one the firm or the bundler."""
    name = lambda who, *other: F.coalesce(f"standardized_{who}_name", *other).alias(f"{who}_name")
    keys = ["recipient_id", "recipient_name", "firm_id", "firm_name", "lobbyist_id", "lobbyist_name", "cycle"]
    rows = bundles_denormalized(t).select(
        "recipient_id", name("recipient", "committee_name"), "firm_id", name("firm", "bundler_employer", "bundler_name"), "lobbyist_id", name("lobbyist", "standardized_firm_name", "bundler_name"),
        even_year(F.col("report_year")).alias("cycle"), F.coalesce("semi_annual_amount", "period_amount").alias("_amount"),
    )
    return rows.groupBy(*keys).agg(F.sum("_amount").alias("amount"))


