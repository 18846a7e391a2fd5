"""Record search: what can be asked of each record set, the order of its records, and its pages.

A field is a predicate on the record itself, which reaches the scan, or a step that joins a related table. Steps are semi joins, so a record that several children
match is there once, without a distinct. Each field asks for a child of its own: `member_party` and `member_state` may be met by two members.
Tables come as a dict of DataFrames. Nulls match no predicate; an empty table gives no rows; columns that no field names are carried along.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from urllib.parse import unquote_plus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.cleaning import mapped
from meridian.operators import filters as fl
from meridian.operators.ranking import page

Tables = dict[str, DataFrame]
Step = Callable[[DataFrame, Tables, str], DataFrame]


@dataclass(frozen=True)
class RecordSet:
    table: str
    fields: dict[str, fl.Field | Step]
    order: tuple[str, ...]  # `-column` is descending
    key: str = "id"  # makes the order total
    whole: bool = False  # all records at once when no page is asked for
    output: tuple[str, ...] = ()  # none: all columns but the internal ones
    labels: dict[str, tuple[str, dict[str, str]]] = field(default_factory=dict)  # new column: column of codes and their labels


def _in(*names: str, cast: Callable = str, **renamed: str) -> dict[str, fl.Field]:
    return {n: fl.inclusion(c, cast) for n, c in {**{n: n for n in names}, **renamed}.items()}


def _text(*names: str, **columns: str) -> dict[str, fl.Field]:
    return {n: fl.fulltext(*c.split()) for n, c in {**{n: n for n in names}, **columns}.items()}


def _compared(cast: Callable, *names: str, **renamed: str) -> dict[str, fl.Field]:
    return {n: fl.comparison(c, cast) for n, c in {**{n: n for n in names}, **renamed}.items()}


def related(table: str, own: str, key: str, asked: fl.Field) -> Step:
    """Records with a row in a related table that the field's predicate selects."""

    def step(df: DataFrame, tables: Tables, value: str) -> DataFrame:
        rows = tables[table].filter(asked(value)).select(F.col(key).alias("_related"))
        return df.join(rows, df[own] == rows["_related"], "left_semi")

    return step


def _children(table: str, key: str, fields: dict[str, fl.Field]) -> dict[str, Step]:
    return {n: related(table, "id", key, f) for n, f in fields.items()}


def by_industry(column: str) -> Step:
    """Codes alone are a predicate on the record; orders ask the table of categories, and then codes must be in it too."""
    in_table = related("category", column, "catcode", fl.industry("catcode", "catorder"))
    codes_alone = fl.industry(column, column)

    def step(df: DataFrame, tables: Tables, value: str) -> DataFrame:
        picked = [a.split(",")[1] or a.split(",")[0] if "," in a else a for a in value.split(fl.DELIMITER)]
        return df.filter(codes_alone(value)) if all(len(p) == 5 for p in picked) else in_table(df, tables, value)

    return step


def by_metro(df: DataFrame, tables: Tables, value: str) -> DataFrame:
    """Records whose zip code lies in a metropolitan area with such a name."""
    areas = tables["metro"].filter(fl.fulltext("name")(value)).select(F.col("id").alias("msa_id"))
    zips = tables["zip"].join(areas, "msa_id", "left_semi").select(F.col("zipcode").alias("_related"))
    return df.join(zips, df["contributor_zipcode"] == zips["_related"], "left_semi")


def _for_against(kind: str, *_: str) -> Column:
    code = F.col("transaction_type")
    return {"for": ~code.isin("24a", "24n", "29"), "against": code.isin("24a", "24n"), "electioneering": code == "29"}.get(kind, F.lit(True))


#: Groups of transaction types.
TYPE_GROUPS = {
    "standard": ("", "10", "11", "15", "15e", "15j", "22y", "24k", "24r", "24z"),
    "ie_supporting": ("24e",),
    "ie_opposing": ("24a",),
    "electioneering": ("29",),
}
#: Transaction types and what they are called.
TYPE_LABELS = {
    "10": "Non-Federal Receipt from Persons",
    "10j": "Memo Receipt from JF Super PAC",
    "11": "Tribal Contribution",
    "12": "Non-Federal Other Receipt - Levin Account (L-2)",
    "13": "Inaugural Donation Accepted",
    "15": "Contribution",
    "15c": "Contribution from Candidate",
    "15e": "Earmarked Contribution",
    "15f": "Loans forgiven by Candidate",
    "15i": "Earmarked Intermediary In",
    "15j": "Memo (Filer's Percentage of Contribution Given to Join Fundraising Committee)",
    "15t": "Earmarked Intermediary Treasury In",
    "15z": "In-Kind Contribution Received from Registered Filer",
    "16c": "Loans Received from the Candidate",
    "16f": "Loans Received from Banks",
    "16g": "Loan from Individual",
    "16h": "Loan from from Registered Filers",
    "16j": "Loan Repayments from Individual",
    "16k": "Loan Repayments from from Registered Filer",
    "16l": "Loan Repayments Received from Unregistered Entity",
    "16r": "Loans Received from Registered Filers",
    "16u": "Loan Received from Unregistered Entity",
    "17r": "Contribution Refund Received from Registered Entity",
    "17u": "Refunds/Rebates/Returns Received from Unregistered Entity",
    "17y": "Refunds/Rebates/Returns from Individual or Corporation",
    "17z": "Refunds/Rebates/Returns from Candidate or Committee",
    "18g": "Transfer In Affiliated",
    "18h": "Honorarium Received",
    "18j": "Memo (Filer's Percentage of Contribution Given to Join Fundraising Committee)",
    "18k": "Contribution Received from Registered Filer",
    "18l": "Bundled Contribution",
    "18s": "Receipts from Secretary of State",
    "18u": "Contribution Received from Unregistered Committee",
    "19": "Electioneering Communication Donation Received",
    "19j": "Memo (Electioneering Communication Percentage of Donation Given to Join Fundraising Committee)",
    "20": "Disbursement - Exempt from Limits",
    "20a": "Non-Federal Disbursement - Levin Account (L-4A) Voter Registration",
    "20b": "Non-Federal Disbursement - Levin Account (L-4B) Voter Identification",
    "20c": "Loan Repayments Made to Candidate",
    "20d": "Non-Federal Disbursement - Levin Account (L-4D) Generic Campaign",
    "20f": "Loan Repayments Made to Banks",
    "20g": "Loan Repayments Made to Individual",
    "20r": "Loan Repayments Made to Registered Filer",
    "20v": "Non-Federal Disbursement - Levin Account (L-4C) Get Out The Vote",
    "20y": "Non-Federal Refund",
    "22g": "Loan to Individual",
    "22h": "Loan to Candidate or Committee",
    "22j": "Loan Repayment to Individual",
    "22k": "Loan Repayment to Candidate or Committee",
    "22l": "Loan Repayment to Bank",
    "22r": "Contribution Refund to Unregistered Entity",
    "22u": "Loan Repaid to Unregistered Entity",
    "22x": "Loan Made to Unregistered Entity",
    "22y": "Contribution Refund to Individual",
    "22z": "Contribution Refund to Candidate or Committee",
    "23y": "Inaugural Donation Refund",
    "24a": "Independent Expenditure Against",
    "24c": "Coordinated Expenditure",
    "24e": "Independent Expenditure For",
    "24f": "Communication Cost for Candidate (C7)",
    "24g": "Transfer Out Affiliated",
    "24h": "Honorarium to Candidate",
    "24i": "Earmarked Intermediary Out",
    "24k": "Contribution Made to Non-Affiliated",
    "24n": "Communication Cost Against Candidate (C7)",
    "24p": "Contribution Made to Possible Candidate",
    "24r": "Election Recount Disbursement",
    "24t": "Earmarked Intermediary Treasury Out",
    "24u": "Contribution Made to Unregistered Entity",
    "24z": "In-Kind Contribution Made to Registered Filer",
    "28l": "Refund of Bundled Contribution",
    "29": "Electioneering Communication Disbursement or Obligation",
}
#: Output columns of contributions.
CONTRIBUTION_OUTPUT = """cycle transaction_namespace transaction_id transaction_type transaction_type_description filing_id is_amendment amount date
contributor_name contributor_ext_id contributor_type contributor_occupation contributor_employer contributor_gender contributor_address contributor_city
contributor_state contributor_zipcode contributor_category organization_name organization_ext_id parent_organization_name parent_organization_ext_id
recipient_name recipient_ext_id recipient_party recipient_type recipient_state recipient_state_held recipient_category committee_name committee_ext_id
committee_party candidacy_status district district_held seat seat_held seat_status seat_result""".split()

_GIVER_TEXT = "organization_name parent_organization_name contributor_employer"
_FARA_MONEY = {**_compared(fl.as_date, "date"), **_compared(Decimal, "amount"), **_in("document_id", "registrant_id", "record_id")}
_FARA_PAID = {**_FARA_MONEY, **_in("client_id", "location_id", "subcontractor_id"), **_text(client_ft="client", registrant_ft="registrant", purpose_ft="purpose")}

#: Names, columns and orders are fixed values: requests are written with them.
RECORD_SETS: dict[str, RecordSet] = {
    "contributions": RecordSet("contribution", {
        "contributor_state": fl.upper_inclusion("contributor_state"), "recipient_state": fl.upper_inclusion("recipient_state"), "cycle": fl.cycle_pair("cycle"),
        "for_against": fl.Field(_for_against), "general_transaction_type": fl.groups("transaction_type", TYPE_GROUPS), "contributor_industry": by_industry("contributor_category"),
        **_in("seat", "transaction_namespace", "transaction_type", "contributor_ext_id", "recipient_ext_id", "organization_ext_id", "parent_organization_ext_id", "committee_ext_id", "contributor_type", "recipient_type"),
        **_compared(fl.as_date, "date"), **_compared(int, "amount"),
        **_text(committee_ft="committee_name", contributor_ft=f"{_GIVER_TEXT} contributor_name", employer_ft=_GIVER_TEXT, organization_ft=_GIVER_TEXT, recipient_ft="recipient_name"), "msa_ft": by_metro,
    }, ("-cycle", "-amount"), "transaction_id", output=tuple(CONTRIBUTION_OUTPUT), labels={"transaction_type_description": ("transaction_type", TYPE_LABELS)}),
    "contributions/dc": RecordSet("contribution_dc", {
        "contributor_state": fl.upper_inclusion("contributor_state"), **_in("contributor_type", "contributor_zipcode"), **_compared(int, "amount"), **_compared(fl.as_date, "date"),
        **_text(committee_ft="committee_name", contributor_ft="contributor_name", recipient_ft="recipient_name", office_ft="seat", payment_type_ft="payment_type"),
    }, ("-amount",)),
    "lobbyist_bundling": RecordSet("bundling", _text(
        recipient_name="committee_name standardized_recipient_name", lobbyist_name="standardized_lobbyist_name standardized_firm_name bundler_name bundler_employer",
    ), ("committee_name", "bundler_name", "-report_year")),
    "lobbying": RecordSet("lobbying", {
        "lobbyist_is_rep": related("lobbyist", "transaction_id", "transaction_id", fl.Field(lambda *_: F.col("member_of_congress"))), "industry": by_industry("client_category"),
        **_in("transaction_id", "transaction_type", "filing_type"), **_in("year", cast=int), **_compared(int, "amount"), **_text(client_ft="client_name", client_parent_ft="client_parent_name", registrant_ft="registrant_name"),
        **{n: related("lobbyist", "transaction_id", "transaction_id", f) for n, f in {**_in("lobbyist_ext_id", "candidate_ext_id"), **_text(lobbyist_ft="lobbyist_name")}.items()},
        **{n: related("lobbying_issue", "transaction_id", "transaction_id", f) for n, f in {**_in(issue="general_issue_code"), **_text(issue_ft="specific_issue")}.items()},
    }, ("-year", "-amount"), "transaction_id"),
    "grants": RecordSet("grant", {
        **_in("assistance_type", "recipient_type", recipient_state="recipient_state_code"), **_in("fiscal_year", cast=int), **_text(agency_ft="agency_name", recipient_ft="recipient_name"), **_compared(int, amount_total="total_funding_amount"),
    }, ("-fiscal_year", "-total_funding_amount")),
    "contracts": RecordSet("contract", {
        **_in(agency_id="agencyid", contracting_agency_id="contractingofficeagencyid", place_district="congressionaldistrict", place_state="statecode", requesting_agency_id="fundingrequestingagencyid",
              vendor_state="state", vendor_zipcode="zipcode", vendor_district="vendor_cd", vendor_duns="dunsnumber", vendor_parent_duns="eeparentduns"),
        **_in("fiscal_year", cast=int), **_text(vendor_name="vendorname", vendor_city="city"),
        **_compared(int, obligated_amount="obligatedamount", current_amount="baseandexercisedoptionsvalue", maximum_amount="baseandalloptionsvalue"), **_compared(fl.as_date, signed_date="signeddate"),
    }, ("-fiscal_year", "-obligatedamount")),
    "earmarks": RecordSet("earmark", {
        **_in(cast=int, year="fiscal_year"), **_text(bill="bill bill_section bill_subsection", description="description notes"), **_compared(Decimal, amount="final_amount"),
        **_children("earmark_location", "earmark_id", {**_in(state="state"), **_text(city="city")}),
        **_children("earmark_member", "earmark_id", {**_in(member_party="party", member_state="state"), **_text(member="standardized_name raw_name")}),
        **_children("earmark_recipient", "earmark_id", _text(recipient="standardized_recipient raw_recipient")),
    }, ("-fiscal_year", "-final_amount")),
    "epa": RecordSet("enforcement", {
        **_in("case_num"), **_text("case_name", "defendants", "location_addresses"), **_compared(Decimal, "penalty"), **_compared(fl.as_date, "first_date", "last_date"),
    }, ("-penalty",), "case_num"),
    "faca": RecordSet("advisory", {
        **_text("committee_name", "member_name", "affiliation", agency_name="agency_abbr agency_name"), "year": fl.years_overlap("start_date", "end_date"),
    }, ("committee_name",)),
    "contractor_misconduct": RecordSet("misconduct", {
        **_in("date_year", cast=int), **_compared(int, "penalty_amount"), **_text("enforcement_agency", "instance", "contracting_party"), "contractor": related("contractor", "contractor_id", "id", fl.fulltext("name")),
    }, ("-penalty_amount", "-date")),
    "fara/client_registrant": RecordSet("fara_client_registrant", {
        "terminated": fl.titled("terminated"), **_in("registrant_id", "client_id", "location_id"),
        **_text(client_ft="client", registrant_name_ft="registrant_name", location_of_client_ft="location_of_client", description_of_service_ft="description_of_service"),
    }, ("client",), whole=True),
    "fara/contact": RecordSet("fara_contact", {
        **_compared(fl.as_date, "date"), **_in("contact_type", "affiliated_memember_bioguide_id", "document_id", "registrant_id", "client_id", "location_id", "recipient_id", "record_id"),
        **_text(contact_title_ft="contact_title", contact_name_ft="contact_name", contact_office_ft="contact_office", contact_agency_ft="contact_agency", client_ft="client",
                client_location_ft="client_location", registrant_ft="registrant", description_ft="description", employees_mentioned_ft="employees_mentioned"),
    }, ("-date",), whole=True),
    "fara/contribution": RecordSet("fara_contribution", {
        **_FARA_MONEY, **_in("contact_type", "recipient_crp_id", "recipient_bioguide_id", "recipient_id"),
        **_text(recipient_ft="recipient", description_ft="description", contributing_individual_or_pac_ft="contributing_individual_or_pac"),
    }, ("-date",), whole=True),
    "fara/disbursement": RecordSet("fara_disbursement", {**_FARA_PAID, **_text(to_subcontractor_ft="to_subcontractor")}, ("-date",), whole=True),
    "fara/payment": RecordSet("fara_payment", {**_FARA_PAID, **_text(from_contractor_ft="from_contractor")}, ("-date",), whole=True),
}
INTERNAL = ("import_reference", "imported_on")


def select(tables: Tables, name: str, params: dict[str, str]) -> DataFrame:
    """All records that the parameters select, in no order. Predicates come before joins; an empty value asks for nothing; an unknown parameter is an error."""
    records = RECORD_SETS[name]
    asked = {n: unquote_plus(v) for n, v in params.items() if n not in fl.RESERVED and v != ""}
    if unknown := [n for n in params if n not in fl.RESERVED and n not in records.fields]:
        raise ValueError(f"no such fields of {name}: {unknown}")
    df = tables[records.table]
    steps = [(f, v) for n, v in asked.items() for f in [records.fields[n]]]
    for f, v in steps:
        if isinstance(f, fl.Field):
            df = df.filter(f(v))
    for f, v in steps:
        if not isinstance(f, fl.Field):
            df = f(df, tables, v)
    return df


def _order(records: RecordSet) -> list[tuple[str, bool]]:
    return [(c.lstrip("-"), c.startswith("-")) for c in (*records.order, records.key)]


def _beyond(order: list[tuple[str, bool]], last: dict) -> Column:
    """Rows that come after one with these values: greatest and null first where descending, least first and null last where not."""

    def past(column: str, falling: bool) -> Column:
        c, v = F.col(column), last[column]
        if falling:
            return c.isNotNull() if v is None else F.coalesce(c < F.lit(v), F.lit(False))
        return F.lit(False) if v is None else c.isNull() | (c > F.lit(v))

    level = [reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.lit(last[p])) for p, _ in order[:i]] + [past(*o)]) for i, o in enumerate(order)]
    return reduce(lambda a, b: a | b, level)


def search(tables: Tables, name: str, params: dict[str, str], after: dict | None = None) -> DataFrame:
    """A page of a record set in its order, ties by key.

    `page` counts from 1, `per_page` is 1000 where not given and 100,000 at most. after: order columns and key of the last row seen; the page then starts behind it and costs
    no more than the first one, however deep it lies. Sets marked as whole come all at once, sorted in ranges, if no page is asked for.
    """
    records = RECORD_SETS[name]
    df, order = select(tables, name, params), _order(records)
    if after:
        df = df.filter(_beyond(order, after))
    by = [F.col(c).desc_nulls_first() if falling else F.col(c).asc_nulls_last() for c, falling in order]
    if not records.whole or "page" in params or after:
        size = min(int(params.get("per_page", 100_000 if records.whole else 1000)), 100_000)
        skip = 0 if after else (int(params.get("page", 1)) - 1) * size
        df = page(df, by, skip, size)
    else:
        df = df.orderBy(*by)
    for new, (codes, labels) in records.labels.items():
        df = df.withColumn(new, F.coalesce(mapped(F.col(codes), labels), F.lit("")))
    return df.select(*[c for c in records.output if c in df.columns]) if records.output else df.drop(*INTERNAL)


def with_children(records: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """Records with each relation as one string, its members sorted and joined by "; "; no members: an empty string. children: column to table, its key, text of a member."""
    for name, (df, own, text) in children.items():
        lists = df.groupBy(F.col(own).alias("_key")).agg(F.array_join(F.array_sort(F.collect_list(text)), "; ").alias("_text"))
        records = records.join(lists, records[key] == lists["_key"], "left").withColumn(name, F.coalesce("_text", F.lit(""))).drop("_key", "_text")
    return records
