"""Spending, enforcement, misconduct, earmarks, regulations, bundling and metadata over stand-in records, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.functions.text import ORG_SUFFIX
from meridian.plans import elections as el
from meridian.plans import entity_metadata as em
from meridian.plans import public_records as pr
from meridian.queries import lobbying, plans
from meridian.queries.base import made_once, query, standins
from meridian.queries.plans import INDUSTRY, ORG, POL

_LATER = "CAST(CAST({0} AS DATE) + INTERVAL 10 YEAR AS DATE)"
_LINE = "l_orderkey * 8 + l_linenumber"
_SUMMED = (
    "total_receipts", "total_disbursements", "ending_cash", "candidate_loan_repayments", "other_loan_repayments", "refunds_to_individuals", "refunds_to_committees", "total_individual_contributions",
    "contributions_from_other_committees", "contributions_from_party_committees", "contributions_from_candidate", "loans_from_candidate", "authorized_transfers_from",
)
_COMMITTEE = (
    "total_receipts", "loan_repayments", "refunds_to_individuals", "refunds_to_committees", "individual_contributions", "contributions_from_other_committees", "transfers_from_affiliates", "nonfederal_transfers_received",
    "total_loans_received", "total_disbursements", "cash_close_of_period", "debts_owed", "contributions_to_committees", "independent_expenditures_made", "party_coordinated_expenditures_made", "nonfederal_expenditure_share",
)
STANDINS = {
    "line": "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"max({c}) AS {c}" for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    + " FROM lineitem WHERE l_linenumber < 8 GROUP BY l_orderkey, l_linenumber",  # one of each number, so that ids are unique
    "pub_attribute": f"""SELECT entity_id, namespace, value FROM attribute UNION ALL SELECT id, 'urn:pogo:contractor', CASE WHEN id % 5 = 0 THEN 'x' ELSE CAST(id % 50 AS STRING) END FROM entity WHERE id < 60
  UNION ALL SELECT id, 'urn:fec:committee', 'C' || CAST(id % 60 AS STRING) FROM entity WHERE id < {ORG} AND id % 2 = 1 AND id % 3 > 0 UNION ALL SELECT id, 'urn:fec:candidate', 'H' || CAST(id - {POL} AS STRING) FROM entity WHERE id >= {POL} AND id % 4 > 0
  UNION ALL SELECT id, 'urn:crp:subindustry', 'BUILD' FROM entity WHERE id = {INDUSTRY} + 1 UNION ALL SELECT id, 'urn:crp:industry', 'a1' FROM entity WHERE id = {INDUSTRY} + 11""",
    "grant_": f"""SELECT {_LINE} AS id, CASE l_suppkey % 4 WHEN 0 THEN 'ORG ' || CAST(l_suppkey % 25 AS STRING) || ' Inc.' WHEN 1 THEN 'Org ' || CAST(l_suppkey % 25 AS STRING) WHEN 2 THEN NULL ELSE 'Firm ' || CAST(l_suppkey AS STRING) || ' Company' END AS recipient_name,
  year(l_shipdate) AS fiscal_year, CASE l_partkey % 5 WHEN 0 THEN 'l' WHEN 1 THEN 'i' WHEN 2 THEN NULL ELSE 'g' END AS asst_cat_type, 'Agency ' || CAST(l_partkey % 7 AS STRING) AS agency_name, 'Project ' || CAST({_LINE} AS STRING) AS project_description,
  CAST(l_extendedprice * 100 AS DECIMAL(18,2)) AS face_loan_guran, CAST(l_extendedprice * 50 AS DECIMAL(18,2)) AS fed_funding_amount FROM line WHERE l_linenumber < 4""",
    "contract_": f"""SELECT {_LINE} AS id, CASE l_suppkey % 3 WHEN 0 THEN 'Parent ' || CAST(l_suppkey % 5 AS STRING) || ' CORP' WHEN 1 THEN 'org ' || CAST(l_suppkey % 25 AS STRING) ELSE 'FIRM ' || CAST(l_suppkey AS STRING) END AS vendorname, year(l_shipdate) AS fiscal_year, l_partkey % 9 AS agencyid,
  'Work ' || CAST({_LINE} AS STRING) AS descriptionofcontractrequirement, CAST(l_extendedprice * 60 AS DECIMAL(18,2)) AS obligatedamount FROM line WHERE l_linenumber > 3""",
    "agency_": "SELECT DISTINCT l_partkey % 6 AS id, 'Office ' || CAST(l_partkey % 6 AS STRING) AS name FROM line",
    "case_": "SELECT o_orderkey AS activity_id, 'C' || CAST(o_orderkey - o_orderkey % 2 AS STRING) AS enfocnu, 'Case ' || CAST(o_custkey AS STRING) AS enfornm FROM orders WHERE o_orderkey % 3 = 0",
    "milestone": f"SELECT l_orderkey AS activity_id, CASE WHEN l_orderkey % 7 = 0 THEN CAST(l_shipdate AS DATE) WHEN l_linenumber = 6 THEN NULL ELSE {_LATER.format('l_shipdate')} END AS subacad, l_linestatus || l_returnflag AS subacty FROM line WHERE l_orderkey % 3 = 0",
    "penalty": """SELECT l_orderkey AS activity_id, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_extendedprice * 20 AS DECIMAL(18,2)) END AS enfccaa, CAST(l_extendedprice * 10 AS DECIMAL(18,2)) AS enfcraa, CASE WHEN l_linenumber = 1 THEN CAST(l_tax * 1000 AS DECIMAL(18,2)) END AS enfotpa,
  CAST(l_discount * 100 AS DECIMAL(18,2)) AS enfotsa, CAST(l_quantity AS DECIMAL(18,2)) AS enfops, CASE WHEN l_linenumber = 2 THEN CAST(l_quantity AS DECIMAL(18,2)) END AS enfcslp FROM line WHERE l_orderkey % 9 < 6""",
    "defendant": "SELECT l_orderkey AS activity_id, 'Defendant ' || CAST(l_suppkey % 30 AS STRING) AS defennm FROM line WHERE l_linenumber < 3",
    "facility": "SELECT l_orderkey AS activity_id, 'City ' || CAST(l_partkey % 11 AS STRING) AS fcltcit, CASE WHEN l_partkey % 5 > 0 THEN 'S' || CAST(l_partkey % 5 AS STRING) END AS fcltstc, CAST(l_partkey AS STRING) || ' Road' AS fcltyad, CAST(10000 + l_suppkey AS STRING) AS fcltpst FROM line WHERE l_linenumber = 2 OR l_linenumber = 5",
    "org_map": "SELECT DISTINCT 'Defendant ' || CAST(l_suppkey % 30 AS STRING) AS defendant_name, 'Org ' || CAST(l_suppkey % 30 AS STRING) AS org_name, CASE WHEN l_suppkey % 30 % 2 = 0 THEN 'Parent ' || CAST(l_suppkey % 30 % 5 AS STRING) END AS ultorg_name FROM line",
    "contractor": "SELECT c_custkey AS id, c_name AS name, CAST(c_custkey % 60 AS INT) AS contractor_ext_id FROM customer",
    "misconduct": """SELECT o_orderkey AS id, o_custkey AS contractor_id, year(o_orderdate) AS date_year, 'Settled ' || CAST(o_orderkey % 3 AS STRING) AS date_significance, CASE WHEN o_orderkey % 13 > 0 THEN CAST(o_orderkey % 40 * 1000 AS DECIMAL(15,2)) END AS penalty_amount,
  'Instance ' || CAST(o_orderkey % 17 AS STRING) AS instance, 'Party ' || CAST(o_orderkey % 4 AS STRING) AS contracting_party, 'Fine' AS disposition, 'Type ' || CAST(o_orderkey % 6 AS STRING) AS misconduct_type, 'u' || CAST(o_orderkey AS STRING) AS url FROM orders""",
    "earmark": "SELECT o_orderkey AS id, year(o_orderdate) AS fiscal_year, CAST(o_totalprice AS DECIMAL(15,2)) AS final_amount, 'Earmark ' || CAST(o_orderkey AS STRING) AS description, CASE WHEN o_orderkey % 10 = 4 THEN 'p' ELSE '' END AS presidential FROM orders",
    "earmark_member": f"""SELECT {_LINE} AS id, l_orderkey AS earmark_id, CASE WHEN l_suppkey % 7 > 0 THEN CAST(l_suppkey % 60 AS STRING) END AS crp_id, CASE WHEN l_partkey % 9 > 0 THEN 'Member ' || CAST(l_suppkey % 60 AS STRING) END AS standardized_name,
  'NATION_' || CAST(l_suppkey % 25 AS STRING) AS state, 'h' AS chamber, CASE l_partkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'R' END AS party FROM line WHERE l_linenumber < 3""",
    "earmark_recipient": f"SELECT {_LINE} AS id, l_orderkey AS earmark_id, CASE WHEN l_partkey % 4 > 0 THEN 'Org ' || CAST(l_suppkey % 40 AS STRING) ELSE '' END AS standardized_recipient, 'raw ' || CAST(l_suppkey AS STRING) AS raw_recipient FROM line WHERE l_linenumber IN (1, 4)",
    "earmark_location": "SELECT l_orderkey AS earmark_id, 'NATION_' || CAST(l_suppkey % 25 AS STRING) AS state FROM line WHERE l_linenumber = 2 OR l_linenumber = 5",
    "politician_state": "SELECT entity_id, cycle, 'NATION_' || CAST((entity_id + cycle) % 25 AS STRING) AS state, seat, CASE WHEN entity_id % 3 > 0 THEN 'D' END AS party FROM politician_metadata",
    "comment_": f"SELECT {_LINE} AS document_id, l_partkey % 60 AS docket_id FROM line",
    "docket": "SELECT DISTINCT l_partkey % 60 AS docket_id, 'Title ' || CAST(l_partkey % 60 AS STRING) AS title, 'A' || CAST(l_partkey % 60 % 8 AS STRING) AS agency, CAST(1982 + l_partkey % 60 % 31 AS INT) AS year FROM line",
    "text_match": f"""SELECT {_LINE} AS document_id, CASE l_suppkey % 3 WHEN 0 THEN {ORG} + l_suppkey % 25 WHEN 1 THEN l_suppkey ELSE {POL} + l_suppkey % 53 END AS entity_id FROM line
  UNION ALL SELECT {_LINE}, {ORG} + l_suppkey % 25 FROM line WHERE l_suppkey % 3 = 0 AND l_partkey % 2 = 0""",
    "submitter_match": f"SELECT {_LINE} AS document_id, CASE WHEN l_partkey % 2 = 0 THEN {ORG} + l_partkey % 25 ELSE l_suppkey END AS entity_id FROM line WHERE l_linenumber < 4",
    "bundle": """SELECT o_orderkey AS file_num, 'C' || CAST(o_custkey % 60 AS STRING) AS committee_fec_id, 'Committee ' || CAST(o_custkey % 60 AS STRING) AS committee_name, year(o_orderdate) AS report_year, 'Q' || CAST(o_orderkey % 4 AS STRING) AS report_type,
  CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) AS end_date, CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_orderdate AS DATE) END AS filing_date, 'p' || CAST(o_orderkey AS STRING) AS pdf_url FROM orders""",
    "lobbyist_bundle": f"""SELECT {_LINE} AS id, l_orderkey AS file_num, 'Bundler ' || CAST(l_suppkey % 40 AS STRING) AS name, CASE WHEN l_partkey % 5 > 0 THEN 'Employer ' || CAST(l_partkey % 30 AS STRING) END AS employer, 'Lobbyist' AS occupation, CAST(l_suppkey AS STRING) AS contributor_fec_id, 'City' AS city,
  CAST(l_extendedprice AS DECIMAL(15,2)) AS amount, CASE l_linenumber % 3 WHEN 0 THEN CAST(0 AS DECIMAL(15,2)) WHEN 1 THEN CAST(l_quantity AS DECIMAL(15,2)) END AS semi_annual_amount FROM line""",
    "bundler_match": f"""SELECT 'Bundler ' || CAST(c_custkey % 40 AS STRING) AS name, c_custkey AS entity_id FROM customer WHERE c_custkey < 30 UNION ALL SELECT 'Employer ' || CAST(n_nationkey AS STRING), {ORG} + n_nationkey FROM nation
  UNION ALL SELECT 'Employer ' || CAST(n_nationkey AS STRING), {ORG} + n_nationkey FROM nation WHERE n_nationkey % 2 = 0""",
    "committee_": "SELECT DISTINCT 'C' || CAST(c_custkey % 60 AS STRING) AS committee_id, c.cycle, CASE WHEN c_custkey % 60 % 4 = 0 THEN 'C' || CAST(c_custkey % 60 AS STRING) ELSE CAST(c_custkey % 60 AS STRING) END AS recipient_id FROM customer CROSS JOIN (VALUES (1992), (1994), (1996)) AS c(cycle)",
    "committee_profile": "SELECT DISTINCT 'C' || CAST(c_custkey % 60 AS STRING) AS committee_id, c.cycle, CASE WHEN c_custkey % 60 % 8 = 1 THEN 'O' ELSE 'Q' END AS committee_type, CASE c_custkey % 60 % 7 WHEN 0 THEN 'C' WHEN 1 THEN 'L' WHEN 2 THEN 'T' WHEN 3 THEN 'W' WHEN 4 THEN 'M' WHEN 5 THEN 'V' END AS interest_group FROM customer CROSS JOIN (VALUES (1992), (1994), (1998)) AS c(cycle)",
    "navigation_bin": "SELECT id AS entity_id, CASE id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'p' WHEN 2 THEN 'u' WHEN 3 THEN 'x' ELSE 'b' END AS navigation_bin FROM entity WHERE type = 'organization' AND id % 3 > 0 UNION ALL SELECT id, 'p' FROM entity WHERE id % 10 = 5 AND type = 'organization'",
    "indexp": """SELECT CAST(year(o_orderdate) + year(o_orderdate) % 2 AS INT) AS cycle, 'H' || CAST(o_orderkey % 60 AS STRING) AS candidate_id, 'Candidate ' || CAST(o_orderkey % 60 AS STRING) AS candidate_name, 'C' || CAST(o_orderkey % 32 AS STRING) AS spender_id, 'Spender ' || CAST(o_orderkey % 32 AS STRING) AS spender_name,
  'G' AS election_type, 'S' || CAST(o_orderkey % 9 AS STRING) AS candidate_state, '0' || CAST(o_orderkey % 5 AS STRING) AS candidate_district, CASE o_orderkey % 3 WHEN 0 THEN 'House' WHEN 1 THEN 'Senate' ELSE 'President' END AS candidate_office, CASE o_orderkey % 2 WHEN 0 THEN 'D' ELSE 'R' END AS candidate_party,
  '$1,' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || '.50' AS amount, '$' || CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING) AS aggregate_amount, CASE o_orderkey % 7 WHEN 0 THEN 'Support' WHEN 1 THEN 'oppose' WHEN 2 THEN NULL ELSE 'support' END AS support_oppose, CAST(o_orderdate AS DATE) AS date,
  'ads' AS purpose, 'payee ' || CAST(o_orderkey % 11 AS STRING) AS payee, CAST(o_orderkey AS STRING) AS filing_number, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey - 32 AS STRING) END AS prev_file_num, 'N' AS amendment, 'T' || CAST(o_orderkey AS STRING) AS transaction_id, 'I' AS image_number, CAST(o_orderdate AS DATE) AS received_date FROM orders""",
    "candidate": """SELECT 'H' || CAST(c_custkey % 60 AS STRING) AS candidate_id, c.cycle, max('Candidate ' || CAST(c_custkey % 60 AS STRING)) AS candidate_name, max(CASE c_custkey % 60 % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'S' ELSE 'P' END) AS office, max('S' || CAST(c_custkey % 60 % 9 AS STRING)) AS office_state,
  max(CASE c_custkey % 2 WHEN 0 THEN 'D' ELSE 'R' END) AS party, max('R' || CAST(c_custkey % 60 % 20 AS STRING)) AS race, max(CASE WHEN c_custkey % 60 % 7 > 0 THEN 'C' ELSE 'N' END) AS candidate_status, max(CASE WHEN c_custkey % 60 % 5 > 0 THEN 'I' END) AS incumbent_challenger_open,
  max('C' || CAST(c_custkey % 60 % 32 AS STRING)) AS committee_id, c.cycle AS election_year FROM customer CROSS JOIN (VALUES (1994), (1996), (1998)) AS c(cycle) GROUP BY c_custkey % 60, c.cycle""",
    "candidate_summary": f"""SELECT 'H' || CAST(o_custkey % 60 AS STRING) AS candidate_id, CAST(year(o_orderdate) + year(o_orderdate) % 2 AS INT) AS cycle, {", ".join(f"CAST(sum(CAST(o_totalprice AS DECIMAL(15,2)) * (o_orderkey % {i + 2})) AS DECIMAL(20,2)) AS {c}" for i, c in enumerate(_SUMMED))},
  max(CAST(o_orderdate AS DATE)) AS ending_date, max(CASE o_custkey % 60 % 4 WHEN 0 THEN 'W' WHEN 1 THEN 'L' WHEN 2 THEN 'X' END) AS primary_election_status, max(CASE o_orderkey % 50 WHEN 0 THEN 'W' END) AS special_election_status, max(CASE o_orderkey % 60 WHEN 1 THEN 'L' END) AS runoff_election_status, max(CASE o_custkey % 3 WHEN 0 THEN 'W' ELSE 'L' END) AS general_election_status
  FROM orders GROUP BY o_custkey % 60, year(o_orderdate) + year(o_orderdate) % 2""",
    "fec_committee": "SELECT 'C' || CAST(c_custkey % 60 AS STRING) AS committee_id, c.cycle, max('Committee ' || CAST(c_custkey % 60 AS STRING)) AS committee_name, max(CASE WHEN c_custkey % 60 % 3 > 0 THEN 'Org ' || CAST(c_custkey % 60 AS STRING) END) AS connected_org FROM customer CROSS JOIN (VALUES (1994), (1996), (1998)) AS c(cycle) GROUP BY c_custkey % 60, c.cycle",
    "committee_summary": f"""SELECT 'C' || CAST(o_custkey % 60 AS STRING) AS committee_id, CAST(year(o_orderdate) + year(o_orderdate) % 2 AS INT) AS cycle, CAST(o_orderdate AS DATE) AS through_date, {", ".join(f"CAST(CAST(o_totalprice AS DECIMAL(15,2)) * (o_orderkey % {i + 2}) AS DECIMAL(20,2)) AS {c}" for i, c in enumerate(_COMMITTEE))} FROM orders""",
    "giver": """SELECT 'C' || CAST(l_suppkey % 60 AS STRING) AS filer_id, CAST(year(l_shipdate) + year(l_shipdate) % 2 AS INT) AS cycle, CAST(l_shipdate AS DATE) AS date, CAST(l_extendedprice AS DECIMAL(15,2)) AS amount, 'Giver ' || CAST(l_partkey % 40 AS STRING) AS contributor_name,
  CASE l_linenumber WHEN 1 THEN '10' WHEN 2 THEN '15e' WHEN 3 THEN '24k' ELSE '15' END AS transaction_type, 'Employer' AS employer, CASE WHEN l_partkey % 3 > 0 THEN 'Job' END AS occupation, 'City' AS city, CASE WHEN l_partkey % 10 < 9 THEN 'S' || CAST(l_partkey % 10 AS STRING) END AS state, '1' AS zipcode FROM line""",
    "group_gift": "SELECT 'C' || CAST(l_partkey % 60 AS STRING) AS filer_id, 'C' || CAST(l_suppkey % 32 AS STRING) AS other_id, CAST(year(l_shipdate) + year(l_shipdate) % 2 AS INT) AS cycle, CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS DECIMAL(15,2)) AS amount, '24z' AS transaction_type, 'Town' AS city, 'S1' AS state, '2' AS zipcode FROM line WHERE l_linenumber < 3",
    "door_lobbyist": f"SELECT {_LINE} AS id, l_orderkey AS transaction_id, 'x' AS lobbyist_name, lpad(CAST(l_suppkey % 40 * 4 AS STRING), 11, '0') || '2' AS lobbyist_ext_id, CASE WHEN l_partkey % 4 > 0 THEN CAST(l_partkey % 70 AS STRING) END AS candidate_ext_id FROM line WHERE l_linenumber = 1",
}
_RENAMED = {"fec_committee": "committee", "pub_attribute": "attribute", "grant_": "grant", "contract_": "contract", "agency_": "agency", "case_": "case", "comment_": "comment", "committee_": "bundle_committee"}
WITH = f"{lobbying.SQL_WITH}, {', '.join(f'{n} AS ({s})' for n, s in STANDINS.items())}"


class Standins(dict):
    """Tables by name; a stand-in is stored when it is first asked for, so a query costs no more than what it reads."""

    def __init__(self, spark, sf):
        super().__init__(plans.tables(spark, sf, linked=False))
        self.base, self.of = dict(self), (spark, sf)
        self["attribute"] = self._made(spark, sf, "pub_attribute")  # those of contributions and more

    def __missing__(self, name):
        own = {new: old for old, new in _RENAMED.items()}.get(name, name)
        if own not in STANDINS:
            raise KeyError(name)
        self[name] = self._made(*self.of, own)
        return self[name]

    def _made(self, spark, sf, own):
        seen = dict(self.base)
        if " line" in STANDINS[own] and own != "line":
            seen["line"] = self._made(spark, sf, "line")
        return made_once(spark, ("public", sf, own), lambda: standins(spark, sf, ("orders", "customer", "lineitem", "nation"), {own: STANDINS[own]}, seen))[own]


def tables(spark, sf) -> pr.Tables:
    return Standins(spark, sf)


def meta_tables(spark, sf) -> em.Tables:
    """Tables of contributions and lobbying with their links, and what metadata reads besides; the attributes are those of contributions and more, of committees and industries."""
    t, lobby = tables(spark, sf), lobbying.tables(spark, sf)
    own = {n: t[n] for n in ("attribute", "committee_profile", "navigation_bin")}
    return plans.tables(spark, sf) | {n: lobby[n] for n in ("lobbying", "lobbyist", "lobbying_linked")} | own


_plain = plans._plain


def _cycles(body: str, keys: str, measures: str) -> str:
    return plans._cycles(body, keys, measures)


def _longs(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- spending

_STD = lambda c: f"regexp_replace(lower({c}), '{ORG_SUFFIX}', '')"
SPENDING = f"""grants_record AS (SELECT id, recipient_name, (fiscal_year + fiscal_year % 2)::INTEGER AS cycle, CASE WHEN asst_cat_type IN ('l', 'i') THEN 'l' ELSE 'g' END AS spending_type, fiscal_year, agency_name, project_description AS description,
  CASE WHEN asst_cat_type IN ('l', 'i') THEN face_loan_guran ELSE fed_funding_amount END AS amount FROM grant_),
contracts_record AS (SELECT c.id, vendorname AS recipient_name, (fiscal_year + fiscal_year % 2)::INTEGER AS cycle, 'c' AS spending_type, fiscal_year, coalesce(a.name, '') AS agency_name, descriptionofcontractrequirement AS description, obligatedamount AS amount FROM contract_ c LEFT JOIN agency_ a ON agencyid = a.id),
{", ".join(f"{k}_links AS (SELECT e.id AS entity_id, g.id AS transaction_id FROM {k}s_record g JOIN alias a ON {_STD('g.recipient_name')} = {_STD('a.alias')} JOIN entity e ON e.id = a.entity_id WHERE e.type = 'organization' AND g.amount >= 1000000 GROUP BY e.id, g.id)" for k in ("grant", "contract"))}"""
for _kind in ("grant", "contract"):
    query(f"spending_{_kind}_links", f"{WITH}, {SPENDING} SELECT * FROM {_kind}_links")(lambda s, d, k=_kind: _longs(pr.spending_links(tables(s, d), k), "entity_id"))
    query(f"spending_{_kind}_records", f"{WITH}, {SPENDING} SELECT * REPLACE (amount::DOUBLE AS amount) FROM {_kind}s_record")(lambda s, d, k=_kind: _plain((pr.grant_records if k == "grant" else pr.contract_records)(tables(s, d))))
_side = lambda kind, rec, where: f"(SELECT entity_id, cycle, count(*) AS count, sum(amount) AS amount FROM {rec}s_record JOIN {rec}_links ON id = transaction_id WHERE {where} GROUP BY ALL) {kind}"
_figures = ", ".join(f"coalesce({k}.count, 0) AS {k}_count, coalesce({k}.amount, 0) AS {k}_amount" for k in ("grant", "contract", "loan"))
query("spending_linked_totals", f"""{WITH}, {SPENDING}, t AS (SELECT entity_id, cycle, {_figures.replace("grant.", "gr.").replace("contract.", "co.").replace("loan.", "lo.")}
  FROM {_side("gr", "grant", "spending_type = 'g'")} FULL JOIN {_side("lo", "grant", "spending_type = 'l'")} USING (entity_id, cycle) FULL JOIN {_side("co", "contract", "true")} USING (entity_id, cycle))
SELECT entity_id, cycle, {", ".join(f"{k}_count::BIGINT AS {k}_count, {k}_amount::DOUBLE AS {k}_amount" for k in ("grant", "contract", "loan"))} FROM (SELECT * FROM t UNION ALL SELECT entity_id, -1, {", ".join(f"sum({k}_count), sum({k}_amount)" for k in ("grant", "contract", "loan"))} FROM t GROUP BY entity_id)""")(
    lambda s, d: _longs(_plain(pr.spending_totals(tables(s, d))), "entity_id")
)
_spent = "(SELECT entity_id, recipient_name, spending_type, cycle, fiscal_year, agency_name, description, amount FROM grants_record JOIN grant_links ON id = transaction_id UNION ALL SELECT entity_id, recipient_name, spending_type, cycle, fiscal_year, agency_name, description, amount FROM contracts_record JOIN contract_links ON id = transaction_id)"
query("spending_linked_top_records", f"""{WITH}, {SPENDING}, s AS {_spent} SELECT * EXCLUDE (rank) REPLACE (amount::DOUBLE AS amount) FROM (SELECT *, rank() OVER (PARTITION BY entity_id, cycle ORDER BY amount DESC) AS rank FROM (SELECT * FROM s UNION ALL SELECT * REPLACE (-1 AS cycle) FROM s)) WHERE rank <= 10""")(
    lambda s, d: _longs(_plain(pr.top_spending(tables(s, d))), "entity_id")
)

# --- enforcement

_sum = lambda e: f"(SELECT sum({e}) FROM penalty p WHERE p.activity_id = i.activity_id)"
_zero = lambda c: f"coalesce({c}, 0)"
ECHO = f"""actions AS (SELECT i.activity_id, enfocnu AS case_num, max(enfornm) AS case_name, (SELECT min(subacad) FROM milestone m WHERE m.activity_id = i.activity_id) AS first_date, (SELECT max(subacad) FROM milestone m WHERE m.activity_id = i.activity_id) AS last_date,
  (SELECT subacty FROM milestone m WHERE m.activity_id = i.activity_id AND subacad IS NOT NULL ORDER BY subacad, subacty LIMIT 1) AS first_date_significance, (SELECT subacty FROM milestone m WHERE m.activity_id = i.activity_id AND subacad IS NOT NULL ORDER BY subacad DESC, subacty LIMIT 1) AS last_date_significance,
  {_sum(" + ".join(map(_zero, pr.PENALTIES)))} AS penalty, {", ".join(f"{_sum(_zero(p))} AS penalty_{p}" for p in pr.SHOWN)},
  (SELECT count(DISTINCT defennm) FROM defendant d WHERE d.activity_id = i.activity_id) AS num_defendants, (SELECT string_agg(DISTINCT defennm, ', ' ORDER BY defennm) FROM defendant d WHERE d.activity_id = i.activity_id) AS defendants,
  (SELECT string_agg(x, '; ' ORDER BY x) FROM (SELECT DISTINCT fcltcit || ', ' || fcltstc AS x FROM facility f WHERE f.activity_id = i.activity_id)) AS locations,
  (SELECT string_agg(x, '; ' ORDER BY x) FROM (SELECT DISTINCT fcltyad || ', ' || fcltcit || ', ' || fcltstc || ' ' || fcltpst AS x FROM facility f WHERE f.activity_id = i.activity_id)) AS location_addresses
  FROM case_ i GROUP BY i.activity_id, enfocnu),
relevant_action AS (SELECT *, (year(last_date) + year(last_date) % 2)::INTEGER AS cycle FROM actions WHERE year(first_date) > 2000 AND penalty > 1000000),
echo_links AS (SELECT d.activity_id, a.case_num, max(d.defennm) AS defendant_name, e.id AS entity_id FROM relevant_action a JOIN defendant d ON d.activity_id = a.activity_id JOIN org_map m ON d.defennm = m.defendant_name JOIN entity e ON e.name = m.org_name OR e.name = m.ultorg_name GROUP BY d.activity_id, a.case_num, e.id)"""
_ACTION = ["activity_id", "case_num", "case_name", "first_date", "last_date", "first_date_significance", "last_date_significance", "penalty", *[f"penalty_{p}" for p in pr.SHOWN], "num_defendants", "defendants", "locations", "location_addresses"]
query("enforcement_cases", f"""{WITH}, {ECHO} SELECT {", ".join(f"coalesce({c}, '') AS {c}" if c.startswith("location") else f"{c}::VARCHAR AS {c}" if c.endswith("date") else f"{c}::DOUBLE AS {c}" if c.startswith("penalty") else c for c in _ACTION)} FROM actions""")(
    lambda s, d: _plain(pr.enforcement_actions(tables(s, d)).select(*[F.coalesce(c, F.lit("")).alias(c) if c.startswith("location") else F.col(c).cast("string").alias(c) if c.endswith("date") else F.col(c) for c in _ACTION]))
)
query("enforcement_links", f"{WITH}, {ECHO} SELECT * FROM echo_links")(lambda s, d: _longs(pr.enforcement_links(tables(s, d)), "entity_id"))
query("enforcement_totals", f"{WITH}, {ECHO}, j AS (SELECT entity_id, cycle, penalty FROM relevant_action JOIN echo_links USING (activity_id)) {_cycles('j', 'entity_id', 'count(*) AS count, sum(penalty)::DOUBLE AS amount')}")(lambda s, d: _longs(_plain(pr.enforcement_totals(tables(s, d))), "entity_id"))
query("enforcement_top_actions", f"""{WITH}, {ECHO}, j AS (SELECT a.cycle, a.case_num, case_name, o.defendant_name, o.entity_id, num_defendants, defendants, coalesce(locations, '') AS locations, coalesce(location_addresses, '') AS location_addresses, penalty, year(last_date) AS year, last_date_significance FROM relevant_action a JOIN echo_links o USING (case_num))
SELECT * REPLACE (penalty::DOUBLE AS penalty) FROM (SELECT *, rank() OVER (PARTITION BY entity_id, cycle ORDER BY CASE WHEN num_defendants = 1 THEN penalty::DOUBLE ELSE -1.0::DOUBLE / penalty::DOUBLE END DESC) AS rank FROM (SELECT * FROM j UNION ALL SELECT * REPLACE (-1 AS cycle) FROM j)) WHERE rank <= 10""")(
    lambda s, d: _longs(_plain(pr.top_enforcement(tables(s, d)).withColumns({c: F.coalesce(c, F.lit("")) for c in ("locations", "location_addresses")})), "entity_id", "year")
)

# --- misconduct

POGO = "pogo_links AS (SELECT DISTINCT a.entity_id, m.id AS misconduct_id FROM misconduct m JOIN contractor c ON m.contractor_id = c.id JOIN pub_attribute a ON try_cast(a.value AS INTEGER) = c.contractor_ext_id WHERE a.namespace = 'urn:pogo:contractor')"
_POGO_ROWS = "pogo AS (SELECT p.entity_id, m.*, (date_year + date_year % 2)::INTEGER AS cycle, c.name AS contractor FROM misconduct m JOIN contractor c ON m.contractor_id = c.id JOIN pogo_links p ON p.misconduct_id = m.id JOIN entity e ON e.id = p.entity_id)"
query("misconduct_links", f"{WITH}, {POGO} SELECT * FROM pogo_links")(lambda s, d: _longs(pr.misconduct_links(tables(s, d)), "entity_id"))
query("misconduct_totals", f"{WITH}, {POGO}, {_POGO_ROWS} {_cycles('pogo', 'entity_id', 'count(*) AS count, sum(penalty_amount)::DOUBLE AS amount')}")(lambda s, d: _longs(_plain(pr.misconduct_totals(tables(s, d))), "entity_id"))
_pogo_columns = "cycle, date_year AS year, date_significance, entity_id AS contractor_entity, contractor, contracting_party, penalty_amount::DOUBLE AS penalty_amount, instance, disposition, misconduct_type, url AS misconduct_url"
query("misconduct_top_instances", f"""{WITH}, {POGO}, {_POGO_ROWS}, r AS (SELECT *, rank() OVER (PARTITION BY entity_id, cycle ORDER BY penalty_amount DESC NULLS FIRST, instance) AS rank FROM pogo),
a AS (SELECT *, rank() OVER (PARTITION BY entity_id ORDER BY penalty_amount DESC NULLS FIRST) AS rank FROM pogo) SELECT {_pogo_columns} FROM r WHERE rank <= 10 UNION ALL SELECT {_pogo_columns} FROM (SELECT * REPLACE (-1 AS cycle) FROM a) WHERE rank <= 10""")(
    lambda s, d: _longs(_plain(pr.top_misconduct(tables(s, d))), "year")
)

# --- earmarks

EARMARKS = """earmark_c AS (SELECT *, CASE WHEN fiscal_year % 2 = 0 THEN fiscal_year ELSE fiscal_year - 1 END::INTEGER AS cycle FROM earmark WHERE presidential = ''),
member_l AS (SELECT a.entity_id, m.id AS member_id, m.earmark_id FROM earmark_member m JOIN pub_attribute a ON m.crp_id = a.value WHERE a.namespace = 'urn:crp:recipient'),
recipient_l AS (SELECT e.id AS entity_id, r.id AS recipient_id, r.earmark_id FROM earmark_recipient r JOIN entity e ON e.name = r.standardized_recipient WHERE e.type = 'organization'),
latest_state AS (SELECT * FROM politician_state QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY cycle DESC) = 1),
member_m AS (SELECT m.earmark_id, m.id AS member_id, x.entity_id, standardized_name AS name, coalesce(meta.state, m.state) AS state, coalesce(meta.seat, m.chamber) AS seat, coalesce(meta.party, m.party) AS party FROM earmark_member m LEFT JOIN member_l x ON m.id = x.member_id LEFT JOIN latest_state meta ON meta.entity_id = x.entity_id),
flat AS (SELECT e.id AS earmark_id, cycle, fiscal_year, final_amount, description,
  coalesce((SELECT list(x ORDER BY x) FROM (SELECT '{"name":"' || name || '", "id":"' || coalesce(entity_id::VARCHAR, '') || '", "party":"' || party || '", "state":"' || state || '"}' AS x FROM member_m m WHERE m.earmark_id = e.id) WHERE x IS NOT NULL), []) AS members,
  coalesce((SELECT list(x ORDER BY x) FROM (SELECT '{"name":"' || CASE WHEN standardized_recipient <> '' THEN standardized_recipient ELSE raw_recipient END || '", "id":"' || coalesce(a.entity_id::VARCHAR, '') || '"}' AS x FROM earmark_recipient r LEFT JOIN recipient_l a ON r.id = a.recipient_id WHERE r.earmark_id = e.id)), []) AS recipients FROM earmark_c e)"""
query("earmark_member_links", f"{WITH}, {EARMARKS} SELECT * FROM member_l")(lambda s, d: _longs(pr.earmark_members(tables(s, d)), "entity_id"))
query("earmark_recipient_links", f"{WITH}, {EARMARKS} SELECT * FROM recipient_l")(lambda s, d: _longs(pr.earmark_recipients(tables(s, d)), "entity_id"))
query("earmark_members_with_metadata", f"{WITH}, {EARMARKS} SELECT * FROM member_m")(lambda s, d: _longs(pr.members_with_metadata(tables(s, d)), "entity_id"))
_joined = lambda df: df.withColumns({c: F.array_join(c, " ") for c in ("members", "recipients")})
_JOINED = "array_to_string(members, ' ') AS members, array_to_string(recipients, ' ') AS recipients"
query("earmarks_flattened", f"{WITH}, {EARMARKS} SELECT * REPLACE (final_amount::DOUBLE AS final_amount, {_JOINED}) FROM flat")(lambda s, d: _plain(_joined(pr.earmarks_flattened(tables(s, d)))))
_both = "SELECT entity_id, earmark_id, 'm' AS kind FROM member_l UNION ALL SELECT entity_id, earmark_id, 'r' FROM recipient_l"
query("earmark_totals", f"""{WITH}, {EARMARKS}, t AS (SELECT entity_id, cycle, count(*) AS count, sum(final_amount) AS amount FROM earmark_c e JOIN ({_both}) x ON x.earmark_id = e.id GROUP BY entity_id, cycle, kind)
SELECT entity_id, cycle, count::BIGINT AS count, amount::DOUBLE AS amount FROM (SELECT * FROM t UNION ALL SELECT entity_id, -1, sum(count), sum(amount) FROM t GROUP BY entity_id)""")(lambda s, d: _longs(_plain(pr.earmark_totals(tables(s, d))), "entity_id", "count"))
query("earmark_top_by_entity", f"""{WITH}, {EARMARKS}, t AS (SELECT x.entity_id, kind, earmark_id, cycle, fiscal_year, final_amount AS amount, description, members, recipients FROM flat JOIN ({_both}) x USING (earmark_id)),
r AS (SELECT *, rank() OVER (PARTITION BY entity_id, cycle, kind ORDER BY amount DESC) AS rank FROM t), a AS (SELECT * REPLACE (-1 AS cycle), rank() OVER (PARTITION BY entity_id ORDER BY amount DESC) AS rank FROM t)
SELECT * EXCLUDE (rank, kind) REPLACE (amount::DOUBLE AS amount, {_JOINED}) FROM (SELECT * FROM r UNION ALL SELECT * FROM a) WHERE rank <= 10""")(lambda s, d: _longs(_plain(_joined(pr.top_earmarks(tables(s, d)))), "entity_id", "fiscal_year"))
_local = """(SELECT m.entity_id, cycle, CASE WHEN NOT EXISTS (SELECT 1 FROM earmark_location l WHERE l.earmark_id = e.id) THEN 'unknown' WHEN EXISTS (SELECT 1 FROM earmark_location l WHERE l.earmark_id = e.id AND l.state = m.state) THEN 'in-state' ELSE 'out-of-state' END AS local, final_amount
  FROM earmark_c e JOIN member_m m ON e.id = m.earmark_id)"""
query("earmarks_local", f"{WITH}, {EARMARKS}, x AS {_local} {_cycles('x', 'entity_id, local', 'count(*) AS count, sum(final_amount)::DOUBLE AS amount')}")(lambda s, d: _longs(_plain(pr.earmarks_local(tables(s, d))), "entity_id"))

# --- regulations

for _kind in ("text", "submitter"):
    _match = f"m AS (SELECT document_id, entity_id FROM {_kind}_match JOIN entity e ON e.id = entity_id WHERE e.type IN ('individual', 'organization') GROUP BY ALL)"
    _rows = "SELECT entity_id, d.docket_id, d.title, d.agency, d.year, count(*) AS count FROM comment_ JOIN m USING (document_id) JOIN docket d USING (docket_id) GROUP BY ALL"
    query(f"regulation_{_kind}_matches", f"{WITH}, {_match} SELECT * FROM m")(lambda s, d, k=_kind: _longs(pr.document_matches(tables(s, d), k), "entity_id"))
    query(f"regulation_{_kind}_top_dockets", f"""{WITH}, {_match}, r AS ({_rows}), c AS (SELECT *, (year + year % 2)::INTEGER AS cycle FROM r UNION ALL SELECT *, -1 FROM r)
SELECT entity_id, cycle, agency, docket_id AS docket, year, count FROM (SELECT *, rank() OVER (PARTITION BY entity_id, cycle ORDER BY count DESC) AS rank FROM c) WHERE rank <= 10""")(lambda s, d, k=_kind: _longs(pr.top_dockets(tables(s, d), k), "entity_id"))
    query(f"regulation_{_kind}_totals", f"""{WITH}, {_match}, r AS ({_rows}) SELECT entity_id, -1 AS cycle, count(DISTINCT docket_id) AS docket_count, sum(count)::BIGINT AS document_count FROM r GROUP BY entity_id
UNION ALL SELECT entity_id, (year + year % 2)::INTEGER, count(DISTINCT docket_id), sum(count)::BIGINT FROM r WHERE year >= 1989 GROUP BY ALL""")(lambda s, d, k=_kind: _longs(pr.docket_totals(tables(s, d), k), "entity_id"))

# --- independent spending

INDEXP = """filing AS (SELECT * EXCLUDE (prev_file_num) REPLACE (CASE WHEN candidate_office = 'House' THEN candidate_district ELSE '' END AS candidate_district, regexp_replace(amount, ',|\\$', '', 'g')::DECIMAL(15,2) AS amount, regexp_replace(aggregate_amount, ',|\\$', '', 'g')::DECIMAL(15,2) AS aggregate_amount)
  FROM indexp i WHERE NOT EXISTS (SELECT 1 FROM indexp a WHERE i.spender_id = a.spender_id AND i.filing_number = a.prev_file_num)),
cand_x AS (SELECT DISTINCT entity_id, cycle, spender_id, filing_number, transaction_id FROM filing JOIN pub_attribute ON candidate_id = value AND namespace = 'urn:fec:candidate'),
comm_x AS (SELECT DISTINCT entity_id, cycle, spender_id FROM filing JOIN pub_attribute ON spender_id = value AND namespace = 'urn:fec:committee'),
spent_x AS (SELECT i.cycle, cand.id AS candidate_entity, coalesce(cand.name, candidate_name) AS candidate_name, comm.id AS committee_entity, coalesce(comm.name, spender_name) AS committee_name, support_oppose, sum(amount) AS amount
  FROM filing i LEFT JOIN cand_x ca USING (spender_id, filing_number, transaction_id) LEFT JOIN entity cand ON ca.entity_id = cand.id LEFT JOIN comm_x co ON co.spender_id = i.spender_id AND co.cycle = i.cycle LEFT JOIN entity comm ON co.entity_id = comm.id GROUP BY ALL),
total_x AS (SELECT cycle, committee_entity AS entity_id, sum(amount) AS spending_amount FROM spent_x WHERE committee_entity IS NOT NULL GROUP BY ALL)"""
query("indexp_candidate_links", f"{WITH}, {INDEXP} SELECT * FROM cand_x")(lambda s, d: _longs(el.candidate_links(tables(s, d)), "entity_id"))
query("indexp_committee_links", f"{WITH}, {INDEXP} SELECT * FROM comm_x")(lambda s, d: _longs(el.committee_links(tables(s, d)), "entity_id"))
query("indexp_by_candidate_and_committee", f"{WITH}, {INDEXP} SELECT * REPLACE (amount::DOUBLE AS amount) FROM spent_x")(lambda s, d: _longs(_plain(el.independent_spending(tables(s, d))), "candidate_entity", "committee_entity"))
query("indexp_totals", f"{WITH}, {INDEXP} SELECT * REPLACE (spending_amount::DOUBLE AS spending_amount) FROM total_x")(lambda s, d: _longs(_plain(el.independent_totals(tables(s, d))), "entity_id"))

# --- election filings

RUNNING = "running AS (SELECT * FROM candidate JOIN candidate_summary USING (candidate_id, cycle) WHERE candidate_status = 'C')"
query("fec_race_status_by_election", f"{WITH}, {RUNNING} SELECT election_year, race, {', '.join(f'max({c}) AS {c}' for c in el.STATUSES)} FROM running GROUP BY ALL")(lambda s, d: el.race_status(tables(s, d)))
_ranks = ", ".join(f"rank() OVER (PARTITION BY office, cycle ORDER BY {c} DESC) AS {n}" for c, n in el.RANKED.items())
RANKINGS = f"""{RUNNING}, field AS (SELECT count(DISTINCT candidate_id) AS num_candidates_in_field, office, 'W' AS status, cycle FROM running WHERE primary_election_status = 'W' GROUP BY ALL UNION ALL SELECT count(DISTINCT candidate_id), office, NULL, cycle FROM running GROUP BY ALL),
won AS (SELECT candidate_id, office, cycle, primary_election_status, {_ranks} FROM running WHERE primary_election_status = 'W'), everybody AS (SELECT candidate_id, office, cycle, primary_election_status, {_ranks} FROM running),
rankings AS (SELECT won.*, num_candidates_in_field FROM won JOIN field ON field.office = won.office AND field.cycle = won.cycle AND field.status = 'W'
  UNION ALL SELECT x.*, num_candidates_in_field FROM everybody x JOIN field ON field.office = x.office AND field.cycle = x.cycle WHERE x.primary_election_status IS NULL OR x.primary_election_status = 'L')"""
query("fec_rankings_by_office", f"{WITH}, {RANKINGS} SELECT * FROM rankings")(lambda s, d: _longs(el.candidate_rankings(tables(s, d)), *el.RANKED.values()))
query("fec_weekly_by_candidate", f"""{WITH}, gift AS (SELECT filer_id AS committee_id, cycle, date, amount FROM giver UNION ALL SELECT other_id, cycle, date, amount FROM group_gift),
w AS (SELECT candidate_id, cycle, race, floor(date_diff('day', make_date((year(date) + year(date) % 2 - 1)::INTEGER, 1, 1), date) / 7)::INTEGER AS week, count(*) AS count, sum(amount) AS amount FROM candidate JOIN (SELECT candidate_id, cycle FROM candidate_summary) USING (candidate_id, cycle) JOIN gift USING (committee_id, cycle) GROUP BY ALL)
SELECT * REPLACE (amount::DOUBLE AS amount), (sum(amount) OVER (PARTITION BY candidate_id, cycle, race ORDER BY week))::DOUBLE AS cumulative_raised FROM w""")(lambda s, d: _plain(el.candidate_timeline(tables(s, d))))
query("fec_gifts_to_candidates", f"""{WITH}, i AS (SELECT filer_id AS committee_id, 'indiv' AS contributor_type, contributor_name, employer, occupation, city, state, zipcode, date, amount, transaction_type, cycle FROM giver
  UNION ALL SELECT other_id, 'pac', committee_name, connected_org, '', city, state, zipcode, date, amount, transaction_type, t.cycle FROM group_gift t JOIN fec_committee c ON c.committee_id = t.filer_id AND c.cycle = t.cycle)
SELECT i.* REPLACE (amount::DOUBLE AS amount, date::VARCHAR AS date), candidate_id, candidate_name, party, race, incumbent_challenger_open AS status FROM candidate JOIN i USING (committee_id, cycle)""")(lambda s, d: _plain(el.candidate_itemized(tables(s, d)).withColumn("date", F.col("date").cast("string"))))
_SUMMARY = {"total_raised": "total_receipts - (candidate_loan_repayments + other_loan_repayments + refunds_to_individuals + refunds_to_committees)", "contributions_indiv": "total_individual_contributions - refunds_to_individuals", "contributions_pac": "contributions_from_other_committees",
    "contributions_party": "contributions_from_party_committees", "contributions_candidate": "contributions_from_candidate + loans_from_candidate - candidate_loan_repayments", "transfers_in": "authorized_transfers_from", "disbursements": "total_disbursements", "cash_on_hand": "ending_cash"}
query("fec_candidate_summary_rows", f"""{WITH}, {RANKINGS} SELECT a.entity_id, c.cycle, c.office, {", ".join(f"r.{n}" for n in el.RANKED.values())}, num_candidates_in_field AS max_rank, {", ".join(f"({x})::DOUBLE AS {n}" for n, x in _SUMMARY.items())}, ending_date::VARCHAR AS date
FROM candidate c JOIN candidate_summary s USING (candidate_id, cycle) JOIN pub_attribute a ON c.candidate_id = a.value AND a.namespace = 'urn:fec:candidate' LEFT JOIN rankings r ON r.candidate_id = c.candidate_id AND r.cycle = c.cycle""")(
    lambda s, d: _longs(_plain(el.candidate_summaries(tables(s, d)).withColumn("date", F.col("date").cast("string"))), "entity_id", *el.RANKED.values())
)
query("fec_committee_summary_rows", f"""{WITH} SELECT a.entity_id, c.cycle, {", ".join(f"sum({x})::DOUBLE AS {n}" for n, x in el.COMMITTEE_SUMS.items())}, min(through_date)::VARCHAR AS first_filing_date, max(through_date)::VARCHAR AS last_filing_date, count(*) AS num_committee_filings
FROM committee_summary c JOIN pub_attribute a ON c.committee_id = a.value AND a.namespace = 'urn:fec:committee' GROUP BY ALL""")(
    lambda s, d: _longs(_plain(el.committee_summaries(tables(s, d)).withColumns({c: F.col(c).cast("string") for c in ("first_filing_date", "last_filing_date")})), "entity_id")
)
query("fec_places_of_givers", f"""{WITH} SELECT a.entity_id, c.cycle, CASE WHEN c.office_state = i.state THEN 'in-state' ELSE 'out-of-state' END AS local, count(*) AS count, sum(amount)::DOUBLE AS amount
FROM candidate c JOIN giver i ON c.committee_id = i.filer_id AND c.cycle = i.cycle JOIN pub_attribute a ON c.candidate_id = a.value AND a.namespace = 'urn:fec:candidate' GROUP BY ALL""")(lambda s, d: _longs(_plain(el.candidate_places(tables(s, d))), "entity_id"))
query("fec_contributors_of_committees", f"""{WITH} SELECT a.entity_id, i.cycle, contributor_name, transaction_type, count(*) AS count, sum(amount)::DOUBLE AS amount FROM giver i JOIN fec_committee c ON c.committee_id = i.filer_id AND c.cycle = i.cycle
JOIN pub_attribute a ON i.filer_id = a.value AND a.namespace = 'urn:fec:committee' WHERE transaction_type IN ('10', '11', '15', '15e', '15j', '22y') GROUP BY ALL""")(lambda s, d: _longs(_plain(el.top_contributors(tables(s, d))), "entity_id"))
query("fec_politicians_by_office", f"""{WITH}, {RUNNING}, latest_state AS (SELECT entity_id, max(cycle) AS cycle FROM politician_state GROUP BY ALL)
SELECT a.entity_id, cycle, candidate_id, candidate_name, office, total_receipts::DOUBLE AS total_receipts, rank() OVER (PARTITION BY office ORDER BY total_receipts DESC) AS rank FROM running JOIN pub_attribute a ON candidate_id = a.value AND a.namespace = 'urn:fec:candidate' JOIN latest_state m USING (entity_id, cycle) WHERE incumbent_challenger_open IS NOT NULL""")(
    lambda s, d: _longs(_plain(el.by_office(tables(s, d))), "entity_id")
)

# --- bundling

BUNDLES = """latest_b AS (SELECT * FROM bundle QUALIFY row_number() OVER (PARTITION BY committee_fec_id, year(end_date), month(end_date) > 6 ORDER BY end_date DESC, filing_date DESC NULLS LAST, file_num DESC) = 1),
recipients_b AS (SELECT file_num, entity_id FROM latest_b JOIN committee_ ON committee_fec_id = committee_id AND (report_year + report_year % 2) = cycle JOIN pub_attribute ON recipient_id = value WHERE namespace IN ('urn:crp:recipient', 'urn:fec:committee')),
firms_b AS (SELECT DISTINCT lb.id AS bundle_id, a.entity_id FROM latest_b JOIN lobbyist_bundle lb USING (file_num) JOIN bundler_match a ON lb.name = a.name OR lb.employer = a.name JOIN entity e ON e.id = a.entity_id WHERE e.type = 'organization'),
people_b AS (SELECT DISTINCT lb.id AS bundle_id, a.entity_id FROM latest_b JOIN lobbyist_bundle lb USING (file_num) JOIN bundler_match a ON lb.name = a.name JOIN entity e ON e.id = a.entity_id WHERE e.type = 'individual'),
joined_b AS (SELECT cb.*, lb.id AS bundle_id, lb.name AS bundler_name, lb.employer AS bundler_employer, lb.occupation, lb.contributor_fec_id, lb.city, lb.amount AS period_amount, nullif(lb.semi_annual_amount, 0) AS semi_annual_amount,
  re.name AS standardized_recipient_name, ra.entity_id AS recipient_id, le.name AS standardized_lobbyist_name, la.entity_id AS lobbyist_id, fe.name AS standardized_firm_name, fa.entity_id AS firm_id
  FROM latest_b cb JOIN lobbyist_bundle lb USING (file_num) LEFT JOIN recipients_b ra USING (file_num) LEFT JOIN entity re ON re.id = ra.entity_id LEFT JOIN firms_b fa ON fa.bundle_id = lb.id LEFT JOIN entity fe ON fe.id = fa.entity_id LEFT JOIN people_b la ON la.bundle_id = lb.id LEFT JOIN entity le ON le.id = la.entity_id)"""
query("bundles_in_force", f"{WITH}, {BUNDLES} SELECT file_num, committee_fec_id FROM latest_b")(lambda s, d: pr.latest_bundles(tables(s, d)).select("file_num", "committee_fec_id"))
query("bundle_recipient_links", f"{WITH}, {BUNDLES} SELECT * FROM recipients_b")(lambda s, d: _longs(pr.bundle_recipients(tables(s, d)), "entity_id"))
query("bundler_firm_links", f"{WITH}, {BUNDLES} SELECT * FROM firms_b")(lambda s, d: _longs(pr.bundler_links(tables(s, d), "firm"), "entity_id"))
query("bundler_lobbyist_links", f"{WITH}, {BUNDLES} SELECT * FROM people_b")(lambda s, d: _longs(pr.bundler_links(tables(s, d), "lobbyist"), "entity_id"))
query("bundles_denormalized", f"{WITH}, {BUNDLES} SELECT * EXCLUDE (filing_date, start_date, end_date) REPLACE (period_amount::DOUBLE AS period_amount, semi_annual_amount::DOUBLE AS semi_annual_amount) FROM joined_b")(
    lambda s, d: _longs(_plain(pr.bundles_denormalized(tables(s, d)).drop("start_date", "end_date")), "recipient_id", "lobbyist_id", "firm_id", "report_year")
)
query("bundling", f"""{WITH}, {BUNDLES} SELECT recipient_id, coalesce(standardized_recipient_name, committee_name) AS recipient_name, firm_id, coalesce(standardized_firm_name, bundler_employer, bundler_name) AS firm_name, lobbyist_id,
  coalesce(standardized_lobbyist_name, standardized_firm_name, bundler_name) AS lobbyist_name, (report_year + report_year % 2)::INTEGER AS cycle, sum(coalesce(semi_annual_amount, period_amount))::DOUBLE AS amount FROM joined_b GROUP BY ALL""")(
    lambda s, d: _longs(_plain(pr.bundling(tables(s, d))), "recipient_id", "lobbyist_id", "firm_id")
)

# --- metadata

_META_KEYS = "entity_id, cycle"
_FLAGS = ", ".join(f"bool_or(coalesce(interest_group = '{c}', false)) AS {n}" for n, c in em.INTERESTS.items())
META = f"""m_rows AS (SELECT DISTINCT entity_id, cycle FROM report JOIN registrant_l USING (transaction_id) UNION SELECT DISTINCT entity_id, cycle FROM (SELECT entity_id, cycle FROM totals_c) JOIN entity e ON e.id = entity_id WHERE type = 'organization'
  UNION SELECT DISTINCT entity_id, cycle FROM report JOIN client_l USING (transaction_id) UNION SELECT DISTINCT entity_id, cycle FROM report JOIN parent_l USING (transaction_id)),
m_firm AS (SELECT entity_id, cycle, coalesce(bool_or(registrant_is_firm), false) AS lobbying_firm FROM report JOIN registrant_l USING (transaction_id) GROUP BY ALL),
m_parent AS (SELECT * FROM (SELECT o.entity_id, c.cycle, p.entity_id AS parent, count(*) AS n FROM organization_a o LEFT JOIN parent_a p USING (transaction_id) LEFT JOIN relevant c USING (transaction_id) WHERE o.entity_id <> p.entity_id OR p.entity_id IS NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY entity_id, cycle ORDER BY n DESC, parent NULLS LAST) = 1),
m_parent2 AS (SELECT * FROM (SELECT c.entity_id, r.cycle, p.entity_id AS parent, count(*) AS n FROM client_l c JOIN parent_l p USING (transaction_id) JOIN report r USING (transaction_id) WHERE c.entity_id <> p.entity_id GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY entity_id, cycle ORDER BY n DESC, parent) = 1),
m_industry AS (SELECT * FROM (SELECT o.entity_id, c.cycle, industry.entity_id AS industry, sub.entity_id AS subindustry, count(DISTINCT i.transaction_id) AS n FROM organization_a o JOIN industry_a i USING (transaction_id) JOIN relevant c USING (transaction_id)
  JOIN pub_attribute sub ON sub.entity_id = i.entity_id JOIN category acm ON acm.catcode = sub.value JOIN pub_attribute industry ON industry.value = acm.catorder WHERE sub.namespace = 'urn:crp:subindustry' AND industry.namespace = 'urn:crp:industry' GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY entity_id, cycle ORDER BY n DESC, industry, subindustry) = 1),
m_committee AS (SELECT entity_id, cycle, {_FLAGS}, CASE WHEN bool_or(committee_type = 'O') THEN true END AS is_superpac, true AS has_fec_profile FROM pub_attribute a JOIN committee_profile ON committee_id = a.value AND a.namespace = 'urn:fec:committee' GROUP BY ALL),
m_all AS (SELECT r.entity_id, r.cycle, coalesce(f.lobbying_firm, false) AS lobbying_firm, coalesce(p.parent, q.parent) AS parent_entity_id, i.industry AS industry_entity_id, i.subindustry AS subindustry_entity_id, is_superpac, {", ".join(em.INTERESTS)}, has_fec_profile,
  CASE WHEN EXISTS (SELECT 1 FROM navigation_bin b WHERE b.entity_id = r.entity_id AND navigation_bin IN ('a', 'b', 'u')) THEN true END AS is_org, CASE WHEN EXISTS (SELECT 1 FROM navigation_bin b WHERE b.entity_id = r.entity_id AND navigation_bin = 'p') THEN true END AS is_pol_group
  FROM m_rows r LEFT JOIN m_firm f USING ({_META_KEYS}) LEFT JOIN m_parent p USING ({_META_KEYS}) LEFT JOIN m_parent2 q USING ({_META_KEYS}) LEFT JOIN m_industry i USING ({_META_KEYS}) LEFT JOIN m_committee c USING ({_META_KEYS})),
m_kept AS (SELECT * FROM m_all WHERE entity_id IN (SELECT id FROM entity) AND (parent_entity_id IS NULL OR parent_entity_id IN (SELECT id FROM entity))),
m_latest AS (SELECT * FROM m_kept QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY cycle DESC) = 1)"""
_TOTALS_C = f"totals_c AS (SELECT entity_id, cycle FROM {plans._both} UNION ALL SELECT entity_id, -1 FROM {plans._both})"
query("organization_metadata", f"{WITH}, {plans.ASSOC}, {_TOTALS_C}, {META} SELECT * FROM m_kept WHERE cycle <> -1 UNION ALL SELECT l.* REPLACE (-1 AS cycle) FROM m_latest l JOIN m_kept k ON k.entity_id = l.entity_id AND k.cycle = -1")(
    lambda s, d: _longs(em.organization_metadata(meta_tables(s, d)), "entity_id")
)
_POLS = {"state": "recipient_state", "party": "recipient_party", "seat": "seat"}
query("politician_metadata_by_cycle", f"""{WITH}, {plans.ASSOC} SELECT entity_id, cycle, state, party, seat FROM (SELECT entity_id, cycle, recipient_state AS state, recipient_party AS party, seat, count(*) AS n FROM relevant JOIN recipient_a USING (transaction_id) JOIN entity e ON e.id = entity_id WHERE e.type = 'politician' GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY entity_id, cycle ORDER BY n DESC, state NULLS LAST, party NULLS LAST, seat NULLS LAST) = 1""")(lambda s, d: _longs(em.politician_metadata(plans.tables(s, d), _POLS), "entity_id"))
query("individual_metadata", f"{WITH}, {plans.ASSOC} SELECT id AS entity_id, id IN (SELECT entity_id FROM contributor_a) AS is_contributor, id IN (SELECT entity_id FROM lobbyist_l) AS is_lobbyist FROM entity WHERE type = 'individual'")(
    lambda s, d: _longs(em.individual_metadata(lobbying.tables(s, d)), "entity_id")
)
query("affiliations", f"{WITH}, {plans.ASSOC} SELECT DISTINCT c.entity_id AS individual_entity_id, o.entity_id AS organization_entity_id FROM contributor_a c JOIN organization_a o USING (transaction_id) JOIN entity e ON e.id = c.entity_id WHERE e.type = 'individual' AND o.entity_id IN (SELECT id FROM entity)")(
    lambda s, d: _longs(em.affiliations(plans.tables(s, d)), "individual_entity_id", "organization_entity_id")
)
query("revolving_door", f"""{WITH} SELECT DISTINCT p.entity_id AS politician_entity_id, l.entity_id AS lobbyist_entity_id FROM door_lobbyist x JOIN attribute p ON p.value = x.candidate_ext_id JOIN attribute l ON l.value[1:11] = x.lobbyist_ext_id[1:11] WHERE p.namespace = 'urn:crp:recipient' AND l.namespace = 'urn:crp:individual'""")(
    lambda s, d: _longs(em.revolving_door(plans.tables(s, d) | {"lobbyist": tables(s, d)["door_lobbyist"]}), "politician_entity_id", "lobbyist_entity_id")
)
