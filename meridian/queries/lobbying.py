"""Lobbying plans over stand-in records, with the SQL that must give the same rows."""

from __future__ import annotations

from meridian.plans import lobbying as lb
from meridian.queries import plans
from meridian.queries.base import made_once, query, standins, stored

STANDINS = {
    "lobbying": """SELECT o_orderkey AS transaction_id, year(o_orderdate) AS year, CAST(o_totalprice AS DECIMAL(15,2)) AS amount, o_orderkey % 10 <> 3 AS use,
  CASE o_orderkey % 5 WHEN 0 THEN 'Firm ' || CAST(o_custkey AS STRING) WHEN 1 THEN 'PARENT ' || CAST(o_custkey % 5 AS STRING) ELSE 'org ' || CAST(o_orderkey % 9 AS STRING) END AS registrant_name, o_orderkey % 5 > 1 AS registrant_is_firm,
  CASE WHEN o_custkey % 2 = 1 THEN 'FIRM ' || CAST(o_custkey AS STRING) WHEN o_custkey % 4 = 0 THEN NULL ELSE 'Nobody ' || CAST(o_custkey AS STRING) END AS client_name,
  CASE c_nationkey % 3 WHEN 0 THEN 'Org ' || CAST(c_nationkey AS STRING) WHEN 1 THEN '' END AS client_parent_name, CASE WHEN o_orderkey % 6 > 0 THEN upper(left(c_mktsegment, 5)) END AS client_category,
  o_orderkey % 3 > 0 AS include_in_industry_totals, o_orderkey % 7 = 1 AS filing_included_nsfs, CASE o_orderkey % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'b' WHEN 2 THEN '' ELSE 'm' END AS filing_type
  FROM orders JOIN customer ON o_custkey = c_custkey""",
    "lobbyist": """SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS transaction_id, 'Lobbyist ' || CAST(l_suppkey % 40 AS STRING) AS lobbyist_name,
  CASE WHEN l_suppkey % 5 > 0 THEN lpad(CAST(l_suppkey % 40 * 4 AS STRING), 11, '0') || CASE l_linenumber % 3 WHEN 0 THEN '0' WHEN 1 THEN '' ELSE '1' END END AS lobbyist_ext_id FROM lineitem WHERE l_linenumber <= 3""",
    "issue": "SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS transaction_id, 'Issue ' || CAST(l_partkey % 13 AS STRING) AS general_issue FROM lineitem WHERE l_linenumber <= 4",
    "bill": """SELECT l_orderkey * 8 + l_linenumber AS issue_id, 110 + l_suppkey % 2 AS congress_no, CASE l_partkey % 3 WHEN 0 THEN 'hr' ELSE 's' END AS bill_type, l_partkey % 11 AS bill_no,
  CASE WHEN l_partkey % 4 > 0 THEN 'Act ' || CAST(l_partkey % 11 AS STRING) END AS bill_name FROM lineitem WHERE l_linenumber IN (1, 3)""",
    "lobbying_metadata": f"""SELECT entity_id, cycle, parent_entity_id, CASE entity_id % 3 WHEN 0 THEN {plans.INDUSTRY} WHEN 1 THEN {plans.INDUSTRY + 1} END AS industry_entity_id,
  CASE WHEN entity_id % 6 = 0 THEN {plans.INDUSTRY + 10} END AS subindustry_entity_id FROM org_metadata""",
}
WITH = f"WITH {plans.CTES}, {', '.join(f'{n} AS ({s})' for n, s in STANDINS.items())}"


def tables(spark, sf, linked: bool = True) -> lb.Tables:
    """The stand-ins and those of contributions, without the latter's links; linked: with the reports' links as one more table."""
    base = plans.tables(spark, sf, linked=False)

    def make():
        made = standins(spark, sf, ("orders", "customer", "lineitem"), STANDINS, base)
        return made | {"org_metadata": made.pop("lobbying_metadata")}

    t = base | made_once(spark, ("lobbying", sf), make)
    if not linked:
        return t
    return t | made_once(spark, ("lobbying", sf, "linked"), lambda: {"lobbying_linked": stored(lb.linked(t), "lobbying_linked")})


def _named(column: str) -> str:
    return f"SELECT a.entity_id, l.transaction_id FROM alias a JOIN entity e ON e.id = a.entity_id JOIN lobbying l ON lower(a.alias) = lower(l.{column}) WHERE e.type = 'organization'"


LINKS = f"""client_l AS ({_named("client_name")}), parent_l AS ({_named("client_parent_name")}), registrant_l AS ({_named("registrant_name")}),
biggest_l AS (SELECT coalesce(p.entity_id, c.entity_id) AS entity_id, transaction_id FROM client_l c FULL OUTER JOIN parent_l p USING (transaction_id)),
industry_l AS (SELECT a.entity_id, l.transaction_id FROM attribute a JOIN entity e ON e.id = a.entity_id JOIN category m ON a.value = m.catorder JOIN lobbying l ON lower(m.catcode) = lower(l.client_category) WHERE e.type = 'industry'
  UNION SELECT a.entity_id, l.transaction_id FROM attribute a JOIN entity e ON e.id = a.entity_id JOIN lobbying l ON lower(a.value) = lower(l.client_category) WHERE e.type = 'industry'),
lobbyist_l AS (SELECT y.entity_id, l.id FROM (SELECT entity_id, coalesce(max(exact), max(lobbyist_ext_id)) AS lobbyist_ext_id
  FROM (SELECT a.entity_id, CASE WHEN a.value = l.lobbyist_ext_id THEN l.lobbyist_ext_id END AS exact, l.lobbyist_ext_id FROM attribute a JOIN lobbyist l ON a.value[1:11] = l.lobbyist_ext_id[1:11] WHERE a.namespace = 'urn:crp:individual') GROUP BY entity_id) y
  JOIN lobbyist l USING (lobbyist_ext_id)),
report AS (SELECT *, CASE WHEN year % 2 = 0 THEN year ELSE year + 1 END::INTEGER AS cycle FROM lobbying WHERE use),
all_client_l AS (SELECT * FROM (SELECT * FROM client_l UNION SELECT * FROM parent_l) UNION ALL SELECT * FROM industry_l)"""
SQL_WITH = f"{WITH}, {LINKS}"

for _kind in ("client", "parent", "registrant", "industry", "biggest"):
    query(f"lobby_{_kind}_links", f"{SQL_WITH} SELECT entity_id, transaction_id FROM {_kind}_l")(lambda s, d, k=_kind: lb.association(tables(s, d, linked=False), k).selectExpr("cast(entity_id as long) as entity_id", "transaction_id"))
query("lobby_lobbyist_links", f"{SQL_WITH} SELECT entity_id, id FROM lobbyist_l")(lambda s, d: lb.lobbyists(tables(s, d)).selectExpr("cast(entity_id as long) as entity_id", "id"))

BY_YEAR = """by_year AS (
  SELECT entity_id, year, coalesce(p.count, f.count, i.count, o.count, 0) AS count, coalesce(i.amount, o.amount, 0) AS non_firm_spending, coalesce(f.amount, 0) AS firm_income,
    coalesce(f.inc, i.inc, o.inc, false) AS include_in_industry_totals, coalesce(i.nsfs, o.nsfs, false) AS include_nsfs, coalesce(i.filing_type, o.filing_type, '') AS filing_type
  FROM (SELECT entity_id, r.year, count(*) AS count FROM report r JOIN lobbyist l USING (transaction_id) JOIN lobbyist_l x ON x.id = l.id GROUP BY ALL) p
  FULL JOIN (SELECT entity_id, r.year, count(*) AS count, sum(amount) AS amount, include_in_industry_totals AS inc FROM report r JOIN registrant_l USING (transaction_id) WHERE registrant_is_firm GROUP BY ALL) f USING (entity_id, year)
  FULL JOIN (SELECT entity_id, r.year, count(*) AS count, sum(amount) AS amount, include_in_industry_totals AS inc, filing_included_nsfs AS nsfs, filing_type FROM report r JOIN registrant_l USING (transaction_id) WHERE NOT registrant_is_firm GROUP BY ALL) i USING (entity_id, year)
  FULL JOIN (SELECT entity_id, r.year, count(*) AS count, sum(amount) AS amount, include_in_industry_totals AS inc, filing_included_nsfs AS nsfs, filing_type FROM report r JOIN client_l USING (transaction_id) WHERE registrant_is_firm GROUP BY ALL) o USING (entity_id, year)),
entity_year AS (SELECT entity_id, year, include_in_industry_totals, include_nsfs, filing_type, sum(count)::BIGINT AS count, sum(non_firm_spending) AS non_firm_spending, sum(firm_income) AS firm_income FROM by_year GROUP BY ALL)"""
ROLLED = f"""{BY_YEAR}, own AS (SELECT y.*, m.parent_entity_id, m.industry_entity_id, m.subindustry_entity_id FROM entity_year y LEFT JOIN lobbying_metadata m ON m.entity_id = y.entity_id AND m.cycle = y.year + y.year % 2),
rolled AS (SELECT entity_id, year, sum(count)::BIGINT AS count, sum(non_firm_spending) AS non_firm_spending, sum(firm_income) AS firm_income FROM (
  SELECT entity_id, year, count, non_firm_spending, firm_income FROM own
  UNION ALL SELECT parent_entity_id, year, count, non_firm_spending, firm_income FROM own c WHERE parent_entity_id IS NOT NULL AND (filing_type = 'b' OR EXISTS (SELECT 1 FROM own p WHERE p.entity_id = c.parent_entity_id AND p.year = c.year AND (p.include_nsfs OR p.filing_type = 'n')))
  UNION ALL SELECT industry_entity_id, year, count, non_firm_spending, firm_income FROM own WHERE industry_entity_id IS NOT NULL AND include_in_industry_totals
  UNION ALL SELECT subindustry_entity_id, year, count, non_firm_spending, firm_income FROM own WHERE subindustry_entity_id IS NOT NULL AND include_in_industry_totals) GROUP BY ALL)"""
_MONEY = "REPLACE (non_firm_spending::DOUBLE AS non_firm_spending, firm_income::DOUBLE AS firm_income)"
query("lobby_by_entity_year", f"{SQL_WITH}, {BY_YEAR} SELECT * {_MONEY} FROM entity_year")(lambda s, d: plans._plain(lb.by_entity_year(tables(s, d))))
query("lobby_by_year_rolled_up", f"{SQL_WITH}, {ROLLED} SELECT * {_MONEY} FROM rolled")(lambda s, d: plans._plain(lb.by_year_rolled_up(tables(s, d))))
query("lobby_by_cycle_rolled_up", f"""{SQL_WITH}, {ROLLED}, cycles AS (SELECT entity_id, (year + year % 2)::INTEGER AS cycle, count, non_firm_spending, firm_income FROM rolled UNION ALL SELECT entity_id, -1, count, non_firm_spending, firm_income FROM rolled)
SELECT entity_id, cycle, sum(count)::BIGINT AS count, sum(non_firm_spending)::DOUBLE AS non_firm_spending, sum(firm_income)::DOUBLE AS firm_income FROM cycles GROUP BY ALL""")(lambda s, d: plans._plain(lb.by_cycle_rolled_up(tables(s, d))))

_ISSUES, _PEOPLE = "JOIN issue i USING (transaction_id)", "JOIN lobbyist l USING (transaction_id)"
_BILLS = f"{_ISSUES} JOIN bill b ON b.issue_id = i.id"
_CLIENT, _FIRM, _PERSON = "JOIN all_client_l x USING (transaction_id) JOIN entity ce ON ce.id = x.entity_id", "JOIN registrant_l x USING (transaction_id)", f"{_PEOPLE} JOIN lobbyist_l x ON x.id = l.id"
_INC = "(ce.type <> 'industry' OR r.include_in_industry_totals)"
_BY_AMOUNT = "amount DESC NULLS FIRST, count DESC"
_B = "b.bill_type, b.bill_no, b.congress_no, b.bill_name"
_NAME = "upper(l.lobbyist_name) AS lobbyist_name, la.entity_id AS lobbyist_entity"
#: List to its joins, columns, order and filter.
LISTS = {
    "registrants_for_client": (f"{_CLIENT} LEFT JOIN registrant_l ra USING (transaction_id)", "r.registrant_name, ra.entity_id AS registrant_entity", _BY_AMOUNT, f"NOT registrant_is_firm AND {_INC}"),
    "issues_for_client": (f"{_CLIENT} {_ISSUES}", "i.general_issue AS issue", "count DESC, issue", _INC),
    "bills_for_client": (f"{_CLIENT} {_BILLS}", _B, "count DESC, bill_type, bill_no, congress_no, bill_name", _INC),
    "lobbyists_for_client": (f"{_CLIENT} {_PEOPLE} LEFT JOIN lobbyist_l la ON la.id = l.id", _NAME, "count DESC, lobbyist_name", _INC),
    "registrants_for_lobbyist": (f"{_PERSON} LEFT JOIN registrant_l ra ON ra.transaction_id = r.transaction_id", "r.registrant_name, ra.entity_id AS registrant_entity", "count DESC, registrant_name", "true"),
    "issues_for_lobbyist": (f"{_PERSON} {_ISSUES}", "i.general_issue AS issue", "count DESC, issue", "true"),
    "clients_for_lobbyist": (f"{_PERSON} LEFT JOIN client_l ca ON ca.transaction_id = r.transaction_id", "r.client_name, ca.entity_id AS client_entity", "count DESC, client_name", "true"),
    "clients_for_registrant": (f"{_FIRM} LEFT JOIN client_l ca USING (transaction_id)", "r.client_name, ca.entity_id AS client_entity", _BY_AMOUNT, "true"),
    "issues_for_registrant": (f"{_FIRM} {_ISSUES}", "i.general_issue AS issue", "count DESC, issue", "true"),
    "bills_for_registrant": (f"{_FIRM} {_BILLS}", _B, "count DESC, bill_type, bill_no, congress_no, bill_name", "true"),
    "lobbyists_for_registrant": (f"{_FIRM} {_PEOPLE} LEFT JOIN lobbyist_l la ON la.id = l.id", _NAME, "count DESC, lobbyist_name", "true"),
}
for _list, (_joins, _what, _order, _where) in LISTS.items():
    _amount, _sum = (", sum(amount) AS amount", ", sum(amount) AS amount") if _order == _BY_AMOUNT else ("", "")
    _out = "* EXCLUDE (rank)" + (" REPLACE (count::BIGINT AS count, amount::DOUBLE AS amount)" if _amount else " REPLACE (count::BIGINT AS count)")
    query(f"lobby_{_list}", f"""{SQL_WITH}, c AS (SELECT x.entity_id, r.cycle, {_what}, count(*) AS count{_amount} FROM report r {_joins} WHERE {_where} GROUP BY ALL),
g AS (SELECT * FROM c UNION ALL SELECT * REPLACE (-1 AS cycle) FROM (SELECT * EXCLUDE (count{", amount" if _amount else ""}), sum(count) AS count{_sum} FROM (SELECT * REPLACE (-1 AS cycle) FROM c) GROUP BY ALL))
SELECT {_out} FROM (SELECT *, rank() OVER (PARTITION BY entity_id, cycle ORDER BY {_order}) AS rank FROM g) WHERE rank <= 10""")(lambda s, d, n=_list: plans._plain(lb.top_list(tables(s, d), n)))

for _what in ("issues", "bills"):
    _keys = "issue" if _what == "issues" else "congress_no, bill_type, bill_no"
    _from = f"report r JOIN biggest_l x USING (transaction_id) {_ISSUES if _what == 'issues' else _BILLS}"
    _cols = "i.general_issue AS issue" if _what == "issues" else "b.congress_no, b.bill_type, b.bill_no"
    _across = f"""a0 AS (SELECT cycle, {_keys}, count(*) AS count, sum(amount) AS amount FROM (SELECT DISTINCT r.transaction_id, {_cols}, r.cycle, amount FROM {_from}) GROUP BY ALL),
a1 AS (SELECT * FROM a0 UNION ALL SELECT -1, {_keys}, sum(count), sum(amount) FROM a0 GROUP BY {_keys}),
a AS (SELECT *, rank() OVER (PARTITION BY cycle ORDER BY amount DESC) AS rank_by_amount, rank() OVER (PARTITION BY cycle ORDER BY count DESC) AS rank_by_count FROM a1)"""
    _orgs = f"""o0 AS (SELECT cycle, {_keys}, entity_id AS client_entity, count(*) AS count, sum(amount) AS amount FROM (SELECT DISTINCT r.transaction_id, {_cols}, x.entity_id, r.cycle, amount FROM {_from}) GROUP BY ALL),
o1 AS (SELECT * FROM o0 UNION ALL SELECT -1, {_keys}, client_entity, sum(count), sum(amount) FROM o0 GROUP BY {_keys}, client_entity),
o AS (SELECT *, rank() OVER (PARTITION BY cycle, {_keys} ORDER BY amount DESC) AS rank_by_amount, rank() OVER (PARTITION BY cycle, {_keys} ORDER BY count DESC) AS rank_by_count FROM o1)"""
    query(f"lobby_{_what}_across_biggest_orgs", f"{SQL_WITH}, {_across} SELECT * REPLACE (count::BIGINT AS count, amount::DOUBLE AS amount) FROM a")(lambda s, d, w=_what: plans._plain(lb.topics_across(tables(s, d), w)))
    query(f"lobby_biggest_orgs_for_{_what}", f"{SQL_WITH}, {_orgs} SELECT * REPLACE (count::BIGINT AS count, amount::DOUBLE AS amount) FROM o")(lambda s, d, w=_what: plans._plain(lb.orgs_for_topics(tables(s, d), w)))
    query(f"lobby_top_biggest_orgs_for_top_{_what}", f"""{SQL_WITH}, {_across}, {_orgs} SELECT cycle, {_keys}, e.name, client_entity AS id, o.count::BIGINT AS client_count, o.rank_by_count AS client_rank_by_count, o.amount::DOUBLE AS client_amount, o.rank_by_amount AS client_rank_by_amount,
  a.count::BIGINT AS topic_total_count, a.rank_by_count AS topic_rank_by_count, a.amount::DOUBLE AS topic_total_amount, a.rank_by_amount AS topic_rank_by_amount FROM a JOIN o USING (cycle, {_keys}) JOIN entity e ON e.id = client_entity WHERE o.rank_by_amount <= 10 AND a.rank_by_amount <= 10""")(
        lambda s, d, w=_what: plans._plain(lb.top_orgs_for_top_topics(tables(s, d), w))
    )
