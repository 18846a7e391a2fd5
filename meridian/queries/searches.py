"""Record search and entity search over stand-ins, with SQL written from what a request means."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from meridian.plans import entity_search as es
from meridian.plans import search as rs
from meridian.queries.base import query, table
from meridian.queries.plans import CTES, tables

#: Stand-ins of the searches' own, read by Spark and DuckDB both; they build on those of the plans.
VIEWS = {
    "metro": "SELECT r_regionkey AS id, 'Greater ' || lower(r_name) || ' area' AS name FROM region",
    "earmark": "SELECT p_partkey AS id, 2000 + p_size % 10 AS fiscal_year, CAST(p_retailprice AS DECIMAL(15,2)) AS final_amount, p_brand AS bill, p_type AS bill_section, '' AS bill_subsection, p_name AS description, CASE WHEN p_size % 3 > 0 THEN p_type END AS notes FROM part",
    "earmark_recipient": "SELECT l_partkey AS earmark_id, 'Supplier ' || CAST(l_suppkey % 20 AS STRING) AS raw_recipient, CASE WHEN l_linenumber % 2 = 0 THEN 'Works ' || l_returnflag ELSE '' END AS standardized_recipient FROM lineitem WHERE l_linenumber < 3",
    "earmark_member": "SELECT l_partkey AS earmark_id, CASE WHEN l_suppkey % 3 = 0 THEN 'D' ELSE 'R' END AS party, CASE WHEN l_orderkey % 4 = 0 THEN 'OH' ELSE 'TX' END AS state, 'Member ' || CAST(l_suppkey AS STRING) AS raw_name, '' AS standardized_name FROM lineitem WHERE l_linenumber = 3",
    "fara_payment": "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, CAST(o_totalprice AS DECIMAL(15,2)) AS amount, CAST(o_custkey % 7 AS STRING) AS registrant_id, o_orderpriority AS purpose, 'x' AS import_reference FROM orders",
    "individual_flags": "SELECT id AS entity_id, id % 3 = 0 AS is_lobbyist, id % 4 = 0 AS is_contributor FROM entity WHERE type = 'individual'",
    "org_details": "SELECT entity_id, cycle, CASE WHEN entity_id % 17 > 0 THEN lobbying_firm END AS lobbying_firm, entity_id % 4 = 1 AS is_superpac, (entity_id + cycle) % 5 = 2 AS is_corporation, entity_id % 19 = 3 AS is_cooperative, CAST(NULL AS BOOLEAN) AS is_corp_w_o_capital_stock FROM org_metadata",
    "politician_details": "SELECT entity_id, cycle, seat, CASE (entity_id + cycle) % 3 WHEN 0 THEN 'OH' WHEN 1 THEN 'TX' ELSE 'CA' END AS state, CASE entity_id % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'R' WHEN 2 THEN 'I' WHEN 3 THEN 'L' END AS party FROM politician_metadata",
    "codes": "SELECT * FROM attribute UNION ALL SELECT id, 'urn:fec:committee', CASE WHEN id % 3 = 0 THEN '' ELSE 'C' || CAST(id AS STRING) END FROM entity WHERE type = 'organization' AND id % 7 < 2",
    "money": "SELECT id AS entity_id, -1 AS cycle, id % 6 AS contributor_count, CASE WHEN id % 4 > 0 THEN id % 9 ELSE 0 END AS recipient_count, CAST(id % 1000 * 1000 AS DECIMAL(15,2)) AS contributor_amount, CAST(CASE WHEN id % 4 > 0 THEN id % 500 * 3000 ELSE 0 END AS DECIMAL(15,2)) AS recipient_amount FROM entity WHERE id % 8 > 0 UNION ALL SELECT id, 1996, 1, 1, CAST(5 AS DECIMAL(15,2)), CAST(5 AS DECIMAL(15,2)) FROM entity",
    "lobbied": "SELECT id AS entity_id, -1 AS cycle, id % 11 AS count, CAST(id % 50 * 700 AS DECIMAL(15,2)) AS firm_income, CAST(id % 30 * 900 AS DECIMAL(15,2)) AS non_firm_spending FROM entity WHERE id % 3 > 0",
}
#: The figures that the stand-ins of the plans lack: each of other entities and cycles, so that every table alone has some.
for _i, (_table, (_key, _figures)) in enumerate(list(es.TOTALS.items())[2:], 3):
    _columns = ", ".join(f"CAST((id + cycle * {k}) % {11 * _i} + 1 AS {'INT' if n.endswith('count') else 'DECIMAL(15,2)'}) AS {c}" for k, (n, c) in enumerate(_figures.items(), 1))
    VIEWS[_table] = f"SELECT id AS {_key}, cycle, {_columns} FROM entity CROSS JOIN (VALUES (-1), (1996), ({2000 + 2 * _i})) AS v(cycle) WHERE id % {_i} < 2"
WITH = f"WITH {CTES}, {', '.join(f'{n} AS ({s})' for n, s in VIEWS.items())}"


def _all(spark, sf) -> dict:
    t = dict(tables(spark, sf))
    for name, df in t.items():
        df.createOrReplaceTempView(name)
    for name in ("part", "lineitem", "orders", "region"):
        table(spark, sf, name).createOrReplaceTempView(name)
    for name, sql in VIEWS.items():
        t[name] = spark.sql(sql)
    return {**t, "individual_metadata": t["individual_flags"], "org_metadata": t["org_details"], "politician_metadata": t["politician_details"], "attribute": t["codes"], "entity_totals": t["money"], "lobbying_totals": t["lobbied"]}


def _plain(df):
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def _has(column: str, *words: str) -> str:
    """SQL: the column's words have all of these."""
    found = f"regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+')"
    return "(" + " AND ".join(f"coalesce(list_contains({found}, '{w}'), false)" for w in words) + ")"


_BRIEF = "transaction_id, cycle::INTEGER AS cycle, amount::DOUBLE AS amount, transaction_type, contributor_name, contributor_state"
_BRIEF_COLUMNS = [c.split("::")[0].strip() for c in _BRIEF.split(",")]


@query("search_contributions", f"""{WITH} SELECT {_BRIEF} FROM contribution WHERE cycle IN (1995, 1996, 1997, 1998) AND amount BETWEEN 20000 AND 400000 AND transaction_type IN ('', '10', '11', '15', '15e', '15j', '22y', '24k', '24r', '24z', '29')
  AND ({_has('organization_name', 'org', '3')} OR {_has('parent_organization_name', 'org', '3')} OR {_has('contributor_name', 'org', '3')} OR {_has('organization_name', 'person')} OR {_has('parent_organization_name', 'person')} OR {_has('contributor_name', 'person')})
  ORDER BY cycle DESC, amount DESC, transaction_id LIMIT 200 OFFSET 200""")
def search_contributions(spark, sf):
    """Groups of types, text over several columns, both years of a cycle, the second page."""
    t = _all(spark, sf)
    t["contribution"] = t["contribution"].withColumn("contributor_employer", F.lit(None).cast("string"))
    asked = {"cycle": "1996|1998", "amount": "><|20000|400000", "general_transaction_type": "standard|electioneering", "contributor_ft": "Org & 3 Inc|person", "per_page": "200", "page": "2", "format": "json"}
    return _plain(rs.search(t, "contributions", asked).select(*_BRIEF_COLUMNS))


@query("search_contributions_by_place", f"""{WITH} SELECT {_BRIEF} FROM contribution c WHERE transaction_type NOT IN ('24a', '24n', '29') AND contributor_state IN ('NATION_1', 'NATION_2', 'NATION_3')
  AND EXISTS (SELECT 1 FROM category k WHERE k.catcode = c.contributor_category AND (k.catcode IN ('BUILD') OR k.catorder IN ('A00', 'A1')))
  AND EXISTS (SELECT 1 FROM zip z JOIN metro m ON z.msa_id = m.id WHERE z.zipcode = c.contributor_zipcode AND {_has('m.name', 'asia')})""")
def search_contributions_by_place(spark, sf):
    """Orders and codes of industries, metropolitan areas, for a candidate; not cut into pages."""
    t = _all(spark, sf)
    return _plain(rs.select(t, "contributions", {"for_against": "for", "contributor_state": "nation_1|nation_2|NATION_3", "contributor_industry": "a00|x,BUILD", "msa_ft": "asia"}).select(*_BRIEF_COLUMNS))


_RECIPIENTS = "coalesce((SELECT string_agg(CASE WHEN standardized_recipient <> '' THEN standardized_recipient ELSE raw_recipient END, '; ' ORDER BY CASE WHEN standardized_recipient <> '' THEN standardized_recipient ELSE raw_recipient END) FROM earmark_recipient r WHERE r.earmark_id = e.id), '')"


@query("search_child_text", f"""{WITH} SELECT id, fiscal_year::INTEGER AS fiscal_year, final_amount::DOUBLE AS final_amount, description, {_RECIPIENTS} AS recipients FROM earmark e WHERE fiscal_year IN (2001, 2002, 2003, 2004) AND final_amount >= 1000
  AND EXISTS (SELECT 1 FROM earmark_recipient r WHERE r.earmark_id = e.id AND ({_has('standardized_recipient', 'works', 'r')} OR {_has('raw_recipient', 'supplier', '7')}))
  AND EXISTS (SELECT 1 FROM earmark_member m WHERE m.earmark_id = e.id AND party = 'D') AND EXISTS (SELECT 1 FROM earmark_member m WHERE m.earmark_id = e.id AND state = 'OH')""")
def search_child_text(spark, sf):
    """Text and values of children: no record twice, however many children match."""
    t = _all(spark, sf)
    found = rs.select(t, "earmarks", {"year": "2001|2002|2003|2004", "amount": ">|1000", "recipient": "works r|supplier 7", "member_party": "D", "member_state": "OH"})
    shown = F.when(F.col("standardized_recipient") != "", F.col("standardized_recipient")).otherwise(F.col("raw_recipient"))
    return _plain(rs.with_children(found.select("id", "fiscal_year", "final_amount", "description"), "id", {"recipients": (t["earmark_recipient"], "earmark_id", shown)}))


@query("search_whole_set", f"{WITH} SELECT * EXCLUDE (import_reference) REPLACE (amount::DOUBLE AS amount) FROM fara_payment WHERE registrant_id IN ('1', '5') AND {_has('purpose', 'urgent')} AND date >= DATE '1995-06-01'")
def search_whole_set(spark, sf):
    return _plain(rs.search(_all(spark, sf), "fara/payment", {"registrant_id": "1|5", "purpose_ft": "urgent", "date": ">|1995-06-01"}))


@query("search_after_last_row", f"""{WITH} SELECT * EXCLUDE (import_reference) REPLACE (amount::DOUBLE AS amount) FROM fara_payment WHERE registrant_id = '2' AND (date < DATE '1998-03-01' OR (date = DATE '1998-03-01' AND id > 1000)) ORDER BY date DESC NULLS FIRST, id LIMIT 500""")
def search_after_last_row(spark, sf):
    return _plain(rs.search(_all(spark, sf), "fara/payment", {"registrant_id": "2", "per_page": "500"}, after={"date": date(1998, 3, 1), "id": 1000}))


@query("label_transaction_types", f"""WITH labels(code, label) AS (VALUES {", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in rs.TYPE_LABELS.items())}), {CTES}
  SELECT transaction_id, coalesce(label, '') AS transaction_type_description FROM contribution LEFT JOIN labels ON transaction_type = code""")
def label_transaction_types(spark, sf):
    codes = F.col("transaction_type")
    return _all(spark, sf)["contribution"].select("transaction_id", F.coalesce(rs.mapped(codes, rs.TYPE_LABELS), F.lit("")).alias("transaction_type_description"))


def _latest(view: str, columns: str) -> str:
    return f"(SELECT DISTINCT ON (entity_id) entity_id, {columns} FROM {view} ORDER BY entity_id, cycle DESC)"


_FIGURES = "LEFT JOIN money a ON a.entity_id = e.id AND a.cycle = -1 LEFT JOIN lobbied l ON l.entity_id = e.id AND l.cycle = -1"
_FOUND = "e.id IN (SELECT entity_id FROM alias WHERE {})"


@query("entity_search", f"""{WITH} SELECT e.id, e.name, e.type, coalesce(contributor_count, 0)::INTEGER AS count_given, coalesce(recipient_count, 0)::INTEGER AS count_received, coalesce(l.count, 0)::INTEGER AS count_lobbied,
  coalesce(contributor_amount, 0)::DOUBLE AS total_given, coalesce(recipient_amount, 0)::DOUBLE AS total_received, coalesce(firm_income, 0)::DOUBLE AS firm_income, coalesce(non_firm_spending, 0)::DOUBLE AS non_firm_spending, p.state, p.party, p.seat, o.lobbying_firm, o.is_superpac
  FROM entity e {_FIGURES} LEFT JOIN {_latest('politician_details', 'state, party, seat')} p ON p.entity_id = e.id LEFT JOIN {_latest('org_details', 'lobbying_firm, is_superpac')} o ON o.entity_id = e.id
  WHERE {_FOUND.format(_has('alias', 'politician'))} AND (e.type <> 'politician' OR recipient_count > 0 OR recipient_amount > 0)""")
def entity_search(spark, sf):
    return es.search(_all(spark, sf), "Politician (inc)")


_SCORE = """CASE e.type WHEN 'politician' THEN 2 * coalesce(recipient_amount, 0)::DOUBLE / 715550915 WHEN 'individual' THEN coalesce(contributor_amount, 0)::DOUBLE / 73301345.75 + coalesce(l.count, 0) / 8882
  WHEN 'organization' THEN coalesce(contributor_amount, 0)::DOUBLE / 364255258.20 + coalesce(non_firm_spending, 0)::DOUBLE / 969305680.0 + coalesce(firm_income, 0)::DOUBLE / 560548185.0
  WHEN 'industry' THEN coalesce(contributor_amount, 0)::DOUBLE / 3648608028.38 + coalesce(non_firm_spending, 0)::DOUBLE / 5757475979.0 + coalesce(firm_income, 0)::DOUBLE / 2225030909.0 ELSE 0 END"""


def _advanced(words: str, also: str) -> str:
    return f"{WITH} SELECT e.id, e.name, e.type, round({_SCORE}, 12) AS score FROM entity e {_FIGURES} WHERE {_FOUND.format(_has('alias', words))} AND {also}"


def _full(name: str) -> str:
    key, figures = es.TOTALS[name]
    return f"(SELECT {key} AS id, cycle, {', '.join(f'{c} AS {n}' for n, c in figures.items())} FROM { {'entity_totals': 'money', 'lobbying_totals': 'lobbied'}.get(name, name)})"


_FULL = " FULL JOIN ".join(f"{_full(n)} t{i}{' USING (id, cycle)' if i else ''}" for i, n in enumerate(es.TOTALS))
query("entity_full_totals", f"""{WITH} SELECT id, cycle::INTEGER AS cycle, {", ".join(f"coalesce({n}, 0)::{'INTEGER' if n.endswith('count') else 'DOUBLE'} AS {n}" for _, f in es.TOTALS.values() for n in f)} FROM {_FULL}""")(
    lambda s, d: es.totals(_all(s, d))
)

_COMPANY = "is_corporation OR is_cooperative OR is_corp_w_o_capital_stock"
_OTHER = f"""e.type = 'organization' AND e.id IN (SELECT o.entity_id FROM {_latest('org_details', 'lobbying_firm, is_corporation, is_cooperative, is_corp_w_o_capital_stock')} o
  WHERE NOT lobbying_firm AND (o.entity_id NOT IN (SELECT entity_id FROM codes WHERE namespace = 'urn:fec:committee' AND value <> '') OR {_COMPANY}))"""
for _name, _words, _params, _also in (
    ("any", "firm", {"type": "organization,planet", "subtype": "none"}, "e.type = 'organization'"),
    ("contributors", "individual", {"subtype": "contributors"}, "e.type = 'individual' AND e.id IN (SELECT entity_id FROM individual_flags WHERE is_contributor)"),
    ("lobbyists", "individual", {"subtype": "lobbyists", "type": "industry"}, "e.type = 'individual' AND e.id IN (SELECT entity_id FROM individual_flags WHERE is_lobbyist)"),
    ("politicians", "politician", {"subtype": "politicians", "state": "OH", "party": "O", "seat": "none"}, "e.type = 'politician' AND e.id IN (SELECT entity_id FROM politician_details WHERE state = 'OH' AND party NOT IN ('R', 'D'))"),
    ("all_politicians", "politician", {"subtype": "politicians", "state": "XX"}, "e.type = 'politician'"),
    ("industries", "industry", {"subtype": "industries"}, "e.type = 'industry'"),
    ("lobbying_firms", "firm", {"subtype": "lobbying_firms"}, f"e.type = 'organization' AND e.id IN (SELECT entity_id FROM {_latest('org_details', 'lobbying_firm')} WHERE lobbying_firm)"),
    ("political_groups", "firm", {"subtype": "political_groups"}, "e.type = 'organization' AND e.id IN (SELECT entity_id FROM codes WHERE namespace = 'urn:fec:committee')"),
    ("other_orgs", "firm", {"subtype": "other_orgs"}, _OTHER),
):
    query(f"entity_search_{_name}", _advanced(_words, _also))(
        lambda s, d, w=_words, p=_params: es.scored(_all(s, d), {"search": w, **p}).withColumn("score", F.round("score", 12))
    )


@query("entity_search_page", f"""{_advanced('firm', "e.type = 'organization'")} ORDER BY score DESC, e.id LIMIT 7 OFFSET 14""")
def entity_search_page(spark, sf):
    return es.scored_page(_all(spark, sf), {"search": "firm", "type": "organization", "per_page": "7", "page": "3"}).withColumn("score", F.round("score", 12)).drop("external_ids", "totals")


@query("entity_search_total", f"{WITH} SELECT count(*) AS total, ceil(count(*) / 25)::BIGINT AS pages FROM entity e WHERE {_FOUND.format(_has('alias', 'firm'))}")
def entity_search_total(spark, sf):
    return es.scored_total(_all(spark, sf), {"search": "firm", "per_page": "100"})


@query("entity_list", f"""{WITH} SELECT e.id, e.name, e.type, coalesce(string_agg(alias, ',' ORDER BY alias), '') AS aliases FROM (SELECT * FROM entity WHERE type = 'organization' ORDER BY id LIMIT 51 OFFSET 10) e
  LEFT JOIN alias a ON a.entity_id = e.id AND a.alias <> e.name GROUP BY ALL""")
def entity_list(spark, sf):
    return es.listed(_all(spark, sf), 10, 60, "organization").withColumn("aliases", F.array_join("aliases", ","))


@query("entity_by_external_id", f"{WITH} SELECT entity_id AS id FROM codes WHERE namespace = 'urn:crp:recipient' AND value = '5'")
def entity_by_external_id(spark, sf):
    return es.by_external_id(_all(spark, sf), "urn:crp:recipient", "5")
