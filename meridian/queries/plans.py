"""The warehouse's plans over stand-in record tables. The stand-ins are SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.plans import contributions as ct
from meridian.queries.base import made_once, query, standins, stored

ORG, PARENT, INDUSTRY, POL = 100_000_000, 200_000_000, 300_000_000, 400_000_000

#: Ids as records and attributes have them.
_ID = "lpad(CAST({} AS STRING), 11, '0')"
STANDINS = {
    "contribution": f"""SELECT o_orderkey AS transaction_id, year(o_orderdate) AS cycle, CASE o_orderstatus WHEN 'F' THEN 'urn:fec:transaction' WHEN 'O' THEN 'urn:nimsp:transaction' ELSE 'urn:other:transaction' END AS transaction_namespace,
  CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN o_custkey % 2 = 0 THEN '11' ELSE '24k' END WHEN 2 THEN '99' WHEN 3 THEN NULL ELSE CASE WHEN o_custkey % 2 = 0 THEN '15e' ELSE '24z' END END AS transaction_type, CAST(o_totalprice AS DECIMAL(15,2)) AS amount,
  CASE WHEN c_custkey % 2 = 1 THEN 'Firm ' || CAST(c_custkey AS STRING) ELSE 'Person ' || CAST(c_custkey - c_custkey % 8 AS STRING) END AS contributor_name, {_ID.format("c_custkey")} AS contributor_ext_id,
  CASE WHEN c_custkey % 2 = 1 THEN 'C' WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 2 THEN '' ELSE 'I' END AS contributor_type,
  CASE o_orderkey % 11 WHEN 0 THEN 'Z1000' WHEN 1 THEN NULL WHEN 2 THEN 'Z9010' WHEN 3 THEN '' WHEN 4 THEN 'Y1000' ELSE left(c_mktsegment, 5) END AS contributor_category, CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 13 = 1 THEN '' ELSE n_name END AS contributor_state,
  CASE WHEN c_custkey % 9 > 0 THEN CAST(10000 + c_custkey % 40 AS STRING) END AS contributor_zipcode,
  CASE WHEN c_nationkey % 6 = 0 THEN '' WHEN c_nationkey % 6 = 1 THEN NULL WHEN c_nationkey % 6 = 2 AND o_orderkey % 7 = 0 THEN 'Retired' ELSE 'Org ' || CAST(c_nationkey AS STRING) END AS organization_name, 'O' || CAST(c_nationkey AS STRING) AS organization_ext_id,
  CASE WHEN n_regionkey > 2 THEN 'Parent ' || CAST(n_regionkey AS STRING) END AS parent_organization_name, CASE WHEN n_regionkey = 1 THEN 'P1' ELSE '' END AS parent_organization_ext_id,
  CASE WHEN o_orderkey % 53 % 3 = 0 THEN 'ORG ' || CAST(o_orderkey % 53 % 25 AS STRING) ELSE 'Recipient ' || CAST(o_orderkey % 53 AS STRING) END AS recipient_name, CASE WHEN o_orderkey % 53 % 7 > 0 THEN CAST(o_orderkey % 53 AS STRING) ELSE '' END AS recipient_ext_id, CASE WHEN o_orderkey % 53 % 3 > 0 THEN 'P' ELSE 'C' END AS recipient_type,
  CASE o_orderkey % 53 % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'R' WHEN 2 THEN 'I' WHEN 3 THEN '' ELSE NULL END AS recipient_party, CASE o_orderkey % 53 WHEN 11 THEN 'Z4100' WHEN 13 THEN NULL ELSE 'H5100' END AS recipient_category,
  CASE WHEN o_orderkey % 53 % 2 = 0 THEN n_name ELSE 'NATION_' || CAST(o_orderkey % 53 % 25 AS STRING) END AS recipient_state, CASE o_orderkey % 53 % 6 WHEN 0 THEN 'federal:house' WHEN 1 THEN 'federal:senate' WHEN 2 THEN 'state:upper' WHEN 3 THEN 'federal:president' WHEN 4 THEN NULL ELSE '' END AS seat
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "entity": f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Individual ' ELSE 'Firm ' END || CAST(c_custkey AS STRING) AS name, CASE WHEN c_custkey % 2 = 0 THEN 'individual' ELSE 'organization' END AS type FROM customer
  UNION ALL SELECT {ORG} + n_nationkey, CASE WHEN n_nationkey = 9 THEN '' ELSE 'Org ' || CAST(n_nationkey AS STRING) END, 'organization' FROM nation UNION ALL SELECT {PARENT} + r_regionkey, 'Parent ' || CAST(r_regionkey AS STRING), 'organization' FROM region
  UNION ALL SELECT {INDUSTRY} + n, CASE WHEN n = 2 THEN 'UNKNOWN' ELSE 'Industry ' || CAST(n AS STRING) END, 'industry' FROM (SELECT DISTINCT length(c_mktsegment) % 3 AS n FROM customer) x
  UNION ALL SELECT {INDUSTRY} + 10, 'Sub', 'industry' FROM region WHERE r_regionkey < 1 UNION ALL SELECT {INDUSTRY} + 11, 'Bare', 'industry' FROM region WHERE r_regionkey < 1
  UNION ALL SELECT {POL} + k, 'Politician ' || CAST(k AS STRING), 'politician' FROM (SELECT DISTINCT o_orderkey % 53 AS k FROM orders) y""",
    "alias": "SELECT id AS entity_id, upper(CASE WHEN id = 100000009 THEN 'Org 9' ELSE name END) AS alias, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'urn:crp:organization' WHEN 3 THEN 'urn:nimsp:organization' ELSE 'urn:none' END AS namespace FROM entity",
    "attribute": f"""SELECT id AS entity_id, 'urn:crp:individual' AS namespace, {_ID.format("id")} || CASE id % 3 WHEN 0 THEN '0' WHEN 1 THEN '' ELSE '1' END AS value FROM entity WHERE type = 'individual' AND id % 4 = 0
  UNION ALL SELECT id, 'urn:nimsp:individual', {_ID.format("id")} FROM entity WHERE type = 'individual' AND id % 6 = 0 UNION ALL SELECT id, 'urn:crp:individual', {_ID.format("id")} FROM entity WHERE type = 'organization' AND id < 100
  UNION ALL SELECT id, 'urn:crp:organization', {_ID.format("id")} FROM entity WHERE id < {ORG} AND id % 6 = 3 UNION ALL SELECT id, 'urn:nimsp:organization', {_ID.format("id")} FROM entity WHERE id < {ORG} AND id % 10 = 5
  UNION ALL SELECT id, 'urn:crp:organization', 'O' || CAST(id - {ORG} AS STRING) FROM entity WHERE id >= {ORG} AND id < {PARENT} AND id % 2 = 0 UNION ALL SELECT id, 'urn:nimsp:organization', 'O' || CAST(id - {ORG} + 1 AS STRING) FROM entity WHERE id >= {ORG} AND id < {PARENT} AND id % 3 = 0
  UNION ALL SELECT id, 'urn:crp:organization', 'P' || CAST(id - {PARENT} AS STRING) FROM entity WHERE id >= {PARENT} AND id < {INDUSTRY} UNION ALL SELECT id, 'urn:crp:organization', '' FROM entity WHERE id = {PARENT}
  UNION ALL SELECT id, 'urn:crp:recipient', CAST(id - {POL} AS STRING) FROM entity WHERE id >= {POL} UNION ALL SELECT id, 'urn:nimsp:recipient', CAST(id - {POL} AS STRING) FROM entity WHERE id >= {POL} AND id % 4 > 0 UNION ALL SELECT -5, 'urn:crp:recipient', '5' FROM region WHERE r_regionkey < 1
  UNION ALL SELECT id, 'urn:crp:industry', 'A' || CAST(id - {INDUSTRY} AS STRING) FROM entity WHERE id >= {INDUSTRY} AND id < {INDUSTRY} + 10 UNION ALL SELECT id, 'urn:crp:subindustry', 'Machi' FROM entity WHERE id = {INDUSTRY} + 10 UNION ALL SELECT id, 'urn:crp:industry', 'build' FROM entity WHERE id = {INDUSTRY} + 1
  UNION ALL SELECT id, 'urn:crp:industry', 'Y00' FROM entity WHERE id = {INDUSTRY} + 2""",
    "category": "SELECT DISTINCT left(c_mktsegment, 5) AS catcode, 'a' || CAST(length(c_mktsegment) % 3 AS STRING) AS catorder FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'",
    "zip": "SELECT DISTINCT CAST(10000 + c_custkey % 40 AS STRING) AS zipcode, c_custkey % 40 % 7 AS msa_id FROM customer WHERE c_custkey % 40 > 2",
    "org_metadata": f"""SELECT id AS entity_id, cycle, (id + cycle) % 3 > 0 AS is_org, id % 5 = 0 AS lobbying_firm, id % 7 = 1 AS is_pol_group, CASE WHEN id % 11 = 5 THEN {PARENT} END AS parent_entity_id
  FROM entity CROSS JOIN (VALUES (1992), (1994), (1996), (-1)) AS c(cycle) WHERE type = 'organization'""",
    "individual_metadata": "SELECT id AS entity_id, id % 3 = 0 AS is_lobbyist FROM entity WHERE type = 'individual'",
    "politician_metadata": "SELECT id AS entity_id, cycle, CASE id % 4 WHEN 0 THEN 'federal:president' WHEN 1 THEN NULL ELSE 'state:upper' END AS seat FROM entity CROSS JOIN (VALUES (1992), (1994), (1998)) AS c(cycle) WHERE type = 'politician'",
    "industry_metadata": f"SELECT id AS entity_id, CASE WHEN id = {INDUSTRY} + 10 THEN {INDUSTRY} END AS parent_industry_id, id % 5 <> 1 AS should_show_entity FROM entity WHERE type = 'industry'",
}
CTES = ", ".join(f"{n} AS ({s})" for n, s in STANDINS.items())


def tables(spark, sf, linked: bool = True) -> ct.Tables:
    """The stand-ins, stored once for a session and folder, so queries don't plan and compute them again; anew where the shared folder was emptied.

    linked: with the records and their links as one more table, which all figures read; without it they are found anew.
    """

    t = made_once(spark, ("plans", sf), lambda: standins(spark, sf, ("orders", "customer", "nation", "region"), STANDINS))
    if not linked:
        return dict(t)
    return t | made_once(spark, ("plans", sf, "linked"), lambda: {"linked": stored(ct.linked(t, *ct.KINDS_OF_LINKS), "linked")})


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _subset(name: str, who: str, to: str, kinds) -> str:
    return f"""{name}_s AS (SELECT * FROM even_cycles WHERE {who} AND recipient_type = '{to}' AND transaction_type IN ({_list(kinds)})
  AND contributor_category NOT IN ({_list(ct.SUPPRESSED_CATEGORIES)}) AND recipient_category NOT LIKE 'Z4%' AND cycle IN (SELECT DISTINCT cycle FROM contribution))"""


_PERSON, _GROUP = "(contributor_type IS NULL OR contributor_type IN ('', 'I'))", "contributor_type = 'C'"
RELEVANT = f"""even_cycles AS (SELECT * REPLACE ((CASE WHEN cycle % 2 = 0 THEN cycle ELSE cycle + 1 END)::INTEGER AS cycle) FROM contribution),
{_subset("individual", _PERSON, "P", ct.FROM_PERSON)}, {_subset("individual_to_organization", _PERSON, "C", ct.FROM_PERSON)}, {_subset("organization", _GROUP, "P", ct.FROM_GROUP)}, {_subset("org_to_pac", _GROUP, "C", ct.FROM_GROUP)},
relevant AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT *, '{n}' AS subset FROM {n}_s" for n in ("individual", "individual_to_organization", "organization", "org_to_pac"))}) WHERE transaction_namespace IN ('urn:fec:transaction', 'urn:nimsp:transaction'))"""


def _by_alias(name: str) -> str:
    return f"""SELECT a.entity_id, c.transaction_id FROM relevant c JOIN alias a ON lower(c.{name}) = lower(a.alias) JOIN entity e ON e.id = a.entity_id WHERE e.type = 'organization'
  AND (a.namespace = '' OR a.namespace IS NULL OR (a.namespace LIKE 'urn:crp:%' AND c.transaction_namespace = 'urn:fec:transaction') OR (a.namespace LIKE 'urn:nimsp:%' AND c.transaction_namespace = 'urn:nimsp:transaction'))"""


def _by_id(column: str, kind: str = "organization", also: str = "true") -> str:
    return f"""SELECT a.entity_id, c.transaction_id FROM relevant c JOIN attribute a ON c.{column} = a.value AND a.value <> '' WHERE {also}
  AND ((a.namespace = 'urn:crp:{kind}' AND c.transaction_namespace = 'urn:fec:transaction') OR (a.namespace = 'urn:nimsp:{kind}' AND c.transaction_namespace = 'urn:nimsp:transaction'))"""


ASSOC = f"""{RELEVANT},
indiv_id AS (SELECT a.entity_id, c.transaction_id FROM relevant c JOIN attribute a ON a.value = c.contributor_ext_id OR (length(a.value) = 12 AND a.value[12] = '0' AND a.value[1:11] = c.contributor_ext_id) JOIN entity e ON e.id = a.entity_id
    WHERE c.transaction_namespace = 'urn:fec:transaction' AND c.contributor_type = 'I' AND e.type = 'individual' AND a.value <> '' AND a.namespace = 'urn:crp:individual'
  UNION ALL SELECT a.entity_id, c.transaction_id FROM relevant c JOIN attribute a ON a.value = c.contributor_ext_id JOIN entity e ON e.id = a.entity_id
    WHERE c.transaction_namespace = 'urn:nimsp:transaction' AND (c.contributor_type IS NULL OR c.contributor_type <> 'C') AND e.type = 'individual' AND a.value <> '' AND a.namespace = 'urn:nimsp:individual'),
indiv_names AS (SELECT DISTINCT entity_id, contributor_name AS name FROM relevant JOIN indiv_id USING (transaction_id)),
indiv_places AS (SELECT DISTINCT entity_id, msa_id FROM relevant JOIN indiv_id USING (transaction_id) JOIN zip ON contributor_zipcode = zipcode),
contributor_a AS ({_by_alias("contributor_name")} UNION {_by_id("contributor_ext_id", also="c.contributor_type = 'C'")} UNION SELECT * FROM indiv_id
  UNION SELECT n.entity_id, c.transaction_id FROM relevant c JOIN indiv_names n ON lower(n.name) = lower(c.contributor_name) JOIN zip z ON c.contributor_zipcode = z.zipcode JOIN indiv_places l ON n.entity_id = l.entity_id AND l.msa_id = z.msa_id),
organization_a AS ({_by_alias("organization_name")} UNION {_by_id("organization_ext_id")}),
parent_a AS ({_by_alias("parent_organization_name")} UNION {_by_id("parent_organization_ext_id")}),
biggest_a AS (SELECT coalesce(p.entity_id, o.entity_id) AS entity_id, transaction_id FROM organization_a o FULL JOIN parent_a p USING (transaction_id)),
industry_a AS (SELECT a.entity_id, transaction_id FROM relevant JOIN category ON lower(contributor_category) = lower(catcode) JOIN attribute a ON lower(catorder) = lower(value) JOIN entity e ON e.id = a.entity_id WHERE e.type = 'industry'
  UNION ALL SELECT a.entity_id, transaction_id FROM relevant JOIN attribute a ON lower(contributor_category) = lower(value) JOIN entity e ON e.id = a.entity_id WHERE e.type = 'industry'),
recipient_a AS ({_by_alias("recipient_name")} UNION SELECT x.entity_id, transaction_id FROM ({_by_id("recipient_ext_id", "recipient", "c.recipient_type = 'P'")}) x JOIN entity e ON e.id = x.entity_id)"""
WITH = f"WITH {CTES}, {ASSOC}"
EDGES = {"organization": "(SELECT * FROM organization_a UNION SELECT * FROM parent_a)", "individual": "contributor_a", "industry": "industry_a"}
_IN_STATE = "CASE WHEN contributor_state = recipient_state THEN 'in-state' WHEN contributor_state = '' THEN '' ELSE 'out-of-state' END"
DIMENSIONS = {
    "party": "recipient_party", "seat": "c.seat", "recipient_type": "recipient_type", "in_state": _IN_STATE,
    "state_fed": "CASE transaction_namespace WHEN 'urn:fec:transaction' THEN 'federal' WHEN 'urn:nimsp:transaction' THEN 'state' ELSE 'other' END",
}
_NOT = "contributor_category NOT LIKE 'Z90%' AND recipient_category NOT IN ('Z4100', 'Z4200', 'Z4300')"


def _cycles(body: str, keys: str, measures: str) -> str:
    """Figures per cycle and, as cycle -1, in all."""
    return f"SELECT {keys}, cycle, {measures} FROM {body} GROUP BY {keys}, cycle UNION ALL SELECT {keys}, -1, {measures} FROM {body} GROUP BY {keys}"


def _aggregate(who: str, by: str) -> str:
    if by == "indiv_pac":
        body = f"(SELECT g.entity_id, c.cycle, amount, subset IN ('organization', 'org_to_pac') AS direct FROM relevant c JOIN {EDGES[who]} g USING (transaction_id) LEFT JOIN recipient_a r USING (transaction_id) JOIN entity e ON e.id = g.entity_id WHERE {_NOT})"
        one = lambda label, test: f"SELECT entity_id, cycle, '{label}' AS indiv_pac, count, coalesce(amount, 0) AS amount FROM ({_cycles(body, 'entity_id', f'count(*) FILTER ({test}) AS count, sum(amount) FILTER ({test}) AS amount')})"
        return f"{one('direct', 'direct')} UNION ALL {one('indiv', 'NOT direct')}"
    simple = who == "individual" and by in ("party", "seat", "recipient_type")
    subsets = "subset = 'individual'" if by == "in_state" else "subset IN ('individual', 'individual_to_organization')" if who == "individual" else "true"
    recipients = "" if simple else "JOIN recipient_a r USING (transaction_id) JOIN politician_metadata m ON m.entity_id = r.entity_id AND m.cycle = c.cycle AND m.seat <> 'federal:president'" if by == "in_state" else "LEFT JOIN recipient_a r USING (transaction_id)"
    body = f"(SELECT g.entity_id, c.cycle, amount, {DIMENSIONS[by]} AS {by} FROM relevant c JOIN {EDGES[who]} g USING (transaction_id) {recipients} WHERE {_NOT} AND {subsets})"
    return _cycles(body, f"entity_id, {by}", "count(*) AS count, sum(amount) AS amount")


def _plain(df):
    """Decimals as doubles, ranks and counts as longs: the types that both engines give."""
    return df.select(*[F.col(f.name).cast("double" if f.dataType.simpleString().startswith("decimal") else "long" if f.name.startswith("rank") or f.name.endswith("_entity") else f.dataType.simpleString()).alias(f.name) for f in df.schema])


query("subset_totals", f"{WITH} SELECT subset, cycle, count(*) AS count, sum(amount)::DOUBLE AS amount FROM relevant GROUP BY ALL")(
    lambda s, d: _plain(ct.relevant(tables(s, d)).groupBy("subset", "cycle").agg(F.count("*").alias("count"), F.sum("amount").alias("amount")))
)
for _kind in ("contributor", "organization", "parent", "industry", "recipient"):
    query(f"assoc_{_kind}_links", f"{WITH} SELECT entity_id, transaction_id FROM {_kind}_a")(lambda s, d, k=_kind: ct.association(tables(s, d, linked=False), k).select(F.col("entity_id").cast("long"), "transaction_id"))
query("assoc_biggest_organization", f"{WITH} SELECT entity_id, transaction_id FROM biggest_a")(lambda s, d: ct.biggest_association(tables(s, d, linked=False)).select(F.col("entity_id").cast("long"), "transaction_id"))

for _who, _dims in {"organization": ("party", "state_fed", "seat", "recipient_type", "indiv_pac"), "individual": ("party", "state_fed", "seat", "recipient_type", "in_state"), "industry": ("party", "state_fed", "recipient_type", "indiv_pac")}.items():
    for _by in _dims:
        query(f"aggregate_{_who}_by_{_by}", f"""{WITH}, g AS ({_aggregate(_who, _by)}) SELECT entity_id, {_by}, cycle, count, amount::DOUBLE AS amount,
rank() OVER (PARTITION BY entity_id, cycle ORDER BY count DESC) AS rank_by_count, rank() OVER (PARTITION BY entity_id, cycle ORDER BY amount DESC) AS rank_by_amount FROM g""")(
            lambda s, d, w=_who, b=_by: _plain(ct.aggregate(tables(s, d), w, b))
        )


def _two_sided(keys: str, ident: str, facts: str, direct: str, people: str) -> str:
    """Both sides grouped apart and joined in full, then summed over all cycles."""
    side = lambda test: f"(SELECT {keys}, cycle, count(*) AS count, sum(amount) AS amount FROM ({facts}) WHERE subset = '{test}' GROUP BY ALL)" if isinstance(test, str) else f"(SELECT {keys}, cycle, count(*) AS count, sum(amount) AS amount FROM ({facts}) WHERE subset IN ({_list(test)}) GROUP BY ALL)"
    figures = ("total_count", "pacs_count", "indivs_count", "total_amount", "pacs_amount", "indivs_amount")
    return f"""b AS (SELECT {keys}, cycle, coalesce(p.count, 0) + coalesce(q.count, 0) AS total_count, coalesce(p.count, 0) AS pacs_count, coalesce(q.count, 0) AS indivs_count,
  coalesce(p.amount, 0) + coalesce(q.amount, 0) AS total_amount, coalesce(p.amount, 0) AS pacs_amount, coalesce(q.amount, 0) AS indivs_amount FROM {side(direct)} p FULL JOIN {side(people)} q USING ({keys}, cycle)),
g AS (SELECT * FROM b UNION ALL SELECT {keys}, -1, {", ".join(f"sum({c}) AS {c}" for c in figures)} FROM b GROUP BY {keys})"""


#: Figures as both engines give them.
_DOUBLES = "REPLACE (total_amount::DOUBLE AS total_amount, pacs_amount::DOUBLE AS pacs_amount, indivs_amount::DOUBLE AS indivs_amount, total_count::BIGINT AS total_count, pacs_count::BIGINT AS pacs_count, indivs_count::BIGINT AS indivs_count)"
_TOP = "r AS (SELECT *, rank() OVER (PARTITION BY entity_id, cycle ORDER BY total_amount DESC) AS rank FROM g)"


def _politician_parts() -> str:
    orgs = f"""SELECT r.entity_id, o.entity_id AS organization_entity, coalesce(e.name, contributor_name) AS organization_name, cycle, amount, subset FROM relevant c JOIN {EDGES["organization"]} o USING (transaction_id) JOIN recipient_a r USING (transaction_id)
  LEFT JOIN entity e ON e.id = o.entity_id WHERE {_NOT} AND (subset = 'individual' OR coalesce(e.name, contributor_name) <> '')"""
    people = f"""(SELECT r.entity_id, a.entity_id AS individual_entity, e.name AS individual_name, cycle, amount FROM relevant c JOIN recipient_a r USING (transaction_id) JOIN contributor_a a USING (transaction_id) JOIN entity e ON e.id = a.entity_id AND e.type = 'individual'
  LEFT JOIN {EDGES["organization"]} o USING (transaction_id) WHERE o.entity_id IS NULL AND subset = 'individual' AND {_NOT})"""
    return f"""{_two_sided("entity_id, organization_entity, organization_name", "", orgs, "organization", "individual")}, pi AS ({_cycles(people, "entity_id, individual_entity, individual_name", "count(*) AS count, sum(amount) AS amount")}),
opi AS (SELECT entity_id, cycle, org_pac_indiv, sum(count)::BIGINT AS count, sum(amount) AS amount FROM (SELECT entity_id, cycle, 'org_pac' AS org_pac_indiv, pacs_count AS count, pacs_amount AS amount FROM g UNION ALL SELECT entity_id, cycle, 'org_indiv', indivs_count, indivs_amount FROM g
  UNION ALL SELECT entity_id, cycle, 'indiv', count, amount FROM pi) JOIN entity e ON e.id = entity_id GROUP BY ALL)"""


_STATE_BODY = f"""(SELECT r.entity_id, {_IN_STATE} AS in_state, c.cycle, amount FROM relevant c JOIN contributor_a a USING (transaction_id) JOIN recipient_a r USING (transaction_id) JOIN entity e ON e.id = a.entity_id
  JOIN politician_metadata m ON m.entity_id = r.entity_id AND m.cycle = c.cycle WHERE m.seat <> 'federal:president' AND subset = 'individual' AND {_NOT})"""
_PIS = f"pis AS ({_cycles(_STATE_BODY, 'entity_id, in_state', 'count(*) AS count, sum(amount) AS amount')})"
_RANKS = "rank() OVER (PARTITION BY entity_id, cycle ORDER BY {0} DESC) AS rank_by_count, rank() OVER (PARTITION BY entity_id, cycle ORDER BY {1} DESC) AS rank_by_amount"

MEMBERS = {
    "parentmost_orgs": "SELECT DISTINCT entity_id, cycle FROM org_metadata WHERE is_org AND parent_entity_id IS NULL", "lobbying_orgs": "SELECT DISTINCT entity_id, cycle FROM org_metadata WHERE lobbying_firm AND parent_entity_id IS NULL",
    "pol_groups": "SELECT DISTINCT entity_id, cycle FROM org_metadata WHERE is_pol_group AND parent_entity_id IS NULL", "individuals": "SELECT id AS entity_id FROM entity",
    "lobbyists": "SELECT DISTINCT entity_id FROM individual_metadata WHERE is_lobbyist", "industries": "SELECT id AS entity_id FROM entity JOIN industry_metadata ON entity_id = id WHERE parent_industry_id IS NULL AND name <> 'UNKNOWN' AND should_show_entity",
    "politicians": "SELECT id AS entity_id FROM entity",
}


def _ranked(group: str, by: str, to: str = "") -> str:
    fold = f"CASE WHEN {by} IN ('D', 'R') THEN {by} ELSE 'Other' END" if by == "party" else by
    who, keys = ct.GROUPS[group][0], "entity_id, cycle" if ct.GROUPS[group][0] == "organization" else "entity_id"
    source = f"{_politician_parts()}, s{to} AS (SELECT * FROM opi)" if by == "org_pac_indiv" else f"{_PIS}, s{to} AS (SELECT * FROM pis)" if who == "politician" else f"s{to} AS ({_aggregate(who, by)})"
    return f"""{source}, m{to} AS ({MEMBERS[group]}),
f{to} AS (SELECT entity_id, {fold} AS dim, cycle, sum(count)::BIGINT AS count, sum(amount) AS amount FROM s{to} JOIN m{to} USING ({keys}) WHERE {by} IS NOT NULL AND {by} <> '' GROUP BY ALL),
r{to} AS (SELECT entity_id, dim AS {by}, cycle, count, amount, rank() OVER (PARTITION BY dim, cycle ORDER BY count DESC) AS rank_by_count, rank() OVER (PARTITION BY dim, cycle ORDER BY amount DESC) AS rank_by_amount FROM f{to})"""


for _group, _dims in ct.BY.items():
    for _by in _dims:
        query(f"ranked_{_group}_by_{_by}", f"{WITH}, {_ranked(_group, _by)} SELECT * REPLACE (amount::DOUBLE AS amount) FROM r")(lambda s, d, g=_group, b=_by: _plain(ct.ranked(tables(s, d), g, b)))
        query(f"summary_{_group}_by_{_by}", f"""{WITH}, {_ranked(_group, _by)}, t AS (SELECT {_by}, cycle, sum(count)::BIGINT AS total_count, sum(amount)::DOUBLE AS total_amount FROM r GROUP BY ALL)
SELECT r.* REPLACE (amount::DOUBLE AS amount), total_count, total_amount FROM r JOIN t USING ({_by}, cycle) WHERE rank_by_amount <= 10""")(lambda s, d, g=_group, b=_by: _plain(ct.summary(tables(s, d), g, b)))

_TYPES = {"industries": "industry", "parentmost_orgs": "org", "pol_groups": "pol_group", "lobbying_orgs": "lobbying_org", "individuals": "individual", "lobbyists": "lobbyist", "politicians": "pol"}
query("summary_entity_types", f"""{WITH}, {", ".join(_ranked(g, "org_pac_indiv" if g == "politicians" else "state_fed", f"_{g}") for g in _TYPES)}
{" UNION ALL ".join(f"SELECT '{n}' AS entity_type, cycle, sum(count)::BIGINT AS contributions_count, sum(amount)::DOUBLE AS contributions_amount, count(DISTINCT entity_id) AS entity_count FROM r_{g} GROUP BY cycle" for g, n in _TYPES.items())}""")(
    lambda s, d: _plain(ct.entity_types(tables(s, d)))
)


def _pivot(who: str, to: str) -> str:
    direct, people = ("organization", "individual") if to == "candidates" else ("org_to_pac", "individual_to_organization")
    which = f"subset = '{people}'" if who == "individual" else _NOT
    facts = f"SELECT e.entity_id, coalesce(n.name, recipient_name) AS recipient_name, r.entity_id AS recipient_id, cycle, amount, subset FROM relevant JOIN {EDGES[who]} e USING (transaction_id) LEFT JOIN recipient_a r USING (transaction_id) LEFT JOIN entity n ON n.id = r.entity_id WHERE {which}"
    return _two_sided("entity_id, recipient_name, recipient_id", "recipient_id", facts, direct, people)


query("org_to_recipients_pivot", f"{WITH}, {_pivot('organization', 'candidates')} SELECT * {_DOUBLES} FROM g")(lambda s, d: _plain(ct.pivot(tables(s, d), "organization", "candidates")))
for _who in ("organization", "industry", "individual"):
    for _to in ("candidates", "pacs"):
        query(f"top_{_who}_to_{_to}", f"{WITH}, {_pivot(_who, _to)}, {_TOP} SELECT * {_DOUBLES} FROM r WHERE rank <= 10")(lambda s, d, w=_who, t=_to: _plain(ct.top_recipients(tables(s, d), w, t)))
for _by, _expr, _extra, _subsets in (
    ("sector", "coalesce(catorder[1], 'Y')", "LEFT JOIN category ON catcode = contributor_category", "'individual', 'organization'"),
    ("contributor_type", "coalesce(contributor_type, '')", "", "'individual', 'organization'"), ("in_state", _IN_STATE, "", "'individual'"),
):
    _body = f"(SELECT entity_id, cycle, amount, {_expr} AS {_by} FROM relevant JOIN recipient_a USING (transaction_id) {_extra} WHERE subset IN ({_subsets}))"
    query(f"politician_by_{_by}", f"{WITH}, g AS ({_cycles(_body, f'entity_id, {_by}', 'count(*) AS count, sum(amount) AS amount')}) SELECT * REPLACE (amount::DOUBLE AS amount) FROM g")(lambda s, d, b=_by: _plain(ct.politician_sources(tables(s, d, linked=False), b)))

_both = "(SELECT entity_id, cycle, amount, true AS given FROM relevant JOIN (SELECT * FROM contributor_a UNION SELECT * FROM organization_a UNION SELECT * FROM parent_a UNION ALL SELECT * FROM industry_a) USING (transaction_id) UNION ALL SELECT entity_id, cycle, amount, false FROM relevant JOIN recipient_a USING (transaction_id))"
query("entity_totals", f"{WITH} {_cycles(_both, 'entity_id', 'count_if(given)::BIGINT AS contributor_count, count_if(NOT given)::BIGINT AS recipient_count, coalesce(sum(amount) FILTER (given), 0)::DOUBLE AS contributor_amount, coalesce(sum(amount) FILTER (NOT given), 0)::DOUBLE AS recipient_amount')}")(
    lambda s, d: _plain(ct.entity_totals(tables(s, d)))
)

_GIVER_KEYS = "entity_id, organization_name, organization_entity"
_ORG_FACTS = """SELECT i.entity_id, coalesce(e.name, CASE subset WHEN 'organization' THEN contributor_name ELSE organization_name END) AS organization_name, o.entity_id AS organization_entity, cycle, amount, subset
  FROM relevant JOIN industry_a i USING (transaction_id) LEFT JOIN organization_a o USING (transaction_id) LEFT JOIN entity e ON e.id = o.entity_id WHERE coalesce(e.name, CASE subset WHEN 'organization' THEN contributor_name ELSE organization_name END) <> ''"""
query("top_orgs_by_industry", f"""{WITH}, {_two_sided(_GIVER_KEYS, "", _ORG_FACTS, "organization", ("individual", "individual_to_organization"))}, {_TOP} SELECT * EXCLUDE (rank) {_DOUBLES} FROM r WHERE rank <= 10""")(lambda s, d: _plain(ct.top_orgs_by_industry(tables(s, d))))
_STATED = "CASE subset WHEN 'organization' THEN organization_name ELSE CASE WHEN organization_name <> '' THEN organization_name ELSE contributor_name END END"
_POL_FACTS = f"""SELECT r.entity_id, coalesce(e.name, CASE subset WHEN 'organization' THEN contributor_name ELSE {_STATED} END) AS organization_name, b.entity_id AS organization_entity, cycle, amount, subset
  FROM relevant JOIN recipient_a r USING (transaction_id) LEFT JOIN biggest_a b USING (transaction_id) LEFT JOIN entity e ON e.id = b.entity_id WHERE lower({_STATED}) NOT IN ({_list(ct.SUPPRESSED_NAMES)})"""
query("top_orgs_to_politician", f"""{WITH}, {_two_sided(_GIVER_KEYS, "", _POL_FACTS, "organization", "individual")}, {_TOP} SELECT * EXCLUDE (rank) {_DOUBLES} FROM r WHERE rank <= 10""")(lambda s, d: _plain(ct.top_orgs_to_politician(tables(s, d, linked=False))))
query("top_industries_to_politician", f"""{WITH}, b AS (SELECT r.entity_id, i.entity_id AS industry_id, coalesce(e.name, 'UNKNOWN') AS industry, cycle, count(*) AS count, sum(amount) AS amount FROM relevant c JOIN recipient_a r USING (transaction_id) LEFT JOIN industry_a i USING (transaction_id)
  LEFT JOIN entity e ON e.id = i.entity_id LEFT JOIN attribute ma ON ma.entity_id = i.entity_id WHERE subset IN ('individual', 'organization') AND coalesce(ma.namespace, 'urn:crp:industry') = 'urn:crp:industry' AND left(contributor_category, 1) NOT IN ('', 'Y', 'Z') GROUP BY ALL),
g AS (SELECT * FROM b UNION ALL SELECT entity_id, industry_id, industry, -1, sum(count), sum(amount) FROM b GROUP BY entity_id, industry_id, industry), r AS (SELECT *, rank() OVER (PARTITION BY entity_id, cycle ORDER BY amount DESC) AS rank FROM g)
SELECT entity_id, coalesce(industry_id, (SELECT entity_id FROM attribute WHERE value = 'Y00')) AS industry_entity, industry, cycle, count::BIGINT AS count, amount::DOUBLE AS amount FROM r WHERE rank <= 10""")(lambda s, d: _plain(ct.top_industries_to_politician(tables(s, d))))
_unknown = "(SELECT entity_id, cycle, amount FROM relevant JOIN recipient_a USING (transaction_id) WHERE subset IN ('individual', 'organization') AND left(contributor_category, 1) IN ('', 'Y', 'Z'))"
query("unknown_industries_to_politician", f"{WITH} {_cycles(_unknown, 'entity_id', 'count(*) AS count, sum(amount)::DOUBLE AS amount')}")(lambda s, d: _plain(ct.unknown_industries_to_politician(tables(s, d))))
query("politician_from_organizations", f"{WITH}, {_politician_parts()} SELECT * {_DOUBLES}, {_RANKS.format('total_count', 'total_amount')} FROM g")(lambda s, d: _plain(ct.politician_from_organizations(tables(s, d))))
query("politician_from_individuals", f"{WITH}, {_politician_parts()} SELECT * REPLACE (amount::DOUBLE AS amount), {_RANKS.format('count', 'amount')} FROM pi")(lambda s, d: _plain(ct.politician_from_individuals(tables(s, d))))
query("politician_by_org_pac_indiv", f"{WITH}, {_politician_parts()} SELECT entity_id, cycle, org_pac_indiv, count, amount::DOUBLE AS amount FROM opi")(lambda s, d: _plain(ct.politician_by_org_pac_indiv(tables(s, d))))
query("politician_from_individuals_in_state", f"{WITH}, {_PIS} SELECT * REPLACE (amount::DOUBLE AS amount), 1::BIGINT AS rank_by_count, 1::BIGINT AS rank_by_amount FROM pis")(lambda s, d: _plain(ct.politician_by_in_state(tables(s, d))))
_industries = f"SELECT r.entity_id, i.entity_id AS industry_entity, e.name AS industry_name, cycle, amount, subset FROM relevant JOIN recipient_a r USING (transaction_id) JOIN industry_a i USING (transaction_id) JOIN entity e ON e.id = i.entity_id WHERE {_NOT}"
query("politician_from_industries", f"""{WITH}, {_two_sided("entity_id, industry_entity, industry_name", "", _industries, "organization", "individual")}, {_TOP} SELECT * {_DOUBLES} FROM r""")(lambda s, d: _plain(ct.politician_from_industries(tables(s, d))))
