"""Look-ups of every route, for all entities at once, against the registered SQL of the tables that they read."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.plans import api
from meridian.plans import contributions as ct
from meridian.queries import lobbying, plans, public
from meridian.queries.base import SQL, query


def warehouse(spark, sf, linked: tuple[str, ...] = ("contributions", "lobbying")) -> api.Warehouse:
    """The stand-ins with the stored links of the record sets named; others' links are not made. Industries of politicians read the attributes of contributions."""
    base, own = plans.tables(spark, sf, linked="contributions" in linked), public.tables(spark, sf)
    lobby = lobbying.tables(spark, sf) if "lobbying" in linked else {}

    class Stored(api.Warehouse):
        def __missing__(self, name):
            if name in api.BUILDERS:
                return super().__missing__(name)
            self[name] = own[name]
            return self[name]

    t = Stored(base | {n: lobby[n] for n in ("lobbying", "lobbyist", "issue", "bill", "org_metadata", "lobbying_linked") if n in lobby} | {"attribute": own["attribute"]})
    if "contributions" in linked:
        t["top_industries_to_politician"] = ct.top_industries_to_politician(base)
    return t


def _bulk(spark, sf, routes: list[str], linked: tuple[str, ...]):
    """route, entity, position and the fields in order as one text."""
    df = api.bulk(warehouse(spark, sf, linked), routes)
    names = {r: ["category", "count", "amount"] if api.ENDPOINTS[r].kind == "pie" else [*api.ENDPOINTS[r].fields, *api.ENDPOINTS[r].sums] for r in routes}
    text = F.lit(None).cast("string")
    for r, n in names.items():
        text = F.when(F.col("route") == r, F.concat_ws("|", *[F.coalesce(F.col("fields")[x], F.lit("")) for x in n])).otherwise(text)
    return df.select("route", "entity", F.col("position").cast("long").alias("position"), text.alias("row"))


def _from(name: str) -> str:
    return f"({SQL[name]})"


_M = lambda c: f"CAST({c} AS DECIMAL(20,2))"
_GIVEN = ["total_count", "pacs_count", "indivs_count", _M("total_amount"), _M("pacs_amount"), _M("indivs_amount")]
_LARGEST = "total_amount DESC NULLS LAST, total_count DESC"
_AMOUNTS = ["count", _M("amount")]
_BY_AMOUNT, _BY_COUNT = "amount DESC NULLS LAST", "count DESC NULLS LAST"
_LATEST = f"({public.WITH} SELECT entity_id AS latest_id, state, party, seat FROM politician_state QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY cycle DESC) = 1)"
_ENTITY = f"(WITH {plans.CTES} SELECT id AS entity_key, name, type FROM entity)"
_SHOWN = f"(WITH {plans.CTES} SELECT entity_id AS shown_id, should_show_entity, parent_industry_id FROM industry_metadata)"
_INDUSTRY_IDS = f"({public.WITH} SELECT DISTINCT entity_id FROM pub_attribute WHERE namespace = 'urn:crp:industry')"
_DOCKET = f"({public.WITH} SELECT docket_id, title FROM docket)"


def _sql(route: str, source: str, key: str, fields: list[str], order: str, where: str = "true", limit: int = 10) -> str:
    text = "concat_ws('|', " + ", ".join(f"coalesce(CAST({f} AS VARCHAR), '')" for f in fields) + ")"
    number = "rank()" if api.ENDPOINTS[route].kind == "rank" else "row_number()"
    tie = "" if number == "rank()" else ", row"
    return f"""SELECT '{route}' AS route, entity, position, row FROM (SELECT *, {number} OVER (PARTITION BY entity ORDER BY {order}{tie}) AS position FROM (SELECT *, CAST({key} AS VARCHAR) AS entity, {text} AS row FROM {source} WHERE {where})) WHERE position <= {limit}"""


def _family(name: str, parts: dict[str, str], *linked: str) -> None:
    query(f"lookup_{name}", " UNION ALL ".join(parts.values()))(lambda s, d, r=list(parts): _bulk(s, d, r, linked))


_all = "cycle = -1"
_keyed = lambda key: f"cycle = -1 AND {key} IS NOT NULL"
_given = lambda route, table, latest=False, names=("recipient_name", "recipient_id"), own=_GIVEN: _sql(
    route, _from(table) + (f" x LEFT JOIN {_LATEST} l ON l.latest_id = recipient_id" if latest else ""), "entity_id", [*names, *(("party", "state") if latest else ()), *own], _LARGEST, _keyed("entity_id")
)
_short = ["total_count", _M("total_amount")]
_family("contribution_lists", {
    "pol/contributors": _given("pol/contributors", "top_orgs_to_politician", names=("organization_name", "organization_entity")),
    "pol/contributors/industries": _sql("pol/contributors/industries", f"{_from('top_industries_to_politician')} x LEFT JOIN {_SHOWN} s ON s.shown_id = industry_entity", "entity_id", ["industry", "industry_entity", "coalesce(should_show_entity, true)", *_AMOUNTS], _BY_AMOUNT, _keyed("entity_id")),
    "pol/contributors/sectors": _sql("pol/contributors/sectors", _from("politician_by_sector"), "entity_id", ["sector", *_AMOUNTS], _BY_AMOUNT, _keyed("entity_id")),
    "indiv/recipient_pols": _given("indiv/recipient_pols", "top_individual_to_candidates", True, own=_short), "indiv/recipient_orgs": _given("indiv/recipient_orgs", "top_individual_to_pacs", own=_short),
    "org/recipients": _given("org/recipients", "top_organization_to_candidates", True), "org/recipient_pacs": _given("org/recipient_pacs", "top_organization_to_pacs"),
    "industry/orgs": _given("industry/orgs", "top_orgs_by_industry", names=("organization_name", "organization_entity")),
}, "contributions")


def _pie(route: str, table: str) -> str:
    e = api.ENDPOINTS[route]
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in e.labels.items())
    label = f"CASE {e.category} {cases} ELSE " + (f"'{e.default}'" if e.default else e.category) + " END"
    return f"SELECT '{route}' AS route, CAST(entity_id AS VARCHAR) AS entity, NULL AS position, concat_ws('|', coalesce(label, ''), CAST(sum(count)::BIGINT AS VARCHAR), CAST(CAST(sum(amount) AS DECIMAL(20,2)) AS VARCHAR)) AS row FROM (SELECT *, {label} AS label FROM {_from(table)} WHERE cycle = -1) GROUP BY entity_id, label"


_family("breakdowns", {r: _pie(r, t) for r, t in {
    "pol/contributors/local_breakdown": "politician_by_in_state", "pol/contributors/type_breakdown": "politician_by_contributor_type", "indiv/recipients/party_breakdown": "aggregate_individual_by_party",
    "org/recipients/party_breakdown": "aggregate_organization_by_party", "org/recipients/level_breakdown": "aggregate_organization_by_state_fed", "pol/earmarks/local_breakdown": "earmarks_local",
}.items()}, "contributions")


def _one(route: str, table: str, fields: list[str]) -> str:
    text = "concat_ws('|', " + ", ".join(f"coalesce(CAST({f} AS VARCHAR), '')" for f in fields) + ")"
    return f"SELECT '{route}' AS route, CAST(entity_id AS VARCHAR) AS entity, NULL AS position, {text} AS row FROM {_from(table)} WHERE cycle = -1"


_family("single_rows", {
    "pol/contributors/industries_unknown": _one("pol/contributors/industries_unknown", "unknown_industries_to_politician", _AMOUNTS),
    "entity/totals": _one("entity/totals", "entity_totals", ["contributor_count", "recipient_count", _M("contributor_amount"), _M("recipient_amount")]),
}, "contributions")

_totals = lambda kind, also="": f"{_from('entity_totals')} x JOIN {_ENTITY} e ON e.entity_key = x.entity_id AND e.type = '{kind}' {also}"
_gave = ["name", "entity_id", "contributor_count", _M("contributor_amount")]
_most = "contributor_amount DESC NULLS LAST, contributor_count DESC"
_by = lambda who, by, kind, also="": f"{_from(f'aggregate_{who}_by_{by}')} x JOIN {_ENTITY} e ON e.entity_key = x.entity_id AND e.type = '{kind}' {also}"
_family("top_of_all", {
    "pols/top": _sql("pols/top", _totals("politician", f"LEFT JOIN {_LATEST} l ON l.latest_id = x.entity_id"), "NULL", ["name", "entity_id", "recipient_count", _M("recipient_amount"), "state", "party", "seat"], "recipient_amount DESC NULLS LAST, recipient_count DESC", _all),
    "orgs/top": _sql("orgs/top", _totals("organization"), "NULL", _gave, _most, _all), "indivs/top": _sql("indivs/top", _totals("individual"), "NULL", _gave, _most, _all),
    "industries/top": _sql("industries/top", _totals("industry", f"LEFT JOIN {_SHOWN} s ON s.shown_id = x.entity_id"), "NULL", [*_gave, "coalesce(should_show_entity, true)"], _most, f"{_all} AND coalesce(should_show_entity, true) AND parent_industry_id IS NULL"),
    "indivs/party/top": _sql("indivs/party/top", _by("individual", "party", "individual"), "party", ["entity_id", "name", *_AMOUNTS], f"{_BY_AMOUNT}, count DESC", _keyed("party")),
    "indivs/area/top": _sql("indivs/area/top", _by("individual", "state_fed", "individual"), "state_fed", ["entity_id", "name", *_AMOUNTS], f"{_BY_AMOUNT}, count DESC", _keyed("state_fed")),
    "industries/party/top": _sql("industries/party/top", _by("industry", "party", "industry"), "party", ["entity_id", "name", *_AMOUNTS], f"{_BY_AMOUNT}, count DESC", f"{_keyed('party')} AND entity_id IN (SELECT entity_id FROM {_INDUSTRY_IDS}) AND NOT regexp_matches(lower(name), 'unknown|retired|self|own campaign')"),
}, "contributions")

_lobby = lambda route, table, *fields, amount=False: _sql(route, _from(f"lobby_{table}"), "entity_id", [*fields, "count", *([_M("amount")] if amount else [])], _BY_AMOUNT if amount else _BY_COUNT, _keyed("entity_id"))
_family("lobbying_lists", {r: _lobby(r, t, *f, amount=t in ("registrants_for_client", "clients_for_registrant")) for r, (t, f) in {
    "org/registrants": ("registrants_for_client", ("registrant_name", "registrant_entity")), "org/issues": ("issues_for_client", ("issue",)), "org/bills": ("bills_for_client", ("bill_type", "bill_no", "congress_no", "bill_name")),
    "org/lobbyists": ("lobbyists_for_client", ("lobbyist_name", "lobbyist_entity")), "indiv/registrants": ("registrants_for_lobbyist", ("registrant_name", "registrant_entity")), "indiv/issues": ("issues_for_lobbyist", ("issue",)),
    "indiv/clients": ("clients_for_lobbyist", ("client_name", "client_entity")), "org/registrant/issues": ("issues_for_registrant", ("issue",)), "org/registrant/bills": ("bills_for_registrant", ("bill_type", "bill_no", "congress_no", "bill_name")),
    "org/registrant/clients": ("clients_for_registrant", ("client_name", "client_entity")), "org/registrant/lobbyists": ("lobbyists_for_registrant", ("lobbyist_name", "lobbyist_entity")),
}.items()}, "lobbying")
_spend = lambda route, column, where: _sql(route, f"{_from('lobby_by_cycle_rolled_up')} x JOIN {_ENTITY} e ON e.entity_key = x.entity_id", "NULL", ["name", "entity_id", _M(column)], f"{column} DESC NULLS LAST", f"{_all} AND {column} > 0 AND {where}")
_family("lobbying_top", {
    "orgs/lobbying/top": _spend("orgs/lobbying/top", "non_firm_spending", "type = 'organization'"), "industries/lobbying/top": _spend("industries/lobbying/top", "non_firm_spending", f"type = 'industry' AND entity_id IN (SELECT entity_id FROM {_INDUSTRY_IDS})"),
    "industries/lobbying/all": _spend("industries/lobbying/all", "non_firm_spending", "type = 'industry'"), "orgs/lobbying_firms/top": _spend("orgs/lobbying_firms/top", "firm_income", "true"),
}, "lobbying")

_names = ["recipient_name", "recipient_id", "firm_name", "firm_id", "lobbyist_name", "lobbyist_id"]
_of = lambda who: _sql(f"bundles/of_{who}", f"(SELECT {', '.join(_names)}, type, sum(coalesce(amount, 0)) AS amount FROM {_from('bundling')} b LEFT JOIN {_ENTITY} e ON e.entity_key = b.recipient_id GROUP BY ALL)", {"recipient": "recipient_id", "firm": "firm_id", "lobbyist": "lobbyist_id"}[who], [*_names, "type", _M("amount")], _BY_AMOUNT, f"{who}_id IS NOT NULL")
_explored = lambda route, *names: _sql(route, f"(SELECT {', '.join(names)}, sum(amount) AS total, count(*) AS count FROM {_from('bundling')} GROUP BY ALL)", "NULL", [*names, _M("total"), "count"], "total DESC NULLS LAST")
_family("bundles", {
    **{f"bundles/of_{w}": _of(w) for w in ("recipient", "firm", "lobbyist")}, "lobbyist_bundling/recipients": _explored("lobbyist_bundling/recipients", "recipient_name", "recipient_id"),
    "lobbyist_bundling/firms": _explored("lobbyist_bundling/firms", "firm_name", "firm_id"), "lobbyist_bundling/transactions": _explored("lobbyist_bundling/transactions", *_names),
    "indivs/lobbyist_bundlers/top": _sql("indivs/lobbyist_bundlers/top", f"(SELECT lobbyist_id, name, count(*) AS count, sum(amount) AS amount FROM {_from('bundling')} b JOIN {_ENTITY} e ON e.entity_key = b.lobbyist_id GROUP BY ALL)", "NULL", ["lobbyist_id", "name", *_AMOUNTS], f"{_BY_AMOUNT}, count DESC"),
})

_docket = lambda route, kind: _sql(route, f"{_from(f'regulation_{kind}_top_dockets')} x JOIN {_DOCKET} d ON d.docket_id = x.docket", "entity_id", ["agency", "docket", "year", "count", "title"], _BY_COUNT, _keyed("entity_id"))
_family("public_records", {
    "org/fed_spending": _sql("org/fed_spending", _from("spending_linked_top_records"), "entity_id", ["recipient_name", "spending_type", "fiscal_year", "agency_name", "description", _M("amount")], _BY_AMOUNT, _keyed("entity_id")),
    "pol/earmarks": _sql("pol/earmarks", _from("earmark_top_by_entity"), "entity_id", ["fiscal_year", _M("amount"), "description", "members", "recipients"], f"{_BY_AMOUNT}, fiscal_year DESC", _keyed("entity_id")),
    "org/epa_enforcement_actions": _sql("org/epa_enforcement_actions", _from("enforcement_top_actions"), "entity_id", ["case_num", "case_name", "defendant_name", "num_defendants", "defendants", "locations", "location_addresses", _M("penalty"), "year", "last_date_significance"], "rank", _keyed("entity_id")),
    "org/contractor_misconduct": _sql("org/contractor_misconduct", _from("misconduct_top_instances"), "contractor_entity", ["year", "date_significance", "contractor", _M("penalty_amount"), "contracting_party", "instance", "disposition", "misconduct_type", "misconduct_url"], "penalty_amount DESC NULLS LAST, year DESC", _keyed("contractor_entity")),
    "org/regulations_text": _docket("org/regulations_text", "text"), "org/regulations_submitter": _docket("org/regulations_submitter", "submitter"),
    "orgs/regulations/submitters/top": _sql("orgs/regulations/submitters/top", f"{_from('regulation_text_totals')} x JOIN {_ENTITY} e ON e.entity_key = x.entity_id AND e.type = 'organization'", "NULL", ["entity_id", "name", "document_count"], "document_count DESC", f"{_all} AND lower(name) NOT IN ('network', 'impact', 'member')"),
})

for _group, _dims in ct.BY.items():
    _parts = []
    for _dim in _dims:
        _labels, _default = api.SUMMARIES[_dim]
        _label = f"CASE {_dim} {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in _labels.items())} ELSE " + (f"'{_default}'" if _default else _dim) + " END"
        _cut = f"WHERE name <> '{_default}' OR position <= 10" if _default else ""
        _parts.append(f"""SELECT '{_dim}' AS dimension, * FROM (SELECT cycle, name, sum(c)::BIGINT AS count, sum(a) AS amount FROM (SELECT DISTINCT cycle, {_label} AS name, {_dim}, total_count AS c, total_amount AS a FROM {_from(f"summary_{_group}_by_{_dim}")}) GROUP BY ALL)
  JOIN (SELECT * FROM (SELECT cycle, {_label} AS name, row_number() OVER (PARTITION BY cycle, {_label} ORDER BY amount DESC, entity_id, {_dim}) AS position, entity_id, amount AS given FROM {_from(f"summary_{_group}_by_{_dim}")}) {_cut}) USING (cycle, name)""")
    query(f"lookup_summaries_{_group}", " UNION ALL ".join(_parts))(lambda s, d, g=_group: plans._plain(api.summary_rows(plans.tables(s, d), g)).withColumns({c: F.col(c).cast("long") for c in ("entity_id", "position")}))
