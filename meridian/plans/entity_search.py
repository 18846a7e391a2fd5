"""Finding entities: by words of their names, by ids elsewhere, and as plain lists.

Tables: entity (id, name, type), alias (entity_id, alias), attribute (entity_id, namespace, value), biography (entity_id, bioguide_id), entity_totals and lobbying_totals
(entity_id, cycle, figures), politician_metadata and org_metadata (entity_id, cycle, details), individual_metadata (entity_id, flags). Empty tables give no rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.cycles import ALL_CYCLES
from meridian.functions.text import text_match
from meridian.operators.ranking import checkpointed, first_row, page

Tables = dict[str, DataFrame]
#: What requests may ask for; anything else is not asked.
TYPES = ("organization", "industry", "individual", "politician")
SEATS = ("federal:house", "federal:president", "federal:senate", "state:governor", "state:judicial", "state:lower", "state:office", "state:upper")
STATES = tuple("AK AL AR AS AZ CA CO CT DC DE FL GA GU HI IA ID IL IN KS KY LA MA MD ME MI MN MO MP MS MT NC ND NE NH NJ NM NV NY OH OK OR PA PR RI SC SD TN TX UT VA VI VT WA WI WV WY".split())
PARTIES = ("D", "R", "O")
COMMITTEE = "urn:fec:committee"
#: For each type, the figures that make its score and what each is divided by.
SCORES = {
    "politician": {"recipient_amount": 715550915 / 2},
    "individual": {"contributor_amount": 73301345.75, "lobbying_count": 8882},
    "organization": {"contributor_amount": 364255258.20, "non_firm_spending": 969305680.0, "firm_income": 560548185.0},
    "industry": {"contributor_amount": 3648608028.38, "non_firm_spending": 5757475979.0, "firm_income": 2225030909.0},
}
#: An entity's figures by cycle: table, the entity's column in it, and the figures with their columns; counts are integers, all else is double.
TOTALS = {
    "entity_totals": ("entity_id", {"contributor_count": "contributor_count", "recipient_count": "recipient_count", "contributor_amount": "contributor_amount", "recipient_amount": "recipient_amount"}),
    "lobbying_totals": ("entity_id", {"lobbying_count": "count", "firm_income": "firm_income", "non_firm_spending": "non_firm_spending"}),
    "spending_totals": ("recipient_entity", {"grant_count": "grant_count", "contract_count": "contract_count", "loan_count": "loan_count", "grant_amount": "grant_amount", "contract_amount": "contract_amount", "loan_amount": "loan_amount"}),
    "earmark_totals": ("entity_id", {"earmark_count": "count", "earmark_amount": "amount"}),
    "misconduct_totals": ("entity_id", {"contractor_misconduct_count": "count"}),
    "enforcement_totals": ("entity_id", {"epa_actions_count": "count"}),
    "regulation_text_totals": ("entity_id", {"regs_docket_count": "docket_count", "regs_document_count": "document_count"}),
    "regulation_submitter_totals": ("entity_id", {"regs_submitted_docket_count": "docket_count", "regs_submitted_document_count": "document_count"}),
    "advisory_totals": ("org_id", {"faca_member_count": "member_count", "faca_committee_count": "committee_count"}),
    "independent_totals": ("entity_id", {"independent_expenditure_amount": "spending_amount"}),
    "committee_summaries": ("entity_id", {"fec_total_raised": "total_raised", "fec_summary_count": "count"}),
}
PER_PAGE, MOST_PER_PAGE, MOST_LISTED = 10, 25, 10_000


def _named(t: Tables, search: str) -> DataFrame:
    """Entities with an alias that has all the words. Words of the stop list alone find nothing."""
    if not search:
        raise ValueError("a search needs words")
    words = " ".join(re.split(r'[ &|!():*"]+', search))
    found = t["alias"].filter(text_match([F.col("alias")], [words])).select(F.col("entity_id").alias("id"))
    return t["entity"].join(found, "id", "left_semi")


def _with_figures(t: Tables, entities: DataFrame) -> DataFrame:
    given = t["entity_totals"].filter(F.col("cycle") == ALL_CYCLES).select(F.col("entity_id").alias("id"), "contributor_count", "recipient_count", "contributor_amount", "recipient_amount")
    lobbied = t["lobbying_totals"].filter(F.col("cycle") == ALL_CYCLES).select(F.col("entity_id").alias("id"), F.col("count").alias("lobbying_count"), "firm_income", "non_firm_spending")
    return entities.join(given, "id", "left").join(lobbied, "id", "left")


def _latest(metadata: DataFrame, *columns: str) -> DataFrame:
    return first_row(metadata.select("entity_id", "cycle", *columns), ["entity_id"], [F.col("cycle"), *[F.col(c) for c in columns]]).select(F.col("entity_id").alias("id"), *columns)


def totals(t: Tables, entities: DataFrame | None = None, cycle: int | None = None) -> DataFrame:
    """All figures of each entity (id) and cycle, 0 where a table has none; a row where any table has one. entities: only those with these ids, at most a page of them.

    Each table has one row at most for an entity and cycle, so a full join of the eleven is one aggregate of their union: one shuffle, not ten. A table that is not given counts
    as empty; rows without entity or cycle are nobody's.
    """
    names, parts = [n for _, figures in TOTALS.values() for n in figures], []
    for table, (key, figures) in TOTALS.items():
        if table not in t:
            continue
        rows = t[table].filter(F.col(key).isNotNull() & (F.col("cycle").isNotNull() if cycle is None else F.col("cycle") == cycle))
        own = {n: F.col(c).cast("int" if n.endswith("count") else "double") for n, c in figures.items()}
        parts.append(rows.select(F.col(key).alias("id"), F.col("cycle").cast("int").alias("cycle"), *[own.get(n, F.lit(None).cast("int" if n.endswith("count") else "double")).alias(n) for n in names]))
    both = reduce(DataFrame.unionAll, parts)
    if entities is not None:
        both = both.join(F.broadcast(entities.select("id").limit(MOST_PER_PAGE)), "id", "left_semi")
    return both.groupBy("id", "cycle").agg(*[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in names])


def search(t: Tables, words: str, kind: str | None = None) -> DataFrame:
    """Entities by words, with their figures over all cycles (nothing known: 0) and latest details. Politicians who received nothing are left out."""
    found = _with_figures(t, _named(t, words) if kind is None else _named(t, words).filter(F.col("type") == kind))
    received = F.coalesce((F.col("recipient_count") > 0) | (F.col("recipient_amount") > 0), F.lit(False))
    found = found.filter((F.col("type") != "politician") | received)
    found = found.join(_latest(t["politician_metadata"], "state", "party", "seat"), "id", "left").join(_latest(t["org_metadata"], "lobbying_firm", "is_superpac"), "id", "left")
    figures = {"count_given": "contributor_count", "count_received": "recipient_count", "count_lobbied": "lobbying_count"}
    amounts = {"total_given": "contributor_amount", "total_received": "recipient_amount", "firm_income": "firm_income", "non_firm_spending": "non_firm_spending"}
    return found.select(
        "id", "name", "type", *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(n) for n, c in figures.items()], *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for n, c in amounts.items()],
        "state", "party", "seat", "lobbying_firm", "is_superpac",
    )


def _score() -> Column:
    score = F.lit(0.0)
    for kind, parts in SCORES.items():
        total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / F.lit(float(by)) for c, by in parts.items()), F.lit(0.0))
        score = F.when(F.col("type") == kind, total).otherwise(score)
    return score


def _of_kind(t: Tables, found: DataFrame, params: dict[str, str]) -> DataFrame:
    """White lists: a value that is on none asks for nothing. A kind implies its type; `type` counts only without one."""
    among = lambda df, rows: df.join(rows.select(F.col("entity_id").alias("id")), "id", "left_semi")
    committees = t["attribute"].filter(F.col("namespace") == COMMITTEE)
    match params.get("subtype"):
        case "contributors" | "lobbyists" as who:
            return among(found.filter("type = 'individual'"), t["individual_metadata"].filter(F.col({"contributors": "is_contributor", "lobbyists": "is_lobbyist"}[who])))
        case "politicians":
            asked = {c: params[c] for c, known in (("seat", SEATS), ("state", STATES), ("party", PARTIES)) if params.get(c) in known}
            rows = t["politician_metadata"]
            for column, value in asked.items():
                rows = rows.filter(~F.col("party").isin("R", "D") if (column, value) == ("party", "O") else F.col(column) == value)
            found = found.filter("type = 'politician'")
            return among(found, rows) if asked else found
        case "industries":
            return found.filter("type = 'industry'")
        case "lobbying_firms":
            return found.filter("type = 'organization'").join(_latest(t["org_metadata"], "lobbying_firm").filter("lobbying_firm").select("id"), "id", "left_semi")
        case "political_groups":
            return among(found.filter("type = 'organization'"), committees)
        case "other_orgs":
            companies = ("is_corporation", "is_cooperative", "is_corp_w_o_capital_stock")
            latest = _latest(t["org_metadata"], "lobbying_firm", *companies).filter("not lobbying_firm")
            named = committees.filter("value <> ''").groupBy(F.col("entity_id").alias("id")).agg(F.lit(True).alias("_committee"))
            kept = latest.join(named, "id", "left").filter(F.expr(f"_committee is null or {' or '.join(companies)}"))
            return found.filter("type = 'organization'").join(kept.select("id"), "id", "left_semi")
    kinds = [k for k in params.get("type", "").split(",") if k in TYPES]
    return found.filter(F.col("type").isin(*kinds)) if kinds else found


def scored(t: Tables, params: dict[str, str]) -> DataFrame:
    """All entities that a search finds (id, name, type, score), in no order: the score weighs figures over all cycles by type."""
    return _with_figures(t, _of_kind(t, _named(t, params.get("search", "")), params)).select("id", "name", "type", _score().alias("score"))


def scored_page(t: Tables, params: dict[str, str]) -> DataFrame:
    """A page of them, best first, ties by id; 10 where not said, 25 at most. External ids are (namespace, id) in order; totals are those over all cycles, null where nothing is known."""
    size, number = min(int(params.get("per_page", PER_PAGE)), MOST_PER_PAGE), max(int(params.get("page", 1)), 1)
    order = [F.desc("score"), F.asc("id")]
    rows = checkpointed(page(scored(t, params), order, (number - 1) * size, size))  # the search runs once; what follows reads these few rows
    ids = t["attribute"].join(rows.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("namespace", F.col("value").alias("id")))).alias("external_ids"))
    known = totals(t, rows, ALL_CYCLES).drop("cycle")
    known = known.select("id", F.struct(*[c for c in known.columns if c != "id"]).alias("totals"))
    return rows.join(ids, "id", "left").join(known, "id", "left").orderBy(*order)


def scored_total(t: Tables, params: dict[str, str]) -> DataFrame:
    """One row: what the search finds in all, and in how many pages."""
    size = min(int(params.get("per_page", PER_PAGE)), MOST_PER_PAGE)
    return scored(t, params).agg(F.count("*").alias("total"), F.ceil(F.count("*") / F.lit(size)).alias("pages"))


def by_external_id(t: Tables, namespace: str | None = None, value: str | None = None, bioguide_id: str | None = None) -> DataFrame:
    """Entities with an id elsewhere; a biography's id goes first."""
    if bioguide_id:
        rows = t["biography"].filter(F.col("bioguide_id") == bioguide_id)
    elif namespace and value:
        rows = t["attribute"].filter((F.col("namespace") == namespace) & (F.col("value") == value))
    else:
        raise ValueError("a namespace with an id, or a biography's id, must be given")
    return rows.select(F.col("entity_id").alias("id"))


def listed(t: Tables, start: int, end: int, kind: str | None = None) -> DataFrame:
    """Entities from place start to place end, both counted, by id, with their aliases other than the name. Spans over 10,000 are an error."""
    if end < start or end - start > MOST_LISTED:
        raise ValueError("only 10,000 entities can be listed at a time")
    rows = t["entity"] if kind is None else t["entity"].filter(F.col("type") == kind)
    rows = rows.select("id", "name", "type")
    rows = page(rows, [F.col("id")], start, end - start + 1)
    other = t["alias"].select(F.col("entity_id").alias("id"), "alias")
    joined = rows.join(other, "id", "left").groupBy("id", "name", "type")
    return joined.agg(F.array_sort(F.collect_list(F.when(F.col("alias") != F.col("name"), F.col("alias")))).alias("aliases")).orderBy("id")


def count(t: Tables, kind: str | None = None) -> DataFrame:
    return (t["entity"] if kind is None else t["entity"].filter(F.col("type") == kind)).agg(F.count("*").alias("count"))


def type_totals(t: Tables, kind: str) -> DataFrame:
    """Per cycle, what all entities of a group gave and how many they are, from the summary of groups."""
    return t["entity_types"].filter(F.col("entity_type") == kind).select("cycle", "contributions_amount", "contributions_count", "entity_count")
