"""Independent spending: filings in force, their links to candidates and committees, and totals. Election filings: ranks, time lines, gifts, summaries.

Tables: indexp (cycle, candidate_id, candidate_name, spender_id, spender_name, election_type, candidate_state, candidate_district, candidate_office, candidate_party, amount and
aggregate_amount as text, support_oppose, date, purpose, payee, filing_number, prev_file_num, amendment, transaction_id, image_number, received_date), entity, attribute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.cleaning import money
from meridian.functions.cycles import cycle_week
from meridian.operators.ranking import equal_join, first_row, rank_within

Tables = dict[str, DataFrame]


def filings(t: Tables) -> DataFrame:
    """Filings that none of the spender's own amends, with amounts as numbers; only candidates for the house have a district."""
    i = t["indexp"]
    replaced = i.filter("prev_file_num is not null").select("spender_id", F.col("prev_file_num").alias("filing_number")).distinct()
    valid = i.join(replaced, ["spender_id", "filing_number"], "left_anti")
    district = F.when(F.col("candidate_office") == "House", F.col("candidate_district")).otherwise("")
    return valid.withColumns({"candidate_district": district, "amount": money(F.col("amount")), "aggregate_amount": money(F.col("aggregate_amount"))}).drop("prev_file_num")


def _added(rows: DataFrame, first: DataFrame, figures: list[str], *keys) -> DataFrame:
    """The figures that first already has, added up by keys (of days the first and the last), in the types of first.

    What is added up by a filer before the filer's entities are joined makes no row for each filing and entity, which would grow with the square.
    """
    of = lambda c: {"first_filing_date": F.min, "last_filing_date": F.max}.get(c, F.sum)
    return rows.groupBy(*keys).agg(*[of(c)(c).cast(first.schema[c].dataType).alias(c) for c in figures])


def _entities(t: Tables, namespace: str, name: str) -> DataFrame:
    return t["attribute"].filter(F.col("namespace") == namespace).select("entity_id", F.col("value").alias(name))


def candidate_links(t: Tables) -> DataFrame:
    """entity_id, cycle, spender_id, filing_number, transaction_id, each once."""
    return filings(t).join(_entities(t, "urn:fec:candidate", "candidate_id"), "candidate_id").select("entity_id", "cycle", "spender_id", "filing_number", "transaction_id").distinct()


def committee_links(t: Tables) -> DataFrame:
    """entity_id, cycle, spender_id, each once."""
    spenders = filings(t).select("cycle", "spender_id").distinct()  # before entities are joined, as in _added
    return spenders.join(_entities(t, "urn:fec:committee", "spender_id").distinct(), "spender_id").select("entity_id", "cycle", "spender_id")


def _by_spender(t: Tables) -> DataFrame:
    """Filings in force with the entities of their candidates (null without), added up by spender, cycle, candidate and whether for or against."""
    candidates = candidate_links(t).withColumnRenamed("entity_id", "candidate_entity").drop("cycle")
    rows = filings(t).join(candidates, ["spender_id", "filing_number", "transaction_id"], "left")
    return rows.groupBy("cycle", "spender_id", "spender_name", "candidate_entity", "candidate_name", "support_oppose").agg(F.sum("amount").alias("amount"))


def independent_spending(t: Tables) -> DataFrame:
    """Amounts by cycle, candidate, committee and whether for or against, under the entities' names where there are entities."""
    named = lambda who: t["entity"].select(F.col("id").alias(f"{who}_entity"), F.col("name").alias(f"_{who}"))
    committees = committee_links(t).withColumnRenamed("entity_id", "committee_entity").join(named("committee"), "committee_entity", "left")
    spent = _by_spender(t)
    rows = equal_join(spent.join(named("candidate"), "candidate_entity", "left"), committees, ["spender_id", "cycle"], "left")
    keys = ["cycle", "candidate_entity", F.coalesce("_candidate", "candidate_name").alias("candidate_name"), "committee_entity", F.coalesce("_committee", "spender_name").alias("committee_name"), "support_oppose"]
    return _added(rows, spent, ["amount"], *keys)


def independent_totals(t: Tables) -> DataFrame:
    """What each committee spent in a cycle."""
    spent = _by_spender(t).groupBy("cycle", "spender_id").agg(F.sum("amount").alias("spending_amount"))
    return _added(equal_join(spent, committee_links(t).filter("entity_id is not null"), ["spender_id", "cycle"]), spent, ["spending_amount"], "cycle", "entity_id")


def of_candidates(t: Tables) -> DataFrame:
    """Filings in force with the entity of their candidate."""
    return filings(t).join(candidate_links(t), ["cycle", "spender_id", "filing_number", "transaction_id"])


def of_committees(t: Tables) -> DataFrame:
    """Filings in force with the entity of their committee."""
    return filings(t).join(committee_links(t), ["cycle", "spender_id"])


# --- election filings
#
# Tables: candidate (candidate_id, cycle, candidate_name, office, office_state, party, race, candidate_status, incumbent_challenger_open, committee_id, election_year), candidate_summary
# (candidate_id, cycle, total_receipts, total_disbursements, ending_cash, ending_date, the parts of RAISED and others, the four election statuses), committee (committee_id, cycle,
# committee_name, connected_org), committee_summary (committee_id, cycle, through_date, amounts), giver (filer_id, cycle, date, amount, contributor_name, transaction_type, employer,
# occupation, city, state, zipcode), group_gift (filer_id, other_id, cycle, date, amount, transaction_type, city, state, zipcode), politician_state.

STATUSES = ("special_election_status", "primary_election_status", "runoff_election_status", "general_election_status")


def running(t: Tables) -> DataFrame:
    """Candidates in a race with their summaries."""
    return t["candidate"].filter("candidate_status = 'C'").join(t["candidate_summary"], ["candidate_id", "cycle"])


def race_status(t: Tables) -> DataFrame:
    """The greatest status of any candidate of a race in each of its elections."""
    return running(t).groupBy("election_year", "race").agg(*[F.max(c).alias(c) for c in STATUSES])


RANKED = {"total_receipts": "total_receipts_rank", "ending_cash": "cash_on_hand_rank", "total_disbursements": "total_disbursements_rank"}


def candidate_rankings(t: Tables) -> DataFrame:
    """Ranks within office and cycle: winners of a primary among such winners; those who lost it, or have not had it, among all candidates, winners too.

    The number of candidates in the field is of winners, and of all. A loser is ranked among all and gets both numbers, as two rows (so in the original, whose join names no status).
    """
    rows = running(t).select("candidate_id", "office", "cycle", "primary_election_status", *RANKED)
    won = F.col("primary_election_status").eqNullSafe("W")

    def placed(d: DataFrame) -> DataFrame:
        for c, name in RANKED.items():
            d = rank_within(d, ["office", "cycle"], c, name)
        return d

    field = rows.groupBy("office", "cycle").agg(F.countDistinct("candidate_id").alias("all"), F.countDistinct(F.when(won, F.col("candidate_id"))).alias("winners"))
    field = field.select("office", "cycle", F.explode(F.expr("filter(array(struct('W' as of, winners as num_candidates_in_field), struct('' as of, `all` as num_candidates_in_field)), x -> x.num_candidates_in_field > 0)")).alias("f"))
    winners = placed(rows.filter(won)).join(field.filter("f.of = 'W'"), ["office", "cycle"])
    others = placed(rows).filter("primary_election_status is null or primary_election_status = 'L'").join(field, ["office", "cycle"])
    return winners.unionByName(others).select("candidate_id", "office", "cycle", "primary_election_status", "f.num_candidates_in_field", *RANKED.values())


def candidate_timeline(t: Tables) -> DataFrame:
    """Weekly gifts of people and groups to each candidate's committee, and their running sum."""
    gifts = t["giver"].select(F.col("filer_id").alias("committee_id"), "cycle", "date", "amount").unionByName(t["group_gift"].select(F.col("other_id").alias("committee_id"), "cycle", "date", "amount"))
    rows = t["candidate"].join(t["candidate_summary"].select("candidate_id", "cycle"), ["candidate_id", "cycle"]).join(gifts, ["committee_id", "cycle"])
    weeks = rows.groupBy("candidate_id", "cycle", "race", cycle_week(F.col("date")).alias("week")).agg(F.count("*").alias("count"), F.sum("amount").alias("amount"))
    return weeks.withColumn("cumulative_raised", F.sum("amount").over(Window.partitionBy("candidate_id", "cycle", "race").orderBy(F.asc_nulls_last("week"))))


def candidate_itemized(t: Tables) -> DataFrame:
    """Every gift to a candidate's committee, of people and of groups under their committee's name."""
    keep = ("city", "state", "zipcode", "date", "amount", "transaction_type", "cycle")
    people = t["giver"].select(F.col("filer_id").alias("committee_id"), F.lit("indiv").alias("contributor_type"), "contributor_name", "employer", "occupation", *keep)
    names = t["committee"].select(F.col("committee_id").alias("filer_id"), "cycle", F.col("committee_name").alias("contributor_name"), F.col("connected_org").alias("employer"))
    groups = t["group_gift"].join(names, ["filer_id", "cycle"]).select(F.col("other_id").alias("committee_id"), F.lit("pac").alias("contributor_type"), "contributor_name", "employer", F.lit("").alias("occupation"), *keep)
    c = t["candidate"].select("committee_id", "cycle", "candidate_id", "candidate_name", "party", "race", F.col("incumbent_challenger_open").alias("status"))
    return c.join(people.unionByName(groups), ["committee_id", "cycle"])


def candidate_summaries(t: Tables) -> DataFrame:
    """What each politician (entity_id) raised and spent in a cycle, with the ranks; a row for each rank that there is."""
    ranks = candidate_rankings(t).drop("office", "primary_election_status")
    rows = t["candidate"].select("candidate_id", "cycle", "office").join(t["candidate_summary"], ["candidate_id", "cycle"]).join(_entities(t, "urn:fec:candidate", "candidate_id"), "candidate_id")
    rows = rows.join(ranks, ["candidate_id", "cycle"], "left")
    return rows.select(
        "entity_id", "cycle", F.expr("total_receipts - (candidate_loan_repayments + other_loan_repayments + refunds_to_individuals + refunds_to_committees)").alias("total_raised"), "office", *RANKED.values(),
        F.col("num_candidates_in_field").alias("max_rank"), F.expr("total_individual_contributions - refunds_to_individuals").alias("contributions_indiv"), F.col("contributions_from_other_committees").alias("contributions_pac"),
        F.col("contributions_from_party_committees").alias("contributions_party"), F.expr("contributions_from_candidate + loans_from_candidate - candidate_loan_repayments").alias("contributions_candidate"),
        F.col("authorized_transfers_from").alias("transfers_in"), F.col("total_disbursements").alias("disbursements"), F.col("ending_cash").alias("cash_on_hand"), F.col("ending_date").alias("date"),
    )


#: What a committee's summary adds up: name to expression.
COMMITTEE_SUMS = {
    "total_raised": "total_receipts - (loan_repayments + refunds_to_individuals + refunds_to_committees)", "contributions_from_indiv": "individual_contributions - refunds_to_individuals",
    "contributions_from_pacs": "contributions_from_other_committees", "transfers_from_affiliates": "transfers_from_affiliates", "nonfederal_transfers_received": "nonfederal_transfers_received", "loans_received": "total_loans_received",
    "disbursements": "total_disbursements", "cash_on_hand": "cash_close_of_period", "debts": "debts_owed", "contributions_to_committees": "contributions_to_committees", "independent_expenditures_made": "independent_expenditures_made",
    "party_coordinated_expenditures_made": "party_coordinated_expenditures_made", "nonfederal_expenditure_share": "nonfederal_expenditure_share",
}


def committee_summaries(t: Tables) -> DataFrame:
    """Sums of the filings of an organization's (entity_id) committees in a cycle, with the first and last day and their number."""
    sums = [F.sum(F.expr(x)).alias(n) for n, x in COMMITTEE_SUMS.items()]
    own = t["committee_summary"].groupBy("committee_id", "cycle").agg(*sums, F.min("through_date").alias("first_filing_date"), F.max("through_date").alias("last_filing_date"), F.count("*").alias("num_committee_filings"))
    return _added(own.join(_entities(t, "urn:fec:committee", "committee_id"), "committee_id"), own, own.columns[2:], "entity_id", "cycle")


def candidate_places(t: Tables) -> DataFrame:
    """Gifts of people to each politician (entity_id) from in and out of the state of the office; an unknown state is out of it."""
    own = t["giver"].groupBy(F.col("filer_id").alias("committee_id"), "cycle", F.col("state").alias("_from")).agg(F.count("*").alias("count"), F.sum("amount").alias("amount"))
    rows = t["candidate"].join(own, ["committee_id", "cycle"]).join(_entities(t, "urn:fec:candidate", "candidate_id"), "candidate_id")
    local = F.when(F.col("office_state") == F.col("_from"), "in-state").otherwise("out-of-state")
    return _added(rows, own, ["count", "amount"], "entity_id", "cycle", local.alias("local"))


#: Types of gifts that a committee's top contributors are counted by.
GIFTS = ("10", "11", "15", "15e", "15j", "22y")


def top_contributors(t: Tables) -> DataFrame:
    """What each giver gave to an organization's (entity_id) committees, by type and cycle."""
    gifts = t["giver"].filter(F.col("transaction_type").isin(*GIFTS)).withColumnRenamed("filer_id", "committee_id")
    own = gifts.groupBy("committee_id", "cycle", "contributor_name", "transaction_type").agg(F.count("*").alias("count"), F.sum("amount").alias("amount"))
    rows = own.join(t["committee"].select("committee_id", "cycle"), ["committee_id", "cycle"]).join(_entities(t, "urn:fec:committee", "committee_id"), "committee_id")
    return _added(rows, own, ["count", "amount"], "entity_id", "cycle", "contributor_name", "transaction_type")


def by_office(t: Tables) -> DataFrame:
    """Candidates in a race who hold a seat in that cycle's metadata, ranked by receipts within their office (its first letter)."""
    rows = running(t).filter("incumbent_challenger_open is not null").select("candidate_id", "cycle", "candidate_name", "office", "total_receipts")
    latest = first_row(t["politician_state"], ["entity_id"], [F.col("cycle")]).select("entity_id", "cycle")
    rows = rows.join(_entities(t, "urn:fec:candidate", "candidate_id"), "candidate_id").join(latest, ["entity_id", "cycle"])
    return rank_within(rows, ["office"], "total_receipts")
