"""Lobbying, spending, earmarks, enforcement, advisory committees, misconduct, regulations, election filings, bundling and metadata.

All are compositions of the same primitives: totals with all cycles, ranks, full joins, latest rows, range membership.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.cycles import cycle_week, even_year, odd_down
from meridian.operators.joins import cycles_between
from meridian.operators.ranking import first_row, global_rank, most_frequent, top_n
from meridian.operators.rollup import cumulative, full_join, repeat_for_all_cycles, with_all_cycles

TOP_N = 10


# --- lobbying


def lobbying_reports(lobbying: DataFrame) -> DataFrame:
    """Reports in use, by even cycle."""
    return lobbying.filter("use").withColumn("cycle", even_year(F.col("year")))


def lobbying_top(reports: DataFrame, who: DataFrame, what: DataFrame, by: list[str], n: int = TOP_N) -> DataFrame:
    """Issues, bills, lobbyists or others of an entity: records per value, the most frequent n of each cycle and of all; ties by name come in order.

    who: (entity_id, transaction_id); what: transaction_id and the columns of by.
    """
    facts = reports.select("transaction_id", "cycle").join(who, "transaction_id").join(what, "transaction_id")
    each = facts.groupBy("entity_id", *by, "cycle").agg(F.count("*").alias("count"))  # first, so that no fact is repeated for each grouping
    g = with_all_cycles(each, ["entity_id", *by], {"count": F.sum("count")})
    return top_n(g, ["entity_id", "cycle"], [F.desc("count"), *[F.asc(b) for b in by]], n)


def lobbying_registrants(reports: DataFrame, who: DataFrame, n: int = TOP_N) -> DataFrame:
    """Firms that an entity hired, by what it paid them."""
    facts = reports.join(who, "transaction_id")
    g = with_all_cycles(facts, ["entity_id", "registrant_name"], {"count": F.count("*"), "amount": F.sum("amount")})
    return top_n(g, ["entity_id", "cycle"], [F.desc("amount"), F.desc("count")], n)


def lobbying_by_year(reports: DataFrame, lobbyists: DataFrame, firms: DataFrame, clients: DataFrame) -> DataFrame:
    """Of each entity and year: reports as lobbyist, as firm with income, as client with spending; 0 where there is none."""
    base = reports.select("transaction_id", "year", "amount")
    l = lobbyists.join(base, "transaction_id").groupBy("entity_id", "year").agg(F.countDistinct("transaction_id").alias("lobbyist_count"))  # noqa: E741
    f = firms.join(base, "transaction_id").groupBy("entity_id", "year").agg(F.count("*").alias("firm_count"), F.sum("amount").alias("firm_income"))
    c = clients.join(base, "transaction_id").groupBy("entity_id", "year").agg(F.count("*").alias("client_count"), F.sum("amount").alias("client_spending"))
    return full_join([l, f, c], ["entity_id", "year"], ["lobbyist_count", "firm_count", "firm_income", "client_count", "client_spending"])


def rolled_up(by_year: DataFrame, parents: DataFrame, sums: list[str]) -> DataFrame:
    """Figures of children added to their parents'. parents: (entity_id, parent_id)."""
    up = by_year.join(parents, "entity_id").drop("entity_id").withColumnRenamed("parent_id", "entity_id")
    return by_year.unionByName(up).groupBy("entity_id", "year").agg(*[F.sum(c).alias(c) for c in sums])


def by_cycle(by_year: DataFrame, sums: list[str]) -> DataFrame:
    return with_all_cycles(by_year.withColumn("cycle", even_year(F.col("year"))), ["entity_id"], {c: F.sum(c) for c in sums})


def biggest_for_topics(reports: DataFrame, biggest: DataFrame, topics: DataFrame, by: str) -> DataFrame:
    """Topics across the biggest organisations, ranked over all rows by count, and for each the organisations, ranked within it."""
    facts = reports.select("transaction_id").join(biggest, "transaction_id").join(topics, "transaction_id")
    g = facts.groupBy(by, "entity_id").agg(F.count("*").alias("count"))
    across = global_rank(g.groupBy(by).agg(F.sum("count").alias("total")), [F.desc("total"), F.asc(by)], "topic_rank")
    return g.withColumn("rank", F.rank().over(Window.partitionBy(by).orderBy(F.desc("count"), "entity_id"))).join(across, by)


# --- spending


def spending_totals(kinds: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Counts and amounts of grants, loans and contracts of each recipient, per cycle and in all, side by side.

    kinds: name to (rows with entity_id and cycle, amount column). One pass over the union gives what full joins of the kinds would.
    """
    rows = reduce(DataFrame.unionByName, [d.select("entity_id", "cycle", F.col(a).alias("amount"), F.lit(k).alias("kind")) for k, (d, a) in kinds.items()])
    measures = {}
    for k in kinds:
        hit = F.col("kind") == k
        measures |= {f"{k}_count": F.count_if(hit), f"{k}_amount": F.coalesce(F.sum(F.when(hit, F.col("amount"))), F.lit(0))}
    return with_all_cycles(rows, ["entity_id"], measures)


def top_records(rows: DataFrame, order: list[Column], n: int = TOP_N) -> DataFrame:
    """The n largest records themselves, of each entity and cycle and over all cycles."""
    return top_n(repeat_for_all_cycles(rows), ["entity_id", "cycle"], order, n)


# --- earmarks


def earmarks_by_cycle(earmarks: DataFrame) -> DataFrame:
    """Odd fiscal years go to the year before; presidential ones are left out."""
    return earmarks.filter("not presidential").withColumn("cycle", odd_down(F.col("fiscal_year")))


def earmarks_in_state(earmarks: DataFrame, members: DataFrame, places: DataFrame) -> DataFrame:
    """Amounts of a member's earmarks for places in and out of the member's state; an earmark with any place in it is in it."""
    rows = earmarks.join(members, "earmark_id")
    home = places.select("earmark_id", F.col("state").alias("place")).distinct()
    flagged = rows.join(home.withColumn("hit", F.lit(True)), (rows["earmark_id"] == home["earmark_id"]) & (F.col("state") == F.col("place")), "left")
    where = flagged.withColumn("in_state", F.coalesce("hit", F.lit(False)))
    return with_all_cycles(where, ["entity_id", "in_state"], {"count": F.count("*"), "amount": F.sum("amount")})


# --- enforcement, advisory committees, misconduct, regulations


def enforcement_actions(milestones: DataFrame, penalties: DataFrame, defendants: DataFrame) -> DataFrame:
    """Fifteen correlated look-ups of the feed as three grouped joins: first and last year, penalty, defendants and their names."""
    m = milestones.groupBy("action_id").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    p = penalties.groupBy("action_id").agg(F.sum("amount").alias("penalty"))
    d = defendants.groupBy("action_id").agg(F.countDistinct("name").alias("num_defendants"), F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("defendants"))
    return m.join(p, "action_id", "left").join(d, "action_id", "left")


def enforcement_relevant(actions: DataFrame, after: int = 2000, least: int = 1_000_000) -> DataFrame:
    return actions.filter((F.col("first_year") > after) & (F.col("penalty") > least)).withColumn("cycle", even_year(F.col("first_year")))


def advisory_records(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First and last day of a membership, with the affiliation of its latest row."""
    latest = first_row(rows, keys, [F.col("end_date"), F.col("affiliation")]).select(*keys, "affiliation")
    return rows.groupBy(*keys).agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date")).join(latest, keys)


def advisory_totals(records: DataFrame, cycles: list[int]) -> DataFrame:
    """Members and committees of each organisation in every cycle that a membership touches."""
    each = cycles_between(records, F.year("start_date"), F.year("end_date"), cycles)
    return each.groupBy("org_id", "cycle").agg(F.countDistinct("member").alias("member_count"), F.countDistinct("committee").alias("committee_count"))


def misconduct_top(rows: DataFrame, n: int = TOP_N) -> DataFrame:
    """Latest first; nothing known about the day comes first."""
    return top_n(repeat_for_all_cycles(rows), ["entity_id", "cycle"], [F.col("date").desc_nulls_first(), F.desc("penalty")], n)


def docket_mentions(comments: DataFrame, matches: DataFrame, dockets: DataFrame, n: int = TOP_N) -> DataFrame:
    """Documents that mention an entity, by docket and agency: most first, per cycle (of the docket's year) and in all. Repeated matches count once."""
    once = matches.select("document_id", "entity_id").distinct()
    facts = once.join(comments.select("document_id", "docket_id"), "document_id").join(dockets, "docket_id").withColumn("cycle", even_year(F.col("year")))
    g = with_all_cycles(facts, ["entity_id", "docket_id", "agency"], {"count": F.count("*")})
    return top_n(g, ["entity_id", "cycle"], [F.desc("count"), F.asc("docket_id")], n)


def docket_totals(comments: DataFrame, matches: DataFrame, dockets: DataFrame) -> DataFrame:
    """Dockets and documents of each entity, each once, per cycle and in all: an entity's dockets and documents with the set of their cycles, where distinct counts over all groupings would repeat every row."""
    facts = matches.join(comments.select("document_id", "docket_id"), "document_id").join(dockets, "docket_id").withColumn("cycle", even_year(F.col("year")))
    one = lambda key: facts.groupBy("entity_id", key).agg(F.collect_set(F.struct("cycle")).alias("_in")).select("entity_id", "_in", *[F.lit(int(c == key)).alias(c) for c in ("docket_id", "document_id")])
    both = one("docket_id").unionByName(one("document_id")).withColumn("cycle", F.explode(F.concat(F.expr("_in.cycle"), F.array(F.lit(-1)))))
    return both.groupBy("entity_id", "cycle").agg(F.sum("docket_id").alias("docket_count"), F.sum("document_id").alias("document_count"))


# --- election filings


def race_status(candidates: DataFrame) -> DataFrame:
    """Whether any candidate of a race is in it, has won or has lost."""
    return candidates.filter("status = 'C'").groupBy("election_year", "race").agg(F.max(F.col("won").cast("int")).alias("won"), F.max(F.col("ran").cast("int")).alias("ran"))


def candidate_rankings(summaries: DataFrame) -> DataFrame:
    """Ranks of receipts, cash and spending within office and cycle, with the field's size."""
    w = lambda c: F.rank().over(Window.partitionBy("office", "cycle").orderBy(F.desc(c)))
    size = summaries.groupBy("office", "cycle").agg(F.countDistinct("candidate_id").alias("field_size"))
    return summaries.withColumns({f"rank_{c}": w(c) for c in ("receipts", "cash", "spending")}).join(size, ["office", "cycle"])


def candidate_timeline(feeds: list[DataFrame]) -> DataFrame:
    """Weekly sums and running sums of each candidate over several feeds (candidate_id, date, amount)."""
    rows = reduce(DataFrame.unionByName, [f.select("candidate_id", "date", "amount") for f in feeds]).filter("date is not null")
    weekly = rows.groupBy("candidate_id", even_year(F.year("date")).alias("cycle"), cycle_week(F.col("date")).alias("week")).agg(F.count("*").alias("count"), F.sum("amount").alias("amount"))
    return cumulative(weekly, ["candidate_id", "cycle"], "week", "amount", "cumulative")


def itemized(individuals: DataFrame, groups: DataFrame, kinds: tuple[int, int] = (10, 19)) -> DataFrame:
    """Both feeds as one; only types whose first two digits lie in the range."""
    both = individuals.unionByName(groups)
    return both.filter(F.left("type", F.lit(2)).try_cast("int").between(*kinds))


def committee_summaries(filings: DataFrame, sums: list[str]) -> DataFrame:
    return filings.groupBy("cycle", "entity_id").agg(F.count("*").alias("count"), F.min("date").alias("first"), F.max("date").alias("last"), *[F.sum(c).alias(c) for c in sums])


def independent_spending(rows: DataFrame, superseded: DataFrame) -> DataFrame:
    """Filings that no amendment replaces, by committee, candidate and whether for or against."""
    valid = rows.join(superseded, "filing_number", "left_anti")
    return valid.groupBy("cycle", "committee_id", "candidate_id", "support_oppose").agg(F.count("*").alias("count"), F.sum("amount").alias("amount"))


# --- bundling and metadata


def bundles_latest(bundles: DataFrame) -> DataFrame:
    """The latest filing of each committee and half-year."""
    return first_row(bundles, ["committee_id", "half"], [F.col("end_date"), F.col("filing_date"), F.col("file_num")])


def metadata_latest(metadata: DataFrame) -> DataFrame:
    """The row of an entity's last real cycle."""
    return first_row(metadata.filter("cycle > 0"), ["entity_id"], [F.col("cycle")])


def politician_metadata(facts: DataFrame, columns: list[str]) -> DataFrame:
    """The most frequent state, party, seat and so on of each entity and cycle."""
    return most_frequent(facts, ["entity_id", "cycle"], columns)
