"""Ranks in large groups, links without keys, metadata by ranked sources, look-ups by route, stored tables that go."""

import pytest
from pyspark.sql import functions as F

from meridian.operators import links
from meridian.operators.ranking import rank_within
from meridian.plans import api
from meridian.plans import entity_metadata as em
from meridian.plans import public_records as pr
from meridian.queries import QUERIES, base
from tests.conftest import SF


def test_rank_within_a_group_of_a_million(spark):
    """One party of a million entities with ties and nulls: ranks equal a window's, and nothing brings the party's rows together."""
    df = spark.range(1_000_000).select(F.lit("D").alias("party"), F.lit(-1).alias("cycle"), F.col("id").alias("entity_id"), F.when(F.col("id") % 1000 == 7, None).otherwise((F.xxhash64("id") % 200_000) / 4).cast("decimal(15,2)").alias("amount"))
    got = rank_within(df, ["party", "cycle"], "amount")
    # a row's rank is 1 and the rows above it: counts by value, added up
    by_value = [(r["amount"], r["count"]) for r in df.groupBy("amount").count().orderBy(F.desc_nulls_last("amount")).collect()]
    want, before = {}, 0
    for v, n in by_value:
        want[v] = before + 1
        before += n
    seen = got.groupBy("amount", "rank").count().collect()
    assert len(seen) == len(want) and all(want[r["amount"]] == r["rank"] for r in seen) and sum(r["count"] for r in seen) == 1_000_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    wide = [x for x in plan.splitlines() if "Exchange hashpartitioning(party" in x and "amount" not in x and "_bucket" not in x]
    assert all("_m#" in plan for _ in wide)  # only sums of buckets are dealt by party and cycle alone


def test_rank_within_signs_and_small_numbers(spark):
    values = [None, -5.0, -5.0, -0.001, 0.0, 0.001, 0.0011, 1e-9, 3.0, 3.0, 1e15, 1e15 + 1, -1e15]
    df = spark.createDataFrame([("g", float(v) if v is not None else None, i) for i, v in enumerate(values)] + [(None, 1.0, 99)], "g string, v double, i int")
    got = {r["i"]: r["rank"] for r in rank_within(df, ["g"], "v").collect()}
    for i, v in enumerate(values):
        assert got[i] == 1 + sum(1 for w in values if w is not None and (v is None or w > v)), v
    assert got[99] == 1


def test_records_without_a_key_are_kept_and_spread(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(300)], "id long, name string")
    found = links.lookup(spark.createDataFrame([("A", 1), ("a", 2), (None, 3)], "alias string, entity_id int"), F.lower("alias"))
    got = links.with_ids(rows, found, F.lower("name"), "ids", "id").collect()
    assert len(got) == 300 and all(sorted(r["ids"]) == ([1, 2] if r["name"] else []) for r in got)


def test_merged_sources(spark):
    """The first source with a value wins field by field; nulls never do; keys without any value stay."""
    of = lambda rows, s: spark.createDataFrame(rows, s)
    rows = of([(1,), (2,), (3,)], "k int")
    first, second = of([(1, "a", None), (2, None, 5)], "k int, x string, y int"), of([(1, "b", 7), (2, "c", 8), (9, "z", 1), (1, "a2", 9)], "k int, x string, y int")
    both = lambda df: (df, {"x": F.col("x"), "y": F.col("y")})
    got = {r["k"]: (r["x"], r["y"]) for r in em.merged([(rows, {}), both(first), both(second)], ["k"], {"x": "string", "y": "int"}).collect()}
    assert got == {1: ("a", 7), 2: ("c", 5), 3: (None, None), 9: ("z", 1)}


def test_parent_conflicts(spark):
    """Most records decide; the least of equals; an organization is not its own parent; null counts as a parent."""
    rows = spark.createDataFrame([(1, 2010, 5), (1, 2010, 5), (1, 2010, None), (2, 2010, None), (2, 2010, 7), (3, 2010, 9), (3, 2010, 8), (4, 2010, None)], "entity_id int, cycle int, parent int")
    got = {r["entity_id"]: r["parent"] for r in em._most(rows, ["entity_id", "cycle"], ["parent"], F.count("*")).collect()}
    assert got == {1: 5, 2: 7, 3: 8, 4: None}


def test_amended_bundles(spark):
    """Of a half-year's filings the one with the latest end stands, of those the latest filed, of those the greatest number; without a filing day it comes last."""
    rows = [(1, "C1", "2009-03-31", "2009-04-01"), (2, "C1", "2009-03-31", "2009-05-01"), (3, "C1", "2009-03-31", None), (4, "C1", "2009-09-30", "2009-10-01"), (5, "C2", "2009-06-30", "2009-07-01"), (6, "C2", "2009-06-30", "2009-07-01")]
    b = spark.createDataFrame(rows, "file_num int, committee_fec_id string, end_date string, filing_date string").withColumns({c: F.to_date(c) for c in ("end_date", "filing_date")})
    assert sorted(r["file_num"] for r in pr.latest_bundles({"bundle": b}).collect()) == [2, 4, 6]


def test_every_route_reads_its_own_table():
    """Routes of politicians' contributors read what was given to politicians; every table of a route can be built."""
    assert api.ENDPOINTS["pol/contributors"].table == "top_orgs_to_politician" and api.ENDPOINTS["pol/contributors/industries"].table == "top_industries_to_politician"
    apart = {"candidate_timeline", "advisory_records"}  # tables that the caller has
    assert {e.table for e in api.ENDPOINTS.values()} - set(api.BUILDERS) == apart
    assert {j.table for e in api.ENDPOINTS.values() for j in e.joins} - set(api.BUILDERS) == {"entity", "industry_metadata", "docket"}


def test_lookups_by_route(spark):
    t = api.Warehouse(
        top_orgs_to_politician=spark.createDataFrame([(1, "Acme", 7, -1, 3, 1, 2, 9.0, 4.0, 5.0), (1, "Bolt", None, -1, 9, 9, 0, 9.0, 9.0, 0.0), (2, "Core", 8, -1, 1, 1, 0, 1.0, 1.0, 0.0), (1, "Acme", 7, 2010, 3, 1, 2, 2.0, 1.0, 1.0)],
            "entity_id int, organization_name string, organization_entity int, cycle int, total_count int, pacs_count int, indivs_count int, total_amount double, pacs_amount double, indivs_amount double"),
        unknown_industries_to_politician=spark.createDataFrame([(1, -1, 4, 5.0)], "entity_id int, cycle int, count int, amount double"),
        individual_by_party=spark.createDataFrame([(1, "R", -1, 2, 5.0), (2, "R", -1, 2, 5.0), (3, "R", -1, 1, 1.0), (4, "R", -1, 9, 9.0), (5, "D", -1, 1, 1.0)], "entity_id int, party string, cycle int, count int, amount double"),
        entity=spark.createDataFrame([(i, f"E{i}", "organization" if i == 4 else "individual") for i in range(1, 9)], "id int, name string, type string"),
        bundling=spark.createDataFrame([(1, "R", 2, "F", 3, "L", 2010, 5.0), (1, "R", 2, "F", 3, "L", 2012, 6.0), (9, "S", 2, "F", None, "M", 2012, 20.0)], "recipient_id int, recipient_name string, firm_id int, firm_name string, lobbyist_id int, lobbyist_name string, cycle int, amount double"),
    )
    assert [r["name"] for r in api.lookup(t, "pol/contributors", 1).collect()] == ["Bolt", "Acme"]
    assert [(r["count"], r["amount"]) for r in api.lookup(t, "pol/contributors/industries_unknown", 1).collect()] == [(4, 5.0)]
    assert sorted((r["entity_id"], r["rank"]) for r in api.lookup(t, "indivs/party/top", "R", limit=1).collect()) == [(1, 1), (2, 1)]  # ties stay; organizations are left out
    assert [(r["total"], r["count"]) for r in api.lookup(t, "lobbyist_bundling/firms").collect()] == [(31.0, 3)]
    assert [(r["total"], r["count"]) for r in api.lookup(t, "lobbyist_bundling/firms", cycle=2010).collect()] == [(5.0, 1)]
    assert [(r["recipient_name"], r["amount"]) for r in api.lookup(t, "bundles/of_firm", 2).collect()] == [("S", 20.0), ("R", 11.0)]
    t["independent_spending"] = spark.createDataFrame([(2012, 1, "x", 2, "c", "Support", 5.0), (2012, 1, "x", 2, "c", "oppose", 7.0), (2012, 3, "y", 2, "c", "Support", 50.0)], "cycle int, candidate_entity int, candidate_name string, committee_entity int, committee_name string, support_oppose string, amount double")
    t["politician_latest"] = spark.createDataFrame([(1, "federal:house", "OR", "D"), (3, "state:upper", "OR", "D")], "entity_id int, seat string, state string, party string")
    assert [(r["entity_id"], r["support_amount"], r["total_amount"]) for r in api.lookup(t, "pols/indexp/top", "federal:house").collect()] == [(1, 5.0, 12.0)]
    t["fec_candidate_places"] = spark.createDataFrame([(1, 2012, "in-state", 3, 4.0), (1, 2010, "in-state", 9, 9.0), (2, 2012, "out-of-state", 1, 1.0)], "entity_id int, cycle int, local string, count int, amount double")
    assert [tuple(r) for r in api.lookup(t, "pol/fec_local_breakdown", 1, cycle=2012).collect()] == [("in-state", 3, 4.0)]
    with pytest.raises(ValueError):
        api.lookup(t, "pol/contributors")
    rows = api.bulk(t, ["pol/contributors", "pol/contributors/industries_unknown"]).collect()
    assert {(r["route"], r["entity"], r["position"], r["fields"].get("name")) for r in rows} == {("pol/contributors", "1", 1, "Bolt"), ("pol/contributors", "1", 2, "Acme"), ("pol/contributors", "2", 1, "Core"), ("pol/contributors/industries_unknown", "1", None, None)}
    with pytest.raises(api.NotFound):
        api.Warehouse()["nothing"]


def test_summary_by_who_gives(spark):
    s = spark.createDataFrame([(1, "org_pac", 2012, 5.0, 10, 9.0), (2, "indiv", 2012, 4.0, 3, 4.0)], "entity_id int, org_pac_indiv string, cycle int, amount double, total_count long, total_amount double")
    assert [(r["name"], r["count"]) for r in api.summarise(s, "org_pac_indiv").collect()] == [("Org PACs", 10), ("Unaffiliated Individuals", 3)]


def test_stored_tables_are_made_anew_where_the_folder_was_emptied(spark):
    name = "unknown_industries_to_politician"
    before = QUERIES[name](spark, SF).count()
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    for path in list(base.PATHS):
        fs(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs(path), True)
    assert QUERIES[name](spark, SF).count() == before


def test_pages_far_on_equal_an_offset(spark, monkeypatch):
    """Beyond NEAR a page is cut by numbers of sorted ranges, ties or not."""
    from meridian.operators import ranking

    df = spark.range(5000).select("id", (F.col("id") * 37 % 101).alias("v"))
    order = [F.desc("v"), F.asc("id")]
    want = [r["id"] for r in df.orderBy(*order).collect()]
    for near in (10_000, 100):
        monkeypatch.setattr(ranking, "NEAR", near)
        for skip, size in ((0, 10), (101, 7), (4995, 50), (6000, 5)):
            assert [r["id"] for r in ranking.page(df, order, skip, size).collect()] == want[skip : skip + size]
