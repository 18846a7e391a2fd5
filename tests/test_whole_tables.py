"""Queries that once had a filter go over whole tables."""

from meridian.queries import QUERIES
from tests.conftest import SF


def test_money_is_shown_for_every_order(spark):
    rows = {r["o_orderkey"]: r["o_totalprice"] for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    got = {r["o_orderkey"]: r["shown"] for r in QUERIES["money_display"](spark, SF).collect()}
    assert got == {k: f"{v:,.2f}" for k, v in rows.items()} and len(got) == 1500


def test_districts_keep_inner_zeros(spark):
    got = {r["n_nationkey"]: r["district"] for r in QUERIES["etl_state_district"](spark, SF).collect()}
    assert got == {k: f"CA-{k}" if k else None for k in range(25)}


def test_facts_are_counted_before_they_are_repeated_for_each_grouping(spark):
    from meridian.plans import records

    reports = spark.range(20).selectExpr("id as transaction_id", "cast(2010 + id % 2 * 2 as int) as cycle")
    who, what = (spark.range(40).selectExpr("id % 20 as transaction_id", x) for x in ("id % 3 as entity_id", "id % 4 as issue"))
    plan = records.lobbying_top(reports, who, what, ["issue"])._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Expand", 1)[1]
    assert "Aggregate" in below and below.index("Aggregate") < below.index("Join")
