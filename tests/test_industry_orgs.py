"""The route industry/orgs lists who gave, not who received."""

from pyspark.sql import functions as F

from meridian.plans import api
from meridian.plans import contributions as ct
from meridian.queries import plans
from tests.conftest import SF


def test_industry_orgs_lists_givers(spark):
    t = {"top_orgs_by_industry": spark.createDataFrame([(1, "Acme", 7, -1, 3, 1, 2, 9.0, 4.0, 5.0), (1, "Bolt", None, -1, 1, 1, 0, 2.0, 2.0, 0.0), (2, "Other", 8, -1, 1, 1, 0, 99.0, 99.0, 0.0)], "entity_id int, organization_name string, organization_entity int, cycle int, total_count int, pacs_count int, indivs_count int, total_amount double, pacs_amount double, indivs_amount double")}
    assert [(r["name"], r["id"], r["total_amount"], r["direct_amount"], r["employee_amount"]) for r in api.lookup(t, "industry/orgs", 1).collect()] == [("Acme", 7, 9.0, 4.0, 5.0), ("Bolt", None, 2.0, 2.0, 0.0)]


def test_names_without_entity_have_a_row_for_each_side(spark):
    t = plans.tables(spark, SF, linked=False)
    t["attribute"] = t["attribute"].filter("namespace not like '%:organization'")
    t["contribution"] = t["contribution"].withColumn("organization_name", F.lit("Nobody")).withColumn("contributor_name", F.lit("Nobody"))
    rows = ct.top_orgs_by_industry(t).collect()
    assert {r["organization_name"] for r in rows} == {"Nobody"} and all(r["organization_entity"] is None for r in rows)
    per = {}
    for r in rows:
        per.setdefault((r["entity_id"], r["cycle"]), []).append((r["pacs_count"] > 0, r["indivs_count"] > 0))
    assert all(v == [(True, True)] if c == -1 else sorted(v) == [(False, True), (True, False)] for (_, c), v in per.items())
