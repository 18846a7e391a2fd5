"""Plans that read a large table once, where they read it for each part of a row or for each route."""

from meridian.plans import contributions as ct
from meridian.queries import QUERIES

SF = "/root/testdata/sf0.001"


def reads(df, column: str) -> int:
    """How many times a plan reads tables that have a column."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum("Relation [" in line and f"{column}#" in line for line in plan.split("\n"))


def test_bundlers_are_read_once(spark):
    assert reads(QUERIES["bundles_denormalized"](spark, SF), "employer") == 1


def test_look_ups_of_bundles_compute_them_once(spark):
    assert reads(QUERIES["lookup_bundles"](spark, SF), "employer") == 0


def test_distinct_counts_of_dockets_do_not_repeat_rows(spark):
    assert "Expand" not in QUERIES["regulation_totals"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_sources_of_politicians_find_no_links_but_recipients(spark, monkeypatch):
    seen = []
    sources = ct.politician_sources
    monkeypatch.setattr(ct, "politician_sources", lambda t, by: (seen.append("linked" in t), sources(t, by))[1])
    QUERIES["politician_by_contributor_type"](spark, SF)
    assert seen == [False]


def test_lobbying_figures_are_added_up_once_for_children_and_industries(spark):
    assert reads(QUERIES["lobby_by_cycle_rolled_up"](spark, SF), "registrant_ids") == 0
