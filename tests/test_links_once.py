"""Records meet their entities once for each kind of link, and aren't dealt by names that are few."""

from pyspark.sql import functions as F

from meridian.operators import links
from meridian.plans import contributions as ct
from meridian.queries import plans
from tests.conftest import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_contributions_are_joined_once_for_each_kind(spark):
    t = plans.tables(spark, SF, linked=False)
    named = ct.linked(t, "organization", "parent", "industry", "recipient")
    joins = [x for x in _plan(named).splitlines() if "Join LeftOuter" in x]
    assert len(joins) == 4 and all("rightHint=(strategy=broadcast)" in x for x in joins)
    got = {r["transaction_id"]: (sorted(r["organization_ids"]), sorted(r["parent_ids"]), sorted(r["industry_ids"]), sorted(r["recipient_ids"])) for r in named.collect()}
    alone = [{r["transaction_id"]: sorted(r[f"{k}_ids"]) for r in ct.linked(t, k).collect()} for k in ("organization", "parent", "industry", "recipient")]
    assert got == {i: tuple(d[i] for d in alone) for i in alone[0]} and len(got) == ct.relevant(t).count()
    assert all(any(x[i] for x in got.values()) for i in range(4)) and any(not x[1] for x in got.values())


def test_kept_look_ups_are_broadcast_only_while_they_are_few(spark):
    rows = spark.range(links.FEW + 1).select(F.lit("many").alias("_kind"), F.array(F.col("id").cast("string")).alias("_key"), F.array("id").alias("_ids"))
    rows = rows.unionByName(rows.limit(5).withColumn("_kind", F.lit("few")))
    kept = links.kept(rows, "_kind")
    assert "broadcast" in _plan(kept["few"].join(rows, "_key")) and "broadcast" not in _plan(kept["many"].join(rows, "_key"))
    assert kept["few"].count() == 5 and kept["many"].count() == links.FEW + 1 and kept["none"].count() == 0
