"""Ranks, running figures and gap filling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridian.functions.cycles import cycle_week
from meridian.operators import ranking, rollup
from meridian.queries.base import CONTRIBUTIONS, contributions, money, query, table


@query("top_n_rank_ties", f"""WITH {CONTRIBUTIONS}, g AS (SELECT contributor_state, cycle, category, count(*) AS count, sum(amount) AS amount FROM contributions GROUP BY ALL)
SELECT contributor_state, cycle, category, count, amount::DOUBLE AS amount, rank FROM (SELECT *, rank() OVER (PARTITION BY contributor_state, cycle ORDER BY count DESC) AS rank FROM g) WHERE rank <= 2""")
def top_n_rank_ties(spark, sf):
    g = contributions(spark, sf).groupBy("contributor_state", "cycle", "category").agg(F.count("*").alias("count"), F.sum("amount").alias("amount"))
    return ranking.top_n(g, ["contributor_state", "cycle"], [F.desc("count")], 2).select("contributor_state", "cycle", "category", "count", F.col("amount").cast("double").alias("amount"), F.col("rank").cast("long").alias("rank"))


@query("dual_rank", f"""WITH {CONTRIBUTIONS}, g AS (SELECT party, contributor_id, count(*) AS count, sum(amount) AS amount FROM contributions GROUP BY ALL)
SELECT party, contributor_id, count, amount::DOUBLE AS amount, rank() OVER (PARTITION BY party ORDER BY count DESC) AS rank_by_count, rank() OVER (PARTITION BY party ORDER BY amount DESC) AS rank_by_amount FROM g""")
def dual_rank(spark, sf):
    g = contributions(spark, sf).groupBy("party", "contributor_id").agg(F.count("*").alias("count"), F.sum("amount").alias("amount"))
    r = ranking.dual_ranked(g, ["party"], F.desc("count"), F.desc("amount"))
    return r.select("party", "contributor_id", "count", F.col("amount").cast("double").alias("amount"), F.col("rank_by_count").cast("long").alias("rank_by_count"), F.col("rank_by_amount").cast("long").alias("rank_by_amount"))


@query("rank_global", "SELECT p_partkey, rank() OVER (ORDER BY p_retailprice DESC) AS rank FROM part")
def rank_global(spark, sf):
    return ranking.global_rank(table(spark, sf, "part"), [F.desc("p_retailprice")]).select("p_partkey", F.col("rank").cast("long").alias("rank"))


@query("rank_case_key", """SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice / 2 END DESC NULLS FIRST, o_orderkey) AS rank FROM orders""")
def rank_case_key(spark, sf):
    key = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(F.col("o_totalprice") / 2)
    return ranking.ranked(table(spark, sf, "orders"), ["o_custkey"], [key.desc_nulls_first(), F.asc("o_orderkey")]).select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("rank_multi_key", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_name) AS rank FROM part")
def rank_multi_key(spark, sf):
    return ranking.ranked(table(spark, sf, "part"), ["p_brand"], [F.desc("p_size"), F.asc("p_name")]).select("p_partkey", F.col("rank").cast("long").alias("rank"))


@query("running_sum_weeks", """WITH w AS (SELECT o_custkey, (year(o_orderdate) + year(o_orderdate) % 2)::INTEGER AS cycle,
floor(date_diff('day', make_date((year(o_orderdate) + year(o_orderdate) % 2 - 1)::INTEGER, 1, 1), o_orderdate::DATE) / 7)::INTEGER AS week, sum(o_totalprice::DECIMAL(15,2)) AS amount FROM orders GROUP BY ALL)
SELECT o_custkey, cycle, week, amount::DOUBLE AS amount, (sum(amount) OVER (PARTITION BY o_custkey, cycle ORDER BY week))::DOUBLE AS cumulative FROM w""")
def running_sum_weeks(spark, sf):
    from meridian.functions.cycles import to_cycle

    d = F.to_date("o_orderdate")
    w = table(spark, sf, "orders").groupBy("o_custkey", to_cycle(d).alias("cycle"), cycle_week(d).alias("week")).agg(F.sum(money("o_totalprice")).alias("amount"))
    return rollup.cumulative(w, ["o_custkey", "cycle"], "week", "amount").select("o_custkey", "cycle", "week", F.col("amount").cast("double").alias("amount"), F.col("cumulative").cast("double").alias("cumulative"))


@query("gap_fill_running_max", """WITH e AS (SELECT user_id, day(ts)::INTEGER AS step, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT user_id, step, sum(n) OVER (PARTITION BY user_id ORDER BY step)::BIGINT AS total FROM e),
s AS (SELECT user_id, unnest(generate_series(min(step), max(step)))::INTEGER AS step FROM e GROUP BY user_id)
SELECT user_id, step, max(total) OVER (PARTITION BY user_id ORDER BY step) AS total FROM s LEFT JOIN c USING (user_id, step)""")
def gap_fill_running_max(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", F.dayofmonth("ts").alias("step")).agg(F.count("*").alias("n"))
    c = rollup.cumulative(e, ["user_id"], "step", "n", "total").select("user_id", "step", "total")
    return rollup.gap_filled(c, ["user_id"], "step", "total").select("user_id", "step", "total")


@query("first_value_named_window", """SELECT event_id, first_value(event_type) OVER w AS latest_type, first_value(value) OVER w AS latest_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id)""")
def first_value_named_window(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return table(spark, sf, "events").select("event_id", F.first("event_type").over(w).alias("latest_type"), F.first("value").over(w).alias("latest_value"))


@query("weekly_window_counts", "SELECT event_type, (date_diff('day', DATE '2023-01-01', ts::DATE) // 7)::INTEGER AS week, count(*) AS n FROM events GROUP BY ALL")
def weekly_window_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", cycle_week(F.to_date("ts")).alias("week")).agg(F.count("*").alias("n"))


@query("rank_filter_at_query_time", """WITH g AS (SELECT l_suppkey, l_partkey, count(*) AS n, sum(l_extendedprice::DECIMAL(15,2)) AS amount FROM lineitem GROUP BY ALL)
SELECT l_partkey, n, amount::DOUBLE AS amount FROM g WHERE l_suppkey = 7 ORDER BY amount DESC, l_partkey LIMIT 10""")
def rank_filter_at_query_time(spark, sf):
    g = table(spark, sf, "lineitem").filter("l_suppkey = 7").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum(money("l_extendedprice")).alias("amount"))
    return g.orderBy(F.desc("amount"), "l_partkey").limit(10).withColumn("amount", F.col("amount").cast("double"))


@query("scalar_top_one", "SELECT o_custkey, min_by(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS first_order FROM orders GROUP BY o_custkey")
def scalar_top_one(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("stratified_bins", "SELECT c_custkey, ntile(10) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS bin FROM customer")
def stratified_bins(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.ntile(10).over(Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")).cast("long").alias("bin"))
