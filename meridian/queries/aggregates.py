"""Aggregates: totals, pivots, rollups, breakdowns, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.functions.cycles import odd_down, semi_annual, to_cycle
from meridian.operators import ranking, rollup
from meridian.queries.base import CONTRIBUTIONS, RECIPIENTS, contributions, money, query, recipients, table


def _dbl(c: str) -> F.Column:
    return F.col(c).cast("double").alias(c)


@query("top_contributors", f"""WITH {CONTRIBUTIONS}, g AS (SELECT contributor_id, cycle, count(*) AS count, sum(amount) AS amount FROM contributions GROUP BY ALL
  UNION ALL SELECT contributor_id, -1, count(*), sum(amount) FROM contributions GROUP BY contributor_id),
r AS (SELECT *, rank() OVER (PARTITION BY cycle ORDER BY amount DESC) AS rank FROM g)
SELECT cycle, contributor_id, count, amount::DOUBLE AS amount, rank FROM r WHERE rank <= 10""")
def top_contributors(spark, sf):
    """The flagship: ten largest contributors of each cycle and of all, ties kept."""
    g = rollup.with_all_cycles(contributions(spark, sf), ["contributor_id"], {"count": F.count("*"), "amount": F.sum("amount")})
    return ranking.top_n(g, ["cycle"], [F.desc("amount")]).select("cycle", "contributor_id", "count", _dbl("amount"), F.col("rank").cast("long").alias("rank"))


@query("all_cycle_rollup", f"""WITH {CONTRIBUTIONS} SELECT organization_id, cycle, count(*) AS count, sum(amount)::DOUBLE AS amount FROM contributions GROUP BY ALL
UNION ALL SELECT organization_id, -1, count(*), sum(amount)::DOUBLE FROM contributions GROUP BY organization_id""")
def all_cycle_rollup(spark, sf):
    g = rollup.with_all_cycles(contributions(spark, sf), ["organization_id"], {"count": F.count("*"), "amount": F.sum("amount")})
    return g.select("organization_id", "cycle", "count", _dbl("amount"))


@query("agg_group_totals", f"WITH {CONTRIBUTIONS} SELECT party, namespace, count(*) AS count, sum(amount)::DOUBLE AS amount, min(date) AS first, max(date) AS last FROM contributions GROUP BY ALL")
def agg_group_totals(spark, sf):
    return contributions(spark, sf).groupBy("party", "namespace").agg(F.count("*").alias("count"), F.sum("amount").cast("double").alias("amount"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("agg_totals_given_received", f"""WITH {CONTRIBUTIONS}, {RECIPIENTS},
g AS (SELECT contributor_id AS entity_id, cycle, count(*) AS given, sum(amount) AS given_amount FROM contributions GROUP BY ALL),
r AS (SELECT entity_id, cycle, count(*) AS received, sum(amount) AS received_amount FROM contributions JOIN recipients USING (transaction_id) GROUP BY ALL)
SELECT entity_id, cycle, coalesce(given, 0) AS given, coalesce(given_amount, 0)::DOUBLE AS given_amount, coalesce(received, 0) AS received, coalesce(received_amount, 0)::DOUBLE AS received_amount
FROM g FULL JOIN r USING (entity_id, cycle)""")
def agg_totals_given_received(spark, sf):
    c = contributions(spark, sf)
    g = c.groupBy(F.col("contributor_id").alias("entity_id"), "cycle").agg(F.count("*").alias("given"), F.sum("amount").alias("given_amount"))
    r = c.join(recipients(spark, sf), "transaction_id").groupBy("entity_id", "cycle").agg(F.count("*").alias("received"), F.sum("amount").alias("received_amount"))
    both = rollup.full_join([g, r], ["entity_id", "cycle"], ["given", "given_amount", "received", "received_amount"])
    return both.select("entity_id", "cycle", "given", _dbl("given_amount"), "received", _dbl("received_amount"))


@query("agg_conditional_sum", "SELECT o_custkey, count_if(o_orderstatus = 'F') AS fed_count, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DECIMAL(15,2) ELSE 0 END)::DOUBLE AS fed_amount, sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice::DECIMAL(15,2) ELSE 0 END)::DOUBLE AS other_amount FROM orders GROUP BY o_custkey")
def agg_conditional_sum(spark, sf):
    fed, amount = F.col("o_orderstatus") == "F", money("o_totalprice")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(fed).alias("fed_count"), F.sum(F.when(fed, amount).otherwise(0)).cast("double").alias("fed_amount"), F.sum(F.when(~fed, amount).otherwise(0)).cast("double").alias("other_amount"))


@query("agg_count_distinct", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(*) AS lines FROM lineitem GROUP BY l_suppkey")
def agg_count_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"), F.count("*").alias("lines"))


@query("agg_string_distinct_sorted", "SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def agg_string_distinct_sorted(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ", ").alias("types"))


@query("agg_bool_or", "SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS urgent, bool_or(o_totalprice > 490000) AS large FROM orders GROUP BY o_custkey")
def agg_bool_or(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.bool_or(F.col("o_totalprice") > 490000).alias("large"))


@query("agg_distinct_then_sum", "SELECT l_suppkey, sum(q)::BIGINT AS kinds FROM (SELECT DISTINCT l_suppkey, l_quantity::BIGINT AS q FROM lineitem) GROUP BY l_suppkey")
def agg_distinct_then_sum(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("q")).distinct().groupBy("l_suppkey").agg(F.sum("q").alias("kinds"))


@query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def agg_having(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 15")


@query("agg_latest_row", "SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def agg_latest_row(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "value", "event_id", "ts")
    return ranking.first_row(rows, ["user_id"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("agg_mode_tuple", """SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY user_id, event_type) WHERE rn = 1""")
def agg_mode_tuple(spark, sf):
    return ranking.most_frequent(table(spark, sf, "events"), ["user_id"], ["event_type"])


@query("agg_concentration_index", """WITH g AS (SELECT l_suppkey, l_partkey % 7 AS issue, count(*)::DOUBLE AS x FROM lineitem GROUP BY ALL)
SELECT l_suppkey, sum(x * x) / (sum(x) * sum(x)) AS concentration, count(*) AS members FROM g GROUP BY l_suppkey""")
def agg_concentration_index(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") % 7).alias("issue"), F.lit(1).alias("one"))
    return rollup.concentration(rows, ["l_suppkey"], "issue", "one")


@query("agg_histogram", "SELECT (floor(l_extendedprice / 5000) * 5000)::BIGINT AS bucket, count(*) AS count FROM lineitem GROUP BY 1")
def agg_histogram(spark, sf):
    return rollup.histogram(table(spark, sf, "lineitem"), F.col("l_extendedprice"), 5000)


@query("pie_with_default", f"""WITH {CONTRIBUTIONS} SELECT contributor_state, CASE party WHEN '1' THEN 'Democrats' WHEN '2' THEN 'Republicans' ELSE 'Other' END AS category, count(*) AS count, sum(amount)::DOUBLE AS amount FROM contributions GROUP BY ALL""")
def pie_with_default(spark, sf):
    return rollup.pie(contributions(spark, sf), ["contributor_state"], "party", {"1": "Democrats", "2": "Republicans"}, "amount", "Other").withColumn("amount", F.col("amount").cast("double"))


@query("pie_without_default", f"WITH {CONTRIBUTIONS} SELECT CASE namespace WHEN 'federal' THEN 'Federal' ELSE namespace END AS category, count(*) AS count, sum(amount)::DOUBLE AS amount FROM contributions GROUP BY ALL")
def pie_without_default(spark, sf):
    return rollup.pie(contributions(spark, sf), [], "namespace", {"federal": "Federal"}, "amount").withColumn("amount", F.col("amount").cast("double"))


@query("summary_rollup_breakout", f"""WITH {CONTRIBUTIONS}, p AS (SELECT party, count(*) AS count, sum(amount) AS amount FROM contributions GROUP BY party),
c AS (SELECT party, contributor_state, sum(amount) AS a FROM contributions GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY party ORDER BY a DESC, contributor_state) AS k FROM c)
SELECT party, count, amount::DOUBLE AS amount, string_agg(contributor_state, ';' ORDER BY k) AS top_states FROM p JOIN r USING (party) WHERE k <= 10 GROUP BY ALL""")
def summary_rollup_breakout(spark, sf):
    c = contributions(spark, sf)
    parents = c.groupBy("party").agg(F.count("*").alias("count"), F.sum("amount").cast("double").alias("amount"))
    kids = c.groupBy("party", "contributor_state").agg(F.sum("amount").alias("given"))
    s = rollup.summary(parents, kids, "party", ["contributor_state"], "given")
    return s.select("party", "count", "amount", F.array_join(F.transform("children", lambda x: x["contributor_state"]), ";").alias("top_states"))


@query("pivot_by_kind", "SELECT l_suppkey, count_if(l_returnflag = 'R') AS pac_count, coalesce(sum(l_extendedprice::DECIMAL(15,2)) FILTER (l_returnflag = 'R'), 0)::DOUBLE AS pac_amount, count_if(l_returnflag = 'A') AS employee_count, coalesce(sum(l_extendedprice::DECIMAL(15,2)) FILTER (l_returnflag = 'A'), 0)::DOUBLE AS employee_amount FROM lineitem GROUP BY l_suppkey")
def pivot_by_kind(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("amount", money("l_extendedprice"))
    p = rollup.pivot_sum(rows, ["l_suppkey"], "l_returnflag", {"R": "pac", "A": "employee"}, "amount")
    return p.select("l_suppkey", "pac_count", _dbl("pac_amount"), "employee_count", _dbl("employee_amount"))


@query("unpivot_regroup", """WITH p AS (SELECT l_suppkey, coalesce(sum(l_extendedprice::DECIMAL(15,2)) FILTER (l_returnflag = 'R'), 0) AS pac, coalesce(sum(l_extendedprice::DECIMAL(15,2)) FILTER (l_returnflag = 'A'), 0) AS employee FROM lineitem GROUP BY l_suppkey)
SELECT kind, count(*) AS n, sum(amount)::DOUBLE AS amount FROM (SELECT 'pac' AS kind, pac AS amount FROM p UNION ALL SELECT 'employee', employee FROM p) GROUP BY kind""")
def unpivot_regroup(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("amount", money("l_extendedprice"))
    p = rollup.pivot_sum(rows, ["l_suppkey"], "l_returnflag", {"R": "pac", "A": "employee"}, "amount")
    u = rollup.unpivot(p, ["l_suppkey"], {"pac_amount": "pac", "employee_amount": "employee"}, "kind", "amount")
    return u.groupBy("kind").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


@query("two_level_union_sum", """SELECT k, sum(n)::BIGINT AS n FROM (SELECT o_custkey % 9 AS k, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT l_suppkey % 9, count(*) FROM lineitem GROUP BY 1) GROUP BY k""")
def two_level_union_sum(spark, sf):
    """Grouped branches regrouped: one aggregate over the union, which Spark splits into partial and final."""
    k = lambda t, c: table(spark, sf, t).select((F.col(c) % 9).alias("k"))
    return k("orders", "o_custkey").unionByName(k("lineitem", "l_suppkey")).groupBy("k").agg(F.count("*").alias("n"))


@query("entity_metadata_by_cycle", """SELECT o_custkey, string_agg(cycle || ':' || n, ',' ORDER BY cycle) AS by_cycle FROM (SELECT o_custkey, (year(o_orderdate) + year(o_orderdate) % 2)::INTEGER AS cycle, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def entity_metadata_by_cycle(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey", to_cycle(F.col("o_orderdate")).alias("cycle")).agg(F.count("*").alias("n"))
    m = g.groupBy("o_custkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cycle", "n")))).alias("m"))
    return m.select("o_custkey", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("by_cycle"))


@query("groupby_sorted_by_size", "SELECT event_type, count(*) AS size, min(event_id) AS first FROM events GROUP BY event_type")
def groupby_sorted_by_size(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("size"), F.min("event_id").alias("first")).orderBy(F.desc("size"), "event_type")


@query("table_counters", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def table_counters(spark, sf):
    one = lambda t: table(spark, sf, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
    return one("orders").unionByName(one("lineitem"))


@query("cycle_functions", """SELECT o_orderkey, (year(o_orderdate) + year(o_orderdate) % 2)::INTEGER AS cycle, (year(o_orderdate) - year(o_orderdate) % 2)::INTEGER AS fiscal, year(o_orderdate) || '/' || CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END AS half FROM orders""")
def cycle_functions(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", to_cycle(F.col("o_orderdate")).alias("cycle"), odd_down(F.year("o_orderdate")).alias("fiscal"), semi_annual(F.col("o_orderdate")).alias("half"))


@query("sql_function_cycle", "SELECT n_nationkey, ((1990 + n_nationkey) + (1990 + n_nationkey) % 2)::INTEGER AS cycle FROM nation")
def sql_function_cycle(spark, sf):
    """The cycle as a temporary SQL function, for callers who write SQL."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION year_cycle(y INT) RETURNS INT RETURN y + y % 2")
    table(spark, sf, "nation").createOrReplaceTempView("m_nation")
    return spark.sql("SELECT n_nationkey, year_cycle(1990 + n_nationkey) AS cycle FROM m_nation")


@query("latest_per_half_year", """SELECT o_custkey, half, o_orderkey FROM (SELECT o_custkey, year(o_orderdate) || '/' || CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END AS half, o_orderkey,
row_number() OVER (PARTITION BY o_custkey, half ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_per_half_year(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", semi_annual(F.col("o_orderdate")).alias("half"), "o_orderkey", "o_orderdate")
    return ranking.first_row(rows, ["o_custkey", "half"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")
