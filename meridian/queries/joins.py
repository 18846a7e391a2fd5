"""Joins, subqueries and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.functions.geo import EARTH_KM, haversine_km
from meridian.functions.text import standard_orgname
from meridian.operators import joins as jn
from meridian.operators import setops
from meridian.operators.rollup import full_join
from meridian.queries.base import CONTRIBUTIONS, contributions, money, query, table


@query("join_inner_left", """SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""")
def join_inner_left(spark, sf):
    """The literal predicate goes to the scan before the join."""
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("join_right", "SELECT n_nationkey, count(s_suppkey) AS suppliers FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def join_right(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "right").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("suppliers"))


@query("join_full_pivot", f"""WITH {CONTRIBUTIONS},
a AS (SELECT organization_id, cycle, sum(amount) AS pac FROM contributions WHERE recipient_type = 'C' GROUP BY ALL),
b AS (SELECT organization_id, cycle, sum(amount) AS indiv FROM contributions WHERE recipient_type = 'P' AND amount > 400000 GROUP BY ALL)
SELECT organization_id, cycle, coalesce(pac, 0)::DOUBLE AS pac, coalesce(indiv, 0)::DOUBLE AS indiv FROM a FULL JOIN b USING (organization_id, cycle)""")
def join_full_pivot(spark, sf):
    c = contributions(spark, sf)
    side = lambda where, name: c.filter(where).groupBy("organization_id", "cycle").agg(F.sum("amount").alias(name))
    both = full_join([side("recipient_type = 'C'", "pac"), side("recipient_type = 'P' and amount > 400000", "indiv")], ["organization_id", "cycle"], ["pac", "indiv"])
    return both.select("organization_id", "cycle", F.col("pac").cast("double").alias("pac"), F.col("indiv").cast("double").alias("indiv"))


@query("join_full_four_way", """WITH a AS (SELECT year(o_orderdate)::INTEGER AS y, count(*) AS orders FROM orders GROUP BY 1),
b AS (SELECT year(l_shipdate)::INTEGER AS y, count(*) AS lines FROM lineitem GROUP BY 1), c AS (SELECT year(ts)::INTEGER AS y, count(*) AS events FROM events GROUP BY 1),
d AS (SELECT 1995 + n_nationkey AS y, count(*) AS nations FROM nation GROUP BY 1)
SELECT y, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines, coalesce(events, 0) AS events, coalesce(nations, 0) AS nations
FROM a FULL JOIN b USING (y) FULL JOIN c USING (y) FULL JOIN d USING (y)""")
def join_full_four_way(spark, sf):
    count = lambda t, y, name: table(spark, sf, t).groupBy(y.cast("int").alias("y")).agg(F.count("*").alias(name))
    parts = [count("orders", F.year("o_orderdate"), "orders"), count("lineitem", F.year("l_shipdate"), "lines"), count("events", F.year("ts"), "events"), count("nation", 1995 + F.col("n_nationkey"), "nations")]
    return full_join(parts, ["y"], ["orders", "lines", "events", "nations"])


@query("join_cross_values", "SELECT n_nationkey, cycle FROM nation CROSS JOIN (VALUES (-1), (1996), (1998)) v(cycle)")
def join_cross_values(spark, sf):
    """A list of parameters for every row: an exploded array, no join."""
    return table(spark, sf, "nation").select("n_nationkey", F.explode(F.array(F.lit(-1), F.lit(1996), F.lit(1998))).alias("cycle"))


@query("join_range_cycles", """WITH r AS (SELECT l_orderkey, year(min(l_shipdate)) AS a, year(max(l_shipdate)) AS b FROM lineitem GROUP BY 1)
SELECT v.cycle::INTEGER AS cycle, count(*) AS members, count(DISTINCT l_orderkey % 100) AS kinds FROM r JOIN (VALUES (-1), (1996), (1998), (2000)) v(cycle) ON v.cycle = -1 OR v.cycle BETWEEN a AND b GROUP BY 1""")
def join_range_cycles(spark, sf):
    r = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.year(F.min("l_shipdate")).alias("a"), F.year(F.max("l_shipdate")).alias("b"))
    return jn.cycles_between(r, F.col("a"), F.col("b"), [1996, 1998, 2000]).groupBy("cycle").agg(F.count("*").alias("members"), F.countDistinct(F.col("l_orderkey") % 100).alias("kinds"))


@query("join_valid_from_to", """WITH v AS (SELECT o_custkey AS k, min(o_orderdate)::DATE AS start, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE (min(o_orderdate) + INTERVAL 400 DAY)::DATE END AS stop FROM orders GROUP BY o_custkey)
SELECT o_orderkey, (v.k IS NOT NULL) AS inside FROM orders LEFT JOIN v ON v.k = o_custkey AND o_orderdate::DATE >= start AND o_orderdate::DATE <= coalesce(stop, DATE '9999-12-31')""")
def join_valid_from_to(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    v = o.groupBy("o_custkey").agg(F.min("d").alias("start")).withColumn("stop", F.when(F.col("o_custkey") % 3 != 0, F.date_add("start", 400)))
    return jn.valid_at(o, v, "o_custkey", F.col("d"), F.col("start"), F.col("stop")).select("o_orderkey", F.col("start").isNotNull().alias("inside"))


@query("join_or_condition", """SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey = s_suppkey OR c_acctbal = s_acctbal""")
def join_or_condition(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return jn.or_join(c, s, [(c["c_custkey"], s["s_suppkey"]), (c["c_acctbal"], s["s_acctbal"])]).select("c_custkey", "s_suppkey")


@query("join_ci_key", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON lower(c_name) = lower('CUSTOMER#' || lpad(o_custkey::VARCHAR, 9, '0'))")
def join_ci_key(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.lower(F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).alias("k"))
    c = table(spark, sf, "customer").select("c_custkey", F.lower("c_name").alias("k"))
    return c.join(o, "k").select("c_custkey", "o_orderkey")


@query("join_prefix_key", "SELECT c.c_custkey, count(*) AS n FROM customer c JOIN customer d ON left(c.c_name, 17) = left(d.c_name, 17) GROUP BY c.c_custkey")
def join_prefix_key(spark, sf):
    c = table(spark, sf, "customer")
    groups = c.groupBy(F.left("c_name", F.lit(17)).alias("p")).agg(F.count("*").alias("n"))
    return jn.prefix_join(c, groups, F.col("c_name"), F.col("p"), 17).select("c_custkey", "n")


@query("prefer_exact_match", """WITH m AS (SELECT c_custkey, s_suppkey, right(c_name, 9) = right(s_name, 9) AS exact FROM customer JOIN supplier ON left(right(c_name, 9), 8) = left(right(s_name, 9), 8))
SELECT c_custkey, coalesce(max(CASE WHEN exact THEN s_suppkey END), max(s_suppkey)) AS s_suppkey FROM m GROUP BY c_custkey""")
def prefer_exact_match(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.right("c_name", F.lit(9)).alias("a"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.right("s_name", F.lit(9)).alias("b"))
    return jn.prefer_exact(jn.prefix_join(c, s, F.col("a"), F.col("b"), 8), ["c_custkey"], F.col("a") == F.col("b"), "s_suppkey")


@query("join_function_key", r"""SELECT a.p_partkey, count(*) AS n FROM part a JOIN (SELECT DISTINCT p_name || ' Inc.' AS name FROM part) b
ON lower(a.p_name) = regexp_replace(lower(b.name), ' ?inc\.?$', '') GROUP BY a.p_partkey""")
def join_function_key(spark, sf):
    p = table(spark, sf, "part")
    b = p.select(standard_orgname(F.concat("p_name", F.lit(" Inc."))).alias("k")).distinct()
    return p.join(b, standard_orgname(F.col("p_name")) == b["k"]).groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("join_cast_key", "SELECT e.event_id, n_name FROM events e JOIN nation ON try_cast(json_extract_string(props, '$.k') AS INTEGER) = n_nationkey")
def join_cast_key(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("n_nationkey"))
    return e.join(table(spark, sf, "nation"), "n_nationkey").select("event_id", "n_name")


@query("join_case_key", "SELECT o_orderkey, r_name FROM orders JOIN region ON r_regionkey = CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 9 END")
def join_case_key(spark, sf):
    key = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(9)
    return table(spark, sf, "orders").withColumn("r_regionkey", key).join(table(spark, sf, "region"), "r_regionkey").select("o_orderkey", "r_name")


@query("semi_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def semi_exists(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(li, "o_orderkey", "left_semi").select("o_orderkey")


@query("anti_not_exists", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_not_exists(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("anti_not_in_null", "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_custkey > 10 THEN NULL ELSE c_custkey END FROM customer)")
def anti_not_in_null(spark, sf):
    """NOT IN with a null among the values holds for no row; the null-aware anti join knows."""
    table(spark, sf, "orders").createOrReplaceTempView("m_orders")
    table(spark, sf, "customer").createOrReplaceTempView("m_customer")
    return spark.sql("SELECT count(*) AS n FROM m_orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_custkey > 10 THEN NULL ELSE c_custkey END FROM m_customer)")


@query("anti_left_null", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def anti_left_null(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("anti_tuple_not_in", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND b.l_returnflag = 'R')")
def anti_tuple_not_in(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_suppkey").distinct().join(li.filter("l_returnflag = 'R'").select("l_orderkey", "l_suppkey"), ["l_orderkey", "l_suppkey"], "left_anti")


@query("exists_under_or", """SELECT o_orderkey FROM orders WHERE o_totalprice > 490000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50) OR EXISTS (SELECT 1 FROM region WHERE r_name = 'MARS')""")
def exists_under_or(spark, sf):
    for t in ("orders", "lineitem", "region"):
        table(spark, sf, t).createOrReplaceTempView(f"m_{t}")
    return spark.sql("""SELECT o_orderkey FROM m_orders WHERE o_totalprice > 490000
        OR EXISTS (SELECT 1 FROM m_lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50) OR EXISTS (SELECT 1 FROM m_region WHERE r_name = 'MARS')""")


@query("self_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join(spark, sf):
    a, b = (table(spark, sf, "nation").select(F.col("n_nationkey").alias(x), "n_regionkey") for x in "ab")
    return a.join(b, "n_regionkey").filter("a < b").select("a", "b")


@query("pairwise_amount", """SELECT sum(amount)::DOUBLE AS amount, count(*) AS n FROM (SELECT o_orderkey, o_totalprice::DECIMAL(15,2) AS amount FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 5)))""")
def pairwise_amount(spark, sf):
    """What one group gave another: both sides as semi joins, so no transaction counts twice."""
    c = table(spark, sf, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    s = table(spark, sf, "supplier").filter("s_nationkey = 5").select(F.col("s_suppkey").alias("l_suppkey"))
    li = table(spark, sf, "lineitem").join(s, "l_suppkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = table(spark, sf, "orders").join(c, "o_custkey", "left_semi").join(li, "o_orderkey", "left_semi")
    return rows.agg(F.sum(money("o_totalprice")).cast("double").alias("amount"), F.count("*").alias("n"))


@query("geo_nearest", f"""WITH n AS (SELECT n_nationkey, 10.0 + n_nationkey AS lat, -20.0 + 3 * n_nationkey AS lon FROM nation)
SELECT n_nationkey, round(2 * {EARTH_KM} * asin(sqrt(pow(sin(radians(lat - 12.5) / 2), 2) + cos(radians(12.5)) * cos(radians(lat)) * pow(sin(radians(lon + 10.25) / 2), 2))), 3) AS km
FROM n ORDER BY km, n_nationkey LIMIT 5""")
def geo_nearest(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", (10.0 + F.col("n_nationkey")).alias("lat"), (-20.0 + 3 * F.col("n_nationkey")).alias("lon"))
    return jn.nearest(n, F.round(haversine_km(F.lit(12.5), F.lit(-10.25), F.col("lat"), F.col("lon")), 3), 5, ["n_nationkey"]).select("n_nationkey", F.col("distance").alias("km"))


@query("correlated_scalar_to_join", "SELECT o_orderkey, (SELECT max(l_shipdate)::DATE FROM lineitem WHERE l_orderkey = o_orderkey) AS last_ship, (SELECT sum(l_quantity::DECIMAL(15,2))::DOUBLE FROM lineitem WHERE l_orderkey = o_orderkey) AS quantity FROM orders")
def correlated_scalar_to_join(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("last_ship"), F.sum(money("l_quantity")).cast("double").alias("quantity"))
    return table(spark, sf, "orders").select("o_orderkey").join(li, "o_orderkey", "left")


@query("scalar_uncorrelated", "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def scalar_uncorrelated(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("m_orders")
    return spark.sql("SELECT count(*) AS n FROM m_orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM m_orders)")


@query("in_nested_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE')))")
def in_nested_subquery(spark, sf):
    r = table(spark, sf, "region").filter("r_name = 'EUROPE'").select(F.col("r_regionkey").alias("n_regionkey"))
    n = table(spark, sf, "nation").join(r, "n_regionkey", "left_semi").select(F.col("n_nationkey").alias("c_nationkey"))
    c = table(spark, sf, "customer").join(n, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("union_mixed_left_assoc", """SELECT k, count(*) AS n FROM (SELECT o_custkey % 50 AS k FROM orders UNION SELECT c_custkey % 60 FROM customer UNION ALL SELECT s_suppkey FROM supplier) GROUP BY k""")
def union_mixed_left_assoc(spark, sf):
    k = lambda t, e: table(spark, sf, t).select(F.expr(e).alias("k"))
    return setops.distinct_then_all([k("orders", "o_custkey % 50"), k("customer", "c_custkey % 60")], [k("supplier", "s_suppkey")]).groupBy("k").agg(F.count("*").alias("n"))


@query("except_chain", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT s_suppkey FROM supplier")
def except_chain(spark, sf):
    k = lambda t, c: table(spark, sf, t).select(F.col(c).alias("k"))
    return setops.except_chain(k("customer", "c_custkey"), table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), k("supplier", "s_suppkey"))


@query("union_branches_ordered", "SELECT * FROM (SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS amount FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier) ORDER BY amount DESC, kind, id LIMIT 25")
def union_branches_ordered(spark, sf):
    side = lambda t, p, k: table(spark, sf, t).select(F.lit(k).alias("kind"), F.col(f"{p}key").alias("id"), F.col(f"{p[0]}_acctbal").alias("amount"))
    return side("customer", "c_cust", "customer").unionByName(side("supplier", "s_supp", "supplier")).orderBy(F.desc("amount"), "kind", "id").limit(25)


def _snapshots(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.filter("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return old, new.unionByName(old.filter("o_orderkey % 97 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000))


SNAPSHOTS = """old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders),
new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM old WHERE o_orderkey % 11 <> 0
  UNION ALL SELECT o_orderkey + 1000000000, o_orderstatus, o_totalprice FROM old WHERE o_orderkey % 97 = 0)"""


@query("table_diff", f"""WITH {SNAPSHOTS} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS change
FROM old o FULL JOIN new n USING (o_orderkey) WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus <> n.o_orderstatus OR o.o_totalprice <> n.o_totalprice""")
def table_diff(spark, sf):
    return setops.table_diff(*_snapshots(spark, sf), "o_orderkey")


@query("apply_diff", f"WITH {SNAPSHOTS} SELECT * FROM new")
def apply_diff(spark, sf):
    old, new = _snapshots(spark, sf)
    return setops.apply_diff(old, new, setops.table_diff(old, new, "o_orderkey"), "o_orderkey")


@query("dirty_cycle_refresh", """WITH d AS (SELECT o_orderkey, (year(o_orderdate) + year(o_orderdate) % 2)::INTEGER AS cycle, o_totalprice FROM orders)
SELECT o_orderkey, cycle, CASE WHEN cycle IN (1996, 2000) THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM d""")
def dirty_cycle_refresh(spark, sf):
    from meridian.functions.cycles import to_cycle

    old = table(spark, sf, "orders").select("o_orderkey", to_cycle(F.col("o_orderdate")).alias("cycle"), "o_totalprice")
    new = old.withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return setops.refresh_cycles(old, new, spark.createDataFrame([(1996,), (2000,)], "cycle int"))


@query("superseded_filings", "SELECT o_orderkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderstatus = 'P' AND b.o_orderkey - 1 = a.o_orderkey)")
def superseded_filings(spark, sf):
    """An amendment names the filing before it; that one is out."""
    o = table(spark, sf, "orders")
    return o.join(o.filter("o_orderstatus = 'P'").select((F.col("o_orderkey") - 1).alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("unique_constraint", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_constraint(spark, sf):
    return setops.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("foreign_key_orphans", "SELECT event_id FROM events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)")
def foreign_key_orphans(spark, sf):
    return setops.orphans(table(spark, sf, "events").select("event_id", "user_id"), table(spark, sf, "customer").filter("c_custkey % 10 <> 3"), "user_id", "c_custkey").select("event_id")


@query("delete_using", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_using(spark, sf):
    bad = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(bad, "o_custkey", "left_anti").select("o_orderkey")
