"""Record search: the filter language, full text, projection, sorting and paging."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from meridian.functions import text
from meridian.functions.cleaning import mapped
from meridian.operators import filters as fl
from meridian.queries.base import CONTRIBUTIONS, contributions, money, query, table

SCHEMA = {
    "amount": fl.comparison("amount", fl.amount), "date": fl.comparison("date", fl.as_date), "cycle": fl.cycle_pair("cycle"),
    "contributor_state": fl.upper_inclusion("contributor_state"), "contributor_ft": fl.fulltext("contributor_name"), "category": fl.inclusion("category"),
    "namespace": fl.inclusion("namespace"), "party": fl.inclusion("party"),
}
PAGE = ["transaction_id", "cycle", "amount", "contributor_name", "contributor_state"]


def _double(df):
    return df.withColumn("amount", F.col("amount").cast("double"))


@query("filter_compare_between", f"""WITH {CONTRIBUTIONS} SELECT transaction_id, cycle, amount::DOUBLE AS amount, contributor_name, contributor_state FROM contributions
WHERE amount >= 50000 AND amount <= 300000 AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""")
def filter_compare_between(spark, sf):
    where = fl.build(SCHEMA, {"date": "><|1996-01-01|1998-12-31", "amount": ">|50000"}) & fl.build(SCHEMA, {"amount": "<|300000"})
    return _double(contributions(spark, sf).filter(where).select(*PAGE))


@query("filter_equal", f"WITH {CONTRIBUTIONS} SELECT transaction_id, cycle FROM contributions WHERE date = DATE '1997-05-28'")
def filter_equal(spark, sf):
    return contributions(spark, sf).filter(fl.build(SCHEMA, {"date": "1997-05-28"})).select("transaction_id", "cycle")


@query("filter_inclusion_in", f"""WITH {CONTRIBUTIONS} SELECT transaction_id, contributor_state, category FROM contributions
WHERE category IN ('BUILDING', 'MACHINERY') AND contributor_state IN ('NATION_1', 'NATION_7')""")
def filter_inclusion_in(spark, sf):
    return contributions(spark, sf).filter(fl.build(SCHEMA, {"category": "BUILDING|MACHINERY", "contributor_state": "nation_1|nation_7"})).select("transaction_id", "contributor_state", "category")


@query("filter_cycle_dual", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y FROM orders WHERE year(o_orderdate) IN (1997, 1998)")
def filter_cycle_dual(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return rows.filter(fl.build({"cycle": fl.cycle_pair("y")}, {"cycle": "1998"}))


@query("filter_industry_mixed", """SELECT p_partkey, upper(left(p_type, 5)) AS code, upper(left(p_brand, 3)) AS sort FROM part
WHERE upper(left(p_type, 5)) IN ('PROMO', 'SMALL') OR upper(left(p_brand, 3)) IN ('XYZ')""")
def filter_industry_mixed(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.upper(F.left("p_type", F.lit(5))).alias("code"), F.upper(F.left("p_brand", F.lit(3))).alias("sort"))
    return rows.filter(fl.build({"industry": fl.industry("code", "sort")}, {"industry": "promo|xyz|abc,small"}))


KINDS = {"urgent": ("1-URGENT",), "middle": ("2-HIGH", "3-MEDIUM")}


@query("filter_or_groups", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND o_orderstatus NOT IN ('F')")
def filter_or_groups(spark, sf):
    rows = table(spark, sf, "orders").filter(fl.build({"kind": fl.groups("o_orderpriority", KINDS)}, {"kind": "urgent|middle"}) & ~F.col("o_orderstatus").isin("F"))
    return rows.select("o_orderkey", "o_orderpriority")


@query("filter_all_group", "SELECT count(*) AS count FROM orders")
def filter_all_group(spark, sf):
    return fl.totals(table(spark, sf, "orders"), {"kind": fl.groups("o_orderpriority", KINDS)}, {"kind": "all"})


@query("filter_year_overlap", """WITH s AS (SELECT l_orderkey, min(l_shipdate)::DATE AS start, max(l_shipdate)::DATE AS stop FROM lineitem GROUP BY 1)
SELECT * FROM s WHERE (start <= DATE '1997-12-31' AND stop >= DATE '1997-01-01') OR (start <= DATE '2000-12-31' AND stop >= DATE '2000-01-01')""")
def filter_year_overlap(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("start"), F.to_date(F.max("l_shipdate")).alias("stop"))
    return s.filter(fl.build({"year": fl.years_overlap("start", "stop")}, {"year": "1997|2000"}))


@query("filter_titled", "SELECT count(*) AS n FROM nation WHERE upper(left('terminated', 1)) || 'erminated' = 'Terminated' AND n_nationkey < 3")
def filter_titled(spark, sf):
    rows = table(spark, sf, "nation").withColumn("status", F.when(F.col("n_nationkey") < 3, "Terminated").otherwise("Active"))
    return rows.filter(fl.build({"status": fl.titled("status")}, {"status": "TERMINATED"})).agg(F.count("*").alias("n"))


@query("filter_has_child", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def filter_has_child(spark, sf):
    kids = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(kids, "o_orderkey", "left_semi").select("o_orderkey")


@query("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%' AND p_name NOT LIKE '%bolt' AND p_type ILIKE 'econ%'")
def filter_like(spark, sf):
    p = table(spark, sf, "part")
    return p.filter(F.col("p_name").like("small%") & ~F.col("p_name").like("%bolt") & F.col("p_type").ilike("econ%")).select("p_partkey", "p_name")


@query("filter_param_branch", f"WITH {CONTRIBUTIONS} SELECT party, count(*) AS n FROM contributions WHERE (-1 = -1 OR cycle = -1) GROUP BY party")
def filter_param_branch(spark, sf):
    cycle = -1  # all cycles: no filter at all
    rows = contributions(spark, sf)
    return (rows if cycle == -1 else rows.filter(F.col("cycle") == cycle)).groupBy("party").agg(F.count("*").alias("n"))


@query("fulltext_and_or_stopwords", """SELECT p_partkey, p_name FROM part
WHERE (list_contains(string_split(lower(p_name), ' '), 'red') AND list_contains(string_split(lower(p_name), ' '), 'widget'))
   OR list_contains(string_split(lower(p_name), ' '), 'anvil')""")
def fulltext_and_or_stopwords(spark, sf):
    p = table(spark, sf, "part")
    return p.filter(text.text_match([F.col("p_name")], ["Widget & red inc", "anvil company"])).select("p_partkey", "p_name")


@query("fulltext_documents", r"""SELECT doc_id FROM documents
WHERE list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 'worthless')""")
def fulltext_documents(spark, sf):
    return table(spark, sf, "documents").filter(text.text_match([F.col("text")], ["worthless co"])).select("doc_id")


@query("fulltext_quoted", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%red widget%'")
def fulltext_quoted(spark, sf):
    return table(spark, sf, "part").filter(text.text_match([F.col("p_name")], ['"red widget"'])).select("p_partkey")


@query("metro_or_text", """SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def metro_or_text(spark, sf):
    """Zip to metropolitan area by a lookup join, then text over the area's name."""
    metro = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).filter(text.text_match([F.col("r_name")], ["asia"]))
    return table(spark, sf, "customer").join(metro.select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi").select("c_custkey")


LABELS = {"F": "filed", "O": "open", "P": "pending"}


@query("label_code_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filed' WHEN 'O' THEN 'open' WHEN 'P' THEN 'pending' END AS label FROM orders")
def label_code_map(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", mapped(F.col("o_orderstatus"), LABELS).alias("label"))


@query("children_joined_string", "SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '; ' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey")
def children_joined_string(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "; ").alias("flags"))


@query("children_nested_struct")
def children_nested_struct(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query("flatten_parent", "SELECT n_nationkey, n_name, r_name AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def flatten_parent(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"], "left").select("n_nationkey", "n_name", F.col("r_name").alias("region"))


@query("display_slug", "SELECT p_partkey, replace(lower(p_name), ' ', '-') AS slug FROM part")
def display_slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("page_offset_limit", f"""WITH {CONTRIBUTIONS} SELECT transaction_id, cycle, amount::DOUBLE AS amount, contributor_name, contributor_state FROM contributions
WHERE amount >= 500 ORDER BY cycle DESC, amount DESC, transaction_id LIMIT 50 OFFSET 100""")
def page_offset_limit(spark, sf):
    order = [F.desc("cycle"), F.desc("amount"), F.asc("transaction_id")]
    return _double(fl.search(contributions(spark, sf), SCHEMA, {"amount": ">|500", "page": "3", "per_page": "50"}, order).select(*PAGE))


@query("search_trace", f"""WITH {CONTRIBUTIONS} SELECT transaction_id, cycle, amount::DOUBLE AS amount, contributor_name, contributor_state FROM contributions
WHERE amount >= 500 AND list_contains(regexp_extract_all(lower(contributor_name), '[\\p{{L}}\\p{{N}}]+'), 'customer') AND cycle IN (1997, 1998)
ORDER BY cycle DESC, amount DESC, transaction_id LIMIT 1000""")
def search_trace(spark, sf):
    order = [F.desc("cycle"), F.desc("amount"), F.asc("transaction_id")]
    return _double(fl.search(contributions(spark, sf), SCHEMA, {"amount": ">|500", "contributor_ft": "customer", "cycle": "1998", "format": "json"}, order).select(*PAGE))


@query("scored_search", """SELECT c_custkey AS id, (CASE WHEN c_name ILIKE '%0001%' THEN 10.0::DOUBLE ELSE 0::DOUBLE END - 1.0::DOUBLE / (c_custkey + 1)) AS score FROM customer
WHERE c_name ILIKE '%001%' ORDER BY score DESC, id LIMIT 20 OFFSET 10""")
def scored_search(spark, sf):
    score = F.when(F.col("c_name").ilike("%0001%"), 10.0).otherwise(0.0) - F.lit(1.0) / (F.col("c_custkey") + 1)
    return table(spark, sf, "customer").filter(F.col("c_name").ilike("%001%")).select(F.col("c_custkey").alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").offset(10).limit(20)


@query("preview_and_count", "SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 400000) AS total, count(*) AS shown FROM (SELECT 1 FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey LIMIT 30)")
def preview_and_count(spark, sf):
    rows = table(spark, sf, "orders").filter("o_totalprice > 400000")
    shown = rows.orderBy("o_orderkey").limit(30)
    return rows.agg(F.count("*").alias("total")).join(shown.agg(F.count("*").alias("shown")), F.lit(True))


@query("default_projection", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def default_projection(spark, sf):
    """All fields but the internal ones."""
    return table(spark, sf, "customer").drop("c_acctbal")


@query("json_emit", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS line FROM nation""")
def json_emit(spark, sf):
    return table(spark, sf, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("line"))


@query("namespace_emission_counts", f"WITH {CONTRIBUTIONS} SELECT namespace, count(*) AS n FROM contributions GROUP BY namespace")
def namespace_emission_counts(spark, sf):
    return contributions(spark, sf).groupBy("namespace").agg(F.count("*").alias("n"))


@query("date_open_ended", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '2001-01-01' AND o_orderdate::DATE <= coalesce(NULL, DATE '9999-12-31')")
def date_open_ended(spark, sf):
    return table(spark, sf, "orders").filter(F.to_date("o_orderdate").between(F.lit(date(2001, 1, 1)), F.lit(date(9999, 12, 31)))).select("o_orderkey")


@query("url_params_base64", "SELECT n_nationkey, base64(('id=' || n_nationkey || '&name=' || n_name)::BLOB) AS token FROM nation")
def url_params_base64(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", text.url_params({"id": F.col("n_nationkey"), "name": F.col("n_name")}).alias("token"))


@query("money_display", "SELECT o_orderkey, printf('%,.2f', o_totalprice::DECIMAL(15,2)::DOUBLE) AS shown FROM orders")
def money_display(spark, sf):
    """Every order."""
    return table(spark, sf, "orders").select("o_orderkey", F.format_number(money("o_totalprice"), 2).alias("shown"))
