"""Feed cleaning, splitting, rejects."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.functions import cleaning as cl
from meridian.functions import text
from meridian.operators.rollup import pivot_sum  # noqa: F401
from meridian.queries.base import query, table
from meridian.sources.rejects import split_valid
from meridian.sources.transforms import salt_rows, split_and_transpose


@query("etl_money", "SELECT o_orderkey, o_totalprice::DECIMAL(15,2)::DOUBLE AS amount FROM orders")
def etl_money(spark, sf):
    raw = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    return table(spark, sf, "orders").select("o_orderkey", cl.money(raw).cast("double").alias("amount"))


@query("etl_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate::DATE END AS mdy, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate::DATE END AS iso FROM orders")
def etl_dates(spark, sf):
    o = table(spark, sf, "orders")
    mdy = F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.date_format("o_orderdate", "MMddyyyy"))
    iso = F.when(F.col("o_orderkey") % 7 == 0, "0000-00-00").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", cl.date_mdy(mdy).alias("mdy"), cl.date_iso(iso).alias("iso"))


@query("etl_zip", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE lpad((c_custkey * 37 % 100000)::VARCHAR, 5, '0') END AS zip FROM customer")
def etl_zip(spark, sf):
    z = F.lpad((F.col("c_custkey") * 37 % 100000).cast("string"), 5, "0")
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, z).when(k == 1, F.concat(F.lit(" "), z, F.lit("-1234"))).when(k == 2, F.concat(z, F.lit(" x"))).otherwise(F.concat(z, F.lit("9")))
    return table(spark, sf, "customer").select("c_custkey", text.zip5(raw).alias("zip"))


@query("etl_best_available", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN c_name END AS name FROM customer")
def etl_best_available(spark, sf):
    k = F.col("c_custkey") % 3
    new, old = F.when(k == 0, F.col("c_mktsegment")).otherwise(""), F.when(k == 2, "").otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", text.best_of(new, old).alias("name"))


@query("etl_party", "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'R' WHEN 2 THEN NULL WHEN 3 THEN '3' ELSE 'Whig' END AS party FROM nation")
def etl_party(spark, sf):
    k = F.col("n_nationkey") % 5
    own = F.when(k == 0, "Democratic").when(k == 2, "P").when(k == 4, "Whig").otherwise("")
    committee = F.when(k == 1, "Republican").when(k == 3, "Third-Party").otherwise("Unknown")
    return table(spark, sf, "nation").select("n_nationkey", cl.party_of(own, committee).alias("party"))


@query("etl_seats", """SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'federal:president' WHEN 1 THEN 'federal:senate' ELSE 'federal:house' END AS seat,
CASE n_nationkey % 3 WHEN 0 THEN '' ELSE 'NY' END AS state, CASE n_nationkey % 3 WHEN 2 THEN 'NY-07' ELSE '' END AS district FROM nation""")
def etl_seats(spark, sf):
    k = F.col("n_nationkey") % 3
    fec = F.when(k == 0, "P00003392").when(k == 1, "S2NY00010").otherwise("H0NY07123")
    return table(spark, sf, "nation").select("n_nationkey", cl.fec_seat(fec).alias("s")).select("n_nationkey", "s.*")


@query("etl_race_seats", """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'federal:president' WHEN 1 THEN 'federal:senate' WHEN 2 THEN 'federal:house' END AS seat,
CASE n_nationkey % 4 WHEN 2 THEN 'MD-04' WHEN 3 THEN NULL ELSE '' END AS district FROM nation""")
def etl_race_seats(spark, sf):
    k = F.col("n_nationkey") % 4
    raw = F.when(k == 0, "PRES").when(k == 1, "NYS1").when(k == 2, "MD04").otherwise("x")
    return table(spark, sf, "nation").select("n_nationkey", cl.race_seat(raw).alias("s")).select("n_nationkey", "s.seat", "s.district")


@query("etl_state_district", "SELECT n_nationkey, CASE WHEN n_nationkey > 0 THEN 'CA-' || n_nationkey END AS district FROM nation")
def etl_state_district(spark, sf):
    """Every nation, those with an inner zero too."""
    return table(spark, sf, "nation").select("n_nationkey", cl.state_district(F.lit("CA"), F.concat(F.lit("00"), F.col("n_nationkey").cast("string"))).alias("district"))


@query("etl_refund_sign", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 2 THEN -o_totalprice ELSE o_totalprice END AS amount FROM orders")
def etl_refund_sign(spark, sf):
    kind = F.when(F.col("o_orderkey") % 6 == 0, "22Y").when(F.col("o_orderkey") % 6 == 1, "22z").otherwise("15")
    return table(spark, sf, "orders").select("o_orderkey", cl.refund(kind, F.col("o_totalprice")).alias("amount"))


@query("etl_salted_id", "SELECT c_custkey, md5(c_custkey || 'pepper') AS id FROM customer")
def etl_salted_id(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", cl.salted_id(F.col("c_custkey"), "pepper").alias("id"))


@query("etl_salt_rows")
def etl_salt_rows(spark, sf):
    """An amount split at a seeded random place into two rows that sum to it."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").alias("amount"))
    return salt_rows(o, "amount", 42)


@query("etl_split_transpose", """SELECT n_nationkey, name, state FROM (SELECT n_nationkey, unnest(['Bob', 'Jeff' || n_nationkey]) AS name,
unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['CA', 'VA'] ELSE ['', ''] END) AS state FROM nation)""")
def etl_split_transpose(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("Bob; Jeff"), F.col("n_nationkey").cast("string")).alias("names"), F.when(F.col("n_nationkey") % 2 == 0, "CA; VA;").otherwise("CA").alias("states"))
    return split_and_transpose(n, ";", {"names": "name", "states": "state"}).select("n_nationkey", "name", "state")


@query("etl_rejects", "SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM (SELECT CASE WHEN year(o_orderdate) < 1996 THEN 'year' WHEN o_totalprice > 450000 THEN 'amount' END AS reason FROM orders) GROUP BY 1")
def etl_rejects(spark, sf):
    o = table(spark, sf, "orders")
    good, bad = split_valid(o, {"year": F.year("o_orderdate") >= 1996, "amount": F.col("o_totalprice") <= 450000})
    return good.agg(F.lit("ok").alias("reason"), F.count("*").alias("n")).unionByName(bad.groupBy("reason").agg(F.count("*").alias("n")))


@query("etl_json_props", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def etl_json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("etl_orgname", r"SELECT DISTINCT p_name, regexp_replace(lower(p_name || ' Co.'), ' ?co\.?$', '') AS standard, replace(lower(p_name), ' ', '') AS normal FROM part")
def etl_orgname(spark, sf):
    p = table(spark, sf, "part").select("p_name").distinct()
    return p.select("p_name", text.standard_orgname(F.concat("p_name", F.lit(" Co."))).alias("standard"), text.basic_normal(F.concat("p_name", F.lit(", Inc."))).alias("normal"))


@query("etl_blank_and_length", "SELECT p_partkey, left(p_name, 5) AS short, CASE WHEN p_size > 25 THEN NULL ELSE p_type END AS kind FROM part")
def etl_blank_and_length(spark, sf):
    blank = F.when(F.col("p_size") > 25, "  ").otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", text.fit(F.concat(F.lit(" "), "p_name"), 5).alias("short"), text.blank_to_null(blank).alias("kind"))


@query("etl_line_breaks", "SELECT n_nationkey, n_name || ' b' || chr(10) || 'c' AS cleaned, n_name AS bare FROM nation")
def etl_line_breaks(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", text.first_break_to_space(F.concat("n_name", F.lit("\nb\nc"))).alias("cleaned"), text.trailing_comma(F.concat("n_name", F.lit(",  "))).alias("bare"))


@query("etl_ascii_fold", "SELECT DISTINCT source, strip_accents('Ünïcödé ') || source AS folded FROM documents WHERE source IS NOT NULL")
def etl_ascii_fold(spark, sf):
    return table(spark, sf, "documents").filter("source is not null").select("source", text.ascii_fold(F.concat(F.lit("Ünïcödé "), "source")).alias("folded")).distinct()


@query("etl_occupation_pair", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'LAWYER' ELSE 'RETIRED' END AS occupation, CASE WHEN n_nationkey % 2 = 0 THEN 'ACME' ELSE '' END AS employer FROM nation")
def etl_occupation_pair(spark, sf):
    both = F.when(F.col("n_nationkey") % 2 == 0, "ACME/LAWYER").otherwise("RETIRED")
    return table(spark, sf, "nation").select("n_nationkey", cl.occupation_pair(both, F.lit(None).cast("string"), F.lit("")).alias("p")).select("n_nationkey", "p.*")


@query("etl_flags_and_codes", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 't' WHEN 1 THEN 'f' END AS flag, 'A' || n_nationkey AS code FROM nation")
def etl_flags_and_codes(spark, sf):
    raw = F.when(F.col("n_nationkey") % 3 == 0, "Y").when(F.col("n_nationkey") % 3 == 1, "No").otherwise("?")
    return table(spark, sf, "nation").select("n_nationkey", cl.flag_tf(raw).alias("flag"), cl.split_code(F.concat(F.lit("A"), F.col("n_nationkey").cast("string"), F.lit(": meaning"))).alias("code"))


@query("lookup_first_wins", "SELECT p_name, min_by(p_partkey, {'c': CASE WHEN p_type = 'PROMO' THEN 0 ELSE 1 END, 'k': p_partkey}) AS p_partkey FROM part GROUP BY p_name")
def lookup_first_wins(spark, sf):
    """Of rows with one key the flagged one, else the first."""
    flagged = F.when(F.col("p_type") == "PROMO", 0).otherwise(1)
    return table(spark, sf, "part").groupBy("p_name").agg(F.min_by("p_partkey", F.struct(flagged.alias("c"), F.col("p_partkey").alias("k"))).alias("p_partkey"))


@query("recipient_fallback", """SELECT o_orderkey, coalesce(s_name, 'committee ' || o_custkey) AS recipient, CASE WHEN s_name IS NULL THEN 'C' ELSE 'P' END AS type FROM orders LEFT JOIN supplier ON o_custkey = s_suppkey""")
def recipient_fallback(spark, sf):
    """The committee's candidate, else the committee itself."""
    o, s = table(spark, sf, "orders"), table(spark, sf, "supplier")
    j = o.join(s, o["o_custkey"] == s["s_suppkey"], "left")
    return j.select("o_orderkey", F.coalesce("s_name", F.concat(F.lit("committee "), F.col("o_custkey").cast("string"))).alias("recipient"), F.when(F.col("s_name").isNull(), "C").otherwise("P").alias("type"))


@query("referential_filter", "SELECT event_id FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier)")
def referential_filter(spark, sf):
    return table(spark, sf, "events").join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id")), "user_id", "left_semi").select("event_id")


@query("etl_contributor_kind", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'C' WHEN 2 THEN 'C' ELSE 'I' END AS kind FROM nation")
def etl_contributor_kind(spark, sf):
    k = F.col("n_nationkey") % 4
    category = F.when(k == 0, "Z2100").when(k == 1, "J2200").otherwise("A1000")
    return table(spark, sf, "nation").select("n_nationkey", cl.contributor_kind(category, F.when(k == 2, "Acme Corp").otherwise("Smith, Ann")).alias("kind"))
