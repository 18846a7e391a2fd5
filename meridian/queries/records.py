"""The other record sets' plans over stand-ins: orders as reports and filings, lines as what belongs to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.functions.cycles import semi_annual
from meridian.plans import records as rc
from meridian.queries.base import money, query, table


def _plain(df):
    return df.select(*[F.col(f.name).cast("double" if f.dataType.simpleString().startswith("decimal") else "long" if "rank" in f.name else f.dataType.simpleString()).alias(f.name) for f in df.schema])


def _reports(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("transaction_id"), F.year("o_orderdate").alias("year"), money("o_totalprice").alias("amount"), F.concat(F.lit("Firm "), (F.col("o_orderkey") % 40).cast("string")).alias("registrant_name"), (F.col("o_orderstatus") != "P").alias("use"))


def _clients(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity_id"))
    return table(spark, sf, "orders").join(c, "o_custkey").select("entity_id", F.col("o_orderkey").alias("transaction_id"))


def _of_lines(spark, sf, expr, name):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("transaction_id"), F.expr(expr).alias(name)).distinct()


LOBBYING = """reports AS (SELECT o_orderkey AS transaction_id, year(o_orderdate)::INTEGER AS year, (year(o_orderdate) + year(o_orderdate) % 2)::INTEGER AS cycle, o_totalprice::DECIMAL(15,2) AS amount, 'Firm ' || (o_orderkey % 40) AS registrant_name FROM orders WHERE o_orderstatus <> 'P'),
clients AS (SELECT c_nationkey AS entity_id, o_orderkey AS transaction_id FROM orders JOIN customer ON o_custkey = c_custkey),
lobbyists AS (SELECT DISTINCT l_suppkey AS entity_id, l_orderkey AS transaction_id FROM lineitem), issues AS (SELECT DISTINCT l_orderkey AS transaction_id, l_partkey % 80 AS issue FROM lineitem)"""


def _all(body: str, keys: str, measures: str) -> str:
    return f"SELECT {keys}, cycle, {measures} FROM {body} GROUP BY {keys}, cycle UNION ALL SELECT {keys}, -1, {measures} FROM {body} GROUP BY {keys}"


@query("lobbying_issues_for_client", f"""WITH {LOBBYING}, g AS ({_all('(SELECT entity_id, issue, cycle FROM reports JOIN clients USING (transaction_id) JOIN issues USING (transaction_id))', 'entity_id, issue', 'count(*) AS count')})
SELECT * FROM (SELECT *, rank() OVER (PARTITION BY entity_id, cycle ORDER BY count DESC, issue) AS rank FROM g) WHERE rank <= 10""")
def lobbying_issues_for_client(spark, sf):
    return _plain(rc.lobbying_top(rc.lobbying_reports(_reports(spark, sf)), _clients(spark, sf), _of_lines(spark, sf, "l_partkey % 80", "issue"), ["issue"]))


@query("lobbying_issues_for_lobbyist", f"""WITH {LOBBYING}, g AS ({_all('(SELECT entity_id, issue, cycle FROM reports JOIN lobbyists USING (transaction_id) JOIN issues USING (transaction_id))', 'entity_id, issue', 'count(*) AS count')})
SELECT * FROM (SELECT *, rank() OVER (PARTITION BY entity_id, cycle ORDER BY count DESC, issue) AS rank FROM g) WHERE rank <= 10""")
def lobbying_issues_for_lobbyist(spark, sf):
    return _plain(rc.lobbying_top(rc.lobbying_reports(_reports(spark, sf)), _of_lines(spark, sf, "l_suppkey", "entity_id"), _of_lines(spark, sf, "l_partkey % 80", "issue"), ["issue"]))


@query("lobbying_registrants_for_client", f"""WITH {LOBBYING}, g AS ({_all('(SELECT entity_id, registrant_name, cycle, amount FROM reports JOIN clients USING (transaction_id))', 'entity_id, registrant_name', 'count(*) AS count, sum(amount) AS amount')})
SELECT * REPLACE (amount::DOUBLE AS amount) FROM (SELECT *, rank() OVER (PARTITION BY entity_id, cycle ORDER BY amount DESC, count DESC) AS rank FROM g) WHERE rank <= 10""")
def lobbying_registrants_for_client(spark, sf):
    return _plain(rc.lobbying_registrants(rc.lobbying_reports(_reports(spark, sf)), _clients(spark, sf)))


BY_YEAR = f"""{LOBBYING}, l AS (SELECT entity_id, year, count(DISTINCT transaction_id) AS lobbyist_count FROM lobbyists JOIN reports USING (transaction_id) GROUP BY ALL),
f AS (SELECT c_custkey % 100 AS entity_id, year, count(*) AS firm_count, sum(amount) AS firm_income FROM reports JOIN orders ON o_orderkey = transaction_id JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
c AS (SELECT entity_id, year, count(*) AS client_count, sum(amount) AS client_spending FROM clients JOIN reports USING (transaction_id) GROUP BY ALL),
y AS (SELECT entity_id, year, coalesce(lobbyist_count, 0) AS lobbyist_count, coalesce(firm_count, 0) AS firm_count, coalesce(firm_income, 0) AS firm_income, coalesce(client_count, 0) AS client_count, coalesce(client_spending, 0) AS client_spending
  FROM l FULL JOIN f USING (entity_id, year) FULL JOIN c USING (entity_id, year))"""
SUMS = ["lobbyist_count", "firm_count", "firm_income", "client_count", "client_spending"]


def _by_year(spark, sf):
    firms = table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("entity_id"), F.col("o_orderkey").alias("transaction_id"))
    clients = _clients(spark, sf).select(F.col("entity_id").cast("long").alias("entity_id"), "transaction_id")
    return rc.lobbying_by_year(rc.lobbying_reports(_reports(spark, sf)), _of_lines(spark, sf, "l_suppkey", "entity_id"), firms, clients)


@query("lobbying_by_entity_year", f"WITH {BY_YEAR} SELECT * REPLACE (firm_income::DOUBLE AS firm_income, client_spending::DOUBLE AS client_spending) FROM y")
def lobbying_by_entity_year(spark, sf):
    return _plain(_by_year(spark, sf))


@query("lobbying_rolled_up_cycles", f"""WITH {BY_YEAR}, u AS (SELECT * FROM y UNION ALL SELECT entity_id % 10 + 1000 AS entity_id, year, lobbyist_count, firm_count, firm_income, client_count, client_spending FROM y WHERE entity_id < 50),
z AS (SELECT *, (year + year % 2)::INTEGER AS cycle FROM u)
{_all('z', 'entity_id', ', '.join(f"sum({c})::{'DOUBLE' if c in ('firm_income', 'client_spending') else 'BIGINT'} AS {c}" for c in SUMS))}""")
def lobbying_rolled_up_cycles(spark, sf):
    y = _by_year(spark, sf)
    parents = y.filter("entity_id < 50").select("entity_id", (F.col("entity_id") % 10 + 1000).alias("parent_id")).distinct()
    return _plain(rc.by_cycle(rc.rolled_up(y, parents, SUMS), SUMS))


@query("lobbying_biggest_orgs_for_issues", f"""WITH {LOBBYING}, g AS (SELECT issue, entity_id, count(*) AS count FROM reports JOIN clients USING (transaction_id) JOIN issues USING (transaction_id) GROUP BY ALL),
a AS (SELECT issue, sum(count)::BIGINT AS total FROM g GROUP BY issue), r AS (SELECT *, rank() OVER (ORDER BY total DESC, issue) AS topic_rank FROM a)
SELECT issue, entity_id, count, rank() OVER (PARTITION BY issue ORDER BY count DESC, entity_id) AS rank, total, topic_rank FROM g JOIN r USING (issue)""")
def lobbying_biggest_orgs_for_issues(spark, sf):
    return _plain(rc.biggest_for_topics(rc.lobbying_reports(_reports(spark, sf)), _clients(spark, sf), _of_lines(spark, sf, "l_partkey % 80", "issue"), "issue"))


def _kind(spark, sf, flag):
    li = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag)
    return li.select(F.col("l_suppkey").alias("entity_id"), (F.year("l_shipdate") + F.year("l_shipdate") % 2).cast("int").alias("cycle"), money("l_extendedprice").alias("amount"), "l_orderkey", "l_partkey")


@query("spending_totals", f"""WITH r AS (SELECT l_suppkey AS entity_id, (year(l_shipdate) + year(l_shipdate) % 2)::INTEGER AS cycle, l_extendedprice::DECIMAL(15,2) AS amount, l_returnflag AS k FROM lineitem)
{_all('r', 'entity_id', ", ".join(f"count_if(k = '{f}')::BIGINT AS {n}_count, coalesce(sum(amount) FILTER (k = '{f}'), 0)::DOUBLE AS {n}_amount" for f, n in (('R', 'grants'), ('A', 'contracts'), ('N', 'loans'))))}""")
def spending_totals(spark, sf):
    return _plain(rc.spending_totals({n: (_kind(spark, sf, f), "amount") for f, n in (("R", "grants"), ("A", "contracts"), ("N", "loans"))}))


@query("spending_org_top_records", """WITH r AS (SELECT l_suppkey AS entity_id, (year(l_shipdate) + year(l_shipdate) % 2)::INTEGER AS cycle, l_extendedprice::DECIMAL(15,2) AS amount, l_orderkey FROM lineitem WHERE l_returnflag IN ('R', 'A')),
b AS (SELECT * FROM r UNION ALL SELECT * REPLACE (-1 AS cycle) FROM r)
SELECT entity_id, cycle, amount::DOUBLE AS amount, l_orderkey, rank FROM (SELECT *, rank() OVER (PARTITION BY entity_id, cycle ORDER BY amount DESC, l_orderkey) AS rank FROM b) WHERE rank <= 10""")
def spending_org_top_records(spark, sf):
    rows = _kind(spark, sf, "R").unionByName(_kind(spark, sf, "A")).drop("l_partkey")
    return _plain(rc.top_records(rows, [F.desc("amount"), F.asc("l_orderkey")])).select("entity_id", "cycle", "amount", "l_orderkey", "rank")


EARMARKS = """e AS (SELECT o_orderkey AS earmark_id, (year(o_orderdate) - year(o_orderdate) % 2)::INTEGER AS cycle, o_totalprice::DECIMAL(15,2) AS amount FROM orders WHERE o_orderstatus <> 'P'),
m AS (SELECT o_orderkey AS earmark_id, o_custkey AS entity_id, c_nationkey AS state FROM orders JOIN customer ON o_custkey = c_custkey), p AS (SELECT DISTINCT l_orderkey AS earmark_id, s_nationkey AS place FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


@query("earmarks_in_state", f"""WITH {EARMARKS}, x AS (SELECT entity_id, cycle, amount, EXISTS (SELECT 1 FROM p WHERE p.earmark_id = e.earmark_id AND p.place = m.state) AS in_state FROM e JOIN m USING (earmark_id))
{_all('x', 'entity_id, in_state', 'count(*) AS count, sum(amount)::DOUBLE AS amount')}""")
def earmarks_in_state(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    e = rc.earmarks_by_cycle(o.select(F.col("o_orderkey").alias("earmark_id"), F.year("o_orderdate").alias("fiscal_year"), money("o_totalprice").alias("amount"), (F.col("o_orderstatus") == "P").alias("presidential")))
    m = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("earmark_id"), F.col("o_custkey").alias("entity_id"), F.col("c_nationkey").alias("state"))
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    p = li.join(s, li["l_suppkey"] == s["s_suppkey"]).select(F.col("l_orderkey").alias("earmark_id"), F.col("s_nationkey").alias("state"))
    return _plain(rc.earmarks_in_state(e, m, p))


@query("enforcement_actions", """SELECT l_orderkey AS action_id, min(year(l_shipdate))::INTEGER AS first_year, max(year(l_shipdate))::INTEGER AS last_year, sum(l_extendedprice::DECIMAL(15,2))::DOUBLE AS penalty,
count(DISTINCT s_name) AS num_defendants, string_agg(DISTINCT s_name, '; ' ORDER BY s_name) AS defendants, (min(year(l_shipdate)) + min(year(l_shipdate)) % 2)::INTEGER AS cycle
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey HAVING min(year(l_shipdate)) > 1996 AND sum(l_extendedprice) > 200000""")
def enforcement_actions(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("action_id"), F.year("l_shipdate").alias("year"), money("l_extendedprice").alias("amount"), F.col("l_suppkey").alias("s_suppkey"))
    d = li.join(table(spark, sf, "supplier"), "s_suppkey").select("action_id", F.col("s_name").alias("name"))
    return _plain(rc.enforcement_relevant(rc.enforcement_actions(li, li, d), 1996, 200_000))


@query("advisory_records", """SELECT o_custkey AS org_id, o_orderkey % 7 AS committee, min(o_orderdate)::DATE AS start_date, max(o_orderdate + INTERVAL 30 DAY)::DATE AS end_date,
max_by(o_orderpriority, {'e': o_orderdate, 'p': o_orderpriority}) AS affiliation FROM orders GROUP BY ALL""")
def advisory_records(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("org_id"), (F.col("o_orderkey") % 7).alias("committee"), F.to_date("o_orderdate").alias("start_date"), F.date_add(F.to_date("o_orderdate"), 30).alias("end_date"), F.col("o_orderpriority").alias("affiliation"))
    return rc.advisory_records(o, ["org_id", "committee"])


@query("advisory_totals", """WITH r AS (SELECT o_custkey AS org_id, o_orderkey % 7 AS committee, o_orderkey % 13 AS member, year(o_orderdate) AS a, year(o_orderdate + INTERVAL 800 DAY) AS b FROM orders)
SELECT org_id, v.c::INTEGER AS cycle, count(DISTINCT member) AS member_count, count(DISTINCT committee) AS committee_count FROM r JOIN (VALUES (-1), (1996), (1998), (2000), (2002)) v(c) ON v.c = -1 OR v.c BETWEEN a AND b GROUP BY ALL""")
def advisory_totals(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("org_id"), (F.col("o_orderkey") % 7).alias("committee"), (F.col("o_orderkey") % 13).alias("member"), F.col("o_orderdate").alias("start_date"), F.date_add(F.to_date("o_orderdate"), 800).alias("end_date"))
    return rc.advisory_totals(o, [1996, 1998, 2000, 2002])


@query("misconduct_top", """WITH r AS (SELECT o_custkey AS entity_id, (year(o_orderdate) + year(o_orderdate) % 2)::INTEGER AS cycle, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate::DATE END AS date, o_totalprice AS penalty FROM orders),
b AS (SELECT * FROM r UNION ALL SELECT * REPLACE (-1 AS cycle) FROM r) SELECT * FROM (SELECT *, rank() OVER (PARTITION BY entity_id, cycle ORDER BY date DESC NULLS FIRST, penalty DESC) AS rank FROM b) WHERE rank <= 10""")
def misconduct_top(spark, sf):
    d = F.to_date("o_orderdate")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"), (F.year(d) + F.year(d) % 2).cast("int").alias("cycle"), F.when(F.col("o_orderkey") % 9 != 0, d).alias("date"), F.col("o_totalprice").alias("penalty"))
    return _plain(rc.misconduct_top(o)).select("entity_id", "cycle", "date", "penalty", "rank")


DOCKETS = """c AS (SELECT o_orderkey AS document_id, o_custkey AS docket_id FROM orders), mt AS (SELECT DISTINCT l_orderkey AS document_id, l_suppkey AS entity_id FROM lineitem),
dk AS (SELECT c_custkey AS docket_id, c_mktsegment AS agency, 1995 + c_nationkey % 8 AS year FROM customer), x AS (SELECT entity_id, docket_id, document_id, agency, (year + year % 2)::INTEGER AS cycle FROM mt JOIN c USING (document_id) JOIN dk USING (docket_id))"""


def _dockets(spark, sf):
    c = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("docket_id"))
    m = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("entity_id"))
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("docket_id"), F.col("c_mktsegment").alias("agency"), (1995 + F.col("c_nationkey") % 8).alias("year"))
    return c, m, d


@query("regulation_mentions", f"""WITH {DOCKETS}, g AS ({_all('x', 'entity_id, docket_id, agency', 'count(*) AS count')}) SELECT * FROM (SELECT *, rank() OVER (PARTITION BY entity_id, cycle ORDER BY count DESC, docket_id) AS rank FROM g) WHERE rank <= 10""")
def regulation_mentions(spark, sf):
    return _plain(rc.docket_mentions(*_dockets(spark, sf)))


@query("regulation_totals", f"WITH {DOCKETS} {_all('x', 'entity_id', 'count(DISTINCT docket_id) AS docket_count, count(DISTINCT document_id) AS document_count')}")
def regulation_totals(spark, sf):
    return rc.docket_totals(*_dockets(spark, sf))


@query("fec_race_status", "SELECT year(o_orderdate)::INTEGER AS election_year, o_custkey % 50 AS race, max(CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END)::INTEGER AS won, max(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END)::INTEGER AS ran FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL")
def fec_race_status(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("election_year"), (F.col("o_custkey") % 50).alias("race"), (F.col("o_totalprice") > 400000).alias("won"), (F.col("o_orderkey") % 2 == 0).alias("ran"), F.when(F.col("o_orderstatus") == "F", "C").otherwise("N").alias("status"))
    return rc.race_status(o)


@query("fec_candidate_rankings", """WITH s AS (SELECT o_custkey AS candidate_id, o_orderstatus AS office, (year(o_orderdate) + year(o_orderdate) % 2)::INTEGER AS cycle, sum(o_totalprice::DECIMAL(15,2)) AS receipts, max(o_totalprice::DECIMAL(15,2)) AS cash, min(o_totalprice::DECIMAL(15,2)) AS spending FROM orders GROUP BY ALL),
f AS (SELECT office, cycle, count(DISTINCT candidate_id) AS field_size FROM s GROUP BY ALL)
SELECT candidate_id, office, cycle, rank() OVER (PARTITION BY office, cycle ORDER BY receipts DESC) AS rank_receipts, rank() OVER (PARTITION BY office, cycle ORDER BY cash DESC) AS rank_cash, rank() OVER (PARTITION BY office, cycle ORDER BY spending DESC) AS rank_spending, field_size FROM s JOIN f USING (office, cycle)""")
def fec_candidate_rankings(spark, sf):
    p = money("o_totalprice")
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("candidate_id"), F.col("o_orderstatus").alias("office"), (F.year("o_orderdate") + F.year("o_orderdate") % 2).cast("int").alias("cycle")).agg(F.sum(p).alias("receipts"), F.max(p).alias("cash"), F.min(p).alias("spending"))
    return _plain(rc.candidate_rankings(s)).drop("receipts", "cash", "spending")


@query("fec_candidate_timeline", """WITH r AS (SELECT o_custkey AS candidate_id, o_orderdate::DATE AS date, o_totalprice::DECIMAL(15,2) AS amount FROM orders UNION ALL SELECT l_suppkey, l_shipdate::DATE, l_extendedprice::DECIMAL(15,2) FROM lineitem),
w AS (SELECT candidate_id, (year(date) + year(date) % 2)::INTEGER AS cycle, floor(date_diff('day', make_date((year(date) + year(date) % 2 - 1)::INTEGER, 1, 1), date) / 7)::INTEGER AS week, count(*) AS count, sum(amount) AS amount FROM r WHERE date IS NOT NULL GROUP BY ALL)
SELECT candidate_id, cycle, week, count, amount::DOUBLE AS amount, (sum(amount) OVER (PARTITION BY candidate_id, cycle ORDER BY week))::DOUBLE AS cumulative FROM w""")
def fec_candidate_timeline(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("candidate_id"), F.to_date("o_orderdate").alias("date"), money("o_totalprice").alias("amount"))
    b = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("candidate_id"), F.to_date("l_shipdate").alias("date"), money("l_extendedprice").alias("amount"))
    return _plain(rc.candidate_timeline([a, b]))


@query("fec_itemized", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '10' WHEN 1 THEN '15e' WHEN 2 THEN '24k' ELSE 'x1' END AS type FROM orders WHERE o_orderkey % 4 < 2 UNION ALL SELECT s_suppkey, '18k' FROM supplier")
def fec_itemized(spark, sf):
    k = F.col("o_orderkey") % 4
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(k == 0, "10").when(k == 1, "15e").when(k == 2, "24k").otherwise("x1").alias("type"))
    return rc.itemized(a, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("18k").alias("type")))


@query("fec_committee_summaries", "SELECT (year(l_shipdate) + year(l_shipdate) % 2)::INTEGER AS cycle, l_suppkey AS entity_id, count(*) AS count, min(l_shipdate)::DATE AS first, max(l_shipdate)::DATE AS last, sum(l_quantity::DECIMAL(15,2))::DOUBLE AS receipts, sum(l_extendedprice::DECIMAL(15,2))::DOUBLE AS spending FROM lineitem GROUP BY ALL")
def fec_committee_summaries(spark, sf):
    d = F.to_date("l_shipdate")
    rows = table(spark, sf, "lineitem").select((F.year(d) + F.year(d) % 2).cast("int").alias("cycle"), F.col("l_suppkey").alias("entity_id"), d.alias("date"), money("l_quantity").alias("receipts"), money("l_extendedprice").alias("spending"))
    return _plain(rc.committee_summaries(rows, ["receipts", "spending"]))


@query("independent_spending", """SELECT (year(o_orderdate) + year(o_orderdate) % 2)::INTEGER AS cycle, o_custkey AS committee_id, o_orderkey % 20 AS candidate_id, o_orderstatus AS support_oppose, count(*) AS count, sum(o_totalprice::DECIMAL(15,2))::DOUBLE AS amount
FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey - 1 FROM orders WHERE o_orderstatus = 'P') GROUP BY ALL""")
def independent_spending(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("filing_number"), (F.year("o_orderdate") + F.year("o_orderdate") % 2).cast("int").alias("cycle"), F.col("o_custkey").alias("committee_id"), (F.col("o_orderkey") % 20).alias("candidate_id"), F.col("o_orderstatus").alias("support_oppose"), money("o_totalprice").alias("amount"))
    return _plain(rc.independent_spending(rows, o.filter("o_orderstatus = 'P'").select((F.col("o_orderkey") - 1).alias("filing_number"))))


@query("bundles_latest", """SELECT committee_id, half, file_num FROM (SELECT o_custkey AS committee_id, year(o_orderdate) || '/' || CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END AS half, o_orderkey AS file_num,
row_number() OVER (PARTITION BY o_custkey, half ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def bundles_latest(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("committee_id"), semi_annual(F.col("o_orderdate")).alias("half"), F.col("o_orderdate").alias("end_date"), F.col("o_orderdate").alias("filing_date"), F.col("o_orderkey").alias("file_num"))
    return rc.bundles_latest(o).select("committee_id", "half", "file_num")


@query("metadata_latest_cycle", "SELECT o_custkey AS entity_id, max(year(o_orderdate) + year(o_orderdate) % 2)::INTEGER AS cycle FROM orders GROUP BY o_custkey")
def metadata_latest_cycle(spark, sf):
    m = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"), (F.year("o_orderdate") + F.year("o_orderdate") % 2).cast("int").alias("cycle")).distinct()
    return rc.metadata_latest(m.unionByName(m.withColumn("cycle", F.lit(-1))).withColumn("name", F.lit("x"))).select("entity_id", "cycle")


@query("politician_metadata", """SELECT entity_id, cycle, party, n FROM (SELECT o_custkey AS entity_id, (year(o_orderdate) + year(o_orderdate) % 2)::INTEGER AS cycle, left(o_orderpriority, 1) AS party, count(*) AS n,
row_number() OVER (PARTITION BY o_custkey, (year(o_orderdate) + year(o_orderdate) % 2) ORDER BY count(*) DESC, left(o_orderpriority, 1)) AS rn FROM orders GROUP BY 1, 2, 3, year(o_orderdate) + year(o_orderdate) % 2, o_custkey) WHERE rn = 1""")
def politician_metadata(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"), (F.year("o_orderdate") + F.year("o_orderdate") % 2).cast("int").alias("cycle"), F.left("o_orderpriority", F.lit(1)).alias("party"))
    return rc.politician_metadata(o, ["party"])
