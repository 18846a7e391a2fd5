"""Entity links, discovery, merging and fuzzy matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridian.functions import names
from meridian.operators import entities as en
from meridian.operators import fuzzy, persons
from meridian.operators.close import close_matches
from meridian.queries.base import CONTRIBUTIONS, contributions, query, table


def _aliases(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.upper("c_name").alias("alias"))


@query("assoc_union_strategies", f"""WITH {CONTRIBUTIONS} SELECT DISTINCT entity_id, transaction_id FROM (
SELECT c_custkey AS entity_id, transaction_id FROM contributions JOIN customer ON lower(contributor_name) = lower(upper(c_name)) WHERE contributor_name <> ''
UNION SELECT contributor_id, transaction_id FROM contributions WHERE contributor_id IS NOT NULL
UNION SELECT -1 - organization_id, transaction_id FROM contributions)""")
def assoc_union_strategies(spark, sf):
    c = contributions(spark, sf)
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_custkey").cast("string").alias("ext_id"))
    orgs = table(spark, sf, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("entity_id"), F.col("n_nationkey").cast("string").alias("org_id"))
    return en.associate(c, "transaction_id", [
        (F.lower("contributor_name"), _aliases(spark, sf).withColumn("alias", F.lower("alias")), "alias"),
        (F.col("contributor_id").cast("string"), ids, "ext_id"), (F.col("organization_id").cast("string"), orgs, "org_id"),
    ])


@query("assoc_by_alias", f"WITH {CONTRIBUTIONS} SELECT DISTINCT c_custkey AS entity_id, transaction_id FROM contributions JOIN customer ON lower(contributor_name) = lower(c_name)")
def assoc_by_alias(spark, sf):
    return en.by_alias(contributions(spark, sf), "transaction_id", "contributor_name", _aliases(spark, sf))


@query("assoc_industry", f"""WITH {CONTRIBUTIONS}, cat(code, industry) AS (VALUES ('BUILDING', 1), ('MACHINERY', 1), ('HOUSEHOLD', 2))
SELECT DISTINCT industry AS entity_id, transaction_id FROM contributions JOIN cat ON category = code""")
def assoc_industry(spark, sf):
    cat = spark.createDataFrame([("BUILDING", 1), ("MACHINERY", 1), ("HOUSEHOLD", 2)], "code string, entity_id int")
    return en.associate(contributions(spark, sf), "transaction_id", [(F.col("category"), cat, "code")])


@query("entity_discovery", "SELECT p_name AS name, count(*) AS n FROM part WHERE p_name NOT LIKE 'red%' AND p_name <> 'blue bolt' GROUP BY p_name HAVING count(*) >= 5")
def entity_discovery(spark, sf):
    known = table(spark, sf, "part").filter("p_name like 'red%'").select(F.upper("p_name").alias("alias")).distinct()
    return en.discover(table(spark, sf, "part").withColumnRenamed("p_name", "raw"), "raw", known, ["blue bolt"], 5)


@query("entity_stale", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders UNION SELECT l_suppkey FROM lineitem)")
def entity_stale(spark, sf):
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return en.stale(e, table(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id")), table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity_id")))


@query("entity_build", """SELECT entity_id, namespace, value FROM (SELECT c_custkey AS entity_id, 'urn:segment' AS namespace, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'urn:nation', c_nationkey::VARCHAR FROM customer) WHERE value <> ''""")
def entity_build(spark, sf):
    return en.build_entities(table(spark, sf, "customer"), "c_custkey", "c_name", "organization", {"c_mktsegment": "urn:segment", "c_nationkey": "urn:nation"})[2]


@query("entity_merge", """WITH m AS (SELECT c_custkey AS old, c_custkey - 1 AS target FROM customer WHERE c_custkey % 10 = 1)
SELECT coalesce(target, c_custkey) AS entity_id, c_name AS alias FROM customer LEFT JOIN m ON old = c_custkey""")
def entity_merge(spark, sf):
    c = table(spark, sf, "customer")
    e, a, t = en.build_entities(c, "c_custkey", "c_name", "individual", {"c_mktsegment": "urn:segment"})
    merges = c.filter("c_custkey % 10 = 1").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") - 1).alias("target"))
    return en.merge(e, a, t, merges)[1]


@query("entity_merge_attributes", """WITH m AS (SELECT c_custkey AS old, c_custkey - 1 AS target FROM customer WHERE c_custkey % 10 = 1)
SELECT DISTINCT coalesce(target, c_custkey) AS entity_id, 'urn:segment' AS namespace, c_mktsegment AS value FROM customer LEFT JOIN m ON old = c_custkey
UNION SELECT target, 'urn:merged', old::VARCHAR FROM m""")
def entity_merge_attributes(spark, sf):
    c = table(spark, sf, "customer")
    e, a, t = en.build_entities(c, "c_custkey", "c_name", "individual", {"c_mktsegment": "urn:segment"})
    merges = c.filter("c_custkey % 10 = 1").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") - 1).alias("target"))
    return en.merge(e, a, t, merges)[2]


@query("update_from_coalesce", """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, n_name) AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def update_from_coalesce(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("label"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("label"))
    return en.fill_from(c, "c_nationkey", n, ["label"]).select("c_custkey", "label")


@query("update_from_values", "SELECT n_nationkey, CASE n_name WHEN 'NATION_3' THEN 'X3' WHEN 'NATION_9' THEN 'X9' END AS code FROM nation")
def update_from_values(spark, sf):
    manual = spark.createDataFrame([("NATION_3", "X3"), ("NATION_9", "X9")], "n_name string, code string")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("code"))
    return en.fill_from(n, "n_name", manual, ["code"], only_null=False).select("n_nationkey", "code")


def _people(spark, sf, source="customer", key="c_custkey", nation="c_nationkey"):
    """Every customer as a person: a last name for each 24 customers, so last names grow with the table; nations of even number are subjects, of odd number targets."""
    k = F.col(key)
    first = F.element_at(F.array(*[F.lit(x) for x in ("John", "Jon", "Mary", "Ann", "Peter")]), (k % 5 + 1).cast("int"))
    last = F.concat(F.lit("Smith"), F.floor(k / 24).cast("string"))
    middle = F.element_at(F.array(F.lit(" A"), F.lit(" Adam"), F.lit(""), F.lit(" B")), (k % 4 + 1).cast("int"))
    return table(spark, sf, source).select(k.alias("id"), first.alias("first"), middle.alias("middle"), last.alias("last"), (F.col(nation) % 2 == 0).alias("is_subject"))


#: The parts of _people's names in SQL.
_PART_OF_NAME = "['John', 'Jon', 'Mary', 'Ann', 'Peter'][s_suppkey % 5 + 1] AS first, ['A', 'Adam', NULL, 'B'][s_suppkey % 4 + 1] AS middle, s_suppkey // 24 AS last"


@query("fuzzy_match_top_score")
def fuzzy_match_top_score(spark, sf):
    """Names as `Last, First Middle` against `First Middle Last`; Python tests hold the scores."""
    p = _people(spark, sf)
    subjects = p.filter("is_subject").select("id", F.concat("last", F.lit(", "), "first", "middle").alias("name"))
    targets = p.filter("not is_subject").select("id", F.concat("first", "middle", F.lit(" "), "last").alias("name"))
    nick = spark.createDataFrame([("john", 1), ("jon", 1)], "name string, family int")
    return fuzzy.match_people(subjects, targets, nick, keep_unmatched=True)


@query("fuzzy_organizations", """WITH s AS (SELECT DISTINCT p_name FROM part), t AS (SELECT DISTINCT p_name FROM part)
SELECT s.p_name AS subject_id, t.p_name AS match_id, 'kernel' AS tier, 4.0::DOUBLE AS confidence FROM s JOIN t ON s.p_name = t.p_name""")
def fuzzy_organizations(spark, sf):
    p = table(spark, sf, "part").select("p_name").distinct()
    s = p.select(F.col("p_name").alias("id"), F.concat(F.initcap("p_name"), F.lit(", Inc.")).alias("name"))
    t = p.select(F.col("p_name").alias("id"), F.concat("p_name", F.lit(" Corp")).alias("name"))
    return fuzzy.match_organizations(s, t)


def _organizations(spark, sf):
    """Every part as an organisation; eight parts share a word (four targets, four subjects), so the words grow with the table."""
    k, word = F.col("p_partkey") % 8, F.concat(F.lit("Q"), F.floor(F.col("p_partkey") / 8).cast("string"), F.lit("x"))
    color = F.element_at(F.array(*[F.lit(x) for x in ("Red", "Blue", "Iron", "Stone", "Gold")]), (F.floor(F.col("p_partkey") / 8) % 5 + 1).cast("int"))
    forms = ("%s %s Corp", "Old %s %2$s Factory and Bank of %2$s Co.", "%s Bros %s Trust", "%s, %s, et al", "%s %s, Inc.", "%s %s Trust", "%s %s, Smith & Jones", "Bank of %2$s")
    name = F.format_string("", word)
    for i, f in enumerate(forms):
        name = F.when(k == i, F.format_string(f, color, word)).otherwise(name)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), (k >= 4).alias("is_subject"))


@query("fuzzy_organizations_cascade")
def fuzzy_organizations_cascade(spark, sf):
    """Names inside longer names, words with others between, firms by their first partners; Python tests hold the pairs."""
    o = _organizations(spark, sf)
    return fuzzy.cascade_organizations(o.filter("is_subject"), o.filter("not is_subject"))


@query("reconcile_names")
def reconcile_names(spark, sf):
    """All customers as individuals, all suppliers as politicians (ids -1, -3, ...), all parts as organisations (ids -2, -4, ...)."""
    people = _people(spark, sf).select("id", F.concat("first", "middle", F.lit(" "), "last").alias("name"), F.lit("individual").alias("kind"), "is_subject")
    p = _people(spark, sf, "supplier", "s_suppkey", "s_nationkey")
    title = F.when(F.col("is_subject"), F.concat(F.lit("Rep. "), "first", "middle", F.lit(" "), "last", F.lit(" (D)"))).otherwise(F.concat("last", F.lit(", "), "first", "middle"))
    politicians = p.select((-2 * F.col("id") - 1).alias("id"), title.alias("name"), F.lit("politician").alias("kind"), "is_subject")
    orgs = _organizations(spark, sf).select((-2 * F.col("id") - 2).alias("id"), "name", F.lit("organization").alias("kind"), "is_subject")
    named = people.unionByName(politicians).unionByName(orgs)
    return fuzzy.reconcile(named.filter("is_subject"), named.filter("not is_subject"))


@query("reconcile_requests", f"""WITH p AS (SELECT s_suppkey AS k, s_nationkey % 2 = 0 AS is_subject, {_PART_OF_NAME} FROM supplier),
q AS (SELECT c_custkey AS k, {_PART_OF_NAME.replace('s_suppkey', 'c_custkey')} FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey % 5 < 3),
hits AS (SELECT q.k AS request, p.k AS match_id, round(CASE WHEN q.first = p.first THEN 2 WHEN q.first = p.middle OR q.middle = p.first THEN 1.8 WHEN q.first[1] = p.first[1] THEN 1.1 ELSE 1 END
 + CASE WHEN q.middle IS NULL OR p.middle IS NULL THEN 0.2 WHEN q.middle = p.middle THEN 1 WHEN q.middle[1] = p.middle[1] AND 1 IN (length(q.middle), length(p.middle)) THEN 0.5
   WHEN q.first = p.first OR q.first = p.middle OR q.middle = p.first THEN -1.5 ELSE 0 END, 4)::DOUBLE AS confidence
 FROM q JOIN p ON q.last = p.last WHERE NOT p.is_subject AND (q.k % 5 = 0 OR (p.k % 3 > 0 AND (q.k % 4 > 1 OR p.k % 2 = q.k % 4))))
SELECT request, 'q' AS key, match_id, confidence, confidence >= 2 AS match FROM hits WHERE confidence >= 1 QUALIFY dense_rank() OVER (PARTITION BY request ORDER BY confidence DESC) <= 2""")
def reconcile_requests(spark, sf):
    """Customers ask for politicians (suppliers) by requests in JSON: without properties, with a hint, with an office; others ask for organizations and people that are not there."""
    c = _people(spark, sf).filter("is_subject")
    k, name = F.col("id"), F.concat("first", "middle", F.lit(" "), "last")
    prop = lambda pid, v: F.struct(F.lit(pid).alias("pid"), F.lit(v).alias("v"))
    hint, house, senate = prop("contributionType", "Politician recipients"), prop("office", "US House"), prop("office", "US Senate")
    asked = F.when(k % 5 == 0, F.lit(None)).when(k % 5 > 2, F.array(prop("contributionType", "Individual"))).otherwise(F.when(k % 4 == 0, F.array(hint, house)).when(k % 4 == 1, F.array(hint, senate)).otherwise(F.array(hint)))
    body = F.to_json(F.create_map(F.lit("q"), F.struct(name.alias("query"), F.when(k % 5 == 0, "politician").alias("type"), asked.alias("properties"))))
    bodies = c.select(k.alias("request"), F.lit(None).cast("string").alias("query"), body.alias("queries"))
    p = _people(spark, sf, "supplier", "s_suppkey", "s_nationkey").filter("not is_subject")
    targets = p.select("id", F.concat("last", F.lit(", "), "first", "middle").alias("name"), F.lit("politician").alias("kind"))
    held = p.select(F.col("id").alias("entity_id"), F.explode(F.expr("if(id % 3 = 0, array(2004, 2008), array(2006, 2012))")).alias("cycle"), F.expr("if(id % 2 = 0, 'federal:house', 'federal:senate')").alias("seat"))
    found = fuzzy.reconcile(fuzzy.requests(bodies), targets, held=held)
    return found.select("query_id.request", "query_id.key", "match_id", "confidence", "match")


@query("close_match_ratio", "SELECT p_partkey, 1.0::DOUBLE AS ratio FROM part WHERE p_name = 'red widget'")
def close_match_ratio(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name").distinct()
    return p.select("p_partkey", names.close_ratio(F.col("p_name"), F.lit("red widget")).alias("ratio")).filter("ratio >= 0.999")


@query("unique_name_match", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name HAVING count(*) = 1")
def unique_name_match(spark, sf):
    """A name that only one entity has."""
    return table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"), F.count("*").alias("n")).filter("n = 1").drop("n")


@query("close_recipient_names")
def close_recipient_names(spark, sf):
    """Every customer as a recipient whose name is written loosely, every part as an organisation; eight parts share a first word, so the words grow with the table. Python tests hold the matches."""
    o = _organizations(spark, sf).withColumn("name", F.concat(F.lit("Q"), F.floor(F.col("id") / 8).cast("string"), F.lit("x "), "name")).select("id", "name")
    k = F.col("c_custkey")
    color = F.element_at(F.array(*[F.lit(x) for x in ("Red", "Bleu", "iron", "Stone", "Gold")]), (k % 5 + 1).cast("int"))
    name = F.concat(F.when(k % 3 == 0, "The ").otherwise(""), F.lit("Q"), F.floor(k / 8).cast("string"), F.lit("x "), color, F.lit(" Q"), F.floor(k / 8).cast("string"), F.when(k % 2 == 0, "x Trust").otherwise("x corp."))
    return close_matches(table(spark, sf, "customer").select(k.alias("id"), name.alias("name")), o)


NICKNAMES = [("JOHN", "john"), ("JON", "john"), ("ANN", "ann"), ("ANNA", "ann")]


def _lettered(spark, sf, source="customer", key="c_custkey", nation="c_nationkey"):
    """_people with last names of letters alone."""
    return _people(spark, sf, source, key, nation).withColumn("last", F.translate("last", "0123456789", "abcdefghij"))


@query("people_of_equal_names")
def people_of_equal_names(spark, sf):
    """All pairs of customers, of even and of odd nations, whose names may be one person's; Python tests hold the pairs."""
    p = _lettered(spark, sf).withColumn("name", F.concat("first", "middle", F.lit(" "), "last"))
    nick = spark.createDataFrame(NICKNAMES, "name string, family string")
    side = lambda where: persons.parsed(p.filter(where).select("id", "name"), nick)
    return persons.equal_people(side("is_subject"), side("not is_subject"))


@query("only_politician_of_name")
def only_politician_of_name(spark, sf):
    """Every supplier as a politician with two aliases, every customer as one who names one; Python tests hold the choice."""
    p = _lettered(spark, sf, "supplier", "s_suppkey", "s_nationkey")
    both = F.explode(F.array(F.concat(F.upper("last"), F.lit(", "), F.upper("first"), F.upper("middle")), F.concat("first", F.lit(" "), "last", F.when(F.col("id") % 2 == 0, " (D)").otherwise(""))))
    aliases = p.select(F.col("id").alias("entity_id"), F.concat("last", F.lit(", "), "first").alias("entity_name"), both.alias("alias"))
    names_ = _lettered(spark, sf).select("id", F.concat(F.left("first", F.lit(1)), F.lit("."), "middle", F.lit(" "), "last").alias("name"))
    return persons.only_politician(names_, aliases, spark.createDataFrame(NICKNAMES, "name string, family string"))


def _state(nation):
    """Two letters for each nation."""
    return F.concat(F.char(F.floor(nation / 5) + 65), F.char(nation % 5 + 65))


@query("match_politicians_by_seat")
def match_politicians_by_seat(spark, sf):
    """All suppliers as politicians, all customers as those who name one; Python tests hold the pairs."""
    p = _people(spark, sf, "supplier", "s_suppkey", "s_nationkey").withColumn("state", _state(F.col("id") % 5))
    t = p.select("id", F.concat("first", "middle", F.lit(" "), "last").alias("name"), F.lit(2010).alias("cycle"), "state", F.when(F.col("id") % 2 == 0, F.concat("state", F.lit("-07"))).otherwise("_").alias("district"))
    k = F.col("c_custkey")
    c = _people(spark, sf).withColumnRenamed("id", "c_custkey").withColumn("last", F.concat(F.lit("Smith"), F.floor(k / 360).cast("string")))
    s = c.select(k.alias("id"), F.concat("last", F.lit(", "), "first", "middle").alias("name"), F.lit(2010).alias("cycle"), _state(k % 5).alias("state"), F.when(k % 2 == 0, "7").otherwise("").alias("district"))
    return fuzzy.match_politicians(s, t)


@query("match_members_unique")
def match_members_unique(spark, sf):
    """All customers as members of earmarks, all suppliers as politicians; every third member has no state."""
    p = _people(spark, sf, "supplier", "s_suppkey", "s_nationkey")
    politicians = p.select("id", F.lower("first").alias("first"), F.lower("last").alias("last"), F.lit("D").alias("party"), _state(F.col("id") % 25).alias("state"), F.lit("federal:house").alias("seat"))
    k = F.col("c_custkey")
    name = F.concat("first", F.lit(" Smith"), F.floor(k / 360).cast("string"))
    c = _people(spark, sf).withColumnRenamed("id", "c_custkey")
    members = c.select(k.alias("id"), name.alias("name"), F.lit("h").alias("chamber"), F.when(k % 2 == 0, "D").otherwise("").alias("party"), F.when(k % 3 > 0, _state(k % 25)).alias("state"))
    earmarks = c.select(name.alias("name"), F.lit("h").alias("chamber"), F.concat(_state(F.floor(k / 7) % 4), F.lit("; ")).alias("states")).distinct()
    return fuzzy.match_members(members, earmarks, politicians)
