"""Folding of letters, merges in chains, salted rows, and which contributions count."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from meridian.functions.text import ascii_fold
from meridian.operators.entities import merge
from meridian.plans import contributions as ct
from meridian.sources.transforms import salt_rows


def test_ascii_fold_is_the_decomposition(spark):
    texts = ["Nguyễn ﬁsh ＡＢ ĳ", "Ångström — ½ №", "漢字 plain", "", None, "ß Ø ł", "\U0001d400\U0001d401 \u3392", "한글 é"]
    texts += ["".join(chr(c) for c in range(a, a + 500) if not 0xD800 <= c < 0xE000) for a in range(0x80, 0x3000, 500)] + ["".join(chr(c) for c in range(a, a + 500)) for a in (0xF900, 0xFB00, 0xFE00, 0x1D400, 0x1F100)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", ascii_fold(F.col("t")).alias("f")).collect()
    for r in rows:
        assert r["f"] == (None if r["t"] is None else unicodedata.normalize("NFKD", r["t"]).encode("ascii", "ignore").decode())


def test_merges_go_to_the_end_of_a_chain(spark):
    e = spark.createDataFrame([(i, "organization" if i < 9 else "individual") for i in range(1, 10)], "id int, type string")
    a = spark.createDataFrame([(i, f"n{i}") for i in range(1, 10)], "entity_id int, alias string")
    t = spark.createDataFrame([(2, "ns", "v")], "entity_id int, namespace string, value string")
    m = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 4), (6, 9)], "old int, target int")
    entities, aliases, attributes = merge(e, a, t, m)
    assert sorted(r["id"] for r in entities.collect()) == [4, 6, 7, 8, 9]
    assert {(r["entity_id"], r["alias"]) for r in aliases.collect()} == {(4, "n1"), (4, "n2"), (4, "n3"), (4, "n4"), (4, "n5"), (6, "n6"), (7, "n7"), (8, "n8"), (9, "n9")}
    assert {(r["entity_id"], r["value"]) for r in attributes.collect()} == {(4, "v"), (4, "1"), (4, "2"), (4, "3"), (4, "5")}
    with pytest.raises(ValueError):
        merge(e, a, t, spark.createDataFrame([(1, 2), (2, 1)], "old int, target int"))


def test_salted_rows_do_not_depend_on_partitions(spark):
    rows = spark.range(200).selectExpr("id", "cast(id * 1.37 as decimal(15,2)) as amount")
    a, b = (sorted((r["id"], r["amount"]) for r in salt_rows(rows.repartition(n), "amount", 8).collect()) for n in (1, 7))
    assert a == b and len(a) == 400
    total = {}
    for i, x in a:
        total[i] = total.get(i, 0) + x
    assert total == {r["id"]: r["amount"] for r in rows.collect()}


COLUMNS = "transaction_id int, transaction_namespace string, transaction_type string, cycle int, contributor_type string, contributor_category string, recipient_type string, recipient_category string"
FEC = "urn:fec:transaction"


def test_which_contributions_count(spark):
    """By hand: each record that is kept, and one for each rule that drops one."""
    rows = [
        (1, FEC, "", 2008, None, "A1000", "P", "H1"), (2, FEC, "22y", 2007, "I", "A1000", "C", "H1"), (3, FEC, "24k", 2008, "C", "A1000", "P", "H1"), (4, "urn:nimsp:transaction", "24z", 2008, "C", "", "C", ""),
        (10, FEC, None, 2008, "I", "A1000", "P", "H1"), (11, FEC, "24k", 2008, "I", "A1000", "P", "H1"), (12, FEC, "15", 2008, "C", "A1000", "P", "H1"), (13, FEC, "15", 2008, "I", None, "P", "H1"),
        (14, FEC, "15", 2008, "I", "Z9999", "P", "H1"), (15, FEC, "24k", 2008, "C", "Z4100", "P", "H1"), (16, FEC, "15", 2008, "I", "A1000", "P", None), (17, FEC, "24k", 2008, "C", "A1000", "C", "Z4100"),
        (18, FEC, "15", 2008, "I", "A1000", None, "H1"), (19, "urn:other", "15", 2008, "I", "A1000", "P", "H1"), (20, FEC, "15", 2011, "I", "A1000", "P", "H1"), (21, FEC, "15", 2008, "X", "A1000", "P", "H1"), (22, FEC, "15", 2008, "I", "A1000", "P", "Z4"),
    ]
    got = {r["transaction_id"]: (r["subset"], r["cycle"]) for r in ct.relevant({"contribution": spark.createDataFrame(rows, COLUMNS)}).collect()}
    assert got == {1: ("individual", 2008), 2: ("individual_to_organization", 2008), 3: ("organization", 2008), 4: ("org_to_pac", 2008)}


def test_filers_with_many_entities(spark):
    """50,000 filings of a committee that 4,000 entities name: pairs of both would be 2e8 rows; figures are added up before entities are joined."""
    from meridian.plans import elections as el

    n = spark.range(50_000)
    entity = spark.range(4000).selectExpr("id", "concat('E', id) as name")
    figures = sorted({w for x in el.COMMITTEE_SUMS.values() for w in x.replace("(", " ").replace(")", " ").split() if w not in "+-"})
    t = {
        "entity": entity, "attribute": entity.selectExpr("id as entity_id", "'urn:fec:committee' as namespace", "'C1' as value").unionByName(spark.sql("select 7L as entity_id, 'urn:fec:candidate' as namespace, 'H1' as value")),
        "indexp": n.selectExpr("2010 as cycle", "if(id % 2 = 0, 'H1', 'H2') as candidate_id", "'Al' as candidate_name", "'C1' as spender_id", "'S' as spender_name", "'1' as candidate_district", "'House' as candidate_office", "'$1.50' as amount", "'$1' as aggregate_amount", "'support' as support_oppose", "cast(id as string) as filing_number", "if(id = 1, '0', null) as prev_file_num", "cast(id as string) as transaction_id"),
        "committee_summary": n.selectExpr("'C1' as committee_id", "2010 as cycle", "date'2010-01-01' + cast(id % 3 as int) as through_date", *[f"cast(1 as decimal(20,2)) as {c}" for c in figures]),
        "giver": n.selectExpr("'C1' as filer_id", "2010 as cycle", "'G' as contributor_name", "if(id % 5 = 0, 'none', '15') as transaction_type", "cast(2 as decimal(15,2)) as amount"),
        "committee": spark.sql("select 'C1' as committee_id, 2010 as cycle"),
    }
    assert el.committee_links(t).count() == 4000
    spent = el.independent_spending(t).groupBy("candidate_entity", "candidate_name").agg(F.count("*"), F.min("amount").cast("double"), F.max("amount").cast("double")).collect()
    assert {tuple(r) for r in spent} == {(7, "E7", 4000, 24_999 * 1.5, 24_999 * 1.5), (None, "Al", 4000, 25_000 * 1.5, 25_000 * 1.5)}  # filing 0 is amended
    assert [tuple(r) for r in el.independent_totals(t).groupBy(F.col("spending_amount").cast("double")).count().collect()] == [(49_999 * 1.5, 4000)]
    rows = el.committee_summaries(t).groupBy("num_committee_filings", "debts", F.col("first_filing_date").cast("string"), F.col("last_filing_date").cast("string")).count().collect()
    assert [(r[0], float(r[1]), *r[2:]) for r in rows] == [(50_000, 50_000.0, "2010-01-01", "2010-01-03", 4000)]
    assert [(r[0], r[1], float(r[2]), r[3]) for r in el.top_contributors(t).groupBy("transaction_type", "count", "amount").agg(F.count("*")).collect()] == [("15", 40_000, 80_000.0, 4000)]
