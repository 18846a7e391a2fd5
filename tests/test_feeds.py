"""Feeds to canonical records on small made-up files."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from meridian.plans import feeds

CAND = "cycle string, fec_cand_id string, cid string, first_last_p string, party string, dist_id_run_for string, dist_id_curr string, curr_cand string, cycle_cand string, crp_ico string, recip_code string"
CMTE = "cycle string, cmte_id string, pac_short string, recip_id string, fec_cand_id string, party string, prim_code string"


def lookups(spark):
    candidates = spark.createDataFrame([("08", "H8NY07046", "N1", "Ann Lee (D)", "D", "NY05", "NY05", "Y", "Y", "I", "DW"), ("08", "P1", "N2", "Bo (R)", "R", "PRES", "", "", "", "C", "RL")], CAND)
    committees = spark.createDataFrame([("08", "C1", "Lee for House", "N1", "H8NY07046", "D", "Z1200"), ("08", "C2", "Big PAC", "C2", "", "", "F1100"), ("08", "C3", "Lost", "N9", "H0XX01", "R", "Z1100")], CMTE)
    return candidates, committees


def test_individuals(spark):
    candidates, committees = lookups(spark)
    codes = spark.createDataFrame([("f1100", "f07")], "catcode string, catorder string")
    rows = spark.createDataFrame([("08", "1", "c1", "C1", " Retired ", "01/31/2008", "123.45", "LAWYER", "ACME", "f1100"), ("08", "2", "C2", "c2", "Acme", "bad", "$5", "", "", "F1"), ("08", "3", "C3", "C9", "", None, "1", "", "", ""), ("08", "4", "C9", "C9", None, None, "x", "", "", None)], "cycle string, id string, recip_id string, cmte_id string, org_name string, date string, amount string, occ_ef string, emp_ef string, real_code string")
    got = {r["id"]: r for r in feeds.campaign_individuals(rows, candidates, committees, codes).collect()}
    a = got["1"]
    assert (a["recipient_name"], a["recipient_type"], a["recipient_ext_id"], a["seat"], a["recipient_state"], a["district"], a["district_held"]) == ("Ann Lee (D)", "P", "N1", "federal:house", "NY", "NY-05", "NY-05")
    assert (a["seat_result"], a["organization_name"], a["amount"], a["date"], a["contributor_category_order"], a["committee_name"]) == ("W", "", Decimal("123.45"), date(2008, 1, 31), "F07", "Lee for House")
    assert (got["2"]["recipient_type"], got["2"]["recipient_ext_id"], got["2"]["date"], got["2"]["organization_name"], got["2"]["contributor_category"]) == ("C", "C2", None, "Acme", None)
    assert (got["3"]["recipient_name"], got["3"]["committee_name"]) == ("Lost", "") and got["4"]["recipient_name"] is None and got["4"]["amount"] is None


def test_groups(spark):
    candidates, committees = lookups(spark)
    rows = spark.createDataFrame([("08", "1", "C2", "", "Filer", "C7", "15", "10"), ("08", "2", "C2", "Donor", "Filer", "C1", "24K", "20"), ("08", "3", "C2", "", "Filer", "P1", "24e", "30")], "cycle string, id string, filer_id string, donor_cmte string, contrib_lend_trans string, other_id string, type string, amount string")
    got = {r["id"]: r for r in feeds.campaign_groups(rows, candidates, committees).collect()}
    assert (got["1"]["contributor_name"], got["1"]["contributor_ext_id"], got["1"]["recipient_name"]) == ("Filer", "C7", "Big PAC")
    assert (got["2"]["contributor_name"], got["2"]["contributor_ext_id"], got["2"]["recipient_name"], got["2"]["committee_ext_id"]) == ("Donor", "C2", "Ann Lee (D)", "C1")
    assert (got["3"]["recipient_name"], got["3"]["seat"], got["3"]["recipient_category"]) == ("Bo (R)", "federal:president", "")


def test_state_feed(spark):
    columns = "id newcontributor contributor newaddress address employer newemployer recipient_party committee_party seat_state district seat status candidate_id committee_id unique_candidate_id contributor_id amount date cycle zipcode contributor_category".split()
    base = dict.fromkeys(columns, "") | {"amount": "10", "date": "2008-01-02", "cycle": "2008"}
    rows = [base | {"id": "1", "contributor": "Smith, Ann", "candidate_id": "5", "unique_candidate_id": "77", "seat_state": "CA", "district": "012", "seat": "H", "status": "Won-General", "committee_party": "Democratic", "zipcode": "90210-1234"},
            base | {"id": "2", "newcontributor": "Acme Corp", "committee_id": "9", "date": "0000-00-00"}, base | {"id": "3", "contributor": "X", "contributor_category": "Z2400", "candidate_id": "1", "committee_id": "2"}]
    good, waits = feeds.state_records(spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns)))
    got = {r["id"]: r for r in good.collect()}
    a, b = got["1"], got["2"]
    assert (a["contributor_type"], a["district"], a["seat"], a["seat_result"], a["candidacy_status"], a["recipient_party"], a["recipient_ext_id"], a["contributor_zipcode"]) == ("I", "CA-12", "state:lower", "W", True, "D", "77", "90210")
    assert (b["contributor_type"], b["organization_name"], b["recipient_type"], b["recipient_ext_id"], b["date"]) == ("C", "Acme Corp", "C", "9", None)
    w = waits.first()
    assert (w["id"], w["recipient_type"], w["contributor_type"]) == ("3", None, None)


def test_earmarks(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(feeds.earmark_recipients(F.lit("A; B;"))) == ["A", "B"]
    assert one(feeds.earmark_recipients(F.lit("Ohio University, Yale University and City"))) == ["Ohio University", "Yale University"]
    assert one(feeds.earmark_recipients(F.lit(""))) == []
    places = lambda c, s: [tuple(x) for x in one(feeds.earmark_places(F.lit(c), F.lit(s)))]
    assert places("A;B", "NY;CA") == [("A", "NY"), ("B", "CA")] and places("A;B", "NY") == [("A", "NY"), ("B", "NY")] and places("", "NY;UNK") == [("", "NY"), ("", "")]
    assert places("A", "") == [("A", "")] and places("", "") == [] and places("A;B;C", "NY;CA") == [("A", ""), ("B", ""), ("C", ""), ("", "NY"), ("", "CA")]


def test_spending_filings_and_enrichment(spark):
    rows = spark.createDataFrame([("012", "(none)", "current entry"), ("x", "NULL", "Correction")], "n string, t string, c string")
    got = feeds.converted(rows, {"n": F.col("n").try_cast("int"), "t": feeds.cl.nullable(F.col("t")), "c": feeds.correction_indicator(F.col("c"))}, {"t": 2}).collect()
    assert [tuple(r) for r in got] == [(12, "", ""), (None, None, "C")]
    f = spark.createDataFrame([("01312007", "22Y", "5", 2010), ("", "15", "7", 2010), ("01311999", "15", "9", 2010)], "date string, type string, amount string, cycle int")
    assert {(r["cycle"], r["type"], float(r["amount"])) for r in feeds.fec_filings(f, spark.createDataFrame([(2008,), (2010,)], "cycle int")).collect()} == {(2008, "22y", -5.0), (2010, "15", 7.0)}
    assert spark.range(1).select(feeds.race(F.lit("H"), F.lit("NY"), F.lit("07")), feeds.race(F.lit("P"), F.lit("US"), F.lit(""))).first() == ("H-NY-07", "P")
    m = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "id int, parent string, bin string")
    e = feeds.enriched(m, [(spark.createDataFrame([(1, "p"), (2, "q")], "id int, parent string"), ["parent"], True), (spark.createDataFrame([(2, "z")], "id int, bin string"), ["bin"], False)], ["id"])
    assert {tuple(r) for r in e.select("id", "parent", "bin").collect()} == {(1, "p", "a"), (2, "x", "z")}
    lob = feeds.lobbying(spark.createDataFrame([("", " Raw ", "Y"), ("Std", "Raw", None)], "std string, raw string, use string"), {"client": ("std", "raw")}, ["use"])
    assert [tuple(r) for r in lob.select("client", "use").collect()] == [("Raw", True), ("Std", False)]
