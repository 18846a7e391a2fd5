"""Record search and entity search over small tables by hand: what is found, how pages are cut, what is an error."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from meridian.plans import entity_search as es
from meridian.plans import search as rs
from meridian.sources.readers import candidates_first, committees_last, in_file_order, verified_csv
from meridian.sources.transforms import counted

COLUMNS = """transaction_id int, cycle int, date date, amount decimal(15,2), contributor_state string, contributor_name string, contributor_employer string, organization_name string,
parent_organization_name string, recipient_name string, committee_name string, transaction_type string, contributor_category string, contributor_zipcode string"""
NAMES = [c.split()[0] for c in COLUMNS.replace("(15,2)", "").split(",")]


def contributions(spark, *rows: dict) -> dict:
    data = [tuple({"transaction_id": i, **r}.get(n) for n in NAMES) for i, r in enumerate(rows)]
    return {
        "contribution": spark.createDataFrame(data, COLUMNS),
        "category": spark.createDataFrame([("A1000", "A01"), ("A1100", "A01"), ("B1000", "B01")], "catcode string, catorder string"),
        "metro": spark.createDataFrame([(1, "Greater Springfield area"), (2, "Shelbyville")], "id int, name string"),
        "zip": spark.createDataFrame([("10001", 1), ("10001", 2), ("10002", 2)], "zipcode string, msa_id int"),
    }


def found(t, **params) -> list[int]:
    return sorted(r["transaction_id"] for r in rs.search(t, "contributions", params).select("transaction_id").collect())


def test_dates_amounts_cycles_and_states(spark):
    t = contributions(
        spark, {"date": date(1999, 12, 25), "amount": Decimal(100), "cycle": 2002, "contributor_state": "CA"}, {"date": date(1999, 12, 31), "amount": Decimal(500), "cycle": 2004, "contributor_state": "OR"},
        {"date": date(2000, 1, 1), "amount": Decimal(800), "cycle": 2003, "contributor_state": "OR"}, {},
    )
    cases = [({"date": ">|2001-01-01"}, []), ({"date": "><|1999-12-24|1999-12-26"}, [0]), ({"date": "<|1999-12-31"}, [0, 1]), ({"date": ">|1980-01-01"}, [0, 1, 2]), ({"date": "1999-12-31"}, [1])]
    cases += [({"amount": ">|1000"}, []), ({"amount": "<|50"}, []), ({"amount": ">|600"}, [2]), ({"amount": "<|500"}, [0, 1]), ({"amount": "><|100|800"}, [0, 1, 2])]
    cases += [({"cycle": "2008"}, []), ({"cycle": "2002"}, [0]), ({"cycle": "2004"}, [1, 2]), ({"contributor_state": "wa"}, []), ({"contributor_state": "ca|OR"}, [0, 1, 2])]
    cases += [({"contributor_state": "CA", "amount": ">|500"}, []), ({"contributor_state": "OR", "amount": ">%7C600"}, [2]), ({}, [0, 1, 2, 3]), ({"amount": "", "_": "1", "apikey": "k"}, [0, 1, 2, 3])]
    for params, wanted in cases:
        assert found(t, **params) == wanted, params
    with pytest.raises(ValueError):
        found(t, colour="red")


def test_text(spark):
    t = contributions(
        spark, {"contributor_name": "Joe Smith"}, {"recipient_name": "John Adams"}, {"recipient_name": "Barry Adams"}, {"committee_name": "Committee to Commit"}, {"contributor_employer": "Meany & Sons"},
        {"organization_name": "Jason Q. Meany"}, {"parent_organization_name": "Jason Q. Meany Sr."}, {"contributor_name": "Apple Association Inc"}, {"recipient_name": "PG&E Corp"}, {"recipient_name": "PGE Corp"},
        {"contributor_name": "Billy Bob"}, {"contributor_name": "Marry Sue"}, {"recipient_name": "John Doe (R)"}, {"recipient_name": ""},
    )
    cases = [({"contributor_ft": "Bruce"}, []), ({"organization_ft": "Smith"}, []), ({"contributor_ft": "Bob Smith"}, []), ({"contributor_ft": "smith+Joe"}, [0]), ({"recipient_ft": "adams"}, [1, 2]), ({"committee_ft": "to"}, [3])]
    cases += [({"organization_ft": "Meany"}, [4, 5, 6]), ({"organization_ft": "Meany Sr."}, [6]), ({"organization_ft": "Sons"}, [4]), ({"contributor_ft": "meany|smith"}, [0, 4, 5, 6]), ({"contributor_ft": "inc"}, [])]
    cases += [({"contributor_ft": "apple corp"}, [7]), ({"recipient_ft": "pg&e"}, [8]), ({"recipient_ft": "pge"}, [9]), ({"recipient_ft": "John (R)"}, [12]), ({"contributor_ft": "billy lee|marry sue"}, [11]), ({"contributor_ft": "billy|marry"}, [10, 11])]
    for params, wanted in cases:
        assert found(t, **params) == wanted, params


def test_types_industries_and_areas(spark):
    t = contributions(
        spark, {"transaction_type": "24a", "contributor_category": "A1000", "contributor_zipcode": "10001"}, {"transaction_type": "29", "contributor_category": "A1100", "contributor_zipcode": "10002"},
        {"transaction_type": "", "contributor_category": "C9999", "contributor_zipcode": "99999"}, {"transaction_type": None, "contributor_category": None}, {"transaction_type": "24e", "contributor_category": "B1000"},
    )
    cases = [({"for_against": "for"}, [2, 4]), ({"for_against": "against"}, [0]), ({"for_against": "electioneering"}, [1]), ({"for_against": "neither"}, [0, 1, 2, 3, 4])]
    cases += [({"general_transaction_type": "standard"}, [2]), ({"general_transaction_type": "ie_supporting|ie_opposing"}, [0, 4]), ({"general_transaction_type": "standard|all"}, [0, 1, 2, 3, 4])]
    cases += [({"contributor_industry": "a01"}, [0, 1]), ({"contributor_industry": "c9999"}, [2]), ({"contributor_industry": "B01|C9999"}, [4]), ({"contributor_industry": "A01,|x,B1000"}, [0, 1, 4])]
    cases += [({"msa_ft": "springfield"}, [0]), ({"msa_ft": "shelbyville"}, [0, 1]), ({"msa_ft": "greater area"}, [0])]
    for params, wanted in cases:
        assert found(t, **params) == wanted, params
    with pytest.raises(ValueError):
        found(t, contributor_industry="abcd")
    row = rs.search(t, "contributions", {"for_against": "against"}).first()
    assert row["transaction_type_description"] == "Independent Expenditure Against" and "contributor_zipcode" in row.asDict()
    assert {r["transaction_type_description"] for r in rs.search(t, "contributions", {"general_transaction_type": "standard"}).collect()} == {""}


def test_pages_by_the_last_row_are_pages_by_number(spark):
    """Ties, nulls in both order columns, pages that end within either."""
    rows = [{"cycle": c, "amount": None if a is None else Decimal(a)} for c in (None, 2000, 2002) for a in (None, 5, 5, 7, None)]
    t = contributions(spark, *rows)
    by_number, last, walked = [], None, []
    for page in range(1, 7):
        by_number += [r["transaction_id"] for r in rs.search(t, "contributions", {"per_page": "3", "page": str(page)}).collect()]
        step = rs.search(t, "contributions", {"per_page": "3"}, after=last).collect()
        walked += [r["transaction_id"] for r in step]
        if step:
            last = {c: step[-1][c] for c in ("cycle", "amount", "transaction_id")}
        elif len(walked) == len(rows):
            break
    assert by_number == walked and sorted(walked) == list(range(15))
    assert walked[:2] == [0, 4]  # nulls first where the order falls


def test_children(spark):
    t = {
        "earmark": spark.createDataFrame([(1, 2008, Decimal(10), "a"), (2, 2008, Decimal(20), "b"), (3, 2009, None, None)], "id int, fiscal_year int, final_amount decimal(15,2), import_reference string"),
        "earmark_member": spark.createDataFrame([(1, "D", "OH", "Ann Smith"), (1, "R", "TX", "Bob Smith"), (2, "D", "OH", None), (9, "D", "TX", "Stray")], "earmark_id int, party string, state string, raw_name string").withColumn("standardized_name", F.lit("")),
        "earmark_recipient": spark.createDataFrame([], "earmark_id int, standardized_recipient string, raw_recipient string"),
    }
    ids = lambda **p: [r["id"] for r in rs.search(t, "earmarks", p).collect()]
    assert ids() == [3, 2, 1]
    assert ids(member="smith") == [1]
    assert ids(member_party="D") == [2, 1] and ids(member_party="D", member_state="TX") == [1]
    assert ids(recipient="anyone") == []
    assert rs.search(t, "earmarks", {}).columns == ["id", "fiscal_year", "final_amount"]
    shown = rs.with_children(t["earmark"], "id", {"members": (t["earmark_member"], "earmark_id", F.col("raw_name")), "recipients": (t["earmark_recipient"], "earmark_id", F.col("raw_recipient"))})
    assert {r["id"]: (r["members"], r["recipients"]) for r in shown.collect()} == {1: ("Ann Smith; Bob Smith", ""), 2: ("", ""), 3: ("", "")}
    lobby = {
        "lobbying": spark.createDataFrame([("a", 2008, Decimal(1)), ("b", 2009, Decimal(2)), ("c", 2009, Decimal(3))], "transaction_id string, year int, amount decimal(15,2)"),
        "lobbyist": spark.createDataFrame([("a", True, "L1"), ("a", True, "L2"), ("b", None, "L1")], "transaction_id string, member_of_congress boolean, lobbyist_ext_id string"),
    }
    ask = lambda **p: [r["transaction_id"] for r in rs.search(lobby, "lobbying", p).collect()]
    assert ask() == ["c", "b", "a"] and ask(lobbyist_is_rep="1") == ["a"] and ask(lobbyist_ext_id="L1|L2") == ["b", "a"] and ask(year="2009") == ["c", "b"]


def test_every_field_of_every_record_set_can_be_asked(spark):
    """Over empty tables that have the columns which fields name, so that a column that is named wrongly shows."""
    assert len(rs.RECORD_SETS) == 15
    strings = lambda *names: spark.createDataFrame([], ", ".join(f"{n} string" for n in names))
    shared = {
        "category": strings("catcode", "catorder"), "metro": strings("id", "name"), "zip": strings("zipcode", "msa_id"), "contractor": strings("id", "name"),
        "lobbyist": spark.createDataFrame([], "transaction_id string, member_of_congress boolean, lobbyist_ext_id string, candidate_ext_id string, lobbyist_name string"),
        "lobbying_issue": strings("transaction_id", "general_issue_code", "specific_issue"), "earmark_location": strings("earmark_id", "state", "city"),
        "earmark_member": strings("earmark_id", "party", "state", "standardized_name", "raw_name"), "earmark_recipient": strings("earmark_id", "standardized_recipient", "raw_recipient"),
    }
    values = {"date": "1999-01-01", "signed_date": "1999-01-01", "first_date": "1999-01-01", "last_date": "1999-01-01", "contributor_industry": "A01", "industry": "A1000", "general_transaction_type": "standard"}
    typed = {"cycle": "int", "amount": "decimal(15,2)", "date": "date", "year": "int", "fiscal_year": "int", "date_year": "int", "start_date": "date", "end_date": "date", "penalty": "decimal(15,2)"}
    typed |= {n: "decimal(15,2)" for n in ("penalty_amount", "total_funding_amount", "final_amount", "obligatedamount", "baseandexercisedoptionsvalue", "baseandalloptionsvalue")}
    typed |= {n: "date" for n in ("signeddate", "first_date", "last_date")}
    own = {
        "contributions": f"{' '.join(rs.CONTRIBUTION_OUTPUT)}".replace("transaction_type_description ", "").split(),
        "lobbyist_bundling": "id committee_name standardized_recipient_name standardized_lobbyist_name standardized_firm_name bundler_name bundler_employer report_year".split(),
        "faca": "id agency_abbr agency_name committee_name member_name affiliation start_date end_date".split(),
        "epa": "case_num case_name defendants location_addresses penalty first_date last_date".split(),
        "contributions/dc": "id contributor_state contributor_type contributor_zipcode amount date committee_name contributor_name recipient_name seat payment_type".split(),
        "lobbying": "transaction_id transaction_type filing_type year amount client_name client_parent_name client_category registrant_name".split(),
        "grants": "id assistance_type recipient_type recipient_state_code fiscal_year agency_name recipient_name total_funding_amount".split(),
        "contracts": """id agencyid contractingofficeagencyid congressionaldistrict statecode fundingrequestingagencyid state zipcode vendor_cd dunsnumber eeparentduns fiscal_year vendorname city
            obligatedamount baseandexercisedoptionsvalue baseandalloptionsvalue signeddate""".split(),
        "earmarks": "id fiscal_year bill bill_section bill_subsection description notes final_amount".split(),
        "contractor_misconduct": "id contractor_id date_year date penalty_amount enforcement_agency instance contracting_party".split(),
        "fara/client_registrant": "id terminated registrant_id client_id location_id client registrant_name location_of_client description_of_service".split(),
        "fara/contact": """id date contact_type affiliated_memember_bioguide_id document_id registrant_id client_id location_id recipient_id record_id contact_title contact_name contact_office
            contact_agency client client_location registrant description employees_mentioned""".split(),
        "fara/contribution": "id date amount contact_type document_id recipient_crp_id recipient_bioguide_id registrant_id recipient_id record_id recipient description contributing_individual_or_pac".split(),
        "fara/disbursement": "id date amount document_id registrant_id client_id location_id subcontractor_id record_id client registrant purpose to_subcontractor".split(),
        "fara/payment": "id date amount document_id registrant_id client_id location_id subcontractor_id record_id client registrant purpose from_contractor".split(),
    }
    assert set(own) == set(rs.RECORD_SETS)
    for name, columns in own.items():
        records = rs.RECORD_SETS[name]
        ddl = ", ".join(f"{c} {typed.get(c, 'string')}" for c in columns)
        t = {**shared, records.table: spark.createDataFrame([], ddl)}
        asked = {f: values.get(f, "1999") for f in records.fields}
        assert rs.search(t, name, asked).count() == 0


def entities(spark) -> dict:
    names = [(1, "Ann Apple", "individual"), (2, "Apple Inc", "organization"), (3, "Apple PAC", "organization"), (4, "Apple Growers", "industry"), (5, "Abe Apple", "politician"), (6, "Al Apple", "politician"), (7, "Pear", "organization")]
    return {
        "entity": spark.createDataFrame(names, "id int, name string, type string"),
        "alias": spark.createDataFrame([(i, n) for i, n, _ in names] + [(2, "Apple Computer"), (2, "Apple Computer"), (7, "Apple Pear"), (1, None)], "entity_id int, alias string"),
        "attribute": spark.createDataFrame([(3, "urn:fec:committee", "C1"), (2, "urn:fec:committee", ""), (5, "urn:crp:recipient", "N5")], "entity_id int, namespace string, value string"),
        "biography": spark.createDataFrame([(5, "B5")], "entity_id int, bioguide_id string"),
        "entity_totals": spark.createDataFrame([(1, -1, 2, 0, 100.0, 0.0), (2, -1, 5, 0, 900.0, 0.0), (5, -1, 0, 3, 0.0, 5000.0), (5, 2008, 0, 9, 0.0, 1.0), (6, -1, 4, 0, 7.0, 0.0)], "entity_id int, cycle int, contributor_count long, recipient_count long, contributor_amount double, recipient_amount double"),
        "lobbying_totals": spark.createDataFrame([(2, -1, 3, 0.0, 60.0)], "entity_id int, cycle int, count long, firm_income double, non_firm_spending double"),
        "politician_metadata": spark.createDataFrame([(5, 2006, "OH", "D", "federal:house"), (5, 2008, "OH", "I", "federal:senate"), (6, 2008, "TX", None, "state:upper")], "entity_id int, cycle int, state string, party string, seat string"),
        "org_metadata": spark.createDataFrame([(2, 2006, True, False, None), (2, 2008, False, False, None), (3, 2008, False, True, None), (7, 2008, False, False, True)], "entity_id int, cycle int, lobbying_firm boolean, is_superpac boolean, is_corporation boolean").withColumns({"is_cooperative": F.lit(None).cast("boolean"), "is_corp_w_o_capital_stock": F.lit(None).cast("boolean")}),
        "individual_metadata": spark.createDataFrame([(1, True, False)], "entity_id int, is_contributor boolean, is_lobbyist boolean"),
    }


def test_entities_by_words(spark):
    t = entities(spark)
    rows = {r["id"]: r for r in es.search(t, "apple & inc").collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 7]  # 6 received nothing; each once, whatever its aliases
    assert (rows[5]["seat"], rows[5]["party"], rows[5]["count_received"], rows[5]["total_received"]) == ("federal:senate", "I", 3, 5000.0)
    assert (rows[2]["lobbying_firm"], rows[2]["non_firm_spending"], rows[4]["count_given"], rows[4]["total_given"]) == (False, 60.0, 0, 0.0)
    assert [r["id"] for r in es.search(t, "computer", "organization").collect()] == [2] and es.search(t, "inc").count() == 0
    with pytest.raises(ValueError):
        es.search(t, "")


def test_entities_by_kind_and_page(spark):
    t = entities(spark)
    ids = lambda **p: sorted(r["id"] for r in es.scored(t, {"search": "apple", **p}).collect())
    assert ids() == [1, 2, 3, 4, 5, 6, 7] and ids(type="organization,individual,planet") == [1, 2, 3, 7] and ids(type="planet") == [1, 2, 3, 4, 5, 6, 7]
    assert ids(subtype="contributors") == [1] and ids(subtype="lobbyists") == [] and ids(subtype="industries") == [4] and ids(subtype="politicians") == [5, 6]
    assert ids(subtype="politicians", party="D") == [5] and ids(subtype="politicians", party="O") == [5] and ids(subtype="politicians", state="TX") == [6] and ids(subtype="politicians", seat="mayor") == [5, 6]
    assert ids(subtype="lobbying_firms") == [] and ids(subtype="political_groups") == [2, 3] and ids(subtype="other_orgs") == [2, 7]
    page = es.scored_page(t, {"search": "apple", "per_page": "3"}).collect()
    assert [r["id"] for r in page] == [5, 2, 1] and page[0]["score"] == pytest.approx(2 * 5000 / 715550915)
    assert [tuple(x) for x in page[0]["external_ids"]] == [("urn:crp:recipient", "N5")] and page[2]["external_ids"] is None
    assert page[0]["totals"]["recipient_amount"] == 5000.0 and page[1]["totals"]["lobbying_count"] == 3 and page[1]["totals"]["earmark_count"] == 0
    assert es.scored_page(t, {"search": "growers"}).first()["totals"] is None
    assert {(r["id"], r["cycle"]): r["recipient_count"] for r in es.totals(t).collect()} == {(1, -1): 0, (2, -1): 0, (5, -1): 3, (5, 2008): 9, (6, -1): 0}
    assert [r["id"] for r in es.scored_page(t, {"search": "apple", "per_page": "3", "page": "3"}).collect()] == [7]
    assert es.scored_total(t, {"search": "apple", "per_page": "3"}).collect() == [(7, 3)]


def test_entities_listed(spark, monkeypatch):
    t = entities(spark)
    wanted = [(2, "Apple Inc", "organization", ["Apple Computer", "Apple Computer"]), (3, "Apple PAC", "organization", [])]
    assert [tuple(r) for r in es.listed(t, 1, 2).collect()] == wanted
    monkeypatch.setattr("meridian.operators.ranking.NEAR", 0)
    assert [tuple(r) for r in es.listed(t, 1, 2).collect()] == wanted
    assert es.listed(t, 0, 10_000, "industry").count() == 1 and es.listed(t, 50, 60).count() == 0 and es.count(t, "politician").first()[0] == 2
    for start, end in ((5, 4), (0, 10_001)):
        with pytest.raises(ValueError):
            es.listed(t, start, end)
    assert es.by_external_id(t, "urn:crp:recipient", "N5").first()[0] == 5 and es.by_external_id(t, bioguide_id="B5").first()[0] == 5 and es.by_external_id(t, "urn:crp:recipient", "5").count() == 0
    with pytest.raises(ValueError):
        es.by_external_id(t, "urn:crp:recipient")


def test_records_are_counted_and_keep_the_order_of_their_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("".join(f"2008,C{i % 3},v{i}\n" for i in range(30)))
    rows = in_file_order(verified_csv(spark, str(tmp_path / "a.csv"), ["cycle", "cmte_id", "v"]).drop("_bad"))
    seen, passed = counted(rows.repartition(4), "feed", last=F.col("cmte_id") == "C2")
    assert {r["cmte_id"]: r["v"] for r in committees_last(seen).collect()} == {"C0": "v27", "C1": "v28", "C2": "v29"}
    assert passed.get == {"records": 30, "last": 10}
    (tmp_path / "b.csv").write_text("2008,H1,N,Y,first\n2008,H1,N,N,second\n2008,H2,N,N,first\n2008,H2,Y,Y,flagged\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20")
    try:
        rows = in_file_order(verified_csv(spark, str(tmp_path / "b.csv"), ["cycle", "fec_cand_id", "curr_cand", "cycle_cand", "v"]).drop("_bad"))
        assert {r["fec_cand_id"]: r["v"] for r in candidates_first(rows).collect()} == {"H1": "first", "H2": "flagged"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
