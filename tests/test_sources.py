"""Readers, writers, rejects, streams and look-ups on small files."""

import io
import zipfile
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meridian.functions import cleaning, names, text
from meridian.operators import filters, setops
from meridian.plans import api
from meridian.sources import readers, rejects, transforms, writers
from meridian.streaming import intake


def put(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_pipe_quoted_and_bad_lines(spark, tmp_path):
    p = put(tmp_path / "a.csv", "|1|,|a, b|,|x|\n|2|,|c|\n|3|,|d|,|y|,|z|\n")
    rows = readers.pipe_quoted(spark, p, ["id", "name", "code"]).collect()
    assert rows[0][:3] == ("1", "a, b", "x") and rows[0]["_bad"] is None
    assert [r["_bad"] is not None for r in rows] == [False, True, True]


def test_other_feeds(spark, tmp_path):
    fec = readers.fec_export(spark, put(tmp_path / "f.txt", 'id|name\n1|A "B" C\n'), ["id", "name"]).first()
    assert fec["name"] == 'A "B" C'
    assert readers.space_null_csv(spark, put(tmp_path / "s.csv", "a,b\n1, \n"), ["a", "b"]).first()["b"] is None
    copy = readers.copy_export(spark, put(tmp_path / "c.csv", '1|"x|y"|NULL\n'), ["a", "b", "c"]).first()
    assert (copy["b"], copy["c"]) == ("x|y", None)
    assert readers.backslash_null_csv(spark, put(tmp_path / "n.csv", "1,\\N\n"), ["a", "b"]).first()["b"] is None
    cat = readers.category_table(spark, put(tmp_path / "cat.txt", "header\n" * 8 + "a1000\tCrops\tA01\n\n"), ["catcode", "catname", "catorder"]).collect()
    assert [tuple(r) for r in cat] == [("A1000", "Crops", "A01")]


def test_lookups(spark):
    c = spark.createDataFrame([("08", "H1", "N", "N", 1), ("08", "H1", "Y", "Y", 2), ("08", "H2", "N", "N", 3), ("08", "H2", "N", "Y", 4)], "cycle string, fec_cand_id string, curr_cand string, cycle_cand string, line int")
    assert {(r["fec_cand_id"], r["line"]) for r in readers.candidates_first(c).collect()} == {("H1", 2), ("H2", 3)}
    m = spark.createDataFrame([("08", "C1", "a", 1), ("08", "C1", "b", 2)], "cycle string, cmte_id string, name string, line int")
    assert readers.committees_last(m).first()["name"] == "b"


def test_rejects(spark):
    df = spark.createDataFrame([(1, "M", "NY", date(2008, 1, 1), "15"), (2, "Male", "NY", None, "15"), (3, None, "N.Y.", None, None), (4, "F", "CA", date(922, 1, 1), "15"), (5, "F", "CA", date(1999, 1, 1), "10soft"), (6, "F", "CA", None, "10soft")], "id int, contributor_gender string, contributor_state string, date date, transaction_type string")
    good, bad = rejects.split_valid(df, rejects.contribution_rules())
    assert sorted(r["id"] for r in good.collect()) == [1, 6]
    assert {(r["id"], r["reason"]) for r in bad.collect()} == {(2, "gender"), (3, "state"), (4, "date"), (5, "soft money")}
    assert {tuple(r) for r in rejects.load_report(good, bad).collect()} >= {("loaded", 2), ("gender", 1)}
    with pytest.raises(rejects.LoadError):
        rejects.split_valid(df, rejects.contribution_rules(), fail_fast=True)


def test_transforms(spark):
    df = spark.createDataFrame([(1, "Bob; Jeff", "D; R", "CA"), (2, "", "", ""), (3, "Ann;", "", "NY")], "id int, names string, parties string, states string")
    got = transforms.split_and_transpose(df, ";", {"names": "name", "parties": "party", "states": "state"}).select("id", "name", "party", "state").collect()
    assert [tuple(r) for r in got] == [(1, "Bob", "D", ""), (1, "Jeff", "R", ""), (3, "Ann", "", "NY")]
    s = transforms.to_schema(df, {"id": "long", "extra": "string", "names": "int"}, "")
    assert s.first() == (1, "", None)
    assert transforms.merge_fields(spark.createDataFrame([("a", " ", "c")], "x string, y string, z string"), "x", ["x", "y", "z"]).first() == ("a c",)
    salted = transforms.salt_rows(spark.createDataFrame([(1, Decimal("341.66"))], "id int, amount decimal(15,2)"), "amount", 3)
    assert salted.count() == 2 and salted.agg(F.sum("amount")).first()[0] == Decimal("341.66")
    a, b = transforms.allocated(spark.createDataFrame([("Z2100",), ("A1000",), (None,)], "c string"), "c")
    assert (a.count(), b.count()) == (2, 1)


def test_cleaners(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    lit = F.lit
    assert one(cleaning.money(lit("$1,234.50")), cleaning.earmark_amount(lit("(see note)")), cleaning.money(lit("x"))) == (Decimal("1234.50"), Decimal("0.00"), None)
    assert one(cleaning.date_mdy(lit("01312008")), cleaning.date_mdy(lit("")), cleaning.date_iso(lit("\\N"))) == (date(2008, 1, 31), None, None)
    assert one(cleaning.district(lit("3rd")), cleaning.district(lit("")), cleaning.code(lit("XXX")), cleaning.id_number(lit("0"))) == (3, 0, None, None)
    assert one(cleaning.candidacy(lit("Won-General")), cleaning.candidacy(lit("Lost-Primary")), cleaning.candidacy(lit("?"))) == (True, False, None)
    assert one(cleaning.starred_date(lit("01/02/2010*")))[0] == (date(2010, 1, 2), True)
    assert one(text.zip5(lit(" 12345-6789")), text.zip5(lit("123456"))) == ("12345", None)
    assert one(text.standard_orgname(lit("Acme Co. Inc.")), text.basic_normal(lit("Smith and Sons, Inc."))) == ("acme co.", "smith&sons".replace("&", ""))
    assert one(text.text_match([lit("The Apple Company, Inc.")], ["apple inc"]), text.text_match([lit("Pear")], ["inc"]), text.text_match([lit("Big Apple Pie")], ['"apple pie"'])) == (True, False, True)


def test_names(spark):
    assert names.parse_person("Smith, John Q., Jr.") == ("john", "q", "smith", "jr")
    assert names.parse_person("Rep. John Quincy Smith") == ("john", "quincy", "smith", None)
    assert names.parse_person(" ") == (None, None, None, None)
    pairs = [("john|a|smith", "john|a|smith", 3.0), ("john||smith", "john||smith", 2.2), ("john|adam|smith", "john|a|smith", 2.5), ("john|a|smith", "jane|b|smith", 1.1), ("john|a|smith", "john|b|smith", 0.5), ("john||smith", "john||smyth", 0.0)]
    df = spark.createDataFrame([(*a.split("|"), *b.split("|"), s) for a, b, s in pairs], "f1 string, m1 string, l1 string, f2 string, m2 string, l2 string, s double")
    part = lambda i: F.struct(F.col(f"f{i}").alias("first"), F.nullif(F.col(f"m{i}"), F.lit("")).alias("middle"), F.col(f"l{i}").alias("last"))
    assert [r[0] for r in df.select(names.person_score(part(1), part(2), F.lit(False))).collect()] == [s for *_, s in pairs]


def test_filter_language(spark):
    with pytest.raises(ValueError):
        filters.industry("c", "o").make("ab")
    with pytest.raises(ValueError):
        filters.build({}, {"nope": "1"})
    df = spark.createDataFrame([(1, 2007), (2, 2008), (3, 2009)], "id int, cycle int")
    schema = {"id": filters.comparison("id", int), "cycle": filters.cycle_pair("cycle")}
    ids = lambda p: sorted(r["id"] for r in df.filter(filters.build(schema, p)).collect())
    assert ids({"cycle": "2008", "format": "json"}) == [1, 2] and ids({"id": ">|2"}) == [2, 3] and ids({"id": "><|1|2"}) == [1, 2] and ids({"id": "3"}) == [3] and ids({}) == [1, 2, 3]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2008, "Ünï", 1.5), (2010, None, 2.0)], "cycle int, name string, amount double")
    assert list(writers.stream_json(df))[0] == '{"cycle":2008,"name":"Ünï","amount":1.5}'
    writers.plain_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).filter("name = 'Uni'").count() == 1
    writers.by_cycle(df, str(tmp_path / "t"))
    writers.by_cycle(df.filter("cycle = 2010").withColumn("amount", F.lit(9.0)), str(tmp_path / "t"))
    assert {(r["cycle"], r["amount"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(2008, 1.5), (2010, 9.0)}
    book = zipfile.ZipFile(io.BytesIO(writers.workbook({"parents": df, "children": df.limit(1)})))
    assert {"xl/worksheets/sheet1.xml", "xl/worksheets/sheet2.xml"} <= set(book.namelist()) and "Ünï" in book.read("xl/worksheets/sheet1.xml").decode()
    with pytest.raises(ValueError):
        writers.workbook({"a": df}, most=1)
    changes = setops.table_diff(df.drop("name"), df.drop("name").withColumn("amount", F.lit(1.5)), "cycle")
    writers.table_diff_files(changes, df, "cycle", str(tmp_path / "diff"))
    assert spark.read.parquet(str(tmp_path / "diff/updates")).count() == 1


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in/a.csv", "id,year\n1,2008\n2,800\n")
    stream = lambda: intake.files(spark, str(tmp_path / "in"), StructType.fromDDL("id int, year int"))
    go = lambda: intake.load(stream(), {"year": F.col("year") >= 1900}, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(60)
    go()
    put(tmp_path / "in/b.csv", "id,year\n3,2010\n")
    go()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3]
    assert [r["reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["year"]


def test_weekly_stream_drops_late_rows(spark, tmp_path):
    (tmp_path / "w").mkdir()
    put(tmp_path / "w/a.csv", "ts,kind\n2024-01-03 00:00:00,a\n2024-01-04 00:00:00,a\n2024-01-20 00:00:00,b\n")
    s = intake.weekly(intake.files(spark, str(tmp_path / "w"), StructType.fromDDL("ts timestamp, kind string")), "ts", ["kind"])
    q = s.writeStream.format("memory").queryName("weekly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(str(r["week"].date()), r["kind"], r["n"]) for r in spark.table("weekly").collect()} == {("2024-01-01", "a", 2), ("2024-01-15", "b", 1)}


def test_lookup(spark):
    t = {"entity_totals": spark.createDataFrame([(i, -1, i, 0, float(i % 3), 0.0) for i in range(20)], "entity_id int, cycle int, contributor_count int, recipient_count int, contributor_amount double, recipient_amount double"), "organization_by_party": spark.createDataFrame([(1, "D", -1, 2, 5.0), (1, "R", -1, 1, 3.0), (1, "I", -1, 1, 1.0), (1, "", -1, 4, 2.0), (2, "D", -1, 9, 9.0)], "entity_id int, party string, cycle int, count long, amount double")}
    assert [r["id"] for r in api.lookup(t, "givers/top", limit=3).collect()] == [17, 14, 11]
    assert {tuple(r) for r in api.lookup(t, "org/recipients/party_breakdown", 1).collect()} == {("Democrats", 2, 5.0), ("Republicans", 1, 3.0), ("Other", 5, 3.0)}
    assert api.lookup(t, "entity/totals", 5).count() == 1
    with pytest.raises(api.NotFound):
        api.lookup(t, "nothing")
    s = spark.createDataFrame([(1, "D", 2012, 5.0, 10, 9.0), (2, "D", 2012, 4.0, 10, 9.0), (3, "Other", 2012, 1.0, 1, 1.0)], "entity_id int, party string, cycle int, amount double, total_count long, total_amount double")
    got = api.summarise(s, "party").collect()
    assert [(r["name"], r["count"], [c["id"] for c in r["children"]]) for r in got] == [("Democrats", 10, [1, 2]), ("Other", 1, [3])]
