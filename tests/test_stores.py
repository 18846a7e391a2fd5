"""Neighbouring repeats, versions of tables, salts between runs, intake of files that are still being written."""

import itertools
import os
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meridian.sources import salts, transforms, versions
from meridian.sources.readers import in_file_order
from meridian.streaming import intake


def test_neighbouring_repeats_as_uniq(spark, tmp_path):
    """Files in several pieces, runs of repeats over their edges, repeats further apart, blank and equal lines of two files."""
    (tmp_path / "f").mkdir()
    want = []
    for f in range(3):
        lines = [f"{(i // 7) % 5},{'x' * (i // 9 % 4)}" for i in range(400)] + ["1,", "1,", "2,", "1,"] + ["9,end"] * 200
        (tmp_path / "f" / f"{f}.csv").write_text("\n".join(lines) + "\n")
        want += [k for k, _ in itertools.groupby(lines)]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = in_file_order(spark.read.schema("a string, b string").csv(str(tmp_path / "f")))
        assert df.rdd.getNumPartitions() > 6
        got = transforms.drop_neighbours(df).select("a", "b").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(f"{r['a']},{r['b'] or ''}" for r in got) == sorted(want)


def test_versions(spark, tmp_path):
    """A reader in between keeps its version, a failing build stays unseen, cycles are replaced and dropped by the pointer alone."""
    root = str(tmp_path / "t")
    of = lambda rows: spark.createDataFrame(rows, "cycle int, v int")
    with pytest.raises(FileNotFoundError):
        versions.current(spark, root)
    first = versions.publish(of([(2008, 1), (2010, 2), (None, 3)]), root, "cycle")
    reader = versions.current(spark, root)
    versions.publish(of([(2010, 20), (2012, 4)]), root, "cycle", replace=False)
    seen = lambda df: sorted((r["cycle"] or 0, r["v"]) for r in df.collect())
    assert seen(reader) == [(0, 3), (2008, 1), (2010, 2)]
    assert seen(versions.current(spark, root)) == [(0, 3), (2008, 1), (2010, 20), (2012, 4)]
    before = versions.pointer(spark, root)
    bad = of([(2008, 0)]).withColumn("v", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        versions.publish(bad, root, "cycle", replace=False)
    assert versions.pointer(spark, root) == before and seen(versions.current(spark, root))[1] == (2008, 1)
    versions.drop(spark, root, 2008, None)
    assert [c for c, _ in seen(versions.current(spark, root))] == [0, 2010, 2012]  # a null cycle goes by "null"
    versions.drop(spark, root, "null")
    assert [c for c, _ in seen(versions.current(spark, root))] == [2010, 2012]
    with pytest.raises(ValueError):
        versions.drop(spark, root, 2010, 2012)
    assert seen(reader) == [(0, 3), (2008, 1), (2010, 2)]  # its folders are still there
    assert versions.clean(spark, root, 3600) == [] and first["2008"].split("/")[0] in versions.clean(spark, root, 0)
    assert [c for c, _ in seen(versions.current(spark, root))] == [2010, 2012]
    versions.publish(of([]), root, "cycle")
    assert versions.current(spark, root).count() == 0
    versions.publish(of([(1, 1)]), root)
    assert seen(versions.current(spark, root)) == [(1, 1)]


SALT_POOL = "id int, contributor_name string, contributor_city string, contributor_state string, contributor_zipcode string"
SALT_ROWS = "contributionid long, contributor_name string, contributor_city string, contributor_state string, contributor_zipcode string, amount decimal(15,2), date date, other string"


def test_salts_stay_from_run_to_run(spark, tmp_path):
    store = str(tmp_path / "salts")
    pool = spark.createDataFrame([(i, f"Name {i}", "City", "OR" if i % 2 else "WA", str(i)) for i in range(40)] + [(99, "Nobody", None, None, None)], SALT_POOL)
    day = F.to_date(F.lit("2010-06-15"))
    rows = lambda ids: spark.createDataFrame([(i, f"Giver {i}", "Town", ["OR", "WA", "TX", None][i % 4], "1", Decimal(i * 100), None, "x") for i in ids], SALT_ROWS).withColumn("date", day)
    key = lambda r: r["contributionid"]
    first = {key(r): r for r in salts.salted(rows(range(1, 21)), pool, store).collect()}
    salted_ids = {-i for i in first if i < 0}
    assert {i for i in salted_ids if i % 4 == 2} == set() and {i for i in range(1, 21) if i % 4 in (0, 1)} <= salted_ids  # no names for TX, i % 4 == 2
    assert len({i for i in salted_ids if i % 4 == 3}) == 1  # one name without a state
    for i in salted_ids:
        part = min(max(i, 10), 500)
        assert first[-i]["amount"] == part and first[i]["amount"] == i * 100 - part
        assert 15 <= (first[i]["date"] - first[-i]["date"]).days <= 45 and first[-i]["other"] == "x"
    names = [first[-i]["contributor_name"] for i in salted_ids]
    assert len(set(names)) == len(names)
    again = {key(r): r for r in salts.salted(rows(range(20, 0, -1)).repartition(5), pool, store).collect()}
    assert again == first
    more = {key(r): r for r in salts.salted(rows(range(1, 61)).unionByName(rows([5])), pool, store).collect()}
    assert all(more[k] == r for k, r in first.items())
    names = [r["contributor_name"] for k, r in more.items() if k < 0]
    assert len(set(names)) == len(names) and 20 < len(names) <= 41


def test_intake_waits_for_quiet_files_and_archives(spark, tmp_path):
    box = {n: tmp_path / n for n in ("in", "ready", "rejected", "done", "out", "bad", "cp")}
    box["in"].mkdir()
    put = lambda name, text, age: ((box["in"] / name).write_text(text), os.utime(box["in"] / name, (time.time() - age,) * 2))
    put("a.csv", "id,year\n1,2008\n2,800\n", 100)
    put("b.csv", "id,year\n3,20", 0)  # still being written
    put("notes.txt", "?", 0)
    offer = lambda: intake.offer(spark, *[str(box[n]) for n in ("in", "ready", "rejected")])
    assert offer() == {"ready": ["a.csv"], "rejected": ["notes.txt"], "waiting": ["b.csv"]}
    schema = StructType.fromDDL("id int, year int")

    def go():
        stream = intake.archived(spark, str(box["ready"]), str(box["done"]), schema)
        intake.load(stream, {"year": F.col("year") >= 1900}, str(box["out"]), str(box["bad"]), str(box["cp"])).awaitTermination(60)
        return sorted(r["id"] for r in spark.read.parquet(str(box["out"])).collect())

    assert go() == [1] and (box["in"] / "b.csv").exists()
    put("b.csv", "id,year\n3,2010\n", 100)
    put("c.csv", "id,year\n4,2010\n", 90)
    assert offer()["ready"] == ["b.csv", "c.csv"]
    assert go() == [1, 3, 4]
    put("d.csv", "id,year\n5,2012\n", 90)
    offer()
    assert go() == [1, 3, 4, 5]
    assert (box["rejected"] / "notes.txt").exists() and not list(box["in"].iterdir())
    deadline = time.time() + 20
    while time.time() < deadline and not list(box["done"].rglob("a.csv")):
        time.sleep(0.2)
    assert list(box["done"].rglob("a.csv"))  # the source archives what earlier batches have read
