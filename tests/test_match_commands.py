"""The match commands: hand-made cases, brute force over all rows of the smallest tables, and a last name with many bearers."""

import pytest
from pyspark.sql import functions as F

from meridian.functions.names import parse_person
from meridian.operators.matching import best_people
from meridian.plans import matching as mt
from meridian.queries import QUERIES
from meridian.queries import matching as qm
from tests.conftest import SF
from tests.test_fuzzy import brute_cascade

NICK = [{"john", "jon", "johnny"}, {"ann", "anna"}]


def added(a, b):
    (f1, m1, l1, _), (f2, m2, l2, _) = a, b
    if not l1 or l1 != l2:
        return 0
    score = 1.0
    if f1 == f2:
        score += 1
    else:
        if any({f1, f2} <= n for n in NICK):
            score += 0.6
        if f1 == m2 and f2 == m1:
            score += 0.8
        elif not f1 or not f2:
            return 0
        elif f1[0] == f2[0]:
            score += 0.1
    if m1 and m2:
        score += (1 if m1 == m2 else 0.5 if m1[0] == m2[0] else -1.5) if score > 1.1 else 0.2
    return round(score, 4)


def brute(subjects, targets, threshold, starts=False):
    out = set()
    for i, a in subjects:
        last = parse_person(a)[2]
        hits = {j: s for j, b in targets if last and (s := added(parse_person(a), parse_person(b))) >= threshold and (not starts or b.lower().startswith(last))}
        out |= {(i, j, s) for j, s in hits.items() if s == max(hits.values())}
    return out


def nicknames(spark):
    return spark.createDataFrame([(n.title(), str(i)) for i, f in enumerate(NICK) for n in f], "name string, family string")


GIVEN = ["John", "Jon", "Johnny", "Ann", "Anna", "Adam", "Jane", "J", ""]
MIDDLE = ["", "A", "Adam", "John", "B", "Bea"]


@pytest.mark.parametrize("threshold,starts", [(1.0, False), (1.1, False), (1.2, False), (1.2, True), (1.3, False), (2.0, False)])
def test_stages_equal_brute_force(spark, threshold, starts):
    names = [(f"{g} {m} {last}" if k % 2 else f"{last}, {g} {m}").strip(" ,") for last in ("Doe", "Poe") for k, (g, m) in enumerate((g, m) for g in GIVEN for m in MIDDLE if g or not m)]
    subjects, targets = list(enumerate(names)), [(1000 + i, n) for i, n in enumerate(names) if i % 3] + [(2000, ""), (2001, None)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, name string")
    got = [tuple(r) for r in best_people(frame([*subjects, (5000, None), *subjects[:3]]), frame(targets + targets[:2]), nicknames(spark), threshold, starts).select("subject_id", "match_id", "confidence").collect()]
    want = brute(subjects, [(j, n) for j, n in targets if n], threshold, starts)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    if (threshold, starts) == (1.0, False):
        assert {1.0, 1.1, 1.2, 1.3} & {w[2] for w in brute(subjects[:30], [t for t in targets if t[1] and "J" in t[1]][:4], 1.0)}


def test_no_nicknames_and_empty_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id int, name string")
    assert best_people(frame([]), frame([(1, "John Doe")])).count() == 0 and best_people(frame([(1, "John Doe")]), frame([])).count() == 0
    got = best_people(frame([(1, "John Doe")]), frame([(2, "Jon Doe"), (3, "John Doe"), (4, "Doe, John A")])).collect()
    assert {(r.match_id, r.confidence) for r in got} == {(3, 2.0), (4, 2.0)}
    with pytest.raises(ValueError):
        best_people(frame([]), frame([]), threshold=0.5)


def test_a_last_name_of_a_third_of_all_rows(spark):
    """20,000 bearers on each side, each with a first name of its own: by last name alone 4e8 pairs."""
    n = spark.range(20000, numPartitions=4)
    s = n.select("id", F.concat(F.lit("Smith, K"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("name"))
    got = best_people(s, s, nicknames(spark))
    assert got.count() == 20000 and got.filter("subject_id = match_id and confidence = 2").count() == 20000


def test_queries_equal_brute_force(spark):
    t = qm.tables(spark, SF)
    for name, starts in (("officers", False), ("whitehouse_visitors_vs_lobbyists", True), ("faca_lobbyists", True)):
        s = [(str(r.id), r.name) for r in mt.subjects(t, name).collect()]
        m = [(str(r.id), r.name) for r in mt.TARGETS[mt.COMMANDS[name].targets](t).collect()]
        got = {(r.subject_id, r.match_id, r.confidence) for r in mt.matches(t, [name]).collect()}
        assert got == brute(s, m, 1.2, starts) and (got or name.startswith("whitehouse"))
    rows = QUERIES["match_commands_organizations"](spark, SF).collect()
    assert {r.command for r in rows} == set(qm.ORGANIZATIONS)
    for name in qm.ORGANIZATIONS:
        s = {str(r.id): r.name for r in mt.subjects(t, name).collect()}
        pairs = brute_cascade(s, {str(r.id): r.name for r in mt.TARGETS[mt.COMMANDS[name].targets](t).collect()})
        best = {i: max(x for k, _, _, x in pairs if k == i) for i, *_ in pairs}
        want = {(i, j, x) for i, j, _, x in pairs if x == best[i]} | {(i, None, -1.0) for i in s if i not in best}
        assert {(r.subject_id, r.match_id, r.confidence) for r in rows if r.command == name} == want and best


def test_rules_of_commands(spark):
    frame = spark.createDataFrame
    people = "id int, name string"
    t = {
        "nickname": nicknames(spark), "officer": frame([(1, "JOHN DOE CBO"), (2, "Doe, Jane, M.D."), (3, "Kerry / Doe"), (4, "Nobody Else"), (5, None)], people),
        "entity": frame([(11, "Doe, John", "politician"), (12, "Jane Doe", "politician"), (13, "John Doe", "individual"), (14, "Roe, Al / Doe, Ann", "politician")], people + ", type string"),
        "attribute": frame([(11, "urn:nimsp:recipient", "x"), (12, "urn:crp:recipient", "y"), (14, "urn:crp:recipient", "z")], "entity_id int, namespace string, value string"),
        "politician_state": frame([(11, 2010, "CA", "state:upper", None), (11, 2012, "NV", "federal:house", None), (12, 2010, "CA", "federal:house", "CA-07"), (14, 2010, "OH", "state:governor", "_")], "entity_id int, cycle int, state string, seat string, district string"),
        "alec_sponsor": frame([(1, "Doe", "CA"), (2, "John Q Doe", "NV"), (3, "Jane Doe", "CA"), (4, "John Doe", "CA"), (5, "John Doe", None)], people + ", state string"),
        "member_of_congress": frame([(1, "Jane Doe", 2010, "CA", "7"), (2, "Jane Doe", 2010, "CA", None), (3, "Ann Doe", 2010, "OH", ""), (4, "Ann Doe", 2008, "OH", ""), (5, "Ann Doe / Al Roe", 2010, "OH", "")], people + ", cycle int, state string, district string"),
        "local_election_official": frame([(1, "John Doe", "Ohio"), (2, "John Doe", "Erewhon")], people + ", state string"),
        "giver_by_state": frame([(21, "Doe, John", "OH", "Election Board", None), (22, "Doe, John", "OH", None, "City of Lima"), (23, "Doe, John", "IN", "BOE", ""), (24, "Doe, John", "OH", "boe", "x")], people + ", state string, employer string, occupation string"),
    }
    got = lambda *names, **more: {(r.command, r.subject_id, r.match_id, r.confidence, r.metadata_confidence) for r in mt.matches(t, names, **more).collect()}
    assert got("officers") == {("officers", "1", "11", 2.0, 0.0), ("officers", "2", "12", 2.0, 0.0)}
    assert {g[1:4] for g in got("officers", keep_unmatched=True)} == {("1", "11", 2.0), ("2", "12", 2.0), ("4", None, -1.0), ("5", None, -1.0)}
    assert {g[1:4] for g in got("alec_sponsors")} == {("1", "11", 1.0), ("4", "11", 2.0)}
    assert {g[1:4] for g in got("mocs_with_historical_bioguide_ids")} == {("1", "12", 2.0), ("3", "14", 2.0)}
    assert {g[1:] for g in got("local_election_officials")} == {("1", "21", 2.0, 1.0), ("1", "22", 2.0, 0.5), ("1", "24", 2.0, 0.0)}
    together = got("officers", "alec_sponsors", "local_election_officials", "mocs_with_historical_bioguide_ids")
    assert together == got("officers") | got("alec_sponsors") | got("local_election_officials") | got("mocs_with_historical_bioguide_ids")


def test_contractors_tables_and_clean_up(spark, tmp_path):
    found = spark.createDataFrame([("pogo_contractors", "9", "1", 4.0), ("pogo_contractors", "10", "1", 4.0), ("pogo_contractors", "3", None, -1.0), ("officers", "7", "2", 2.0)], "command string, subject_id string, match_id string, confidence double")
    attribute = spark.createDataFrame([(1, mt.CONTRACTOR, "old"), (1, "x", "y"), (2, mt.CONTRACTOR, "kept")], "entity_id int, namespace string, value string")
    assert {tuple(r) for r in mt.with_contractors(attribute, found).collect()} == {(1, mt.CONTRACTOR, "10"), (1, "x", "y"), (2, mt.CONTRACTOR, "kept")}
    root = str(tmp_path)
    for when in ("20240101_0900", "20240301_0900", "20231201_0900"):
        mt.save(found, "pogo_contractors", root, when)
    mt.save(found, "officers", root, "20200101_0000")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        mt.save(found, "officers", root, "20200101_0000")
    assert mt.clean_up(spark, root, "matching_pogo") == ["matching_pogo_matches_20231201_0900", "matching_pogo_matches_20240101_0900"]
    assert mt.clean_up(spark, root, "matching_pogo") == [] and mt.clean_up(spark, root, "none") == []
    assert spark.read.parquet(f"{root}/matching_pogo_matches_20240301_0900").count() == 3 and spark.read.parquet(f"{root}/matching_matches_20200101_0000").count() == 1
    assert {p.name for p in tmp_path.iterdir()} == {"matching_pogo_matches_20240301_0900", "matching_matches_20200101_0000"}


def test_a_politicians_recipient_id_is_no_lobbyists(spark, tmp_path):
    """Staffers are matched by the first 11 characters of ids: with rows of sf0.1 a politician of the stand-ins passed for a lobbyist, whom the query's SQL leaves out."""
    customers = [(k, k % 2) for k in range(10080, 10120)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{SF}/part.parquet").limit(8).write.parquet(f"{tmp_path}/part.parquet")
    t = qm.tables(spark, str(tmp_path))
    found = {r.id for r in mt.TARGETS["lobbyists_2009_2011_by_short_id"](t).collect()}
    assert found == {k for k, odd in customers if odd and k % 3 and k % 5 != 4 and k % 7 < 6 and 2009 <= 2008 + k % 6 <= 2011}
    one = {"entity": spark.sql("select 1 as id, 'A' as name, 'politician' as type"), "attribute": spark.sql("select 1 as entity_id, 'x' as namespace, 'U0000000001A' as value"), "lobbyist_id": spark.sql("select 'U0000000001B' as ext_id, 2010 as year")}
    assert mt.TARGETS["lobbyists_2009_2011_by_short_id"](one).count() == 1 and mt.TARGETS["lobbyists_2009_2011"](one).count() == 0


def test_no_politician_of_the_stand_ins_has_a_lobbyists_id(spark):
    """The statistics' SQL matches staffers with lobbyists who are no politicians; ids are compared by eleven characters there."""
    t = qm.tables(spark, SF)
    short = lambda c: F.left(c, F.lit(11)).alias("_id")
    politicians = t["entity"].filter("type = 'politician'").select(F.col("id").alias("entity_id"))
    theirs = t["attribute"].join(politicians, "entity_id").select(short("value"))
    assert theirs.count() > 0 and theirs.join(t["lobbyist_id"].select(short("ext_id")), "_id").count() == 0
