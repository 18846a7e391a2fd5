"""Fuzzy matching against brute force in plain Python, over all rows of the smallest tables."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from meridian.functions.names import parse_person
from meridian.operators import fuzzy
from meridian.queries import QUERIES, entities
from tests.conftest import SF

FIRSTS, MIDDLES, NICK = ("John", "Jon", "Mary", "Ann", "Peter"), (" A", " Adam", "", " B"), {"john", "jon"}


def score(a, b, nicknames=True):
    """As names.person_score says it."""
    (f1, m1, l1, _), (f2, m2, l2, _) = a, b
    if l1 is None or l1 != l2:
        return 0.0
    if f1 and f1 == f2:
        first = 1.0
    elif nicknames and {f1, f2} <= NICK:
        first = 0.6
    elif (f1 and f1 == m2) or (f2 and f2 == m1):
        first = 0.8
    else:
        first = 0.1 if f1 and f2 and f1[0] == f2[0] else 0.0
    if not (m1 and m2):
        middle = 0.2
    elif m1 == m2:
        middle = 1.0
    elif 1 in (len(m1), len(m2)) and m1[0] == m2[0]:
        middle = 0.5
    else:
        middle = -1.5 if first > 0.1 else 0.0
    return round(1 + first + middle, 4)


@pytest.fixture(scope="module")
def people(spark):
    """Subjects and targets: id to parsed name."""
    rows = [(r["c_custkey"], r["c_nationkey"]) for r in spark.read.parquet(f"{SF}/customer.parquet").collect()]
    assert len(rows) == 150
    named = {k: parse_person(f"{FIRSTS[k % 5]}{MIDDLES[k % 4]} Smith{k // 24}") for k, _ in rows}
    nation = dict(rows)
    return {k: v for k, v in named.items() if nation[k] % 2 == 0}, {k: v for k, v in named.items() if nation[k] % 2}


def test_top_scores_equal_brute_force(spark, people):
    subjects, targets = people
    want = set()
    for i, a in subjects.items():
        hits = {j: s for j, b in targets.items() if (s := score(a, b)) >= 1.2}
        want |= {(i, j, s) for j, s in hits.items() if s == max(hits.values())} or {(i, None, -1.0)}
    got = [tuple(r) for r in QUERIES["fuzzy_match_top_score"](spark, SF).select("subject_id", "match_id", "confidence").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len([w for w in want if w[1] is not None]) > 50 and {w[0] for w in want} == set(subjects)


def brute_reconcile(pairs, lower, upper):
    """pairs: query, match, confidence."""
    by, want = defaultdict(dict), set()
    for i, j, s in pairs:
        if s >= lower:
            by[i][j] = s
    for i, hits in by.items():
        levels = sorted(set(hits.values()), reverse=True)[:2]
        for j, s in hits.items():
            if s in levels:
                want.add((i, j, s, s >= upper))
    return want


def test_reconcile_individuals_equals_brute_force(spark, people):
    subjects, targets = people
    want = brute_reconcile([(i, j, score(a, b, False)) for i, a in subjects.items() for j, b in targets.items()], 1.2, 3.0)
    df = QUERIES["reconcile_names"](spark, SF)
    got = [tuple(r) for r in df.filter(F.col("query_id").isin(*subjects)).select("query_id", "match_id", "confidence", "match").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({w[0] for w in want}) > 40


def org_texts(name):
    words = [fuzzy.ABBREVIATIONS.get(w, w) for w in re.sub("[,.*:;+]+", "", re.sub(r"[/\\\\\s]+", " ", name.lower())).split()]
    kernel = [w for w in words if w not in {*fuzzy.FILLERS, *fuzzy.ABBREVIATIONS.values()}]
    return name.lower().strip(), " ".join(words), " ".join(kernel), ", ".join(kernel[:2])


def brute_cascade(subjects, targets):
    """All pairs of the first way that finds any: subject, match, way, score."""
    out = set()
    for i, name in subjects.items():
        low, full, kernel, firm = org_texts(name)
        ways = {"kernel": (kernel, lambda m: kernel in m), "name": (low, lambda m: low in m), "expanded": (full, lambda m: full in m), "words": (kernel, lambda m: re.search(".*".join(map(re.escape, kernel.split())), m)), "firm": (firm, lambda m: m.startswith(firm))}
        for way, (key, test) in ways.items():
            if hits := [j for j, t in targets.items() if key and test(t.lower().strip())]:
                for j in hits:
                    m_low, m_full, m_kernel, _ = org_texts(targets[j])
                    partners = "," in low and firm + ", et al" == m_low
                    out.add((i, j, way, 4.0 if m_full == full else 3.0 if m_kernel == kernel or partners else 2.0))
                break
    return out


ORGANIZATIONS = {
    0: "Mass. Inst. of Tech", 1: "Acme", 2: "Acme Corp.", 3: "Big Iron Works, Inc.", 4: "Patton, Boggs & Blow", 5: "The Group", 6: "3M", 7: "Nobody At All", 8: "Bank of Ohio", 9: "AT&T Inc", 10: "a(b", 11: "",
}
TARGETS = {
    100: "The Mass Institute of Tech Fund", 101: "Pacme Corporation", 102: "ACME corporation", 103: "Acme Company", 104: "Big Old Iron Heavy Works", 105: "Patton, Boggs, et al", 106: "The Group Inc",
    107: "3M Co", 108: "First Bank of Ohio", 109: "AT&T, Incorporated", 110: "x a(b y", 111: "Works Iron Big", 112: "",
}


def test_organization_cascade_equals_brute_force(spark):
    frame = lambda d: spark.createDataFrame(list(d.items()), "id int, name string")
    want = brute_cascade(ORGANIZATIONS, TARGETS)
    got = [tuple(r) for r in fuzzy.organization_candidates(frame(ORGANIZATIONS), frame(TARGETS)).select("subject_id", "match_id", "tier", "confidence").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {w[2] for w in want} == set(fuzzy.CASCADE) and {w[3] for w in want} == {2.0, 3.0, 4.0}
    assert {(0, 100, "expanded", 2.0), (1, 101, "kernel", 2.0), (2, 102, "kernel", 4.0), (3, 104, "words", 2.0), (4, 105, "firm", 3.0), (8, 108, "name", 2.0)} <= want


def test_candidates_of_organizations_grow_with_the_names(spark):
    """Names told apart by numbers: every run of three characters is in a share of all names, so pairs by these would be 36 times as many for six times the names."""
    def pairs(n):
        d = spark.range(n).select("id", F.format_string("Q%05dx Bros", F.col("id") * 7919 % 100_000).alias("low"))
        keys = d.select(F.col("id").alias("subject_id"), F.lit(0).alias("tier"), F.col("low").alias("key"), F.array("low").alias("parts"))
        return fuzzy.organization_pairs(keys, d.select(F.col("id").alias("match_id"), F.col("low").alias("match_low")))

    few, many = pairs(2000), pairs(12000)
    assert many.filter("subject_id = match_id").count() == 12000 and many.count() <= 7 * few.count()


def test_organization_query_equals_brute_force(spark):
    rows = entities._organizations(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/part.parquet").count()
    pairs = brute_cascade({r["id"]: r["name"] for r in rows if r["is_subject"]}, {r["id"]: r["name"] for r in rows if not r["is_subject"]})
    best = {i: max(s for k, _, _, s in pairs if k == i) for i, *_ in pairs}
    got = [tuple(r) for r in QUERIES["fuzzy_organizations_cascade"](spark, SF).select("subject_id", "match_id", "tier", "confidence").collect()]
    assert len(got) == len(set(got)) and set(got) == {w for w in pairs if w[3] == best[w[0]]}
    assert {g[2] for g in got} == {"kernel", "name", "words", "firm"}


def test_reconcile_politicians_and_organizations_equal_brute_force(spark):
    rows = [(-2 * r["s_suppkey"] - 1, r["s_suppkey"], r["s_nationkey"]) for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()]
    named = {i: parse_person(f"{FIRSTS[k % 5]}{MIDDLES[k % 4]} Smith{k // 24}") for i, k, _ in rows}
    side = {i: n % 2 for i, _, n in rows}
    pol = brute_reconcile([(i, j, score(named[i], named[j], False)) for i in named for j in named if side[i] == 0 and side[j] == 1], 1.0, 2.0)
    parts = [(-2 * r["id"] - 2, r["name"], r["is_subject"]) for r in entities._organizations(spark, SF).collect()]
    org = brute_reconcile([(i, j, s) for i, j, _, s in brute_cascade({i: n for i, n, q in parts if q}, {i: n for i, n, q in parts if not q})], 1.0, 4.0)
    got = [tuple(r) for r in QUERIES["reconcile_names"](spark, SF).filter("query_id < 0").select("query_id", "match_id", "confidence", "match").collect()]
    assert pol and org and len(got) == len(set(got)) and set(got) == pol | org


def test_reconcile_limits_by_kind(spark):
    q = spark.createDataFrame([(1, "John Smith", "individual"), (2, "Rep. John Smith (R)", "politician"), (3, "Red Bolt, Inc.", "organization"), (4, "Red Bolt Corp.", "organization"), (5, "Jane Smith", "politician"), (6, "Kerry/Edwards", "politician")], "id int, name string, kind string")
    t = spark.createDataFrame([(11, "Smith, John", "individual"), (12, "Smith, John", "politician"), (13, "Red Bolt Corporation", "organization"), (14, "Kerry/Edwards", "politician"), (15, "Old Red Bolt Works", "organization"), (16, "Red Bolt Corp", "organization")], "id int, name string, kind string")
    got = {tuple(r) for r in fuzzy.reconcile(q, t).select("query_id", "match_id", "confidence", "match").collect()}
    assert got == {(1, 11, 2.2, False), (2, 12, 2.2, True), (3, 13, 3.0, False), (3, 16, 3.0, False), (3, 15, 2.0, False), (4, 13, 4.0, True), (4, 16, 4.0, True), (4, 15, 2.0, False), (5, 12, 1.3, False)}


def test_members_two_passes(spark):
    """A state, a wrong state, no state, several politicians, a first name that differs, another chamber."""
    pol = [(1, "john", "smith", "D", "CA", "federal:house"), (1, "johnny", "smith", "D", "CA", "federal:house"), (2, "john", "smith", "R", "NV", "federal:house"), (3, "john", "smith", "D", "CA", "federal:senate"), (4, "ann", "doe", "D", "TX", "federal:house"), (5, "ann", "doe", "R", "UT", "federal:house")]
    members = [(1, "John Smith", "h", "", "CA"), (2, "John Smith", "h", None, "OR"), (3, "John Smith", "h", "R", None), (4, "Ann Doe", "h", "", ""), (5, "Ann Doe", "h", "R", ""), (6, "Bob Doe", "h", "", "TX"), (7, "John Smith", "s", "", "CA"), (8, "Doe", "h", "", "TX"), (9, "Ann Doe", "s", "", "TX")]
    earmarks = [("John Smith", "h", "NV; OR; Nevada"), ("Ann Doe", "h", "TX"), ("Ann Doe", "h", "UT;"), ("Ann Doe", "s", "TX")]
    make = spark.createDataFrame
    got = {tuple(r) for r in fuzzy.match_members(make(members, "id int, name string, chamber string, party string, state string"), make(earmarks, "name string, chamber string, states string"), make(pol, "id int, first string, last string, party string, state string, seat string")).collect()}
    assert got == {(1, 1, "matched"), (2, 2, "matched"), (3, 2, "matched"), (4, None, "many"), (5, 5, "matched"), (6, None, "none"), (7, 3, "matched"), (8, 4, "matched"), (9, None, "none")}


def test_extra_keys_metadata_and_unmatched(spark):
    s = spark.createDataFrame([(1, "John Smith", "CA"), (2, "John Smith", "NV"), (3, "John Smith", "TX")], "id int, name string, state string")
    t = spark.createDataFrame([(11, "Smith, John", "CA", "town clerk"), (12, "Smith, John", "NV", "city"), (13, "Smith, John", "CA", "none")], "id int, name string, state string, job string")
    job = F.when(F.contains("match_job", F.lit("clerk")), 1).when(F.contains("match_job", F.lit("city")), 0.5).otherwise(0)
    got = {tuple(r) for r in fuzzy.match_people(s, t, keep_unmatched=True, on=("state",), metadata=job).select("subject_id", "match_id", "confidence", "metadata_confidence").collect()}
    assert got == {(1, 11, 2.2, 1.0), (1, 13, 2.2, 0.0), (2, 12, 2.2, 0.5), (3, None, -1.0, None)}


def test_politicians_by_cycle_state_district_and_mates(spark):
    s = spark.createDataFrame([(1, "John Smith", 2010, "CA", "7"), (2, "John Smith", 2010, "CA", ""), (3, "John Smith", 2008, "CA", "7"), (4, "Kerry/Smith", 2010, "CA", "7"), (5, "Joe Kerry", 2010, "MA", None)], "id int, name string, cycle int, state string, district string")
    t = spark.createDataFrame([(11, "Smith, John", 2010, "CA", "CA-07"), (12, "Smith, John", 2010, "CA", "_"), (13, "Kerry, Joe / Smith, John", 2010, "MA", None), (14, "Smith, John", 2010, "NV", "NV-07")], "id int, name string, cycle int, state string, district string")
    assert {tuple(r) for r in fuzzy.match_politicians(s, t).collect()} == {(1, 11, 2.2), (2, 12, 2.2), (5, 13, 2.2)}


def test_queries_of_politicians_and_members_use_all_rows(spark):
    state = lambda n: chr(65 + n // 5) + chr(65 + n % 5)
    sup = sorted(r["s_suppkey"] for r in spark.read.parquet(f"{SF}/supplier.parquet").collect())
    cust = sorted(r["c_custkey"] for r in spark.read.parquet(f"{SF}/customer.parquet").collect())
    want = set()
    for c in cust:
        a = parse_person(f"{FIRSTS[c % 5]}{MIDDLES[c % 4]} Smith{c // 360}")
        hits = {k: s for k in sup if k % 5 == c % 5 and k % 2 == c % 2 and (s := score(a, parse_person(f"{FIRSTS[k % 5]}{MIDDLES[k % 4]} Smith{k // 24}"), False)) >= 1.2}
        want |= {(c, k, s) for k, s in hits.items() if s == max(hits.values())}
    assert want and {tuple(r) for r in QUERIES["match_politicians_by_seat"](spark, SF).collect()} == want
    possible, found = defaultdict(set), set()
    for c in cust:
        possible[c % 5, c // 360].add(state(c // 7 % 4))
    for c in cust:
        near = {k for k in sup if k % 5 == c % 5 and k // 24 == c // 360}
        hits = {k for k in near if c % 3 and state(k % 25) == state(c % 25)} or {k for k in near if state(k % 25) in possible[c % 5, c // 360]}
        found.add((c, min(hits) if len(hits) == 1 else None, {0: "none", 1: "matched"}.get(len(hits), "many")))
    assert {tuple(r) for r in QUERIES["match_members_unique"](spark, SF).collect()} == found


def test_requests_of_reconciliation(spark):
    """One query, several, hints, types, offices, text that is no JSON."""
    several = '{"a": {"query": "Ann Doe", "type": "politician"}, "b": {"query": "Ann Doe", "properties": [{"pid": "contributionType", "v": "Politician"}, {"pid": "office", "v": "US House"}]}, "c": {"query": "X Inc", "properties": []}, "d": {"type": "politician"}}'
    rows = [(1, '{"query": "John Doe", "type": "individual"}', several), (2, None, several), (3, "", "no json"), (4, None, None), (5, '{"query": "Y", "type": "else", "properties": [{"pid": "office", "v": "Mayor"}, {"pid": "contributionType", "v": "individual"}]}', None),
            (6, '{"query": "Z", "properties": [{"pid": "contributionType", "v": "individuals"}, {"pid": "office", "v": ""}]}', None)]
    got = {(r.id.request, r.id.key, r["name"], r.kind, r.seat, r.narrow) for r in fuzzy.requests(spark.createDataFrame(rows, "request int, query string, queries string")).collect()}
    assert got == {
        (1, None, "John Doe", "individual", None, False), (2, "a", "Ann Doe", "politician", None, False), (2, "b", "Ann Doe", "politician", "federal:house", True), (2, "c", "X Inc", "organization", None, False),
        (5, None, "Y", "organization", "?", True), (6, None, "Z", "individual", None, True),
    }


def test_politicians_narrowed_by_office_and_cycle(spark):
    make = spark.createDataFrame
    q = make([(1, "Ann Doe", "politician", None, False), (2, "Ann Doe", "politician", None, True), (3, "Ann Doe", "politician", "federal:house", True), (4, "Ann Doe", "politician", "?", True)], "id int, name string, kind string, seat string, narrow boolean")
    t = make([(i, "Doe, Ann", "politician") for i in (11, 12, 13, 14)], "id int, name string, kind string")
    held = make([(11, 2010, "federal:senate"), (11, 2006, "federal:house"), (12, 2008, "federal:house"), (13, 2012, "federal:senate"), (13, None, None)], "entity_id int, cycle int, seat string")
    got = {(r.query_id, r.match_id) for r in fuzzy.reconcile(q, t, held=held).collect()}
    assert got == {(1, 11), (1, 12), (1, 13), (1, 14), (2, 11), (2, 13), (3, 11)}


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    """Spark takes exploded rows for as few as before: joins with them must not bring them to the driver, however small the tables seem."""
    from meridian.operators import close, fuzzy, matching

    plans = []
    kept = close.checkpointed
    for module in (close, matching):
        monkeypatch.setattr(module, "checkpointed", lambda d: (plans.append(d), kept(d))[1])
    names = spark.range(50).selectExpr("id", "concat('Q', id div 8, 'x Red Trust ', id) as name")
    people = spark.range(50).selectExpr("id", "concat('John ', if(id % 2 = 0, 'A', 'B'), ' Smith', id div 8) as name")
    plans += [close.close_matches(names, names), fuzzy.cascade_organizations(names, names), fuzzy.match_people_all(people, people, 1.0), matching.best_people(people, people, threshold=1.0)]
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in plans]
    assert sum("SortMergeJoin" in x for x in plans) > 8 and not any("Broadcast" in x for x in plans)
