"""Close matches against difflib, equal names and the only politician against plain code."""

import difflib
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from meridian.functions import names
from meridian.functions.persons import Switches, parts_of, western
from meridian.operators import close, persons
from meridian.operators.close import close_matches


def brute_close(name, targets, n=3, cutoff=0.6):
    if not name:
        return []
    low = name.lower()
    fit = [x for x in targets if x is not None and len(x.split(" ")) - len(name.split(" ")) < 2 and (low.startswith(x.split(" ")[0].lower()) or re.sub("(?i)^the ", "", name).lower().startswith(x.split(" ")[0].lower()))]
    return difflib.get_close_matches(low, [x.lower() for x in fit], n, cutoff)


def test_close_matches_equal_difflib(spark):
    rng = random.Random(4)
    words = ["University", "univ", "of", "City", "Center", "Research", "The", "Saint", "St", "health", "Hospital", "a", "Oregon"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
    names = [name() for _ in range(60)] + ["the university of oregon", "Universities", "", None, "x", "  double  space", "ÉCOLE centrale"]
    targets = sorted({name() for _ in range(150)}) + ["", None, "École Centrale", "University of Oregon", "UNIVERSITY OF OREGON Research"]
    of = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id int, name string")
    got = {}
    for r in sorted(close_matches(of(names), of(targets)).collect(), key=lambda r: (r["id"], r["position"])):
        got.setdefault(r["id"], []).append(r["match"].lower())
    assert got == {i: m for i, x in enumerate(names) if (m := brute_close(x, targets))}
    assert close_matches(of([]), of(targets)).count() == 0 and close_matches(of(names), of([])).count() == 0


@pytest.mark.parametrize("few", [0, 3, 32])
def test_close_matches_of_few_and_of_many_targets(spark, monkeypatch, few):
    """By arrays of a first word's targets, by characters, and by both together; equal names of several targets, leading spaces and `the` twice."""
    monkeypatch.setattr(close, "FEW", few)
    rng = random.Random(5)
    words = ["The", "the", "T", "Bank", "bank", "B", "of", "Ohio", "\U0001d517rust", "Zürich", "Co."]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    names = [name() for _ in range(80)] + ["the the bank", "The  Bank", " bank", "the ", "THE", "the bank of ohio"] * 2
    targets = [name() for _ in range(120)] + [" Bank", "", "Bank of Ohio", "bank of ohio", "BANK OF OHIO", "BANK OF OHIO", "The Bank"]
    rng.shuffle(targets)
    of = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id int, name string")
    got = sorted((r["id"], r["position"], r["match_id"], r["match"], r["ratio"]) for r in close_matches(of(names), of(targets)).collect())
    want = []
    for i, x in enumerate(names):
        fit = [(difflib.SequenceMatcher(None, t.lower(), x.lower()).ratio(), t.lower(), -j) for j, t in enumerate(targets) if brute_close(x, [t])]
        want += [(i, at, -j, targets[-j], ratio) for at, (ratio, _, j) in enumerate(sorted(fit, reverse=True)[:3], 1)]
    assert got == want and len({x for x, *_ in got}) > 80


def test_close_matches_shuffle_little_for_each_name(spark):
    """Names of which each has three targets are not repeated for each beginning and character."""
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        time.sleep(0.5)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    names = spark.range(1000).selectExpr("id", "concat('Q', id, 'x County Hospital for Children and Women') as name")
    targets = spark.range(3000).selectExpr("id", "concat('Q', id div 3, 'x County Hospital for Women and Children ', id % 3) as name")
    before = shuffled()
    assert close_matches(names, targets).count() == 3000
    assert 0 < shuffled() - before < 2000 * 1000


def test_closest_of_computes_no_ratio_that_cannot_count(monkeypatch):
    tried = []
    kept = difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda m: tried.append(m.a) or kept(m))
    assert names.closest_of("abcdef", ["abcxyz", "abcdef", "abcdeg", "abcdeg", "zzz"], 2, 0.1) == [{"place": 1, "ratio": 1.0}, {"place": 2, "ratio": 10 / 12}]
    assert "abcxyz" not in tried and "zzz" not in tried
    assert names.closest_of("abc", [], 2, 0.1) == [] and names.closest_of("abc", ["", "xyz"], 2, 0.1) == []


NICKS = [("BILL", "William"), ("WILLIAM", "William"), ("TED", "Ted"), ("EDWARD", "Ted"), ("THEODORE", "Ted"), ("BILL", "Billy")]


def brute_equal(x, y, s):
    """The rules read one after the other."""
    a, b = (dict(zip(("whole", "first", "middle", "last", "suffix", "nicks"), parts_of(n), strict=True)) for n in (x, y))
    if not a["whole"] or not b["whole"]:
        return False
    nick = lambda p, q: any({(p, f), (q, f)} <= set(NICKS) for f in ("William", "Ted", "Billy")) or any(v and p in v and q in v for v in (a["nicks"], b["nicks"]))
    short = lambda p, q: bool(p and q and (p == q[0] and len(p) == 1 or q == p[0] and len(q) == 1))
    first = lambda p, q: p == q or (s.nicknames and nick(p, q)) or (s.initials and short(p, q))
    if a["whole"] == b["whole"]:
        return True
    if not a["last"] or a["last"] != b["last"]:
        return False
    if a["suffix"] != b["suffix"] and ((a["suffix"] and b["suffix"]) or not s.missing_suffix):
        return False
    if s.missing_first and any(not p["first"] and not p["middle"] for p in (a, b)):
        return True
    if s.first_as_middle and any(p["first"] and p["middle"] and not q["middle"] and first(p["middle"], q["first"]) for p, q in ((a, b), (b, a))):
        return True
    if not first(a["first"], b["first"]):
        return False
    return a["middle"] == b["middle"] or (s.missing_middle and not (a["middle"] and b["middle"])) or (s.initials and short(a["middle"], b["middle"]))


PEOPLE = [
    "William Jefferson Clinton", "Bill Clinton", "W. J. Clinton", "Jefferson Clinton", "Clinton", "William J Clinton Jr", "Bill Clinton Sr.", "Hillary Clinton", "H Clinton", "Edward Kennedy", "Ted Kennedy", "Theodore Kennedy",
    'Edward "Buddy" Kennedy', "Buddy Kennedy", "E M Kennedy", "Edward Moore Kennedy III", "Kennedy", "J. Edgar Hoover", "Edgar Hoover", "John Hoover", "John & Mary Hoover", "-", "  ", "Ben Israel", "II", "A B C D Hoover", "Bill O'Neil", "William ONeil",
]


def test_names_in_parts():
    assert parts_of("Barack Hussein Obama Sr") == ("BARACKHUSSEINOBAMASR", "BARACK", "HUSSEIN", "OBAMA", "SR", None)
    assert parts_of('Edward "Ted" Kennedy')[1:] == ("EDWARD", None, "KENNEDY", None, ["EDWARD", "TED"])
    assert western("OBAMA, BARACK (D)") == "BARACK OBAMA" and western("SMITH, JOHN JR") == "JOHN SMITH JR" and western("Mr. X & Y, Z") != ""
    assert western("US Dept of Health") == "united states department of Health" and western("DOE, MR JOHN") == "JOHN DOE"


def test_equal_people_with_every_switch(spark):
    people = persons.parsed(spark.createDataFrame(list(enumerate(PEOPLE)), "id int, name string"), spark.createDataFrame(NICKS, "name string, family string")).cache()
    settings = [Switches(), Switches.exact(), *[Switches.exact(**{k: True}) for k in Switches.__dataclass_fields__], *[Switches(**{k: False}) for k in Switches.__dataclass_fields__]]
    for s in settings:
        got = {(r["left_id"], r["right_id"]) for r in persons.equal_people(people, people, s).collect()}
        want = {(i, j) for (i, x), (j, y) in itertools.product(enumerate(PEOPLE), repeat=2) if brute_equal(x, y, s)}
        assert got == want, (s, [(PEOPLE[i], PEOPLE[j]) for i, j in got ^ want])


def test_a_last_name_with_100000_bearers(spark):
    """Many first names of one last name: candidates are by first name, in several tasks, and few."""
    many = spark.range(100_000).select(F.col("id"), F.concat(F.lit("N"), F.translate((F.col("id") % 20_000).cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit(" Smith")).alias("name"))
    asked = spark.createDataFrame([(1, "Nbcd Smith"), (2, "Nzz Smith"), (3, "Smith Nbcd")], "id long, name string")
    keys = persons._keys(persons.parsed(many), 1)
    assert keys.filter("_key like 'SMITH|n%'").groupBy("_key").count().agg(F.max("count")).first()[0] == 5
    got = persons.equal_people(persons.parsed(asked), persons.parsed(many)).groupBy("left_id").count().collect()
    assert {r["left_id"]: r["count"] for r in got} == {1: 5}


def test_only_politician(spark):
    """One with two entities that agree, one name that two different people have, one unknown; the least alias of the first by name."""
    rows = [
        (1, "Kennedy, Edward", "KENNEDY, EDWARD M"), (1, "Kennedy, Edward", "Ted Kennedy"), (2, "Kennedy, Ted", "TED KENNEDY (D)"), (3, "Smith, A", "Adam Smith"), (4, "Smith, B", "Anna Smith"),
        (5, "Jones", "JONES, MR BOB"), (5, "Jones", "Jones, Robert"), (6, "Nobody", None),
    ]
    aliases = spark.createDataFrame(rows, "entity_id int, entity_name string, alias string")
    names = spark.createDataFrame([(1, "Edward Kennedy"), (2, "A Smith"), (3, "Adam Smith"), (4, "Bob Jones"), (5, "Zed Zed"), (6, None)], "id int, name string")
    got = {r["id"]: (r["entity_id"], r["alias"]) for r in persons.only_politician(names, aliases, spark.createDataFrame(NICKS, "name string, family string")).collect()}
    assert got == {1: (1, "KENNEDY, EDWARD M"), 3: (3, "Adam Smith"), 4: (5, "JONES, MR BOB")}


def test_queries_equal_brute_force(spark):
    """The registered queries over all rows of the smallest tables."""
    from meridian.queries import entities as q
    from tests.conftest import SF

    # close names
    o = q._organizations(spark, SF).collect()
    targets = [(r["id"], f"Q{r['id'] // 8}x {r['name']}") for r in o]
    color = ("Red", "Bleu", "iron", "Stone", "Gold")
    got = {}
    for r in sorted(q.close_recipient_names(spark, SF).collect(), key=lambda r: (r["id"], r["position"])):
        got.setdefault(r["id"], []).append((r["match"].lower(), round(r["ratio"], 9)))
    by_word = {}
    for _, t in targets:
        by_word.setdefault(t.split(" ")[0].lower(), []).append(t)
    n = 0
    for k in (r["c_custkey"] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()):
        name = ("The " if k % 3 == 0 else "") + f"Q{k // 8}x {color[k % 5]} Q{k // 8}" + ("x Trust" if k % 2 == 0 else "x corp.")
        first = re.sub("(?i)^the ", "", name).split(" ")[0].lower()
        near = [t for w in {first[:i] for i in range(len(first) + 1)} | {"the", "th", "t"} for t in by_word.get(w, [])]
        want = brute_close(name, near)
        assert [m for m, _ in got.get(k, [])] == want, name
        n += len(want)
    assert n > 50
    # equal names, and the only politician
    people = q._lettered(spark, SF).collect()
    full = lambda r: f"{r['first']}{r['middle']} {r['last']}"
    nick = {}
    for a, f in q.NICKNAMES:
        nick.setdefault(f, set()).add(a)
    pairs = {(r["left_id"], r["right_id"]) for r in q.people_of_equal_names(spark, SF).collect()}
    by_last = {}
    for r in people:
        by_last.setdefault(r["last"], []).append(r)
    want = {(a["id"], b["id"]) for rows in by_last.values() for a in rows for b in rows if a["is_subject"] and not b["is_subject"] and brute_people(full(a), full(b), nick)}
    assert pairs == want and want
    found = {r["id"]: (r["entity_id"], r["alias"]) for r in q.only_politician_of_name(spark, SF).collect()}
    pols = {}
    for r in q._lettered(spark, SF, "supplier", "s_suppkey", "s_nationkey").collect():
        pols[r["id"]] = (f"{r['last']}, {r['first']}", sorted({f"{r['last']}, {r['first']}{r['middle']}".upper(), f"{r['first']} {r['last']}" + (" (D)" if r["id"] % 2 == 0 else "")}))
    some = lambda e, f: any(brute_people(western(x), western(y), nick) for x in pols[e][1] for y in pols[f][1])
    want = {}
    for r in people:
        name = f"{r['first'][0]}.{r['middle']} {r['last']}"
        hits = sorted((pols[e][0], e, next(a for a in pols[e][1] if brute_people(western(a), name, nick))) for e in pols if any(brute_people(western(a), name, nick) for a in pols[e][1]))
        if hits and all(some(hits[0][1], e) for _, e, _ in hits[1:]):
            want[r["id"]] = (hits[0][1], hits[0][2])
    assert found == want and want


def brute_people(x, y, families):
    """brute_equal with all switches and other nicknames."""
    global NICKS
    before, NICKS = NICKS, [(n, {"john": "William", "ann": "Ted"}[f]) for f, ns in families.items() for n in ns]
    try:
        return brute_equal(x, y, Switches())
    finally:
        NICKS = before
