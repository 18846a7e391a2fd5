"""Fuzzy matching of names: block by a cheap key, score, keep all ties at the top."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import names, text

THRESHOLD = 1.2
#: What stands between the names of running mates.
MATES = r"\s*[/&]\s*"
#: Confidence of the ways in which organisation names agree.
ORG_SCORES = {"kernel": 4.0, "name": 3.0, "expanded": 3.0, "prefix": 2.0}


def _parsed(d: DataFrame, p: str) -> DataFrame:
    """Columns prefixed; the parsed name as the prefix itself, and _last of those that have a last name."""
    rest = [F.col(c).alias(f"{p}_{c}") for c in d.columns if c not in ("id", "name")]
    return d.select(F.col("id").alias(f"{p}_id"), names.person(F.col("name")).alias(p), *rest).withColumn("_last", F.col(f"{p}.last")).filter("_last is not null")


def match_people(subjects: DataFrame, targets: DataFrame, nicknames: DataFrame | None = None, threshold: float = THRESHOLD, keep_unmatched: bool = False, on: tuple[str, ...] = (), metadata: Column | None = None) -> DataFrame:
    """Columns subject_id, match_id, confidence. subjects and targets: id, name. nicknames: name, family, distinct pairs.

    Both sides are parsed once, before they are joined on the last name and on the columns of `on`, which both sides have. Confidence -1 and no match_id stand for a
    subject without a match. metadata: an expression over subject_x and match_x of further columns x; it comes as metadata_confidence and does not choose among matches.
    """
    s, m = _parsed(subjects, "subject"), _parsed(targets, "match")
    if nicknames is not None:
        family = nicknames.groupBy("name").agg(F.collect_set("family").alias("_f"))
        for side in ("subject", "match"):
            own = family.select(F.col("name").alias(f"_n_{side}"), F.col("_f").alias(f"_f_{side}"))
            d = s if side == "subject" else m
            d = d.join(F.broadcast(own), d[f"{side}.first"] == own[f"_n_{side}"], "left").drop(f"_n_{side}")
            s, m = (d, m) if side == "subject" else (s, d)
        nick = F.coalesce(F.arrays_overlap("_f_subject", "_f_match"), F.lit(False))
    else:
        nick = F.lit(False)
    for c in on:
        s, m = s.withColumn(f"_on_{c}", F.col(f"subject_{c}")), m.withColumn(f"_on_{c}", F.col(f"match_{c}"))
    extra = [] if metadata is None else [metadata.cast("double").alias("metadata_confidence")]
    pairs = s.join(m, ["_last", *[f"_on_{c}" for c in on]])
    scored = pairs.select("subject_id", "match_id", names.person_score(F.col("subject"), F.col("match"), nick).alias("confidence"), *extra).filter(F.col("confidence") >= threshold)
    best = scored.withColumn("_r", F.rank().over(Window.partitionBy("subject_id").orderBy(F.desc("confidence")))).filter("_r = 1").drop("_r")
    if not keep_unmatched:
        return best
    none = subjects.select(F.col("id").alias("subject_id")).join(best.select("subject_id").distinct(), "subject_id", "left_anti")
    return best.unionByName(none.select("subject_id", F.lit(None).cast(best.schema["match_id"].dataType).alias("match_id"), F.lit(-1.0).alias("confidence")), allowMissingColumns=True)


def match_politicians(subjects: DataFrame, targets: DataFrame, nicknames: DataFrame | None = None) -> DataFrame:
    """Columns subject_id, match_id, confidence, by last name, cycle, state and district held.

    subjects: id, name, cycle, state, district (a number or empty). targets: id, name, cycle, state, district (as `CA-07`; null, empty or `_` for none), a row for each cycle.
    Each running mate of a target counts, the best of them; subjects that are running mates are left out.
    """
    held = F.coalesce("district", F.lit(""))
    s = subjects.filter(~F.rlike("name", F.lit(MATES))).withColumn("district", F.when(held == "", "").otherwise(F.concat("state", F.lit("-"), F.lpad("district", 2, "0"))))
    t = targets.withColumn("district", F.when(held == "_", "").otherwise(held)).withColumn("name", F.explode(F.split("name", MATES)))
    return match_people(s, t, nicknames, on=("cycle", "state", "district")).distinct()


#: Seats of the chambers of earmarks' members.
CHAMBERS = {"s": "federal:senate", "h": "federal:house"}


def match_members(members: DataFrame, earmarks: DataFrame, politicians: DataFrame) -> DataFrame:
    """Columns id, match_id, outcome (matched, none, many): the only politician of a member's name, seat, party and state.

    members: id, name, chamber, party, state. earmarks: name, chamber, states (`CA; NV`). politicians: id, first, last (lower case), party, state, seat, a row for each alias.
    What a member does not state is not asked for. Without a state, or if none is found in it, all states of the earmarks of that name and chamber are tried.
    """
    said = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(""))
    states = earmarks.select("name", "chamber", F.explode(F.split("states", ";")).alias("_s")).select("name", "chamber", F.trim("_s").alias("_s")).filter("length(_s) = 2")
    possible = states.groupBy("name", "chamber").agg(F.collect_set("_s").alias("_possible"))
    seat = F.create_map(*[F.lit(x) for kv in CHAMBERS.items() for x in kv])[F.col("chamber")]
    m = members.join(possible, ["name", "chamber"], "left").select("id", names.person(F.col("name")).alias("_n"), seat.alias("_seat"), said("party").alias("_party"), said("state").alias("_state"), "_possible")
    p = politicians.select(F.col("id").alias("_pid"), *[F.col(c).alias(f"p_{c}") for c in ("first", "last", "party", "state", "seat")])
    same = (F.col("_n.last") == F.col("p_last")) & (F.col("_n.first").isNull() | (F.col("_n.first") == F.col("p_first")))
    same = same & (F.col("_seat").isNull() | (F.col("_seat") == F.col("p_seat"))) & ((F.col("_party") == "") | (F.col("_party") == F.col("p_party")))
    first, second = F.when(F.col("_state") == F.col("p_state"), F.col("_pid")), F.when(F.array_contains("_possible", F.col("p_state")), F.col("_pid"))
    g = m.join(p, same, "left").groupBy("id").agg(
        F.countDistinct(first).alias("n1"), F.min(first).alias("m1"), F.countDistinct(second).alias("n2"), F.min(second).alias("m2"),
    )
    n, match = F.when(F.col("n1") > 0, F.col("n1")).otherwise(F.col("n2")), F.when(F.col("n1") > 0, F.col("m1")).otherwise(F.col("m2"))
    return g.select("id", F.when(n == 1, match).alias("match_id"), F.when(n == 1, "matched").when(n == 0, "none").otherwise("many").alias("outcome"))


def org_keys(name: Column) -> dict[str, Column]:
    """Keys by which two organisations may agree, surest first."""
    plain = text.basic_normal(name)
    kernel = F.trim(text.standard_orgname(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}]+", " "))))
    return {"kernel": kernel, "name": F.trim(F.lower(name)), "expanded": plain, "prefix": F.left(plain, F.lit(12))}


def match_organizations(subjects: DataFrame, targets: DataFrame) -> DataFrame:
    """Columns subject_id, match_id, tier, confidence: of the surest way in which names agree as wholes, all matches. Names inside longer ones: cascade_organizations.

    Each way is an equality join on its key, together one join on (way, key).
    """
    ways = list(ORG_SCORES)

    def keyed(d: DataFrame, p: str) -> DataFrame:
        keys = org_keys(F.col("name"))
        rows = F.explode(F.array(*[F.struct(F.lit(i).alias("tier"), keys[w].alias("key")) for i, w in enumerate(ways)]))
        return d.select(F.col("id").alias(f"{p}_id"), rows.alias("_k")).select(f"{p}_id", "_k.tier", "_k.key").filter("length(key) > 2")

    hits = keyed(subjects, "subject").join(keyed(targets, "match").hint("merge"), ["tier", "key"]).groupBy("subject_id", "match_id").agg(F.min("tier").alias("tier"))
    surest = hits.groupBy("subject_id").agg(F.min("tier").alias("_best"))
    score = F.element_at(F.array(*[F.lit(ORG_SCORES[w]) for w in ways]), F.col("tier") + 1)
    return hits.join(surest, "subject_id").filter("tier = _best").select("subject_id", "match_id", F.element_at(F.array(*[F.lit(w) for w in ways]), F.col("tier") + 1).alias("tier"), score.alias("confidence"))


#: Ways of the cascade, in order: which text of the subject the target's name holds, and how.
CASCADE = ("kernel", "name", "expanded", "words", "firm")
#: Abbreviations in names of organisations, and words that say little.
ABBREVIATIONS = {
    "acad": "academy", "assn": "association", "assns": "associations", "assoc": "association", "cmte": "committee", "co": "company", "cos": "companies", "colg": "college",
    "corp": "corporation", "dept": "department", "fdn": "foundation", "inc": "incorporated", "inst": "institute", "intl": "international", "ltd": "limited", "natl": "national",
    "univ": "university",
}
FILLERS = ("the", "and", "of", "in", "for", "group", "llc")


def org_texts(name: Column) -> dict[str, Column]:
    """Lower case: low (as it stands), expanded (no marks, abbreviations in full), kernel (expanded without company words and fillers), firm (first two words of the kernel)."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), r"[/\\\s]+", " "), "[,.*:;+]+", "")
    full = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    words = F.transform(F.filter(F.split(bare, " "), lambda w: w != ""), lambda w: F.coalesce(full[w], w))
    kernel = F.filter(words, lambda w: ~w.isin(*FILLERS, *ABBREVIATIONS.values()))
    return {"low": F.trim(F.lower(name)), "expanded": F.array_join(words, " "), "kernel": F.array_join(kernel, " "), "firm": F.array_join(F.slice(kernel, 1, 2), ", ")}


#: Runs of g characters of each of an array of texts.
_GRAMS = "array_distinct(flatten(transform({parts}, p -> if(length(p) >= {g}, transform(sequence(1, length(p) - {g} + 1), i -> substring(p, i, {g})), cast(array() as array<string>)))))"


#: Lengths of the runs by which candidates are looked for. Runs of three alone are too few in kind: of names that are told apart by numbers or codes each is in a share of all, so pairs would grow with the square.
GRAMS = (1, 2, 3, 6)


def organization_pairs(keys: DataFrame, targets: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Columns of `on`, subject_id, tier, key, match_id: the targets (match_id, match_low) that may contain all parts of a key, by the run of it that the fewest of them have.

    keys: subject_id, tier, key, parts. Only targets with equal columns of `on` count, which both have.
    """
    longest = F.array_max(F.transform("parts", F.length))
    g = F.array_max(F.filter(F.array(*[F.lit(x) for x in GRAMS]), lambda x: x <= longest))
    wanted = keys.withColumn("g", g).select(*on, "subject_id", "tier", "key", F.explode(F.expr(_GRAMS.format(parts="parts", g="g"))).alias("gram"))
    own = F.explode(F.flatten(F.array(*[F.expr(_GRAMS.format(parts="array(match_low)", g=x)) for x in GRAMS])))  # of different lengths, so distinct
    posted = targets.select(*on, "match_id", own.alias("gram"))
    often = posted.groupBy(*on, "gram").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    rarest = wanted.join(often.hint("merge"), [*on, "gram"], "left").groupBy(*on, "subject_id", "tier", "key").agg(F.min(F.struct(n.alias("n"), "gram")).alias("_g")).filter("_g.n > 0").select(*on, "subject_id", "tier", "key", "_g.gram")
    return rarest.join(posted.hint("merge"), [*on, "gram"]).drop("gram")


def organization_candidates(subjects: DataFrame, targets: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Columns subject_id, match_id, tier, confidence, and of `on`: all targets that the first way of CASCADE with any result finds for a subject (id, name; ids distinct).

    on: columns of both sides that must be equal; ids are then distinct within these.

    kernel, name, expanded: the target's name contains that text of the subject; words: the kernel's words follow one another in it with anything between; firm: it
    begins with the first two. Joins are by sorted shuffles: exploded rows would else pass for few and be brought to the driver to be broadcast. An empty text finds nothing. A text that is contained has all its runs of six characters in the target (shorter texts: runs of three, two or
    one), so candidates come by the one that the fewest targets have and are then verified. Confidence: 4 for equal expanded names, 3 for equal kernels or for `a, b et al`
    of a list of partners, else 2.
    """
    dealt = int(subjects.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # names are a small file whose runs are many rows: dealt first, so that no single task makes them
    texts = lambda d, p: d.select("id", "name", *on).repartition(dealt, *on, "id").select(*on, F.col("id").alias(f"{p}_id"), *[c.alias(f"{p}_{n}") for n, c in org_texts(F.col("name")).items()])
    s, m = texts(subjects, "subject"), texts(targets, "match")
    of = {"kernel": "subject_kernel", "name": "subject_low", "expanded": "subject_expanded", "words": "subject_kernel", "firm": "subject_firm"}
    ways = F.array(*[F.struct(F.lit(i).alias("tier"), F.col(of[w]).alias("key"), (F.split(of[w], " ") if w == "words" else F.array(of[w])).alias("parts")) for i, w in enumerate(CASCADE)])
    keys = s.select(*on, "subject_id", F.inline(ways)).filter("key <> ''")
    pairs = organization_pairs(keys, m.select(*on, "match_id", "match_low"), on).join(m.hint("merge"), [*on, "match_id"])
    words = F.concat(F.lit(r"(?s)\Q"), F.replace("key", F.lit(" "), F.lit(r"\E.*\Q")), F.lit(r"\E"))
    way = lambda name: F.col("tier") == CASCADE.index(name)
    found = pairs.filter(F.when(way("words"), F.rlike("match_low", words)).when(way("firm"), F.startswith("match_low", "key")).otherwise(F.contains("match_low", "key")))
    first = found.withColumn("_first", F.min("tier").over(Window.partitionBy(*on, "subject_id"))).filter("tier = _first").join(s.hint("merge"), [*on, "subject_id"])
    partners = F.contains("subject_low", F.lit(",")) & (F.concat("subject_firm", F.lit(", et al")) == F.col("match_low"))
    score = F.when(F.col("match_expanded") == F.col("subject_expanded"), 4.0).when((F.col("match_kernel") == F.col("subject_kernel")) | partners, 3.0).otherwise(2.0)
    return first.select("subject_id", "match_id", F.element_at(F.array(*[F.lit(w) for w in CASCADE]), F.col("tier") + 1).alias("tier"), score.alias("confidence"), *on)


def cascade_organizations(subjects: DataFrame, targets: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Of organization_candidates all at a subject's highest confidence."""
    return organization_candidates(subjects, targets, on).withColumn("_r", F.rank().over(Window.partitionBy(*on, "subject_id").orderBy(F.desc("confidence")))).filter("_r = 1").drop("_r")


#: Lower and upper limit of confidence of each kind that is reconciled.
LIMITS = {"individual": (1.2, 3.0), "politician": (1.0, 2.0), "organization": (1.0, 4.0)}


#: Seats of the offices that a request may name, and the first cycle that narrowed politicians must have been in since.
OFFICES = {"US House": "federal:house", "US Senate": "federal:senate", "President": "federal:president"}
SINCE = 2010


def requests(bodies: DataFrame) -> DataFrame:
    """Columns id (request, key), name, kind, seat, narrow: the queries of reconciliation requests, for reconcile().

    bodies: request, query (JSON text of one query), queries (of an object of queries by key; not read where there is query, whose key is null). A query has the name as query, a type, and
    properties as a list of pid and v, of which the last of a pid counts. Without a type the property contributionType tells it by how it begins; whatever is neither individual nor
    politician is an organization. narrow: the query has properties. seat: of the property office; `?` for an office that is none, which no politician has. Text that is no JSON gives no
    query, nor does one without a name.
    """
    one = "struct<query: string, type: string, properties: array<struct<pid: string, v: string>>>"
    alone, several = F.from_json("query", one), F.from_json("queries", f"map<string, {one}>")
    asked = F.when(F.col("query").isNotNull() & (F.col("query") != ""), F.array(F.struct(F.lit(None).cast("string").alias("key"), alone.alias("value")))).otherwise(F.map_entries(several))
    d = bodies.select("request", F.explode(asked).alias("_q")).select("request", "_q.key", "_q.value.*").filter("query is not null")
    last = lambda pid: F.element_at(F.transform(F.filter("properties", lambda x: x["pid"] == pid), lambda x: x["v"]), -1)
    said = lambda pid: F.when(F.size(F.filter("properties", lambda x: x["pid"] == pid)) > 0, last(pid))
    hint, office = F.lower(said("contributionType")), F.nullif(said("office"), F.lit(""))
    kind = F.when(F.col("type").isin("individual", "politician"), F.col("type")).when(F.col("type").isNotNull(), "organization").when(F.startswith(hint, F.lit("individual")), "individual").when(F.startswith(hint, F.lit("politician")), "politician").otherwise("organization")
    seat = F.when(office.isNotNull(), F.coalesce(F.create_map(*[F.lit(x) for kv in OFFICES.items() for x in kv])[office], F.lit("?")))
    return d.select(F.struct("request", "key").alias("id"), F.col("query").alias("name"), kind.alias("kind"), seat.alias("seat"), F.coalesce(F.size("properties") > 0, F.lit(False)).alias("narrow"))


def reconcile(queries: DataFrame, targets: DataFrame, limits: dict[str, tuple[float, float]] | None = None, held: DataFrame | None = None) -> DataFrame:
    """Columns query_id, match_id, confidence, match: the two best levels of confidence for each query (id, name, kind: individual, politician or organization).

    held: entity_id, cycle, seat of politicians. With it a query that is to narrow (columns seat, narrow, as of requests()) meets only politicians who held its seat in any cycle, if it names
    one, and who were there in 2010 or later.

    match is true where the confidence is at the kind's upper limit or over, however many are as good; under the lower limit nothing is returned. Running mates
    are no single politician and are left out on both sides.
    """
    limits = {**LIMITS, **(limits or {})}
    pick = lambda d, kind, *more: d.filter(F.col("kind") == kind).select("id", "name", *more)
    single = lambda d: d.filter(~F.rlike("name", F.lit(MATES)))
    asking, politicians, fits = pick(queries, "politician"), pick(targets, "politician"), None
    if held is not None:
        seats = held.groupBy(F.col("entity_id").alias("id")).agg(F.collect_set("seat").alias("seats"), F.max("cycle").alias("latest"))
        asking, politicians = pick(queries, "politician", "seat", "narrow"), politicians.join(seats, "id", "left")
        fits = ~F.col("subject_narrow") | ((F.col("match_latest") >= SINCE) & (F.col("subject_seat").isNull() | F.array_contains("match_seats", F.col("subject_seat"))))
    found = [
        match_people_all(pick(queries, "individual"), pick(targets, "individual"), limits["individual"][0]),
        match_people_all(single(asking), single(politicians), limits["politician"][0], fits),
        organization_candidates(pick(queries, "organization"), pick(targets, "organization")).select("subject_id", "match_id", "confidence").filter(F.col("confidence") >= limits["organization"][0]),
    ]
    kinds = [f.withColumn("_sure", F.lit(limits[k][1])).withColumn("kind", F.lit(k)) for k, f in zip(("individual", "politician", "organization"), found, strict=True)]
    ranks = F.dense_rank().over(Window.partitionBy("kind", "subject_id").orderBy(F.desc("confidence")))
    both = reduce(DataFrame.unionByName, kinds).withColumn("_r", ranks).filter("_r <= 2")
    return both.select(F.col("subject_id").alias("query_id"), "match_id", "confidence", (F.col("confidence") >= F.col("_sure")).alias("match"))


def match_people_all(subjects: DataFrame, targets: DataFrame, threshold: float, where: Column | None = None) -> DataFrame:
    """All pairs over a threshold, not only the best. where: what else must hold, over subject_x and match_x of further columns x; null counts as false."""
    pairs = _parsed(subjects, "subject").join(_parsed(targets, "match").hint("merge"), "_last")
    pairs = pairs if where is None else pairs.filter(where)
    return pairs.select("subject_id", "match_id", names.person_score(F.col("subject"), F.col("match"), F.lit(False)).alias("confidence")).filter(F.col("confidence") >= threshold)
