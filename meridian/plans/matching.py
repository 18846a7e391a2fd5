"""The match commands: which records are matched with which entities, and how; their tables of matches, statistics, attributes and the clean-up.

Tables: one for each command's subjects (columns as Command says), entity (id, name, type), attribute (entity_id, namespace, value), politician_state (entity_id, cycle, state, seat,
district), lobbyist_links and registrant_links (entity_id), lobbyist_id (ext_id, year), manual_bundler (name), giver_by_state (id, name, state, employer, occupation), candidate_metadata
(id, name), relative (id, raw_name), nickname (name, family).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import names
from meridian.operators import fuzzy
from meridian.operators.matching import THRESHOLD, best_by_given_names, best_people
from meridian.operators.ranking import checkpointed

Tables = Mapping[str, DataFrame]
#: What is cut from officers' names before they are read.
OFFICER = ((r" CBO$", ""), (r" PE C$", ""), (r" M$", ""), (r", M\.?D\.?$", ""))
#: Visitors: a suffix at the end goes, a title that is written together with the name is set apart.
VISITOR = ((r"(?i)[, ]+(jr|sr|ii|iii|iv)\.?$", ""), (r"^DR(?=[BCDFGHJKLMNPQRSTVWXZ])", "DR "))
#: States and territories by name.
STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "Florida": "FL", "Georgia": "GA",
    "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD",
    "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH",
    "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA",
    "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA",
    "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY", "American Samoa": "AS", "District of Columbia": "DC", "Federated States of Micronesia": "FM", "Guam": "GU",
    "Marshall Islands": "MH", "Northern Mariana Islands": "MP", "Palau": "PW", "Puerto Rico": "PR", "Virgin Islands": "VI",
}
CONTRACTOR = "urn:pogo:contractor"


@dataclass(frozen=True)
class Command:
    """kind: person, given (first and last names alone), politician (by seat), organization. name: the subjects' column. on: columns that must agree too."""

    subjects: str
    targets: str
    prefix: str
    kind: str = "person"
    name: str = "name"
    starts: bool = False
    clean: tuple[tuple[str, str], ...] = ()
    on: tuple[str, ...] = ()
    threshold: float = THRESHOLD
    where: str = "true"
    by_manual: bool = False  # names that were matched by hand are left out


def _organizations(subjects: str, prefix: str, **more) -> Command:
    return Command(subjects, more.pop("targets", "organizations"), prefix, "organization", **more)


COMMANDS = {
    "alec_sponsors": Command("alec_sponsor", "state_politicians", "alec", "given", on=("state",), threshold=1.0),
    "consumer_groups": _organizations("consumer_group", "cnsmr_grp"),
    "dc_candidates": Command("dc_candidate", "candidate_metadata", "dc_meta", name="candidate"),
    "faca_lobbyists": Command("faca_member", "lobbyists", "faca_lob", starts=True),
    "fortune_100": _organizations("fortune_company", "ftn_100"),
    "honorarium_registrants": _organizations("honorarium_registrant", "ks"),
    "lobbyist_bundlers__employers": _organizations("lobbyist_bundle", "bundler_employer", name="employer", targets="registrants", where="employer is not null", by_manual=True),
    "lobbyist_bundlers__individuals": Command("lobbyist_bundle", "individual_lobbyists", "bundler_indiv", where="not (name <=> employer)", by_manual=True),
    "local_election_officials": Command("local_election_official", "givers_by_state", "leo", on=("state",)),
    "mocs_with_historical_bioguide_ids": Command("member_of_congress", "federal_politicians", "bioguide_historical", "politician", threshold=1.1),
    "officers": Command("officer", "politicians", "matching", clean=OFFICER),
    "pogo_contractors": _organizations("contractor", "matching_pogo"),
    "publically_traded_orgs": _organizations("public_company", "public_orgs_"),
    "relatives": Command("officer", "relatives", "guidestar_relatives", clean=OFFICER),
    "staffers_with_lobbyists": Command("hill_staffer", "lobbyists_2009_2011_by_short_id", "staffers", starts=True),
    "superpac_donors_to_lobbyists": Command("superpac_donor", "lobbyists_2008_2012", "superpac", starts=True),
    "usnews_top_200_unis": _organizations("university", "top_200_unis", clean=(("--.*$", ""),)),
    "whitehouse_visitors_vs_lobbyists": Command("whitehouse_visitor", "lobbyists_2009_2011", "whitehouse", starts=True, clean=VISITOR),
}


def _typed(t: Tables, kind: str | None = None) -> DataFrame:
    e = t["entity"].filter(F.col("type") == kind) if kind else t["entity"]
    return e.select("id", "name")


def _among(entities: DataFrame, ids: DataFrame) -> DataFrame:
    return entities.join(ids.select(F.col("entity_id").alias("id")), "id", "left_semi")


def _named(t: Tables, namespace: str) -> DataFrame:
    return t["attribute"].filter(F.col("namespace") == namespace)


def _lobbyists(t: Tables, first: int, last: int, length: int | None = None) -> DataFrame:
    """Entities with an attribute that is a lobbyist's id of those years, or begins as one does."""
    cut = lambda c: F.left(c, F.lit(length)) if length else F.col(c)
    ids = t["lobbyist_id"].filter(F.col("year").between(first, last)).select(cut("ext_id").alias("_id"))
    return _among(_typed(t), t["attribute"].withColumn("_id", cut("value")).join(ids, "_id", "left_semi"))


def _state_politicians(t: Tables) -> DataFrame:
    held = t["politician_state"].filter("lower(seat) like '%state%'").select(F.col("entity_id").alias("id"), "state").distinct()
    return _among(_typed(t, "politician"), _named(t, "urn:nimsp:recipient")).join(held, "id")


def _federal_politicians(t: Tables) -> DataFrame:
    held = t["politician_state"].select(F.col("entity_id").alias("id"), "cycle", "state", "district").distinct()
    return _among(_typed(t, "politician"), _named(t, "urn:crp:recipient")).join(held, "id")


#: The sets that subjects are matched with: id, name and what a command needs besides.
TARGETS: dict[str, Callable[[Tables], DataFrame]] = {
    "organizations": lambda t: _typed(t, "organization"), "politicians": lambda t: _typed(t, "politician"),
    "registrants": lambda t: _among(_typed(t, "organization"), t["registrant_links"]),
    "individual_lobbyists": lambda t: _among(_typed(t, "individual"), t["lobbyist_links"]),
    "lobbyists": lambda t: _among(_among(_typed(t), t["attribute"]), t["lobbyist_links"]),
    "lobbyists_2009_2011": lambda t: _lobbyists(t, 2009, 2011), "lobbyists_2008_2012": lambda t: _lobbyists(t, 2008, 2012), "lobbyists_2009_2011_by_short_id": lambda t: _lobbyists(t, 2009, 2011, 11),
    "state_politicians": _state_politicians, "federal_politicians": _federal_politicians,
    "candidate_metadata": lambda t: t["candidate_metadata"].select("id", "name"), "relatives": lambda t: t["relative"].select("id", F.col("raw_name").alias("name")),
    "givers_by_state": lambda t: t["giver_by_state"].select("id", "name", "state", "employer", "occupation"),
}


def subjects(t: Tables, command: str) -> DataFrame:
    """A command's subjects: id, name as it is matched, raw_name and their other columns."""
    c = COMMANDS[command]
    d = t[c.subjects].filter(c.where)
    if c.by_manual:
        d = d.join(t["manual_bundler"].select(F.col("name").alias(c.name)), c.name, "left_anti")
    name = F.col(c.name)
    for pattern, into in c.clean:
        name = F.regexp_replace(name, pattern, into)
    return d.select("id", name.alias("name"), F.col(c.name).alias("raw_name"), *[x for x in c.on if x in d.columns], *[x for x in ("cycle", "state", "district") if x in d.columns and c.kind == "politician"])


def office_confidence(employer: Column, occupation: Column) -> Column:
    """1 if a giver's employer or occupation speaks of elections or clerks, 0.5 if of a town, city or county."""
    job = F.concat_ws(" ", F.coalesce(employer, F.lit("")), F.coalesce(occupation, F.lit("")))
    return F.when(F.rlike(job, F.lit("(?i)electio|clerk")) | F.contains(job, F.lit("BOE")), 1.0).when(F.rlike(job, F.lit("(?i)town|cty|county|city")), 0.5).otherwise(0.0)


def _sides(t: Tables, command: str) -> tuple[DataFrame, DataFrame]:
    """A command's subjects and targets: id, name, set (the targets' name), also (what must agree besides, as one text), and the command's rules or the targets' jobs.

    Running mates count each by itself as politicians to match, and not at all as subjects.
    """
    c = COMMANDS[command]
    s, m = subjects(t, command), TARGETS[c.targets](t)
    if c.kind != "organization":
        s = s.filter(~F.coalesce(F.rlike("name", F.lit(fuzzy.MATES)), F.lit(False)))
    if c.targets == "givers_by_state":
        s = s.withColumn("state", F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[F.col("state")])
    if c.kind == "politician":
        number = F.coalesce("district", F.lit(""))
        s = s.withColumn("district", F.when(number == "", "").otherwise(F.concat("state", F.lit("-"), F.lpad(number, 2, "0"))))
        m = m.withColumn("district", F.when(number == "_", "").otherwise(number)).withColumn("name", F.explode(F.split("name", fuzzy.MATES)))
    on = ("cycle", "state", "district") if c.kind == "politician" else c.on
    also = F.concat(F.lit(""), *[x for o in on for x in (F.col(o).cast("string"), F.lit("|"))]).alias("also")  # null where one is null
    job = [F.col(x) if x in m.columns else F.lit(None).cast("string").alias(x) for x in ("employer", "occupation")]
    of = F.struct(F.lit(command).alias("command"), F.col("id").cast("string").alias("id")).alias("id")
    s = s.select(of, "name", F.lit(c.targets).alias("set"), also, F.lit(c.threshold).alias("threshold"), F.lit(c.starts).alias("starts"))
    return s, m.select(F.col("id").cast("string").alias("id"), "name", F.lit(c.targets).alias("set"), also, *job)


def matches(t: Tables, commands: Iterable[str], keep_unmatched: bool = False) -> DataFrame:
    """Columns command, subject_id, match_id (as text), confidence, metadata_confidence: of each subject all matches at its highest confidence.

    Commands of a kind are one job: subjects and targets carry the name of their set, which is joined on. With keep_unmatched a subject that has no match comes with confidence -1, also one whose name
    can't be read (those the match commands pass over). Running mates are no subjects and don't come at all.
    """
    commands = list(commands)
    kinds = {k: [n for n in commands if COMMANDS[n].kind in k] for k in (("person", "politician"), ("given",), ("organization",))}
    out, every = [], []
    for kind, alike in kinds.items():
        if not alike:
            continue
        sides = [_sides(t, n) for n in alike]
        s = reduce(DataFrame.unionByName, [x for x, _ in sides])
        m = reduce(DataFrame.unionByName, {COMMANDS[n].targets: y for n, (_, y) in zip(alike, sides, strict=True)}.values())
        if kind == ("organization",):
            alike_names = s.select(F.col("name").alias("id"), "name", "set").distinct()  # commands share subjects: a name is looked for once
            found = fuzzy.cascade_organizations(alike_names, m.select("id", "name", "set"), ("set",)).withColumnRenamed("subject_id", "name")
            found = s.select(F.col("id").alias("subject_id"), "name", "set").join(found.hint("merge"), ["name", "set"]).select("subject_id", "match_id", "confidence", F.lit(0.0).alias("metadata_confidence"))
        elif kind == ("given",):
            found = best_by_given_names(s, m, ("set", "also"))
        else:
            office = office_confidence(F.col("match_employer"), F.col("match_occupation"))
            found = best_people(s, m, t["nickname"], F.col("subject_threshold"), F.col("subject_starts"), ("set", "also"), office, min(COMMANDS[n].threshold for n in alike))
        out.append(found)
        every.append(s.select(F.col("id").alias("subject_id")))
    found = reduce(DataFrame.unionByName, out)
    if keep_unmatched:
        found = checkpointed(found)  # read twice
        none = reduce(DataFrame.unionByName, every).distinct().join(found.select("subject_id").distinct().hint("merge"), "subject_id", "left_anti")
        found = found.unionByName(none.select("subject_id", F.lit(None).cast("string").alias("match_id"), F.lit(-1.0).alias("confidence"), F.lit(None).cast("double").alias("metadata_confidence")))
    return found.select("subject_id.command", F.col("subject_id.id").alias("subject_id"), "match_id", "confidence", "metadata_confidence")


def statistics(found: DataFrame, every: DataFrame) -> DataFrame:
    """Columns command, measure, confidence, n: subjects; several (those with more than one match); average (matches of these, rounded); confidence (rows of each confidence).

    found: matches(); every: command, id of all subjects. A command without subjects has no rows; without a subject of several matches average is null.
    """
    none = F.lit(None).cast("double")
    total = every.groupBy("command").agg(F.count("*").alias("n")).select("command", F.lit("subjects").alias("measure"), none.alias("confidence"), "n")
    many = found.groupBy("command", "subject_id").agg(F.count("*").alias("k")).groupBy("command").agg(F.count(F.when(F.col("k") > 1, 1)).alias("several"), F.round(F.avg(F.when(F.col("k") > 1, F.col("k")))).cast("long").alias("average"))
    both = many.select("command", F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), none.alias("confidence"), F.col(c).alias("n")) for c in ("several", "average")])))
    spread = found.groupBy("command", "confidence").agg(F.count("*").alias("n")).select("command", F.lit("confidence").alias("measure"), "confidence", "n")
    return total.unionByName(both).unionByName(spread)


def with_contractors(attribute: DataFrame, found: DataFrame) -> DataFrame:
    """attribute with the contractor that each organization was matched with, in place of what it had; of several contractors the one with the greatest number."""
    new = found.filter("command = 'pogo_contractors' and match_id is not null").groupBy("match_id").agg(F.max(F.col("subject_id").cast("long")).cast("string").alias("value"))
    new = new.select(F.col("match_id").cast(attribute.schema["entity_id"].dataType).alias("entity_id"), F.lit(CONTRACTOR).alias("namespace"), "value")
    return attribute.join(new.select("entity_id", "namespace"), ["entity_id", "namespace"], "left_anti").select("entity_id", "namespace", "value").unionByName(new)


def save(found: DataFrame, command: str, root: str, when: str) -> str:
    """A command's matches as a table of its own: prefix, `matches` and the time (as 20240131_0930). One that is there already is an error, as two runs in one minute are."""
    at = f"{root}/{COMMANDS[command].prefix}_matches_{when}"
    found.filter(F.col("command") == command).drop("command").write.mode("error").parquet(at)
    return at


def clean_up(spark: SparkSession, root: str, prefix: str) -> list[str]:
    """Deletes all tables of a prefix but the last by name; gives the names of those deleted. With one table or none nothing happens."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    tables = sorted((s.getPath() for s in fs.listStatus(folder) if s.isDirectory() and s.getPath().getName().lower().startswith(f"{prefix.lower()}_")), key=lambda p: p.getName())
    for path in tables[:-1]:
        fs.delete(path, True)
    return [p.getName() for p in tables[:-1]]


def evaluated(pairs: DataFrame) -> DataFrame:
    """pairs (name_x, name_y and others) with name_confidence, for matches that someone made elsewhere."""
    d = pairs.withColumns({"_x": names.person(F.col("name_x")), "_y": names.person(F.col("name_y"))})
    return d.withColumn("name_confidence", names.evaluated_score(F.col("_x"), F.col("_y"))).drop("_x", "_y")
