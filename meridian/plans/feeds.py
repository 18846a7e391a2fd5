"""Feeds to canonical records: campaign, state, lobbying, earmarks, spending. Dictionary look-ups of the feeds are joins to small tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions import cleaning as cl
from meridian.functions import text
from meridian.functions.cycles import cycle_or

# Texts in the organisation field that are occupations or none, in lower case.
NOT_ORGANIZATIONS = (
    "retired", "homemaker", "attorney", "[24i contribution]", "self-employed", "physician", "self", "information requested", "self employed", "[24t contribution]",
    "consultant", "investor", "[candidate contribution]", "n/a", "farmer", "real estate", "none", "writer", "dentist", "info requested", "business owner", "accountant",
    "artist", "rancher", "student", "realtor", "investments", "real estate developer", "unemployed", "requested", "owner", "developer", "businessman", "contractor",
    "president", "engineer", "n", "psychologist", "real estate broker", "executive", "private investor", "architect", "sales", "real estate investor", "selfemployed",
    "philanthropist", "not employed", "author", "builder", "insurance agent", "volunteer", "construction", "insurance", "entrepreneur", "lobbyist", "ceo", "n.a", "actor",
    "photographer", "musician", "interior designer", "restaurant owner", "teacher", "designer", "surgeon", "social worker", "veterinarian", "psychiatrist", "chiropractor",
    "auto dealer", "small business owner", "optometrist", "producer", "business", ".information requested", "financial advisor", "pharmacist", "psychotherapist",
    "manager", "management consultant", "general contractor", "finance", "orthodontist", "actress", "n.a.", "restauranteur", "property management", "home builder", "oil & gas",
    "real estate investments", "geologist", "professor", "farming", "real estate agent", "na", "financial planner", "community volunteer", "property manager", "political consultant",
    "public relations", "business consultant", "publisher", "insurance broker", "educator", "nurse", "orthopedic surgeon", "editor", "marketing", "dairy farmer", "investment advisor",
    "freelance writer", "investment banker", "trader", "computer consultant", "banker", "oral surgeon", "business executive", "unknown", "civic volunteer", "filmmaker", "economist",
)
RECIPIENT = ("name", "party", "type", "category", "ext_id", "seat_status", "seat_result", "seat", "state", "district", "seat_held", "state_held", "district_held")


def organization_name(name: Column) -> Column:
    """Trimmed; empty for an occupation."""
    bare = F.trim(F.coalesce(name, F.lit("")))
    return F.when(F.lower(bare).isin(*NOT_ORGANIZATIONS), "").otherwise(bare)


def _candidate(category: Column) -> Column:
    """A recipient struct of the joined candidate (columns cand_…)."""
    c = lambda f: F.col(f"cand_{f}")
    fec, run, held = cl.fec_seat(c("fec_cand_id")), cl.race_seat(c("dist_id_run_for")), cl.race_seat(F.trim(c("dist_id_curr")))
    own = F.when((fec["seat"] == "federal:house") & (run["seat"] == "federal:house") & (run["state"] == fec["state"]), run["district"]).otherwise(fec["district"])
    flagged = (F.coalesce(c("curr_cand"), F.lit("")) != "") & (F.coalesce(c("cycle_cand"), F.lit("")) != "")
    blank = lambda x: F.coalesce(x, F.lit(""))
    values = (c("first_last_p"), c("party"), F.lit("P"), blank(category), c("cid"), c("crp_ico"), F.when(flagged, blank(cl.recipient_result(c("recip_code")))).otherwise(""), fec["seat"], fec["state"], own, blank(held["seat"]), blank(held["state"]), blank(held["district"]))
    return F.struct(*[v.alias(n) for n, v in zip(RECIPIENT, values, strict=True)])


def _committee() -> Column:
    c = lambda f: F.col(f"cmte_{f}")
    values = (c("pac_short"), c("party"), F.lit("C"), c("prim_code"), c("cmte_id"), *[F.lit("")] * 8)
    return F.struct(*[v.alias(n) for n, v in zip(RECIPIENT, values, strict=True)])


def with_recipient(rows: DataFrame, committee_id: Column, candidates: DataFrame, committees: DataFrame, candidate_id: Column | None = None) -> DataFrame:
    """Adds the recipient's columns: the candidate of a candidate committee, else the committee; candidate_id names a candidate directly.

    Look-ups are by cycle and id. A record whose committee is unknown has nulls.
    """
    p = lambda d, prefix: d.select(*[F.col(x).alias(f"{prefix}_{x}") for x in d.columns])
    cm = p(committees, "cmte")
    j = rows.join(cm, (rows["cycle"] == cm["cmte_cycle"]) & (F.upper(F.trim(committee_id)) == F.upper(cm["cmte_cmte_id"])), "left")
    of_candidate = (F.col("cmte_cmte_id") != F.col("cmte_recip_id")) & (F.trim("cmte_fec_cand_id") != "")
    wanted = F.when(of_candidate, F.upper(F.trim("cmte_fec_cand_id")))
    if candidate_id is not None:
        wanted = F.coalesce(wanted, F.when(F.col("cmte_cmte_id").isNull(), F.upper(F.trim(candidate_id))))
    j = j.withColumn("_wanted", wanted)
    ca = p(candidates, "cand")
    j = j.join(ca, (j["cycle"] == ca["cand_cycle"]) & (j["_wanted"] == F.upper(ca["cand_fec_cand_id"])), "left")
    r = F.when(F.col("cand_fec_cand_id").isNotNull(), _candidate(F.col("cmte_prim_code"))).when(F.col("cmte_cmte_id").isNotNull(), _committee())
    return j.withColumn("_r", r).select(*rows.columns, *[F.col(f"_r.{n}").alias(f"recipient_{n}" if n in ("name", "party", "type", "category", "ext_id", "state", "state_held") else n) for n in RECIPIENT])


def with_category(rows: DataFrame, codes: DataFrame, field: str = "real_code", prefix: str = "contributor") -> DataFrame:
    """Category of five characters, and its order where the code is known."""
    code = F.upper(F.coalesce(field, F.lit("")))
    known = codes.select(F.upper("catcode").alias("_c"), F.upper("catorder").alias(f"{prefix}_category_order"))
    return rows.withColumn(f"{prefix}_category", F.when(F.length(code) == 5, code)).join(known, F.col(f"{prefix}_category") == F.col("_c"), "left").drop("_c")


def campaign_individuals(rows: DataFrame, candidates: DataFrame, committees: DataFrame, codes: DataFrame) -> DataFrame:
    """Gifts of persons as canonical records."""
    named = committees.select(F.col("cycle").alias("_cy"), F.upper("cmte_id").alias("_cm"), F.col("pac_short").alias("committee_name"), F.col("party").alias("committee_party"))
    j = with_recipient(rows, F.col("recip_id"), candidates, committees)
    j = j.join(named, (F.col("cycle") == F.col("_cy")) & (F.upper("cmte_id") == F.col("_cm")), "left").drop("_cy", "_cm")
    job = cl.occupation_pair(F.col("fec_occ_emp") if "fec_occ_emp" in rows.columns else F.lit(""), F.col("occ_ef"), F.col("emp_ef"))
    return with_category(j, codes).withColumns({
        "organization_name": organization_name(F.col("org_name")), "contributor_type": F.lit("I"), "transaction_namespace": F.lit("urn:fec:transaction"),
        "contributor_occupation": job["occupation"], "contributor_employer": job["employer"], "amount": cl.money(F.col("amount")),
        "date": F.try_to_timestamp("date", F.lit("MM/dd/yyyy")).cast("date"), "committee_name": F.coalesce("committee_name", F.lit("")), "committee_party": F.coalesce("committee_party", F.lit("")),
    })


def direction(rows: DataFrame) -> DataFrame:
    """Group to group: a type that begins with 1 was filed by who got it, with 2 by who gave; a donor's own name goes first."""
    kind = F.left(F.trim("type"), F.lit(1))
    got, gave = kind == "1", kind == "2"
    filer, donor = F.trim("contrib_lend_trans"), F.trim("donor_cmte")
    name = F.when(donor != "", donor).when(got, filer)
    ext = F.when(got, F.col("other_id")).when(gave, F.col("filer_id"))
    return rows.withColumns({
        "contributor_name": name, "organization_name": name, "contributor_ext_id": ext, "organization_ext_id": ext,
        "committee_ext_id": F.when(got, F.col("filer_id")).when(gave, F.col("other_id")), "committee_name": F.when(gave, filer), "contributor_type": F.lit("C"),
    })


def campaign_groups(rows: DataFrame, candidates: DataFrame, committees: DataFrame) -> DataFrame:
    """Gifts of groups to groups and candidates as canonical records."""
    d = direction(rows)
    recipient = F.when(F.left("type", F.lit(1)) == "1", F.col("filer_id")).otherwise(F.col("other_id"))
    direct = F.when((F.left("type", F.lit(1)) != "1") & ~F.startswith(F.upper(F.trim("other_id")), F.lit("C")), F.col("other_id"))
    return with_recipient(d, recipient, candidates, committees, direct).withColumn("amount", cl.money(F.col("amount")))


def state_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State feed as canonical records: those with a category, and those to be allocated. A record with both a candidate and a committee keeps neither."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    cand, cmte = has("candidate_id"), has("committee_id")
    kind = F.when(cand & ~cmte, "P").when(cmte & ~cand, "C")
    out = rows.withColumns({
        "contributor_name": text.best_of(F.col("newcontributor"), F.col("contributor")), "contributor_address": text.best_of(F.col("newaddress"), F.col("address")),
        "contributor_employer": text.best_of(F.col("employer")), "organization_name": text.best_of(F.col("newemployer")),
        "recipient_party": cl.party_of(F.col("recipient_party"), F.col("committee_party")), "district": cl.state_district(F.col("seat_state"), F.col("district")),
        "seat": cl.mapped(F.col("seat"), cl.OFFICES), "seat_result": cl.seat_result(F.col("status")), "candidacy_status": cl.candidacy(F.col("status")),
        "recipient_type": kind, "recipient_ext_id": F.when(kind == "P", F.nullif(F.nullif("unique_candidate_id", F.lit("")), F.lit("0"))).when(kind == "C", F.col("committee_id")),
        "contributor_ext_id": text.best_of(F.col("contributor_id")), "amount": cl.money(F.col("amount")), "date": cl.date_iso(F.col("date")), "cycle": cl.whole(F.col("cycle")),
        "contributor_zipcode": text.zip5(F.col("zipcode")), "transaction_namespace": F.lit("urn:nimsp:transaction"),
    })
    out = out.withColumn("contributor_type", cl.contributor_kind(F.col("contributor_category"), F.col("contributor_name")))
    group = F.col("contributor_type") == "C"
    out = out.withColumn("organization_name", F.when(group, text.best_of(F.col("organization_name"), F.col("contributor_name"))).otherwise(F.col("organization_name")))
    waits = F.coalesce(F.startswith("contributor_category", F.lit("Z2")), F.lit(False))
    return out.filter(~waits), out.filter(waits)


def lobbying(rows: DataFrame, names: dict[str, tuple[str, str]], flags: list[str]) -> DataFrame:
    """names: new field to (standardised, raw); the first that is not empty, trimmed. flags: y is true."""
    return rows.withColumns({**{n: F.trim(text.best_of(F.col(a), F.col(b))) for n, (a, b) in names.items()}, **{f: cl.flag_yes(F.col(f)) for f in flags}})


# --- earmarks


def earmark_recipients(raw: Column) -> Column:
    """Array of names: parts between semicolons; of a text with two universities, its parts that are universities."""
    unis = F.filter(F.transform(F.split(raw, r"(?i)(?:,|;|(?: and ))+"), lambda x: F.trim(x)), lambda x: F.contains(F.lower(x), F.lit("university")))
    plain = F.transform(F.split(F.regexp_replace(raw, ";+$", ""), ";"), lambda x: F.trim(x))
    return F.when(F.coalesce(raw, F.lit("")) == "", F.array().cast("array<string>")).when(raw.rlike("(?is)university.*university"), unis).otherwise(plain)


def earmark_places(cities: Column, states: Column) -> Column:
    """Array of (city, state): pairs where the numbers agree, several cities in one state, one list alone; else all cities, then all states, unpaired."""
    split = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(c, ";"), lambda x: F.trim(x)))
    a, b = split(cities), F.transform(split(states), cl.two_letter_state)
    pair = lambda x, y: F.zip_with(x, y, lambda p, q: F.struct(p.alias("city"), q.alias("state")))
    empty = lambda n: F.array_repeat(F.lit(""), F.size(n))
    none = ~F.exists(a, lambda x: x != "") & ~F.exists(b, lambda x: x != "")
    return (
        F.when(none, F.array().cast("array<struct<city:string,state:string>>")).when(F.size(a) == F.size(b), pair(a, b)).when(F.size(b) == 0, pair(a, empty(a))).when(F.size(a) == 0, pair(empty(b), b))
        .when(F.size(b) == 1, pair(a, F.array_repeat(F.element_at(b, 1), F.size(a)))).otherwise(F.concat(pair(a, empty(a)), pair(empty(b), b)))
    )


# --- spending and election filings


def converted(rows: DataFrame, transforms: dict[str, Column], lengths: dict[str, int]) -> DataFrame:
    """Columns of a spending file by a table of expressions; texts cut to their lengths. An expression that cannot read its value gives null."""
    return rows.select(*[(F.substring(c, 1, lengths[n]) if n in lengths else c).alias(n) for n, c in transforms.items()])


def correction_indicator(value: Column) -> Column:
    first = F.left(value, F.lit(1))
    return F.when((value != "current entry") & first.isin("C", "L"), first).otherwise("")


def fec_filings(rows: DataFrame, cycles: DataFrame, given_cycle: str = "cycle") -> DataFrame:
    """Dates, lower-case types, refunds as negative amounts; only cycles that are loaded. A record without a date has its file's cycle."""
    day = cl.date_mdy(F.col("date"))
    out = rows.withColumns({"cycle": cycle_or(day, F.col(given_cycle)), "amount": cl.refund(F.col("type"), cl.money(F.col("amount"))), "type": F.lower("type"), "date": day})
    return out.join(cycles.select("cycle").distinct(), "cycle", "left_semi")


def race(office: Column, state: Column, district: Column) -> Column:
    """H-NY-07, S-NY or P."""
    return F.when(office == "H", F.concat_ws("-", office, state, district)).when(office == "S", F.concat_ws("-", office, state)).otherwise(office)


def enriched(metadata: DataFrame, passes: list[tuple[DataFrame, list[str], bool]], keys: list[str]) -> DataFrame:
    """Several UPDATE … FROM passes in turn as left joins; each: source (one row for each key), its columns, whether only nulls are filled."""

    def one(df: DataFrame, step) -> DataFrame:
        source, columns, only_null = step
        s = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
        pick = (lambda c: F.coalesce(c, f"_{c}")) if only_null else (lambda c: F.coalesce(f"_{c}", c))
        return df.join(s, keys, "left").withColumns({c: pick(c) for c in columns}).drop(*[f"_{c}" for c in columns])

    return reduce(one, passes, metadata)
