"""The best matches of people by the added-up score, in stages, so that bearers of one last name are not all compared with each other.

A pair scores over 1.3 only if first names are equal, forms of one, or crossed with the middle names, so such pairs are found by keys of last name and given names. Only subjects that
find nothing there go on: first to those with the same initial and a middle name (1.3), then to all with a middle name (1.2), to the same initial (1.1) and to all (1), as far as the threshold
lets them. Pairs of the later stages are ties at the top of a subject, so nearly all that is compared there is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import names
from meridian.operators.ranking import checkpointed

THRESHOLD = 1.2
#: Stages after the keys: the score of their pairs, whether the initial must agree, whether both need a middle name.
STAGES = ((1.3, True, True), (1.2, False, True), (1.1, True, False), (1.0, False, False))


def _side(d: DataFrame, p: str, nicknames: DataFrame | None, on: tuple[str, ...]) -> DataFrame:
    """The parsed name as p, all other columns under p_, the nickname families as p_families, and the columns to join on."""
    rest = [F.col(c).alias(f"{p}_{c}") for c in d.columns if c != "id"]
    d = d.select(F.col("id").alias(f"{p}_id"), names.person(F.col("name")).alias(p), *rest).withColumn("_last", F.col(f"{p}.last")).filter("_last is not null")
    for c in on:
        d = d.withColumn(f"_on_{c}", F.col(f"{p}_{c}"))
    none = F.array().cast("array<string>")
    if nicknames is None:
        return d.withColumn(f"{p}_families", none)
    family = nicknames.groupBy(F.lower("name").alias("_nick")).agg(F.collect_set(F.col("family").cast("string")).alias("_f"))
    return d.join(family, F.col(f"{p}.first") == F.col("_nick"), "left").withColumn(f"{p}_families", F.coalesce("_f", none)).drop("_nick", "_f")


def _keys(p: str) -> Column:
    first, middle = F.coalesce(F.col(f"{p}.first"), F.lit("")), F.coalesce(F.col(f"{p}.middle"), F.lit(""))
    crossed = F.concat(F.lit("c"), F.least(first, middle), F.lit("|"), F.greatest(first, middle))
    return F.concat(F.array(F.concat(F.lit("f"), first), crossed), F.transform(F.array_sort(f"{p}_families"), lambda x: F.concat(F.lit("n"), x)))


def best_people(subjects: DataFrame, targets: DataFrame, nicknames: DataFrame | None = None, threshold: float | Column = THRESHOLD, starts: bool | Column = False, on: tuple[str, ...] = (), metadata: Column | None = None, least: float | None = None) -> DataFrame:
    """Columns subject_id, match_id, confidence (names.added_score), metadata_confidence: of each subject all matches at its highest confidence, if that is at the threshold (1 or over).

    threshold and starts may be expressions over subject_x; then `least` says how low a threshold can be.

    subjects and targets: id, name and others; the columns of `on`, which both have, must be equal (a null equals nothing). starts: a target's name, as it is written, must begin with the
    subject's last name. metadata: an expression over subject_x and match_x of other columns x, else 0; it does not choose among matches. nicknames: name, family. Rows without a last
    name match nothing; repeated rows count once; of a target with several rows the greatest metadata confidence counts. Empty tables give no rows.
    Names are parsed once, and each stage is kept, in the session's shared folder, before the next one asks who is left: so jobs run when this is called.
    """
    least = threshold if least is None else least
    if least < 1:
        raise ValueError("equal last names alone score 1: a lower threshold means the same")
    s, m = checkpointed(_side(subjects, "subject", nicknames, on)), checkpointed(_side(targets, "match", nicknames, on))
    also = ["_last", *[f"_on_{c}" for c in on]]
    nick = F.arrays_overlap("subject_families", "match_families")
    threshold, starts = (x if isinstance(x, Column) else F.lit(x) for x in (threshold, starts))
    begins = ~starts | F.startswith(F.lower("match_name"), F.col("_last"))
    sure = F.lit(0.0) if metadata is None else metadata.cast("double")

    def scored(pairs: DataFrame) -> DataFrame:
        d = pairs.filter(begins).withColumn("confidence", names.added_score(F.col("subject"), F.col("match"), F.coalesce(nick, F.lit(False)))).filter(F.col("confidence") >= threshold)
        return d.groupBy("subject_id", "match_id").agg(F.max("confidence").alias("confidence"), F.max(sure).alias("metadata_confidence"))

    sk, mk = s.withColumn("_sk", _keys("subject")), m.withColumn("_mk", _keys("match"))
    keyed = sk.withColumn("_key", F.explode("_sk")).join(mk.withColumn("_key", F.explode("_mk")).hint("merge"), [*also, "_key"])
    found = checkpointed(scored(keyed.filter(F.col("_key") == F.array_intersect("_sk", "_mk")[0])))  # a pair with several keys in common comes from the first
    for worth, initial, middles in STAGES:
        if worth < least:
            break
        left, right, keys = s.filter(threshold <= worth).join(found.select("subject_id").distinct().hint("merge"), "subject_id", "left_anti"), m, list(also)
        if initial:
            left, right = left.withColumn("_i", F.left("subject.first", F.lit(1))), right.withColumn("_i", F.left("match.first", F.lit(1)))
            keys.append("_i")
        if middles:
            left, right = left.filter("subject.middle is not null"), right.filter("match.middle is not null")
        found = found.unionByName(checkpointed(scored(left.join(right.hint("merge"), keys))))
    return found.withColumn("_r", F.rank().over(Window.partitionBy("subject_id").orderBy(F.desc("confidence")))).filter("_r = 1").drop("_r")


def best_by_given_names(subjects: DataFrame, targets: DataFrame, on: tuple[str, ...], threshold: float = 1.0) -> DataFrame:
    """As best_people, by names.given_score. Pairs are made within the columns of `on`, which have to bound the bearers of a last name (a state's politicians)."""
    s, m = _side(subjects, "subject", None, on), _side(targets, "match", None, on)
    pairs = s.join(m, ["_last", *[f"_on_{c}" for c in on]]).withColumn("confidence", names.given_score(F.col("subject"), F.col("match"))).filter(F.col("confidence") >= threshold)
    pairs = pairs.groupBy("subject_id", "match_id").agg(F.max("confidence").alias("confidence"), F.lit(0.0).alias("metadata_confidence"))
    return pairs.withColumn("_r", F.rank().over(Window.partitionBy("subject_id").orderBy(F.desc("confidence")))).filter("_r = 1").drop("_r")
