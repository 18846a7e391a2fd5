"""Names of persons and organisations: parts and scores. Parsing is an Arrow-batched pandas function, scoring is native."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

# What may stand before and after a person's name.
HONORIFICS = {"mr", "mrs", "ms", "miss", "dr", "rep", "representative", "sen", "senator", "gov", "hon", "honorable", "judge", "prof"}
SUFFIXES = {"jr", "sr", "ii", "iii", "iv", "v", "esq", "md", "phd"}
PARSED = StructType([StructField(f, StringType()) for f in ("first", "middle", "last", "suffix")])


def parse_person(name: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    """First, middle, last name and suffix, in lower case, of `Last, First Middle` or `First Middle Last`."""
    if not name or not name.strip():
        return None, None, None, None
    name = re.sub(r"\([^)]*\)", " ", name.lower())
    suffix = None
    parts = [p.strip() for p in name.split(",") if p.strip()]
    words = lambda s: [w for w in re.findall(r"[\w'-]+", s) if w not in HONORIFICS]
    if len(parts) > 1 and parts[-1].replace(".", "") in SUFFIXES:
        suffix = parts.pop().replace(".", "")
    if len(parts) > 1:
        last, given = words(parts[0]), words(" ".join(parts[1:]))
    else:
        given = words(parts[0]) if parts else []
        while len(given) > 2 and given[-1] in SUFFIXES:
            suffix = given.pop()
        last, given = given[-1:], given[:-1]
    for side in (last, given):
        if len(side) > 1 and side[-1] in SUFFIXES:
            suffix = side.pop()
    first, middle = (given[0] if given else None), " ".join(given[1:]) or None
    return first, middle, " ".join(last) or None, suffix


@F.pandas_udf(PARSED)
def person(name: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_person(n) for n in name], columns=["first", "middle", "last", "suffix"])


@F.pandas_udf(DoubleType())
def close_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters, 0 to 1, by longest matching blocks."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def closest_of(text: str, others: list[str], n: int, cutoff: float) -> list[dict]:
    """Places in others, and ratios, of the n closest to text, `cutoff` at least: of equal ratios the greater text first, then the first place. Most promising first, so that weak ones need no ratio."""
    m = difflib.SequenceMatcher(b=text)
    bounds, best = [], []
    for i, x in enumerate(others):
        m.set_seq1(x)
        if m.real_quick_ratio() >= cutoff and (bound := m.quick_ratio()) >= cutoff:
            bounds.append((bound, i))
    for bound, i in sorted(bounds, reverse=True):
        if len(best) == n and bound < best[-1][0]:
            break
        m.set_seq1(others[i])
        if (ratio := m.ratio()) >= cutoff:
            best = sorted([*best, (ratio, others[i], -i)], reverse=True)[:n]
    return [{"place": -i, "ratio": r} for r, _, i in best]


def closest(text: Column, others: Column, n: int, cutoff: float) -> Column:
    """closest_of of a text and an array of texts."""

    @F.pandas_udf("array<struct<place: int, ratio: double>>")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([closest_of(x, list(y), n, cutoff) for x, y in zip(a, b, strict=True)], dtype=object)

    return of(text, others)


def person_score(subject: Column, match: Column, nickname: Column) -> Column:
    """Confidence that two parsed names are one person; 0 where the last names differ. nickname: whether their first names are forms of one.

    First names: equal 1, forms of one 0.6, first and middle crossed 0.8, same initial 0.1. Middle names: equal 1, same initial 0.5, different -1.5 (only from
    a score over 1.1); one or both missing 0.2.
    """
    s, m = lambda f: subject[f], lambda f: match[f]
    crossed = F.coalesce((s("first") == m("middle")) | (s("middle") == m("first")), F.lit(False))
    initial = lambda c: F.left(c, F.lit(1))
    first = F.when(s("first") == m("first"), 1.0).when(nickname, 0.6).when(crossed, 0.8).when(initial(s("first")) == initial(m("first")), 0.1).otherwise(0.0)
    base = 1.0 + first
    both = s("middle").isNotNull() & m("middle").isNotNull()
    one_letter = (F.length(s("middle")) == 1) | (F.length(m("middle")) == 1)
    middle = (
        F.when(~both, 0.2).when(s("middle") == m("middle"), 1.0).when(one_letter & (initial(s("middle")) == initial(m("middle"))), 0.5)
        .when(base > 1.1, -1.5).otherwise(0.0)
    )
    return F.when(s("last") == m("last"), F.round(base + middle, 4)).otherwise(0.0)


def added_score(subject: Column, match: Column, nickname: Column) -> Column:
    """Confidence that two parsed names are one person, as the records' match commands add it up; 0 where the last names differ or only one side has a first name.

    Last names 1. First names: equal 1 (both missing too); else forms of one 0.6, and besides first and middle crossed 0.8 or, if not, the same initial 0.1. Two middle names: from a
    score over 1.1 equal 1, same initial 0.5, others -1.5; up to that 0.2. A missing middle name adds nothing.
    """
    s, m = lambda f: subject[f], lambda f: match[f]
    initial = lambda c: F.left(c, F.lit(1))
    crossed = s("first").eqNullSafe(m("middle")) & m("first").eqNullSafe(s("middle"))
    missing = s("first").isNull() | m("first").isNull()
    form = F.when(nickname, 0.6).otherwise(0.0)
    base = F.when(s("first").eqNullSafe(m("first")), 2.0).when(crossed, form + 1.8).when(missing, None).otherwise(form + F.when(initial(s("first")) == initial(m("first")), 1.1).otherwise(1.0))
    near = F.when(s("middle") == m("middle"), 1.0).when(initial(s("middle")) == initial(m("middle")), 0.5).otherwise(-1.5)
    middle = F.when(s("middle").isNull() | m("middle").isNull(), 0.0).when(base > 1.1, near).otherwise(0.2)
    return F.when(s("last") == m("last"), F.coalesce(F.round(base + middle, 4), F.lit(0.0))).otherwise(0.0)


def given_score(subject: Column, match: Column) -> Column:
    """1 for equal last names, 2 if the first names are equal too; 0 where last names, or two first names, differ."""
    both = subject["first"].isNotNull() & match["first"].isNotNull()
    return F.when(subject["last"] != match["last"], 0.0).when(both & (subject["first"] != match["first"]), 0.0).when(both, 2.0).when(subject["last"] == match["last"], 1.0).otherwise(0.0)


def evaluated_score(one: Column, other: Column) -> Column:
    """How well two names agree that someone matched before: last names 1 or -1; first names 1, same initial 0.3, one missing -0.5; two middle names 1, same initial 0.2."""
    initial = lambda c: F.left(c, F.lit(1))
    last = F.when(one["last"].eqNullSafe(other["last"]), 1.0).otherwise(-1.0)
    part = lambda f, same, none: F.when(one[f].isNull() | other[f].isNull(), none).when(one[f] == other[f], 1.0).when(initial(one[f]) == initial(other[f]), same).otherwise(0.0)
    return F.round(last + part("first", 0.3, -0.5) + part("middle", 0.2, 0.0), 4)
