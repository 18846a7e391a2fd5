"""Names of people in parts, and whether two of them may be one person's: a lattice of switches as column expressions.

Parsing is an Arrow-batched pandas function; comparing is native.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Abbreviations that names of aliases have.
ABBREVIATIONS = {
    "assn": "association", "cmte": "committee", "cltn": "coalition", "inst": "institute", "co": "company", "corp": "corporation",
    "us": "united states", "dept": "department", "assoc": "associates", "natl": "national",
}
PERSON = StructType([*[StructField(f, StringType()) for f in ("whole", "first", "middle", "last", "suffix")], StructField("nicks", ArrayType(StringType()))])


def letters(text: str) -> str:
    return re.sub("[^A-Z]", "", text.upper())


def western(alias: str) -> str:
    """An alias as `First Middle Last`: `Last, First` turned round at each comma, remarks in brackets and titles left out, abbreviations in full."""
    name = re.sub(r"\s+\([\w ]+\)", "", alias)
    if "," in name and not re.search("(et al| inc)", name, re.I):
        name, suffix = re.fullmatch("(.*?)( (?:JR|SR|I+))?", name.strip(), re.S).groups()
        turned = [", ".join(reversed(p.split(", "))).replace(", ", " ") for p in re.split(r"(\s?[^A-Za-z0-9\s,']\s?)", name)]
        name = re.sub("^(DR|MR|MRS|MS) ", "", "".join(turned) + (suffix or ""), flags=re.I)
    return " ".join(ABBREVIATIONS.get(w.lower(), w) for w in name.split())


def parts_of(name: str | None) -> tuple:
    """whole, first, middle, last, suffix (letters in upper case) and the two first names of one with a nickname in quotes. A last word that holds JR or SR counts as a suffix."""
    if not name or not name.strip():
        return None, None, None, None, None, None
    whole, nick = letters(name), None
    name = name.split(" & ")[0]
    if quoted := re.fullmatch('(.*?) "(.*?)" (.*?)', name):
        name, nick = f"{quoted[1]} {quoted[3]}", quoted[2]
    words = [letters(w) for w in name.split()]
    suffix = words.pop() if words and re.search("(^I+$|JR|SR)", words[-1]) else None
    last = words[-1] if words else None
    first = words[0] if len(words) > 1 else None
    middle = " ".join(words[1:-1]) if len(words) > 2 else None
    nicks = sorted({x for x in (first, letters(nick)) if x}) if nick else None
    return whole or None, first or None, middle or None, last or None, suffix, nicks


@F.pandas_udf(PERSON)
def person_parts(name: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parts_of(n) for n in name], columns=[f.name for f in PERSON])


@F.pandas_udf(PERSON)
def alias_parts(alias: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parts_of(western(a) if a else None) for a in alias], columns=[f.name for f in PERSON])


@dataclass(frozen=True)
class Switches:
    """What two names may differ in and still be one person's. All of them is the widest equality, none the narrowest; `exact` turns off all that are not asked for."""

    nicknames: bool = True
    first_as_middle: bool = True
    missing_first: bool = True
    missing_middle: bool = True
    initials: bool = True
    missing_suffix: bool = True

    @classmethod
    def exact(cls, **on: bool) -> Switches:
        return cls(**({k: False for k in cls.__dataclass_fields__} | on))


def same_person(a: Column, b: Column, s: Switches = Switches(), families: str = "families") -> Column:
    """Whether person a (PERSON with an array `families` of nickname families for first and middle as a struct, if nicknames count) may be b. Never null.

    Names equal as wholes are one's; else last names must be equal, so a name that is only a suffix equals none but itself.
    """
    of = lambda p, f: p[f]
    same = lambda x, y: x.eqNullSafe(y)
    none = lambda *c: F.coalesce(*[x for x in c], F.lit(None).cast("string")).isNull()
    initial = lambda x, y: F.coalesce(((F.length(x) == 1) & (x == F.left(y, F.lit(1)))) | ((F.length(y) == 1) & (y == F.left(x, F.lit(1)))), F.lit(False))

    def as_first(p: Column, f: str, q: Column, g: str) -> Column:
        x, y = of(p, f), of(q, g)
        out = same(x, y)
        if s.nicknames:
            out = out | F.coalesce(F.arrays_overlap(p[families][f], q[families][g]), F.lit(False))
            for nicks in (of(a, "nicks"), of(b, "nicks")):
                out = out | F.coalesce(F.array_contains(nicks, x) & F.array_contains(nicks, y), F.lit(False))
        return out | initial(x, y) if s.initials else out

    suffix = same(of(a, "suffix"), of(b, "suffix"))
    if s.missing_suffix:
        suffix = suffix | none(of(a, "suffix")) | none(of(b, "suffix"))
    bare = lambda p: none(of(p, "first"), of(p, "middle"))
    crossed = lambda p, q: of(p, "first").isNotNull() & of(p, "middle").isNotNull() & of(q, "middle").isNull() & as_first(p, "middle", q, "first")
    middle = same(of(a, "middle"), of(b, "middle"))
    if s.missing_middle:
        middle = middle | none(of(a, "middle")) | none(of(b, "middle"))
    if s.initials:
        middle = middle | initial(of(a, "middle"), of(b, "middle"))
    ways = as_first(a, "first", b, "first") & middle
    if s.first_as_middle:
        ways = ways | crossed(a, b) | crossed(b, a)
    if s.missing_first:
        ways = ways | bare(a) | bare(b)
    last = F.coalesce(of(a, "last") == of(b, "last"), F.lit(False))
    return F.coalesce(of(a, "whole") == of(b, "whole"), F.lit(False)) | (last & suffix & ways)
