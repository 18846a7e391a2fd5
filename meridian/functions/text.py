"""Text search and cleaning as column expressions."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that text search leaves out.
STOP_WORDS = (
    "association", "assoc", "assn", "incorporated", "inc", "company", "co", "corporation", "corp",
    "committee", "cmte", "limited", "ltd",
)
#: Search operators, which count as spaces in a request.
OPERATORS = "\"'&|!():*\\"
#: What organisation names lose at their end, in this order of choice.
ORG_SUFFIX = r"( ?co\.?$)|( ?corp\.?$)|( ?corporation$)|( ?company$)|( ?inc\.?$)|( ?incorporated$)|( ?assoc\.?$)|( ?association$)|( ?ltd\.?$)|( ?limited$)|( ?llc\.?$)"
#: Characters that basic_normal removes.
NORMAL_REMOVES = " ,.\"'@+#$(){}[]\\&-/"
ZIP5 = r"^\s*(\d{5})(?:[- ]*\d{4})?(?!\d)"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def search_tokens(query: str) -> list[str]:
    for c in OPERATORS:
        query = query.replace(c, " ")
    return [t for t in re.findall(r"[^\W_]+", query.lower()) if t not in STOP_WORDS]


def text_match(columns: list[Column], searches: list[str]) -> Column:
    """True where any column matches any search: all its words are there, and a search in quotes also as it stands, whatever the case.

    A search of stop words alone matches nothing, as the text index has nothing to look up.
    """
    clauses = []
    for column in columns:
        words = tokens(column)
        for s in searches:
            wanted = search_tokens(s)
            clause = F.lit(False) if not wanted else reduce(lambda a, b: a & b, [F.array_contains(words, w) for w in wanted])
            if quoted := re.fullmatch(r'"(.*)"', s):
                clause = clause & F.contains(F.lower(column), F.lit(quoted[1].lower()))
            clauses.append(clause)
    return F.coalesce(reduce(lambda a, b: a | b, clauses), F.lit(False)) if clauses else F.lit(True)


def standard_orgname(name: Column) -> Column:
    """Lower case without one company suffix at the end."""
    return F.regexp_replace(F.lower(name), ORG_SUFFIX, "")


def basic_normal(name: Column) -> Column:
    """Lower case, ` and ` as `&`, no marks or spaces, no company suffix."""
    bare = F.regexp_replace(F.replace(F.lower(name), F.lit(" and "), F.lit("&")), "[" + re.escape(NORMAL_REMOVES) + "]", "")
    return F.regexp_replace(bare, "(?:" + "|".join(STOP_WORDS) + ")$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def best_of(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def zip5(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, ZIP5, 1), F.lit(""))


def fit(text: Column, most: int) -> Column:
    return F.substring(F.trim(text), 1, most)


def strip_control(text: Column) -> Column:
    """Without zero and start-of-heading characters."""
    return F.translate(text, "\0\x01", "")


def first_break_to_space(text: Column) -> Column:
    """Only the first line break becomes a space."""
    return F.regexp_replace(text, r"(?s)^(.*?)(?:\r\n|\r|\n)", "$1 ")


def trailing_comma(text: Column) -> Column:
    return F.regexp_replace(text, ", *$", "")


def ascii_fold(text: Column) -> Column:
    """Characters as what their compatibility decomposition leaves of plain ones: accents go, ligatures and wide forms become letters, all else that is not ASCII
    goes. In Arrow batches, as no built-in function decomposes characters.
    """
    @F.pandas_udf("string")
    def fold(x: pd.Series) -> pd.Series:
        return x.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")

    return fold(text)


def slug(name: Column) -> Column:
    """Lower-case words joined by hyphens."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(name)), "[^a-z0-9]+", "-"), F.lit("-"))


def url_params(pairs: dict[str, Column]) -> Column:
    """Base64 of the parameters as a url has them."""
    parts = [F.concat(F.lit(k + "="), F.url_encode(v.cast("string"))) for k, v in pairs.items()]
    return F.base64(F.concat_ws("&", *parts).cast("binary"))
