"""The record filter language: `field=op|arg|arg`, fields joined by and.

A schema names the fields a record set has; `build` turns request parameters into one predicate, which Catalyst pushes to the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from decimal import Decimal
from functools import reduce
from urllib.parse import unquote_plus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.text import text_match
from meridian.operators import ranking

RESERVED = ("page", "per_page", "format", "callback", "apikey", "limit", "return_entities", "_")
DELIMITER = "|"


def as_date(text: str) -> date:
    return date.fromisoformat(text)


class Field:
    """A predicate from an operator and its arguments."""

    def __init__(self, make: Callable[..., Column], operators: tuple[str, ...] = ()):
        self.make, self.operators = make, operators

    def __call__(self, value: str) -> Column:
        parts = value.split(DELIMITER)
        if self.operators:
            if parts[0] in self.operators and len(parts) > 1:
                return self.make(parts[0], *parts[1:])
            return self.make("=", *parts)
        return self.make(*parts)


def _column(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column  # made when asked for: schemas may be stated before there is a session


def comparison(column: str | Column, cast: Callable = str) -> Field:
    """=, < (at most), > (at least), >< (between, both ends in)."""

    def make(op: str, *args: str) -> Column:
        c = _column(column)
        values = [F.lit(cast(a)) for a in args]
        if op == "><":
            return c.between(*values)
        return {"=": c == values[0], "<": c <= values[0], ">": c >= values[0]}[op]

    return Field(make, ("=", "<", ">", "><"))


def inclusion(column: str | Column, cast: Callable = str) -> Field:
    return Field(lambda *args: _column(column).isin(*[cast(a) for a in args]))


def upper_inclusion(column: str) -> Field:
    return Field(lambda *args: F.col(column).isin(*[a.upper() for a in args]))


def cycle_pair(column: str) -> Field:
    """An even cycle means both its years."""
    return Field(lambda *args: F.col(column).isin(*sorted({y for a in args for y in (int(a), int(a) - 1)})))


def industry(column: str, order: str) -> Field:
    """Codes of 5 characters and orders of 3, any of them; `order,code` is the code, or the order if that is empty."""

    def make(*args: str) -> Column:
        picked = [a.split(",")[1] or a.split(",")[0] if "," in a else a for a in args]
        if bad := [p for p in picked if len(p) not in (3, 5)]:
            raise ValueError(f"neither industry categories nor orders: {bad}")
        codes, orders = ([p.upper() for p in picked if len(p) == n] for n in (5, 3))
        clauses = [F.col(c).isin(*own) for c, own in ((column, codes), (order, orders)) if own]
        return reduce(lambda a, b: a | b, clauses, F.lit(False)) if clauses else F.lit(True)

    return Field(make)


def fulltext(*columns: str) -> Field:
    return Field(lambda *args: text_match([F.col(c) for c in columns], list(args)))


def groups(column: str, kinds: dict[str, tuple[str, ...]], everything: str = "all") -> Field:
    """Any of the named groups of codes; `all` asks for nothing."""

    def make(*args: str) -> Column:
        if everything in args:
            return F.lit(True)
        return F.col(column).isin(*[c for a in args for c in kinds[a]])

    return Field(make)


def years_overlap(start: str, end: str) -> Field:
    """Any of the years from start to end."""

    def make(*args: str) -> Column:
        one = lambda y: (F.col(start) <= F.lit(date(int(y), 12, 31))) & (F.col(end) >= F.lit(date(int(y), 1, 1)))
        return reduce(lambda a, b: a | b, [one(y) for y in args])

    return Field(make)


def titled(column: str) -> Field:
    return Field(lambda *args: F.col(column) == args[0].capitalize())


def exists(has: str | Column) -> Field:
    """A flag column, made by a semi join beforehand."""
    return Field(lambda *args: _column(has) if args[0].lower() in ("1", "true", "t") else F.lit(True))


def build(schema: dict[str, Field], params: dict[str, str]) -> Column:
    """All parameters together. Reserved ones are left out; an unknown one is an error."""
    clauses = []
    for name, value in params.items():
        if name in RESERVED:
            continue
        if name not in schema:
            raise ValueError(f"no field {name}")
        if value != "":
            clauses.append(schema[name](unquote_plus(value)))
    return reduce(lambda a, b: a & b, clauses) if clauses else F.lit(True)


def search(df: DataFrame, schema: dict[str, Field], params: dict[str, str], order: list[Column], per_page: int = 1000, most: int = 100_000) -> DataFrame:
    """A page of the records that the parameters select, in a stated order; pages count from 1."""
    size = min(int(params.get("per_page", per_page)), most)
    skip = (int(params.get("page", 1)) - 1) * size
    return ranking.page(df.filter(build(schema, params)), order, skip, size)


def totals(df: DataFrame, schema: dict[str, Field], params: dict[str, str]) -> DataFrame:
    return df.filter(build(schema, params)).agg(F.count("*").alias("count"))


def amount(text: str) -> Decimal:
    return Decimal(text)
