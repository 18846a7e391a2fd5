"""Record transformations that change the number or the set of fields and rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def compose(df: DataFrame, *steps) -> DataFrame:
    """Steps DataFrame -> DataFrame in turn; a step may make several rows of one by an exploded array."""
    return reduce(lambda d, f: d.transform(f), steps, df)


def to_schema(df: DataFrame, fields: dict[str, str], default: str | None = None) -> DataFrame:
    """Exactly these fields, in this order and of these types; missing ones get the default."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f) if f.lower() in have else F.lit(default)).try_cast(kind).alias(f) for f, kind in fields.items()])


def merge_fields(df: DataFrame, into: str, parts: list[str], separator: str = " ") -> DataFrame:
    return df.withColumn(into, F.concat_ws(separator, *[F.nullif(F.trim(p), F.lit("")) for p in parts])).drop(*[p for p in parts if p != into])


def split_and_transpose(df: DataFrame, separator: str, fields: dict[str, str]) -> DataFrame:
    """Lists side by side in several text fields become rows: the parts of the first field set their number; a field with another
    number of parts gives empty ones. A record whose fields are all empty gives no row. fields: text field to new field.
    """
    parts = {}
    for f in fields:
        bare = F.regexp_replace(F.coalesce(F.col(f), F.lit("")), f"{separator}+$", "")
        parts[f] = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(bare, separator), lambda x: F.trim(x)))
    first = next(iter(fields))
    n = F.size(parts[first])
    same = {f: F.when(F.size(p) == n, p).otherwise(F.array_repeat(F.lit(""), n)) for f, p in parts.items()}
    rows = F.explode(F.arrays_zip(*[same[f].alias(new) for f, new in fields.items()]))
    return df.withColumn("_row", rows).select("*", *[F.col(f"_row.{new}") for new in fields.values()]).drop("_row")


def drop_adjacent_repeats(df: DataFrame, order: str) -> DataFrame:
    """Repeated records out. The feeds' own tool drops only neighbours; rows have no neighbours here, so all repeats go."""
    return df.dropDuplicates([c for c in df.columns if c != order])


def drop_neighbours(df: DataFrame, order: str = "line") -> DataFrame:
    """Records out that equal the one before them in their file, as `uniq` does; equal records further apart stay. order: the column that `in_file_order` made.

    A file is read in pieces by several tasks. A record is compared with the one before it in its piece, a piece's first record with the last one of the piece before; only
    those edge records are brought together, one for each piece of a file. Nulls equal nulls; a file's first record always stays.
    """
    columns = [c for c in df.columns if c != order]
    piece, place = [F.col(f"{order}.file").alias("_file"), F.col(f"{order}.piece").alias("_piece")], F.col(f"{order}.place")
    rows = df.select("*", *piece, F.struct(*columns).alias("_row"))
    edges = rows.groupBy("_file", "_piece").agg(F.max_by("_row", place).alias("_last"))
    edges = edges.select("_file", "_piece", F.lag("_last").over(Window.partitionBy("_file").orderBy("_piece")).alias("_edge"))
    before = F.lag("_row").over(Window.partitionBy("_file", "_piece").orderBy(place))
    return rows.withColumn("_before", before).join(edges, ["_file", "_piece"]).filter(~F.coalesce(F.coalesce("_before", "_edge").eqNullSafe(F.col("_row")), F.lit(False))).select(*df.columns)


def salt_rows(df: DataFrame, amount: str, seed: int) -> DataFrame:
    """Each row as two whose amounts sum to its own, split at a place that a hash of the seed and the row gives: the same however rows are dealt, or computed again."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns]), 11) / F.lit(float(1 << 53))
    part = F.round(F.col(amount) * place, 2).cast(df.schema[amount].dataType)
    return df.withColumn("_p", part).withColumn(amount, F.explode(F.array(F.col("_p"), (F.col(amount) - F.col("_p")).cast(df.schema[amount].dataType)))).drop("_p")


def allocated(df: DataFrame, category: str, prefix: str = "Z2") -> tuple[DataFrame, DataFrame]:
    """Records with a real category, and those to be allocated."""
    without = F.coalesce(F.col(category).startswith(prefix), F.lit(False))
    return df.filter(~without), df.filter(without)


def first_match(rows: DataFrame, *lookups: tuple[DataFrame, str, str, Column]) -> DataFrame:
    """Left joins to small lookups in turn; each: table, key in rows, key in table, value; adds found_0 and so on."""
    for i, (t, a, b, value) in enumerate(lookups):
        small = t.select(F.col(b).alias(f"_k{i}"), value.alias(f"found_{i}"))
        rows = rows.join(small, rows[a] == small[f"_k{i}"], "left").drop(f"_k{i}")
    return rows


def counted(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """df, and how many records passed by, in all and of each condition, to be had when an action on it is done: progress without a second pass.

    While it runs, the session's listeners and web interface show records by stage; a tick for every n records would have to be counted in one place.
    """
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("records"), *[F.count_if(c).alias(n) for n, c in conditions.items()]), seen
