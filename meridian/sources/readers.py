"""Readers of the feeds. Schemas are always given, so no file is read twice; bad lines are kept in a column of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BAD = "_bad"


def _csv(spark: SparkSession, path, fields: list[str] | StructType, **options) -> DataFrame:
    schema = fields if isinstance(fields, StructType) else StructType.fromDDL(", ".join(f"`{f}` string" for f in fields))
    reader = spark.read.schema(StructType([*schema, *StructType.fromDDL(f"{BAD} string")]))
    return reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, **options).csv(path)


def verified_csv(spark: SparkSession, path, fields, quote: str = '"', header: bool = False) -> DataFrame:
    """Named fields in order; a line with more or fewer has its text in `_bad`."""
    return _csv(spark, path, fields, quote=quote, header=header, escape=quote)


def pipe_quoted(spark: SparkSession, path, fields) -> DataFrame:
    """Comma-separated fields between pipes: the campaign and lobbying feeds."""
    return _csv(spark, path, fields, quote="|", escape="|")


def category_table(spark: SparkSession, path, fields, skip: int = 8, key: str = "catcode") -> DataFrame:
    """Tab-separated codes under header lines; the key in upper case. The header is known by its lines' place in one small file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).filter(f"n >= {skip} and trim(line) <> ''")
    part = F.split("line", "\t")
    rows = lines.select(*[F.trim(F.try_element_at(part, F.lit(i + 1))).alias(f) for i, f in enumerate(fields)])
    return rows.withColumn(key, F.upper(key))


def fec_export(spark: SparkSession, path, fields) -> DataFrame:
    """Pipes between fields, no quotes, one header line."""
    return _csv(spark, path, fields, sep="|", quote="\u0001", header=True)


def space_null_csv(spark: SparkSession, path, fields) -> DataFrame:
    """A single space is null."""
    return _csv(spark, path, fields, nullValue=" ", header=True)


def copy_export(spark: SparkSession, path, fields) -> DataFrame:
    """Database exports: pipes, double quotes, NULL for null."""
    return _csv(spark, path, fields, sep="|", quote='"', escape='"', nullValue="NULL")


def encoded_csv(spark: SparkSession, path, fields, encoding: str = "UTF-8") -> DataFrame:
    return _csv(spark, path, fields, header=True, encoding=encoding)


def backslash_null_csv(spark: SparkSession, path, fields) -> DataFrame:
    r"""State feed: `\N` is null."""
    return _csv(spark, path, fields, nullValue="\\N", escape="\\")


def jdbc_joined(spark: SparkSession, url: str, base: str, joins: list[tuple[str, str]], properties: dict | None = None) -> DataFrame:
    """A database's table left-joined to others; joins: (table, shared key). Each table is read through its own scan."""
    df = spark.read.jdbc(url, base, properties=properties)
    for name, key in joins:
        df = df.join(spark.read.jdbc(url, name, properties=properties), key, "left")
    return df


def candidates_first(df: DataFrame, order: str = "line") -> DataFrame:
    """One row for each cycle and candidate number: one flagged as current and as candidate of the cycle, else the first."""
    flagged = F.when((F.col("curr_cand") == "Y") & (F.col("cycle_cand") == "Y"), 0).otherwise(1)
    rest = [c for c in df.columns if c not in ("cycle", "fec_cand_id")]
    best = F.min_by(F.struct(*rest), F.struct(flagged.alias("f"), F.col(order).alias("o")))
    return df.groupBy("cycle", "fec_cand_id").agg(best.alias("r")).select("cycle", "fec_cand_id", "r.*")


def committees_last(df: DataFrame, order: str = "line") -> DataFrame:
    """One row for each cycle and committee: the last."""
    rest = [c for c in df.columns if c not in ("cycle", "cmte_id")]
    return df.groupBy("cycle", "cmte_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("cycle", "cmte_id", "r.*")


def in_file_order(df: DataFrame, name: str = "line") -> DataFrame:
    """With a column that sorts records as they stand in their files, which `candidates_first` and `committees_last` need; for a DataFrame as a reader gave it.

    It is the file, the start of the piece that a task read and the record's place in that piece: no count of lines, and nothing is shuffled for it.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("place"))
    return df.select("*", at.alias(name))
