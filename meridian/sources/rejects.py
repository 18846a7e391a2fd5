"""Bad records go to a table of their own, or stop the load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class LoadError(ValueError):
    pass


def split_valid(df: DataFrame, rules: dict[str, Column], fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all rules, and the others with the first rule they break as `reason`. A rule that is null is broken.

    fail_fast: any bad row is an error.
    """
    reason = F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    marked = df.withColumn("reason", reason)
    good, bad = marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")
    if fail_fast and (first := bad.first()):
        raise LoadError(f"{first['reason']}: {first.asDict()}")
    return good, bad


#: Rules of contribution records.
def contribution_rules() -> dict[str, Column]:
    return {
        "gender": F.coalesce(F.length("contributor_gender") <= 1, F.lit(True)),
        "state": F.coalesce(F.length("contributor_state") <= 2, F.lit(True)),
        "date": F.col("date").isNull() | (F.year("date") >= 1900),
        # any dated soft-money record breaks this rule, as in the feed's loader
        "soft money": ~((F.coalesce("transaction_type", F.lit("")) == "10soft") & F.col("date").isNotNull()),
    }


def load_report(good: DataFrame, bad: DataFrame) -> DataFrame:
    """Columns outcome, n: records loaded, and rejected by reason."""
    return good.agg(F.lit("loaded").alias("outcome"), F.count("*").alias("n")).unionByName(bad.groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("n")))
