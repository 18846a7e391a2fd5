"""Registry of queries and the stand-in tables they share.

Contributions stand in as orders: a transaction with an amount, a date and a cycle; its contributor is the customer, the contributor's
state the nation, the category the market segment; recipients are the suppliers of the order's lines.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions.cycles import to_cycle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Tables that stored() has written.
PATHS: list[str] = []


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder that the session names; a local folder only where none is set and all runs in this process, as in tests."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
        at = tempfile.mkdtemp(prefix="meridian-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    PATHS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def there(spark: SparkSession, path: str) -> bool:
    """Whether a stored table is still in the shared folder, which may be emptied at any time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


_made: dict[tuple, tuple[dict[str, DataFrame], list[str]]] = {}


def made_once(spark: SparkSession, key: tuple, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Tables that make() stores, kept for the session; made anew where the shared folder was emptied."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _made or not all(there(spark, p) for p in _made[key][1]):
        before = len(PATHS)
        _made[key] = make(), PATHS[before:]
    return _made[key][0]


def standins(spark: SparkSession, sf_dir: str, sources: tuple[str, ...], sql: dict[str, str], seen: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Stored tables of some SQL over the tables of sf_dir and over others that were stored before; later ones may read earlier ones."""
    for name in sources:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name, df in (seen or {}).items():
        df.createOrReplaceTempView(name)
    made = {}
    for name, text in sql.items():
        made[name] = stored(spark.sql(text).coalesce(spark.sparkContext.defaultParallelism), name)
        made[name].createOrReplaceTempView(name)
    return made


def money(column: str) -> F.Column:
    return F.col(column).cast("decimal(15,2)")


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order with its contributor; see CONTRIBUTIONS for the same in SQL."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"])
        .select(
            F.col("o_orderkey").alias("transaction_id"), to_cycle(F.col("o_orderdate")).alias("cycle"), F.to_date("o_orderdate").alias("date"),
            money("o_totalprice").alias("amount"), F.when(F.col("o_orderstatus") == "F", "federal").otherwise("state").alias("namespace"),
            F.col("c_custkey").alias("contributor_id"), F.col("c_name").alias("contributor_name"), F.col("n_name").alias("contributor_state"),
            F.col("n_nationkey").alias("organization_id"), F.col("n_regionkey").alias("parent_id"), F.col("c_mktsegment").alias("category"),
            F.left("o_orderpriority", F.lit(1)).alias("party"), F.when(F.col("o_orderstatus") == "P", "C").otherwise("P").alias("recipient_type"),
        )
    )


#: Common table expressions of the stand-ins, for the SQL side.
CONTRIBUTIONS = """contributions AS (
  SELECT o_orderkey AS transaction_id, (year(o_orderdate) + year(o_orderdate) % 2)::INTEGER AS cycle, o_orderdate::DATE AS date,
    o_totalprice::DECIMAL(15,2) AS amount, CASE WHEN o_orderstatus = 'F' THEN 'federal' ELSE 'state' END AS namespace,
    c_custkey AS contributor_id, c_name AS contributor_name, n_name AS contributor_state, n_nationkey AS organization_id, n_regionkey AS parent_id,
    c_mktsegment AS category, left(o_orderpriority, 1) AS party, CASE WHEN o_orderstatus = 'P' THEN 'C' ELSE 'P' END AS recipient_type
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

RECIPIENTS = "recipients AS (SELECT DISTINCT l_orderkey AS transaction_id, l_suppkey AS entity_id FROM lineitem)"


def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("transaction_id"), F.col("l_suppkey").alias("entity_id")).distinct()
