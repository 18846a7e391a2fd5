"""Structured Streaming over feeds that arrive as files."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from meridian.functions.cycles import to_cycle
from meridian.operators.setops import refresh_cycles
from meridian.sources.rejects import split_valid


def files(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.csv", per_trigger: int = 50, **options) -> DataFrame:
    """New files of a folder as they come, a bounded number each time."""
    return spark.readStream.schema(schema).options(pathGlobFilter=pattern, maxFilesPerTrigger=per_trigger, header=True, **options).csv(folder)


def offer(spark: SparkSession, inbox: str, ready: str, rejected: str, pattern: str = "*.csv", quiet_s: float = 60, most: int = 1000) -> dict[str, list[str]]:
    """Moves what came in: files that nobody has written to for `quiet_s` seconds to `ready`, where the stream reads, files of other names to `rejected`. Gives the names of each, and of those that wait.

    A move is one step of the file system, so the stream never sees a part of a file, and a file that two offers race for is moved once. `most` files are moved at a time, the oldest first;
    a name that is in `ready` already waits until the stream has archived that file.
    """
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(inbox).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in (ready, rejected):
        fs.mkdirs(at(folder))
    now, out = spark._jvm.System.currentTimeMillis(), {"ready": [], "rejected": [], "waiting": []}
    for s in sorted((x for x in fs.listStatus(at(inbox)) if x.isFile()), key=lambda x: (x.getModificationTime(), x.getPath().getName())):
        name = s.getPath().getName()
        if len(out["ready"]) >= most or now - s.getModificationTime() <= quiet_s * 1000 and fnmatch(name, pattern):
            out["waiting"].append(name)
            continue
        kind, folder = ("ready", ready) if fnmatch(name, pattern) else ("rejected", rejected)
        moved = not fs.exists(at(f"{folder}/{name}")) and fs.rename(s.getPath(), at(f"{folder}/{name}"))
        out[kind if moved else "waiting"].append(name)
    return out


def archived(spark: SparkSession, ready: str, done: str, schema: StructType, pattern: str = "*.csv", per_trigger: int = 50, **options) -> DataFrame:
    """Files of `ready` as a stream; what a later batch no longer needs is moved to `done` by the source itself."""
    return files(spark, ready, schema, pattern, per_trigger, cleanSource="archive", sourceArchiveDir=done, **options)


def load(stream: DataFrame, rules: dict, to: str, rejects: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Good records to one table, bad ones with their reason to another; each batch is written once, also after a restart."""

    def each(batch: DataFrame, number: int) -> None:
        good, bad = split_valid(batch, rules)
        good.withColumn("_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(to)
        bad.withColumn("_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(rejects)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def weekly(stream: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Counts by seven-day window from Monday; rows later than the watermark are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "7 days", startTime="4 days"), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("week"), *keys, "n")


def refresh(old: DataFrame, changed: DataFrame, rebuilt: DataFrame, date: str) -> DataFrame:
    """old with the cycles of the changed records taken from rebuilt."""
    return refresh_cycles(old, rebuilt, changed.select(to_cycle(F.col(date)).alias("cycle")))
