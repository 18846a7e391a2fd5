"""Tables in versions: a build is invisible until it is whole, then a pointer moves to it at once; readers keep the version they began with.

The pointer is a small file that names the folder of each cycle. A new version writes only its own cycles' folders; replacing and dropping a cycle is a new pointer, and no
data is written twice. A build that fails leaves the pointer as it was. Folders that no pointer names any more go with `clean`, which is told how long readers may take.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER, PART = "_current.json", "_part"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, root: str):
    return _path(spark, root).getFileSystem(spark._jsc.hadoopConfiguration())


def pointer(spark: SparkSession, root: str) -> dict[str, str]:
    """Folder of each cycle (as text; `*` where a table has no cycles) in the current version; empty where there is none yet."""
    fs, at = _files(spark, root), _path(spark, f"{root}/{POINTER}")
    if not fs.exists(at):
        return {}
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _point(spark: SparkSession, root: str, to: dict[str, str]) -> None:
    """Writes the pointer beside the old one and renames it over that, which is one step in the file system."""
    fs, new = _files(spark, root), _path(spark, f"{root}/.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(json.dumps(to).encode())
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    qualified = lambda p: fs.makeQualified(p)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified(new).toUri(), spark._jsc.hadoopConfiguration()).rename(qualified(new), qualified(_path(spark, f"{root}/{POINTER}")), options)


def publish(df: DataFrame, root: str, cycle: str | None = None, replace: bool = True) -> dict[str, str]:
    """A new version of a table; gives its pointer. With a cycle column and without `replace` only the cycles of df are replaced, all others stay as they are.

    A null cycle is a cycle of its own. An empty df publishes an empty table, or changes nothing where cycles are replaced.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    at = f"{root}/{name}"
    if cycle is None:
        df.write.parquet(at)
        made = {"*": name}
    else:
        df.withColumn(PART, F.coalesce(F.col(cycle).cast("string"), F.lit("null"))).repartition(F.col(PART)).write.partitionBy(PART).parquet(at)
        fs = _files(spark, root)
        folders = [s.getPath().getName() for s in fs.listStatus(_path(spark, at)) if s.isDirectory()]
        made = {f.removeprefix(f"{PART}="): f"{name}/{f}" for f in folders}
        if not made and replace:
            df.limit(0).write.mode("overwrite").parquet(at)
            made = {"*": name}
    old = {} if replace or cycle is None else {k: v for k, v in pointer(spark, root).items() if k != "*"}
    _point(spark, root, old | made)
    return old | made


def drop(spark: SparkSession, root: str, *cycles) -> None:
    """The table without some cycles: only the pointer changes. The last cycle can't be dropped; publish an empty table instead."""
    left = {k: v for k, v in pointer(spark, root).items() if k not in {str(c) for c in cycles}}
    if not left:
        raise ValueError("no cycle would be left")
    _point(spark, root, left)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The current version, as it is now and stays for who reads this DataFrame."""
    folders = sorted(set(pointer(spark, root).values()))
    if not folders:
        raise FileNotFoundError(f"{root} has no version yet")
    return spark.read.option("recursiveFileLookup", "true").parquet(*[f"{root}/{f}" for f in folders])


def clean(spark: SparkSession, root: str, older_s: int) -> list[str]:
    """Deletes builds that the pointer does not name and that are older than some seconds: failed ones, and those whose readers have ended. Gives their names."""
    fs, named = _files(spark, root), {v.split("/")[0] for v in pointer(spark, root).values()}
    now, gone = spark._jvm.System.currentTimeMillis(), []
    for s in fs.listStatus(_path(spark, root)):
        name = s.getPath().getName()
        if s.isDirectory() and name not in named and now - s.getModificationTime() >= older_s * 1000:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return gone
