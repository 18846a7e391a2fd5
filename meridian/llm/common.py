"""Helpers that the training-data operators share: durable intermediates, bounded samples, Arrow buffers."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a text: runs of bytes that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Where none is set: a local one if all runs in this process, as in tests, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
        at = tempfile.mkdtemp(prefix="meridian-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Rows and bytes that go to Python at once. Texts are some KB on average and may be very long, so Spark's defaults are too much for small executors.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Rows that Spark reads of a Parquet file at once. Its default of 4096 makes arrays of tens of MB of texts, anew for each batch, which drive the heap up.
READ_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Fewer rows and bytes in an Arrow batch and in what is read at once, unless the session asks for fewer still: settings of the session, for tables
    of texts. A row that is longer makes a batch of its own.
    """
    if int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) > READ_ROWS:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


_tables: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("tables", default=None)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a written table of ours from the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def owned(path: str) -> None:
    """Gives a written table to the scratch() around, if there is one."""
    if (mine := _tables.get()) is not None:
        mine.append(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that durable() writes inside are deleted at the end, but for those it is told to keep."""
    mine: list[str] = []
    before = _tables.set(mine)
    try:
        yield
    finally:
        _tables.reset(before)
        for path in mine:
            delete(spark, path)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, and the path, which delete() takes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors.

    The table stays until the scratch() around it ends; with keep, or where there is none, until the folder is emptied.
    """
    out, path = written(df, name)
    if not keep and (mine := _tables.get()) is not None:
        mine.append(path)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """A name for a column of an operator's own that none of df's has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def split_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string")) % parts


def held(doc_id: Column, parts: int, out: int) -> Column:
    """True where the row is held out of learning; false for a null id, which is not learned from either."""
    return F.coalesce(split_of(doc_id, parts) == out, F.lit(False))


def unit_hash(*cols: Column) -> Column:
    """A number from 0 to 1 that depends on the values alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(17), *cols), 11) / F.lit(float(1 << 53))).cast("double")


#: Different values that bounded_sample takes classes from; more is an error, as they are then no classes.
MAX_CLASSES = 20_000


def bounded_sample(df: DataFrame, by: str, per_class: int, total: int, key: list[str]) -> DataFrame:
    """About per_class distinct rows of each value of by, and about total of all (one of each class at least), chosen by a hash of key.

    Sizes are counted over the whole table first, so that rare classes keep all their rows. Equal rows count once. Over MAX_CLASSES values: an error.
    """
    sizes = df.filter(F.col(by).isNotNull()).groupBy(by).count().limit(MAX_CLASSES + 1).collect()
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"over {MAX_CLASSES} values of {by}")
    if not sizes:
        return df.limit(0)
    want = max(1, min(per_class, total // len(sizes)))
    rates = df.sparkSession.createDataFrame([(r[0], min(1.0, want / r[1])) for r in sizes], T.StructType([T.StructField("_by", df.schema[by].dataType), T.StructField("_rate", T.DoubleType())]))
    h = F.xxhash64(F.lit(17), *[F.col(k) for k in key])
    picked = df.join(F.broadcast(rates), F.col(by) == F.col("_by")).filter(unit_hash(*[F.col(k) for k in key]) < F.col("_rate")).drop("_by", "_rate")
    return picked.withColumn("_h", h).dropDuplicates(["_h"]).drop("_h")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins and the last ends. A null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def groups(at: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of texts with at most so many bytes each; a longer text stands alone."""
    out, a, n = [], 0, len(at) - 1
    while a < n:
        b = int(np.searchsorted(at, at[a] + most, "right")) - 1
        b = max(a + 1, min(b, n))
        out.append((a, b))
        a = b
    return out


def spans(at: np.ndarray, bytes_most: int = 1_000_000, rows_most: int = 512) -> list[tuple[int, int]]:
    """Like groups, with at most rows_most texts each."""
    return [(i, min(i + rows_most, b)) for a, b in groups(at, bytes_most) for i in range(a, b, rows_most)]


def tidy(run, done=None):
    """run over batches, then done(), and what is left behind given back: workers live on, and their allocators would keep it.

    A task's function is made anew from its pickled form and can hold itself in a cycle; done lets go of what it has loaded.
    """

    def whole(batches):
        yield from run(batches)
        if done:
            done()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return whole


def map_texts(df: DataFrame, text: str, fn, added: str, done=None) -> DataFrame:
    """df without its text column and with the columns that fn makes of it. fn(bytes, offsets) gives one Arrow array for each."""
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    new = StructType.fromDDL(added)
    if clash := {c.lower() for c in df.columns if c != text} & {f.name.lower() for f in new}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    others = [c for c in df.columns if c != text]
    names = [*others, *new.names]

    def run(batches):
        for b in batches:
            made = fn(*utf8(b.column(text)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], *made], names=names)

    return df.select(*others, text).mapInArrow(tidy(run, done), StructType([*df.select(*others).schema, *new]))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """a, b for which sigmoid(a z + b) fits y, by Newton's steps with a small penalty; 0 and the prior's where z says nothing."""
    if not len(z):
        return 0.0, 0.0
    w = np.ones(len(z)) if weight is None else weight
    scale = float(np.std(z)) or 1.0
    x = np.stack([z / scale, np.ones(len(z))], 1)
    p = np.zeros(2)
    t = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y <= 0) + 2))  # Platt's targets
    for _ in range(50):
        q = sigmoid(x @ p)
        g = x.T @ (w * (q - t)) + 1e-3 * p
        h = (x * (w * np.maximum(q * (1 - q), 1e-9))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        p -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(p[0] / scale), float(p[1])
