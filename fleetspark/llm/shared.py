"""What the operators of this subpackage share: tables, shared storage, words, small joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters only: the contracts lower-case A-Z and leave every other letter as it is.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same for UTF-8 bytes, as a bytes.translate table.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; local sessions without it get one of their own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="fleetspark-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def _drop_at_exit(spark: SparkSession, where: str) -> None:
    def drop() -> None:
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone; its folder is the cluster's to clean
            pass

    atexit.register(drop)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, removed when the driver exits."""
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _drop_at_exit(spark, where)
    return where


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage, survives lost executors and gives later joins true sizes."""
    spark = df.sparkSession
    where = new_folder(spark, name)
    df.write.option("compression", codec).parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df (best from ``written``) with a broadcast hint if it has at most that many rows; else Spark chooses, and splits skewed partitions at run time."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hash_sample(df: DataFrame, by: Column, rows: int) -> DataFrame:
    """The ``rows`` rows of df with the smallest hashes ``by`` (a long). Rows beyond four times their share go before the sort, so that what tasks send on stays about that size however many there are."""
    share = 4 * rows / max(1, df.count())
    if share < 1:
        df = df.where(by < int((share * 2 - 1) * 2**63))
    return df.orderBy(by).limit(rows)


def each_row(df: DataFrame, count: str) -> DataFrame:
    """df's rows as often as ``count`` says, without that column; no array of numbers is longer than 2^16 for counts up to 2^32."""
    step = 1 << 16
    block, row = fresh(df, "_block", "_row")
    df = df.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / step))))
    return df.withColumn(row, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(step).cast("long"), F.col(count) - F.col(block) * step)))).drop(block, row, count)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df has no column of, in any case, so that a table's further columns are never met."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(batches: Iterable, most_bytes: int = 4 << 20):
    """Arrow record batches in slices of about that many bytes, so that very long texts don't meet in one Python list."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def lean(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema); when a task ends, the worker, which Spark keeps for other tasks and stages, gives its free memory back."""

    def wrapped(batches):
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return df.mapInArrow(wrapped, schema)
