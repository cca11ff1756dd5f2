"""What the training-data operators share: reading tables, shared storage, numbering rows."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Word rule used wherever words are counted: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Arrow batches sent to Python workers, where the session has Spark's own defaults: small ones keep workers small.  A session that
#: sets these itself keeps its own values.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "2m")}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, and keep their batches small."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    for key, (default, own) in BATCH.items():
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, own)
    if getattr(sc, "_tapeloom_shipped", False):
        return
    to = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "tapeloom_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(to))
    sc._tapeloom_shipped = True


def trim() -> None:
    """Give memory that a Python task no longer uses back to the system; workers live on for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no such call in other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, one parent per application, which goes when the driver ends.  A session
    that names none gets a temporary one if it runs on this machine alone; on a cluster that is an error."""
    sc, root = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
        sc.setCheckpointDir(root)
    own = f"{root.rstrip('/')}/tapeloom-{sc.applicationId}"
    if getattr(sc, "_tapeloom_folder", None) != own:
        sc._tapeloom_folder = own
        atexit.register(remove, sc, own)
    return f"{own}/{uuid.uuid4().hex}"


def remove(sc: SparkContext, path: str) -> None:
    """Delete a folder of the shared store, if the application still runs; what cannot be deleted stays."""
    if sc._jsc is None:
        return
    with contextlib.suppress(Py4JError, OSError):
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write *df* as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, other: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None, nulls: bool = False) -> DataFrame:
    """Join *rows* with *other*, which has one row per key, so that no task gets all rows of a frequent key.

    Keys of more than max(1,000, a hundred-thousandth) of the rows, so at most 100,000 of them, are joined by broadcast, the rest by
    shuffle.  how: inner or left.  Null keys match nothing; with *nulls*, a left join leaves their rows, however many, where
    they are.  *hot*: the frequent keys, where they are known."""
    if nulls:
        new = [F.lit(None).cast(t).alias(n) for n, t in other.dtypes if n != key]
        none = rows.where(F.col(key).isNull()).select(key, *[n for n in rows.columns if n != key], *new)
        return _spread(rows.where(F.col(key).isNotNull()), other, key, how, hot).unionByName(none)
    return _spread(rows, other, key, how, hot)


def _spread(rows: DataFrame, other: DataFrame, key: str, how: str, hot: DataFrame | None) -> DataFrame:
    hot = frequent(rows, key) if hot is None else hot
    if hot.isEmpty():
        return rows.join(other, key, how)
    hot = F.broadcast(hot)
    some = F.broadcast(other.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_semi").join(some, key, how).unionByName(rows.join(hot, key, "left_anti").join(other, key, how))


def frequent(rows: DataFrame, key: str) -> DataFrame:
    """Keys of more than max(1,000, a hundred-thousandth) of the rows; a table is stored once, so count it from there."""
    limit = max(1_000, rows.count() // 100_000)
    return stored(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(key))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; a null text counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def unit_hash(*cols: Column) -> Column:
    """Keyed hash as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def sub_groups(rows: int, groups: int, per_task: int = 20_000, least: int = 64) -> int:
    """Into how many salted parts each group is cut so that a part stays near ``per_task`` rows
    even when one group holds all of them."""
    return max(least, -(-rows // per_task))


def numbered(df: DataFrame, groups: list[str], order: list[str], sub: Column, out: str) -> DataFrame:
    """Gapless numbers from 0 in every group, without gathering a group in one task: rows are numbered
    inside (group, sub) and shifted by the sizes of the earlier parts.  Order: sub, then *order*."""
    keys = [*groups, "_sub"]
    df = df.withColumn("_sub", sub)
    before = Window.partitionBy(*groups).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.join(sizes, keys).withColumn(out, inner + F.col("_before")).drop("_sub", "_before")


def ordered_index(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Position of each row in the global order, from 0: range partitions, numbered inside and shifted
    by the sizes of the partitions before (as many rows as there are partitions)."""
    cut = stored(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = cut.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return cut.join(F.broadcast(sizes), "_p").withColumn(out, inner + F.col("_before")).drop("_p", "_before")
