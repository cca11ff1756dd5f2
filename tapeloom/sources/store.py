"""Reading tables and keyed writes on Parquet: deduplicate, anti-join the old rows, union; then swap partitions."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from functools import reduce

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.factors import dedup_last
from tapeloom.sources.normalize import normalize_trades

c = F.col


def read_table(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, date: str = "trade_date", schema: str | None = None, **equal: str) -> DataFrame:
    """Rows by date range and equalities; the conditions reach the scan."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    df = df.where(c(date) >= F.lit(start)) if start else df
    df = df.where(c(date) <= F.lit(end)) if end else df
    return reduce(lambda d, kv: d.where(c(kv[0]) == kv[1]), equal.items(), df)


def read_trades_csv(spark: SparkSession, path: str) -> DataFrame:
    """Executed trades from CSV; every column is read as text first, nothing is inferred."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).transform(normalize_trades)


def upsert_by_key(old: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None, null_safe: bool = False) -> DataFrame:
    """Old rows whose key is not among the new ones, and the last new row per key."""
    new = dedup_last(new, keys, seq).drop(seq) if seq else new.dropDuplicates(keys)
    marks = new.select(*[c(k).alias(f"_{k}") for k in keys])
    same = [c(k).eqNullSafe(c(f"_{k}")) if null_safe else c(k) == c(f"_{k}") for k in keys]
    kept = old.join(marks, reduce(lambda a, b: a & b, same), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_run_scoped(old: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """Upsert on key and run_id; rows without run_id are one legacy run."""
    return upsert_by_key(old, new, [*keys, "run_id"], seq, null_safe=True)


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Every old row of a scope the new rows touch goes."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_run(df: DataFrame, run_id: str) -> DataFrame:
    return df.where(~c("run_id").eqNullSafe(F.lit(run_id)))


def replace_all(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions *df* holds.  The rows are staged first, so *df* may read from *path*."""
    stage = f"{path.rstrip('/')}_stage_{uuid.uuid4().hex}"
    df.write.parquet(stage)
    staged = df.sparkSession.read.schema(df.schema).parquet(stage)
    staged.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    remove(df.sparkSession.sparkContext, stage)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Within this, Spark removes the shuffle files of a query as soon as it has ended, not when the driver happens to collect its garbage:
    for writes whose rows are read back from where they were written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bucketed(df: DataFrame, path: str, key: str, buckets: int | None = None, part: str | None = None) -> DataFrame:
    """Store *df* in buckets by *key*, by default as many as the session's shuffle partitions, and in folders by *part* if given, and
    read it back: windows and aggregates by the key need no exchange, and two such tables join by it, or by it and more
    columns, without one.  For the latter the session must not ask for all of a join's keys in a partitioning; this sets that."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    n, name = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), f"tapeloom_{uuid.uuid4().hex}"
    out = df.repartition(n, key).write.option("path", path).option("compression", "zstd").bucketBy(n, key).sortBy(key)
    with shuffles_removed(spark):
        (out.partitionBy(part) if part else out).saveAsTable(name)
    return spark.table(name)


def trading_dates(calendar: DataFrame | None, spark: SparkSession, start: str, end: str) -> DataFrame:
    """Open days of the range, or every day where no calendar is at hand."""
    if calendar is None:
        days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("trade_date"))
        return days
    return calendar.where((c("is_open") == 1) & c("cal_date").between(start, end)).select(c("cal_date").alias("trade_date")).distinct()


def write_active_config(rows: DataFrame, path: str, column: str = "recommendation", value: str = "enable_observation") -> DataFrame:
    """Write the rows whose *column* has *value* as JSON lines, and return them."""
    out = rows.where(c(column) == value)
    out.write.mode("overwrite").json(path)
    return out


def read_active_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("strategy_name string, strategy_version string, recommendation string").json(path)


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder all machines share, which goes when the driver ends; a temporary one only where Spark runs on this
    machine alone."""
    sc, root = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    own = f"{root.rstrip('/')}/tapeloom-core-{sc.applicationId}"
    if getattr(sc, "_tapeloom_scratch", None) != own:
        sc._tapeloom_scratch = own
        atexit.register(remove, sc, own)
    return f"{own}/{uuid.uuid4().hex}"


def remove(sc: SparkContext, path: str) -> None:
    """Delete a folder, if the application still runs; what cannot be deleted stays."""
    if sc._jsc is None:
        return
    with contextlib.suppress(Py4JError, OSError):
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def order_output(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)
