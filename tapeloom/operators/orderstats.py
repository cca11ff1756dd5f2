"""Exact grouped order statistics: no group is gathered in one task or one aggregation buffer.

All values are laid out once in global order of (group, value) by range partitions, sorted inside.  Counts per group and partition
turn any rank of any group into a partition and a place in it, and one join on these two reads all the values wanted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.sources.store import scratch, shuffles_removed

c = F.col

def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in the order of some columns, with their partition and place in it; stored, as later steps rely on both.

    A random last key spreads rows that tie over partitions; callers must not depend on their order among themselves."""
    rows = df.withColumn("_tie", F.rand(7))
    rows = rows.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    path = scratch(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        rows.select(*df.columns, F.shiftright("_at", 33).alias("_part"), c("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """Per group, one row with n (values that are not null) and q, the quantiles in the order given; between two values they are
    interpolated in proportion.  Groups without a value are absent; null is a group key like others; NaN is the largest value.  No
    group may be named n, q or with a leading underscore."""
    rows = placed(df.where(c(value).isNotNull()).select(*groups, value), [*groups, value])
    parts = rows.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_place").alias("_first"))
    by_group = Window.partitionBy(*groups)
    # As many rows per group as there are partitions.
    parts = parts.withColumns({"_n": F.sum("_size").over(by_group), "_before": F.sum("_size").over(by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - c("_size")})
    spots = [(c("_n") - 1) * F.lit(float(p)) for p in probabilities]
    ranks = [F.struct(F.lit(2 * i + up).alias("i"), (F.ceil if up else F.floor)(h).alias("rank")) for i, h in enumerate(spots) for up in (0, 1)]
    wanted = parts.select(*groups, "_n", "_part", "_first", "_before", "_size", F.explode(F.array(*ranks)).alias("_r"))
    wanted = wanted.where((c("_r.rank") >= c("_before")) & (c("_r.rank") < c("_before") + c("_size")))
    wanted = wanted.select(*groups, "_n", "_part", (c("_first") + c("_r.rank") - c("_before")).alias("_place"), c("_r.i").alias("_i"))
    met = rows.select("_part", "_place", c(value).alias("_value_")).join(wanted, ["_part", "_place"])  # few targets: broadcast by their size at run time
    found = met.groupBy(*groups).agg(F.first("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_i", "_value_"))).alias("_v"))

    def between(i: int, h: Column) -> Column:
        low, high = F.element_at("_v", 2 * i), F.element_at("_v", 2 * i + 1)
        return F.when(F.floor(h) == F.ceil(h), low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)

    return found.select(*groups, c("_n").alias("n"), F.array(*[between(i, h) for i, h in enumerate(spots)]).alias("q"))


def with_medians(aggregated: DataFrame, df: DataFrame, groups: list[str], values: dict[str, Column]) -> DataFrame:
    """*aggregated*, one row per group, with the exact median of each named value over the rows of *df*."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), v.cast("double").alias("_value")) for n, v in values.items()]))
    long = df.select(*groups, each.alias("_m")).select(*groups, "_m.*")
    found = exact_quantiles(long, [*groups, "_name"], "_value", [0.5])
    wide = found.groupBy(*groups).agg(*[F.max(F.when(c("_name") == n, F.get("q", F.lit(0)))).alias(n) for n in values])
    wide = wide.select(*[c(g).alias(f"_g_{g}") for g in groups], *values)
    match = reduce(lambda a, b: a & b, [c(g).eqNullSafe(c(f"_g_{g}")) for g in groups])
    return aggregated.join(wide, match, "left").drop(*[f"_g_{g}" for g in groups])
