"""Factor tables kept up to date: only new dates are built, from new bars and a stored halo of earlier ones."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.factors import daily_factors
from tapeloom.sources.keyed import PART, KeyedTable

#: Fixed value: bars before a date that its factors look back on, that date left out (the longest window has 20).
HALO = 19
BARS = ["trade_date", "code", "open", "high", "low", "close", "volume", "amount"]
Enrich = Callable[[DataFrame, str | None], DataFrame]


def bars_after(bars: KeyedTable, through: str | None) -> DataFrame:
    """Bars later than a date: the months before it are not scanned."""
    if through is None:
        return bars.read().select(*BARS)
    return bars.read((F.col(PART) >= through[:7]) & (F.col("trade_date") > F.lit(through).cast("date"))).select(*BARS)


def last_bars(bars: DataFrame, n: int = HALO) -> DataFrame:
    """The last *n* bars of every code."""
    latest = Window.partitionBy("code").orderBy(F.desc("trade_date"))
    return bars.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= n).drop("_n")


def refresh_factors(bars: KeyedTable, table: KeyedTable, enrich: Enrich | None = None, until: str | None = None) -> DataFrame:
    """Bring *table* up to the last date of *bars* (or *until*); returns the rows that this run added.

    The manifest of *table* holds the high-water mark ``through`` and the folder of the halo, the last bars of every code at that mark;
    rows, mark and halo change with one commit.  A run reads bars after the mark and the halo, and nothing earlier; without a
    mark it reads all bars.  *enrich* adds columns to the factors of new dates; it is told the mark.  Bars of dates up to the mark that come late or changed
    take no part: name their codes to rebuild_codes().
    """
    spark, state = bars.spark, table.properties()
    through = state.get("through")
    new = bars_after(bars, through)
    new = new.where(F.col("trade_date") <= F.lit(until).cast("date")) if until else new
    both = new if through is None else new.unionByName(spark.read.schema(new.schema).parquet(state["halo"]))
    built = daily_factors(both)
    built = built if through is None else built.where(F.col("trade_date") > F.lit(through).cast("date"))
    last = new.agg(F.max("trade_date")).first()[0]
    if last is None:
        return (enrich(built, through) if enrich else built).limit(0)
    halo = f"{table.path}/halo/{uuid.uuid4().hex}"
    last_bars(both).write.parquet(halo)
    table.merge(enrich(built, through) if enrich else built, properties={"through": str(last), "halo": halo})
    old = state.get("halo")
    if old:
        table._fs.delete(table._at(old), True)
    since = F.col("trade_date") > F.lit(through).cast("date") if through else None
    return table.read((F.col(PART) >= through[:7]) & since if through else None)


def rebuild_codes(bars: KeyedTable, table: KeyedTable, codes: DataFrame, enrich: Enrich | None = None) -> None:
    """Build the factors of some codes again up to the mark, after their bars were corrected; *codes*: code.  Other codes are not read
    beyond the scan's filter; the halo takes the corrected bars too."""
    state = table.properties()
    mark = F.lit(state["through"]).cast("date")
    own = bars.read(F.col(PART) <= state["through"][:7]).where(F.col("trade_date") <= mark).select(*BARS).join(codes.select("code").distinct(), "code", "left_semi")
    built = daily_factors(own)
    kept = bars.spark.read.schema(own.schema).parquet(state["halo"]).join(codes.select("code").distinct(), "code", "left_anti")
    halo = f"{table.path}/halo/{uuid.uuid4().hex}"
    kept.unionByName(last_bars(own)).write.parquet(halo)
    table.merge(enrich(built, None) if enrich else built, properties={"halo": halo})
    table._fs.delete(table._at(state["halo"]), True)


def factor_table(path: str, bars: KeyedTable) -> KeyedTable:
    """A stored factor table beside stored bars."""
    return KeyedTable(bars.spark, path, ["trade_date", "code"], F.date_format("trade_date", "yyyy-MM"))


