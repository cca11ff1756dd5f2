"""K-d tree sharding: recursive weighted-median cuts along the widest metadata dimension.

Native DataFrame code only.  A level of the tree splits all its open cells together: one aggregate finds each cell's widest dimension, and
histogram passes, whose bins are summed and searched in Spark, refine all cuts at once.  The driver holds a few numbers per open cell, so at
most some hundred bytes per shard; rows and bins never leave Spark.  Rows look their cell's numbers up by its place in constant arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, stored, sub_groups, table, text_bytes

GRID_BITS, TIE_BITS, STEP_BITS = 24, 36, 12
#: Keys are GRID_BITS of coordinate followed by TIE_BITS of keyed hash, so that equal coordinates can be cut too.
KEY_BITS = GRID_BITS + TIE_BITS


def _key(dim: str) -> Column:
    return F.shiftleft(F.col(dim), TIE_BITS).bitwiseOR(F.col("tie"))


def _of(values: list, kind: str) -> Column:
    """What a list, by number of the open cell, holds for a row's cell."""
    return F.get(F.expr(f"array({', '.join(f'CAST({v} AS {kind})' for v in values)})"), F.col("cell"))


@dataclass
class Cell:
    """An open cell: *leaves* shards from number *first* on, the dimension it is cut along, and the cut as far as it is known: the leading bits
    of its key and the weight below them."""

    first: int
    leaves: int
    dim: int = 0
    goal: float = 0.0
    prefix: int = 0
    below: float = 0.0
    cut: int | None = None


def _find_cuts(rows: DataFrame, cells: list[Cell], dims: list[str]) -> None:
    """Choose every open cell's dimension and find its cut, all cells together."""
    stats = rows.where("cell >= 0").groupBy("cell").agg(F.sum("size").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in dims])
    for r in stats.collect():
        x = cells[r["cell"]]
        x.dim = max(range(len(dims)), key=lambda i: (r[dims[i]], -i))
        x.goal = r["w"] * (x.leaves // 2) / x.leaves
    keyed = rows.where("cell >= 0").select("cell", "size", _cell_key(cells, dims).alias("k"))
    for shift in range(KEY_BITS - STEP_BITS, -1, -STEP_BITS):
        todo = [x.cut is None for x in cells]
        if not any(todo):
            break
        inside = keyed.where(_of(todo, "boolean") & (F.shiftrightunsigned("k", shift + STEP_BITS) == _of([x.prefix for x in cells], "bigint")))
        hist = inside.groupBy("cell", F.shiftrightunsigned("k", shift).alias("b")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
        ordered = Window.partitionBy("cell").orderBy("b")  # 2 ** STEP_BITS bins a cell at most
        hist = hist.withColumn("run", F.sum("w").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) + _of([x.below for x in cells], "double"))
        bin_ = F.struct("b", "w", "n", (F.col("run") - F.col("w")).alias("total"))
        reached = F.min(F.when(F.col("run") >= _of([x.goal for x in cells], "double"), bin_))
        found = hist.groupBy("cell").agg(F.coalesce(reached, F.max(bin_)).alias("x")).select("cell", "x.*").collect()
        for r in found:
            x = cells[r["cell"]]
            x.prefix, x.below = r["b"], r["total"]
            if r["n"] == 1 or shift == 0:
                over = r["total"] + r["w"] - x.goal
                x.cut = (r["b"] + (over < x.goal - r["total"])) << shift
        for i in {i for i, t in enumerate(todo) if t} - {r["cell"] for r in found}:  # no row
            cells[i].cut = 0


def _cell_key(cells: list[Cell], dims: list[str]) -> Column:
    dim = _of([x.dim for x in cells], "int")
    return F.coalesce(*[F.when(dim == i, _key(d)) for i, d in enumerate(dims)])


def _split_level(rows: DataFrame, cells: list[Cell], dims: list[str]) -> tuple[DataFrame, list[Cell]]:
    """Split every open cell; rows with their new cells, and those of them that are open."""
    _find_cuts(rows, cells, dims)
    kids, places = [], ([], [])
    for x in cells:
        half = x.leaves // 2
        for side, kid in enumerate((Cell(x.first, half), Cell(x.first + half, x.leaves - half))):
            places[side].append(len(kids) if kid.leaves > 1 else -1)
            kids += [kid] if kid.leaves > 1 else []
    left = _cell_key(cells, dims) < _of([x.cut for x in cells], "bigint")
    open_ = F.col("cell") >= 0
    shard = F.when(~open_ | left, F.col("shard")).otherwise(F.col("shard") + _of([x.leaves // 2 for x in cells], "int"))
    cell = F.when(~open_, -1).when(left, _of(places[0], "int")).otherwise(_of(places[1], "int"))
    return stored(rows.withColumns({"shard": shard, "cell": cell})), kids


def grid(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Replace each measure by an integer coordinate of GRID_BITS over its own range; null: 0."""
    df = df.withColumns({k: c.cast("double") for k, c in measures.items()})
    bounds = df.agg(*[f(k).alias(f"{f.__name__}_{k}") for k in measures for f in (F.min, F.max)]).first()
    top = float((1 << GRID_BITS) - 1)

    def scaled(k: str) -> Column:
        low, high = bounds[f"min_{k}"], bounds[f"max_{k}"]
        if low is None or high <= low:
            return F.lit(0).cast("long")
        return F.coalesce(F.floor((F.col(k) - low) / (high - low) * top), F.lit(0)).cast("long")

    return df.withColumns({k: scaled(k) for k in measures})


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Shard documents by a k-d tree over source, language, length and position.

    Give either the number of shards or the bytes a shard should hold.  Returns doc_id, size, text_crc32,
    law, shard, slot and grown_shard.  Each cut is the weighted median (for an odd number of shards, the
    matching quantile) found exactly by histogram refinement, so a shard is off by about one document.
    Null text: no bytes, size 8; texts count whole.  Null metadata: lowest coordinate.  Ties: cut inside by keyed hash; rows equal
    in doc_id and text stay together, but equal texts under different ids may lie in different shards, since
    position is one of the dimensions and any law by bytes has to cut through large groups.  Empty table: empty result.  Other columns
    are ignored.
    """
    source = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit(""))), 40)
    lang = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("lang").cast("string"), F.lit(""))), 40)
    data = text_bytes(F.col("text"))
    rows = docs.select("doc_id", "source", "lang", (F.octet_length(data).cast("long") + 8).alias("size"), F.crc32(data).alias("text_crc32"))
    rows = rows.select("doc_id", "size", "text_crc32", source.alias("source"), lang.alias("lang"), F.shiftrightunsigned(F.xxhash64(F.lit("kd"), "doc_id", "text_crc32"), 64 - TIE_BITS).alias("tie"))
    rows = stored(rows)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w")).first()
    if shards is None:
        shards = max(1, -(-(total["w"] or 0) // (target_bytes or 1)))
    measures = {"d_source": F.col("source"), "d_lang": F.col("lang"), "d_size": F.log2("size"), "d_id": F.col("doc_id")}
    rows = stored(grid(rows, measures).select("doc_id", "size", "text_crc32", "tie", *measures))
    rows, cells = rows.withColumns({"shard": F.lit(0), "cell": F.lit(0 if shards > 1 else -1)}), [Cell(0, shards)] if shards > 1 else []
    while total["n"] and cells:
        rows, cells = _split_level(rows, cells, list(measures))
    placed = rows.select("doc_id", "size", "text_crc32", "shard")
    parts = sub_groups(total["n"], shards)
    sub = F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "text_crc32"), F.lit(parts)).cast("int")
    placed = numbered(placed, ["shard"], ["doc_id", "text_crc32"], sub, "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards; nulls, empty and long texts, ties and repeats as in kd_shards()."""
    return kd_shards(table(spark, sf_dir, "documents"), shards=24)
