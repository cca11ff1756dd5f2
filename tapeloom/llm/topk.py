"""Exact top-k inner products by distributed histogram selection.

Vectors become integers and are packed into blocks; every query block meets every candidate block (the stated
query set against all rows, in blocks).  Each pass scores everything and sends, per query, histogram bins of the
scores inside the interval that still holds the kth value; a block leaves out bins below its own kth score, which
cannot change the answer.  The summed histograms shrink the interval by a factor of BINS per pass until it is one
score wide; then scores above it are kept, and ties at it by smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, stored, table

BINS, QUERY_BLOCK, ROW_BLOCK, LANE = 4096, 1024, 4096, 64
#: Components and scores beyond this count as this: what follows adds a few of them in 64 bits.
MOST = 1 << 62


def _pack(size: int):
    """(id, dim, v) rows into blocks of one dimension, at most *size* vectors each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def block(dim: int) -> pd.DataFrame:
            ids, rows = zip(*held.pop(dim))
            m = np.array(rows, np.int64).reshape(len(ids), dim)
            key = int.from_bytes(np.random.SeedSequence([*map(abs, map(int, ids[:64])), len(ids)]).generate_state(2, np.uint32).tobytes(), "little") >> 1
            return pd.DataFrame({"block": [key], "dim": [dim], "ids": [np.array(ids, np.int64).tobytes()], "rows": [m.tobytes()], "largest": [int(np.abs(m).max(initial=0))]})

        for frame in frames:
            for i, dim, v in zip(frame["id"], frame["dim"], frame["v"]):
                held.setdefault(dim, []).append((i, v))
                if len(held[dim]) == size:
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    return run


def _matrix(data: bytes, dim: int, count: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(count, dim)


def _scores(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and exact integer scores of a pair of blocks; a query's own row scores least."""
    q, c = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
    a, b = _matrix(r.q_rows, r.dim, len(q)), _matrix(r.rows, r.dim, len(c))
    if float(r.q_largest) * float(r.largest) * max(r.dim, 1) < 2**53:
        s = (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    elif int(r.q_largest) * int(r.largest) * int(r.dim) < MOST:
        s = a @ b.T
    else:  # products leave 64 bits
        s = np.clip(a.astype(object) @ b.astype(object).T, -MOST, MOST).astype(np.int64)
    s[q[:, None] == c[None, :]] = np.iinfo(np.int64).min
    return q, c, s


def _histograms(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                q, c, s = _scores(r)
                low, width = np.frombuffer(r.low, np.int64)[:, None], np.frombuffer(r.width, np.int64)[:, None]
                floor = np.maximum(low, np.partition(s, len(c) - k, axis=1)[:, [len(c) - k]]) if len(c) > k else np.broadcast_to(low, (len(q), 1))
                floor = low + np.maximum(floor - low, 0) // width * width
                at, col = np.nonzero((s >= floor) & (s < low + width * BINS) & (s > np.iinfo(np.int64).min))
                bins = (s[at, col] - low[at, 0]) // width[at, 0]
                found, n = np.unique(at * BINS + bins, return_counts=True)
                yield pd.DataFrame({"q_block": r.q_block, "at": found // BINS, "bin": found % BINS, "n": n})

    return run


def _keep(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                q, c, s = _scores(r)
                kth = np.frombuffer(r.low, np.int64)
                at, col = np.nonzero((s >= kth[:, None]) & (s > np.iinfo(np.int64).min))
                score, ids = s[at, col], c[col]
                order = np.lexsort((ids, -score, at))
                at, score, ids = at[order], score[order], ids[order]
                first = np.searchsorted(at, at)
                few = np.arange(len(at)) - first < k
                yield pd.DataFrame({"query_id": q[at[few]], "vec_id": ids[few], "score": score[few]})

    return run


def _start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The widest interval a query's scores can lie in."""
    for frame in frames:
        lows, widths = [], []
        for r in frame.itertuples(index=False):
            m = _matrix(r.q_rows, r.dim, len(r.q_ids) // 8)
            reach = [min(MOST, sum(map(abs, x)) * int(r.all_largest)) for x in m.tolist()]
            lows.append(np.array([-x for x in reach], np.int64))
            widths.append(np.array([-(-(2 * x + 1) // BINS) for x in reach], np.int64))
        yield pd.DataFrame({"q_block": frame["q_block"], "need": [len(x) for x in lows], "low": [x.tobytes() for x in lows], "width": [x.tobytes() for x in widths]})


def _narrow(k: int):
    """One query block's state and its summed histogram: the interval of one bin that holds the kth score."""

    def run(key, state: pd.DataFrame, hist: pd.DataFrame) -> pd.DataFrame:
        low, width, above = (np.frombuffer(state[c].iloc[0], np.int64).copy() for c in ("low", "width", "above"))
        hist = hist.sort_values(["at", "bin"], ascending=[True, False])
        at, bins, n = (hist[c].to_numpy(np.int64) for c in ("at", "bin", "n"))
        sums = np.cumsum(n)
        first = np.searchsorted(at, np.arange(len(low) + 1))
        for i in range(len(low)):
            a, b = first[i], first[i + 1]
            got = sums[a:b] - (sums[a - 1] if a else 0) + above[i]
            j = int(np.searchsorted(got, k))
            if j < b - a:
                above[i] = got[j] - n[a + j]
                low[i] += bins[a + j] * width[i]
            width[i] = -(-width[i] // BINS) if j < b - a else 1
        wide = int((width > 1).any())
        return pd.DataFrame({"q_block": [state["q_block"].iloc[0]], "low": [low.tobytes()], "width": [width.tobytes()], "above": [above.tobytes()], "open": [wide]})

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors, queries: vec_id, v (array of long).  Returns query_id, rank, vec_id, score: the k highest inner
    products of each query with all rows of other ids, ties to the smaller id.

    Components and scores beyond 2**62 either way count as 2**62.  Rows whose vector or vec_id is null take no part; vectors meet those of their own length only; a query id given twice
    keeps its least vector; repeated candidate rows count each.  Fewer than k candidates: all of them.
    Empty tables: empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    block = "block bigint, dim bigint, ids binary, rows binary, largest bigint"
    flat = lambda d: d.select(F.col("vec_id").alias("id"), F.size("v").cast("bigint").alias("dim"), "v")
    whole = "v is not null and vec_id is not null"
    rows = stored(flat(vectors.where(whole)).mapInPandas(_pack(ROW_BLOCK), block))
    asked = queries.where(whole).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = flat(asked).mapInPandas(_pack(QUERY_BLOCK), block)
    asked = stored(asked.select(F.col("block").alias("q_block"), "dim", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("largest").alias("q_largest")))
    # A cell is a lane of row blocks and a lane of query blocks, LANE blocks or so each, however many rows there are.
    blocks = rows.count()
    groups = max(1, min(blocks, max(4 * spark.sparkContext.defaultParallelism, blocks // LANE)))
    turns = max(1, asked.count() // LANE)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    asked = asked.withColumn("h", F.pmod("q_block", F.lit(turns)))
    rows = rows.withColumn("g", F.pmod("block", F.lit(groups)))
    top = rows.groupBy("dim").agg(F.max("largest").alias("all_largest"))
    state = asked.join(top, "dim").mapInPandas(_start, "q_block bigint, need bigint, low binary, width binary")
    state = stored(state.select("q_block", "low", "width", F.expr("cast(repeat(decode(X'00', 'UTF-8'), cast(8 * need as int)) as binary)").alias("above")))

    def cells(state: DataFrame) -> DataFrame:
        lanes = asked.join(state, "q_block").withColumn("g", every(groups))
        return rows.withColumn("h", every(turns)).join(lanes, ["dim", "g", "h"])

    while True:
        hist = cells(state).mapInPandas(_histograms(k), "q_block bigint, at bigint, bin bigint, n bigint")
        hist = hist.groupBy("q_block", "at", "bin").agg(F.sum("n").alias("n"))
        state = state.groupBy("q_block").cogroup(hist.groupBy("q_block")).applyInPandas(_narrow(k), "q_block bigint, low binary, width binary, above binary, open bigint")
        state = stored(state)
        if state.where("open > 0").isEmpty():
            break
    kept = cells(state).mapInPandas(_keep(k), "query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and v = floor(scale * x) of each component; v is null where a component is null or not finite."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return embeddings.select("vec_id", F.when(fine, F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("bigint"))).alias("v"))


def op7_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of every fiftieth vector; nulls, ties, repeats and large values as in exact_topk() and quantised()."""
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return exact_topk(rows, rows.where("vec_id % 50 = 0"), k=5)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
