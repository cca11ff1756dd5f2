"""Exact ranked lexical search: maximum inner products by ball trees over sparse document vectors.

A document is a sparse vector of integer impacts, an item one of integer weights; the score is their inner product.  Items come in
blocks of bounded size, and only terms of a block's items are coordinates, since no other term adds to a score.  Every task
gathers its documents into trees: a node has a centre and a radius that holds all its documents, so no document below
it scores more than (weights . centre) + |weights| * radius, rounded up.  The radius is held once for all coordinates and once for each of them,
as an item's terms are few and seldom those in which the documents differ; the lesser bound counts.  A search takes nodes best-first and stops
when the best bound left is below the kth score so far; leaves are scored in exact 64-bit integers.  The best of each task then meet in one ranking.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, stored, table, trim

#: Bytes to bytes: letters, digits and all non-ASCII bytes stay, A to Z in lower case; the rest parts terms.
TERMS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
#: Items and their terms in a block, on average; documents in a leaf; documents and vector entries in a tree.
ITEMS, ITEM_TERMS, LEAF, TREE_DOCS, TREE_ENTRIES = 512, 32_768, 32, 4096, 1_000_000
#: Relative allowance for the rounding of bounds, far above that of sums of a tree's size.
SLACK = 1e-6


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERMS).split()


def _count(vocabulary: dict[bytes, int]):
    """Per document its number of terms, and which terms of the vocabulary it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            sizes, found, times, ends = [], [], [], [0]
            for text in batch.column(1).cast(pa.binary()):
                words = terms_of(text.as_py())
                counts = Counter(words)
                common = counts.keys() & known
                sizes.append(len(words))
                found += [vocabulary[w] for w in common]
                times += [counts[w] for w in common]
                ends.append(len(found))
            cut = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(x, kind)) for x, kind in ((found, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])
        trim()

    return run


class BallTree:
    """Documents as rows of (terms, impacts); *scale* is the weight of each term, which shapes the geometry."""

    def __init__(self, ids: list, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, scale: np.ndarray) -> None:
        self.ids, self.scale = ids, scale
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.reaches: list[np.ndarray] = []  # how far documents go beyond the centre, by coordinate
        self.below: list[tuple | None] = []  # two children, or none
        self.leaves: dict[int, tuple] = {}
        self._node(np.arange(len(ids)), sizes, terms, impacts)
        self.centre, self.radius, self.reach = np.stack(self.centres), np.array(self.radii), np.stack(self.reaches)

    def _node(self, rows: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> int:
        at, of = len(self.centres), np.repeat(np.arange(len(rows)), sizes)
        x = impacts.astype(np.float64) * self.scale[terms]
        dot = lambda v: np.bincount(of, x * v[terms], len(rows))
        centre = (np.bincount(terms, x, len(self.scale)) / len(rows)).astype(np.float32)
        c = centre.astype(np.float64)
        own, middle = np.bincount(of, x * x, len(rows)), float(c @ c)
        far = own - 2 * dot(c) + middle
        self.centres.append(centre)
        self.radii.append(math.sqrt(max(0.0, float(far.max())) + SLACK * SLACK * (float(own.max()) + middle)) * (1 + SLACK))
        most = np.zeros(len(self.scale))
        np.maximum.at(most, terms, x)
        self.reaches.append((np.maximum(most - c, 0) * (1 + SLACK)).astype(np.float32))
        self.below.append(None)
        if len(rows) <= LEAF:
            self.leaves[at] = rows, np.concatenate([[0], np.cumsum(sizes)[:-1]]), terms, impacts
            return at

        def point(i: int) -> np.ndarray:
            v, mine = np.zeros(len(self.scale)), of == i
            v[terms[mine]] = x[mine]
            return v

        one = point(int(far.argmax()))
        other = point(int((own - 2 * dot(one)).argmax()))
        side = np.zeros(len(rows), bool)
        side[np.argsort(dot(one - other), kind="stable")[: len(rows) // 2]] = True
        parts = []
        for part in (side, ~side):
            entries = np.repeat(part, sizes)
            parts.append(self._node(rows[part], sizes[part], terms[entries], impacts[entries]))
        self.below[at] = tuple(parts)
        return at

    def search(self, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, best: list[tuple], k: int) -> list[tuple]:
        """*best*, an ascending list of (-score, id is null, id), with the documents that belong among its first k.

        weights: scratch of zeros by term; it is zero again afterwards."""
        off = np.minimum(math.sqrt(float(counts @ counts)) * self.radius, self.reach[:, terms].astype(np.float64) @ counts)
        reach = (self.centre[:, terms].astype(np.float64) @ counts + off) * (1 + SLACK) + 1
        weights[terms] = counts * self.scale[terms]
        todo = [(-reach[0], 0)]
        while todo:
            bound, at = heapq.heappop(todo)
            if len(best) == k and -bound < -best[-1][0]:
                break
            if self.below[at]:
                for child in self.below[at]:
                    heapq.heappush(todo, (max(bound, -reach[child]), child))
                continue
            rows, starts, own, impacts = self.leaves[at]
            score = np.add.reduceat(weights[own] * impacts, starts)
            least = -best[-1][0] if len(best) == k else 1
            good = np.flatnonzero(score >= max(1, least))
            if len(good):
                new = [(-int(score[i]), self.ids[rows[i]] is None, self.ids[rows[i]] or 0) for i in good]
                best = sorted([*best, *new])[:k]
        weights[terms] = 0
        return best


def _search(items: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    """The k best documents of a task per item, from trees of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in items]
        scratch = np.zeros(len(weight), np.int64)
        held: list[tuple] = []
        entries = 0

        def flush() -> None:
            tree = BallTree([i for ids, *_ in held for i in ids], *(np.concatenate(x) for x in list(zip(*held))[1:]), weight)
            for q, (terms, counts) in enumerate(items):
                best[q] = tree.search(terms, counts, scratch, best[q], k)
            held.clear()

        for batch in batches:
            n, lists, tf = batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            times = tf.flatten().to_numpy()
            m = np.repeat(100 - 75 + 75 * n * n_docs // max(1, n_terms), sizes)
            held.append((batch.column(0).to_pylist(), sizes, lists.flatten().to_numpy().astype(np.int64), 1_000_000_000 * times // (1000 * times + 8 * m)))
            entries += len(times)
            if sum(len(x[0]) for x in held) >= TREE_DOCS or entries >= TREE_ENTRIES:
                flush()
                entries = 0
        if held:
            flush()
        rows = [(q, None if none else i, -s) for q, found in enumerate(best) for s, none, i in found]
        names = {"item": pa.int32(), "doc_id": pa.int64(), "score": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(names.values())], list(names))
        trim()

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """docs: doc_id, text; items: item_id, text.  Returns item_id, rank (from 1), doc_id, score: the k documents of the highest
    positive scores per item, equal scores by ascending doc_id, a null id last.

    A score sums, over the item's terms with repeats, weight(term) * impact(term, document), where the weight falls with the number
    of documents that hold the term and the impact grows with its occurrences and falls with the document's length.  Texts count whole;
    null, empty and termless texts have no terms: such documents are not counted, such items return nothing.  Document rows that repeat
    count each; item rows that repeat return their list each.  Fewer than k scoring documents: all of them.  Empty tables: an empty
    result.  Other columns play no part.  Items are dealt into blocks of some ITEMS rows, and every block meets all documents.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.where("text is not null").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times"))
    asked = stored(asked.withColumn("item", F.xxhash64("item_id", "text")))
    size = asked.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-size[0] // ITEMS), -(-(size[1] or 0) // (6 * ITEM_TERMS)))
    results = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.col("item"), F.lit(blocks)) == b).orderBy("item").collect()  # a block, whose size is bounded on average
        counts = [Counter(terms_of(r["text"].encode())) for r in block]
        number = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        if not number:
            continue
        found = stored(texts.mapInArrow(_count(number), "doc_id bigint, n bigint, terms array<int>, tf array<bigint>").where("n > 0"))
        total = found.agg(F.count(F.lit(1)), F.sum("n")).first()
        held = {r["term"]: r["df"] for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
        weight = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(number))], np.int64)
        wanted = [(np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counts]
        told = [i for i, c in enumerate(counts) if c]
        search = _search([wanted[i] for i in told], weight, total[0], total[1] or 0, k)
        own = found.where("size(terms) > 0").mapInArrow(search, "item int, doc_id bigint, score bigint")
        names = spark.createDataFrame([(j, block[i]["item_id"], block[i]["times"]) for j, i in enumerate(told)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}, times bigint")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        top = own.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "item")
        results.append(top.select("item_id", "rank", "doc_id", "score", F.explode(F.expr("sequence(1, times)"))).drop("col"))
    if not results:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def op13_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item; nulls, empty and long texts, ties and repeats as in ranked_search()."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
OP13_SQL = f"""
WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents WHERE text IS NOT NULL) GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t WHERE term IN (SELECT term FROM q) GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM f, s),
m AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // total AS m FROM n, s),
x AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
