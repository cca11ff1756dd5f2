"""BagMinHash near-duplicates: weighted-Jaccard signatures of shingle multisets, banded and verified.

A weight w of a feature is cut into dyadic blocks [0,1), [1,2), [2,4), ...; each block carries a Poisson process
seeded by feature and block, whose points have a time, a signature slot and a height inside the block.  A point
counts if its height is below w, so two bags share the earliest point of a slot with a probability equal to
their weighted Jaccard similarity.  Points later than the last slot to be filled are never made.

Flow: equal texts collapse to one node.  Nodes that share a band meet in a bucket; the bucket's head is the least keyed
hash of its members, and buckets of one head form one group, so a pair that shares several bands meets once or twice.  A
group of up to BLOCK nodes is compared whole.  A larger one is first compared with a few heads; what those links join
needs no more comparing among itself, and all other pairs meet in cells of two blocks.  Inside a cell all overlaps
are exact, from one matrix product over shared shingles, and only links that keep the components are returned.  No
bucket is capped and no link inside a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, spread_join, stored, table, trim
from .components import components
from .shingles import many_shingles, mix, overlap, shingles

WORDS, SIMILAR, BANDS, ROWS, HEADS, BLOCK = 5, 0.8, 32, 5, 4, 384
#: Shared band keys and candidate ids are broadcast up to so many rows, of at most some 40 bytes each.
BROADCAST_ROWS = 1_000_000


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(owner: np.ndarray, features: np.ndarray, weights: np.ndarray, bags: int, slots: int, spare: float = 4.0) -> np.ndarray:
    """BagMinHash signatures of *bags* bags of 64-bit features with positive integer weights; owner: the bag of each
    feature.  A bag without features has a signature of zeros."""
    keys, floor, width, weight, own = [], [], [], [], []
    low = 0
    while len(over := np.flatnonzero(weights > low)):
        size = max(low, 1)
        keys.append(mix(features[over] + np.uint64((low + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))
        floor.append(np.full(len(over), low, np.float64))
        width.append(np.full(len(over), size, np.float64))
        weight.append(weights[over].astype(np.float64))
        own.append(owner[over])
        low += size
    out = np.zeros((bags, slots), np.uint64)
    if not keys:
        return out
    key, base, span, top, own = map(np.concatenate, (keys, floor, width, weight, own))
    total = np.bincount(owner, weights=weights, minlength=bags)
    until = ((np.log(slots) + spare) / np.maximum(total, 1))[own]
    times, values, cells = [], [], []
    live, t, n = np.arange(len(key)), np.zeros(len(key)), 0
    while len(live):
        n += 1
        point = mix(key[live] + np.uint64(n * 0xD1342543DE82EF95 % (1 << 64)))
        t = t - np.log(_unit(point)) / (slots * span[live])
        early = t < until[live]
        live, t, point = live[early], t[early], mix(point[early])
        under = np.flatnonzero(base[live] + span[live] * _unit(point << np.uint64(16)) < top[live])
        value = point[under]
        times.append(t[under])
        values.append(value)
        cells.append(own[live[under]] * slots + ((value >> np.uint64(48)) * np.uint64(slots) >> np.uint64(16)).astype(np.int64))
    when, value, cell = map(np.concatenate, (times, values, cells))
    order = np.argsort(-when)
    hit = np.zeros(bags * slots, bool)
    out.reshape(-1)[cell[order]] = value[order]
    hit[cell] = True
    for i in np.flatnonzero((total > 0) & ~hit.reshape(bags, slots).all(axis=1)):  # a slot had no early point: look further
        mine = owner == i
        out[i] = signatures(np.zeros(int(mine.sum()), np.int64), features[mine], weights[mine], 1, slots, spare * 2)[0]
    return out


def signature(features: np.ndarray, weights: np.ndarray, slots: int) -> np.ndarray:
    return signatures(np.zeros(len(features), np.int64), features, weights, 1, slots)[0]


def band_keys(sigs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of each signature."""
    cube = sigs.reshape(len(sigs), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), cube.shape[:2])
    for r in range(rows):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + cube[:, :, r])
    return key.view(np.int64)


def _chunks(lengths: list[int], most: int = 1 << 19, bags: int = 500) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about *most* bytes and at most *bags* texts, since each bag costs some 1,500 points whatever its size."""
    a = size = 0
    for i, n in enumerate(lengths):
        size += n
        if size >= most or i + 1 - a >= bags:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(lengths):
        yield a, len(lengths)


def _sign(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(2)
            totals, keys = [np.empty(0, np.int64)], [np.empty((0, bands), np.int64)]
            for a, b in _chunks(pc.binary_length(data).to_pylist()):
                owner, f, n = many_shingles(data.slice(a, b - a).to_pylist(), words)
                totals.append(np.bincount(owner, weights=n, minlength=b - a).astype(np.int64))
                keys.append(band_keys(signatures(owner, f, n, b - a, bands * rows), bands, rows))
            total, key = np.concatenate(totals), np.concatenate(keys)
            offsets = np.concatenate(([0], np.cumsum(np.where(total > 0, bands, 0)))).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[total > 0].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total), column], ["doc_id", "node", "n", "bands"])
        trim()

    return run


def packed(features: np.ndarray) -> bytes:
    """The upper 48 bits of ascending features; two of a pair of documents of 1,000 shingles fall together with
    probability 4e-9."""
    return (features >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _bags(words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = [shingles(bytes(t), words) for t in frame["data"]]
            yield pd.DataFrame({"node": frame["node"], "bag": [packed(f) for f, _ in both], "times": [n.astype(np.uint32).tobytes() for _, n in both]})
        trim()

    return run


def linked(bags: list[tuple[np.ndarray, np.ndarray]], similar: float) -> np.ndarray:
    """Which pairs of bags overlap enough, exactly: the matrix of multiset intersections from the features that two bags
    share."""
    size = np.array([int(n.sum()) for _, n in bags])
    owner = np.repeat(np.arange(len(bags)), [len(f) for f, _ in bags])
    f, n = np.concatenate([f for f, _ in bags]), np.concatenate([n for _, n in bags]).astype(np.int64)
    both = np.zeros((len(bags), len(bags)))
    level = 0
    while len(f):
        kinds, at, times = np.unique(f, return_inverse=True, return_counts=True)
        shared = times[at] > 1
        f, n, owner, at = f[shared], n[shared], owner[shared], at[shared]
        kept, at = np.unique(at, return_inverse=True)
        step = 1 if level < 8 else int(n.min(initial=level + 1)) - level
        for a in range(0, len(kept), 4096):
            part = (at >= a) & (at < a + 4096)
            m = np.zeros((len(bags), min(4096, len(kept) - a)), np.float32)
            m[owner[part], at[part] - a] = 1
            both += step * (m @ m.T)
        level += step
        more = n > level
        f, n, owner = f[more], n[more], owner[more]
    np.fill_diagonal(both, 0)
    return (both >= similar * (size[:, None] + size[None, :] - both) - 1e-9) & (both > 0)


def _tree(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges that keep the components of a link matrix."""
    seen, out = np.zeros(len(link), bool), []
    for i in range(len(link)):
        if seen[i]:
            continue
        seen[i], todo = True, [i]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(link[x] & ~seen)
            seen[new] = True
            out += [(x, int(y)) for y in new]
            todo += new.tolist()
    return out


def _cells(similar: float):
    """Rows sorted by cell -> links that keep the components inside each cell."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, {}

        def links() -> pd.DataFrame:
            nodes = list(held)
            bags = [(unpacked(b), np.frombuffer(t, np.uint32).astype(np.int64)) for b, t in held.values()]
            if len(nodes) == 2:
                edges = [(0, 1)] if overlap(*bags[0], *bags[1]) >= similar - 1e-12 else []
            else:
                edges = _tree(linked(bags, similar)) if nodes else []
            return pd.DataFrame({"a": [nodes[i] for i, _ in edges], "b": [nodes[j] for _, j in edges]})

        for frame in frames:
            out = []
            for h, c, node, bag, times in zip(frame["head"], frame["cell"], frame["node"], frame["bag"], frame["times"]):
                if (h, c) != key:
                    if len(held) > 1:
                        out.append(links())
                    key, held = (h, c), {}
                held[node] = (bag, times)
            yield pd.concat(out) if out else pd.DataFrame({"a": [], "b": []})
        if len(held) > 1:
            yield links()
        held.clear()
        trim()

    return run


def _verify(similar: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bags = [[unpacked(x) if "bag" in c else np.frombuffer(x, np.uint32) for x in frame[c]] for c in ("bag_a", "times_a", "bag_b", "times_b")]
            sims = np.array([overlap(a, na.astype(np.int64), b, nb.astype(np.int64)) for a, na, b, nb in zip(*bags)])
            yield frame.loc[sims >= similar - 1e-12, ["a", "b"]] if len(frame) else pd.DataFrame({"a": [], "b": []})
        trim()

    return run


def _drawn(turn: int) -> Column:
    return F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), F.col("node").alias("node")))


def _star_links(groups: DataFrame, bags: DataFrame, heads: int, similar: float, salts: int = 64) -> DataFrame:
    """Links between the members of large groups and a few members drawn from each.

    The drawn members' bags are dealt out *salts* times, so that a group's pairs lie in as many parts; that is fewer rows than
    the group has members."""
    drawn = groups.groupBy("head").agg(*[_drawn(i).alias(f"h{i}") for i in range(heads)])
    drawn = drawn.select("head", F.explode(F.array_distinct(F.array(*[f"h{i}.node" for i in range(heads)]))).alias("b"))
    pairs = groups.select("head", F.col("node").alias("a")).join(drawn, "head").where("a != b").select("a", "b").distinct()
    side = lambda s: bags.select(F.col("node").alias(s), F.col("bag").alias(f"bag_{s}"), F.col("times").alias(f"times_{s}"))
    dealt = side("b").join(drawn.select("b").distinct(), "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int"))
    return stored(salted.join(side("a"), "a").join(dealt, ["b", "salt"]).drop("salt").mapInPandas(_verify(similar), "a binary, b binary"))


def _in_cells(groups: DataFrame, labels: DataFrame | None, block: int) -> DataFrame:
    """Cells of at most about two blocks in which all pairs of a group meet that may still join two components.

    Members of the group's largest component are one side only; the others meet everyone."""
    if labels is None:
        return groups.select("head", F.lit(0).alias("cell"), "node")
    own = groups.join(labels, "node", "left").select("head", "node", F.coalesce("label", "node").alias("label"))
    counts = own.groupBy("head", "label").agg(F.count(F.lit(1)).alias("c"))
    shape = counts.groupBy("head").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("main"))
    shape = shape.select("head", F.col("main.label").alias("main"), F.ceil(F.col("main.c") / block).alias("n_main"), F.ceil((F.col("m") - F.col("main.c")) / block).alias("n_rest"))
    own = own.join(shape, "head").where("n_rest > 0")
    number = F.pmod(F.xxhash64(F.lit("block"), "node"), F.when(F.col("label") == F.col("main"), F.col("n_main")).otherwise(F.col("n_rest")))
    own = own.withColumn("x", number)
    rest = F.sequence(F.lit(0), F.col("n_rest") - 1)
    pair = lambda y: F.least("x", y) * F.col("n_rest") + F.greatest("x", y)
    among = F.concat(F.transform(rest, pair), F.transform(F.sequence(F.lit(0), F.col("n_main") - 1), lambda y: -1 - (F.col("x") * F.col("n_main") + y)))
    against = F.transform(rest, lambda y: -1 - (y * F.col("n_main") + F.col("x")))
    return own.select("head", "node", F.explode(F.when(F.col("label") == F.col("main"), against).otherwise(among)).alias("cell"))


def _small(df: DataFrame) -> DataFrame:
    """A narrow stored table, marked for broadcast if it has few rows; otherwise both sides of its join are shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def near_duplicates(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), n_shingles, kept (doc_id == class_id).

    Documents are linked if their texts are equal or their multisets of *words*-word shingles overlap with
    weighted Jaccard >= *similar*; classes are the components.  A pair at exactly 0.8 shares no band with
    probability (1 - 0.8**rows)**bands, about 3e-6.  Null, empty and blank texts have no shingle and are classes of their own.
    Fewer words than *words*: one shingle.  Rows repeated in doc_id and text count as one document.  Empty table: empty
    result.  Other columns are ignored.
    """
    rows_ = stored(labelled(docs, words, similar, bands, rows, block))
    least = rows_.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return spread_join(rows_, least, "label").select("doc_id", "class_id", "class_size", F.col("n").alias("n_shingles"), F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def digest(text: Column) -> Column:
    """MD5 of a text; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def labelled(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per document, that is per doc_id and text: doc_id, digest of the text, n shingles, times (its rows), label
    of its class."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    data = docs.select("doc_id", digest(text).alias("node"), text.cast("binary").alias("data"))
    signed = stored(data.mapInArrow(_sign(words, bands, rows), "doc_id bigint, node binary, n bigint, bands array<bigint>"))
    met = signed.where(F.col("n") > 0).select("node", F.explode("bands").alias("key"))
    own = F.xxhash64(F.lit(-1), "node")
    shared = met.groupBy("key").agg(F.min(own).alias("head"), F.max(own).alias("last")).where("head < last")  # equal texts alone share nothing
    groups = stored(met.join(_small(stored(shared.select("key", "head"))), "key").select("head", "node").distinct())
    wanted = _small(stored(groups.select("node").distinct()))
    own = data.join(wanted, "node", "left_semi").groupBy("node").agg(F.any_value("data").alias("data"))  # equal nodes, equal texts
    bags = stored(own.mapInPandas(_bags(words), "node binary, bag binary, times binary"))

    sizes = stored(groups.groupBy("head").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block))
    small, large = groups.join(sizes, "head", "left_anti"), groups.join(sizes, "head", "left_semi")
    cells, links = _in_cells(small, None, block), None
    if not sizes.isEmpty():
        links = _star_links(large, bags, HEADS, similar)
        cells = cells.withColumn("cell", F.col("cell").cast("bigint")).unionByName(_in_cells(large, components(links), block))
    rows_ = cells.join(bags, "node").repartition("head", "cell").sortWithinPartitions("head", "cell")
    found = stored(rows_.select("head", F.col("cell").cast("bigint").alias("cell"), "node", "bag", "times").mapInPandas(_cells(similar), "a binary, b binary"))
    labels = components(found if links is None else found.union(links))
    alone = F.unhex(F.md5(F.concat(F.lit("alone "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.hex("digest"))))
    rows_ = signed.groupBy("doc_id", F.col("node").alias("digest"), "n").agg(F.count(F.lit(1)).alias("times"))
    rows_ = rows_.withColumn("node", F.when(F.col("n") > 0, F.col("digest")).otherwise(alone))
    return spread_join(stored(rows_), labels, "node", "left").select("doc_id", "digest", "n", "times", F.coalesce("label", "node").alias("label"))


def op5_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document; nulls, empty and long texts, ties and repeats as in near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "documents"))
