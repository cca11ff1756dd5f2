"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy on all labelled rows.

A word's vector is the sum of a vector of the word and one of its first bytes, both by hash; filters of several
widths run over the word sequence, each keeps its maximum over the text, and a logistic layer weighs the maxima.
Vectors hold the log-odds of buckets, counted by Spark over all rows that learn.  Those rows are packed into blocks; in every
round each block goes its own steps of descent from common filters, and Spark sums where the blocks end, in integers, so results
do not depend on partitions.  One row in five learns nothing and tells the cut: scores are shifted so that 0.7 is the best cut
on those rows; cuts by language are reported beside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, spread_join, stored, table, trim, unit_hash
from .shingles import word_hashes

BUCKET_BITS, SIZE, FILTERS, WIDTHS, STEM = 18, 6, 8, (1, 2, 3), 5
#: Bytes of text of each label in a sample that a caller asks for.
SAMPLE_BYTES = 64 << 20
#: A language has a cut of its own from LEAST_ROWS rows and LEAST_SHARE of the rows that tell cuts.
CUT, LEAST_ROWS, LEAST_SHARE, LEAST_SEEN, CHUNK_WORDS = 0.7, 30, 0.005, 4, 200_000
ROUNDS, BATCH, RATE, SEED, CHECK = 6, 32, 0.01, 8, 0.2
#: Text of a block that descends by itself, in bytes and (at most, whole texts aside) words.
BLOCK_BYTES, BLOCK_WORDS = 4 << 20, 1 << 20
#: Logits are multiples of 1/GRID and at most MOST, so all of them fit a table of fixed size; sums of states are in units of 1/UNIT.
GRID, MOST, UNIT = 1024, 32, 1 << 26
_PUNCTUATION = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))
_SHIFT = np.uint64(64 - BUCKET_BITS)


def words(text: str) -> np.ndarray:
    """Bucket of each word and of its beginning; bucket 0 is left for padding."""
    data = text.lower().encode("utf-8", "replace").translate(_PUNCTUATION)
    pair = np.stack([word_hashes(data), word_hashes(data, STEM)], axis=1)
    return np.maximum((pair >> _SHIFT).astype(np.int32), 1)


@dataclass
class Model:
    word: np.ndarray
    stem: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    top: np.ndarray
    constant: np.ndarray
    shift: float = 0.0
    thresholds: dict | None = None

    def params(self) -> list[np.ndarray]:
        return [*self.filters, *self.bias, self.top, self.constant]

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        return self.word[ids[:, 0]] + self.stem[ids[:, 1]]

    def maps(self, x: np.ndarray) -> list[np.ndarray]:
        """Filter responses of every width at every position; x ends with padding."""
        n = len(x) - WIDTHS[-1] + 1
        return [sum(x[k : k + n] @ f[k] for k in range(w)) + b for w, f, b in zip(WIDTHS, self.filters, self.bias)]

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        ids, start = joined(docs)
        tops = [np.maximum.reduceat(m, start, axis=0) for m in self.maps(self.vectors(ids))]
        z = np.maximum(np.hstack(tops), 0) @ self.top + self.constant
        return np.rint(np.clip(z, -MOST, MOST) * GRID) / GRID

    def all_logits(self, texts: list[str]) -> np.ndarray:
        out, held, size = [], [], 0
        for t in texts:
            held.append(words(t))
            size += len(held[-1])
            if size > CHUNK_WORDS:
                out.append(self.logits(held))
                held, size = [], 0
        if held:
            out.append(self.logits(held))
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, texts: list[str]) -> np.ndarray:
        return _logistic(self.all_logits(texts) + self.shift)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after the other, each followed by padding that keeps filters inside it."""
    gap = np.zeros((WIDTHS[-1], 2), np.int32)
    parts = [p for d in docs for p in (d, gap)]
    start = np.cumsum([0, *(len(d) + len(gap) for d in docs)])[:-1]
    return np.concatenate([*parts, gap]), start


def untrained(odds: np.ndarray, seed: int = SEED) -> Model:
    """The model before descent; odds: log-odds of each bucket of words and of beginnings, 0 where seldom seen."""
    rng, tables = np.random.default_rng(seed), []
    for own in odds:
        e = (rng.normal(0, 0.05, (1 << BUCKET_BITS, SIZE)) * (own != 0)[:, None]).astype(np.float32)
        e[:, 0] += np.clip(own, -4, 4) / 4
        tables.append(e)
    shape = lambda w: rng.normal(0, 0.2, (w, SIZE, FILTERS)).astype(np.float32)
    filters = [shape(w) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.5 / len(f)
    top = np.abs(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32)
    return Model(*tables, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], top, np.zeros(1, np.float32))


def descend(model: Model, m1: list[np.ndarray], m2: list[np.ndarray], step: int, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
    """One pass of Adam over a block; changes the filters, the logistic layer and the moments in place.  weight: of each label."""
    params, turn = model.params(), rng.permutation(len(docs))
    for at in range(0, len(turn), BATCH):
        batch = turn[at : at + BATCH]
        ids, start = joined([docs[i] for i in batch])
        x = model.vectors(ids)
        end = np.append(start[1:], len(ids) - WIDTHS[-1])
        best, tops = [], []
        for m in model.maps(x):
            t = np.array([s + m[s : max(e - WIDTHS[-1], s + 1)].argmax(axis=0) for s, e in zip(start, end)])
            best.append(t)
            tops.append(np.take_along_axis(m, t, axis=0))
        tops = np.hstack(tops)
        f = np.maximum(tops, 0)
        d = (_logistic(f @ model.top + model.constant) - y[batch]) * weight[y[batch]] / len(batch)
        df = (d[:, None] * model.top * (tops > 0)).astype(np.float32)
        g_filters, g_bias = [], []
        for k, w in enumerate(WIDTHS):
            g = df[:, k * FILTERS : (k + 1) * FILTERS]
            g_filters.append(np.einsum("bk,bkwd->wdk", g, x[best[k][:, :, None] + np.arange(w)]))
            g_bias.append(g.sum(axis=0))
        step += 1
        for p_, g_, a, b in zip(params, [*g_filters, *g_bias, f.T @ d + 1e-4 * model.top, d.sum(keepdims=True)], m1, m2):
            a += 0.1 * (g_ - a)
            b += 0.001 * (g_ * g_ - b)
            p_ -= (RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, positive: int, negative: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """A bounded sample of labelled rows with their texts: lowest keyed hash of doc_id first, per label, as many as the numbers
    and bytes of text allow; each id once, as toxic where labels differ, with its least text."""
    key = F.xxhash64(F.lit("toxic"), "doc_id")
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [known.where(F.col("toxic") == v).orderBy(key, "doc_id").limit(n) for v, n in ((1, positive), (0, negative))]
    few = parts[0].unionByName(parts[1])
    met = docs.select("doc_id", "text", "lang").join(F.broadcast(few), "doc_id")
    once = stored(met.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("row")).select("doc_id", "toxic", "row.*"))
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("toxic").orderBy(key, "doc_id"))
    fits = once.select("doc_id", so_far.alias("bytes"), "toxic").where(F.col("bytes") <= most_bytes).select("doc_id")  # ids and sizes alone
    return once.join(F.broadcast(fits), "doc_id")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All labelled rows with their texts; each id once, as toxic where labels differ, with its least text."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    met = spread_join(docs.select("doc_id", "text", "lang"), known, "doc_id")
    return met.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("row")).select("doc_id", "toxic", "row.*")


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of hashed words from rows in order of blocks."""
    docs, y, size, now, part = [], [], 0, None, 0

    def block() -> pd.DataFrame:
        sizes = np.fromiter(map(len, docs), "<i4", len(docs))
        return pd.DataFrame({"block": [now], "part": [part], "ids": [np.concatenate(docs).astype("<i4").tobytes()], "sizes": [sizes.tobytes()], "y": [np.array(y, np.int8).tobytes()]})

    for frame in frames:
        for b, text, toxic in zip(frame["block"], frame["text"], frame["toxic"]):
            if docs and (b != now or size >= BLOCK_WORDS):
                yield block()
                docs, y, size, part = [], [], 0, part + 1 if b == now else 0
            now = b
            docs.append(words(text))
            y.append(toxic)
            size += len(docs[-1])
    if docs:
        yield block()
    trim()


def _unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    for frame in frames:
        for b, part, ids, sizes, y in zip(frame["block"], frame["part"], frame["ids"], frame["sizes"], frame["y"]):
            yield b, part, np.split(np.frombuffer(ids, "<i4").reshape(-1, 2), np.cumsum(np.frombuffer(sizes, "<i4"))[:-1]), np.frombuffer(y, np.int8).astype(np.int64)


def _seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each label that hold each bucket (of beginnings: from 2**BUCKET_BITS on)."""
    for _, _, docs, y in _unpacked(frames):
        seen = np.zeros((2, 2 << BUCKET_BITS), np.int64)
        for d, label in zip(docs, y):
            seen[label, np.unique(d + [0, 1 << BUCKET_BITS])] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"bucket": at, "clean": seen[0, at], "toxic": seen[1, at]})
    trim()


def _odds(blocks: DataFrame, total: np.ndarray) -> np.ndarray:
    """Log-odds of a bucket's presence between toxic and other texts, less a standard error; 0 where seldom seen.  A table of fixed size."""
    seen = blocks.mapInPandas(_seen, "bucket int, clean bigint, toxic bigint").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    both = F.col("clean") + F.col("toxic")
    ratio = F.log((F.col("toxic") + 0.5) / (float(total[1]) + 1)) - F.log((F.col("clean") + 0.5) / (float(total[0]) + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    odds = F.signum(ratio) * F.greatest(F.abs(ratio) - error, F.lit(0.0))
    found = seen.where(both >= LEAST_SEEN).select("bucket", odds.cast("float").alias("odds")).where("odds != 0").toPandas()
    odds = np.zeros(2 << BUCKET_BITS)
    odds[found["bucket"]] = found["odds"]
    odds = odds.reshape(2, -1)
    odds[:, 0] = 0
    return odds


def _round(blocks: DataFrame, start: Broadcast[Model], state: np.ndarray, step: int, turn: int, weight: np.ndarray) -> np.ndarray:
    """State after every block went its steps: parameters, first moments and roots of second moments, each block by its rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(len(state), np.int64), 0
        for b, part, docs, y in _unpacked(frames):
            model, m1, m2 = _model_at(start.value, state)
            descend(model, m1, m2, step, docs, y, weight, np.random.default_rng([SEED, turn, b, part]))
            own = np.concatenate([p.ravel() for p in (*model.params(), *m1, *map(np.sqrt, m2))], dtype=np.float64)
            total += np.rint(own * UNIT).astype(np.int64) * len(docs)
            rows += len(docs)
        yield pd.DataFrame({"at": np.arange(-1, len(state)), "total": np.concatenate(([rows], total))})
        trim()

    sums = blocks.mapInPandas(run, "at int, total bigint").groupBy("at").agg(F.sum("total").alias("total")).toPandas().sort_values("at")["total"].to_numpy()
    return sums[1:] / sums[0] / UNIT


def _model_at(start: Model, state: np.ndarray) -> tuple[Model, list[np.ndarray], list[np.ndarray]]:
    """A model with its own copies of the parameters and moments in *state*."""
    shapes, found, at = [p.shape for p in start.params()], [], 0
    for shape in shapes * 3:
        n = int(np.prod(shape))
        found.append(state[at : at + n].reshape(shape).astype(np.float32))
        at += n
    n, w = len(shapes), len(WIDTHS)
    own = replace(start, filters=found[:w], bias=found[w : 2 * w], top=found[2 * w], constant=found[2 * w + 1])
    return own, found[n : 2 * n], [m * m for m in found[2 * n :]]


def cuts(logits: DataFrame) -> DataFrame:
    """lang, rows and the logit in the middle of the gap that gives the best F1, from all rows of (lang, toxic, z); the row
    without a language is for all.  Logits are multiples of 1/GRID, so their table is of fixed size a language."""
    seen = logits.groupBy("lang", "z").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
    seen = seen.groupBy("z").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).select(F.lit(None).cast("string").alias("lang"), "z", "n", "hits").unionByName(seen.where(F.col("lang").isNotNull()))
    whole, down = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy(F.desc("z"))
    f1 = 2 * F.sum("hits").over(down) / (F.sum("n").over(down) + F.sum("hits").over(whole))
    below = F.coalesce(F.lead("z").over(down), F.col("z") - 2)
    found = seen.select("lang", "n", "hits", f1.alias("f1"), "z", ((F.col("z") + below) / 2).alias("cut"))
    best = F.max(F.struct("f1", (-F.col("z")).alias("_"), "cut"))["cut"]
    found = found.groupBy("lang").agg(F.sum("n").alias("rows"), F.sum("hits").alias("hits"), best.alias("cut"), F.max("z").alias("most"))
    return found.select("lang", "rows", "hits", F.when(F.col("hits") > 0, F.col("cut")).otherwise(F.col("most") + 1).alias("cut"))


def train(docs: DataFrame, labels: DataFrame, positive: int | None = None, negative: int | None = None) -> Model:
    """Train on all labelled rows: four in five by hash of doc_id give counts and filters, the fifth the cuts (all, where the fifth
    lacks a label).  With *positive* and *negative*, on a bounded sample instead.  The model, of fixed size, comes to the driver.

    Labels that are null or neither 0 nor 1, and rows without an id or a document, are left out; a null text counts as empty.  Repeated
    ids count once.  No labelled row, or one label only: a model that predicts no text to be toxic."""
    ship(docs.sparkSession)
    rows = labelled(docs, labels) if positive is None or negative is None else sample(docs, labels, positive, negative)
    text = F.coalesce("text", F.lit(""))
    rows = stored(rows.select("doc_id", text.alias("text"), F.octet_length(text).alias("bytes"), F.col("toxic").cast("int").alias("toxic"), "lang", (unit_hash(F.lit("check"), "doc_id") < CHECK).alias("check")))
    sums = {(r["check"], r["toxic"]): r for r in rows.groupBy("check", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()}
    n = {k: r["n"] for k, r in sums.items()}
    total = np.array([n.get((False, v), 0) for v in (0, 1)], np.float64)
    if not all(total[v] + n.get((True, v), 0) for v in (0, 1)):
        return replace(untrained(np.zeros((2, 1 << BUCKET_BITS))), shift=-30.0)
    many = max(1, -(-sum(r["bytes"] for k, r in sums.items() if not k[0]) // BLOCK_BYTES))
    learn = rows.where("not check").select("doc_id", "text", "toxic", F.pmod(F.xxhash64(F.lit("block"), "doc_id"), F.lit(many)).cast("int").alias("block"))
    learn = learn.repartition(many, "block").sortWithinPartitions("block", F.xxhash64("doc_id"), "doc_id")
    blocks = stored(learn.select("block", "text", "toxic").mapInPandas(_pack, "block int, part int, ids binary, sizes binary, y binary"))
    first = untrained(_odds(blocks, total))
    if total.all():
        start = docs.sparkSession.sparkContext.broadcast(first)
        weight = 0.5 * total.sum() / total
        state = np.concatenate([p.ravel() for p in first.params()], dtype=np.float64)
        state = np.concatenate([state, np.zeros(2 * len(state))])
        each = max(1, round(total.sum() / many / BATCH))
        for turn in range(ROUNDS):
            state = _round(blocks, start, state, turn * each, turn, weight)
        first = _model_at(first, state)[0]
    told = rows.where("check") if n.get((True, 0)) and n.get((True, 1)) else rows
    found = cuts(_logits(told, first).select("lang", "toxic", "z")).where(F.col("lang").isNull() | (F.col("rows") >= max(LEAST_ROWS, LEAST_SHARE * sum(v for k, v in n.items() if k[0])))).collect()
    shift = np.log(CUT / (1 - CUT)) - next(r.cut for r in found if r.lang is None)
    return replace(first, shift=float(shift), thresholds={r.lang: float(_logistic(r.cut + shift)) for r in found if r.lang is not None and r.hits})


def _logits(rows: DataFrame, model: Model) -> DataFrame:
    """The rows with z, the logit of their text before the shift."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def logit(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.all_logits(texts.tolist()), dtype="float64")

    return rows.withColumn("z", logit("text"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, lang_threshold, lang_predicted.  The score sees the text only (null: empty); a language without
    a threshold of its own takes 0.7.  Rows repeat as given; an empty table gives an empty result."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()), dtype="float64")

    rows = docs.select("doc_id", toxic(F.coalesce("text", F.lit(""))).alias("score"), "lang")
    own = [F.when(F.col("lang") == k, F.lit(v)) for k, v in sorted((model.thresholds or {}).items())]
    rows = rows.withColumn("lang_threshold", F.coalesce(*own, F.lit(CUT)))
    return rows.withColumn("lang_predicted", (F.col("score") >= F.col("lang_threshold")).cast("int")).drop("lang")


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of the labels that are not held out; nulls, empty and long texts as in score() and train()."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = train(docs, labels.where(part != 1))
    scored = score(docs, model)
    return scored.select("doc_id", (part == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "lang_threshold", "lang_predicted")
