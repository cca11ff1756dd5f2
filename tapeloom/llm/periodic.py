"""Periodic runs in word sequences by block convolution.

A run of period q and length L has L - q positions at which word i equals word i + q.  At a dyadic scale, aligned blocks of B words meet
the distances from 2B - 1 to 4B - 2: whatever run has its period among them holds a whole block whose copy lies one period on.  An exact
integer number-theoretic transform of squared differences of word labels finds every distance at which a block has no mismatch
in the window that follows it; each distance seeds an extension to both sides, which compares the words themselves.  Blocks
whose first or last words recur nowhere in their window can match nowhere, and blocks that lie with their window inside a run of a
period no longer than themselves can only find it again: neither is transformed, and a match inside such a run is not extended.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, trim

#: A prime with roots of unity of every order up to 2**23, and one of its generators.
PRIME, GENERATOR = 998_244_353, 3
P = np.uint64(PRIME)
LEAST = 12
#: Numbers in the arrays of one transform call; a block that needs more goes alone.
CELLS = 1 << 17
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


@lru_cache(maxsize=64)
def _powers(half: int, back: bool) -> np.ndarray:
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    root = pow(root, PRIME - 2, PRIME) if back else root
    out = np.ones(1, np.uint64)
    while len(out) < half:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), PRIME)) % P])
    return out


def _under(x: np.ndarray) -> np.ndarray:
    """Numbers below 2 * PRIME to their remainder: the difference wraps round where it would be negative."""
    return np.minimum(x, x - P)


def forward(x: np.ndarray) -> np.ndarray:
    """Transform of every row in place; the result is in bit-reversed order."""
    rows, size = x.shape
    half = size // 2
    while half:
        y = x.reshape(rows, -1, 2, half)
        a, b = y[:, :, 0].copy(), y[:, :, 1]
        y[:, :, 0] = _under(a + b)
        y[:, :, 1] = (a + P - b) * _powers(half, False) % P
        half //= 2
    return x


def backward(x: np.ndarray) -> np.ndarray:
    """Inverse of forward()."""
    rows, size = x.shape
    half = 1
    while half < size:
        y = x.reshape(rows, -1, 2, half)
        a, b = y[:, :, 0].copy(), y[:, :, 1] * _powers(half, True) % P
        y[:, :, 0], y[:, :, 1] = _under(a + b), _under(a + P - b)
        half *= 2
    return x * np.uint64(pow(size, PRIME - 2, PRIME)) % P


def matches(ids: np.ndarray, at: np.ndarray, block: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, distances) of blocks of labels without a mismatch at a distance from *low* to *high*.

    Labels are word numbers reduced so far that a block's sum of squared differences stays below the prime: it is 0 only where all
    labels agree.  Different words may share a label, so extensions compare words."""
    label = ids % int(((PRIME - 1) / block) ** 0.5)
    label = np.concatenate([label, np.zeros(high + block, np.int64)])
    squares = np.concatenate([[0], np.cumsum(label * label)])
    width = high - low + block
    size = 1 << (width + block - 2).bit_length()
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    step = max(1, CELLS // size)
    for i in range(0, len(at), step):
        p = at[i : i + step, None]
        x, y = np.zeros((len(p), size), np.uint64), np.zeros((len(p), size), np.uint64)
        x[:, :width] = label[p + low + np.arange(width)]
        y[:, :block] = label[p + np.arange(block - 1, -1, -1)]
        cross = backward(forward(x) * forward(y) % P)[:, block - 1 : block + high - low].astype(np.int64)
        d = np.arange(low, high + 1)
        apart = squares[p + block] - squares[p] + squares[p + d + block] - squares[p + d]
        row, k = np.nonzero(apart % PRIME == 2 * cross % PRIME)
        found.append((p[row, 0], d[k]))
    return tuple(np.concatenate(x) for x in zip(*found))


class Recurrence:
    """Where stretches of *length* words occur again: hashes and positions in one sorted array."""

    def __init__(self, ids: np.ndarray, length: int) -> None:
        h, span = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
        while span < length:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h[:-span] * np.uint64(0x94D049BB133111EB) + h[span:]
            span *= 2
        self.bits = np.uint64(max(1, len(ids).bit_length()))
        self.high = h >> self.bits << self.bits
        self.keys = np.sort(self.high | np.arange(len(h), dtype=np.uint64))

    def within(self, at: np.ndarray, low: int, high: int) -> np.ndarray:
        """Whether the stretch at each position occurs again from *low* to *high* words on; no occurrence is missed."""
        if not len(self.keys):
            return np.zeros(len(at), bool)
        first = self.high[at] | np.minimum(at + low, (1 << int(self.bits)) - 1).astype(np.uint64)
        last = self.high[at] | np.minimum(at + high, (1 << int(self.bits)) - 1).astype(np.uint64)
        i = np.searchsorted(self.keys, first)
        return (i < len(self.keys)) & (self.keys[np.minimum(i, len(self.keys) - 1)] <= last)


def _agree_right(x: np.ndarray, i: int, d: int) -> int:
    """First position from *i* on at which the words *d* apart differ, or at which there is none."""
    end, step = len(x) - d, 32
    while i < end:
        j = min(end, i + step)
        differ = x[i:j] != x[i + d : j + d]
        k = int(differ.argmax())
        if differ[k]:
            return i + k
        i, step = j, step * 2
    return max(i, end)


def _agree_left(x: np.ndarray, i: int, d: int) -> int:
    """Least position from which on all words up to *i* equal those *d* further on."""
    step = 32
    while i > 0:
        j = max(0, i - step)
        differ = (x[j:i] != x[j + d : i + d])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return i - k
        i, step = j, step * 2
    return 0


def _covered(known: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether some known (start, end), in ascending order, covers each stretch."""
    if not len(known):
        return np.zeros(len(start), bool)
    before = np.searchsorted(known[:, 0], start, "right") - 1
    return (before >= 0) & (np.maximum.accumulate(known[:, 1])[before] >= end)


def find_runs(ids: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all maximal runs of length max(least, 2 * period) or more, by start and period.

    ids: word numbers; runs are sought up to a length of *longest* words (texts put one behind the other share no number)."""
    n = len(ids)
    if longest < least:
        return np.empty((0, 3), np.int64)
    runs: dict[tuple[int, int], int] = {}
    again = {g: Recurrence(ids, g) for g in (4, 8) if n >= g}
    block, stride, low, high = 4, 2, 1, 14
    while 2 * low <= longest and n >= block + low:
        at = np.arange(0, n - block - low + 1, stride)
        gram = min(block, 8)
        at = at[again[gram].within(at, low, high)]
        if block > gram:
            at = at[again[gram].within(at + block - gram, low, high)]
        known = np.array(sorted((s, e) for (s, e), q in runs.items() if q <= block), np.int64).reshape(-1, 2)
        at = at[~_covered(known, at, at + high + block)]
        starts, apart = matches(ids, at, block, low, high)
        new = ~_covered(known, starts, starts + apart + block)
        starts, apart = starts[new], apart[new]
        order = np.lexsort((starts, apart))
        last, to = 0, 0
        for p, d in zip(starts[order].tolist(), apart[order].tolist()):
            if d == last and p + block <= to:
                continue
            end = _agree_right(ids, p, d)
            if end < p + block:  # labels agree, words don't
                continue
            start, last, to = _agree_left(ids, p, d), d, end
            if end + d - start >= max(least, 2 * d):
                key = (start, end + d)
                runs[key] = min(d, runs.get(key, d))
        block, stride, low, high = 2 * block, 2 * block, 4 * block - 1, 8 * block - 2
    rows = np.array([(s, e - s, q) for (s, e), q in runs.items()], np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


Reshape = Callable[[int | None, int], "np.ndarray | None"]


def _search(reshape: Reshape | None, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            words, parts, base = [], [], 0
            for key, text in zip(keys, texts):
                own = (text.as_py() or b"").split()  # bytes split at the six ASCII white-space characters alone
                number = {w: i for i, w in enumerate(dict.fromkeys(own), base)}
                ids = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
                order = reshape(key, len(own)) if reshape and own else None
                if order is not None:
                    ids, own = ids[order], [own[i] for i in order.tolist()]
                words.append(own)
                parts.append(ids)
                base += len(number)
            sizes = np.array([len(x) for x in parts], np.int64)
            first = np.concatenate([[0], np.cumsum(sizes)])
            found = find_runs(np.concatenate(parts), int(sizes.max(initial=0)), least) if parts else np.empty((0, 3), np.int64)
            of = np.searchsorted(first, found[:, 0], "right") - 1
            edge = np.zeros(first[-1] + 1, np.int64)
            np.add.at(edge, found[:, 0] + found[:, 2], 1)
            np.add.at(edge, found[:, 0] + found[:, 1], -1)
            dropped = np.cumsum(edge) > 0
            kept = []
            for i, own in enumerate(words):
                gone = dropped[first[i] : first[i + 1]]
                kept.append(b" ".join([w for w, g in zip(own, gone.tolist()) if not g] if gone.any() else own))
            fields = [pa.array(found[:, 0] - first[of]), pa.array(found[:, 1]), pa.array(found[:, 2])]
            offsets = pa.array(np.searchsorted(of, np.arange(len(words) + 1)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), lists, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
        trim()

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, reshape: Reshape | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period) and the text without repeats, per row of *docs*.

    A run is a stretch of words with smallest period q, of length max(least, 2q) or more, which no neighbouring word extends.
    ``collapsed`` are the words outside every run's part after its first period, joined by a blank.  *reshape* may return, for an id and a
    number of words, which words to take in which order.  Texts count whole, each in one task; null, empty and blank texts have no
    words and no run; a null doc_id stays; rows repeat as given; an empty table gives an empty result; other columns
    play no part.  least: 12 or more, as the smallest scale finds no shorter runs of every period.
    """
    if least < LEAST:
        raise ValueError(f"least must be {LEAST} or more")
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_search(reshape, least), f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word order that makes about every tenth document periodic from some word on, by the checksum of its id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the longest one (ties: first, then shortest period), and digests of all runs and of the text without
    repeats.  Nulls, empty and long texts as in periodic_runs(); a null doc_id leaves the words as they are."""
    found = periodic_runs(table(spark, sf_dir, "documents"), reshape=looped)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("top"), listed.alias("listed"), "collapsed")
    length = -F.col("top.l")
    return rows.select(
        "doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"),
        F.expr("(-1000 * top.l) div top.period").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
