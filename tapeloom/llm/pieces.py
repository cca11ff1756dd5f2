"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The vocabulary comes from a public model file, the merging is done here: an agenda of candidate merges, best score
first; a candidate is skipped if a keyed hash of (seed, document, part, place, piece) falls below the dropout rate, so each
occurrence of a word draws for itself.  No piece joins a letter to a following space or line break (checked when the model
is opened), so a text is cut there and each part is segmented by itself.  Parts of equal length run side by side as
numpy lanes: every step takes the best open candidate of each lane.  Long parts have an agenda of their own.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import ship, table, trim
from .shingles import mix

SPACE = "▁"
_PART = re.compile(r" *[^ \n]+| +|\n")
_ACROSS = re.compile(r"[^ ] |\n.|.\n", re.S)
_MASK = (1 << 64) - 1
_PIECE, _PLACE, _DOC = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x9E3779B97F4A7C15
#: Parts of more ids than PLACES are segmented one by one; NOTHING stands beside the first and the last id.
PLACE_BITS, PLACES, NEVER, NOTHING, LANES, CHUNK = 5, 30, 1 << 30, 0xFFFF, 8192, 1 << 19


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pairs:
    """Rank of the merge of two pieces, by two-choice hashing: a pair is in one of two slots."""

    def __init__(self, ranks: dict[int, int]) -> None:
        self.bits = max(8, (4 * len(ranks)).bit_length())
        self.factors = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
        self.table = np.full(1 << self.bits, -1, np.int64)
        place = [[(k * int(f) & _MASK) >> 64 - self.bits for f in self.factors] for k in ranks]
        held: dict[int, tuple[int, int]] = {}
        for (key, rank), slots in zip(ranks.items(), place):
            item, slot = (key, rank), slots[0]
            for _ in range(500):
                held[slot], item = item, held.get(slot)
                if item is None:
                    break
                a, b = ((item[0] * int(f) & _MASK) >> 64 - self.bits for f in self.factors)
                slot = b if slot == a else a
            else:
                raise ValueError("no place for a pair")
        for slot, (key, rank) in held.items():
            self.table[slot] = key << 16 | rank

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NEVER where two pieces don't merge."""
        key = left.astype(np.int64) << 16 | right
        out = np.full(key.shape, NEVER, np.int32)
        for f in self.factors:
            found = self.table.take((key.view(np.uint64) * f >> np.uint64(64 - self.bits)).view(np.int64))
            out = np.where(found >> 16 == key, (found & 0xFFFF).astype(np.int32), out)
        return out


@dataclass
class Pieces:
    """A vocabulary and how to segment with it."""

    path: str
    rate: float
    seed: int

    def __post_init__(self) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        bytes_ = [model.is_byte(i) for i in range(n)]
        ids = {p: i for i, p in enumerate(names) if not special[i] and not bytes_[i]}
        if n >= NOTHING or any(_ACROSS.search(p.replace(SPACE, " ")) for p in ids):
            raise ValueError(f"pieces of {self.path} join what is cut apart here")
        order = sorted(ids.values(), key=lambda i: (-model.get_score(i), i))
        self.piece_of, rank_of = np.array(order, np.int32), {i: k for k, i in enumerate(order)}
        self.below = np.uint64(int(self.rate * (1 << 24)))
        pairs = {ids[p[:k]] << 16 | ids[p[k:]]: rank_of[i] for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.pairs, self.rank = Pairs(pairs), pairs.get
        self.chars = {c: i for c, i in ids.items() if len(c) == 1 and c != SPACE} | {" ": ids[SPACE]}
        self.id_of = np.full(1 << 16, -1, np.int32)
        for c, i in self.chars.items():
            if ord(c) < 1 << 16:
                self.id_of[ord(c)] = i
        self.byte_ids = {int(names[i][1:-1], 16): i for i in range(n) if bytes_[i]}
        self.raw = [b"" if special[i] else bytes([int(p[1:-1], 16)]) if bytes_[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]

    def _skipped(self, keys: np.ndarray, pieces: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether the keyed hash drops the merge into a piece at a place."""
        h = keys + pieces.astype(np.uint64) * np.uint64(_PIECE) + places.astype(np.uint64) * np.uint64(_PLACE)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
        return h >> np.uint64(40) < self.below

    def _agenda(self, ids: list[int], key: int) -> list[int]:
        """Ids of one part of any length, with a heap."""
        ids, n, rank, below = list(ids), len(ids), self.rank, int(self.below)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list = []

        def offer(left: int, right: int) -> None:
            r = rank(ids[left] << 16 | ids[right])
            if r is not None:
                heapq.heappush(agenda, (r, left, right, ids[left] << 16 | ids[right]))

        for left in range(n - 1):
            offer(left, left + 1)
        while agenda:
            r, left, right, pair = heapq.heappop(agenda)
            if after[left] != right or right >= n or ids[right] < 0 or ids[left] << 16 | ids[right] != pair:
                continue
            i = int(self.piece_of[r])
            h = key + i * _PIECE + (left + 1) * _PLACE & _MASK
            if ((h ^ h >> 32) * 0xBF58476D1CE4E5B9 & _MASK) >> 40 < below:
                continue
            ids[left], ids[right] = i, -1
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                offer(left, nxt)
            if before[left] >= 0:
                offer(before[left], left)
        return [i for i in ids if i >= 0]

    def _lanes(self, ids: np.ndarray, open_: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """ids: one column of ids per part, NOTHING above and below; open_: rank and place of each pair of neighbours.
        Yields columns and their segmentation, -1 where an id went into another piece."""
        places, column = len(ids), np.arange(len(keys))
        after, before = (np.broadcast_to(np.arange(places, dtype=np.int32)[:, None] + k, ids.shape).copy() for k in (1, -1))
        best = open_.min(axis=0)
        while True:
            live = np.flatnonzero(best < NEVER)
            if len(live) < 0.7 * len(column):
                done = best >= NEVER
                yield column[done], ids[1:-1, done]
                if not len(live):
                    return
                ids, open_, after, before = (x.take(live, axis=1) for x in (ids, open_, after, before))
                column, keys, best, live = column[live], keys[live], best[live], np.arange(len(live))
            n = len(column)
            flat, flat_open, flat_after, flat_before = (x.reshape(-1) for x in (ids, open_, after, before))
            top = best.take(live)
            place, piece = top & (1 << PLACE_BITS) - 1, self.piece_of.take(top >> PLACE_BITS)
            at = place * n + live
            if self.below:
                drop = self._skipped(keys.take(live), piece, place)
                flat_open[at[drop]] = NEVER
                go = np.flatnonzero(~drop)
                live, place, piece, at = live.take(go), place.take(go), piece.take(go), at.take(go)
            right = flat_after.take(at) * n + live
            next_, left = flat_after.take(right), flat_before.take(at)
            beyond, before_ = next_ * n + live, left * n + live
            flat_after[at], flat_before[beyond] = next_, place
            flat[at], flat[right] = piece, -1
            flat_open[right] = NEVER
            m = len(live)
            rank = self.pairs.ranks(np.concatenate((piece, flat.take(before_))), np.concatenate((flat.take(beyond), piece)))
            spot = np.concatenate((place, left))
            rank = np.where(rank == NEVER, NEVER, rank << PLACE_BITS | spot).astype(np.int32)
            flat_open[at], flat_open[before_] = rank[:m], rank[m:]
            best = open_.min(axis=0)

    def _ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids that parts begin with, one after the other, and how many each has; characters outside the vocabulary
        become bytes."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = self.id_of.take(np.minimum(points, np.uint32(0xFFFF)).astype(np.int64))
        unknown = np.flatnonzero((ids < 0) | (points >= 0xFFFF))
        if not len(unknown):
            return ids, sizes
        owner = np.repeat(np.arange(len(parts)), sizes)
        out, at = [], 0
        for u in unknown.tolist():
            c = chr(points[u])
            own = [self.chars[c]] if c in self.chars else [self.byte_ids[b] for b in c.encode("utf-8")]
            out += [ids[at:u], np.array(own, np.int32)]
            sizes[owner[u]] += len(own) - 1
            at = u + 1
        return np.concatenate([*out, ids[at:]]), sizes

    def encode_many(self, texts: list[str], docs: list[int]) -> list[np.ndarray]:
        """Piece ids of each text, a space put before it as the model does; an empty text has none."""
        found = [_PART.findall(" " + t) if t else [] for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        parts = [p for own in found for p in own]
        if not parts:
            return [np.empty(0, np.uint16) for _ in texts]
        code = {p: i for i, p in enumerate(dict.fromkeys(parts))}
        codes = np.fromiter(map(code.__getitem__, parts), np.int64, len(parts))
        flat, sizes = self._ids(list(code))
        first = np.cumsum(sizes) - sizes
        start = np.array([doc * _DOC + self.seed & _MASK for doc in docs], np.uint64)
        turn = np.arange(len(parts)) - np.repeat(np.cumsum(counts) - counts, counts)
        keys = mix(np.repeat(mix(start), counts) + turn.astype(np.uint64))

        n, runs = np.empty(len(parts), np.int64), []
        size_of = sizes.take(codes)
        order = np.argsort(np.minimum(size_of, PLACES + 1).astype(np.uint8), kind="stable")
        ends = np.searchsorted(size_of.take(order), np.arange(PLACES + 2), side="right") if len(order) else []
        number = np.empty(len(sizes), np.int64)
        for size in range(1, PLACES + 1):
            own = order[ends[size - 1] : ends[size]]
            if not len(own):
                continue
            kinds = np.flatnonzero(sizes == size)
            number[kinds] = np.arange(len(kinds))
            ids = np.full((size + 2, len(kinds)), NOTHING, np.int32)
            ids[1:-1] = flat.take(first.take(kinds) + np.arange(size)[:, None])
            open_ = np.full(ids.shape, NEVER, np.int32)
            if size > 1:
                rank = self.pairs.ranks(ids[1:-2], ids[2:-1])
                open_[1:-2] = np.where(rank == NEVER, NEVER, rank << PLACE_BITS | np.arange(1, size, dtype=np.int32)[:, None])
            for a in range(0, len(own), LANES):
                some = own[a : a + LANES]
                of = number.take(codes.take(some))
                for column, made in self._lanes(ids.take(of, axis=1), open_.take(of, axis=1), keys.take(some)):
                    kept = made.T >= 0
                    n[some[column]] = kept.sum(axis=1)
                    runs.append((some[column], made.T[kept].astype(np.uint16)))
        for i in order[ends[PLACES] :].tolist():
            a = first[codes[i]]
            own_ids = self._agenda(flat[a : a + size_of[i]].tolist(), int(keys[i]))
            n[i] = len(own_ids)
            runs.append((np.array([i]), np.array(own_ids, np.uint16)))
        begin = np.concatenate(([0], np.cumsum(n)))
        out = np.empty(begin[-1], np.uint16)
        for own, ids in runs:
            length = n.take(own)
            out[np.repeat(begin.take(own) - (np.cumsum(length) - length), length) + np.arange(len(ids))] = ids
        return np.split(out, begin.take(np.cumsum(counts))[:-1])

    def encode(self, text: str, doc: int) -> np.ndarray:
        return self.encode_many([text], [doc])[0]

    def chunks(self, texts: list[str], docs: list[int]) -> Iterator[np.ndarray]:
        """encode_many() over any number of texts, about CHUNK characters at a time."""
        a = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK or i + 1 == len(texts):
                yield from self.encode_many(texts[a : i + 1], docs[a : i + 1])
                a, size = i + 1, 0

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()])[1:].decode()


_open: dict[tuple, Pieces] = {}


def pieces(path: str, rate: float, seed: int) -> Pieces:
    """One vocabulary per Python worker and setting."""
    key = (path, rate, seed)
    if key not in _open:
        _open[key] = Pieces(*key)
    return _open[key]


def encode_documents(docs: DataFrame, rate: float = 0.1, seed: int = 9, model: str | None = None) -> DataFrame:
    """All columns of *docs* and ids: array of piece ids of the text, a space put before it as the model does.

    Null and empty texts: no ids.  Copies of a text under different doc_id vary; equal (doc_id, text, seed) agree.  A null
    doc_id counts as 0.  Characters outside the vocabulary, and the space mark itself, become bytes.  Texts of any length are
    encoded whole; repeated rows repeat; an empty table stays empty; a column named ids is replaced.
    """
    ship(docs.sparkSession)
    model = model or default_model()
    rows = docs.drop("ids")
    key = next(f"key_{i}" for i in range(len(rows.columns) + 1) if f"key_{i}" not in {c.lower() for c in rows.columns})
    at, names = rows.columns.index("text"), [*rows.columns, "ids"]
    schema = StructType([*rows.schema.fields, StructField("ids", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model, rate, seed)
        for batch in batches:
            *columns, keys = batch.columns
            made = list(p.chunks([t or "" for t in columns[at].to_pylist()], keys.to_pylist()))
            offsets = np.cumsum([0, *map(len, made)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint16), *made]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names)
        trim()

    return rows.withColumn(key, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Adds decoded: the text that *ids* spell; null ids: null."""
    ship(encoded.sparkSession)
    model = model or default_model()

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        p = pieces(model, 0.0, 0)
        return pd.Series([None if x is None else p.decode(np.asarray(x, np.int64)) for x in ids], dtype=object)

    return encoded.withColumn("decoded", text("ids"))


def op9_merge_dropout(spark: SparkSession, sf_dir: str, rate: float = 0.1, seed: int = 9) -> DataFrame:
    """Per document: number of pieces, CRC-32 of their ids (unsigned 32-bit, little-endian), CRC-32 of the decoded
    text and whether it equals the text.  Nulls, empty and long texts as in encode_documents()."""
    ship(spark)
    model = default_model()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model, rate, seed)
        for frame in frames:
            texts, rows = frame["text"].tolist(), []
            for text, ids in zip(texts, p.chunks(texts, frame["key"].tolist())):
                back = p.decode(ids)
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(back.encode()), back == text))
            made = pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "decoded_crc32", "lossless"])
            made.insert(0, "doc_id", frame["doc_id"].array)
            yield made
        trim()

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInPandas(run, "doc_id bigint, n_pieces bigint, ids_crc32 bigint, decoded_crc32 bigint, lossless boolean")
