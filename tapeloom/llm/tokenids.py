"""Token ids of a corpus, written in ascending document order as range-coded segments, and read back.

The file is a Parquet table of segments (part, segment, data); ``data`` is the format of ``idcoder``.  Parts are ranges
of doc_id; a segment holds whole documents, about SEGMENT ids, and decodes alone, so a lost task repeats one part.
"""

from __future__ import annotations

import os
import struct
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, stored, table, trim
from .idcoder import BLOCK, LANES, read_segment, write_segment
from .shingles import run_hashes

END, SEGMENT, HELD, CHUNK = 1, BLOCK * LANES, 400_000, 1 << 21
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
#: Bytes that are no printable Latin-1 characters go by the characters from 256 on.
_NAMED = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
_NAMES = "".join(chr(_NAMED.get(b, b)) for b in range(256))

_HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n of eight bytes


def _kinds() -> np.ndarray:
    """What a byte of a lower-case text is to the tokenizer.  Apostrophes and "<" begin what it treats in ways of their own; the
    lead bytes C3 to C9 begin the Latin letters that its normalisation keeps."""
    kind = np.full(256, ODD, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    kind[ord("a") : ord("z") + 1] = kind[0x80:0xC0] = kind[0xC3:0xCA] = LETTER
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "<'"]] = SIGN
    return kind


_KIND = _kinds()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memory(dict):
    """Values found lately, in two halves of at most *held*: the older half goes when the newer is full."""

    def __init__(self, held: int) -> None:
        self.held, self.old = held, {}

    def turn(self) -> None:
        if len(self) > self.held:
            self.old = dict(self)
            self.clear()


#: Texts that tell whether a tokenizer is of the kind whose words WordIds can take one by one.
PROBE = [
    " ".join(map(chr, range(33, 127))), "".join(map(chr, range(32, 127))), "Hello  World\nnew\tline's don't I'LL it's", " lead and trail ", "", "12345 3.14 1,000 x2y3 v1.2-rc",
    "foo_bar a-b (x) [y] {z} <tag> <|end|> #1 @me", "Straße École ñandú ÇA ÀÉÎ ǅ Σίσυφος", "日本語 текст 😀 a😀b", "ALLCAPS mixedCase \"quoted\" 'single'", "aaaaaaaaaaaaaaaaaaaaaaaa bbbb...!!!???",
]


class WordIds:
    """Ids of texts by a tokenizer of up to 65536 ids.  Where a tokenizer agrees with it on PROBE, ids go by word: such a one drops white space, never looks across it and does not tell upper case from lower.  What
    stands between spaces, if of Latin letters, digits and ASCII signs, falls into the words of the tokenizer's pattern, which
    its model takes one by one; anything else goes through the whole tokenizer.  Equal words of a batch are looked up once,
    and words found lately are remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.words = Tokenizer.from_file(path), Memory(HELD)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path} has more than 65536 ids")
        # where the last piece of a word is marked, its model takes many words as one text of lines
        self.bare, self.last = Tokenizer(self.tokenizer.model), np.zeros(1 << 16, bool)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        if mark := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            self.last[[i for w, i in self.tokenizer.get_vocab(False).items() if w.endswith(mark)]] = True
        ids, counts = self._whole(PROBE)
        own, sizes = self._by_word(PROBE)
        self.by_word = np.array_equal(counts, sizes) and np.array_equal(ids, own)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """16-bit ids of all texts, END after each, and how many each has."""
        return self._by_word(texts) if self.by_word else self._whole(texts)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.array([i for x in found for i in (*x, END)], np.uint16)
        return ids, np.fromiter((len(x) + 1 for x in found), np.int64, len(found))

    def _by_word(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = ["<|" not in t and "Σ" not in t for t in texts]  # marks of special tokens are as written
        raw = [(t.lower() if p else t).encode() for t, p in zip(texts, plain)]
        data = b"\n".join([*raw, b""])
        stop = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        b = np.frombuffer(data, np.uint8)
        kind = self._kinds(b, [(int(stop[i]) - len(raw[i]) - 1, int(stop[i])) for i, p in enumerate(plain) if not p])
        new = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        start = np.flatnonzero(np.concatenate(([True], new)) & (kind != SPACE))
        end = np.flatnonzero(new & (kind[:-1] != SPACE)) + 1  # the last byte is a space
        code, first = self._same(b, start, end)
        odd = kind[start[first]] == ODD
        found = self._look([data[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())], odd.tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 2
        flat, begin = np.frombuffer(b"".join(found), "<u2"), np.cumsum(sizes) - sizes
        n = sizes.take(code)
        doc = np.searchsorted(stop, start, side="right")
        counts = np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64) + 1
        out = np.empty(int(counts.sum()), np.uint16)
        run, place = np.cumsum(n) - n, np.arange(int(n.sum()))
        out[np.repeat(doc, n) + place] = flat.take(np.repeat(begin.take(code) - run, n) + place)
        out[np.cumsum(counts) - 1] = END
        return out, counts

    @staticmethod
    def _kinds(b: np.ndarray, as_written: list[tuple[int, int]]) -> np.ndarray:
        """Kind of each byte; all of what stands between spaces is odd where a byte of it is."""
        kind = _KIND.take(b)
        for s, e in as_written:
            kind[s:e][b[s:e] >= 0x80] = ODD
        lead = np.flatnonzero((b == 0xC3) | (b == 0xC9))
        after = b.take(lead + 1)
        kind[lead[np.where(b.take(lead) == 0xC3, (after < 0x9F) | (after == 0xB7), after > 0x8F)]] = ODD
        if len(odd := np.flatnonzero(kind == ODD)):
            part = np.cumsum(kind == SPACE)
            bad = np.zeros(int(part[-1]) + 1, bool)
            bad[part[odd]] = True
            kind[bad.take(part) & (kind != SPACE)] = ODD
        return kind

    @staticmethod
    def _same(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A code for each run of bytes, equal for equal runs, and the first run of each code."""
        code, kinds = pd.factorize(run_hashes(b, start, end))
        first = np.empty(len(kinds), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        n = end - start
        model = first.take(code)
        eights = np.ndarray(len(b), "<u8", np.concatenate((b, np.zeros(8, np.uint8))).data, strides=(1,))
        head = eights[start] & _HEADS.take(n, mode="clip")
        differs = (n != n.take(model)).any() or (head != head.take(model)).any()
        if not differs and len(long := np.flatnonzero(n > 8)):
            size, model = n.take(long) - 8, model.take(long)
            place = np.arange(8, 8 + int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            differs = (b.take(place + np.repeat(start.take(long), size)) != b.take(place + np.repeat(start.take(model), size))).any()
        if differs:  # two words of one hash: tell all words apart by their bytes
            data = b.tobytes()
            code, _ = pd.factorize(np.array([data[s:e] for s, e in zip(start.tolist(), end.tolist())], object))
            first = np.empty(int(code.max(initial=-1)) + 1, np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
        return code, first

    def _look(self, words: list[bytes], odd: list[bool]) -> list[bytes]:
        """Ids of distinct words, little-endian."""
        self.words.turn()
        known, old = self.words, self.words.old
        found = list(map(known.get, words))
        new = [i for i, f in enumerate(found) if f is None]
        for i in new:
            found[i] = old.get(words[i])
        whole = [i for i in new if found[i] is None and odd[i]]
        for a in range(0, len(whole), 4096):
            some = whole[a : a + 4096]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([words[i].decode() for i in some], add_special_tokens=False)):
                found[i] = struct.pack(f"<{len(e.ids)}H", *e.ids)
        plain = [i for i in new if found[i] is None]
        for a in range(0, len(plain), 4096):
            some = plain[a : a + 4096]
            for i, f in zip(some, self._plain([words[i].decode() if words[i].isascii() else charmap_decode(words[i], "strict", _NAMES)[0] for i in some])):
                found[i] = f
        for i in new:
            known[words[i]] = found[i]
        return found

    def _plain(self, words: list[str]) -> list[bytes]:
        """Ids of words that the tokenizer's model takes as they are."""
        if self.last.any():
            ids = np.array(self.bare.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, "<u2")
            end = np.flatnonzero(self.last.take(ids)) + 1
            if len(end) == len(words) and end[-1] == len(ids):
                data, end = ids.tobytes(), (2 * end).tolist()
                return [data[a:b] for a, b in zip([0, *end], end)]
        tokenize = self.tokenizer.model.tokenize
        return [np.array([t.id for t in tokenize(w)], "<u2").tobytes() for w in words]


_tokenizers: dict[str, WordIds] = {}


def _encode(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _tokenizers:
            _tokenizers[path] = WordIds(path)
        words, docs, counts, held, size, done, number, part = _tokenizers[path], [], [], [], 0, 0, 0, 0

        def segment() -> pd.DataFrame:
            ids = np.concatenate(held)
            held.clear()
            data = write_segment(docs, np.concatenate(counts).tolist(), ids)
            return pd.DataFrame({"part": [part], "segment": [number], "first": [done], "n_tokens": [len(ids)], "data": [data]})

        for frame in frames:
            part = int(frame["part"].iloc[0]) if len(frame) else part
            own = [None if null else doc for doc, null in zip(frame["doc_id"], frame["null"])]
            texts = frame["text"].tolist()
            for a, b in chunks(texts):
                ids, n = words.batch(texts[a:b])
                docs += own[a:b]
                counts.append(n)
                held.append(ids)
                size += len(ids)
                if size >= SEGMENT:
                    yield segment()
                    docs, counts, done, number, size = [], [], done + size, number + 1, 0
        if docs:
            yield segment()
        trim()

    return run


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters."""
    a = size = 0
    for i, t in enumerate(texts, 1):
        size += len(t)
        if size >= CHUNK or i == len(texts):
            yield a, i
            a, size = i, 0


def write_ids(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Encode every whole text (null: empty) and write segments in ascending doc_id order.

    Returns the written table.  Rows repeated in doc_id are kept, by text hash; null ids come first and stay null; texts of
    any length are encoded whole; an empty table writes no segment; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))  # parts an id, or the null one, that many rows have
    rows = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("null"), "text", F.spark_partition_id().alias("part"))
    coded = rows.mapInPandas(_encode(tokenizer or default_tokenizer()), "part int, segment int, first bigint, n_tokens bigint, data binary")
    return stored(coded, path, codec="none")


def _decode(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, first, data in zip(frame["part"], frame["first"], frame["data"]):
                doc_ids, counts, ids = read_segment(bytes(data))
                at = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
                for a in range(0, len(doc_ids), 512):
                    own = range(a, min(a + 512, len(doc_ids)))
                    raw, b = ids[at[a] : at[own.stop]].astype(f"<u{width}"), (at[a : own.stop + 1] - at[a]).tolist()
                    yield pd.DataFrame({"part": part, "doc_id": pd.array(doc_ids[own.start : own.stop], "Int64"), "local": first + at[own.start : own.stop], "ids": [raw[i:j].tobytes() for i, j in zip(b, b[1:])]})
        trim()

    return run


def read_ids(segments: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian, of *width* bytes: 2, 4 or 8) of each document."""
    ship(segments.sparkSession)
    sizes = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", before.alias("offset"))  # one row per part
    rows = segments.select("part", "first", "data").mapInPandas(_decode(width), "part int, doc_id bigint, local bigint, ids binary")
    return rows.join(F.broadcast(sizes), "part").select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "ids")


def op3_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and checksum of every document's ids, read back from the files; nulls, empty and long texts and repeats as in write_ids()."""
    rows = read_ids(write_ids(table(spark, sf_dir, "documents")), width=4)
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
