"""Adaptive context-mixing range coder for sequences of 16-bit token ids.

Ids are cut into blocks of equal length; each block has its own model, coder and CRC-32, so blocks decode alone.  All
blocks of a segment run side by side as numpy lanes.  Per id, tables of order 2 and order 1 each predict the id that
last followed their context; whether the order-2 prediction holds, the order-1 prediction, or neither, is one symbol.
Its distribution mixes two adaptive ones, chosen by the confidence of order 2 and of order 1, with a weight that
follows which of them did better lately.  An id that neither predicts is coded by its order-0 distribution, which every
block starts from and which the segment's head holds.  The coder keeps 48 bits of low and range and emits 16-bit
words; carries are settled at the end.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, LANES = 2048, 4096
MAGIC, HEAD = b"TLCM\x02", "<5sIIQII"
BITS, ZERO_BITS, RATE, WEIGHT_BITS, WEIGHT_RATE = 14, 16, 4, 8, 4
TOTAL, ZERO_TOTAL, LEAST = 1 << BITS, 1 << ZERO_BITS, 32
ONE_BITS, TWO_BITS = 9, 11
SURE, MOST_SURE = 1 << 16, 3
ROWS_TWO, ROWS_ONE, SLAB = 4, 8, 32
_U = np.uint64
_AIMS = np.array([[TOTAL - LEAST] * 2, [LEAST, TOTAL - LEAST], [LEAST, LEAST]]) + (1 << 15)


def _fixed(dtype: type, *values: int) -> list[np.ndarray]:
    """Numbers as arrays without dimensions, which numpy takes faster than Python's."""
    return [np.array(v, dtype) for v in values]


# By symbol (0: order 2 was right, 1: order 1 was, 2: neither), for both shares of a row in one number, 16 bits each: what they go
# to, above an offset that keeps differences positive, and which of them learn.
_AIM = (_AIMS[:, 0] | _AIMS[:, 1] << 16).astype(np.uint32)
_LEARNS = np.array([0xFFF, 0xFFF0FFF, 0xFFF0FFF], np.uint32)
_OFFSET, _RATE = _fixed(np.uint32, 0x8000800, RATE)
_ID, _SURE, _CAP, _16, _17, _31 = _fixed(np.int32, 0xFFFF, SURE, MOST_SURE * SURE, 16, 17, 31)
_WEIGHT_BITS, _WEIGHT_RATE, _BITS, _INNER, _NONE, _ONE = _fixed(np.int32, WEIGHT_BITS, WEIGHT_RATE, BITS, TOTAL - 2, 0, 1)
_MASK_TWO, _MASK_ONE, _LATER, _5, _4 = _fixed(np.uint32, (1 << TWO_BITS) - 1, (1 << ONE_BITS) - 1, 30011, 5, 4)
_SPREAD = np.array(40503, np.uint32)
_1, _63 = _fixed(np.int64, 1, 63)
_16U, _LOW, _1U = _fixed(np.uint32, 16, 0xFFFF, 1)
_LAST = np.array(ZERO_TOTAL - 1.0)
_U1, _U4, _U16, _U32, _U63, _UBITS, _UZERO, _UTOTAL, _NARROW = _fixed(_U, 1, 4, 16, 32, 63, BITS, ZERO_BITS, TOTAL, 1 << 32)


class _Model:
    """Adaptive state of n lanes: predictions of both orders, their confidence, and the mixed distribution.  Arrays with two rows
    hold order 2 and order 1.  Steps are bound by the number of numpy calls and np.where() is slow, so choices are masks or
    lookups.  Places are always inside the tables; mode="clip" spares numpy a pass that checks them."""

    def __init__(self, n: int):
        self.ids = np.zeros((n << TWO_BITS) + (n << ONE_BITS), np.int32)
        self.rows = np.full(n * (ROWS_TWO + ROWS_ONE), TOTAL // 8 | TOTAL // 16 << 16, np.uint32)
        self.weight = np.full(n, 1 << WEIGHT_BITS - 1, np.int32)
        lane = np.arange(n)
        self.base = np.array([lane << TWO_BITS, (n << TWO_BITS) + (lane << ONE_BITS)])
        self.base_row = np.array([lane * ROWS_TWO, n * ROWS_TWO + lane * ROWS_ONE], np.int32)
        self.shrink(n)

    def shrink(self, n: int) -> None:
        """Only the first n lanes go on."""
        self.base, self.base_row, self.weight = self.base[:, :n].copy(), self.base_row[:, :n].copy(), self.weight[:n].copy()
        self.lane, self.step = np.arange(n), np.array(n)
        self.named, self.shares = np.zeros((3, n), np.int32), np.empty((2, 2, n), np.int32)

    def places(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Where the contexts of ids stand, by the two ids before each (32-bit, unsigned); one or many steps."""
        spread, at = last * _SPREAD, np.empty((*last.shape[:-1], *self.base.shape), np.int64)
        np.add((spread ^ before * _LATER) >> _4 & _MASK_TWO, self.base[0], out=at[..., 0, :])
        np.add(spread >> _5 & _MASK_ONE, self.base[1], out=at[..., 1, :])
        return at

    def predict(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Look the contexts up; the two inner bounds of the symbol."""
        self.at, self.entry = at, self.ids.take(at, mode="clip")
        self.known = np.bitwise_and(self.entry, _ID, out=self.named[:2])
        row = self.entry >> _16
        row[1] += row[1]
        row[1] += (self.known[0] == self.known[1]).view(np.int8)
        row += self.base_row
        self.row = row.astype(np.int64)
        self.own = self.rows.take(self.row, mode="clip")
        own, shares = self.own.view(np.int32), self.shares
        np.bitwise_and(own, _ID, out=shares[0])
        np.right_shift(own, _16, out=shares[1])
        lead = shares[:, 0] - shares[:, 1]
        self.lead = lead[0]
        p, q = mixed = lead * self.weight
        mixed >>= _WEIGHT_BITS
        mixed += shares[:, 1]
        inner = _INNER - p
        inner *= q
        inner >>= _BITS
        inner += p
        inner += _ONE
        return p, inner

    def learn(self, ids: np.ndarray, wrong: np.ndarray, symbol: np.ndarray) -> None:
        """wrong: whether each order's prediction was."""
        more, less = self.lead > _NONE, self.lead < _NONE
        better = (more ^ (more ^ less) & wrong[0]).astype(np.int32)
        better <<= _WEIGHT_BITS
        better -= self.weight
        better >>= _WEIGHT_RATE
        self.weight += better
        learns = _LEARNS.take(symbol, mode="clip")
        share = _AIM.take(symbol, mode="clip") - self.own
        share >>= _RATE
        share &= learns
        share += self.own
        share -= learns & _OFFSET
        self.rows[self.row] = share
        entry = wrong.astype(np.int32)
        entry <<= _17  # twice SURE: less by SURE if wrong, else more
        np.subtract(self.entry, entry, out=entry)
        entry += _SURE
        gone = entry - _SURE
        gone >>= _31
        np.minimum(entry, self.known | _CAP, out=entry)
        fresh = (ids + _SURE) ^ entry
        fresh &= gone
        entry ^= fresh
        self.ids[self.at] = entry


def order_zero(counts: np.ndarray) -> np.ndarray:
    """Counts of ids as shares of ZERO_TOTAL, at least 1 where an id occurs."""
    seen = np.flatnonzero(counts)
    share = np.zeros(len(counts), np.int64)
    if len(seen):
        share[seen] = np.maximum(1, counts[seen] * (ZERO_TOTAL - len(seen)) // counts.sum())
        share[seen[counts[seen].argmax()]] += ZERO_TOTAL - share.sum()
    return share


def _lengths(total: int) -> np.ndarray:
    return np.minimum(BLOCK, total - np.arange(0, total, BLOCK))


def _zero(share: np.ndarray) -> np.ndarray:
    """Begin of each id's share, and its size less 1, in one number; ids without one are not asked for."""
    return (np.concatenate(([0], np.cumsum(share)[:-1])) << 16 | share - 1 & 0xFFFF).astype(np.uint32)


def _room(steps: int) -> int:
    """32-bit places for the words of a block: a symbol and an id take 30 bits at most.  An odd number of cache lines, so that
    blocks do not compete for the same ones."""
    return (2 * steps + 3 + 31) // 32 * 32 + 16


def _short(span: np.ndarray) -> np.ndarray:
    """1 where a span, below 1 << 63, is too narrow for a symbol, else 0."""
    return span - _NARROW >> _U63


def _encode_blocks(grid: np.ndarray, lengths: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
    """grid: one column of ids per block.  16-bit words per block."""
    lanes, steps, full = len(lengths), int(lengths[0]), int(lengths[-1])
    model, zero = _Model(lanes), _zero(share)
    all_low, all_span, most = np.zeros(lanes, _U), np.full(lanes, 1 << 48, _U), _room(steps)
    words, all_at = np.zeros(lanes * most, np.uint32), np.arange(lanes) * most
    ids = np.zeros((steps + 2, lanes), np.uint16)
    ids[2:] = grid[:steps]
    for a, b in [(a, min(a + SLAB, stop)) for start, stop in ((0, full), (full, steps)) for a in range(start, stop, SLAB)]:
        n = lanes if a < full else lanes - 1
        if n < len(model.weight):
            model.shrink(n)
        low, span, at = all_low[:n], all_span[:n], all_at[:n]
        before, last, own = (ids[a + i : b + i, :n].astype(t) for i, t in enumerate((np.uint32, np.uint32, np.int32)))
        places, parts = model.places(last, before), zero.take(own, mode="clip")
        begins, widths = (parts >> _16U).astype(_U), (parts & _LOW).astype(_U) + _U1
        bounds = np.zeros((4, n), _U)
        bounds[3] = TOTAL
        for t in range(b - a):
            bounds[1], bounds[2] = model.predict(places[t])
            wrong = model.known != own[t]
            symbol = (wrong[0].view(np.int8) + (wrong[0] & wrong[1]).view(np.int8)).astype(np.int64)
            missed = (_1 - symbol >> _63).view(_U)
            place = symbol * model.step
            place += model.lane
            start = bounds.take(place, mode="clip")
            place += model.step
            part = bounds.take(place, mode="clip")
            part -= start
            unit = span >> _UBITS
            start *= unit
            low += start
            part *= unit
            unit = part >> _UZERO
            start = begins[t] * unit
            start &= missed
            low += start
            unit *= widths[t]
            unit ^= part
            unit &= missed
            np.bitwise_xor(part, unit, out=span)
            word, short = low >> _U32, _short(span)
            words[at] = word
            at += short.view(np.int64)
            word *= short
            word <<= _U32
            low -= word
            short <<= _U4
            low <<= short
            span <<= short
            while (narrow := span < _NARROW).any():
                some = np.flatnonzero(narrow)  # few lanes
                word = low[some] >> _U32
                words[at[some]] = word
                at[some] += 1
                low[some] = low[some] - (word << _U32) << _U16
                span[some] <<= _U16
            model.learn(own[t], wrong, symbol)
    for _ in range(3):
        words[all_at] = all_low >> _U32
        all_at += 1
        all_low = (all_low & _U(0xFFFFFFFF)) << _U16
    sizes = all_at - np.arange(lanes) * most
    flat = np.concatenate([words[i * most : i * most + n] for i, n in enumerate(sizes.tolist())])
    while len(at := np.flatnonzero(flat >> 16)):
        carry = flat[at] >> 16
        flat[at] &= 0xFFFF
        flat[at - 1] += carry
    return np.split(flat.astype("<u2"), np.cumsum(sizes)[:-1])


def _decode_blocks(streams: np.ndarray, start: np.ndarray, lengths: np.ndarray, share: np.ndarray) -> np.ndarray:
    """streams: all words; start: where each block's begin.  One column of ids per block."""
    lanes, steps = len(lengths), int(lengths[0])
    model, zero = _Model(lanes), _zero(share)
    named = np.repeat(np.arange(len(share)).astype(np.uint16), share)
    grid = np.zeros((steps, lanes), np.uint16)
    streams = np.concatenate([streams, np.zeros(4, streams.dtype)])
    end, at = len(streams) - 1, start.astype(np.int64)
    code, span = np.zeros(lanes, _U), np.full(lanes, 1 << 48, _U)
    for _ in range(3):
        code = code << _U16 | streams.take(at, mode="clip")
        at += 1
    bounds, before, last = np.zeros((4, lanes), _U), np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)

    for t in range(steps):
        n = lanes if lengths[-1] > t else lanes - 1
        if n < len(model.weight):
            model.shrink(n)
            code, span, at, bounds, before, last = code[:n], span[:n], at[:n], bounds[:, :n].copy(), before[:n], last[:n]
        unit = span >> _UBITS
        bounds[1], bounds[2] = model.predict(model.places(last, before))
        bounds[1:3] *= unit
        np.multiply(unit, _UTOTAL, out=bounds[3])
        above = code >= bounds[1:3]
        symbol = (above[0].view(np.int8) + above[1].view(np.int8)).astype(np.int64)
        missed = (_1 - symbol >> _63).view(_U)
        place = symbol * model.step
        place += model.lane
        low = bounds.take(place, mode="clip")
        part = bounds.take(place + model.step, mode="clip")
        part -= low
        code -= low
        unit = part >> _UZERO
        share_at = code / unit  # of numbers below 1 << 48, so rounding never reaches the next whole number
        ids = named.take(np.minimum(share_at, _LAST).astype(np.int64), mode="clip")
        parts = zero.take(ids, mode="clip")
        low = (parts >> _16U).astype(_U)
        low *= unit
        low &= missed
        code -= low
        parts &= _LOW
        parts += _1U
        unit *= parts
        unit ^= part
        unit &= missed
        np.bitwise_xor(part, unit, out=span)
        short = _short(span)
        word = short * streams.take(at, mode="clip")
        at += short.view(np.int64)
        short <<= _U4
        code <<= short
        code |= word
        span <<= short
        while (narrow := span < _NARROW).any():
            some = np.flatnonzero(narrow)  # few lanes
            code[some] = code[some] << _U16 | streams.take(at[some], mode="clip")
            span[some] <<= _U16
            at[some] = np.minimum(at[some] + 1, end)
            if not span.all():
                raise ValueError("damaged block")
        model.named[2] = ids
        ids = model.named.take(place, mode="clip")
        grid[t, :n] = ids
        model.learn(ids, model.known != ids, symbol)
        before, last = last, ids.astype(np.uint32)
    return grid


def write_segment(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """A self-contained segment: documents (an id may be None), their token counts, the order-0 distribution, and coded blocks
    with their checksums."""
    ids = np.ascontiguousarray(ids, "<u2")
    lengths, share = _lengths(len(ids)), order_zero(np.bincount(ids, minlength=1 << 16))
    null = np.array([d is None for d in doc_ids], np.uint8)
    table = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(counts, "<u4").tobytes() + null.tobytes(), 1)
    seen = np.flatnonzero(share)
    zero = zlib.compress(np.diff(seen, prepend=0).astype("<u2").tobytes() + share[seen].astype("<u4").tobytes(), 6)
    parts, sizes, sums = [], [], []
    for a in range(0, len(lengths), LANES):
        own = lengths[a : a + LANES]
        flat = ids[a * BLOCK : a * BLOCK + int(own.sum())]
        grid = np.zeros((len(own), BLOCK), np.uint16)
        grid.reshape(-1)[: len(flat)] = flat
        coded = _encode_blocks(np.ascontiguousarray(grid.T), own, share)
        parts += [c.tobytes() for c in coded]
        sizes += [len(c) for c in coded]
        sums += [zlib.crc32(grid[i, :n].tobytes()) for i, n in enumerate(own)]
    head = struct.pack(HEAD, MAGIC, len(doc_ids), len(lengths), len(ids), len(table), len(zero))
    return b"".join([head, table, zero, np.array(sizes, "<u4").tobytes(), np.array(sums, "<u4").tobytes(), *parts])


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts and ids of a segment; ValueError if a checksum fails."""
    magic, docs, blocks, total, size, zero = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a segment")
    at = struct.calcsize(HEAD)
    table = zlib.decompress(data[at : at + size])
    doc_ids, counts, null = np.frombuffer(table, "<i8", docs), np.frombuffer(table, "<u4", docs, 8 * docs), np.frombuffer(table, np.uint8, docs, 12 * docs)
    at += size
    seen = zlib.decompress(data[at : at + zero])
    share, n = np.zeros(1 << 16, np.int64), len(seen) // 6
    share[np.cumsum(np.frombuffer(seen, "<u2", n), dtype=np.int64)] = np.frombuffer(seen, "<u4", n, 2 * n)
    at += zero
    sizes, sums = np.frombuffer(data, "<u4", blocks, at), np.frombuffer(data, "<u4", blocks, at + 4 * blocks)
    words = np.frombuffer(data, "<u2", offset=at + 8 * blocks)
    start, lengths, out = np.cumsum([0, *sizes.tolist()]), _lengths(total), []
    for a in range(0, blocks, LANES):
        own = lengths[a : a + LANES]
        first, stop = start[a], start[a + len(own)]
        grid = np.ascontiguousarray(_decode_blocks(words[first:stop], start[a : a + len(own)] - first, own, share).T)
        for i, n in enumerate(own):
            if zlib.crc32(grid[i, :n].tobytes()) != sums[a + i]:
                raise ValueError(f"checksum of block {a + i}")
            out.append(grid[i, :n])
    return [None if none else int(d) for d, none in zip(doc_ids, null)], counts, np.concatenate(out) if out else np.empty(0, np.uint16)
