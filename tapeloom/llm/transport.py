"""Media columns: documents as MPEG transport streams, and a parser for such streams.

The writer cuts a payload into access units, each one PES packet with a presentation timestamp, behind program tables
that repeat at every random-access unit.  The parser resynchronises on packet size, reads the program tables,
checks continuity counters, drops repeated packets, reassembles the elementary stream and lists timestamps and
random-access points.  Both are pure functions over bytes; Spark maps them over rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stored, table, text_bytes, trim

PACKET, BODY, SAMPLES = 188, 184, 192
PMT_PID, DATA_PID, PRIVATE_DATA, LENGTH_TAG = 0x1000, 0x100, 0x06, 0xA0
UNIT, RANDOM_EVERY, FIRST_PTS, STEP_PTS = SAMPLES * 80, 8, 126_000, 3_600
_COLUMNS = np.arange(PACKET)

UNITS = "array<struct<pts:bigint,random_access:boolean,start:bigint,length:bigint>>"
STREAMS = f"program int, pid int, stream_type int, declared_bytes bigint, packets bigint, lost_sync bigint, continuity_errors bigint, repeated bigint, table_errors bigint, damaged_units bigint, units {UNITS}, payload binary"


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 of program tables: polynomial 04C11DB7, not reflected; 0 over a section with its CRC."""
    c = 0xFFFFFFFF
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ x]
    return c


def pad(text: bytes) -> bytes:
    """Spaces up to a positive multiple of 192 bytes."""
    return text + b" " * (max(SAMPLES, -(-len(text) // SAMPLES) * SAMPLES) - len(text))


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, count: int, section: bytes) -> bytes:
    head = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10 | count & 15, 0])
    return (head + section).ljust(PACKET, b"\xff")


def _stamp(pts: int) -> bytes:
    pts &= (1 << 33) - 1
    return bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, 1 | pts >> 14 & 254, pts >> 7 & 255, 1 | pts << 1 & 254])


def _unit_packets(pes: bytes, pts: int, random: bool, count: int) -> tuple[bytes, int]:
    clock = b""
    if random:
        base = pts & (1 << 33) - 1
        clock = b"\x50" + (base << 15 | 0x7E00).to_bytes(6, "big")
    first = BODY - (len(clock) + 1 if clock else 0)
    packets = 1 + max(0, -(-(len(pes) - first) // BODY))
    out = np.full((packets, PACKET), 255, np.uint8)
    out[:, 0] = 0x47
    out[:, 1] = DATA_PID >> 8
    out[0, 1] |= 0x40
    out[:, 2] = DATA_PID & 255
    out[:, 3] = 0x10 | (count + np.arange(packets)) & 15
    data = np.frombuffer(pes, np.uint8)
    for k in sorted({0, packets - 1}):
        field = clock if k == 0 else b""
        begin = 0 if k == 0 else first + (k - 1) * BODY
        space = BODY - (len(field) + 1 if field else 0)
        piece = data[begin : begin + space]
        spare = space - len(piece)
        if spare and not field:
            field, spare = (b"\x00", spare - 2) if spare > 1 else (b"", 0)
            used = BODY - len(piece) - 1
        else:
            used = len(field) + spare
        if len(piece) < BODY:
            out[k, 3] |= 0x20
            out[k, 4] = used
            out[k, 5 : 5 + len(field)] = np.frombuffer(field, np.uint8)
        out[k, PACKET - len(piece) :] = piece
    if packets > 2:
        out[1:-1, 4:] = data[first : first + (packets - 2) * BODY].reshape(-1, BODY)
    return out.tobytes(), packets


def write_stream(payload: bytes, declared: int) -> bytes:
    """A single-program stream of *payload*; *declared* goes into a private descriptor of the program."""
    pat = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    info = bytes([LENGTH_TAG, 8]) + declared.to_bytes(8, "big")
    stream = bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info + stream)
    out, count = [], 0
    for i, at in enumerate(range(0, len(payload), UNIT)):
        random = i % RANDOM_EVERY == 0
        if random:
            out += [_table_packet(0, i // RANDOM_EVERY, pat), _table_packet(PMT_PID, i // RANDOM_EVERY, pmt)]
        body, pts = payload[at : at + UNIT], FIRST_PTS + i * STEP_PTS
        pes = b"\x00\x00\x01\xbd" + (len(body) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + body
        packets, n = _unit_packets(pes, pts, random, count)
        out.append(packets)
        count += n
    return b"".join(out)


def _sections(packets: np.ndarray, start: np.ndarray) -> tuple[list[bytes], int]:
    """Whole sections with a right CRC carried by the packets of one PID, and how many were wrong."""
    held, good, bad = b"", [], 0
    for p, s in zip(packets, start):
        data = p[s:].tobytes()
        if p[1] & 0x40:
            held, data = held + data[1 : 1 + data[0]], data[1 + data[0] :]
            held = _cut(held, good)[0]
            bad += bool(held)
            held = data
        elif held:
            held += data
        held, wrong = _cut(held, good)
        bad += wrong
    return good, bad


def _cut(held: bytes, good: list[bytes]) -> tuple[bytes, int]:
    bad = 0
    while len(held) >= 3 and held[0] != 0xFF:
        n = 3 + ((held[1] & 15) << 8 | held[2])
        if len(held) < n:
            return held, bad
        if section_crc(held[:n]):
            bad += 1
        else:
            good.append(held[:n])
        held = held[n:]
    return b"", bad


def _align(media: bytes) -> tuple[np.ndarray, int]:
    """Packets that begin with the sync byte, and how many bytes were left out."""
    a = np.frombuffer(media, np.uint8)
    whole = len(a) // PACKET * PACKET
    if whole == len(a) and (a[::PACKET] == 0x47).all():
        return a.reshape(-1, PACKET), 0
    found, at = [], 0
    while at + PACKET <= len(a):
        if a[at] == 0x47 and (at + PACKET == len(a) or at + PACKET < len(a) and a[at + PACKET] == 0x47):
            found.append(a[at : at + PACKET])
            at += PACKET
        else:
            at += 1
    rows = np.array(found, np.uint8).reshape(-1, PACKET)
    return rows, len(a) - rows.size


def _continuity(rows: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Which packets to keep, jumps of the counter, and repeated packets.  fresh: discontinuity is signalled."""
    count = rows[:, 3] & 15
    step = (count[1:].astype(np.int16) - count[:-1]) % 16
    same = (step == 0) & (rows[1:] == rows[:-1]).all(axis=1)
    jump = (step != 1) & ~same & ~fresh[1:]
    return np.concatenate(([True], ~same)), int(jump.sum()), int(same.sum())


def _units(data: bytes, starts: np.ndarray, random: np.ndarray) -> tuple[list[dict], list[bytes], int]:
    units, bodies, damaged, at = [], [], 0, 0
    for begin, end, r in zip(starts, [*starts[1:], len(data)], random):
        head = data[begin : begin + 9]
        if len(head) < 9 or head[:3] != b"\x00\x00\x01":
            damaged += 1
            continue
        size, body = int.from_bytes(head[4:6], "big"), begin + 9 + head[8]
        stop = begin + 6 + size if size else end
        damaged += int(stop > end)
        b = data[body : min(stop, end)]
        s = data[begin + 9 : begin + 14]
        pts = (s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1 if head[7] & 0x80 and len(s) == 5 else None
        units.append({"pts": pts, "random_access": bool(r), "start": at, "length": len(b)})
        bodies.append(b)
        at += len(b)
    return units, bodies, damaged


def read_stream(media: bytes) -> list[dict]:
    """One entry per elementary stream of every program, with its units and its payload."""
    rows, lost = _align(media)
    if not len(rows):
        return []
    pid = (rows[:, 1] & 31).astype(np.int32) << 8 | rows[:, 2]
    field = (rows[:, 3] & 0x20) > 0
    start = np.minimum(4 + np.where(field, 1 + rows[:, 4].astype(np.int32), 0), PACKET)
    use = ((rows[:, 3] & 0x10) > 0) & ((rows[:, 1] & 0x80) == 0)
    flags = np.where(field & (rows[:, 4] > 0), rows[:, 5], 0)

    def tables(p: int) -> tuple[list[bytes], int]:
        own = np.flatnonzero((pid == p) & use)
        if not len(own):
            return [], 0
        keep, _, _ = _continuity(rows[own], (flags[own] & 0x80) > 0)
        return _sections(rows[own[keep]], start[own[keep]])

    sections, wrong = tables(0)
    programs = {int.from_bytes(s[i : i + 2], "big"): (s[i + 2] & 31) << 8 | s[i + 3] for s in sections if s[0] == 0 for i in range(8, len(s) - 4, 4)}
    out = []
    for program, p in sorted(programs.items()):
        if program == 0:
            continue
        sections, bad = tables(p)
        maps = [s for s in sections if s[0] == 2 and int.from_bytes(s[3:5], "big") == program]
        if not maps:
            continue
        s = maps[-1]
        at, declared = 12 + ((s[10] & 15) << 8 | s[11]), None
        info = s[12:at]
        while len(info) >= 2:
            if info[0] == LENGTH_TAG:
                declared = int.from_bytes(info[2 : 2 + info[1]], "big")
            info = info[2 + info[1] :]
        while at < len(s) - 4:
            kind, es = s[at], (s[at + 1] & 31) << 8 | s[at + 2]
            at += 5 + ((s[at + 3] & 15) << 8 | s[at + 4])
            own = np.flatnonzero((pid == es) & use)
            stream = {"program": program, "pid": es, "stream_type": kind, "declared_bytes": declared, "packets": len(rows), "lost_sync": lost, "continuity_errors": 0, "repeated": 0, "table_errors": wrong + bad, "damaged_units": 0, "units": [], "payload": b""}
            if len(own):
                keep, stream["continuity_errors"], stream["repeated"] = _continuity(rows[own], (flags[own] & 0x80) > 0)
                own = own[keep]
                sub, first = rows[own], start[own]
                data = sub[_COLUMNS[None, :] >= first[:, None]].tobytes()
                offset = np.concatenate(([0], np.cumsum(PACKET - first)))[:-1]
                begins = (sub[:, 1] & 0x40) > 0
                units, bodies, stream["damaged_units"] = _units(data, offset[begins], (flags[own] & 0x40)[begins] > 0)
                stream |= {"units": units, "payload": b"".join(bodies)}
            out.append(stream)
    return out


def _write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"doc_id": frame["doc_id"], "media": [write_stream(pad(bytes(t)), len(t)) for t in frame["data"]]})
    trim()


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [{"doc_id": i} | s for i, m in zip(frame["doc_id"], frame["media"]) for s in read_stream(bytes(m))]
        yield pd.DataFrame(found, columns=["doc_id", *(c.split()[0] for c in STREAMS.split(", "))])


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id and media: each text (null: empty) as a transport stream, stored losslessly.  Equal texts give equal
    bytes; repeated rows repeat; an empty table stays empty; other columns are ignored."""
    ship(docs.sparkSession)
    return docs.select("doc_id", text_bytes(F.col("text")).alias("data")).mapInPandas(_write, "doc_id bigint, media binary")


def parse_media(media: DataFrame) -> DataFrame:
    """doc_id, media -> one row per elementary stream.  Null media and bytes without a program give no row."""
    ship(media.sparkSession)
    return media.where("media is not null").select("doc_id", "media").mapInPandas(_read, "doc_id bigint, " + STREAMS)


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc, m in zip(frame["doc_id"], frame["media"]):
            s, = read_stream(bytes(m))
            p = s["payload"]
            rows.append((doc, s["declared_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), s["program"], s["pid"], s["stream_type"], s["packets"], s["continuity_errors"], s["units"]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")])
    trim()


DIGEST = f"doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, program int, pid int, stream_type int, packets bigint, continuity_errors bigint, units {UNITS}"


def op1_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored streams, read back; the units with their timestamps and random-access points are stored as a table,
    from which the feature and the columns first_pts, last_pts and random_access come.  Nulls, empty and long texts, repeated rows and
    an empty table as in media_table()."""
    media = stored(media_table(table(spark, sf_dir, "documents")))
    found = stored(media.mapInPandas(_digest, DIGEST))
    first, last = F.get("units", F.lit(0))["pts"], F.get("units", F.size("units") - 1)["pts"]
    random = F.size(F.filter("units", lambda u: u["random_access"]))
    said = {"program": "program", "pid": "pid", "type": "stream_type", "packets": "packets", "continuity_errors": "continuity_errors", "units": F.size("units"), "random_access": random}
    text = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), (F.col(v) if isinstance(v, str) else v).cast("string")) for k, v in said.items()], F.concat(F.lit("pts="), first.cast("string"), F.lit("-"), last.cast("string")))
    digest = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    return found.select(*digest, text.alias("feature"), random.cast("bigint").alias("random_access"), first.alias("first_pts"), last.alias("last_pts"))
