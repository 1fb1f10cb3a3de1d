"""MPEG transport streams as media columns.

Writing: a payload of 8-bit samples becomes access units of 576 bytes; AUS_PER_PES of them make an elementary packet
with a presentation time stamp, cut into 188-byte transport packets after a program association and a program map
table. Every RAP_EVERY-th elementary packet is a random-access point and carries a clock reference.

Reading takes nothing but the stored bytes: it finds the program's elementary stream through the tables (their CRC is
verified), checks each PID's continuity counter, joins the elementary packets and lists time stamps with
random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.llm.common import read_table, tidy

UNIT, AUS_PER_PES, RAP_EVERY = 576, 40, 4
PMT_PID, MEDIA_PID, PROGRAM = 0x1000, 0x0100, 1
#: Ticks of the 90 kHz clock for one access unit (24 ms).
TICKS = 2160


def crc_mpeg(data: bytes) -> int:
    """CRC-32 with polynomial 04C11DB7, not reflected, no final xor."""
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


PAT = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = _section(2, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, cc: int, section: bytes) -> bytes:
    return b"\x47" + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10 | cc, 0]) + section.ljust(183, b"\xff")


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 29 & 0xE) | 1, t >> 22 & 0xFF, (t >> 14 & 0xFE) | 1, t >> 7 & 0xFF, (t << 1 & 0xFE) | 1])


def _unstamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def pad(data: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of the access unit."""
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload whose length is a positive multiple of UNIT."""
    out: list[bytes] = []
    head = (0x4000 | MEDIA_PID).to_bytes(2, "big")
    plain = MEDIA_PID.to_bytes(2, "big")
    first = [b"\x47" + plain + bytes([0x10 | c]) for c in range(16)]
    cc, step = 0, UNIT * AUS_PER_PES
    for n, at in enumerate(range(0, len(payload), step)):
        t = n * AUS_PER_PES * TICKS & 0x1FFFFFFFF
        data = payload[at : at + step]
        body = b"\x00\x00\x01\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, t) + data
        if rap := n % RAP_EVERY == 0:
            k = n // RAP_EVERY & 15
            out += [_table_packet(0, k, PAT), _table_packet(PMT_PID, k, PMT)]
        field_ = b"\x50" + (t << 15 | 0x7E00).to_bytes(6, "big") if rap else b"\x00"
        room = 183 - len(field_)
        stuff = b"\xff" * max(0, room - len(body))
        out.append(b"\x47" + head + bytes([0x30 | cc, len(field_) + len(stuff)]) + field_ + stuff + body[:room])
        cc = cc + 1 & 15
        end = room + (len(body) - room) // 184 * 184 if len(body) > room else len(body)
        for p in range(room, end, 184):
            out += [first[cc], body[p : p + 184]]
            cc = cc + 1 & 15
        if end < len(body):
            rest = body[end:]
            fill = 183 - len(rest)
            out += [b"\x47" + plain + bytes([0x30 | cc, fill]), (b"\x00".ljust(fill, b"\xff") if fill else b""), rest]
            cc = cc + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes = b""
    #: (time stamp, payload offset, is a random-access point) of each elementary packet.
    index: list[tuple[int, int, bool]] = field(default_factory=list)
    packets: int = 0
    continuity_errors: int = 0
    table_errors: int = 0
    stream_type: int = -1
    clock: int = -1


def _parsed_section(body: bytes, table: int) -> bytes | None:
    """A table section's bytes after its eight header bytes and without CRC; None if broken."""
    s = body[1 + body[0] :]
    if len(s) < 12 or s[0] != table:
        return None
    end = 3 + ((s[1] & 15) << 8 | s[2])
    if end < 12 or end > len(s) or crc_mpeg(s[:end]):
        return None
    return s[8 : end - 4]


def demux(media: bytes) -> Stream:
    """Reads a stream; lost sync, gaps of a counter and broken tables count as errors, not as crashes.

    A packet may be sent twice in a row: the second is passed over, a third is an error. Where sync is lost, reading goes
    on at the next sync byte that another follows a packet later, or that ends the stream.
    """
    out = Stream()
    maps: set[int] = set()
    media_pid = -1
    counters: dict[int, int] = {}
    known: dict[bytes, bytes | None] = {}
    units: list[tuple[int, bool, list[bytes]]] = []
    last: dict[int, tuple[int, bool]] = {}  # of a PID: where its last packet is, and whether that was a repeat
    at = -188
    while (at := at + 188) <= len(media) - 188:
        a, b, c, d = media[at : at + 4]
        if a != 0x47:
            out.continuity_errors += 1
            sync = media.find(0x47, at + 1)
            while sync >= 0 and sync + 188 < len(media) and media[sync + 188] != 0x47:
                sync = media.find(0x47, sync + 1)
            if sync < 0:
                break
            at = sync - 188
            continue
        out.packets += 1
        if b & 0x80:
            out.continuity_errors += 1
            continue
        pid = (b & 0x1F) << 8 | c
        start, rap = at + 4, False
        if d & 0x20:
            length = media[start]
            if length and media[start + 1] & 0x40:
                rap = True
            if length >= 7 and media[start + 1] & 0x10 and out.clock < 0:
                out.clock = int.from_bytes(media[start + 2 : start + 8], "big") >> 15
            start += 1 + length
        if not d & 0x10:
            continue
        if counters.get(pid, d - 1 & 15) != d - 1 & 15:
            before, again = last[pid]
            if counters[pid] == d & 15 and not again and media[before + 4 : before + 188] == media[at + 4 : at + 188]:
                last[pid] = at, True
                continue
            out.continuity_errors += 1
        counters[pid], last[pid] = d & 15, (at, False)
        if pid == media_pid:
            if b & 0x40:
                units.append((-1, rap, []))
            if units:
                units[-1][2].append(media[start : at + 188])
        elif pid == 0 or pid in maps:
            body = media[start : at + 188]
            if body not in known:
                known[body] = _parsed_section(body, 0 if pid == 0 else 2)
            if (section := known[body]) is None:
                out.table_errors += 1
            elif pid == 0:
                maps |= {(section[i + 2] & 0x1F) << 8 | section[i + 3] for i in range(0, len(section) - 3, 4) if section[i] or section[i + 1]}
            else:
                i = 4 + ((section[2] & 15) << 8 | section[3])
                if i + 5 <= len(section):
                    out.stream_type, media_pid = section[i], (section[i + 1] & 0x1F) << 8 | section[i + 2]
    parts, size = [], 0
    for _, rap, pieces in units:
        pes = b"".join(pieces)
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
            out.continuity_errors += 1
            continue
        length = int.from_bytes(pes[4:6], "big")
        data = pes[9 + pes[8] : 6 + length if length else len(pes)]
        out.index.append((_unstamp(pes[9:14]) if pes[7] & 0x80 else -1, size, rap))
        parts.append(data)
        size += len(data)
    out.payload = b"".join(parts)
    return out


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes (unpadded), media binary: every whole text as a transport stream. A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):  # few streams in memory at a time
                part = batch.slice(i, 256)
                data = [x.as_py() or b"" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([mux(pad(x)) for x in data], pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("string").cast("binary").alias("b")).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_bytes bigint, media binary")


FEATURES = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, index array<struct<pts:bigint,offset:bigint,random_access:boolean>>, continuity_errors bigint, table_errors bigint"


def read_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_bytes and what the stored bytes hold: payload hashes, time-stamp index with random-access points, error counts.

    feature: stream type, elementary packets, random-access points, first and last time stamp, sum of samples.
    A null media cell gives the values of an empty stream.
    """
    index_type = pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("random_access", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(2):
                media = cell.as_py() or b""
                s = demux(media)
                p = s.payload
                last = s.index[-1][0] if s.index else -1
                feature = f"type={s.stream_type};pes={len(s.index)};rap={sum(x[2] for x in s.index)};clock={s.clock};pts={s.index[0][0] if s.index else -1}-{last};sum={sum(p)}"
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, [{"pts": a, "offset": b, "random_access": c} for a, b, c in s.index], s.continuity_errors, s.table_errors))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), index_type, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[id_col, "n_bytes", *(f.split(" ")[0] for f in FEATURES.split(", "))])

    kind = dict(media.dtypes)[id_col]
    return media.select(id_col, "n_bytes", "media").mapInArrow(tidy(run), f"`{id_col}` {kind}, n_bytes bigint, {FEATURES}")


def op4_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a stored stream and what is read back; a null text is empty, null and repeated ids pass through."""
    return read_media(store_media(read_table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        F.size("index").alias("n_packets"), F.size(F.filter("index", lambda x: x["random_access"])).alias("n_random_access"), "continuity_errors", "table_errors",
    )
