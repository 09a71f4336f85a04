"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

Writing puts a payload into one private elementary stream of one program: program tables first, then one elementary
packet (PES) per unit of payload, with presentation times, a clock reference and random-access marks. Reading accepts streams of
other writers as well: program association and map tables over several packets, any number of programs and elementary
streams, adaptation fields, repeated packets, lost packets and elementary packets of open length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the standard.
PACKET = 188
SYNC = 0x47
CRC_POLYNOMIAL = 0x04C11DB7
NULL_PID = 0x1FFF
PRIVATE_STREAM_1 = 0xBD
PRIVATE_DATA_TYPE = 0x06
CLOCK = 90_000

MAP_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT_BYTES = 16_384
UNIT_TICKS = CLOCK // 25
ACCESS_EVERY = 8  # units from one random-access point to the next
BATCH_BYTES = 1 << 24


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32) << np.uint32(24)
    for _ in range(8):
        value = np.where(value >> np.uint32(31), (value << np.uint32(1)) ^ np.uint32(CRC_POLYNOMIAL), value << np.uint32(1))
    return value


_CRC = [int(x) for x in _crc_table()]


def section_crc(content: bytes) -> int:
    """CRC-32 of program tables; 0 over a section that ends with its own checksum."""
    value = 0xFFFFFFFF
    for byte in content:
        value = ((value << 8) & 0xFFFFFFFF) ^ _CRC[(value >> 24) ^ byte]
    return value


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return head + section + b"\xff" * (PACKET - len(head) - len(section))


def _stamp(mark: int, ticks: int) -> bytes:
    """A 33-bit time in five bytes, with the four leading bits ``mark``."""
    return bytes(
        [mark << 4 | ticks >> 29 & 0x0E | 1, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1]
    )


_TABLES = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big"))) + _table_packet(
    MAP_PID,
    _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_DATA_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0"),
)


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload. Equal payloads give equal streams."""
    out, counter = [_TABLES], 0
    for nth, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        unit = payload[at : at + UNIT_BYTES]
        ticks = nth * UNIT_TICKS & (1 << 33) - 1
        body = (
            b"\0\0\1" + bytes([PRIVATE_STREAM_1]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, ticks) + unit
        )
        # Adaptation field of the first packet: random access and clock reference (base, no extension).
        flags = 0x10 | (0x40 if nth % ACCESS_EVERY == 0 else 0)
        clock = (ticks << 15 | 0x7E00).to_bytes(6, "big")
        count = max(1, -(-(len(body) + 8) // 184))
        packets = np.full((count, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(count)) & 0x0F
        counter += count
        packets[0, 1] |= 0x40
        content = np.frombuffer(body, np.uint8)
        spare = count * 184 - 8 - len(content)
        room = np.zeros(count, np.int64)  # adaptation bytes per packet, the length byte included
        room[0] = 8
        room[-1] += spare
        for k in {0, count - 1}:
            if room[k]:
                packets[k, 3] |= 0x20
                packets[k, 4] = room[k] - 1
                if room[k] > 1:
                    packets[k, 5] = 0
        packets[0, 5] = flags
        packets[0, 6:12] = np.frombuffer(clock, np.uint8)
        packets[:, 4:][np.arange(184)[None, :] >= room[:, None]] = content
        out.append(packets.tobytes())
    return b"".join(out)


def _sections(chunks: list[tuple[bool, bytes]]) -> list[bytes]:
    """Whole table sections with a right checksum from the payloads of one PID (unit start, bytes)."""
    found, held = [], None
    for begins, content in chunks:
        if begins:
            gap = content[0] if content else 0
            if held is not None:
                held += content[1 : 1 + gap]
                found += _whole(held)[0]
            held = content[1 + gap :]
        elif held is not None:
            held += content
        if held is not None:
            whole, held = _whole(held)
            found += whole
    return [s for s in found if section_crc(s) == 0]


def _whole(content: bytes) -> tuple[list[bytes], bytes]:
    found = []
    while len(content) >= 3 and content[0] != 0xFF:
        size = 3 + (int.from_bytes(content[1:3], "big") & 0x0FFF)
        if len(content) < size:
            break
        found.append(content[:size])
        content = content[size:]
    return found, content


class Stream:
    """Packets of a transport stream: tables, continuity and elementary packets."""

    def __init__(self, content: bytes):
        whole = len(content) // PACKET
        packets = np.frombuffer(content, np.uint8, whole * PACKET).reshape(whole, PACKET)
        self.lost_sync = int((packets[:, 0] != SYNC).sum()) + (len(content) % PACKET > 0)
        packets = packets[(packets[:, 0] == SYNC) & (packets[:, 1] < 0x80)]  # without transport errors
        self.packets = packets
        self.pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
        self.begins = (packets[:, 1] & 0x40) > 0
        self.counter = packets[:, 3] & 0x0F
        self.has_payload = (packets[:, 3] & 0x10) > 0
        adapted = (packets[:, 3] & 0x20) > 0
        size = np.where(adapted, packets[:, 4].astype(np.int64) + 1, 0)
        self.start = np.minimum(4 + size, PACKET)
        flags = np.where(adapted & (packets[:, 4] > 0), packets[:, 5], 0)
        self.jump, self.access = (flags & 0x80) > 0, (flags & 0x40) > 0
        self.programs = self._programs()

    def _programs(self) -> dict[int, dict[int, int]]:
        """Program number -> {elementary PID: stream type}."""
        maps: dict[int, int] = {}
        for section in _sections(self._chunks(0)):
            if section[0] == 0 and section[5] & 1:
                for k in range(8, len(section) - 4 - 3, 4):
                    program = int.from_bytes(section[k : k + 2], "big")
                    if program:
                        maps[program] = int.from_bytes(section[k + 2 : k + 4], "big") & 0x1FFF
        programs: dict[int, dict[int, int]] = {}
        for program, pid in maps.items():
            for section in _sections(self._chunks(pid)):
                if section[0] == 2 and section[5] & 1 and int.from_bytes(section[3:5], "big") == program:
                    streams, k = {}, 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
                    while k + 5 <= len(section) - 4:
                        streams[int.from_bytes(section[k + 1 : k + 3], "big") & 0x1FFF] = section[k]
                        k += 5 + (int.from_bytes(section[k + 3 : k + 5], "big") & 0x0FFF)
                    programs[program] = streams
        return programs

    def _chunks(self, pid: int) -> list[tuple[bool, bytes]]:
        rows = np.flatnonzero((self.pid == pid) & self.has_payload)
        return [(bool(self.begins[k]), self.packets[k, self.start[k] :].tobytes()) for k in rows]

    def continuity(self, pid: int) -> tuple[np.ndarray, np.ndarray]:
        """Packets of a PID that carry new payload, and which of them follow a loss."""
        rows = np.flatnonzero((self.pid == pid) & self.has_payload)
        if not len(rows):
            return rows, np.zeros(0, bool)
        step = (np.diff(self.counter[rows].astype(np.int16)) & 0x0F)
        # A packet may be sent twice; everything but the clock reference is then the same.
        same = np.zeros(len(rows), bool)
        same[1:] = (step == 0) & (self.packets[rows[1:], 12:] == self.packets[rows[:-1], 12:]).all(axis=1)
        lost = np.zeros(len(rows), bool)
        lost[1:] = (step != 1) & ~same[1:] & ~self.jump[rows[1:]]
        return rows[~same], lost[~same]

    def elementary(self, pid: int) -> tuple[bytes, list[dict], int]:
        """Payload of an elementary stream, its units, and the number of continuity errors."""
        rows, lost = self.continuity(pid)
        if not len(rows):
            return b"", [], 0
        inside = np.arange(PACKET)[None, :] >= self.start[rows][:, None]
        flat = self.packets[rows][inside].tobytes()
        ends = np.cumsum(PACKET - self.start[rows])
        first = np.flatnonzero(self.begins[rows])
        edges = [*(ends[first] - (PACKET - self.start[rows][first])).tolist(), len(flat)]
        payload, units, size = [], [], 0
        for nth, row in enumerate(first):
            head = flat[edges[nth] : edges[nth + 1]]
            last = first[nth + 1] if nth + 1 < len(first) else len(rows)
            if head[:3] != b"\0\0\1" or len(head) < 9:
                continue
            length = int.from_bytes(head[4:6], "big")
            body = head[9 + head[8] : 6 + length if length else len(head)]
            pts = _ticks(head[9:14]) if head[7] & 0x80 else None
            units.append(
                {
                    "pid": pid,
                    "unit": len(units),
                    "pts": pts,
                    "dts": _ticks(head[14:19]) if head[7] & 0xC0 == 0xC0 else pts,
                    "random_access": bool(self.access[rows[row]]),
                    "packet": int(rows[row]),
                    "start": size,
                    "size": len(body),
                    "damaged": bool(lost[row + 1 : last].any()) or (length > 0 and len(body) < length - 3 - head[8]),
                }
            )
            payload.append(body)
            size += len(body)
        return b"".join(payload), units, int(lost.sum())


def _ticks(stamp: bytes) -> int:
    return (stamp[0] >> 1 & 7) << 30 | stamp[1] << 22 | (stamp[2] >> 1) << 15 | stamp[3] << 7 | stamp[4] >> 1


UNIT = "pid int, unit int, pts long, dts long, random_access boolean, packet long, start long, size long, damaged boolean"
_UNIT = pa.struct(
    [("pid", pa.int32()), ("unit", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()),
     ("packet", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("damaged", pa.bool_())]
)


def padded(text: bytes) -> bytes:
    """Bytes 0 are appended up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % 64 if text else 64)


def _write():
    schema = pa.schema([("_row_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            column = batch.column(1)
            for k, row_id in enumerate(batch.column(0).to_pylist()):
                text = (column[k].as_py() or "").encode("utf-8")
                media = mux(padded(text))
                rows.append((row_id, len(text), media))
                held += len(media)
                if held > BATCH_BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                    )
                    rows, held = [], 0

    return run, "_row_id long, n_bytes long, media binary"


def _read():
    schema = pa.schema(
        [("_row_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("programs", pa.map_(pa.int32(), pa.map_(pa.int32(), pa.int32()))),
         ("lost_sync", pa.int64()), ("continuity_errors", pa.int64()), ("payload", pa.binary()), ("units", pa.list_(_UNIT))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part, rows = batch.slice(first, 256), []
                for media in part.column(2):
                    stream = Stream(media.as_py() or b"")
                    payload, units, errors = [], [], 0
                    for pid in sorted({p for streams in stream.programs.values() for p in streams}):
                        body, own, bad = stream.elementary(pid)
                        payload.append(body)
                        units += own
                        errors += bad
                    programs = [(p, list(s.items())) for p, s in sorted(stream.programs.items())]
                    rows.append((programs, stream.lost_sync, errors, b"".join(payload), units))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[3:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], schema=schema)

    kind = (
        "_row_id long, n_bytes long, media binary, programs map<int, map<int, int>>, lost_sync long, "
        f"continuity_errors long, payload binary, units array<struct<{', '.join(f.replace(' ', ': ', 1) for f in UNIT.split(', '))}>>"
    )
    return run, kind


def written(docs: DataFrame) -> DataFrame:
    """(_row_id, n_bytes, media): the transport stream of each text's padded UTF-8 bytes; null counts as empty."""
    run, kind = _write()
    return docs.select("_row_id", "_text").mapInArrow(run, kind)


def read(media: DataFrame) -> DataFrame:
    """``media`` (_row_id, n_bytes, media) with programs, errors, the payload and one entry per elementary packet.

    ``programs`` maps program numbers to stream types by PID. ``payload`` joins the elementary streams in the order of
    their PIDs, ``units`` has times in 90 kHz ticks, random-access marks and places within the stream's payload. A null
    or empty media value has no programs; bytes that are no packets are counted in ``lost_sync``.
    """
    run, kind = _read()
    return media.select("_row_id", "n_bytes", "media").mapInArrow(run, kind)
