import hashlib
import random
import zlib

import pytest
from helpers import awkward, docs
from pyspark.sql import functions as F

from turnweave.llm import transport_stream as ts


def one(content):
    stream = ts.Stream(content)
    pids = sorted({p for streams in stream.programs.values() for p in streams})
    return stream, [stream.elementary(p) for p in pids]


@pytest.mark.parametrize("size", [64, 128, 192, 4096, ts.UNIT_BYTES, ts.UNIT_BYTES + 64, 10 * ts.UNIT_BYTES])
def test_round_trip(size):
    payload = random.Random(size).randbytes(size)
    content = ts.mux(payload)
    assert len(content) % ts.PACKET == 0 and ts.mux(payload) == content
    stream, found = one(content)
    (body, units, errors), = found
    assert body == payload and errors == 0 and stream.lost_sync == 0
    assert stream.programs == {ts.PROGRAM: {ts.DATA_PID: ts.PRIVATE_DATA_TYPE}}
    assert [u["pts"] for u in units] == [k * ts.UNIT_TICKS for k in range(len(units))]
    assert [u["random_access"] for u in units] == [k % ts.ACCESS_EVERY == 0 for k in range(len(units))]
    assert not any(u["damaged"] for u in units)


def test_stamps_hold_33_bits():
    for ticks in (0, 1, 90_000, 2**32 + 5, 2**33 - 1):
        assert ts._ticks(ts._stamp(2, ticks)) == ticks


def test_lost_repeated_and_foreign_packets():
    payload = random.Random(1).randbytes(3 * ts.UNIT_BYTES)
    packets = [ts.mux(payload)[k : k + ts.PACKET] for k in range(0, len(ts.mux(payload)), ts.PACKET)]
    twice = b"".join(packets[:5] + [packets[4]] + packets[5:])
    _, found = one(twice)
    assert found[0][0] == payload and found[0][2] == 0
    null = bytes([ts.SYNC, ts.NULL_PID >> 8, ts.NULL_PID & 0xFF, 0x10]) + b"\xff" * 184
    _, found = one(b"".join(packets[:7] + [null] + packets[7:]))
    assert found[0][0] == payload and found[0][2] == 0
    _, found = one(b"".join(packets[:9] + packets[10:]))
    assert found[0][2] == 1 and [u["damaged"] for u in found[0][1]] == [True, False, False]
    broken = bytearray(b"".join(packets))
    broken[9 * ts.PACKET] = 0
    stream, found = one(bytes(broken))
    assert stream.lost_sync == 1 and found[0][2] == 1


def test_tables_over_several_packets_and_two_programs():
    maps = {n: 0x30 + n for n in range(1, 61)}
    body = b"".join(n.to_bytes(2, "big") + (0xE000 | p).to_bytes(2, "big") for n, p in maps.items())
    section = ts._section(0, 1, body)
    first = bytes([ts.SYNC, 0x40, 0, 0x10, 0]) + section[:183]
    second = bytes([ts.SYNC, 0, 0, 0x11]) + (section[183:] + b"\xff" * 184)[:184]
    tables = b"".join(
        ts._table_packet(p, ts._section(2, n, b"\xe1\0\xf0\0" + bytes([0x1B]) + (0xE200 + n).to_bytes(2, "big") + b"\xf0\0"))
        for n, p in maps.items()
    )
    stream = ts.Stream(first + second + tables)
    assert stream.programs == {n: {0x200 + n: 0x1B} for n in maps}


def test_open_length_and_decoding_times():
    stamps = ts._stamp(3, 9000) + ts._stamp(1, 6000)
    pes = b"\0\0\1\xe0\0\0\x80\xc0\x0a" + stamps + b"frame" * 30
    tables = ts._TABLES
    head = bytes([ts.SYNC, 0x41, 0, 0x10])
    packet = head + pes + b"." * (184 - len(pes))
    stream, found = one(tables + packet)
    assert found[0][0] == b"frame" * 30 + b"." * (184 - len(pes))
    assert (found[0][1][0]["pts"], found[0][1][0]["dts"]) == (9000, 6000)


def test_columns(spark):
    rows = awkward()
    table = docs(spark, rows).select(F.col("doc_id").alias("_row_id"), F.col("text").alias("_text"))
    media = ts.written(table)
    found = {r["_row_id"]: r for r in ts.read(media.unionByName(spark.createDataFrame([(-1, 0, None), (-2, 0, b"no packets")], media.schema))).collect()}
    for row_id, text in rows:
        want = ts.padded((text or "").encode())
        got = bytes(found[row_id]["payload"])
        assert got == want and len(want) % 64 == 0 and want
        assert found[row_id]["n_bytes"] == len((text or "").encode())
        assert hashlib.sha256(bytes(found[row_id]["media"])).hexdigest() == hashlib.sha256(ts.mux(want)).hexdigest()
        assert zlib.crc32(got[-64:]) == zlib.crc32(want[-64:])
    assert found[-1]["programs"] == {} and found[-1]["lost_sync"] == 0
    assert found[-2]["programs"] == {} and found[-2]["lost_sync"] == 1
    assert ts.read(ts.written(table.limit(0))).collect() == []
