"""Byte-level repeated-string removal by bucket-pointer refinement.

In bucket-pointer refinement (Schuermann and Stoye, 2005) suffixes are put into buckets by their first q bytes, and a
bucket is refined by sorting its suffixes on the bucket identifiers at later offsets; refined identifiers are used
again, so the compared depth doubles. Here an identifier is a 64-bit hash of the bucket's bytes instead of a rank, so that all
tasks agree on it without a global sort of all suffixes: 8-byte buckets come straight from the text, and each further
level combines the identifiers at the place and at a later offset. Buckets of one suffix leave early:

1. depth half: only at minimizers. Every window of ``length`` bytes holds the smallest half-length identifier of its own,
   and two equal windows hold the same one at the same place, so unrepeated minimizers rule out all windows around them.
2. blocks: windows with a repeated minimizer are taken in blocks of neighbouring starts at fixed distances from it. All
   windows of a block share a core of bytes, and lie within its hull. A core that occurs once rules the block out; a hull that occurs
   twice proves it whole.
3. windows: what is left, the blocks across which a repeat ends, is compared window by window at full depth.

All levels count identifiers in parts before the shuffle and join the counts back, so a string that fills a
third of all documents is no single task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from turnweave.llm.difference_cover import text_copies
from turnweave.llm.tables import kept, slices

MOST_STARTS = 32  # window starts per block
SLICE_BYTES = 1 << 16  # small enough for the arrays of a slice to stay in the processor's cache
LOWEST = 64  # the shortest repeat the levels are laid out for
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _paired(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (one ^ (one >> np.uint64(29))) * _C1 + (other ^ (other >> np.uint64(32))) * _C2 + np.uint64(0x9E3779B97F4A7C15)
        return z ^ (z >> np.uint64(31))


def _later(ids: np.ndarray, offset: int) -> np.ndarray:
    moved = np.zeros_like(ids)
    if offset < len(ids):
        moved[: len(ids) - offset] = ids[offset:]
    return moved


class Buckets:
    """Bucket identifiers per place at growing depths; places whose string leaves the text carry no meaning."""

    def __init__(self, data: np.ndarray, most: int):
        ids = data.astype(np.uint64)
        for depth in (1, 2, 4):  # the 8 bytes themselves
            ids = (ids << np.uint64(8 * depth)) | _later(ids, depth)
        self.levels = {8: ids}
        depth = 8
        while depth * 2 <= most:
            self.levels[depth * 2] = _paired(self.levels[depth], _later(self.levels[depth], depth))
            depth *= 2

    def at(self, places: np.ndarray, depth: np.ndarray | int, salt: int) -> np.ndarray:
        """Identifiers of the strings of ``depth`` bytes at ``places``; depths lie within one doubling of a level."""
        longest = int(np.max(depth)) if np.size(depth) else 8
        level = max(k for k in self.levels if k <= (int(np.min(depth)) if np.size(depth) else 8))
        if longest > 2 * level:
            raise ValueError("depths differ by more than one level")
        ids = self.levels[level]
        once = _paired(ids[places], ids[places + depth - level])
        return _paired(once, np.uint64(salt) + np.asarray(depth, np.uint64)).view(np.int64)

    def everywhere(self, depth: int, salt: int) -> np.ndarray:
        level = max(k for k in self.levels if k <= depth)
        return _paired(self.levels[level], _later(self.levels[level], depth - level)) ^ np.uint64(salt)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of the ``width`` values from each place on (fewer at the end)."""
    out, reach = values.copy(), 1
    while reach < width:
        step = min(reach, width - reach)
        out[: len(out) - step] = pick(out[: len(out) - step], out[step:])
        reach += step
    return out


def block_starts(length: int) -> int:
    """Window starts per block: the hull, one more byte per start, has to lie within one doubling of a level."""
    level = 1 << (length.bit_length() - 1)
    return min(MOST_STARTS, 2 * level - length + 1)


def _minimizers(data: np.ndarray, offsets: np.ndarray, length: int, most: int):
    """Half-length identifiers, the smallest of each window (0 where no window starts), and the minimizers' places."""
    half = length // 2
    buckets = Buckets(data, most)
    ids = buckets.everywhere(half, 31) | np.uint64(1)
    end = np.repeat(offsets[1:], np.diff(offsets))
    place = np.arange(len(data))
    ids[place + half > end] = np.uint64(2**64 - 1)
    width = length - half + 1
    least = _slide(ids, width, np.minimum)
    least[place + length > end] = 0
    highest = _slide(least[::-1], width, np.maximum)[::-1]
    return buckets, ids, least, np.flatnonzero((ids == highest) & (ids != np.uint64(2**64 - 1)))


def _texts(part: pa.RecordBatch, row: np.ndarray, place: np.ndarray) -> list[pa.Array]:
    """Columns doc and at: the place in the text, above it the number of the text where its id has several."""
    doc, copy = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    return [pa.array(doc[row], pa.int64()), pa.array((copy[row] << 32) + place, pa.int64())]


def _placed(name: str) -> list[Column]:
    """The text of doc and at, and the place in it."""
    place = F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return [F.col("doc").alias("_row_id"), F.shiftright("at", 32).alias("_copy"), place.alias(name)]


def _halves(length: int):
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "_text", SLICE_BYTES):
            _, ids, _, found = _minimizers(data, offsets, length, length // 2)
            row = np.searchsorted(offsets, found, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[found].view(np.int64)), *_texts(part, row, found - offsets[row])], schema=schema
            )

    return run, "h long, doc long, at long"


def _blocks(length: int):
    starts = block_starts(length)
    schema = pa.schema(
        [("core", pa.int64()), ("hull", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("more", pa.int32())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "_text", SLICE_BYTES):
            buckets, ids, least, found = _minimizers(data, offsets, length, length)
            column = part.column(part.schema.get_field_index("places"))
            counts = np.diff(column.offsets.to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(len(counts)), counts)
            flagged = offsets[row] + column.flatten().to_numpy(zero_copy_only=False)
            flagged = flagged[flagged < offsets[1:][row]]
            # The minimizer of a window is the first place in it that holds the window's smallest identifier.
            start = np.flatnonzero(least)
            change = np.ones(len(start), bool)
            change[1:] = (least[start[1:]] != least[start[:-1]]) | (start[1:] != start[:-1] + 1)
            good = np.isin(least[start[change]], ids[flagged])
            start = start[good[np.cumsum(change) - 1]]
            if not len(start):
                continue
            anchor = _first_equal(found, ids, start, least[start])
            block = (anchor - start) // starts
            new = np.ones(len(start), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1]) | (start[1:] != start[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(start)]]) - 1
            low, high, top = start[first], start[last], (anchor - starts * block)[first]
            core = buckets.at(top, length - starts + 1, 41)
            hull = buckets.at(low, high - low + length, 42)
            # Blocks of equal hulls must also sit alike around their minimizer.
            with np.errstate(over="ignore"):
                hull = _paired(hull.view(np.uint64), (top - low).astype(np.uint64)).view(np.int64)
            of = np.searchsorted(offsets, low, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(core),
                    pa.array(hull),
                    *_texts(part, of, low - offsets[of]),
                    pa.array((high - low).astype(np.int32)),
                ],
                schema=schema,
            )

    return run, "core long, hull long, doc long, at long, more int"


def _first_equal(found: np.ndarray, ids: np.ndarray, start: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The first place in ``found`` from each start on that holds the value (it exists within the window)."""
    nth = np.searchsorted(found, start)
    wrong = np.flatnonzero(ids[found[nth]] != value)
    while len(wrong):
        nth[wrong] += 1
        wrong = wrong[ids[found[nth[wrong]]] != value[wrong]]
    return found[nth]


def _windows(length: int):
    schema = pa.schema([("h", pa.int64()), ("hull", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "_text", SLICE_BYTES):
            buckets = Buckets(data, length)
            column = part.column(part.schema.get_field_index("open"))
            counts = np.diff(column.offsets.to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(len(counts)), counts)
            fields = column.flatten()
            start, more, hull = (fields.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            size = more.astype(np.int64) + 1
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            of = np.repeat(row, size)
            place = np.repeat(start.astype(np.int64), size) + nth
            inside = offsets[of] + place + length <= offsets[of + 1]
            of, place, hull = of[inside], place[inside], np.repeat(hull, size)[inside]
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets.at(offsets[of] + place, length, 43)), pa.array(hull), *_texts(part, of, place)],
                schema=schema,
            )

    return run, "h long, hull long, doc long, at long"


def _repeated(seen: DataFrame, key: str) -> DataFrame:
    often = seen.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)
    # Written first: the join then deals out its rows anew, and adaptive execution can split a frequent identifier.
    return seen.join(kept(often, "often"), key)


def _listed(found: DataFrame, entry: Column | str, name: str) -> DataFrame:
    """Entries per text, as a list."""
    return found.groupBy("_row_id", "_copy").agg(F.collect_list(entry).alias(name))


def repeated_spans(rows: DataFrame, length: int = 400) -> DataFrame:
    """(_row_id, _copy, spans): byte ranges (start, size), unsorted and overlapping, made of repeated strings of ``length`` bytes.

    ``rows`` has ``_row_id``, ``_copy`` and ``_text``; the first two tell texts apart, and only equal texts have both in common.
    """
    if length < LOWEST:
        raise ValueError(f"length must be {LOWEST} or more")
    run, kind = _halves(length)
    halves = kept(rows.mapInArrow(run, kind), "minimizers")
    places = kept(_listed(_repeated(halves, "h").select(*_placed("place")), "place", "places"), "halves")
    run, kind = _blocks(length)
    blocks = kept(rows.join(places, ["_row_id", "_copy"]).mapInArrow(run, kind), "blocks")

    hulls = blocks.groupBy("core", "hull").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"))
    cores = hulls.groupBy("core").agg(F.count(F.lit(1)).alias("hulls"), F.min("n").alias("least"))
    hulls = kept(hulls.join(cores.filter("hulls > 1 or least > 1"), "core"), "hulls")
    whole = blocks.join(hulls.filter("n > 1").select("core", "hull"), ["core", "hull"]).select(
        "doc", "at", (F.col("more") + length).alias("size")
    )
    # One place per hull speaks for all its places; where it occurs once, its windows are still open.
    open_hulls = hulls.filter("hulls > 1 and least = 1").select("core", "hull", "doc", "n")
    open_blocks = blocks.join(open_hulls, ["core", "hull", "doc"]).groupBy("core", "hull", "doc").agg(
        F.min(F.struct("at", "more")).alias("first"), F.min("n").alias("n")
    )
    open_blocks = open_blocks.select("doc", "first.at", "first.more", "hull").select(*_placed("start"), "more", "hull")
    wanted = _listed(open_blocks, F.struct("start", "more", "hull"), "open")
    run, kind = _windows(length)
    windows = rows.join(kept(wanted, "open"), ["_row_id", "_copy"]).mapInArrow(run, kind)
    single = _repeated(kept(windows, "windows"), "h").join(hulls.filter("n = 1").select("hull", "doc"), ["hull", "doc"])
    found = whole.union(single.select("doc", "at", F.lit(length).alias("size"))).select(*_placed("start"), "size")
    spans = found.groupBy("_row_id", "_copy").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    return kept(spans, "spans")


def _cut():
    schema = pa.schema(
        [("_row_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))), ("left", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "_text", SLICE_BYTES):
            column = part.column(part.schema.get_field_index("spans"))
            counts = np.diff(column.offsets.to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(len(counts)), counts)
            fields = column.flatten()
            start, size = (fields.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            low = np.minimum(offsets[row] + start, offsets[row + 1])
            high = np.minimum(low + size, offsets[row + 1])
            step = np.zeros(len(data) + 1, np.int64)
            np.add.at(step, low, 1)
            np.add.at(step, high, -1)
            gone = np.cumsum(step)[:-1] > 0
            begins, ends = gone.copy(), gone.copy()
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            if len(data):
                begins[1:] &= ~gone[:-1] | edge[1:-1]
                ends[:-1] &= ~gone[1:] | edge[1:-1]
            begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            nth = np.searchsorted(begins, offsets)
            of = np.repeat(np.arange(len(counts)), np.diff(nth))
            runs = pa.StructArray.from_arrays(
                [pa.array(begins - offsets[of]), pa.array(ends - begins)], names=["start", "size"]
            )
            lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[offsets])
            total = np.diff(offsets)
            rest = np.concatenate([[0], np.cumsum(total - lost)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(total, pa.int64()),
                    pa.array(lost, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(nth.astype(np.int32)), runs),
                    pa.BinaryArray.from_buffers(
                        pa.binary(), len(total), [None, pa.py_buffer(rest), pa.py_buffer(data[~gone].tobytes())]
                    ),
                ],
                schema=schema,
            )

    return run, "_row_id long, n_bytes long, n_removed long, removed array<struct<start: long, size: long>>, left binary"


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 400) -> DataFrame:
    """(id, n_bytes, n_removed, removed, left) per row: the UTF-8 bytes outside every repeated string.

    A string of ``length`` bytes is repeated when it also starts elsewhere, in the same or another text; overlaps count,
    and strings are judged on the input. ``removed`` lists the maximal removed runs, ``left`` the remaining bytes
    end to end (they may end inside a character). Null counts as empty. Rows with a null id are neither compared nor
    changed. Texts that share an id are documents of their own, each loses its own bytes; equal rows repeat each other.
    Further columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("_row_id"), F.col(text_column).alias("_text"))
    # Written first: ids rarely have several texts, and a small table is joined without moving the texts.
    copies = kept(text_copies(rows).select("_row_id", "_digest", "_copy"), "copies")
    rows = rows.join(copies, [rows["_row_id"] == copies["_row_id"], F.xxhash64("_text") == copies["_digest"]], "left").select(
        rows["_row_id"], F.coalesce("_copy", F.lit(0)).cast("bigint").alias("_copy"), "_text"
    )
    spans = repeated_spans(rows.filter(f"_row_id is not null and octet_length(_text) >= {length}"), length)
    none = F.array().cast("array<struct<start: int, size: int>>")
    run, kind = _cut()
    joined = rows.join(spans, ["_row_id", "_copy"], "left").withColumn("spans", F.coalesce("spans", none))
    return joined.mapInArrow(run, kind).withColumnRenamed("_row_id", id_column)
