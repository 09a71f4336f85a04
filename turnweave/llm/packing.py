"""Best-fit packing of token sequences, in bulk-synchronous steps.

Documents are cut into pieces of at most ``capacity`` tokens and range-sorted by length. A step takes the longest length that is
left, with all its pieces, and the gaps of all open sequences, sorted as well: the pieces' successor among the gaps is the
smallest gap they fit into. Where many pieces want the same gap, their rank decides: the first ranks fill
the first sequences of that gap, the next ranks sweep on to the next larger gap, and what no gap holds opens new
sequences. Then gaps are updated, and the next step follows. This is best-fit decreasing, for all pieces of a length at once.

Pieces of one length, and sequences of one gap, are interchangeable, so a step needs their numbers only: the sweep runs over
at most ``capacity`` lengths, whatever the size of the corpus, and returns for each length which ranks go to which
sequences. The rows find their places by their own ranks in parallel.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnweave.llm.hashing import word_bounds, word_hashes
from turnweave.llm.tables import kept, slices, worker_cache
from turnweave.operators.ordering import ranked

SLICE_BYTES = 1 << 20
BULK = 2_000  # words per string given to the tokenizer
MOST_WORDS = 1 << 19  # distinct words whose ids a Python worker remembers


_CODES = np.arange(256)
_LETTER = ((_CODES | 32) >= 97) & ((_CODES | 32) <= 122)
_MARK = (_CODES > 32) & (_CODES < 127) & ~_LETTER & ~((_CODES >= 48) & (_CODES <= 57)) & (_CODES != 39)
_LOWERED = np.where(_LETTER, _CODES | 32, _CODES).astype(np.uint8)
_SPECIAL = b"<|"


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut further where ASCII letters and marks meet, without the apostrophe, which may begin an ending ('s)."""
    starts, ends, _ = word_bounds(data, offsets)
    if not len(starts):
        return starts, ends, np.zeros(len(offsets), np.int64)
    letter, mark = _LETTER[data], _MARK[data]
    cut = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
    # Texts lie end to end, so a cut may fall on a start.
    cut = np.setdiff1d(cut, starts, assume_unique=True)
    first, last = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return first, last, np.searchsorted(first, offsets)


class WordTokens:
    """Token ids per distinct word, for a tokenizer whose tokens never reach across a blank.

    Normalising, splitting and merging of ``word_bpe_49k.json`` all stop at blanks, so the ids of a text are those
    of its words in turn. They also ignore the case of letters, and stop where letters and marks meet; only special
    tokens reach across that, and texts that may hold one are taken by whole words. The tokenizer needs a special token of its own, to set words apart in bulk.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.mark_id, token = max(self.tokenizer.get_added_tokens_decoder().items())
        self.mark = token.content
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.ids: list[np.ndarray] = []
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.begin = np.zeros(0, np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids per text."""
        if _SPECIAL not in data.tobytes():
            data = _LOWERED[data]
            starts, ends, before = _segments(data, offsets)
        else:
            starts, ends, before = word_bounds(data, offsets)
        hashes = word_hashes(data, starts, ends)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.place) + len(first) > MOST_WORDS:
            self._clear()
        keys = hashes[first].tolist()
        places = np.array([self.place.get(k, -1) for k in keys], np.int64)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            sizes, flat = self._new(data, starts[first[missing]], ends[first[missing]])
            places[missing] = len(self.place) + np.arange(len(missing))
            self.place.update(zip((keys[k] for k in missing.tolist()), places[missing].tolist(), strict=True))
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat])
            self.begin = np.cumsum(self.sizes) - self.sizes
        word = places[which]
        size = self.sizes[word]
        total = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(self.begin[word] - total[:-1], size) + np.arange(total[-1])
        return self.flat[source], np.diff(total[before])


    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids per word, and the ids end to end. Words are encoded in bulk, with a special token between."""
        mark = np.frombuffer(self.mark.encode(), np.uint8)
        width = ends - starts + len(mark)
        at = np.concatenate([[0], np.cumsum(width)])
        source = np.repeat(starts - at[:-1], width) + np.arange(at[-1])
        joined = data[np.minimum(source, len(data) - 1)]
        joined[(at[1:, None] - len(mark) + np.arange(len(mark))[None, :]).reshape(-1)] = np.tile(mark, len(starts))
        raw = joined.tobytes()
        edges = [*range(0, len(starts), BULK), len(starts)]
        texts = [raw[at[a] : at[b]].decode("utf-8") for a, b in zip(edges[:-1], edges[1:], strict=True)]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        stops = np.flatnonzero(flat == self.mark_id)
        if len(stops) != len(starts):  # some word holds the special token itself
            words = [data[a:b].tobytes().decode("utf-8") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([len(x) for x in each], np.int64), np.concatenate(each)
        return np.diff(stops, prepend=-1) - 1, np.delete(flat, stops)


@worker_cache
def word_tokens(definition: str) -> WordTokens:
    """The encoder of a Python worker, which serves one task after another until the worker does other work."""
    return WordTokens(definition)


def _pieces(definition: str, capacity: int, end: int):
    schema = pa.schema(
        [("_row_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(definition)
        for part, data, offsets in slices(batches, "_text", SLICE_BYTES, word_tokens):
            ids, counts = tokens(data, offsets)
            stop = np.cumsum(counts)
            raw = np.insert(ids, stop, end).astype("<u4").tobytes()
            doc = part.column(0).to_pylist()
            rows: list[tuple] = []
            at = 0
            for k, count in enumerate(counts.tolist()):
                count += 1
                for nth, start in enumerate(range(0, count, capacity)):
                    size = min(capacity, count - start)
                    whole = raw[4 * (at + start) : 4 * (at + start + size)]
                    rows.append((doc[k], nth, start, size, zlib.crc32(whole), whole))
                at += count
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    return run, "_row_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, definition: str, capacity: int = 4096, end: int = 1, keep_ids: bool = True) -> DataFrame:
    """One row per piece: the document's ids and a final ``end``, cut into pieces of ``capacity`` ids where longer.

    ``docs`` has _row_id and _text; a null text counts as empty, so its only id is ``end``. ``definition`` is the content of a
    tokenizer file whose tokens end at blanks. ``ids`` holds little-endian unsigned 32-bit numbers.
    """
    run, kind = _pieces(definition, capacity, end)
    found = docs.select("_row_id", "_text").mapInArrow(run, kind)
    return found if keep_ids else found.drop("ids")


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places per length: (length, first rank, first sequence, pieces per sequence, offset) for a run of ranks each.

    The run lasts until the next entry of its length; ranks fill one sequence after another.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, number)
    order: list[int] = []  # gaps in use, ascending
    entries: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def leave(gap: int, first: int, number: int) -> None:
        if gap > 0 and number:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            else:
                gap, first = capacity, opened
                number = -(-(total - rank) // (capacity // length))
                opened += number
            each = gap // length
            full = min(number, (total - rank) // each)
            if full:
                entries.append((length, rank, first, each, capacity - gap))
                leave(gap - each * length, first, full)
                rank += full * each
            if full < number:
                rest = min(total - rank, each - 1)
                if rest:
                    entries.append((length, rank, first + full, rest, capacity - gap))
                    leave(gap - rest * length, first + full, 1)
                    rank += rest
                    full += 1
                leave(gap, first + full, number - full)
    return entries


def _places(entries: np.ndarray):
    names = ("length", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (entries[:, 0] << 44) + entries[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names)
            at = entries[np.searchsorted(key, (length << 44) + rank, "right") - 1]
            past = rank - at[:, 1]
            rest = [n for n in batch.schema.names if n != "rank"]
            yield (
                batch.select(rest)
                .append_column("sequence_id", pa.array(at[:, 2] + past // at[:, 3]))
                .append_column("offset", pa.array(at[:, 4] + past % at[:, 3] * length))
            )

    return run


def packed(found: DataFrame, capacity: int = 4096) -> DataFrame:
    """Pieces (_row_id, piece, length and more) with ``sequence_id`` and ``offset``: best-fit decreasing.

    No sequence holds more than ``capacity``; offsets leave no hole. Equal lengths are placed in the order of
    (_row_id, piece). An empty table packs into nothing.
    """
    # Written first: range sorting reads its input twice, once to choose the bounds.
    found = kept(found, "pieces")
    placed = kept(ranked(found, ["length", "_row_id", "piece"], "_nth"), "ranked-pieces")
    classes = placed.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.min("_nth").alias("_first"))
    # One row per length: at most ``capacity`` of them, also in the broadcast.
    counts = {r["length"]: r["n"] for r in classes.select("length", "n").collect()}
    entries = np.array(sorted(sweep(counts, capacity)), np.int64).reshape(-1, 5)
    rows = placed.join(F.broadcast(classes.select("length", "_first")), "length")
    rows = rows.select(*found.columns, (F.col("_nth") - F.col("_first")).alias("rank"))
    kind = ", ".join(f"`{n}` {t}" for n, t in found.dtypes)
    return rows.mapInArrow(_places(entries), f"{kind}, sequence_id long, offset long")
