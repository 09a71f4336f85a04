"""Substring dedup over words, anchored at the positions of a difference cover.

A difference cover D of period v meets every pair of residues at a common shift: for any places i and j there is a shift
below v after which both lie in D. So two equal windows of ``window`` words hold equal anchors of ``window - v + 1``
words at covered places, and only covered places need hashing. Anchors that occur in two documents are extended to
all windows around them, and those windows are compared as wholes.

Both comparisons are a count per hash, merged in parts before the shuffle, and a join back; a passage that a third of
all documents share is a hash like any other, split by adaptive execution where it is large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnweave.llm.hashing import Windows, mix, word_bounds, word_hashes
from turnweave.llm.tables import kept, slices
from turnweave.operators.ordering import ranked

# Perfect difference sets by period: each non-zero residue is one difference of two members.
COVERS = {1: (0,), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
SLICE_BYTES = 1 << 18
# Anchors are found by one hash; whole windows, on whose equality words are removed, are told apart by two.
# ``at`` is a word place, above it the number of the text where an id has several.
SEEN = "h long, doc long, at long"
WHOLE = "h long, g long, doc long, at long"


def period_for(window: int) -> int:
    """The longest period whose anchors keep over a third of the window."""
    return max(v for v in COVERS if v == 1 or 3 * (window - v + 1) > window)


def _words(data: np.ndarray, offsets: np.ndarray):
    starts, ends, before = word_bounds(data, offsets)
    return Windows(word_hashes(data, starts, ends)), starts, ends, before


def _emit(part: pa.RecordBatch, row: np.ndarray, place: np.ndarray, **hashes: np.ndarray) -> pa.RecordBatch:
    doc, copy = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    columns = {name: pa.array(values.view(np.int64)) for name, values in hashes.items()}
    columns |= {"doc": pa.array(doc[row], pa.int64()), "at": pa.array((copy[row] << 32) + place, pa.int64())}
    return pa.RecordBatch.from_pydict(columns)


def _anchors(window: int):
    period = period_for(window)
    length = window - period + 1
    covered = np.zeros(period, bool)
    covered[list(COVERS[period])] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "_text", SLICE_BYTES):
            windows, _, _, before = _words(data, offsets)
            count = np.diff(before)
            row = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(row)) - before[:-1][row]
            # Documents of fewer words than a window cannot hold one.
            chosen = np.flatnonzero(covered[place % period] & (place + length <= count[row]) & (count[row] >= window))
            yield _emit(part, row[chosen], place[chosen], h=windows(chosen, chosen + length, 21))

    return run


def _candidates(window: int):
    """Hashes of all windows that hold a shared anchor; input rows have the anchors' places in ``places``."""
    reach = period_for(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "_text", SLICE_BYTES):
            starts, ends, before = word_bounds(data, offsets)
            hashes = word_hashes(data, starts, ends)
            windows, other = Windows(hashes), Windows(mix(hashes, 99))
            row, place = _flat(part.column(part.schema.get_field_index("places")), before)
            total = int(before[-1])
            step = np.zeros(total + 1, np.int32)
            np.add.at(step, np.maximum(before[:-1][row] + place - reach + 1, before[:-1][row]), 1)
            np.add.at(step, before[:-1][row] + place + 1, -1)
            near = np.cumsum(step)[:-1] > 0
            text_of = np.repeat(np.arange(len(before) - 1), np.diff(before))
            chosen = np.flatnonzero(near & (np.arange(total) + window <= before[1:][text_of]))
            place = chosen - before[:-1][text_of[chosen]]
            yield _emit(part, text_of[chosen], place, h=windows(chosen, chosen + window, 22), g=other(chosen, chosen + window, 23))

    return run


def _flat(column: pa.Array, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and place of each entry of a list column, without places beyond the row's words."""
    counts = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(counts)), counts)
    place = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    inside = place < (before[1:] - before[:-1])[row]
    return row[inside], place[inside]


def _shared(seen: DataFrame, *hashes: str) -> DataFrame:
    """Rows whose hashes occur in two documents, with the smallest of these documents."""
    shared = seen.groupBy(*hashes).agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high")
    # Written first: the join then deals out its rows anew, and adaptive execution can split a frequent hash.
    return seen.join(kept(shared.select(*hashes, "low"), "shared"), list(hashes))


def text_copies(rows: DataFrame) -> DataFrame:
    """(_row_id, _digest, _copy) of ``rows`` (_row_id, _text): a number from 1 for each text whose id has several."""
    seen = rows.filter("_row_id is not null").select("_row_id", F.xxhash64("_text").alias("_digest"))
    ends = seen.groupBy("_row_id").agg(F.min("_digest").alias("low"), F.max("_digest").alias("high"))
    several = kept(ends.filter("low < high").select("_row_id"), "ids-of-several-texts")
    return ranked(seen.join(several, "_row_id", "left_semi").distinct(), ["_row_id", "_digest"], "_copy")


def numbered_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with _row_id, _copy and _text before its columns: _copy tells the texts of one id apart, 0 where it has one."""
    rows = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("_row_id"), F.col(f"`{text_column}`").alias("_text"), F.struct("*").alias("_row"))
    named = rows.withColumn("_digest", F.xxhash64("_text")).join(text_copies(rows), ["_row_id", "_digest"], "left")
    return named.select("_row_id", F.coalesce("_copy", F.lit(0)).cast("bigint").alias("_copy"), "_text", "_row")


def _listed(seen: DataFrame, name: str) -> DataFrame:
    """Places per text, as a list."""
    copy, place = F.shiftright("at", 32).alias("_copy"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return seen.groupBy(F.col("doc").alias("_row_id"), copy).agg(F.collect_list(place).alias(name))


def repeated_windows(texts: DataFrame, window: int = 50) -> DataFrame:
    """(_row_id, _copy, starts) of ``numbered_texts``: the word places at which a window starts that also starts in a text of a smaller id."""
    rows = texts.select("_row_id", "_copy", "_text").filter("_row_id is not null and length(_text) > 0")
    seen = rows.mapInArrow(_anchors(window), SEEN)
    places = kept(_listed(_shared(seen, "h"), "places"), "anchors")
    wide = rows.join(places, ["_row_id", "_copy"]).mapInArrow(_candidates(window), WHOLE)
    return kept(_listed(_shared(wide, "h", "g").filter("doc > low"), "starts"), "repeats")


def _strip(window: int):
    names = ["_row_id", "_copy", "n_words", "n_removed", "text"]
    schema = pa.schema([*[(name, pa.int64()) for name in names[:-1]], (names[-1], pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "_text", SLICE_BYTES):
            starts, ends, before = word_bounds(data, offsets)
            row, place = _flat(part.column(part.schema.get_field_index("starts")), before)
            step = np.zeros(len(starts) + 1, np.int32)
            first = before[:-1][row] + place
            np.add.at(step, first, 1)
            np.add.at(step, np.minimum(first + window, before[1:][row]), -1)
            stay = np.cumsum(step)[:-1] == 0
            text, places = _joined(data, starts, ends, before, stay)
            count = np.diff(before)
            left = np.diff(np.concatenate([[0], np.cumsum(stay)])[before])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(count, pa.int64()),
                    pa.array(count - left, pa.int64()),
                    pa.StringArray.from_buffers(
                        len(count), pa.py_buffer(places.astype(np.int32)), pa.py_buffer(text.tobytes())
                    ),
                ],
                schema=schema,
            )

    return run, "_row_id long, _copy long, n_words long, n_removed long, text string"


def _joined(data, starts, ends, before, stay) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of each text joined by one blank, end to end, and the place of each text."""
    chosen = np.flatnonzero(stay)
    size = ends[chosen] - starts[chosen] + 1
    at = np.concatenate([[0], np.cumsum(size)])
    if not len(chosen):
        return np.zeros(0, np.uint8), np.zeros(len(before), np.int64)
    source = np.repeat(starts[chosen] - at[:-1], size) + np.arange(at[-1])
    text = data[np.minimum(source, len(data) - 1)]
    blank = at[1:] - 1
    text[blank] = 0x20
    edge = np.searchsorted(chosen, before)
    filled = np.diff(edge) > 0
    last = blank[edge[1:][filled] - 1]
    text = np.delete(text, last)
    places = at[edge] - np.concatenate([[0], np.cumsum(filled)])
    return text, places


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 50) -> DataFrame:
    """(id, n_words, n_removed, text) per row: words left after every repeated window is removed, joined by one blank.

    A window of ``window`` words is repeated when the same words also start in a document of a smaller id; windows are
    judged on the input. Words are runs of bytes other than the six ASCII blanks, compared as they are. Null and empty
    texts have no words. Rows with a null id are neither compared nor changed. Texts that share an id are documents of one
    rank: none is compared with the others, each keeps its own words. Further columns are ignored, whatever their names.
    """
    rows = numbered_texts(docs, id_column, text_column).select("_row_id", "_copy", "_text")
    joined = rows.join(repeated_windows(rows, window), ["_row_id", "_copy"], "left")
    joined = joined.withColumn("starts", F.coalesce("starts", F.array().cast("array<int>")))
    return stripped(joined, window).select(F.col("_row_id").alias(id_column), "n_words", "n_removed", "text")


def stripped(rows: DataFrame, window: int = 50) -> DataFrame:
    """(_row_id, _copy, n_words, n_removed, text) for rows (_row_id, _copy, _text, starts) of ``repeated_windows``."""
    run, kind = _strip(window)
    return rows.select("_row_id", "_copy", "_text", "starts").mapInArrow(run, kind)
