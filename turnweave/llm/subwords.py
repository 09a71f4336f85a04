"""Quality classifier on supervised subword embeddings.

A text is the average of learned vectors of its words, of pairs of neighbouring words and of the words' character n-grams, all
hashed into one table; a softmax layer turns the average into class probabilities (the model of Joulin et al., 2016). Training is stochastic
gradient descent in numpy, inside one task, on a bounded sample of labelled rows. Scoring reads whole texts: the
output layer is linear, so the two classes' difference is folded into one number per table entry, and a text needs one
look-up per word and n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from turnweave.llm.hashing import byte_windows, mix, word_bounds
from turnweave.llm.tables import give_back, kept, named, slices

TRAIN_ROWS = 4_000  # labelled rows used for training, the smallest by a hash of their id
ENTRIES = 1 << 15
WIDTH = 8
GRAMS = (3, 4, 5)
STEPS = 2_000  # updates, in as many rounds over the sample as they take
BATCH = 16
RATE = 0.5
RESERVED = 2  # entries of a word that repeats the one before it, and of a pair of words that recurs
RECALL = 16  # words within which a pair counts as recurring
SLICE_BYTES = 1 << 17


def _separated(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with one blank before each and one after the last, so that every word has a mark on both sides."""
    count = len(offsets) - 1
    moved = np.full(len(data) + count + 1, 0x20, np.uint8)
    text_of = np.repeat(np.arange(count), np.diff(offsets))
    moved[np.arange(len(data)) + text_of + 1] = data
    return moved, offsets + np.arange(count + 1)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, table entry) of all words, of word pairs, then of the n-grams of each size, which may begin or end in a word's mark."""
    data, offsets = _separated(data, offsets)
    starts, ends, _ = word_bounds(data, offsets + 0)
    marks = np.ones(len(data), bool)
    step = np.zeros(len(data) + 1, np.int32)
    step[starts] += 1
    step[ends] -= 1
    marks[np.cumsum(step)[:-1] > 0] = False
    data = np.where(marks, np.uint8(0x20), data)
    hashes = byte_windows(data)
    text = np.searchsorted(offsets, starts, "right") - 1
    words = hashes(starts, ends, 50)
    yield text, _entries(words)
    together = text[1:] == text[:-1]
    with np.errstate(over="ignore"):
        pairs = mix(words[1:] * np.uint64(3) + words[:-1])
    yield text[1:][together], _entries(pairs[together])
    yield from _recurring(text, words)
    # Characters: bytes that do not continue one. A gram lies between two characters of which only the outer ones are marks.
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    mark = marks[begin]
    stops = np.append(begin, len(data))
    passed = np.concatenate([[0], np.cumsum(mark)])
    for size in GRAMS:
        first = np.arange(max(0, len(begin) - size + 1))
        inner = passed[first + size - 1] - passed[first + 1]
        first = first[inner == 0]
        at = begin[first]
        text = np.minimum(np.searchsorted(offsets, at + 1, "right") - 1, len(offsets) - 2)
        yield text, _entries(hashes(at, stops[first + size], 50 + size))


def _entries(hashes: np.ndarray) -> np.ndarray:
    """Table entries of hashed words, word pairs and n-grams; the first ones are those of recurrence."""
    return (hashes % np.uint64(ENTRIES - RESERVED)).astype(np.int64) + RESERVED


def _recurring(text: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and pairs by recurrence, which unseen words share: a word that equals the one before it, and a pair of words that
    came up shortly before. They have entries of their own."""
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    yield text[again], np.full(int(again.sum()), 0, np.int64)
    with np.errstate(over="ignore"):
        pairs = words[1:] * np.uint64(3) + words[:-1]
    recur = np.zeros(len(pairs), bool)
    for back in range(1, min(RECALL, len(pairs) - 1) + 1):
        recur[back:] |= (pairs[back:] == pairs[:-back]) & (text[1 + back :] == text[1:-back])
    yield text[1:][recur], np.full(int(recur.sum()), 1, np.int64)


@dataclass(frozen=True)
class Model:
    """Table of vectors, output weights and bias per class (class 0, class 1)."""

    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        return (self.table @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> Model:
    """Fit on texts given as (table entries, shares summing to 1)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (ENTRIES, WIDTH))
    weights, bias = np.zeros((WIDTH, 2)), np.zeros(2)
    # Classes weigh alike in the gradient's start: the bias begins at their log share.
    share = (np.bincount(labels, minlength=2) + 1.0) / (len(labels) + 2.0)
    bias[:] = np.log(share)
    rounds = -(-STEPS // -(-len(texts) // BATCH))
    steps, done = rounds * -(-len(texts) // BATCH), 0
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for first in range(0, len(order), BATCH):
            rate = RATE * (1 - done / steps)
            done += 1
            chosen = order[first : first + BATCH]
            entries = np.concatenate([texts[k][0] for k in chosen])
            shares = np.concatenate([texts[k][1] for k in chosen])
            size = np.array([len(texts[k][0]) for k in chosen])
            begin = np.concatenate([[0], np.cumsum(size)])[:-1]
            mean = np.zeros((len(chosen), WIDTH))
            some = size > 0
            if some.any():
                mean[some] = np.add.reduceat(vectors[entries] * shares[:, None], begin[some])
            logits = mean @ weights + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True)
            error[np.arange(len(chosen)), labels[chosen]] -= 1
            back = error @ weights.T
            weights -= rate * (mean.T @ error)
            bias -= rate * 0.1 * error.sum(axis=0)
            change = np.repeat(back, size, axis=0) * shares[:, None]
            for k in range(WIDTH):
                vectors[:, k] -= rate * np.bincount(entries, change[:, k], ENTRIES)
    return Model(vectors, weights, bias)


def _bags(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    found = list(features(data, offsets))
    text, entry = (np.concatenate([pair[k] for pair in found]) for k in (0, 1))
    key, count = np.unique(text * ENTRIES + entry, return_counts=True)
    of = key // ENTRIES
    edge = np.searchsorted(of, np.arange(len(offsets)))
    total = np.maximum(np.bincount(of, count, len(offsets) - 1), 1)
    # Views of two arrays per slice: thousands of small arrays would leave gaps in the worker's memory.
    entries, shares = (key % ENTRIES).astype(np.int32), count / total[of]
    return [(entries[a:b], shares[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _fit():
    schema = pa.schema([("table", pa.binary()), ("weights", pa.binary()), ("bias", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, labels = [], [], []
        for part, data, offsets in slices(batches, "_text", SLICE_BYTES):
            texts += _bags(data, offsets)
            ids.append(part.column(0).to_numpy(zero_copy_only=False))
            labels.append(part.column(part.schema.get_field_index("_label")).to_numpy(zero_copy_only=False))
        if not texts:
            return
        ids, labels = np.concatenate(ids), np.concatenate(labels).astype(np.int64)
        order = np.lexsort((labels, ids))  # the same model whatever order the rows arrive in
        model = train([texts[k] for k in order], labels[order])
        del texts
        give_back()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in (model.table, model.weights, model.bias)],
            schema=schema,
        )

    return run, "table binary, weights binary, bias binary"


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Model of the labelled documents: ``docs`` has _row_id and _text, ``labels`` _row_id and _label (0 or 1).

    Ids whose labels disagree, and rows with a null id or label, are left out. At most ``rows`` ids are used, the
    smallest by hash; without any, the model scores every text 0.5. The model (ENTRIES x WIDTH numbers) comes to the driver.
    """
    known = (
        labels.filter("_row_id is not null and _label in (0, 1)")
        .groupBy("_row_id")
        .agg(F.min("_label").alias("_label"), F.max("_label").alias("_high"))
        .filter("_label = _high")
        .drop("_high")
    )
    present = known.join(docs.select("_row_id"), "_row_id", "left_semi")
    sample = kept(present.orderBy(F.xxhash64("_row_id"), "_row_id").limit(rows), "labelled")
    # At most ``rows`` ids, so both the broadcast and the one training task are bounded. Of several texts the one of the
    # smallest digest stands for its id.
    texts = docs.join(F.broadcast(sample), "_row_id").groupBy("_row_id")
    texts = texts.agg(F.min_by("_text", F.coalesce(F.sha2("_text", 256), F.lit(""))).alias("_text"), F.min("_label").alias("_label"))
    run, kind = _fit()
    found = texts.repartition(1).mapInArrow(run, kind).collect()
    if not found:
        return Model(np.zeros((ENTRIES, WIDTH)), np.zeros((WIDTH, 2)), np.zeros(2))
    table, weights, bias = (np.frombuffer(bytes(found[0][k]), "<f4").astype(np.float64) for k in range(3))
    return Model(table.reshape(ENTRIES, WIDTH), weights.reshape(WIDTH, 2), bias)


def _score(model: Model, column: str):
    worth, bias = model.folded()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, column, SLICE_BYTES):
            rows = len(offsets) - 1
            total, count = np.zeros(rows), np.zeros(rows)
            for text, entry in features(data, offsets):
                total += np.bincount(text, worth[entry], rows)
                count += np.bincount(text, minlength=rows)
            logit = total / np.maximum(count, 1) + bias
            score = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["row", "score"])

    return run


def scored(docs: DataFrame, model: Model, text_column: str = "text", carried: list[str] | None = None) -> DataFrame:
    """(row, score) per row of ``docs``: its ``carried`` columns (all by default) as a struct, and a score from 0 to 1.

    Null and empty texts have no features and get the score of the bias alone.
    """
    row = F.struct(*named(docs.columns if carried is None else carried)).alias("row")
    rows = docs.select(row, *[c.alias("_text") for c in named([text_column])])
    kind = StructType([rows.schema["row"], StructField("score", DoubleType())])
    return rows.mapInArrow(_score(model, "_text"), kind)
