"""The source mixture: targets against plain loops, totals, bounds and reruns of its draws."""

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave.llm import source_mixture
from turnweave.llm.op_mixture import op13_source_mixture
from turnweave.llm.source_mixture import mixture, permuted, sized, spans, taken_words

SIZES = "doc_id long, source string, size long"


def brute_targets(sizes, most=3):
    """Targets by sharing out the excess until none is above, in exact fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, full, left = dict.fromkeys(order, Fraction(0)), set(), Fraction(sum(sizes.values()))
    while left:
        going = [s for s in order if s not in full]
        total = sum(weight[s] for s in going)
        if not total:
            break
        for s in going:
            target[s] += left * weight[s] / total
        left = Fraction(0)
        for s in going:
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = Fraction(most * sizes[s])
                full.add(s)
    return target


def rows_for(seed, documents=400):
    rng = np.random.default_rng(seed)
    sources = ["s1", "s2", "é", "𝔘", "Z", None, "", "tiny", "hot"]
    rows = [(k, sources[8] if k % 3 == 0 else sources[int(rng.integers(0, 7))], int(rng.integers(0, 90))) for k in range(documents)]
    return rows + [(5, "tiny", 9), (5, "tiny", 9), (None, "s1", 40), (7, "bare", 0), (8, "long", 5000)]


def check(rows, found, block):
    sizes = defaultdict(int)
    for _, source, size in rows:
        sizes[source] += size
    wanted = brute_targets(sizes)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in found) == sorted((i is None, i or 0, s) for i, _, s in rows)
    by_source = defaultdict(int)
    facts = {(sizes[s], round(float(wanted[s]), 6)): s for s in sizes}
    for r in found:
        source = facts[r["source_size"], round(r["target"], 6)]
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_source[source] += r["taken"]
    for source, size in sizes.items():
        assert abs(by_source[source] - float(wanted[source])) <= 2 * block


@pytest.mark.parametrize("block, shard_slots, at_once", [(4, 7, 2), (16, 50, 1024), (256, 4096, 3)])
def test_targets_totals_and_bounds(spark, monkeypatch, block, shard_slots, at_once):
    monkeypatch.setattr(source_mixture, "SOURCES_AT_ONCE", at_once)
    monkeypatch.setattr(source_mixture, "PLACES", 30)
    rows = rows_for(block)
    sizes = spark.createDataFrame(rows, SIZES)
    plan, slots, parts = mixture(sizes, block=block, shard_slots=shard_slots)
    check(rows, taken_words(sizes, plan, slots, parts).collect(), block)
    quotas = {r["number"]: (r["quota"], r["blocks"]) for r in plan.collect()}
    placed = [tuple(r) for r in slots.select("shard", "place", "number", "block").collect()]
    assert len(placed) == sum(q for q, _ in quotas.values()) == len({p[:2] for p in placed})
    assert all(0 <= place < shard_slots for _, place, _, _ in placed)
    times = defaultdict(int)
    for _, _, number, at in placed:
        times[number, at] += 1
    for number, (quota, blocks) in quotas.items():
        for at in range(blocks):
            assert quota // blocks <= times[number, at] <= math.ceil(quota / blocks)
    # Spans lie side by side inside a slot and fill its block.
    words = sum(r["length"] for r in spans(slots, parts).collect())
    assert words == taken_words(sizes, plan, slots, parts).agg(F.sum("taken")).first()[0]
    # Another dealing of the rows gives the same mix.
    again = mixture(sizes.repartition(13), block=block, shard_slots=shard_slots)[1]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, slots.collect()))


def test_shards_differ_by_chance_and_seed(spark):
    sizes = spark.createDataFrame([(k, f"s{k % 3}", 400) for k in range(300)], SIZES)
    _, slots, _ = mixture(sizes, block=10, shard_slots=500)
    shares = slots.filter("number = 2").groupBy("shard").count().collect()
    assert len({r["count"] for r in shares}) > 5
    assert all(150 < r["count"] < 350 for r in shares)
    other = mixture(sizes, block=10, shard_slots=500, seed=14)[1]
    assert set(map(tuple, other.collect())) != set(map(tuple, slots.collect()))


def test_permutations():
    for size in (1, 2, 3, 5, 64, 65, 1000):
        for turn in (0, 1):
            n = np.arange(size)
            image = permuted(n, np.full(size, size), np.full(size, 3), np.full(size, turn), 13)
            assert sorted(image.tolist()) == n.tolist()
    n = np.arange(1000)
    images = [permuted(n, np.full(1000, 1000), np.full(1000, s), np.full(1000, t), 13) for s in (0, 1) for t in (0, 1)]
    assert all((a == b).sum() < 20 for k, a in enumerate(images) for b in images[:k])


def test_tables_without_words(spark):
    docs = spark.createDataFrame([(1, None, None), (2, " \n", "a"), (2, " \n", "a")], "doc_id long, text string, source string")
    wide = docs.select("*", *[F.lit(2).alias(c) for c in ("size", "number", "block", "a.b", "row")])
    sizes = sized(wide)
    assert sorted(tuple(r) for r in taken_words(sizes, *mixture(sizes)).select("doc_id", "size", "target", "taken").collect()) == [
        (1, 0, 0.0, 0), (2, 0, 0.0, 0), (2, 0, 0.0, 0)
    ]
    empty = sized(docs.limit(0))
    assert taken_words(empty, *mixture(empty)).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["source"], len([w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in r["text"] or "").split(" ") if w]))
            for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = op13_source_mixture(spark, folder)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"]
    check(rows, found.collect(), 256)
