"""Ordered statistics over sparse positions and a dominant key, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from turnweave.operators import intervals, running
from turnweave.operators.running import Running, even_bins, numbered

RNG = random.Random(11)


def sparse(count=400):
    """One key with most rows at positions far apart, and many small ones; steps of +1 and -1."""
    rows = [("big", place * 10**9 + RNG.randrange(10**6), RNG.choice([1, -1])) for place in range(count)]
    return rows + [(f"k{k}", RNG.randrange(10**12) + n * 10**12, RNG.choice([1, -1])) for k in range(60) for n in range(3)]


def by_key(rows):
    groups = {}
    for key, position, step in sorted(rows):
        groups.setdefault(key, []).append((position, step))
    return groups


def lowest(rows, inclusive):
    total, low, out = 0, None, {}
    for position, step in rows:
        total += step
        now = total if low is None else min(low, total)
        out[position] = now if inclusive else low
        low = now
    return out


@pytest.mark.parametrize("size", [7, 50, 10_000])
def test_sums_and_lows_share_a_pass(spark, size):
    rows = sparse()
    df = spark.createDataFrame(rows, "key string, position long, step long")
    binned = even_bins(df, ["key"], "position", size=size)
    found = running.running(
        binned, ["key"], "_bin", ["position"],
        total=Running("sum", F.col("step"), inclusive=True), low=Running("low", F.col("step")),
        low_now=Running("low", F.col("step"), inclusive=True), high=Running("max", F.col("position")),
    )
    got = {(r["key"], r["position"]): (r["total"], r["low"], r["low_now"], r["high"]) for r in found.collect()}
    for key, steps in by_key(rows).items():
        before, now, total, high = lowest(steps, False), lowest(steps, True), 0, None
        for position, step in steps:
            total += step
            assert got[key, position] == (total, before[position], now[position], high)
            high = position
    assert len(got) == len(rows)


def test_bins_follow_the_rows_and_not_the_positions(spark):
    df = spark.createDataFrame(sparse(4_000), "key string, position long, step long")
    bins = even_bins(df, ["key"], "position", size=100).groupBy("key", "_bin").count().collect()
    assert max(r["count"] for r in bins if r["key"] == "big") < 250
    assert sum(r["key"] == "big" for r in bins) <= 41
    # One bin per small key, whatever its positions: far fewer rows than the table has.
    assert len(bins) <= 60 + 41


def test_numbers_and_pairs_over_sparse_positions(spark, small_bins):
    rows = sparse(120)
    df = spark.createDataFrame(rows, "key string, position long, step long")
    found = {(r["key"], r["position"]): r["n"] for r in numbered(df, ["key"], "position", "n").collect()}
    assert found == {(k, p): n for k, steps in by_key(rows).items() for n, (p, _) in enumerate(steps, 1)}
    marks = [(k, p, "S" if step > 0 else "E", p % 1000) for k, p, step in rows]
    pairs = intervals.pair_intervals(spark.createDataFrame(marks, "media_id string, line_no long, kind string, at long"))
    got = {}
    for r in pairs.collect():
        got.setdefault(r["media_id"], []).append((r["start"], r["end"]))
    want = {k: brute.paired(v) for k, v in brute.by_key(marks).items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
