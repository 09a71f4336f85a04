"""The conversation prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from turnweave.llm import zfast_trie
from turnweave.llm.zfast_trie import ordered_turns, prefix_trie, two_fattest, with_shared_start

TALKS = "conv_id long, turn long, role string, text string"


def talk_of(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(turns, key=lambda x: x[:2])] for c, turns in talks.items()}


def rebuilt(talks):
    out = {}
    for c, turns in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(talks.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:])
    return out


def brute(sequences):
    members = defaultdict(list)
    for c in sorted(sequences):
        for d in range(len(sequences[c]) + 1):
            members[sequences[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, inside in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(inside) - 1) * len(node[-1][1]) if node else 0
    rows = set()
    for node, inside in members.items():
        ends = ",".join(str(c) for c in inside if sequences[c] == node)
        parent = members[node[:-1]][0] if node else None
        rows.add((inside[0], len(node), parent, len(inside), children.get(node, 0), leaves[node], saved[node],
                  hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.collect())


def tree(spark, rows):
    turns = ordered_turns(spark.createDataFrame(rows, TALKS).select("*", *[F.lit(3).alias(c) for c in ("nth", "depth", "x1", "a.b", "rep")]))
    return prefix_trie(*with_shared_start(turns))


def key(row):
    return tuple((v is not None, v) for v in row)


def test_trie_of_random_conversations(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 130), *range(200, 230), -3, -100, -205, 10**12]:
        base = rng.choice(["p", "q", "pp"])
        for turn in range(rng.choice([1, 2, 3, 5, 9, 20])):
            rows.append((c, turn or None, rng.choice(["user", "user", None]), base if turn < 3 else rng.choice([None, "", "é𝔘", "long text"])))
    rows += [(None, 1, "user", "nobody"), (555, 2, None, None), (556, None, "", "")]
    wanted = brute(rebuilt(talk_of(rows)))
    assert sorted(found(tree(spark, rows)), key=key) == sorted(wanted, key=key)


def given(spark, sequences):
    rows = [(c, d + 1, role, text) for c, turns in sequences.items() for d, (role, text) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, depth long, role string, text string")
    keyed = turns.select("conv_id", "depth", *zfast_trie.turn_keys(F.col("role"), F.col("text")))
    return prefix_trie(keyed, spark.createDataFrame([(c,) for c in sequences], "conv_id long"))


def test_chains_copies_and_branches(spark, monkeypatch):
    monkeypatch.setattr(zfast_trie, "BIN", 4)
    spine = [("u", f"t{d}") for d in range(37)]
    sequences = {1: (), 2: tuple(spine), 3: tuple(spine), 90: ()}
    for k in range(0, 36, 3):
        sequences[100 + k] = tuple(spine[:k])
        sequences[200 + k] = tuple(spine[:k] + [("u", "side")] * (k % 4))
        sequences[300 + k] = tuple(spine[:k] + [("u", "side")] * 2 + [("x", str(k % 2))])
    for k in range(20):
        sequences[400 + k] = (("other", "copy"),)
    wanted = brute(sequences)
    assert sorted(found(given(spark, sequences)), key=key) == sorted(wanted, key=key)


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], TALKS)
    assert found(prefix_trie(*with_shared_start(ordered_turns(empty)))) == []
    # A conversation loses its only turn and has no conversation 0 to start from.
    conv = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6)
    alone = (conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())
    assert found(tree(spark, [(conv, 1, "user", "x")])) == [alone]


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)] + [(2**40 - 1, 2**40 + 5), (5, 2**33 - 1)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    for a, b, f in rows:
        assert a < f <= b
        step = f & -f
        assert b // (2 * step) == a // (2 * step)


@pytest.mark.parametrize("seed", [1, 2])
def test_deep_random_tries(spark, seed):
    rng = random.Random(seed)
    sequences = {}
    for c in range(150):
        turns, d = [], 0
        while rng.random() < 0.9 and d < 70:
            turns.append(("u", "ab"[rng.random() < 0.15] * (d % 3)))
            d += 1
        sequences[c] = tuple(turns)
    wanted = brute(sequences)
    assert sorted(found(given(spark, sequences)), key=key) == sorted(wanted, key=key)
