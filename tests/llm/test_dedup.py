import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, docs, words
from pyspark.sql import functions as F

from turnweave.llm import bucket_pointers, difference_cover, superminhash, tables
from turnweave.llm.components import components
from turnweave.llm.embedding_cells import embedding_groups, spherical_k_means


def united(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {n: root(n) for n in nodes}


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 240)] + [(5, 5), (7, None)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    real = [(a, b) for a, b in links if b is not None and a != b]
    want = united({n for pair in real for n in pair}, real)
    rows = found.collect()
    assert len(rows) == len(want) and {r["id"]: r["component"] for r in rows} == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text, size):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, size):
    rows = awkward()
    base = words(1, 160)
    rng = random.Random(9)
    for k in range(40):  # copies with more and more edits: some link with all, some with a few, some with none
        edited = list(base)
        for at in rng.sample(range(len(edited)), k // 4):
            edited[at] = f"y{k}{at}"
        rows.append((100 + k, " ".join(edited).upper() if k % 5 == 0 else " ".join(edited)))
    found = {r["doc_id"]: r for r in superminhash.near_duplicates(docs(spark, rows), words=size).collect()}
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    want = united(sets, links)
    assert {i: found[i]["component_id"] for i in sets} == want
    assert {i: found[i]["n_shingles"] for i in sets} == {i: len(s) for i, s in sets.items()}
    assert all(found[i]["kept"] == (want[i] == i) for i in sets)
    assert found[None]["component_id"] is None and found[None]["kept"]


@pytest.mark.parametrize("seed", [1, 2])
def test_families_without_their_core(spark, seed):
    """Texts that differ from a missing core in places of their own or in common: pairs lie closely around the limit."""
    rng = random.Random(seed)
    rows, base, other = [], words(5, 130, 10**6), words(6, 70, 10**6)
    for k in range(220):
        edited = list(base if k % 4 else other)
        for at in rng.sample(range(len(edited)), rng.randrange(2, 6)):
            edited[at] = f"e{at}" if rng.random() < 0.4 else f"z{k}{at}"
        if k % 9 == 0:
            edited = edited + words(k % 27, rng.randrange(5, 40), 10**6)
        rows.append((k, " ".join(edited)))
    found = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(docs(spark, rows), words=4).collect()}
    sets = {i: shingles(t, 4) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert found == united(sets, links)


def test_texts_of_one_id_are_all_compared(spark):
    a, b = words(1, 200), words(2, 200)
    near = lambda w: " ".join([*w[:100], "other", *w[101:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(words(3, 200))), (4, None)]
    found = superminhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in found) == [
        (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True)
    ]


def test_near_duplicates_of_nothing_and_of_repeated_ids(spark):
    assert superminhash.near_duplicates(docs(spark, [])).collect() == []
    a, b = " ".join(words(1, 50)), " ".join(words(2, 50))
    found = superminhash.near_duplicates(docs(spark, [(1, a), (3, a), (3, b), (2, b)])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (2, 1), (3, 1), (3, 1)]


def test_signatures_estimate_similarity_with_low_variance():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(40):
        whole = rng.integers(0, 2**63, 90).astype(np.uint64)
        one, other = np.sort(whole[:80]), np.sort(whole[10:])  # 70 of 90
        values = superminhash.signatures(np.concatenate([one, other]), np.array([80, 80]))
        errors.append((values[0] == values[1]).mean() - 70 / 90)
    assert abs(np.mean(errors)) < 0.02
    assert np.var(errors) < (70 / 90) * (20 / 90) / superminhash.SLOTS


def test_features_do_not_depend_on_how_rows_are_batched(monkeypatch):
    rows = [(i, t) for i, t in awkward() if i is not None]
    table = pa.table({"_row_id": pa.array([i for i, _ in rows], pa.int64()), "_text": pa.array([t for _, t in rows], pa.string())})

    def features():
        run, _ = superminhash._features(4)
        return pa.Table.from_batches(list(run(iter(table.to_batches())))).to_pylist()

    whole = features()
    monkeypatch.setattr(tables, "ROWS", 3)
    monkeypatch.setattr(superminhash, "SLICE_BYTES", 100)
    assert features() == whole
    copies = {r["_row_id"]: (r["set_a"], r["set_b"]) for r in whole}
    assert copies[6] == copies[7]


def test_texts_of_one_id_keep_their_own_words(spark):
    a, b, c = (" ".join(words(k, 60)) for k in (1, 2, 3))
    rows = [(1, a), (2, a + " x"), (2, b), (2, None), (3, c + " " + b), (3, a), (3, c)]
    found = difference_cover.without_repeats(docs(spark, rows), window=20).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in found) == sorted(
        [(1, 60, 0, a), (2, 61, 60, "x"), (2, 60, 0, b), (2, 0, 0, ""), (3, 120, 60, c), (3, 60, 60, ""), (3, 60, 0, c)]
    )


def test_covers_meet_every_pair_of_places():
    for period, cover in difference_cover.COVERS.items():
        for apart in range(period):
            assert any((c + apart) % period in cover for c in cover)


def brute_words(rows, window):
    split = {i: (t or "").encode().split() for i, t in rows}
    seen = {}
    for i, w in split.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            seen[key] = min(seen.get(key, i), i)
    out = {}
    for i, w in split.items():
        gone = {j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


@pytest.mark.parametrize("window", [3, 9, 20, 50])
def test_word_windows(spark, window):
    rows = awkward()
    found = {r["doc_id"]: r for r in difference_cover.without_repeats(docs(spark, rows), window=window).collect()}
    want = brute_words([r for r in rows if r[0] is not None], window)
    assert {i: (found[i]["n_words"], found[i]["n_removed"], found[i]["text"]) for i in want} == want
    assert found[None]["n_removed"] == 0


def test_word_windows_of_nothing_and_of_repeated_rows(spark):
    assert difference_cover.without_repeats(docs(spark, [])).collect() == []
    text = " ".join(words(1, 60))
    found = difference_cover.without_repeats(docs(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in found) == [(1, 0), (1, 0), (2, 60)]


def brute_bytes(rows, length):
    data = {i: (t or "").encode() for i, t in rows}
    seen = Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("length", [64, 100, 400])
def test_byte_strings(spark, length):
    rows = [r for r in awkward() if r[0] != 41] + [(50, "ab" * 500), (51, "x" * length), (52, "x" * (length + 1)), (53, "yx" + "ab" * 300)]
    found = bucket_pointers.without_repeats(docs(spark, rows), length=length)
    got = {
        r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), hashlib.sha256(bytes(r["left"])).hexdigest())
        for r in found.collect()
    }
    want = brute_bytes([r for r in rows if r[0] is not None], length)
    assert {i: got[i] for i in want} == want
    assert got[None][1] == 0


def test_byte_strings_of_texts_that_share_an_id(spark):
    a, b, c, d = (" ".join(words(seed, 150)) for seed in range(80, 84))
    texts = [(1, a), (1, b), (1, a[:300]), (2, a), (3, c), (3, d + c[20:520]), (3, None), (4, d[100:]), (4, "x" + a), (5, c[:390]), (5, b[:390])]
    found = bucket_pointers.without_repeats(docs(spark, texts + [(6, b), (6, b)])).collect()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), hashlib.sha256(bytes(r["left"])).hexdigest()) for r in found)
    rows = texts + [(6, b), (6, b)]
    want = brute_bytes(list(enumerate(t for _, t in rows)), 400)
    assert got == sorted((i, *want[k]) for k, (i, _) in enumerate(rows))


def test_clean_text_stays_beside_a_copy_of_its_id(spark):
    a, b = " ".join(words(90, 200)), " ".join(words(91, 200))
    found = bucket_pointers.without_repeats(docs(spark, [(1, a), (1, b), (2, a)])).collect()
    assert sorted((r["doc_id"], bytes(r["left"]).decode()) for r in found) == [(1, ""), (1, b), (2, "")]


def test_byte_strings_of_nothing(spark):
    assert bucket_pointers.without_repeats(docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        bucket_pointers.repeated_spans(docs(spark, []), length=10)


def vectors(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return table.select("*", F.lit(1).alias("rep"), F.lit(2).alias("unit"), F.lit(3).alias("cell"))


@pytest.mark.parametrize("cell_rows", [4096, 12])
def test_embedding_groups(spark, monkeypatch, cell_rows):
    from turnweave.llm import embedding_cells

    monkeypatch.setattr(embedding_cells, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(embedding_cells, "BLOCK", 16 if cell_rows == 12 else 1024)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = []
    for k in range(160):
        near = centres[k % 12] + rng.normal(scale=0.22, size=8)
        rows.append((k, near.astype(np.float32).tolist(), int(k % 24 // 12)))
    rows += [(200 + k, rows[3][1], rows[3][2]) for k in range(40)]  # one very common vector
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [1.0] * 7 + [None], 0), (304, [], 0)]
    rows += [(305, rows[3][1], None), (None, rows[3][1], 0), (306, [float("inf")] + [1.0] * 7, 0), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0)]
    found = {r["vec_id"]: r for r in embedding_groups(vectors(spark, rows)).collect()}
    good = {i: (np.array(v, float), l) for i, v, l in rows if i is not None and i not in (300, 301, 302, 303, 304, 305, 306)}
    links = [
        (a, b) for a in good for b in good
        if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0])
        and good[a][0] @ good[b][0] / np.sqrt((good[a][0] @ good[a][0]) * (good[b][0] @ good[b][0])) >= 0.93
    ]
    count = Counter(n for pair in links for n in pair)
    ids = [r[0] for r in rows if r[0] is not None]
    want = united(ids, links)
    assert {i: found[i]["n_links"] for i in ids} == {i: count[i] for i in ids}
    assert {i: found[i]["component_id"] for i in ids} == want
    assert found[None]["n_links"] == 0 and found[None]["kept"]


def test_embedding_groups_of_nothing(spark):
    assert embedding_groups(vectors(spark, [])).collect() == []


def test_k_means_fills_all_cells():
    points = np.repeat(np.eye(4), 5, axis=0)
    centroids = spherical_k_means(points, 4)
    assert (np.bincount((points @ centroids.T).argmax(axis=1), minlength=4) > 0).sum() >= 3
    assert np.allclose(np.linalg.norm(centroids, axis=1), 1)


def test_vectors_of_more_lengths_than_cells_are_compared(spark, monkeypatch):
    from turnweave.llm import embedding_cells

    monkeypatch.setattr(embedding_cells, "MOST_CELLS", 1)
    rows = [(10 * n + k, "en", [1.0] * n + [k / 1000]) for n in (1, 2, 3) for k in (0, 1)]
    table = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    found = embedding_groups(table).collect()
    assert sorted((r[0], r["component_id"]) for r in found) == [(10 * n + k, 10 * n) for n in (1, 2, 3) for k in (0, 1)]


@pytest.mark.parametrize("split, most", [(40, 4), (15, 3)])
def test_large_cells_are_cut_again(spark, monkeypatch, split, most):
    from turnweave.llm import embedding_cells

    for name, value in {"CELL_ROWS": 12, "MOST_CELLS": most, "SPLIT_ROWS": split, "PART_SAMPLE": 30, "CHUNK": 25, "BLOCK": 8}.items():
        monkeypatch.setattr(embedding_cells, name, value)
    rng = np.random.default_rng(split)
    rows = []
    for k in range(420):
        width = 6 if k % 9 else 4
        centre = np.random.default_rng(k % 60).normal(size=width)
        rows.append((k, (centre + rng.normal(size=width) * rng.choice([0.05, 0.2, 0.6])).tolist(), k % 2))
    rows += [(500 + k, rows[k][1], rows[k][2]) for k in range(0, 40, 3)] + [(600, [1.0, 2.0, 3.0], 0), (601, [2.0, 4.0, 6.0], 0)]
    found = {r["vec_id"]: r for r in embedding_groups(vectors(spark, rows)).collect()}
    unit = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    label = {i: l for i, _, l in rows}
    links = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    want = united(unit, links)
    degree = Counter(x for pair in links for x in pair)
    assert len(links) > 100
    assert {i: (found[i]["n_links"], found[i]["component_id"]) for i in unit} == {i: (degree[i], want[i]) for i in unit}
