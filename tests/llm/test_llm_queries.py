"""Registered queries of the package over the smallest tables, against brute force where they have no SQL."""

import hashlib
import os
import re
import zlib

import corpus_pipeline
import pytest
from helpers import docs
from pyspark.sql import functions as F
from test_dedup import brute_bytes, brute_words, shingles, united

from turnweave.llm.queries import QUERIES
from turnweave.llm.tables import kept

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_every_number_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_byte_repeats(spark, texts):
    rows = QUERIES["op2_suffix_array_dedup"][0](spark, FOLDER).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == brute_bytes(list(texts.items()), 400)


def test_media(spark, texts):
    for r in QUERIES["op6_transport_streams"][0](spark, FOLDER).collect():
        text = texts[r["doc_id"]].encode()
        payload = text + b"\0" * (-len(text) % 64 if text else 64)
        assert r["n_bytes"] == len(text) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])


def test_chat(spark):
    rows = {r["conv_id"]: r for r in QUERIES["op7_chat_windows"][0](spark, FOLDER).collect()}
    talks = {-1: [(0, "user", "<|im_end|><|im_start|>assistant ok"), (1, "assistant", "<|im_end|><|im_start|>assistant ok")]}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    assert set(rows) == set(talks)
    for conv, turns in talks.items():
        said = "".join(f"{role}\n{text}\n" for _, role, text in sorted(turns))
        loss = "".join(text for _, role, text in sorted(turns) if role == "assistant")
        assert rows[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (rows[conv]["n_turns"], rows[conv]["loss_chars"]) == (len(turns), len(loss))
        assert rows[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_stages(spark, texts):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stage, names = given, [n for n, _ in corpus_pipeline.STAGES]
    out = {}
    for name, function in corpus_pipeline.STAGES:
        stage = kept(function(spark, stage, FOLDER), name)
        out[name] = {r["doc_id"]: r["text"] for r in stage.collect()} if name != names[-1] else stage.collect()
        if name != names[-1]:
            assert stage.columns == given.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    accepted = set(out["quality_classifier"])
    right = [(i in accepted) == bool(q) for i, q in labels.items() if i in texts]
    assert sum(right) > 0.9 * len(right)
    sets = {i: shingles(texts[i], 5) for i in accepted}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert set(out["minhash_near_dedup"]) == set(united(sets, links).values())
    after = out["substring_dedup"]
    assert set(after) == set(out["minhash_near_dedup"]) == set(out["pii"])
    words = brute_words(sorted(out["minhash_near_dedup"].items()), 50)
    for i, text in out["minhash_near_dedup"].items():
        n_words, n_removed, kept_text = words[i]
        assert after[i] == (kept_text if n_removed else text)
    private = re.compile(r"[\w.]+@[\w-]+\.[\w.]+|\b\d{3}-\d{3}-\d{4}\b|AKIA[0-9A-Z]{16}|\b[0-9a-f]{32,}\b")
    for i, text in after.items():
        mentions = set(private.findall(text or ""))
        assert not mentions & set(private.findall(out["pii"][i] or "")), i
        if not mentions and not re.search(r"\d|@|[Tt]oken|[Pp]assw|secret|api|\b[MSFHГ]", text or ""):
            assert out["pii"][i] == text
    assert {r["doc_id"] for r in out["best_fit_packing"]} == set(after)


def test_stages_bear_awkward_tables(spark, tmp_path):
    docs(spark, []).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    rows = docs(spark, [(1, None), (2, ""), (3, "good words stand here " * 30), (3, "good words stand here " * 30), (None, "text")])
    for name, function in corpus_pipeline.STAGES[1:]:
        found = kept(function(spark, rows, FOLDER), "awkward")
        assert found.count() >= 3
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.columns == rows.columns


def test_stages_bear_repeated_ids_and_odd_names(spark):
    a, b, c = (" ".join(f"w{seed}x{k * 31 % 97}" for k in range(80)) for seed in (1, 40, 70))
    rows = docs(spark, [(1, a), (2, a + " x"), (2, b), (3, c + " mail me@here.org"), (3, ""), (4, None), (5, "long " * 30000)])
    rows = rows.select("*", F.lit("k").alias("a.b"), F.lit(1).alias("_row"), F.lit(2).alias("_copy"), F.lit(3).alias("b`c"))
    stages = dict(corpus_pipeline.STAGES)
    found = {n: kept(stages[n](spark, rows, FOLDER), "odd") for n in ("quality_classifier", "minhash_near_dedup", "substring_dedup", "pii")}
    assert all(f.columns == rows.columns for f in found.values())
    texts = {n: sorted((r["doc_id"], r["text"]) for r in f.filter("doc_id < 4").collect()) for n, f in found.items()}
    assert texts["substring_dedup"] == sorted([(1, a), (2, "x"), (2, b), (3, c + " mail me@here.org"), (3, "")])
    # The texts of an id stay or go together: 2 is a near copy of 1 by one of its texts.
    assert [i for i, _ in texts["minhash_near_dedup"]] == [1, 3, 3]
    assert [i for i, _ in texts["pii"]] == [1, 2, 2, 3, 3] and not any("me@here.org" in t for _, t in texts["pii"])
    places = kept(stages["best_fit_packing"](spark, rows, FOLDER), "odd").collect()
    assert {r["doc_id"] for r in places} == {1, 2, 3, 4, 5}
