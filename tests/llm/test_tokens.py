import base64
import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from helpers import awkward, docs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnweave.llm import bpe_sql, difference_cover, packing
from turnweave.llm.op_bpe import op3_byte_bpe
from turnweave.llm.op_pack import packed_documents

RANKS = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a" * 900, "\x1c\x1d\x85   x​ \t\n\r\x0b\x0c  ", "日本語テキスト" * 20, "<|endoftext|> it's I'LL 'S ´", "é ﬁ Ǆ 𝔘 १२३",
    "   ", "\n\n\n a", "Ω" * 300 + "ßẞ" * 90, "qwertyzxcvb" * 60, "", "\x00\x01 \x7f", "é ǻ İ ǅ", "x<|startoftext|>y",
]


@pytest.fixture(scope="module")
def wanted():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library_and_decode_back(spark, wanted):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, t) for k, (_, t) in enumerate(awkward())]
    table = docs(spark, rows).select(F.col("doc_id").alias("_row_id"), F.col("text").alias("_text"))
    ids = bpe_sql.encoded(table, RANKS, public_tokenizers.PATTERN)
    found = {r["_row_id"]: r for r in bpe_sql.decoded(ids, RANKS, public_tokenizers.PATTERN).collect()}
    for row_id, text in rows:
        want = wanted.encode_ordinary(text or "")
        assert np.frombuffer(bytes(found[row_id]["ids"]), "<u4").tolist() == want
        assert found[row_id]["n_tokens"] == len(want)
        assert bytes(found[row_id]["decoded"]) == (text or "").encode()


def test_long_pieces_go_through_several_queries(wanted, monkeypatch):
    monkeypatch.setattr(bpe_sql, "QUERY_BYTES", 200)
    tokens = bpe_sql.RankTokens(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdeéß") for _ in range(n)) for n in (1, 2, 60, 300, 700)]
    ids, counts = tokens.encode(texts)
    assert ids.tolist() == [i for t in texts for i in wanted.encode_ordinary(t)]
    assert counts.tolist() == [len(wanted.encode_ordinary(t)) for t in texts]


def test_tokens_of_nothing(spark):
    table = docs(spark, []).select(F.col("doc_id").alias("_row_id"), F.col("text").alias("_text"))
    assert bpe_sql.decoded(bpe_sql.encoded(table, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("capacity", [4096, 50])
def test_packing(spark, capacity):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, t) for k, (_, t) in enumerate(awkward())] + [(0, ODD[0]), (None, "null id")]
    found = packed_documents(docs(spark, rows), capacity=capacity).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    want = []
    for row_id, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((row_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    order = lambda r: tuple(-5 if x is None else x for x in r)
    assert sorted([tuple(r)[:5] for r in found], key=order) == sorted(want, key=order)
    filled = {}
    for r in found:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in filled.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity


def test_packing_of_nothing(spark):
    assert packed_documents(docs(spark, [])).collect() == []


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fitting = [k for k, g in enumerate(gaps) if g >= length]
        if fitting:
            gaps[min(fitting, key=lambda k: gaps[k])] -= length
        else:
            gaps.append(capacity - length)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_sweeps_equal_best_fit_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 100])
    lengths = [rng.randrange(1, capacity + 1) if rng.random() < 0.6 else rng.randrange(1, 5) for _ in range(400)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    filled, rank_ends = {}, {}
    entries = packing.sweep(counts, capacity)
    for k, (length, rank, first, each, offset) in enumerate(sorted(entries)):
        after = [e for e in sorted(entries)[k + 1 :] if e[0] == length]
        end = after[0][1] if after else counts[length]
        for r in range(rank, end):
            sequence, at = first + (r - rank) // each, offset + (r - rank) % each * length
            filled.setdefault(sequence, []).append((at, length))
        rank_ends[length] = end
    assert sum(len(v) for v in filled.values()) == len(lengths)
    gaps = []
    for places in filled.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        gaps.append(capacity - end)
    assert sorted(gaps) == best_fit_decreasing(lengths, capacity)


def test_digest_of_ids_is_little_endian(wanted):
    ids = wanted.encode_ordinary("hello world")
    assert hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def test_words_are_encoded_once_for_the_tasks_of_a_worker(monkeypatch):
    new, made = [], packing.WordTokens._new
    monkeypatch.setattr(packing.WordTokens, "_new", lambda self, *given: new.append(1) or made(self, *given))
    run, _ = packing._pieces(Path(WORDS).read_text("utf-8"), 4096, 1)
    batch = pa.RecordBatch.from_pydict({"_row_id": [1, 2], "_text": ["some words of a worker", "words of some"]})
    first, second = (list(run(iter([batch]))) for _ in range(2))
    assert first == second and len(new) <= 1


def test_pieces_are_merged_once_for_the_tasks_of_a_worker(monkeypatch):
    merged, made = [], bpe_sql.RankTokens.merged
    monkeypatch.setattr(bpe_sql.RankTokens, "merged", lambda self, given: merged.append(1) or made(self, given))
    run, _ = bpe_sql._encode(RANKS, public_tokenizers.PATTERN)
    batch = pa.RecordBatch.from_pydict({"_row_id": [1, 2], "_text": ["some pieces of a worker", "pieces of some"]})
    first, second = (list(run(iter([batch]))) for _ in range(2))
    assert first == second and len(merged) <= 1


def test_frequent_pieces_stay_when_too_many_are_known(monkeypatch):
    monkeypatch.setattr(bpe_sql, "MOST_PIECES", 60)
    merged, made = [], bpe_sql.RankTokens.merged
    monkeypatch.setattr(bpe_sql.RankTokens, "merged", lambda self, given: merged.extend(given) or made(self, given))
    tokens, fresh = bpe_sql.RankTokens(RANKS, public_tokenizers.PATTERN), bpe_sql.RankTokens(RANKS, public_tokenizers.PATTERN)
    for k in range(20):
        text = "qwertyzx" + "".join(f" zq{chr(97 + k)}{chr(97 + j)}xv" for j in range(25))
        ids, counts = tokens.encode([text, "", "qwertyzx"])
        assert len(tokens.place) <= 60
        want = [fresh.encode([t])[0].tolist() for t in (text, "", "qwertyzx")]
        fresh._clear()
        assert ids.tolist() == [i for part in want for i in part] and counts.tolist() == [len(part) for part in want]
    tokens.encode(["qwertyzx"])
    merged.clear()
    tokens.encode([" ".join(f"yy{a}{b}qx" for a in "abcdef" for b in "abcdef")])
    tokens.encode(["qwertyzx"])
    assert merged and b"qwertyzx" not in merged


def test_a_task_of_op3_needs_one_python_worker(spark, tmp_path, capsys):
    docs(spark, [(1, "some text"), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    found = op3_byte_bpe(spark, str(tmp_path))
    found.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    assert {r["doc_id"]: r["n_tokens"] for r in found.collect()} == {1: 2, 2: 0}


def test_other_work_frees_the_tokens_of_a_worker():
    batch = pa.RecordBatch.from_pydict({"_row_id": [1], "_copy": [0], "_text": ["words of a worker"]})
    list(packing._pieces(Path(WORDS).read_text("utf-8"), 4096, 1)[0](iter([batch.select(["_row_id", "_text"])])))
    assert packing.word_tokens.cache_info().currsize == 1
    list(bpe_sql._encode(RANKS, public_tokenizers.PATTERN)[0](iter([batch.select(["_row_id", "_text"])])))
    assert packing.word_tokens.cache_info().currsize == 0 and bpe_sql.rank_tokens.cache_info().currsize == 1
    list(difference_cover._anchors(50)(iter([batch])))
    assert bpe_sql.rank_tokens.cache_info().currsize == 0
