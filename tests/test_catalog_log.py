"""The catalog log: total order, failed writers, compaction, the index by file, and look-ups by hash alone."""

import random

import pytest

from turnweave.operators.catalog import look_up
from turnweave.operators.refresh import plan_refresh
from turnweave.sinks import catalog_log
from turnweave.sinks.catalog_log import append_log, compact_log, known_rows, merge_index, read_log
from turnweave.streaming.intake import start_intake

ROW = "pos long, audio_id string, source_file_identity string, source_hash string, conversion_signature string, artifact_exists boolean, artifact_path string"
FILES = "path string, source_file_identity string, source_hash string, size_bytes long"


def rows(spark, *values):
    return spark.createDataFrame([(n, f"a{n}", i, h, s, e, f"/out/{p}") for n, (i, h, s, e, p) in enumerate(values)], ROW)


def many(seed, count):
    rng = random.Random(seed)
    return [
        (rng.choice([None, "", f"S::{rng.randrange(9)}.wav", f"s::{rng.randrange(9)}.WAV"]), f"h{rng.randrange(6)}", rng.choice("XY"),
         rng.random() < 0.7, f"p{rng.randrange(40)}")
        for _ in range(count)
    ]


def files(spark):
    named = [(f"{k}", f"s::{k}.wav", f"h{h}", 1) for k in range(10) for h in range(7)]
    return spark.createDataFrame(named + [(f"b{h}", i, f"h{h}", 1) for h in range(8) for i in (None, " ", "/")], FILES)


def found(files, catalog):
    hit = look_up(files, catalog, "X").select("path", "source_hash", "source_file_identity", "exact.audio_id", "reusable.audio_id")
    return sorted(map(repr, map(tuple, hit.collect())))


def test_commits_have_a_total_order(spark, tmp_path):
    root = str(tmp_path / "log")
    assert read_log(spark, root).collect() == [] and compact_log(spark, root) is None
    assert append_log(rows(spark, ("i", "h", "X", True, "a"), ("i", "h", "X", True, "b")), root, ["pos"]) == 1
    assert append_log(rows(spark, ("i", "h", "X", True, "c")), root, ["pos"]) == 2
    assert append_log(rows(spark, ("i", "h", "X", True, "d")), root, ["pos"], commit=2) == 2  # marked already
    read_log(spark, root).write.parquet(f"{root}/log/commit_3")  # a writer that stopped before its marker
    got = read_log(spark, root).orderBy("catalog_pos").collect()
    assert [(r["catalog_pos"]["commit"], r["catalog_pos"]["place"], r["artifact_path"]) for r in got] == [
        (1, 1, "/out/a"), (1, 2, "/out/b"), (2, 1, "/out/c")
    ]
    assert append_log(rows(spark, ("i", "h", "X", True, "e")), root, ["pos"]) == 3
    assert read_log(spark, root, after=2).count() == 1


def test_compaction_keeps_every_look_up(spark, tmp_path):
    root = str(tmp_path)
    for seed in range(3):
        append_log(rows(spark, *many(seed, 40)), root, ["pos"])
    before = read_log(spark, root)
    paths = {}
    for r in before.orderBy("catalog_pos").collect():
        paths.setdefault(r["artifact_path"].lower(), r["catalog_pos"])
    assert compact_log(spark, root) == 3
    after = read_log(spark, root)
    assert {r["artifact_path"].lower(): r["catalog_pos"] for r in after.collect()} == paths
    append_log(rows(spark, *many(9, 10)), root, ["pos"])
    assert read_log(spark, root).count() == len(paths) + 10


def test_index_returns_what_the_whole_log_does(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog_log, "BUCKETS", 8)
    root = str(tmp_path)
    assert merge_index(spark, root) == 0 and known_rows(files(spark), root).collect() == []
    for seed in range(3):
        append_log(rows(spark, *many(seed, 40)), root, ["pos"])
        assert merge_index(spark, root) == seed + 1
        assert found(files(spark), known_rows(files(spark), root)) == found(files(spark), read_log(spark, root))
    one = files(spark).filter("path = '3'")
    read = known_rows(one, root).inputFiles()
    assert read and {p.split("/side=")[1].split("/version")[0] for p in read} == {read[0].split("/side=")[1].split("/version")[0]}


def test_stopped_merge_is_done_again(spark, tmp_path, monkeypatch):
    root, mark = str(tmp_path), catalog_log._mark

    def stops(spark, root, kind, number):
        if kind == "index":
            raise RuntimeError("stopped")
        mark(spark, root, kind, number)

    append_log(rows(spark, *many(1, 30)), root, ["pos"])
    merge_index(spark, root)
    append_log(rows(spark, *many(2, 30)), root, ["pos"])
    old = found(files(spark), known_rows(files(spark), root))
    monkeypatch.setattr(catalog_log, "_mark", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        merge_index(spark, root)
    assert found(files(spark), known_rows(files(spark), root)) == old
    monkeypatch.setattr(catalog_log, "_mark", mark)
    assert merge_index(spark, root) == 2
    assert found(files(spark), known_rows(files(spark), root)) == found(files(spark), read_log(spark, root))


def test_files_without_identity_match_by_hash(spark):
    stored = rows(
        spark, ("s::a", "h", "Y", False, "1"), ("s::b", "h", "Y", True, "2"), ("", "h", "X", True, "3"), ("s::c", "g", "X", True, "4")
    ).withColumnRenamed("pos", "catalog_pos")
    asked = spark.createDataFrame([("p1", "", "h", 1), ("p2", None, "g", 1), ("p3", "s::z", "h", 1), ("p4", "", "none", 1)], FILES)
    hits = {r["path"]: r for r in look_up(asked, stored, "X").collect()}
    assert (hits["p1"].exact.audio_id, hits["p1"].reusable.audio_id) == ("a2", "a1")
    assert (hits["p2"].exact, hits["p2"].reusable.audio_id) == (None, "a3")
    assert (hits["p3"].exact, hits["p3"].reusable, hits["p4"].reusable) == (None, None, None)
    planned = {r["path"]: (r["action"], r["reason"], r["duplicate_of"]) for r in plan_refresh(asked, stored, "X").collect()}
    assert planned["p1"] == ("skipped", "unchanged", "a2") and planned["p2"] == ("skipped", "existing_artifact_reused", "a3")
    assert planned["p3"][0] == planned["p4"][0] == "queued"


@pytest.mark.parametrize("indexed", [False, True])
def test_stream_in_several_batches(spark, tmp_path, indexed):
    root, output = str(tmp_path / "log"), str(tmp_path / "plan")
    append_log(rows(spark, *many(5, 60)), root, ["pos"])
    files(spark).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    catalog = root if indexed else lambda: read_log(spark, root)
    start_intake(stream, catalog, "X", output, str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(output)
    assert got.select("batch").distinct().count() == 3
    want = plan_refresh(files(spark), read_log(spark, root), "X")
    assert sorted(map(repr, got.drop("batch").collect())) == sorted(map(repr, want.collect()))
