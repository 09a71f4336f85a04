import hashlib
import json

import pytest
from pyspark.sql import functions as F

from turnweave.operators import items, timeline
from turnweave.plans import files as plans
from turnweave.sinks import documents as sinks
from turnweave.sinks.lines import write_lines
from turnweave.sources import documents, files, probe, run_folders, silence, stages
from turnweave.streaming.intake import new_files, start_intake
from turnweave.streaming.stale import closed_sessions


def write(path, payload):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False, indent=2)
    path.write_text(text, encoding="utf-8")


def test_discovery_and_hashes(spark, tmp_path):
    root = tmp_path / "_inputs"
    write(root / "a.WAV", "one")
    write(root / "deep" / "b c.mp3", "two")
    write(root / "deep" / "notes.txt", "three")
    roots = [{"source_id": "Main", "path": str(root)}, {"source_id": "gone", "path": str(tmp_path / "missing")},
             {"source_id": "flat", "path": str(root), "recursive": False}]
    found, missing = files.discover_files(spark, roots)
    rows = {(r.source_id, r.relative_path): r for r in found.collect()}
    assert set(rows) == {("Main", "a.WAV"), ("Main", "deep/b c.mp3"), ("flat", "a.WAV")}
    assert missing == [str(tmp_path / "missing")]
    assert rows["Main", "deep/b c.mp3"].source_file_identity == "Main::deep/b c.mp3"
    assert files.select_roots(found, ["MAIN"]).count() == 2
    digest = hashlib.sha256(b"two").hexdigest()
    hashed = {r.path: r.source_hash for r in files.hash_files(found).collect()}
    assert hashed[str(root / "deep" / "b c.mp3")] == digest
    whole = {r.path: r.source_hash for r in files.content_hashes(spark, str(root)).collect()}
    assert whole[str(root / "deep" / "b c.mp3")] == digest and len(whole) == 3


def test_item_folders(spark, tmp_path):
    source = {"source_hash": "h", "duration_sec": 2.5, "source_id": "s"}
    write(tmp_path / "one" / "timeline.json", {"source": {"source_hash": "old"}, "pipeline": {"generation_signature": "t"}})
    write(tmp_path / "one" / "convert_info.json", {"source": source, "generated_at": "2026-01-01"})
    write(tmp_path / "two" / "timeline.json", {"source": source})
    write(tmp_path / "three" / "timeline.json", {"turns": []})
    write(tmp_path / "three" / "convert_info.json", {"source": "text"})
    rows = documents.scan_items(spark, str(tmp_path)).collect()
    assert [r.audio_id for r in rows] == ["one"]
    assert (rows[0].source_hash, rows[0].conversion_signature, rows[0].duration_seconds) == ("h", "t", 2.5)
    assert rows[0].artifact_path == str(tmp_path / "one" / "timeline.json")


def test_catalog_lines(spark, tmp_path):
    lines = [
        json.dumps({"audio_id": "a", "artifact_path": "/x/a", "source_hash": "1"}), "", "{broken",
        json.dumps({"media_id": "b", "artifact_path": "/x/b", "sha256": "2"}),
        json.dumps({"audio_id": "c", "artifact_path": "/x/gone"}), json.dumps({"audio_id": "d"}),
    ]
    write(tmp_path / "catalog.jsonl", "\n".join(lines))
    existing = spark.createDataFrame([("/x/a",), ("/x/b",)], "path string")
    rows = documents.read_catalog(spark, str(tmp_path / "catalog.jsonl"), existing).orderBy("catalog_pos").collect()
    assert [(r.audio_id, r.source_hash) for r in rows] == [("a", "1"), ("b", "2")]


def test_run_folders(spark, tmp_path):
    hidden, plain = tmp_path / "data" / "runs", tmp_path / "out"
    item = {"status": "completed", "size_bytes": 10, "duration_seconds": 4.0, "processing_wall_seconds": 20.0,
            "audio_codec": "aac", "media_id": "m", "sha256": "h", "stage_elapsed_seconds": {"diarize_audio": 3}}
    write(hidden / "run-2" / "request.json", {"run_id": "two", "compute_mode": "gpu", "created_at": "x"})
    write(hidden / "run-2" / "status.json", {"state": "running", "videos_done": 3})
    write(plain / "run-1" / "request.json", {"compute_mode": "cpu"})
    write(plain / "run-1" / "status.json", {"items_done": 1, "videos_done": 9})
    write(plain / "run-1" / "manifest.json", {"items": [item]})
    write(plain / "run-0" / "request.json", {"run_id": "no status"})
    runs = run_folders.read_runs(spark, [str(hidden), str(plain)])
    rows = runs.orderBy(F.desc("run_name")).collect()
    assert [(r.run_id, r.state, r.items_done, len(r.items)) for r in rows] == [("two", "running", 3, 0), ("run-1", "unknown", 1, 1)]
    manifest = run_folders.manifest_items(runs)
    row = manifest.head()
    assert (row.run_id, row.audio_id, row.source_hash, row.stage_elapsed_seconds) == ("run-1", "m", "h", {"diarize_audio": 3.0})
    assert run_folders.history_samples(manifest, "run-1").count() == 0
    assert run_folders.history_samples(manifest, "run-2").head().wall_seconds == 20.0


def test_probe_facts(spark):
    payload = {
        "format": {
            "duration": "73.25", "size": "4096", "bit_rate": "192000", "format_name": "ogg,oga",
            "tags": {"creation_time": "2025-11-08T17:40:12Z", "date": "2025-11-07T06:05:04Z"},
        },
        "streams": [
            {"codec_type": "audio", "codec_name": "vorbis", "channels": 6, "sample_rate": "22050",
             "tags": {"encoded_date": "2025-11-08T09:15:00Z"}}
        ],
    }
    rows = spark.createDataFrame([("/a/B.M4A", json.dumps(payload)), ("/a/c", "{}"), ("/a/d", "nonsense")], "path string, probe_json string")
    facts = {r.path: r for r in probe.probe_facts(rows).collect()}
    full = facts["/a/B.M4A"]
    assert (full.container_name, full.audio_codec, full.audio_channels, full.audio_sample_rate, full.bitrate) == (
        "ogg", "vorbis", 6, 22050, 192000
    )
    assert (full.duration_seconds, full.size_bytes_probed, full.extension) == (73.25, 4096, ".m4a")
    assert full.captured_at == "2025-11-07T06:05:04Z"
    assert full.metadata_timestamp_candidates == ["2025-11-07T06:05:04Z", "2025-11-08T09:15:00Z", "2025-11-08T17:40:12Z"]
    assert not facts["/a/d"].readable and facts["/a/c"].captured_at is None
    assert facts["/a/c"].readable and facts["/a/c"].duration_seconds == 0
    stated = [("N/A", "5"), ("3.5", "N/A"), ("", "5"), (" 2 ", " 7 ")]
    rows = spark.createDataFrame(
        [(f"/{k}", json.dumps({"format": {"duration": d, "size": s}})) for k, (d, s) in enumerate(stated)],
        "path string, probe_json string",
    )
    assert [r.readable for r in probe.probe_facts(rows).orderBy("path").collect()] == [False, False, True, True]


def test_broken_silence_marks_take_no_part(spark):
    lines = spark.createDataFrame([("silence_start: 1.2.3",), ("silence_end: 4.5",), ("other",)], "line string")
    assert [(r.kind, r["at"]) for r in silence.silence_marks(lines).collect()] == [("E", 4.5)]
    assert [r.line for r in silence.broken_marks(lines).collect()] == ["silence_start: 1.2.3"]


def test_silence_logs(spark, tmp_path):
    log = "x\nsilence_start: 1.5\r\nsilence_end: 2 | silence_duration: 0.5\nsilence_start: -0.01\nsilence_end: 9 silence_start: 8\n"
    write(tmp_path / "talk.log", log)
    rows = silence.read_silence_logs(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.media_id, r.line_no, r.kind, r.at) for r in rows] == [
        ("talk", 1, "S", 1.5), ("talk", 2, "E", 2.0), ("talk", 4, "S", 8.0)
    ]


def test_stage_outputs(spark, tmp_path):
    write(tmp_path / "m 1" / "diarize.json", {"turns": [{"start": 0.0, "end": 1.0, "speaker": "A"}, {"start": 1, "end": 2}]})
    write(
        tmp_path / "m 1" / "transcribe.json",
        {"status": "ok", "segments": [{"index": 1, "start": 0.5, "end": 1.5, "text": " a  b ", "avg_logprob": -0.1},
                                      {"index": 2, "start": 2, "end": 3, "text": "  "}]},
    )
    turns, segments = stages.read_stage_outputs(spark, str(tmp_path))
    assert [tuple(r) for r in turns.orderBy("turn_pos").collect()] == [("m 1", 0, 0.0, 1.0, "A"), ("m 1", 1, 1.0, 2.0, None)]
    assert [tuple(r) for r in segments.collect()] == [("m 1", 1, 0.5, 1.5, "a b", -0.1, None)]


def test_timeline_summary_and_source_info(spark):
    rows = spark.createDataFrame(
        [(1, '{"turn_count": 5, "turns": [{"speaker": " A "}, {"speaker": "A"}, {"speaker": ""}]}'), (2, '{"turns": [{}]}'),
         (3, "{bad"), (4, None), (5, '{"turn_count": "9", "turns": [{"speaker": "B"}]}')],
        "item int, timeline_json string",
    )
    found = {r.item: tuple(r)[1:] for r in documents.timeline_summary(rows).collect()}
    assert found == {1: (True, 5, 1), 2: (True, 1, 0), 3: (True, 0, 0), 4: (False, 0, 0), 5: (True, 1, 1)}


def test_timeline_summary_of_a_recording_in_parts(spark):
    turns = spark.createDataFrame(
        [("m", n, f"s{n % 5}") for n in range(1, 7)] + [("n", 1, "A")], "media_id string, index int, speaker string"
    )
    sources = spark.sql("select id as media_id, struct(id as source_hash) as source, struct(id as s) as pipeline from values ('m'), ('n'), ('o') as t(id)")
    lines = timeline.timeline_documents(turns, sources, per_part=2)
    for columns, key in ((["media_id"], None), (["media_id", "part"], None), (["media_id", "part"], "media_id")):
        rows = lines.select(*columns, F.to_json(F.struct("part", "parts", "turn_count", "turns")).alias("timeline_json"))
        found = documents.timeline_summary(rows, key=key).select("media_id", "has_timeline", "turn_count", "speaker_count")
        assert sorted(map(tuple, found.collect())) == [("m", True, 6, 5), ("n", True, 1, 1), ("o", True, 0, 0)]


def test_written_documents_and_export(spark, tmp_path):
    turns = spark.createDataFrame(
        [("m", n, n * 1.0, f"t{n}") for n in range(1, 6)], "media_id string, index int, start double, text string"
    )
    sources = spark.createDataFrame([("m", "h", "sig"), ("n", "h2", "sig")], "media_id string, h string, s string").selectExpr(
        "media_id", "struct(h as source_hash, cast(null as string) as recorded_at) as source",
        "struct(s as generation_signature) as pipeline",
    )
    lines = timeline.timeline_documents(turns, sources, per_part=2)
    infos = sources.selectExpr("media_id", "'2026' as generated_at", "source", "pipeline")
    sinks.write_documents(lines, str(tmp_path / "timeline"))
    sinks.write_documents(infos, str(tmp_path / "info"))
    assert '"recorded_at":null' in "".join(p.read_text() for p in (tmp_path / "timeline").glob("*.json"))
    scanned = documents.scan_written(spark, str(tmp_path / "timeline"), str(tmp_path / "info")).orderBy("audio_id").collect()
    assert [(r.audio_id, r.source_hash, r.conversion_signature) for r in scanned] == [("m", "h", "sig"), ("n", "h2", "sig")]
    sinks.write_documents(infos, str(tmp_path / "folders"), per_item=True)
    assert (tmp_path / "folders" / "item_id=m").is_dir()

    listed = spark.createDataFrame([("m", "available"), ("n", "missing_artifact")], "item_id string, status string")
    named = lambda df: df.withColumnRenamed("media_id", "item_id")
    chosen, missing = items.export_items(listed, items.requested_ids(spark, ["M"]))
    sinks.export_package(chosen, missing, named(lines), named(infos), str(tmp_path / "out"))
    assert (tmp_path / "out" / "timeline" / "items" / "item_id=m").is_dir()
    sinks.export_package(chosen, missing, named(lines), named(infos), str(tmp_path / "out"))
    again = spark.read.json(str(tmp_path / "out" / "timeline" / "items"))
    assert again.filter("item_id = 'm'").count() == lines.filter("media_id = 'm'").count()
    assert [r.package_path for r in chosen.collect()] == ["timeline/items/item_id=m"]
    for wanted, message in ((["m", "zzz", "yyy"], "Item not found: 2 requested ids"), (["n"], "No completed item artifacts")):
        with pytest.raises(ValueError, match=message):
            chosen, missing = items.export_items(listed, items.requested_ids(spark, wanted))
            sinks.export_package(chosen, missing, named(lines), named(infos), str(tmp_path / "out2"))


def test_intake_stream_plans_only_new_files(spark, tmp_path):
    root, output = tmp_path / "in", str(tmp_path / "plan")
    write(root / "a.wav", "one")
    known = hashlib.sha256(b"one").hexdigest()
    catalog = lambda: spark.createDataFrame(
        [(0, "a-1", "src::a.wav", known, "sig", True)],
        "catalog_pos long, audio_id string, source_file_identity string, source_hash string, "
        "conversion_signature string, artifact_exists boolean",
    )

    def run():
        query = start_intake(
            new_files(spark, "src", str(root)), catalog, "sig", output, str(tmp_path / "state"), hash_content=True
        )
        query.awaitTermination()
        return sorted((r.file_name, r.action) for r in spark.read.parquet(output).collect())

    assert run() == [("a.wav", "skipped")]
    write(root / "b.wav", "two")
    assert run() == [("a.wav", "skipped"), ("b.wav", "queued")]


def test_sessions_close_after_the_gap(spark, tmp_path):
    rows = spark.createDataFrame([("r", 0), ("r", 20), ("r", 100), ("s", 100), ("r", 125)], "run_id string, at long")
    rows.select("run_id", F.timestamp_seconds("at").alias("updated_at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, updated_at timestamp").parquet(str(tmp_path / "in"))
    query = (
        closed_sessions(stream, "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).select("run_id", F.unix_seconds("interrupted_at"), "updates").collect()
    assert [tuple(r) for r in found] == [("r", 50, 2)]


def test_run_folders_are_written_and_read_back(spark, tmp_path):
    work = spark.createDataFrame(
        [("run-a", f"ref-{n:04d}", f"/in/{n}.wav", f"{n}.wav", n, "s", f"{n}.wav", f"s::{n}.wav") for n in range(700, 0, -1)]
        + [("run-b", "ref-0001", "/in/é.wav", "é.wav", None, "s", "é.wav", "s::é.wav")],
        "run_id string, input_id string, path string, file_name string, size_bytes long, source_id string, relative_path string, source_file_identity string",
    )
    assert sinks.write_runs(work, str(tmp_path), "2026", {"compute_mode": "gpu", "reprocess_duplicates": False}) == 8
    request = json.loads((tmp_path / "run-a" / "request.json").read_text())
    assert [i["input_id"] for i in request["input_items"]] == [f"ref-{n:04d}" for n in range(1, 701)]
    assert (request["compute_mode"], request["reprocess_duplicates"], request["input_items"][0]["uploaded_path"]) == ("gpu", False, None)
    assert json.loads((tmp_path / "run-b" / "manifest.json").read_text())["items"] == []
    assert json.loads((tmp_path / "run-b" / "result.json").read_text())["state"] == "pending"
    runs = run_folders.read_runs(spark, [str(tmp_path)])
    rows = {r.run_id: r for r in runs.collect()}
    assert {i: (r.state, r.items_total, r.warnings, len(r["items"])) for i, r in rows.items()} == {"run-a": ("pending", 700, [], 0), "run-b": ("pending", 1, [], 0)}
    listed = run_folders.input_items(runs).filter("run_id = 'run-b'").collect()
    assert [(r.item_pos, r.original_path, r.size_bytes) for r in listed] == [(0, "/in/é.wav", 0)]


def test_source_records_by_the_first_file(spark, tmp_path):
    assert documents.read_source_info(spark, str(tmp_path)).collect() == []
    write(tmp_path / "a" / "source" / "source-record.json", {"display_name": "record"})
    write(tmp_path / "a" / "source.json", {"display_name": "source"})
    write(tmp_path / "b" / "source.json", "{broken")
    write(tmp_path / "b" / "timeline.json", {"source": {"display_name": "timeline"}})
    write(tmp_path / "c" / "timeline.json", {"source": {"display_name": "timeline", "original_path": "/in/c"}, "turns": [{}]})
    write(tmp_path / "d" / "timeline.json", {"source": "text"})
    write(tmp_path / ".e" / "source.json", {"display_name": "hidden"})
    rows = documents.read_source_info(spark, str(tmp_path)).collect()
    found = {r.media_dir.rsplit("/", 1)[1]: (r.display_name, r.original_path) for r in rows}
    assert found == {"a": ("record", None), "b": (None, None), "c": ("timeline", "/in/c"), "d": (None, None)}


def tasks_of(spark, group, action):
    """Tasks per stage of the jobs that an action starts."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages_ = [s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds]
    return [info.numTasks for info in map(tracker.getStageInfo, stages_) if info]


def test_hashes_of_many_folders_take_few_listing_tasks_and_several_hashing_tasks(spark, tmp_path):
    for k in range(100):
        write(tmp_path / "all" / f"k={k}" / "a.txt", str(k))
    before = spark.conf.get(files.LISTING)
    found = []
    listed = tasks_of(spark, "list", lambda: found.append(files.content_hashes(spark, str(tmp_path / "all"))))
    assert listed and max(listed) < 100
    assert spark.conf.get(files.LISTING) == before
    rows = found[0].withColumn("part", F.spark_partition_id()).collect()
    assert {r.source_hash for r in rows} == {hashlib.sha256(str(k).encode()).hexdigest() for k in range(100)}
    assert len({r.part for r in rows}) > 1


def test_lines_of_a_folder_are_one_file(spark, tmp_path):
    rows = [("k=1", "b"), ("k=1", "a"), ("k=2", None), ("k=1", "b"), ("k=3", "ü")]
    write_lines(spark.createDataFrame(rows, "folder string, value string"), str(tmp_path / "out"))
    found = {str(p.relative_to(tmp_path / "out")): p.read_text("utf-8") for p in (tmp_path / "out").rglob("*.txt")}
    assert found == {"k=1/part-0.txt": "a\nb\nb\n", "k=2/part-0.txt": "\n", "k=3/part-0.txt": "ü\n"}
    write_lines(spark.createDataFrame([], "folder string, value string"), str(tmp_path / "none"))
    assert files.content_hashes(spark, str(tmp_path / "none")).count() == 0


def test_discovery_of_many_folders_takes_few_listing_tasks(spark, tmp_path):
    for k in range(100):
        write(tmp_path / "all" / f"k={k}" / "a.txt", str(k))
    found = []
    roots = [{"source_id": "s", "path": str(tmp_path / "all")}]
    listed = tasks_of(spark, "discover", lambda: found.append(files.discover_files(spark, roots, ["txt"])[0]))
    assert listed and max(listed) < 100
    assert found[0].count() == 100


def test_streamed_tables_may_be_folders_of_files(spark, tmp_path):
    for name in ("documents", "events"):
        rows = spark.range(20).withColumn("part", F.col("id") % 3)
        rows.repartition(3, "part").write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "single"))
    next((tmp_path / "single").glob("*.parquet")).rename(tmp_path / "one.parquet")
    for name, count in (("documents", 20), ("one", 5)):
        stream = files.table_stream(spark, str(tmp_path), name)
        out, state = str(tmp_path / f"out-{name}"), str(tmp_path / f"state-{name}")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        query.trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(out).select("id").distinct().count() == count


def test_plan_is_streamed_from_a_folder_of_files(spark, tmp_path):
    rows = [(k, f"text {k}", "en", "web", 6) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    planned = plans.streamed_plan(spark, str(tmp_path))
    assert planned.count() == 10 and planned.filter("action = 'skipped'").count() > 0
