import pytest
from pyspark.sql import functions as F

from turnweave.operators import catalog, items, listing, ordering, paths, refresh

CATALOG = (
    "catalog_pos long, audio_id string, source_file_identity string, source_hash string, "
    "conversion_signature string, artifact_exists boolean"
)
FILES = "path string, source_file_identity string, source_hash string, size_bytes long"


def files(spark, *rows):
    return spark.createDataFrame(list(rows), FILES)


def stored(spark, *rows):
    return spark.createDataFrame(list(rows), CATALOG)


def actions(plan):
    return {r.source_file_identity: (r.action, r.reason) for r in plan.collect()}


def test_unchanged_reused_renamed_and_stale(spark):
    rows = stored(
        spark,
        (0, "a", "SRC::a.wav", "H1", "sig", True),
        (1, "b", "src::b.wav", "h2", "other", True),
        (2, "old", "src::old.wav", "h3", "sig", True),
        (3, "gone", "src::gone.wav", "h4", "sig", False),
    )
    found = files(
        spark, ("a.wav", "src::a.wav", "h1", 1), ("b.wav", "src::b.wav", "h2", 1),
        ("new.wav", "src::new.wav", "h3", 1), ("gone.wav", "src::gone.wav", "h4", 1),
    )
    assert actions(refresh.plan_refresh(found, rows, "sig")) == {
        "src::a.wav": ("skipped", "unchanged"),
        "src::b.wav": ("skipped", "existing_artifact_reused"),
        "src::new.wav": ("queued", None),
        "src::gone.wav": ("queued", None),
    }
    again = actions(refresh.plan_refresh(found, rows, "sig", reprocess=True))
    assert {action for action, _ in again.values()} == {"queued"}


def test_exact_is_last_wins_and_fallback_first_wins(spark):
    rows = stored(
        spark, (0, "first", "s::a", "h", "x", True), (1, "second", "s::a", "h", "x", True),
        (2, "third", "s::a", "h", "y", True),
    )
    found = catalog.look_up(files(spark, ("a", "s::a", "h", 1)), rows, "X").head()
    assert (found.exact.audio_id, found.reusable.audio_id) == ("second", "first")


def test_batch_limit_takes_the_smallest(spark, monkeypatch):
    found = files(spark, *[(f"{n}.wav", f"s::{n}", f"h{n}", size) for n, size in enumerate((500, 5, 50))])
    empty = stored(spark)
    planned = actions(refresh.plan_refresh(found, empty, "sig", limit=1))
    assert planned["s::1"] == ("queued", None)
    assert planned["s::0"] == planned["s::2"] == ("deferred", "batch_limit")
    assert actions(refresh.plan_refresh(found, empty, "sig", limit=1)) == planned
    five = files(spark, *[(f"{n}.wav", f"s::{n}", f"h{n}", 10) for n in range(5)])
    summary = refresh.refresh_summary(refresh.plan_refresh(five, empty, "sig", limit=2)).head()
    assert (summary.selected_count, summary.queued_count, summary.deferred_count) == (5, 2, 3)
    with pytest.raises(ValueError):
        refresh.plan_refresh(found, empty, "sig", limit=0)


def test_work_list_is_numbered_in_path_order(spark):
    found = files(spark, ("B.wav", "s::b", "1", 1), ("a.wav", "s::a", "2", 1), ("c.wav", "s::c", "3", 1))
    rows = refresh.work_list(refresh.plan_refresh(found, stored(spark), "sig")).collect()
    assert {r.input_id: r.path for r in rows} == {"ref-0001": "a.wav", "ref-0002": "B.wav", "ref-0003": "c.wav"}


def test_ranked_numbers_every_row_once(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    ranks = {r.v: r.rank for r in ordering.ranked(rows, ["v"]).collect()}
    assert ranks == {v: v + 1 for v in range(1000)}


def test_pages(spark, monkeypatch):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "v string")
    order = [F.desc("v")]
    assert [r.v for r in ordering.page_rows(rows, order, 1, 2).collect()] == ["c", "b"]
    assert [r.v for r in ordering.page_rows(rows, order, 2, 2).collect()] == ["a"]
    assert [r.v for r in ordering.page_rows(rows, order).collect()] == ["c", "b", "a"]
    one = ordering.page_summary(rows, 1, 2).head()
    assert (one.range_start, one.range_end, one.has_next, one.has_previous, one.total_pages) == (1, 2, True, False, 2)
    two = ordering.page_summary(rows, 2, 2).head()
    assert (two.returned_rows, two.has_next, two.has_previous) == (1, False, True)
    whole = ordering.page_summary(rows).head()
    assert (whole.mode, whole.page, whole.range_end) == ("all", None, 3)
    beyond = ordering.page_summary(rows, 9, 2).head()
    assert (beyond.returned_rows, beyond.range_start, beyond.range_end) == (0, 0, 0)
    assert [r.v for r in ordering.page_rows(rows, order, 1, 2).collect()] == ["c", "b"]
    with pytest.raises(ValueError):
        ordering.page_rows(rows, order, 0, 2)


def test_file_status_precedence(spark):
    rows = stored(
        spark, (0, "a", "s::a", "h", "sig", True), (1, "b", "s::b", "h", "old", True), (2, "c", "s::c", "x", "sig", True),
        (3, "e", "s::e", "h", "sig", False),
    )
    found = files(spark, *[(name, f"s::{name}", "h", 1) for name in "abcdefg"])
    manifest = spark.createDataFrame(
        [
            ("s::a", "failed", "failed", "run-1", 0), ("s::d", "failed", "failed", "run-1", 1),
            ("s::f", "running", "queued", "run-1", 2), ("s::f", "pending", "queued", "run-2", 0),
            ("s::g", "completed", "failed", "run-1", 3),
        ],
        "source_file_identity string, run_state string, status string, run_name string, item_pos int",
    ).withColumn("run_id", F.col("run_name")).withColumn("audio_id", F.lit("m"))
    status = {r.path: r.status for r in catalog.file_status(found, rows, "sig", manifest).collect()}
    assert status == {
        "a": "completed", "b": "settings_changed", "c": "changed", "d": "failed", "e": "unprocessed",
        "f": "processing", "g": "unprocessed",
    }
    unknown = found.withColumn("source_hash", F.lit(None).cast("string"))
    bare = {r.path: r.status for r in catalog.file_status(unknown, rows, "sig").collect()}
    assert (bare["a"], bare["b"], bare["c"], bare["d"]) == ("completed", "changed", "completed", "unprocessed")


def test_union_keeps_artifacts_first(spark):
    schema = "catalog_pos long, audio_id string, artifact_path string"
    scanned = spark.createDataFrame([(0, "a", "/out/A/timeline.json")], schema)
    cached = spark.createDataFrame(
        [(0, "dup", "/OUT/a/timeline.json"), (1, "b", "/out/b"), (2, "b2", "/out/B"), (3, "none", None)], schema
    )
    rows = catalog.union_catalog(scanned, cached).orderBy("catalog_order").collect()
    assert [r.audio_id for r in rows] == ["a", "b"]


def test_removal(spark):
    rows = spark.createDataFrame(
        [("Item-1", "/out/one"), ("item-2", "/out/../etc"), ("item-3", "/out/three")], "item_id string, item_dir string"
    )
    requested = items.requested_ids(spark, ["item-1", "ITEM-2", " ", "nope"])
    planned = {r.item_id: r for r in items.plan_removal(rows, requested, "/out", ()).collect()}
    assert set(planned) == {"Item-1", "item-2"}
    assert planned["Item-1"].remove_folder and not planned["item-2"].folder_safe
    assert [r.requested_id for r in items.missing_ids(requested, rows).collect()] == ["nope"]
    assert [r.item_id for r in items.remaining_items(rows, requested).collect()] == ["item-3"]
    dry = items.removal_summary(items.plan_removal(rows, requested, "/out", (), dry_run=True)).head()
    assert (dry.matched_count, dry.catalog_rows_removed, dry.media_dirs_removed, dry.unsafe_media_dirs) == (2, 2, 0, 1)
    with pytest.raises(ValueError):
        items.requested_ids(spark, ["  "])


def test_prune_and_old_names(spark):
    rows = spark.createDataFrame(
        [("Run-1", "/r/1"), ("run-2", "/r/one/"), (None, None), ("run-3", "/r/3")], "run_id string, run_dir string"
    )
    assert [r.run_id for r in catalog.prune_run(rows, "run-1", "/r/one").collect()] == [None, "run-3"]
    old = spark.createDataFrame([("h", None, "new"), ("h2", "x", None)], "sha256 string, media_id string, audio_id string")
    assert [tuple(r) for r in catalog.canonical_columns(old).select("source_hash", "audio_id").collect()] == [
        ("h", "new"), ("h2", "x")
    ]


def test_item_ids(spark):
    rows = spark.createDataFrame(
        [(" id ", "s::A/", "H", "Sig", "r"), (None, "s::A/", "H", "Sig", "r"), (None, None, None, None, None)],
        "audio_id string, source_file_identity string, source_hash string, conversion_signature string, run_id string",
    )
    found = [r.item_id for r in catalog.with_item_ids(rows).collect()]
    digest = spark.range(1).select(F.left(F.sha2(F.lit("s::a::h::sig::r"), 256), F.lit(12)).alias("d")).head().d
    assert found[:2] == ["id", f"item-{digest}"] and found[2].startswith("item-")


def test_path_mappings(spark):
    mappings = spark.createDataFrame(
        [("C:\\Audio", "/mnt/audio"), ("C:\\Audio\\Deep\\", "/deep"), ("/home/x", "/x")], "host string, container string"
    )
    given = spark.createDataFrame(
        [("c:/audio/One.wav",), ("C:\\AUDIO\\Deep\\a\\b.wav",), ("/home/x",), ("/home/xy",)], "path string"
    )
    found = {r.path: r.mapped_path for r in paths.remap_paths(given, mappings).collect()}
    assert found["C:\\AUDIO\\Deep\\a\\b.wav"].lower() == "/deep/a/b.wav"
    assert found["c:/audio/One.wav"].lower() == "/mnt/audio/one.wav"
    assert (found["/home/x"], found["/home/xy"]) == ("/x", None)
    inside = spark.createDataFrame([("/deep/A/b.wav",), ("/other",)], "path string")
    back = {r.path: r.mapped_path for r in paths.remap_paths(inside, mappings, reverse=True).collect()}
    assert back == {"/deep/A/b.wav": "C:\\Audio\\Deep\\A\\b.wav", "/other": "/other"}
    assert spark.range(1).select(paths.drive_to_mount(F.lit("D:\\a\\b")).alias("p")).head().p == "/mnt/d/a/b"


def test_preflight(spark):
    found = files(spark, ("a", "s::a", "h", 1), ("b", "s::b", "h", 1), ("c", "s::c", "h", 1)).withColumn(
        "readable", F.col("path") != "a"
    ).withColumn("duration_seconds", F.when(F.col("path") == "b", 1.99).otherwise(2.0))
    rows = stored(spark, (0, "c-1", "s::c", "h", "sig", True))
    by_path = {r.path: r for r in refresh.classify_inputs(found, rows, "sig").collect()}
    assert [by_path[p].status for p in "abc"] == ["skipped_invalid", "skipped_too_short", "queued"]
    assert (by_path["c"].duplicate_status, by_path["c"].duplicate_of) == ("duplicate_skip", "c-1")
    warnings = refresh.skip_counts(refresh.classify_inputs(found, rows, "sig")).orderBy("status").collect()
    assert [w.warning for w in warnings] == [
        "preflight: skipped 1 invalid audio file(s).", "preflight: skipped 1 audio file(s) shorter than 2.0s."
    ]


def test_collect_inputs(spark):
    offered = spark.createDataFrame(
        [("local_file", "local", "/A.wav", 0), ("local_directory", "/", "/a.WAV", 1), ("mounted_root", "r", "/b.txt", 2),
         ("mounted_root", "r", "/c.mp3", 3)],
        "source_kind string, source_id string, path string, offer_pos long",
    )
    rows = refresh.collect_inputs(offered).orderBy("offer_pos").collect()
    assert [(r.input_id, r.path) for r in rows] == [("loca-0001", "/A.wav"), ("moun-0002", "/c.mp3")]
    existing = spark.createDataFrame([("/A.wav",)], "path string")
    with pytest.raises(Exception, match="Input file was not found"):
        refresh.require_found(offered, existing).collect()


def test_limit_counts_rows_not_identities(spark):
    none = stored(spark, (0, "z", "s::z", "h", "sig", True))
    found = files(spark, ("b", "s::x", "1", 5), ("a", "s::x", "2", 5), ("c", None, "3", 1), ("d", "s::d", "4", 9))
    for limit in (1, 2, 3):
        plan = refresh.plan_refresh(found, none, "sig", limit=limit)
        rows = {r.path: r.action for r in plan.collect()}
        assert [p for p in "cabd" if rows[p] == "queued"] == list("cabd")[:limit] and len(rows) == 4
    numbered = refresh.work_list(refresh.plan_refresh(found, none, "sig", limit=3), limited=True).collect()
    assert {r.path: r.input_id for r in numbered} == {"c": "ref-0001", "a": "ref-0002", "b": "ref-0003"}


def test_blank_runs_prune_nothing(spark):
    rows = spark.createDataFrame([("r1", ""), ("", "/runs/1"), (None, None)], "run_id string, run_dir string")
    assert catalog.prune_run(rows, "", "").count() == 3
    blank = spark.createDataFrame([("", " "), (None, "")], "run_id string, run_dir string")
    assert catalog.prune_runs(rows, blank).count() == 3


def test_runs_that_decide_bring_their_duration(spark):
    rows = stored(spark, (0, "a", "s::a", "h", "sig", True)).withColumn("duration_seconds", F.lit(5.0))
    manifest = spark.createDataFrame(
        [("s::a", "running", "queued", "run-1", 0, "run-1", "m", 77.0)],
        "source_file_identity string, run_state string, status string, run_name string, item_pos int, run_id string, "
        "audio_id string, duration_seconds double",
    )
    found = catalog.file_status(files(spark, ("a", "s::a", "h", 1)), rows, "sig", manifest).collect()
    assert [(r.status, r.duration_sec) for r in found] == [("processing", 77.0)]


def test_removal_falls_back_to_the_run_folder(spark):
    rows = spark.createDataFrame(
        [("i1", None, "/out/run-1/", "m1"), ("i2", " ", "/out/.data", "m2"), ("i3", "/out/x", "/out/run-1", "m3")],
        "item_id string, item_dir string, run_dir string, audio_id string",
    )
    requested = items.requested_ids(spark, ["i1", "i2", "i3"])
    planned = {r.item_id: r for r in items.plan_removal(rows, requested, "/out", (".data",)).collect()}
    assert planned["i1"].item_dir == "/out/run-1/media/m1" and planned["i1"].remove_folder
    assert planned["i2"].item_dir == "/out/.data/media/m2" and not planned["i2"].folder_safe
    assert planned["i3"].item_dir == "/out/x"


def test_list_of_items(spark):
    rows = spark.createDataFrame(
        [(0, "a", "r1", "/runs/r1", "/out/a", None, 2.5, "c0", None), (1, "b", "r1", "/runs/r1", None, "/out/gone.json", 0.0, "c1", "u1"),
         (2, "c", None, "/out/r2", None, None, None, "", None), (3, "d", None, None, "/else/d", "/else/d/t.json", 1.0, "c3", None)],
        "catalog_pos long, audio_id string, run_id string, run_dir string, item_dir string, artifact_path string, "
        "duration_seconds double, created_at string, updated_at string",
    ).selectExpr("*", "concat('s::x/', audio_id, '.wav') as source_file_identity", "'h' as source_hash", "'sig' as conversion_signature",
                 "'s' as source_id", "if(catalog_pos = 0, 'x/a.wav', null) as source_relative_path")
    existing = spark.createDataFrame(
        [("/out/a/timeline.json", "t1"), ("/out/a/convert_info.json", "t2"), ("/out/r2/media/c/timeline.json", "t3"), ("/else/d/t.json", "t4")],
        "path string, modified_at string",
    )
    summaries = spark.createDataFrame([("/out/a/timeline.json", 7, 2)], "artifact_path string, turn_count long, speaker_count long")
    info = spark.createDataFrame([("/out/r2/media/c", " Talk c ", None), ("/out/a", "", "/in/o.wav")], "media_dir string, display_name string, original_path string")
    found = {r["media_id"]: r for r in listing.list_items(rows, existing, "/out", summaries, info).collect()}
    shown = lambda i: tuple(found[i][c] for c in ("status", "artifact_path", "media_dir", "updated_at", "source_file_name", "turn_count", "duration_sec"))
    assert shown("a") == ("available", "/out/a/timeline.json", "/out/a", "t2", "a.wav", 7, 2.5)
    assert shown("b") == ("missing_artifact", "", "", "u1", "b", 0, None)
    assert shown("c") == ("available", "/out/r2/media/c/timeline.json", "/out/r2/media/c", "t3", "Talk c", 0, None)
    assert shown("d") == ("available", "/else/d/t.json", "", "t4", "d", 0, 1.0)
    assert len(found["a"].asDict()) == 19


def test_list_of_files(spark):
    files = spark.createDataFrame(
        [("/m/x/a b.wav", "S1", "x/a b.wav", 5, "2026", "completed", "m1", "r", None), ("/m/c.wav", "", "c.wav", 1, "2025", "unprocessed", "", "", 3.0)],
        "path string, source_id string, relative_path string, size_bytes long, modified_at string, status string, media_id string, run_id string, duration_sec double",
    ).withColumn("source_file_identity", F.concat("source_id", F.lit("::"), "relative_path"))
    roots = spark.createDataFrame([("s1", "E:\\Rec\\")], "source_id string, root_path string")
    summaries = spark.createDataFrame([("m1", 0, 0)], "media_id string, turn_count long, speaker_count long")
    probes = spark.createDataFrame([("/m/x/a b.wav", 1.23456), ("/m/c.wav", 9.0)], "path string, probe_seconds double")
    one, other = listing.list_files(files, roots, summaries, probes).orderBy(F.desc("modified_at")).collect()
    assert (one.display_path, one.directory, one.file_name, one.duration_sec) == ("E:\\Rec\\x\\a b.wav", "x", "a b.wav", 1.235)
    assert (one.has_timeline, one.run_id, one.has_audio) == (True, "r", False)
    assert (other.source_display_name, other.display_path, other.directory, other.duration_sec, other.has_timeline) == ("Audio", "/m/c.wav", "", 3.0, False)
