import random

from pyspark.sql import functions as F

from turnweave.operators import forecast, runs

HISTORY = (
    "sample_pos long, compute_mode string, audio_codec string, container_name string, audio_channels int, "
    "audio_sample_rate int, bitrate int, duration_seconds double, wall_seconds double, status string"
)
WEIGHTS = {"audio_codec": 3.0, "container_name": 1.0, "audio_channels": 2.0, "rate": 1.5, "bits": 1.5}


def rate_class(value):
    limits = ((0, "unknown"), (16_000, "narrowband"), (24_000, "voice"), (48_000, "standard"))
    return next((name for limit, name in limits if (value or 0) <= limit), "high")


def bitrate_class(value):
    limits = ((0, "unknown"), (96_000, "low"), (192_000, "standard"), (320_000, "high"))
    return next((name for limit, name in limits if (value or 0) <= limit), "lossless")


def features(row):
    return {**row, "rate": rate_class(row["audio_sample_rate"]), "bits": bitrate_class(row["bitrate"])}


def best_samples(item, history):
    """Every sample scored against the item, best first, ties by position."""
    item = features(item)
    scored = []
    for sample in map(features, history):
        if sample["compute_mode"] == item["compute_mode"]:
            score = 1.0 + sum(w for name, w in WEIGHTS.items() if item[name] and item[name] == sample[name])
            scored.append((-score, sample["sample_pos"]))
    return sorted(scored)[:12]


def test_nearest_samples_match_full_comparison(spark):
    choose = random.Random(3).choice
    names = HISTORY.replace(",", "").split()[::2]
    rows = [
        (n, choose(["cpu", "cpu", "gpu"]), choose(["aac", "mp3", None]), choose(["mov", "wav", ""]),
         choose([0, 1, 2, None]), choose([0, 8000, 24000, 96000]), choose([0, 90_000, 400_000]), 5.0, 9.0, "completed")
        for n in range(300)
    ]
    history = spark.createDataFrame(rows, HISTORY)
    listed = [dict(zip(names, row)) for row in rows]
    for row in listed:
        row["container_name"] = row["container_name"] or None
    found = {}
    keyed = forecast.with_features(history).withColumn("combination", F.struct("f_mode", *forecast.FEATURE_COLUMNS))
    near = forecast.nearest_samples(history, history)
    combos = {}
    for r in near.collect():
        combos.setdefault(tuple(r.combination), []).append((r["rank"], -r.score, r.sample_pos))
    for r in keyed.select("sample_pos", "combination").collect():
        found[r.sample_pos] = [pair[1:] for pair in sorted(combos[tuple(r.combination)])]
    for row in listed:
        assert found[row["sample_pos"]] == best_samples(row, listed)


def test_similar_history_wins(spark):
    history = spark.createDataFrame(
        [
            (0, "cpu", "pcm_s16le", "wav", 1, 16000, 64000, 4.0, 20.0, "completed"),
            (1, "cpu", "aac", "m4a", 2, 48000, 192000, 4.0, 34.0, "completed"),
            (2, "cpu", "aac", "m4a", 2, 48000, 192000, 4.0, 900.0, "failed"),
        ],
        HISTORY,
    )
    items = history.filter("sample_pos < 2").withColumn("status", F.lit("queued"))
    mono, stereo = forecast.predict_time(items, history).orderBy("sample_pos").collect()
    assert mono.total_seconds < stereo.total_seconds
    assert mono.sample_count == 2
    assert forecast.predict_time(items, history.limit(0)).head().total_seconds is None


def _one_item(spark, stages):
    history = spark.createDataFrame([(0, "cpu", "aac", "mov", 1, 8000, 64000, 5.0, 10.0, "completed")], HISTORY)
    if stages:
        entries = [part for name, value in stages.items() for part in (F.lit(name), F.lit(value))]
        history = history.withColumn("stage_seconds", F.create_map(*entries))
    items = history.drop("stage_seconds").withColumn("status", F.lit("queued"))
    return items, history


def _remaining(spark, items, history, **current):
    predicted = (
        forecast.predict_time(items, history)
        .withColumn("run_id", F.lit("r"))
        .withColumn("item_pos", F.col("sample_pos"))
        .withColumn("duplicate_status", F.lit("new"))
    )
    row = {"run_id": "r", "current_item_pos": 0, "current_stage": None, "current_stage_elapsed_sec": 0.0,
           "current_item_elapsed_sec": 0.0, "legacy_remaining_sec": None, **current}
    schema = (
        "run_id string, current_item_pos long, current_stage string, current_stage_elapsed_sec double, "
        "current_item_elapsed_sec double, legacy_remaining_sec double"
    )
    now = spark.createDataFrame([tuple(row.values())], schema)
    return forecast.remaining_time(predicted, now, include_export=current.get("legacy_remaining_sec") is not None)


def test_current_stage_and_blend(spark):
    stages = dict(zip(forecast.STAGES, (1.0, 1.0, 3.0, 4.0, 1.0)))
    items, history = _one_item(spark, stages)
    left = _remaining(spark, items, history, current_stage="transcribe_audio", current_stage_elapsed_sec=1.0).head()
    assert left.estimated_remaining_sec == 4.0
    both = items.unionByName(items.withColumn("sample_pos", F.lit(1).cast("long")))
    blended = _remaining(spark, both, history, current_item_elapsed_sec=3.0, legacy_remaining_sec=40.0).head()
    assert 12 < blended.estimated_remaining_sec < 40


def test_run_views(spark):
    rows = spark.createDataFrame(
        [
            ("r1", "run-1", "/r/1", "pending", "queued", None, 0.0, 1, 1, 1, 5, None, None, None),
            ("r2", "run-2", "/r/2", "running", "x", "m", 150.0, 0, 0, 0, 0, 10, 5, 10),
            ("r3", "run-3", "/r/3", "completed_with_errors", "x", "bad", None, 2, 0, 1, 3, None, None, 69),
            ("r4", "run-4", "/r/4", "running", "x", "m", 1.0, 0, 0, 0, 0, 80, 5, 10),
        ],
        "run_id string, run_name string, run_dir string, state string, current_stage string, message string, "
        "progress_percent double, items_done long, items_skipped long, items_failed long, items_total long, "
        "updated_at long, started_at long, locked_at long",
    )
    view = {r.job_id: r for r in runs.job_view(rows).collect()}
    assert (view["r1"].state, view["r1"].current, view["r1"].percent) == ("queued", 3, 0.0)
    assert (view["r2"].percent, view["r2"].error) == (100.0, None)
    assert (view["r3"].percent, view["r3"].error) == (100.0, "bad")
    stale = {r.run_id: (r.stale, r.state_now) for r in runs.classify_stale(rows, F.lit(100)).collect()}
    assert stale == {
        "r1": (False, "pending"), "r2": (True, "interrupted"), "r3": (True, "completed_with_errors"),
        "r4": (False, "running"),
    }
    assert runs.active_run(rows).head().run_id == "r4"


def test_stage_durations_add_up(spark):
    events = spark.createDataFrame(
        [("i", 0, 0, "a"), ("i", 1, 5, "b"), ("i", 2, 7, "a"), ("i", 3, 10, "a")],
        "item_id string, event_pos int, at long, stage string",
    )
    ends = spark.createDataFrame([("i", 12)], "item_id string, ended_at long")
    found = {r.stage: r.elapsed for r in runs.stage_durations(events, ends).collect()}
    assert found == {"a": 10, "b": 2}


def test_stage_average_covers_all_completed_items(spark):
    items = spark.createDataFrame(
        [("r", "completed", {"a": 3.0, "b": -1.0}), ("r", "completed", {}), ("r", "failed", {"a": 9.0})],
        "run_id string, status string, stage_elapsed_seconds map<string,double>",
    )
    found = {r.stage: tuple(r)[2:] for r in runs.stage_performance(items).collect()}
    assert found == {"a": (3.0, 1.5, 3.0), "b": (0.0, 0.0, 0.0)}
