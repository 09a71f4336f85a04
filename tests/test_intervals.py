import random

import pytest
from pyspark.sql import functions as F

import brute
from turnweave.operators import intervals, running

pytestmark = pytest.mark.usefixtures("small_bins")
RANDOM = random.Random(7)
MEDIA = range(25)


def grouped(df, *columns):
    rows = df.select("media_id", *columns).collect()
    return {key: sorted(values) for key, values in brute.by_key(rows).items()}


def expected(groups, compute):
    return {key: sorted(compute(rows)) for key, rows in groups.items() if compute(rows)}


def test_pair_intervals(spark):
    rows = [(m, n, RANDOM.choice("SE"), n * 2 + m) for m in MEDIA for n in range(RANDOM.randint(1, 40))]
    df = spark.createDataFrame(rows, "media_id int, line_no long, kind string, at long")
    found = grouped(intervals.pair_intervals(df), "start", "end")
    assert found == expected(brute.by_key(rows), brute.paired)


def _silences(reversed_share=0.0):
    rows = []
    for media in MEDIA:
        for _ in range(RANDOM.randint(1, 30)):
            start = RANDOM.randint(0, 80)
            length = RANDOM.randint(0, 5)
            if RANDOM.random() < reversed_share:
                length = -RANDOM.randint(1, 6)
            rows.append((media, start, start + length))
    return rows


def test_merge_intervals(spark):
    rows = _silences()
    df = spark.createDataFrame(rows, "media_id int, start long, end long")
    assert grouped(intervals.merge_intervals(df), "start", "end") == expected(brute.by_key(rows), brute.merged)


@pytest.mark.parametrize("reversed_share", [0.0, 0.3])
def test_speech_ranges(spark, reversed_share):
    rows = _silences(reversed_share)
    lengths = {media: RANDOM.choice([0, 20, 60, 90]) for media in [*MEDIA, 99]}
    silences = spark.createDataFrame(
        [(m, float(s), float(e)) for m, s, e in rows], "media_id int, start double, end double"
    )
    durations = spark.createDataFrame([(m, float(d)) for m, d in lengths.items()], "media_id int, duration double")
    groups = brute.by_key([(m, float(s), float(e)) for m, s, e in rows])
    want = {
        media: sorted(brute.kept(groups.get(media, []), float(length), 1.0, 0.25))
        for media, length in lengths.items()
    }
    found = grouped(intervals.speech_ranges(silences, durations), "start", "end")
    assert found == {media: ranges for media, ranges in want.items() if ranges}


def test_trimmed_axis(spark):
    rows = [(m, s * 5, s * 5 + RANDOM.randint(1, 4)) for m in MEDIA for s in range(RANDOM.randint(1, 20))]
    df = spark.createDataFrame(rows, "media_id int, start long, end long")
    found = grouped(intervals.trimmed_axis(df), "start", "trimmed_start", "trimmed_end")
    for media, spans in brute.by_key(rows).items():
        cursor, want = 0, []
        for start, end in sorted(spans):
            want.append((start, cursor, cursor + end - start))
            cursor += end - start
        assert found[media] == want


def _segments_and_evidence():
    segments, turns, ranges = [], [], []
    for media in MEDIA:
        for n in range(RANDOM.randint(1, 20)):
            start = RANDOM.randint(0, 40)
            end = RANDOM.choice([start, start + RANDOM.randint(1, 9), max(0, start - 3), None, 0])
            segments.append((media, n, start, end))
        for n in range(RANDOM.randint(0, 15)):
            start = RANDOM.randint(0, 40)
            turns.append((media, n, start, start + RANDOM.choice([0, 1, 4, 12]), RANDOM.choice(["A", "B", " ", None])))
        turns += [(media, 100 + n, 3, 9, "copy") for n in range(RANDOM.randint(0, 2))]
        for _ in range(RANDOM.randint(0, 8)):
            start = RANDOM.randint(0, 40)
            ranges.append((media, start, start + RANDOM.randint(0, 9)))
    return segments, turns, ranges


def test_speakers_and_overlap(spark):
    segments, turns, ranges = _segments_and_evidence()
    seg = spark.createDataFrame(segments, "media_id int, seg_index int, start long, end long")
    turn = spark.createDataFrame(turns, "media_id int, turn_pos int, start long, end long, speaker string")
    span = spark.createDataFrame(ranges, "media_id int, start long, end long")
    labels = {(r.media_id, r.seg_index): r.best_speaker for r in intervals.assign_speakers(seg, turn).collect()}
    sums = {(r.media_id, r.seg_index): r.speech_overlap for r in intervals.speech_overlap(seg, span).collect()}
    turn_groups, range_groups = brute.by_key(turns), brute.by_key(ranges)
    for media, n, start, end in segments:
        assert labels[media, n] == brute.speaker((start, end), turn_groups[media]), (media, n)
        assert sums[media, n] == brute.total_overlap((start, end), range_groups[media]), (media, n)


def test_best_speaker_example(spark):
    seg = spark.createDataFrame([("a", 1, 1.0, 4.0)], "media_id string, seg_index int, start double, end double")
    turn = spark.createDataFrame(
        [("a", 0, 0.0, 1.5, "SPEAKER_00"), ("a", 1, 1.5, 5.0, "SPEAKER_01")],
        "media_id string, turn_pos int, start double, end double, speaker string",
    )
    assert intervals.assign_speakers(seg, turn).head().best_speaker == "SPEAKER_01"


def test_run_lengths_and_repeats(spark):
    rows = [
        (m, n * 2, RANDOM.choice(["x", "x", "y", None])) for m in MEDIA for n in range(RANDOM.randint(1, 40))
    ] + [(50, n, "same") for n in range(30)]
    df = spark.createDataFrame(rows, "media_id int, pos int, value string")
    found = grouped(running.run_lengths(df, "media_id", "pos", "value"), "pos", "run_length")
    counts = grouped(running.repeat_counts(df, "media_id", "pos", "value"), "pos", "repeats")
    for media, values in brute.by_key(rows).items():
        values.sort()
        texts = [text for _, text in values]
        assert [n for _, n in found[media]] == brute.runs(texts)
        assert [n for _, n in counts[media]] == [texts.count(t) if t is not None else 0 for t in texts]


def test_running_statistics(spark):
    rows = [(m, n, RANDOM.randint(-9, 9)) for m in MEDIA for n in range(RANDOM.randint(1, 30))]
    df = spark.createDataFrame(rows, "media_id int, pos int, v int").withColumn(
        "_bin", running.position_bin(F.col("pos"))
    )
    stats = running.running(
        df, ["media_id"], "_bin", ["pos"],
        total=running.Running("sum", F.col("v"), inclusive=True),
        before=running.Running("sum", F.col("v")),
        top=running.Running("max", F.col("v")),
        low=running.Running("min", F.col("v"), inclusive=True),
        previous=running.Running("last", F.col("v")),
    )
    found = grouped(stats, "pos", "total", "before", "top", "low", "previous")
    for media, values in brute.by_key(rows).items():
        values = [v for _, v in sorted(values)]
        for n, row in enumerate(found[media]):
            head = values[:n]
            assert row[1:] == (
                sum(values[: n + 1]), sum(head), max(head, default=None), min(values[: n + 1]),
                head[-1] if head else None,
            )


def test_quiet_intervals(spark):
    rows = [(m, n, n * 3 + m, RANDOM.choice([1.0, 2.0, 9.0])) for m in MEDIA for n in range(RANDOM.randint(1, 40))]
    df = spark.createDataFrame(rows, "media_id int, pos int, at long, level double")
    found = grouped(intervals.quiet_intervals(df, below=5.0, at_least=6), "start", "end")
    assert found == expected(brute.by_key(rows), lambda levels: brute.quiet(levels, 5.0, 6))


def test_chunks(spark):
    durations = spark.createDataFrame([("a", 1500.0), ("b", 600.0), ("c", 10.0)], "media_id string, duration double")
    plan = intervals.chunk_plan(durations)
    rows = [tuple(r) for r in plan.orderBy("media_id", "chunk_no").collect()]
    assert rows == [
        ("a", 0, 0.0, 600.0), ("a", 1, 600.0, 600.0), ("a", 2, 1200.0, 300.0), ("b", 0, 0.0, 600.0), ("c", 0, 0.0, 10.0)
    ]
    local = spark.createDataFrame(
        [("a", 1, 1, 2.0, 3.0, " b  c "), ("a", 0, 1, 1.0, 2.0, "a"), ("a", 0, 2, 2.0, 3.0, " 　"),
         ("a", 2, 1, 0.0, 1.0, "d")],
        "media_id string, chunk_no int, local_index int, start double, end double, text string",
    )
    found = intervals.stitch_chunks(local, plan).orderBy("seg_index").collect()
    assert [(r.seg_index, r.start, r.end, r.text) for r in found] == [
        (1, 1.0, 2.0, "a"), (2, 602.0, 603.0, "b c"), (3, 1200.0, 1201.0, "d")
    ]
    spoken = spark.createDataFrame([("a", 1, "en"), ("a", 0, "ja")], "media_id string, chunk_no int, language string")
    assert intervals.first_chunk_language(spoken).head().language == "ja"


def test_one_recording_is_spread_over_many_groups(spark):
    """A recording that holds most rows is never sorted as one group: the window runs per (recording, bin)."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("media_id"),
        F.col("id").alias("pos"),
        (F.col("id") % 5).cast("string").alias("value"),
    )
    plan = running.run_lengths(rows, "media_id", "pos", "value")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_bin" in line for line in windows if "value" in line)
