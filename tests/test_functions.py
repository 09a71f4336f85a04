from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnweave.functions import numbers, text, times, vocabulary


def column(spark, values, build, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_text_forms(spark):
    given = [" あ　い\u00a0ABC\u0085", "Straße", "\x1fx\x1c", ""]
    assert column(spark, given, text.comparable) == ["".join(v.split()).casefold() for v in given]
    assert column(spark, given, text.compact) == [" ".join(v.split()) for v in given]
    assert column(spark, given, text.strip) == [v.strip() for v in given]


def test_identity_and_slug(spark):
    assert column(spark, [" A\\B/c// ", None], text.identity_key) == ["a/b/c", ""]
    assert column(spark, ["  Hello (World)--x ", "---", "é", "a.b_c"], text.slug) == ["Hello-World-x", "item", "item", "a.b_c"]
    assert column(spark, ["/a/b.tar.GZ", ".bashrc", "x", "/d/n."], text.extension) == [".gz", "", "", ""]
    assert column(spark, ["/a/b.tar.GZ", ".bashrc", "x"], text.stem) == ["b.tar", ".bashrc", "x"]
    assert column(spark, ["a, b\n\na,c"], text.id_list) == [["a", "b", "c"]]


def test_normal_extensions():
    assert text.normalize_extensions([" MP3", ".mp3", "", "ogg"]) == [".mp3", ".ogg"]
    assert text.normalize_extensions([]) == [".mp3", ".wav", ".m4a", ".aac", ".flac"]


def test_iso_times(spark):
    given = [
        "2026-03-25T01:02:03Z", "2026-03-25 01:02:03.5+09:00", "20260325T010203-0330", "2026-03-25", "2026-02-30T00:00:00",
        "soon", "", None, "2026-03-25T23:59:59.000001",
    ]

    def moved(value):
        try:
            return (datetime.fromisoformat(value.replace("Z", "+00:00")) + timedelta(seconds=1.25)).isoformat()
        except (AttributeError, ValueError):
            return None

    assert column(spark, given, lambda c: times.absolute_at(c, F.lit(1.25))) == [moved(v) for v in given]
    utc = column(spark, ["2026-01-01T00:30:00+09:00", "2026-01-01"], lambda c: times.iso_text(times.utc_datetime(c)))
    assert utc == ["2025-12-31T15:30:00", "2026-01-01T00:00:00"]


def test_times_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = column(spark, ["2026-03-08T02:30:00"], lambda c: times.absolute_at(c, F.lit(0.0)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == ["2026-03-08T02:30:00"]


def test_file_name_times(spark):
    given = [
        "/a/2024-05-06 07-08-09 x.mp3", "/a/x_2024-05-06_07-08-09.mp3", "/a/20240506-070809.wav", "/a/99999999999999 20240506070809.wav",
        "/a/talk.wav",
    ]
    want = "2024-05-06T07:08:09+09:00"
    assert column(spark, given, times.file_name_recorded_at) == [want] * 4 + [None]
    source = spark.range(1).select(times.recorded_at(F.lit(" 2026-01-01T00:00:00Z "), F.lit(given[0])).alias("r")).head().r
    assert tuple(source) == ("2026-01-01T00:00:00Z", "metadata", "UTC")


def test_numbers(spark):
    assert column(spark, ["N/A", "", " 12 ", "1.5", "x"], numbers.optional_int) == [None, None, 12, None, None]
    assert column(spark, ["0/0", "1/3", "30000/1001", "2.5", "a/b", "1/0"], numbers.optional_ratio) == [
        None, 0.333, 29.97, 2.5, None, None
    ]
    rates = [None, 0, 16000, 24000, 48000, 96000]
    assert column(spark, rates, numbers.sample_rate_bucket, "v int") == [
        "unknown", "unknown", "narrowband", "voice", "standard", "high"
    ]


def test_stage_expectations(spark):
    seconds = lambda stage, mode: column(
        spark, [0.0, 100.0, 1e6], lambda c: numbers.expected_stage_seconds(F.lit(stage), c, F.lit(mode)), "v double"
    )
    assert seconds("transcribe_audio", "cpu") == [4.0, 90.0, 720.0]
    assert seconds("transcribe_audio", "gpu") == [4.0, 18.0, 180.0]
    assert seconds("diarize_audio", "gpu") == [2.0, 10.0, 120.0]
    assert seconds("unheard_of", "cpu") == [5.0, 5.0, 5.0]


def test_vocabulary(spark):
    assert column(spark, ["Pending", "cancelled", "", None, "Odd"], vocabulary.job_state) == [
        "queued", "canceled", "unknown", "unknown", "odd"
    ]
    assert column(spark, ["", None, "LOOSE"], vocabulary.silence_profile_ms) == [500, 500, 1000]
    with pytest.raises(Exception, match="Unsupported VAD profile"):
        column(spark, ["bogus"], vocabulary.silence_profile_ms)


def test_signature_follows_the_settings(spark):
    def sign(mode, profile):
        return spark.range(1).select(vocabulary.generation_signature("p", F.lit(mode), F.lit(profile)).alias("s")).head().s

    assert sign("cpu", None) == sign("CPU", "default") == sign("other", "")
    assert len({sign("cpu", None), sign("gpu", None), sign("cpu", "loose"), sign("cpu", "strict")}) == 4
