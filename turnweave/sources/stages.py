"""Output files of the diarization and transcription tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnweave.functions.numbers import optional_double
from turnweave.functions.text import compact

TURN_SCHEMA = (
    "backend string, model_id string, status string, warning_count int, warnings array<string>, turn_count bigint, "
    "turns array<struct<start:double, end:double, speaker:string>>"
)
SEGMENT_SCHEMA = (
    "backend_name string, model_id string, status string, device string, compute_type string, language string, "
    "language_probability double, duration double, warnings array<string>, "
    "segments array<struct<index:bigint, start:double, end:double, text:string, avg_logprob:string, "
    "no_speech_probability:string>>"
)


def _folder_name() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)


def read_stage_results(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One row per result file, keyed by the name of its folder."""
    return (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .json(pattern)
        .select(F.url_decode(_folder_name()).alias("media_id"), "*")
    )


def speaker_turns(results: DataFrame) -> DataFrame:
    """Turns of diarization results with their position."""
    return results.select("media_id", F.posexplode("turns").alias("turn_pos", "_t")).select(
        "media_id", "turn_pos", "_t.start", "_t.end", "_t.speaker"
    )


def transcript_segments(results: DataFrame) -> DataFrame:
    """Segments of transcription results: compact text, empty ones dropped, list position as ``seg_index``."""
    rows = results.select("media_id", F.posexplode("segments").alias("_pos", "_s")).select(
        "media_id",
        (F.col("_pos") + 1).alias("seg_index"),
        F.coalesce("_s.start", F.lit(0.0)).alias("start"),
        F.coalesce("_s.end", F.lit(0.0)).alias("end"),
        compact(F.coalesce("_s.text", F.lit(""))).alias("text"),
        optional_double(F.col("_s.avg_logprob")).alias("avg_logprob"),
        optional_double(F.col("_s.no_speech_probability")).alias("no_speech_probability"),
    )
    return rows.filter("text <> ''")


def read_stage_outputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Turns and segments of ``<folder>/<recording>/diarize.json`` and ``transcribe.json``."""
    turns = read_stage_results(spark, f"{folder}/*/diarize.json", TURN_SCHEMA)
    segments = read_stage_results(spark, f"{folder}/*/transcribe.json", SEGMENT_SCHEMA)
    return speaker_turns(turns), transcript_segments(segments)
