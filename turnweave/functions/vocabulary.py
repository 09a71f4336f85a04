"""Closed vocabularies: compute modes, job states, silence profiles, warnings and the settings digest."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnweave.functions.text import lowered

# Minimum silence per profile, in milliseconds.
SILENCE_PROFILES = {"default": 500, "loose": 1000, "strict": 250}

# Phrases that speech models invent over silence.
SILENCE_PHRASES = (
    "ご視聴ありがとうございました",
    "ご視聴ありがとうございます",
    "ありがとうございました",
    "Thank you for watching",
    "Thanks for watching",
)

# What the upstream tools are called in documents and digests.
TOOL_NAMES = {
    "pipeline_version": "2026-05-11-v1-whisper-transcript-timeline",
    "transcription_backend": "faster-whisper-large-v3-v1",
    "transcription_model_id": "Systran/faster-whisper-large-v3",
    "diarization_backend": "pyannote.audio",
    "diarization_model_id": "pyannote/speaker-diarization-community-1",
    "vad_backend": "ffmpeg-silencedetect",
    "vad_model_id": "ffmpeg-silencedetect-noise-35db",
    "timeline_schema": "timeline-v1",
    "timeline_path": "timeline.json",
}

# Job states that map to another name; every other state keeps its lowercase form.
JOB_STATE_ALIASES = {
    "pending": "queued",
    "cancelled": "canceled",
    "skipped": "completed",
    "skipped_no_changes": "completed",
}

MIN_DURATION_SECONDS = 2.0


def compute_mode(value: Column) -> Column:
    return F.when(lowered(value) == "gpu", "gpu").otherwise("cpu")


def job_state(state: Column) -> Column:
    text = lowered(state)
    aliases = F.create_map(*[F.lit(part) for pair in JOB_STATE_ALIASES.items() for part in pair])
    return F.coalesce(F.try_element_at(aliases, text), F.nullif(text, F.lit("")), F.lit("unknown"))


def silence_profile(value: Column) -> Column:
    """Normalized profile name; an unknown name raises when the row is evaluated."""
    name = F.coalesce(F.nullif(lowered(value), F.lit("")), F.lit("default"))
    return F.when(name.isin(*SILENCE_PROFILES), name).otherwise(
        F.raise_error(F.concat(F.lit("Unsupported VAD profile: "), name)).cast("string")
    )


def silence_profile_ms(value: Column) -> Column:
    levels = F.create_map(*[F.lit(part) for pair in SILENCE_PROFILES.items() for part in pair])
    return F.element_at(levels, silence_profile(value))


def skip_warning(status: Column, count: Column) -> Column:
    """Text for files left out before processing; null for other statuses or no files."""
    return (
        F.when(count <= 0, F.lit(None).cast("string"))
        .when(status == "skipped_invalid", F.format_string("preflight: skipped %d invalid audio file(s).", count))
        .when(
            status == "skipped_too_short",
            F.format_string(f"preflight: skipped %d audio file(s) shorter than {MIN_DURATION_SECONDS:.1f}s.", count),
        )
    )


def generation_signature(pipeline: str, mode: Column, profile: Column, diarization_enabled: bool = True) -> Column:
    """SHA-256 over the compact JSON of every setting that changes the output, in a fixed field order."""
    name = silence_profile(profile)
    settings = F.struct(
        F.lit(pipeline).alias("pipeline"),
        F.lit(TOOL_NAMES["pipeline_version"]).alias("pipeline_version"),
        compute_mode(mode).alias("compute_mode"),
        F.struct(
            F.lit(TOOL_NAMES["transcription_backend"]).alias("backend"),
            F.lit(TOOL_NAMES["transcription_model_id"]).alias("model_id"),
            F.lit("auto").alias("language"),
        ).alias("speech_transcription"),
        F.struct(
            F.lit(True).alias("required"),
            F.lit(TOOL_NAMES["diarization_model_id"]).alias("model_id"),
            F.lit(diarization_enabled).alias("requested_enabled_flag"),
        ).alias("diarization"),
        F.struct(
            F.lit(TOOL_NAMES["vad_backend"]).alias("backend"),
            F.lit(TOOL_NAMES["vad_model_id"]).alias("model_id"),
            name.alias("profile"),
            F.lit(True).alias("filter"),
            F.struct(silence_profile_ms(profile).alias("min_silence_duration_ms")).alias("parameters"),
        ).alias("vad"),
        F.struct(
            F.lit(TOOL_NAMES["timeline_schema"]).alias("schema"),
            F.lit(TOOL_NAMES["timeline_path"]).alias("path"),
        ).alias("artifact"),
    )
    return F.sha2(F.to_json(settings), 256)
