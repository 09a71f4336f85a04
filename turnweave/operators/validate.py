"""Transcript validation: reject segments without speech, and phrases that models invent over silence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from turnweave.functions.numbers import round_to
from turnweave.functions.text import comparable
from turnweave.functions.vocabulary import SILENCE_PHRASES
from turnweave.operators.intervals import segment_evidence
from turnweave.operators.running import repeat_counts, run_lengths

# Validation thresholds (seconds, probability, log probability, repeats).
MIN_SPEECH_OVERLAP_SECONDS = 0.1
HIGH_NO_SPEECH = 0.6
LOW_CONFIDENCE = -0.6
REPEATS = 3
LONG_PHRASE_SECONDS = 8.0


def phrase_number(text, phrases: Sequence[str]):
    """1-based number of the known phrase a text equals, compared without whitespace and case; else null."""
    known = F.array(*[comparable(F.lit(phrase)) for phrase in phrases])
    return F.nullif(F.array_position(known, comparable(text)), F.lit(0).cast("bigint"))


def phrase_repeats(
    segments: DataFrame,
    phrases: Sequence[str] = SILENCE_PHRASES,
    key: str = "media_id",
    segment: str = "seg_index",
    text: str = "text",
) -> DataFrame:
    """Known-phrase segments with ``repeats`` in the recording and ``run_length`` of consecutive ones.

    Only a phrase number per segment is shuffled, never the text.
    """
    numbered = segments.select(key, segment, phrase_number(F.col(text), phrases).alias("phrase_no"))
    runs = run_lengths(numbered, key, segment, "phrase_no").filter(F.col("phrase_no").isNotNull())
    return repeat_counts(runs, key, segment, "phrase_no", counted=numbered)


def validate_segments(
    segments: DataFrame,
    ranges: DataFrame,
    turns: DataFrame,
    phrases: Sequence[str] = SILENCE_PHRASES,
    key: str = "media_id",
    segment: str = "seg_index",
    start: str = "start",
    end: str = "end",
    text: str = "text",
    logprob: str = "avg_logprob",
    no_speech: str = "no_speech_probability",
    unit: int = 1,
    score_scale: int = 1,
) -> DataFrame:
    """Adds ``speech_overlap``, ``best_speaker``, ordered ``reasons`` and ``state`` (validated or rejected).

    ``score_scale`` multiplies the score thresholds when scores are stored as integers.
    """
    zero = F.lit(0)
    found = segment_evidence(
        segments, turns=turns, ranges=ranges, key=key, segment=segment, start=start, end=end, unit=unit
    )
    phrases_found = phrase_repeats(segments, phrases, key, segment, text)
    joined = segments.join(found, [key, segment], "left").join(phrases_found, [key, segment], "left")

    seg_start = F.coalesce(F.col(start), zero)
    length = F.greatest(F.coalesce(F.nullif(F.col(end), zero), seg_start) - seg_start, zero)
    overlap = F.coalesce(F.col("speech_overlap"), zero)
    no_overlap = overlap < F.lit(MIN_SPEECH_OVERLAP_SECONDS * unit)
    no_speaker = F.col("best_speaker").isNull()
    silent = F.coalesce(F.col(no_speech) >= F.lit(HIGH_NO_SPEECH * score_scale), F.lit(False))
    unsure = F.coalesce(F.col(logprob) < F.lit(LOW_CONFIDENCE * score_scale), F.lit(False))
    consecutive = F.coalesce(F.col("run_length") >= REPEATS, F.lit(False))
    long_phrase = length >= F.lit(LONG_PHRASE_SECONDS * unit)
    invented = F.coalesce(F.col("repeats") >= REPEATS, F.lit(False)) & (
        consecutive | long_phrase | no_overlap | no_speaker | silent
    )
    rules = (
        (no_overlap, "no_speech_candidate_overlap"),
        (no_speaker, "no_speaker_overlap"),
        (unsure, "low_confidence"),
        (silent, "high_no_speech_probability"),
        (invented, "known_silence_hallucination_phrase"),
        (invented, "repeated_hallucination_phrase"),
        (invented & consecutive, "consecutive_hallucination_phrase"),
        (invented & long_phrase, "long_known_hallucination_segment"),
    )
    reasons = F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in rules]), lambda name: name.isNotNull())
    rejected = no_overlap | silent | invented
    return joined.select(
        *segments.columns,
        overlap.alias("speech_overlap"),
        "best_speaker",
        reasons.alias("reasons"),
        F.when(rejected, "rejected").otherwise("validated").alias("state"),
    )


def with_validation(validated: DataFrame) -> DataFrame:
    """Document form: a ``validation`` struct on all rows, ``rejection_reasons`` on rejected ones."""
    return validated.select(
        *[c for c in validated.columns if c not in ("speech_overlap", "best_speaker", "reasons", "state")],
        F.struct(
            "state",
            round_to(F.col("speech_overlap"), 3).alias("speech_overlap_sec"),
            F.col("best_speaker").alias("speaker"),
            "reasons",
        ).alias("validation"),
        F.when(F.col("state") == "rejected", F.col("reasons")).alias("rejection_reasons"),
    )
