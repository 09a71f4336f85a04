"""Speaker timelines: flat turns, nested documents, audit documents and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnweave.functions.times import absolute_at
from turnweave.functions.vocabulary import TOOL_NAMES, silence_profile, silence_profile_ms
from turnweave.operators.running import numbered

# Turns of a recording that lie together: joined with its source, kept in one place of the turn table.
STRETCH = 4_096
# Turns rendered as one piece of a document's text.
PIECE = 256

# The steps listed in every audit document (name, description, persistent output).
PROCESSING_FLOW = (
    ("audio_normalization", "Decode source audio into the worker's analysis format.", False),
    ("speech_activity_detection", "Find source-audio ranges that are likely to contain speech.", False),
    ("speaker_diarization", "Assign mechanical speaker labels to source-audio time ranges.", False),
    ("speech_transcription", "Transcribe source audio with Whisper automatic language detection.", False),
    (
        "timeline_merge",
        "Merge speaker labels, timestamps, and validated Whisper transcript text into the final timeline JSON "
        "without rewriting accepted text.",
        True,
    ),
)


def timeline_turns(
    validated: DataFrame,
    sources: DataFrame | None = None,
    key: str = "media_id",
    segment: str = "seg_index",
    start: str = "start",
    end: str = "end",
    unit: int = 1,
) -> DataFrame:
    """Accepted segments as numbered turns, in input order, with absolute times when ``sources`` has them.

    ``validated`` is the output of ``validate_segments``; ``sources`` has the recording key and ``recorded_at``.
    """
    accepted = validated.filter(F.col("state") == "validated")
    turns = numbered(accepted, [key], segment, "index").withColumn("speaker", F.col("best_speaker"))
    zero = F.lit(0)
    begin = F.coalesce(F.col(start), zero)
    finish = F.coalesce(F.nullif(F.col(end), zero), begin)
    turns = turns.withColumn(start, begin).withColumn(end, finish)
    if sources is not None:
        # Sources are repeated for every stretch of turns, so the join deals out a long recording by its stretches.
        turns = turns.withColumn("_stretch", F.floor((F.col("index") - 1) / F.lit(STRETCH)))
        stretches = turns.select(key, "_stretch").distinct()
        moments = stretches.join(sources.select(key, "recorded_at"), key, "left")
        turns = turns.join(moments, [key, "_stretch"], "left").drop("_stretch")
        recorded = F.col("recorded_at")
    else:
        recorded = F.lit(None).cast("string")
    moment = lambda name: absolute_at(recorded, F.col(name) / F.lit(float(unit)))
    kept = [c for c in ("text", "avg_logprob", "no_speech_probability") if c in turns.columns]
    return turns.select(
        key,
        "index",
        start,
        end,
        moment(start).alias("absolute_start_at"),
        moment(end).alias("absolute_end_at"),
        "speaker",
        F.col(segment).alias("transcription_segment_index"),
        *kept,
    )


def turn_table(turns: DataFrame, key: str = "media_id") -> DataFrame:
    """Turns as rows, clustered by recording and stretch of the index, so a long recording spreads over many tasks and files.

    This is how timelines are stored and joined, whatever the length of a recording; documents are made at export only.
    """
    rows = turns.withColumn("stretch", F.floor((F.col("index") - 1) / F.lit(STRETCH)))
    return rows.repartitionByRange(key, "stretch").sortWithinPartitions(key, "index")


def timeline_headers(turns: DataFrame, sources: DataFrame, key: str = "media_id") -> DataFrame:
    """One row per row of ``sources``: everything of a timeline document but its turns."""
    counts = turns.groupBy(key).agg(F.count(F.lit(1)).alias("turn_count"))
    return sources.join(counts, key, "left").select(
        key,
        F.lit(1).alias("schema_version"),
        F.lit("timeline").alias("artifact_type"),
        "source",
        "pipeline",
        F.coalesce("turn_count", F.lit(0)).cast("bigint").alias("turn_count"),
    )


def document_pieces(headers: DataFrame, turns: DataFrame, infos: DataFrame, key: str = "media_id") -> DataFrame:
    """Both documents of every item as text in pieces (item_id, document, piece, text) for ``item_folders``.

    A timeline is its header up to the opened list of turns, ``PIECE`` turns per further piece, and the end of the list, so
    no row holds a whole recording. ``infos`` are audit documents, one piece each. Null fields are written out.
    """
    item, options = F.col(key).cast("string").alias("item_id"), {"ignoreNullFields": "false"}

    def body(rows: DataFrame) -> Column:
        return F.to_json(F.struct(*[c for c in rows.columns if c not in (key, "stretch")]), options)

    def piece(rows: DataFrame, document: str, place: Column, text: Column) -> DataFrame:
        return rows.select(item, F.lit(document).alias("document"), place.cast("bigint").alias("piece"), text.alias("text"))

    opened = F.concat(F.regexp_replace(body(headers), r"\}$", ""), F.lit(',"turns":['))
    line = F.struct("index", body(turns).alias("line"))
    place = F.floor((F.col("index") - 1) / F.lit(PIECE)) + 1
    grouped = turns.select(key, place.alias("piece"), line.alias("line")).groupBy(key, "piece")
    lines = grouped.agg(F.array_join(F.array_sort(F.collect_list("line")).getField("line"), ",").alias("lines"))
    comma = F.when(F.col("piece") > 1, ",").otherwise("")
    return (
        piece(headers, "timeline", F.lit(0), opened)
        .union(piece(lines, "timeline", F.col("piece"), F.concat(comma, "lines")))
        .union(piece(headers, "timeline", F.lit(2**62), F.lit("]}")))
        .union(piece(infos, "convert_info", F.lit(0), body(infos)))
    )


def turn_parts(turns: DataFrame, key: str = "media_id", per_part: int | None = None) -> DataFrame:
    """Turns as ordered arrays, one row per recording and part; ``turn_count`` covers all parts."""
    return part_counts(turns, key, per_part).join(_part_bodies(turns, key, per_part), [key, "part"])


def part_counts(turns: DataFrame, key: str = "media_id", per_part: int | None = None) -> DataFrame:
    """(key, part, turn_count, parts): narrow rows, so that totals of a recording need none of its text."""
    sizes = _with_part(turns, per_part).groupBy(key, "part").agg(F.count(F.lit(1)).alias("_size"))
    totals = sizes.groupBy(key).agg(
        F.sum("_size").alias("turn_count"), F.count(F.lit(1)).cast("int").alias("parts")
    )
    return sizes.drop("_size").join(totals, key)


def _with_part(turns: DataFrame, per_part: int | None) -> DataFrame:
    if per_part is None:
        return turns.withColumn("part", F.lit(0))
    return turns.withColumn("part", F.floor((F.col("index") - 1) / F.lit(per_part)).cast("int"))


def _part_bodies(turns: DataFrame, key: str, per_part: int | None) -> DataFrame:
    body = F.struct("index", *[c for c in turns.columns if c not in (key, "index")])
    return _with_part(turns, per_part).groupBy(key, "part").agg(F.array_sort(F.collect_list(body)).alias("turns"))


def timeline_documents(
    turns: DataFrame, sources: DataFrame, key: str = "media_id", per_part: int | None = None
) -> DataFrame:
    """Timeline documents for every row of ``sources``: ``source`` and ``pipeline`` structs plus the turns.

    For views that want nested arrays: a recording without turns gets an empty array, and only where the caller sets ``per_part``
    a longer one has several parts. Stores and files use ``turn_table`` and ``document_pieces``, which hold no recording whole.
    """
    bodies = _part_bodies(turns, key, per_part)
    empty = F.array().cast(bodies.schema["turns"].dataType)
    # Sources meet the narrow counts by recording; turns join by recording and part only.
    placed = sources.join(part_counts(turns, key, per_part), key, "left")
    return placed.join(bodies, [key, "part"], "left").select(
        key,
        F.lit(1).alias("schema_version"),
        F.lit("timeline").alias("artifact_type"),
        "source",
        "pipeline",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("parts", F.lit(1)).alias("parts"),
        F.coalesce("turn_count", F.lit(0)).cast("bigint").alias("turn_count"),
        F.coalesce("turns", empty).alias("turns"),
    )


def changed_texts(
    validated: DataFrame, turns: DataFrame, key: str = "media_id", segment: str = "seg_index"
) -> DataFrame:
    """Accepted segments whose text is missing or different in the timeline, and turns without a segment.

    An empty result proves that assembling the timeline changed no text; rows are compared one by one, so no
    transcript is concatenated.
    """
    left = validated.filter(F.col("state") == "validated").select(key, segment, F.col("text").alias("segment_text"))
    right = turns.select(
        key, F.col("transcription_segment_index").alias(segment), F.col("text").alias("timeline_text")
    )
    return left.join(right, [key, segment], "full").filter(
        ~F.col("segment_text").eqNullSafe(F.col("timeline_text"))
    )


def require_same_text(validated: DataFrame, turns: DataFrame, key: str = "media_id") -> DataFrame:
    """One row with the number of differences; evaluating it fails when there are any."""
    message = "Transcript text was changed while assigning speakers."
    return changed_texts(validated, turns, key).agg(F.count(F.lit(1)).alias("changed")).withColumn(
        "checked", F.assert_true(F.col("changed") == 0, message).isNull()
    )


def recording_counts(
    ranges: DataFrame, turns: DataFrame, validated: DataFrame, key: str = "media_id"
) -> DataFrame:
    """Speech ranges, speaker turns and raw, accepted and rejected segments per recording, in one shuffle."""

    def tally(df: DataFrame, **names: Column) -> DataFrame:
        zero = F.lit(0)
        columns = ("speech_candidate_ranges", "speaker_turns", "raw_transcript_segments",
                   "transcript_segments", "rejected_transcript_segments")
        return df.select(key, *[names.get(c, zero).cast("bigint").alias(c) for c in columns])

    one = F.lit(1)
    rows = (
        tally(ranges, speech_candidate_ranges=one)
        .unionByName(tally(turns, speaker_turns=one))
        .unionByName(
            tally(
                validated,
                raw_transcript_segments=one,
                transcript_segments=F.col("state") == "validated",
                rejected_transcript_segments=F.col("state") == "rejected",
            )
        )
    )
    return rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in rows.columns if c != key])


def speaker_counts(turns: DataFrame, recordings: DataFrame, key: str = "media_id") -> DataFrame:
    """Distinct non-blank speakers per recording with the status and note of the count."""
    counted = turns.groupBy(key).agg(
        F.count_distinct(F.nullif(F.trim("speaker"), F.lit(""))).alias("speaker_count")
    )
    some = F.coalesce(F.col("speaker_count"), F.lit(0)) > 0
    return recordings.select(key).join(counted, key, "left").select(
        key,
        F.when(some, F.col("speaker_count")).alias("speaker_count"),
        F.when(some, "confirmed").otherwise("unavailable").alias("speaker_count_status"),
        F.when(~some, "No speaker turns were available.").alias("speaker_count_note"),
    )


def conversion_documents(
    sources: DataFrame,
    counts: DataFrame,
    application: str,
    generated_at: Column,
    key: str = "media_id",
) -> DataFrame:
    """Audit documents: where a timeline came from, which tools made it and what they counted.

    ``sources`` has the recording key, ``source``, ``pipeline_version``, ``generation_signature``, ``compute_mode``,
    ``vad_profile`` and the tool results ``diarization`` and ``transcription`` as structs.
    """
    zero = F.lit(0).cast("bigint")
    joined = sources.join(counts, key, "left")
    number = lambda name: F.coalesce(F.col(name), zero)
    flow = F.array(
        *[
            F.struct(
                F.lit(step).alias("step"),
                F.lit(name).alias("name"),
                F.lit(description).alias("description"),
                F.lit(persistent).alias("persistent_output"),
            )
            for step, (name, description, persistent) in enumerate(PROCESSING_FLOW, start=1)
        ]
    )
    detection = F.struct(
        F.lit(TOOL_NAMES["vad_backend"]).alias("backend"),
        F.lit(TOOL_NAMES["vad_model_id"]).alias("model_id"),
        silence_profile(F.col("vad_profile")).alias("profile"),
        F.struct(silence_profile_ms(F.col("vad_profile")).alias("min_silence_duration_ms")).alias("parameters"),
    )
    return joined.select(
        key,
        F.lit(1).alias("schema_version"),
        F.lit("convert_info").alias("artifact_type"),
        F.lit(application).alias("application"),
        generated_at.alias("generated_at"),
        "source",
        F.struct(
            "pipeline_version",
            "generation_signature",
            "compute_mode",
            detection.alias("speech_activity_detection"),
            F.struct(F.lit(True).alias("required"), "diarization.*").alias("speaker_diarization"),
            F.struct(
                "transcription.*",
                number("raw_transcript_segments").alias("raw_segment_count"),
                number("transcript_segments").alias("segment_count"),
                number("rejected_transcript_segments").alias("rejected_segment_count"),
            ).alias("speech_transcription"),
        ).alias("pipeline"),
        flow.alias("processing_flow"),
        F.struct(
            *[
                number(c).alias(c)
                for c in (
                    "speech_candidate_ranges",
                    "speaker_turns",
                    "raw_transcript_segments",
                    "transcript_segments",
                    "rejected_transcript_segments",
                )
            ]
        ).alias("counts"),
        F.struct(
            F.lit("convert_info.json").alias("convert_info"), F.lit("timeline.json").alias("timeline")
        ).alias("output_files"),
    )


def stage_gates(recordings: DataFrame, turns: DataFrame, validated: DataFrame, key: str = "media_id") -> DataFrame:
    """Per recording: diarization status, whether it goes on, and its warnings in order.

    ``recordings`` has ``transcription_status``; ``ok`` and ``no_segments`` go on, anything else fails the item.
    """
    found = turns.groupBy(key).agg(F.count(F.lit(1)).alias("_turns"))
    rejected = validated.groupBy(key).agg(F.count_if(F.col("state") == "rejected").alias("_rejected"))
    no_turns = F.coalesce(F.col("_turns"), F.lit(0)) == 0
    dropped = F.coalesce(F.col("_rejected"), F.lit(0))
    # The warnings of each gate.
    warnings = F.array(
        F.when(no_turns, "Speaker diarization completed, but no speaker turns were found."),
        F.when(F.col("transcription_status") == "no_segments", "Speech transcription produced no segments."),
        F.when(dropped > 0, F.format_string("Speech transcript validation rejected %d segment(s).", dropped)),
    )
    return recordings.join(found, key, "left").join(rejected, key, "left").select(
        *recordings.columns,
        F.when(no_turns, "no_speaker_turns").otherwise("ok").alias("diarization_status"),
        F.col("transcription_status").isin("ok", "no_segments").alias("continues"),
        F.filter(warnings, lambda text: text.isNotNull()).alias("warnings"),
    )
