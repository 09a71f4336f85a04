"""Interval algebra per recording: pair, merge, invert, overlap, assign, chunk.

Start and end may be any numeric type; ``unit`` is the number of units per second (1 for seconds, 1000 for
milliseconds) and scales every threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnweave.functions.text import compact, non_blank
from turnweave.operators.running import TIME_BIN_SECONDS, Running, even_bins, numbered, running, time_bin

JOIN_BIN_SECONDS = 60

# Silence padding, shortest kept range and chunk lengths, in seconds.
PADDING_SECONDS = 1.0
MIN_RANGE_SECONDS = 0.25
CHUNK_SECONDS = 600.0
MIN_CHUNK_SECONDS = 60.0


def _scaled(seconds: float, unit: int) -> float | int:
    value = seconds * unit
    return int(value) if unit > 1 else float(value)


def pair_intervals(
    marks: DataFrame, key: str = "media_id", position: str = "line_no", kind: str = "kind", at: str = "at"
) -> DataFrame:
    """Pair start marks (``S``) with end marks (``E``) first in, first out.

    An end without a waiting start is ignored and starts left over are dropped. With the balance of starts and ends
    along the log, an end is ignored exactly when it takes the balance to a new low below zero; the n-th start
    then belongs to the n-th end that remains.
    """
    is_start = F.col(kind) == "S"
    rows = marks.select(key, position, F.col(at).alias("_at"), is_start.alias("_start"))
    step = F.when(F.col("_start"), F.lit(1)).otherwise(F.lit(-1)).cast("bigint")
    lows = running(
        even_bins(rows, [key], position),
        [key],
        "_bin",
        [position],
        _balance=Running("sum", step, inclusive=True),
        _starts=Running("sum", F.col("_start").cast("bigint"), inclusive=True),
        _low=Running("low", step),
    )
    low_before = F.least(F.coalesce(F.col("_low"), F.lit(0)), F.lit(0))
    low_now = F.least(low_before, F.col("_balance"))
    matched_ends = F.col("_starts") - F.col("_balance") + low_now
    numbered_marks = lows.filter(F.col("_start") | (F.col("_balance") >= low_before)).withColumn(
        "pair_no", F.when(F.col("_start"), F.col("_starts")).otherwise(matched_ends)
    )
    pairs = numbered_marks.groupBy(key, "pair_no").agg(
        F.max(F.when(F.col("_start"), F.col("_at"))).alias("start"),
        F.max(F.when(~F.col("_start"), F.col("_at"))).alias("end"),
        F.count(F.lit(1)).alias("_n"),
    )
    return pairs.filter("_n = 2").drop("_n")


def _ordered_intervals(intervals: DataFrame, key: str, start: str, end: str, unit: int) -> DataFrame:
    """Intervals ready for an ordered pass by ``_s``, ``_e``: those with one start collapse to the longest.

    An interval that ends before it starts (from a damaged log) stays a row of its own, copies included, because
    each of them begins a group.
    """
    reversed_end = F.when(F.col(end) < F.col(start), F.col(end))
    longest = intervals.groupBy(key, F.col(start).alias("_s"), reversed_end.alias("_r")).agg(
        F.max(end).alias("_e"), F.count(F.lit(1)).alias("_n")
    )
    copies = F.when(F.col("_r").isNull(), F.lit(1)).otherwise(F.col("_n")).cast("int")
    return longest.select(
        key,
        "_s",
        "_e",
        time_bin(F.col("_s"), TIME_BIN_SECONDS * unit).alias("_bin"),
        F.explode(F.sequence(F.lit(1), copies)).alias("_copy"),
    ).drop("_copy")


def merge_intervals(
    intervals: DataFrame, key: str = "media_id", start: str = "start", end: str = "end", unit: int = 1
) -> DataFrame:
    """Merge overlapping or touching intervals."""
    starts = _ordered_intervals(intervals, key, start, end, unit)
    order = ["_s", "_e"]
    reached = running(starts, [key], "_bin", order, _reach=Running("max", F.col("_e")))
    head = F.col("_reach").isNull() | (F.col("_s") > F.col("_reach"))
    islands = running(
        reached, [key], "_bin", order, _island=Running("sum", head.cast("bigint"), inclusive=True)
    )
    return islands.groupBy(key, "_island").agg(F.min("_s").alias(start), F.max("_e").alias(end)).drop("_island")


def speech_ranges(
    silences: DataFrame,
    durations: DataFrame,
    key: str = "media_id",
    start: str = "start",
    end: str = "end",
    duration: str = "duration",
    padding: float = PADDING_SECONDS,
    minimum: float = MIN_RANGE_SECONDS,
    unit: int = 1,
) -> DataFrame:
    """Invert (unmerged) silences into speech ranges; every silence grows by the padding on both sides.

    ``durations`` has one row per recording. A new silence group starts where a start lies beyond everything reached
    so far, so merging and inverting share one ordered pass.
    """
    pad, least_length = F.lit(_scaled(padding, unit)), F.lit(_scaled(minimum, unit))
    starts = _ordered_intervals(silences, key, start, end, unit)
    lengths = durations.filter(F.col(duration) > 0).select(key, F.col(duration).alias("_d"))
    reached = running(
        starts,
        [key],
        "_bin",
        ["_s", "_e"],
        _reach=Running("max", F.col("_e")),
        _before=Running("last", F.struct("_s", "_e")),
    )
    # A group of one reversed interval ends before it starts; its own end counts then, not the furthest one.
    group_end = F.when(F.col("_reach") < F.col("_before._s"), F.col("_before._e")).otherwise(F.col("_reach"))
    heads = reached.filter(F.col("_reach").isNull() | (F.col("_s") > F.col("_reach"))).join(lengths, key)
    zero = F.lit(0).cast("bigint") if unit > 1 else F.lit(0.0)
    cursor = F.when(F.col("_reach").isNull(), zero).otherwise(F.least(F.col("_d"), group_end + pad))
    inner = heads.select(
        key, cursor.alias(start), F.greatest(cursor, F.col("_s") - pad).alias(end)
    )

    latest = starts.groupBy(key).agg(F.max("_e").alias("_reach"), F.max(F.struct("_s", "_e")).alias("_before"))
    tails = lengths.join(latest, key, "left").select(
        key,
        F.when(F.col("_reach").isNull(), zero).otherwise(F.least(F.col("_d"), group_end + pad)).alias(start),
        F.col("_d").alias(end),
    )
    return inner.unionByName(tails).filter(F.col(end) - F.col(start) >= least_length)


def trimmed_axis(
    ranges: DataFrame, key: str = "media_id", start: str = "start", end: str = "end", unit: int = 1
) -> DataFrame:
    """Place kept ranges one after the other: adds ``trimmed_start`` and ``trimmed_end``."""
    length = F.greatest(F.col(end) - F.col(start), F.lit(0))
    binned = ranges.withColumn("_bin", time_bin(F.col(start), TIME_BIN_SECONDS * unit)).withColumn("_length", length)
    placed = running(binned, [key], "_bin", [start, end], trimmed_start=Running("sum", F.col("_length")))
    return placed.withColumn("trimmed_end", F.col("trimmed_start") + F.col("_length")).drop("_length", "_bin")


def segment_evidence(
    segments: DataFrame,
    turns: DataFrame | None = None,
    ranges: DataFrame | None = None,
    key: str = "media_id",
    segment: str = "seg_index",
    start: str = "start",
    end: str = "end",
    turn_position: str = "turn_pos",
    speaker: str = "speaker",
    unit: int = 1,
) -> DataFrame:
    """Best speaker and speech overlap of every segment that meets a turn or a range.

    Both sides are cut into time bins and joined on (recording, bin), so a long recording is spread over many tasks;
    a pair counts only in the bin where both intervals have begun. Turns and ranges with equal bounds are reduced
    to one row first, and segments travel without their text.
    """
    width = JOIN_BIN_SECONDS * unit
    zero = F.lit(0)
    seg_start = F.coalesce(F.col(start), zero)
    seg_end = F.coalesce(F.nullif(F.col(end), zero), seg_start)
    spans = (
        segments.select(key, segment, seg_start.alias("_s"), seg_end.alias("_e"))
        .withColumn("_low", F.least("_s", "_e"))
        .withColumn("_high", F.greatest("_s", "_e"))
        .withColumn("_bin", F.explode(F.sequence(time_bin(F.col("_low"), width), time_bin(F.col("_high"), width))))
    )

    def bounded(df: DataFrame, position: Column, label: Column, is_range: int) -> DataFrame:
        first = F.coalesce(F.col(start), zero)
        last = F.coalesce(F.nullif(F.col(end), zero), first)
        return df.select(
            key,
            first.alias("_ts"),
            last.alias("_te"),
            position.cast("bigint").alias("_pos"),
            label.cast("string").alias("_speaker"),
            F.lit(is_range).cast("bigint").alias("_ranges"),
        )

    parts = []
    if turns is not None:
        parts.append(bounded(turns, F.col(turn_position), non_blank(F.col(speaker)), 0))
    if ranges is not None:
        parts.append(bounded(ranges, F.lit(None), F.lit(None), 1))
    evidence = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    distinct = (
        evidence.filter("_te >= _ts")
        .groupBy(key, "_ts", "_te")
        .agg(
            F.min("_pos").alias("_pos"),
            F.min_by("_speaker", "_pos").alias("_speaker"),
            F.sum("_ranges").alias("_ranges"),
        )
        .withColumn("_bin", F.explode(F.sequence(time_bin(F.col("_ts"), width), time_bin(F.col("_te"), width))))
    )

    overlap = F.least("_e", "_te") - F.greatest("_s", "_ts")
    middle = F.col("_s") + (F.col("_e") - F.col("_s")) / F.lit(2)
    touches = F.col("_pos").isNotNull() & middle.between(F.col("_ts"), F.col("_te"))
    pairs = (
        spans.join(distinct, [key, "_bin"])
        .filter((overlap > 0) | touches)
        .filter(time_bin(F.greatest("_low", "_ts"), width) == F.col("_bin"))
        .withColumn("_overlap", F.greatest(overlap, zero))
    )
    preference = F.when(F.col("_pos").isNotNull(), F.struct("_overlap", -F.col("_pos"), "_speaker"))
    return pairs.groupBy(key, segment).agg(
        F.max(preference).getField("_speaker").alias("best_speaker"),
        F.coalesce(F.sum(F.col("_overlap") * F.col("_ranges")), zero).alias("speech_overlap"),
    )


def assign_speakers(segments: DataFrame, turns: DataFrame, **columns) -> DataFrame:
    """Adds ``best_speaker``: the turn with the largest overlap, ties to the earlier turn; without any overlap the
    first turn around the midpoint; a blank label or no turn gives null."""
    key, segment = columns.get("key", "media_id"), columns.get("segment", "seg_index")
    found = segment_evidence(segments, turns=turns, **columns).drop("speech_overlap")
    return segments.join(found, [key, segment], "left")


def speech_overlap(segments: DataFrame, ranges: DataFrame, **columns) -> DataFrame:
    """Adds ``speech_overlap``: the summed overlap with all speech ranges, 0 without any."""
    key, segment = columns.get("key", "media_id"), columns.get("segment", "seg_index")
    found = segment_evidence(segments, ranges=ranges, **columns).drop("best_speaker")
    return segments.join(found, [key, segment], "left").withColumn(
        "speech_overlap", F.coalesce(F.col("speech_overlap"), F.lit(0))
    )


def quiet_intervals(
    levels: DataFrame,
    below: float,
    at_least: float,
    key: str = "media_id",
    position: str = "pos",
    at: str = "at",
    level: str = "level",
) -> DataFrame:
    """Intervals in which the level stays below a bound for long enough.

    An interval runs from its first quiet sample to the next loud one, or to the last sample of the recording;
    ``at_least`` is in the unit of ``at``.
    """
    loud = (F.col(level) >= F.lit(below)).cast("bigint")
    rows = levels.select(key, position, F.col(at).alias("_at"), loud.alias("_loud"))
    grouped = running(even_bins(rows, [key], position), [key], "_bin", [position], _group=Running("sum", F.col("_loud")))
    spans = grouped.groupBy(key, "_group").agg(
        F.min(F.when(F.col("_loud") == 0, F.col("_at"))).alias("start"), F.max("_at").alias("end")
    )
    return spans.filter(F.col("start").isNotNull() & (F.col("end") - F.col("start") >= F.lit(at_least))).drop("_group")


def chunk_plan(
    durations: DataFrame,
    key: str = "media_id",
    duration: str = "duration",
    chunk_seconds: float = CHUNK_SECONDS,
    unit: int = 1,
) -> DataFrame:
    """Fixed-length chunks of long recordings; a recording up to one chunk long stays whole."""
    size = F.lit(_scaled(max(MIN_CHUNK_SECONDS, chunk_seconds), unit))
    length = F.col(duration)
    last = F.when(length > size, F.ceil(length / size).cast("int") - F.lit(1)).otherwise(F.lit(0))
    chunks = durations.select(key, length.alias("_d"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    begin = F.col("chunk_no") * size
    return chunks.select(
        key,
        "chunk_no",
        begin.alias("chunk_start"),
        F.when(F.col("_d") > size, F.least(size, F.col("_d") - begin)).otherwise(F.col("_d")).alias("chunk_duration"),
    )


def stitch_chunks(
    chunk_segments: DataFrame,
    plan: DataFrame,
    key: str = "media_id",
    local_index: str = "local_index",
    start: str = "start",
    end: str = "end",
    text: str = "text",
) -> DataFrame:
    """Chunk-local segments on the recording's own axis, compact text, renumbered across chunks from 1.

    A segment whose chunk is not in the plan has no place on the axis; it stops the query with its recording and chunk.
    """
    unknown = F.raise_error(
        F.concat(F.lit("Chunk is not in the plan: "), F.col(key).cast("string"), F.lit("/"), F.col("chunk_no").cast("string"))
    ).cast("bigint")
    shifted = (
        chunk_segments.withColumn(text, compact(F.coalesce(F.col(text), F.lit(""))))
        .filter(F.col(text) != "")
        .join(plan.select(key, "chunk_no", "chunk_start"), [key, "chunk_no"], "left")
        .withColumn("chunk_start", F.coalesce(F.col("chunk_start"), unknown))
        .withColumn(start, F.col("chunk_start") + F.coalesce(F.col(start), F.lit(0)))
        .withColumn(end, F.col("chunk_start") + F.coalesce(F.col(end), F.lit(0)))
        .withColumn("_order", F.shiftleft(F.col("chunk_no").cast("bigint"), 32) + F.col(local_index))
    )
    return numbered(shifted, [key], "_order", "seg_index").drop("_order", "chunk_start")


def first_chunk_language(chunk_results: DataFrame, key: str = "media_id", language: str = "language") -> DataFrame:
    """Language of the first chunk, null when that one is blank."""
    return chunk_results.groupBy(key).agg(F.min_by(non_blank(F.col(language)), "chunk_no").alias(language))
