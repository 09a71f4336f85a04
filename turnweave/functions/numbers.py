"""Optional numbers, rounding, buckets and the clamped arithmetic of progress and forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Stage names in processing order.
STAGES = (
    "extract_audio",
    "detect_speech_candidates",
    "diarize_audio",
    "transcribe_audio",
    "generate_artifacts",
)

# Share of an item's time per stage when a sample carries no stage data.
DEFAULT_STAGE_SHARES = {
    "extract_audio": 0.12,
    "detect_speech_candidates": 0.10,
    "diarize_audio": 0.30,
    "transcribe_audio": 0.42,
    "generate_artifacts": 0.06,
}

# Progress bounds of each stage inside one item (0.94 to 0.96 is a gap).
STAGE_BOUNDS = {
    "extract_audio": (0.0, 0.18),
    "detect_speech_candidates": (0.18, 0.30),
    "diarize_audio": (0.30, 0.70),
    "transcribe_audio": (0.70, 0.94),
    "generate_artifacts": (0.96, 1.0),
}

# Expected seconds = factor * duration, clamped; (gpu factor, gpu max, other factor, other max, min).
STAGE_EXPECTATIONS = {
    "extract_audio": (0.06, 25.0, 0.06, 25.0, 1.5),
    "detect_speech_candidates": (0.08, 30.0, 0.08, 30.0, 1.0),
    "diarize_audio": (0.10, 120.0, 0.45, 480.0, 2.0),
    "transcribe_audio": (0.18, 180.0, 0.90, 720.0, 4.0),
    "generate_artifacts": (0.03, 15.0, 0.03, 15.0, 1.0),
    "preflight": (0.02, 10.0, 0.02, 10.0, 1.0),
}
EXPORT_STAGE = "llm_export"
EXPORT_SECONDS = 5.0


def round_to(value: Column, digits: int) -> Column:
    """Half-up rounding in binary floating point, the same arithmetic in every engine."""
    factor = float(10**digits)
    return F.floor(value * F.lit(factor) + F.lit(0.5)) / F.lit(factor)


def clamp(value: Column, low: float, high: float) -> Column:
    """Null stays null: ``greatest`` and ``least`` alone would return the bound."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def optional_int(text: Column) -> Column:
    """``N/A``, blank and junk text become null."""
    digits = F.trim(text)
    # Testing first is cheaper than a failed cast.
    return F.when(digits.rlike(r"^[+-]?\d+$"), digits.try_cast("bigint"))


def optional_double(text: Column) -> Column:
    number = F.trim(text)
    return F.when(~number.isin("", "N/A"), number.try_cast("double"))


def optional_ratio(text: Column) -> Column:
    """``a/b`` or a plain number as a 3-decimal double; ``0/0`` and junk become null."""
    parts = F.split(F.trim(text), "/", 2)
    left = F.trim(F.get(parts, F.lit(0))).try_cast("double")
    right = F.trim(F.get(parts, F.lit(1))).try_cast("double")
    quotient = F.when(F.size(parts) == 2, left / F.nullif(right, F.lit(0.0))).otherwise(left)
    return round_to(quotient, 3)


def truthy(value: Column, fallback: Column) -> Column:
    """``value`` unless it is null or zero."""
    return F.coalesce(F.nullif(value, F.lit(0).cast("bigint")), fallback)


def bitrate_bucket(bitrate: Column) -> Column:
    return (
        F.when(bitrate.isNull() | (bitrate <= 0), "unknown")
        .when(bitrate <= 96_000, "low")
        .when(bitrate <= 192_000, "standard")
        .when(bitrate <= 320_000, "high")
        .otherwise("lossless")
    )


def sample_rate_bucket(rate: Column) -> Column:
    return (
        F.when(rate.isNull() | (rate <= 0), "unknown")
        .when(rate <= 16_000, "narrowband")
        .when(rate <= 24_000, "voice")
        .when(rate <= 48_000, "standard")
        .otherwise("high")
    )


def scaled_wall_seconds(sample_duration: Column, sample_wall: Column, target_duration: Column) -> Column:
    """Wall time of a past item carried over to another duration: a fixed part plus a proportional part."""
    ratio = F.greatest(
        F.lit(0.25),
        F.least(F.lit(4.0), F.greatest(F.lit(1.0), target_duration) / F.greatest(F.lit(1.0), sample_duration)),
    )
    fixed = F.least(F.lit(12.0), sample_wall * F.lit(0.35))
    return F.greatest(F.lit(1.0), round_to(fixed + F.greatest(F.lit(0.0), sample_wall - fixed) * ratio, 3))


def expected_stage_seconds(stage: Column, duration: Column, compute_mode: Column) -> Column:
    safe = F.greatest(F.lit(1.0), or_zero(duration))
    gpu = compute_mode == "gpu"

    def clamped(values: tuple) -> Column:
        gpu_factor, gpu_max, factor, maximum, minimum = values
        return F.greatest(
            F.lit(minimum),
            F.when(gpu, F.least(F.lit(gpu_max), safe * F.lit(gpu_factor))).otherwise(
                F.least(F.lit(maximum), safe * F.lit(factor))
            ),
        )

    branches = F.when(stage == EXPORT_STAGE, F.lit(EXPORT_SECONDS))
    for name, values in STAGE_EXPECTATIONS.items():
        branches = branches.when(stage == name, clamped(values))
    return branches.otherwise(F.lit(EXPORT_SECONDS))


def stage_fraction(stage: Column, elapsed: Column, duration: Column, compute_mode: Column) -> Column:
    """Position inside the current item, 0 to 1; unknown stages use the whole range."""
    expected = expected_stage_seconds(stage, duration, compute_mode)
    share = clamp(or_zero(elapsed) / F.greatest(expected, F.lit(0.1)), 0.0, 1.0)
    low = reduce(lambda acc, item: acc.when(stage == item[0], F.lit(item[1][0])), STAGE_BOUNDS.items(), F)
    high = reduce(lambda acc, item: acc.when(stage == item[0], F.lit(item[1][1])), STAGE_BOUNDS.items(), F)
    low, high = low.otherwise(F.lit(0.0)), high.otherwise(F.lit(1.0))
    return low + (high - low) * share


def completed_percent(processed: Column, total: Column, completed_items: Column, total_items: Column) -> Column:
    by_duration = clamp(processed / F.nullif(total, F.lit(0.0)), 0.0, 1.0)
    by_count = clamp(completed_items / F.nullif(total_items, F.lit(0)), 0.0, 1.0)
    return (
        F.when(total > 0, round_to(F.lit(5.0) + F.lit(90.0) * by_duration, 1))
        .when(total_items <= 0, F.lit(0.0))
        .otherwise(round_to(F.lit(5.0) + F.lit(90.0) * by_count, 1))
    )


def overall_percent(
    stage: Column,
    stage_elapsed: Column,
    item_duration: Column,
    compute_mode: Column,
    processed: Column,
    total: Column,
    completed_items: Column,
    total_items: Column,
    preflight_fraction: Column,
) -> Column:
    """Progress of a run: queued 0, preflight 0-5, export 95-99, otherwise 5 + 90 x fraction."""
    inside = stage_fraction(stage, stage_elapsed, item_duration, compute_mode)
    export = clamp(or_zero(stage_elapsed) / F.lit(EXPORT_SECONDS), 0.0, 1.0)
    effective = F.least(
        total, F.greatest(F.lit(0.0), processed) + F.greatest(F.lit(0.0), item_duration) * inside
    )
    by_count = clamp((completed_items + inside) / F.nullif(total_items, F.lit(0)), 0.0, 1.0)
    return (
        F.when(stage == "queued", F.lit(0.0))
        .when(stage == "preflight", round_to(F.lit(5.0) * clamp(preflight_fraction, 0.0, 1.0), 1))
        .when(stage == EXPORT_STAGE, round_to(F.lit(95.0) + F.lit(4.0) * export, 1))
        .when(stage == "completed", F.lit(100.0))
        .when(total > 0, round_to(F.lit(5.0) + F.lit(90.0) * (effective / F.nullif(total, F.lit(0.0))), 1))
        .when(total_items <= 0, F.lit(0.0))
        .otherwise(round_to(F.lit(5.0) + F.lit(90.0) * by_count, 1))
    )


def naive_remaining(total: Column, processed: Column, elapsed: Column) -> Column:
    """Remaining seconds at the rate seen so far; null when nothing can be said."""
    known = (total > 0) & (processed > 0) & (elapsed > 0)
    return F.when(known, F.greatest(F.lit(0.0), (total - processed) / (processed / elapsed)))
