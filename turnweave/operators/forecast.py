"""Processing-time forecasts from similar past items, and remaining time of a run."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnweave.functions.numbers import (
    DEFAULT_STAGE_SHARES,
    EXPORT_SECONDS,
    STAGES,
    bitrate_bucket,
    round_to,
    sample_rate_bucket,
    scaled_wall_seconds,
)
from turnweave.functions.text import lowered

NEIGHBOURS = 12
# Tasks among which the items of one feature combination are dealt.
SHARES = 16

# Score of each equal feature on top of the base score 1; the best score is 10, rated against 9.
FEATURE_SCORES = {"codec": 3.0, "channels": 2.0, "rate": 1.5, "bitrate": 1.5, "container": 1.0}
BASE_SCORE = 1.0
RATED_SCORE = 9.0
EXPORT_CONFIDENCE = 0.4

# Item states that need no more work.
TERMINAL_STATES = ("completed", "failed", "skipped_duplicate", "skipped_invalid", "skipped_too_short")

FEATURES = tuple(FEATURE_SCORES)
FEATURE_COLUMNS = tuple(f"f_{name}" for name in FEATURES)


def with_features(rows: DataFrame) -> DataFrame:
    """Adds the compared features; a blank codec or container and 0 channels compare equal to nothing."""
    text = lambda name: F.nullif(lowered(F.col(name)), F.lit(""))
    return rows.select(
        "*",
        F.coalesce(text("compute_mode"), F.lit("cpu")).alias("f_mode"),
        text("audio_codec").alias("f_codec"),
        F.nullif(F.col("audio_channels").cast("string"), F.lit("0")).alias("f_channels"),
        sample_rate_bucket(F.col("audio_sample_rate")).alias("f_rate"),
        bitrate_bucket(F.col("bitrate")).alias("f_bitrate"),
        text("container_name").alias("f_container"),
    )


def usable_history(history: DataFrame) -> DataFrame:
    """Completed items with positive duration and wall time."""
    return history.filter(
        (F.lower("status") == "completed") & (F.col("wall_seconds") > 0) & (F.col("duration_seconds") > 0)
    )


def _by_subset(rows: DataFrame, kept: list[str]) -> DataFrame:
    """One row per subset of features that the row has a value for; features outside the subset become ``*``."""
    subsets = [set(chosen) for size in range(len(FEATURES) + 1) for chosen in combinations(FEATURES, size)]
    # One SQL text: 32 structs built column by column would cost more than running the query on small data.
    variants = ", ".join(
        "named_struct("
        + f"'subset', {number}, "
        + ", ".join(f"'k_{name}', " + (f"f_{name}" if name in chosen else "'*'") for name in FEATURES)
        + f", 'score', {BASE_SCORE + sum(FEATURE_SCORES[name] for name in chosen)}D)"
        for number, chosen in enumerate(subsets)
    )
    spread = rows.select("f_mode", *kept, F.expr(f"inline(array({variants}))"))
    return spread.dropna(subset=[f"k_{name}" for name in FEATURES])


def _first_in_group(rows: DataFrame, keys: list[str], order: list, count: int, name: str = "_n") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= count)


def nearest_samples(items: DataFrame, history: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The best-scored past samples of every distinct feature combination among ``items``.

    Exact without comparing items to samples. Samples with equal features score alike and rank by position, so
    the first 12 of each combination suffice. Each subset of the features then gives groups of samples that agree
    on it, again cut to their first 12: a sample outside the cut of the subset it matches has 12 better-placed
    samples with at least its score. Items meet the groups through equi joins, at most 32 x 12 rows per combination.
    """
    stages = [c for c in ("stage_seconds",) if c in history.columns]
    sample = ["sample_pos", "duration_seconds", "wall_seconds", *stages]
    samples = with_features(usable_history(history)).select("f_mode", *FEATURE_COLUMNS, *sample)
    reduced = _first_in_group(samples, ["f_mode", *FEATURE_COLUMNS], ["sample_pos"], neighbours).drop("_n")
    keys = ["f_mode", "subset", *[f"k_{name}" for name in FEATURES]]
    offered = _first_in_group(
        _by_subset(reduced, sample).drop("score"), keys, ["sample_pos"], neighbours
    ).drop("_n")

    wanted = with_features(items).select("f_mode", *FEATURE_COLUMNS).distinct()
    asked = _by_subset(wanted.withColumn("combination", F.struct("f_mode", *FEATURE_COLUMNS)), ["combination"])
    scored = (
        asked.join(offered, keys)
        .groupBy("combination", "sample_pos")
        .agg(F.max("score").alias("score"), *[F.first(c).alias(c) for c in sample[1:]])
    )
    return _first_in_group(scored, ["combination"], [F.desc("score"), F.col("sample_pos")], neighbours, "rank")


def _sample_shares(has_stages: bool) -> list[Column]:
    """Share of each stage in a sample's known stage times; the default shares when it has none."""
    if not has_stages:
        return [F.lit(DEFAULT_STAGE_SHARES[stage]) for stage in STAGES]
    positive = [
        F.greatest(F.coalesce(F.try_element_at("stage_seconds", F.lit(stage)), F.lit(0.0)), F.lit(0.0))
        for stage in STAGES
    ]
    total = positive[0]
    for value in positive[1:]:
        total = total + value
    return [
        F.when(total > 0, value / F.nullif(total, F.lit(0.0))).otherwise(F.lit(DEFAULT_STAGE_SHARES[stage]))
        for stage, value in zip(STAGES, positive)
    ]


def _neighbourhoods(found: DataFrame) -> DataFrame:
    """Everything about the nearest samples of a combination that no item changes: the samples as one small array,
    their weight, the confidence and the stage shares."""
    shares = [value.alias(f"s_{stage}") for stage, value in zip(STAGES, _sample_shares("stage_seconds" in found.columns))]
    sample = F.struct("rank", "score", "duration_seconds", "wall_seconds", *[f"s_{stage}" for stage in STAGES])
    # At most `neighbours` elements per combination.
    lists = (
        found.select("combination", "rank", "score", "duration_seconds", "wall_seconds", *shares)
        .groupBy("combination")
        .agg(F.array_sort(F.collect_list(sample)).alias("near"))
    )
    total = lambda field: F.aggregate(
        "near", F.lit(0.0), lambda acc, s: acc + (s.getField("score") * s.getField(field) if field else s.getField("score"))
    )
    weighed = lists.select("combination", "near", F.size("near").alias("sample_count"), total("").alias("weight"))
    factor = F.least(F.lit(1.0), F.col("sample_count") / F.lit(5.0))
    rating = F.least(F.lit(1.0), F.col("weight") / F.col("sample_count") / F.lit(RATED_SCORE))
    confidence = F.least(F.lit(0.9), F.lit(0.15) + F.lit(0.55) * factor + F.lit(0.30) * rating)
    return weighed.select(
        F.col("combination").alias("_key"),
        "near",
        "sample_count",
        "weight",
        round_to(confidence, 3).alias("confidence"),
        *[(total(f"s_{stage}") / F.col("weight")).alias(f"share_{stage}") for stage in STAGES],
    )


def predict_time(items: DataFrame, history: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Adds ``total_seconds``, ``confidence``, ``sample_count`` and ``stage_seconds``; null without history.

    Work happens per feature combination; an item only scales the few nearest samples to its own duration. A
    sample's ``stage_seconds`` map is optional.
    """
    near = _neighbourhoods(nearest_samples(items, history, neighbours))
    # A few hundred combinations serve all items, so a popular one is dealt to several tasks: its row is repeated per
    # share, and items are spread over the shares by their duration. Features may be null.
    spread = near.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    own = with_features(items).select(
        *items.columns,
        F.struct("f_mode", *FEATURE_COLUMNS).alias("_own"),
        F.pmod(F.xxhash64("duration_seconds"), F.lit(SHARES)).cast("int").alias("_own_share"),
    )
    same = F.col("_own").eqNullSafe(F.col("_key")) & (F.col("_own_share") == F.col("_share"))
    joined = own.join(spread, same, "left")
    duration = F.col("duration_seconds")
    scaled = lambda s: scaled_wall_seconds(
        s.getField("duration_seconds"), s.getField("wall_seconds"), duration
    )
    weighted = F.aggregate("near", F.lit(0.0), lambda acc, s: acc + s.getField("score") * scaled(s))
    raw = joined.withColumn("_raw", weighted / F.greatest(F.col("weight"), F.lit(0.1)))
    some = F.col("near").isNotNull()
    stage_seconds = F.create_map(
        *[
            part
            for stage in STAGES
            for part in (F.lit(stage), round_to(F.col("_raw") * F.col(f"share_{stage}"), 3))
        ]
    )
    return raw.select(
        *items.columns,
        F.when(some, F.greatest(F.lit(1.0), round_to(F.col("_raw"), 3))).alias("total_seconds"),
        "confidence",
        F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
        F.when(some, stage_seconds).alias("stage_seconds"),
    )


def stage_remaining(stage_seconds: Column, stage: Column, elapsed: Column) -> Column:
    """What is left of the current stage plus all later stages; an unknown stage counts against the total."""
    spent = F.greatest(F.coalesce(elapsed, F.lit(0.0)), F.lit(0.0))
    target = lambda name: F.greatest(
        F.coalesce(F.try_element_at(stage_seconds, F.lit(name)), F.lit(0.0)), F.lit(0.0)
    )
    branches = F
    for place, name in enumerate(STAGES):
        left = F.greatest(F.lit(0.0), target(name) - spent)
        for later in STAGES[place + 1 :]:
            left = left + target(later)
        branches = branches.when(stage == name, left)
    total = target(STAGES[0])
    for name in STAGES[1:]:
        total = total + target(name)
    return round_to(branches.otherwise(F.greatest(F.lit(0.0), total - spent)), 3)


def remaining_time(
    predicted: DataFrame, current: DataFrame, key: str = "run_id", include_export: bool = True
) -> DataFrame:
    """Remaining seconds of every run.

    ``predicted`` holds the run's items with their predictions, ``item_pos``, ``status`` and ``duplicate_status``.
    ``current`` has one row per run: ``current_item_pos`` (null before the first item), ``current_stage``,
    ``current_stage_elapsed_sec``, ``current_item_elapsed_sec`` and the naive ``legacy_remaining_sec``.
    """
    open_item = ~(
        F.lower("status").isin(*TERMINAL_STATES)
        | F.coalesce(F.col("duplicate_status") == "duplicate_skip", F.lit(False))
    )
    rows = predicted.filter(open_item & F.col("total_seconds").isNotNull()).join(current, key)
    place = F.col("current_item_pos")
    is_current = F.coalesce(F.col("item_pos") == place, F.lit(False))
    ahead = place.isNull() | (F.col("item_pos") > place)
    spent = F.greatest(F.coalesce("current_item_elapsed_sec", F.lit(0.0)), F.lit(0.0))
    current_left = F.when(
        F.coalesce("current_stage", F.lit("")) != "",
        stage_remaining(F.col("stage_seconds"), F.col("current_stage"), F.col("current_stage_elapsed_sec")),
    ).otherwise(F.greatest(F.lit(0.0), F.col("total_seconds") - spent))
    left = F.when(is_current, current_left).when(ahead, F.col("total_seconds"))
    sums = (
        rows.withColumn("_left", left)
        .filter(F.col("_left").isNotNull())
        .groupBy(key)
        .agg(
            F.sum("_left").alias("_sum"),
            F.sum("confidence").alias("_confidence"),
            F.count(F.lit(1)).alias("_items"),
        )
    )
    export = 1 if include_export else 0
    history = round_to(F.greatest(F.lit(0.0), F.col("_sum") + F.lit(EXPORT_SECONDS * export)), 3)
    trust = (F.col("_confidence") + F.lit(EXPORT_CONFIDENCE * export)) / (F.col("_items") + F.lit(export))
    naive = F.col("legacy_remaining_sec")
    blended = round_to(F.greatest(F.lit(0.0), history * trust + naive * (F.lit(1.0) - trust)), 3)
    return current.join(sums, key, "left").select(
        key,
        F.when(F.col("_items").isNull(), naive).when(naive.isNull(), history).otherwise(blended).alias(
            "estimated_remaining_sec"
        ),
        F.coalesce("_items", F.lit(0)).alias("predicted_items"),
    )
