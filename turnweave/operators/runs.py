"""Runs: roll-ups, stage performance, progress, job views and stale detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from turnweave.functions.numbers import overall_percent, round_to
from turnweave.functions.text import lowered
from turnweave.functions.vocabulary import job_state
from turnweave.operators.running import Running, even_bins, running

STALE_SECONDS = 30

# States with an error text, and states that count as fully done without a percentage.
ERROR_STATES = ("failed", "completed_with_errors", "interrupted")
DONE_STATES = ("completed", "completed_with_errors")

# Fixed value: what an interrupted run reports.
INTERRUPTED_MESSAGE = (
    "Run was interrupted while the worker was stopped. It will not be resumed "
    "automatically; queue a new refresh to retry."
)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def run_rollup(runs: DataFrame, items: DataFrame, key: str = "run_id") -> DataFrame:
    """Runs with summed size and duration of their manifest items, 0 without items."""
    sums = items.groupBy(key).agg(
        F.sum(_zero("size_bytes")).alias("total_size_bytes"),
        F.sum(F.coalesce("duration_seconds", F.lit(0))).alias("total_duration_sec"),
    )
    return runs.join(sums, key, "left").fillna(0, ["total_size_bytes", "total_duration_sec"])


def item_counts(items: DataFrame, keys: Sequence[str] = ("run_id",), status: str = "status") -> DataFrame:
    """Items per run by outcome, and audio durations."""
    state = F.lower(status)
    length = F.greatest(F.coalesce("duration_seconds", F.lit(0)), F.lit(0))
    skipped = state.startswith("skipped")
    finished = state.isin("completed", "failed", "skipped_duplicate")
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items_total"),
        F.count_if(state == "completed").alias("items_completed"),
        F.count_if(skipped).alias("items_skipped"),
        F.count_if(state == "failed").alias("items_failed"),
        F.sum(F.coalesce("duration_seconds", F.lit(0))).alias("total_audio"),
        F.coalesce(F.sum(F.when(finished, F.coalesce("duration_seconds", F.lit(0)))), F.lit(0)).alias(
            "processed_audio"
        ),
        F.coalesce(F.sum(F.when(state == "completed", length)), F.lit(0)).alias("completed_audio"),
    )


def throughput(completed_audio: Column, wall_seconds: Column) -> Column:
    """Completed audio seconds per wall second, 3 decimals; null when either is not positive."""
    known = (completed_audio > 0) & (wall_seconds > 0)
    return F.when(known, round_to(completed_audio / F.nullif(wall_seconds, F.lit(0)), 3))


def stage_performance(items: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Total, average and maximum wall seconds per stage over completed items.

    The average divides by all completed items of the run, whether they have the stage or not; negative times count
    as 0. ``items`` has ``stage_elapsed_seconds`` as a map.
    """
    completed = items.filter(F.lower("status") == "completed")
    sizes = completed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_completed"))
    # Decimal sums do not depend on the order in which partitions arrive.
    elapsed = completed.select(
        *keys, F.explode("stage_elapsed_seconds").alias("stage", "_value")
    ).withColumn("_value", F.greatest(F.coalesce("_value", F.lit(0.0)), F.lit(0.0)).cast("decimal(28,6)"))
    sums = elapsed.groupBy(*keys, "stage").agg(
        F.sum("_value").cast("double").alias("_total"), F.max("_value").cast("double").alias("_max")
    )
    return sums.join(sizes, list(keys)).select(
        *keys,
        "stage",
        round_to(F.col("_total"), 3).alias("total_wall_seconds"),
        round_to(F.col("_total") / F.col("_completed"), 3).alias("average_wall_seconds"),
        round_to(F.col("_max"), 3).alias("max_wall_seconds"),
    )


def run_performance(runs: DataFrame, items: DataFrame, key: str = "run_id") -> DataFrame:
    """One performance document per run: counts, durations, throughput and the stage map.

    ``runs`` has the run id, ``compute_mode`` and ``run_wall_seconds``.
    """
    stages = (
        stage_performance(items, [key])
        .groupBy(key)
        .agg(
            F.map_from_entries(
                F.array_sort(
                    F.collect_list(
                        F.struct(
                            "stage",
                            F.struct("total_wall_seconds", "average_wall_seconds", "max_wall_seconds").alias("times"),
                        )
                    )
                )
            ).alias("stages")
        )
    )
    counts = item_counts(items, [key])
    wall = F.greatest(F.coalesce("run_wall_seconds", F.lit(0.0)), F.lit(0.0))
    return (
        runs.join(counts, key, "left")
        .join(stages, key, "left")
        .select(
            key,
            F.lit(1).alias("schema_version"),
            "compute_mode",
            F.struct(
                _zero("items_total").alias("total"),
                _zero("items_completed").alias("completed"),
                _zero("items_skipped").alias("skipped"),
                _zero("items_failed").alias("failed"),
            ).alias("item_counts"),
            F.struct(
                round_to(_zero("total_audio"), 3).alias("total_audio"),
                round_to(_zero("processed_audio"), 3).alias("processed_audio"),
                round_to(_zero("completed_audio"), 3).alias("completed_audio"),
                round_to(wall, 3).alias("run_wall"),
            ).alias("duration_seconds"),
            F.struct(
                throughput(_zero("completed_audio"), wall).alias("completed_audio_seconds_per_wall_second")
            ).alias("throughput"),
            "stages",
        )
    )


def run_outcome(items: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """State of finished runs: failed when any item failed, else completed."""
    state = F.lower("status")
    return items.groupBy(*keys).agg(
        F.when(F.max((state == "failed").cast("int")) == 1, "failed").otherwise("completed").alias("state"),
        F.count_if(state == "completed").alias("processed_count"),
        F.count_if(state.startswith("skipped")).alias("skipped_count"),
        F.count_if(state == "failed").alias("error_count"),
    )


def run_warnings(preflight: DataFrame, item_warnings: DataFrame, key: str = "run_id") -> DataFrame:
    """Warnings of a run as rows in order: preflight texts by status, then ``name: warning`` by item and position.

    ``preflight`` is the output of ``skip_counts`` by run; ``item_warnings`` has ``item_pos``, ``warning_pos``,
    ``display_name`` and ``warning``. Rows, not an array: a run may have any number of items.
    """
    first = preflight.filter("warning is not null").select(
        key, F.lit(0).alias("part"), F.col("status").alias("part_key"),
        F.lit(0).cast("bigint").alias("item_pos"), F.lit(0).cast("bigint").alias("warning_pos"), "warning",
    )
    second = item_warnings.select(
        key,
        F.lit(1).alias("part"),
        F.lit("").alias("part_key"),
        F.col("item_pos").cast("bigint").alias("item_pos"),
        F.col("warning_pos").cast("bigint").alias("warning_pos"),
        F.concat("display_name", F.lit(": "), "warning").alias("warning"),
    )
    return first.unionByName(second)


def stage_durations(
    events: DataFrame,
    ends: DataFrame | None = None,
    key: str = "item_id",
    position: str = "event_pos",
    at: str = "at",
    stage: str = "stage",
) -> DataFrame:
    """Time per item and stage from stage-change events; repeats of a stage add up.

    A stage lasts until the next event; the last one until the item's end (``ends`` with the key and ``ended_at``),
    or for no time when that is unknown.
    """
    binned = even_bins(events.select(key, position, F.col(at).alias("_at"), F.col(stage).alias("_stage")), [key], position)
    stepped = running(binned, [key], "_bin", [position], _before=Running("last", F.struct("_at", "_stage")))
    inner = stepped.filter(F.col("_before").isNotNull()).select(
        key, F.col("_before._stage").alias(stage), (F.col("_at") - F.col("_before._at")).alias("_elapsed")
    )
    last = binned.groupBy(key).agg(F.max_by(F.struct("_at", "_stage"), F.col(position)).alias("_last"))
    if ends is None:
        tail = last.select(key, F.col("_last._stage").alias(stage), (F.col("_last._at") * 0).alias("_elapsed"))
    else:
        tail = last.join(ends, key).select(
            key, F.col("_last._stage").alias(stage), (F.col("ended_at") - F.col("_last._at")).alias("_elapsed")
        )
    return (
        inner.unionByName(tail)
        .withColumn("_elapsed", F.greatest("_elapsed", F.lit(0)))
        .groupBy(key, stage)
        .agg(F.sum("_elapsed").alias("elapsed"))
    )


def stage_maps(durations: DataFrame, key: str = "item_id", stage: str = "stage") -> DataFrame:
    """One map per item; the number of stages is small and fixed."""
    entry = F.struct(F.col(stage), F.col("elapsed"))
    return durations.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("stage_elapsed_seconds")
    )


def with_progress(status: DataFrame) -> DataFrame:
    """Adds ``progress_percent`` to run status rows."""
    return status.withColumn(
        "progress_percent",
        overall_percent(
            stage=F.col("current_stage"),
            stage_elapsed=F.col("current_stage_elapsed_sec"),
            item_duration=F.col("current_item_duration_sec"),
            compute_mode=F.col("compute_mode"),
            processed=F.col("processed_duration_sec"),
            total=F.col("total_duration_sec"),
            completed_items=F.col("completed_items"),
            total_items=F.col("total_items"),
            preflight_fraction=F.col("preflight_fraction"),
        ),
    )


def _view(runs: DataFrame) -> list[Column]:
    state = job_state(F.col("state"))
    percent = F.coalesce(
        F.nullif(F.col("progress_percent"), F.lit(0.0)),
        F.when(state.isin(*DONE_STATES), F.lit(100.0)).otherwise(F.lit(0.0)),
    )
    return [
        F.col("run_id").alias("job_id"),
        state.alias("state"),
        F.coalesce("current_stage", F.lit("")).alias("stage"),
        F.coalesce("message", F.lit("")).alias("message"),
        round_to(F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent)), 2).alias("percent"),
        (_zero("items_done") + _zero("items_skipped") + _zero("items_failed")).alias("current"),
        _zero("items_total").alias("total"),
        F.when(state.isin(*ERROR_STATES), F.coalesce("message", F.lit(""))).alias("error"),
    ]


def job_view(runs: DataFrame) -> DataFrame:
    """What a caller sees of a run: state vocabulary, clamped percentage, counts and error text."""
    return runs.select(*_view(runs))


def job_payload(runs: DataFrame) -> DataFrame:
    """``job_view`` with the item in work, the remaining seconds, the times and the warnings of each run.

    Texts that are missing are empty, a missing list of warnings has none; the remaining seconds stay null when unknown.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    empty = F.array().cast("array<string>")
    return runs.select(
        *_view(runs),
        text("current_item"),
        F.col("estimated_remaining_sec").cast("double").alias("estimated_remaining_sec"),
        text("started_at"),
        text("updated_at"),
        text("completed_at"),
        F.coalesce("warnings", empty).alias("warnings"),
    )


def active_run(runs: DataFrame, order: str = "run_name") -> DataFrame:
    """The newest run that is pending or running."""
    return runs.filter(lowered(F.col("state")).isin("pending", "running")).orderBy(F.desc(order)).limit(1)


def runs_in_state(
    runs: DataFrame, states: Sequence[str], marked: DataFrame | None = None, order: str = "run_dir"
) -> DataFrame:
    """Runs in any of the states (without case), without those marked for deletion, by folder name."""
    chosen = runs.filter(lowered(F.col("state")).isin(*[state.lower() for state in states]))
    if marked is not None:
        chosen = chosen.join(marked.select("run_id"), "run_id", "left_anti")
    return chosen.orderBy(order)


def next_run(pending: DataFrame, inputs: DataFrame, existing: DataFrame, order: str = "run_dir") -> DataFrame:
    """First pending run whose inputs all exist. ``inputs`` has ``run_id`` and ``path``."""
    incomplete = inputs.join(existing.select("path"), "path", "left_anti").select("run_id")
    return pending.join(incomplete, "run_id", "left_anti").orderBy(order).limit(1)


def classify_stale(runs: DataFrame, as_of: Column, limit_seconds: int = STALE_SECONDS) -> DataFrame:
    """Adds ``stale`` and the state after recovery.

    A running run ages by its last update (or start); when it has neither, and for other states, the lock time counts.
    Times are epoch seconds; a run without a lock is never stale, but a running one without a lock is interrupted.
    """
    is_running = lowered(F.col("state")) == "running"
    seen = F.when(is_running, F.coalesce("updated_at", "started_at", "locked_at")).otherwise(F.col("locked_at"))
    stale = F.col("locked_at").isNotNull() & F.coalesce(as_of - seen > F.lit(limit_seconds), F.lit(False))
    interrupted = is_running & (stale | F.col("locked_at").isNull())
    return runs.select(
        *runs.columns,
        stale.alias("stale"),
        F.when(interrupted, "interrupted").otherwise(lowered(F.col("state"))).alias("state_now"),
        F.when(interrupted, F.lit(INTERRUPTED_MESSAGE)).alias("warning"),
    )

