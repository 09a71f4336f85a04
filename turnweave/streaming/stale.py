"""Interrupted runs on streams of progress updates and lock times."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def closed_sessions(
    updates: DataFrame, delay: str, key: str = "run_id", at: str = "updated_at", gap: str = "30 seconds"
) -> DataFrame:
    """One row per stretch of updates that ended: no update of the run for ``gap``, as the watermark shows.

    A closed stretch of a running run means that it was interrupted. Updates that
    come more than ``delay`` behind the latest one are dropped, so it has to cover how far updates get out of order.
    """
    sessions = updates.withWatermark(at, delay).groupBy(key, F.session_window(at, gap).alias("session"))
    return sessions.agg(F.count(F.lit(1)).alias("updates")).select(
        key, F.col("session.start").alias("first_update"), F.col("session.end").alias("interrupted_at"), "updates"
    )


def silent_runs(
    locks: DataFrame,
    updates: DataFrame,
    delay: str,
    key: str = "run_id",
    locked_at: str = "locked_at",
    updated_at: str = "updated_at",
    gap: str = "30 seconds",
) -> DataFrame:
    """Runs that were locked and then gave no update for ``gap``: a run that never reports is found too.

    A left outer join of two streams: a lock waits for the first update of its run within ``gap``, and comes out alone when the
    watermarks of both streams have passed that time. Rows more than ``delay`` behind the latest of their own stream are
    dropped. ``closed_sessions`` finds runs that fall silent after an update.
    """
    left = locks.select(key, locked_at).withWatermark(locked_at, delay)
    right = updates.select(F.col(key).alias("_run"), updated_at).withWatermark(updated_at, delay)
    until = F.col(locked_at) + F.expr(f"interval {gap}")
    within = (F.col(key) == F.col("_run")) & (F.col(updated_at) >= F.col(locked_at)) & (F.col(updated_at) <= until)
    return left.join(right, within, "leftOuter").filter("_run is null").select(key, locked_at, until.alias("interrupted_at"))
