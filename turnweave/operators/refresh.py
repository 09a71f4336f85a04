"""Refresh planning: which files to queue, skip or defer, and preflight classification of queued files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from turnweave.functions.text import extension, media_id, normalize_extensions
from turnweave.functions.vocabulary import MIN_DURATION_SECONDS, skip_warning
from turnweave.operators.catalog import look_up
from turnweave.operators.ordering import MOST_MERGED, first_rows, ranked
from turnweave.operators.running import Running, even_bins, running
from turnweave.session import stored


def plan_refresh(
    inventory: DataFrame,
    catalog: DataFrame,
    signature: str,
    reprocess: bool = False,
    limit: int | None = None,
    path: str = "path",
    position: str = "catalog_pos",
) -> DataFrame:
    """Every file with ``action`` (queued, skipped, deferred) and ``reason``.

    A file is skipped when its exact catalog row has its artifact (``unchanged``), or when there is no exact row and a
    row with another signature has one (``existing_artifact_reused``); a row whose artifact is gone is processed
    again. With a limit only the smallest files are queued; skipped files do not count against it.
    """
    found = look_up(inventory, catalog, signature, position)
    no_exact = F.col("exact").isNull()
    unchanged = ~no_exact & F.coalesce(F.col("exact.artifact_exists"), F.lit(False))
    reusable = no_exact & F.col("reusable").isNotNull()
    skipped = F.lit(False) if reprocess else unchanged | reusable
    hit = F.coalesce(F.col("exact"), F.col("reusable"))
    planned = found.select(
        *inventory.columns,
        F.when(skipped, "skipped").otherwise("queued").alias("action"),
        F.when(skipped & unchanged, "unchanged").when(skipped, "existing_artifact_reused").alias("reason"),
        F.when(skipped, hit.getField("audio_id")).alias("duplicate_of"),
        F.when(skipped, hit.getField("conversion_signature")).alias("existing_conversion_signature"),
        F.lit(signature).alias("requested_conversion_signature"),
    )
    if limit is None:
        return planned
    if limit <= 0:
        raise ValueError("max_items must be greater than 0.")
    order = _smallest_first(path)
    if limit > MOST_MERGED:
        queued = ranked(planned.filter("action = 'queued'"), order, "_rank").withColumn("_over", F.col("_rank") > limit)
        return planned.filter("action <> 'queued'").unionByName(_deferred(queued, planned.columns))
    # The last row within the limit tells of all others whether they are in, so they need no order.
    planned = stored(planned, "planned")
    key = F.struct(*[value.alias(f"k{n}") for n, value in enumerate(order)])
    queued = planned.filter("action = 'queued'").withColumn("_key", key)
    last = first_rows(queued.select("_key"), ["_key"], limit).agg(F.max("_key").alias("_last"), F.count(F.lit(1)).alias("_n"))
    found = last.first()
    if found["_n"] < limit:
        return planned
    placed = queued.withColumn("_last", _literal(found["_last"], queued.schema["_key"].dataType))
    before = placed.filter(F.col("_key") < F.col("_last")).count()
    # Rows that tie with it are counted one by one, so rows that share an identity, or have none, are too.
    ties = ranked(placed.filter(F.col("_key").eqNullSafe(F.col("_last"))), ["_key"], "_rank")
    ties = ties.withColumn("_over", F.col("_rank") > limit - before)
    others = placed.filter(~F.col("_key").eqNullSafe(F.col("_last"))).withColumn("_over", F.col("_key") > F.col("_last"))
    return planned.filter("action <> 'queued'").unionByName(_deferred(others, planned.columns)).unionByName(_deferred(ties, planned.columns))


def _literal(row, kind) -> Column:
    """A row that came to the driver as a struct again."""
    return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])


def _deferred(queued: DataFrame, columns: list[str]) -> DataFrame:
    over = F.col("_over")
    return queued.withColumn("action", F.when(over, "deferred").otherwise(F.col("action"))).withColumn(
        "reason", F.when(over, "batch_limit").otherwise(F.col("reason"))
    ).select(columns)


def _smallest_first(path: str) -> list[Column]:
    return [F.coalesce("size_bytes", F.lit(0)), F.lower(path), F.col("source_file_identity")]


def refresh_summary(plan: DataFrame) -> DataFrame:
    """One row: selected, queued, skipped and deferred files."""
    of = lambda name: F.count_if(F.col("action") == name)
    return plan.agg(
        F.count(F.lit(1)).alias("selected_count"),
        of("queued").alias("queued_count"),
        of("skipped").alias("skipped_count"),
        of("deferred").alias("deferred_count"),
    )


def refresh_report(
    plan: DataFrame, discovered: DataFrame, missing_roots: Sequence[str], signature: str, limit: int | None = None
) -> DataFrame:
    """``refresh_summary`` with what was found before roots were chosen: all discovered files, the roots that do not exist, the
    limit and the signature that was asked for."""
    missing = F.array(*[F.lit(root) for root in missing_roots]).cast("array<string>")
    counts = ("selected_count", "queued_count", "skipped_count", "deferred_count")
    found = discovered.agg(F.count(F.lit(1)).alias("total_discovered"))
    both = found.unionByName(refresh_summary(plan), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("total_discovered", *counts)]).select(
        "total_discovered",
        missing.alias("missing_sources"),
        *counts,
        F.lit(limit).cast("bigint").alias("queued_limit"),
        F.lit(signature).alias("generation_signature"),
        F.lit("timeline").alias("artifact"),
    )


def work_list(plan: DataFrame, path: str = "path", prefix: str = "ref", limited: bool = False) -> DataFrame:
    """Queued files with running ids ``ref-0001``, ``ref-0002``, ... in path order, or smallest first as a limited plan
    chose them."""
    queued = plan.filter("action = 'queued'")
    order = _smallest_first(path) if limited else [F.lower(path), F.col("source_file_identity")]
    return ranked(queued, order, "_n").withColumn(
        "input_id", F.format_string(f"{prefix}-%04d", F.col("_n"))
    ).drop("_n")


def collect_inputs(
    offered: DataFrame, extensions: Sequence[str] | None = None, path: str = "path", position: str = "offer_pos"
) -> DataFrame:
    """Files, folder contents and root contents offered for one run: distinct by path without case (first offer
    wins), disallowed extensions dropped, numbered per offer order as ``kind[:4]-0001``.

    ``offered`` has ``source_kind``, ``source_id``, the path and a unique offer position.
    """
    allowed = normalize_extensions(extensions)
    kept = offered.filter(extension(F.col(path)).isin(*allowed))
    firsts = (
        kept.groupBy(F.lower(path).alias("_key"))
        .agg(F.min_by(F.struct(*offered.columns), F.col(position)).alias("_row"))
        .select("_row.*")
    )
    counted = ranked(firsts, [F.col(position)], "_n")
    return counted.withColumn(
        "input_id", F.format_string("%s-%04d", F.substring("source_kind", 1, 4), F.col("_n"))
    ).drop("_n")


def require_found(offered: DataFrame, existing: DataFrame, path: str = "path") -> DataFrame:
    """``offered`` with a check that fails on the first path that does not exist."""
    known = existing.select(F.col(path), F.lit(True).alias("_known")).distinct()
    missing = F.raise_error(F.concat(F.lit("Input file was not found: "), F.col(path))).cast("boolean")
    return offered.join(known, path, "left").filter(F.coalesce(F.col("_known"), missing)).drop("_known")


def classify_inputs(
    inputs: DataFrame,
    catalog: DataFrame,
    signature: str,
    reprocess: bool = False,
    readable: str = "readable",
    duration: str = "duration_seconds",
    position: str = "catalog_pos",
    minimum: float = MIN_DURATION_SECONDS,
) -> DataFrame:
    """Preflight: ``status`` skipped_invalid, skipped_too_short or queued, and for queued files whether they are new,
    a duplicate to skip or a duplicate to process again."""
    found = look_up(inputs, catalog, signature, position)
    invalid = ~F.coalesce(F.col(readable), F.lit(False))
    short = F.coalesce(F.col(duration), F.lit(0)) < F.lit(minimum)
    stored = ~invalid & ~short & F.coalesce(F.col("exact.artifact_exists"), F.lit(False))
    return found.select(
        *inputs.columns,
        F.when(invalid, "skipped_invalid").when(short, "skipped_too_short").otherwise("queued").alias("status"),
        F.when(stored, F.lit("duplicate_reprocess" if reprocess else "duplicate_skip"))
        .otherwise("new")
        .alias("duplicate_status"),
        F.when(stored, F.col("exact.audio_id")).alias("duplicate_of"),
    )


def with_media_ids(inputs: DataFrame) -> DataFrame:
    """Adds ``media_id`` from display name (or path), identity and hash."""
    return inputs.withColumn(
        "media_id",
        media_id(F.col("display_name"), F.col("path"), F.col("source_file_identity"), F.col("source_hash")),
    )


def skip_counts(classified: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Files left out per status with the warning text; order by status for the run's warning list."""
    counted = (
        classified.filter(F.col("status").isin("skipped_invalid", "skipped_too_short"))
        .groupBy(*keys, "status")
        .agg(F.count(F.lit(1)).alias("files"))
    )
    return counted.withColumn("warning", skip_warning(F.col("status"), F.col("files")))


def running_duration(
    items: DataFrame, key: str = "run_id", position: str = "item_pos", duration: str = "duration_seconds",
    done: Column | None = None,
) -> DataFrame:
    """Adds ``processed_duration``: durations of finished items up to and including each item of its run."""
    finished = F.lit(True) if done is None else done
    value = F.when(finished, F.col(duration)).otherwise(F.lit(0))
    binned = even_bins(items.withColumn("_value", value), [key], position)
    return running(
        binned, [key], "_bin", [position], processed_duration=Running("sum", F.col("_value"), inclusive=True)
    ).drop("_bin", "_value")
