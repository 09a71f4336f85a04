"""Finished items: listing, selection, removal and artifact locations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnweave.functions.numbers import round_to
from turnweave.functions.text import file_name, non_blank, strip


def newest_first(*names: str) -> list[Column]:
    """Descending text order; ISO times are compared as text."""
    return [F.desc(F.coalesce(F.col(name), F.lit(""))) for name in names]


def requested_ids(spark: SparkSession, ids: Sequence[str]) -> DataFrame:
    """One row per distinct non-blank id (without case), keeping the last spelling."""
    spelled = {value.strip().lower(): value for value in ids if value.strip()}
    if not spelled:
        raise ValueError("At least one item id is required.")
    return spark.createDataFrame(list(spelled.items()), "id_key string, requested_id string")


def _id_key(name: str) -> Column:
    return F.lower(strip(F.col(name)))


def select_items(items: DataFrame, requested: DataFrame, item: str = "item_id") -> DataFrame:
    """Items whose id was requested."""
    return items.withColumn("id_key", _id_key(item)).join(requested, "id_key", "left_semi").drop("id_key")


def missing_ids(requested: DataFrame, items: DataFrame, item: str = "item_id") -> DataFrame:
    """Requested ids that match no item."""
    known = items.select(_id_key(item).alias("id_key"))
    return requested.join(known, "id_key", "left_anti").select("requested_id")


def remaining_items(items: DataFrame, requested: DataFrame, item: str = "item_id") -> DataFrame:
    """Items left after removing the requested ones."""
    return items.withColumn("id_key", _id_key(item)).join(requested, "id_key", "left_anti").drop("id_key")


def folder_is_safe(
    folder: Column, output_root: str, reserved: Sequence[str] = (), run_dir: Column | None = None
) -> Column:
    """Whether a folder lies strictly below the output root, in no reserved subfolder, and is not the folder that holds
    all media of a run."""
    root = output_root.rstrip("/")
    path = F.regexp_replace(folder, "/+$", "")
    parts = F.split(path, "/")
    climbs = F.array_contains(parts, "..")
    kept_out = F.arrays_overlap(parts, F.array(*[F.lit(name) for name in reserved])) if reserved else F.lit(False)
    whole_run = F.lit(False)
    if run_dir is not None:
        whole_run = F.coalesce(path == F.concat(F.regexp_replace(run_dir, "/+$", ""), F.lit("/media")), F.lit(False))
    below = F.startswith(path, F.lit(f"{root}/"))
    return F.coalesce(below & ~climbs & ~kept_out & ~whole_run, F.lit(False))


def plan_removal(
    items: DataFrame,
    requested: DataFrame,
    output_root: str,
    reserved: Sequence[str],
    dry_run: bool = False,
    folder: str = "item_dir",
    media: str = "audio_id",
) -> DataFrame:
    """Rows that a removal takes out, with ``folder_safe`` and ``remove_folder`` (never on a dry run).

    ``reserved`` names the folders below the output root that hold no items. An item without a folder of its own has the
    one below its run, ``<run_dir>/media/<media>``, where the table has these columns.
    """
    run_dir = F.col("run_dir") if "run_dir" in items.columns else None
    place = F.col(folder)
    if run_dir is not None and media in items.columns:
        below_run = F.concat(F.regexp_replace(run_dir, "/+$", ""), F.lit("/media/"), strip(F.col(media)))
        place = F.coalesce(non_blank(place), below_run)
    chosen = select_items(items, requested).withColumn(folder, place)
    safe = folder_is_safe(F.col(folder), output_root, reserved, run_dir)
    return chosen.select(
        *items.columns,
        safe.alias("folder_safe"),
        (safe & F.lit(not dry_run)).alias("remove_folder"),
        F.lit(dry_run).alias("dry_run"),
    )


def removal_summary(planned: DataFrame, folder: str = "item_dir") -> DataFrame:
    """One row of counts over a removal plan."""
    return planned.agg(
        F.count_distinct(_id_key("item_id")).alias("matched_count"),
        F.count(F.lit(1)).alias("catalog_rows_removed"),
        F.count_distinct(F.when(F.col("remove_folder"), F.col(folder))).alias("media_dirs_removed"),
        F.count_if(~F.col("folder_safe") & F.col(folder).isNotNull()).alias("unsafe_media_dirs"),
    )


def artifact_location(
    catalog: DataFrame,
    existing: DataFrame,
    columns: Sequence[str] = ("timeline_path", "artifact_path"),
    file: str = "timeline.json",
    row_id: str = "catalog_pos",
) -> DataFrame:
    """Adds ``artifact_found``: the first existing candidate among the path columns, the item folder and the run's
    media folder."""
    text = lambda name: (
        non_blank(F.col(name)) if name in catalog.columns else F.lit(None).cast("string")
    )
    join = lambda *parts: F.array_join(
        F.when(parts[0].isNotNull() & parts[-2].isNotNull(), F.array(*parts)), "/"
    )
    candidates = F.array(
        *[text(name) for name in columns],
        join(text("item_dir"), F.lit(file)),
        join(text("run_dir"), F.lit("media"), text("audio_id"), F.lit(file)),
    )
    offered = catalog.select(row_id, F.posexplode(candidates).alias("_nth", "path")).filter("path is not null")
    found = (
        offered.join(existing.select("path").distinct(), "path", "left_semi")
        .groupBy(row_id)
        .agg(F.min_by("path", "_nth").alias("artifact_found"))
    )
    return catalog.join(found, row_id, "left")


def item_updated_at(timeline_time: Column, info_time: Column, updated_at: Column, created_at: Column) -> Column:
    """Latest file time as ISO text, else the row's own times."""
    return F.coalesce(
        F.greatest(timeline_time, info_time), non_blank(updated_at), non_blank(created_at), F.lit("")
    )


def item_list(
    catalog: DataFrame, source_info: DataFrame, summaries: DataFrame, key: str = "item_id"
) -> DataFrame:
    """One row per catalog item with display name, duration, status and timeline counts.

    ``source_info`` has ``display_name`` and ``original_path`` per item, ``summaries`` ``turn_count`` and
    ``speaker_count``.
    """
    joined = catalog.join(source_info, key, "left").join(summaries, key, "left")
    name = F.coalesce(
        non_blank(F.col("display_name")),
        F.nullif(file_name(F.coalesce("source_relative_path", F.lit(""))), F.lit("")),
        F.nullif(file_name(F.coalesce("original_path", F.lit(""))), F.lit("")),
        F.col("audio_id"),
    )
    zero = F.lit(0)
    return joined.select(
        key,
        F.col("audio_id").alias("media_id"),
        "source_file_identity",
        name.alias("source_file_name"),
        "source_hash",
        "conversion_signature",
        F.nullif(F.col("duration_seconds"), F.lit(0.0)).alias("duration_sec"),
        "created_at",
        "updated_at",
        F.when(F.col("artifact_path").isNotNull(), "available").otherwise("missing_artifact").alias("status"),
        F.coalesce("artifact_path", F.lit("")).alias("artifact_path"),
        F.coalesce("turn_count", zero).cast("bigint").alias("turn_count"),
        F.coalesce("speaker_count", zero).cast("bigint").alias("speaker_count"),
    )


def with_duration(items: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """``duration_sec``: the catalog value, else the probed one, 3 decimals; 0 and junk count as missing."""
    known = F.nullif(F.col("duration_seconds").cast("string").try_cast("double"), F.lit(0.0))
    probed = F.nullif(F.col("probe_seconds"), F.lit(0.0))
    return items.join(probes.select(key, "probe_seconds"), key, "left").withColumn(
        "duration_sec", round_to(F.coalesce(known, probed), 3)
    ).drop("probe_seconds")


def export_items(items: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items to export with their place in the package, and the requested ids without an item."""
    chosen = select_items(items, requested)
    manifest = chosen.filter("status = 'available'").withColumn(
        "package_path", F.concat(F.lit("timeline/items/item_id="), F.col("item_id"))
    )
    return manifest, missing_ids(requested, items)

