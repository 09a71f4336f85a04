"""Whole lists: finished items, audio files, and what a caller sees of them, from catalog, file times and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from turnweave.functions.numbers import round_to
from turnweave.functions.text import directory, display_path, file_name, non_blank
from turnweave.operators.catalog import with_item_ids
from turnweave.operators.items import artifact_location, folder_is_safe, item_updated_at


def _text(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _joined(rows: DataFrame, key: Column, other: DataFrame, on: str, position: str, **columns: Column) -> DataFrame:
    """``rows`` with columns of the one row of ``other`` whose ``on`` equals ``key``; rows without a key stay spread."""
    own = F.concat(F.lit("\u0000"), F.xxhash64(position).cast("string"))
    side = other.select(F.col(on).alias("_key"), *[value.alias(name) for name, value in columns.items()])
    return rows.withColumn("_key", F.coalesce(key, own)).join(side, "_key", "left").drop("_key")


def media_folder(rows: DataFrame, output_root: str, reserved: Sequence[str] = ()) -> Column:
    """The folder of an item, its own or the one below its run, where it is safe; null elsewhere."""
    run_dir, media = non_blank(_text(rows, "run_dir")), non_blank(_text(rows, "audio_id"))
    below_run = F.concat(F.regexp_replace(run_dir, "/+$", ""), F.lit("/media/"), media)
    place = F.coalesce(non_blank(_text(rows, "item_dir")), below_run)
    return F.when(folder_is_safe(place, output_root, reserved, run_dir), F.regexp_replace(place, "/+$", ""))


def list_items(
    catalog: DataFrame,
    files: DataFrame,
    output_root: str,
    summaries: DataFrame | None = None,
    source_info: DataFrame | None = None,
    reserved: Sequence[str] = (),
    position: str = "catalog_pos",
) -> DataFrame:
    """One row per catalog row with everything a list of finished items shows.

    ``files`` are the documents that exist (``path``, ``modified_at`` as ISO text), ``summaries`` turn and speaker counts by
    ``artifact_path``, ``source_info`` ``display_name`` and ``original_path`` by ``media_dir``. The artifact is the first
    candidate that exists; an item without one is ``missing_artifact``. Order by ``newest_first("updated_at", "created_at",
    "item_id")``. The time of the folder itself is not read.
    """
    rows = catalog if "item_id" in catalog.columns else with_item_ids(catalog)
    rows = artifact_location(rows, files, row_id=position).withColumn("_media_dir", media_folder(rows, output_root, reserved))
    found = F.col("artifact_found")
    rows = _joined(rows, found, files, "path", position, _line_time=F.col("modified_at"))
    info_path = F.concat("_media_dir", F.lit("/convert_info.json"))
    rows = _joined(rows, info_path, files, "path", position, _info_time=F.col("modified_at"))
    nothing = F.lit(None).cast("string")
    if source_info is None:
        rows = rows.withColumn("_name", nothing).withColumn("_original", nothing)
    else:
        rows = _joined(rows, F.col("_media_dir"), source_info, "media_dir", position, _name=F.col("display_name"), _original=F.col("original_path"))
    if summaries is None:
        rows = rows.withColumn("_turns", F.lit(0)).withColumn("_speakers", F.lit(0))
    else:
        rows = _joined(rows, found, summaries, "artifact_path", position, _turns=F.col("turn_count"), _speakers=F.col("speaker_count"))
    relative = F.coalesce(_text(rows, "source_relative_path"), F.lit(""))
    media = F.coalesce(_text(rows, "audio_id"), F.lit(""))
    name = F.coalesce(
        non_blank(F.col("_name")),
        F.nullif(file_name(relative), F.lit("")),
        F.nullif(file_name(F.coalesce("_original", F.lit(""))), F.lit("")),
        media,
    )
    duration = F.col("duration_seconds").cast("double") if "duration_seconds" in rows.columns else F.lit(None).cast("double")
    return rows.select(
        position,
        "item_id",
        media.alias("media_id"),
        _text(rows, "run_id").alias("run_id"),
        _text(rows, "run_dir").alias("run_dir"),
        _text(rows, "source_id").alias("source_id"),
        relative.alias("source_relative_path"),
        "source_file_identity",
        name.alias("source_file_name"),
        "source_hash",
        "conversion_signature",
        F.nullif(duration, F.lit(0.0)).alias("duration_sec"),
        F.coalesce(_text(rows, "created_at"), F.lit("")).alias("created_at"),
        item_updated_at(F.col("_line_time"), F.col("_info_time"), _text(rows, "updated_at"), _text(rows, "created_at")).alias("updated_at"),
        F.when(found.isNotNull(), "available").otherwise("missing_artifact").alias("status"),
        F.coalesce(found, F.lit("")).alias("artifact_path"),
        F.coalesce("_media_dir", F.lit("")).alias("media_dir"),
        F.coalesce("_turns", F.lit(0)).cast("bigint").alias("turn_count"),
        F.coalesce("_speakers", F.lit(0)).cast("bigint").alias("speaker_count"),
    )


def list_files(
    files: DataFrame,
    roots: DataFrame,
    summaries: DataFrame | None = None,
    probes: DataFrame | None = None,
    position: str = "path",
) -> DataFrame:
    """One row per audio file with its place, status and timeline.

    ``files`` is the result of ``file_status`` over ``discover_files`` (with ``modified_at`` as ISO text), ``roots`` the
    configured ``source_id`` and ``root_path`` as their owner wrote it, ``summaries`` turn and speaker counts by ``media_id``,
    ``probes`` ``probe_seconds`` by ``path`` for files whose duration is unknown. Order by ``newest_first("modified_at",
    "source_file_identity")``.
    """
    root = roots.select(F.lower("source_id").alias("_root"), F.col("root_path").alias("_given")).dropDuplicates(["_root"])
    # The roots are a short configured list; the optimizer sends them to the files where their size allows.
    rows = files.withColumn("_root", F.lower("source_id")).join(root, "_root", "left")
    media = F.nullif(F.coalesce(_text(rows, "media_id"), F.lit("")), F.lit(""))
    if summaries is None:
        rows = rows.withColumn("_turns", F.lit(None).cast("bigint")).withColumn("_speakers", F.lit(None).cast("bigint"))
    else:
        rows = _joined(rows, media, summaries, "media_id", position, _turns=F.col("turn_count"), _speakers=F.col("speaker_count"))
    known = F.col("duration_sec") if "duration_sec" in rows.columns else F.lit(None).cast("double")
    if probes is not None:
        rows = _joined(rows, F.col("path"), probes, "path", position, _probed=F.col("probe_seconds"))
        known = F.coalesce(known, round_to(F.nullif(F.col("_probed"), F.lit(0.0)), 3))
    relative, given = F.col("relative_path"), F.coalesce("_given", F.lit(""))
    source = F.coalesce("source_id", F.lit(""))
    return rows.select(
        source.alias("source_id"),
        F.coalesce(F.nullif(source, F.lit("")), F.lit("Audio")).alias("source_display_name"),
        given.alias("root_path"),
        relative.alias("relative_path"),
        directory(relative).alias("directory"),
        file_name(F.col("path")).alias("file_name"),
        display_path(given, relative, F.col("path")).alias("display_path"),
        F.col("path").alias("container_path"),
        "size_bytes",
        "modified_at",
        known.alias("duration_sec"),
        "status",
        F.coalesce(_text(rows, "run_id"), F.lit("")).alias("run_id"),
        F.coalesce(_text(rows, "media_id"), F.lit("")).alias("media_id"),
        F.col("_turns").isNotNull().alias("has_timeline"),
        F.lit(False).alias("has_audio"),
        F.coalesce("_turns", F.lit(0)).cast("bigint").alias("turn_count"),
        F.coalesce("_speakers", F.lit(0)).cast("bigint").alias("speaker_count"),
        "source_file_identity",
    )
