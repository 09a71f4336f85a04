"""Run folders: request, status and manifest documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnweave.sources.files import paths_matching, qualified

REQUEST_SCHEMA = (
    "run_id string, created_at string, output_root_path string, compute_mode string, conversion_signature string, "
    "generation_signature string, vad_profile string, reprocess_duplicates boolean, "
    "input_items array<struct<input_id:string, original_path:string, display_name:string, size_bytes:bigint, "
    "source_id:string, source_relative_path:string, source_file_identity:string>>"
)
STATUS_SCHEMA = (
    "state string, current_stage string, message string, items_total bigint, items_done bigint, items_skipped bigint, "
    "items_failed bigint, videos_total bigint, videos_done bigint, videos_skipped bigint, videos_failed bigint, "
    "processed_duration_sec double, total_duration_sec double, progress_percent double, started_at string, "
    "updated_at string, completed_at string, current_item string, estimated_remaining_sec double, "
    "current_item_elapsed_sec double, current_stage_elapsed_sec double, warnings array<string>"
)
MANIFEST_SCHEMA = (
    "items array<struct<input_id:string, file_name:string, size_bytes:bigint, duration_seconds:double, "
    "source_hash:string, sha256:string, conversion_signature:string, duplicate_status:string, audio_id:string, "
    "media_id:string, status:string, container_name:string, audio_codec:string, audio_channels:bigint, "
    "audio_sample_rate:bigint, bitrate:bigint, processing_wall_seconds:double, "
    "stage_elapsed_seconds:map<string,double>, source_file_identity:string>>"
)


def _documents(spark: SparkSession, parents: Sequence[str], file: str, schema: str) -> DataFrame:
    # Only the parents are looked up on the driver; the reader lists the run folders below them.
    present = paths_matching(spark, parents)
    below = [qualified(spark, parent) for parent in present]
    folder = F.regexp_extract(
        F.regexp_replace(F.url_decode("_metadata.file_path"), r"^file:/+", "/"), r"^(.*)/[^/]+$", 1
    )
    if not present:
        return spark.createDataFrame([], f"run_dir string, {schema}")
    return (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", file)
        .json(list(present))
        .select(folder.alias("run_dir"), "*")
        .filter(
            F.regexp_extract("run_dir", r"^(.*)/[^/]+$", 1).isin(*below) & F.regexp_extract("run_dir", r"([^/]+)$", 1).startswith("run-")
        )
        .dropDuplicates(["run_dir"])
    )


def distinct_run_dirs(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Run folders found below several parents, each once (a trailing slash does not matter), with their names."""
    found = first.select("run_dir")
    for other in others:
        found = found.unionByName(other.select("run_dir"))
    return (
        found.select(F.regexp_replace("run_dir", "/+$", "").alias("run_dir"))
        .distinct()
        .withColumn("run_name", F.regexp_extract("run_dir", r"([^/]+)$", 1))
    )


def read_runs(spark: SparkSession, parents: Sequence[str]) -> DataFrame:
    """One row per run folder with request and status below any of the parents."""
    return assemble_runs(
        _documents(spark, parents, "request.json", REQUEST_SCHEMA),
        _documents(spark, parents, "status.json", STATUS_SCHEMA),
        _documents(spark, parents, "manifest.json", MANIFEST_SCHEMA),
    )


def assemble_runs(request: DataFrame, status: DataFrame, manifest: DataFrame) -> DataFrame:
    """Join the three documents of each run by ``run_dir``; ``items`` is empty without a manifest.

    Newest run first is ``run_name`` descending.
    """
    old = {"items_total": "videos_total", "items_done": "videos_done", "items_skipped": "videos_skipped",
           "items_failed": "videos_failed"}
    name = F.regexp_extract("run_dir", r"([^/]+)$", 1)
    zero = F.lit(0).cast("bigint")
    joined = request.withColumnRenamed("run_id", "_run_id").join(status, "run_dir").join(manifest, "run_dir", "left")
    return joined.select(
        F.coalesce("_run_id", name).alias("run_id"),
        "run_dir",
        name.alias("run_name"),
        F.coalesce("state", F.lit("unknown")).alias("state"),
        F.coalesce("current_stage", F.lit("")).alias("current_stage"),
        "message",
        *[F.coalesce(new, legacy, zero).alias(new) for new, legacy in old.items()],
        "processed_duration_sec",
        "total_duration_sec",
        "progress_percent",
        "started_at",
        "updated_at",
        "completed_at",
        "current_item",
        "estimated_remaining_sec",
        "current_item_elapsed_sec",
        "current_stage_elapsed_sec",
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
        "created_at",
        "compute_mode",
        F.coalesce("generation_signature", "conversion_signature").alias("conversion_signature"),
        F.coalesce("items", F.array().cast(manifest.schema["items"].dataType)).alias("items"),
        F.coalesce("input_items", F.array().cast(request.schema["input_items"].dataType)).alias("input_items"),
    )


def input_items(runs: DataFrame) -> DataFrame:
    """One row per file that a run was asked to process, with its place in the request."""
    rows = runs.select("run_id", "run_dir", F.posexplode("input_items").alias("item_pos", "_item"))
    return rows.select("run_id", "run_dir", "item_pos", "_item.*")


def manifest_items(runs: DataFrame) -> DataFrame:
    """One row per manifest item with its run and position."""
    rows = runs.select(
        "run_id", "run_dir", "run_name", F.col("state").alias("run_state"), "compute_mode",
        F.posexplode("items").alias("item_pos", "_item"),
    )
    return rows.select(
        "run_id", "run_dir", "run_name", "run_state", "compute_mode", "item_pos", "_item.*"
    ).withColumn("source_hash", F.coalesce("source_hash", "sha256")).withColumn(
        "audio_id", F.coalesce("audio_id", "media_id")
    ).drop("sha256", "media_id")


def history_samples(items: DataFrame, current_run_id: str | None = None) -> DataFrame:
    """Past items as forecast samples, in run and manifest order, without the current run."""
    past = items if current_run_id is None else items.filter(F.col("run_name") != current_run_id)
    return past.select(
        F.struct("run_dir", "item_pos").alias("sample_pos"),
        "compute_mode",
        "audio_codec",
        "container_name",
        "audio_channels",
        "audio_sample_rate",
        "bitrate",
        "duration_seconds",
        F.col("processing_wall_seconds").alias("wall_seconds"),
        F.col("stage_elapsed_seconds").alias("stage_seconds"),
        "status",
    )
