"""Writers. Spark's commit protocol replaces temporary files and renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnweave.operators.ordering import ranked
from turnweave.operators.running import numbered
from turnweave.operators.timeline import PIECE, document_pieces
from turnweave.sources.item_folders import write_pieces


def _spread(documents: DataFrame, key: str) -> DataFrame:
    """Hash partitions of a fixed number, so that few bytes in many files are still written by many tasks."""
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return documents.repartition(partitions, key)


def run_pieces(work: DataFrame, output_root: str, created_at: str, settings: dict, run: str = "run_id") -> DataFrame:
    """The documents of new runs as pieces for ``item_folders``: request, status, result and an empty manifest.

    ``work`` holds the files of each run (``run_id``, ``input_id``, ``path``, ``file_name``, ``size_bytes``, ``source_id``,
    ``relative_path``, ``source_file_identity``). ``settings`` become fields of the request, after its own ones. A request lists its
    files in the order of their input ids, in pieces, so a run may have any number of them.
    """
    root = output_root.rstrip("/")
    counted = work.groupBy(F.col(run).alias("run_id")).agg(F.count(F.lit(1)).alias("items_total"))
    none, no_text = F.array().cast("array<string>"), F.lit(None).cast("string")
    options = {"ignoreNullFields": "false"}
    given = {name: F.lit(value) for name, value in settings.items()}
    request = F.struct(
        F.lit(1).alias("schema_version"), "run_id", F.lit(created_at).alias("created_at"), F.lit(root).alias("output_root_path"),
        *[value.alias(name) for name, value in given.items()],
    )
    status = F.struct(
        F.lit(1).alias("schema_version"), "run_id", F.lit("pending").alias("state"), F.lit("queued").alias("current_stage"),
        F.lit("Queued for worker pickup.").alias("message"), none.alias("warnings"), "items_total",
        *[F.lit(0).alias(c) for c in ("items_done", "items_skipped", "items_failed")], no_text.alias("current_item"),
        *[F.lit(0.0).alias(c) for c in ("current_item_elapsed_sec", "current_stage_elapsed_sec", "processed_duration_sec", "total_duration_sec")],
        F.lit(None).cast("double").alias("estimated_remaining_sec"), F.lit(0.0).alias("progress_percent"),
        no_text.alias("started_at"), F.lit(created_at).alias("updated_at"), no_text.alias("completed_at"),
    )
    result = F.struct(
        F.lit(1).alias("schema_version"), "run_id", F.lit("pending").alias("state"),
        F.concat(F.lit(f"{root}/"), "run_id").alias("run_dir"), F.lit(root).alias("output_root_path"),
        *[F.lit(0).alias(c) for c in ("processed_count", "skipped_count", "error_count", "batch_count")],
        no_text.alias("timeline_index_path"), none.alias("warnings"),
    )
    manifest = F.struct(
        F.lit(1).alias("schema_version"), "run_id", F.lit(created_at).alias("generated_at"), none.alias("items")
    )
    item = F.struct(
        "input_id", F.lit("configured_directory").alias("source_kind"), "source_id", F.col("path").alias("original_path"),
        F.col("file_name").alias("display_name"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), no_text.alias("uploaded_path"),
        F.col("relative_path").alias("source_relative_path"), "source_file_identity",
    )
    numbered_work = numbered(ranked(work.withColumnRenamed(run, "run_id"), ["run_id", "input_id"], "_order"), ["run_id"], "_order", "_nth")
    place = F.floor((F.col("_nth") - 1) / F.lit(PIECE)) + 1
    line = F.struct("_nth", F.to_json(item, options).alias("line"))
    grouped = numbered_work.select("run_id", place.alias("piece"), line.alias("line")).groupBy("run_id", "piece")
    lines = grouped.agg(F.array_join(F.array_sort(F.collect_list("line")).getField("line"), ",").alias("lines"))

    def piece(rows: DataFrame, document: str, at, text) -> DataFrame:
        return rows.select(F.col("run_id").alias("item_id"), F.lit(document).alias("document"), at.cast("bigint").alias("piece"), text.alias("text"))

    opened = F.concat(F.regexp_replace(F.to_json(request, options), r"\}$", ""), F.lit(',"input_items":['))
    comma = F.when(F.col("piece") > 1, ",").otherwise("")
    return (
        piece(counted, "request", F.lit(0), opened)
        .union(piece(lines, "request", F.col("piece"), F.concat(comma, "lines")))
        .union(piece(counted, "request", F.lit(2**62), F.lit("]}")))
        .union(piece(counted, "status", F.lit(0), F.to_json(status, options)))
        .union(piece(counted, "result", F.lit(0), F.to_json(result, options)))
        .union(piece(counted, "manifest", F.lit(0), F.to_json(manifest, options)))
    )


def write_runs(work: DataFrame, output_root: str, created_at: str, settings: dict) -> int:
    """Create the run folders of ``work`` below the output root; the number of documents."""
    return write_pieces(run_pieces(work, output_root, created_at, settings), output_root)


def write_documents(documents: DataFrame, folder: str, key: str = "media_id", per_item: bool = False) -> None:
    """Documents as JSON, one line each, with null fields written out.

    ``per_item`` gives every item its own folder (``item_id=<id>``) for readers that expect one; large collections are
    better off without, since every item then costs a folder and a file.
    """
    identified = documents.withColumn("item_id", F.col(key).cast("string"))
    if per_item:
        writer = _spread(identified, "item_id").write.partitionBy("item_id")
    else:
        writer = identified.write
    writer.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def append_catalog(rows: DataFrame, path: str) -> None:
    """Add catalog rows; earlier rows stay as they are."""
    rows.write.mode("append").parquet(path)


def catalog_rows(items: DataFrame, output_root: str, created_at) -> DataFrame:
    """Completed manifest items in catalog form."""
    folder = F.concat_ws("/", F.lit(output_root.rstrip("/")), F.col("audio_id"))
    return items.filter(F.lower("status") == "completed").select(
        "run_id",
        "run_dir",
        "audio_id",
        folder.alias("item_dir"),
        F.concat(folder, F.lit("/timeline.json")).alias("artifact_path"),
        F.concat(folder, F.lit("/convert_info.json")).alias("conversion_info_path"),
        "source_hash",
        "conversion_signature",
        "source_file_identity",
        "file_name",
        "duration_seconds",
        created_at.alias("created_at"),
    )


def write_manifest(classified: DataFrame, folder: str, run: str = "run_id") -> None:
    """The classification of every input, partitioned by run.

    Rows are sorted into ranges of runs first, and within a run by their own values, so a run of few rows is one file and
    a run of very many is written by several tasks: as many files as there are runs and tasks, not their product.
    """
    spread = F.xxhash64(*[c for c in classified.columns if c != run])
    classified.repartitionByRange(run, spread).write.mode("append").partitionBy(run).parquet(folder)


def write_performance(performance: DataFrame, folder: str, run: str = "run_id") -> None:
    performance.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy(run).json(folder)


def write_work_list(plan: DataFrame, folder: str) -> None:
    """Queued, skipped and deferred files of a refresh, one folder per action."""
    plan.write.mode("overwrite").partitionBy("action").parquet(folder)


def _require_items(manifest: DataFrame, missing: DataFrame, folder: str) -> None:
    """Fails when an id is unknown, listing all of them below ``missing``, or when no chosen item has an artifact."""
    missing.write.mode("overwrite").json(f"{folder}/missing")
    count = missing.sparkSession.read.schema(missing.schema).json(f"{folder}/missing").count()
    if count:
        raise ValueError(f"Item not found: {count} requested ids, listed in {folder}/missing")
    if manifest.limit(1).count() == 0:
        raise ValueError("No completed item artifacts are available to download.")


def write_items(headers: DataFrame, turns: DataFrame, infos: DataFrame, root: str, key: str = "media_id") -> int:
    """Both documents of every item as ``<root>/<item>/timeline.json`` and ``convert_info.json``; the number of documents.

    ``headers`` and ``infos`` have one row per item, ``turns`` the rows of ``turn_table``. An item that is written again is replaced.
    """
    return write_pieces(document_pieces(headers, turns, infos, key), root)


def export_items(manifest: DataFrame, missing: DataFrame, pieces: DataFrame, folder: str, key: str = "item_id") -> int:
    """Write the chosen items' two documents below ``items/<item>/`` under their own names, and a manifest.

    ``pieces`` are document pieces of at least the chosen items. Fails as ``export_package`` does.
    """
    _require_items(manifest, missing, folder)
    chosen = manifest.select(F.col(key).alias("item_id"))
    written = write_pieces(pieces.join(chosen, "item_id", "left_semi"), f"{folder}/items")
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return written


def export_package(
    manifest: DataFrame, missing: DataFrame, timelines: DataFrame, infos: DataFrame, folder: str, key: str = "item_id"
) -> None:
    """Write the chosen items' two documents, whole, below ``<document>/items/item_id=<id>/``, and a manifest that names
    these folders. A second export into the same folder replaces the first.

    Fails when an id is unknown, or when no chosen item has an artifact. All unknown ids are then listed below
    ``missing`` in the folder.
    """
    _require_items(manifest, missing, folder)
    chosen = manifest.select(key)
    for documents, name in ((timelines, "timeline"), (infos, "convert_info")):
        (
            _spread(documents.join(chosen, key, "left_semi"), key)
            .write.mode("overwrite")
            .option("ignoreNullFields", "false")
            .partitionBy(key)
            .json(f"{folder}/{name}/items")
        )
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
