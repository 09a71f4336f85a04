"""Item documents (timeline and audit JSON) and the cached catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnweave.functions.text import non_blank
from turnweave.session import stored
from turnweave.sources.item_folders import read_first, read_pieces

SOURCE_SCHEMA = (
    "struct<file_name:string, display_name:string, original_path:string, source_kind:string, source_id:string, "
    "source_relative_path:string, source_file_identity:string, source_hash:string, size_bytes:bigint, "
    "duration_sec:double, container_name:string, extension:string, audio_codec:string, audio_channels:bigint, "
    "audio_sample_rate:bigint, bitrate:bigint, recorded_at:string, recorded_at_source:string, "
    "recorded_at_timezone:string>"
)
PIPELINE_SCHEMA = "struct<pipeline_version:string, generation_signature:string, compute_mode:string>"
DOCUMENT_SCHEMA = (
    f"schema_version int, artifact_type string, generated_at string, source {SOURCE_SCHEMA}, "
    f"pipeline {PIPELINE_SCHEMA}, part int, item_id string"
)
CATALOG_SCHEMA = (
    "run_id string, run_dir string, audio_id string, media_id string, item_dir string, artifact_path string, "
    "conversion_info_path string, source_hash string, sha256 string, conversion_signature string, source_id string, "
    "source_relative_path string, source_file_identity string, file_name string, original_path string, "
    "duration_seconds double, duration_sec double, created_at string"
)


def _documents(spark: SparkSession, pattern: str, lines: bool) -> DataFrame:
    path = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), r"^file:/+", "/")
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return (
        spark.read.schema(DOCUMENT_SCHEMA)
        .option("multiLine", not lines)
        .json(pattern)
        .filter("coalesce(part, 0) = 0")
        .select(
            path.alias("document_path"),
            F.regexp_extract(path, r"^(.*)/[^/]+$", 1).alias("item_dir"),
            (F.col("item_id") if lines else folder).alias("audio_id"),
            F.col("_metadata.file_modification_time").alias("modified_at"),
            "generated_at",
            "source",
            "pipeline",
        )
    )


def scan_items(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog rows of all ``<folder>/<item>/`` that hold both ``timeline.json`` and ``convert_info.json``."""
    base = folder.rstrip("/")
    return assemble_items(
        _documents(spark, f"{base}/*/timeline.json", lines=False),
        _documents(spark, f"{base}/*/convert_info.json", lines=False),
    )


def scan_written(spark: SparkSession, timelines: str, infos: str) -> DataFrame:
    """The same for the two folders of ``write_documents``."""
    return assemble_items(_documents(spark, timelines, lines=True), _documents(spark, infos, lines=True))


def read_items(spark: SparkSession, root: str) -> DataFrame:
    """``scan_items`` over the ``item_folders`` data source, whose tasks take the item folders by turns."""
    text = read_pieces(spark, root).withColumn("_d", F.from_json("text", DOCUMENT_SCHEMA))
    rows = text.select(
        "document",
        "document_path",
        F.regexp_extract("document_path", r"^(.*)/[^/]+$", 1).alias("item_dir"),
        F.col("item_id").alias("audio_id"),
        "modified_at",
        "_d.generated_at",
        "_d.source",
        "_d.pipeline",
    )
    found = stored(rows, "item-documents")
    return assemble_items(found.filter("document = 'timeline'"), found.filter("document = 'convert_info'"))


def assemble_items(timelines: DataFrame, infos: DataFrame) -> DataFrame:
    """Join the two documents of each item.

    ``source`` and ``pipeline`` come whole from the audit document, else from the timeline; an item with neither is
    left out. Order by ``lower(audio_id)`` gives catalog order.
    """
    info = infos.select(
        "audio_id",
        F.col("document_path").alias("conversion_info_path"),
        F.col("source").alias("_info_source"),
        F.col("pipeline").alias("_info_pipeline"),
        F.col("generated_at").alias("created_at"),
        F.col("modified_at").alias("info_modified_at"),
    )
    timeline = timelines.select(
        "audio_id",
        "item_dir",
        F.col("document_path").alias("artifact_path"),
        F.col("source").alias("_line_source"),
        F.col("pipeline").alias("_line_pipeline"),
        F.col("modified_at").alias("timeline_modified_at"),
    )
    joined = (
        timeline.filter(~F.startswith("audio_id", F.lit(".")))
        .join(info, "audio_id")
        .withColumn("source", F.coalesce("_info_source", "_line_source"))
        .withColumn("pipeline", F.coalesce("_info_pipeline", "_line_pipeline"))
        .filter("source is not null or pipeline is not null")
    )
    return joined.select(
        "audio_id",
        "item_dir",
        "artifact_path",
        "conversion_info_path",
        "source.source_hash",
        F.col("pipeline.generation_signature").alias("conversion_signature"),
        "source.source_id",
        "source.source_relative_path",
        "source.source_file_identity",
        "source.file_name",
        "source.original_path",
        F.col("source.duration_sec").alias("duration_seconds"),
        "created_at",
        "timeline_modified_at",
        "info_modified_at",
    )


def parse_catalog(lines: DataFrame, existing: DataFrame | None = None, line: str = "value") -> DataFrame:
    """Rows of catalog lines; blank and malformed lines are skipped, and rows whose artifact is gone when ``existing``
    (``path``) is given."""
    parsed = (
        lines.filter(F.trim(line) != "")
        .withColumn(
            "_row",
            F.from_json(F.col(line), CATALOG_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}),
        )
        .filter("_row._bad is null")
    )
    kept = [c for c in lines.columns if c != line]
    names = [c.strip().split(" ")[0] for c in CATALOG_SCHEMA.split(",")]
    merged = {"audio_id": "media_id", "source_hash": "sha256", "duration_seconds": "duration_sec"}
    rows = parsed.select(
        *kept,
        *[
            (F.coalesce(f"_row.{c}", f"_row.{merged[c]}") if c in merged else F.col(f"_row.{c}")).alias(c)
            for c in names
            if c not in merged.values()
        ],
    ).filter(non_blank(F.col("artifact_path")).isNotNull())
    if existing is None:
        return rows
    return rows.join(existing.select(F.col("path").alias("artifact_path")), "artifact_path", "left_semi")


def read_catalog(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """The cached catalog of JSON lines, with the byte-order position of each line as ``catalog_pos``."""
    lines = spark.read.text(path).select(
        "value",
        # Within one file block the ids rise with the lines; across blocks and files the first two fields decide.
        F.struct(
            "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")
        ).alias("catalog_pos"),
    )
    return parse_catalog(lines, existing)


def timeline_summary(documents: DataFrame, payload: str = "timeline_json", key: str | None = None) -> DataFrame:
    """Turn and distinct speaker counts of timeline documents held as text; unreadable text counts zero.

    ``turn_count`` is taken from the document when it is an integer, else from the number of turns. Documents that say they
    are one of several ``parts`` become one row per recording: rows with equal ``key``, or without one with equal
    other columns apart from ``part`` and ``parts``; what differs between them is taken from the first part.
    """
    schema = "part int, parts int, turn_count bigint, turns array<struct<speaker:string>>"
    parsed = documents.withColumn("_d", F.from_json(F.col(payload), schema))
    turns = F.coalesce(F.col("_d.turns"), F.array().cast("array<struct<speaker:string>>"))
    speakers = F.array_distinct(
        F.filter(F.transform(turns, lambda t: non_blank(t.getField("speaker"))), lambda s: s.isNotNull())
    )
    several = F.coalesce(F.col("_d.parts") > 1, F.lit(False))
    others = [c for c in documents.columns if c != payload]
    whole = parsed.filter(~several).select(
        *others,
        F.col(payload).isNotNull().alias("has_timeline"),
        F.coalesce("_d.turn_count", F.size(turns).cast("bigint")).alias("turn_count"),
        F.size(speakers).cast("bigint").alias("speaker_count"),
    )
    same = [key] if key is not None else [c for c in others if c not in ("part", "parts")]
    if not same:
        raise ValueError("Parts of a recording need a key or another column that tells recordings apart.")
    # Speakers of a part meet those of the others as narrow rows; the turns themselves are not gathered.
    pieces = parsed.filter(several).select(
        *others,
        F.col("_d.part").alias("_part"),
        F.col("_d.turn_count").alias("_total"),
        F.size(turns).cast("bigint").alias("_size"),
        F.explode_outer(speakers).alias("_speaker"),
    )
    per_part = pieces.groupBy(*same, "_part").agg(
        F.max("_total").alias("_total"), F.max("_size").alias("_size"), F.min(F.struct(*others)).alias("_row")
    )
    first = F.min_by("_row", "_part")
    counts = per_part.groupBy(*same).agg(
        F.coalesce(F.max("_total"), F.sum("_size")).alias("turn_count"), first.alias("_row")
    )
    named = pieces.groupBy(*same).agg(F.count_distinct("_speaker").alias("speaker_count"))
    matched = [counts[c].eqNullSafe(named[c]) for c in same]
    joined = counts.join(named, matched).select(
        *[F.col("_row").getField(c).alias(c) for c in others], F.lit(True).alias("has_timeline"), "turn_count", "speaker_count"
    )
    return whole.unionByName(joined)


def read_source_info(spark: SparkSession, root: str) -> DataFrame:
    """(media_dir, display_name, original_path, ...) of every item folder, from the first of three files that exists:
    ``source/source-record.json``, ``source.json``, or the ``source`` of ``timeline.json``.

    A file that exists but cannot be read gives empty fields; the next one is not tried then. Text after the ``source`` of a timeline
    is not kept.
    """
    base = root.rstrip("/")
    rows = read_first(spark, base, ("source/source-record.json", "source.json", "timeline.json"))
    whole = F.from_json("text", SOURCE_SCHEMA)
    inner = F.from_json("text", f"source {SOURCE_SCHEMA}").getField("source")
    source = F.when(F.col("document") == "timeline.json", inner).otherwise(whole)
    # The folder of an item is its file's path without the file's place in it.
    folder = F.expr("left(document_path, length(document_path) - length(document) - 1)")
    return rows.select(folder.alias("media_dir"), source.alias("_source")).select("media_dir", "_source.*")


def source_info(items: DataFrame, record: str, source: str, timeline_source: str) -> DataFrame:
    """``source_info``: the first of three optional source structs."""
    return items.withColumn("source_info", F.coalesce(F.col(record), F.col(source), F.col(timeline_source)))
