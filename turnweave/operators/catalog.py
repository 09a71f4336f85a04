"""Artifact catalog: union, lookups, file status, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnweave.functions.text import identity_key, item_id, lowered, strip
from turnweave.functions.numbers import round_to

# Older column names and their present ones.
OLD_COLUMN_NAMES = {
    "videos_total": "items_total",
    "videos_done": "items_done",
    "videos_skipped": "items_skipped",
    "videos_failed": "items_failed",
    "job_id": "run_id",
    "sha256": "source_hash",
    "media_id": "audio_id",
    "duration_sec": "duration_seconds",
    "media_dir": "item_dir",
    "current_media": "current_item",
    "current_media_elapsed_sec": "current_item_elapsed_sec",
}


def canonical_columns(df: DataFrame, names: dict[str, str] = OLD_COLUMN_NAMES) -> DataFrame:
    """Old column names give way to the present ones; where both exist the present value wins unless null."""
    for old, new in names.items():
        if old not in df.columns:
            continue
        if new in df.columns:
            df = df.withColumn(new, F.coalesce(F.col(new), F.col(old))).drop(old)
        else:
            df = df.withColumnRenamed(old, new)
    return df


def union_catalog(artifact_rows: DataFrame, cached_rows: DataFrame, position: str = "catalog_pos") -> DataFrame:
    """Scanned artifacts first, then cached rows whose artifact path (without case) was not seen yet.

    Cached rows without a path are dropped; among cached rows with one path the first wins. The
    added ``catalog_order`` puts artifacts before cached rows.
    """
    path_key = F.lower(strip(F.col("artifact_path")))
    seen = artifact_rows.select(path_key.alias("_path")).distinct()
    candidates = cached_rows.withColumn("_path", path_key).filter(F.coalesce(F.col("_path"), F.lit("")) != "")
    fresh = candidates.join(seen, "_path", "left_anti")
    row = F.struct(*cached_rows.columns)
    firsts = fresh.groupBy("_path").agg(F.min_by(row, F.col(position)).alias("_row")).select("_row.*")
    united = artifact_rows.withColumn("_origin", F.lit(0)).unionByName(
        firsts.withColumn("_origin", F.lit(1)), allowMissingColumns=True
    )
    return united.withColumn("catalog_order", F.struct("_origin", position)).drop("_origin")


def latest_by_key(catalog: DataFrame, position: str = "catalog_pos") -> DataFrame:
    """One row per (identity, hash, signature), the last one in catalog order; rows without hash or signature
    are left out. ``first_pos`` is where the key first appeared, which orders the keys."""
    usable = catalog.filter(
        (F.coalesce(F.col("source_hash"), F.lit("")) != "")
        & (F.coalesce(F.col("conversion_signature"), F.lit("")) != "")
    )
    return (
        usable.groupBy(
            identity_key(F.col("source_file_identity")).alias("identity_key"),
            lowered(F.col("source_hash")).alias("hash_key"),
            lowered(F.col("conversion_signature")).alias("signature_key"),
        )
        .agg(
            F.max_by(F.struct(*catalog.columns), F.col(position)).alias("_row"),
            F.min(position).alias("first_pos"),
        )
        .select("identity_key", "hash_key", "signature_key", "first_pos", "_row.*")
    )


def look_up(
    inventory: DataFrame, catalog: DataFrame, signature: str, position: str = "catalog_pos"
) -> DataFrame:
    """Adds ``exact`` (same identity, hash and signature; the last catalog row) and ``reusable`` (same identity and
    hash, any signature, artifact present; the first catalog row).

    A file without an identity is matched by its hash alone: any row with that hash and an artifact is reusable, and a row that
    has no identity either is exact. Both look-ups come from one aggregation of the catalog by (identity, hash) and one join.
    """
    identity, digest = identity_key(F.col("source_file_identity")), lowered(F.col("source_hash"))
    row = F.struct("audio_id", "conversion_signature", "artifact_exists", *(
        ["run_id"] if "run_id" in catalog.columns else []
    ))
    stored = lowered(F.col("conversion_signature"))
    found = (
        catalog.filter(digest != "")
        .withColumn("_identity", identity)
        .withColumn("_hash", digest)
        .groupBy("_identity", "_hash")
        .agg(
            F.max_by(row, F.when(stored == signature.strip().lower(), F.col(position))).alias("exact"),
            F.min_by(row, F.when(F.col("artifact_exists"), F.col(position))).alias("reusable"),
            F.min(F.when(F.col("artifact_exists"), F.col(position))).alias("_first"),
        )
    )
    # Rows without an identity look up by hash: their exact row comes from rows without one, the reusable one from all.
    by_hash = found.groupBy("_hash").agg(
        F.max(F.when(F.col("_identity") == "", F.col("exact"))).alias("exact"), F.min_by("reusable", "_first").alias("reusable")
    )
    either = found.filter("_identity <> ''").drop("_first").unionByName(by_hash.withColumn("_identity", F.lit("")))
    keyed = inventory.withColumn("_identity", identity).withColumn("_hash", digest)
    return keyed.join(either, ["_identity", "_hash"], "left").drop("_identity", "_hash")


def file_status(
    inventory: DataFrame,
    catalog: DataFrame,
    signature: str,
    manifest: DataFrame | None = None,
    position: str = "catalog_pos",
) -> DataFrame:
    """Status of every file: completed, settings_changed, changed or unprocessed from the catalog, then processing,
    queued or failed from run manifests.

    Identities are compared as they are. ``inventory.source_hash`` may be null; the signature alone decides then.
    ``manifest`` has ``source_file_identity``, ``run_state``, ``status``, ``run_name``, ``item_pos``; the oldest run
    and in it the last item wins. ``run_id`` is that of the row that decides, empty where it is unknown. A file that its run
    decides also has the run's media id and ``duration_seconds``, where the manifest has that column.
    """
    files = inventory.withColumn("_identity", strip(F.col("source_file_identity")))
    rows = (
        latest_by_key(catalog, position)
        .filter(F.col("artifact_exists"))
        .select(
            strip(F.col("source_file_identity")).alias("_identity"),
            F.col("source_hash").alias("_hash"),
            (F.col("conversion_signature") == signature).alias("_signed"),
            F.col("first_pos").alias("_pos"),
            F.col("audio_id").alias("_audio_id"),
            *([F.col("duration_seconds").alias("_duration")] if "duration_seconds" in catalog.columns else []),
            *([F.col("run_id").alias("_run_id")] if "run_id" in catalog.columns else []),
        )
    )
    extras = [c for c in ("_duration", "_run_id") if c in rows.columns]
    entry = F.struct("_pos", "_audio_id", *extras)
    # First row per (file, content) and per file, each with and without the signature: every later join finds at most
    # one row, however many catalog rows a file has.
    by_hash = rows.groupBy("_identity", "_hash").agg(
        F.min(F.when(F.col("_signed"), entry)).alias("_signed_same"), F.min(entry).alias("_same")
    )
    by_file = by_hash.groupBy("_identity").agg(
        F.min("_signed_same").alias("_signed_any"), F.min("_same").alias("_any")
    )
    known = F.col("source_hash").isNotNull()
    signed = F.when(known, F.col("_signed_same")).otherwise(F.col("_signed_any"))
    status = (
        F.when(signed.isNotNull(), "completed")
        .when(F.col("_same").isNotNull(), "settings_changed")
        .when(F.col("_any").isNotNull(), "changed")
        .otherwise("unprocessed")
    )
    joined = (
        files.withColumn("_hash", F.col("source_hash"))
        .join(by_hash, ["_identity", "_hash"], "left")
        .join(by_file, "_identity", "left")
        .withColumn("status", status)
        .withColumn("_best", F.coalesce(signed, F.col("_same"), F.col("_any")))
        .drop("_hash", "_signed_same", "_same", "_signed_any", "_any")
    )
    media, timed = F.col("_best._audio_id"), manifest is not None and "duration_seconds" in manifest.columns
    duration = F.col("_best._duration") if "_duration" in extras else F.lit(None).cast("double")
    run = F.col("_best._run_id") if "_run_id" in extras else F.lit(None).cast("string")
    if manifest is not None:
        active = F.lower("run_state").isin("pending", "running", "failed")
        runs = (
            manifest.filter(active)
            .withColumn("_identity", strip(F.col("source_file_identity")))
            .filter(F.col("_identity") != "")
            .groupBy("_identity")
            .agg(
                F.min_by(
                    F.struct(
                        F.lower("run_state").alias("state"),
                        F.coalesce(F.nullif("status", F.lit("")), F.lower("run_state")).alias("item"),
                        "run_id",
                        "audio_id",
                        *([F.col("duration_seconds").alias("duration")] if timed else []),
                    ),
                    F.struct("run_name", -F.col("item_pos")),
                ).alias("_run")
            )
        )
        state, item = F.col("_run.state"), F.col("_run.item")
        by_run = (state.isin("pending", "running")) | ((item == "failed") & (F.col("status") == "unprocessed"))
        by_run = F.coalesce(by_run, F.lit(False))
        joined = (
            joined.join(runs, "_identity", "left")
            .withColumn("_by_run", by_run)
            .withColumn(
                "status",
                F.when(state == "running", "processing")
                .when(state == "pending", "queued")
                .when(F.col("_by_run"), "failed")
                .otherwise(F.col("status")),
            )
        )
        media = F.when(F.col("_by_run"), F.col("_run.audio_id")).otherwise(media)
        run = F.when(F.col("_by_run"), F.col("_run.run_id").cast("string")).otherwise(run)
        if timed:
            duration = F.when(F.col("_by_run"), F.col("_run.duration")).otherwise(duration)
    kept = joined.withColumn("media_id", F.coalesce(media, F.lit(""))).withColumn("run_id", F.coalesce(run, F.lit("")))
    if "_duration" in extras or timed:
        kept = kept.withColumn("duration_sec", round_to(F.nullif(duration, F.lit(0.0)), 3))
    return kept.drop("_identity", "_best", "_run", "_by_run")


def with_item_ids(catalog: DataFrame, extra: Column | None = None) -> DataFrame:
    """Adds ``item_id`` to catalog rows."""

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in catalog.columns else F.lit(None).cast("string")

    whole = F.to_json(F.struct(*sorted(catalog.columns))) if extra is None else extra
    return catalog.withColumn(
        "item_id",
        item_id(
            text("audio_id"),
            text("source_file_identity"),
            text("source_hash"),
            text("conversion_signature"),
            text("run_id"),
            whole,
        ),
    )


def prune_run(catalog: DataFrame, run_id: str, run_dir: str) -> DataFrame:
    """Catalog without the rows of one run: same run id (without case) or same run folder. Rows with neither stay, and
    a blank id or folder matches nothing."""
    kept = catalog
    if run_id.strip():
        kept = kept.filter(~F.coalesce(F.lower("run_id") == run_id.lower(), F.lit(False)))
    if run_dir.strip():
        folder = F.regexp_replace(F.col("run_dir"), "/+$", "")
        kept = kept.filter(~F.coalesce(folder == run_dir.rstrip("/"), F.lit(False)))
    return kept


def prune_runs(catalog: DataFrame, runs: DataFrame) -> DataFrame:
    """The same for a table of runs with ``run_id`` and ``run_dir``: two anti joins instead of one with OR."""
    by_id = runs.select(F.lower("run_id").alias("_id")).filter(strip(F.col("_id")) != "").distinct()
    folders = runs.filter(strip(F.col("run_dir")) != "").select(F.regexp_replace("run_dir", "/+$", "").alias("_folder"))
    by_folder = folders.distinct()
    kept = catalog.withColumn("_id", F.lower("run_id")).join(by_id, "_id", "left_anti")
    kept = kept.withColumn("_folder", F.regexp_replace("run_dir", "/+$", "")).join(by_folder, "_folder", "left_anti")
    return kept.drop("_id", "_folder")


def prune_lines(lines: DataFrame, runs: DataFrame, line: str = "value") -> DataFrame:
    """Catalog lines as they are, without those of the given runs (``run_id`` without case, or ``run_dir``).

    Lines that cannot be read stay, so nothing is lost by a rewrite; blank lines go. ``job_id`` counts as the older name of the run id.
    """
    schema = "run_id string, job_id string, run_dir string, _bad string"
    parsed = F.from_json(F.col(line), schema, {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.filter(strip(F.col(line)) != "").withColumn("_row", parsed)
    readable = F.col("_row").isNotNull() & F.col("_row._bad").isNull()
    named = rows.filter(readable).select(
        *lines.columns, F.coalesce("_row.run_id", "_row.job_id").alias("run_id"), F.col("_row.run_dir").alias("run_dir")
    )
    return prune_runs(named, runs).select(lines.columns).unionByName(rows.filter(~readable).select(lines.columns))
