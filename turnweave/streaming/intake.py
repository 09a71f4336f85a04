"""Incremental refresh: new files become work-list rows as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from turnweave.functions.text import (
    extension,
    file_name,
    identity_key,
    lowered,
    normalize_extensions,
    relative_to,
    source_identity,
)
from turnweave.operators.refresh import plan_refresh
from turnweave.sinks.catalog_log import known_rows, merge_index
from turnweave.sources.files import hash_files, qualified

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, source_id: str, folder: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """Stream of files below a folder with an allowed extension; only metadata is read."""
    files = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(folder)
    )
    path = F.regexp_replace("path", r"^file:/+", "/")
    relative = relative_to(path, F.lit(qualified(spark, folder)))
    return files.filter(extension(F.col("path")).isin(*normalize_extensions(extensions))).select(
        F.lit(source_id).alias("source_id"),
        path.alias("path"),
        F.col("length").alias("size_bytes"),
        source_identity(F.lit(source_id), relative).alias("source_file_identity"),
        file_name(path).alias("file_name"),
    )


def start_intake(
    inventory: DataFrame,
    read_catalog: Callable[[], DataFrame] | str,
    signature: str,
    output: str,
    checkpoint: str,
    hash_content: bool = False,
    trigger: dict | None = None,
    **plan_options,
) -> StreamingQuery:
    """Plan every micro-batch against the catalog as it is then and write it below ``output``.

    ``read_catalog`` is a function that reads the catalog, of which only rows of the batch's own identities (or hashes, for files
    without one) are aggregated, or the root of a ``catalog_log``: then every batch first brings its index up to date and
    reads only the buckets of its own files. A batch writes its own folder and overwrites it when repeated, so a restart
    leaves no duplicates. ``trigger`` is given to the stream writer, by default
    ``{"availableNow": True}``.
    """

    def plan_batch(batch: DataFrame, batch_id: int) -> None:
        files = (hash_files(batch) if hash_content else batch).persist()
        if isinstance(read_catalog, str):
            merge_index(files.sparkSession, read_catalog)
            known = known_rows(files, read_catalog)
        else:
            known = rows_for(files, read_catalog())
        planned = plan_refresh(files, known, signature, **plan_options)
        planned.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
        files.unpersist()

    writer = inventory.writeStream.foreachBatch(plan_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def rows_for(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows with the identity of a file, or with the hash of a file that has no identity."""
    identity, digest = identity_key(F.col("source_file_identity")), lowered(F.col("source_hash"))
    wanted = files.select(identity.alias("_identity"), digest.alias("_hash"))
    keyed = catalog.withColumn("_identity", identity).withColumn("_hash", digest)
    by_name = keyed.join(wanted.filter("_identity <> ''").select("_identity").distinct(), "_identity", "left_semi")
    by_hash = keyed.join(wanted.filter("_identity = ''").select("_hash").distinct(), "_hash", "left_semi")
    # A row that is found both ways counts once for each, which changes no look-up.
    return by_name.unionByName(by_hash).drop("_identity", "_hash")
