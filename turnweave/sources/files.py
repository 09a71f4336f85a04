"""Tables, file inventories and content hashes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import cache

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from turnweave.functions.text import extension, file_name, normalize_extensions, relative_to, source_identity

READ_CHUNK = 1024 * 1024


@cache
def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table; its footer is read once per session."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table as a stream of its files, whether it is one file or a folder of them.

    The pattern matches the table's own name only; a plain path must be a folder to be streamed.
    """
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}.parque[t]")


def _local_path(column):
    """``file:`` URIs as plain paths; other schemes stay as they are."""
    return F.regexp_replace(column, r"^file:/+", "/")


def paths_matching(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """The paths or glob patterns that match something; the reader refuses the others."""
    context = spark.sparkContext

    def matches(pattern: str) -> bool:
        target = context._jvm.org.apache.hadoop.fs.Path(pattern)
        found = target.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(target)
        return found is not None and len(found) > 0

    return [pattern for pattern in patterns if matches(pattern)]


def qualified(spark: SparkSession, path: str) -> str:
    """A folder as Spark's readers name the files in it: with its file system, but for local ones; without a trailing slash."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return re.sub(r"^file:/+", "/", whole).rstrip("/")


def paths_of(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob pattern matches, in byte order."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(target)
    return sorted(status.getPath().toString() for status in found or [])


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_TASKS = 8  # per core, each for many folders


@contextmanager
def listing_tasks(spark: SparkSession) -> Iterator[None]:
    """While files are listed: few tasks for many folders each. By default Spark starts a task for every folder, up to 10,000."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), LISTING_TASKS * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def discover_files(
    spark: SparkSession, roots: Sequence[dict], extensions: Sequence[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """Files below each root with an allowed extension, and the roots that do not exist.

    ``roots`` are dicts with ``source_id``, ``path`` and optional ``recursive`` (default true). Only file metadata is
    read. Spark's file index leaves out names starting with ``_`` or ``.``; such a folder can be given as a root.
    Sort with ``orderBy(lower("path"))`` where order matters.
    """
    allowed = normalize_extensions(extensions)
    present = paths_matching(spark, [root["path"] for root in roots])
    missing = [root["path"] for root in roots if root["path"] not in present]
    schema = "source_id string, root_path string, _below string, path string, size_bytes bigint, modified_at timestamp"
    found = spark.createDataFrame([], schema)
    for root in roots:
        if root["path"] in missing:
            continue
        reader = spark.read.format("binaryFile")
        if root.get("recursive", True):
            reader = reader.option("recursiveFileLookup", "true")
        base = root["path"].rstrip("/")
        with listing_tasks(spark):
            files = reader.load(base)
        listed = files.select(
            F.lit(root["source_id"]).alias("source_id"),
            F.lit(base).alias("root_path"),
            F.lit(qualified(spark, base)).alias("_below"),
            _local_path(F.col("path")).alias("path"),
            F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("modified_at"),
        )
        found = found.unionByName(listed)
    relative = relative_to(F.col("path"), F.col("_below"))
    kept = found.filter(extension(F.col("path")).isin(*allowed)).select(
        "*",
        relative.alias("relative_path"),
        source_identity(F.col("source_id"), relative).alias("source_file_identity"),
        file_name(F.col("path")).alias("file_name"),
    ).drop("_below")
    return kept, missing


def select_roots(inventory: DataFrame, source_ids: Sequence[str]) -> DataFrame:
    """Rows of the chosen roots, compared without case; all rows when none are chosen."""
    if not source_ids:
        return inventory
    return inventory.filter(F.lower("source_id").isin(*[value.lower() for value in source_ids]))


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` and ``source_hash`` of every file below a folder; no task holds more than a chunk of a file."""
    with listing_tasks(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return hash_files(files.select(_local_path(F.col("path")).alias("path")))


def hash_files(files: DataFrame) -> DataFrame:
    """Adds ``source_hash`` to rows with a ``path``: only the given files are read, in fixed-size chunks.

    Rows are spread over the tasks first, in a fixed number: paths are so few bytes that adaptive execution would give them all to
    one task. A task holds one chunk at a time, so file size does not matter.
    """
    schema = T.StructType([*files.schema.fields, T.StructField("source_hash", T.StringType())])
    partitions = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(partitions, "path").mapInPandas(_hash_batches, schema)


def _hash_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(source_hash=[_file_digest(path) for path in batch["path"]])


def _file_digest(path: str) -> str:
    filesystem, inner = FileSystem.from_uri(path)
    digest = hashlib.sha256()
    with filesystem.open_input_stream(inner) as stream:
        while chunk := stream.read(READ_CHUNK):
            digest.update(chunk)
    return digest.hexdigest()
