"""The catalog as an append log of Parquet commits, and an index that look-ups read by file.

Rows have a total order: the number of their commit and their place in it. A commit counts when its marker is there, which is
written last; what a failed writer left behind is overwritten by the next commit of that number. One writer at a time.

``merge_index`` carries new commits over into an index of the rows that a look-up can return: of each identity, hash and
signature the last row and the first one with an artifact. The index is bucketed by identity, and once more by hash for
files without identity. A merge rewrites the buckets it touches as a new version and marks the version last; a look-up for a
batch of files reads the buckets of that batch only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnweave.functions.text import identity_key, lowered, non_blank, strip
from turnweave.operators.ordering import ranked
from turnweave.session import stored
from turnweave.sources.files import paths_of

BUCKETS = 64  # of each side; to be raised before the first merge of a catalog that outgrows them
POSITION = ("commit", "place")
# Columns of a catalog row; the writer adds those that a caller leaves out.
COLUMNS = {
    "run_id": "string", "run_dir": "string", "audio_id": "string", "item_dir": "string", "artifact_path": "string",
    "conversion_info_path": "string", "source_hash": "string", "conversion_signature": "string", "source_id": "string",
    "source_relative_path": "string", "source_file_identity": "string", "file_name": "string", "original_path": "string",
    "duration_seconds": "double", "created_at": "string", "artifact_exists": "boolean",
}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items()) + ", commit bigint, place bigint"


def _marked(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Numbers of the commits, bases or versions that count."""
    return sorted(int(path.rsplit("=", 1)[1]) for path in paths_of(spark, f"{root}/markers/{kind}=*"))


def _mark(spark: SparkSession, root: str, kind: str, number: int) -> None:
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{root}/markers/{kind}={number}")


def append_log(rows: DataFrame, root: str, order: Sequence[Column | str], commit: int | None = None) -> int:
    """Add rows as one commit, placed in ``order``; its number. A given number that is marked already is not written again."""
    spark = rows.sparkSession
    done = _marked(spark, root, "commit")
    number = commit if commit is not None else (done[-1] + 1 if done else 1)
    if number in done:
        return number
    present = [F.col(c) if c in rows.columns else F.lit(None) for c in COLUMNS]
    full = rows.select(*[value.cast(COLUMNS[c]).alias(c) for value, c in zip(present, COLUMNS)], *_order_columns(rows, order))
    placed = ranked(full, [F.col(f"_o{k}") for k in range(len(order))], "place")
    written = placed.select(*COLUMNS, F.lit(number).cast("bigint").alias("commit"), "place")
    written.write.mode("overwrite").parquet(f"{root}/log/commit_{number}")
    _mark(spark, root, "commit", number)
    return number


def _order_columns(rows: DataFrame, order: Sequence[Column | str]) -> list[Column]:
    return [(F.col(o) if isinstance(o, str) else o).alias(f"_o{k}") for k, o in enumerate(order)]


def read_log(spark: SparkSession, root: str, after: int | None = None) -> DataFrame:
    """Rows of all commits, or of those after one, with ``catalog_pos`` (commit, place), which the look-ups order by."""
    commits = _marked(spark, root, "commit")
    bases = [] if after is not None else _marked(spark, root, "base")
    first = after if after is not None else (bases[-1] if bases else 0)
    paths = [f"{root}/log/commit_{n}" for n in commits if n > first]
    if bases:
        paths.append(f"{root}/base/upto_{bases[-1]}")
    rows = spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)
    return _positioned(rows)


def _positioned(rows: DataFrame) -> DataFrame:
    return rows.select(*COLUMNS, F.struct(*POSITION).alias("catalog_pos"))


def compact_log(spark: SparkSession, root: str) -> int | None:
    """Rewrite all commits as one base without the rows that nothing can return; the last commit in it.

    Of several rows with one artifact path (without case) only the first is ever used, and rows without a path never are.
    Positions stay, so look-ups find the same rows before and after. Older files are left for the operator to expire.
    """
    commits = _marked(spark, root, "commit")
    if not commits:
        return None
    rows = read_log(spark, root)
    path = F.lower(strip(F.col("artifact_path")))
    usable = rows.filter(non_blank(F.col("artifact_path")).isNotNull())
    firsts = usable.groupBy(path.alias("_path")).agg(F.min_by(F.struct(*usable.columns), "catalog_pos").alias("_row"))
    kept = firsts.select("_row.*").select(*COLUMNS, "catalog_pos.*")
    kept.write.mode("overwrite").parquet(f"{root}/base/upto_{commits[-1]}")
    _mark(spark, root, "base", commits[-1])
    return commits[-1]


def _sides(rows: DataFrame) -> DataFrame:
    """Every row under its identity, and under its hash, with the bucket of each."""
    identity, digest = identity_key(F.col("source_file_identity")), lowered(F.col("source_hash"))
    keys = F.array(F.struct(F.lit("identity").alias("side"), identity.alias("key")), F.struct(F.lit("hash").alias("side"), digest.alias("key")))
    spread = rows.select("*", F.explode(keys).alias("_k")).select(*rows.columns, "_k.side", "_k.key").filter("key <> ''")
    return spread.withColumn("bucket", bucket(F.col("key")))


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _needed(rows: DataFrame) -> DataFrame:
    """Of each identity, hash and signature the last row, and the first one with an artifact."""
    row = F.struct(*COLUMNS, "catalog_pos")
    keys = ["side", "bucket", identity_key(F.col("source_file_identity")), lowered(F.col("source_hash")), lowered(F.col("conversion_signature"))]
    found = rows.groupBy(*keys).agg(
        F.max_by(row, "catalog_pos").alias("last"), F.min_by(row, F.when(F.col("artifact_exists"), F.col("catalog_pos"))).alias("first")
    )
    both = F.array_distinct(F.array_compact(F.array("last", "first")))
    return found.select("side", "bucket", F.explode(both).alias("_row")).select("side", "bucket", "_row.*")


def merge_index(spark: SparkSession, root: str) -> int:
    """Bring the index up to the last commit; its version, which is the number of that commit.

    Only touched buckets are read and written. A merge that stopped before its marker is done again with the same result.
    """
    commits, versions = _marked(spark, root, "commit"), _marked(spark, root, "index")
    done = versions[-1] if versions else 0
    if not commits or commits[-1] <= done:
        return done
    new = stored(_sides(read_log(spark, root, after=done)), "index-rows")
    # At most two times BUCKETS rows.
    touched = [(r["side"], r["bucket"]) for r in new.select("side", "bucket").distinct().collect()]
    old = _read_buckets(spark, root, touched, done)
    merged = _needed(new.drop("key").unionByName(old)).withColumn("version", F.lit(commits[-1]))
    (
        merged.repartition("side", "bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("side", "bucket", "version")
        .parquet(f"{root}/index")
    )
    _mark(spark, root, "index", commits[-1])
    return commits[-1]


def _read_buckets(spark: SparkSession, root: str, buckets: Sequence[tuple[str, int]], version: int) -> DataFrame:
    """Rows of the newest marked version of the given buckets."""
    wanted = {f"side={side}/bucket={number}" for side, number in buckets}
    newest: dict[str, int] = {}
    marked = set(_marked(spark, root, "index"))
    for path in paths_of(spark, f"{root}/index/side=*/bucket=*/version=*"):
        place, number = path.rsplit("/version=", 1)
        place = "/".join(place.split("/")[-2:])
        if place in wanted and int(number) <= version and int(number) in marked:
            newest[place] = max(newest.get(place, 0), int(number))
    schema = ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())
    schema = f"side string, bucket int, {schema}, catalog_pos struct<commit:bigint, place:bigint>"
    if not newest:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/index/{place}/version={number}" for place, number in sorted(newest.items())]
    rows = spark.read.schema(f"{schema}, version int").option("basePath", f"{root}/index").parquet(*paths)
    return rows.drop("version")


def known_rows(files: DataFrame, root: str) -> DataFrame:
    """Catalog rows of the index that a look-up of ``files`` (source_file_identity, source_hash) can return.

    Files with an identity take rows by it, others by their hash. Reads the buckets of these files only.
    """
    spark = files.sparkSession
    versions = _marked(spark, root, "index")
    identity = identity_key(F.col("source_file_identity"))
    named = F.when(identity != "", F.struct(F.lit("identity").alias("side"), identity.alias("key"))).otherwise(
        F.struct(F.lit("hash").alias("side"), lowered(F.col("source_hash")).alias("key"))
    )
    asked = files.select(named.alias("_k")).select("_k.*").distinct().withColumn("bucket", bucket(F.col("key")))
    buckets = [(r["side"], r["bucket"]) for r in asked.select("side", "bucket").distinct().collect()]
    rows = _read_buckets(spark, root, buckets, versions[-1] if versions else 0)
    key = F.when(F.col("side") == "identity", identity).otherwise(lowered(F.col("source_hash")))
    found = rows.withColumn("key", key).join(asked, ["side", "key", "bucket"], "left_semi")
    return found.select(*COLUMNS, "catalog_pos").distinct()
