"""Query of the byte-level repeat removal. SQL over all windows of whole tables is too slow; tests use brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnweave.llm.bucket_pointers import without_repeats
from turnweave.llm.tables import table


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(table(spark, sf_dir, "documents"), length=400)
    return left.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("left", 256).alias("kept_sha256"),
    )
