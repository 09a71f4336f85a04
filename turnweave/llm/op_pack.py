"""Query of best-fit packing. Tokens have no SQL; tests compare with the tokenizer on whole texts."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnweave.llm import packing
from turnweave.llm.tables import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 4096


def packed_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Placed pieces of all documents. The tokenizer file (a few MB) is read on the driver and sent with the tasks."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_row_id"), F.col("text").alias("_text"))
    found = packing.pieces(rows, Path(tokenizer).read_text("utf-8"), capacity, keep_ids=False)
    return packing.packed(found, capacity).withColumnRenamed("_row_id", "doc_id")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
