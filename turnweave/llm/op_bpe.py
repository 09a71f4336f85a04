"""Query of byte-level BPE. Merging by rank has no plain SQL; tests compare with the reference library of the file."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnweave.llm import bpe_sql
from turnweave.llm.tables import kept, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op3_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    """Encodes all documents and decodes the ids again. The rank file (under 1 MB) is read on the driver."""
    content = Path(ranks).read_bytes()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_row_id"), F.col("text").alias("_text"))
    # Written first: in one stage a task would need two Python workers, each with an encoder.
    ids = kept(bpe_sql.encoded(docs, content, public_tokenizers.PATTERN), "token-ids")
    both = bpe_sql.decoded(ids, content, public_tokenizers.PATTERN)
    return both.select(
        F.col("_row_id").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
