"""Query of the surrogate operator. Keyed draws have no SQL; tests check properties of the replacements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnweave.llm.surrogates import replaced
from turnweave.llm.tables import table


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return replaced(docs, count_column="n_replaced")
