"""Query of the quality classifier. A trained model has no SQL; tests measure held-out accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnweave.llm import subwords
from turnweave.llm.tables import table


def held_out(doc_id: Column) -> Column:
    """A third of the ids, by checksum of the id as text, is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def quality_model(docs: DataFrame, labels: DataFrame) -> subwords.Model:
    """Model of the labelled documents, learned from ids outside the held-out third."""
    known = labels.filter(~held_out(F.col("doc_id")))
    return subwords.fit(
        docs.select(F.col("doc_id").alias("_row_id"), F.col("text").alias("_text")),
        known.select(F.col("doc_id").alias("_row_id"), F.col("quality").alias("_label")),
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = subwords.scored(docs, quality_model(docs, table(spark, sf_dir, "labels")), carried=["doc_id"])
    return found.select(
        "row.doc_id",
        F.coalesce(held_out(F.col("row.doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
