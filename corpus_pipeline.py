"""Corpus preparation in five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
documents: quality classifier, MinHash near-dedup, word substring dedup, surrogates for personal data, best-fit packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnweave.llm import difference_cover, subwords, superminhash, surrogates
from turnweave.llm.op_pack import packed_documents
from turnweave.llm.op_quality import quality_model
from turnweave.llm.tables import kept, named, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score 0.5 or more); it learns from the labels outside the held-out third."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return subwords.scored(docs, model).filter("score >= 0.5").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates: five-word shingles, similarity 0.8. Null ids stay.

    An id with several texts is linked by all of them, and keeps or loses all of them.
    """
    groups = superminhash.near_duplicates(docs, words=5, percent=80)
    gone = kept(groups.filter("not kept").select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*named(docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word passages that start in a document of a smaller id; all others stay as they are.

    A text that loses words has the rest joined by blanks, and one that loses all of them is empty. Texts of one id are
    not compared with each other.
    """
    texts = difference_cover.numbered_texts(docs)
    starts = difference_cover.repeated_windows(texts)
    held = texts.join(starts, ["_row_id", "_copy"]).dropDuplicates(["_row_id", "_copy"])
    left = kept(difference_cover.stripped(held).select("_row_id", "_copy", "text"), "stripped")
    found = texts.join(left.withColumn("_changed", F.lit(True)), ["_row_id", "_copy"], "left")
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("bigint")}
    return found.select(
        *[F.when(F.col("_changed"), new[c]).otherwise(F.col("_row")[c]).alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns]
    )


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by surrogates."""
    return surrogates.replaced(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placed pieces of the remaining documents in sequences of 4096 tokens."""
    return packed_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", personal_data),
    ("best_fit_packing", packing),
]

# A trained model, keyed draws and tokens have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
