"""Query of the source mixture. Its draws have no SQL; tests check targets, totals and bounds against plain loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnweave.llm.source_mixture import mixture, sized, taken_words
from turnweave.llm.tables import kept, table


def op13_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = kept(sized(table(spark, sf_dir, "documents")), "sizes")
    return taken_words(sizes, *mixture(sizes))
