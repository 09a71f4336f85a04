"""Query of the transport-stream operator. Bit layouts have no SQL; tests use exact round trips and damaged streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnweave.llm import transport_stream
from turnweave.llm.tables import kept, table


def op6_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores all texts as transport streams in a written table, reads them back and describes them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_row_id"), F.col("text").alias("_text"))
    found = transport_stream.read(kept(transport_stream.written(docs), "media"))
    tail = F.substring("payload", -64, 64)
    return found.select(
        F.col("_row_id").alias("doc_id"),
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            " ",
            F.format_string("programs=%d", F.size("programs")),
            F.format_string("units=%d", F.size("units")),
            F.format_string("access=%d", F.size(F.filter("units", lambda u: u["random_access"]))),
            F.format_string("pts=%d-%d", F.array_min(F.col("units.pts")), F.array_max(F.col("units.pts"))),
            F.format_string("errors=%d", F.col("continuity_errors") + F.col("lost_sync")),
        ).alias("feature"),
    )
