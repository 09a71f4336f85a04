"""Silence marks from detector logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# How detector logs name a mark.
START_PATTERN = r"silence_start:\s*([0-9.]+)"
END_PATTERN = r"silence_end:\s*([0-9.]+)"


def silence_marks(lines: DataFrame, line: str = "line") -> DataFrame:
    """Keep the log lines that carry a mark: ``kind`` S or E and ``at`` in seconds.

    Numbers are unsigned, so a negative start is no mark; a start wins when both are on one line. Lines whose number
    does not parse take no part; ``broken_marks`` lists them.
    """
    return _marks(lines, line).filter("kind is not null and at is not null").drop(line)


def broken_marks(lines: DataFrame, line: str = "line") -> DataFrame:
    """The log lines with a mark whose number does not parse, such as ``1.2.3``."""
    return _marks(lines, line).filter("kind is not null and at is null").drop("kind", "at")


def _marks(lines: DataFrame, line: str) -> DataFrame:
    first, last = F.regexp_extract(F.col(line), START_PATTERN, 1), F.regexp_extract(F.col(line), END_PATTERN, 1)
    kind = F.when(first != "", "S").when(last != "", "E")
    at = F.when(first != "", first).otherwise(last).try_cast("double")
    return lines.withColumn("kind", kind).withColumn("at", at)


def parse_silence_log(logs: DataFrame, key: str = "media_id", log: str = "log") -> DataFrame:
    """Marks of whole logs held in one column, with ``line_no`` in log order."""
    lines = logs.select(key, F.posexplode(F.split(F.col(log), r"\r\n|\n|\r")).alias("line_no", "line"))
    return silence_marks(lines)


def read_silence_logs(spark: SparkSession, folder: str, media_id: Column | None = None) -> DataFrame:
    """Marks of a folder of log files, one file per recording; the recording is the file's stem by default."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]+)?$", 1) if media_id is None else media_id
    logs = spark.read.text(folder, wholetext=True).select(name.alias("media_id"), F.col("value").alias("log"))
    return parse_silence_log(logs)
