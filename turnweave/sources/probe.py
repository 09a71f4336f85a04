"""Media facts from probe output, kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnweave.functions.numbers import optional_int, truthy
from turnweave.functions.text import extension, non_blank, strip
from turnweave.functions.times import tag_recorded_times

PROBE_SCHEMA = (
    "format struct<duration:string, size:string, bit_rate:string, format_name:string, tags:map<string,string>>, "
    "streams array<struct<codec_type:string, codec_name:string, channels:string, sample_rate:string, "
    "bit_rate:string, tags:map<string,string>>>"
)


def probe_facts(probes: DataFrame, payload: str = "probe_json", path: str = "path", size: str | None = None) -> DataFrame:
    """Flat facts per file: the first audio stream, the first container name, bitrate of the container or the stream,
    and the recording times in the tags. ``size`` names a column used when the probe has no size.

    A file is unreadable when its payload is no JSON, or states a duration or size that is no number (``N/A``); a payload
    without ``format`` is readable with duration 0.
    """
    parsed = probes.withColumn("_p", F.from_json(F.col(payload), PROBE_SCHEMA))
    streams = F.coalesce(F.col("_p.streams"), F.array().cast(parsed.schema["_p"].dataType["streams"].dataType))
    audio = F.get(
        F.filter(streams, lambda s: F.coalesce(F.lower(s.getField("codec_type")), F.lit("")) == "audio"), F.lit(0)
    )
    tag_maps = F.filter(
        F.concat(F.array(F.col("_p.format.tags")), F.transform(streams, lambda s: s.getField("tags"))),
        lambda tags: tags.isNotNull(),
    )
    times = tag_recorded_times(tag_maps)
    stored_size = optional_int(F.col("_p.format.size"))
    facts = parsed.withColumn("_a", audio).withColumn("metadata_timestamp_candidates", times)
    # Payloads with a format have been parsed already; only the others are looked at again.
    parses = F.when(F.col("_p.format").isNotNull(), True).otherwise(F.try_parse_json(F.col(payload)).isNotNull())

    def number_like(field: str, pattern: str) -> Column:
        stated = F.coalesce(strip(F.col(f"_p.format.{field}")), F.lit(""))
        return (stated == "") | stated.rlike(f"^{pattern}$")

    as_int = lambda field: optional_int(F.col(f"_a.{field}"))
    return facts.select(
        *probes.columns,
        F.coalesce(F.col("_p.format.duration").try_cast("double"), F.lit(0.0)).alias("duration_seconds"),
        (truthy(stored_size, F.col(size)) if size else stored_size).alias("size_bytes_probed"),
        non_blank(F.get(F.split(strip(F.col("_p.format.format_name")), ","), F.lit(0))).alias("container_name"),
        F.nullif(extension(F.col(path)), F.lit("")).alias("extension"),
        non_blank(F.col("_a.codec_name")).alias("audio_codec"),
        as_int("channels").alias("audio_channels"),
        as_int("sample_rate").alias("audio_sample_rate"),
        truthy(optional_int(F.col("_p.format.bit_rate")), as_int("bit_rate")).alias("bitrate"),
        F.get("metadata_timestamp_candidates", F.lit(0)).alias("captured_at"),
        "metadata_timestamp_candidates",
        (parses & number_like("duration", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?") & number_like("size", r"[+-]?\d+")).alias(
            "readable"
        ),
    )
