"""Recording-shaped views of the driver's tables: a Spark DataFrame and the DuckDB SQL for each.

Times are whole milliseconds, so both engines agree to the last digit.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnweave.operators.running import Running, position_bin, running
from turnweave.sources.files import table

LONG = "bigint"


def epoch_micros(moment: Column) -> Column:
    """Microseconds of a zone-less timestamp, whatever the session time zone."""
    seconds = F.date_part(F.lit("SECOND"), moment)
    whole = (F.unix_date(F.to_date(moment)).cast(LONG) * 24 + F.hour(moment)) * 60 + F.minute(moment)
    return whole * F.lit(60_000_000) + (seconds * F.lit(1_000_000)).cast(LONG)


def at_ms(moment: Column) -> Column:
    micros = epoch_micros(moment)
    return ((micros - micros % 1000) / 1000).cast(LONG)


@cache
def _conversation_times(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("media_id"),
        F.col("turn").alias("seg_index"),
        "text",
        (F.lit(100) + F.length("text") % 4000).cast(LONG).alias("_length"),
        position_bin(F.col("turn")).alias("_bin"),
    )
    return running(turns, ["media_id"], "_bin", ["seg_index"], start_ms=Running("sum", F.col("_length"))).withColumn(
        "end_ms", F.col("start_ms") + F.col("_length")
    )


@cache
def raw_segments(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("seg_index")
    phrase = (F.col("media_id") % 3 == 0) & (turn % 6).isin(1, 2, 3)
    return _conversation_times(spark, sf).select(
        "media_id",
        "seg_index",
        "start_ms",
        "end_ms",
        F.when(phrase, "Thanks for watching").otherwise(F.col("text")).alias("text"),
        (-((turn * 71) % 1000)).cast(LONG).alias("logprob_milli"),
        ((turn * 131) % 1000).cast(LONG).alias("no_speech_milli"),
    )


@cache
def speaker_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth turn has no length, so that stretches without a speaker occur."""
    turn = F.col("seg_index")
    begin = F.col("start_ms") + (turn * 137) % 900
    return _conversation_times(spark, sf).select(
        "media_id",
        turn.alias("turn_pos"),
        F.concat(F.lit("SPEAKER_0"), (turn % 3).cast("string")).alias("speaker"),
        begin.cast(LONG).alias("start_ms"),
        F.when(turn % 4 == 3, begin).otherwise(F.col("end_ms") + (turn * 53) % 700).cast(LONG).alias("end_ms"),
    )


@cache
def speech_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Every third range has no length, so that segments outside speech occur."""
    begin = F.col("start_ms") + 50
    end = F.when(F.col("seg_index") % 3 == 1, begin).otherwise(F.col("end_ms") - 20)
    return _conversation_times(spark, sf).select("media_id", begin.alias("start_ms"), end.alias("end_ms"))


@cache
def silence_marks(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .select(
            F.col("user_id").alias("media_id"),
            F.col("event_id").alias("line_no"),
            F.when(F.col("event_type").isin("view", "click"), "S").otherwise("E").alias("kind"),
            at_ms(F.col("ts")).alias("at_ms"),
        )
    )


@cache
def silences(spark: SparkSession, sf: str) -> DataFrame:
    begin = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 613) % 3_600_000
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("media_id"),
        begin.cast(LONG).alias("start_ms"),
        (begin + (F.col("l_partkey") * 97) % 9000).cast(LONG).alias("end_ms"),
    )


@cache
def durations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("media_id"), F.lit(3_600_000).cast(LONG).alias("duration_ms")
    )


@cache
def inventory(spark: SparkSession, sf: str) -> DataFrame:
    relative = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav"))
    return table(spark, sf, "documents").select(
        F.col("source").alias("source_id"),
        relative.alias("relative_path"),
        F.concat("source", F.lit("::"), relative).alias("source_file_identity"),
        F.sha2("text", 256).alias("source_hash"),
        F.col("n_chars").alias("size_bytes"),
    )


@cache
def catalog(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    doc = F.col("doc_id")
    identity = F.concat("source", F.lit("::"), "lang", F.lit("/"), doc.cast("string"), F.lit(".wav"))
    # Every fifth file was moved since: its row holds the place where it was, so the file itself is new to the catalog.
    moved = F.when(doc % 5 == 0, F.concat(F.lit("moved-"), identity)).otherwise(identity)
    first = documents.select(
        (doc * 2).alias("catalog_pos"),
        F.concat(F.lit("item-"), doc.cast("string")).alias("audio_id"),
        F.upper(moved).alias("source_file_identity"),
        F.when(doc % 7 == 0, F.sha2(F.concat("text", F.lit("x")), 256))
        .otherwise(F.sha2("text", 256))
        .alias("source_hash"),
        F.when(doc % 3 == 0, "sig-gpu").otherwise("sig-cpu").alias("conversion_signature"),
        (doc % 11 != 0).alias("artifact_exists"),
    )
    second = documents.filter(doc % 13 == 0).select(
        (doc * 2 + 1).alias("catalog_pos"),
        F.concat(F.lit("item-"), doc.cast("string"), F.lit("-b")).alias("audio_id"),
        identity.alias("source_file_identity"),
        F.sha2("text", 256).alias("source_hash"),
        F.lit("sig-cpu").alias("conversion_signature"),
        F.lit(True).alias("artifact_exists"),
    )
    return first.unionByName(second)


@cache
def history(spark: SparkSession, sf: str) -> DataFrame:
    priority, key, customer = F.col("o_orderpriority"), F.col("o_orderkey"), F.col("o_custkey")

    def by_priority(urgent: str, high: str, medium: str, other: str) -> Column:
        return (
            F.when(priority == "1-URGENT", urgent)
            .when(priority == "2-HIGH", high)
            .when(priority == "3-MEDIUM", medium)
            .otherwise(other)
        )

    return table(spark, sf, "orders").select(
        key.alias("sample_pos"),
        (key % 97).cast("int").alias("run_no"),
        F.when(key % 3 == 0, "gpu").otherwise("cpu").alias("compute_mode"),
        by_priority("mp3", "aac", "flac", "pcm_s16le").alias("audio_codec"),
        by_priority("mp3", "mov", "flac", "wav").alias("container_name"),
        (1 + customer % 2).cast("int").alias("audio_channels"),
        (8000 * (1 + customer % 7)).cast("int").alias("audio_sample_rate"),
        (32000 * (key % 12)).cast("int").alias("bitrate"),
        (1000 + customer * 37 % 600_000).cast(LONG).alias("duration_ms"),
        (500 + key * 53 % 300_000).cast(LONG).alias("wall_ms"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "queued")
        .otherwise("failed")
        .alias("status"),
    )


@cache
def stage_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("item_id"),
        F.col("event_id").alias("event_pos"),
        at_ms(F.col("ts")).alias("at_ms"),
        F.when(kind == "signup", "extract_audio")
        .when(kind == "view", "detect_speech_candidates")
        .when(kind == "click", "diarize_audio")
        .when(kind == "purchase", "transcribe_audio")
        .otherwise("generate_artifacts")
        .alias("stage"),
    )


@cache
def levels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("media_id"),
        F.col("event_id").alias("pos"),
        at_ms(F.col("ts")).alias("at_ms"),
        F.col("value").alias("level"),
    )


_CUMULATIVE = (
    "sum(100 + length(text) % 4000) over (partition by conv_id order by turn rows unbounded preceding)"
)
_AT_MS = "cast((epoch_us(ts) - epoch_us(ts) % 1000) / 1000 as bigint)"

SQL_VIEWS = {
    "raw_segments": f"""
        select conv_id as media_id, turn as seg_index,
          cast({_CUMULATIVE} - (100 + length(text) % 4000) as bigint) as start_ms,
          cast({_CUMULATIVE} as bigint) as end_ms,
          case when conv_id % 3 = 0 and turn % 6 in (1, 2, 3) then 'Thanks for watching' else text end as text,
          cast(-((turn * 71) % 1000) as bigint) as logprob_milli,
          cast((turn * 131) % 1000 as bigint) as no_speech_milli
        from conversations""",
    "speaker_turns": f"""
        select * from (
          select conv_id as media_id, turn as turn_pos, concat('SPEAKER_0', cast(turn % 3 as varchar)) as speaker,
            cast({_CUMULATIVE} - (100 + length(text) % 4000) + (turn * 137) % 900 as bigint) as start_ms,
            case when turn % 4 = 3 then cast({_CUMULATIVE} - (100 + length(text) % 4000) + (turn * 137) % 900 as bigint)
              else cast({_CUMULATIVE} + (turn * 53) % 700 as bigint) end as end_ms
          from conversations)""",
    "speech_ranges": f"""
        select media_id, start_ms + 50 as start_ms,
          case when seg_index % 3 = 1 then start_ms + 50 else end_ms - 20 end as end_ms from (
          select conv_id as media_id, turn as seg_index,
            cast({_CUMULATIVE} - (100 + length(text) % 4000) as bigint) as start_ms,
            cast({_CUMULATIVE} as bigint) as end_ms
          from conversations)""",
    "silence_marks": f"""
        select user_id as media_id, event_id as line_no,
          case when event_type in ('view', 'click') then 'S' else 'E' end as kind, {_AT_MS} as at_ms
        from events""",
    "silences": """
        select l_suppkey as media_id,
          cast((l_orderkey * 7919 + l_linenumber * 613) % 3600000 as bigint) as start_ms,
          cast((l_orderkey * 7919 + l_linenumber * 613) % 3600000 + (l_partkey * 97) % 9000 as bigint) as end_ms
        from lineitem""",
    "durations": "select s_suppkey as media_id, cast(3600000 as bigint) as duration_ms from supplier",
    "inventory": """
        select source as source_id, concat(lang, '/', cast(doc_id as varchar), '.wav') as relative_path,
          concat(source, '::', lang, '/', cast(doc_id as varchar), '.wav') as source_file_identity,
          sha256(text) as source_hash, n_chars as size_bytes
        from documents""",
    "catalog": """
        select doc_id * 2 as catalog_pos, concat('item-', cast(doc_id as varchar)) as audio_id,
          upper(concat(case when doc_id % 5 = 0 then 'moved-' else '' end, source, '::', lang, '/', cast(doc_id as varchar), '.wav'))
            as source_file_identity,
          case when doc_id % 7 = 0 then sha256(concat(text, 'x')) else sha256(text) end as source_hash,
          case when doc_id % 3 = 0 then 'sig-gpu' else 'sig-cpu' end as conversion_signature,
          doc_id % 11 <> 0 as artifact_exists
        from documents
        union all
        select doc_id * 2 + 1, concat('item-', cast(doc_id as varchar), '-b'),
          concat(source, '::', lang, '/', cast(doc_id as varchar), '.wav'), sha256(text), 'sig-cpu', true
        from documents where doc_id % 13 = 0""",
    "history": """
        select o_orderkey as sample_pos, cast(o_orderkey % 97 as int) as run_no,
          case when o_orderkey % 3 = 0 then 'gpu' else 'cpu' end as compute_mode,
          case o_orderpriority when '1-URGENT' then 'mp3' when '2-HIGH' then 'aac' when '3-MEDIUM' then 'flac'
            else 'pcm_s16le' end as audio_codec,
          case o_orderpriority when '1-URGENT' then 'mp3' when '2-HIGH' then 'mov' when '3-MEDIUM' then 'flac'
            else 'wav' end as container_name,
          cast(1 + o_custkey % 2 as int) as audio_channels,
          cast(8000 * (1 + o_custkey % 7) as int) as audio_sample_rate,
          cast(32000 * (o_orderkey % 12) as int) as bitrate,
          cast(1000 + o_custkey * 37 % 600000 as bigint) as duration_ms,
          cast(500 + o_orderkey * 53 % 300000 as bigint) as wall_ms,
          case o_orderstatus when 'F' then 'completed' when 'O' then 'queued' else 'failed' end as status
        from orders""",
    "stage_events": f"""
        select user_id as item_id, event_id as event_pos, {_AT_MS} as at_ms,
          case event_type when 'signup' then 'extract_audio' when 'view' then 'detect_speech_candidates'
            when 'click' then 'diarize_audio' when 'purchase' then 'transcribe_audio'
            else 'generate_artifacts' end as stage
        from events""",
    "levels": f"select user_id as media_id, event_id as pos, {_AT_MS} as at_ms, value as level from events",
}


def with_views(*names: str, query: str) -> str:
    """DuckDB SQL: the named views as CTEs, then ``query`` (which may bring more CTEs of its own)."""
    ctes = ", ".join(f"{name} as ({SQL_VIEWS[name]})" for name in names)
    body = query.strip()
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"
