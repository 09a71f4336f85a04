"""Queries that write tables to the shared folder and read them back, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnweave.operators import items, timeline
from turnweave.operators.runs import run_performance
from turnweave.plans import catalogs, runs, segments, views
from turnweave.plans.views import with_views
from turnweave.session import scratch_path, stored
from turnweave.sinks import documents as sinks
from turnweave.sinks.catalog_log import append_log, compact_log, read_log
from turnweave.sinks.lines import write_lines
from turnweave.sources.documents import read_items
from turnweave.sources.files import content_hashes, discover_files, table, table_stream
from turnweave.sources.item_folders import read_pieces
from turnweave.streaming.intake import start_intake
from turnweave.streaming.stale import closed_sessions, silent_runs


def _supplier_files(spark: SparkSession, sf: str) -> str:
    """A folder with one text file per supplier, which holds its name."""
    folder = scratch_path(spark, "supplier-files")
    key = F.concat(F.lit("s_suppkey="), F.coalesce(F.col("s_suppkey").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    write_lines(table(spark, sf, "supplier").select(key.alias("folder"), F.col("s_name").alias("value")), folder)
    return folder


def discovered(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = discover_files(spark, [{"source_id": "names", "path": _supplier_files(spark, sf)}], ["TXT"])
    return found.select(
        "source_id",
        F.regexp_extract("relative_path", r"^s_suppkey=(\d+)/[^/]+$", 1).cast("bigint").alias("s_suppkey"),
        "size_bytes",
        F.regexp_extract("source_file_identity", "^(.*)/[^/]+$", 1).alias("identity_folder"),
        F.regexp_extract("file_name", r"(\.[^.]+)$", 1).alias("extension"),
    )


def hashed(spark: SparkSession, sf: str) -> DataFrame:
    return content_hashes(spark, _supplier_files(spark, sf)).select(
        F.regexp_extract("path", r"/s_suppkey=(\d+)/[^/]+$", 1).cast("bigint").alias("s_suppkey"), "source_hash"
    )


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    media = F.col("media_id").cast("string")
    recordings = views.raw_segments(spark, sf).groupBy("media_id").agg((F.max("end_ms") / 1000).alias("duration_sec"))
    tool = lambda status: F.struct(F.lit("tool").alias("backend"), F.lit(status).alias("status"))
    return recordings.select(
        "media_id",
        F.struct(
            F.sha2(media, 256).alias("source_hash"),
            F.concat(F.lit("src::"), media).alias("source_file_identity"),
            "duration_sec",
            F.lit(None).cast("string").alias("recorded_at"),
        ).alias("source"),
        F.struct(F.lit("sig-cpu").alias("generation_signature")).alias("pipeline"),
        F.lit("v1").alias("pipeline_version"),
        F.lit("sig-cpu").alias("generation_signature"),
        F.lit("cpu").alias("compute_mode"),
        F.lit("default").alias("vad_profile"),
        tool("ok").alias("diarization"),
        tool("ok").alias("transcription"),
    )


def _timeline(spark: SparkSession, sf: str, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and stored turns of all recordings."""
    turns = stored(timeline.turn_table(timeline.timeline_turns(judged, **segments.MS)), "turns")
    return timeline.timeline_headers(turns, _sources(spark, sf).select("media_id", "source", "pipeline")), turns


def _conversion_documents(spark: SparkSession, sf: str, judged: DataFrame | None = None) -> DataFrame:
    return timeline.conversion_documents(
        _sources(spark, sf),
        segments.counts_per_recording(spark, sf, judged),
        application="turnweave",
        generated_at=F.lit("2026-01-01T00:00:00+00:00"),
    )


def _written(spark: SparkSession, sf: str) -> str:
    """A folder with both documents of every recording, by item."""
    folder = scratch_path(spark, "items")
    judged = segments.stored_validation(spark, sf)
    sinks.write_items(*_timeline(spark, sf, judged), _conversion_documents(spark, sf, judged), folder)
    return folder


def written_items(spark: SparkSession, sf: str) -> DataFrame:
    """Write both documents of every recording, then scan the folders as a catalog."""
    found = read_items(spark, _written(spark, sf))
    return found.select("audio_id", "source_hash", "source_file_identity", "conversion_signature", "duration_seconds")


def written_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of the written timeline files."""
    documents = read_pieces(spark, _written(spark, sf)).filter("document = 'timeline'")
    turn = "struct<index:bigint, start_ms:bigint, end_ms:bigint, speaker:string, transcription_segment_index:bigint, text:string>"
    parsed = documents.select("item_id", F.from_json("text", f"turn_count bigint, turns array<{turn}>").alias("d"))
    return parsed.select("item_id", "d.turn_count", F.inline("d.turns")).withColumnRenamed("transcription_segment_index", "seg_index")


def stored_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turn table and headers, counted per recording from what was stored."""
    headers, turns = _timeline(spark, sf, segments.stored_validation(spark, sf))
    per_stretch = turns.groupBy("media_id", "stretch").agg(
        F.count(F.lit(1)).alias("n"), F.min("index").alias("first"), F.max("index").alias("last"), F.sum(F.length("text")).alias("chars")
    )
    counted = per_stretch.groupBy("media_id").agg(
        F.sum("n").alias("n_turns"), F.max("last").alias("last_index"), F.min("first").alias("first_index"), F.sum("chars").alias("chars")
    )
    return headers.join(counted, "media_id", "left").select(
        "media_id", "turn_count", F.coalesce("n_turns", F.lit(0)).alias("n_turns"), "first_index", "last_index", "chars",
        F.col("source.source_hash").alias("source_hash"),
    )


def conversion_counts(spark: SparkSession, sf: str) -> DataFrame:
    documents = _conversion_documents(spark, sf)
    return documents.select(
        "media_id",
        F.col("counts.speech_candidate_ranges").alias("ranges"),
        F.col("pipeline.speech_transcription.segment_count").alias("segments"),
        F.col("pipeline.speech_activity_detection.parameters.min_silence_duration_ms").alias("min_silence_ms"),
        F.size("processing_flow").alias("steps"),
        F.col("output_files.timeline").alias("timeline_file"),
    )


def appended_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Append the completed items of every run, then read the catalog."""
    folder = scratch_path(spark, "catalog")
    manifest = runs.manifest(spark, sf).select(
        F.concat(F.lit("run-"), F.col("run_id").cast("string")).alias("run_id"),
        F.concat(F.lit("/runs/run-"), F.col("run_id").cast("string")).alias("run_dir"),
        F.concat(F.lit("a-"), F.col("item_pos").cast("string")).alias("audio_id"),
        F.sha2(F.col("item_pos").cast("string"), 256).alias("source_hash"),
        F.lit("sig-cpu").alias("conversion_signature"),
        F.concat(F.lit("src::"), F.col("item_pos").cast("string")).alias("source_file_identity"),
        F.concat(F.col("item_pos").cast("string"), F.lit(".wav")).alias("file_name"),
        (F.col("duration_seconds") / F.lit(1000.0)).alias("duration_seconds"),
        "status",
    )
    rows = sinks.catalog_rows(manifest, "/out/", F.lit("2026-01-01T00:00:00+00:00"))
    sinks.append_catalog(rows, folder)
    return spark.read.schema(rows.schema).parquet(folder).select(
        "run_id", "audio_id", "artifact_path", "source_hash", "duration_seconds"
    )


def written_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Write the classification of all inputs partitioned by run and roll it up from the files."""
    folder = scratch_path(spark, "manifest")
    classified = catalogs.classify(spark, sf).withColumnRenamed("source_id", "run_id")
    sinks.write_manifest(classified.select("run_id", "path", "status", "duplicate_status"), folder)
    return spark.read.parquet(folder).groupBy("run_id", "status", "duplicate_status").agg(
        F.count(F.lit(1)).alias("files")
    )


def written_work_list(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "work-list")
    sinks.write_work_list(catalogs.plan(spark, sf, limit=25), folder)
    return spark.read.parquet(folder).groupBy("action", "reason").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")
    )


def written_performance(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "performance")
    known = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("run_id"),
        F.lit("cpu").alias("compute_mode"),
        (F.col("n_nationkey") * 12.5).alias("run_wall_seconds"),
    )
    performance = run_performance(known, runs.staged_items(spark, sf))
    sinks.write_performance(performance, folder)
    schema = performance.drop("run_id").schema
    return spark.read.schema(schema).json(folder).select(
        F.col("run_id").cast("bigint").alias("run_id"), F.col("item_counts.total").alias("items_total"),
        F.col("throughput.completed_audio_seconds_per_wall_second").alias("throughput"),
    )


def exported(spark: SparkSession, sf: str) -> DataFrame:
    """Export every recording and read the package back."""
    folder = scratch_path(spark, "export")
    judged = segments.stored_validation(spark, sf)
    as_item = F.concat(F.lit("Item-"), F.col("media_id").cast("string")).alias("item_id")
    stored = _sources(spark, sf).select(as_item, F.lit("available").alias("status"))
    wanted = table(spark, sf, "conversations").select(F.concat(F.lit("item-"), F.col("conv_id").cast("string")).alias("id_key"))
    requested = wanted.distinct().withColumn("requested_id", F.col("id_key"))
    manifest, missing = items.export_items(stored, requested)
    headers, turns = (df.withColumn("item_id", as_item).drop("media_id") for df in _timeline(spark, sf, judged))
    infos = _conversion_documents(spark, sf, judged).withColumn("item_id", as_item).drop("media_id")
    sinks.export_items(manifest, missing, timeline.document_pieces(headers, turns, infos, "item_id"), folder)
    # Turns are counted in the documents that were read back.
    read = read_pieces(spark, f"{folder}/items").withColumn(
        "d", F.from_json("text", "turns array<struct<text:string>>, counts struct<transcript_segments:bigint>")
    )
    return read.groupBy("item_id").agg(
        F.max(F.when(F.col("document") == "timeline", F.size("d.turns"))).cast("bigint").alias("turn_count"),
        F.max("d.counts.transcript_segments").alias("transcript_segments"),
    )


def streamed_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The refresh plan of the whole inventory, planned from a stream of documents."""
    folder = scratch_path(spark, "intake")
    stream = table_stream(spark, sf, "documents")
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav"))
    inventory = stream.select(
        F.col("source").alias("source_id"),
        path.alias("path"),
        F.concat("source", F.lit("::"), path).alias("source_file_identity"),
        F.sha2("text", 256).alias("source_hash"),
        F.col("n_chars").alias("size_bytes"),
    )
    query = start_intake(
        inventory, lambda: views.catalog(spark, sf), catalogs.SIGNATURE, f"{folder}/plan", f"{folder}/state"
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/plan").select("source_file_identity", "action", "reason", "duplicate_of")


def _logged_catalog(spark: SparkSession, sf: str) -> str:
    """The made catalog, appended to a log in three commits."""
    folder = scratch_path(spark, "catalog-log")
    rows = views.catalog(spark, sf).withColumn("artifact_path", F.concat(F.lit("/out/"), "audio_id", F.lit("/timeline.json")))
    limits = rows.agg(F.expr("percentile_approx(catalog_pos, array(0.4, 0.7))")).first()[0] or [0, 0]
    for low, high in ((None, limits[0]), (limits[0], limits[1]), (limits[1], None)):
        part = rows if low is None else rows.filter(F.col("catalog_pos") > low)
        part = part if high is None else part.filter(F.col("catalog_pos") <= high)
        append_log(part, folder, ["catalog_pos"])
    return folder


def logged_look_up(spark: SparkSession, sf: str) -> DataFrame:
    """Look-ups in the catalog log after it was compacted."""
    folder = _logged_catalog(spark, sf)
    compact_log(spark, folder)
    return catalogs.looked_up(spark, sf, read_log(spark, folder))


def indexed_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The refresh plan from a stream of several batches, each of which reads its own buckets of the catalog's index."""
    folder, log = scratch_path(spark, "indexed"), _logged_catalog(spark, sf)
    inventory = catalogs.named_inventory(spark, sf)
    inventory.repartition(4, "source_file_identity").write.parquet(f"{folder}/files")
    stream = spark.readStream.schema(inventory.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/files")
    start_intake(stream, log, catalogs.SIGNATURE, f"{folder}/plan", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/plan").select("source_file_identity", "action", "reason", "duplicate_of")


def streamed_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of events per user that a two-hour silence closed."""
    folder = scratch_path(spark, "sessions")
    events = table_stream(spark, sf, "events")
    updates = events.select(
        F.col("user_id").alias("run_id"), F.timestamp_millis(views.at_ms(F.col("ts"))).alias("updated_at")
    )
    query = (
        closed_sessions(updates, "0 seconds", gap="2 hours")
        .select(
            "run_id",
            F.unix_millis("first_update").alias("first_ms"),
            F.unix_millis("interrupted_at").alias("interrupted_ms"),
            "updates",
        )
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema("run_id bigint, first_ms bigint, interrupted_ms bigint, updates bigint").parquet(
        f"{folder}/out"
    )


def streamed_silent(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-ups as locks and other events as updates: who gives no event within three days of signing up."""
    folder = scratch_path(spark, "silent")

    def stream(test: str) -> DataFrame:
        events = table_stream(spark, sf, "events").filter(test)
        return events.select(F.col("user_id").alias("run_id"), F.timestamp_millis(views.at_ms(F.col("ts"))).alias("at"))

    locks = stream("event_type = 'signup'").withColumnRenamed("at", "locked_at")
    updates = stream("event_type <> 'signup'").withColumnRenamed("at", "updated_at")
    silent = silent_runs(locks, updates, "0 seconds", gap="3 days")
    query = (
        silent.select("run_id", F.unix_millis("locked_at").alias("locked_ms"))
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema("run_id bigint, locked_ms bigint").parquet(f"{folder}/out")


_DOCUMENTED = f"""with {segments.VALIDATED},
  m as (select media_id, max(end_ms) / 1000.0::double as duration, count(*) filter (state = 'validated') as accepted
    from validated group by 1)"""

QUERIES = {
    "s1_discover_files": (
        discovered,
        """select 'names' as source_id, cast(s_suppkey as bigint) as s_suppkey, length(s_name) + 1 as size_bytes,
          'names::s_suppkey=' || s_suppkey as identity_folder, '.txt' as extension from supplier""",
    ),
    "s3_content_hashes": (
        hashed,
        "select cast(s_suppkey as bigint) as s_suppkey, sha256(s_name || chr(10)) as source_hash from supplier",
    ),
    "k1_k2_s4_written_items": (
        written_items,
        """select cast(conv_id as varchar) as audio_id, sha256(cast(conv_id as varchar)) as source_hash,
          'src::' || conv_id as source_file_identity, 'sig-cpu' as conversion_signature,
          cast(sum(100 + length(text) % 4000) as double) / 1000 as duration_seconds from conversations group by conv_id""",
    ),
    "k1_written_turns": (
        written_turns,
        with_views(*segments.SEGMENT_VIEWS, query=f"""with {segments.VALIDATED}
        select cast(media_id as varchar) as item_id, count(*) over (partition by media_id) as turn_count,
          row_number() over (partition by media_id order by seg_index) as index, start_ms, end_ms, best_speaker as speaker,
          seg_index, text from validated where state = 'validated'"""),
    ),
    "a10_k1_turn_table": (
        stored_turns,
        with_views(*segments.SEGMENT_VIEWS, query=f"""with {segments.VALIDATED}
        select media_id, count(*) filter (state = 'validated') as turn_count, count(*) filter (state = 'validated') as n_turns,
          case when count(*) filter (state = 'validated') > 0 then 1 end as first_index,
          nullif(count(*) filter (state = 'validated'), 0) as last_index,
          cast(sum(length(text)) filter (state = 'validated') as bigint) as chars,
          sha256(cast(media_id as varchar)) as source_hash
        from validated group by media_id"""),
    ),
    "k2_conversion_documents": (
        conversion_counts,
        with_views(*segments.SEGMENT_VIEWS, query=f"""{_DOCUMENTED}
        select media_id, (select count(*) from speech_ranges r where r.media_id = m.media_id) as ranges,
          accepted as segments, 500 as min_silence_ms, 5 as steps, 'timeline.json' as timeline_file from m"""),
    ),
    "k3_catalog_append": (
        appended_catalog,
        with_views("history", query=f"""with {runs.MANIFEST} select 'run-' || run_id as run_id, 'a-' || item_pos as audio_id,
          '/out/a-' || item_pos || '/timeline.json' as artifact_path, sha256(cast(item_pos as varchar)) as source_hash,
          duration_seconds / 1000.0::double as duration_seconds from manifest where status = 'completed'"""),
    ),
    "k4_manifest": (
        written_manifest,
        with_views("inventory", "catalog", query=f"""with {catalogs.CLASSIFIED}
        select source_id as run_id, status, duplicate_status, count(*) as files from classified group by 1, 2, 3"""),
    ),
    "k7_written_work_list": (
        written_work_list,
        with_views("inventory", "catalog", query=f"""with {catalogs.LIMITED}
        select case when n > 25 then 'deferred' else action end as action,
          case when n > 25 then 'batch_limit' else reason end as reason, count(*) as files,
          cast(sum(size_bytes) as bigint) as bytes from limited group by 1, 2"""),
    ),
    "k5_written_performance": (
        written_performance,
        with_views("stage_events", query=f"""with {runs.STAGE_TIMES},
        audio as (select item_id % 13 as run_id, sum(item_id % 600) filter (item_id % 4 <> 0) as audio
          from (select distinct item_id from stage_times) group by 1)
        select cast(n_nationkey as bigint) as run_id, coalesce(total, 0) as items_total,
          case when audio > 0 and n_nationkey > 0
            then floor(audio / (n_nationkey * 12.5::double) * 1000 + 0.5::double) / 1000 end as throughput
        from nation left join sizes on run_id = n_nationkey left join audio using (run_id)"""),
    ),
    "k6_export": (
        exported,
        with_views(*segments.SEGMENT_VIEWS, query=f"""{_DOCUMENTED}
        select 'Item-' || media_id as item_id, accepted as turn_count, accepted as transcript_segments from m"""),
    ),
    "k3_s5_catalog_log": (logged_look_up, catalogs.QUERIES["j1_j2_catalog_look_up"][1]),
    "t1_indexed_plan": (indexed_plan, catalogs.QUERIES["k7_plan_refresh"][1]),
    "t1_streamed_plan": (streamed_plan, catalogs.QUERIES["k7_plan_refresh"][1]),
    "t2_streamed_silent": (
        streamed_silent,
        with_views("stage_events", query="""with locks as (select item_id, at_ms from stage_events where stage = 'extract_audio'),
        updates as (select item_id, at_ms from stage_events where stage <> 'extract_audio'),
        mark as (select least((select max(at_ms) from locks), (select max(at_ms) from updates)) as m)
        select item_id as run_id, at_ms as locked_ms from locks l, mark
        where at_ms + 259200000 < m and not exists (
          select 1 from updates u where u.item_id = l.item_id and u.at_ms between l.at_ms and l.at_ms + 259200000)"""),
    ),
    "t2_streamed_sessions": (
        streamed_sessions,
        with_views("stage_events", query="""with e as (
          select item_id, at_ms, case when at_ms - lag(at_ms) over w >= 7200000 then 1 else 0 end as fresh
          from stage_events window w as (partition by item_id order by at_ms)),
        s as (select *, sum(fresh) over (partition by item_id order by at_ms rows unbounded preceding) as n from e)
        select item_id as run_id, min(at_ms) as first_ms, max(at_ms) + 7200000 as interrupted_ms, count(*) as updates
        from s group by item_id, n having max(at_ms) + 7200000 <= (select max(at_ms) from e)"""),
    ),
}