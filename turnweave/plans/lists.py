"""Queries over whole lists: finished items, audio files, jobs, refresh reports, and run folders that are written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnweave.operators import listing, refresh, runs as run_operators
from turnweave.plans import catalogs, runs, views
from turnweave.plans.views import with_views
from turnweave.session import scratch_path
from turnweave.sinks import documents as sinks
from turnweave.sources import documents as document_sources, stages
from turnweave.sources.files import table
from turnweave.sources.item_folders import write_pieces
from turnweave.sources.run_folders import input_items, read_runs

NOW = "2026-06-01T08:00:00+00:00"


def _stamp(day, month: str) -> F.Column:
    return F.concat(F.lit(f"2026-{month}-"), F.lpad(day.cast("string"), 2, "0"))


def listed_items(spark: SparkSession, sf: str) -> DataFrame:
    """The list of finished items, with documents that exist for some of them only."""
    rows, pos = catalogs.listing(spark, sf), F.col("catalog_pos")
    rows = rows.withColumn("source_id", F.regexp_extract("source_file_identity", "^(.*?)::", 1))
    files = rows.filter("artifact_exists").select(F.col("artifact_path").alias("path"), _stamp(1 + pos % 20, "07").alias("modified_at"))
    infos = rows.filter(pos % 4 < 2).select(
        F.concat("item_dir", F.lit("/convert_info.json")).alias("path"), _stamp(1 + pos % 17, "07").alias("modified_at")
    )
    summaries = rows.filter(F.col("artifact_exists") & (pos % 3 != 1)).select(
        "artifact_path", (pos % 9).alias("turn_count"), (pos % 4).alias("speaker_count")
    )
    info = rows.filter(pos % 6 == 1).select(
        F.col("item_dir").alias("media_dir"), F.when(pos % 12 == 1, F.concat(F.lit("Talk "), pos.cast("string"))).alias("display_name"),
        F.concat(F.lit("/in/x/"), pos.cast("string"), F.lit(".mp3")).alias("original_path"),
    )
    return listing.list_items(rows, files.union(infos), "/out", summaries, info, catalogs.RESERVED)


def listed_files(spark: SparkSession, sf: str) -> DataFrame:
    """The list of audio files with their status, their place below configured roots and probed durations."""
    doc = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("bigint")
    rows = catalogs.all_file_status(spark, sf).withColumn("relative_path", F.col("path"))
    rows = rows.withColumn("modified_at", _stamp(1 + doc % 28, "03")).withColumn("path", F.concat(F.lit("/in/"), "source_id", F.lit("/"), "path"))
    roots = table(spark, sf, "documents").select(F.upper("source").alias("source_id")).distinct()
    root_path = F.when(F.length("source_id") > 4, F.concat(F.lit("D:\\Audio\\"), "source_id")).otherwise(F.concat(F.lit("/host/"), "source_id"))
    summaries = catalogs.views.catalog(spark, sf).filter("catalog_pos % 3 <> 0").groupBy(F.col("audio_id").alias("media_id")).agg(
        F.max(F.col("catalog_pos") % 9).alias("turn_count"), F.max(F.col("catalog_pos") % 4).alias("speaker_count")
    )
    probes = rows.select("path", ((doc % 11) / F.lit(8.0)).alias("probe_seconds"))
    return listing.list_files(rows, roots.withColumn("root_path", root_path), summaries, probes)


def job_payloads(spark: SparkSession, sf: str) -> DataFrame:
    key = F.regexp_extract("run_id", "([0-9]+)$", 1).cast("bigint")
    warned = F.when(key % 3 == 0, F.array(F.lit("short file"), F.concat(F.lit("w"), (key % 4).cast("string"))))
    rows = runs.made_runs(spark, sf).withColumn("current_item", F.when(key % 2 == 0, F.concat(F.lit("talk-"), key.cast("string"))))
    rows = rows.withColumn("estimated_remaining_sec", F.when(key % 5 < 3, (key % 90) / F.lit(4.0))).withColumn("warnings", warned)
    found = run_operators.job_payload(rows.withColumn("completed_at", F.when(key % 7 == 0, F.lit(NOW))))
    return found.withColumn("warnings", F.array_join("warnings", "|"))


def refresh_report(spark: SparkSession, sf: str) -> DataFrame:
    inventory = catalogs.named_inventory(spark, sf)
    chosen = inventory.filter("source_id <> 'src3'")
    plan = refresh.plan_refresh(chosen, views.catalog(spark, sf), catalogs.SIGNATURE, limit=25)
    report = refresh.refresh_report(plan, inventory, ["/missing/a", "/missing/b"], catalogs.SIGNATURE, 25)
    return report.withColumn("missing_sources", F.array_join("missing_sources", "|"))


def _queued(spark: SparkSession, sf: str) -> DataFrame:
    """Queued files as the work of one run per source."""
    plan = catalogs.plan(spark, sf).filter("action = 'queued'")
    doc = F.regexp_extract("path", r"(\d+)\.wav$", 1)
    return plan.select(
        F.concat(F.lit("run-"), "source_id").alias("run_id"), F.concat(F.lit("ref-"), F.lpad(doc, 12, "0")).alias("input_id"),
        F.concat(F.lit("/in/"), "path").alias("path"), F.concat(doc, F.lit(".wav")).alias("file_name"), "size_bytes", "source_id",
        F.col("path").alias("relative_path"), "source_file_identity",
    )


def _run_folders(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "runs")
    sinks.write_runs(_queued(spark, sf), folder, NOW, {"compute_mode": "cpu", "generation_signature": catalogs.SIGNATURE})
    return read_runs(spark, [folder])


def written_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Run folders of the queued files, written and read back: one row per run."""
    found = _run_folders(spark, sf)
    return found.select(
        "run_id", "state", "current_stage", "items_total", "items_done", "compute_mode", "conversion_signature",
        F.size("input_items").cast("bigint").alias("inputs"), F.size("items").cast("bigint").alias("manifest_items"), "updated_at",
    )


def written_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """The files that the written requests list, in their order."""
    return input_items(_run_folders(spark, sf)).select(
        "run_id", "item_pos", "input_id", "original_path", "display_name", "size_bytes", "source_relative_path", "source_file_identity"
    )


def source_records(spark: SparkSession, sf: str) -> DataFrame:
    """Source records from written item folders: ``source.json`` where it is, broken for some, else the timeline's source."""
    folder, doc = scratch_path(spark, "records"), F.col("doc_id")
    documents = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("item_id"))
    named = lambda text: F.struct(F.concat(F.lit(text), "item_id").alias("display_name"))
    timeline = F.to_json(F.struct(named("timeline ").alias("source")))
    own = F.when(doc % 6 == 0, F.lit("{broken")).otherwise(F.to_json(named("source ")))
    pieces = documents.select("item_id", F.lit("timeline").alias("document"), F.lit(0).alias("piece"), timeline.alias("text")).union(
        documents.filter(doc % 2 == 0).select("item_id", F.lit("source"), F.lit(0), own)
    )
    write_pieces(pieces, folder)
    found = document_sources.read_source_info(spark, folder)
    return found.select(F.regexp_extract("media_dir", "([^/]+)$", 1).alias("item_id"), "display_name")


def _stage_folder(spark: SparkSession, sf: str) -> str:
    """Both tool outputs of every recording as JSON files in its folder."""
    folder = scratch_path(spark, "stages")
    turns = views.speaker_turns(spark, sf).groupBy(F.col("media_id").cast("string").alias("item_id")).agg(
        F.array_sort(F.collect_list(F.struct("turn_pos", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "speaker"))).alias("turns")
    )
    line = F.struct(
        F.col("seg_index").alias("index"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"),
        F.concat(F.lit("  "), "text").alias("text"), F.when(F.col("seg_index") % 2 == 0, F.col("logprob_milli") / 1000).alias("avg_logprob"),
    )
    said = views.raw_segments(spark, sf).groupBy(F.col("media_id").cast("string").alias("item_id")).agg(F.array_sort(F.collect_list(line)).alias("segments"))
    whole = lambda df, name: df.select("item_id", F.lit(name).alias("document"), F.lit(0).alias("piece"), F.to_json(F.struct(F.lit("ok").alias("status"), df.columns[1])).alias("text"))
    write_pieces(whole(turns, "diarize").union(whole(said, "transcribe")), folder)
    return folder


def read_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Speaker turns from the files that the diarization tool leaves."""
    found, _ = stages.read_stage_outputs(spark, _stage_folder(spark, sf))
    return found.select("media_id", "turn_pos", F.round(F.col("start") * 1000).cast("bigint").alias("start_ms"), "speaker")


def read_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Transcript segments from the files that the transcription tool leaves."""
    _, found = stages.read_stage_outputs(spark, _stage_folder(spark, sf))
    milli = lambda name: F.round(F.col(name) * 1000).cast("bigint").alias(f"{name}_milli")
    return found.select("media_id", "seg_index", milli("start"), milli("end"), milli("avg_logprob"), F.regexp_count("text", F.lit(" ")).alias("blanks"))


_QUEUED = f"""with {catalogs.FOUND},
queued as (
  select 'run-' || source_id as run_id, 'ref-' || lpad(d, 12, '0') as input_id, '/in/' || relative_path as original_path,
    d || '.wav' as display_name, size_bytes, relative_path as source_relative_path, source_file_identity
  from (select *, regexp_extract(relative_path, '([0-9]+)\\.wav$', 1) as d from planned) where action = 'queued')"""

QUERIES = {
    "j16_p31_list_items": (
        listed_items,
        with_views("catalog", query=f"""with {catalogs.LISTING},
        known as (
          select *, catalog_pos % 10 <> 0 as safe, case when catalog_pos % 3 = 0 then ' ' else audio_id end as media,
            case when artifact_exists then '2026-07-' || lpad(cast(1 + catalog_pos % 20 as varchar), 2, '0') end as line_time,
            case when catalog_pos % 4 < 2 and catalog_pos % 10 <> 0
              then '2026-07-' || lpad(cast(1 + catalog_pos % 17 as varchar), 2, '0') end as info_time,
            case when catalog_pos % 6 = 1 and catalog_pos % 10 <> 0 and catalog_pos % 12 = 1 then 'Talk ' || catalog_pos end as shown,
            case when catalog_pos % 6 = 1 and catalog_pos % 10 <> 0 then catalog_pos || '.mp3' end as original,
            artifact_exists and catalog_pos % 3 <> 1 as counted from listing)
        select catalog_pos, item_id, media as media_id, run_id, run_dir, regexp_extract(source_file_identity, '^(.*?)::', 1) as source_id,
          coalesce(source_relative_path, '') as source_relative_path, source_file_identity,
          coalesce(shown, nullif(regexp_extract(coalesce(source_relative_path, ''), '([^/]*)$', 1), ''), original, media)
            as source_file_name, source_hash, conversion_signature, nullif(duration_seconds, 0) as duration_sec, created_at,
          coalesce(greatest(line_time, info_time), updated_at) as updated_at,
          case when artifact_path is null then 'missing_artifact' else 'available' end as status,
          coalesce(artifact_path, '') as artifact_path, case when safe then item_dir else '' end as media_dir,
          case when counted then catalog_pos % 9 else 0 end as turn_count,
          case when counted then catalog_pos % 4 else 0 end as speaker_count from known"""),
    ),
    "j6_list_files": (
        listed_files,
        with_views("inventory", "catalog", query=f"""with status as ({catalogs.QUERIES["j6_file_status"][1]}),
        summaries as (select audio_id as media_id, max(catalog_pos % 9) as turns, max(catalog_pos % 4) as speakers
          from catalog where catalog_pos % 3 <> 0 group by 1),
        files as (select *, cast(regexp_extract(relative_path, '([0-9]+)\\.wav$', 1) as bigint) as d,
          lang_of, case when length(source_id) > 4 then 'D:\\Audio\\' || upper(source_id) else '/host/' || upper(source_id) end as root
          from (select *, regexp_extract(relative_path, '^(.*)/', 1) as lang_of from inventory))
        select source_id, source_id as source_display_name, root as root_path, relative_path, lang_of as directory, d || '.wav' as file_name,
          case when length(source_id) > 4 then root || '\\' || lang_of || '\\' || d || '.wav' else root || '/' || relative_path end
            as display_path, '/in/' || source_id || '/' || relative_path as container_path, size_bytes,
          '2026-03-' || lpad(cast(1 + d % 28 as varchar), 2, '0') as modified_at,
          coalesce(duration_sec, floor(nullif(d % 11, 0) / 8.0::double * 1000 + 0.5) / 1000) as duration_sec, status,
          case when by_run then 'run-' || d % 9 else '' end as run_id, media_id, turns is not null as has_timeline, false as has_audio,
          coalesce(turns, 0) as turn_count, coalesce(speakers, 0) as speaker_count, source_file_identity
        from files join (select *, media_id like 'm-%' as by_run from status) using (source_file_identity)
          left join summaries using (media_id)"""),
    ),
    "p29_job_payload": (
        job_payloads,
        f"""with {runs.RUNS}, shown as ({runs.QUERIES["p28_p29_job_view"][1]})
        select s.*, case when k % 2 = 0 then 'talk-' || k else '' end as current_item,
          case when k % 5 < 3 then (k % 90) / 4.0::double end as estimated_remaining_sec,
          coalesce(cast(started_at as varchar), '') as started_at, coalesce(cast(updated_at as varchar), '') as updated_at,
          case when k % 7 = 0 then '{NOW}' else '' end as completed_at,
          case when k % 3 = 0 then 'short file|w' || k % 4 else '' end as warnings
        from shown s join runs on run_id = job_id""",
    ),
    "a15_refresh_report": (
        refresh_report,
        with_views("inventory", "catalog", query=f"""with {catalogs.FOUND}, chosen as (select * from planned where source_id <> 'src3')
        select (select count(*) from inventory) as total_discovered, '/missing/a|/missing/b' as missing_sources,
          count(*) as selected_count, least(count(*) filter (action = 'queued'), 25) as queued_count,
          count(*) filter (action = 'skipped') as skipped_count, greatest(count(*) filter (action = 'queued') - 25, 0) as deferred_count,
          25 as queued_limit, 'sig-cpu' as generation_signature, 'timeline' as artifact from chosen"""),
    ),
    "k7_s6_run_folders": (
        written_runs,
        with_views("inventory", "catalog", query=f"""{_QUEUED}
        select run_id, 'pending' as state, 'queued' as current_stage, count(*) as items_total, 0 as items_done, 'cpu' as compute_mode,
          'sig-cpu' as conversion_signature, count(*) as inputs, 0 as manifest_items, '{NOW}' as updated_at from queued group by run_id"""),
    ),
    "k7_s6_run_inputs": (
        written_inputs,
        with_views("inventory", "catalog", query=f"""{_QUEUED}
        select run_id, row_number() over (partition by run_id order by input_id) - 1 as item_pos, input_id, original_path, display_name,
          size_bytes, source_relative_path, source_file_identity from queued"""),
    ),
    "s9_read_turns": (
        read_turns,
        with_views("speaker_turns", query="""select cast(media_id as varchar) as media_id,
          row_number() over (partition by media_id order by turn_pos) - 1 as turn_pos, start_ms, speaker from speaker_turns"""),
    ),
    "s9_read_segments": (
        read_segments,
        with_views("raw_segments", query="""with read as (
          select media_id, row_number() over (partition by media_id order by seg_index) as seg_index, start_ms as start_milli, end_ms as end_milli,
            case when seg_index % 2 = 0 then logprob_milli end as avg_logprob_milli, trim(regexp_replace(text, '\\s+', ' ', 'g')) as said
          from raw_segments)
        select cast(media_id as varchar) as media_id, seg_index, start_milli, end_milli, avg_logprob_milli,
          length(said) - length(replace(said, ' ', '')) as blanks from read where said <> ''"""),
    ),
    "s11_read_source_info": (
        source_records,
        """select cast(doc_id as varchar) as item_id, case when doc_id % 6 = 0 then null when doc_id % 2 = 0 then 'source ' || doc_id
          else 'timeline ' || doc_id end as display_name from documents""",
    ),
}
