"""Queries over runs, stages and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnweave.functions.numbers import completed_percent, naive_remaining, scaled_wall_seconds, stage_fraction
from turnweave.operators import forecast, refresh, runs
from turnweave.plans import views
from turnweave.plans.views import with_views
from turnweave.sources.files import table
from turnweave.sources.run_folders import distinct_run_dirs

STAGES = ("extract_audio", "detect_speech_candidates", "diarize_audio", "transcribe_audio", "generate_artifacts")


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return views.history(spark, sf).select(
        F.col("run_no").alias("run_id"),
        F.col("sample_pos").alias("item_pos"),
        F.col("bitrate").cast("bigint").alias("size_bytes"),
        F.col("duration_ms").alias("duration_seconds"),
        F.when(F.col("sample_pos") % 11 == 0, "skipped_duplicate").otherwise(F.col("status")).alias("status"),
        "wall_ms",
    )


MANIFEST = """
manifest as (
  select run_no as run_id, sample_pos as item_pos, cast(bitrate as bigint) as size_bytes,
    duration_ms as duration_seconds,
    case when sample_pos % 11 = 0 then 'skipped_duplicate' else status end as status, wall_ms from history)"""


def rollup(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"))
    return runs.run_rollup(known, manifest(spark, sf))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return runs.item_counts(manifest(spark, sf))


def outcome(spark: SparkSession, sf: str) -> DataFrame:
    rows = manifest(spark, sf).withColumn("run_id", F.col("item_pos") % 1013)
    return runs.run_outcome(rows.filter("status <> 'queued'"))


def stage_times(spark: SparkSession, sf: str) -> DataFrame:
    return runs.stage_durations(views.stage_events(spark, sf), at="at_ms").withColumnRenamed("elapsed", "elapsed_ms")


def staged_items(spark: SparkSession, sf: str) -> DataFrame:
    maps = runs.stage_maps(
        runs.stage_durations(views.stage_events(spark, sf), at="at_ms").withColumn(
            "elapsed", F.col("elapsed") / F.lit(1000.0)
        )
    )
    item = F.col("item_id")
    return maps.select(
        (item % 13).alias("run_id"),
        F.when(item % 4 == 0, "failed").otherwise("completed").alias("status"),
        (item % 600).cast("double").alias("duration_seconds"),
        "stage_elapsed_seconds",
    )


def stage_performance(spark: SparkSession, sf: str) -> DataFrame:
    return runs.stage_performance(staged_items(spark, sf))


def run_performance(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("run_id"),
        F.lit("cpu").alias("compute_mode"),
        (F.col("n_nationkey") * 12.5).cast("double").alias("run_wall_seconds"),
    )
    found = runs.run_performance(known, staged_items(spark, sf))
    return found.select(
        "run_id",
        F.col("item_counts.total").alias("items_total"),
        F.col("item_counts.completed").alias("items_completed"),
        F.col("duration_seconds.completed_audio").alias("completed_audio"),
        F.col("duration_seconds.run_wall").alias("run_wall"),
        F.col("throughput.completed_audio_seconds_per_wall_second").alias("throughput"),
        F.coalesce(F.array_size(F.map_keys("stages")), F.lit(0)).alias("stage_count"),
        F.try_element_at("stages", F.lit("diarize_audio")).getField("max_wall_seconds").alias("diarize_max"),
    )


STAGE_TIMES = """
stepped as (
  select item_id, stage, lead(at_ms) over (partition by item_id order by event_pos) - at_ms as elapsed
  from stage_events),
stage_times as (
  select item_id, stage, cast(sum(greatest(coalesce(elapsed, 0), 0)) as bigint) as elapsed_ms from stepped group by 1, 2),
staged as (
  select *, item_id % 13 as run_id, case when item_id % 4 = 0 then 'failed' else 'completed' end as status
  from stage_times),
sizes as (
  select item_id % 13 as run_id, count(distinct item_id) filter (item_id % 4 <> 0) as completed,
    count(distinct item_id) as total from stage_times group by 1)"""


def _status_rows(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    stages = F.array(*[F.lit(s) for s in ("queued", "preflight", *STAGES, "llm_export", "completed", "other")])
    return table(spark, sf, "orders").select(
        key.alias("run_id"),
        F.element_at(stages, (key % 10 + 1).cast("int")).alias("current_stage"),
        ((key * 7) % 400 / F.lit(8.0)).alias("current_stage_elapsed_sec"),
        ((key * 13) % 3000 / F.lit(4.0)).alias("current_item_duration_sec"),
        F.when(key % 3 == 0, "gpu").otherwise("cpu").alias("compute_mode"),
        ((key * 17) % 5000 / F.lit(2.0)).alias("processed_duration_sec"),
        F.when(key % 4 == 0, F.lit(0.0)).otherwise(F.lit(3000.0)).alias("total_duration_sec"),
        (key % 9).alias("completed_items"),
        F.when(key % 8 == 0, F.lit(0)).otherwise(F.lit(10)).cast("bigint").alias("total_items"),
        ((key % 16) / F.lit(12.0)).alias("preflight_fraction"),
    )


_STATUS = """
status as (
  select o_orderkey as run_id,
    ['queued', 'preflight', 'extract_audio', 'detect_speech_candidates', 'diarize_audio', 'transcribe_audio',
     'generate_artifacts', 'llm_export', 'completed', 'other'][o_orderkey % 10 + 1] as stage,
    cast((o_orderkey * 7) % 400 as double) / 8 as elapsed, cast((o_orderkey * 13) % 3000 as double) / 4 as duration,
    case when o_orderkey % 3 = 0 then 'gpu' else 'cpu' end as mode,
    cast((o_orderkey * 17) % 5000 as double) / 2 as processed,
    cast(case when o_orderkey % 4 = 0 then 0 else 3000 end as double) as total, o_orderkey % 9 as completed_items,
    case when o_orderkey % 8 = 0 then 0 else 10 end as total_items, cast(o_orderkey % 16 as double) / 12 as preflight
  from orders),
expected as (
  select *, case stage
      when 'extract_audio' then greatest(1.5::double, least(25::double, d * 0.06::double))
      when 'detect_speech_candidates' then greatest(1::double, least(30::double, d * 0.08::double))
      when 'diarize_audio' then greatest(2::double, case when mode = 'gpu' then least(120::double, d * 0.10::double)
        else least(480::double, d * 0.45::double) end)
      when 'transcribe_audio' then greatest(4::double, case when mode = 'gpu' then least(180::double, d * 0.18::double)
        else least(720::double, d * 0.90::double) end)
      when 'generate_artifacts' then greatest(1::double, least(15::double, d * 0.03::double))
      when 'preflight' then greatest(1::double, least(10::double, d * 0.02::double)) else 5::double end as expected,
    case stage when 'detect_speech_candidates' then 0.18::double when 'diarize_audio' then 0.30::double
      when 'transcribe_audio' then 0.70::double when 'generate_artifacts' then 0.96::double else 0::double end as low,
    case stage when 'extract_audio' then 0.18::double when 'detect_speech_candidates' then 0.30::double
      when 'diarize_audio' then 0.70::double when 'transcribe_audio' then 0.94::double else 1::double end as high
  from (select *, greatest(1::double, duration) as d from status)),
inside as (
  select *, low + (high - low) * greatest(0::double, least(1::double, elapsed / greatest(expected, 0.1::double)))
    as fraction from expected)"""


def progress(spark: SparkSession, sf: str) -> DataFrame:
    return runs.with_progress(_status_rows(spark, sf)).select("run_id", "current_stage", "progress_percent")


def fractions(spark: SparkSession, sf: str) -> DataFrame:
    found = stage_fraction(
        F.col("current_stage"),
        F.col("current_stage_elapsed_sec"),
        F.col("current_item_duration_sec"),
        F.col("compute_mode"),
    )
    return _status_rows(spark, sf).select("run_id", F.floor(found * 1_000_000 + F.lit(0.5)).alias("fraction_ppm"))


def finished_percent(spark: SparkSession, sf: str) -> DataFrame:
    found = completed_percent(
        F.col("processed_duration_sec"), F.col("total_duration_sec"), F.col("completed_items"), F.col("total_items")
    )
    return _status_rows(spark, sf).select("run_id", found.alias("percent"))


def remaining_naive(spark: SparkSession, sf: str) -> DataFrame:
    found = naive_remaining(
        F.col("total_duration_sec"), F.col("processed_duration_sec"), F.col("current_stage_elapsed_sec")
    )
    return _status_rows(spark, sf).select("run_id", F.floor(found * 1000 + F.lit(0.5)).alias("remaining_ms"))


def made_runs(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    names = ("pending", "RUNNING", "completed", "failed", "cancelled", "skipped", "interrupted", "", "Odd ",
             "completed_with_errors")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("run-"), key.cast("string")).alias("run_id"),
        F.concat(F.lit("run-"), F.lpad((key * 7919 % 1_000_003).cast("string"), 7, "0")).alias("run_name"),
        F.concat(F.lit("/runs/"), F.lpad(key.cast("string"), 9, "0")).alias("run_dir"),
        F.element_at(F.array(*[F.lit(n) for n in names]), (key % 10 + 1).cast("int")).alias("state"),
        F.lit("transcribe_audio").alias("current_stage"),
        F.concat(F.lit("m"), (key % 5).cast("string")).alias("message"),
        F.when(key % 3 != 0, (key * 31 % 1300) / F.lit(8.0) - F.lit(20.0)).alias("progress_percent"),
        F.when(key % 4 != 0, key % 6).alias("items_done"),
        (key % 3).alias("items_skipped"),
        (key % 2).alias("items_failed"),
        F.lit(12).cast("bigint").alias("items_total"),
        F.when(key % 5 != 0, key * 11 % 100).alias("updated_at"),
        F.when(key % 7 != 0, key * 3 % 100).alias("started_at"),
        F.when(key % 6 != 0, key * 5 % 100).alias("locked_at"),
    )


RUNS = """
runs as (
  select 'run-' || o_orderkey as run_id, 'run-' || lpad(cast(o_orderkey * 7919 % 1000003 as varchar), 7, '0') as run_name,
    '/runs/' || lpad(cast(o_orderkey as varchar), 9, '0') as run_dir, o_orderkey as k,
    ['pending', 'RUNNING', 'completed', 'failed', 'cancelled', 'skipped', 'interrupted', '', 'Odd ',
     'completed_with_errors'][o_orderkey % 10 + 1] as state,
    ['queued', 'running', 'completed', 'failed', 'canceled', 'completed', 'interrupted', 'unknown', 'odd',
     'completed_with_errors'][o_orderkey % 10 + 1] as job_state,
    case when o_orderkey % 3 <> 0 then cast(o_orderkey * 31 % 1300 as double) / 8 - 20 end as progress,
    case when o_orderkey % 4 <> 0 then o_orderkey % 6 end as done,
    case when o_orderkey % 5 <> 0 then o_orderkey * 11 % 100 end as updated_at,
    case when o_orderkey % 7 <> 0 then o_orderkey * 3 % 100 end as started_at,
    case when o_orderkey % 6 <> 0 then o_orderkey * 5 % 100 end as locked_at from orders)"""


def job_views(spark: SparkSession, sf: str) -> DataFrame:
    return runs.job_view(made_runs(spark, sf))


def stale(spark: SparkSession, sf: str) -> DataFrame:
    return runs.classify_stale(made_runs(spark, sf), F.lit(100)).select("run_id", "stale", "state_now")


def run_dirs(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("/runs/run-"), (F.col("o_orderkey") % 5000).cast("string")).alias("run_dir")
    )
    lines = table(spark, sf, "lineitem").select(
        F.concat(F.lit("/runs/run-"), F.col("l_orderkey").cast("string"), F.lit("/")).alias("run_dir")
    )
    return distinct_run_dirs(orders, lines)


def active(spark: SparkSession, sf: str) -> DataFrame:
    return runs.active_run(made_runs(spark, sf)).select("run_id", "run_name")


def pending(spark: SparkSession, sf: str) -> DataFrame:
    marked = table(spark, sf, "supplier").select(F.concat(F.lit("run-"), F.col("s_suppkey").cast("string")).alias("run_id"))
    return runs.runs_in_state(made_runs(spark, sf), ["Pending", "running"], marked).select("run_id", "state")


def next_ready(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        F.concat(F.lit("run-"), F.col("l_orderkey").cast("string")).alias("run_id"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"),
    )
    existing = table(spark, sf, "part").filter("p_partkey % 7 <> 3").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path")
    )
    return runs.next_run(made_runs(spark, sf).filter("state = 'pending'"), lines, existing).select("run_id", "run_dir")


def warnings(spark: SparkSession, sf: str) -> DataFrame:
    rows = manifest(spark, sf).withColumn(
        "status",
        F.when(F.col("item_pos") % 23 == 0, "skipped_invalid")
        .when(F.col("item_pos") % 23 == 1, "skipped_too_short")
        .otherwise(F.col("status")),
    )
    failed = rows.filter("status = 'failed'").select(
        "run_id",
        "item_pos",
        F.lit(0).alias("warning_pos"),
        F.concat(F.lit("f"), F.col("item_pos").cast("string"), F.lit(".wav")).alias("display_name"),
        F.lit("no speech").alias("warning"),
    )
    return runs.run_warnings(refresh.skip_counts(rows, ["run_id"]), failed).select(
        "run_id", "part", "part_key", "item_pos", "warning"
    )


def processed(spark: SparkSession, sf: str) -> DataFrame:
    done = F.col("status") != "queued"
    found = refresh.running_duration(manifest(spark, sf), done=done)
    return found.select("run_id", "item_pos", F.col("processed_duration").alias("processed_ms"))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return views.history(spark, sf).select(
        "*",
        (F.col("duration_ms") / F.lit(1000.0)).alias("duration_seconds"),
        (F.col("wall_ms") / F.lit(1000.0)).alias("wall_seconds"),
    )


def _open_items(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf).filter("status = 'queued'")


def buckets(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.with_features(_history(spark, sf)).groupBy("f_rate", "f_bitrate").agg(
        F.count(F.lit(1)).alias("samples")
    )


def nearest(spark: SparkSession, sf: str) -> DataFrame:
    found = forecast.nearest_samples(_open_items(spark, sf), _history(spark, sf))
    return found.select("combination.*", "rank", "sample_pos", "score")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    found = forecast.predict_time(_open_items(spark, sf), _history(spark, sf))
    return found.select(
        "sample_pos",
        "total_seconds",
        "confidence",
        "sample_count",
        F.try_element_at("stage_seconds", F.lit("transcribe_audio")).alias("transcribe_seconds"),
    )


def staged_predictions(spark: SparkSession, sf: str) -> DataFrame:
    pos = F.col("sample_pos")
    times = [((pos * factor) % 50).cast("double") for factor in (3, 5, 7, 11, 13)]
    stages = F.create_map(*[part for name, value in zip(STAGES, times) for part in (F.lit(name), value)])
    past = _history(spark, sf).withColumn("stage_seconds", F.when(pos % 3 != 1, stages))
    found = forecast.predict_time(_open_items(spark, sf), past)
    return found.select(
        "sample_pos",
        *[F.try_element_at("stage_seconds", F.lit(name)).alias(name) for name in STAGES],
    )


def scaled_times(spark: SparkSession, sf: str) -> DataFrame:
    found = scaled_wall_seconds(
        F.col("duration_seconds"), F.col("wall_seconds"), (F.col("sample_pos") % 900).cast("double")
    )
    return _history(spark, sf).select("sample_pos", found.alias("scaled_seconds"))


def remaining(spark: SparkSession, sf: str) -> DataFrame:
    predicted = (
        forecast.predict_time(_open_items(spark, sf), _history(spark, sf))
        .withColumn("run_id", F.col("run_no"))
        .withColumn("item_pos", F.col("sample_pos"))
        .withColumn("duplicate_status", F.when(F.col("sample_pos") % 5 == 0, "duplicate_skip").otherwise("new"))
    )
    run = F.col("run_id")
    current = (
        views.history(spark, sf)
        .groupBy(F.col("run_no").alias("run_id"))
        .agg(F.min(F.when(F.col("status") == "queued", F.col("sample_pos"))).alias("_first"))
        .select(
            "run_id",
            F.when(run % 4 != 0, F.col("_first")).alias("current_item_pos"),
            F.when(run % 3 == 0, "transcribe_audio").when(run % 3 == 1, "").alias("current_stage"),
            (run % 7).cast("double").alias("current_stage_elapsed_sec"),
            (run % 50).cast("double").alias("current_item_elapsed_sec"),
            F.when(run % 5 != 0, (run * 100).cast("double")).alias("legacy_remaining_sec"),
        )
    )
    return forecast.remaining_time(predicted, current).select("run_id", "estimated_remaining_sec", "predicted_items")


_NEAREST = """
featured as (
  select *, case when audio_sample_rate <= 0 then 'unknown' when audio_sample_rate <= 16000 then 'narrowband'
      when audio_sample_rate <= 24000 then 'voice' when audio_sample_rate <= 48000 then 'standard' else 'high' end as rate,
    case when bitrate <= 0 then 'unknown' when bitrate <= 96000 then 'low' when bitrate <= 192000 then 'standard'
      when bitrate <= 320000 then 'high' else 'lossless' end as bits,
    cast(duration_ms as double) / 1000 as dur, cast(wall_ms as double) / 1000 as wall from history),
wanted as (
  select distinct compute_mode, audio_codec, audio_channels, rate, bits, container_name from featured
  where status = 'queued'),
scored as (
  select w.*, h.sample_pos, h.dur, h.wall,
    1.0::double + case when w.audio_codec = h.audio_codec then 3 else 0 end
      + case when w.container_name = h.container_name then 1 else 0 end
      + case when w.audio_channels = h.audio_channels then 2 else 0 end
      + case when w.rate = h.rate then 1.5::double else 0 end
      + case when w.bits = h.bits then 1.5::double else 0 end as score
  from wanted w join featured h on h.compute_mode = w.compute_mode and h.status = 'completed'),
nearest as (
  select * from (
    select *, row_number() over (partition by compute_mode, audio_codec, audio_channels, rate, bits, container_name
      order by score desc, sample_pos) as rank from scored) where rank <= 12)"""

_PREDICTED = f"""
{_NEAREST},
open_items as (select * from featured where status = 'queued'),
pairs as (
  select i.sample_pos, n.rank, n.score, n.sample_pos as past_pos,
    greatest(1::double, floor((least(12::double, n.wall * 0.35::double) +
      greatest(0::double, n.wall - least(12::double, n.wall * 0.35::double)) *
      greatest(0.25::double, least(4::double, greatest(1::double, i.dur) / greatest(1::double, n.dur))))
      * 1000 + 0.5::double) / 1000) as scaled
  from open_items i join nearest n using (compute_mode, audio_codec, audio_channels, rate, bits, container_name)),
sums as (
  select sample_pos, count(*) as n, sum(score) as weight, sum(score * scaled order by rank) as weighted,
    sum(score * 0.42::double order by rank) / sum(score) as transcribe_share,
    sum(score * 0.06::double order by rank) / sum(score) as generate_share from pairs
  group by 1),
predicted as (
  select sample_pos, n as sample_count, weighted / weight as raw, transcribe_share, generate_share,
    greatest(1::double, floor(weighted / weight * 1000 + 0.5::double) / 1000) as total_seconds,
    floor(least(0.9::double, 0.15::double + 0.55::double * least(1::double, n / 5.0::double) +
      0.30::double * least(1::double, weight / n / 9.0::double)) * 1000 + 0.5::double) / 1000 as confidence
  from sums)"""

_SHARES = (
    ("extract_audio", 0.12, 3),
    ("detect_speech_candidates", 0.10, 5),
    ("diarize_audio", 0.30, 7),
    ("transcribe_audio", 0.42, 11),
    ("generate_artifacts", 0.06, 13),
)
_TOTAL = " + ".join(f"(past_pos * {factor}) % 50" for _, _, factor in _SHARES)
_STAGED = ", ".join(
    f"floor(raw * (sum(score * case when past_pos % 3 <> 1 and {_TOTAL} > 0 then "
    f"cast((past_pos * {factor}) % 50 as double) / ({_TOTAL}) else {share}::double end order by rank) / sum(score)) "
    f"* 1000 + 0.5::double) / 1000 as {name}"
    for name, share, factor in _SHARES
)


def _stage_left(elapsed: str) -> str:
    stage = lambda share: f"floor(p.raw * p.{share} * 1000 + 0.5::double) / 1000"
    return (
        f"floor((greatest(0::double, {stage('transcribe_share')} - {elapsed}) + {stage('generate_share')}) * 1000 + 0.5::double) / 1000"
    )


QUERIES = {
    "a2_run_rollup": (
        rollup,
        with_views("history", query=f"""with {MANIFEST} select c_custkey as run_id,
          cast(coalesce(sum(size_bytes), 0) as bigint) as total_size_bytes,
          cast(coalesce(sum(duration_seconds), 0) as bigint) as total_duration_sec
        from customer left join manifest on run_id = c_custkey group by 1"""),
    ),
    "a5_item_counts": (
        counts,
        with_views("history", query=f"""with {MANIFEST} select run_id, count(*) as items_total,
          count(*) filter (status = 'completed') as items_completed,
          count(*) filter (status like 'skipped%') as items_skipped, count(*) filter (status = 'failed') as items_failed,
          cast(sum(duration_seconds) as bigint) as total_audio,
          cast(coalesce(sum(duration_seconds) filter (status <> 'queued'), 0) as bigint) as processed_audio,
          cast(coalesce(sum(duration_seconds) filter (status = 'completed'), 0) as bigint) as completed_audio
        from manifest group by 1"""),
    ),
    "a16_run_outcome": (
        outcome,
        with_views("history", query=f"""with {MANIFEST} select item_pos % 1013 as run_id,
          case when count(*) filter (status = 'failed') > 0 then 'failed' else 'completed' end as state,
          count(*) filter (status = 'completed') as processed_count,
          count(*) filter (status like 'skipped%') as skipped_count, count(*) filter (status = 'failed') as error_count
        from manifest where status <> 'queued' group by 1"""),
    ),
    "a16_run_warnings": (
        warnings,
        with_views("history", query=f"""with {MANIFEST},
        m as (select *, case item_pos % 23 when 0 then 'skipped_invalid' when 1 then 'skipped_too_short'
          else status end as st from manifest)
        select run_id, 0 as part, st as part_key, 0 as item_pos, case st when 'skipped_invalid'
          then 'preflight: skipped ' || count(*) || ' invalid audio file(s).'
          else 'preflight: skipped ' || count(*) || ' audio file(s) shorter than 2.0s.' end as warning
        from m where st in ('skipped_invalid', 'skipped_too_short') group by run_id, st
        union all select run_id, 1, '', item_pos, 'f' || item_pos || '.wav: no speech' from m where st = 'failed'"""),
    ),
    "a7_running_duration": (
        processed,
        with_views("history", query=f"""with {MANIFEST} select run_id, item_pos,
          cast(sum(case when status <> 'queued' then duration_seconds else 0 end) over (partition by run_id
            order by item_pos rows unbounded preceding) as bigint) as processed_ms from manifest"""),
    ),
    "w10_stage_durations": (
        stage_times,
        with_views("stage_events", query=f"with {STAGE_TIMES} select item_id, stage, elapsed_ms from stage_times"),
    ),
    "a4_stage_performance": (
        stage_performance,
        with_views("stage_events", query=f"""with {STAGE_TIMES} select s.run_id, stage,
          floor(cast(sum(elapsed_ms) as double) / 1000 * 1000 + 0.5::double) / 1000 as total_wall_seconds,
          floor(cast(sum(elapsed_ms) as double) / 1000 / any_value(z.completed) * 1000 + 0.5::double) / 1000
            as average_wall_seconds,
          floor(max(elapsed_ms / 1000.0::double) * 1000 + 0.5::double) / 1000 as max_wall_seconds
        from staged s join sizes z using (run_id) where status = 'completed' group by 1, 2"""),
    ),
    "k5_run_performance": (
        run_performance,
        with_views("stage_events", query=f"""with {STAGE_TIMES},
        per as (select run_id, count(distinct stage) as stage_count,
          max(case when stage = 'diarize_audio' then elapsed_ms end) as diarize from staged where status = 'completed'
          group by 1),
        audio as (select item_id % 13 as run_id, sum(item_id % 600) filter (item_id % 4 <> 0) as audio
          from (select distinct item_id from stage_times) group by 1),
        known as (select n_nationkey as run_id, cast(n_nationkey as double) * 12.5 as wall from nation)
        select k.run_id, coalesce(total, 0) as items_total, coalesce(completed, 0) as items_completed,
          cast(coalesce(audio, 0) as double) as completed_audio, wall as run_wall,
          case when audio > 0 and wall > 0 then floor(audio / wall * 1000 + 0.5::double) / 1000 end as throughput,
          coalesce(stage_count, 0) as stage_count, floor(diarize / 1000.0::double * 1000 + 0.5::double) / 1000
            as diarize_max
        from known k left join sizes using (run_id) left join per using (run_id) left join audio using (run_id)"""),
    ),
    "p25_progress": (
        progress,
        f"""with {_STATUS} select run_id, stage as current_stage, case
          when stage = 'queued' then 0
          when stage = 'preflight' then floor(5 * least(1::double, preflight) * 10 + 0.5::double) / 10
          when stage = 'llm_export' then floor((95 + 4 * least(1::double, elapsed / 5)) * 10 + 0.5::double) / 10
          when stage = 'completed' then 100
          when total > 0 then floor((5 + 90 * (least(total, processed + duration * fraction) / total)) * 10
            + 0.5::double) / 10
          when total_items <= 0 then 0
          else floor((5 + 90 * greatest(0::double, least(1::double, (completed_items + fraction) / total_items))) * 10
            + 0.5::double) / 10 end as progress_percent from inside""",
    ),
    "p23_p24_stage_fraction": (
        fractions,
        f"with {_STATUS} select run_id, cast(floor(fraction * 1000000 + 0.5::double) as bigint) as fraction_ppm from inside",
    ),
    "p25_completed_percent": (
        finished_percent,
        f"""with {_STATUS} select run_id, case when total > 0
            then floor((5 + 90 * least(1::double, processed / total)) * 10 + 0.5::double) / 10
          when total_items <= 0 then 0
          else floor((5 + 90 * least(1::double, completed_items / total_items)) * 10 + 0.5::double) / 10 end as percent
        from status""",
    ),
    "p34_naive_remaining": (
        remaining_naive,
        f"""with {_STATUS} select run_id, case when total > 0 and processed > 0 and elapsed > 0 then
          cast(floor(greatest(0::double, (total - processed) / (processed / elapsed)) * 1000 + 0.5::double) as bigint) end
            as remaining_ms from status""",
    ),
    "p28_p29_job_view": (
        job_views,
        f"""with {RUNS} select run_id as job_id, job_state as state, 'transcribe_audio' as stage, 'm' || k % 5 as message,
          floor(greatest(0::double, least(100::double, coalesce(nullif(progress, 0),
            case when job_state in ('completed', 'completed_with_errors') then 100 else 0 end))) * 100 + 0.5::double) / 100
            as percent,
          coalesce(done, 0) + k % 3 + k % 2 as current, 12 as total,
          case when job_state in ('failed', 'completed_with_errors', 'interrupted') then 'm' || k % 5 end as error
        from runs""",
    ),
    "t2_classify_stale": (
        stale,
        f"""with {RUNS}, s as (select *, locked_at is not null and coalesce(100 - case when lower(state) = 'running'
            then coalesce(updated_at, started_at, locked_at) else locked_at end > 30, false) as stale from runs)
        select run_id, stale, case when lower(state) = 'running' and (stale or locked_at is null) then 'interrupted'
          else trim(lower(state)) end as state_now from s""",
    ),
    "u4_run_dirs": (
        run_dirs,
        """select '/runs/' || run_name as run_dir, run_name from (
          select 'run-' || o_orderkey % 5000 as run_name from orders union select 'run-' || l_orderkey from lineitem)""",
    ),
    "o6_active_run": (
        active,
        f"""with {RUNS} select run_id, run_name from runs where lower(state) in ('pending', 'running')
        order by run_name desc limit 1""",
    ),
    "o8_runs_in_state": (
        pending,
        f"""with {RUNS} select run_id, state from runs where lower(state) in ('pending', 'running')
        and run_id not in (select 'run-' || s_suppkey from supplier)""",
    ),
    "o8_next_run": (
        next_ready,
        f"""with {RUNS} select run_id, run_dir from runs where state = 'pending' and run_id not in (
          select 'run-' || l_orderkey from lineitem
          where l_partkey not in (select p_partkey from part where p_partkey % 7 <> 3))
        order by run_dir limit 1""",
    ),
    "p21_buckets": (
        buckets,
        with_views("history", query=f"""with {_NEAREST} select rate as f_rate, bits as f_bitrate, count(*) as samples
        from featured group by 1, 2"""),
    ),
    "p22_scaled_times": (
        scaled_times,
        with_views("history", query="""with f as (
          select sample_pos, duration_ms / 1000.0::double as dur, wall_ms / 1000.0::double as wall,
            cast(sample_pos % 900 as double) as target from history)
        select sample_pos, greatest(1::double, floor((least(12::double, wall * 0.35::double) +
          greatest(0::double, wall - least(12::double, wall * 0.35::double)) * greatest(0.25::double,
            least(4::double, greatest(1::double, target) / greatest(1::double, dur)))) * 1000 + 0.5::double) / 1000)
          as scaled_seconds from f"""),
    ),
    "j13_w9_nearest_samples": (
        nearest,
        with_views("history", query=f"""with {_NEAREST} select compute_mode as f_mode, audio_codec as f_codec,
          cast(audio_channels as varchar) as f_channels, rate as f_rate, bits as f_bitrate, container_name as f_container,
          rank, sample_pos, score from nearest"""),
    ),
    "a8_predict_time": (
        predictions,
        with_views("history", query=f"""with {_PREDICTED} select sample_pos, total_seconds, confidence, sample_count,
          floor(raw * transcribe_share * 1000 + 0.5::double) / 1000 as transcribe_seconds from predicted"""),
    ),
    "a9_stage_shares": (
        staged_predictions,
        with_views("history", query=f"""with {_PREDICTED} select sample_pos, {_STAGED} from (
          select p.*, q.raw from pairs p join predicted q using (sample_pos)) group by sample_pos, raw"""),
    ),
    "a12_remaining_time": (
        remaining,
        with_views("history", query=f"""with {_PREDICTED},
        cur as (
          select run_no as run_id, case when run_no % 4 <> 0 then min(sample_pos) filter (status = 'queued') end as place,
            case run_no % 3 when 0 then 'transcribe_audio' else '' end as stage, cast(run_no % 7 as double) as stage_spent,
            cast(run_no % 50 as double) as spent, case when run_no % 5 <> 0 then cast(run_no * 100 as double) end as naive
          from history group by run_no),
        lefts as (
          select c.run_id, p.confidence, p.sample_pos, case when p.sample_pos = place then
              case when stage <> '' then {_stage_left('stage_spent')}
                else greatest(0::double, total_seconds - spent) end
            when place is null or p.sample_pos > place then total_seconds end as remaining
          from predicted p join open_items i using (sample_pos) join cur c on c.run_id = i.run_no
          where p.sample_pos % 5 <> 0),
        sums2 as (select run_id, sum(remaining) as s, sum(confidence) as c, count(*) as n from lefts
          where remaining is not null group by 1),
        final as (
          select cur.run_id, naive, n, floor((s + 5) * 1000 + 0.5::double) / 1000 as hist, (c + 0.4::double) / (n + 1) as t
          from cur left join sums2 using (run_id))
        select run_id, case when n is null then naive when naive is null then hist
          else floor((hist * t + naive * (1 - t)) * 1000 + 0.5::double) / 1000 end as estimated_remaining_sec,
          coalesce(n, 0) as predicted_items from final"""),
    ),
}
