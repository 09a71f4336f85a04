"""Queries over recordings: intervals, speakers, validation, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnweave.functions.text import comparable
from turnweave.operators import intervals, timeline
from turnweave.operators.running import numbered, repeat_counts, run_lengths
from turnweave.operators.validate import phrase_repeats, validate_segments
from turnweave.plans import views
from turnweave.plans.views import with_views
from turnweave.session import stored

MS = {"start": "start_ms", "end": "end_ms", "unit": 1000}


def assign_speakers(spark: SparkSession, sf: str) -> DataFrame:
    found = intervals.assign_speakers(views.raw_segments(spark, sf), views.speaker_turns(spark, sf), **MS)
    return found.select("media_id", "seg_index", "start_ms", "end_ms", F.col("best_speaker").alias("speaker"))


_BEST = """
best as (
  select media_id, seg_index, speaker as best_speaker from (
    select s.media_id, s.seg_index, t.speaker,
      row_number() over (partition by s.media_id, s.seg_index
        order by greatest(least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms), 0) desc, t.turn_pos) as n
    from raw_segments s join speaker_turns t on s.media_id = t.media_id
      and (least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) > 0
        or (s.start_ms + s.end_ms) / 2.0 between t.start_ms and t.end_ms)) where n = 1)"""

_OVERLAP = """
overlap as (
  select s.media_id, s.seg_index,
    cast(sum(least(s.end_ms, r.end_ms) - greatest(s.start_ms, r.start_ms)) as bigint) as speech_overlap
  from raw_segments s join speech_ranges r on s.media_id = r.media_id
    and least(s.end_ms, r.end_ms) > greatest(s.start_ms, r.start_ms)
  group by 1, 2)"""

_PHRASES = """
phrases as (
  select unnest(['ご視聴ありがとうございました', 'ご視聴ありがとうございます', 'ありがとうございました',
    'thankyouforwatching', 'thanksforwatching']) as phrase),
normal as (
  select media_id, seg_index, lower(regexp_replace(text, '\\s+', '', 'g')) as norm from raw_segments),
marked as (
  select *, case when norm = lag(norm) over (partition by media_id order by seg_index) then 0 else 1 end as changed
  from normal),
islands as (
  select *, sum(changed) over (partition by media_id order by seg_index rows unbounded preceding) as island
  from marked),
repeated as (
  select media_id, seg_index, norm, norm in (select phrase from phrases) as known,
    count(*) over (partition by media_id, norm) as repeats,
    case when norm = '' then 0 else count(*) over (partition by media_id, island) end as run_length
  from islands)"""

VALIDATED = f"""
{_BEST}, {_OVERLAP}, {_PHRASES},
facts as (
  select s.*, coalesce(o.speech_overlap, 0) as speech_overlap, b.best_speaker,
    coalesce(o.speech_overlap, 0) < 100 as no_overlap, b.best_speaker is null as no_speaker,
    s.logprob_milli < -600 as unsure, s.no_speech_milli >= 600 as silent,
    r.run_length >= 3 as consecutive, greatest(s.end_ms - s.start_ms, 0) >= 8000 as long_phrase,
    r.known and r.repeats >= 3 as suspect
  from raw_segments s
  left join best b using (media_id, seg_index)
  left join overlap o using (media_id, seg_index)
  join repeated r using (media_id, seg_index)),
judged as (
  select *, suspect and (consecutive or long_phrase or no_overlap or no_speaker or silent) as invented from facts),
validated as (
  select media_id, seg_index, start_ms, end_ms, text, logprob_milli, no_speech_milli, speech_overlap, best_speaker,
    concat_ws(',', case when no_overlap then 'no_speech_candidate_overlap' end,
      case when no_speaker then 'no_speaker_overlap' end,
      case when unsure then 'low_confidence' end,
      case when silent then 'high_no_speech_probability' end,
      case when invented then 'known_silence_hallucination_phrase' end,
      case when invented then 'repeated_hallucination_phrase' end,
      case when invented and consecutive then 'consecutive_hallucination_phrase' end,
      case when invented and long_phrase then 'long_known_hallucination_segment' end) as reasons,
    case when no_overlap or silent or invented then 'rejected' else 'validated' end as state
  from judged)"""

SEGMENT_VIEWS = ("raw_segments", "speaker_turns", "speech_ranges")


def speech_overlap(spark: SparkSession, sf: str) -> DataFrame:
    found = intervals.speech_overlap(views.raw_segments(spark, sf), views.speech_ranges(spark, sf), **MS)
    return found.select("media_id", "seg_index", F.col("speech_overlap").cast("bigint").alias("speech_overlap_ms"))


def validated(spark: SparkSession, sf: str) -> DataFrame:
    return validate_segments(
        views.raw_segments(spark, sf),
        views.speech_ranges(spark, sf),
        views.speaker_turns(spark, sf),
        logprob="logprob_milli",
        no_speech="no_speech_milli",
        score_scale=1000,
        **MS,
    )


def stored_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Validated segments as a stored table, for queries that read them in several branches."""
    return stored(validated(spark, sf), "validated")


def validate_transcript(spark: SparkSession, sf: str) -> DataFrame:
    return validated(spark, sf).select(
        "media_id",
        "seg_index",
        F.col("speech_overlap").cast("bigint").alias("speech_overlap"),
        "best_speaker",
        F.array_join("reasons", ",").alias("reasons"),
        "state",
    )


def consecutive_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.raw_segments(spark, sf).select(
        "media_id", "seg_index", F.nullif(comparable(F.col("text")), F.lit("")).alias("norm")
    )
    return run_lengths(rows, "media_id", "seg_index", "norm").select("media_id", "seg_index", "run_length")


def repeated_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.raw_segments(spark, sf).select(
        "media_id", "seg_index", F.nullif(comparable(F.col("text")), F.lit("")).alias("norm")
    )
    counted = repeat_counts(rows, "media_id", "seg_index", "norm")
    return counted.select("media_id", "seg_index", "repeats", (F.col("repeats") >= 3).alias("repeated"))


def known_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrase_repeats(views.raw_segments(spark, sf)).select("media_id", "seg_index", "run_length", "repeats")


def counts_per_recording(spark: SparkSession, sf: str, judged: DataFrame | None = None) -> DataFrame:
    return timeline.recording_counts(
        views.speech_ranges(spark, sf), views.speaker_turns(spark, sf), validated(spark, sf) if judged is None else judged
    )


def speakers_per_recording(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.speaker_counts(views.speaker_turns(spark, sf), _recordings(spark, sf))


def _recordings(spark: SparkSession, sf: str) -> DataFrame:
    """All recordings, and some of which nothing else is known."""
    known = views.raw_segments(spark, sf).select("media_id").distinct()
    return known.union(known.filter("media_id % 10 = 7").select(F.col("media_id") + 10_000_000))


def merged_silences(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merge_intervals(views.silences(spark, sf), **MS)


def ranges_from_silences(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.speech_ranges(
        views.silences(spark, sf), views.durations(spark, sf), duration="duration_ms", **MS
    )


def cut_map(spark: SparkSession, sf: str) -> DataFrame:
    placed = intervals.trimmed_axis(stored(ranges_from_silences(spark, sf), "ranges"), **MS)
    return placed.select("media_id", "start_ms", "end_ms", "trimmed_start", "trimmed_end")


def paired_marks(spark: SparkSession, sf: str) -> DataFrame:
    pairs = intervals.pair_intervals(views.silence_marks(spark, sf), at="at_ms")
    return pairs.select("media_id", "pair_no", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


def renumbered_segments(spark: SparkSession, sf: str) -> DataFrame:
    kept = views.raw_segments(spark, sf).filter("no_speech_milli < 600").select("media_id", "seg_index")
    return numbered(kept, ["media_id"], "seg_index", "index")


def quiet_levels(spark: SparkSession, sf: str) -> DataFrame:
    found = intervals.quiet_intervals(views.levels(spark, sf), below=20.0, at_least=7_200_000, at="at_ms")
    return found.select("media_id", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


def _chunk_durations(spark: SparkSession, sf: str) -> DataFrame:
    return views.raw_segments(spark, sf).groupBy("media_id").agg((F.max("end_ms") * 200).alias("duration_ms"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.chunk_plan(_chunk_durations(spark, sf), duration="duration_ms", unit=1000)


def stitched_chunks(spark: SparkSession, sf: str) -> DataFrame:
    plan = intervals.chunk_plan(_chunk_durations(spark, sf), duration="duration_ms", unit=1000)
    last = plan.groupBy("media_id").agg(F.max("chunk_no").alias("last"))
    local = views.raw_segments(spark, sf).join(last, "media_id").select(
        "media_id",
        F.least(F.col("seg_index") % 2, F.col("last")).cast("int").alias("chunk_no"),
        F.col("seg_index").alias("local_index"),
        "start_ms",
        "end_ms",
        F.when(F.col("seg_index") % 5 == 4, "  ").otherwise(F.col("text")).alias("text"),
    )
    found = intervals.stitch_chunks(local, plan, start="start_ms", end="end_ms")
    return found.select("media_id", "chunk_no", "seg_index", "start_ms", "end_ms", F.length("text").alias("chars"))


def _recording_times(spark: SparkSession, sf: str) -> DataFrame:
    media = F.col("media_id")
    zone = F.when(media % 3 == 0, "Z").when(media % 3 == 1, "+09:00").otherwise("")
    day = F.lpad((1 + media % 28).cast("string"), 2, "0")
    return (
        views.raw_segments(spark, sf)
        .select("media_id")
        .distinct()
        .withColumn("recorded_at", F.concat(F.lit("2026-03-"), day, F.lit("T23:59:50"), zone))
    )


def timeline_turns(spark: SparkSession, sf: str) -> DataFrame:
    turns = timeline.timeline_turns(stored_validation(spark, sf), _recording_times(spark, sf), **MS)
    return turns.drop("logprob_milli", "no_speech_milli")


_TURNS = """
turns as (
  select v.media_id, row_number() over (partition by v.media_id order by v.seg_index) as "index", v.start_ms, v.end_ms,
    strptime('2026-03-' || lpad(cast(1 + v.media_id % 28 as varchar), 2, '0') || ' 23:59:50', '%Y-%m-%d %H:%M:%S')
      as base,
    case v.media_id % 3 when 0 then '+00:00' when 1 then '+09:00' else '' end as zone,
    v.best_speaker as speaker, v.seg_index as transcription_segment_index, v.text
  from validated v where state = 'validated')"""


def _sql_moment(column: str) -> str:
    return (
        f"strftime(base + to_milliseconds({column}), '%Y-%m-%dT%H:%M:%S') || case when {column} % 1000 <> 0 "
        f"then '.' || lpad(cast({column} % 1000 as varchar), 3, '0') || '000' else '' end || zone"
    )


_TURN_ROWS = f"""
select media_id, "index", start_ms, end_ms, {_sql_moment('start_ms')} as absolute_start_at,
  {_sql_moment('end_ms')} as absolute_end_at, speaker, transcription_segment_index, text from turns"""


def timeline_documents(spark: SparkSession, sf: str) -> DataFrame:
    sources = _recording_times(spark, sf).select(
        "media_id",
        F.struct("recorded_at").alias("source"),
        F.struct(F.lit("v1").alias("pipeline_version")).alias("pipeline"),
    )
    documents = timeline.timeline_documents(timeline_turns(spark, sf), sources, per_part=3)
    line = lambda t: F.concat_ws(
        "|", t.getField("index").cast("string"), F.coalesce(t.getField("speaker"), F.lit("-")),
        t.getField("start_ms").cast("string"), t.getField("absolute_end_at"),
    )
    return documents.select(
        "media_id", "part", "parts", "turn_count", F.array_join(F.transform("turns", line), ";").alias("turns"),
        F.col("source.recorded_at").alias("recorded_at"),
    )


def text_changes(spark: SparkSession, sf: str) -> DataFrame:
    checked = stored_validation(spark, sf)
    return timeline.require_same_text(checked, timeline.timeline_turns(checked, **MS))


def stage_gates(spark: SparkSession, sf: str) -> DataFrame:
    media = F.col("media_id")
    recordings = (
        _recordings(spark, sf)
        .withColumn(
            "transcription_status",
            F.when(media % 11 == 0, "unavailable").when(media % 11 == 1, "no_segments").otherwise("ok"),
        )
    )
    gated = timeline.stage_gates(recordings, views.speaker_turns(spark, sf), validated(spark, sf))
    return gated.withColumn("warnings", F.array_join("warnings", ";"))


QUERIES = {
    "j3_assign_speakers": (
        assign_speakers,
        with_views(
            "raw_segments",
            "speaker_turns",
            query=f"""with {_BEST} select s.media_id, s.seg_index, s.start_ms, s.end_ms, b.best_speaker as speaker
            from raw_segments s left join best b using (media_id, seg_index)""",
        ),
    ),
    "j4_speech_overlap": (
        speech_overlap,
        with_views(
            "raw_segments",
            "speech_ranges",
            query=f"""with {_OVERLAP} select s.media_id, s.seg_index, coalesce(o.speech_overlap, 0) as speech_overlap_ms
            from raw_segments s left join overlap o using (media_id, seg_index)""",
        ),
    ),
    "v1_validate_segments": (
        validate_transcript,
        with_views(
            *SEGMENT_VIEWS,
            query=f"with {VALIDATED} select media_id, seg_index, speech_overlap, best_speaker, reasons, state from validated",
        ),
    ),
    "w1_run_lengths": (
        consecutive_runs,
        with_views("raw_segments", query=f"with {_PHRASES} select media_id, seg_index, run_length from repeated"),
    ),
    "a1_repeated_texts": (
        repeated_texts,
        with_views(
            "raw_segments",
            query=f"with {_PHRASES} select media_id, seg_index, repeats, repeats >= 3 as repeated from repeated",
        ),
    ),
    "j5_known_phrases": (
        known_phrases,
        with_views(
            "raw_segments",
            query=f"with {_PHRASES} select media_id, seg_index, run_length, repeats from repeated where known",
        ),
    ),
    "a13_recording_counts": (
        counts_per_recording,
        with_views(
            *SEGMENT_VIEWS,
            query=f"""with {VALIDATED}
            select media_id,
              cast((select count(*) from speech_ranges r where r.media_id = v.media_id) as bigint)
                as speech_candidate_ranges,
              cast((select count(*) from speaker_turns t where t.media_id = v.media_id) as bigint) as speaker_turns,
              count(*) as raw_transcript_segments,
              count(*) filter (state = 'validated') as transcript_segments,
              count(*) filter (state = 'rejected') as rejected_transcript_segments
            from validated v group by media_id""",
        ),
    ),
    "a3_p36_speaker_counts": (
        speakers_per_recording,
        with_views(
            "raw_segments",
            "speaker_turns",
            query="""
            select m.media_id, nullif(count(distinct t.speaker), 0) as speaker_count,
              case when count(distinct t.speaker) > 0 then 'confirmed' else 'unavailable' end as speaker_count_status,
              case when count(distinct t.speaker) = 0 then 'No speaker turns were available.' end as speaker_count_note
            from (select media_id from raw_segments union
              select media_id + 10000000 from raw_segments where media_id % 10 = 7) m
            left join speaker_turns t on t.media_id = m.media_id
            group by m.media_id""",
        ),
    ),
    "w2_merge_intervals": (
        merged_silences,
        with_views(
            "silences",
            query="""with reach as (
              select *, max(end_ms) over (partition by media_id order by start_ms, end_ms
                rows between unbounded preceding and 1 preceding) as before from silences),
            heads as (
              select *, sum(case when before is null or start_ms > before then 1 else 0 end)
                over (partition by media_id order by start_ms, end_ms rows unbounded preceding) as island from reach)
            select media_id, min(start_ms) as start_ms, max(end_ms) as end_ms from heads group by media_id, island""",
        ),
    ),
    "w3_speech_ranges": (
        ranges_from_silences,
        with_views("silences", "durations", query="with {ranges} select * from ranges"),
    ),
    "w4_trimmed_axis": (
        cut_map,
        with_views(
            "silences",
            "durations",
            query="""with {ranges} select media_id, start_ms, end_ms,
              cast(coalesce(sum(end_ms - start_ms) over (partition by media_id order by start_ms
                rows between unbounded preceding and 1 preceding), 0) as bigint) as trimmed_start,
              cast(sum(end_ms - start_ms) over (partition by media_id order by start_ms rows unbounded preceding)
                as bigint) as trimmed_end from ranges""",
        ),
    ),
    "w5_pair_intervals": (
        paired_marks,
        with_views(
            "silence_marks",
            query="""with balance as (
              select *, sum(case when kind = 'S' then 1 else -1 end) over w as s,
                count(*) filter (kind = 'S') over w as starts from silence_marks
              window w as (partition by media_id order by line_no rows unbounded preceding)),
            lows as (
              select *, least(0, min(s) over (partition by media_id order by line_no rows unbounded preceding)) as low,
                least(0, coalesce(min(s) over (partition by media_id order by line_no
                  rows between unbounded preceding and 1 preceding), 0)) as low_before from balance),
            numbered as (
              select media_id, kind, at_ms,
                row_number() over (partition by media_id, kind order by line_no) as pair_no
              from lows where kind = 'S' or low = low_before)
            select a.media_id, a.pair_no, a.at_ms as start_ms, b.at_ms as end_ms
            from numbered a join numbered b on a.media_id = b.media_id and a.pair_no = b.pair_no
              and a.kind = 'S' and b.kind = 'E'""",
        ),
    ),
    "w6_renumber": (
        renumbered_segments,
        with_views(
            "raw_segments",
            query="""select media_id, seg_index, row_number() over (partition by media_id order by seg_index) as "index"
            from raw_segments where no_speech_milli < 600""",
        ),
    ),
    "w11_quiet_intervals": (
        quiet_levels,
        with_views(
            "levels",
            query="""with marked as (
              select *, coalesce(sum(case when level >= 20 then 1 else 0 end) over (partition by media_id order by pos
                rows between unbounded preceding and 1 preceding), 0) as grp from levels)
            select media_id, min(at_ms) filter (level < 20) as start_ms, max(at_ms) as end_ms from marked
            group by media_id, grp
            having min(at_ms) filter (level < 20) is not null
              and max(at_ms) - min(at_ms) filter (level < 20) >= 7200000""",
        ),
    ),
    "w12_chunk_plan": (
        chunks,
        with_views(
            "raw_segments",
            query="""with d as (select media_id, max(end_ms) * 200 as d from raw_segments group by 1),
            c as (select media_id, d, unnest(range(0, case when d > 600000
              then cast(ceil(d / 600000.0) as bigint) else 1 end)) as n from d)
            select media_id, cast(n as int) as chunk_no, cast(n * 600000 as bigint) as chunk_start,
              cast(least(600000, d - n * 600000) as bigint) as chunk_duration from c""",
        ),
    ),
    "w12_stitch_chunks": (
        stitched_chunks,
        with_views(
            "raw_segments",
            query="""with d as (select media_id, max(end_ms) * 200 as d from raw_segments group by 1),
            moved as (
              select s.media_id, case when d > 600000 then cast(seg_index % 2 as int) else 0 end as chunk_no,
                seg_index as local_index, case when d > 600000 then seg_index % 2 else 0 end * 600000 + start_ms as start_ms,
                case when d > 600000 then seg_index % 2 else 0 end * 600000 + end_ms as end_ms,
                trim(regexp_replace(text, '\\s+', ' ', 'g')) as text
              from raw_segments s join d using (media_id)
              where seg_index % 5 <> 4)
            select media_id, chunk_no, row_number() over (partition by media_id order by chunk_no, local_index)
              as seg_index, cast(start_ms as bigint) as start_ms, cast(end_ms as bigint) as end_ms,
              cast(length(text) as int) as chars
            from moved where text <> ''""",
        ),
    ),
    "a10_timeline_turns": (
        timeline_turns,
        with_views(*SEGMENT_VIEWS, query=f"with {VALIDATED}, {_TURNS} {_TURN_ROWS}"),
    ),
    "a10_timeline_documents": (
        timeline_documents,
        with_views(
            *SEGMENT_VIEWS,
            query=f"""with {VALIDATED}, {_TURNS}, turn_rows as ({_TURN_ROWS}),
            parts as (
              select media_id, cast(("index" - 1) // 3 as int) as part,
                string_agg(cast("index" as varchar) || '|' || coalesce(speaker, '-') || '|' ||
                  cast(start_ms as varchar) || '|' || absolute_end_at, ';' order by "index") as turns, count(*) as n
              from turn_rows group by 1, 2)
            select m.media_id, coalesce(part, 0) as part,
              cast(greatest(count(part) over (partition by m.media_id), 1) as int) as parts,
              cast(coalesce(sum(n) over (partition by m.media_id), 0) as bigint) as turn_count,
              coalesce(turns, '') as turns,
              '2026-03-' || lpad(cast(1 + m.media_id % 28 as varchar), 2, '0') || 'T23:59:50' ||
                case m.media_id % 3 when 0 then 'Z' when 1 then '+09:00' else '' end as recorded_at
            from (select distinct media_id from raw_segments) m left join parts p on p.media_id = m.media_id""",
        ),
    ),
    "a11_text_conservation": (
        text_changes,
        with_views(
            *SEGMENT_VIEWS,
            query=f"""with {VALIDATED}
            select cast(count(*) as bigint) as changed, true as checked from validated where text is null""",
        ),
    ),
    "p39_stage_gates": (
        stage_gates,
        with_views(
            *SEGMENT_VIEWS,
            query=f"""with {VALIDATED},
            r as (select media_id, count(*) filter (state = 'rejected') as rejected from validated group by 1
              union all select distinct media_id + 10000000, 0 from validated where media_id % 10 = 7),
            m as (select media_id, rejected,
              case media_id % 11 when 0 then 'unavailable' when 1 then 'no_segments' else 'ok' end
                as transcription_status from r),
            t as (select media_id, count(*) as n from speaker_turns group by 1)
            select m.media_id, transcription_status,
              case when coalesce(n, 0) = 0 then 'no_speaker_turns' else 'ok' end as diarization_status,
              transcription_status <> 'unavailable' as continues,
              concat_ws(';',
                case when coalesce(n, 0) = 0
                  then 'Speaker diarization completed, but no speaker turns were found.' end,
                case when transcription_status = 'no_segments' then 'Speech transcription produced no segments.' end,
                case when rejected > 0 then 'Speech transcript validation rejected ' || rejected || ' segment(s).' end)
                as warnings
            from m left join t using (media_id)""",
        ),
    ),
}

_RANGES = """
distinct_starts as (select media_id, start_ms, max(end_ms) as end_ms from silences group by 1, 2),
reach as (
  select *, max(end_ms) over (partition by media_id order by start_ms
    rows between unbounded preceding and 1 preceding) as before from distinct_starts),
merged as (
  select media_id, min(start_ms) as s, max(end_ms) as e from (
    select *, sum(case when before is null or start_ms > before then 1 else 0 end)
      over (partition by media_id order by start_ms rows unbounded preceding) as island from reach)
  group by media_id, island),
gaps as (
  select media_id, s, case when lag(e) over w is null then 0 else least(3600000, lag(e) over w + 1000) end as cursor
  from merged window w as (partition by media_id order by s)),
tails as (
  select d.media_id, least(3600000, coalesce(max(e) + 1000, 0)) as start_ms, 3600000 as end_ms
  from durations d left join merged m using (media_id) group by d.media_id),
ranges as (
  select g.media_id, cast(cursor as bigint) as start_ms, cast(greatest(cursor, s - 1000) as bigint) as end_ms
  from gaps g join durations using (media_id) where greatest(cursor, s - 1000) - cursor >= 250
  union all
  select media_id, cast(start_ms as bigint), cast(end_ms as bigint) from tails where end_ms - start_ms >= 250)"""

for _name in ("w3_speech_ranges", "w4_trimmed_axis"):
    _query, _sql = QUERIES[_name]
    QUERIES[_name] = (_query, _sql.replace("{ranges}", _RANGES.strip()))
