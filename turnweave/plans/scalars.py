"""Queries over single rows: normal forms, times, numbers, vocabularies and parsed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnweave.functions import numbers, text, times, vocabulary
from turnweave.plans import views
from turnweave.plans.views import with_views
from turnweave.sources import documents as document_sources
from turnweave.sources import probe, run_folders, silence
from turnweave.sources.files import table


def identities(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    raw = F.concat(
        F.when(doc % 3 == 0, F.lit("  ")).otherwise(F.lit("")), F.upper("source"), F.lit("::"), "lang",
        F.when(doc % 2 == 0, F.lit("\\")).otherwise(F.lit("/")), doc.cast("string"),
        F.when(doc % 5 == 0, F.lit("//")).otherwise(F.lit("")),
    )
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang", raw.alias("raw"))
    source = F.when(doc % 4 == 0, F.lit(" ")).otherwise(F.col("source"))
    relative = F.concat(F.lit("//"), "lang", F.lit("\\"), doc.cast("string"))
    return rows.select(
        "doc_id",
        text.identity_key(F.col("raw")).alias("identity_key"),
        text.catalog_key(
            F.when(doc % 7 == 0, F.lit(None)).otherwise(F.col("raw")), F.lit(" AB "), F.concat(F.lit("Sig"), "lang")
        ).alias("catalog_key"),
        text.source_identity(source, relative).alias("source_identity"),
        text.output_root_key(F.concat(F.lit("/Out/"), "source")).alias("root_key"),
    )


def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    relative = F.concat(
        F.when(doc % 3 == 0, F.lit("")).otherwise(F.concat("lang", F.lit("/"), (doc % 10).cast("string"), F.lit("/"))),
        F.lit("a.b "), doc.cast("string"), F.when(doc % 5 == 0, F.lit("")).otherwise(F.lit(".MP3")),
    )
    root = F.when(doc % 4 == 0, F.lit("C:\\Audio\\")).otherwise(F.concat(F.lit("/in/"), "source"))
    rows = table(spark, sf, "documents").select(
        "doc_id", "source", relative.alias("relative"), root.alias("root"),
        F.concat(F.lit("/in/src1/"), relative).alias("path"),
    )
    inside = text.relative_to(F.col("path"), F.concat(F.lit("/in/"), "source"))
    return rows.select(
        "doc_id",
        inside.alias("relative_path"),
        text.directory(F.col("relative")).alias("directory"),
        text.file_name(F.col("relative")).alias("file_name"),
        text.extension(F.col("relative")).alias("extension"),
        text.stem(F.col("relative")).alias("stem"),
        text.display_path(F.col("root"), F.col("relative"), F.col("path")).alias("display_path"),
    )


def text_forms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        F.sha2(text.comparable(F.col("text")), 256).alias("comparable"),
        F.sha2(text.compact(F.col("text")), 256).alias("compact"),
    )


def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


def id_lists(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.explode(text.id_list(F.col("text"))).alias("id")
    )


def extension_lists(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    given = F.array(
        F.concat(F.lit(" ."), (key % 4).cast("string")), F.lit("MP3"), F.lit(".mp3"), F.lit(""),
        F.concat(F.lit("X"), (key % 9).cast("string")),
    )
    offered = F.when(key % 6 == 0, F.array(F.lit(" "))).otherwise(given)
    return table(spark, sf, "orders").select(
        "o_orderkey", F.array_join(text.extension_list(offered), ",").alias("extensions")
    )


def signatures(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    mode = F.when(key % 3 == 0, " GPU ").when(key % 3 == 1, "cpu")
    profile = F.when(key % 4 == 0, "Loose").when(key % 4 == 1, "strict").when(key % 4 == 2, "")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        vocabulary.generation_signature("Étude", mode, profile).alias("signature"),
        vocabulary.compute_mode(mode).alias("compute_mode"),
        vocabulary.silence_profile_ms(profile).alias("min_silence_ms"),
    )


def _stamp(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def file_name_times(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    month, day, hour = two(key % 14), two(key % 33), two(key % 25)
    name = (
        F.when(key % 4 == 0, _stamp("talk 2024-", month, "-", day, "_", hour, "-30-15.mp3"))
        .when(key % 4 == 1, _stamp("x20240230101010 2024", month, day, "-", hour, "3015.mp3"))
        .when(key % 4 == 2, _stamp("2024", month, day, hour, "3015.wav"))
        .otherwise("meeting.wav")
    )
    tagged = F.when(key % 7 == 0, F.lit("2026-03-24T23:59:59Z"))
    found = times.recorded_at(tagged, _stamp("/in/", name))
    rows = table(spark, sf, "orders").select("o_orderkey", found.alias("r"))
    return rows.select("o_orderkey", "r.recorded_at", "r.recorded_at_source", "r.recorded_at_timezone")


def tag_times(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    base = _stamp("2024-05-", two(1 + key % 28), "T", two(key % 24), ":00:00")
    tags = F.create_map(F.lit("creation_time"), _stamp(base, "Z"), F.lit("title"), F.lit("2001-01-01"))
    later = F.create_map(
        F.lit("date"), F.when(key % 3 == 0, F.lit("N/A")).otherwise(_stamp(base, ".25+02:00")),
        F.lit("encoded_date"), F.when(key % 2 == 0, base).otherwise(F.lit("soon")),
    )
    found = table(spark, sf, "orders").select(
        "o_orderkey", times.tag_recorded_times(F.array(tags, later)).alias("found")
    )
    return found.select(
        "o_orderkey",
        F.get("found", F.lit(0)).alias("captured_at"),
        F.array_join("found", ",").alias("candidates"),
    )


def iso_times(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    zone = F.when(key % 4 == 0, "Z").when(key % 4 == 1, "+09:00").when(key % 4 == 2, "-0330").otherwise("")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    stamp = F.when(key % 10 == 9, "nonsense").otherwise(
        _stamp("2024-12-", two(1 + key % 31), "T23:", two(key % 60), ":07", zone)
    )
    offset = (key % 2000) / F.lit(8.0)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        times.absolute_at(stamp, offset).alias("absolute_at"),
        times.iso_text(times.utc_datetime(stamp)).alias("utc"),
        times.iso_from_epoch(key * 86_399 + F.lit(0.5), "+09:00").alias("from_epoch"),
    )


def optional_numbers(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    raw = (
        F.when(key % 5 == 0, "N/A")
        .when(key % 5 == 1, "")
        .when(key % 5 == 2, key.cast("string"))
        .when(key % 5 == 3, _stamp(key.cast("string"), ".5"))
        .otherwise("x1")
    )
    ratio = (
        F.when(key % 4 == 0, "0/0")
        .when(key % 4 == 1, _stamp(key.cast("string"), "/16"))
        .when(key % 4 == 2, "30")
        .otherwise("a/b")
    )
    return table(spark, sf, "orders").select(
        "o_orderkey",
        numbers.optional_int(raw).alias("as_int"),
        numbers.optional_double(raw).alias("as_double"),
        numbers.optional_ratio(ratio).alias("as_ratio"),
    )


def probe_facts(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("sample_pos")
    history = views.history(spark, sf)
    stamp = _stamp("2026-03-", F.lpad((1 + key % 28).cast("string"), 2, "0"), "T01:02:03Z")
    video = F.struct(
        F.lit("video").alias("codec_type"), F.lit("png").alias("codec_name"), F.lit(None).cast("int").alias("channels"),
        F.lit(None).cast("string").alias("sample_rate"), F.lit("1").alias("bit_rate"),
    )
    audio = F.struct(
        F.lit("Audio").alias("codec_type"), F.col("audio_codec").alias("codec_name"),
        F.col("audio_channels").alias("channels"), F.col("audio_sample_rate").cast("string").alias("sample_rate"),
        F.lit("64000").alias("bit_rate"),
    )
    payload = F.to_json(
        F.struct(
            F.struct(
                (F.col("duration_ms") / 1000).cast("string").alias("duration"),
                F.when(key % 2 == 0, F.col("wall_ms").cast("string")).otherwise("N/A").alias("size"),
                F.col("bitrate").cast("string").alias("bit_rate"),
                F.concat("container_name", F.lit(", other")).alias("format_name"),
                F.create_map(F.lit("creation_time"), stamp).alias("tags"),
            ).alias("format"),
            F.when(key % 9 == 0, F.array(video)).otherwise(F.array(video, audio)).alias("streams"),
        )
    )
    made = history.select("sample_pos", _stamp("/in/", key.cast("string"), ".M4A").alias("path"), payload.alias("probe_json"))
    return probe.probe_facts(made).select(
        "sample_pos", "duration_seconds", "size_bytes_probed", "container_name", "extension", "audio_codec",
        "audio_channels", "audio_sample_rate", "bitrate", "captured_at", "readable",
    )


def log_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Two log lines per event: a start (negative for every seventh event) and an end with its duration."""
    seconds = F.col("event_id").cast("string")
    log = F.concat(
        F.lit("[silencedetect @ 0x1] silence_start: "),
        F.when(F.col("event_id") % 7 == 0, F.lit("-")).otherwise(F.lit("")),
        seconds, F.lit(".25\r\nframe= 1\n[silencedetect @ 0x1] silence_end: "), seconds, F.lit(".5 | silence_duration: 0.25"),
    )
    logs = table(spark, sf, "events").select(F.col("event_id").alias("media_id"), log.alias("log"))
    return silence.parse_silence_log(logs)


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    turn = lambda speaker: F.struct(speaker.alias("speaker"), F.lit("t").alias("text"))
    turns = F.array(
        turn(_stamp("S", (key % 3).cast("string"))), turn(F.lit(" ")), turn(_stamp("S", (key % 2).cast("string"), " "))
    )
    whole = F.to_json(F.struct(F.lit(7).alias("turn_count"), turns.alias("turns")))
    bare = F.to_json(F.struct(F.lit("many").alias("turn_count"), turns.alias("turns")))
    payload = (
        F.when(key % 4 == 0, whole).when(key % 4 == 1, bare).when(key % 4 == 2, F.lit("{broken"))
    )
    made = table(spark, sf, "orders").select("o_orderkey", payload.alias("timeline_json"))
    return document_sources.timeline_summary(made)


def catalog_lines(spark: SparkSession, sf: str) -> DataFrame:
    pos = F.col("catalog_pos")
    row = F.to_json(
        F.struct(
            F.col("audio_id").alias("media_id"), F.col("source_hash").alias("sha256"), "source_file_identity",
            F.when(pos % 8 != 3, _stamp("/out/", pos.cast("string"))).alias("artifact_path"),
            (pos / F.lit(8.0)).alias("duration_sec"),
        )
    )
    lines = views.catalog(spark, sf).select(
        "catalog_pos",
        F.when(pos % 6 == 0, F.lit("   ")).when(pos % 6 == 1, F.lit('{"audio_id": ')).otherwise(row).alias("value"),
    )
    existing = table(spark, sf, "documents").select(_stamp("/out/", F.col("doc_id").cast("string")).alias("path"))
    return document_sources.parse_catalog(lines, existing).select(
        "catalog_pos", "audio_id", "source_hash", "artifact_path", "duration_seconds"
    )


def source_records(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    known = lambda name, test: F.when(test, F.struct(_stamp(name, doc.cast("string")).alias("display_name")))
    rows = table(spark, sf, "documents").select(
        "doc_id",
        known("record ", doc % 3 == 0).alias("record"),
        known("source ", doc % 2 == 0).alias("source"),
        known("timeline ", doc % 5 != 0).alias("timeline"),
    )
    found = document_sources.source_info(rows, "record", "source", "timeline")
    return found.select("doc_id", "source_info.display_name")


def item_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Both documents of every recording parsed from JSON text; some lack a source or a pipeline. Further items have one of
    the documents only."""
    media, documents = F.col("doc_id"), table(spark, sf, "documents")
    source = F.struct(_stamp("h", media.cast("string")).alias("source_hash"), (media / F.lit(4.0)).alias("duration_sec"))
    pipeline = F.struct(_stamp("sig", (media % 3).cast("string")).alias("generation_signature"))

    def made(name: str, alone, with_source, with_pipeline) -> DataFrame:
        payload = F.to_json(
            F.struct(
                F.lit(name).alias("generated_at"),
                F.when(with_source, source).alias("source"),
                F.when(with_pipeline, pipeline).alias("pipeline"),
            )
        )
        item, only = media.cast("string"), _stamp(media.cast("string"), "-only-", name)
        rows = documents.select("doc_id", item.alias("item")).union(documents.filter(alone).select("doc_id", only))
        folder = _stamp("/out/", F.col("item"))
        parsed = F.from_json(payload, document_sources.DOCUMENT_SCHEMA)
        return rows.select(
            F.col("item").alias("audio_id"), folder.alias("item_dir"),
            _stamp(folder, "/", name).alias("document_path"), F.lit(None).cast("timestamp").alias("modified_at"),
            parsed.alias("_d"),
        ).select("audio_id", "item_dir", "document_path", "modified_at", "_d.*")

    found = document_sources.assemble_items(
        made("timeline.json", media % 7 == 0, (media % 2 == 0) | (media % 5 != 0), media % 5 == 0),
        made("convert_info.json", media % 11 == 0, media % 3 == 0, media % 3 == 0),
    )
    return found.select("audio_id", "artifact_path", "source_hash", "duration_seconds", "conversion_signature")


def run_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Run documents parsed from JSON text: old counter names, missing states, runs without a manifest. Further runs have no status."""
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders").withColumn("run_dir", _stamp("/runs/run-", key.cast("string")))
    request = F.to_json(F.struct(F.when(key % 3 != 0, _stamp("r", key.cast("string"))).alias("run_id")))
    status = F.to_json(
        F.struct(
            F.when(key % 4 != 0, "running").alias("state"),
            F.when(key % 2 == 0, key % 10).alias("items_done"),
            (key % 7).alias("videos_done"),
        )
    )
    item = F.struct((key * 2).alias("size_bytes"), (key / F.lit(2.0)).alias("duration_seconds"))
    manifest = F.to_json(F.struct(F.array(item, item).alias("items")))

    def parsed(payload, schema: str, rows: DataFrame) -> DataFrame:
        return rows.select("run_dir", F.from_json(payload, schema).alias("_d")).select("run_dir", "_d.*")

    runs = run_folders.assemble_runs(
        parsed(request, run_folders.REQUEST_SCHEMA, orders.union(orders.filter(key % 5 == 0).withColumn("run_dir", _stamp(F.col("run_dir"), "-bare")))),
        parsed(status, run_folders.STATUS_SCHEMA, orders),
        parsed(manifest, run_folders.MANIFEST_SCHEMA, orders.filter(key % 6 != 0)),
    )
    sums = F.aggregate("items", F.lit(0).cast("bigint"), lambda acc, i: acc + i.getField("size_bytes"))
    return runs.select("run_id", "run_name", "state", "items_done", sums.alias("total_size_bytes"))


_SIGNATURE_JSON = (
    '{"pipeline":"Étude","pipeline_version":"2026-05-11-v1-whisper-transcript-timeline","compute_mode":"\' || mode || \'",'
    '"speech_transcription":{"backend":"faster-whisper-large-v3-v1","model_id":"Systran/faster-whisper-large-v3",'
    '"language":"auto"},"diarization":{"required":true,"model_id":"pyannote/speaker-diarization-community-1",'
    '"requested_enabled_flag":true},"vad":{"backend":"ffmpeg-silencedetect",'
    '"model_id":"ffmpeg-silencedetect-noise-35db","profile":"\' || profile || \'","filter":true,'
    '"parameters":{"min_silence_duration_ms":\' || ms || \'}},"artifact":{"schema":"timeline-v1","path":"timeline.json"}}'
)

QUERIES = {
    "p1_p2_p3_p37_identities": (
        identities,
        """with d as (select doc_id, source, lang, lower(source || '::' || lang || '/' || doc_id) as ik from documents)
        select doc_id, ik as identity_key,
          case when doc_id % 7 = 0 then '' else ik || '::' end || 'ab::sig' || lang as catalog_key,
          case when doc_id % 4 = 0 then 'local' else source end || '::' || lang || '/' || doc_id as source_identity,
          left(sha256('/out/' || lower(source)), 16) as root_key from d""",
    ),
    "p4_p5_path_parts": (
        path_parts,
        """with d as (
          select *, case when doc_id % 3 = 0 then '' else lang || '/' || doc_id % 10 end as dir, 'a.b ' || doc_id as base,
            case when doc_id % 5 = 0 then '' else '.MP3' end as ext from documents),
        e as (select *, case when dir = '' then '' else dir || '/' end || base || ext as rel from d)
        select doc_id, case when source = 'src1' then rel else '/in/src1/' || rel end as relative_path, dir as directory,
          base || ext as file_name, case when ext = '' then lower('.b ' || doc_id) else '.mp3' end as extension,
          case when ext = '' then 'a' else base end as stem,
          case when doc_id % 4 = 0 then 'C:\\Audio\\' || replace(rel, '/', '\\') else '/in/' || source || '/' || rel end
            as display_path from e""",
    ),
    "p12_p13_text_forms": (
        text_forms,
        """select doc_id, sha256(replace(lower(regexp_replace(text, '\\s+', '', 'g')), 'ß', 'ss')) as comparable,
          sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as compact from documents""",
    ),
    "p6_slugs": (
        slugs,
        """select page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'),
          '-{2,}', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item') as slug from pages""",
    ),
    "p30_id_lists": (
        id_lists,
        """with parts as (select doc_id, unnest(string_split_regex(text, '[,\\r\\n]')) as part from documents)
        select distinct doc_id, regexp_replace(part, '^\\s+|\\s+$', '', 'g') as id from parts
        where regexp_replace(part, '^\\s+|\\s+$', '', 'g') <> ''""",
    ),
    "s2_extension_lists": (
        extension_lists,
        """select o_orderkey, case when o_orderkey % 6 = 0 then '.mp3,.wav,.m4a,.aac,.flac'
          else '.' || o_orderkey % 4 || ',.mp3,.x' || o_orderkey % 9 end as extensions from orders""",
    ),
    "p9_p10_p11_signatures": (
        signatures,
        f"""with s as (
          select o_orderkey, case when o_orderkey % 3 = 0 then 'gpu' else 'cpu' end as mode,
            case o_orderkey % 4 when 0 then 'loose' when 1 then 'strict' else 'default' end as profile,
            case o_orderkey % 4 when 0 then 1000 when 1 then 250 else 500 end as ms from orders)
        select o_orderkey, sha256('{_SIGNATURE_JSON}') as signature, mode as compute_mode, ms as min_silence_ms from s""",
    ),
    "p14_p16_recorded_at": (
        file_name_times,
        """with p as (
          select o_orderkey as k, lpad(cast(o_orderkey % 14 as varchar), 2, '0') as mo,
            lpad(cast(o_orderkey % 33 as varchar), 2, '0') as da, lpad(cast(o_orderkey % 25 as varchar), 2, '0') as ho
          from orders),
        t as (select *, case when k % 4 < 3 then try_strptime('2024-' || mo || '-' || da || ' ' || ho || ':30:15',
          '%Y-%m-%d %H:%M:%S') end as ts from p)
        select k as o_orderkey, case when k % 7 = 0 then '2026-03-24T23:59:59Z'
            else strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+09:00' end as recorded_at,
          case when k % 7 = 0 then 'metadata' when ts is not null then 'filename' else 'unknown' end as recorded_at_source,
          case when k % 7 = 0 then 'UTC' when ts is not null then 'Asia/Tokyo' end as recorded_at_timezone from t""",
    ),
    "p15_tag_times": (
        tag_times,
        """with b as (
          select o_orderkey as k, strptime('2024-05-' || lpad(cast(1 + o_orderkey % 28 as varchar), 2, '0') || ' ' ||
            lpad(cast(o_orderkey % 24 as varchar), 2, '0'), '%Y-%m-%d %H') as ts from orders),
        f as (select k, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' as base, case when k % 3 <> 0 then
          strftime(ts - interval 2 hour, '%Y-%m-%dT%H:%M:%S') || '.250000Z' end as early from b)
        select k as o_orderkey, coalesce(early, base) as captured_at, concat_ws(',', early, base) as candidates from f""",
    ),
    "p17_p18_p38_iso_times": (
        iso_times,
        """with p as (
          select o_orderkey as k, strptime('2024-12-' || lpad(cast(1 + o_orderkey % 31 as varchar), 2, '0') || ' 23:' ||
              lpad(cast(o_orderkey % 60 as varchar), 2, '0') || ':07', '%Y-%m-%d %H:%M:%S') as ts,
            case o_orderkey % 4 when 0 then '+00:00' when 1 then '+09:00' when 2 then '-03:30' else '' end as zone,
            case o_orderkey % 4 when 1 then -540 when 2 then 210 else 0 end as shift,
            (o_orderkey % 2000) * 125 as ms from orders)
        select k as o_orderkey, case when k % 10 <> 9 then strftime(ts + to_milliseconds(ms), '%Y-%m-%dT%H:%M:%S') ||
            case when ms % 1000 <> 0 then '.' || rpad(lpad(cast(ms % 1000 as varchar), 3, '0'), 6, '0') else '' end || zone
            end as absolute_at,
          case when k % 10 <> 9 then strftime(ts + to_minutes(shift), '%Y-%m-%dT%H:%M:%S') end as utc,
          strftime(timestamp '1970-01-01 09:00:00' + to_seconds(k * 86399), '%Y-%m-%dT%H:%M:%S') || '.500000+09:00'
            as from_epoch from p""",
    ),
    "p19_p20_optional_numbers": (
        optional_numbers,
        """select o_orderkey, case when o_orderkey % 5 = 2 then o_orderkey end as as_int,
          case o_orderkey % 5 when 2 then cast(o_orderkey as double) when 3 then o_orderkey + 0.5::double end as as_double,
          case o_orderkey % 4 when 1 then floor(o_orderkey / 16.0::double * 1000 + 0.5::double) / 1000 when 2 then 30 end
            as as_ratio from orders""",
    ),
    "s7_probe_facts": (
        probe_facts,
        with_views("history", query="""select sample_pos, duration_ms / 1000.0::double as duration_seconds,
          case when sample_pos % 2 = 0 then wall_ms end as size_bytes_probed, container_name, '.m4a' as extension,
          case when sample_pos % 9 <> 0 then audio_codec end as audio_codec,
          case when sample_pos % 9 <> 0 then audio_channels end as audio_channels,
          case when sample_pos % 9 <> 0 then audio_sample_rate end as audio_sample_rate,
          case when bitrate > 0 then bitrate when sample_pos % 9 <> 0 then 64000 end as bitrate,
          '2026-03-' || lpad(cast(1 + sample_pos % 28 as varchar), 2, '0') || 'T01:02:03Z' as captured_at,
          sample_pos % 2 = 0 as readable from history"""),
    ),
    "s8_silence_log": (
        log_marks,
        """select event_id as media_id, 0 as line_no, 'S' as kind, event_id + 0.25::double as at from events
          where event_id % 7 <> 0
        union all select event_id, 2, 'E', event_id + 0.5::double from events""",
    ),
    "s10_timeline_summary": (
        summaries,
        """select o_orderkey, o_orderkey % 4 <> 3 as has_timeline,
          case o_orderkey % 4 when 0 then 7 when 1 then 3 else 0 end as turn_count,
          case when o_orderkey % 4 > 1 then 0 when o_orderkey % 3 = o_orderkey % 2 then 1 else 2 end as speaker_count
        from orders""",
    ),
    "s5_catalog_lines": (
        catalog_lines,
        with_views("catalog", query="""select catalog_pos, audio_id, source_hash, '/out/' || catalog_pos as artifact_path,
          catalog_pos / 8.0::double as duration_seconds from catalog
        where catalog_pos % 6 > 1 and catalog_pos % 8 <> 3 and catalog_pos in (select doc_id from documents)"""),
    ),
    "s11_source_info": (
        source_records,
        """select doc_id, case when doc_id % 3 = 0 then 'record ' || doc_id when doc_id % 2 = 0 then 'source ' || doc_id
          when doc_id % 5 <> 0 then 'timeline ' || doc_id end as display_name from documents""",
    ),
    "s4_j7_item_documents": (
        item_documents,
        """select cast(doc_id as varchar) as audio_id, '/out/' || doc_id || '/timeline.json' as artifact_path,
          case when doc_id % 3 = 0 or doc_id % 2 = 0 or doc_id % 5 <> 0 then 'h' || doc_id end as source_hash,
          case when doc_id % 3 = 0 or doc_id % 2 = 0 or doc_id % 5 <> 0 then doc_id / 4.0::double end as duration_seconds,
          case when doc_id % 3 = 0 or doc_id % 5 = 0 then 'sig' || doc_id % 3 end as conversion_signature
        from documents""",
    ),
    "s6_j8_run_documents": (
        run_documents,
        """select case when o_orderkey % 3 <> 0 then 'r' || o_orderkey else 'run-' || o_orderkey end as run_id,
          'run-' || o_orderkey as run_name, case when o_orderkey % 4 <> 0 then 'running' else 'unknown' end as state,
          case when o_orderkey % 2 = 0 then o_orderkey % 10 else o_orderkey % 7 end as items_done,
          case when o_orderkey % 6 <> 0 then o_orderkey * 4 else 0 end as total_size_bytes
        from orders""",
    ),
}
