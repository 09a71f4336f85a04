"""Queries over inventories, catalogs and finished items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnweave.functions.text import catalog_key
from turnweave.operators import catalog, items, ordering, paths, refresh
from turnweave.plans import views
from turnweave.plans.views import with_views
from turnweave.sources.files import select_roots, table

SIGNATURE = "sig-cpu"
RESERVED = (".data",)


def named_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return views.inventory(spark, sf).withColumnRenamed("relative_path", "path")


def plan(spark: SparkSession, sf: str, **options) -> DataFrame:
    return refresh.plan_refresh(named_inventory(spark, sf), views.catalog(spark, sf), SIGNATURE, **options)


FOUND = """
exact as (
  select * from (
    select *, lower(source_file_identity) as ik, row_number() over (
      partition by lower(source_file_identity), source_hash order by catalog_pos desc) as n
    from catalog where conversion_signature = 'sig-cpu') where n = 1),
reusable as (
  select * from (
    select *, lower(source_file_identity) as ik, row_number() over (
      partition by lower(source_file_identity), source_hash order by catalog_pos) as n
    from catalog where artifact_exists) where n = 1),
planned as (
  select i.*, e.audio_id as exact_id, e.artifact_exists as exact_artifact, r.audio_id as reusable_id,
    r.conversion_signature as reusable_signature,
    case when e.artifact_exists then 'skipped' when e.audio_id is null and r.audio_id is not null then 'skipped'
      else 'queued' end as action,
    case when e.artifact_exists then 'unchanged'
      when e.audio_id is null and r.audio_id is not null then 'existing_artifact_reused' end as reason,
    case when e.artifact_exists then e.audio_id when e.audio_id is null then r.audio_id end as duplicate_of
  from inventory i
  left join exact e on e.ik = lower(i.source_file_identity) and e.source_hash = i.source_hash
  left join reusable r on r.ik = lower(i.source_file_identity) and r.source_hash = i.source_hash)"""

LIMITED = f"""
{FOUND},
limited as (
  select *, case when action = 'queued' then row_number() over (
    partition by action order by size_bytes, lower(relative_path), source_file_identity) end as n from planned)"""


def looked_up(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    found = catalog.look_up(views.inventory(spark, sf), rows, SIGNATURE)
    return found.select(
        "source_file_identity",
        F.col("exact.audio_id").alias("exact_id"),
        F.col("exact.artifact_exists").alias("exact_artifact"),
        F.col("reusable.audio_id").alias("reusable_id"),
        F.col("reusable.conversion_signature").alias("reusable_signature"),
    )


def look_up(spark: SparkSession, sf: str) -> DataFrame:
    return looked_up(spark, sf, views.catalog(spark, sf))


def look_up_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Files without an identity, looked up by their hash alone."""
    files = table(spark, sf, "documents").select(
        F.col("doc_id"), F.lit(None).cast("string").alias("source_file_identity"), F.sha2("text", 256).alias("source_hash")
    )
    found = catalog.look_up(files, views.catalog(spark, sf), SIGNATURE)
    return found.select(
        "doc_id",
        F.col("exact.audio_id").alias("exact_id"),
        F.col("reusable.audio_id").alias("reusable_id"),
        F.col("reusable.conversion_signature").alias("reusable_signature"),
    )


def plan_refresh(spark: SparkSession, sf: str) -> DataFrame:
    return plan(spark, sf).select("source_file_identity", "action", "reason", "duplicate_of")


def plan_limited(spark: SparkSession, sf: str) -> DataFrame:
    return plan(spark, sf, limit=25).select("source_file_identity", "action", "reason", "duplicate_of")


def plan_reprocess(spark: SparkSession, sf: str) -> DataFrame:
    return plan(spark, sf, reprocess=True).groupBy("action").agg(F.count(F.lit(1)).alias("files"))


def summary(spark: SparkSession, sf: str) -> DataFrame:
    return refresh.refresh_summary(plan(spark, sf, limit=25))


def work_list(spark: SparkSession, sf: str) -> DataFrame:
    return refresh.work_list(plan(spark, sf)).select("input_id", "source_file_identity", "size_bytes")


def latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.latest_by_key(views.catalog(spark, sf))
    key = catalog_key(F.col("source_file_identity"), F.col("source_hash"), F.col("conversion_signature"))
    return rows.select(key.alias("catalog_key"), "audio_id", "artifact_exists", "first_pos")


def all_file_status(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("bigint")
    inventory = named_inventory(spark, sf)
    stored = views.catalog(spark, sf).withColumn(
        "source_file_identity", F.lower("source_file_identity")
    ).withColumn("duration_seconds", (F.col("catalog_pos") % 1000) / F.lit(8.0))
    documents = table(spark, sf, "documents")
    number = F.col("doc_id")
    manifest = documents.filter(number % 4 == 0).select(
        F.concat("source", F.lit("::"), "lang", F.lit("/"), number.cast("string"), F.lit(".wav")).alias(
            "source_file_identity"
        ),
        F.concat(F.lit("run-"), (number % 9).cast("string")).alias("run_name"),
        F.concat(F.lit("run-"), (number % 9).cast("string")).alias("run_id"),
        F.element_at(
            F.array(F.lit("running"), F.lit("pending"), F.lit("Failed"), F.lit("completed")),
            (number / 4 % 4).cast("int") + 1,
        ).alias("run_state"),
        F.when(number % 3 == 0, "failed").otherwise("queued").alias("status"),
        number.alias("item_pos"),
        F.concat(F.lit("m-"), number.cast("string")).alias("audio_id"),
        (number % 50 + F.lit(0.5)).alias("duration_seconds"),
    )
    known = inventory.withColumn("source_hash", F.when(doc % 6 == 5, None).otherwise(F.col("source_hash")))
    return catalog.file_status(known, stored, SIGNATURE, manifest)


def file_status(spark: SparkSession, sf: str) -> DataFrame:
    return all_file_status(spark, sf).select("source_file_identity", "status", "media_id", "duration_sec")


def classify(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("bigint")
    inputs = named_inventory(spark, sf).select(
        "*", (doc % 17 != 0).alias("readable"), ((doc % 40) / F.lit(4.0)).alias("duration_seconds")
    )
    return refresh.classify_inputs(inputs, views.catalog(spark, sf), SIGNATURE)


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return classify(spark, sf).select(
        "source_file_identity", "status", "duplicate_status", "duplicate_of"
    )


def skip_counts(spark: SparkSession, sf: str) -> DataFrame:
    return refresh.skip_counts(classify(spark, sf), ["source_id"])


CLASSIFIED = f"""
{FOUND},
classified as (
  select source_id, source_file_identity,
    case when d % 17 = 0 then 'skipped_invalid' when d % 40 < 8 then 'skipped_too_short' else 'queued' end as status,
    case when d % 17 <> 0 and d % 40 >= 8 and exact_artifact then 'duplicate_skip' else 'new' end as duplicate_status,
    case when d % 17 <> 0 and d % 40 >= 8 and exact_artifact then exact_id end as duplicate_of
  from (select *, cast(regexp_extract(relative_path, '([0-9]+)\\.wav$', 1) as bigint) as d from planned))"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.with_item_ids(
        views.catalog(spark, sf)
        .withColumn("audio_id", F.when(F.col("catalog_pos") % 3 == 0, F.lit(" ")).otherwise(F.upper("audio_id")))
        .withColumn("run_id", F.concat(F.lit("run-"), (F.col("catalog_pos") % 7).cast("string")))
        .withColumn("run_dir", F.concat(F.lit("/runs/r"), (F.col("catalog_pos") % 5).cast("string"), F.lit("/")))
        .withColumn(
            "item_dir",
            F.concat(
                F.when(F.col("catalog_pos") % 10 == 0, "/elsewhere/").otherwise("/out/"),
                F.col("catalog_pos").cast("string"),
            ),
        )
    )


_ITEMS = """
stored as (
  select catalog_pos, case when catalog_pos % 3 = 0 then '' else upper(audio_id) end as audio_id, source_file_identity,
    source_hash, conversion_signature, artifact_exists, 'run-' || catalog_pos % 7 as run_id,
    '/runs/r' || catalog_pos % 5 || '/' as run_dir,
    case when catalog_pos % 10 = 0 then '/elsewhere/' else '/out/' end || catalog_pos as item_dir from catalog),
items as (
  select *, case when audio_id <> '' then audio_id else 'item-' || left(sha256(lower(source_file_identity) || '::' ||
    source_hash || '::' || conversion_signature || '::' || run_id), 12) end as item_id from stored)"""


def item_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("catalog_pos", "item_id")


def _requested(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "labels").filter("toxic = 1").select(
        F.concat(F.lit("Item-"), F.col("doc_id").cast("string")).alias("requested_id")
    )
    return wanted.select(F.lower("requested_id").alias("id_key"), "requested_id")


_REQUESTED = (
    "requested as (select lower('Item-' || doc_id) as id_key, 'Item-' || doc_id as requested_id "
    "from labels where toxic = 1)"
)


def selected_items(spark: SparkSession, sf: str) -> DataFrame:
    return items.select_items(_items(spark, sf), _requested(spark, sf)).select("catalog_pos", "item_id")


def missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    return items.missing_ids(_requested(spark, sf), _items(spark, sf))


def remaining_items(spark: SparkSession, sf: str) -> DataFrame:
    return items.remaining_items(_items(spark, sf), _requested(spark, sf)).select("catalog_pos", "item_id")


def removal(spark: SparkSession, sf: str) -> DataFrame:
    return items.plan_removal(_items(spark, sf), _requested(spark, sf), "/out", RESERVED).select(
        "catalog_pos", "item_id", "folder_safe", "remove_folder", "dry_run"
    )


def removal_summary(spark: SparkSession, sf: str) -> DataFrame:
    return items.removal_summary(items.plan_removal(_items(spark, sf), _requested(spark, sf), "/out", RESERVED, dry_run=True))


def pruned(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.prune_run(_items(spark, sf), "RUN-3", "/runs/r2").select("catalog_pos", "run_id")


def pruned_runs(spark: SparkSession, sf: str) -> DataFrame:
    doomed = table(spark, sf, "region").select(
        F.concat(F.lit("Run-"), F.col("r_regionkey").cast("string")).alias("run_id"),
        F.concat(F.lit("/runs/r"), (F.col("r_regionkey") + 3).cast("string")).alias("run_dir"),
    )
    return catalog.prune_runs(_items(spark, sf), doomed).select("catalog_pos", "run_id")


def listing(spark: SparkSession, sf: str) -> DataFrame:
    pos = F.col("catalog_pos")
    day = F.lpad((1 + pos % 28).cast("string"), 2, "0")
    return (
        _items(spark, sf)
        .withColumn("updated_at", F.concat(F.lit("2026-05-"), day, F.lit("T00:00:00+09:00")))
        .withColumn("created_at", F.concat(F.lit("2026-04-"), day, F.lit("T00:00:00Z")))
        .withColumn("artifact_path", F.when(F.col("artifact_exists"), F.concat("item_dir", F.lit("/timeline.json"))))
        .withColumn("source_relative_path", F.when(pos % 4 != 1, F.regexp_extract("source_file_identity", "::(.*)$", 1)))
        .withColumn("duration_seconds", (pos % 50) / F.lit(4.0))
    )


def item_list(spark: SparkSession, sf: str) -> DataFrame:
    stored = listing(spark, sf)
    pos = F.col("catalog_pos")
    info = stored.filter(pos % 6 == 1).select(
        "catalog_pos",
        F.when(pos % 12 == 1, F.concat(F.lit("Talk "), pos.cast("string"))).alias("display_name"),
        F.concat(F.lit("/in/x/"), pos.cast("string"), F.lit(".mp3")).alias("original_path"),
    )
    counts = views.raw_segments(spark, sf).groupBy((F.col("media_id") * 2).alias("catalog_pos")).agg(
        F.count(F.lit(1)).alias("turn_count"), F.count_distinct(F.col("seg_index") % 3).alias("speaker_count")
    )
    return items.item_list(stored, info, counts, key="catalog_pos").drop("created_at", "conversion_signature")


def item_page(spark: SparkSession, sf: str) -> DataFrame:
    order = items.newest_first("updated_at", "created_at", "item_id") + [F.col("catalog_pos")]
    rows = ordering.page_rows(listing(spark, sf), order, page=3, page_size=40)
    return rows.select("catalog_pos", "item_id", "updated_at")


def item_page_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.page_summary(listing(spark, sf), page=3, page_size=40)


def ranked_files(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.lower("path"), F.col("source_file_identity")]
    return ordering.ranked(named_inventory(spark, sf), order).select("source_file_identity", "rank")


def union_catalog(spark: SparkSession, sf: str) -> DataFrame:
    stored = views.catalog(spark, sf)
    pos = F.col("catalog_pos")
    path = F.concat(F.when(pos % 2 == 0, "/Out/").otherwise("/out/"), (pos - pos % 4).cast("string"))
    scanned = stored.filter(pos % 3 == 0).withColumn("artifact_path", path)
    cached = stored.withColumn("artifact_path", F.when(pos % 9 != 5, path).otherwise(F.lit("")))
    united = catalog.union_catalog(scanned, cached)
    return united.select("catalog_pos", "artifact_path", F.col("catalog_order._origin").alias("origin"))


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    old = views.catalog(spark, sf).select(
        "catalog_pos",
        F.when(F.col("catalog_pos") % 2 == 0, F.col("audio_id")).alias("audio_id"),
        F.concat(F.lit("old-"), "audio_id").alias("media_id"),
        F.col("source_hash").alias("sha256"),
        F.concat(F.lit("run-"), F.col("catalog_pos").cast("string")).alias("job_id"),
    )
    return catalog.canonical_columns(old)


def mapped_paths(spark: SparkSession, sf: str) -> DataFrame:
    return paths.remap_paths(_paths(spark, sf), _mappings(spark, sf)).select("doc_id", "mapped_path")


def host_paths(spark: SparkSession, sf: str) -> DataFrame:
    inside = _paths(spark, sf).withColumn("path", F.regexp_replace("path", "^/shared/", "/data/"))
    return paths.remap_paths(inside, _mappings(spark, sf), reverse=True).select("doc_id", "mapped_path")


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat(
            F.when(F.col("doc_id") % 5 == 0, "/other/").otherwise("/shared/"), "source", F.lit("/"), "lang",
            F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav"),
        ).alias("path"),
    )


def _mappings(spark: SparkSession, sf: str) -> DataFrame:
    by_source = table(spark, sf, "documents").select("source").distinct().filter("length(source) > 4").select(
        F.concat(F.lit("/shared/"), "source").alias("host"), F.concat(F.lit("/data/"), "source").alias("container")
    )
    whole = table(spark, sf, "region").filter("r_regionkey = 0").select(
        F.lit("/shared").alias("host"), F.lit("/all").alias("container")
    )
    return by_source.unionByName(whole)


def artifact_locations(spark: SparkSession, sf: str) -> DataFrame:
    stored = _items(spark, sf).withColumn(
        "artifact_path", F.when(F.col("catalog_pos") % 4 == 0, F.concat(F.lit("/moved/"), F.col("catalog_pos").cast("string")))
    )
    existing = table(spark, sf, "documents").select(
        F.explode(
            F.array(
                F.concat(F.lit("/moved/"), (F.col("doc_id") * 8).cast("string")),
                F.concat(F.lit("/out/"), (F.col("doc_id") * 3).cast("string"), F.lit("/timeline.json")),
            )
        ).alias("path")
    )
    return items.artifact_location(stored, existing).select("catalog_pos", "artifact_found")


def file_page(spark: SparkSession, sf: str) -> DataFrame:
    modified = F.concat(
        F.lit("2026-0"), (1 + F.col("size_bytes") % 9).cast("string"), F.lit("-01T00:00:00+00:00")
    )
    rows = named_inventory(spark, sf).withColumn("modified_at", modified)
    order = items.newest_first("modified_at", "source_file_identity")
    return ordering.page_rows(rows, order, page=2, page_size=100).select("source_file_identity", "modified_at")


def chosen_roots(spark: SparkSession, sf: str) -> DataFrame:
    return select_roots(named_inventory(spark, sf), ["SRC3", "src11"]).select("source_id", "source_file_identity")


def collected_inputs(spark: SparkSession, sf: str) -> DataFrame:
    rows = named_inventory(spark, sf)
    doc = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("bigint")
    single = rows.filter(doc % 3 == 0).select(
        F.lit("local_file").alias("source_kind"), F.upper("path").alias("path"), doc.alias("offer_pos")
    )
    folder = rows.select(
        F.lit("mounted_root").alias("source_kind"),
        F.when(doc % 10 == 9, F.concat("path", F.lit(".txt"))).otherwise(F.col("path")).alias("path"),
        (doc + F.lit(1 << 40)).alias("offer_pos"),
    )
    return refresh.collect_inputs(single.unionByName(folder)).select("input_id", "path", "source_kind")


def media_ids(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("bigint")
    inputs = named_inventory(spark, sf).select(
        "path",
        "source_hash",
        F.when(doc % 4 != 0, F.col("source_file_identity")).alias("source_file_identity"),
        F.when(doc % 5 != 0, F.concat(F.lit(" Talk (é) "), doc.cast("string"), F.lit("--x.WAV"))).alias("display_name"),
    )
    return refresh.with_media_ids(inputs).select("path", "source_hash", "media_id")


def catalog_durations(spark: SparkSession, sf: str) -> DataFrame:
    pos = F.col("catalog_pos")
    stored = views.catalog(spark, sf).select(
        "catalog_pos",
        F.when(pos % 4 == 0, "0").when(pos % 4 == 1, "junk").when(pos % 4 == 2, (pos / F.lit(16.0)).cast("string"))
        .alias("duration_seconds"),
    )
    probes = stored.filter(pos % 8 != 5).select("catalog_pos", (pos / F.lit(32.0)).alias("probe_seconds"))
    return items.with_duration(stored, probes, "catalog_pos").select("catalog_pos", "duration_sec")


def updated_times(spark: SparkSession, sf: str) -> DataFrame:
    pos = F.col("catalog_pos")
    stamp = lambda day: F.concat(F.lit("2026-05-"), F.lpad(day.cast("string"), 2, "0"))
    rows = listing(spark, sf).select(
        "catalog_pos",
        "created_at",
        F.when(pos % 3 == 0, F.col("updated_at")).alias("updated_at"),
        F.when(pos % 4 < 2, stamp(1 + pos % 20)).alias("timeline_time"),
        F.when(pos % 4 == 1, stamp(1 + pos % 17)).alias("info_time"),
    )
    found = items.item_updated_at(
        F.col("timeline_time"), F.col("info_time"), F.col("updated_at"), F.col("created_at")
    )
    return rows.select("catalog_pos", found.alias("item_updated_at"))


LISTING = f"""
{_ITEMS},
listing as (
  select *, '2026-05-' || lpad(cast(1 + catalog_pos % 28 as varchar), 2, '0') || 'T00:00:00+09:00' as updated_at,
    '2026-04-' || lpad(cast(1 + catalog_pos % 28 as varchar), 2, '0') || 'T00:00:00Z' as created_at,
    case when artifact_exists then item_dir || '/timeline.json' end as artifact_path,
    case when catalog_pos % 4 <> 1 then regexp_extract(source_file_identity, '::(.*)$', 1) end as source_relative_path,
    (catalog_pos % 50) / 4.0 as duration_seconds from items)"""

_PATHS = """
paths as (
  select doc_id, case when doc_id % 5 = 0 then '/other/' else '{root}' end || source || '/' || lang || '/' || doc_id ||
    '.wav' as path from documents),
mappings as (
  select distinct '/shared/' || source as host, '/data/' || source as container from documents
  where length(source) > 4
  union all select '/shared', '/all' from region where r_regionkey = 0)"""


def _inv(query: str) -> str:
    return with_views("inventory", "catalog", query=query)


QUERIES = {
    "j1_j2_catalog_look_up": (
        look_up,
        _inv(f"""with {FOUND} select source_file_identity, exact_id, exact_artifact, reusable_id, reusable_signature
        from planned"""),
    ),
    "j2_hash_look_up": (
        look_up_by_hash,
        _inv("""with first as (
          select source_hash, arg_min(audio_id, catalog_pos) as audio_id, arg_min(conversion_signature, catalog_pos) as signature
          from catalog where artifact_exists group by 1)
        select doc_id, cast(null as varchar) as exact_id, audio_id as reusable_id, signature as reusable_signature
        from documents left join first on source_hash = sha256(text)"""),
    ),
    "u2_latest_by_key": (
        latest,
        _inv("""select lower(source_file_identity) || '::' || source_hash || '::' || conversion_signature as catalog_key,
          arg_max(audio_id, catalog_pos) as audio_id, arg_max(artifact_exists, catalog_pos) as artifact_exists,
          min(catalog_pos) as first_pos
        from catalog group by 1"""),
    ),
    "k7_plan_refresh": (
        plan_refresh,
        _inv(f"with {FOUND} select source_file_identity, action, reason, duplicate_of from planned"),
    ),
    "w7_o2_batch_limit": (
        plan_limited,
        _inv(f"""with {LIMITED} select source_file_identity, case when n > 25 then 'deferred' else action end as action,
        case when n > 25 then 'batch_limit' else reason end as reason, duplicate_of from limited"""),
    ),
    "k7_plan_reprocess": (plan_reprocess, "select 'queued' as action, count(*) as files from documents"),
    "a15_refresh_summary": (
        summary,
        _inv(f"""with {LIMITED} select count(*) as selected_count,
          count(*) filter (action = 'queued' and n <= 25) as queued_count,
          count(*) filter (action = 'skipped') as skipped_count,
          count(*) filter (action = 'queued' and n > 25) as deferred_count from limited"""),
    ),
    "k7_work_list": (
        work_list,
        _inv(f"""with {FOUND} select 'ref-' || printf('%04d', n) as input_id, source_file_identity, size_bytes from (
          select *, row_number() over (order by lower(relative_path), source_file_identity) as n
          from planned where action = 'queued')"""),
    ),
    "j6_file_status": (
        file_status,
        _inv("""with stored as (
          select arg_max(source_hash, catalog_pos) as h, arg_max(conversion_signature, catalog_pos) as s,
            arg_max(audio_id, catalog_pos) as audio_id, arg_max(artifact_exists, catalog_pos) as artifact_exists,
            max(catalog_pos) as last_pos, lower(source_file_identity) as ident, min(catalog_pos) as pos
          from catalog group by ident, source_hash, conversion_signature),
        files as (
          select source_file_identity, d, case when d % 6 <> 5 then source_hash end as h from (
            select *, cast(regexp_extract(relative_path, '([0-9]+)\\.wav$', 1) as bigint) as d from inventory)),
        ranked as (
          select f.source_file_identity, s.audio_id, s.last_pos, case when s.s = 'sig-cpu' and (f.h is null or f.h = s.h) then 1
            when f.h = s.h then 2 else 3 end as r,
            row_number() over (partition by f.source_file_identity order by
              case when s.s = 'sig-cpu' and (f.h is null or f.h = s.h) then 1 when f.h = s.h then 2 else 3 end, s.pos) as n
          from files f join stored s on s.ident = f.source_file_identity and s.artifact_exists),
        based as (
          select f.source_file_identity, d, coalesce(['completed', 'settings_changed', 'changed'][r], 'unprocessed') as st,
            audio_id, last_pos from files f left join (select * from ranked where n = 1) using (source_file_identity)),
        runs as (
          select source || '::' || lang || '/' || doc_id || '.wav' as source_file_identity,
            ['running', 'pending', 'failed', 'completed'][(doc_id // 4) % 4 + 1] as state,
            case when doc_id % 3 = 0 then 'failed' else 'queued' end as item, 'm-' || doc_id as run_audio
          from documents where doc_id % 4 = 0 and (doc_id // 4) % 4 < 3),
        joined as (
          select *, coalesce(state in ('running', 'pending') or (item = 'failed' and st = 'unprocessed'), false) as by_run
          from based left join runs using (source_file_identity))
        select source_file_identity, case when state = 'running' then 'processing' when state = 'pending' then 'queued'
          when by_run then 'failed' else st end as status,
          coalesce(case when by_run then run_audio else audio_id end, '') as media_id,
          case when by_run then d % 50 + 0.5::double else floor(nullif((last_pos % 1000) / 8.0, 0) * 1000 + 0.5) / 1000 end
            as duration_sec from joined"""),
    ),
    "p26_classify_inputs": (
        classified,
        _inv(f"""with {CLASSIFIED} select source_file_identity, status, duplicate_status, duplicate_of
        from classified"""),
    ),
    "a6_p35_skip_counts": (
        skip_counts,
        _inv(f"""with {CLASSIFIED} select source_id, status, count(*) as files, case status when 'skipped_invalid'
          then 'preflight: skipped ' || count(*) || ' invalid audio file(s).'
          else 'preflight: skipped ' || count(*) || ' audio file(s) shorter than 2.0s.' end as warning
        from classified where status <> 'queued' group by 1, 2"""),
    ),
    "p8_item_ids": (item_ids, with_views("catalog", query=f"with {_ITEMS} select catalog_pos, item_id from items")),
    "j9_select_items": (
        selected_items,
        with_views("catalog", query=f"""with {_ITEMS}, {_REQUESTED} select catalog_pos, item_id from items
        where lower(item_id) in (select id_key from requested)"""),
    ),
    "j11_u5_missing_ids": (
        missing_ids,
        with_views("catalog", query=f"""with {_ITEMS}, {_REQUESTED} select requested_id from requested
        where id_key not in (select lower(item_id) from items)"""),
    ),
    "j10_remaining_items": (
        remaining_items,
        with_views("catalog", query=f"""with {_ITEMS}, {_REQUESTED} select catalog_pos, item_id from items
        where lower(item_id) not in (select id_key from requested)"""),
    ),
    "j10_p33_plan_removal": (
        removal,
        with_views("catalog", query=f"""with {_ITEMS}, {_REQUESTED} select catalog_pos, item_id,
          catalog_pos % 10 <> 0 as folder_safe, catalog_pos % 10 <> 0 as remove_folder, false as dry_run from items
        where lower(item_id) in (select id_key from requested)"""),
    ),
    "j10_removal_summary": (
        removal_summary,
        with_views("catalog", query=f"""with {_ITEMS}, {_REQUESTED} select count(distinct lower(item_id)) as matched_count,
          count(*) as catalog_rows_removed, cast(0 as bigint) as media_dirs_removed,
          count(*) filter (catalog_pos % 10 = 0) as unsafe_media_dirs from items
        where lower(item_id) in (select id_key from requested)"""),
    ),
    "j12_prune_run": (
        pruned,
        with_views("catalog", query=f"""with {_ITEMS} select catalog_pos, run_id from items
        where catalog_pos % 7 <> 3 and catalog_pos % 5 <> 2"""),
    ),
    "j12_prune_runs": (
        pruned_runs,
        with_views("catalog", query=f"""with {_ITEMS} select catalog_pos, run_id from items
        where catalog_pos % 7 > 4 and catalog_pos % 5 < 3"""),
    ),
    "j16_item_list": (
        item_list,
        with_views("catalog", "raw_segments", query=f"""with {LISTING},
        counts as (select media_id * 2 as catalog_pos, count(*) as turn_count,
          count(distinct seg_index % 3) as speaker_count from raw_segments group by 1)
        select l.catalog_pos, case when l.catalog_pos % 3 = 0 then ' ' else audio_id end as media_id,
          source_file_identity,
          coalesce(case when l.catalog_pos % 12 = 1 then 'Talk ' || l.catalog_pos end,
            nullif(regexp_extract(coalesce(source_relative_path, ''), '([^/]*)$', 1), ''),
            case when l.catalog_pos % 6 = 1 then l.catalog_pos || '.mp3' end,
            case when l.catalog_pos % 3 = 0 then ' ' else audio_id end) as source_file_name,
          source_hash, nullif(duration_seconds, 0) as duration_sec, updated_at,
          case when artifact_path is not null then 'available' else 'missing_artifact' end as status,
          coalesce(artifact_path, '') as artifact_path, coalesce(turn_count, 0) as turn_count,
          coalesce(speaker_count, 0) as speaker_count
        from listing l left join counts using (catalog_pos)"""),
    ),
    "w8_o3_item_page": (
        item_page,
        with_views("catalog", query=f"""with {LISTING} select catalog_pos, item_id, updated_at from listing
        order by updated_at desc, created_at desc, item_id desc, catalog_pos limit 40 offset 80"""),
    ),
    "w8_page_summary": (
        item_page_summary,
        with_views("catalog", query="""with t as (select count(*) as total_rows from catalog)
        select 'page' as mode, 3 as page, 40 as page_size, total_rows,
          cast(ceil(total_rows / 40.0) as bigint) as total_pages,
          greatest(0, least(40, total_rows - 80)) as returned_rows, 80 as "offset",
          case when total_rows > 80 then 81 else 0 end as range_start,
          case when total_rows > 80 then 80 + least(40, total_rows - 80) else 0 end as range_end,
          total_rows > 0 as has_previous, 3 < ceil(total_rows / 40.0) as has_next from t"""),
    ),
    "o1_ranked_files": (
        ranked_files,
        with_views("inventory", query="""select source_file_identity,
          row_number() over (order by lower(relative_path), source_file_identity) as rank from inventory"""),
    ),
    "o4_file_page": (
        file_page,
        with_views("inventory", query="""select source_file_identity,
          '2026-0' || (1 + size_bytes % 9) || '-01T00:00:00+00:00' as modified_at from inventory
        order by modified_at desc, source_file_identity desc limit 100 offset 100"""),
    ),
    "u1_union_catalog": (
        union_catalog,
        with_views("catalog", query="""with p as (
          select catalog_pos, case when catalog_pos % 2 = 0 then '/Out/' else '/out/' end ||
            (catalog_pos - catalog_pos % 4) as artifact_path from catalog),
        scanned as (select * from p where catalog_pos % 3 = 0),
        cached as (
          select *, row_number() over (partition by lower(artifact_path) order by catalog_pos) as n from p
          where catalog_pos % 9 <> 5
            and lower(artifact_path) not in (select lower(artifact_path) from scanned))
        select catalog_pos, artifact_path, 0 as origin from scanned
        union all select catalog_pos, artifact_path, 1 from cached where n = 1"""),
    ),
    "p27_canonical_columns": (
        canonical,
        with_views("catalog", query="""select catalog_pos, case when catalog_pos % 2 = 0 then audio_id
          else 'old-' || audio_id end as audio_id, source_hash, 'run-' || catalog_pos as run_id from catalog"""),
    ),
    "j14_remap_paths": (
        mapped_paths,
        f"""with {_PATHS.format(root='/shared/')} select p.doc_id,
          arg_max(container || substr(path, length(host) + 1), length(host)) as mapped_path
        from paths p left join mappings m on starts_with(path, host || '/') group by 1""",
    ),
    "j14_host_paths": (
        host_paths,
        f"""with {_PATHS.format(root='/data/')} select p.doc_id,
          coalesce(arg_max(host || substr(path, length(container) + 1), length(container)), any_value(path))
            as mapped_path
        from paths p left join mappings m on starts_with(path, container || '/') group by 1""",
    ),
    "p32_artifact_location": (
        artifact_locations,
        with_views("catalog", query="""with existing as (
          select '/moved/' || doc_id * 8 as path from documents
          union all select '/out/' || doc_id * 3 || '/timeline.json' from documents)
        select catalog_pos, case
          when catalog_pos % 4 = 0 and '/moved/' || catalog_pos in (select path from existing) then '/moved/' || catalog_pos
          when catalog_pos % 10 <> 0 and '/out/' || catalog_pos || '/timeline.json' in (select path from existing)
            then '/out/' || catalog_pos || '/timeline.json' end as artifact_found from catalog"""),
    ),
    "j15_select_roots": (
        chosen_roots,
        with_views("inventory", query="""select source_id, source_file_identity from inventory
        where lower(source_id) in ('src3', 'src11')"""),
    ),
    "u3_collect_inputs": (
        collected_inputs,
        with_views("inventory", query="""with d as (
          select *, cast(regexp_extract(relative_path, '([0-9]+)\\.wav$', 1) as bigint) as doc from inventory),
        offered as (
          select 'local_file' as source_kind, upper(relative_path) as path, doc as pos from d where doc % 3 = 0
          union all select 'mounted_root', relative_path, doc + 1099511627776 from d where doc % 10 <> 9),
        firsts as (select *, row_number() over (partition by lower(path) order by pos) as n from offered)
        select left(source_kind, 4) || '-' || printf('%04d', k)
          as input_id, path, source_kind
        from (select *, row_number() over (order by pos) as k from firsts where n = 1)"""),
    ),
    "p6_p7_media_ids": (
        media_ids,
        with_views("inventory", query="""with d as (
          select *, cast(regexp_extract(relative_path, '([0-9]+)\\.wav$', 1) as bigint) as doc from inventory)
        select relative_path as path, source_hash, case when doc % 5 <> 0 then 'Talk-' || doc || '-x' else cast(doc as varchar) end || '-' ||
          case when doc % 4 <> 0 then left(sha256(source_file_identity), 8) else left(source_hash, 8) end as media_id
        from d"""),
    ),
    "p40_duration_fallback": (
        catalog_durations,
        with_views("catalog", query="""select catalog_pos, case when catalog_pos % 4 = 2
            then floor(catalog_pos / 16.0 * 1000 + 0.5) / 1000
          when catalog_pos % 8 <> 5 then floor(nullif(catalog_pos / 32.0, 0) * 1000 + 0.5) / 1000 end as duration_sec
        from catalog"""),
    ),
    "p31_item_updated_at": (
        updated_times,
        with_views("catalog", query=f"""with {LISTING} select catalog_pos, coalesce(greatest(
          case when catalog_pos % 4 < 2 then '2026-05-' || lpad(cast(1 + catalog_pos % 20 as varchar), 2, '0') end,
          case when catalog_pos % 4 = 1 then '2026-05-' || lpad(cast(1 + catalog_pos % 17 as varchar), 2, '0') end),
          case when catalog_pos % 3 = 0 then updated_at end, created_at) as item_updated_at from listing"""),
    ),
}
