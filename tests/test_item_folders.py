"""Item folders: exact names, long recordings, replaced and aborted writes."""

import json

import pytest
from pyspark.sql import functions as F

from turnweave.operators import items, timeline
from turnweave.sinks import documents as sinks
from turnweave.sources import documents, item_folders

SOURCES = (
    "select id as media_id, struct(id as source_hash, cast(null as string) as recorded_at) as source, "
    "struct('sig' as generation_signature) as pipeline from values ('m'), ('n'), ('o/p é') as t(id)"
)


def parts(spark, count=700, text="t"):
    turns = spark.range(1, count + 1).select(
        F.lit("m").alias("media_id"), F.col("id").alias("index"), (F.col("id") * 0.5).alias("start"),
        F.concat(F.lit(text), F.lit('"\n'), F.col("id").cast("string")).alias("text"),
    )
    turns = turns.union(spark.sql("select 'n', 1L, 1.0d, cast(null as string)"))
    sources = spark.sql(SOURCES)
    infos = sources.selectExpr("media_id", "'2026' as generated_at", "source", "pipeline")
    return timeline.timeline_headers(turns, sources), timeline.turn_table(turns), infos


def test_written_items_have_exact_names_and_whole_documents(spark, tmp_path):
    root = str(tmp_path / "items")
    assert sinks.write_items(*parts(spark, 25_000), root) == 6
    assert sorted(p.name for p in (tmp_path / "items").iterdir()) == ["m", "n", "o%2Fp é"]
    read = json.loads((tmp_path / "items" / "m" / "timeline.json").read_text())
    assert (read["turn_count"], read["artifact_type"], read["source"]) == (25_000, "timeline", {"source_hash": "m", "recorded_at": None})
    assert [t["index"] for t in read["turns"]] == list(range(1, 25_001)) and read["turns"][4]["text"] == 't"\n5'
    assert json.loads((tmp_path / "items" / "n" / "timeline.json").read_text())["turns"][0]["text"] is None
    assert json.loads((tmp_path / "items" / "o%2Fp é" / "timeline.json").read_text())["turns"] == []
    by_tasks = sorted(tuple(r) for r in documents.read_items(spark, root).select("audio_id", "source_hash", "conversion_signature", "created_at").collect())
    assert by_tasks == [(i, i, "sig", "2026") for i in ("m", "n", "o/p é")]
    by_glob = documents.scan_items(spark, root).select("audio_id", "source_hash").filter("audio_id <> 'o%2Fp é'")
    assert sorted(tuple(r) for r in by_glob.collect()) == [("m", "m"), ("n", "n")]


def test_turns_of_one_recording_spread_over_tasks(spark):
    _, turns, _ = parts(spark, 25_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = turns.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 1 and max(r["count"] for r in spread) < 25_000
    pieces = timeline.document_pieces(*parts(spark, 25_000))
    assert pieces.filter("item_id = 'm' and document = 'timeline'").count() == 2 + -(-25_000 // timeline.PIECE)


def test_items_are_replaced_and_others_stay(spark, tmp_path):
    root = str(tmp_path)
    sinks.write_items(*parts(spark, 3, "old"), root)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "timeline.json").write_text("{}")
    (tmp_path / ".hidden").mkdir()
    assert sinks.write_items(*[df.filter("media_id = 'm'") for df in parts(spark, 2, "new")], root) == 2
    turns = json.loads((tmp_path / "m" / "timeline.json").read_text())["turns"]
    assert [t["text"][:3] for t in turns] == ["new", "new"]
    # An item with one document only, and a hidden one, are no items.
    assert {r["audio_id"] for r in documents.read_items(spark, root).collect()} == {"m", "n", "o/p é"}
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".staging")]
    assert documents.read_items(spark, str(tmp_path / "none")).collect() == []


def test_failed_write_leaves_nothing(spark, tmp_path):
    root = str(tmp_path)
    headers, turns, infos = parts(spark, 600)
    sinks.write_items(headers, turns, infos, root)
    before = (tmp_path / "m" / "timeline.json").read_bytes()
    bad = timeline.document_pieces(headers, turns, infos).withColumn(
        "text", F.when(F.col("piece") == 2, F.raise_error(F.lit("broken piece"))).otherwise(F.col("text"))
    )
    with pytest.raises(Exception, match="broken piece"):
        item_folders.write_pieces(bad, root)
    assert (tmp_path / "m" / "timeline.json").read_bytes() == before
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".staging")]


def test_interrupted_publication_goes_on(spark, tmp_path):
    root, staging = str(tmp_path), ".staging-x"
    attempt = tmp_path / staging / "0-7" / "m"
    attempt.mkdir(parents=True)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "convert_info.json").write_text("{}")  # moved before the interruption
    (attempt / "timeline.json").write_text("{}")
    (tmp_path / staging / "1-9" / "n").mkdir(parents=True)  # an attempt that does not count
    (tmp_path / staging / item_folders.COMMITTED).write_text('["0-7"]')
    assert item_folders.publish(spark, root, staging) == 1
    assert sorted(p.name for p in tmp_path.rglob("*")) == ["convert_info.json", "m", "timeline.json"]


def test_export_of_chosen_items(spark, tmp_path):
    listed = spark.createDataFrame([("m", "available"), ("n", "available")], "item_id string, status string")
    pieces = timeline.document_pieces(*parts(spark, 4))
    chosen, missing = items.export_items(listed, items.requested_ids(spark, ["M"]))
    assert sinks.export_items(chosen, missing, pieces, str(tmp_path / "out")) == 2
    assert sorted(p.name for p in (tmp_path / "out" / "items").rglob("*")) == ["convert_info.json", "m", "timeline.json"]
    chosen, missing = items.export_items(listed, items.requested_ids(spark, ["zzz"]))
    with pytest.raises(ValueError, match="Item not found: 1"):
        sinks.export_items(chosen, missing, pieces, str(tmp_path / "out"))
