"""First rows without a sort of all, prefix look-ups in the plan, lines that cannot be read, runs that never report."""

import json
import random

import pytest
from pyspark.sql import functions as F

from turnweave.operators import catalog, ordering, paths, refresh
from turnweave.streaming.stale import silent_runs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute_mapped(path, mappings):
    best = max((h for h in mappings if path == h or path.startswith(h + "/")), key=len, default=None)
    return None if best is None else mappings[best] + path[len(best):]


@pytest.mark.parametrize("count", [0, 1, 7, 5_000])
def test_longest_prefix_among_many_mappings(spark, count):
    rng = random.Random(count)
    hosts = {f"/r{rng.randrange(40)}" + "".join(f"/d{rng.randrange(9)}" for _ in range(rng.randrange(5))) + f"/é{k % 50}" * (k % 2) for k in range(count)}
    mappings = {h: f"/c{n}" for n, h in enumerate(sorted(hosts))}
    offered = [f"/r{rng.randrange(45)}" + "".join(f"/{rng.choice('dé')}{rng.randrange(9)}" for _ in range(rng.randrange(7))) for _ in range(300)]
    offered += list(mappings)[:50] + ["", "/", None]
    rows = spark.createDataFrame(list(mappings.items()), "host string, container string")
    found = paths.remap_paths(spark.createDataFrame([(p,) for p in offered], "path string"), rows)
    assert {r.path: r.mapped_path for r in found.collect()} == {p: brute_mapped(p, mappings) if p else None for p in offered}
    assert "Exchange" not in plan_of(found)


def test_mappings_beyond_the_plan_are_joined(spark, monkeypatch):
    monkeypatch.setattr(paths, "MOST_MAPPINGS", 1)
    rows = spark.createDataFrame([("/a", "/x"), ("/a/b", "C:\\y")], "host string, container string")
    asked = spark.createDataFrame([("/a/b/c",), ("/a/c",), ("/z",)], "path string")
    assert {r.path: r.mapped_path for r in paths.remap_paths(asked, rows).collect()} == {"/a/b/c": "C:\\y/c", "/a/c": "/x/c", "/z": None}


def test_few_first_rows_need_no_sort_of_all(spark, monkeypatch):
    df = spark.range(1_000).select(F.col("id"), (F.col("id") * 7919 % 1009).alias("v"))
    few = ordering.first_rows(df, ["v", "id"], 25)
    assert "rangepartitioning" not in plan_of(few) and "TakeOrderedAndProject" in plan_of(few)
    want = sorted((k * 7919 % 1009, k) for k in range(1_000))
    assert [(r.v, r.id) for r in few.collect()] == want[:25]
    page = ordering.page_rows(df, ["v", "id"], page=3, page_size=40)
    assert [(r.v, r.id) for r in page.collect()] == want[80:120]
    monkeypatch.setattr(ordering, "MOST_MERGED", 10)
    assert sorted((r.v, r.id) for r in ordering.first_rows(df, ["v", "id"], 25).collect()) == want[:25]
    assert [(r.v, r.id) for r in ordering.page_rows(df, ["v", "id"], page=3, page_size=40).collect()] == want[80:120]


@pytest.mark.parametrize("merged", [3, 1_000])
def test_limit_counts_ties_one_by_one(spark, monkeypatch, merged):
    monkeypatch.setattr(refresh, "MOST_MERGED", merged)
    files = [(f"p{k % 4}", f"s::{k % 4}", "h", None if k % 5 == 0 else k % 3) for k in range(40)] + [(None, None, "g", 0)] * 5
    inventory = spark.createDataFrame(files, "path string, source_file_identity string, source_hash string, size_bytes long")
    empty = spark.createDataFrame([], "catalog_pos long, audio_id string, source_file_identity string, source_hash string, conversion_signature string, artifact_exists boolean")
    for limit in (1, 13, 44, 45, 60):
        planned = refresh.plan_refresh(inventory, empty, "sig", limit=limit).collect()
        assert len(planned) == 45 and sum(r.action == "queued" for r in planned) == min(limit, 45)
        size = lambda r: (r.size_bytes or 0, r.path is not None, r.path or "", r.source_file_identity or "")
        queued, deferred = ([size(r) for r in planned if r.action == a] for a in ("queued", "deferred"))
        assert not deferred or max(queued) <= min(deferred)
        assert all(r.reason == ("batch_limit" if r.action == "deferred" else None) for r in planned)


def test_lines_that_cannot_be_read_stay(spark):
    kept = [json.dumps({"run_id": "r2", "run_dir": "/runs/r2"}), "{broken", "[1]", json.dumps({"audio_id": "x"})]
    gone = [json.dumps({"run_id": "R1"}), json.dumps({"job_id": "r1", "run_dir": "/x"}), json.dumps({"run_dir": "/runs/r1/"}), " "]
    lines = spark.createDataFrame([(k, v) for k, v in enumerate(kept + gone)], "at long, value string")
    doomed = spark.createDataFrame([("r1", "/runs/r1")], "run_id string, run_dir string")
    assert sorted(r.value for r in catalog.prune_lines(lines, doomed).collect()) == sorted(kept)
    nobody = spark.createDataFrame([], "run_id string, run_dir string")
    assert catalog.prune_lines(lines, nobody).count() == 7


def test_runs_that_never_report_are_found(spark, tmp_path):
    locks = [("a", 0), ("b", 10), ("c", 20), ("d", 500), ("late", 5)]
    updates = [("a", 25), ("c", 51), ("b", 5), ("x", 500), ("c", 20_000), ("a", 7)]
    # Two files per stream, so that late rows come in a second batch.
    for name, rows, column in (("locks", locks, "locked_at"), ("updates", updates, "updated_at")):
        for part, half in enumerate((rows[:-1], rows[-1:])):
            df = spark.createDataFrame(half, "run_id string, at long").select("run_id", F.timestamp_seconds("at").alias(column))
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}/part={part}")
    read = lambda name, column: (
        spark.readStream.schema(f"run_id string, {column} timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")
    )
    silent = silent_runs(read("locks", "locked_at"), read("updates", "updated_at"), "0 seconds")
    query = (
        silent.select("run_id", F.unix_seconds("interrupted_at").alias("at")).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    found = {(r.run_id, r.at) for r in spark.read.schema("run_id string, at long").parquet(f"{tmp_path}/out").collect()}
    # a reported in time; c reported after its 30 seconds only; d is younger than the watermark.
    assert {("b", 40), ("c", 50)} <= found and not {r for r, _ in found} & {"a", "d"}
