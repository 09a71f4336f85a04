"""Path mapping between hosts and containers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from turnweave.functions.text import forward_slashes, is_windows_path, strip

DRIVE = r"^[A-Za-z]:[\\/]"
# Mappings up to this number, and bytes of their text, travel in the plan; more of them are joined.
MOST_MAPPINGS = 10_000
MOST_BYTES = 2_000_000


def _mapping_key(path: Column) -> Column:
    """Forward slashes, no trailing one; drive paths without case."""
    key = F.regexp_replace(forward_slashes(strip(path)), "/+$", "")
    return F.when(strip(path).rlike(DRIVE), F.lower(key)).otherwise(key)


def _prefixes(key: Column) -> Column:
    """The path itself and every parent, longest first."""
    parts = F.split(key, "/")
    return F.transform(
        F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )


def remap_paths(
    paths: DataFrame, mappings: DataFrame, path: str = "path", name: str = "mapped_path", reverse: bool = False
) -> DataFrame:
    """Adds the path under the mapping with the longest matching prefix; null without one.

    Mappings are configuration: up to ``MOST_MAPPINGS`` of them become a sorted list in the plan, in which each path looks up
    itself and its parents by binary search, so no path is shuffled. A longer list is joined on these prefixes. With
    ``reverse`` container paths turn into host paths in the host's own style and unmapped ones stay as they are.
    ``mappings`` has ``host`` and ``container``.
    """
    table = _prefix_table(mappings, reverse)
    text = strip(F.col(path))
    key = F.regexp_replace(forward_slashes(text), "/+$", "") if reverse else _mapping_key(F.col(path))
    listed = table.limit(MOST_MAPPINGS + 1).collect()
    if len(listed) <= MOST_MAPPINGS and sum(len(p) + len(t) for p, t in listed) <= MOST_BYTES:
        rows = paths.withColumn("_key", key).withColumn("_hit", _longest_listed(F.col("_key"), sorted(listed, key=lambda r: r[0].encode())))
        joined = rows.withColumn(name, F.when(F.col("_hit").isNotNull(), _mapped(reverse))).drop("_key", "_hit")
    else:
        joined = paths.join(_longest_joined(paths, table, path, key).select(path, _mapped(reverse).alias(name)), path, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), text)) if reverse else joined


def _prefix_table(mappings: DataFrame, reverse: bool) -> DataFrame:
    origin, target = ("container", "host") if reverse else ("host", "container")
    plain_key = F.regexp_replace(forward_slashes(strip(F.col(origin))), "/+$", "")
    return (
        mappings.filter((strip(F.col("host")) != "") & (strip(F.col("container")) != ""))
        .select((plain_key if reverse else _mapping_key(F.col(origin))).alias("_prefix"), strip(F.col(target)).alias("_target"))
        .filter("_prefix <> ''")
        .groupBy("_prefix")
        .agg(F.min("_target").alias("_target"))
    )


def _longest_listed(key: Column, listed: list) -> Column:
    """(_prefix, _target) of the longest prefix in a list sorted by bytes; null without one."""
    if not listed:
        return F.lit(None).cast("struct<_prefix:string, _target:string>")
    # As text these are two literals, which the optimizer parses once.
    prefixes, targets = (F.from_json(F.lit(json.dumps([r[k] for r in listed])), "array<string>") for k in (0, 1))

    def place(prefix: Column) -> Column:
        """The first place whose entry is not below the prefix."""

        def halved(state: Column, _: Column) -> Column:
            middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
            below = F.get(prefixes, middle) < prefix
            open_still = state["low"] < state["high"]
            return F.struct(
                F.when(open_still & below, middle + 1).otherwise(state["low"]).alias("low"),
                F.when(open_still & ~below, middle).otherwise(state["high"]).alias("high"),
            )

        steps = F.sequence(F.lit(1), F.lit(len(listed).bit_length()))
        begin = F.struct(F.lit(0).alias("low"), F.lit(len(listed)).alias("high"))
        return F.aggregate(steps, begin, halved)["low"]

    offered = F.transform(_prefixes(key), lambda prefix: F.struct(prefix.alias("_prefix"), place(prefix).alias("at")))
    found = F.filter(offered, lambda o: F.coalesce(F.get(prefixes, o["at"]) == o["_prefix"], F.lit(False)))
    hits = F.transform(found, lambda o: F.struct(o["_prefix"].alias("_prefix"), F.get(targets, o["at"]).alias("_target")))
    return F.get(hits, F.lit(0))


def _longest_joined(paths: DataFrame, table: DataFrame, path: str, key: Column) -> DataFrame:
    """(path, _key, _hit) for paths with a mapping: each path offers itself and its parents as equi-join keys."""
    distinct = paths.select(path).distinct().withColumn("_key", key)
    offered = distinct.select(path, "_key", F.explode(_prefixes(F.col("_key"))).alias("_prefix"))
    longest = F.max_by(F.struct("_prefix", "_target"), F.length("_prefix")).alias("_hit")
    return offered.join(table, "_prefix").groupBy(path, "_key").agg(longest)


def _mapped(reverse: bool) -> Column:
    # Both keys have their slashes normalized, so the rest is what follows the prefix.
    rest = F.substr(F.col("_key"), F.length("_hit._prefix") + F.lit(2))
    root = F.regexp_replace(F.col("_hit._target"), r"[\\/]+$", "")
    mapped = F.when(F.col("_key") == F.col("_hit._prefix"), F.col("_hit._target"))
    if reverse:
        windows = is_windows_path(F.col("_hit._target"))
        mapped = mapped.when(windows, F.concat(root, F.lit("\\"), F.replace(rest, F.lit("/"), F.lit("\\"))))
    return mapped.otherwise(F.concat(root, F.lit("/"), rest))


def drive_to_mount(path: Column) -> Column:
    """``C:\\folder`` as ``/mnt/c/folder``; other paths stay."""
    text = strip(path)
    rest = F.regexp_replace(forward_slashes(F.substr(text, F.lit(4))), "^/+", "")
    return F.when(
        text.rlike(DRIVE), F.concat(F.lit("/mnt/"), F.lower(F.substring(text, 1, 1)), F.lit("/"), rest)
    ).otherwise(text)
