"""Connected components of a link table, by alternating large and small stars.

Each round moves links towards the smallest id of a component; the number of rounds grows with the logarithm of the
longest path. A node with very many links is no single task's work: its minimum is aggregated in parts, and the join back
is split by adaptive execution. Each round is written to the shared folder. No links come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnweave.llm.tables import kept


def components(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each linked id. Null ids and self links are left out."""
    one, other = F.col(first).cast("bigint"), F.col(second).cast("bigint")
    edges = kept(
        links.filter(one.isNotNull() & other.isNotNull() & (one != other))
        .select(F.greatest(one, other).alias("u"), F.least(one, other).alias("v"))
        .distinct(),
        "links",
    )
    seen, now = None, _digest(edges)
    # Links only ever move to smaller ids, so the rounds end by themselves.
    while now != seen:
        edges = kept(_small_star(_large_star(edges)), "stars")
        seen, now = now, _digest(edges)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def regrouped(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Groups (id, component) after further links (a, b): only the groups' names are linked, which are few."""
    names = [groups.select(F.col("id").alias(c), F.col("component").alias(f"group_{c}")) for c in "ab"]
    met = links.join(names[0], "a", "left").join(names[1], "b", "left")
    merged = components(met.select(F.coalesce("group_a", "a").alias("a"), F.coalesce("group_b", "b").alias("b")))
    merged = kept(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "merged")
    known = groups.join(merged, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    alone = merged.withColumnRenamed("component", "id").join(groups.select("id"), "id", "left_anti")
    return known.union(alone.select("id", F.col("to").alias("component")))


def _digest(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
    # Written first, so that the join deals out its rows anew and adaptive execution can split a node of many links.
    return larger.join(kept(least, "least"), "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    least = kept(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
