"""Prefix trie of conversations as a z-fast trie, built in batches by joins.

A z-fast trie (Belazzougui, Boldi, Pagh, Vigna, 2009) is a compacted trie whose nodes are found by hash: a node that covers
the depths from above ``top`` to ``extent`` is stored under the hash of its handle, the prefix whose length is the two-fattest
number of that range (the one divisible by the largest power of two). A sequence finds where it leaves the trie by fat binary
search: it looks up its own prefix of two-fattest length, goes on below the node it meets or above the length it missed.

Here the trie is a table. Each batch lets all open sequences search at once, one pair of joins per step and as many steps as
the longest sequence has bits. Sequences that leave at the same place with the same next turn are one group, and one of
them, drawn by hash, adds its rest as a new node; splits of nodes come from the places. The others go on in the next batch
from where they left, so a batch meets each branch of a third of all sequences once, and their number grows with
the logarithm of the sequences. Equal sequences are one class from the start.

Every class holds each of its ancestors' handles exactly once among its own prefixes. One join therefore gives all
(class, ancestor) pairs, and counts, leaves and saved text of all subtrees are sums over them, without walking the tree.

Prefixes are compared by 128 bits of hash: among 10**12 different prefixes two agree by chance with probability 2e-15.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from turnweave.llm.tables import kept
from turnweave.operators.ordering import ranked
from turnweave.operators.running import numbered

BIN = 65_536  # depths of one conversation that a task holds in order
KEY = ("x1", "x2")
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_keys(role: Column, text: Column) -> list[Column]:
    """Two hashes of a turn and the code points of its text; null counts as empty."""
    said = [F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))]
    return [
        F.xxhash64(F.lit(1), *said).alias("k1"),
        F.xxhash64(*said, F.lit(2)).alias("k2"),
        F.char_length(said[1]).cast("bigint").alias("chars"),
    ]


def ordered_turns(talks: DataFrame) -> DataFrame:
    """(conv_id, nth, k1, k2, chars): the turns of each conversation, numbered from 1 by turn, null first.

    Rows of one turn number follow each other by their hashes. Rows without conv_id belong to no conversation and go.
    """
    rows = talks.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), *turn_keys(F.col("role"), F.col("text"))
    )
    placed = ranked(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("k1"), F.col("k2")], "place")
    return kept(numbered(placed, ["conv_id"], "place", "nth").select("conv_id", "nth", "k1", "k2", "chars"), "turns")


def with_shared_start(turns: DataFrame, width: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth, k1, k2, chars), and all conversations (conv_id).

    A conversation c starts with the first h turns of conversation c - c % ``width`` (as many as there are), and goes on with
    its own turns after the first h, where h is the checksum of c as text modulo ``most``.
    """
    bins = turns.groupBy("conv_id", F.floor(F.col("nth") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    sizes = kept(bins.groupBy("conv_id").agg(F.sum("n").alias("n")), "sizes")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("head")
    facts = sizes.select("conv_id", head, (F.col("conv_id") - F.col("conv_id") % width).alias("base"))
    facts = facts.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    facts = kept(facts.select("conv_id", "base", "head", F.least("head", F.coalesce("n_base", F.lit(0))).alias("taken")), "starts")
    first = turns.filter(F.col("nth") < most).withColumnRenamed("conv_id", "base")
    start = facts.join(first, "base").filter("nth <= taken").select("conv_id", F.col("nth").alias("depth"), "k1", "k2", "chars")
    # One row per bin of a conversation, so that a very long one is joined in many tasks.
    spread = bins.select("conv_id", "bin").join(facts.select("conv_id", "head", "taken"), "conv_id")
    own = turns.withColumn("bin", F.floor(F.col("nth") / BIN)).join(spread, ["conv_id", "bin"]).filter("nth > head")
    own = own.select("conv_id", (F.col("taken") + F.col("nth") - F.col("head")).alias("depth"), "k1", "k2", "chars")
    return start.union(own), sizes.select("conv_id")


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, x1, x2, chars, before): hash of the first ``depth`` turns, their code points, and those without the last.

    The hash is the exclusive or of the turns' hashes with their depths, so it runs inside bins and is carried between them.
    """
    rows = rebuilt.select(
        "conv_id",
        "depth",
        F.floor(F.col("depth") / BIN).alias("bin"),
        F.xxhash64(F.lit(3), "depth", "k1", "k2").alias("m1"),
        F.xxhash64("k2", "k1", "depth", F.lit(4)).alias("m2"),
        F.col("chars").alias("own"),
    )
    here = Window.partitionBy("conv_id", "bin").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(
        "conv_id", "depth", "bin", "own",
        F.bit_xor("m1").over(here).alias("l1"), F.bit_xor("m2").over(here).alias("l2"), F.sum("own").over(here).alias("lc"),
    )
    bins = rows.groupBy("conv_id", "bin").agg(F.bit_xor("m1").alias("b1"), F.bit_xor("m2").alias("b2"), F.sum("own").alias("bc"))
    order = Window.partitionBy("conv_id").orderBy("bin")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select(
        "conv_id", "bin", F.row_number().over(order).alias("at"),
        F.bit_xor("b1").over(past).alias("c1"), F.bit_xor("b2").over(past).alias("c2"), F.sum("bc").over(past).alias("cc"),
    ).filter("at > 1")
    joined = local.join(carried.drop("at"), ["conv_id", "bin"], "left").fillna(0, ["c1", "c2", "cc"])
    total = F.col("lc") + F.col("cc")
    return joined.select(
        "conv_id",
        "depth",
        F.col("l1").bitwiseXOR(F.col("c1")).alias("x1"),
        F.col("l2").bitwiseXOR(F.col("c2")).alias("x2"),
        total.alias("chars"),
        (total - F.col("own")).alias("before"),
    )


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the largest power of two divides: ``high`` without the bits below the first that differs."""
    same = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, same), same)


def _each_depth(rows: DataFrame, low: str, high: str) -> DataFrame:
    """One row per depth in (low, high], in chunks, so that no array grows with a conversation."""
    first = F.floor((F.col(low) + 1) / BIN)
    chunks = rows.filter(F.col(low) < F.col(high)).withColumn("chunk", F.explode(F.sequence(first, F.floor(F.col(high) / BIN))))
    begin, end = F.col("chunk") * BIN, F.col("chunk") * BIN + (BIN - 1)
    inside = F.sequence(F.greatest(F.col(low) + 1, begin), F.least(F.col(high), end))
    return chunks.withColumn("depth", F.explode(inside)).drop("chunk")


def _at(paths: DataFrame, rep: str, depth: str, *names: str) -> DataFrame:
    """The hash of a class's prefix under other names, keyed by ``rep`` and ``depth``."""
    return paths.select(F.col("rep").alias(rep), F.col("depth").alias(depth), *[F.col(k).alias(n) for k, n in zip(KEY, names)])


def _searched(pending: DataFrame, nodes: DataFrame, paths: DataFrame, steps: int) -> DataFrame:
    """Fat binary search of all open sequences: the last node whose handle starts the sequence, as owner, top, extent, f, e1, e2."""
    none = F.lit(None).cast("bigint")
    rows = pending.select("rep", "n", F.col("low").alias("a"), F.col("n").alias("b"), *[none.alias(c) for c in _NODE])
    known = nodes.select(F.col("f").alias("at"), F.col("f1").alias("y1"), F.col("f2").alias("y2"), *[F.col(c).alias(f"_{c}") for c in _NODE])
    for _ in range(steps):
        asked = rows.withColumn("at", F.when(F.col("a") < F.col("b"), two_fattest(F.col("a"), F.col("b"))))
        asked = asked.join(_at(paths, "rep", "at", "y1", "y2"), ["rep", "at"], "left")
        met = asked.join(known, ["at", "y1", "y2"], "left")
        hit, missed = F.col("_extent").isNotNull(), F.col("at").isNotNull() & F.col("_extent").isNull()
        rows = met.select(
            "rep",
            "n",
            F.when(hit, F.col("_extent")).otherwise(F.col("a")).alias("a"),
            F.when(missed, F.col("at") - 1).otherwise(F.col("b")).alias("b"),
            *[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in _NODE],
        )
    return rows


_NODE = ("owner", "top", "extent", "f", "e1", "e2")


def _exits(pending: DataFrame, nodes: DataFrame, paths: DataFrame, steps: int) -> DataFrame:
    """(rep, n, owner, top, extent, d): the node in which each open sequence leaves the trie, and the depth at which it does.

    ``owner`` is null where it leaves right below a node's end; then only ``d`` matters.
    """
    last = _searched(pending.drop("d"), nodes, paths, steps).join(pending.select("rep", "low"), "rep")
    # A search from a known place may meet no further node: it stands at that place, which ends a node or is the root.
    last = last.withColumn("end", F.coalesce("extent", "low"))
    last = last.join(_at(paths, "rep", "end", "h1", "h2"), ["rep", "end"], "left")
    through = F.col("extent").isNull() | (F.col("h1").eqNullSafe(F.col("e1")) & F.col("h2").eqNullSafe(F.col("e2")))
    last = last.withColumn("through", through).withColumn("next", F.when(F.col("through"), F.col("end") + 1))
    last = last.join(_at(paths, "rep", "next", "y1", "y2"), ["rep", "next"], "left")
    below = nodes.select(
        (F.col("top") + 1).alias("next"), F.col("n1").alias("y1"), F.col("n2").alias("y2"),
        F.col("owner").alias("b_owner"), F.col("top").alias("b_top"), F.col("extent").alias("b_extent"),
    )
    last = last.join(below, ["next", "y1", "y2"], "left")
    inside = F.col("through") & F.col("b_owner").isNotNull()

    def edge(name: str) -> Column:
        return F.when(inside, F.col(f"b_{name}")).when(~F.col("through"), F.col(name))

    sure = F.when(inside, F.col("next")).when(F.col("through"), F.col("end")).otherwise(F.col("f"))
    stood = kept(last.select("rep", "n", edge("owner").alias("owner"), edge("top").alias("top"), edge("extent").alias("extent"), sure.alias("sure")), "stood")
    # How far a sequence goes along the node in which it leaves: its prefixes are compared with those of the node's owner.
    along = _each_depth(stood.filter("owner is not null").withColumn("most", F.least("n", F.col("extent") - 1)), "sure", "most")
    along = along.join(_at(paths, "rep", "depth", "y1", "y2"), ["rep", "depth"])
    same = along.join(_at(paths, "owner", "depth", "y1", "y2"), ["owner", "depth", "y1", "y2"], "left_semi")
    far = same.groupBy("rep").agg(F.max("depth").alias("far"))
    return stood.join(far, "rep", "left").select("rep", "n", "owner", "top", "extent", F.coalesce("far", "sure").alias("d"))


def _keyed(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes (owner, top, extent) with the hashes of their handle (f), end (e), first depth (n) and parent's end (p)."""
    ranges = edges.withColumn("f", two_fattest(F.col("top"), F.col("extent")))
    depths = {"f": F.col("f"), "e": F.col("extent"), "n": F.col("top") + 1, "p": F.col("top")}
    points = ranges.withColumn("point", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), d.alias("depth")) for k, d in depths.items()])))
    points = points.select("owner", "top", "extent", "f", "point.kind", "point.depth")
    found = points.join(paths.select(F.col("rep").alias("owner"), "depth", *KEY, "chars"), ["owner", "depth"], "left")
    hashes = [F.max(F.when(F.col("kind") == k, F.col(f"x{i}"))).alias(f"{k}{i}") for k in depths for i in (1, 2)]
    # The root has no prefix of its own.
    keyed = found.groupBy("owner", "top", "extent", "f").agg(*hashes, F.max(F.when(F.col("kind") == "p", F.col("chars"))).alias("top_chars"))
    return keyed.fillna(0, ["p1", "p2", "top_chars"])


def build(classes: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie, and (rep, exit): the depth at which each class left the trie when it came in."""
    nodes = kept(_keyed(paths.sparkSession.createDataFrame([], "owner long, top long, extent long"), paths), "nodes")
    pending = classes.filter("n > 0").select("rep", "n", F.lit(0).cast("bigint").alias("low"))
    longest = pending.agg(F.max("n")).first()[0]
    exits = classes.filter("n = 0").select("rep", F.lit(0).cast("bigint").alias("exit"))
    while longest is not None:
        found = _exits(pending, nodes, paths, int(longest).bit_length())
        found = found.withColumn("next", F.when(F.col("n") > F.col("d"), F.col("d") + 1))
        found = kept(found.join(_at(paths, "rep", "next", "y1", "y2"), ["rep", "next"], "left"), "exits")
        drawn = found.filter("next is not null").groupBy("next", "y1", "y2").agg(F.min_by("rep", F.struct(F.xxhash64("rep"), "rep")).alias("drawn"))
        named = kept(found.join(drawn, ["next", "y1", "y2"], "left").withColumn("enters", F.col("rep").eqNullSafe(F.col("drawn"))), "drawn")
        exits = exits.union(named.filter("enters or next is null").select("rep", F.col("d").alias("exit")))

        cuts = named.filter("owner is not null and d > top and d < extent").select("owner", "top", "extent", "d").distinct()
        cuts = kept(cuts, "cuts")
        whole = cuts.select("owner", "top", "extent").distinct()
        points = cuts.select("owner", "top", "extent", F.col("d").alias("end")).union(whole.select("*", F.col("extent").alias("end")))
        along = Window.partitionBy("owner", "top", "extent").orderBy("end")
        pieces = points.select("owner", F.lag("end", 1).over(along).alias("begin"), "top", F.col("end").alias("extent"))
        pieces = pieces.select("owner", F.coalesce("begin", "top").alias("top"), "extent")
        leaves = named.filter("enters").select(F.col("rep").alias("owner"), F.col("d").alias("top"), F.col("n").alias("extent"))
        new = _keyed(pieces.union(leaves), paths)
        left = nodes.join(whole, ["owner", "top", "extent"], "left_anti")
        nodes = kept(left.unionByName(new), "nodes")
        pending = named.filter("next is not null and not enters").select("rep", "n", F.col("d").alias("low"))
        longest = pending.agg(F.max("n")).first()[0]
    return nodes, kept(exits, "entered")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the comma-joined ids of each class; rows come sorted, so a class is read once, however large."""
    held, digest = None, hashlib.sha256()

    def out(keys, digests):
        columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], names=["n", "x1", "x2", "ends_sha256"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        ids = batch.column(3).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero((rows[1:] != rows[:-1]).any(axis=1)) + 1, [len(rows)]])
        keys, digests = [], []
        for begin, end in zip(edges[:-1], edges[1:]):
            key, text = tuple(rows[begin].tolist()), ",".join(map(str, ids[begin:end].tolist())).encode()
            if key == held:
                digest.update(b"," + text)
                continue
            if held is not None:
                keys.append(held)
                digests.append(digest.hexdigest())
            held, digest = key, hashlib.sha256(text)
        if keys:
            yield out(keys, digests)
    if held is not None:
        yield out([held], [digest.hexdigest()])


def prefix_trie(rebuilt: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns, with the texts that a shared prefix saves.

    ``rebuilt`` holds (conv_id, depth, k1, k2, chars) with depths from 1 without gaps, ``conversations`` every conv_id once,
    also those without turns. Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, members less one times code points of the last text), ends_sha256 (digest of the
    members that end there, in numeric order). The root has depth 0. Without conversations there is no row.
    """
    every = kept(prefixes(rebuilt), "prefixes")
    last = every.groupBy("conv_id").agg(F.max(F.struct("depth", *KEY, "chars")).alias("last"))
    members = conversations.join(last, "conv_id", "left").select("conv_id", F.col("last.depth").alias("n"), "last.x1", "last.x2", "last.chars")
    members = kept(members.fillna(0), "members")
    classes = kept(members.groupBy("n", *KEY).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.max("chars").alias("chars")), "classes")
    reps = classes.select(F.col("rep").alias("conv_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / BIN))).alias("bin"))
    paths = every.withColumn("bin", F.floor(F.col("depth") / BIN)).join(reps, ["conv_id", "bin"], "left_semi")
    paths = kept(paths.drop("bin").withColumnRenamed("conv_id", "rep"), "paths")
    nodes, exits = build(classes, paths)

    children = kept(nodes.groupBy(F.col("top").alias("n"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    facts = classes.join(children, ["n", *KEY], "left").join(exits, "rep")
    facts = facts.join(paths.select("rep", F.col("depth").alias("exit"), F.col("chars").alias("exit_chars")), ["rep", "exit"], "left")
    facts = facts.select(
        "rep", "n", "size", "chars", "exit", F.coalesce("exit_chars", F.lit(0)).alias("exit_chars"),
        F.col("n_children").isNull().cast("bigint").alias("leaf"),
    )
    facts = kept(facts, "class-facts")
    root = facts.agg(
        F.min("rep"), F.sum("size"), F.sum("leaf"), F.sum(F.col("size") * F.col("chars") - F.col("chars") + F.col("exit_chars"))
    ).first()
    ends = members.repartition("n", *KEY).sortWithinPartitions("n", *KEY, "conv_id").select("n", *KEY, "conv_id")
    ends = kept(ends.mapInArrow(_digests, "n long, x1 long, x2 long, ends_sha256 string"), "ends")

    # A class holds the handle of each of its ancestors, and of its own node, among its prefixes.
    handles = nodes.select("owner", "top", F.col("f").alias("depth"), F.col("f1").alias("x1"), F.col("f2").alias("x2"), "top_chars")
    pairs = paths.select("rep", "depth", *KEY).join(handles, ["depth", *KEY]).join(facts, "rep")
    # Of a class's text below a node's top, the part that it brought itself is stored in any case.
    brought = F.col("chars") - F.when(F.col("exit") >= F.col("top"), F.col("exit_chars")).otherwise(F.col("top_chars"))
    sums = pairs.groupBy("owner", "top").agg(
        F.min("rep").alias("conv_id"), F.sum("size").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("size") * F.col("chars") - brought).alias("saved"),
    )
    full = kept(nodes.join(sums, ["owner", "top"]), "node-sums")
    parents = full.select(F.col("extent").alias("top"), F.col("e1").alias("p1"), F.col("e2").alias("p2"), F.col("conv_id").alias("parent"))
    here = ["extent", "e1", "e2"]
    full = full.join(parents, ["top", "p1", "p2"], "left").join(children.toDF(*here, "n_children"), here, "left")
    full = kept(full.join(ends.toDF(*here, "ends_sha256"), here, "left"), "full-nodes")

    deep = _each_depth(full, "top", "extent").join(paths.select(F.col("rep").alias("owner"), "depth", "before"), ["owner", "depth"])
    at_end = F.col("depth") == F.col("extent")
    inner = deep.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("top") + 1, F.col("conv_id")).when(F.col("top") == 0, F.lit(root[0]).cast("bigint")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        F.when(at_end, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("bigint").alias("n_children"),
        "n_leaves",
        (F.col("saved") - F.col("top_chars") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"),
        F.when(at_end, F.coalesce("ends_sha256", F.lit(NOTHING))).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )
    if root[0] is None:
        return inner
    top = facts.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("extent"), *[F.lit(0).cast("bigint").alias(k) for k in KEY])
    top = top.join(children.withColumnRenamed("n", "extent"), ["extent", *KEY], "left")
    top = top.join(ends.withColumnRenamed("n", "extent"), ["extent", *KEY], "left").select(
        F.lit(root[0]).cast("bigint").alias("conv_id"),
        F.lit(0).cast("bigint").alias("depth"),
        F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.lit(root[1]).cast("bigint").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        F.lit(root[2]).cast("bigint").alias("n_leaves"),
        F.lit(root[3]).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
    return inner.union(top)
