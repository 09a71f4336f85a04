"""Mixing sources to target weights, over blocks of fixed length.

The words of a source follow each other, document after document, and are cut into blocks of ``block`` words; the last block of
a source may be shorter. The mix is a sequence of slots, one block each, dealt out to output shards:

1. each shard draws how many of its slots go to each source, multinomially by the sources' shares of all slots;
2. the slots of a source are numbered over all shards. A source has a fixed number of slots in total, the one that brings
   it nearest to its target: slots drawn beyond it are handed, in order, to the sources that drew too few. So totals
   are exact, and the shards differ by chance;
3. slot ``q`` of a source with ``n`` blocks takes the block that the pseudorandom permutation of round ``q // n`` puts at
   place ``q % n``. Every block is taken once before any is taken again;
4. slots meet the documents' pieces by (source, block).

All draws are keyed by seed, shard and source, so a rerun or a repeated task gives the same mix. As no source has more than
``most`` times its size as target, no block, and so no document, is taken more than ``most`` times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from turnweave.llm.hashing import mix, word_bounds
from turnweave.llm.tables import kept, slices
from turnweave.operators.ordering import ranked
from turnweave.operators.running import Running, running

BLOCK = 256  # words
SHARD_SLOTS = 4_096
MOST_TIMES = 3
SOURCES_AT_ONCE = 1_024  # sources whose counts a shard draws in one step
PLACES = 8_192  # of a range that one task adds up
SLICE_BYTES = 1 << 20


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in slices(batches, "text", SLICE_BYTES):
        _, _, before = word_bounds(data, offsets)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(np.diff(before), pa.int64())], names=["doc_id", "source", "size"]
        )


def sized(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, source, size): words of each row's text; null and blank texts have none."""
    rows = docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("doc_id"),
        F.col(f"`{source_column}`").cast("string").alias("source"),
        F.col(f"`{text_column}`").cast("string").alias("text"),
    )
    return rows.mapInArrow(_sizes, "doc_id long, source string, size long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_TIMES, block: int = BLOCK) -> DataFrame:
    """(number, source, source_size, target, blocks, quota): what the mix takes of each source.

    Sources in the order of their code points, null last, have the weights in turn and share the words of all sources by
    them. A target stops at ``most`` times the source's size, and the excess is shared out again by weight until none is
    above. ``quota`` is the number of slots, of the source's average block, that comes nearest to the target.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbers = ranked(by_source, [F.col("source").asc_nulls_last()], "number").withColumn("number", F.col("number") - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int")).cast("bigint")
    rows = kept(numbers.withColumn("weight", weight), "weighted-sources")
    total, share, limit = (F.col(c).cast("decimal(38,0)") for c in ("source_size", "weight", "source_size"))
    limit = limit * most
    whole = int(rows.agg(F.sum(total)).first()[0] or 0)
    capped, above = F.lit(False), None
    while True:
        # The words left for the sources below their limit, and their weight; a limit is reached for good, as shares only grow.
        left, open_weight, seen = rows.agg(
            F.sum(F.when(capped, limit)), F.sum(F.when(~capped, share)), F.count_if(capped)
        ).first()
        left, open_weight = whole - int(left or 0), int(open_weight or 0)
        if seen == above or open_weight == 0:
            break
        above = seen
        # Sources that share a whole number of words below this bound reach it: limit * open_weight < left * weight.
        capped = limit * F.lit(open_weight).cast("decimal(38,0)") < F.lit(left).cast("decimal(38,0)") * share
    fair = F.col("weight") * F.lit(left / open_weight if open_weight else 0.0)
    target = F.when(capped, F.col("source_size") * float(most)).otherwise(fair)
    blocks = F.ceil(F.col("source_size") / F.lit(block))
    quota = F.when(F.col("source_size") > 0, F.round(target * blocks / F.col("source_size")).cast("bigint")).otherwise(0)
    found = rows.withColumn("target", target).withColumn("blocks", blocks).withColumn("quota", F.least(quota, blocks * most))
    return kept(found.select("number", "source", "source_size", "target", "blocks", "quota"), "targets")


def _drawn(seed: int, names: tuple[str, ...]):
    """Multinomial counts of a shard's slots over the entries of ``quotas``, each row with a stream of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, part, slots, quotas = (batch.column(i) for i in range(4))
            out: list[list[np.ndarray]] = [[], [], []]
            for s, p, n, q in zip(shard.to_pylist(), part.to_pylist(), slots.to_pylist(), quotas):
                chances = np.asarray(q.as_py(), np.float64)
                counts = np.random.default_rng([seed, s, p + 1]).multinomial(n, chances / chances.sum())
                held = np.flatnonzero(counts)
                for column, values in zip(out, (np.full(len(held), s), held + (p * SOURCES_AT_ONCE if p >= 0 else 0), counts[held])):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=list(names))

    return run


def drawn_slots(plan: DataFrame, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, number, n): slots each shard gives to each source, drawn in two steps so that no task meets all sources.

    First over groups of ``SOURCES_AT_ONCE`` sources, then inside the groups, which is the same as one draw over all.
    """
    spark = plan.sparkSession
    part = F.floor(F.col("number") / SOURCES_AT_ONCE)
    groups = plan.groupBy(part.alias("part")).agg(F.sum("quota").alias("quota"), F.array_sort(F.collect_list(F.struct("number", "quota"))).alias("held"))
    groups = kept(groups.select("part", "quota", F.col("held.quota").alias("quotas")), "source-groups")
    # One number per group of sources comes to the driver.
    chances = [r["quota"] for r in groups.select("part", "quota").orderBy("part").collect()]
    total = sum(chances)
    if not total:
        return spark.createDataFrame([], "shard long, number long, n long")
    shards = spark.range(-(-total // shard_slots)).select(
        F.col("id").alias("shard"),
        F.lit(-1).cast("bigint").alias("part"),
        F.least(F.lit(shard_slots), F.lit(total) - F.col("id") * shard_slots).cast("bigint").alias("slots"),
        F.array(*[F.lit(c).cast("bigint") for c in chances]).alias("quotas"),
    )
    first = shards.mapInArrow(_drawn(seed, ("shard", "part", "slots")), "shard long, part long, slots long")
    inside = first.join(groups.filter("quota > 0").select("part", "quotas"), "part").select("shard", "part", "slots", "quotas")
    return inside.mapInArrow(_drawn(seed, ("shard", "number", "n")), "shard long, number long, n long")


def _permuted(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Adds the block of each slot: its place under the permutation of its source and round."""
    for batch in batches:
        columns = {name: batch.column(i).to_numpy() for i, name in enumerate(batch.schema.names)}
        block = permuted(columns["nth"] % columns["blocks"], columns["blocks"], columns["number"], columns["nth"] // columns["blocks"], seed)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array(columns["nth"] // columns["blocks"]), pa.array(block)],
            names=["shard", "place", "number", "round", "block"],
        )


def permuted(place: np.ndarray, size: np.ndarray, source: np.ndarray, turn: np.ndarray, seed: int) -> np.ndarray:
    """Images of ``place`` under the pseudorandom permutation of 0..size-1 of a source and turn.

    Four Feistel rounds permute the numbers of the least even count of bits that holds ``size``; an image beyond the
    size is permuted again until it lies below, which keeps a permutation and takes four steps at most on average.
    """
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    key = mix(mix(mix(source.astype(np.uint64), seed), 1) ^ turn.astype(np.uint64), 2)
    out = place.astype(np.uint64)
    going = np.arange(len(out))
    while len(going):
        left, right = out[going] >> half[going], out[going] & mask[going]
        for k in range(4):
            left, right = right, left ^ (mix(right ^ key[going], 31 + k) & mask[going])
        out[going] = (left << half[going]) | right
        going = going[out[going] >= size[going].astype(np.uint64)]
    return out.astype(np.int64)


def mixed_slots(plan: DataFrame, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, place, number, round, block): the block of every slot of the mix."""
    counts = kept(drawn_slots(plan, seed, shard_slots), "drawn-slots")
    binned = counts.withColumn("bin", F.floor(F.col("shard") / PLACES))
    begun = running(binned, ["number"], "bin", ["shard"], begin=Running("sum", F.col("n")))
    within = Window.partitionBy("shard").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    # A shard has as many sources as it has slots at most.
    laid = kept(begun.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0))).drop("bin"), "laid-slots")
    quotas = plan.select("number", "blocks", "quota")
    # A source of a third of all slots has a row in each shard, so the quotas reach it by AQE's broadcast or split join.
    drawn = laid.join(quotas, "number")
    fits = F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("begin")))
    drawn = kept(drawn.withColumn("fits", fits.cast("bigint")), "drawn")

    def spread(rows: DataFrame, count: str, *names: str) -> DataFrame:
        """One row per slot of a shard, which are few."""
        return rows.filter(F.col(count) > 0).select(*names, F.posexplode(F.sequence(F.lit(1).cast("bigint"), F.col(count))).alias("k", "_"))

    own = spread(drawn, "fits", "shard", "number", "blocks", "begin", "at").select(
        "shard", (F.col("at") + F.col("k")).alias("place"), "number", (F.col("begin") + F.col("k")).alias("nth"), "blocks"
    )
    # Slots beyond a source's quota, in the order of shards, go to the sources short of theirs, in the order of sources.
    over = spread(drawn.withColumn("excess", F.col("n") - F.col("fits")).withColumn("late", F.col("at") + F.col("fits")), "excess", "shard", "late")
    over = over.select("shard", (F.col("late") + F.col("k")).alias("place"))
    over = ranked(over, ["shard", "place"], "nth_over").withColumn("nth_over", F.col("nth_over") - 1)
    got = drawn.groupBy("number").agg(F.sum("fits").alias("got"))
    short = quotas.join(got, "number", "left").fillna(0, ["got"]).withColumn("lack", F.col("quota") - F.col("got")).filter("lack > 0")
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("lack") - 1) / PLACES)))
    short = short.select("number", "blocks", "got", "lack", chunk.alias("chunk"))
    each = F.explode(F.sequence(F.col("chunk") * PLACES, F.least(F.col("lack"), (F.col("chunk") + 1) * PLACES) - 1))
    short = short.withColumn("k", each).select("number", "blocks", (F.col("got") + F.col("k")).alias("nth"))
    short = ranked(short, ["number", "nth"], "nth_over").withColumn("nth_over", F.col("nth_over") - 1)
    moved = over.join(short, "nth_over").select("shard", "place", "number", "nth", "blocks")
    kind = "shard long, place long, number long, round long, block long"
    return own.union(moved).mapInArrow(lambda batches: _permuted(batches, seed), kind)


def pieces(sizes: DataFrame, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """(number, block, doc_id, row, begin, length): the words of each row that lie in each block of its source.

    ``row`` is the place of the row's first word in its source, which no other row with words shares.
    """
    some = sizes.filter("size > 0").join(plan.select("number", "source"), sizes["source"].eqNullSafe(plan["source"]))
    rows = ranked(some.select("number", "doc_id", "size"), ["number", "doc_id", "size"], "place")
    binned = rows.withColumn("bin", F.floor(F.col("place") / PLACES))
    placed = running(binned, ["number"], "bin", ["place"], row=Running("sum", F.col("size")))
    first, last = F.floor(F.col("row") / block), F.floor((F.col("row") + F.col("size") - 1) / block)
    cut = placed.select("number", "doc_id", "size", "row", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.lit(0), F.col("block") * block - F.col("row"))
    end = F.least("size", (F.col("block") + 1) * block - F.col("row"))
    return cut.select("number", "block", "doc_id", "row", begin.alias("begin"), (end - begin).alias("length"))


def mixture(
    sizes: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = MOST_TIMES,
    block: int = BLOCK,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 13,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of rows (doc_id, source, size): its targets, its slots, and the pieces of rows that its blocks hold.

    A word range of the mix is a slot joined with the pieces of its (number, block). Null sources are a source of their own,
    after the others; null ids and repeated rows are rows like any other. An empty table, or one without words, has no slots.
    """
    plan = targets(sizes, weights, most, block)
    return plan, kept(mixed_slots(plan, seed, shard_slots), "slots"), kept(pieces(sizes, plan, block), "pieces")


def spans(slots: DataFrame, parts: DataFrame) -> DataFrame:
    """(shard, place, number, block, doc_id, row, begin, length): word ranges of the mix in their order inside a slot by ``row``."""
    return slots.join(parts, ["number", "block"]).select("shard", "place", "number", "block", "doc_id", "row", "begin", "length")


def taken_words(sizes: DataFrame, plan: DataFrame, slots: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row: words the mix takes of it, repeats counted."""
    times = slots.groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"))
    rows = parts.join(times, ["number", "block"], "left").fillna(0, ["times"])
    counted = rows.groupBy("number", "row").agg(F.first("doc_id").alias("doc_id"), F.sum("length").alias("size"), F.sum(F.col("length") * F.col("times")).alias("taken"))
    facts = plan.select("number", "source_size", "target")
    some = counted.join(facts, "number").select("doc_id", "size", "source_size", "target", "taken")
    bare = sizes.filter("size = 0").join(plan.select("source", "source_size", "target"), sizes["source"].eqNullSafe(plan["source"]))
    none = bare.select("doc_id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"))
    return some.union(none)
