"""MinHash near-dedup with SuperMinHash signatures, banding, verification and union-find grouping.

SuperMinHash (O. Ertl, 2017) gives each set element a random permutation of the signature's slots; in step ``j`` the
element offers ``j`` plus a uniform fraction to the slot that its permutation puts at place ``j``. Slots therefore
receive ranks that are correlated within an element, which lowers the variance against independent minima, and a
document stops as soon as all its slots hold a value below the current step. Here one step is done for all elements of
many documents at once.

Rows with equal shingle sets form one class, and only one row of a class goes on. Classes that share a band are candidates.
A band's members are first compared with one of them, never all with all: members found to belong together need no
further comparison. What is left are families of texts that differ from a common core in a few places, and the rest of them is
found by what they lack: two members of a family are similar only if they lack or add the same shingles in enough
places, so a join on these rare differences takes the place of a join on the common ones. Every link is confirmed on the full
sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnweave.llm.components import components, regrouped
from turnweave.llm.hashing import Windows, mix, word_bounds, word_hashes
from turnweave.llm.tables import kept, lists, slices

SLOTS = 128
BANDS = 32  # of 4 slots: a pair of similarity 0.8 shares no band with probability (1 - 0.8**4)**32 = 5e-8
SKETCH_BITS = 512  # four bits per slot
# Of the slots of a pair of similarity 0.8, 24 sketches differ, with a deviation below 4.4; this leaves over five of them.
MOST_SLOTS_APART = 48
SLICE_BYTES = 1 << 17


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text end to end, and their number per text.

    A text of fewer than ``words`` words, but at least one, has its whole word sequence as its only shingle.
    """
    texts = len(offsets) - 1
    starts, ends, before = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends, lower=True)
    count = np.diff(before)
    windows = Windows(hashes)
    per_text = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    text_of = np.repeat(np.arange(texts, dtype=np.int32), per_text)
    nth = np.arange(len(text_of)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = before[:-1][text_of] + nth
    shingles = windows(begin, begin + np.minimum(count, words)[text_of], 2)
    order = np.lexsort((shingles, text_of))
    shingles, text_of = shingles[order], text_of[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (text_of[1:] != text_of[:-1])
    return shingles[new], np.bincount(text_of[new], minlength=texts)


def signatures(shingles: np.ndarray, counts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash values (step in the high 8 bits, fraction in the low 24) per text and slot."""
    texts = len(counts)
    held = np.full((texts, slots), 0xFFFFFFFF, np.uint32)
    flat = held.reshape(-1)
    text_of = np.repeat(np.arange(texts), counts)
    elements, places = shingles, None
    for step in range(slots):
        if step:
            open_texts = (held.max(axis=1) >> np.uint32(24)) >= step
            going = open_texts[text_of]
            if not going.any():
                break
            if not going.all():
                elements, text_of = elements[going], text_of[going]
                places = places[going]
        rows = np.arange(len(elements))
        random = mix(elements, 11 + step)
        pick = step + (((random & np.uint64(0xFFFFFFFF)) * np.uint64(slots - step)) >> np.uint64(32)).astype(np.int64)
        if places is None:
            places = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(elements), slots)).copy()
        slot = places[rows, pick].astype(np.int64)
        places[rows, pick] = places[:, step]
        value = (np.uint32(step) << np.uint32(24)) | (random >> np.uint64(40)).astype(np.uint32)
        np.minimum.at(flat, text_of * slots + slot, value)
    return held


def _features(words: int):
    schema = pa.schema(
        [("_row_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
         ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = SLOTS // BANDS
        for part, data, offsets in slices(batches, "_text", SLICE_BYTES):
            shingles, counts = shingle_sets(data, offsets, words)
            values = signatures(shingles, counts)
            keys = _set_keys(shingles, counts)
            bands = np.zeros((len(counts), BANDS), np.uint64)
            for k in range(width):
                bands = mix(bands ^ values[:, k::width].astype(np.uint64), 5 + k)
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B9), 6)
            low = (values & np.uint32(15)).astype(np.uint8)
            sketch = np.ascontiguousarray(low[:, ::2] | low[:, 1::2] << np.uint8(4)).view("<i8")
            some = counts > 0
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(keys[0]), pa.array(keys[1]),
                 lists(bands[some].view(np.int64).reshape(-1), np.where(some, BANDS, 0), pa.int64()),
                 lists(sketch.reshape(-1), np.full(len(counts), SKETCH_BITS // 64), pa.int64())],
                schema=schema,
            )

    return run, "_row_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"


def _set_keys(shingles: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Two sums of mixed shingles per text: texts of equal sets have equal keys."""
    begin = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        zero = np.zeros(1, np.uint64)
        sums = [np.concatenate([zero, np.cumsum(mix(shingles, salt), dtype=np.uint64)]) for salt in (3, 4)]
        return [(s[begin[1:]] - s[begin[:-1]]).view(np.int64) for s in sums]


def _sets(words: int):
    schema = pa.schema(
        [("_row_id", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("shingles", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "_text", SLICE_BYTES):
            shingles, counts = shingle_sets(data, offsets, words)
            keys = _set_keys(shingles, counts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(keys[0]), pa.array(keys[1]), lists(shingles.view(np.int64), counts, pa.int64())],
                schema=schema,
            )

    return run, "_row_id long, set_a long, set_b long, shingles array<long>"


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row: groups linked by 100 * intersection >= percent * union.

    Sets hold the distinct shingles of ``words`` words, ASCII letters in lower case. Null, empty and blank texts have
    no shingles and link with nothing. Rows that repeat an id are one node of the graph, with the links of all their texts;
    rows with a null id stand alone (component null, kept). Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("_row_id"), F.col(f"`{text_column}`").alias("_text"))
    run, kind = _features(words)
    features = kept(rows.mapInArrow(run, kind), "signatures")
    some = features.filter("n_shingles > 0 and _row_id is not null")
    key = ["set_a", "set_b", "n_shingles"]
    # A class is known by a number of its own, as one id can carry texts of several classes.
    classes = some.groupBy(*key).agg(F.min("_row_id").alias("least")).withColumn("rep", F.monotonically_increasing_id())
    classes = kept(classes, "classes")
    members = kept(some.select("_row_id", *key).join(classes, key).select("_row_id", "rep").distinct(), "members")
    reps = some.join(classes.withColumnRenamed("least", "_row_id"), ["_row_id", *key]).dropDuplicates(["rep"])
    reps = kept(reps.select("rep", "_row_id", *key, "bands", "sketch"), "representatives")
    shared = members.groupBy("_row_id").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same_id = members.join(shared, "_row_id").select(F.col("rep").alias("a"), "b")
    linked, late = class_groups(rows, reps, words, percent)
    groups = regrouped(linked, same_id if late is None else same_id.union(late))
    # A component is named by the smallest id among its classes.
    inside = kept(classes.select("rep", "least").join(groups.withColumnRenamed("id", "rep"), "rep"), "inside")
    names = kept(inside.groupBy("component").agg(F.min("least").alias("name")), "names")
    named = kept(inside.join(names, "component").select("rep", "name"), "named")
    found = members.join(named, "rep").groupBy("_row_id").agg(F.min("name").alias("component"))
    # Without a link, an id has texts of one class only, whose smallest id names it.
    alone = members.join(named, "rep", "left_anti").join(classes.select("rep", "least"), "rep")
    found = found.union(alone.select("_row_id", F.col("least").alias("component")))
    return (
        features.select("_row_id", "n_shingles")
        .join(found, "_row_id", "left")
        .select(
            F.col("_row_id").alias(id_column),
            "n_shingles",
            F.coalesce("component", "_row_id").alias("component_id"),
            F.coalesce(F.coalesce("component", "_row_id") == F.col("_row_id"), F.lit(True)).alias("kept"),
        )
    )


def class_groups(rows: DataFrame, reps: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Groups (id, component) of classes, and confirmed links (a, b) that are still to join them.

    First every band's members meet its smallest member. Members of bands that then hold several components form
    families, chained by their bands, and are compared by their differences from the family's core.
    """
    exploded = reps.select(F.explode("bands").alias("band"), F.col("rep"))
    ends = exploded.groupBy("band").agg(F.min("rep").alias("pivot"), F.max("rep").alias("high")).filter("pivot < high")
    shared = kept(ends, "shared-bands")
    buckets = kept(exploded.join(shared.select("band", "pivot"), "band"), "bands")
    facts = reps.select("rep", F.col("n_shingles").alias("n"), "sketch")
    wanted = reps.select("rep", "_row_id", "set_a", "set_b").join(buckets.select("rep").distinct(), "rep")
    texts = rows.join(wanted.select("_row_id").distinct(), "_row_id", "left_semi")
    run, kind = _sets(words)
    sets = texts.mapInArrow(run, kind).join(wanted, ["_row_id", "set_a", "set_b"]).dropDuplicates(["rep"])
    sets = kept(sets.select("rep", "shingles"), "sets")

    pairs = kept(_pairs(buckets.filter("rep <> pivot").select("rep", F.col("pivot").alias("other"))), "pairs")
    x, y = _side(facts, "x", "a"), _side(facts, "y", "b")
    likely = pairs.join(x, "a").join(y, "b").filter(_possible(percent)).select("a", "b")
    found = kept(_confirmed(likely, sets, percent), "confirmed")
    groups = kept(components(found), "groups")

    members = kept(_mixed(buckets.select("band", "rep"), groups), "mixed-bands")
    if members.limit(1).count() == 0:
        return groups, None
    family = kept(_families(members, facts), "families")
    differing = kept(_differences(family, sets, percent), "differences")
    sure = kept(_confirmed(_pairs(_surely(differing, percent)), sets, percent), "confirmed")
    groups = kept(regrouped(groups, sure), "groups")
    now = groups.select(F.col("id").alias("rep"), F.col("component").alias("now"))
    differing = differing.join(now, "rep", "left").withColumn("component", F.coalesce("now", "rep")).drop("now")
    likely = _pairs(_met(kept(differing, "open-members"), percent)).join(pairs, ["a", "b"], "left_anti")
    return groups, kept(_confirmed(likely, sets, percent), "confirmed")


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def _side(facts: DataFrame, name: str, key: str) -> DataFrame:
    return facts.select(F.col("rep").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in facts.columns if c != "rep"])


def _possible(percent: int) -> F.Column:
    """Whether sizes and sketches of x and y leave the similarity possible."""
    small, large = F.least("x_n", "y_n"), F.greatest("x_n", "y_n")

    def apart(k: int) -> F.Column:
        """Slots in the k-th number of the sketch, four bits each, that differ."""
        bits = F.col("x_sketch")[k].bitwiseXOR(F.col("y_sketch")[k])
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2))
        return F.bit_count(bits.bitwiseAND(F.lit(0x1111111111111111)))

    total = sum((apart(k) for k in range(1, SKETCH_BITS // 64)), apart(0))
    return (small * 100 >= large * percent) & (total <= MOST_SLOTS_APART)


def _mixed(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of the bands that hold two components or more, with their component."""
    named = (
        members.join(groups.withColumnRenamed("id", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
        .select(*members.columns, "component")
    )
    ends = named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return named.join(ends.filter("low < high").select("band", "low"), "band")


def _families(members: DataFrame, facts: DataFrame) -> DataFrame:
    """(rep, component, family, n, sketch): components chained by common bands are one family."""
    chained = components(members.select("component", "low").distinct(), "component", "low")
    known = members.groupBy("rep").agg(F.min("component").alias("component"))
    named = known.join(chained.select(F.col("id").alias("component"), F.col("component").alias("family")), "component")
    return named.join(facts, "rep").select("rep", "component", "family", "n", "sketch")


def _differences(family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members with ``core`` (shingles that over half of the family holds), ``lacks`` (how many of them a member lacks) and
    ``differs``: shingles in which it differs from the core, rarest difference first, without those of one component only.

    For any two members, intersection = core - lacks of one - lacks of the other + differences in common, whatever the core.
    """
    inside = family.select("rep", "component", "family").join(sets, "rep").select("rep", "component", "family", F.explode("shingles").alias("shingle"))
    inside = kept(inside, "family-shingles")
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    counts = inside.groupBy("family", "shingle").agg(
        F.count(F.lit(1)).alias("held"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    counts = kept(counts.join(sizes, "family").withColumn("is_core", F.col("held") * 2 > F.col("size")), "shingle-counts")
    core = kept(counts.filter("is_core").select("family", "shingle", "size", "held"), "core")
    added = counts.filter("not is_core and low < high").select("family", "shingle", F.col("held").alias("rarity"))
    adds = inside.join(added, ["family", "shingle"]).select("rep", "shingle", "rarity")
    # A member lacks the core's shingles that it does not hold: those of the family without its own.
    lacking = kept(core.filter("held < size").select("family", "shingle", (F.col("size") - F.col("held")).alias("rarity")), "lacking")
    listed = lacking.groupBy("family").agg(F.sort_array(F.collect_list("shingle")).alias("core_list"))
    own = family.select("rep", "family").join(listed, "family").join(sets, "rep")
    lost = own.select("rep", "family", F.explode(F.array_except("core_list", "shingles")).alias("shingle"))
    lost = kept(lost.join(lacking, ["family", "shingle"]).select("rep", "shingle", "rarity"), "lost")
    lacks = lost.groupBy("rep").agg(F.count(F.lit(1)).alias("lacks"))
    order = F.array_sort(F.collect_list(F.struct("rarity", "shingle")))
    differs = lost.filter("rarity > 1").union(adds).groupBy("rep").agg(order.alias("differs"))
    cores = core.groupBy("family").agg(F.count(F.lit(1)).alias("core"))
    joined = family.join(cores, "family", "left").join(lacks, "rep", "left").join(differs, "rep", "left")
    listed = F.coalesce(F.col("differs.shingle"), F.array().cast("array<bigint>"))
    rows = joined.fillna(0, ["core", "lacks"]).withColumn("differs", listed)
    # The more a member lacks for its size, the more differences it must have in common with a partner.
    return rows.withColumn("gap", F.col("lacks") * (100 + percent) + F.col("n") * percent)


def _needed(percent: int, one: str, other: str) -> F.Column:
    """How many differences two members must have in common to be similar, from their gaps and their core."""
    return F.expr(f"({one} + {other} + {99 + percent}) div {100 + percent} - core")


def _surely(members: DataFrame, percent: int) -> DataFrame:
    """(rep, other): members similar to the member of the least gap of their family whatever they have in common with it.

    Whoever is similar to any member in this way is so to that one, so these links connect all of them.
    """
    centre = F.min_by(F.struct(F.col("rep").alias("other"), F.col("gap").alias("least"), F.col("component").alias("its")), F.struct("gap", "rep"))
    centres = kept(members.groupBy("family").agg(centre.alias("centre")).select("family", "centre.*"), "centres")
    met = members.join(centres, "family").filter("rep <> other and component <> its")
    return met.filter(_needed(percent, "gap", "least") <= 0).select("rep", "other")


def _met(members: DataFrame, percent: int) -> DataFrame:
    """(rep, other): members outside their family's largest component, and members of other components that may be similar.

    Two members that need ``s`` differences in common share one among the rarest of each, all but the last s - 1. Bits of their
    differences limit how many they have in common, sizes and sketches limit their similarity.
    """
    mask = [
        F.aggregate(
            F.filter("differs", lambda e, k=k: F.pmod(e, F.lit(4)) == k),
            F.lit(0).cast("bigint"),
            lambda bits, e: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(e, 2), F.lit(64)).cast("int"))),
        ).alias(f"mask{k}")
        for k in range(4)
    ]
    rows = members.select("*", F.size("differs").alias("many"), *mask)
    sizes = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("size"), F.min("gap").alias("gap"))
    heads = sizes.groupBy("family").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.min("gap").alias("least"))
    heads = kept(heads, "largest")
    outside = kept(rows.join(heads, "family").filter("component <> largest"), "outside")
    nearest = kept(outside.groupBy("family").agg(F.min("gap").alias("least")), "nearest")

    def listed(side: DataFrame, name: str) -> DataFrame:
        """The rarest differences of each member that a partner of the least gap may share."""
        most = F.col("many") - F.greatest(_needed(percent, "gap", "least"), F.lit(1)) + 1
        first = side.filter(most > 0).withColumn("rare", F.slice("differs", F.lit(1), F.greatest(most, F.lit(0)).cast("int")))
        columns = ["rep", "component", "n", "sketch", "many", "gap", *[f"mask{k}" for k in range(4)]]
        return first.select(
            "family", *(["core"] if name == "x" else []), *[F.col(c).alias(f"{name}_{c}") for c in columns],
            F.posexplode("rare").alias(f"{name}_at", "shingle"),
        )

    x = listed(outside, "x")
    y = listed(rows.join(nearest, "family"), "y")
    need = _needed(percent, "x_gap", "y_gap")
    shared = sum((F.bit_count(F.col(f"x_mask{k}").bitwiseAND(F.col(f"y_mask{k}"))) for k in range(4)), F.lit(0))
    doubled = F.col("x_many") - sum((F.bit_count(f"x_mask{k}") for k in range(4)), F.lit(0))
    met = x.join(y, ["family", "shingle"]).filter(
        (F.col("x_component") != F.col("y_component"))
        & (F.col("x_at") + need <= F.col("x_many"))
        & (F.col("y_at") + need <= F.col("y_many"))
        & (shared + doubled >= need)
        & _possible(percent)
    )
    return met.select(F.col("x_rep").alias("rep"), F.col("y_rep").alias("other"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"))
    other = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return pairs.join(one, "b").join(other, "a").filter(common * 100 >= union * percent).select("a", "b")
