"""Audit of how far the sources of a language differ, by three-dimensional cube partitioning.

Each source of a language has a smoothed distribution over the language's kept terms, in whole billionths. The comparison
of all pairs of sources over all terms is a cube: source x source x term. It is cut into cells (block of sources, block of
sources, block of terms); a block of a source's distribution is copied to each cell that needs it, every cell computes
partial sums of absolute differences, and the sums are added along the term axis. A cell holds about
``GROUPS`` x 2 sources and ``TERMS`` terms, whatever the size of the corpus.

Terms are counted per task before anything is shuffled, so a source with a third of all documents is no larger than its
vocabulary afterwards.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from turnweave.llm.tables import kept

GROUPS = 16  # sources of a block, about
TERMS = 4_096  # terms of a block, about
SCALE = 1_000_000_000
SMOOTHING = 5
HELD = 400_000  # distinct terms that a task holds before it hands its counts on
PIECE = 1 << 20  # bytes of a long text that are split at once
# Runs of ASCII letters and of any character beyond ASCII, as UTF-8 bytes.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
BREAK = re.compile(rb"[^A-Za-z\x80-\xff]")
COUNTS = "lang string, source string, term binary, n long, docs long"
PARTIAL = "lang string, a string, b string, part long, terms long, rest long, vocabulary long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text with A-Z lower-cased, a long text in pieces that end between terms."""
    begin = 0
    while begin < len(text):
        end = BREAK.search(text, begin + PIECE) if len(text) - begin > PIECE else None
        stop = end.start() if end else len(text)
        yield TERM.findall(text[begin:stop].lower())
        begin = stop


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per (lang, source, term), merged within the task; a null term stands for the group."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def merged() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = [None, *n]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()),
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *(docs[t] for t in n)], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        counts.clear()

    for batch in batches:
        for lang, source, text in zip(*(column.to_pylist() for column in batch.columns)):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            distinct: set[bytes] = set()
            for found in terms_of(text or b""):
                n.update(found)
                distinct.update(found)
            docs.update(distinct)
        if sum(len(n) for n, _ in counts.values()) > HELD:
            yield from merged()
    yield from merged()


def term_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and documents that hold it. A row without term per group."""

    def named(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))

    rows = docs.select(
        named(lang_column).alias("lang"), named(source_column).alias("source"), F.col(f"`{text_column}`").cast("binary").alias("text")
    )
    merged = rows.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return merged.withColumn("term", F.col("term").cast("string"))


def _share(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * vocabulary)) in whole numbers; null without any term."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(20,0)")
    below = F.nullif(total + SMOOTHING * vocabulary, F.lit(0)).cast("decimal(20,0)")
    return F.call_function("div", above, below) + F.lit(1)


def distributions(counts: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, vocabulary, rest, n_groups) and shares (lang, source, term, p, q) of the terms a group holds.

    ``rest`` is the share of a term that the group does not hold, ``q`` the share of the term in the whole language.
    """
    words = counts.filter("term is not null")
    by_lang = words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    terms = kept(by_lang.filter(F.col("docs") >= least_docs).select("lang", "term", "lang_n"), "terms")
    held = kept(words.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "held-terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = counts.filter("term is null").select("lang", "source")
    many = named.groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups"))
    groups = named.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(many, "lang")
    groups = groups.fillna(0, ["total", "vocabulary", "lang_total"])
    groups = groups.withColumn("rest", _share(F.lit(0), F.col("total"), F.col("vocabulary")))
    groups = kept(groups.fillna(0, ["rest"]), "groups")
    shares = held.join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        _share(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary")).alias("q"),
    )
    return groups, kept(shares, "shares")


def _cell(table: pa.Table) -> pa.Table:
    """Partial divergences of a cell: of each pair of its two source blocks over the terms of its term block.

    Rows without term name the sources of the cell. Terms that no source of the cell holds are added up by their number later.
    """
    here = table.filter(pc.is_null(table["term"])).sort_by("source")
    given = table.filter(pc.is_valid(table["term"]))
    names, block = here["source"].to_pylist(), here["block"].to_pylist()
    rest = here["p"].to_numpy()
    terms = pc.unique(given["term"])
    shares = np.repeat(rest[:, None], len(terms), axis=1)
    row = pc.index_in(given["source"], here["source"]).to_numpy()
    shares[row, pc.index_in(given["term"], terms).to_numpy()] = given["p"].to_numpy()
    first, second = here["i"][0].as_py(), here["j"][0].as_py()
    if first == second:
        pairs = list(combinations(range(len(names)), 2))
    else:
        pairs = list(product(*([k for k, b in enumerate(block) if b == side] for side in (first, second))))
    lang = here["lang"][0].as_py()
    return pa.table(
        {
            "lang": pa.array([lang] * len(pairs), pa.string()),
            "a": pa.array([names[a] for a, _ in pairs], pa.string()),
            "b": pa.array([names[b] for _, b in pairs], pa.string()),
            "part": pa.array([int(np.abs(shares[a] - shares[b]).sum()) for a, b in pairs], pa.int64()),
            "terms": pa.array([len(terms)] * len(pairs), pa.int64()),
            "rest": pa.array([abs(int(rest[a]) - int(rest[b])) for a, b in pairs], pa.int64()),
            "vocabulary": pa.array([here["vocabulary"][0].as_py()] * len(pairs), pa.int64()),
        }
    )


def divergences(groups: DataFrame, shares: DataFrame, group_size: int = GROUPS, term_size: int = TERMS) -> DataFrame:
    """(lang, a, b, value): sum of absolute differences over the kept terms, one row per unordered pair of sources of a language."""
    sides = F.ceil(F.col("n_groups") / group_size)
    depth = F.greatest(F.ceil(F.col("vocabulary") / term_size), F.lit(1))
    facts = groups.select(
        "lang",
        "source",
        "rest",
        "vocabulary",
        sides.alias("sides"),
        depth.alias("depth"),
        F.pmod(F.xxhash64("lang", "source"), sides).alias("block"),
    )
    names = facts.select("*", F.lit(None).cast("string").alias("term"), F.col("rest").alias("p"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("depth") - 1)).alias("k"))
    slices = shares.select("lang", "source", "term", "p").join(facts, ["lang", "source"])
    slices = slices.withColumn("k", F.pmod(F.xxhash64("term"), F.col("depth")))
    copied = slices.select(*names.columns).union(names).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("sides") - 1)))
    cells = copied.select(
        "lang", "source", "block", "term", "p", "vocabulary", "k", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    partial = cells.groupBy("lang", "i", "j", "k").applyInArrow(_cell, PARTIAL)
    summed = partial.groupBy("lang", "a", "b").agg(
        F.sum("part").alias("part"), F.sum("terms").alias("terms"), F.max("rest").alias("rest"), F.max("vocabulary").alias("vocabulary")
    )
    return summed.select("lang", "a", "b", (F.col("part") + (F.col("vocabulary") - F.col("terms")) * F.col("rest")).alias("value"))


def divergence_audit(
    docs: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
    least_docs: int = 30,
    most_terms: int = 50,
    group_size: int = GROUPS,
    term_size: int = TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between sources of a language, and terms a source uses above the rest.

    Part ``pair`` ranks all other sources of the language by distance, part ``term`` the ``most_terms`` terms whose share
    in the source exceeds that in the language the most; ties by item. Terms are runs of ASCII letters and characters beyond
    ASCII, A-Z lower-cased; a language keeps those in at least ``least_docs`` of its rows. Null texts, languages and sources
    count as empty ones, repeated rows as documents of their own. A group without terms is compared like any other; without
    kept terms in its language its distances are 0. An empty table gives no rows; other columns are ignored.
    """
    groups, shares = distributions(kept(term_counts(docs, text_column, lang_column, source_column), "term-counts"), least_docs)
    found = kept(divergences(groups, shares, group_size, term_size), "divergences")
    both = found.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(
        found.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    above = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = both.select("*", F.lit("pair").alias("part"), F.row_number().over(order).alias("rank"))
    terms = above.select("*", F.lit("term").alias("part"), F.row_number().over(order).alias("rank"))
    return pairs.select(*columns).union(terms.filter(F.col("rank") <= most_terms).select(*columns))
