"""Total orders over whole tables: ranks, first-N selections and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnweave.session import stored


def ranked(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """1-based position of every row in the order, without a single-task window.

    Rows are range-partitioned and sorted, their place is written out with them, and the number of rows in earlier
    partitions (one value per partition) is added. ``order`` should end in a unique column.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", 33)
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    # One row per range partition, so the broadcast is bounded by the partition count.
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_before") + within + F.lit(1)).drop("_part", "_place", "_before")


# Up to this many rows each task keeps its own first rows and one task merges these; more of them are ranked.
MOST_MERGED = 1_000


def first_rows(df: DataFrame, order: Sequence[Column | str], count: int) -> DataFrame:
    """The first ``count`` rows of the order. Few of them need no sort of all rows; many are found by rank, so that no task
    merges them all."""
    if count <= MOST_MERGED:
        return df.orderBy(*order).limit(count)
    return ranked(df, order, "_rank").filter(F.col("_rank") <= count).drop("_rank")


def page_rows(
    df: DataFrame, order: Sequence[Column | str], page: int | None = None, page_size: int | None = None
) -> DataFrame:
    """One page of the ordered rows, or all of them when neither argument is given."""
    _check_page(page, page_size)
    if page is None and page_size is None:
        return df.orderBy(*order)
    size = page_size or 100
    start = ((page or 1) - 1) * size
    if start + size <= MOST_MERGED:
        return df.orderBy(*order).offset(start).limit(size)
    chosen = ranked(df, order, "_rank").filter((F.col("_rank") > start) & (F.col("_rank") <= start + size))
    return chosen.orderBy("_rank").drop("_rank")


def page_summary(df: DataFrame, page: int | None = None, page_size: int | None = None) -> DataFrame:
    """One row of page metadata."""
    _check_page(page, page_size)
    total = F.count(F.lit(1)).alias("total_rows")
    if page is None and page_size is None:
        counted = df.agg(total)
        some = F.col("total_rows") > 0
        return counted.select(
            F.lit("all").alias("mode"),
            F.lit(None).cast("bigint").alias("page"),
            F.lit(None).cast("bigint").alias("page_size"),
            "total_rows",
            some.cast("bigint").alias("total_pages"),
            F.col("total_rows").alias("returned_rows"),
            F.lit(0).cast("bigint").alias("offset"),
            some.cast("bigint").alias("range_start"),
            F.col("total_rows").alias("range_end"),
            F.lit(False).alias("has_previous"),
            F.lit(False).alias("has_next"),
        )
    number, size = page or 1, page_size or 100
    start = (number - 1) * size
    pages = F.ceil(F.col("total_rows") / F.lit(size)).cast("bigint")
    returned = F.greatest(F.lit(0), F.least(F.lit(size), F.col("total_rows") - F.lit(start))).cast("bigint")
    nothing = F.lit(0).cast("bigint")
    return (
        df.agg(total)
        .select("total_rows", pages.alias("total_pages"), returned.alias("returned_rows"))
        .select(
            F.lit("page").alias("mode"),
            F.lit(number).cast("bigint").alias("page"),
            F.lit(size).cast("bigint").alias("page_size"),
            "total_rows",
            "total_pages",
            "returned_rows",
            F.lit(start).cast("bigint").alias("offset"),
            F.when(F.col("returned_rows") > 0, F.lit(start + 1)).otherwise(nothing).cast("bigint").alias("range_start"),
            F.when(F.col("returned_rows") > 0, F.lit(start) + F.col("returned_rows"))
            .otherwise(nothing)
            .alias("range_end"),
            (F.lit(number > 1) & (F.col("total_rows") > 0)).alias("has_previous"),
            (F.lit(number) < F.col("total_pages")).alias("has_next"),
        )
    )


def _check_page(page: int | None, page_size: int | None) -> None:
    if page is not None and page < 1:
        raise ValueError("page must be 1 or greater.")
    if page_size is not None and page_size < 1:
        raise ValueError("page_size must be 1 or greater.")
