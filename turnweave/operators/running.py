"""Ordered running statistics per key that never put a whole key into one task.

A plain ``Window.partitionBy(key)`` sorts every row of a key in a single task, which fails when one recording
holds a large part of the data. Here rows are cut into bins along the order column. A window inside
``(key, bin)`` gives the local value, one pre-aggregated summary row per bin gives what all earlier bins
contribute, and both are combined. The wide rows are shuffled once on ``(key, bin)``; the second, small shuffle
moves one row per bin, and keys that fit in a single bin contribute nothing to it. Several statistics share one pass, also
the lowest point of a running sum.

Where positions may be far apart, ``even_bins`` cuts them by the number of rows of a key, so there are never many more bins
than rows ask for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

POSITION_BIN = 65_536
TIME_BIN_SECONDS = 3_600


@dataclass(frozen=True)
class Running:
    """``sum``, ``max``, ``min`` or ``last`` of ``value`` over the rows before (or up to) each row; ``low`` is the least
    running sum of ``value`` among these rows."""

    kind: str
    value: Column
    inclusive: bool = False


def position_bin(position: Column, size: int | None = None) -> Column:
    return F.floor(position / F.lit(size or POSITION_BIN)).cast("bigint")


def even_bins(df: DataFrame, keys: Sequence[str], position: str, name: str = "_bin", size: int | None = None) -> DataFrame:
    """``df`` with a bin per row that rises with ``position``: 0 for keys of up to ``size`` rows, else one of as many stretches
    of equal width as the key's rows fill.

    Only keys of more rows have a width, so the table that is joined has fewer rows than there are bins.
    """
    most = size or POSITION_BIN
    ends = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias("_bin_low"), F.max(position).alias("_high"))
    width = F.ceil((F.col("_high") - F.col("_bin_low") + 1) / F.ceil(F.col("_n") / most))
    wide = ends.filter(F.col("_n") > most).select(*keys, "_bin_low", width.alias("_bin_width"))
    nth = F.floor((F.col(position) - F.col("_bin_low")) / F.col("_bin_width"))
    return df.join(wide, list(keys), "left").select(*df.columns, F.coalesce(nth, F.lit(0)).cast("bigint").alias(name))


def time_bin(moment: Column, width: float) -> Column:
    return F.floor(moment / F.lit(width)).cast("bigint")


def _local(stat: Running, window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, 0 if stat.inclusive else -1)
    if stat.kind == "last":
        held = F.struct(stat.value.alias("v"))
        return held if stat.inclusive else F.lag(held).over(window)
    return {"sum": F.sum, "max": F.max, "min": F.min, "low": F.min}[stat.kind](stat.value).over(frame)


def _per_bin(stat: Running, order: Sequence[str]) -> Column:
    if stat.kind == "last":
        return F.max_by(F.struct(stat.value.alias("v")), F.struct(*order))
    return {"sum": F.sum, "max": F.max, "min": F.min, "low": F.min}[stat.kind](stat.value)


def _before(kind: str, name: str, bins) -> Column:
    frame = bins.rowsBetween(Window.unboundedPreceding, -1)
    if kind == "last":
        return F.lag(name).over(bins)
    return {"sum": F.sum, "max": F.max, "min": F.min, "low": F.min}[kind](name).over(frame)


def _combined(kind: str, local: str, carried: str) -> Column:
    if kind == "sum":
        zero = F.lit(0)
        return F.coalesce(F.col(local), zero) + F.coalesce(F.col(carried), zero)
    if kind == "last":
        return F.coalesce(F.col(local), F.col(carried)).getField("v")
    if kind == "low":
        # The local low counts from what the earlier bins add up to.
        begun = F.coalesce(F.col(f"{carried}_sum"), F.lit(0))
        return F.least(F.col(carried), F.col(local) + begun)
    return (F.greatest if kind == "max" else F.least)(F.col(local), F.col(carried))


def running(
    df: DataFrame, keys: Sequence[str], bin_column: str, order: Sequence[str], **stats: Running
) -> DataFrame:
    """``df`` with one column per statistic; ``bin_column`` must not decrease along ``order``."""
    keys = list(keys)
    window = Window.partitionBy(*keys, bin_column).orderBy(*order)
    bins = Window.partitionBy(*keys).orderBy(bin_column)
    lows = [name for name, stat in stats.items() if stat.kind == "low"]
    # A low is the minimum of sums, which are taken along the same window first.
    sums = {name: Running("sum", stats[name].value, inclusive=True) for name in lows}
    taken = {name: Running("low", F.col(f"_s_{name}"), stats[name].inclusive) if name in lows else stat for name, stat in stats.items()}

    summed = df.select("*", *[_local(stat, window).alias(f"_s_{name}") for name, stat in sums.items()])
    rows = summed.select("*", *[_local(stat, window).alias(f"_l_{name}") for name, stat in taken.items()])
    # Sums of a bin are part of its rows only where a low needs them.
    summary = (summed if lows else df).groupBy(*keys, bin_column).agg(
        *[_per_bin(stat, order).alias(f"_b_{name}") for name, stat in taken.items()],
        *[F.sum(stats[name].value).alias(f"_b_{name}_sum") for name in lows],
    )
    begun = [_before("sum", f"_b_{name}_sum", bins).alias(f"_c_{name}_sum") for name in lows]
    carried = summary.select("*", F.row_number().over(bins).alias("_nth"), *begun)
    for name in lows:
        reached = F.col(f"_b_{name}") + F.coalesce(F.col(f"_c_{name}_sum"), F.lit(0))
        carried = carried.withColumn(f"_b_{name}", reached)
    carried = carried.select(
        *keys,
        bin_column,
        "_nth",
        *[f"_c_{name}_sum" for name in lows],
        *[_before(stat.kind, f"_b_{name}", bins).alias(f"_c_{name}") for name, stat in stats.items()],
    )
    joined = rows.join(carried.filter("_nth > 1").drop("_nth"), [*keys, bin_column], "left")
    return joined.select(
        *df.columns,
        *[_combined(stat.kind, f"_l_{name}", f"_c_{name}").alias(name) for name, stat in stats.items()],
    )


def numbered(df: DataFrame, keys: Sequence[str], position: str, name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers per key in the order of ``position``."""
    binned = even_bins(df, keys, position)
    counted = running(binned, keys, "_bin", [position], _n=Running("sum", F.lit(1).cast("bigint")))
    return counted.withColumn(name, F.col("_n") + F.lit(start)).drop("_n", "_bin")


def run_lengths(df: DataFrame, key: str, position: str, value: str, name: str = "run_length") -> DataFrame:
    """Length of the run of equal consecutive values each row belongs to; 0 for a null value.

    Runs are found inside position bins; only the first and last run of a bin can go on in a neighbour, so
    at most two rows per bin are compared across bins.
    """
    binned = even_bins(df, [key], position)
    window = Window.partitionBy(key, "_bin").orderBy(position)
    changed = F.when(
        (F.row_number().over(window) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(window)), 1
    ).otherwise(0)
    rows = binned.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(window))
    local = rows.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(key, "_bin", "_run")))

    runs = rows.groupBy(key, "_bin", "_run").agg(F.first(value).alias("_value"), F.count(F.lit(1)).alias("_size"))
    edges = runs.withColumn("_last", F.max("_run").over(Window.partitionBy(key, "_bin"))).filter(
        "_run = 1 or _run = _last"
    )
    along = Window.partitionBy(key).orderBy("_bin", "_run")
    broken = (
        F.lag("_bin").over(along).isNull()
        | (F.lag("_bin").over(along) == F.col("_bin"))
        | ~F.lag("_value").over(along).eqNullSafe(F.col("_value"))
    )
    chained = edges.withColumn("_break", broken.cast("int")).withColumn("_chain", F.sum("_break").over(along))
    across = (
        chained.withColumn("_total", F.sum("_size").over(Window.partitionBy(key, "_chain")))
        .filter("_total <> _size")
        .select(key, "_bin", "_run", "_total")
    )
    length = F.coalesce(F.col("_total"), F.col("_size"))
    return local.join(across, [key, "_bin", "_run"], "left").select(
        *df.columns, F.when(F.col(value).isNull(), F.lit(0)).otherwise(length).cast("bigint").alias(name)
    )


def repeat_counts(
    df: DataFrame, key: str, position: str, value: str, name: str = "repeats", counted: DataFrame | None = None
) -> DataFrame:
    """How often each row's value occurs within its key; 0 for a null value.

    Counted per position bin first and joined back per bin, so a value that fills a whole recording stays spread.
    ``counted`` gives the same rows from a shorter plan when ``df`` is itself the result of much work.
    """
    place = position_bin(F.col(position)).alias("_bin")
    source = (df if counted is None else counted).filter(F.col(value).isNotNull())
    per_bin = source.groupBy(key, place, value).agg(F.count(F.lit(1)).alias("_n"))
    totals = per_bin.select(
        key, "_bin", value, F.sum("_n").over(Window.partitionBy(key, value)).alias("_total")
    )
    return df.withColumn("_bin", place).join(totals, [key, "_bin", value], "left").select(
        *df.columns, F.coalesce(F.col("_total"), F.lit(0)).cast("bigint").alias(name)
    )
