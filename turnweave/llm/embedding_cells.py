"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group.

The comparison is exact. A vector is at home in the cell of its nearest centroid. For unit vectors x at home in cell i and y
at home in cell j, the plane between both centroids separates them, so their angle is at least the angle between x and that
plane. Hence x has to visit cell j only if that angle is within the limit, and of two cells the later one visits the
earlier one, which finds each pair once.

Cells follow the rows: the first level has at most ``MOST_CELLS`` centroids, fitted on a bounded sample, and every cell of a
label that still holds many vectors is cut again by centroids of its own, fitted inside a task on a bounded sample of the
cell. The same rule tells which vectors visit which part; two visitors of a cell are compared where one of them is at home.

Equal vectors (one vector may make up a third of all rows) are counted and merged first. Cells are cut into blocks of
``BLOCK`` vectors, and each task multiplies two blocks, so a large cell is many tasks. A task returns link counts and a
spanning star per group it sees, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from turnweave.llm.components import components
from turnweave.llm.tables import kept, lists

SAMPLE_ROWS = 20_000  # distinct vectors the centroids are fitted on
CELL_ROWS = 4_096  # vectors aimed at per cell
MOST_CELLS = 1_024  # centroids fitted at once
SPLIT_ROWS = 16_384  # vectors of one label in a cell above which it is cut again
PART_SAMPLE = 8_192  # vectors of a cell its own centroids are fitted on
CHUNK = 8_192  # vectors of a cell that a task places at once
BLOCK = 1_024
ITERATIONS = 8
SLACK = 1e-9


def spherical_k_means(vectors: np.ndarray, cells: int, iterations: int = ITERATIONS, seed: int = 7) -> np.ndarray:
    """Unit centroids; a cell that runs empty takes the vector that is farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), cells, replace=False)].copy()
    for _ in range(iterations):
        near = vectors @ centroids.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        if len(empty):
            far = np.argsort(near[np.arange(len(own)), own], kind="stable")[: len(empty)]
            sums[empty] = vectors[far]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
    return centroids


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _units():
    """Unit vectors of the rows whose components are all finite numbers and not all zero."""
    schema = pa.schema([("_row_id", pa.int64()), ("label", pa.string()), ("unit", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for width in np.unique(sizes[sizes > 0]).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == width)))
                # Null components become NaN.
                vectors = _matrix(part.column(2), width)
                good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
                vectors = vectors[good]
                # Scaling by the largest component first keeps squares in range; adding 0.0 turns -0.0 into 0.0.
                vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True) + 0.0
                vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
                ids, labels = (part.column(k).filter(pa.array(good)) for k in (0, 1))
                units = lists(vectors.reshape(-1), np.full(len(vectors), width), pa.float64())
                yield pa.RecordBatch.from_arrays([ids, labels, units], schema=schema)

    return run, "_row_id long, label string, unit array<double>"


def _visits(units: np.ndarray, centroids: np.ndarray, apart: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own cell of each vector, and (row, cell) of the earlier cells that may hold a partner."""
    near = units @ centroids.T
    own = near.argmax(axis=1)
    margin = near[np.arange(len(own)), own][:, None] - near
    # Centroids that coincide leave no plane between them.
    row, cell = np.nonzero((margin <= reach * apart[own]) & (np.arange(len(centroids))[None, :] < own[:, None]))
    return own, row, cell


def _apart(centroids: np.ndarray) -> np.ndarray:
    return np.linalg.norm(centroids[:, None, :] - centroids[None, :, :], axis=2)


def _reach(least: float) -> float:
    return float(np.sqrt(max(0.0, 1 - least * least)) + SLACK)


PLACED = [("rep", pa.int64()), ("label", pa.string()), ("copies", pa.int64()), ("width", pa.int32()), ("cell", pa.int32())]


def _homes(fitted: dict[int, np.ndarray], least: float):
    """Each vector at home in its cell, and as a guest in the earlier cells that may hold a partner; lengths have cells of their own."""
    schema = pa.schema([*PLACED, ("guest", pa.bool_()), ("unit", pa.list_(pa.float64()))])
    reach = _reach(least)
    between = {width: _apart(centroids) for width, centroids in fitted.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.list_value_length(whole.column(3)).to_numpy(zero_copy_only=False)
            for width in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == width)
                for first in range(0, len(rows), 2048):
                    batch = whole.take(pa.array(rows[first : first + 2048]))
                    if width in fitted:
                        own, row, cell = _visits(_matrix(batch.column(3), width), fitted[width], between[width], reach)
                    else:
                        own, row, cell = np.zeros(batch.num_rows, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                    taken = batch.take(pa.array(np.concatenate([np.arange(len(own)), row])))
                    cell = np.concatenate([own, cell]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [taken.column(0), taken.column(1), taken.column(2), pa.array(np.full(len(cell), width, np.int32)), pa.array(cell),
                         pa.array(np.arange(len(cell)) >= len(own)), taken.column(3)],
                        schema=schema,
                    )

    return run, "rep long, label string, copies long, width int, cell int, guest boolean, unit array<double>"


def _fit_parts(group: pa.Table) -> pa.Table:
    """Centroids of one cell, from a sample of its vectors."""
    width, rows = group["width"][0].as_py(), group["rows"][0].as_py()
    group = group.sort_by("rep")
    units = _matrix(group["unit"], width)
    parts = int(min(MOST_CELLS, len(units), max(1, -(-rows // CELL_ROWS))))
    centroids = spherical_k_means(units, parts)
    key = [pa.array([group[c][0].as_py()], t) for c, t in (("label", pa.string()), ("width", pa.int32()), ("cell", pa.int32()))]
    return pa.table([*key, lists(centroids.reshape(-1), np.array([centroids.size]), pa.float64())], names=["label", "width", "cell", "centroids"])


def _parts(least: float):
    """Vectors of a chunk of a cell settled in a part of it, and as visitors in the earlier parts that may hold a partner."""
    schema = pa.schema([*PLACED, ("part", pa.int32()), ("settled", pa.bool_()), ("guest", pa.bool_()), ("unit", pa.list_(pa.float64()))])
    reach = _reach(least)

    def run(chunk: pa.Table, fitted: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return schema.empty_table()
        width = chunk["width"][0].as_py()
        centroids = _matrix(fitted["centroids"], width)
        own, row, part = _visits(_matrix(chunk["unit"], width), centroids, _apart(centroids), reach)
        taken = chunk.take(pa.array(np.concatenate([np.arange(len(own)), row])))
        part = np.concatenate([own, part]).astype(np.int32)
        columns = {name: taken[name] for name in schema.names if name in taken.column_names}
        columns |= {"part": pa.array(part), "settled": pa.array(np.arange(len(part)) < len(own))}
        return pa.table([columns[name] for name in schema.names], schema=schema)

    return run, "rep long, label string, copies long, width int, cell int, part int, settled boolean, guest boolean, unit array<double>"


def _products(least: float):
    schema = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        units = _matrix(group.column("unit"), group.column("width")[0].as_py())
        guest = group.column("guest").to_numpy()
        one, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        within = not len(other)
        if within:
            other = one
        # Two guests of a cell meet in the cell of one of them.
        close = (units[one] @ units[other].T >= least) & ~(guest[one][:, None] & guest[other][None, :])
        if within:
            np.fill_diagonal(close, False)
        i, j = np.nonzero(close)
        a, b = one[i], other[j]
        links = np.bincount(a, copies[b], len(rep))
        if not within:
            links += np.bincount(b, copies[a], len(rep))
        low = _least_reached(rep, a, b)
        some = links > 0
        return pa.table([pa.array(rep[some]), pa.array(low[some]), pa.array(links[some].astype(np.int64))], schema=schema)

    return run, "rep long, other long, links long"


def _least_reached(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest id reachable from each entry by the links (a, b) among them."""
    order = np.argsort(ids, kind="stable")
    label = np.empty(len(ids), np.int64)
    label[order] = np.arange(len(ids))
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = np.minimum(label, label[order[label]])
        if np.array_equal(label, before):
            return ids[order[label]]


def embedding_groups(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    least: float = 0.93,
) -> DataFrame:
    """(id, n_links, component_id, kept) per row: links between vectors of one label with a cosine of ``least`` or more.

    Cosines are taken in double precision. Vectors that are null, empty, zero or hold null or non-finite components, rows with
    a null label and rows with a null id link with nothing; of vectors with different lengths only equal lengths are
    compared. Every row counts as a vector, so repeated rows link with each other. ``component_id`` is the smallest
    id reachable by links, null for a null id. Further columns are ignored, whatever their names.
    """
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("_row_id"),
        F.col(label_column).cast("string").alias("label"),
        F.col(vector_column).cast("array<double>").alias("vector"),
    )
    run, kind = _units()
    usable = kept(rows.filter("_row_id is not null and label is not null and vector is not null").mapInArrow(run, kind), "units")
    # Equal unit vectors are one; their rows are linked with each other.
    same = kept(
        usable.groupBy("label", "unit").agg(F.min("_row_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors"
    )
    members = usable.join(same, ["label", "unit"]).select("_row_id", "rep", "copies")
    members = kept(members, "vector-members")
    # An id that several rows carry joins their vectors; other rows of equal vectors follow their representative.
    twice = members.groupBy("_row_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).filter("a > b")
    links = members.join(twice.select("_row_id", "b"), "_row_id").select(F.col("rep").alias("a"), "b")
    found = kept(_compared(same, least), "products")
    links = links.union(found.filter("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    groups = components(links)
    totals = members.join(found.groupBy("rep").agg(F.sum("links").alias("far")), "rep", "left")
    totals = totals.join(groups.withColumnRenamed("id", "rep"), "rep", "left").groupBy("_row_id").agg(
        F.max(F.coalesce("far", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"),
        F.min(F.coalesce("component", "rep")).alias("component"),
    )
    return (
        rows.select("_row_id")
        .join(totals, "_row_id", "left")
        .select(
            F.col("_row_id").alias(id_column),
            F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
            F.coalesce("component", "_row_id").alias("component_id"),
            F.coalesce(F.coalesce("component", "_row_id") == F.col("_row_id"), F.lit(True)).alias("kept"),
        )
    )


def _fitted(same: DataFrame) -> dict[int, np.ndarray]:
    """Centroids of the vector lengths that fill more than one cell, fitted on at most SAMPLE_ROWS vectors on the driver."""
    many = {r["w"]: r["n"] for r in same.groupBy(F.size("unit").alias("w")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2 * CELL_ROWS).collect()}
    total = sum(many.values())
    if not total:
        return {}
    share = min(1.0, 1.2 * SAMPLE_ROWS / total)
    picked = same.filter(F.size("unit").isin(*many)).filter(F.abs(F.hash("rep")) % 1_000_000 < F.lit(int(share * 1_000_000) + 1))
    sample: dict[int, list] = {}
    for row in picked.select("unit").limit(SAMPLE_ROWS).collect():
        sample.setdefault(len(row[0]), []).append(row[0])
    return {
        width: spherical_k_means(np.array(units, np.float64), min(MOST_CELLS, many[width] // CELL_ROWS, len(units)))
        for width, units in sample.items()
    }


def _compared(same: DataFrame, least: float) -> DataFrame:
    """(rep, other, links): numbers of links of each vector per task, and a vector it is connected with."""
    run, kind = _homes(_fitted(same), least)
    placed = kept(same.select("rep", "label", "copies", "unit").mapInArrow(run, kind), "cells")
    cell = ["label", "width", "cell"]
    sizes = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("guest")).alias("own"))
    large = kept(sizes.filter(F.col("own") > SPLIT_ROWS), "large-cells")
    whole = placed.join(large.select(*cell), cell, "left_anti").select(
        *[n for n, _ in PLACED], F.lit(0).alias("part"), (~F.col("guest")).alias("settled"), "guest", "unit"
    )
    if large.limit(1).count():
        # Vectors of a large cell are dealt out by hash, so no task fits or places more than a bounded number of them.
        inside = placed.join(large, cell)
        share = F.abs(F.hash("rep", F.lit(1))) % 1_000_000 < F.lit(1_000_000) * PART_SAMPLE / F.col("own")
        sample = inside.filter(~F.col("guest") & share).select(*cell, "rep", "unit", F.col("rows"))
        fitted = kept(sample.groupBy(*cell).applyInArrow(_fit_parts, "label string, width int, cell int, centroids array<double>"), "part-centroids")
        chunks = F.ceil(F.col("rows") / CHUNK).cast("bigint")
        dealt = inside.withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks)).select(*[n for n, _ in PLACED], "guest", "unit", "chunk")
        wanted = large.select(*cell, F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("chunk")).join(fitted, cell)
        run, kind = _parts(least)
        key = [*cell, "chunk"]
        whole = whole.unionByName(dealt.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInArrow(run, kind))
        whole = kept(whole, "parts")
    return _block_products(whole, [*cell, "part"], least)


def _block_products(placed: DataFrame, cell: list[str], least: float) -> DataFrame:
    sizes = placed.groupBy(*cell).agg(
        F.ceil(F.sum(F.col("settled").cast("int")) / BLOCK).cast("int").alias("homes"),
        F.ceil(F.sum((~F.col("settled")).cast("int")) / BLOCK).cast("int").alias("visitors"),
    )
    spread = F.pmod(F.xxhash64("rep"), F.when(F.col("settled"), F.col("homes")).otherwise(F.col("visitors")).cast("bigint"))
    blocked = placed.join(sizes, cell).filter("homes > 0").withColumn("block", spread.cast("int"))
    # Home blocks meet each other once (first <= second); visitors' blocks follow them in the numbering.
    home_tasks = F.transform(
        F.sequence(F.lit(0), F.col("homes") + F.col("visitors") - 1),
        lambda k: F.struct(
            F.least(k, F.col("block")).alias("p"),
            F.greatest(k, F.col("block")).alias("q"),
            F.when(k < F.col("block"), 1).otherwise(0).alias("side"),
        ),
    )
    visitor_tasks = F.transform(
        F.sequence(F.lit(0), F.col("homes") - 1),
        lambda k: F.struct(k.alias("p"), (F.col("homes") + F.col("block")).alias("q"), F.lit(1).alias("side")),
    )
    tasks = blocked.withColumn("task", F.explode(F.when(F.col("settled"), home_tasks).otherwise(visitor_tasks))).select(
        *cell, "task.p", "task.q", "task.side", "rep", "copies", "guest", "unit"
    )
    run, kind = _products(least)
    return tasks.groupBy(*cell, "p", "q").applyInArrow(run, kind)
