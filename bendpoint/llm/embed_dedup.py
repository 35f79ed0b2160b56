"""Embedding near-duplicates: PCA-ordered tiles, compared dimension by dimension until they cannot reach."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, landed, small
from .components import components, least_reached
from .simhash import Forest

TILE_ROWS = 4096
SAMPLE_ROWS = 10_000
STEP = 16
BLOCK = 1024
SLACK = 1e-9  # over the rounding of a product of unit vectors; survivors are computed exactly


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite, and is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotations(vectors: DataFrame, sample_rows: int) -> dict[int, np.ndarray]:
    """For each number of dimensions the principal axes of a sample of unit vectors, by falling variance.

    The sample holds at most about `sample_rows` vectors, drawn by a hash. Axes of another sample would
    be slower, never wrong: rotation changes no cosine.
    """
    n = vectors.count()
    draw = F.pmod(F.xxhash64("embedding", F.lit("axes")), F.lit(1 << 30))
    sample = vectors.filter(draw < F.lit(int((1 << 30) * min(1.0, sample_rows / max(n, 1)))))
    rows = sample.select("embedding").toArrow().column("embedding").to_pylist()
    axes = {}
    for size in {len(r) for r in rows}:
        x = _units(np.array([r for r in rows if len(r) == size], np.float64))
        _, turn = np.linalg.eigh(x.T @ x)
        axes[size] = np.ascontiguousarray(turn[:, ::-1])
    return axes


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of huge or tiny numbers are lost
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


@lru_cache(maxsize=2)
def _loaded(data: bytes) -> dict[int, np.ndarray]:
    return pickle.loads(data)


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _lead(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The coordinate on the first axis, which orders the tiles."""
        axes = _loaded(shared.value)
        for batch in batches:
            vectors = batch.column("vector")
            sizes = np.diff(vectors.offsets.to_numpy())
            lead = np.zeros(batch.num_rows)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                if size in axes:
                    lead[rows] = _units(_matrix(vectors.take(pa.array(rows)))) @ axes[size][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead)], [*batch.schema.names, "lead"])

    return run


def _tile(cuts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile = np.searchsorted(cuts.value, batch.column("lead").to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile)], [*batch.schema.names, "tile"])

    return run


def _reach(ranges: list, threshold: float, tile_rows: int) -> list[tuple[int, int, int, int, int, int]]:
    """(tile, part, parts, k, low, high): parts are numbered k along the axis; low..high are in reach.

    A tile may be larger than asked for, as when a third of all rows have one coordinate: it is dealt
    into parts. Linear in the number of tiles.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6)
    split = [-(-r["n"] // (2 * tile_rows)) for r in ranges]
    first = np.concatenate([[0], np.cumsum(split)]).astype(int)
    lows, highs = np.array([r["low"] for r in ranges]), np.array([r["high"] for r in ranges])
    out = []
    for t, r in enumerate(ranges):
        low = int(first[np.searchsorted(highs, r["low"] - reach)])
        high = int(first[np.searchsorted(lows, r["high"] + reach, "right")]) - 1
        out += [(r["tile"], p, split[t], int(first[t]) + p, low, high) for p in range(split[t])]
    return out


def near_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of unit vectors a, b whose cosine reaches the threshold.

    Leading dimensions are added up first. What the others can add is at most the product of the norms
    of the two remainders; pairs that cannot reach the threshold with it are left, and after the first
    steps only the rest are looked at one by one.
    """
    x, y = (a @ axes, b @ axes) if axes is not None else (a, b)
    dims = x.shape[1]
    cuts = [*range(0, dims, STEP), dims]
    rest = lambda v, cut: np.sqrt(np.maximum(np.einsum("ij,ij->i", v[:, cut:], v[:, cut:]), 0))
    rx, ry = {c: rest(x, c) for c in cuts[1:]}, {c: rest(y, c) for c in cuts[1:]}
    sums = x[:, : cuts[1]] @ y[:, : cuts[1]].T
    i, j = np.nonzero(sums + rx[cuts[1]][:, None] * ry[cuts[1]][None, :] >= threshold - SLACK)
    part = sums[i, j]
    for low, high in zip(cuts[1:-1], cuts[2:], strict=True):
        part = part + np.einsum("ij,ij->i", x[i, low:high], y[j, low:high])
        keep = part + rx[high][i] * ry[high][j] >= threshold - SLACK
        i, j, part = i[keep], j[keep], part[keep]
    exact = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
    return i[exact], j[exact]


def _compare(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit, at most two tiles each; what is held is bounded by that."""
        axes = _loaded(shared.value)
        held: list[pa.RecordBatch] = []

        def result(unit: pa.Table) -> pa.RecordBatch:
            node, copies = unit.column("node").to_numpy(), unit.column("copies").to_numpy()
            tile = unit.column("tile").to_numpy()
            vectors = _units(_matrix(unit.column("vector").combine_chunks()))
            order = np.argsort(tile, kind="stable")
            node, copies, tile, vectors = node[order], copies[order], tile[order], vectors[order]
            cut = int(np.searchsorted(tile, tile[0], "right"))
            own = unit.column("own")[0].as_py()  # else one of the two may have no such vectors
            links, forest = np.zeros(len(node), np.int64), Forest(len(node))
            turn = axes.get(vectors.shape[1])
            first, second = (0, len(node)), ((0, len(node)) if own else (cut, len(node)))
            first = first if own else (0, cut)
            for low in range(*first, BLOCK):
                a = vectors[low : min(low + BLOCK, first[1])]
                for at in range(low if own else second[0], second[1], BLOCK):
                    b = vectors[at : min(at + BLOCK, second[1])]
                    i, j = near_pairs(a, b, turn, threshold)
                    i, j = i + low, j + at
                    if own:
                        i, j = i[i < j], j[i < j]
                    links += np.bincount(i, copies[j], len(node)).astype(np.int64)
                    links += np.bincount(j, copies[i], len(node)).astype(np.int64)
                    if len(i):
                        forest.link(i, j)
            found = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays(
                [pa.array(node[found]), pa.array(links[found]), pa.array(node[forest.root[found]])],
                ["node", "links", "root"],
            )

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, dims = batch.column("unit").to_numpy(), batch.column("dims").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(unit) != 0) | (np.diff(dims) != 0)) + 1).tolist(), len(unit)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if held and (unit[low], dims[low]) != last:
                    yield result(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(low, high - low))
                last = (unit[low], dims[low])
        if held:
            yield result(pa.Table.from_batches(held))

    return run


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.95,
    tile_rows: int = TILE_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding).

    Rows whose cosine in double precision is `threshold` (above 0) or more are linked, whatever their
    labels. n_links counts the other rows linked directly, equal vectors among them; component_id is the
    smallest vec_id reachable, itself included; kept is vec_id = component_id. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, as do vectors of different
    dimensions. Rows that repeat a vec_id are rows of their own with the same component. Null vec_ids
    link, are smallest only if all are null, and are never kept. Extra columns are not carried. A unit of
    work holds two tiles of vectors whatever their number of dimensions, so very wide vectors want a
    smaller `tile_rows`. An empty table gives an empty one.

    Equal vectors are one node with a count. Nodes are dealt into tiles of about `tile_rows` along the
    first principal axis, and only tiles within reach of each other on that axis meet: cosine t means
    a distance of at most sqrt(2 - 2t). A tile pair is a unit of work of bounded size; it returns one row
    a node, not the pairs. The work beyond that pruning is quadratic, as for any exact comparison.
    """
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    valid = valid.withColumn("vector", F.when(usable(F.col("embedding")), F.col("embedding")))
    # -0.0 and 0.0 are one number but would be two keys
    valid = valid.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0).cast("float")))
    groups = valid.filter("vector IS NOT NULL").groupBy("vector").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least")
    )
    nodes = landed(groups.withColumn("node", F.monotonically_increasing_id()))
    spark = vectors.sparkSession
    axes = rotations(nodes.withColumnRenamed("vector", "embedding"), sample_rows)
    shared = spark.sparkContext.broadcast(pickle.dumps(axes))
    kind = dict(nodes.dtypes)["vector"]
    led = landed(
        arrow_map(nodes.select("node", "copies", "vector"), _lead(shared), f"node bigint, copies bigint, vector {kind}, lead double")
    )
    n = led.count()
    tiles = max(1, -(-n // tile_rows))
    bounds = led.approxQuantile("lead", [i / tiles for i in range(1, tiles)], 0.1 / tiles) if tiles > 1 else []
    cuts = spark.sparkContext.broadcast(np.unique(np.array(bounds, np.float64)))
    tiled = arrow_map(led, _tile(cuts), f"node bigint, copies bigint, vector {kind}, lead double, tile int")
    ranges = tiled.groupBy("tile").agg(F.min("lead").alias("low"), F.max("lead").alias("high"), F.count("*").alias("n"))
    parts = _reach(ranges.orderBy("tile").collect(), threshold, tile_rows)
    plan = small(landed(spark.createDataFrame(parts, "tile int, part int, parts int, k bigint, low bigint, high bigint")))
    # A row meets every part of the tiles in reach; the two parts of a unit share its number.
    other = F.explode(F.sequence("low", "high")).alias("other")
    units = (
        tiled.join(small(landed(plan.select("tile", "parts").distinct())), "tile")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .join(plan.drop("parts"), ["tile", "part"])
        .select("node", "copies", "vector", "k", other)
        .withColumn("unit", F.least("k", "other") * F.lit(len(parts)) + F.greatest("k", "other"))
        .withColumn("own", F.col("k") == F.col("other"))
        .select("unit", F.size("vector").alias("dims"), F.col("k").alias("tile"), "own", "node", "copies", "vector")
        .repartition(max(1, min(4 * len(parts), 20_000)), "unit")
        .sortWithinPartitions("unit", "dims")
    )
    found = landed(arrow_map(units, _compare(shared, threshold), "node bigint, links bigint, root bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = least_reached(nodes.select("node", F.col("least").alias("first")).join(roots, "node"), "node", "first")
    classes = (
        nodes.join(links, "node", "left")
        .join(linked.withColumnRenamed("least", "reached"), "node", "left")
        .select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
                F.coalesce("reached", "least").alias("component"))
    )
    joined = valid.join(classes, "vector", "left")
    component = F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
