"""Near-duplicate vectors by spherical-cap filters of a structured random product code.

A code's directions are all ways to join one unit vector from each of ``m``
random lists (one list for each block of coordinates, after a random rotation),
so a million directions need some thousand vectors. Each vector is list-decoded
to the directions that exceed its own cap's height, its inner product with its
``12 * m``-th best one: the best sums over blocks only use the best of each
block, so they are found exactly without looking at all directions. Vectors
join on label and direction; vectors that meet are compared in double precision.

The rotation is random and independent of the data, so the chance to miss a
pair depends on its angle alone: at a cosine of 0.98, the least that counts,
it is below one in a thousand (tests measure it), and less for closer pairs.

Copies are one node. A direction's nodes are compared within a task and give
each node's number of links and the least node of its local component, never
pairs; a direction with more than ``CELL`` nodes of a label is dealt out by
pairs of slices, which still compare every two. A pair that meets under many
directions counts under the least of them only.

Cases: null labels, vectors that are null, empty, zero or hold null or
non-finite components, and vectors of other lengths link with nothing; a row
is a vector, so repeated rows and ids link as others do; a component's id is
the least id in it that isn't null (null if there is none), and a null id is
never the kept one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, kept
from .simhash import components

MIN_COSINE = 0.98
SEED = 11
#: Directions that a vector is under, for each block.
PER_BLOCK = 12
#: Vectors of a block's list.
MAX_LIST = 2048
#: Nodes of one label and direction that a task compares at once (twice as many for two slices).
CELL = 1024


def code_shape(n: int) -> tuple[int, int]:
    """Blocks and vectors of a block's list for ``n`` nodes: about a direction for each node and each of its places."""
    for m in (2, 3, 4, 5):
        size = 1 << max(5, int(np.ceil(np.log2(max(n, 1) * PER_BLOCK * m) / m)))
        if size <= MAX_LIST:
            return m, size
    return 5, MAX_LIST


@lru_cache(maxsize=8)
def _code(dim: int, blocks: int, size: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """A rotation, the coordinates of each block, and each block's list of unit vectors."""
    random = np.random.default_rng([SEED, dim, blocks, size])
    rotation, _ = np.linalg.qr(random.standard_normal((dim, dim)))
    parts = np.array_split(np.arange(dim), min(blocks, dim))
    lists = [random.standard_normal((size, len(p))) for p in parts]
    return rotation, parts, [x / np.linalg.norm(x, axis=1, keepdims=True) for x in lists]


def _best(score: np.ndarray, width: int) -> np.ndarray:
    """Places of the ``width`` greatest of each row."""
    return np.argpartition(-score, width - 1, axis=1)[:, :width] if width < score.shape[1] else np.tile(np.arange(score.shape[1]), (len(score), 1))


def decoded(unit: np.ndarray, blocks: int, size: int) -> np.ndarray:
    """Numbers of the directions that exceed each unit vector's cap, one row a vector."""
    rotation, parts, lists = _code(unit.shape[1], blocks, size)
    turned, width = unit @ rotation, PER_BLOCK * blocks
    score, number = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
    for p, vectors in zip(parts, lists, strict=True):
        own = turned[:, p] @ vectors.T
        best = _best(own, width)
        score = (score[:, :, None] + np.take_along_axis(own, best, 1)[:, None, :]).reshape(len(unit), -1)
        number = (number[:, :, None] * size + best[:, None, :]).reshape(len(unit), -1)
        order = _best(score, width)
        score, number = np.take_along_axis(score, order, 1), np.take_along_axis(number, order, 1)
    return number


def unit_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors of each length and these as unit vectors; no entry is null."""
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64)
    lengths = np.diff(offsets)
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        x = values[offsets[at][:, None] + np.arange(dim)[None, :]]
        x /= np.abs(x).max(axis=1, keepdims=True)
        yield at, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(nodes: DataFrame, blocks: int, size: int) -> DataFrame:
    """node, directions of every node."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                ids = np.asarray(part.column("node"))
                for at, unit in unit_vectors(part.column("vector")):
                    found = decoded(unit, blocks, size)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), flat], names=["node", "directions"])

    return in_batches(nodes.select("node", "vector"), lists, "node long, directions array<long>")


def _shared_before(earlier: list[np.ndarray], side: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether two members share a direction before this one, for each of ``side`` and each of ``other``."""
    every = np.concatenate([*earlier, np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(earlier)), [len(x) for x in earlier])
    codes, column, times = np.unique(every, return_inverse=True, return_counts=True)
    often = np.flatnonzero(times > 1)
    out = np.zeros((len(side), len(other)), dtype=bool)
    for lo in range(0, len(often), 1024):
        place = np.full(len(codes), -1)
        place[often[lo : lo + 1024]] = np.arange(len(often[lo : lo + 1024]))
        has = np.zeros((len(earlier), len(often[lo : lo + 1024])), np.float32)
        use = place[column] >= 0
        has[owner[use], place[column][use]] = 1
        out |= has[side] @ has[other].T > 0
    return out


def cell_links(node: np.ndarray, weight: np.ndarray, unit: np.ndarray, earlier: list[np.ndarray], side: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one direction that link, the least node of each one's local component, and the copies each links to under this direction first.

    ``side`` is False or True where two slices meet (pairs across count), None for one slice.
    """
    rows, columns = (np.arange(len(node)),) * 2 if side is None else (np.flatnonzero(~side), np.flatnonzero(side))
    near = unit[rows] @ unit[columns].T >= least
    if side is None:
        np.fill_diagonal(near, False)
    r, c = near.any(axis=1), near.any(axis=0)
    rows, columns, near = rows[r], columns[c], near[r][:, c]
    if not len(rows):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = near & ~_shared_before(earlier, rows, columns)
    count = np.zeros(len(node), np.int64)
    count[rows] = first @ weight[columns]
    if side is not None:
        count[columns] = first.T @ weight[rows]
    root, top = node.copy(), np.iinfo(np.int64).max
    while True:
        before = root.copy()
        root[rows] = np.minimum(root[rows], np.where(near, root[columns][None, :], top).min(axis=1))
        root[columns] = np.minimum(root[columns], np.where(near, root[rows][:, None], top).min(axis=0))
        if (root == before).all():
            break
    met = np.union1d(rows, columns)
    return node[met], root[met], count[met]


def _compared(least: float):
    """A task over rows sorted by cell: what cell_links gives of every cell."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def closed(cell: pa.Table) -> Iterator[pa.RecordBatch]:
            if cell.num_rows < 2:
                return
            cell = cell.combine_chunks()
            (_, unit), *_ = unit_vectors(cell.column("vector").chunk(0))
            one, two = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
            side = np.asarray(cell.column("slice")) == two if one != two else None
            direction = cell.column("direction")[0].as_py()
            earlier = [x[x < direction] for x in (np.asarray(v, np.int64) for v in cell.column("directions").to_pylist())]
            found = cell_links(np.asarray(cell.column("node")), np.asarray(cell.column("weight")), unit, earlier, side, least)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "root", "links"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            here = pa.Table.from_batches([batch])
            rows = here if held is None else pa.concat_tables([held, here])
            key = np.stack([np.asarray(rows.column(k)) for k in ("grp", "direction", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield from closed(rows.slice(a, b - a))
            held = rows.slice(cuts[-1])
        if held is not None:
            yield from closed(held)

    return task


def links(nodes: DataFrame, least: float = MIN_COSINE, cell: int = CELL) -> DataFrame:
    """node, root, links: for each direction under which a node links, a node that it is connected with and the copies that it links to there first.

    ``nodes`` has node, grp (only nodes of one group meet), vector and weight (its number of copies).
    """
    blocks, size = code_shape(nodes.count())
    listed = kept(directions(nodes, blocks, size))
    under = listed.select("node", F.explode("directions").alias("direction")).join(nodes.select("node", "grp"), "node")
    shared = under.groupBy("grp", "direction").agg(F.count("*").alias("n")).where("n > 1").withColumn("slices", F.ceil(F.col("n") / cell).cast("int"))
    met = under.join(shared, ["grp", "direction"]).withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    dealt = met.select("grp", "direction", "node", "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    dealt = dealt.select("grp", "direction", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "slice", "node")
    full = dealt.join(nodes.select("node", "vector", "weight"), "node").join(listed, "node")
    laid = full.repartition("grp", "direction", "i", "j").sortWithinPartitions("grp", "direction", "i", "j", "node")
    return in_batches(laid, _compared(least), "node long, root long, links long")


def near_duplicates(vectors: DataFrame, least: float = MIN_COSINE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    ok = usable(F.col(vector)) & F.col(label).isNotNull()
    key = [F.when(ok, F.xxhash64(F.lit(side), vector)).alias(f"key_{side}") for side in "ab"]
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(ok, F.struct(F.col(label).alias("label"), F.size(vector).alias("dim"))).alias("kind"), *key, F.col(vector).alias("vector"))
    same = ["kind", "key_a", "key_b"]
    nodes = rows.where("kind is not null").groupBy(*same).agg(F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    nodes = kept(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("grp", F.xxhash64("kind")))
    found = kept(links(nodes.select("node", "grp", "vector", "weight"), least))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = kept(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    rooted = nodes.select(*same, "node", "weight", "least").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").join(counts, "node", "left").select(*same, (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.drop("vector").join(named, same, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("kind").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
