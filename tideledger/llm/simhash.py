"""SimHash near-duplicates by pigeonhole blocks.

The 64 bits of a fingerprint are cut into six blocks. Two fingerprints that
differ in at most three bits differ in at most three blocks, so at least three
blocks are the same: each fingerprint is put under the 20 choices of three
blocks (about 32 bits each), equal keys meet, and the Hamming distance is
verified there.

Only distinct fingerprints take part, so copies cost nothing. Fingerprints
under one key are linked within a task to the least of their local component,
never to each other in pairs; a key with more than ``CELL`` fingerprints is
dealt out by pairs of slices, which still compare every two. The links' connected
components come from alternating large-star and small-star rounds.

Cases: null and blank texts have no words and fingerprint zero, which is
linked like any other; a component's id is the least id in it that isn't null
(null if there is none); rows that repeat give results that repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import fresh, matched, row_key, without_rows
from .shared import in_batches, kept
from .textbatch import chunks

SEED = 42
MAX_BITS = 3
#: Widths of the blocks, from the lowest bit up.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of one key that a task compares at once (twice as many for two slices).
CELL = 2048


def _masks() -> list[int]:
    edges = np.concatenate([[0], np.cumsum(BLOCKS)])
    blocks = [((1 << int(w)) - 1) << int(at) for w, at in zip(BLOCKS, edges, strict=False)]
    return [sum(blocks[i] for i in chosen) for chosen in combinations(range(len(BLOCKS)), len(BLOCKS) - MAX_BITS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(text: str) -> int:
    """Fingerprint of a text as an unsigned number."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < 3:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-3] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[2:].tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = np.ascontiguousarray(h[at : at + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The (long) columns ``keep`` and fp (as a signed long) of every document."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            fps = np.array([simhash(t) if t else 0 for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    columns = [F.col(c).cast("long").alias(c) for c in keep]
    return in_batches(docs.select(*columns, F.col(text).alias("text")), prints, ", ".join(f"{c} long" for c in (*keep, "fp")))


def local_links(fps: np.ndarray, slices: np.ndarray, across: bool) -> Iterator[tuple[int, int]]:
    """(fingerprint, least of its local component) for fingerprints within MAX_BITS of each other, by breadth-first search."""
    order = np.argsort(fps, kind="stable")
    signed, bits, side = fps[order], fps[order].view(np.uint64), slices[order]
    open_ = np.arange(len(bits))
    while len(open_):
        root, front, open_ = open_[0], open_[:1], open_[1:]
        while len(front) and len(open_):
            near = np.zeros(len(open_), dtype=bool)
            for at in range(0, len(front), 64):
                some = front[at : at + 64]
                close = np.bitwise_count(bits[some][:, None] ^ bits[open_][None, :]) <= MAX_BITS
                if across:
                    close &= side[some][:, None] != side[open_][None, :]
                near |= close.any(axis=0)
            front, open_ = open_[near], open_[~near]
            for x in front:
                yield int(signed[x]), int(signed[root])


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every run of rows with the same (c, v, i, j); the rows come sorted by these."""
    held: list[np.ndarray] = []
    a, b = [], []

    def close(rows: np.ndarray) -> None:
        if len(rows) > 1:
            for x, y in local_links(np.ascontiguousarray(rows[:, 5]), rows[:, 4], bool(rows[0, 2] != rows[0, 3])):
                a.append(x)
                b.append(y)

    def drained() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a.clear()
        b.clear()
        return out

    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = np.stack([np.asarray(batch.column(n).to_numpy(zero_copy_only=False), np.int64) for n in ("c", "v", "i", "j", "slice", "fp")], axis=1)
        if held:
            rows = np.concatenate([*held, rows])
        cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
        parts = np.split(rows, cut)
        for part in parts[:-1]:
            close(part)
        held = [parts[-1]]
        if len(a) > 100_000:
            yield drained()
    if held:
        close(held[0])
    yield drained()


def links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all pairs within MAX_BITS."""
    keyed = F.array(*(F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for c, m in enumerate(_masks())))
    keys = fps.select("fp", F.explode(keyed).alias("k")).select("k.c", "k.v", "fp")
    groups = keys.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1")
    members = keys.join(groups, ["c", "v"]).withColumn("slices", F.ceil(F.col("n") / cell).cast("int"))
    members = members.withColumn("slice", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
    # a slice meets each of the slices, itself included: the cells (i, j) with i <= j
    cells = members.select("c", "v", "fp", "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    cells = cells.select("c", "v", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "slice", "fp")
    dealt = cells.repartition("c", "v", "i", "j").sortWithinPartitions("c", "v", "i", "j")
    return in_batches(dealt, _cell_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component of the links (a, b); nodes without a link are left out."""
    edges = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(root.select("u", F.col("m").alias("v")))
        edges = kept(small.distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every document."""
    prints = kept(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = kept(components(links(distinct.select("fp"))))
    # the least id of each component, then of each fingerprint
    linked = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    roots = linked.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("component_id"))
    labels = linked.select("fp", F.coalesce("root", "fp").alias("root")).join(roots, "root").select("fp", "component_id")
    return prints.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def fingerprint_hex() -> F.Column:
    return F.lower(F.lpad(F.hex("fp"), 16, "0"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the least id (then the least hash) of each component, with its columns as they were.

    Rows that repeat id and text are one document; of these one row stays.
    """
    prints = kept(fingerprints(docs.select(row_key().alias("row_key"), "doc_id", "text"), keep=("row_key", "doc_id")))
    least = kept(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"))).alias("least")))
    found = components(links(least.select("fp")))
    rooted = least.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    best = kept(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row_key").alias("k"), F.col("least.doc_id").alias("i")))
    is_best = (F.col("row_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("i"))
    dropped = kept(prints.join(best, is_best, "left_anti").select("row_key", "doc_id").distinct())
    rest = without_rows(docs, dropped)
    repeated = kept(prints.join(best, is_best, "left_semi").groupBy("row_key", "doc_id").count().where("count > 1").drop("count"))
    if repeated.isEmpty():
        return rest
    name = fresh("_row", docs)
    once = matched(rest, repeated, "left_semi").withColumn(name, row_key()).dropDuplicates([name, "doc_id"]).drop(name)
    return without_rows(rest, repeated).unionByName(once)
