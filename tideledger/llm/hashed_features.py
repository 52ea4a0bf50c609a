"""Hashed word and character n-grams of whole texts, for the trained quality models.

Four groups of features, each the share of a text's n-grams that fall into a
slot: words, pairs of neighbouring words (a word that repeats itself is one
pair, whatever the word), character trigrams, and runs of four character
classes (letters by case, digits, blanks, each kind of mark). A model has a weight for each
slot, so a text's score is a mean of weights over its n-grams in each group.
Weights are fixed-point integers in scoring: sums don't depend on how texts are
dealt to batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import in_batches, kept
from .textbatch import BLANK_WORD, LOWER, chunks, gram_hashes, span_hashes, spans, text_of, utf8

#: Slots of a group: with a few thousand labelled rows few slots learn more (held-out accuracy of the pairwise model 0.995; with 16 bits 0.952).
SLOT_BITS = 9
SLOTS = 1 << SLOT_BITS
GROUPS = 4
SIZE = GROUPS * SLOTS
_SAME_WORD = np.int64(SLOTS + 1)
_FIXED = float(1 << 24)


def _classes() -> np.ndarray:
    """A number below 32 for each byte: letters beyond ASCII count as lower case."""
    table = np.zeros(256, np.uint32)
    for lo, hi, c in ((0x00, 0x1F, 1), (0x30, 0x39, 2), (0x41, 0x5A, 3)):
        table[lo : hi + 1] = c
    table[0x20], table[0x0A] = 4, 5
    for i, mark in enumerate("!#$%&*<>|.,;:?-_/=+@\"'", 6):
        table[ord(mark)] = i
    for b in (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)):
        table[b] = table[b] or 31
    return table


_CLASS = _classes()


def slots_of(data: np.ndarray, byte_off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group the slot of every n-gram, and the n-grams' offsets by text."""
    starts, ends, offsets = spans(data, byte_off, BLANK_WORD)
    lower = LOWER[data]
    words = span_hashes(lower, starts, ends)
    out = [((words >> np.uint64(64 - SLOT_BITS)).astype(np.int64), offsets)]

    pairs = SLOTS + (gram_hashes(words, 2) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    if len(pairs):
        pairs[words[1:] == words[:-1]] = _SAME_WORD
    keep, off = _within(len(pairs), offsets, 2)
    out.append((pairs[keep], off))

    wide = data.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    out.append(_character_slots(code, 2, byte_off, 3))
    kinds = _CLASS[data]
    code = (kinds[:-3] << np.uint32(15)) | (kinds[1:-2] << np.uint32(10)) | (kinds[2:-1] << np.uint32(5)) | kinds[3:]
    out.append(_character_slots(code, 3, byte_off, 4))
    return out


def _character_slots(code: np.ndarray, group: int, byte_off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    keep, off = _within(len(code), byte_off, size)
    slots = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)).astype(np.int64)
    return group * SLOTS + slots[keep], off


def _within(n: int, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` n-grams lie within one text, and their offsets by text."""
    counts = np.maximum(np.diff(offsets) - (size - 1), 0)
    delta = np.zeros(n + 2, np.int64)
    np.add.at(delta, offsets[:-1][counts > 0], 1)
    np.add.at(delta, (offsets[:-1] + counts)[counts > 0], -1)
    inside = np.cumsum(delta)[:n] > 0
    return inside, np.concatenate([[0], np.cumsum(counts)])


def fixed(weights: np.ndarray) -> np.ndarray:
    return np.rint(np.asarray(weights) * _FIXED).astype(np.int64)


def raw_scores(data: np.ndarray, byte_off: np.ndarray, weights: np.ndarray, intercept: float = 0.0) -> np.ndarray:
    """Intercept plus the mean weight of each group, for every text; ``weights`` from ``fixed``."""
    out = np.full(len(byte_off) - 1, intercept)
    for slots, off in slots_of(data, byte_off):
        total = np.zeros(len(slots) + 1, np.int64)
        np.cumsum(weights[slots], out=total[1:])
        n = np.diff(off)
        out += (total[off[1:]] - total[off[:-1]]) / np.maximum(n, 1) / _FIXED
    return out


def sparse_rows(batches: Iterator[pa.RecordBatch], keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Slots and shares of each text as lists, with the columns ``keep``."""
    for batch in chunks(batches, limit=1 << 18):
        data, byte_off = utf8(batch.column("text"))
        keys, shares = [], []
        for slots, off in slots_of(data, byte_off):
            both = text_of(off) * SIZE + slots
            key, n = np.unique(both, return_counts=True)
            keys.append(key)
            shares.append(n / np.diff(off)[key // SIZE])
        key, share = np.concatenate(keys), np.concatenate(shares)
        order = np.argsort(key, kind="stable")
        key, share = key[order], share[order]
        bounds = np.searchsorted(key // SIZE, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in ((key % SIZE).astype(np.int32), share)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *lists], names=[*keep, "slots", "shares"])


@F.udf(VectorUDT())
def as_vector(slots: list[int], shares: list[float]) -> SparseVector:
    return SparseVector(SIZE, slots, shares)


def vectors(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``features`` of the (few) rows a model is trained on."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("shares", T.ArrayType(T.DoubleType()))])
    # kept before the vectors are made: a task then has one Python worker, not one for each of two steps
    rows = kept(in_batches(docs.select(*keep, "text"), lambda batches: sparse_rows(batches, keep), schema))
    return rows.select(*keep, as_vector("slots", "shares").alias("features"))


def sampled(docs: DataFrame, labels: DataFrame, per_class: int | None) -> tuple[DataFrame, dict[int, int]]:
    """Documents with a quality label, at most ``per_class`` of each class by the hash of their ids (None: all), and the size of each class.

    Of labels that repeat for a document the lowest counts; of documents that repeat an id the text of least hash.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    totals = {int(r["quality"]): int(r["count"]) for r in known.groupBy("quality").count().collect()}
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    least = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    if per_class is None:
        return texts.join(known, "doc_id").groupBy("doc_id", "quality").agg(least).select("doc_id", "text", "quality"), totals
    order = (F.xxhash64(F.lit("sample"), "doc_id"), F.col("doc_id"))
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("quality") == c).orderBy(*order).limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.select(F.col("doc_id").alias("_labelled"), "quality")
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled")).drop("_labelled")
    return rows.groupBy("doc_id", "quality").agg(least).select("doc_id", "text", "quality"), totals


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts of slots (a row a text), compressed: a byte each, the few of 255 and more with their places behind."""
    flat = counts.ravel()
    big = np.flatnonzero(flat > 254)
    raw = np.minimum(flat, 255).astype(np.uint8).tobytes() + big.astype(np.uint32).tobytes() + flat[big].astype(np.uint32).tobytes()
    return np.uint32(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked_counts(block: bytes, rows: int, dtype: type = np.float64) -> np.ndarray:
    raw = pa.decompress(memoryview(block)[4:], int(np.frombuffer(block, np.uint32, 1)[0]), codec="zstd", asbytes=True)
    counts = np.frombuffer(raw, np.uint8, rows * SIZE).astype(dtype)
    places, values = np.frombuffer(raw, np.uint32, offset=rows * SIZE).reshape(2, -1)
    counts[places] = values
    return counts.reshape(rows, SIZE)


def group_shares(counts: np.ndarray) -> np.ndarray:
    """What one n-gram of each group counts in a text's shares."""
    return 1.0 / np.maximum(counts.reshape(-1, GROUPS, SLOTS).sum(axis=2), 1)


def count_rows(batches: Iterator[pa.RecordBatch], keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The packed counts of each text's slots, with the columns ``keep``."""
    for chunk in chunks(batches):
        # short texts are many in a chunk
        for at in range(0, chunk.num_rows, 512):
            batch = chunk.slice(at, 512)
            data, byte_off = utf8(batch.column("text"))
            counts = np.zeros(batch.num_rows * SIZE, np.int64)
            for slots, off in slots_of(data, byte_off):
                counts += np.bincount(text_of(off) * SIZE + slots, minlength=len(counts))
            rows = pa.array([packed_counts(c) for c in counts.reshape(-1, SIZE)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), rows], names=[*keep, "counts"])


def line_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int, scale: float, a: float, b: float) -> np.ndarray:
    """What rows add to the gradient and to the second derivatives of the fit of ``line_fit`` over ``n`` rows."""
    z = x / scale
    target = np.where(y == 1, (n - 1.0) / n, 1.0 / n)
    p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
    r, w = weight * (p - target), weight * p * (1 - p) + 1e-9
    return np.array([(r * z).sum(), r.sum(), (w * z * z).sum(), (w * z).sum(), w.sum()])


def line_fit(sums: Callable[[float, float], np.ndarray], scale: float, up: float, down: float) -> tuple[float, float]:
    """Slope and offset of a weighted one-dimensional logistic fit with smoothed targets, by Newton steps over ``line_sums``."""
    a, b = 1.0, float(np.log(max(up, 1e-9) / max(down, 1e-9)))
    for _ in range(60):
        s = sums(a, b)
        g = np.array([s[0] + 1e-3 * a, s[1]])
        h = np.array([[s[2] + 1e-3, s[3]], [s[3], s[4] + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return a / scale, b


def logistic_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """``line_fit`` of rows that are at hand."""
    scale = float(np.std(x)) or 1.0
    return line_fit(lambda a, b: line_sums(x, y, weight, len(y), scale, a, b), scale, weight[y == 1].sum(), weight[y == 0].sum())
