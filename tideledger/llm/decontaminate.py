"""Benchmark decontamination by winnowing.

Words are hashed, every run of ``K`` words is a k-gram, and of each ``SPAN``
consecutive k-grams the one with the least hash (the last of equals) is the
fingerprint. A run of ``K + SPAN - 1`` = ``WINDOW`` words holds one full span
of k-grams, so two texts that share such a run share a fingerprint at the same
place of it. Training and test fingerprints are joined; each hit is extended
to the windows around it, which are compared by a second hash.

An item of fewer than ``WINDOW`` words is one window of its own length; for
each such length that occurs in the benchmark (nine at most) every run of that
many words is a fingerprint (winnowing with a span of one).

Cases: null text has no words; an item without words never occurs; an item
with a null id counts for hit words, not for the list of items; equal item ids
count once; rows that repeat give results that repeat; an empty table on either
side gives zero hits. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import row_key, without_rows
from .shared import in_batches, kept
from .textbatch import ALNUM_WORD, LOWER, chunks, gram_hashes, span_hashes, spans, text_of, utf8

WINDOW = 10
K = 5
SPAN = WINDOW - K + 1
#: Bits of the map of benchmark fingerprints, whatever the benchmark's size: 8 MB.
MAP_BITS = 1 << 26
#: Benchmark fingerprints (about 120 bytes each) up to which the join may broadcast them.
BROADCAST_ROWS = 200_000

_MARKS = "key long, doc_id long, n_words long, fp long, start int, len int, wins array<long>"


def _fingerprints(words: np.ndarray, offsets: np.ndarray, short: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For every length of window: fingerprint, place of its first window, hashes of its windows (0: none)."""
    texts, end_of = text_of(offsets), offsets[1:]
    grams = gram_hashes(words, K)
    at = np.flatnonzero(np.arange(len(words)) + WINDOW <= end_of[texts]) if len(words) else np.zeros(0, np.int64)
    if len(at):
        best, least = at.copy(), grams[at]
        for j in range(1, SPAN):
            here = grams[at + j]
            better = here <= least
            best[better], least[better] = at[better] + j, here[better]
        chosen = np.zeros(len(words), dtype=bool)
        chosen[best] = True
        place = np.flatnonzero(chosen)
        yield grams[place], place - (SPAN - 1), words, WINDOW
    for n in short:
        runs = gram_hashes(words, n, seed=n)
        at = np.flatnonzero(np.arange(len(runs)) + n <= end_of[texts[: len(runs)]])
        if len(at):
            yield runs[at], at, words, n


def _windows(words: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Second hashes of the windows of ``n`` words from ``first`` on, 0 where one leaves its text."""
    out = np.zeros((len(first), SPAN if n == WINDOW else 1), np.uint64)
    if len(words) < n:
        return out.view(np.int64)
    hashes = gram_hashes(words, n, seed=101)
    for j in range(out.shape[1]):
        s = first + j
        ok = (s >= low) & (s + n <= high)
        out[ok, j] = hashes[s[ok]] | np.uint64(2)
    return out.view(np.int64)


def _marked(batches: Iterator[pa.RecordBatch], short: list[int], wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """A row for each fingerprint that may be in the other table, or one row without for a text that has none."""
    for batch in chunks(batches):
        raw, byte_off = utf8(batch.column("text"))
        data = LOWER[raw]
        starts, ends, offsets = spans(data, byte_off, ALNUM_WORD)
        words = span_hashes(data, starts, ends)
        texts = text_of(offsets)
        found: list[tuple[np.ndarray, ...]] = []
        for fp, first, _, n in _fingerprints(words, offsets, short):
            where = first + SPAN - 1 if n == WINDOW else first
            if wanted is not None:
                slot = fp & np.uint64(MAP_BITS - 1)
                ok = (wanted[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                fp, first, where = fp[ok], first[ok], where[ok]
            text = texts[where]
            wins = _windows(words, first, offsets[text], offsets[text + 1], n)
            found.append((text, fp.view(np.int64), (first - offsets[text]).astype(np.int32), np.full(len(fp), n, np.int32), wins))
        hit = np.zeros(batch.num_rows, dtype=bool)
        for x in found:
            hit[x[0]] = True
        bare = np.flatnonzero(~hit)
        key, doc_id, n_words = batch.column("key"), batch.column("doc_id"), pa.array(np.diff(offsets))
        for text, fp, first, n, wins in found:
            if len(text):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * wins.shape[1]), pa.array(wins.ravel()))
                yield pa.RecordBatch.from_arrays([key.take(pa.array(text)), doc_id.take(pa.array(text)), n_words.take(pa.array(text)), pa.array(fp), pa.array(first), pa.array(n), lists], names=["key", "doc_id", "n_words", "fp", "start", "len", "wins"])
        if len(bare):
            no = len(bare)
            yield pa.RecordBatch.from_arrays([key.take(pa.array(bare)), doc_id.take(pa.array(bare)), n_words.take(pa.array(bare)), pa.nulls(no, pa.int64()), pa.nulls(no, pa.int32()), pa.nulls(no, pa.int32()), pa.nulls(no, pa.list_(pa.int64()))], names=["key", "doc_id", "n_words", "fp", "start", "len", "wins"])


def _fingerprint_map(marks: DataFrame) -> np.ndarray:
    """A bit for each slot that a benchmark fingerprint falls into; at most MAP_BITS / 64 rows reach the driver."""
    slot = F.col("fp").bitwiseAND(F.lit(MAP_BITS - 1))
    rows = (
        marks.where("fp is not null")
        .groupBy(F.shiftright(slot, 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(fp & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(MAP_BITS // 64, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def item_marks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of the benchmark: item_id, fp, start, len, wins, and n_words."""
    items = benchmark.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = list(range(1, WINDOW))
    marks = in_batches(items, lambda batches: _marked(batches, every, None), _MARKS)
    # an item's own length decides: long items by winnowing, short ones as one window
    return marks.where((F.col("n_words") >= WINDOW) & (F.col("len") == WINDOW) | (F.col("n_words") < WINDOW) & (F.col("len") == F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", key: Column | None = None) -> DataFrame:
    """One row per document: key, doc_id, n_words, n_hit, items (sorted as strings), spans (of hit windows: start, len).

    ``key`` names a row; rows of one key and id count as one. Without it each row is its own.
    """
    spark = docs.sparkSession
    tests = kept(item_marks(benchmark, item_id, item_text))
    sizes = tests.agg(F.count("fp").alias("n"), F.collect_set(F.when(F.col("len") < WINDOW, F.col("len"))).alias("short")).first()
    short = sorted(sizes["short"])
    wanted = spark.sparkContext.broadcast(_fingerprint_map(tests))

    keyed = docs.select((F.monotonically_increasing_id() if key is None else key).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marks = in_batches(keyed, lambda batches: _marked(batches, short, wanted.value), _MARKS)
    # items that share a passage are one row, whose ids a hit takes along
    side = tests.where("fp is not null").groupBy(F.col("fp").alias("fp_key"), F.col("len").alias("i_len"), F.col("wins").alias("i_wins")).agg(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("i_items"))
    if sizes["n"] <= BROADCAST_ROWS:
        side = F.broadcast(side)
    # a document without fingerprints joins nothing; its own key keeps such rows apart
    joined = marks.withColumn("fp_key", F.coalesce("fp", F.xxhash64("key"))).join(side, "fp_key", "left")
    same = F.filter(
        F.transform(F.sequence(F.lit(0), F.size("wins") - 1), lambda j: F.when((F.get("wins", j) == F.get("i_wins", j)) & (F.get("wins", j) != 0), F.col("start") + j)),
        lambda s: s.isNotNull(),
    )
    hits = joined.withColumn("at", F.when(F.col("fp").isNotNull() & (F.col("len") == F.col("i_len")), same)).withColumn("at", F.when(F.size("at") > 0, F.col("at")))
    rows = hits.select("key", "doc_id", "n_words", F.when(F.col("at").isNotNull(), F.col("i_items")).alias("items"), F.col("len"), F.explode_outer("at").alias("s"))
    per_doc = rows.groupBy("key", "doc_id", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.sort_array(F.collect_set(F.when(F.col("s").isNotNull(), F.struct(F.col("s").alias("start"), F.col("len").alias("len"))))).alias("spans"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("e"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["e"], x["start"] + x["len"]).alias("e"),
            (acc["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(acc["e"], x["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return per_doc.select("key", "doc_id", "n_words", covered.alias("n_hit"), "items", "spans")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; rows and columns are otherwise as they were."""
    found = kept(contamination_keys(docs, benchmark))
    return without_rows(docs, found)


def contamination_keys(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row_key and doc_id of each document that holds a benchmark window."""
    return contamination(docs, benchmark, key=row_key()).where("n_hit > 0").select(F.col("key").alias("row_key"), "doc_id")
