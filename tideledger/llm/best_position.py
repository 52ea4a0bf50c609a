"""Ranked lexical search by the Best Position Algorithm.

Documents are dealt in shards. In a shard each term of the items has an impact
list: its documents by falling share of the score. An item's lists are read from
the top in step; each document met is looked up in all of the item's lists
(direct access), which also marks the places it has there as seen. A list's best
position is the last of the unbroken run of seen places from its top; no unseen
document has more than the sum of the impacts there. Reading stops once that sum
is strictly below the tenth score found so far, so that documents of equal score
are never missed; a task carries its best ten of an item from shard to shard.

Counts over all documents (how many hold a term, how many there are, how many
words) come from a pass of their own. The items go to the tasks in blocks of
bounded size, each block against all documents; what the tasks found is ranked
in two levels.

Cases: null and wordless documents and items have no terms and no rows; each row
of documents is a document and each row of items an item, so repeated rows rank
beside each other; equal scores come by ascending doc_id, null last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_batches
from .textbatch import ALNUM_WORD, LOWER, chunks, spans, text_of, utf8

TOP = 10
#: Bytes of items' texts that go to the tasks at once.
BLOCK_BYTES = 8 << 20
#: Documents of a shard, places of its lists, and cells of an item's direct-access table.
SHARD_DOCS, SHARD_PLACES, TABLE_CELLS = 8192, 2_000_000, 1 << 24
#: Places read of each list at first; twice as many in each further step.
FIRST_READ = 8


def terms_of(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All terms of the texts end to end, and the offsets of each text's."""
    data, offsets = utf8(texts)
    data = LOWER[data]
    starts, ends, of_text = spans(data, offsets, ALNUM_WORD)
    lengths = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    inside = data[ALNUM_WORD[data]]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.tobytes()), pa.py_buffer(inside.tobytes())), of_text


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_factors(lengths: np.ndarray, documents: int, words: int) -> np.ndarray:
    """m of each document."""
    if len(lengths) and 90 * int(lengths.max()) * documents >= 2**63:
        lengths = lengths.astype(object)
    return (10 + 90 * lengths * documents // words).astype(np.int64)


class Block:
    """Items (number, id, places of their terms in ``terms``) that go to the tasks together."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"], r["text"] or ""))
        words, offsets = terms_of(pa.array([r["text"] for r in rows], pa.string()))
        self.terms = words.unique()
        number = pc.index_in(words, value_set=self.terms).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids = [r["item_id"] for r in rows]
        self.lists = [np.unique(number[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.longest = max(map(len, self.lists), default=0)


def counted(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text in number, then for each text and block's term in it: text, term, occurrences."""
    words, offsets = terms_of(batch.column("text"))
    found = pc.index_in(words, value_set=terms)
    known = np.asarray(found.is_valid().to_numpy(zero_copy_only=False), bool)
    term = np.asarray(found.drop_null(), np.int64)
    pairs, times = np.unique(text_of(offsets)[known] * len(terms) + term, return_counts=True)
    return np.diff(offsets), pairs // max(len(terms), 1), pairs % max(len(terms), 1), times


def statistics(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each of the block's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(block.terms)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        holding, documents, words = np.zeros(len(terms), np.int64), 0, 0
        for batch in chunks(batches):
            lengths, _, term, _ = counted(batch, terms)
            holding += np.bincount(term, minlength=len(terms))
            documents, words = documents + int((lengths > 0).sum()), words + int(lengths.sum())
        at = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()]), pa.array([documents, words, *holding[at].tolist()])], names=["term", "n"])

    rows = in_batches(docs.select("text"), task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(block.terms) + 2, np.int64)
    out[rows.column("term").to_numpy() + 2] = rows.column("n").to_numpy()
    return int(out[0]), int(out[1]), out[2:]


class Shard:
    """Impact lists of some documents: places by term, falling impact and document."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int) -> None:
        order = np.lexsort((doc, -impact, term))
        self.ids, self.nulls = ids, nulls
        self.doc, self.impact = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(terms + 1))
        self.seen = np.zeros(len(order), dtype=bool)
        self.met = np.zeros(len(ids), dtype=bool)

    def search(self, terms: np.ndarray, best: Best) -> int:
        """Puts the item's best documents of this shard into ``best``; the number of documents looked up."""
        since, until = self.starts[terms], self.starts[terms + 1]
        some = until > since
        since, until = since[some], until[some]
        if not len(since):
            return 0
        lengths = until - since
        # place of each document in each list, one more than its number; 0 where it isn't
        access = np.zeros((len(since), len(self.ids)), np.int32)
        for t, (a, b) in enumerate(zip(since, until, strict=True)):
            access[t, self.doc[a:b]] = np.arange(1, b - a + 1)
        position = np.zeros(len(since), np.int64)
        read, step, looked, marks, docs = 0, FIRST_READ, 0, [], []
        while True:
            ends = np.minimum(read + step, lengths)
            places = np.concatenate([np.arange(a + read, a + e) for a, e in zip(since, ends, strict=True) if e > read])
            new = np.unique(self.doc[places])
            new = new[~self.met[new]]
            self.met[new] = True
            docs.append(new)
            held = access[:, new]
            lists, column = np.nonzero(held)
            at = since[lists] + held[lists, column] - 1
            self.seen[at] = True
            marks.append(at)
            looked += len(new)
            gained = np.zeros(held.shape, np.int64)
            gained[lists, column] = self.impact[at]
            score = gained.sum(axis=0)
            best.add(score, self.ids[new], self.nulls[new])
            read, step = read + step, step * 2
            position = np.maximum(position, ends)
            for t in range(len(since)):
                run = self.seen[since[t] + position[t] : until[t]]
                position[t] += len(run) if run.all() else int(run.argmin())
            open_ = position < lengths
            if not open_.any() or best.last > int(self.impact[since + np.maximum(position, 1) - 1][open_].sum()):
                break
        self.seen[np.concatenate(marks)] = False
        self.met[np.concatenate(docs)] = False
        return looked


class Best:
    """The ``TOP`` best documents of an item so far: falling score, then rising id, null ids last."""

    def __init__(self, top: int) -> None:
        self.top, self.last = top, 0
        self.score, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        use = (score > 0) & (score >= self.last)
        if not use.any():
            return
        score, ids, nulls = np.concatenate([self.score, score[use]]), np.concatenate([self.ids, ids[use]]), np.concatenate([self.nulls, nulls[use]])
        order = np.lexsort((ids, nulls, -score))[: self.top]
        self.score, self.ids, self.nulls = score[order], ids[order], nulls[order]
        self.last = int(self.score[-1]) if len(self.score) == self.top else 0


def _found(docs: DataFrame, block: Block, top: int) -> DataFrame:
    """item (its number), doc_id, score: the best of each task."""
    documents, words, holding = statistics(docs, block)
    weights = np.array([weight(documents, int(n)) for n in holding], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((block, weights))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = shared.value
        most = max(1, min(SHARD_DOCS, TABLE_CELLS // max(block.longest, 1)))
        best = [Best(top) for _ in block.lists]
        held: list[tuple[np.ndarray, ...]] = []
        count = places = 0

        def search() -> None:
            nonlocal held, count, places
            if held:
                shard = Shard(*(np.concatenate(x) for x in zip(*held, strict=True)), len(block.terms))
                for terms, own in zip(block.lists, best, strict=True):
                    shard.search(terms, own)
            held, count, places = [], 0, 0

        for batch in chunks(batches):
            lengths, text, term, times = counted(batch, block.terms)
            m = length_factors(lengths, documents, max(words, 1))
            impact = weights[term] * (1_000_000_000 * times // (1000 * times + 8 * m[text]))
            nulls = np.asarray(batch.column("doc_id").is_null())
            ids = np.asarray(batch.column("doc_id").fill_null(0))
            holds, number = np.unique(text, return_inverse=True)
            for lo in range(0, len(holds), most):
                here = (number >= lo) & (number < lo + most)
                if count + len(holds[lo : lo + most]) > most:
                    search()
                held.append((ids[holds[lo : lo + most]], nulls[holds[lo : lo + most]], number[here] - lo + count, term[here], impact[here]))
                count, places = count + len(holds[lo : lo + most]), places + int(here.sum())
                if places >= SHARD_PLACES:
                    search()
        search()
        item = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        if len(item):
            ids, nulls = np.concatenate([b.ids for b in best]), np.concatenate([b.nulls for b in best])
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=nulls), pa.array(np.concatenate([b.score for b in best]))], names=["item", "doc_id", "score"])

    return in_batches(docs.select("doc_id", "text"), task, "item long, doc_id long, score long")


def _ranked(found: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` highest-scoring documents of each item with a score above 0."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    parts = []
    for number in range(blocks):
        block = Block(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect())
        if not len(block.terms):
            continue
        # bounded by the block: a row an item
        names = F.broadcast(spark.createDataFrame(list(enumerate(block.ids)), "item long, item_id long"))
        found = _found(docs, block, top).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
        best = _ranked(_ranked(found, ["item", "part"], top), ["item"], top)
        parts.append(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
