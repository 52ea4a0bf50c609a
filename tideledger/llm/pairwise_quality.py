"""Quality classifier by Bradley-Terry pairwise ranking.

From all labelled rows preference pairs are made: each good row is preferred to
``PAIRS`` bad ones, or to so many that every bad row stands in a pair. Weights
minimise the logistic loss on the difference of features of each pair, so a
document's score is its strength in the Bradley-Terry sense. The threshold is a
quantile of the scores of the labelled rows: the share of bad rows among all
labels. Scores go to 0..1 by a logistic curve whose value at the threshold is
``ACCEPT_AT``.

Rows of a class are numbered by the hash of their ids, and a good row meets the
bad ones from its own place in their order on. So a stretch of ``BLOCK_PAIRS``
pairs needs a stretch of good and one of bad rows: each is dealt to a block with
the rows it needs, as compressed counts of slots (a fraction of the texts). A
step of the fit is a pass over blocks that adds up the loss and its gradient;
no pair's features are ever written, and only sums of fixed size reach the driver.
The threshold is found by repeated histograms of the scores, the curve's slope
by sums over them.

Cases: null counts as an empty text and has a score like any other; labels
other than 0 and 1 don't count; with fewer than two classes of labelled
documents nothing is learned and every score is the share of good labels
(0.5 without any); rows that repeat give results that repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashed_features import GROUPS, SIZE, SLOTS, count_rows, fixed, group_shares, line_fit, line_sums, packed_counts, raw_scores, sampled, unpacked_counts
from .shared import in_batches, kept, shuffles_freed
from .textbatch import chunks, utf8

#: Labelled rows of each class that are learnt from; None: all.
PER_CLASS = None
PAIRS = 3
PENALTY = 0.003
STEPS = 60
#: Pairs of a block, which holds at most as many bad rows and as many good ones.
BLOCK_PAIRS = 1536
#: Blocks that a task of a pass takes, once there are more than the cluster has cores.
TASK_BLOCKS = 32
#: Bins of a histogram of scores.
BINS = 1024
ACCEPT_AT = 0.7


@dataclass(frozen=True)
class RankModel:
    weights: np.ndarray | None
    threshold: float = 0.0
    slope: float = 1.0
    constant: float = 0.5

    def scores(self, data: np.ndarray, byte_off: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(byte_off) - 1, self.constant)
        lift = np.log(ACCEPT_AT / (1 - ACCEPT_AT))
        z = self.slope * (raw_scores(data, byte_off, self.weights) - self.threshold) + lift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@F.udf(VectorUDT())
def _difference(a: SparseVector, b: SparseVector, sign: int) -> SparseVector:
    slots = np.union1d(a.indices, b.indices)
    values = np.zeros(len(slots))
    values[np.searchsorted(slots, a.indices)] += a.values
    values[np.searchsorted(slots, b.indices)] -= b.values
    return SparseVector(SIZE, slots, values * sign)


def numbered(data: DataFrame) -> DataFrame:
    """``data`` with the number of each row among those of its class, from 0, by the hash of ids; counted within ranges of the hash."""
    rows = data.withColumn("_key", F.xxhash64(F.lit("sample"), "doc_id")).withColumn("_range", F.shiftrightunsigned("_key", 54))
    sizes = rows.groupBy("quality", "_range").count()
    # one row a class and range, 2,048 at most
    before = sizes.select("quality", "_range", (F.sum("count").over(Window.partitionBy("quality").orderBy("_range")) - F.col("count")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("quality", "_range").orderBy("_key", "doc_id")) - 1
    placed = rows.withColumn("_inside", inside).join(F.broadcast(before), ["quality", "_range"])
    return placed.withColumn("number", F.col("_before") + F.col("_inside")).drop("_key", "_range", "_inside", "_before")


def _bad_of(pair: np.ndarray, good: np.ndarray, n_good: int, n_bad: int, pairs: int) -> np.ndarray:
    return (good * n_bad // n_good + pair % pairs) % n_bad


def drawn(data: DataFrame, n_good: int, n_bad: int, pairs: int) -> DataFrame:
    """pair, good, bad: the numbers of the rows of each pair; every bad row is met if ``pairs * n_good >= n_bad``."""
    good = F.expr(f"id div {pairs}L")
    bad = F.expr(f"((id div {pairs}L) * {n_bad}L div {n_good}L + id % {pairs}L) % {n_bad}L")
    return data.sparkSession.range(n_good * pairs).select(F.col("id").alias("pair"), good.alias("good"), bad.alias("bad"))


def preference_pairs(data: DataFrame, n_bad: int, pairs: int = PAIRS) -> DataFrame:
    """``pairs`` rows (features, label) for each good row: half as good minus bad with 1, half turned round with 0."""
    rows = kept(numbered(data))
    n_good = rows.where("quality = 1").count()
    good = rows.where("quality = 1").select(F.col("number").alias("good"), F.col("features").alias("good_features"))
    bad = rows.where("quality = 0").select(F.col("number").alias("bad"), F.col("features").alias("bad_features"))
    label = (F.col("pair") % 2).cast("int")
    return drawn(data, n_good, n_bad, pairs).join(good, "good").join(bad, "bad").select(_difference("good_features", "bad_features", 2 * label - 1).alias("features"), label.cast("double").alias("label"))


def _packed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block, of rows that come sorted by block, class and number: the rows' numbers and their counts."""
    at, held = None, []

    def close() -> pa.RecordBatch:
        numbers = [np.array([n for q, n, _ in held if q == c], np.int64).tobytes() for c in (0, 1)]
        counts = packed_counts(np.concatenate([unpacked_counts(c, 1, np.uint32) for *_, c in held]))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *(pa.array([x], pa.binary()) for x in (*numbers, counts))], names=["block", "bad", "good", "counts"])

    for batch in batches:
        for block, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "quality", "number", "counts")), strict=True):
            if held and block != at:
                yield close()
            at = block
            held.append(row)
    if held:
        yield close()


@dataclass(frozen=True)
class Deal:
    """How many rows of each class there are, how many bad ones a good one meets, and the pairs of a block."""

    n_good: int
    n_bad: int
    pairs: int
    block: int = BLOCK_PAIRS

    def opened(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each block: counts (a row a text), what one n-gram counts, and of each pair its number and the rows of its good and bad text."""
        for block, bad, good, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "bad", "good", "counts")), strict=True):
            bads, goods = np.frombuffer(bad, np.int64), np.frombuffer(good, np.int64)
            pair = np.arange(block * self.block, min((block + 1) * self.block, self.n_good * self.pairs))
            of = pair // self.pairs
            x = unpacked_counts(counts, len(bads) + len(goods))
            yield x, group_shares(x), pair, len(bads) + np.searchsorted(goods, of), np.searchsorted(bads, _bad_of(pair, of, self.n_good, self.n_bad, self.pairs))


def _blocks(rows: DataFrame, deal: Deal) -> DataFrame:
    """The rows that each stretch of pairs needs, packed."""
    met = drawn(rows, deal.n_good, deal.n_bad, deal.pairs).withColumn("block", F.expr(f"pair div {deal.block}L"))
    both = F.array(*(F.struct(F.lit(c).alias("quality"), F.col(name).alias("number")) for c, name in enumerate(("bad", "good"))))
    need = met.select("block", F.explode(both).alias("row")).select("block", "row.quality", "row.number").distinct()
    dealt = need.join(rows, ["quality", "number"]).select("block", "quality", "number", "counts")
    return in_batches(dealt.repartition("block").sortWithinPartitions("block", "quality", "number"), _packed_blocks, "block long, bad binary, good binary, counts binary")


def _summed(data: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of what ``part`` gives for each batch (numbers, the same of each), added up in the order of partitions."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = part(batch) + (0.0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return np.sum([np.frombuffer(r["sums"]) for r in in_batches(data, task, "sums binary").collect()], axis=0)


def _spread(blocks: DataFrame, deal: Deal) -> np.ndarray:
    """Standard deviation of each slot over the pairs' differences, every other one turned round."""

    def part(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((2, SIZE))
        for x, share, pair, good, bad in deal.opened(batch):
            x = x * np.repeat(share, SLOTS, axis=1)
            side = 2.0 * (pair % 2) - 1
            for i in range(0, len(pair), 256):
                d = x[good[i : i + 256]] - x[bad[i : i + 256]]
                out += side[i : i + 256] @ d, np.einsum("ij,ij->j", d, d)
        return out.ravel()

    n = deal.n_good * deal.pairs
    first, second = _summed(blocks, part).reshape(2, SIZE)
    return np.sqrt(np.maximum(second - first * first / n, 0) / max(n - 1, 1))


def _loss(blocks: DataFrame, deal: Deal, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean logistic loss of the pairs and its gradient."""

    def part(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(1 + SIZE)
        for x, share, _, good, bad in deal.opened(batch):
            groups = [slice(g * SLOTS, (g + 1) * SLOTS) for g in range(GROUPS)]
            score = sum((x[:, s] @ weights[s]) * share[:, g] for g, s in enumerate(groups))
            lead = score[good] - score[bad]
            pull = -np.exp(-np.logaddexp(0, lead))
            of = np.bincount(good, pull, len(x)) - np.bincount(bad, pull, len(x))
            out[0] += np.logaddexp(0, -lead).sum()
            out[1:] += np.concatenate([(of * share[:, g]) @ x[:, s] for g, s in enumerate(groups)])
        return out

    total = _summed(blocks, part) / (deal.n_good * deal.pairs)
    return float(total[0]), total[1:]


def least(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, steps: int = STEPS, kept_steps: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """Where a smooth convex function is least, from 0 on, by L-BFGS; ends when a step lowers it by less than its ``tolerance``."""
    u = np.zeros(size)
    f, g = loss(u)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, coefficients = -g, []
        for s, y, r in reversed(past):
            coefficients.append(r * (s @ d))
            d = d - coefficients[-1] * y
        if past:
            s, y, r = past[-1]
            d = d / (r * (y @ y))
        for (s, y, r), c in zip(past, reversed(coefficients), strict=True):
            d = d + (c - r * (y @ d)) * s
        slope = float(g @ d)
        if slope >= 0:
            break
        # a step that lowers the function enough (else shorter) and flattens it enough (else longer)
        low, high, step = 0.0, np.inf, 1.0 if past else min(1.0, 1.0 / np.linalg.norm(g))
        for _ in range(30):
            f_new, g_new = loss(u + step * d)
            if f_new > f + 1e-4 * step * slope:
                high = step
            elif g_new @ d < 0.9 * slope:
                low = step
            else:
                break
            step = (low + high) / 2 if np.isfinite(high) else 2 * step
        else:
            break
        s, y = step * d, g_new - g
        if s @ y > 0:
            past = [*past[-kept_steps + 1 :], (s, y, 1.0 / (s @ y))]
        done = f - f_new <= tolerance * max(abs(f), abs(f_new), 1e-12)
        u, f, g = u + s, f_new, g_new
        if done:
            break
    return u


def _fitted(blocks: DataFrame, deal: Deal) -> np.ndarray:
    """Weights of least mean loss with a penalty on weights of slots of spread 1."""
    spread = _spread(blocks, deal)
    scale = np.divide(1.0, spread, out=np.zeros(SIZE), where=spread > 0)

    def loss(u: np.ndarray) -> tuple[float, np.ndarray]:
        value, gradient = _loss(blocks, deal, u * scale)
        return value + PENALTY / 2 * float(u @ u), gradient * scale + PENALTY * u

    return least(loss, SIZE) * scale


def _row_scores(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """quality, x: each labelled row's score, to the last bit what its text has in scoring."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, c in enumerate(batch.column("counts").to_pylist()):
                counts = unpacked_counts(c, 1, np.int64).reshape(GROUPS, SLOTS)
                for total, n in zip((counts * weights.reshape(GROUPS, SLOTS)).sum(axis=1), counts.sum(axis=1), strict=True):
                    out[i] += total / max(n, 1) / float(1 << 24)
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(out)], names=["quality", "x"])

    return in_batches(rows.select("quality", "counts"), task, T.StructType([rows.schema["quality"], T.StructField("x", T.DoubleType())]))


def _threshold(scores: DataFrame, totals: dict[int, int], seen: dict[int, int]) -> float:
    """Midway between the row where the share of bad labels is reached and the next one; rows weigh their class's labels by its rows."""
    worth = (totals[0] * seen[1], totals[1] * seen[0])
    aim, below = totals[0] * seen[0] * seen[1], 0
    sizes = [F.sum((F.col("quality") == c).cast("long")).alias(f"n{c}") for c in (0, 1)]
    lo, hi = scores.agg(F.min("x"), F.max("x")).first()
    while True:
        slot = F.least(F.lit(BINS - 1), F.floor((F.col("x") - lo) / F.lit(max(hi - lo, 5e-324)) * BINS)).alias("bin")
        bins = scores.where(F.col("x").between(lo, hi)).groupBy(slot).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), *sizes).orderBy("lo").collect()
        for r in bins:
            here = r["n0"] * worth[0] + r["n1"] * worth[1]
            if below + here >= aim or r is bins[-1]:
                break
            below += here
        if r["lo"] == r["hi"]:
            break
        lo, hi = r["lo"], r["hi"]
    at, last = r["lo"], worth[1] if r["n1"] else worth[0]
    # of equal scores one more may follow
    after = None if below + here - last >= aim else scores.where(F.col("x") > at).agg(F.min("x")).first()[0]
    return at if after is None else (at + after) / 2


def _slope(scores: DataFrame, totals: dict[int, int], seen: dict[int, int]) -> float:
    """Slope of a logistic curve through the labelled rows, weighted to the classes' shares of labels."""
    n, total = sum(seen.values()), sum(totals.values())
    worth = np.array([totals[c] / total / seen[c] * n for c in (0, 1)])

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column("x").to_numpy(), batch.column("quality").to_numpy()

    mean = float(_summed(scores, lambda b: np.array([columns(b)[0].sum()]))[0]) / n
    scale = float(np.sqrt(_summed(scores, lambda b: np.array([((columns(b)[0] - mean) ** 2).sum()]))[0] / n)) or 1.0

    def sums(a: float, b: float) -> np.ndarray:
        def part(batch: pa.RecordBatch) -> np.ndarray:
            x, y = columns(batch)
            return line_sums(x, y, worth[y], n, scale, a, b)

        return _summed(scores, part)

    return line_fit(sums, scale, worth[1] * seen[1], worth[0] * seen[0])[0]


def trained(docs: DataFrame, labels: DataFrame, per_class: int | None = PER_CLASS) -> RankModel:
    with shuffles_freed(docs.sparkSession):
        return _trained(docs, labels, per_class)


def _trained(docs: DataFrame, labels: DataFrame, per_class: int | None) -> RankModel:
    rows, totals = sampled(docs, labels, per_class)
    schema = T.StructType([rows.schema["doc_id"], rows.schema["quality"], T.StructField("counts", T.BinaryType())])
    rows = kept(in_batches(rows, lambda batches: count_rows(batches, ("doc_id", "quality")), schema))
    seen = {int(r["quality"]): int(r["count"]) for r in rows.groupBy("quality").count().collect()}
    total = sum(totals.values())
    if len(totals) < 2 or len(seen) < 2:
        return RankModel(None, constant=totals.get(1, 0) / total if total else 0.5)
    rows = kept(numbered(rows))
    deal = Deal(seen[1], seen[0], max(PAIRS, -(-seen[0] // seen[1])))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    n_blocks = -(-deal.n_good * deal.pairs // deal.block)
    blocks = kept(_blocks(rows, deal)).coalesce(max(min(n_blocks, cores), n_blocks // TASK_BLOCKS))
    weights = fixed(_fitted(blocks, deal))
    scores = kept(_row_scores(rows, weights)).coalesce(max(cores, sum(seen.values()) >> 18))
    return RankModel(weights, _threshold(scores, totals, seen), max(_slope(scores, totals, seen), 1e-6))


def quality_scores(docs: DataFrame, model: RankModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted of every document, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            s = shared.value.scores(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= ACCEPT_AT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return in_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), score, "doc_id long, score double, predicted int")
