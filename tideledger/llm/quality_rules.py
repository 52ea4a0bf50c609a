"""Quality rules: counted rules and a calibrated logistic regression on hashed n-grams.

The regression learns from labelled rows (at most ``PER_CLASS`` of each class),
three quarters of them for the weights; on the rest its scores are calibrated
to probabilities at the classes' true shares. All texts are then scored in
Arrow batches and kept at a probability of at least ``KEEP_AT``.

Cases: null counts as a text without words, which fails the base rules; labels
other than 0 and 1 and labels of unknown documents don't count; with fewer than
two classes of labelled documents nothing is learned and the base rules decide
alone; rows that repeat give results that repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashed_features import fixed, logistic_line, raw_scores, sampled, vectors
from .shared import in_batches, kept
from .textbatch import BLANK_WORD, LEAD, byte_table, chunks, gram_hashes, mix, per_text, span_hashes, spans, text_of, utf8

PER_CLASS = 1500
KEEP_AT = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOLS = byte_table(*((ord(c), ord(c)) for c in "#*$%&|<>"))
_NOT_NEWLINE = ~byte_table((0x0A, 0x0A))


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray | None
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, data: np.ndarray, byte_off: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(byte_off) - 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * raw_scores(data, byte_off, self.weights) + self.offset, -500, 500)))


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    rows, totals = sampled(docs, labels, per_class)
    data = kept(vectors(rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(4))), "quality", "fold", "doc_id"))
    fit = data.where("fold > 0")
    if len(totals) < 2 or fit.select("quality").distinct().count() < 2:
        return QualityModel(None)
    model = LogisticRegression(labelCol="quality", regParam=0.003, maxIter=60).fit(fit)
    weights = fixed(model.coefficients.toArray())
    held = data.where("fold = 0")
    if held.select("quality").distinct().count() < 2:
        held = data
    seen = held.select("quality", "features").toPandas()
    exact = weights / float(1 << 24)
    x = np.array([float(v.values @ exact[v.indices]) for v in seen["features"]])
    y = seen["quality"].to_numpy()
    share = np.array([totals[0], totals[1]], float) / sum(totals.values())
    weight = (share / np.bincount(y, minlength=2) * len(y))[y]
    slope, offset = logistic_line(x, y, weight)
    return QualityModel(weights, slope, offset)


def base_counts(data: np.ndarray, byte_off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    starts, ends, offsets = spans(data, byte_off, BLANK_WORD)
    n_words = np.diff(offsets)
    words = span_hashes(data, starts, ends)
    texts = text_of(offsets)

    # lines with a word that equal an earlier line of their text
    l_starts, l_ends, l_off = spans(data, byte_off, _NOT_NEWLINE)
    has_word = np.searchsorted(starts, l_ends) > np.searchsorted(starts, l_starts)
    line_text = text_of(l_off)[has_word]
    lines = mix(span_hashes(data, l_starts[has_word], l_ends[has_word]) + line_text.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    _, first = np.unique(lines, return_index=True)
    again = np.ones(len(lines), dtype=bool)
    again[first] = False
    n_dup_lines = np.bincount(line_text[again], minlength=len(n_words))

    # words in a run of three that stands twice or more in the text
    runs = gram_hashes(words, 3)
    at = np.flatnonzero(np.arange(len(runs)) + 3 <= offsets[1:][texts[: len(runs)]])
    own = mix(runs[at] + texts[at].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    _, back, n = np.unique(own, return_inverse=True, return_counts=True)
    twice = at[n[back] > 1]
    covered = np.zeros(len(words), dtype=bool)
    for j in range(3):
        covered[twice + j] = True
    letter = LEAD[data] & BLANK_WORD[data]
    return {
        "n_words": n_words,
        "word_chars": per_text(letter, byte_off),
        "n_symbols": per_text(_SYMBOLS[data], byte_off),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": per_text(covered, offsets),
    }


def quality_rules(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, probability and kept of every document, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, byte_off = utf8(batch.column("text"))
            counts = base_counts(data, byte_off)
            failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
            p = shared.value.probability(data, byte_off)
            columns = [batch.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in counts.values()), pa.array(failed), pa.array(p), pa.array(~failed & (p >= KEEP_AT))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *counts, "base_failed", "probability", "kept"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return in_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), score, schema)


def passing(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The documents that are kept, with their columns as they were; decided where a row stands, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, byte_off = utf8(batch.column("text"))
            counts = base_counts(data, byte_off)
            good = (counts["n_words"] >= MIN_WORDS) & (100 * counts["n_repeat_words"] <= MAX_REPEAT_PERCENT * counts["n_words"])
            yield batch.filter(pa.array(good & (shared.value.probability(data, byte_off) >= KEEP_AT)))

    return in_batches(docs, choose, docs.schema)
