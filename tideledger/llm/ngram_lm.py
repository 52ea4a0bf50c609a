"""Interpolated modified Kneser-Ney language model of word n-grams.

Counting: words are 48-bit hashes. A first pass counts them; the most frequent
ones have codes of two bytes. Every task then turns its texts into n-grams of
``order`` words, counts the distinct ones of about a million tokens and sends
each shard one packed block. A shard's blocks are merged and written to the
shared folder as sorted arrays of n-gram hashes with their counts; what the
shard has of each shorter gram, as a context and as a continuation, goes on as
packed blocks to the next level's shards, down to single words. Blocks wait in
a table of the shared folder in 2**PART_BITS parts by the first bits of their
shard; a level's parts are shuffled and merged one after the other, and a part's
blocks and shuffle files go before the next part, so that the disk holds the
arrays and one level's blocks. Only the sums and the code table (of fixed size)
reach the driver.

Scoring: workers map the arrays into memory, sort the grams of a batch and look
each shard's share up in order.

    p_m(w | h) = max(c_m(h w) - D_m, 0) / c_m(h) + g_m(h) p_(m-1)(w | h'),  h' = h without its first word
    p_1(w)     = max(c_1(w) - D_1, 0) / C_1 + g_1 / (V + 1)

c_m(h w) is how often the gram stands there at the highest order and the number of
different words before it below; c_m(h) their sum over w; V is the number of
known words. The discounts D (by count 1, 2, 3 and more) come from each level's
counts of counts (Chen and Goodman), and g is what they set free. Every text
is read after order - 1 begin marks, which belong to the context like words.

A gram's shard depends on the last word of its context, so that most of what is
known of a shorter gram meets in one place; of words with more than HOT mean
shards of tokens it depends on the whole gram, which deals them over all shards.
With many shards blocks are dealt in steps of STEP_BITS bits, so that they stay
large and no step has more than 2**STEP_BITS targets.

Cases: null is an empty text, which is the end token alone; an unknown word has
its share of g_1; a context that was never seen leaves the next lower order;
without any training text V = N = 0 and every probability is 1; a null id
counts as held out. Arrays hold 40 bits of a gram's hash beside its shard: in
a shard of a million grams one of a million unknown grams is taken for another.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import delete_folder, in_batches, kept, new_folder, shuffles_freed
from .textbatch import BLANK_WORD, LOWER, chunks, mix, span_hashes, spans, utf8

ORDER = 3
WORD_BITS = 48
_WORD = np.uint64((1 << WORD_BITS) - 1)
#: Hashes of the end token and of what stands before the first word; no word has them but by chance.
END, BEGIN = np.uint64(0x0E0F0E0F0E0F), np.uint64(0x0B0E0B0E0B0E)
TOKENS_A_BLOCK = 1_000_000
#: Rows of unmerged blocks that a merging task holds.
HELD_ROWS = 800_000
#: Words with a code of two bytes.
CODED = (1 << 16) - 1
#: First bits of a word by which its code is looked up.
INDEX_BITS = 20
#: Bytes of text for each shard.
SHARD_BYTES = 4 << 20
STEP_BITS = 12
#: Parts of a level that are merged one after the other, in bits; fewer where there are few shards.
PART_BITS = 2
#: Times a shard's mean of tokens from which on a word's grams are dealt over all shards.
HOT = 2
#: Bytes of text that are scored together: the more, the fewer looks into each shard.
SCORED_BYTES = 2 << 20
#: Bytes of arrays that a worker holds of a store that can't be mapped.
HELD_BYTES = 128 << 20
#: Files that a worker has mapped at a time, well below what a system allows for a process; the one not looked into for longest goes.
MAPS = 8192


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


class SharedArrays:
    """Files of raw arrays in the shared folder: written whole or not at all, mapped into memory for reading."""

    def __init__(self, uri: str):
        self.uri = uri

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri)

    def create(self) -> None:
        files, root = self._open()
        files.create_dir(root, recursive=True)

    def write(self, name: str, *arrays: np.ndarray) -> None:
        """Arrays one after the other; a task that runs twice puts the same file in place twice."""
        files, root = self._open()
        part = f"{root}/.{name}-{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out:
            for a in arrays:
                out.write(np.ascontiguousarray(a).view(np.uint8).data)
        files.move(part, f"{root}/{name}")

    @property
    def mapped(self) -> bool:
        return isinstance(self._open()[0], fs.LocalFileSystem)

    def read(self, name: str) -> np.ndarray:
        """The bytes: mapped, or of a store that can't be mapped in memory."""
        files, root = self._open()
        path = f"{root}/{name}"
        if isinstance(files, fs.LocalFileSystem):
            # a plain array over the map: slices of it cost less
            return np.asarray(np.memmap(path, np.uint8, "r")) if os.path.getsize(path) else np.zeros(0, np.uint8)
        with files.open_input_stream(path) as src:
            return np.frombuffer(src.readall(), np.uint8)

    def names(self) -> frozenset[str]:
        """The files that were written whole."""
        files, root = self._open()
        return frozenset(f.base_name for f in files.get_file_info(fs.FileSelector(root)) if not f.base_name.startswith("."))

    def delete(self) -> None:
        files, root = self._open()
        files.delete_dir(root)


def tokens(data: np.ndarray, byte_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token and the texts' offsets; every text ends with END."""
    lower = LOWER[data]
    starts, ends, off = spans(lower, byte_off, BLANK_WORD)
    words = span_hashes(lower, starts, ends) & _WORD
    texts = len(off) - 1
    out = np.full(len(words) + texts, END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(texts), np.diff(off))] = words
    return out, off + np.arange(texts + 1)


def grams(now: np.ndarray, to: np.ndarray, order: int, begin: np.uint64 = BEGIN) -> list[np.ndarray]:
    """For each token the words (or what stands for them) of its gram, first to last; ``begin`` before a text's first word."""
    place = np.arange(len(now)) - np.repeat(to[:-1], np.diff(to))
    out = []
    for back in range(order - 1, 0, -1):
        before = np.full(len(now), begin, np.uint64)
        inside = place >= back
        before[inside] = now[np.flatnonzero(inside) - back]
        out.append(before)
    return [*out, now]


def gram_hash(words: list[np.ndarray], mixed: bool = False) -> np.ndarray:
    """A hash of each gram; ``mixed``: the words come mixed already."""
    h = np.full(len(words[0]), 0x9E3779B97F4A7C15 + len(words), np.uint64)
    for w in words:
        h = h * np.uint64(0xD1342543DE82EF95) + (w if mixed else mix(w))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass(frozen=True)
class Codes:
    """Numbers for words: the frequent ones' ranks, of the others their hash above these; and which are hot."""

    hashes: np.ndarray
    hot: np.ndarray
    bits: int

    def __post_init__(self) -> None:
        order = np.argsort(self.hashes)
        object.__setattr__(self, "_order", order)
        object.__setattr__(self, "_sorted", self.hashes[order])

    @cached_property
    def _begins(self) -> np.ndarray:
        """Where the words with each first INDEX_BITS bits begin among the sorted ones."""
        return np.searchsorted(self._sorted, np.arange((1 << INDEX_BITS) + 1, dtype=np.uint64) << np.uint64(WORD_BITS - INDEX_BITS)).astype(np.int32)

    def of(self, words: np.ndarray) -> np.ndarray:
        first = words >> np.uint64(WORD_BITS - INDEX_BITS)
        out = words + np.uint64(CODED + 1)
        at, end = self._begins[first], self._begins[first + np.uint64(1)]
        here = np.flatnonzero(at < end)
        at, end = at[here], end[here]
        while len(here):
            hit = self._sorted[at] == words[here]
            out[here[hit]] = self._order[at[hit]]
            more = ~hit & (at + 1 < end)
            here, at, end = here[more], at[more] + 1, end[more]
        return out

    def words(self, codes: np.ndarray) -> np.ndarray:
        known = codes <= CODED
        out = codes - np.uint64(CODED + 1)
        out[known] = self.hashes[codes[known].astype(np.int64)]
        return out

    def shard(self, by: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """By the last word of the context, or of hot ones by the whole gram."""
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, by), len(self.hot) - 1)
            by = np.where(self.hot[at] == by, hashes, by)
        return (mix(by ^ np.uint64(0x5DEECE66D)) >> np.uint64(64 - self.bits)).astype(np.int64)


def _packs(columns: list[np.ndarray], cut: np.ndarray) -> list[bytes]:
    """A block for each stretch of rows that begins at ``cut``: columns of numbers in as many bytes each as most need, the few larger ones apart, compressed."""
    n, laid = len(columns[0]), []
    for c in columns:
        full = max(1, (int(c.max()).bit_length() + 7) // 8 if n else 1)
        need = [np.count_nonzero(c >> np.uint64(8 * w)) for w in range(full)]
        width = min(range(1, full + 1), key=lambda w: w * n + (12 * need[w] if w < full else 0))
        big = np.flatnonzero(c >> np.uint64(8 * width)) if width < full else np.zeros(0, np.int64)
        low = np.ascontiguousarray(c.astype(np.uint64)).view(np.uint8).reshape(-1, 8)
        # byte by byte, which compresses better than number by number
        planes = [np.ascontiguousarray(low[:, b]) for b in range(width)]
        laid.append((width, planes, big, c[big].astype(np.uint64), np.searchsorted(big, [*cut, n]).tolist()))
    out = []
    for i, (a, b) in enumerate(zip(cut.tolist(), [*cut[1:].tolist(), n], strict=True)):
        parts = [np.array([len(columns), b - a], np.uint32)]
        for width, planes, big, values, at in laid:
            lo, hi = at[i], at[i + 1]
            parts.append(np.array([width, hi - lo], np.uint32))
            parts += [p[a:b] for p in planes]
            if hi > lo:
                parts += [(big[lo:hi] - a).astype(np.uint32), values[lo:hi]]
        raw = b"".join(parts)
        out.append(np.uint32(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True))
    return out


def _pack(*columns: np.ndarray) -> bytes:
    return _packs(list(columns), np.zeros(1, np.int64))[0]


def _unpack(block: bytes) -> list[np.ndarray]:
    size = int(np.frombuffer(block, np.uint32, 1)[0])
    raw = pa.decompress(memoryview(block)[4:], size, codec="zstd", asbytes=True)
    columns, rows = np.frombuffer(raw, np.uint32, 2).tolist()
    at, out = 8, []
    for _ in range(columns):
        width, big = np.frombuffer(raw, np.uint32, 2, at).tolist()
        at += 8
        wide = np.zeros((rows, 8), np.uint8)
        for b in range(width):
            wide[:, b] = np.frombuffer(raw, np.uint8, rows, at)
            at += rows
        c = wide.view(np.uint64).ravel()
        where = np.frombuffer(raw, np.uint32, big, at)
        at += 4 * big
        c[where] = np.frombuffer(raw, np.uint64, big, at)
        at += 8 * big
        out.append(c)
    return out


_BLOCK = "shard int, kind int, block binary"
#: What a block holds beside the grams' codes: counts of grams, what is known of them as contexts, words' counts; sums.
_GRAMS, _CONTEXTS, _COUNTS, _SUMS = range(4)
#: Columns of a gram: times (words only), count or different words before, and as a context sum and numbers of words seen after it once, twice, more often.
_FIELDS = ("times", "count", "total", "once", "twice", "more")
_OF_KIND = {_GRAMS: ("count",), _CONTEXTS: _FIELDS[2:], _COUNTS: ("times",)}


def _summed(keys: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct keys, the columns of their first rows and the values' sums."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)) != 0)
    return keys[at], [c[order[at]] for c in columns], [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


def _hashes(coded: list[np.ndarray], codes: Codes) -> np.ndarray:
    return gram_hash([codes.words(c) for c in coded])


def _dealt(kind: int, coded: list[np.ndarray], values: list[np.ndarray], codes: Codes, bits: int, hashes: np.ndarray | None = None) -> tuple[list[int], list[int], list[bytes]]:
    """Packed blocks by the first ``bits`` bits of the shard; within, equal contexts stand together, by their last word (which compresses better)."""
    hashes = _hashes(coded, codes) if hashes is None else hashes
    shard = codes.shard(codes.words(coded[max(len(coded) - 2, 0)]), hashes) >> (codes.bits - bits)
    key, left = shard.astype(np.uint64) << np.uint64(64 - bits), 64 - bits
    for c in reversed(coded[-3:-1]):
        # the first words of longer contexts, and of rare words all but some bits, are left out: the order needn't be exact
        left -= (64 - bits) // 2
        key |= (c & np.uint64((1 << (64 - bits) // 2) - 1)) << np.uint64(left)
    order = np.argsort(key)
    shard, coded, values = shard[order], [c[order] for c in coded], [v[order] for v in values]
    cut = np.flatnonzero(np.diff(shard, prepend=-1))
    ids = shard[cut].tolist()
    return ids, [kind] * len(ids), _packs([*coded, *values], cut)


def _batch(ids: list[int], kinds: list[int], blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blocks, pa.binary())], names=["shard", "kind", "block"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n: how often each word stands in a stretch of texts."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    for batch in chunks(batches):
        held.append(tokens(*utf8(batch.column("text")))[0])
        size += len(held[-1])
        if size >= TOKENS_A_BLOCK:
            yield flush()
            size = 0
    if held:
        yield flush()


def _counted(batches: Iterator[pa.RecordBatch], order: int, codes: Codes, bits: int) -> Iterator[pa.RecordBatch]:
    """Packed blocks of the distinct grams of a stretch of texts."""
    held: list[list[np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        hashes, *coded = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(hashes)
        hashes = hashes[order]
        at = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] ^ np.uint64(1)) != 0)
        n = np.diff(at, append=len(hashes))
        return _batch(*_dealt(_GRAMS, [c[order[at]] for c in coded], [n.astype(np.uint64)], codes, bits, hashes[at]))

    for batch in chunks(batches):
        now, to = tokens(*utf8(batch.column("text")))
        hashes = gram_hash(grams(mix(now), to, order, mix(np.array([BEGIN]))[0]), mixed=True)
        held.append([hashes, *grams(codes.of(now), to, order, np.uint64(0))])
        size += len(now)
        if size >= TOKENS_A_BLOCK:
            yield flush()
            size = 0
    if held:
        yield flush()


def _coded_counts(batches: Iterator[pa.RecordBatch], codes: Codes, bits: int) -> Iterator[pa.RecordBatch]:
    """Packed blocks of words' counts, some HELD_ROWS words dealt together."""
    held: list[list[np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        words, n = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        return _batch(*_dealt(_COUNTS, [codes.of(words)], [n], codes, bits))

    for batch in batches:
        held.append([batch.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("word", "n")])
        size += batch.num_rows
        if size >= HELD_ROWS:
            yield flush()
            size = 0
    if size:
        yield flush()


def _redealt(batches: Iterator[pa.RecordBatch], level: int, codes: Codes, bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks of coarse shards as blocks of finer ones, equal grams summed up."""
    for (_, kind), blocks in _runs(batches):
        if kind == _SUMS:
            for block in blocks:
                yield _batch([0], [kind], [block])
            continue
        for coded, values in _pieces(blocks, level, codes):
            yield _batch(*_dealt(kind, coded, values, codes, bits))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[bytes]]]:
    """((shard, kind), its blocks) for rows that come sorted by these; the blocks are read as they are asked for."""
    rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[:2]

        def same(key: tuple[int, int] = key) -> Iterator[bytes]:
            nonlocal ahead
            while ahead is not None and ahead[:2] == key:
                block = ahead[2]
                ahead = next(rows, None)
                yield block

        mine = same()
        yield key, mine
        for _ in mine:
            pass


def _pieces(blocks: Iterator[bytes], level: int, codes: Codes) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """Codes and values of blocks of one kind, equal grams summed up within stretches of HELD_ROWS rows."""
    held: list[list[np.ndarray]] = []

    def merged() -> tuple[list[np.ndarray], list[np.ndarray]]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        coded, values = columns[:level], columns[level:]
        _, coded, values = _summed(_hashes(coded, codes), coded, values)
        return coded, values

    size = 0
    for block in blocks:
        held.append(_unpack(block))
        size += len(held[-1][0])
        if size > HELD_ROWS:
            coded, values = merged()
            held[:] = [[*coded, *values]]
            size = len(coded[0])
            if size > HELD_ROWS // 2:
                yield coded, values
                held.clear()
                size = 0
    if held:
        yield merged()


def _count_of_counts(c: np.ndarray) -> list[int]:
    return [*(int((c == i).sum()) for i in (1, 2, 3, 4)), int((c >= 3).sum()), int(c.sum())]


def _table(hashes: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays of a file: sizes; large values' places and values; 40 bits of the sorted hashes; a byte for each value."""
    big = [np.flatnonzero(c > 254) for c in columns]
    out = [np.array([len(hashes), *map(len, big)], np.uint64)]
    out += [x for c, b in zip(columns, big, strict=True) for x in (b.astype(np.uint64), c[b].astype(np.uint64))]
    out += [(hashes >> np.uint64(32)).astype(np.uint32), (hashes >> np.uint64(24)).astype(np.uint8)]
    return out + [np.minimum(c, 255).astype(np.uint8) for c in columns]


def _fields(level: int, order: int) -> tuple[str, ...]:
    """What a level's arrays hold."""
    return (("times",) if level == 1 else ()) + ("count",) + (_FIELDS[2:] if level < order else ())


def _merged(batches: Iterator[pa.RecordBatch], files: SharedArrays, level: int, order: int, codes: Codes, bits: int) -> Iterator[pa.RecordBatch]:
    """Writes each shard's grams; passes on what it has of the grams one word shorter, and the level's counts of counts."""
    shard, parts = None, []
    # what goes on of the shards that are closed: dealt together, so that blocks stay large where there are many shards
    waiting: dict[int, list] = {_CONTEXTS: [], _GRAMS: []}
    rows = dict.fromkeys(waiting, 0)

    def dealt(kind: int) -> pa.RecordBatch:
        met, part, own = zip(*waiting[kind], strict=True)
        waiting[kind], rows[kind] = [], 0
        part, own = ([np.concatenate(c) for c in zip(*x, strict=True)] for x in (part, own))
        return _batch(*_dealt(kind, part, own, codes, bits, np.concatenate(met)))

    def close() -> Iterator[pa.RecordBatch]:
        names = _fields(level, order)
        coded = [np.concatenate([p[0][i] for p in parts]) for i in range(level)]
        values = [np.concatenate([p[1].get(f, np.zeros(len(p[0][0]), np.uint64)) for p in parts]) for f in names]
        parts.clear()
        hashes, coded, values = _summed(_hashes(coded, codes), coded, values)
        by_name = dict(zip(names, values, strict=True))
        if order == 1:
            by_name["count"] = by_name["times"]
        files.write(f"{level}-{shard}", *_table(hashes, [by_name[f] for f in names]))
        c, times = by_name["count"], by_name.get("times", np.zeros(0, np.uint64))
        sums = [level, *_count_of_counts(c), int(times.sum()), int((times > 0).sum())]
        yield _batch([0], [_SUMS], [_pack(*(np.array([x], np.uint64) for x in sums))])
        if level == 1:
            return
        real = c > 0
        coded, c = [x[real] for x in coded], c[real]
        one = np.ones(len(c), np.uint64)
        for kind, part, own in ((_CONTEXTS, coded[:-1], [c, *((x).astype(np.uint64) for x in (c == 1, c == 2, c >= 3))]), (_GRAMS, coded[1:], [one])):
            if waiting[kind] and rows[kind] + len(c) > HELD_ROWS:
                yield dealt(kind)
            waiting[kind].append(_summed(_hashes(part, codes), part, own))
            rows[kind] += len(waiting[kind][-1][0])

    for (at, kind), blocks in _runs(batches):
        if kind == _SUMS:
            for block in blocks:
                yield _batch([0], [_SUMS], [block])
            continue
        if parts and at != shard:
            yield from close()
        shard = at
        for coded, values in _pieces(blocks, level, codes):
            parts.append((coded, dict(zip(_OF_KIND[kind], values, strict=True))))
    if parts:
        yield from close()
    for kind in waiting:
        if waiting[kind]:
            yield dealt(kind)


_SUM_NAMES = ("level", "n1", "n2", "n3", "n4", "more", "sum", "tokens", "words")


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discount for counts 0, 1, 2 and more, from the counts of counts; 0 < D(i) < i, half of 1 where a count of counts is missing."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5)
    return np.array([0.0, *(min(max(d, 0.05 * i), 0.95 * i) for i, d in enumerate(raw, 1))])


@dataclass
class KneserNey:
    """A counted model: where its arrays are, which there are, its code table and its sums by level."""

    order: int
    files: SharedArrays
    shards: frozenset[str]
    codes: Codes
    sums: dict[int, dict[str, int]]
    _maps: OrderedDict = field(default_factory=OrderedDict, repr=False)
    _held: int = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_maps": OrderedDict(), "_held": 0}

    @property
    def totals(self) -> dict[str, int]:
        return self.sums.get(1, dict.fromkeys(_SUM_NAMES, 0))

    def _arrays(self, name: str, width: int) -> tuple | None:
        """The arrays of a file with ``width`` columns, mapped by each worker, MAPS at a time; None if no such shard was written. A file that can't be read fails the task."""
        if name not in self.shards:
            return None
        if name in self._maps:
            self._maps.move_to_end(name)
            return self._maps[name]
        raw = self.files.read(name)
        sizes = np.array(raw[: 8 * (1 + width)]).view(np.uint64).tolist()
        n, at, big = sizes[0], 8 * (1 + width), []
        for m in sizes[1:]:
            big.append((raw[at : at + 8 * m].view(np.uint64), raw[at + 8 * m : at + 16 * m].view(np.uint64)))
            at += 16 * m
        high = raw[at : at + 4 * n].view(np.uint32)
        at += 4 * n
        low = raw[at : at + n]
        at += n
        self._maps[name] = (high, low, [raw[at + j * n : at + (j + 1) * n] for j in range(width)], big)
        self._held += 0 if self.files.mapped else len(raw)
        while (self._held > HELD_BYTES or len(self._maps) > MAPS) and len(self._maps) > 1:
            _, (h, _, columns, old) = self._maps.popitem(last=False)
            self._held -= 0 if self.files.mapped else 5 * len(h) + len(h) * len(columns) + sum(16 * len(b[0]) for b in old)
        return self._maps[name]

    def _found(self, words: list[np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """For grams: the values of each distinct one by field (0 where there is none), and each gram's number among these."""
        level = len(words)
        hashes = gram_hash(words)
        shard = self.codes.shard(words[max(level - 2, 0)], hashes)
        # by shard and hash in one sort; with 24 bits of shards at most all 40 bits that arrays hold stay in the key
        keys = (shard.astype(np.uint64) << np.uint64(64 - self.codes.bits)) | (hashes >> np.uint64(self.codes.bits))
        order = np.argsort(keys)
        keys = keys[order]
        new = np.diff(keys, prepend=keys[:1] ^ np.uint64(1)) != 0
        back = np.empty(len(keys), np.int64)
        back[order] = np.cumsum(new) - 1
        first = order[new]
        hashes, shard = hashes[first], shard[first]
        names = _fields(level, self.order)
        out = {f: np.zeros(len(hashes), np.int64) for f in names}
        high, low = (hashes >> np.uint64(32)).astype(np.uint32), (hashes >> np.uint64(24)).astype(np.uint8)
        cut = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, b, number in zip(cut.tolist(), [*cut[1:].tolist(), len(shard)], shard[cut].tolist(), strict=True):
            arrays = self._arrays(f"{level}-{number}", len(names))
            if arrays is None or not len(arrays[0]):
                continue
            # few calls: with many shards each has few of a batch's grams
            highs, lows, columns, big = arrays
            top, last = high[a:b], low[a:b]
            at = highs.searchsorted(top)
            here = (highs.take(at, mode="clip") == top).nonzero()[0]
            at = at[here]
            same = lows.take(at) == last[here]
            if not same.all():
                # several grams may share the first 32 bits: the next ones are looked at too
                more, next_at = here[~same], at[~same] + 1
                here, at = here[same], at[same]
                while len(more):
                    inside = next_at < len(highs)
                    more, next_at = more[inside], next_at[inside]
                    alike = highs[next_at] == top[more]
                    more, next_at = more[alike], next_at[alike]
                    same = lows[next_at] == last[more]
                    here, at = np.append(here, more[same]), np.append(at, next_at[same])
                    more, next_at = more[~same], next_at[~same] + 1
            if not len(here):
                continue
            to = here + a
            for f, c, (places, values) in zip(names, columns, big, strict=True):
                v = c.take(at)
                out[f][to] = v
                if len(places):
                    large = (v == 255).nonzero()[0]
                    if len(large):
                        out[f][to[large]] = values[places.searchsorted(at[large].astype(np.uint64))]
        return out, back

    def scored(self, now: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: log10 probability, log10 of its base share, whether it is known."""
        t, n = self.totals, len(now)
        # one gram more, of begin marks alone: what stands before a text's first word
        words = [np.append(w, BEGIN) for w in grams(now, to, self.order)]
        before = np.arange(-1, n - 1)
        before[to[:-1][np.diff(to) > 0]] = n
        found, back = self._found(words[-1:])
        times, c = found["times"][back[:n]], found["count"][back[:n]]
        d = discounts(*(t[f"n{i}"] for i in (1, 2, 3, 4)))
        if t["sum"]:
            free = (d[1] * t["n1"] + d[2] * t["n2"] + d[3] * t["more"]) / t["sum"]
            p = np.maximum(c - d[np.minimum(c, 3)], 0) / t["sum"] + free / (t["words"] + 1)
        else:
            p = np.full(n, 1.0 / (t["words"] + 1))
        for level in range(2, self.order + 1):
            s = self.sums.get(level, dict.fromkeys(_SUM_NAMES, 0))
            d = discounts(*(s[f"n{i}"] for i in (1, 2, 3, 4)))
            # a token's context is the next shorter gram of the token before it, which is found already
            h, gamma, context = found["total"], d[1] * found["once"] + d[2] * found["twice"] + d[3] * found["more"], back[before]
            gamma = np.where(h > 0, gamma / np.maximum(h, 1), 1.0)[context]
            h = h[context]
            found, back = self._found(words[self.order - level :])
            c = found["count"][back[:n]]
            p = np.where(h > 0, np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(h, 1), 0.0) + gamma * p
        base = np.log10((times + 0.1) / (t["tokens"] + 0.1 * (t["words"] + 1)))
        return np.log10(p), base, times > 0


def _frequent(counts: DataFrame) -> DataFrame:
    """The most frequent words, CODED - 1 at most: all above the least step of the counts' logarithm where that many stand."""
    step = F.floor(16 * F.log2(F.col("n"))).cast("int")
    steps = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True)
    words = np.cumsum([r["words"] for r in steps])
    within = int(np.searchsorted(words, CODED - 1, side="right"))
    least = steps[within - 1]["step"] if within else 1 << 30
    return counts.where(step >= least).orderBy("word")


def trained(docs: DataFrame, text: str = "text", order: int = ORDER) -> KneserNey:
    """Counts the texts of ``docs`` into a model of ``order`` words in the shared folder."""
    spark = docs.sparkSession
    files, waiting = SharedArrays(new_folder(spark, "kneser-ney")), new_folder(spark, "kneser-ney-blocks")
    files.create()
    try:
        with shuffles_freed(spark):
            return _trained(docs.select(F.col(text).alias("text")), order, files, waiting)
    except BaseException:
        files.delete()
        raise
    finally:
        delete_folder(spark, waiting)


def _trained(texts: DataFrame, order: int, files: SharedArrays, waiting: str) -> KneserNey:
    """``waiting``: a folder for the blocks of levels that are still to be merged."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(size // SHARD_BYTES).bit_length())
    counts = kept(in_batches(texts, _word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = _frequent(counts).collect()
    hashes = np.array([int(BEGIN), *(r["word"] for r in top)], np.uint64)
    hot = np.sort(np.array([int(BEGIN), *(r["word"] for r in top if r["n"] > HOT * total / (1 << bits))], np.uint64))
    codes = Codes(hashes, hot, bits)
    shared = spark.sparkContext.broadcast(codes)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    steps = [*range(STEP_BITS, bits, STEP_BITS), bits]
    first, part_bits = steps[0], min(PART_BITS, bits - 4)

    def put(blocks: DataFrame, level: int) -> None:
        """Adds blocks to those that wait for a level; small row groups, as a reader holds one of them at a time."""
        rows = blocks.withColumn("part", F.shiftright("shard", first - part_bits)).write.mode("append").partitionBy("part")
        rows.options(**{"compression": "none", "parquet.block.size": 16 << 20, "parquet.enable.dictionary": "false"}).parquet(f"{waiting}/{level}")

    def put_in(level: int) -> DataFrame:
        return spark.read.schema(f"{_BLOCK}, part int").parquet(f"{waiting}/{level}")

    def by_shard(blocks: DataFrame, level: int) -> DataFrame:
        """Blocks of a level by shard, dealt in as many steps as there are."""
        for b in steps[1:]:
            blocks = in_batches(blocks.repartition(tasks, "shard").sortWithinPartitions("shard", "kind"), lambda x, b=b: _redealt(x, level, shared.value, b), _BLOCK)
        return blocks.repartition(tasks, "shard").sortWithinPartitions("shard", "kind")

    if order > 1:
        put(in_batches(texts, lambda x: _counted(x, order, shared.value, first), _BLOCK), order)
    for level in range(order, 0, -1):
        if level == 1:
            put(in_batches(counts, lambda x: _coded_counts(x, shared.value, first), _BLOCK), level)
        for part in range(1 << part_bits):
            blocks = by_shard(put_in(level).where(F.col("part") == part).drop("part"), level)
            put(in_batches(blocks, lambda x, level=level: _merged(x, files, level, order, shared.value, first), _BLOCK), level - 1)
            delete_folder(spark, f"{waiting}/{level}/part={part}")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in _unpack(block)], names=list(_SUM_NAMES))

    sums = in_batches(put_in(0).select("block"), opened, ", ".join(f"{n} long" for n in _SUM_NAMES))
    rows = sums.groupBy("level").agg(*(F.sum(n).alias(n) for n in _SUM_NAMES[1:])).collect()
    return KneserNey(order, files, files.names(), codes, {r["level"]: {n: int(r[n]) for n in _SUM_NAMES} for r in rows})


def scores(docs: DataFrame, model: KneserNey, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every document, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=SCORED_BYTES):
            now, to = tokens(*utf8(batch.column("text")))
            p, base, known = shared.value.scored(now, to)
            of, n = np.repeat(np.arange(batch.num_rows), np.diff(to)), batch.num_rows
            sums = [np.bincount(of, weights=w, minlength=n) for w in (base, p)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(to)), pa.array(np.bincount(of[known], minlength=n)), *map(pa.array, sums)],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return in_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
