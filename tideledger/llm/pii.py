"""Personal data: fixed patterns, and information-theoretic sanitisation of terms.

Fixed patterns find e-mail addresses, IP addresses, card and telephone numbers;
these are the protected entities. Entities that stand in exactly the same documents
are one subject (a person's address and number, the addresses of a list that is
copied). Other words may give a subject away without it: over the whole corpus the
operator counts in how many documents a term stands together with a subject, and in
how many it stands at all. A term t discloses a subject e if

* with e it has ``MIN_CONTEXTS`` contexts of which no two are alike: near an entity of e
  each place of t is one (the words around it), and a document with t elsewhere only
  is one (the words around all its places); copies and near copies of a passage share
  ``LIKE`` of these or more, so they count once, however many there are. Whether there
  are such contexts is searched in full, so more documents never take them away,
* P(e | t) >= ``MIN_SHARE``: most documents with t have e, and
* log2 P(e | t) / P(e) >= ``MIN_BITS``: that is far more than by chance; of a
  subject so common that it has hardly as many bits itself, half of its own bits
  will do, if ``MIN_BITS`` a context all in all speak against chance.

A term that discloses any subject is a span of kind ``term`` wherever it stands, in
documents without the subject as well; ``sanitised`` puts a general placeholder in
place of every span.

Cases: null counts as empty text; rows that repeat give results that repeat; in
a corpus without entities no term discloses any; only id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import fresh, row_key
from .shared import in_batches, kept
from .textbatch import BLANK_WORD, LOWER, chunks, code_points, span_hashes, spans, text_of, utf8

KINDS = ("email", "ip", "card", "phone")
NEAR_WORDS = 8
MIN_CONTEXTS = 3
#: Share of the lesser of two contexts from which they count as alike.
LIKE = 1 / 3
#: Contexts of a pair that are compared at once are three slices of this many.
SLICE = 640
MIN_SHARE = 0.5
MIN_BITS = 6.0
#: Bits of the map of candidate terms, whatever their number: 8 MB.
MAP_BITS = 1 << 26
#: Terms that a task counts together before it passes them on.
HELD_PAIRS = 500_000
#: Disclosing pairs or terms (16 bytes each) up to which they may be broadcast.
BROADCAST_ROWS = 500_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# digits before a start would have been part of the match, so a look-behind changes nothing but the time it takes
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: the local part is the whole run before the sign, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns: kind, start, end, by the order of KINDS and then by start."""
    out = [("email", s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


_STRIP = ".,;:!?\"'()[]{}<>#*$%&|"
_EDGE = np.zeros(256, dtype=bool)
_EDGE[list(_STRIP.encode())] = True


def _hash(values: list[str]) -> np.ndarray:
    """Of A-Z lowered and nothing else, as texts are hashed bytewise."""
    data, offsets = utf8(pa.array(values, pa.string()))
    return span_hashes(LOWER[data], offsets[:-1], offsets[1:])


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of 2 characters and more, edge characters stripped: hash, start and end in the text, and the words' offsets by text."""
    raw, byte_off = utf8(column)
    data = LOWER[raw]
    starts, ends, offsets = spans(data, byte_off, BLANK_WORD)
    texts = text_of(offsets)
    # strip the edge characters: jump to the first and last byte that isn't one
    inner = np.flatnonzero(~_EDGE[data])
    first = np.searchsorted(inner, starts)
    last = np.searchsorted(inner, ends) - 1
    ok = first <= last
    s, e, texts = inner[first[ok]], inner[last[ok]] + 1, texts[ok]
    points = code_points(data)
    long = points[e] - points[s] >= 2
    s, e, texts = s[long], e[long], texts[long]
    before = points[byte_off[texts]]
    return span_hashes(data, s, e), points[s] - before, points[e] - before, np.searchsorted(texts, np.arange(len(byte_off)))


def _outside(start: np.ndarray, end: np.ndarray, found: list[tuple[str, int, int]]) -> np.ndarray:
    """Which words overlap none of the spans."""
    free = np.ones(len(start), bool)
    for _, s, e in found:
        free[np.searchsorted(end, s, side="right") : np.searchsorted(start, e)] = False
    return free


def _entities(text: str, found: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct entities of a text and how often each stands there."""
    return np.unique(_hash([text[s:e] for _, s, e in found]), return_counts=True)


class _Map:
    """A broadcast bit map of hashes: has all that it was made of, and hardly any other."""

    def __init__(self, df: DataFrame, column: str):
        rows = (
            df.groupBy(F.shiftright(F.col(column).bitwiseAND(F.lit(MAP_BITS - 1)), 6).alias("word"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits"))
            .toArrow()
        )
        slots = np.zeros(MAP_BITS // 64, np.uint64)
        slots[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        self._slots = df.sparkSession.sparkContext.broadcast(slots)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & np.uint64(MAP_BITS - 1)
        return (self._slots.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _signed(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.asarray(c).astype(np.uint64).view(np.int64)) for c in columns]


def _document_entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, entity, how often: each entity of each document."""
    for batch in chunks(batches):
        rows = batch.column("row").to_pylist()
        held = [(r, *_entities(t, found)) for r, t in zip(rows, batch.column("text").to_pylist(), strict=True) if t and (found := base_spans(t))]
        if held:
            row = np.repeat(np.array([r for r, _, _ in held], np.int64), [len(w) for _, w, _ in held])
            yield pa.RecordBatch.from_arrays([pa.array(row), *_signed(*(np.concatenate([x[i] for x in held]) for i in (1, 2)))], names=["row", "entity", "times"])


def _document_terms(batches: Iterator[pa.RecordBatch], entities: _Map) -> Iterator[pa.RecordBatch]:
    """row, term, how often: the words of each document with an entity of the map."""
    for batch in chunks(batches):
        for i, t in enumerate(batch.column("text").to_pylist()):
            found = base_spans(t) if t else []
            if not found or not entities.has(_entities(t, found)[0]).any():
                continue
            h, start, end, _ = _words(batch.column("text").slice(i, 1))
            terms, n = np.unique(h[_outside(start, end, found)], return_counts=True)
            if len(terms):
                row = np.full(len(terms), batch.column("row")[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row), *_signed(terms, n)], names=["row", "term", "times"])


def _term_documents(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """term, n: in how many documents each candidate term stands."""
    wanted = _Map(candidates, "term")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            terms, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n for _, n in held]))
            held.clear()
            return pa.RecordBatch.from_arrays(_signed(terms, n), names=["term", "n"])

        for batch in chunks(batches):
            h, _, _, offsets = _words(batch.column("text"))
            hit = wanted.has(h)
            h, texts = h[hit], text_of(offsets)[hit]
            order = np.lexsort((texts, h))
            h, texts = h[order], texts[order]
            new = (np.diff(h, prepend=~h[:1]) != 0) | (np.diff(texts, prepend=-1) != 0)
            held.append(np.unique(h[new], return_counts=True))
            size += len(held[-1][0])
            if size >= HELD_PAIRS:
                yield flush()
                size = 0
        if held:
            yield flush()

    return in_batches(docs, count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_NEAR = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("context", pa.list_(pa.int64()))]))
_FAR = pa.list_(pa.struct([("term", pa.int64()), ("context", pa.list_(pa.int64()))]))
_FOUND = "key long, row long, doc_id long, base array<struct<kind:string,start:int,end:int>>"
_HITS = ", term array<long>, start array<int>, end array<int>, near array<struct<entity:long,term:long,context:array<long>>>, far array<struct<term:long,context:array<long>>>"


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        base = [[{"kind": k, "start": s, "end": e} for k, s, e in base_spans(t)] if t else [] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("row"), batch.column("doc_id"), pa.array(base, _SPANS)], names=["key", "row", "doc_id", "base"])


def _contexts(text: str, found: list[tuple[str, int, int]], entities: _Map, words: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[list[dict], list[dict]]:
    """Of the terms at ``at``: the words around each place near an entity of the map, by entity; and the words around all places of each term."""
    values = _hash([text[s:e] for _, s, e in found])
    ours = entities.has(values)
    lines = np.searchsorted(end, np.array([s for _, s, _ in found])[ours], side="right")
    order = np.argsort(lines, kind="stable")
    lines, values = lines[order], values[ours][order].view(np.int64)
    near: set[tuple] = set()
    far: dict[int, list[np.ndarray]] = {}
    if not len(lines):
        return [], []
    for j in at.tolist():
        around = np.unique(words[max(0, j - NEAR_WORDS) : j + NEAR_WORDS + 1])
        around = around[around != words[j]].view(np.int64)
        term = int(words[j].view(np.int64))
        far.setdefault(term, []).append(around)
        # lines - NEAR_WORDS <= j < lines + NEAR_WORDS
        beside = values[np.searchsorted(lines, j - NEAR_WORDS, side="right") : np.searchsorted(lines, j + NEAR_WORDS, side="right")]
        near |= {(e, term, tuple(around.tolist())) for e in set(beside.tolist())}
    return [{"entity": e, "term": t, "context": c} for e, t, c in near], [{"term": t, "context": np.unique(np.concatenate(c))} for t, c in far.items()]


def _places(batches: Iterator[pa.RecordBatch], entities: _Map, wanted: _Map) -> Iterator[pa.RecordBatch]:
    """Base spans, every place of the wanted terms, and in documents with an entity of the map the words around each such place."""
    for batch in chunks(batches):
        h, start, end, offsets = _words(batch.column("text"))
        hit = wanted.has(h)
        base, terms, starts, ends, near, far = [], [], [], [], [], []
        for i, t in enumerate(batch.column("text").to_pylist()):
            found = base_spans(t) if t else []
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            own = slice(offsets[i], offsets[i + 1])
            w, s, e, here = h[own], start[own], end[own], hit[own]
            if found:
                free = _outside(s, e, found)
                w, s, e, here = w[free], s[free], e[free], here[free]
            at = np.flatnonzero(here)
            terms.append(w[at].view(np.int64))
            starts.append(s[at])
            ends.append(e[at])
            beside, all_over = _contexts(t, found, entities, w, e, at) if found and len(at) else ([], [])
            near.append(beside)
            far.append(all_over)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                batch.column("row"),
                batch.column("doc_id"),
                pa.array(base, _SPANS),
                pa.array(terms, pa.list_(pa.int64())),
                *(pa.array(x, pa.list_(pa.int32())) for x in (starts, ends)),
                pa.array(near, _NEAR),
                pa.array(far, _FAR),
            ],
            names=["key", "row", "doc_id", "base", "term", "start", "end", "near", "far"],
        )


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (kept beforehand) for a join: broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= rows else df


def three_unlike(contexts: list[np.ndarray]) -> bool:
    """Whether three of the contexts (sets of words, none empty) are unlike each other."""
    sizes = np.array([len(c) for c in contexts])
    if len(contexts) < MIN_CONTEXTS:
        return False
    owner = np.repeat(np.arange(len(contexts)), sizes)
    _, word, times = np.unique(np.concatenate(contexts), return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    use = often[word]
    owner, word = owner[use], number[word[use]]
    shared = np.zeros((len(contexts), len(contexts)), np.float32)
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    for lo in range(0, int(often.sum()), 2048):
        a, b = np.searchsorted(word, [lo, lo + 2048])
        has = np.zeros((len(contexts), 2048), np.float32)
        has[owner[a:b], word[a:b] - lo] = 1
        shared += has @ has.T
    unlike = (shared < LIKE * np.minimum(sizes[:, None], sizes[None, :])).astype(np.float32)
    np.fill_diagonal(unlike, 0)
    most = np.flatnonzero(unlike[int(unlike.sum(axis=1).argmax())])
    return bool(unlike[np.ix_(most, most)].any() or ((unlike @ unlike > 0) & (unlike > 0)).any())


def _cells_with_three(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """subject, term of every cell (rows come sorted by subject, term and cell) that holds three unlike contexts."""
    held: list[np.ndarray] = []
    at: tuple | None = None
    out: list[tuple] = []

    def closed() -> None:
        if at is not None and out[-1:] != [at[:2]] and three_unlike(held):
            out.append(at[:2])

    for batch in batches:
        key = zip(*(batch.column(c).to_pylist() for c in ("subject", "term", "cell")), strict=True)
        offsets, flat = np.asarray(batch.column("context").offsets), np.asarray(batch.column("context").values)
        for i, k in enumerate(key):
            if k != at:
                closed()
                held, at = [], k
            held.append(flat[offsets[i] : offsets[i + 1]])
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out[:-1]], pa.int64()) for i in (0, 1)], names=["subject", "term"])
            del out[:-1]
    closed()
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["subject", "term"])


def _in_unlike_contexts(contexts: DataFrame) -> DataFrame:
    """subject, term of pairs with three contexts of which no two are alike.

    A pair's distinct contexts are dealt in slices; first each slice is searched,
    then, for pairs that have none so far, every three slices together, which
    meets every three contexts.
    """
    pair = ["subject", "term"]
    rows = kept(contexts.where(F.size("context") > 0).select(*pair, "context").distinct())
    counts = rows.groupBy(*pair).agg(F.count("*").alias("n")).where(F.col("n") >= MIN_CONTEXTS).withColumn("slices", F.ceil(F.col("n") / SLICE).cast("int"))
    sliced = rows.join(counts, pair).withColumn("slice", F.pmod(F.xxhash64("context"), F.col("slices")).cast("long"))

    def searched(cells: DataFrame) -> DataFrame:
        dealt = cells.select(*pair, "cell", "context").repartition(*pair, "cell").sortWithinPartitions(*pair, "cell")
        return in_batches(dealt, _cells_with_three, "subject long, term long").distinct()

    first = kept(searched(sliced.withColumn("cell", F.col("slice"))))
    rest = sliced.where("slices > 1").join(first, pair, "left_anti")
    # each slice with every two others; with every one other where there are just two
    others = F.expr("""
        CASE WHEN slices = 2 THEN array(0L)
        ELSE flatten(transform(sequence(0, slices - 2), b -> transform(sequence(b + 1, slices - 1), c -> IF(b = slice OR c = slice, NULL,
             array_sort(array(slice, bigint(b), bigint(c)))[0] * slices * slices + array_sort(array(slice, bigint(b), bigint(c)))[1] * slices + array_sort(array(slice, bigint(b), bigint(c)))[2])))) END
    """)
    cells = rest.withColumn("cell", F.explode(F.filter(others, lambda x: x.isNotNull())))
    return first.unionByName(searched(cells)).distinct()


def _likely(texts: DataFrame, total: int) -> tuple[DataFrame, DataFrame] | None:
    """(row, entity, subject) of documents with recurring entities, and the pairs (subject, term) of which the term has most of its documents with the subject, far more than by chance."""
    every = kept(in_batches(texts, _document_entities, "row long, entity long, times long"))
    # the same documents: as many, and equal sums of two hashes of them
    sums = [F.sum(F.xxhash64(F.lit(i), "row").cast("decimal(20,0)")) for i in (1, 2)]
    entities = every.groupBy("entity").agg(F.count("*").alias("n"), F.sum("times").alias("seen"), *(x.alias(f"s{i}") for i, x in enumerate(sums))).where(F.col("seen") >= MIN_CONTEXTS)
    named = kept(entities.select("entity", "n", F.xxhash64("n", "s0", "s1").alias("subject")))
    if named.isEmpty():
        return None
    known = _Map(named, "entity")
    whose = kept(every.join(_small(named, BROADCAST_ROWS), "entity").select("row", "entity", "subject", "n").distinct())
    words = kept(in_batches(texts, lambda b: _document_terms(b, known), "row long, term long, times long"))
    # a term stands in at least as many documents as in those with any such entity, so its share is no more than of these
    rare = words.groupBy("term").agg(F.count("*").alias("at_least"), F.sum("times").alias("seen")).where(F.col("seen") >= MIN_CONTEXTS).drop("seen")
    met = words.join(rare, "term").join(whose.select("row", "subject", "n").distinct(), "row").where(MIN_SHARE * F.col("at_least") <= F.col("n"))
    pairs = met.groupBy("subject", "term", "at_least", F.col("n").alias("n_subject")).agg(F.count("*").alias("together"), F.sum("times").alias("seen"))
    pairs = kept(pairs.where((F.col("seen") >= MIN_CONTEXTS) & (F.col("together") >= MIN_SHARE * F.col("at_least"))).drop("at_least", "seen"))
    if pairs.isEmpty():
        return None
    p, n = F.col("n_subject") / F.lit(float(total)), F.greatest("n", "together")
    share = F.col("together") / n
    bits = F.log2(share / p)
    # how unlikely it is that chance put so many of the term's documents among the subject's
    evidence = F.col("together") * bits + F.when(share < 1, (n - F.col("together")) * F.log2((1 - share) / (1 - p))).otherwise(0.0)
    hot = (bits > 0) & (bits >= -F.log2(p) / 2) & (evidence >= MIN_BITS * MIN_CONTEXTS)
    likely = pairs.join(_term_documents(texts, pairs), "term").where((share >= MIN_SHARE) & ((bits >= MIN_BITS) | hot)).select("subject", "term")
    return whose, kept(likely)


def personal_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: bool = False) -> DataFrame:
    """doc_id, base and terms (arrays of kind, start, end) of every document; with ``row`` its row_key too."""
    out = [*(["row"] if row else []), "doc_id", "base"]
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("terms")
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed = named.select(F.monotonically_increasing_id().alias("key"), row_key().alias("row"), "doc_id", "text")
    texts = named.select(row_key().alias("row"), "text")
    pairs = _likely(texts, texts.count())
    if pairs is None or pairs[1].isEmpty():
        return in_batches(keyed, _base, _FOUND).select(*out, none)
    whose, likely = pairs
    likely = _small(likely, BROADCAST_ROWS)
    subjects = kept(whose.join(likely, "subject", "left_semi").select("row", "entity", "subject"))
    entities, wanted = _Map(subjects, "entity"), _Map(likely, "term")
    found = kept(in_batches(keyed, lambda b: _places(b, entities, wanted), _FOUND + _HITS))
    names = subjects.select("entity", "subject").distinct()
    near = found.where(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.*").join(names, "entity").join(likely, ["subject", "term"], "left_semi")
    near = kept(near.select("subject", "term", "row", "context"))
    far = found.where(F.size("far") > 0).select("row", F.explode("far").alias("x")).select("row", "x.*").join(likely, "term")
    far = far.join(subjects.select("row", "subject").distinct(), ["row", "subject"], "left_semi").join(near, ["row", "subject", "term"], "left_anti")
    contexts = near.unionByName(far.select("subject", "term", "row", "context"))
    disclosing = kept(_in_unlike_contexts(contexts).select("term").distinct())
    spans_of = (
        found.where(F.size("term") > 0)
        .select("key", F.explode(F.arrays_zip("term", "start", "end")).alias("x"))
        .select("key", "x.*")
        .join(_small(disclosing, BROADCAST_ROWS), "term", "left_semi")
        .groupBy("key")
        .agg(F.sort_array(F.collect_set(F.struct(F.lit("term").alias("kind"), F.col("start"), F.col("end")))).alias("terms"))
    )
    return found.join(spans_of, "key", "left").select(*out, F.coalesce("terms", none).alias("terms"))


#: What stands in place of a span (fixed values).
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def replaced(text: str, found: list[tuple[str, int, int]]) -> str:
    """``text`` with each span generalised; of spans that overlap the first counts, stretched over the rest."""
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(found, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data and disclosing terms generalised and ``n_chars`` (if there) counted anew."""
    found = personal_spans(docs.select("doc_id", "text"), row=True)
    # fixed patterns are found again where a text is written out; only disclosing terms come from the corpus
    row, who, own = fresh("_row", docs), fresh("_id", docs), fresh("_terms", docs)
    extra = kept(found.where(F.size("terms") > 0).groupBy(F.col("row").alias(row), F.col("doc_id").alias(who)).agg(F.first("terms").alias(own)))
    if extra.count() <= BROADCAST_ROWS // 10:
        extra = F.broadcast(extra)
    with_terms = docs.join(extra, (row_key() == F.col(row)) & F.col("doc_id").eqNullSafe(F.col(who)), "left").drop(row, who)
    schema = docs.schema
    names = schema.names

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = []
            for t, terms in zip(batch.column("text").to_pylist(), batch.column(own).to_pylist(), strict=True):
                found = (base_spans(t) if t else []) + [(x["kind"], x["start"], x["end"]) for x in terms or ()]
                texts.append(replaced(t, found) if found else t)
            out = batch.select(names)
            at = names.index("text")
            out = out.set_column(at, out.schema.field(at), pa.array(texts, out.schema.field(at).type))
            if "n_chars" in names:
                at = names.index("n_chars")
                sizes = [None if t is None else len(t) for t in texts]
                out = out.set_column(at, out.schema.field(at), pa.array(sizes, out.schema.field(at).type))
            yield out

    return in_batches(with_terms, rewrite, schema)
