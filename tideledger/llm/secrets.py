"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Fixed patterns find assignments to credential names, access keys and long hex
strings. The token-efficiency test then looks at every unbroken run of key
characters: text that people write takes few tokens for its characters under a
byte-level BPE vocabulary, a random string takes many. A run of at least
``MIN_RUN`` characters with both letters and digits and fewer than
``MAX_CHARS_PER_TOKEN`` characters a token is a finding of kind ``random``,
unless it is a known digest (hex of a digest's length), a UUID or an
identifier (words joined by ``_``, ``-``, ``/`` or ``.``), or touches a span of
a fixed pattern.

Cases: null counts as empty text, which has no findings; rows that repeat give
results that repeat; text beyond ASCII never matches but counts by code points
in the offsets.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches
from .textbatch import byte_table, chunks, spans, utf8

KINDS = ("assign", "access", "hex")
MIN_RUN = 20
MAX_CHARS_PER_TOKEN = 2.4

_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)
_PART = r"(?>[A-Z]{2,}(?![a-z])|[A-Za-z][a-z]*+|[0-9]{1,8}(?![0-9]))"  # tried once each, so that long runs take linear time
_IDENTIFIER = re.compile(rf"{_PART}(?:[_/=+-]++{_PART})*+[_/=+-]*+")

_HEX_BYTES = byte_table((0x30, 0x39), (0x61, 0x66))
_RUN_BYTES = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), *((ord(c), ord(c)) for c in "+/_=-"))


@lru_cache(maxsize=2)
def _encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns: start, end, kind, by start and then the order of KINDS."""
    found = []
    # every name's letters are in the lower-cased text, also where that changes its length
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def is_random(run: str, encoding: tiktoken.Encoding) -> bool:
    """Whether a run of key characters takes too many tokens to be written text, a digest or an identifier."""
    if not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)):
        return False
    if _DIGEST.fullmatch(run) or _UUID.fullmatch(run) or _IDENTIFIER.fullmatch(run):
        return False
    return len(run) < MAX_CHARS_PER_TOKEN * len(encoding.encode_ordinary(run))


def random_spans(text: str, taken: list[tuple[int, int, str]], encoding: tiktoken.Encoding) -> list[tuple[int, int, str]]:
    out, i = [], 0
    ordered = sorted(taken)
    reach = 0
    for m in _RUN.finditer(text):
        while i < len(ordered) and ordered[i][0] < m.end():
            reach = max(reach, ordered[i][1])
            i += 1
        if reach <= m.start() and is_random(m.group(), encoding):
            out.append((m.start(), m.end(), "random"))
    return out


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def _has_run(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, least: int) -> np.ndarray:
    starts, ends, by_text = spans(data, offsets, table)
    long = np.concatenate([[0], np.cumsum(ends - starts >= least)])
    return long[by_text[1:]] > long[by_text[:-1]]


def secret_spans(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base (text form of the fixed patterns' spans), spans (of all)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks, pattern)
        for batch in chunks(batches):
            data, offsets = utf8(batch.column("text"))
            # runs are found bytewise first: a text without any needs no patterns but the cheap name tests
            runs = _has_run(data, offsets, _RUN_BYTES, MIN_RUN) | _has_run(data, offsets, _HEX_BYTES, 24)
            rows = []
            for t, run in zip(batch.column("text").to_pylist(), runs, strict=True):
                t = t or ""
                base = base_spans(t) if run or any(n in t.lower() for n in _NAMES) else []
                extra = random_spans(t, base, encoding) if run else []
                both = sorted(base + extra, key=lambda s: (s[0], (*KINDS, "random").index(s[2])))
                rows.append((*(sum(s[2] == k for s in base) for k in KINDS), len(extra), _joined(base), _joined(both)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base", "spans"],
            )

    return in_batches(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), scan, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base string, spans string"
    )


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
