"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

A text falls into pieces by the vocabulary's pattern, and each piece is encoded
on its own. Within a piece the table of prefixes is filled from left to right:
the encoding of the prefix that ends at byte i is the encoding of a shorter
prefix followed by the one token that may stand after that prefix's last token
(two tokens may stand side by side if the merges turn their bytes into just
these two). So ``count[i] = count[i - len(token)] + 1``, and one pass gives the
exact count of every prefix. Over the pieces the counts add up, which answers
how many tokens any prefix of a text has, and how much of it fits a budget,
without encoding again.

Cases: null and empty texts have no tokens; the special string of the
vocabulary is one token wherever it stands, as in the library's default.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches
from .textbatch import chunks, utf8

#: White space as the library's pattern has it (fixed values: the White_Space property of Unicode).
_WS = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_BLANK = regex.compile(rf"[{_WS}]+")
#: Endings of three characters: cut by one they are an apostrophe and a letter (fixed values).
_LONG_ENDINGS = ("'re", "'ve", "'ll")

#: Entries a worker keeps of pieces it has met; beyond that it starts afresh.
PIECES_KEPT = 400_000


def _letter_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Exact token counts of every prefix under the vocabulary of a ``tokenizers`` byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _letter_bytes()
        of = lambda s: bytes(letters[c] for c in s)
        special = {t["content"] for t in spec["added_tokens"]}
        self.vocab = {of(s) for s in spec["model"]["vocab"] if s not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(of(a), of(b)): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.vocab))
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self._beside: dict[tuple[bytes, bytes], bool] = {}
        self._whole: dict[bytes, bool] = {}
        self._counts: dict[str, int] = {}

    def merged(self, text: bytes) -> list[bytes]:
        """The merges applied to a short run of bytes: least rank first, leftmost of equals."""
        parts = [bytes([b]) for b in text]
        while len(parts) > 1:
            rank, at = min((self.merges.get((parts[i], parts[i + 1]), 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, last: bytes, token: bytes) -> bool:
        key = (last, token)
        known = self._beside.get(key)
        if known is None:
            if len(self._beside) > PIECES_KEPT:
                self._beside.clear()
            known = self._beside[key] = self.merged(last + token) == [last, token]
        return known

    def _is_token(self, token: bytes) -> bool:
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merged(token) == [token]
        return known

    def piece_table(self, piece: bytes) -> list[int]:
        """Token counts of the prefixes of one piece, from the empty one to the whole."""
        counts, last = [0], [b""]
        vocab, longest = self.vocab, self.longest
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                token = piece[start:end]
                if token in vocab and (self._may_follow(last[start], token) if start else self._is_token(token)):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return counts

    def _piece_count(self, piece: str) -> int:
        count = self._counts.get(piece)
        if count is None:
            if len(self._counts) > PIECES_KEPT:
                self._counts.clear()
            count = self.piece_table(piece.encode("utf-8"))[-1]
            if len(piece) <= 64:
                self._counts[piece] = count
        return count

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        yield text[at:], False

    def pieces(self, text: str) -> tuple[list[str], list[int]]:
        """The stored table at piece ends: the pieces (special strings among them) and the tokens of the text up to each one's end."""
        known, parts, counts = self._counts, [], []
        for segment, is_special in self._segments(text):
            if is_special:
                parts.append(segment)
                counts.append(1)
                continue
            found = _PIECE.findall(segment)
            parts += found
            counts += [known.get(x) or self._piece_count(x) for x in found]
        return parts, list(accumulate(counts))

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entry of its table."""
        _, ends = self.pieces(text)
        return ends[-1] if ends else 0

    def _prefixes(self, parts: list[str], ends: list[int], j: int) -> list[int]:
        """Tokens of the text up to each code point of piece ``j``, as if it were cut there; the last entry is the table's own."""
        piece, under = parts[j], ends[j - 1] if j else 0
        if self.special and self.special.fullmatch(piece):
            # a part of the special string is ordinary text: only the two pieces before it may read on into it
            k = max(0, j - 2)
            while k < j and any(self.special.fullmatch(x) for x in parts[k:j]):
                k += 1
            lead, base = "".join(parts[k:j]), ends[k - 1] if k else 0
            out = [base + sum(map(self._piece_count, _PIECE.findall(lead + piece[:i]))) for i in range(1, len(piece))]
            return [*out, ends[j]]
        sizes = list(accumulate(len(c.encode("utf-8")) for c in piece))
        own = self.piece_table(piece.encode("utf-8"))
        out = [under + own[n] for n in sizes]
        blank = len(piece) if _BLANK.fullmatch(piece) else int(piece[0] == " ")
        if blank and j and _BLANK.fullmatch(parts[j - 1]):
            # a cut among blanks makes them one piece with the blanks before
            run = parts[j - 1] + piece[:blank]
            whole = self.piece_table(run.encode("utf-8"))
            base, at = ends[j - 2] if j > 1 else 0, len(parts[j - 1].encode("utf-8"))
            out[:blank] = [base + whole[at + n] for n in sizes[:blank]]
        if piece in _LONG_ENDINGS:
            # cut short it is no ending: the apostrophe, then a letter
            out[1] = under + self._piece_count(piece[0]) + self._piece_count(piece[1])
        # the end of the text is the table's own; before it a cut after blanks is a cut among blanks
        if j + 1 == len(parts) or blank < len(piece):
            out[-1] = ends[j]
        return out

    def table(self, text: str) -> list[int]:
        """Tokens of text[:i] for every i from 0 to len(text)."""
        parts, ends = self.pieces(text)
        out = [0]
        for j in range(len(parts)):
            out += self._prefixes(parts, ends, j)
        return out

    def fits(self, text: str, budget: int, table: tuple[list[str], list[int]] | None = None) -> int:
        """Code points of the longest prefix that starts a run of prefixes all within ``budget`` tokens, read from the table at piece ends (``pieces``).

        Only pieces that could pass the budget are looked into.
        """
        parts, ends = table or self.pieces(text)
        if not parts:
            return 0
        # a prefix that ends in a piece has at most a token a byte of it and of the blanks before
        most = 8 * max(map(len, parts))
        if ends[-1] + most <= budget:
            return len(text)
        first = bisect_right(ends, budget - most)
        at = sum(map(len, parts[:first]))
        for j in range(first, len(parts)):
            over = next((i for i, n in enumerate(self._prefixes(parts, ends, j)) if n > budget), None)
            if over is not None:
                return at + over
            at += len(parts[j])
        return len(text)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One counter for each worker process."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, budget: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document, and with a budget fits (code points that stay within it): all read from the text's table, in one pass without a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in chunks(batches):
            _, offsets = utf8(batch.column("text"))
            n_tokens, fits = [], []
            for t in batch.column("text").to_pylist():
                table = own.pieces(t) if t else ([], [])
                n_tokens.append(table[1][-1] if t else 0)
                if budget is not None:
                    fits.append(own.fits(t, budget, table) if t else 0)
            columns = [batch.column("doc_id"), pa.array(offsets[1:] - offsets[:-1], pa.int64()), pa.array(n_tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(fits, pa.int64())] if budget is not None else []), names=names)

    names = ["doc_id", "n_bytes", "n_tokens"] + (["fits"] if budget is not None else [])
    return in_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), count, ", ".join(f"{n} long" for n in names))


def prefix_tables(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and prefix_tokens: tokens of each prefix of the text by code points, from the empty prefix to the whole."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_of = counter(tokenizer)
        for batch in chunks(batches):
            rows = pa.array([count_of.table(t or "") for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows], names=["doc_id", "prefix_tokens"])

    return in_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), tables, "doc_id long, prefix_tokens array<long>")


def truncated(docs: DataFrame, tokenizer: str, budget: int) -> DataFrame:
    """``docs`` with every text cut to the longest prefix within ``budget`` tokens; other columns as they were."""
    schema, column = docs.schema, "text"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_of = counter(tokenizer)
        for batch in chunks(batches):
            texts = [t if t is None else t[: count_of.fits(t, budget)] for t in batch.column(column).to_pylist()]
            at = batch.schema.get_field_index(column)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return in_batches(docs, cut, schema)
