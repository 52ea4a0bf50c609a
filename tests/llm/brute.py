"""Plain statements of the operators, a text at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

UPPER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BLANK = re.compile("[^\x20\x09-\x0d]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def tokens(text):
    return BLANK.findall((text or "").translate(UPPER))


def contamination(text, items):
    w = words(text)
    hit, found = set(), set()
    for item_id, item in items:
        v = words(item)
        n = min(10, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item_id)
    return len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)


class Ngrams:
    """Interpolated modified Kneser-Ney by dictionaries: counts at the highest order, numbers of different words before below."""

    def __init__(self, texts, order):
        self.order, self.times = order, Counter()
        top = Counter()
        for t in texts:
            line = [0] * (order - 1) + [*tokens(t), 1]
            for i in range(order - 1, len(line)):
                top[tuple(line[i - order + 1 : i + 1])] += 1
                self.times[line[i]] += 1
        self.n = sum(self.times.values())
        self.counts = {order: top}
        for m in range(order - 1, 0, -1):
            self.counts[m] = Counter(g[1:] for g in self.counts[m + 1])
        self.after = {m: defaultdict(Counter) for m in self.counts}
        for m, c in self.counts.items():
            for g, k in c.items():
                self.after[m][g[:-1]][g[-1]] = k
        self.d = {m: self._discounts(c) for m, c in self.counts.items()}

    @staticmethod
    def _discounts(counts):
        of = Counter(counts.values())
        n1, n2, n3, n4 = (of[i] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
        return [0.0, *(min(max(x, 0.05 * i), 0.95 * i) for i, x in enumerate(d, 1))]

    def probability(self, context, w):
        m = len(context) + 1
        seen, d = self.after[m].get(context), self.d[m]
        lower = self.probability(context[1:], w) if m > 1 else 1 / (len(self.times) + 1)
        if not seen:
            return lower
        total = sum(seen.values())
        return max(seen[w] - d[min(seen[w], 3)], 0) / total + sum(d[min(k, 3)] for k in seen.values()) / total * lower

    def score(self, text):
        base = score = 0.0
        known, line = 0, [0] * (self.order - 1) + [*tokens(text), 1]
        for i in range(self.order - 1, len(line)):
            w = line[i]
            base += math.log10((self.times[w] + 0.1) / (self.n + 0.1 * (len(self.times) + 1)))
            score += math.log10(self.probability(tuple(line[i - self.order + 1 : i]), w))
            known += self.times[w] > 0
        return len(line) - self.order + 1, known, base, score


def remainder(doc_id, n):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % n


def quality(text):
    text = text or ""
    w = BLANK.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLANK.search(line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(runs)
    rep = set()
    for i, r in enumerate(runs):
        if n[r] > 1:
            rep.update((i, i + 1, i + 2))
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), failed


def secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ("assign", "access", "hex")
    return [f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(out)]


def licences(text):
    w = words(text)
    at, labels = [], set()
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def simhash(text):
    w = tokens(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """rows: (doc_id, fingerprint); component of each by comparing every two."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(rows))]


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    text = text or ""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and _luhn(d):
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def slot_shares(text):
    """Share of a text's n-grams in each slot, a dictionary for each group; the slot of a gram by the operators' hash of it alone."""
    import numpy as np

    from tideledger.llm import hashed_features as h
    from tideledger.llm.textbatch import LOWER, gram_hashes, span_hashes

    data = (text or "").encode()
    lower = bytes(LOWER[np.frombuffer(data, np.uint8)].tolist())
    hashes = [int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in re.findall(rb"[^\x20\x09-\x0d]+", lower)]
    words = [x >> (64 - h.SLOT_BITS) for x in hashes]
    pairs = [h._SAME_WORD if a == b else h.SLOTS + (int(gram_hashes(np.array([a, b], np.uint64), 2)[0]) >> (64 - h.SLOT_BITS)) for a, b in zip(hashes, hashes[1:])]

    def character(codes, group):
        return [group * h.SLOTS + ((c * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - h.SLOT_BITS)) for c in codes]

    kinds = [int(h._CLASS[b]) for b in data]
    three = character([data[i] << 16 | data[i + 1] << 8 | data[i + 2] for i in range(len(data) - 2)], 2)
    four = character([kinds[i] << 15 | kinds[i + 1] << 10 | kinds[i + 2] << 5 | kinds[i + 3] for i in range(len(data) - 3)], 3)
    return [{k: n / len(g) for k, n in Counter(map(int, g)).items()} for g in (words, pairs, three, four)]


def raw_score(text, weights):
    return sum(share * weights[slot] for group in slot_shares(text) for slot, share in group.items())


def random_runs(text, encoding):
    """Runs of key characters that take too many tokens, away from the fixed patterns' spans."""
    text = text or ""
    taken = [tuple(map(int, x.split(":")[1:])) for x in secrets(text)]
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        run = m[0]
        if any(a < m.end() and m.start() < b for a, b in taken) or not re.search("[0-9]", run) or not re.search("[A-Za-z]", run):
            continue
        if len(run) in (32, 40, 56, 64, 96, 128) and re.fullmatch("[0-9a-fA-F]+", run) or re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", run):
            continue
        parts = [p for p in re.split("[_/=+-]+", run) if p]
        plain = run[0].isalnum() and all(re.fullmatch("[A-Z]{2,}|[A-Za-z][a-z]*|[0-9]{1,8}", p) for p in parts)
        if not plain and len(run) / len(encoding.encode_ordinary(run)) < 2.4:
            out.append(f"random:{m.start()}:{m.end()}")
    return out
