"""Disclosing terms against a plain statement of the rule, and the search for unlike contexts."""

import math
import random
import re
import sys
import time
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tideledger.llm import pii  # noqa: E402

ENTITY = re.compile(r"[a-z0-9]+@[a-z0-9]+\.[a-z]+")


def plain_disclosing(texts):
    """Terms that disclose a subject, by the rule's words; texts hold lower-case words and addresses only."""
    lines = [[w for w in t.split() if len(w) >= 2] for t in texts]
    docs_of, seen = defaultdict(list), Counter()
    for d, line in enumerate(lines):
        for e in {w for w in line if ENTITY.fullmatch(w)}:
            docs_of[e].append(d)
        seen.update(w for w in line if ENTITY.fullmatch(w))
    subjects = defaultdict(set)
    for e, ds in docs_of.items():
        if seen[e] >= 3:
            subjects[tuple(ds)].add(e)
    words = [Counter(w for w in line if not ENTITY.fullmatch(w)) for line in lines]
    df = Counter(t for c in words for t in c)
    out = set()
    for ds, names in subjects.items():
        for t in {t for d in ds for t in words[d]}:
            together = [d for d in ds if words[d][t]]
            p, share = len(ds) / len(texts), len(together) / df[t]
            bits = math.log2(share / p)
            evidence = len(together) * bits + ((df[t] - len(together)) * math.log2((1 - share) / (1 - p)) if share < 1 else 0)
            if sum(words[d][t] for d in together) < 3 or share < 0.5 or not (bits >= 6 or bits > 0 and bits >= -math.log2(p) / 2 and evidence >= 18):
                continue
            contexts = set()
            for d in together:
                plain, spots = [], []
                for w in lines[d]:
                    if ENTITY.fullmatch(w):
                        spots += [len(plain)] if w in names else []
                    else:
                        plain.append(w)
                places = [j for j, w in enumerate(plain) if w == t]
                around = {j: frozenset(plain[max(0, j - 8) : j + 9]) - {t} for j in places}
                near = [j for j in places if any(x - 8 <= j < x + 8 for x in spots)]
                contexts |= {around[j] for j in near} if near else {frozenset().union(*around.values())}
            contexts.discard(frozenset())
            if any(all(3 * len(a & b) < min(len(a), len(b)) for a, b in combinations(three, 2)) for three in combinations(contexts, 3)):
                out.add(t)
    return out


def masked(spark, texts):
    found = {r["doc_id"]: r["terms"] for r in pii.personal_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return [sorted(t[x["start"] : x["end"]] for x in found[i]) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", range(4))
def test_terms_of_random_corpora(spark, seed):
    rng = random.Random(seed)
    common, rare = [f"w{i}" for i in range(60)], [f"r{i}" for i in range(12)]
    names = ["ann@x.org", "bob@x.org", "cy@y.net", "di@z.com"]
    passages = [" ".join(rng.choices(common, k=12)) for _ in range(3)]
    texts = []
    for _ in range(90):
        line = rng.choices(common, k=rng.randint(4, 20))
        if rng.random() < 0.5:
            at = rng.randrange(len(line))
            who = rng.randrange(4)
            line[at:at] = [rng.choice(rare[3 * who : 3 * who + 3]) for _ in range(rng.randint(1, 3))] + [names[who]] * rng.randint(1, 2) + (["eve@q.io"] if who == 2 else [])
        if rng.random() < 0.3:
            line += rng.choice(passages).split() + [rng.choice(rare), rng.choice(names)]
        texts.append(" ".join(line))
    texts += texts[:5] + [" ".join(rng.choices(common, k=10)) for _ in range(300)]
    want = plain_disclosing(texts)
    assert masked(spark, texts) == [sorted(w for w in t.split() if w in want) for t in texts]
    assert want


def some(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_a_document_more_unmasks_nothing(spark):
    rng = random.Random(2)
    beside = [some(rng, 14) for _ in range(3)]
    texts = [" ".join([*b[:7], "zorblax", "zed@example.org", *b[7:]]) for b in beside]
    rest = [" ".join(some(rng, 20)) for _ in range(600)]
    assert masked(spark, texts + rest)[:3] == [["zorblax"]] * 3
    mixed = [w for b in beside for w in b[4:10]]
    fourth = " ".join([*mixed[:8], "zorblax", "zed@example.org", *mixed[8:16]])
    assert masked(spark, [*texts, fourth, *rest])[:4] == [["zorblax"]] * 4


@settings(max_examples=200, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 9), min_size=1, max_size=6), max_size=12))
def test_three_unlike(sets):
    want = any(all(3 * len(a & b) < min(len(a), len(b)) for a, b in combinations(three, 2)) for three in combinations(sets, 3))
    assert pii.three_unlike([np.array(sorted(s)) for s in sets]) == want


@pytest.mark.parametrize("size", [1, 2, 4])
def test_contexts_in_slices(spark, monkeypatch, size):
    monkeypatch.setattr(pii, "SLICE", size)
    rng = random.Random(size)
    rows, want = [], set()
    for pair in range(40):
        sets = {frozenset(rng.sample(range(16), rng.randint(2, 5))) for _ in range(rng.randint(1, 9))}
        rows += [(pair % 7, pair, sorted(s)) for s in sets for _ in range(2)]
        if any(all(3 * len(a & b) < min(len(a), len(b)) for a, b in combinations(three, 2)) for three in combinations(sets, 3)):
            want.add((pair % 7, pair))
    rows.append((1, 99, []))
    found = pii._in_unlike_contexts(spark.createDataFrame(rows, "subject long, term long, context array<long>")).collect()
    assert {(r["subject"], r["term"]) for r in found} == want and 5 < len(want) < 40


def test_long_lists_of_addresses_in_three_copies(spark):
    rng = random.Random(9)
    page = " ".join(f"{' '.join(some(rng, 3))} a{i}@example.org" for i in range(10_000))
    other = " ".join(f"{' '.join(some(rng, 3))} {a}@example.org" for i in range(2_000) for a in (f"a{i}", f"b{i}"))
    texts = [page, page, f"{page} end", other, f"{other} more", f"{other} still", *(" ".join(some(rng, 30)) for _ in range(50))]
    began = time.time()
    assert not any(masked(spark, texts)[6:])
    assert time.time() - began < 60


def test_sanitised_keeps_rows_of_one_hash_and_other_ids_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(pii, "row_key", lambda: F.xxhash64(F.length("text")))
    rng = random.Random(12)
    texts = [" ".join([*some(rng, 7), "zorblax", "zed@example.org", *some(rng, 7)]) for _ in range(4)]
    size = len(texts[0])
    texts += [("x " * size)[:size], *(" ".join(some(rng, 20)) for _ in range(500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[4] == texts[4]
    assert brute.personal(texts[0])
