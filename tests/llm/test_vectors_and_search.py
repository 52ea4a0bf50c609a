"""Cap filters, whitening and ranked search against plain statements of them."""

import math
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import cases  # noqa: E402

from tideledger.llm import best_position, queries, spherical_caps, whitening  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int, kept string, n_links double, root int, node string, slice int"


def vectors(seed=3, dim=24):
    """Near copies in chains and bunches beside each other, copies, scaled copies, and vectors that link with nothing."""
    r = np.random.default_rng(seed)
    rows = [(1, None, 1), (2, [], 1), (3, [0.0] * dim, 1), (4, [None] + [1.0] * (dim - 1), 1), (5, [float("nan")] * dim, 1), (6, [float("inf")] + [0.0] * (dim - 1), 1), (7, [1.0, 2.0], 1), (8, [1.0, 2.0], 1), (9, [-3.0], 2), (10, [-1e-30], 2), (11, [1e30, 1e-30], 2), (None, [3.0, 4.0], 5), (None, [3.0, 4.0], 5)]
    n = 100
    for label in (1, 2, None, 3):
        for _ in range(6):
            x = r.standard_normal(dim)
            for i in range(8):
                rows.append((n := n + 1, (x * r.uniform(0.1, 5)).tolist(), label))
                x = x / np.linalg.norm(x) + r.standard_normal(dim) / math.sqrt(dim) * (0.12 if i % 3 else 0.17)
        x = r.standard_normal(dim)
        for _ in range(40):
            rows.append((n := n + 1, (x / np.linalg.norm(x) + r.standard_normal(dim) / math.sqrt(dim) * 0.1).tolist(), label))
        rows += [(n + 1, rows[-1][1], label), (n + 2, rows[-1][1], label), (n + 2, rows[-1][1], label), (n + 3, (np.array(rows[-1][1], np.float32) * np.float32(2)).tolist(), label)]
        n += 3
    rows.append((None, rows[-1][1], 3))
    rows.append((None, r.standard_normal(dim).tolist(), 3))
    return [(*x, "k", 0.5, 1, "n", 2) for x in rows]


def plain_links(rows, least=0.98):
    """(vec_id, n_links, component_id, kept) of each row, by comparing every two."""
    x = [np.array(e, np.float32).astype(float) if e is not None and None not in e else None for _, e, *_ in rows]
    ok = [v is not None and len(v) and np.isfinite(v).all() and v.any() and r[2] is not None for v, r in zip(x, rows, strict=True)]
    link = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / math.sqrt(x[i] @ x[i]) / math.sqrt(x[j] @ x[j]) >= least:
                link[i].append(j)
                link[j].append(i)
    out = Counter()
    for i, r in enumerate(rows):
        met, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in met:
                    met.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in met if rows[j][0] is not None]
        out[r[0], len(link[i]), min(ids, default=None), r[0] is not None and r[0] == min(ids)] += 1
    return out


@pytest.mark.parametrize("cell", [spherical_caps.CELL, 7])
def test_op11(spark, cell, monkeypatch):
    monkeypatch.setattr(spherical_caps.links, "__defaults__", (spherical_caps.MIN_COSINE, cell))
    rows = vectors()
    found = spherical_caps.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found) == plain_links(rows)
    assert max(r["n_links"] for r in found) > 20


def test_directions_meet_at_the_least_cosine():
    r = np.random.default_rng(5)
    for n in (500, 50_000, 3_000_000):
        blocks, size = spherical_caps.code_shape(n)
        x = r.standard_normal((3000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = r.standard_normal(x.shape)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.98 * x + math.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        a, b = spherical_caps.decoded(x, blocks, size), spherical_caps.decoded(y, blocks, size)
        met = [bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
        assert np.mean(met) > 0.999


def test_directions_are_the_best_of_all():
    r = np.random.default_rng(8)
    x = r.standard_normal((20, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotation, parts, lists = spherical_caps._code(10, 2, 32)
    y = x @ rotation
    every = (y[:, parts[0]] @ lists[0].T)[:, :, None] + (y[:, parts[1]] @ lists[1].T)[:, None, :]
    found = spherical_caps.decoded(x, 2, 32)
    for scores, numbers in zip(every.reshape(20, -1), found, strict=True):
        assert set(numbers) == set(np.argsort(-scores)[: len(numbers)])


def test_a_cell_counts_a_pair_once():
    unit = np.array([[1.0, 0], [1, 0], [0, 1], [1, 0]])
    node, root, links = spherical_caps.cell_links(np.array([5, 6, 7, 8]), np.array([1, 2, 4, 8]), unit, [np.array([3]), np.array([3]), np.array([3]), np.array([], int)], None, 0.98)
    assert node.tolist() == [5, 6, 8] and root.tolist() == [5, 5, 5] and links.tolist() == [8, 8, 3]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 30), st.integers(0, 10**6), st.sampled_from([1, 3, 200]))
def test_spectrum_against_a_direct_solver(dim, n, seed, most):
    x = np.random.default_rng(seed).integers(-most, most + 1, (n, dim)).astype(float)
    one, two = whitening.Spectrum.empty(dim), whitening.Spectrum.empty(dim)
    for i, row in enumerate(x):
        (one if i % 3 else two).add(row)
    one.combine(two)
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    top = max(1.0, np.abs(scatter).max())
    assert np.allclose(one.mean, x.mean(axis=0)) and one.n == n
    assert np.abs(one.values - np.linalg.eigvalsh(scatter)).max() < 1e-10 * top * dim
    assert np.abs(one.vectors * one.values @ one.vectors.T - scatter).max() < 1e-10 * top * dim
    assert np.abs(one.vectors.T @ one.vectors - np.eye(dim)).max() < 1e-10


def whitening_rows(dim=6):
    r = np.random.default_rng(4)
    scales = np.array([3.0, 2.0, 1.0, 0.5, 0.25, 0.1])[:dim]
    rows = [(i if i % 11 else None, (r.standard_normal(dim) * scales).tolist(), 1) for i in range(150)]
    rows += [rows[3], rows[3], (900, None, 1), (901, [None] * dim, 1), (902, [float("nan")] * dim, 1), (903, [1.0, 2.0], 1), (904, [], 1), (905, [float("-inf")] * dim, 1)]
    return [(*x, "k", 0.5, 1, "n", 2) for x in rows]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_op12(spark, parts):
    rows = whitening_rows()
    found = whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(parts)).collect()
    good = [(i, np.array(e, np.float32).astype(float)) for i, e, *_ in rows if e and None not in e and np.isfinite(e).all() and len(e) == 6]
    x = np.floor(64 * np.stack([e for _, e in good])) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    v = (x - s / n).T @ (x - s / n) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    white = (x - s / n) @ u / np.sqrt(e)
    assert len(found) == n * 6 and {r["n"] for r in found} == {n}
    assert max(r["identity_error"] for r in found) < 1e-9
    deviation = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s, strict=True)) for row in x]
    for k in range(6):
        got = sorted((r["vec_id"] is None, r["vec_id"], r["deviation"], round(r["whitened"], 7)) for r in found if r["component"] == k + 1)
        sign = [sorted((i is None, i, d, round(float(w) * f, 7)) for (i, _), d, w in zip(good, deviation, white[:, k], strict=True)) for f in (1, -1)]
        assert any(all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want, strict=True)) for want in sign)
        assert all(abs(r["explained"] - e[k] / e.sum()) < 1e-9 for r in found if r["component"] == k + 1)


def test_whitening_of_few_and_of_constant_rows(spark):
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["component"], r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in one] == [(1, 0.0, 0.0, 0, 0.0), (2, 0.0, 0.0, 0, 0.0)]
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<double>")).collect()
    assert {round(r["explained"], 9) for r in line} == {1.0, 0.0} and line[0]["identity_error"] < 1e-9
    huge = whitening.whitened(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in huge} == {0, None} and huge[0]["identity_error"] < 1e-9


def test_whitened_rows_of_long_vectors_stop_at_32(spark):
    r = np.random.default_rng(9)
    rows = [(i, r.standard_normal(40).tolist()) for i in range(120)]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(x["component"] for x in found) == {k: 120 for k in range(1, 33)}


def plain_search(docs, items, top=10):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    parts = [brute.words(t) for _, t in docs]
    n, total = sum(map(bool, parts)), sum(map(len, parts))
    times = [Counter(w) for w in parts]
    df = Counter(t for c in times for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for (doc, _), w, c in zip(docs, parts, times, strict=True):
            m = 10 + 90 * len(w) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(brute.words(text)) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc, score))
        for rank, (_, _, doc, score) in enumerate(sorted(found)[:top], 1):
            out[item, rank, doc, score] += 1
    return out


@pytest.mark.parametrize(("docs_", "places", "block"), [(8192, 2_000_000, 8 << 20), (5, 2_000_000, 300), (8192, 40, 8 << 20)])
def test_op13(spark, docs_, places, block, monkeypatch):
    monkeypatch.setattr(best_position, "SHARD_DOCS", docs_)
    monkeypatch.setattr(best_position, "SHARD_PLACES", places)
    monkeypatch.setattr(best_position, "BLOCK_BYTES", block)
    rows = cases.documents()
    items = [*cases.benchmark(rows), (11, cases.sentence(random.Random(2), 30)), (11, cases.sentence(random.Random(2), 30)), (12, "zzz unknown")]
    found = best_position.search(spark.createDataFrame(rows, cases.SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found) == plain_search([(r[0], r[1]) for r in rows], items)
    assert len({r["item_id"] for r in found}) >= 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=6), min_size=1, max_size=40), st.lists(st.integers(0, 6), min_size=1, max_size=6, unique=True), st.integers(1, 4))
def test_best_positions_against_all_scores(docs, item, top):
    doc = np.array([d for d, ts in enumerate(docs) for _ in set(ts)], np.int64)
    term = np.array([t for ts in docs for t in set(ts)], np.int64)
    impact = np.array([10 * (1 + t) * ts.count(t) // (1 + ts.count(t)) for ts in docs for t in set(ts)], np.int64)
    shard = best_position.Shard(np.arange(len(docs)), np.zeros(len(docs), bool), doc, term, impact, 7)
    for _ in range(2):  # nothing stays behind from the first
        best = best_position.Best(top)
        shard.search(np.array(sorted(item)), best)
        score = Counter()
        for d, t, x in zip(doc.tolist(), term.tolist(), impact.tolist(), strict=True):
            if t in item:
                score[d] += x
        assert list(zip(best.ids.tolist(), best.score.tolist(), strict=True)) == sorted(((d, s) for d, s in score.items() if s > 0), key=lambda x: (-x[1], x[0]))[:top]


def test_search_stops_before_the_end_of_the_lists():
    n = 4096
    doc, term = np.tile(np.arange(n), 2), np.repeat([0, 1], n)
    impact = np.concatenate([np.arange(n, 0, -1), np.arange(n, 0, -1)])
    best = best_position.Best(10)
    assert best_position.Shard(np.arange(n), np.zeros(n, bool), doc, term, impact, 2).search(np.array([0, 1]), best) < 64
    assert best.ids.tolist() == list(range(10))


def test_empty_vectors(spark, tmp_path):
    spark.createDataFrame([], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op11_spherical_caps", "op12_whitening"):
        assert queries.queries()[name](spark, str(tmp_path)).count() == 0
