"""Each numbered operator against its plain statement, on a table of special cases."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import cases  # noqa: E402

from tideledger.llm import decontaminate, licenses, mixing, ngram_lm, pairwise_quality, pii, quality_rules, queries, secrets, simhash, token_prefix  # noqa: E402


@pytest.fixture(scope="module")
def rows():
    return cases.documents()


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, cases.SCHEMA).coalesce(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(cases.labels(rows), "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(cases.benchmark(rows), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], cases.SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


def got(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", list(queries.queries()))
def test_empty_tables(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0


def test_documents_without_the_other_table(spark, tables, empty, rows):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    none = spark.read.parquet(f"{empty}/benchmark.parquet")
    assert decontaminate.contamination(docs, none).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminated(docs, none).count() == len(rows)
    labels = spark.read.parquet(f"{empty}/labels.parquet")
    assert {r["score"] for r in pairwise_quality.quality_scores(docs, pairwise_quality.trained(docs, labels)).collect()} == {0.5}
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.quality_rules(docs, quality_rules.trained(docs, labels)).collect())


def test_op1(spark, tables, rows):
    items = [(i, t) for i, t in cases.benchmark(rows)]
    want = Counter()
    for r in rows:
        n, hit, _, _, flag = brute.contamination(r[1], items)
        named = brute.contamination(r[1], [x for x in items if x[0] is not None])
        want[r[0], n, hit, named[2], named[3], flag] += 1
    assert got(queries.op1_decontamination(spark, tables), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert sum(n for k, n in want.items() if k[-1]) >= 12


def test_op1_join_without_broadcast(spark, tables, rows, monkeypatch):
    want = got(queries.op1_decontamination(spark, tables), "doc_id", "n_hit", "items_sha256")
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    assert got(queries.op1_decontamination(spark, tables), "doc_id", "n_hit", "items_sha256") == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=10, max_size=10), st.lists(st.sampled_from("abc"), max_size=25), st.lists(st.sampled_from("abc"), max_size=25))
def test_op1_every_shared_window_has_a_fingerprint(shared, left, right):
    import numpy as np

    from tideledger.llm.textbatch import mix

    def prints(words):
        h = mix(np.array([ord(w) for w in words], np.uint64))
        return {(int(fp), int(at)) for f, a, _, _ in decontaminate._fingerprints(h, np.array([0, len(h)]), []) for fp, at in zip(f, a + 5, strict=True)}

    a = {(fp, at - len(left)) for fp, at in prints([*left, *shared]) if at >= len(left)}
    b = {(fp, at) for fp, at in prints([*shared, *right]) if at <= 5}
    assert a & b


def test_op2(spark, tables, rows):
    model = brute.Ngrams([r[1] for r in rows if brute.remainder(r[0], 10)], ngram_lm.ORDER)
    got = queries.op2_lm_scoring(spark, tables).collect()
    assert len(got) == len(rows)
    found = {(r["doc_id"], r["n_tokens"], round(r["score"], 6)): r for r in got}
    for r in rows:
        n, known, base, score = model.score(r[1])
        row = found[r[0], n, round(score, 6)]
        assert (row["n_known"], row["train_tokens"], row["held_out"]) == (known, model.n, brute.remainder(r[0], 10) == 0)
        assert row["base_score"] == pytest.approx(base, rel=1e-9)


@pytest.mark.parametrize("order,step,held,block", [(1, 12, 3_000_000, 1_200_000), (2, 12, 40, 300), (3, 2, 40, 300), (4, 12, 3_000_000, 1_200_000)])
def test_op2_orders_and_steps(spark, rows, monkeypatch, order, step, held, block):
    monkeypatch.setattr(ngram_lm, "STEP_BITS", step)
    for texts in ([r[1] for r in rows[:40]], []):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        model = ngram_lm.trained(docs, order=order)
        plain = brute.Ngrams(texts, order)
        every = [r[1] for r in rows[:60]]
        got = {r["doc_id"]: r for r in ngram_lm.scores(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string"), model).collect()}
        for i, t in enumerate(every):
            n, known, base, score = plain.score(t)
            assert (got[i]["n_tokens"], got[i]["n_known"]) == (n, known)
            assert got[i]["base_score"] == pytest.approx(base, rel=1e-9) and got[i]["score"] == pytest.approx(score, rel=1e-9, abs=1e-9)
        model.files.delete()


def test_op2_bounded_merges_give_the_same_sums(monkeypatch):
    import numpy as np

    monkeypatch.setattr(ngram_lm, "HELD_ROWS", 50)
    rng = np.random.default_rng(3)
    words = np.sort(rng.choice(2**48, 90, replace=False).astype(np.uint64))
    codes = ngram_lm.Codes(words[:30], words[:2], 4)
    rows = [rng.integers(0, 90, (40, 2)) for _ in range(30)]
    blocks = [ngram_lm._pack(*(codes.of(words[r[:, j]]) for j in (0, 1)), np.ones(40, np.uint64)) for r in rows]
    got = Counter()
    for coded, (n,) in ngram_lm._pieces(iter(blocks), 2, codes):
        for a, b, k in zip(*(codes.words(c).tolist() for c in coded), n.tolist(), strict=True):
            got[a, b] += k
    assert got == Counter((int(words[a]), int(words[b])) for r in rows for a, b in r)


@pytest.mark.parametrize("mapped", [True, False])
def test_op2_holds_few_files_of_thousands(monkeypatch, mapped):
    import numpy as np

    monkeypatch.setattr(ngram_lm, "MAPS", 16)

    class Many:
        def read(self, name):
            n = int(name.split("-")[1])
            return np.concatenate([np.ascontiguousarray(x).view(np.uint8) for x in ngram_lm._table(np.array([n << 24], np.uint64), [np.array([n], np.uint64)])])

    Many.mapped = mapped
    model = ngram_lm.KneserNey(3, Many(), frozenset(f"3-{i}" for i in range(5000)), ngram_lm.Codes(np.array([1], np.uint64), np.zeros(0, np.uint64), 4), {})
    for i in (*range(5000), 0, 4999):
        _, _, columns, big = model._arrays(f"3-{i}", 1)
        assert (big[0][1][0] if columns[0][0] == 255 else columns[0][0]) == i
        assert len(model._maps) <= 16


def test_op2_probabilities_sum_to_one():
    model = brute.Ngrams(["a b a c", "b a b", "c"], 3)
    for h in ((0, 0), (0, "a"), ("a", "b"), ("b", "a"), ("c", "unseen")):
        assert sum(model.probability(h, w) for w in [*model.times, "unknown"]) == pytest.approx(1)


def test_op2_blocks_and_tables_round_trip():
    import numpy as np

    for c in ([0], [1, 255, 254], [1] * 500 + [70_000], list(range(1000)), [2**47, 3], [2**63]):
        a = np.array(c, np.uint64)
        assert (ngram_lm._unpack(ngram_lm._pack(a, a))[1] == a).all()
    # grams that share 32 bits of their hash, and counts beyond four bytes
    hashes = np.sort(np.array([5 << 32 | i << 24 for i in range(200)] + [2**40, 2**63], np.uint64))
    values = np.arange(len(hashes), dtype=np.uint64) * np.uint64(10**8) * np.uint64(10**3)
    raw = np.concatenate([np.ascontiguousarray(x).view(np.uint8) for x in ngram_lm._table(hashes, [values])])

    class One:
        mapped = True
        read = staticmethod(lambda name: raw)

    model = ngram_lm.KneserNey(3, One(), frozenset(["3-0"]), ngram_lm.Codes(np.array([1], np.uint64), np.zeros(0, np.uint64), 4), {})
    high, low, columns, big = model._arrays("3-0", 1)
    assert (high == hashes >> np.uint64(32)).all() and (columns[0] == np.minimum(values, 255)).all() and (big[0][1] == values[values > 254]).all()


def test_op2_blocks_are_packed_together(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    n = 5000
    columns = [rng.integers(0, 200, n).astype(np.uint64), rng.integers(0, 1 << 48, n).astype(np.uint64), np.where(rng.random(n) < 0.01, 1 << 63, 7).astype(np.uint64)]
    cut = np.array([0, 1, 2, 700, 4999])
    blocks = ngram_lm._packs(columns, cut)
    for block, a, b in zip(blocks, cut, [*cut[1:], n], strict=True):
        assert all((x == c[a:b]).all() for x, c in zip(ngram_lm._unpack(block), columns, strict=True))
    # all blocks of a deal are laid out in one pass over each column, whatever their number
    passes = []
    monkeypatch.setattr(ngram_lm, "_packs", lambda *x, packs=ngram_lm._packs: passes.append(1) or packs(*x))
    codes = ngram_lm.Codes(columns[1][:30], np.zeros(0, np.uint64), 6)
    ids, _, blocks = ngram_lm._dealt(ngram_lm._GRAMS, [codes.of(columns[1]), codes.of(columns[1][::-1])], [columns[0]], codes, 6)
    assert len(ids) == len(set(ids)) == len(blocks) == 64 and len(passes) == 1
    assert sorted(np.concatenate([codes.words(ngram_lm._unpack(b)[0]) for b in blocks]).tolist()) == sorted(columns[1].tolist())


def test_op2_codes_of_words_that_begin_alike():
    import numpy as np

    words = np.concatenate([np.arange(50, dtype=np.uint64), np.uint64(1 << 47) + np.arange(50, dtype=np.uint64) * np.uint64(3), np.array([(1 << 48) - 1], np.uint64)])
    known = np.random.default_rng(1).permutation(words)[:60]
    number = {w: i for i, w in enumerate(known.tolist())}
    codes = ngram_lm.Codes(known, np.zeros(0, np.uint64), 4)
    assert codes.of(words).tolist() == [number.get(w, w + ngram_lm.CODED + 1) for w in words.tolist()]
    assert (codes.words(codes.of(words)) == words).all()


def test_op2_a_shard_that_cannot_be_read_fails(spark, tables, monkeypatch):
    import numpy as np

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = ngram_lm.trained(docs)
    assert model._arrays("3-none", 1) is None and not model.scored(np.array([12345], np.uint64), np.array([0, 1]))[2].any()

    def broken(self, name):
        raise OSError(28, "No space left on device")

    monkeypatch.setattr(ngram_lm.SharedArrays, "read", broken)
    model._maps.clear()
    with pytest.raises(OSError):
        model.scored(np.array([ngram_lm.END]), np.array([0, 1]))
    monkeypatch.undo()
    model.files.delete()
    with pytest.raises(OSError):
        model.scored(np.array([ngram_lm.END]), np.array([0, 1]))


def test_hashes_of_long_texts_in_stretches(monkeypatch):
    import numpy as np

    from tideledger.llm import textbatch

    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    cuts = np.sort(rng.choice(4000, 40, replace=False))
    starts, ends = np.array([0, *cuts]), np.array([*cuts, 4000])
    want = textbatch.span_hashes(data, starts, ends)
    monkeypatch.setattr(textbatch, "HASH_BYTES", 64)
    textbatch._powers.cache_clear()
    got = textbatch.span_hashes(data, starts, ends)
    textbatch._powers.cache_clear()
    assert (got == want).all()


def test_op3(spark, tables, rows):
    found = queries.op3_source_mix(spark, tables).collect()
    assert len(found) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(brute.BLANK.findall(r[1] or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    cut, total = {}, sum(size.values())
    while True:
        rest = [s for s in order if s not in cut]
        each = (total - sum(cut.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if weight[s] * each > 3 * size[s] or weight[s] * each == 3 * size[s]]
        if not over:
            break
        cut |= {s: 3 * size[s] for s in over}
    target = {s: cut.get(s, weight[s] * each) for s in order}
    sources = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
    for f in found:
        r = by_doc[f["doc_id"]][0]
        assert f["source_size"] == size[r[3]] and f["target"] == pytest.approx(target[r[3]])
        assert 0 <= f["taken"] <= 3 * f["size"]
        sources[r[3]].append(f["taken"])
    for s, taken in sources.items():
        assert abs(sum(taken) - target[s]) <= max(6, 0.02 * target[s])
    again = queries.op3_source_mix(spark, tables)
    assert got(again, "doc_id", "size", "taken") == Counter((f["doc_id"], f["size"], f["taken"]) for f in found)


def test_op3_schedule_is_even(spark):
    sources = spark.createDataFrame([(0, 0, 100), (1, 100, 400), (2, 400, 1000)], "number long, lo long, hi long")
    slots = mixing.schedule(sources, 1000).collect()
    assert len(slots) == 1000
    for number, n in ((0, 100), (1, 300), (2, 600)):
        mine = sorted((r["slot"], r["rank"]) for r in slots if r["number"] == number)
        assert [k for _, k in mine] == list(range(len(mine))) and abs(len(mine) - n) <= 3


def test_op4(spark, tables, rows):
    found = queries.op4_quality_rules(spark, tables)
    want = Counter((r[0], *brute.quality(r[1])) for r in rows)
    assert got(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert all(not (r["kept"] and r["base_failed"]) and 0 <= r["probability"] <= 1 for r in found.collect())


def test_op5(spark, tables, rows):
    want = Counter((r[0], brute.sha(",".join(brute.secrets(r[1])))) for r in rows)
    found = queries.op5_secret_scan(spark, tables)
    assert got(found, "doc_id", "base_sha256") == want
    for r in found.collect():
        base = [s for s in r["spans"].split(",") if s and not s.startswith("random")]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
        assert brute.sha(",".join(base)) == r["base_sha256"]


def test_op5_random_spans_against_brute_force(spark, rows):
    rng = __import__("random").Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [r[1] for r in rows]
    for _ in range(150):
        key = "".join(rng.choice(letters) for _ in range(rng.randint(18, 44)))
        name = rng.choice(["-", "_", "/"]).join(rng.choice(["user", "Default", "USER", "2024", "path", "v2"]) for _ in range(rng.randint(3, 8)))
        texts.append(f"see {key} and {name}, token={key[:8]} d41d8cd98f00b204e9800998ecf8427e {key}-{name}")
    encoding = secrets._encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = {r["doc_id"]: r["spans"] for r in secrets.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert [x for x in found[i].split(",") if x.startswith("random")] == brute.random_runs(t, encoding), t


def test_op5_random_strings():
    encoding = secrets._encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert secrets.is_random("xK9vQ2mWzL7pRt4YbN8cJf3H", encoding) and secrets.is_random("A-" * 20_000 + "1a1b", encoding)
    for plain in ("internationalization2024", "user_profile_settings_2", "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "aaaaaaaaaaaaaaaaaaaaaaaa", "A-" * 20_000 + "B", "USER_NAME-default-2024/Path"):
        assert not secrets.is_random(plain, encoding)


def test_op6(spark, tables, rows):
    found = queries.op6_license_scan(spark, tables)
    assert got(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == Counter((r[0], *brute.licences(r[1])) for r in rows)
    for r in found.collect():
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_op6_longer_rules_suppress_what_they_contain(spark):
    texts = ["Licensed under the Apache License, Version 2.0", "GNU Lesser General Public License v2.1", "SPDX-License-Identifier: GPL-3.0-or-later", "the mitigation of licences", "BSD 3-clause"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {r["doc_id"]: r["labels"] for r in licenses.license_scan(docs).collect()}
    assert labels == {0: "apache,apache-2.0", 1: "lgpl-2.1", 2: "gpl-3.0-or-later", 3: "", 4: "bsd-3-clause"}


TEXTS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "bsd,bsd-3-clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software",
    "apache-2.0": "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl,gpl-3.0-or-later": "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl,lgpl-2.1": "released under the LGPL v2.1",
    "cc-by-4.0": "see https://creativecommons.org/licenses/by/4.0/ for terms",
    "gpl-2.0-only": "SPDX-License-Identifier: GPL-2.0-only",
    "proprietary": "Copyright (c) 2019 Example Works Ltd. All rights reserved.",
    "": "the as is of it and the redistributions",
}


def plain_labels(text):
    """Every rule on its own by Python's patterns, then suppression by comparing every two matches."""
    import re

    flat = " ".join(["", *brute.words(text), ""]) or " "
    found = []
    for number, priority, _, _, pattern, label, _, _ in licenses.rules():
        found += [(m.start(), m.end(), priority, number, label) for m in re.finditer(pattern, flat)]

    def hidden(a, b):
        if b[2] < a[2] or b[1] < a[1]:
            return False
        return (b[0], -b[1], -b[2], b[3]) < (a[0], -a[1], -a[2], a[3])

    own = {a[4] for a in found if not any(hidden(a, b) for b in found)}
    return ",".join(sorted(own | set(filter(None, brute.licences(text)[4].split(",")))))


def test_op6_texts_and_notices(spark, rows):
    texts = [*TEXTS.values(), *(r[1] for r in rows), " ".join(TEXTS.values()), " x ".join([*TEXTS.values()] * 40), "MIT License " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {r["doc_id"]: r["labels"] for r in licenses.license_scan(docs).collect()}
    assert [labels[i] for i in range(len(TEXTS))] == list(TEXTS)
    for i, t in enumerate(texts[:-2]):
        assert labels[i] == plain_labels(t), t
    assert labels[len(texts) - 1] == "mit" and set(labels[len(texts) - 2].split(",")) >= {x for k in TEXTS for x in k.split(",") if x}


def shortest(pattern):
    """A text that the pattern matches: first branches, least repetitions, no optional parts."""
    from re import _parser as parser

    def text(parts):
        out = []
        for op, arg in parts:
            name = str(op)
            if name == "LITERAL":
                out.append(chr(arg))
            elif name == "NOT_LITERAL":
                out.append("q")
            elif name == "IN":
                out.append({"LITERAL": lambda a: chr(a), "RANGE": lambda a: chr(a[0]), "NEGATE": lambda a: "q"}[str(arg[0][0])](arg[0][1]))
            elif name == "BRANCH":
                out.append(text(arg[1][0]))
            elif name == "SUBPATTERN":
                out.append(text(arg[3]))
            elif name == "MAX_REPEAT":
                out.append(text(arg[2]) * arg[0])
            else:
                raise ValueError(name)
        return "".join(out)

    return text(parser.parse(pattern)).strip()


def test_op6_every_rule_fires_alone(spark):
    every = licenses.rules()
    texts = [shortest(r[4]) for r in every]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_scan(docs).collect()}
    for i, t in enumerate(texts):
        assert found[i][0] == plain_labels(t) and found[i][0] and found[i][1] > 0, (every[i], t, found[i])
    # the label of a signature is there, or that of a longer one over the same words
    alone = [i for i, r in enumerate(every) if r[5] in found[i][0].split(",")]
    assert len(alone) > 0.95 * len(every)


def test_op6_rules_are_unlike():
    every = [(r[4], r[2]) for r in licenses.rules()]
    assert len(set(every)) > 500 and len({x[2] for x in licenses.SIGNATURES}) == len(licenses.SIGNATURES)


def test_op7(spark, tables, rows):
    prints = [(r[0], brute.simhash(r[1])) for r in rows]
    want = Counter((d, f"{fp:016x}", c) for (d, fp), c in zip(prints, brute.components(prints), strict=True))
    assert got(queries.op7_simhash(spark, tables), "doc_id", "fingerprint", "component_id") == want


def test_op7_clusters_in_slices(spark):
    import random

    rng = random.Random(2)
    fps = []
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            fps.append(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(set(fps))
    signed = [simhash._signed(x) for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(table, cell=7)).collect()}
    groups = defaultdict(set)
    for x in signed:
        groups[found.get(x, x)].add(x)
    want = defaultdict(set)
    for (i, x), c in zip(enumerate(signed), brute.components(list(enumerate(fps))), strict=True):
        want[c].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_op8(spark, tables, rows):
    want = Counter((r[0], brute.sha(",".join(brute.personal(r[1])))) for r in rows)
    found = queries.op8_pii(spark, tables)
    assert got(found, "doc_id", "base_sha256") == want
    for r in found.collect():
        base = [s for s in r["spans"].split(",") if s and not s.startswith("term")]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s.startswith(k) for s in base) for k in pii.KINDS)


def test_op8_terms_that_give_an_entity_away(spark):
    rng = __import__("random").Random(3)
    rows = [(i, f"{cases.sentence(rng, 6)} Zorblax wrote to zed@example.org {cases.sentence(rng, 6)}") for i in range(5)]
    rows += [(i, cases.sentence(rng, 30) + " and more") for i in range(5, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["terms"] for r in pii.personal_spans(docs).collect()}
    texts = dict(rows)
    for i in range(5):
        assert "Zorblax" in [texts[i][t["start"] : t["end"]] for t in found[i]]
    assert not any(found[i] for i in range(5, 400))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert all("zed@" not in clean[i] and "Zorblax" not in clean[i] for i in range(5)) and all(clean[i] == texts[i] for i in range(5, 400))


def test_op8_terms_with_capitals_outside_ascii(spark):
    rng = __import__("random").Random(4)
    names = ["Østergaard", "Élodie", "Жанна", "Ωmega"]
    rows = [(i, f"{cases.sentence(rng, 6)} {names[i % 4]} wrote to zed{i % 4}@example.org {cases.sentence(rng, 6)}") for i in range(20)]
    rows += [(i, cases.sentence(rng, 30)) for i in range(20, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["terms"] for r in pii.personal_spans(docs).collect()}
    assert all(names[i % 4] in [rows[i][1][t["start"] : t["end"]] for t in found[i]] for i in range(20))


def disclosed(spark, texts):
    """The terms masked in each text."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["terms"] for r in pii.personal_spans(docs).collect()}
    return [[t[x["start"] : x["end"]] for x in found[i]] for i, t in enumerate(texts)]


def test_op8_thousands_of_different_contexts(spark):
    rng = __import__("random").Random(5)

    def some(n):
        return " ".join(f"w{rng.randrange(1000)}" for _ in range(n))

    texts = [f"{some(7)} Zorblax zed@example.org {some(8)}" for _ in range(3000)] + [some(16) for _ in range(4000)]
    masked = disclosed(spark, texts)
    assert all(m == ["Zorblax"] for m in masked[:3000]) and not any(masked[3000:])


def test_op8_near_copies_of_a_passage_are_one_context(spark):
    rng = __import__("random").Random(6)
    passage = [f"p{i}" for i in range(24)]
    texts = []
    for i in range(300):
        words = list(passage)
        words[rng.randrange(24)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join([*words[:12], "zed@example.org", *words[12:]]))
    page = [f"q{i}" if i % 50 else "Zorblax" for i in range(300)]
    for i in range(60):
        words = list(page)
        words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join([*words[:225], "page@example.org", *words[225:]]))
    texts += [cases.sentence(rng, 20) for _ in range(20_000)]
    assert not any(disclosed(spark, texts))


def test_op8_disclosing_terms_are_masked_wherever_they_stand(spark):
    rng = __import__("random").Random(7)

    def some(n):
        return " ".join(f"w{rng.randrange(1000)}" for _ in range(n))

    texts = [f"Zorblax {some(40)} zed@example.org {some(30)} Zorblax." for _ in range(6)] + [f"{some(9)} (zorblax) {some(9)}"] + [some(30) for _ in range(1500)]
    masked = disclosed(spark, texts)
    assert masked[:7] == [["Zorblax", "Zorblax"]] * 6 + [["zorblax"]] and not any(masked[7:])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1.@+- ()29%_é", max_size=40))
def test_op8_patterns(text):
    kinds = {k: i for i, k in enumerate(pii.KINDS)}
    assert [f"{k}:{s}:{e}" for k, s, e in sorted(pii.base_spans(text), key=lambda x: (kinds[x[0]], x[1]))] == brute.personal(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdef019AKI:=\"' tokensecret/é", max_size=80))
def test_op5_patterns(text):
    assert [f"{k}:{s}:{e}" for s, e, k in secrets.base_spans(text)] == brute.secrets(text)


def test_op9(spark, tables, rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = [len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    want = Counter((r[0], len((r[1] or "").encode()), k, k > 1024) for r, k in zip(rows, n, strict=True))
    assert got(queries.op9_token_counts(spark, tables), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "l", " ", "  ", "\n", "'", "s", "ll", "é", "日", "1", "!", " the", "<|endoftext|>", "<|", "\t", "ing", " ", "😀"]), max_size=12))
def test_op9_every_prefix(parts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mine = token_prefix.counter(public_tokenizers.path("byte_bpe_50k.json"))
    text = "".join(parts)
    table = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert mine.table(text) == table and mine.count(text) == table[-1]
    for budget in (0, 1, 3, 7):
        assert mine.fits(text, budget) == next((i for i, n in enumerate(table) if n > budget), len(table)) - 1


def test_op9_long_runs_take_linear_time():
    import time

    mine = token_prefix.counter(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    began = time.time()
    for text in ("'" * 20_000, "'re" * 7_000, " " * 20_000 + "a", "a\n \n" * 5_000, "word <|endoftext|>" * 1_000, "x" * 20_000):
        table = mine.table(text)
        assert len(table) == len(text) + 1 and table[-1] == len(library.encode(text, add_special_tokens=False).ids)
        for i in (1, len(text) // 2, len(text) // 2 + 1, len(text) - 1):
            assert table[i] == len(library.encode(text[:i], add_special_tokens=False).ids)
    assert time.time() - began < 30


def test_op9_truncation(spark, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    cut = token_prefix.truncated(docs, path, 20)
    assert cut.schema == docs.schema
    assert max(r["n_tokens"] for r in token_prefix.token_counts(cut, path).collect()) <= 20


def test_op10(spark, tables, rows):
    found = queries.op10_pairwise_quality(spark, tables).collect()
    assert Counter((r["doc_id"], r["held_out"]) for r in found) == Counter((r[0], brute.remainder(r[0], 4) == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)


def test_op4_verdict_against_brute_force(spark, tables, rows):
    import math

    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.trained(docs, labels)
    weights = [w / (1 << 24) for w in model.weights.tolist()]
    got = {(r["doc_id"], r["n_words"], r["word_chars"]): r for r in quality_rules.quality_rules(docs, model).collect()}
    for r in rows:
        n, chars, *_, failed = brute.quality(r[1])
        p = 1 / (1 + math.exp(-(model.slope * brute.raw_score(r[1], weights) + model.offset)))
        row = got[r[0], n, chars]
        assert row["probability"] == pytest.approx(p, rel=1e-6) and row["kept"] == (not failed and row["probability"] >= 0.5)


def test_op10_against_a_brute_bradley_terry_fit(spark, tables, rows):
    import math

    import numpy as np

    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    model = pairwise_quality.trained(docs, labels)
    weights = model.weights / float(1 << 24)
    # preference pairs are good less bad, each good row PAIRS times
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    quality = {}
    for d, q, _ in cases.labels(rows):
        if d in text and q in (0, 1):
            quality[d] = min(q, quality.get(d, 1))
    shares = {d: np.zeros(len(weights)) for d in quality}
    for d in quality:
        for group in brute.slot_shares(text[d]):
            for slot, share in group.items():
                shares[d][slot] += share
    from tideledger.llm.hashed_features import sampled, vectors

    data = vectors(sampled(docs, labels, pairwise_quality.PER_CLASS)[0], "quality", "doc_id")
    pairs = [(np.array(r["features"].toArray()), r["label"]) for r in pairwise_quality.preference_pairs(data, sum(q == 0 for q in quality.values())).collect()]
    assert len(pairs) == pairwise_quality.PAIRS * sum(quality.values())
    differences = {tuple(np.round(shares[a] - shares[b], 9)) for a in quality for b in quality if quality[a] == 1 and quality[b] == 0}
    assert all(tuple(np.round(x * (2 * y - 1), 9)) in differences for x, y in pairs)
    # the weights are where the logistic loss with its penalty on scaled weights is least
    x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    scale = x.std(axis=0, ddof=1)
    loss = lambda w: float(np.mean(np.logaddexp(0, -(2 * y - 1) * (x @ w))) + 0.003 / 2 * ((w * scale) ** 2).sum())
    best, step, on = np.zeros(len(weights)), 2.0, scale > 0
    z = x[:, on] / scale[on]
    u, widest = np.zeros(on.sum()), max(1.0, np.linalg.norm(z, 2) ** 2 / len(y))
    for _ in range(4000):
        p = 1 / (1 + np.exp(-np.clip(z @ u, -500, 500)))
        g = z.T @ (p - y) / len(y) + 0.003 * u
        u = u - step / widest * g
    best[on] = u / scale[on]
    assert loss(weights) <= loss(best) * 1.02 + 1e-4
    score = lambda t: 1 / (1 + math.exp(-(model.slope * (brute.raw_score(t, weights.tolist()) - model.threshold) + math.log(0.7 / 0.3))))
    got = Counter((r["doc_id"], round(r["score"], 5)) for r in pairwise_quality.quality_scores(docs, model).collect())
    assert got == Counter((r[0], round(score(r[1]), 5)) for r in rows)


def test_op10_learns_from_every_labelled_row(spark):
    import random

    import numpy as np

    from tideledger.llm.hashed_features import raw_scores
    from tideledger.llm.textbatch import utf8

    rng = random.Random(5)
    plain, loud = "plain words of a good text that says much".split(), "BUY now $$$ win".split()
    rows = [(i, " ".join(rng.choice(loud if rng.random() < (0.3 if i % 16 else 0.6) else plain) for _ in range(rng.randint(3, 12)))) for i in range(1800)]
    quality = [int(i % 16 > 0) for i, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pairwise_quality.trained(docs, spark.createDataFrame([(i, q) for (i, _), q in zip(rows, quality, strict=True)], "doc_id long, quality int"))
    import pyarrow as pa

    x = np.sort(raw_scores(*utf8(pa.array([t for _, t in rows])), model.weights))
    n_bad = quality.count(0)
    assert sum(quality) > 1500 and model.threshold == (x[n_bad - 1] + x[n_bad]) / 2


@pytest.mark.parametrize(("n_good", "n_bad"), [(40, 9), (3, 20), (7, 1), (1, 1)])
def test_op10_blocks_hold_every_pair(spark, n_good, n_bad):
    import numpy as np

    from tideledger.llm.hashed_features import count_rows, vectors
    from tideledger.llm.shared import in_batches

    pairs = max(pairwise_quality.PAIRS, -(-n_bad // n_good))
    rows = spark.createDataFrame([(i, "a b " * (i % 5) + f"w{i} " + "x" * (300 * (i == 2)), int(i < n_good)) for i in range(n_good + n_bad)], "doc_id long, text string, quality int")
    plain = pairwise_quality.preference_pairs(vectors(rows, "quality", "doc_id"), n_bad, pairs).collect()
    met = pairwise_quality.drawn(rows, n_good, n_bad, pairs).collect()
    assert len(plain) == len(met) == n_good * pairs
    assert {r["good"] for r in met} == set(range(n_good)) and {r["bad"] for r in met} == set(range(n_bad))
    deal = pairwise_quality.Deal(n_good, n_bad, pairs, block=4)
    counted = pairwise_quality.numbered(in_batches(rows, lambda x: count_rows(x, ("doc_id", "quality")), "doc_id long, quality int, counts binary"))
    blocks = pairwise_quality._blocks(counted, deal)
    assert blocks.count() == -(-len(plain) // 4)
    x, y = np.array([r["features"].toArray() for r in plain]), np.array([2 * r["label"] - 1 for r in plain])
    w = np.random.default_rng(3).normal(size=x.shape[1])
    loss, gradient = pairwise_quality._loss(blocks, deal, w)
    lead = y * (x @ w)
    assert loss == pytest.approx(float(np.logaddexp(0, -lead).mean()))
    assert np.allclose(gradient, -(y / (1 + np.exp(lead))) @ x / len(y), atol=1e-12)
    assert np.allclose(pairwise_quality._spread(blocks, deal), x.std(axis=0, ddof=1), atol=1e-7)


def test_op10_threshold_is_the_exact_quantile(spark):
    import random

    import numpy as np

    rng = random.Random(8)
    for values, extra in (([i / 7 for i in range(9)], 0), ([1e9, 1.0, 1.0 + 2**-52, -3.5], 5), ([2.0], 1)):
        rows = [(rng.randint(0, 1), rng.choice(values)) for _ in range(60)] + [(0, values[0]), (1, values[-1])]
        seen = {c: sum(q == c for q, _ in rows) for c in (0, 1)}
        totals = {0: seen[0] + extra, 1: seen[1]}
        rows.sort(key=lambda r: (r[1], r[0]))
        at = np.cumsum([totals[q] * seen[1 - q] for q, _ in rows])
        i = int(np.searchsorted(at, totals[0] * seen[0] * seen[1]))
        x = [r[1] for r in rows]
        got_ = pairwise_quality._threshold(spark.createDataFrame(rows, "quality int, x double").repartition(3), totals, seen)
        assert got_ == (x[i] + x[min(i + 1, len(x) - 1)]) / 2


DATA = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not DATA.exists(), reason="driver tables")
def test_quality_models_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [r for r in queries.op10_pairwise_quality(spark, str(DATA)).collect() if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in rows)
    assert right >= 0.85 * len(rows)
    good = [r for r in queries.op4_quality_rules(spark, str(DATA)).collect() if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.9 * len(good)


def test_batch_bound_in_other_units(spark, tables):
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    try:
        for asked, holds in (("64m", str(4 << 20)), ("1k", "1k")):
            spark.conf.set(conf, asked)
            assert queries.op7_simhash(spark, tables).count() > 0
            assert spark.conf.get(conf) == holds
    finally:
        spark.conf.set(conf, before)


def test_labelled_sample_of_an_id_with_two_texts(spark):
    from tideledger.llm.hashed_features import sampled

    rows = [(1, "one"), (1, "two"), (1, None), (2, "x")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    got_ = {tuple(sorted((r["doc_id"], r["text"], r["quality"]) for r in sampled(spark.createDataFrame(part, "doc_id long, text string").repartition(3), labels, 5)[0].collect())) for part in (rows, rows[::-1])}
    assert len(got_) == 1 and [x[2] for x in next(iter(got_))] == [0, 1]


def test_pii_scan_is_linear():
    import time

    began = time.time()
    for text in ("a" * 100_000 + " x@y", "1" * 100_000 + ".", "1." * 50_000, "+1" + " " * 100_000, "@" * 50_000, "a@" * 50_000):
        pii.base_spans(text)
        secrets.base_spans(text)
    assert time.time() - began < 20


def test_pipeline(spark, tables, rows):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        before, after = docs.collect(), out.collect()
        if name == "source_mix":
            want = {(r["doc_id"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mixture(docs).collect() if r["taken"] > 0}
            assert want == {(r["doc_id"], r["source_size"], round(r["target"], 6), r["taken"]) for r in after} and after
            assert {(r["doc_id"], r["text"]) for r in after} <= {(r["doc_id"], r["text"]) for r in before}
            break
        assert out.columns == docs.columns, name
        if name == "quality_rules":
            model = quality_rules.trained(docs, spark.read.parquet(f"{tables}/labels.parquet"))
            verdict = Counter(r["doc_id"] for r in quality_rules.quality_rules(docs, model).collect() if r["kept"])
            assert Counter(r["doc_id"] for r in after) == verdict and not any(brute.quality(r["text"])[-1] for r in after)
        if name == "simhash_near_dedup":
            prints = {r["doc_id"]: brute.simhash(r["text"]) for r in before}
            comp = dict(zip(prints, brute.components([(d, prints[d]) for d in prints]), strict=True))
            assert Counter(comp[r["doc_id"]] for r in after) == Counter(set(comp.values()))
        if name == "decontamination":
            dirty = {r["doc_id"] for r in before if brute.contamination(r["text"], cases.benchmark(rows))[4]}
            assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before if r["doc_id"] not in dirty)
        if name == "pii":
            assert not any(brute.personal(r["text"]) for r in after) and len(after) == len(before)
            assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None)
        docs = spark.createDataFrame(after, docs.schema) if after else out
    assert corpus_pipeline.run(spark, tables).count() > 0


def test_near_duplicate_stage_on_every_row(spark, rows):
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    kept = simhash.one_of_each(docs).collect()
    prints = [(r[0], brute.simhash(r[1])) for r in rows]
    groups = len({c if c is not None else ("none", fp) for (_, fp), c in zip(prints, brute.components(prints), strict=True)})
    assert len(kept) == groups
