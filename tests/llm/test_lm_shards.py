"""The language model where there are many shards: blocks dealt together, look-ups in many arrays."""

import numpy as np
import pyarrow as pa

from tideledger.llm import ngram_lm as lm


class Stored:
    """Arrays kept by name."""

    mapped = True

    def __init__(self):
        self.found = {}

    def write(self, name, *arrays):
        self.found[name] = np.concatenate([np.ascontiguousarray(a).view(np.uint8) for a in arrays])

    def read(self, name):
        return self.found[name]


def blocks_of(batches):
    return [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]


def some_codes(bits, rng):
    return lm.Codes(rng.integers(0, 1 << 48, 20).astype(np.uint64), np.zeros(0, np.uint64), bits)


def test_shards_closed_by_a_task_are_dealt_together(monkeypatch):
    rng = np.random.default_rng(2)
    codes, pool = some_codes(5, rng), rng.integers(0, 1 << 48, 4000).astype(np.uint64)
    first, second = codes.of(rng.choice(pool, 6000)), codes.of(rng.choice(pool, 6000))
    ids, kinds, blocks = lm._dealt(lm._GRAMS, [first, second], [np.ones(6000, np.uint64)], codes, 5)
    distinct = len(set(zip(first.tolist(), second.tolist(), strict=True)))
    for held, most in ((lm.HELD_ROWS, 1), (500, 32)):
        monkeypatch.setattr(lm, "HELD_ROWS", held)
        files = Stored()
        out = blocks_of(lm._merged(iter([lm._batch(ids, kinds, blocks)]), files, 2, 2, codes, 5))
        assert len(files.found) == len(set(ids)) == 32
        for kind, total in ((lm._CONTEXTS, 6000), (lm._GRAMS, distinct)):
            mine = [(shard, lm._unpack(block)) for shard, k, block in out if k == kind]
            assert len(mine) <= 32 * most
            assert sum(int(columns[1].sum()) for _, columns in mine) == total
            assert all((codes.shard(codes.words(c[0]), lm._hashes([c[0]], codes)) == shard).all() for shard, c in mine)


def test_counts_of_words_are_dealt_together():
    rng = np.random.default_rng(3)
    codes, words = some_codes(5, rng), rng.integers(0, 1 << 48, 2000).astype(np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(words[i : i + 50]), pa.array(np.arange(i, i + 50))], names=["word", "n"]) for i in range(0, 2000, 50)]
    out = blocks_of(lm._coded_counts(iter([*batches, batches[0].slice(0, 0)]), codes, 5))
    assert len(out) <= 32
    found = {w: n for _, _, block in out for w, n in zip(codes.words(lm._unpack(block)[0]).tolist(), lm._unpack(block)[1].tolist(), strict=True)}
    assert found == dict(zip(words.tolist(), range(2000), strict=True))
    assert not list(lm._coded_counts(iter([]), codes, 5))


def test_look_ups_among_grams_that_share_bits_and_large_counts(monkeypatch):
    class Sixteen:
        bits = 4
        shard = staticmethod(lambda by, hashes: (hashes >> np.uint64(24) & np.uint64(1)).astype(np.int64) + 3)

    rng = np.random.default_rng(5)
    hashes = np.unique(np.concatenate([np.uint64(5 << 32) + (np.arange(200, dtype=np.uint64) << np.uint64(24)), rng.integers(0, 1 << 40, 500).astype(np.uint64) << np.uint64(24), np.array([0, ((1 << 40) - 1) << 24], np.uint64)]))
    hashes = hashes[rng.random(len(hashes)) < 0.9]
    counts = np.where(rng.random(len(hashes)) < 0.2, rng.integers(250, 1 << 40, len(hashes)), rng.integers(1, 260, len(hashes))).astype(np.uint64)
    files, shard = Stored(), Sixteen.shard(None, hashes)
    for s in (3, 4):
        files.write(f"3-{s}", *lm._table(hashes[shard == s], [counts[shard == s]]))
    files.write("3-7", *lm._table(hashes[:0], [counts[:0]]))
    model = lm.KneserNey(3, files, frozenset(files.found), Sixteen(), {})
    monkeypatch.setattr(lm, "gram_hash", lambda words: words[-1])
    asked = rng.permutation(np.concatenate([hashes, hashes[:50], np.uint64(5 << 32) + (np.arange(256, dtype=np.uint64) << np.uint64(24)), np.array([0, ((1 << 40) - 1) << 24, 9 << 24], np.uint64)]))
    found, back = model._found([asked, asked, asked])
    known = dict(zip(hashes.tolist(), counts.tolist(), strict=True))
    assert found["count"][back].tolist() == [known.get(h, 0) for h in asked.tolist()]
    none = lm.KneserNey(3, files, frozenset(["3-7"]), Sixteen(), {})
    assert not none._found([asked, asked, asked])[0]["count"].any()
