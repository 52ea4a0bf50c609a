"""Scans by header, interval joins, and everything that is taken by stretches, against plain statements."""

import datetime as dt
import math
import os
import random
import re
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideledger.operators import capital, joins, models, quantiles, rules, scoring, tables, validation, windows
from tideledger.sources import tables as sources


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_files_with_other_headers_are_read_by_name(spark, tmp_path):
    root = tmp_path / "runs [1]"
    write(root / "run-a" / "a.csv", "slug,ts_iso,buy_up_cents\nm-1,2024-01-01T00:00:01Z,41\n")
    write(root / "run-a" / "b.csv", " slug , ts_iso,sell_up_cents,buy_up_cents,note\nm-1,2024-01-01T00:00:02Z,39,42,x\nm-1,2024-01-01T00:00:03Z,38\n")
    write(root / "run_name=run b" / "c+d.csv", "\n﻿ts_iso,slug,slug,\n2024-01-01T00:00:04Z,m-2,again,last\n")
    write(root / "run-a" / "empty.csv", "")
    rows = {(r["run_name"], r["source_file"], r["ts_iso"][17:19]): r for r in sources.run_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {("run-a", "a.csv", "01"), ("run-a", "b.csv", "02"), ("run-a", "b.csv", "03"), ("run b", "c+d.csv", "04")}
    a, b, short, c = (rows[k] for k in sorted(rows, key=lambda k: k[2]))
    assert (a["buy_up_cents"], a["sell_up_cents"], a["note"]) == ("41", None, None)
    assert (b["buy_up_cents"], b["sell_up_cents"], b["note"]) == ("42", "39", "x")
    assert (short["buy_up_cents"], short["sell_up_cents"]) == (None, "38")
    assert (c["slug"], c["_c2"], c["_c3"], c["buy_up_cents"]) == ("m-2", "again", "last", None)
    typed = sources.quote_files(spark, str(tmp_path), sources.T.StructType([sources.T.StructField("BUY_UP_CENTS", sources.T.IntegerType()), sources.T.StructField("gone", sources.T.DoubleType())]))
    assert typed.columns == ["BUY_UP_CENTS", "gone", "source_file", "source_order"]
    assert sorted(r["BUY_UP_CENTS"] or 0 for r in typed.collect()) == [0, 0, 41, 42]


def test_a_folder_without_files_has_no_rows(spark, tmp_path):
    write(tmp_path / "x.txt", "slug\n")
    assert sources.quote_files(spark, str(tmp_path)).count() == 0


def test_the_last_row_of_a_file_is_kept(spark, tmp_path):
    lines = [f"m-{i % 40},2024-01-01T00:00:{i % 7:02d}Z,{i}" for i in range(4000)]
    write(tmp_path / "r" / "a.csv", "\n".join(["slug,ts_iso,buy_up_cents", *lines]) + "\n")
    write(tmp_path / "r" / "b.csv", "buy_up_cents,slug,ts_iso\n-1,m-3,2024-01-01T00:00:03Z\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        found = {(r["slug"], r["ts_iso"][:19]): r["buy_up_cents"] for r in sources.merged_run(sources.run_files(spark, str(tmp_path))).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {}
    for i in range(4000):
        want[f"m-{i % 40}", f"2024-01-01T00:00:{i % 7:02d}"] = float(i)
    want["m-3", "2024-01-01T00:00:03"] = -1.0
    assert found == want


@pytest.mark.parametrize("closed", [False, True])
def test_intervals_of_all_lengths(spark, closed):
    rng = random.Random(int(closed))
    points = [(i, float(rng.choice([rng.uniform(-1000, 1000), rng.randint(-20, 20), 0.0, 1e18, -1e-12]))) for i in range(300)] + [(300, None), (301, float("nan"))]
    spans = []
    for i in range(300):
        lo = rng.choice([rng.uniform(-1000, 1000), rng.randint(-20, 20), 0.0])
        spans.append((i, float(lo), float(lo + rng.choice([0, 1, 2**-9, rng.random(), rng.random() * 1e4, -1]))))
    spans += [(300, float("-inf"), 3.0), (301, -2.0, float("inf")), (302, float("-inf"), float("inf")), (303, None, 5.0), (304, 1e17, 1e18), (305, 0.0, 0.0)]
    got = joins.in_intervals(spark.createDataFrame(points, "p int, x double"), "x", spark.createDataFrame(spans, "s int, lo double, hi double"), "lo", "hi", closed)
    want = Counter((p, s) for p, x in points for s, lo, hi in spans if x is not None and lo is not None and x == x and (lo <= x if closed else lo < x) and x <= hi)
    assert Counter((r["p"], r["s"]) for r in got.where("not isnan(x)").collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_whole_numbers_and_an_empty_table_of_intervals(spark):
    points = spark.range(100)
    spans = spark.createDataFrame([(5, 9), (9, 9), (50, 49)], "lo long, hi long")
    assert sorted(r["id"] for r in joins.in_intervals(points, "id", spans, "lo", "hi").collect()) == [6, 7, 8, 9]
    assert sorted(r["id"] for r in joins.in_intervals(points, "id", spans, "lo", "hi", True).collect()) == [5, 6, 7, 8, 9, 9]
    assert joins.in_intervals(points, "id", spans.where("lo > 99"), "lo", "hi").count() == 0


@pytest.fixture
def many_ranges(spark):
    """Ranges of a few rows each."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "9")
    spark.conf.set(names[1], "false")
    yield
    for n, b in zip(names, before, strict=True):
        spark.conf.set(n, b)


def series_rows(seed=1, n=400):
    """Series of very unequal length, one of them null; t is a total order."""
    rng = random.Random(seed)
    names = ["hot"] * 12 + ["a", "b", None]
    return [(rng.choice(names), t, rng.choice([None, *[rng.uniform(-0.3, 0.4) for _ in range(5)]]), rng.choice(["u", "v", None]), rng.choice([None, 1.0, 0.0, 1.0])) for t in rng.sample(range(10_000), n)]


SERIES = "s string, t int, r double, k string, y double"


def by_series(rows):
    out = {}
    for row in sorted(rows, key=lambda r: r[1]):
        out.setdefault(row[0], []).append(row)
    return out


def test_numbers_and_running_sums_by_ranges(spark, many_ranges):
    rows = series_rows()
    df = spark.createDataFrame(rows, SERIES)
    got = {(r["s"], r["t"]): (r["n"], r["c"]) for r in windows.ranged(df, ["s"], ["t"], total="c").collect()}
    assert got == {(s, r[1]): (i, len(part)) for s, part in by_series(rows).items() for i, r in enumerate(part)}
    numbered = windows.ranged(df, [], ["t"], stretch="st")
    assert sorted((r["t"], r["n"]) for r in numbered.collect()) == [(t, i) for i, t in enumerate(sorted(r[1] for r in rows))]
    assert numbered.select("st").distinct().count() > 5
    sums = {(r["s"], r["t"]): (r["up"], r["all"]) for r in windows.running(df.where("r is not null"), ["s"], ["t"], {"up": "r"}, {"all": "r"}).collect()}
    for s, part in by_series([r for r in rows if r[2] is not None]).items():
        total = 0.0
        for r in part:
            total += r[2]
            assert math.isclose(sums[s, r[1]][0], total, abs_tol=1e-9) and math.isclose(sums[s, r[1]][1], sum(x[2] for x in part), abs_tol=1e-9)
    assert windows.ranged(df.where("false"), ["s"], ["t"]).count() == 0


def test_splits_are_numbered_without_a_window_over_all(spark, many_ranges):
    rows = [("all", t) for t in random.Random(3).sample(range(1000), 101)]
    out = validation.split_50_25_25(spark.createDataFrame(rows, "part string, t int"), ["part"], ["t"], 20)
    found = {}
    for r in out.collect():
        found.setdefault(r["split"], []).append((r["ordinal"], r["t"]))
    line = sorted(t for _, t in rows)
    want = {"train": line[:50], "validation": line[50:75], "test": line[75:], "full": line, "latest": line[-20:]}
    assert {k: [t for _, t in sorted(v)] for k, v in found.items()} == want and all([i for i, _ in sorted(v)] == list(range(len(v))) for v in found.values())
    # windows are over a row for each range only
    specs = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", out._jdf.queryExecution().optimizedPlan().toString())
    assert specs and all("_range" in x or " ASC" not in x for x in specs)


def test_runs_drawdowns_and_pairs_by_stretches(spark, many_ranges):
    rows = [(s, t, r if r is not None else 0.05, k or "u", y) for s, t, r, k, y in series_rows(2)]
    df = spark.createDataFrame(rows, SERIES)
    parts = by_series(rows)

    def longest(flags):
        best = now = 0
        for f in flags:
            now = now + 1 if f else 0
            best = max(best, now)
        return best

    got = {r["s"]: r["longest"] for r in windows.longest_run(df, ["s"], ["t"], F.col("r") > -0.15).collect()}
    assert got == {s: longest([r[2] > -0.15 for r in part]) for s, part in parts.items()}
    assert {r["s"]: r["longest"] for r in windows.longest_run(df, ["s"], ["t"], F.lit(True)).collect()} == {s: len(p) for s, p in parts.items()}
    assert {r["longest"] for r in windows.longest_run(df, ["s"], ["t"], F.lit(None).cast("boolean")).collect()} == {0}
    down = {(r["s"], r["t"]): (r["wealth"], r["peak"], r["drawdown"]) for r in windows.drawdowns(df, ["s"], ["t"], "r").collect()}
    for s, part in parts.items():
        wealth, peak = 1.0, -math.inf
        for r in part:
            wealth *= 1 + r[2]
            peak = max(peak, wealth)
            assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip(down[s, r[1]], (wealth, peak, (peak - wealth) / peak), strict=True))
    steps = Counter((a[3], b[3]) for part in parts.values() for a, b in zip(part[:-1], part[1:], strict=True))
    assert {(r["before"], r["after"]): r["n"] for r in windows.transitions(df, ["s"], ["t"], "k").collect()} == dict(steps)
    auto = {(r["s"], r["lag"]): r["autocorr"] for r in windows.autocorrelation(df, ["s"], ["t"], "r", [1, 3]).collect()}
    x = np.array([r[2] for r in parts["hot"]])
    for k in (1, 3):
        assert math.isclose(auto["hot", k], np.corrcoef(x[k:], x[:-k])[0, 1], abs_tol=1e-9)


@pytest.mark.parametrize("size", [1, 2, 7, 48])
def test_sliding_windows_by_blocks(spark, many_ranges, size):
    rows = series_rows(5, 260)
    got = {r["s"]: r for r in windows.sliding_compound(spark.createDataFrame(rows, SERIES), ["s"], ["t"], "r", size).collect() if r["s"] is not None}
    for s, part in by_series(rows).items():
        if s is None:
            continue
        full = [part[i : i + size] for i in range(len(part) - size + 1)]
        values = [math.prod(1 + (r[2] or 0) for r in w) - 1 for w in full]
        assert got[s]["n_windows"] == len(full)
        if full:
            assert math.isclose(got[s]["worst"], min(values), abs_tol=1e-9) and math.isclose(got[s]["median"], statistics.median(values), abs_tol=1e-9)
            assert math.isclose(got[s]["active_rate"], sum(any(r[2] is not None for r in w) for w in full) / len(full))


@pytest.mark.parametrize("half_life", [None, 0.2, 3])
def test_history_by_chunks_is_that_of_the_whole(spark, half_life):
    rows = series_rows(6, 300)
    df = spark.createDataFrame(rows, SERIES)
    levels = [["k"], []]

    def plain(row):
        back = [r for r in rows if r[0] == row[0] and r[1] < row[1]]
        for level, part in ((1, [r for r in back if r[3] == row[3]] if row[3] is not None else None), (2, back)):
            if part is None or sum(r[4] is not None for r in part) < 4:
                continue
            part = sorted(part, key=lambda r: -r[1])
            w = [1.0 if half_life is None else 0.5 ** (i / half_life) for i in range(len(part))]
            seen = [(a, r[4]) for a, r in zip(w, part, strict=True) if r[4] is not None]
            return round(sum(a * y for a, y in seen) / sum(a for a, _ in seen), 9), len(seen), level
        return None, 0, 0

    for chunk in (None, F.floor(F.col("t") / 700)):
        if half_life is None:
            out = windows.backoff_mean(df, ["s"], ["t"], "y", levels, 4, "q", chunk)
        else:
            out = windows.ew_backoff_mean(df, ["s"], ["t"], "y", levels, half_life, 4, "q", chunk)
        assert out.columns == [*df.columns, "q", "q_n", "q_level"]
        for r in out.collect():
            want = plain(tuple(r)[:5])
            assert (r["q_n"], r["q_level"]) == want[1:] and (r["q"] is None) == (want[0] is None)
            # a block more than 60 half-lives long is as far as it sees
            assert r["q"] is None or abs(r["q"] - want[0]) < 1e-8


def test_quantiles_of_whole_columns(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 8)
    monkeypatch.setattr(quantiles, "FEW", 3)
    rng = random.Random(4)
    columns = {
        "a": [rng.gauss(0, 1) for _ in range(400)],
        "b": [rng.choice([1.0, 2.0, 3.0]) for _ in range(400)],
        "c": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(400)],
        "d": [None] * 400,
        "e": [None, float("nan")] * 199 + [7.0, -3.0],
        "f": [5e-324 * rng.randint(0, 3) for _ in range(400)],
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(5)
    found = quantiles.quantiles(df, list(columns), [0.0, 0.25, 0.5, 0.9, 1.0])
    for c, values in columns.items():
        known = [v for v in values if v is not None and v == v]
        assert found[c]["n"] == len(known)
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert found[c][q] is None if not known else math.isclose(found[c][q], float(np.quantile(known, q)), rel_tol=1e-12), (c, q)
    t = {r["column"]: r for r in tables.distribution(df, ["a", "d"]).collect()}
    exact = df.agg(F.median("a"), F.percentile("a", F.lit(0.9))).first()
    assert (t["a"]["median"], t["a"]["p90"]) == tuple(exact) and t["d"]["median"] is None
    ends = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,)], "x double")
    assert quantiles.quantiles(ends, ["x"], [0.5])["x"][0.5] == 1.0
    filled = models.median_imputed(df.withColumn("train", F.col("b") > 1), ["a", "d"], "train")
    assert "d" not in filled.columns


def test_rank_scores_are_those_of_windows(spark, many_ranges):
    rng = random.Random(7)
    rows = [(rng.choice(["p", None]), i, rng.choice([None, 0.0, -0.0, 0.1 + 0.2, 0.3, rng.random()]), rng.choice([None, 1.0, 2.0])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, a double, b double")
    parts = {"one": (scoring.Part("a", 0.7, fill=-1), scoring.Part("b", 0.3, "low", 9)), "two": (scoring.Part("a", 1.0),)}
    got = {r["i"]: (r["one"], r["two"]) for r in scoring.rank_scores(df, parts, ["g"]).collect()}
    a, b = F.coalesce("a", F.lit(-1.0)), -F.coalesce("b", F.lit(9.0))
    one = 0.7 * windows.percent_rank(a, ["g"]) + 0.3 * windows.percent_rank(b, ["g"])
    for r in df.select("i", one.alias("one"), windows.percent_rank(F.col("a"), ["g"]).alias("two")).collect():
        assert math.isclose(got[r["i"]][0], r["one"], abs_tol=1e-12)
        assert got[r["i"]][1] is None if r["two"] is None else math.isclose(got[r["i"]][1], r["two"], abs_tol=1e-12)


def test_two_quota_windows(spark):
    rng = random.Random(8)
    rows = [("k", i, 0.1, 0.5, 1000.0, rng.choice([-0.5, 0.4])) for i in range(120) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "k string, n int, fraction double, price double, size double, unit_pnl double")
    got = capital.capital_fold(df, ["k"], ["n"], quota=3, window=6, wide_quota=7, wide_window=30, cooldown=2).first()
    b, taken, losses, until = 100.0, [], 0, -1
    for _, n, f, p, size, u in rows:
        if n <= until or sum(i > n - 6 for i in taken) >= 3 or sum(i > n - 30 for i in taken) >= 7:
            continue
        pnl = min(b * f, size * p) / p * u
        b, taken = b + pnl, [*taken, n]
        losses = losses + 1 if pnl < 0 else 0
        if losses == 2:
            losses, until = 0, n + 2
    assert got["trades"] == len(taken) and math.isclose(got["ending"], b, rel_tol=1e-9)
    assert max(sum(n - 30 < i <= n for i in taken) for n in range(120)) == 7


def test_limits_of_sets(spark):
    df = spark.createDataFrame([("mix_active",), ("other",), ("mix_conservative",)], "rule string")
    rows = {kind: {r["rule"]: tuple(r)[1:] for r in df.select("rule", *(c.alias(n) for c, n in zip(rules.limit_columns(rules.LIMITS[kind]), "qwc", strict=True))).collect()} for kind in rules.LIMITS}
    assert rows["framework"] == {"mix_active": (14, None, 6), "other": (10, None, 8), "mix_conservative": (10, None, 8)}
    assert rows["final"]["mix_conservative"] == (10, None, 10) and rows["final"]["other"] == (14, None, 6)
    assert rows["refresh"] == {"mix_active": (14, 28, 6), "other": (10, 18, 8), "mix_conservative": (10, 28, 10)}


def test_every_predicate_is_a_conjunction():
    for r in [*rules.catalogue(), *rules.DYNAMIC, *rules.MODEL, *rules.REGIME_VALUE]:
        assert " or " not in r.predicate.lower() and " between " not in r.predicate.lower() and " and " not in r.predicate.replace(" and ", "")
    assert len(rules.comparisons(rules.catalogue())) < 250


def test_scratch_goes_when_done(spark):
    from tideledger.sources.shared import scratch

    with scratch(spark) as at:
        spark.range(3).write.parquet(f"{at}/x")
        assert os.path.isdir(at.removeprefix("file://"))
    assert not os.path.exists(at.removeprefix("file://"))


def test_stream_of_last_quotes_is_the_batch(spark, tmp_path):
    from tideledger.operators.quotes import keep_last
    from tideledger.streaming.quotes import last_of_each

    rng = random.Random(10)
    schema = "slug string, ts_utc timestamp, source_file string, ord int, price double"
    rows = [(rng.choice(["a", "b", None]), dt.datetime(2024, 1, 1, 0, rng.randrange(60), rng.randrange(3)), rng.choice(["x", "y", None]), i, float(i)) for i in range(300)]
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], schema).write.parquet(f"{tmp_path}/in/{k}")
    spark.createDataFrame([("late", dt.datetime(2030, 1, 1), "x", 0, 0.0)], schema).write.parquet(f"{tmp_path}/in/9")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 5).parquet(f"{tmp_path}/in")
    query = last_of_each(stream, ["slug"], ["source_file", "ord"], late="2 hours").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(str, keep_last(spark.createDataFrame(rows, schema), ["slug", "ts_utc"], ["source_file", "ord"]).collect())) and len(got) > 100


def test_sizes_by_kelly(spark):
    df = spark.createDataFrame([(0.5, 0.75), (0.9, 0.75), (1.0, 0.75), (0.5, None)], "price double, p double")
    got = {(r["price"], r["p"], r["sizing"]): r["fraction"] for r in rules.sized(df, F.col("p")).collect()}
    assert (got[0.5, 0.75, "full_kelly"], got[0.5, 0.75, "quarter_kelly"], got[0.5, 0.75, "fixed_10pct"]) == (0.5, 0.125, 0.1)
    assert got[0.9, 0.75, "half_kelly"] == got[1.0, 0.75, "half_kelly"] == 0.0 and not got[0.5, None, "full_kelly"]


def test_training_windows_by_stretches(spark):
    rng = random.Random(11)
    rows = [(s, i, rng.gauss(0, 1), rng.gauss(0, 1) if i % 5 else None, rng.choice([0.0, 1.0, 1.0, None])) for s in ("a", "b") for i in range(150)]
    df = spark.createDataFrame(rows, "s string, n int, x double, z double, y double")
    got = {(r["s"], r["n"]): r["q"] for r in models.walk_forward_logit(df, ["s"], "n", "y", ["x", "z"], every=4, warm_up=10, lookback=30, half_life=15).collect()}
    for s in ("a", "b"):
        for n in (8, 12, 33, 64, 90, 149):
            start = n // 4 * 4
            past = [r for r in rows if r[0] == s and start - 30 <= r[1] < start and r[4] is not None]
            if start < 10:
                assert got[s, n] is None
                continue
            fill = statistics.median(r[3] for r in past if r[3] is not None)
            x = np.array([[r[2], fill if r[3] is None else r[3]] for r in past])
            beta = models._fitted((x - x.mean(axis=0)) / x.std(axis=0), np.array([r[4] for r in past]), np.array([0.5 ** ((start - 1 - r[1]) / 15) for r in past]), 1.0)
            row = next(r for r in rows if r[0] == s and r[1] == n)
            here = (np.array([row[2], fill if row[3] is None else row[3]]) - x.mean(axis=0)) / x.std(axis=0)
            fill_all = np.median(x, axis=0)[1]
            if row[3] is None:
                here = (np.array([row[2], fill_all]) - x.mean(axis=0)) / x.std(axis=0)
            assert math.isclose(got[s, n], 1 / (1 + math.exp(-(beta[0] + here @ beta[1:]))), rel_tol=1e-6)
