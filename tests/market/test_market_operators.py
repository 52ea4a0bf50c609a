"""Operators on tiny tables, one test for each rule that is easy to get wrong."""

import datetime as dt
import math
import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideledger.functions import columns as C
from tideledger.operators import capital, features, joins, models, quotes, rules, scoring, tables, validation, windows
from tideledger.sources import tables as sources


def column(spark, values, make, kind="double"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_buckets_are_right_closed(spark):
    edges = [-100.0, -50.0, -30.0, -10.0, 10.0, 30.0, 50.0, 100.0, 100.1, None]
    assert column(spark, edges, lambda x: C.cut(x, C.MOVE_EDGES, C.MOVE_LABELS)) == [*C.MOVE_LABELS, None]
    assert column(spark, [0.0, 0.2, 0.21, 1.0, 1.1, None], C.price_bucket) == ["0.0~0.2", "0.0~0.2", "0.2~0.4", "0.8~1.0", None, None]


def test_bad_numbers_are_null(spark):
    assert column(spark, ["1.5", "abc", "", "NaN", None], C.number, "string") == [1.5, None, None, None, None]


def test_null_falls_through_labels(spark):
    assert column(spark, [None], C.three_way) == ["neu"] and column(spark, [None], C.liquidity) == ["low"] and column(spark, [None], C.spread_tier) == ["wide"]


def test_close_time_and_bucket(spark):
    assert column(spark, ["up-1704067200", "nothing", "x-123"], C.close_epoch, "string") == [1704067200, None, None]
    assert column(spark, [-1.0, 0.0, 30.0, 31.0, 300.0, 301.0, None], C.close_bucket) == ["after_close", "00_30s", "00_30s", "30_60s", "04_05m", "gt_05m", "unknown"]


def test_sessions(spark):
    times = ["2024-01-03 00:00:00", "2024-01-03 07:00:00", "2024-01-03 14:30:00", "2024-01-03 17:00:00", "2024-01-03 21:00:00", "2024-01-06 15:00:00"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string").withColumn("t", F.to_timestamp("t"))
    assert [r["s"] for r in rows.select("i", C.session(F.col("t")).alias("s")).orderBy("i").collect()] == ["asia", "london", "us_open", "us_afternoon", "other", "other"]


def test_gate_fails_on_missing(spark):
    rows = spark.createDataFrame([(0.05, 0.04, 150.0), (None, 0.0, 500.0), (0.01, 0.01, None)], "s double, o double, z double")
    assert [r["g"] for r in rows.select(C.gate(F.col("s"), F.col("o"), F.col("z")).alias("g")).collect()] == [True, False, False]


def test_kelly_and_labels(spark):
    rows = spark.createDataFrame([(0.6, 0.5), (0.4, 0.5), (0.6, 1.0), (None, 0.5)], "q double, p double")
    assert [round(r["k"], 9) for r in rows.select(C.kelly(F.col("q"), F.col("p")).alias("k")).collect()] == [0.2, 0.0, 0.0, 0.0]
    assert column(spark, [" Up ", "no", "1", "green", "0.0", None, "?"], lambda x: C.binary_label(x), "string") == [1, 0, 1, 1, 0, 0, 0]


def test_keep_last_by_total_order(spark):
    rows = spark.createDataFrame([("m", "t", "a.csv", 1), ("m", "t", "b.csv", 2), ("m", "u", "a.csv", 3)], "slug string, ts_iso string, source_file string, v int")
    assert {r["v"] for r in quotes.keep_last(rows, ["slug", "ts_iso"], ["source_file"]).collect()} == {2, 3}


def test_prepared_fills_mids(spark):
    raw = spark.createDataFrame([("m-1704067200", "2024-01-01T00:00:00+00:00", "40", "38", "", "62", "58", "100", "101")], "slug string, ts_iso string, buy_up_cents string, sell_up_cents string, mid_up_cents string, buy_down_cents string, sell_down_cents string, target_price string, final_price string")
    row = quotes.prepared(raw).first()
    assert (row["mid_up_cents"], row["mid_down_cents"], row["move"], row["book_complete"], row["can_resolve"], row["seconds_to_close"]) == (39.0, 60.0, 1.0, True, True, 0.0)
    assert row["overround"] == pytest.approx(0.02) and row["trade_count_1s"] is None


def test_aliases(spark):
    df = spark.createDataFrame([(1, 2)], "Timestamp int, Outcome int")
    assert quotes.aliased(df, {"ts": ["time", "timestamp"], "label": ["outcome"], "none": ["zz"]}).columns == ["ts", "label"]


def _market(spark, rows):
    names = ["market_id", "t", "ord", "final_price", "target_price", "mid_up_cents", "buy_up_cents", "buy_down_cents", "sell_up_cents", "sell_down_cents"]
    full = [(*r, *([None] * (10 - len(r)))) for r in rows]
    df = spark.createDataFrame(full, "market_id string, t long, ord long, final_price double, target_price double, mid_up_cents double, buy_up_cents double, buy_down_cents double, sell_up_cents double, sell_down_cents double")
    assert df.columns == names
    df = df.withColumn("source_file", F.lit("a")).withColumn("run_name", F.lit("r"))
    df = quotes.with_columns(df, [c for c in quotes.NUMERIC if c not in names])
    return df.withColumns({"move": F.col("final_price") - F.col("target_price"), "mid_up_prob": F.col("mid_up_cents") / 100, "overround": (F.col("buy_up_cents") + F.col("buy_down_cents")) / 100 - 1})


def test_snapshot_takes_the_row_as_it_is(spark):
    minute = features.MINUTE_US
    q = _market(spark, [("m", 0, 1, 10.0, 10.0, 50.0, 51.0, 50.0), ("m", minute, 2, 11.0, 10.0, 52.0, 53.0, 49.0), ("m", 2 * minute, 3, None, 10.0, None, None, 48.0), ("m", 3 * minute, 4, 10.0, 10.0, 50.0, 51.0, 50.0)])
    f = features.market_features(q, ["market_id"]).first()
    assert (f["m1"], f["m2"], f["dn2"], f["up2"], f["outcome"], f["n_early"]) == (1.0, None, 0.48, None, 0.0, 3)
    r = features.market_rollup(q, ["market_id"]).first()
    assert (r["open_mid"], r["last_mid"], r["final"], r["outcome"]) == (50.0, 50.0, 10.0, 0.0)


def test_single_tick_and_unresolved_markets(spark):
    f = features.market_features(_market(spark, [("m", 5, 1, 10.0, None, 50.0, 51.0, 50.0)]), ["market_id"]).first()
    assert (f["outcome"], f["eff"], f["chop"], f["vol"], f["up1"], f["up4"]) == (None, 1.0, 1.0, 0.0, 0.51, 0.51)


def test_empty_buckets_stay(spark):
    df = spark.createDataFrame([(5.0, 1.0)], "m double, y double")
    t = tables.bucket_table(df, C.cut(F.col("m"), C.MOVE_EDGES, C.MOVE_LABELS), list(C.MOVE_LABELS), "b", {"rate": F.col("y")}).collect()
    assert len(t) == 9 and sum(r["n"] for r in t) == 1 and next(r for r in t if r["b"] == "<=-100")["rate"] is None


def test_asof_is_inclusive_and_bounded(spark):
    left = spark.createDataFrame([("s", 100), ("s", 400), ("s", 401), ("z", 100)], "k string, t long")
    right = spark.createDataFrame([("s", 100, 1.0), ("s", 99, 0.5)], "k string, t long, v double")
    got = {(r["k"], r["t"]): r["p__v"] for r in joins.asof(left, right, ["k"], "t", "t", ["v"], 300, "p").collect()}
    assert got == {("s", 100): 1.0, ("s", 400): 1.0, ("s", 401): None, ("z", 100): None}


def test_asof_against_pandas(spark):
    rng = random.Random(4)
    a = pd.DataFrame({"k": [rng.choice("ab") for _ in range(200)], "t": sorted(rng.sample(range(5000), 200))})
    b = pd.DataFrame({"k": [rng.choice("ab") for _ in range(100)], "t": sorted(rng.sample(range(5000), 100)), "v": [rng.random() for _ in range(100)]})
    want = pd.merge_asof(a, b, on="t", by="k", tolerance=60)
    got = joins.asof(spark.createDataFrame(a), spark.createDataFrame(b), ["k"], "t", "t", ["v"], 60, "p").toPandas().sort_values("t")
    assert [None if math.isnan(x) else x for x in want["v"]] == [None if pd.isna(x) else x for x in got["p__v"]]


def test_missing_provider_is_reported(spark):
    left = spark.createDataFrame([("s", 1)], "k string, t long")
    out, status = joins.asof_many(left, {"a": (left, ["v"]), "b": (left.withColumn("v", F.lit(1.0)), ["v"])}, ["k"], "t", "t", 10)
    assert status == [("a", "missing: v"), ("b", "merged")] and out.columns == ["k", "t", "b__v"]


def test_percent_rank_averages_ties(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 1.0), ("g", 3.0), ("g", None)], "g string, x double")
    assert sorted([r["p"] for r in df.select(windows.percent_rank(F.col("x"), ["g"]).alias("p")).collect()], key=str) == [0.5, 0.5, 1.0, None]


def test_backoff_needs_enough_rows_and_a_key(spark):
    rows = [("s", i, "a" if i < 11 else None, float(i % 2)) for i in range(14)]
    df = spark.createDataFrame(rows, "s string, i int, k string, y double")
    got = {r["i"]: r for r in windows.backoff_mean(df, ["s"], ["i"], "y", [["k"], []]).collect()}
    assert got[9]["q_level"] == 0 and got[10]["q_level"] == 1 and got[10]["q"] == 0.5 and got[12]["q_level"] == 2


def test_exponential_mean_over_many_half_lives(spark):
    h, rng = 2, random.Random(1)
    y = [rng.random() for _ in range(600)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(y)], "s string, i int, y double")
    got = {r["i"]: r["q"] for r in windows.ew_mean(df, ["s"], ["i"], "y", h, "q").collect()}
    for i in (1, 5, 119, 120, 121, 239, 241, 599):
        w = [0.5 ** ((i - 1 - j) / h) for j in range(i)]
        assert got[i] == pytest.approx(sum(a * b for a, b in zip(w, y, strict=False)) / sum(w), rel=1e-9)
    assert got[0] is None


def test_runs_and_correlation(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([1, 0, 0, 1, 0, 0, 0, 1])] + [("t", 0, 1)], "s string, i int, y int")
    assert {r["s"]: r["longest"] for r in windows.longest_run(df, ["s"], ["i"], F.col("y") == 0).collect()} == {"s": 3, "t": 0}


def test_short_series_have_no_windows(spark):
    df = spark.createDataFrame([("s", i, 0.1) for i in range(5)], "s string, i int, r double")
    row = windows.sliding_compound(df, ["s"], ["i"], "r", 6).first()
    assert row["n_windows"] == 0 and row["worst"] is None
    assert windows.sliding_compound(df, ["s"], ["i"], "r", 2).first()["worst"] == pytest.approx(0.21)


def _simulated(trades, quota=None, window=144, cooldown=0):
    b = peak = 100.0
    dd, losses, wait, taken, k = 0.0, 0, 0, [], 0
    by_event = {t["n"]: t for t in trades}
    for i in range(max(by_event) + 1):
        taken = [x for x in taken if x > i - window]
        if wait > 0:
            wait -= 1
            continue
        t = by_event.get(i)
        if quota and len(taken) >= quota or t is None:
            continue
        cost = min(b * t["fraction"], b, t["size"] * t["price"])
        if cost <= 0:
            continue
        pnl = cost / t["price"] * t["unit_pnl"]
        b += pnl
        peak = max(peak, b)
        dd = max(dd, (peak - b) / peak)
        taken.append(i)
        k += 1
        losses = losses + 1 if pnl < 0 else 0
        if losses >= 2:
            wait, losses = cooldown, 0
    return k, b, dd


@pytest.mark.parametrize("quota,window,cooldown", [(None, 144, 0), (5, 20, 0), (4, 12, 6), (None, 144, 3)])
def test_capital_fold_equals_the_loop(spark, quota, window, cooldown):
    rng = random.Random(7)
    rows = []
    for s in range(12):
        for i in sorted(rng.sample(range(120), 60)):
            price = rng.uniform(0.05, 0.95)
            rows.append((s, i, rng.choice([0.05, 0.2, 1.0]), price, rng.choice([5.0, 1000.0]), (rng.random() < 0.5) - price - 0.01))
    df = spark.createDataFrame(rows, "s int, n int, fraction double, price double, size double, unit_pnl double")
    got = {r["s"]: r for r in capital.capital_fold(df, ["s"], ["n"], quota=quota, window=window, cooldown=cooldown).collect()}
    for s in range(12):
        k, b, dd = _simulated([dict(zip(("s", "n", "fraction", "price", "size", "unit_pnl"), r, strict=True)) for r in rows if r[0] == s], quota, window, cooldown)
        assert (got[s]["trades"], got[s]["ending"], got[s]["max_drawdown"]) == (k, pytest.approx(b), pytest.approx(dd))
    if not quota and not cooldown:
        last = capital.trade_log(df, ["s"], ["n"]).groupBy("s").agg(F.max_by("capital_after", "n").alias("b"), F.max("drawdown").alias("dd")).collect()
        assert all((r["b"], r["dd"]) == (pytest.approx(got[r["s"]]["ending"]), pytest.approx(got[r["s"]]["max_drawdown"])) for r in last)


def test_path_metrics_equal_dense_windows(spark):
    rng = random.Random(9)
    trades, groups = [], []
    for g, total in (("a", 60), ("b", 9), ("c", 40)):
        groups.append((g, total))
        for rule in ("x", "y"):
            for i in sorted(rng.sample(range(total), 7)) if (g, rule) != ("c", "y") else []:
                trades.append((g, rule, i, 0.2, 0.5, 1e9, rng.choice([0.4, -0.51])))
    df = spark.createDataFrame(trades, "g string, rule string, n int, fraction double, price double, size double, unit_pnl double")
    log = capital.trade_log(df, ["g", "rule"], ["n"], quota=F.when(F.col("rule") == "x", 3).otherwise(5), window=20, cooldown=F.when(F.col("rule") == "x", 4).otherwise(0))
    base = spark.createDataFrame(groups, "g string, total long").join(spark.createDataFrame([("x",), ("y",)], "rule string"))
    got = {(r["g"], r["rule"]): r for r in capital.path_metrics(log, base, ["g", "rule"], (8, 10, 30), 30).collect()}
    taken = {}
    for r in log.collect():
        taken.setdefault((r["g"], r["rule"]), {})[r["i"]] = (r["pnl"], r["before"])
    assert len(got) == 6
    for (g, rule), row in got.items():
        total, mine = dict(groups)[g], taken.get((g, rule), {})
        returns = [mine[i][0] / mine[i][1] if i in mine else 0.0 for i in range(total)]
        assert row["trades"] == len(mine)
        streak = best = 0
        for i in sorted(mine):
            streak = streak + 1 if mine[i][0] < 0 else 0
            best = max(best, streak)
        assert row["loss_streak"] == best
        for w in (8, 10, 30):
            runs = [math.prod(1 + x for x in returns[i : i + w]) - 1 for i in range(total - w + 1)]
            active = [any(j in mine for j in range(i, i + w)) for i in range(total - w + 1)]
            if not runs:
                assert row[f"worst_{w}"] is None and row[f"active_{w}"] is None
                continue
            assert row[f"worst_{w}"] == pytest.approx(min(runs)) and row[f"active_{w}"] == pytest.approx(sum(active) / len(active))
            assert row[f"share_positive_{w}"] == pytest.approx(sum(x > 1e-15 for x in runs) / len(runs)) and row[f"share_over_10_{w}"] == pytest.approx(sum(x > 0.10 for x in runs) / len(runs))
        assert row["recent_return"] == (pytest.approx(math.prod(1 + x for x in returns[-30:]) - 1) if total >= 30 else None)


def test_asof_of_one_series_over_many_cells(spark):
    rng = random.Random(4)
    right = sorted(rng.sample(range(5000), 60))
    left = [rng.randrange(5000) for _ in range(300)]
    a = spark.createDataFrame([(x,) for x in left], "t long")
    b = spark.createDataFrame([(x, x) for x in right], "t long, v long")
    got = sorted((r["t"], r["p__v"]) for r in joins.asof(a, b, [], "t", "t", ["v"], 50, "p").collect() if r["p__v"] is not None)
    want = sorted((x, max(y for y in right if y <= x)) for x in left if any(x - 50 <= y <= x for y in right))
    assert got == want


def test_expanding_means_in_chunks(spark):
    rng = random.Random(8)
    rows = [("s", i, rng.choice(["a", "b", None]), float(rng.random() < 0.5)) for i in range(200)]
    df = spark.createDataFrame(rows, "s string, i long, k string, y double")
    one, two = ({r["i"]: (r["q"], r["q_n"], r["q_level"]) for r in windows.backoff_mean(df, ["s"], ["i"], "y", [["k"], []], chunk=c).collect()} for c in (None, F.floor(F.col("i") / 13)))
    assert one == two


def test_regression_equals_newton_steps(spark):
    rng = random.Random(11)
    rows = [("s", i, rng.gauss(0, 1), rng.gauss(0, 2), float(rng.random() < 0.6)) for i in range(90)]
    df = spark.createDataFrame(rows, "s string, n int, a double, b double, y double")
    got = {r["n"]: r["q"] for r in models.walk_forward_logit(df, ["s"], "n", "y", ["a", "b"], every=1, warm_up=60, half_life=30).where("n in (60, 89)").collect()}
    for at, q in got.items():
        past = rows[:at]
        columns = [[r[j] for r in past] for j in (2, 3)]
        mean, dev = [statistics.fmean(c) for c in columns], [statistics.pstdev(c) for c in columns]
        x = [[1.0, *((r[j + 2] - mean[j]) / dev[j] for j in (0, 1))] for r in past]
        w = [0.5 ** ((at - 1 - r[1]) / 30) for r in past]
        beta = [0.0, 0.0, 0.0]
        for _ in range(20000):
            p = [1 / (1 + math.exp(-sum(b * v for b, v in zip(beta, row, strict=True)))) for row in x]
            grad = [sum(w[i] * (past[i][4] - p[i]) * x[i][k] for i in range(at)) - (beta[k] if k else 0.0) for k in range(3)]
            beta = [b + 0.05 * g for b, g in zip(beta, grad, strict=True)]
            if max(map(abs, grad)) < 1e-9:
                break
        now = [1.0, *((rows[at][j + 2] - mean[j]) / dev[j] for j in (0, 1))]
        assert q == pytest.approx(1 / (1 + math.exp(-sum(b * v for b, v in zip(beta, now, strict=True)))), abs=1e-5)


def test_model_rules_against_plain_predicates(spark):
    rng = random.Random(12)
    names = [f"{a}{m}" for m in (1, 2, 3, 4) for a in ("up", "dn", "usz", "dsz", "pay_up", "pay_dn")]
    flags = ["breakout", "milddrop", "gate_up", "gate_down", "gate_up_2", "strict_up_2", "strict_down"]
    rows = []
    for k in range(300):
        q = rng.choice([None, rng.random()])
        rows.append((k, rng.choice(["asia", "london", "us_afternoon", "other"]), q, None if q is None else 1 - q, *(rng.random() < 0.6 for _ in flags), *(rng.random() for _ in names)))
    kinds = "k int, session string, q_up double, q_down double, " + ", ".join(f"{c} boolean" for c in flags) + ", " + ", ".join(f"{c} double" for c in names)
    got = {(r["k"], r["rule"]): (r["side"], r["minute"]) for r in rules.signals(spark.createDataFrame(rows, kinds), rules.MODEL, ["k"]).collect()}
    want = {}
    for row in rows:
        f = dict(zip(["k", "session", "q_up", "q_down", *flags, *names], row, strict=True))
        if f["q_up"] is None:
            continue
        up4, up2, dn2, s = f["q_up"] - f["up4"], f["q_up"] - f["up2"], f["q_down"] - f["dn2"], f["session"]
        for name, more, last in (("logit_overlay", 0.08, 0.10), ("logit_gated_session", 0.06, 0.08)):
            if s == "asia" and f["breakout"] and f["gate_up"] and up4 > more:
                want[f["k"], name] = ("up", 4)
            elif s == "london" and f["milddrop"] and f["gate_down"] and dn2 > more or s == "us_afternoon" and f["milddrop"] and dn2 > last:
                want[f["k"], name] = ("down", 2)
        if s in ("london", "us_afternoon") and f["milddrop"] and dn2 > 0.06:
            want[f["k"], "logit_value"] = ("down", 2)
        elif f["breakout"] and up4 > 0.06:
            want[f["k"], "logit_value"] = ("up", 4)
        for name, a, b, edge in (("logit_edge_06", "gate_up_2", "gate_down", 0.06), ("logit_edge_10", "strict_up_2", "strict_down", 0.10)):
            if f[a] and up2 > edge:
                want[f["k"], name] = ("up", 2)
            elif f[b] and dn2 > edge:
                want[f["k"], name] = ("down", 2)
    assert got == want


def test_uncapped_equals_fold_without_binding_size(spark):
    rng = random.Random(3)
    rows = [(0, i, 0.1, p := rng.uniform(0.2, 0.8), 1e12, (rng.random() < 0.5) - p) for i in range(40)]
    df = spark.createDataFrame(rows, "s int, n int, fraction double, price double, size double, unit_pnl double")
    a, b = capital.capital_fold(df, ["s"], ["n"]).first(), capital.uncapped(df, ["s"], ["n"]).first()
    assert a["ending"] == pytest.approx(b["ending"]) and a["max_drawdown"] == pytest.approx(b["max_drawdown"])


def test_splits_and_folds(spark):
    df = spark.createDataFrame([("s", i) for i in range(10)], "s string, i int")
    sizes = {r["split"]: r["count"] for r in validation.split_50_25_25(df, ["s"], ["i"], 3).groupBy("split").count().collect()}
    assert sizes == {"train": 5, "validation": 2, "test": 3, "full": 10, "latest": 3}
    runs = spark.createDataFrame([(f"r{i}",) for i in range(9)], "run_name string")
    folds = validation.run_folds(runs).collect()
    assert {r["fold_id"] for r in folds} == {1, 2, 3, 4, 5}
    assert sorted((r["split"], r["run_name"]) for r in folds if r["fold_id"] == 1) == [("test", "r4"), ("train", "r0"), ("train", "r1"), ("train", "r2"), ("validation", "r3")]
    assert not any(r["train"] for r in validation.time_split(df, ["s"], ["i"]).collect())


def test_latest_complete_run(spark):
    cover = spark.createDataFrame([("a", 5, 1), ("b", 5, 1), ("c", 4, 1)], "run_name string, file_count int, row_count int")
    assert {r["run_name"]: (r["is_complete"], r["is_latest"]) for r in validation.complete_runs(cover).collect()} == {"a": (True, False), "b": (True, True), "c": (False, False)}


def test_imputer_drops_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None, True), (3.0, None, True), (None, None, False), (100.0, None, False)], "a double, b double, train boolean")
    out = models.median_imputed(df, ["a", "b"], "train")
    assert out.columns == ["a", "train"] and sorted(r["a"] for r in out.collect()) == [1.0, 2.0, 3.0, 100.0]


def test_walk_forward_uses_only_the_past(spark):
    rng = random.Random(5)
    rows = [("s", i, x := rng.gauss(0, 1), float(x + rng.gauss(0, 0.5) > 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "s string, n int, x double, y double")
    got = {r["n"]: r["q"] for r in models.walk_forward_logit(df, ["s"], "n", "y", ["x"]).collect()}
    assert all(got[i] is None for i in range(50)) and all(got[i] is not None for i in range(75, 200))
    assert statistics.mean((got[i] > 0.5) == (rows[i][3] == 1) for i in range(75, 200)) > 0.75
    changed = spark.createDataFrame([(*r[:3], 1 - r[3] if r[1] >= 150 else r[3]) for r in rows], "s string, n int, x double, y double")
    again = {r["n"]: r["q"] for r in models.walk_forward_logit(changed, ["s"], "n", "y", ["x"]).collect()}
    assert all(got[i] == again[i] for i in range(75, 150))


def test_scores(spark):
    df = spark.createDataFrame([("a", 110.0, 0.1, None, 0.5), ("b", 90.0, None, 2.0, 0.4)], "s string, total_return double, max_drawdown double, profit_factor double, worst_144 double").withColumn("one", F.lit(1))
    got = {r["s"]: r["score"] for r in scoring.rank_score(df, scoring.SCORES["framework"], ["one"]).collect()}
    assert got == {"a": pytest.approx(0.35 + 0.25 + 0.10 + 0.20), "b": pytest.approx(0.175 + 0.125 + 0.20 + 0.10)}


def test_first_match_wins_and_null_never_fires(spark):
    row = {f"{a}{m}": None for m in (1, 2, 3, 4) for a in ("m", "up", "dn", "usz", "dsz", "pay_up", "pay_dn")}
    row |= {"k": 1, "m1": -25.0, "m2": 60.0, "dn1": 0.8, "dn2": 0.1, "dsz1": 5.0, "dsz2": 5.0, "pay_dn1": 0.1, "pay_dn2": 0.8}
    kinds = ", ".join(f"{c} {'int' if c == 'k' else 'double'}" for c in row)
    df = spark.createDataFrame([tuple(row.values())], kinds)
    got = {r["rule"]: (r["side"], r["minute"]) for r in rules.signals(df, [r for r in rules.catalogue() if r.name in ("switch_1", "switch_2", "m4_breakout", "m2_extreme_fade")], ["k"]).collect()}
    assert got == {"switch_1": ("down", 1), "switch_2": ("down", 1), "m2_extreme_fade": ("down", 2)}


def test_catalogue_has_no_phantom_rules():
    names = {r.name for r in rules.catalogue()}
    assert len(names) > 100 and all(r.side in ("up", "down") and r.minute in (1, 2, 3, 4) for r in rules.catalogue())


def test_files_round_trip(spark, tmp_path):
    for run in ("run-a", "run-b"):
        (tmp_path / "root" / run).mkdir(parents=True)
        (tmp_path / "root" / run / "chunk1.csv").write_text(" ts_iso ,slug,final_price\n2024-01-01T00:00:00+08:00,m-1,5\n2024-01-01T00:00:00+08:00,m-1,oops\n,,\n")
    raw = sources.run_files(spark, str(tmp_path / "root"))
    assert {r["run_name"] for r in raw.collect()} == {"run-a", "run-b"} and "ts_iso" in raw.columns and {r["source_file"] for r in raw.collect()} == {"chunk1.csv"}
    one = sources.merged_run(sources.quote_files(spark, str(tmp_path / "root" / "run-a")))
    assert one.count() == 1 and one.first()["ts_utc"] == dt.datetime(2023, 12, 31, 16)
    sources.written(one, str(tmp_path / "out"))
    assert sources.loaded(spark, str(tmp_path / "out")).count() == 1
    sources.metadata_written(one.agg(F.count("*").alias("rows")), str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).first()["rows"] == 1
    both = sources.united(one.select("slug"), one.select("final_price"), layer=["x", "y"])
    assert both.count() == 2 and set(both.columns) == {"slug", "final_price", "source_layer"}
    (tmp_path / "p.csv").write_text("timestamp,iv\n2024-01-01 00:00:00,0.5\nbad,1\n")
    assert [r["iv"] for r in sources.provider_series(spark, str(tmp_path / "p.csv")).collect()] == [0.5]


def test_stream_of_windows(spark, tmp_path):
    from tideledger.streaming.quotes import market_windows

    rows = [("m", dt.datetime(2024, 1, 1, 0, m), float(m)) for m in range(12)] + [("m", dt.datetime(2024, 1, 1, 1), 0.0)]
    spark.createDataFrame(rows, "market_id string, ts_utc timestamp, mid_up_cents double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("market_id string, ts_utc timestamp, mid_up_cents double").parquet(str(tmp_path / "in"))
    query = market_windows(stream, ["market_id"]).writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r["n_quotes"], r["open_mid"], r["last_mid"]) for r in spark.table("windows").collect())
    assert got == [(2, 10.0, 11.0), (5, 0.0, 4.0), (5, 5.0, 9.0)]
