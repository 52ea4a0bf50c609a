"""Ordered computations within a series. Every window is partitioned by its series, or by stretches of it where a series may be everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def numbered(df: DataFrame, series: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Rows numbered from 0 within their series."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*series).orderBy(*order)) - 1)


def ranged(df: DataFrame, series: list[str], order: list[str], name: str = "n", total: str | None = None, stretch: str | None = None) -> DataFrame:
    """Rows numbered from 0 within their series (null is one too) without a window over it; ``total`` names a column for the series' number of rows.

    Rows are dealt by ranges of series and order, so one series alone is many
    tasks; a row's number is its place in its range plus the rows of the series
    in the ranges before, of which there is a row for each range and series.
    Rows come sorted; ``stretch`` names a column for the number of the range.
    """
    laid = df.repartitionByRange(*series, *order).sortWithinPartitions(*series, *order)
    laid = cut(laid.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33).cast("int"))
    counts = laid.groupBy(*series, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    every = Window.partitionBy(*series) if series else Window.partitionBy(F.lit(0))
    before = every.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(series)), F.col("_range").alias("_in"), "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"), F.sum("_rows").over(every).alias("_all"))
    same = F.col("_range") == F.col("_in")
    for i, c in enumerate(series):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    out = laid.join(counts, same).withColumn(name, F.col("_base") + F.col("_at") - F.col("_first"))
    out = out.withColumns({n: F.col(c) for n, c in ((total, "_all"), (stretch, "_range")) if n})
    return out.drop("_at", "_range", "_in", "_first", "_base", "_all", *(f"_s{i}" for i in range(len(series))))


def running(df: DataFrame, series: list[str], order: list[str], sums: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """Adds running sums along each series, the row's own included (``sums``: name to column), and sums over all of it (``totals``).

    Rows are dealt by ranges: sums are taken within a range, beside those of the
    series' ranges before, of which there is a row each.
    """
    totals = totals or {}
    rows = ranged(df, series, order, "_i", stretch="_stretch")
    within = Window.partitionBy(*series, "_stretch").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy(*series, "_stretch").agg(*(F.sum(c).alias(f"_p{i}") for i, c in enumerate(sums.values())), *(F.sum(c).alias(f"_t{i}") for i, c in enumerate(totals.values())))
    every = Window.partitionBy(*series) if series else Window.partitionBy(F.lit(0))
    before = every.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(series)), F.col("_stretch").alias("_in"), *(F.coalesce(F.sum(f"_p{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))), *(F.sum(f"_t{i}").over(every).alias(f"_a{i}") for i in range(len(totals))))
    same = F.col("_stretch") == F.col("_in")
    for i, c in enumerate(series):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    out = rows.withColumns({name: F.sum(c).over(within) for name, c in sums.items()}).join(bases, same)
    out = out.withColumns({**{name: F.coalesce(F.col(name), F.lit(0)) + F.col(f"_b{i}") for i, name in enumerate(sums)}, **{name: F.col(f"_a{i}") for i, name in enumerate(totals)}})
    return out.drop("_i", "_stretch", "_in", *(f"_s{i}" for i in range(len(series))), *(f"_b{i}" for i in range(len(sums))), *(f"_a{i}" for i in range(len(totals))))


def _pairs(rows: DataFrame, series: list[str], y: str, lags: list[int]) -> DataFrame:
    """series, lag, _y, _before: each numbered row (``_i``) with the one ``lag`` rows before, met by number."""
    key = F.to_json(F.struct(*(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(series)), F.lit(1).alias("x")))
    here = rows.select(*series, key.alias("_key"), "_i", F.col(y).alias("_y"))
    back = here.select("_key", F.col("_y").alias("_before"), F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), (F.col("_i") + k).alias("_i")) for k in lags))).alias("_x")).select("_key", "_before", "_x.*")
    return here.join(back, ["_key", "_i"]).drop("_key", "_i")


def autocorrelation(df: DataFrame, series: list[str], order: list[str], y: str, lags: list[int]) -> DataFrame:
    """series, lag, autocorr: correlation of y with itself ``lag`` rows before."""
    rows = ranged(df.select(*series, *order, y), series, order, "_i")
    found = _pairs(rows, series, y, lags).groupBy(*series, "lag").agg(F.corr("_y", "_before").alias("autocorr"))
    every = df.select(*series).distinct().withColumn("lag", F.explode(F.array(*map(F.lit, lags))))
    return every.join(found, [*series, "lag"], "left")


def transitions(df: DataFrame, series: list[str], order: list[str], y: str) -> DataFrame:
    """before, after, n, share: how often one state follows another, and its share of the first state's rows."""
    rows = ranged(df.select(*series, *order, y), series, order, "_i")
    pairs = _pairs(rows, series, y, [1]).where("_before is not null").groupBy(F.col("_before").alias("before"), F.col("_y").alias("after")).agg(F.count("*").alias("n"))
    return pairs.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("before")))


def longest_run(df: DataFrame, series: list[str], order: list[str], holds: Column) -> DataFrame:
    """series, longest: the longest run of rows where ``holds``.

    A stretch of a series is summed up as its length, the runs that it begins
    and ends with and its longest; a series' stretches, one for each range that
    it is dealt over, are joined in a fold.
    """
    rows = ranged(df.withColumn("_on", F.coalesce(holds, F.lit(False))).select(*series, *order, "_on"), series, order, "_i", stretch="_stretch")
    by = [*series, "_stretch"]
    # a run's rows have the same number of rows before them that aren't of one
    off = F.count(F.when(~F.col("_on"), 1)).over(Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("_off", off).groupBy(*by, "_off").agg(F.count(F.when(F.col("_on"), 1)).alias("_len"), F.count(F.when(~F.col("_on"), 1)).alias("_first"))
    parts = runs.groupBy(*by).agg(F.sum(F.col("_len") + F.col("_first")).alias("len"), F.max("_len").alias("best"), F.max(F.when(F.col("_off") == 0, F.col("_len"))).alias("head"), F.max_by("_len", "_off").alias("tail"))
    part = F.struct(F.col("_stretch").alias("s"), "len", "best", F.coalesce("head", F.lit(0)).cast("long").alias("head"), "tail")
    start = F.struct(F.lit(0).cast("long").alias("best"), F.lit(0).cast("long").alias("tail"))

    def joined(acc: Column, x: Column) -> Column:
        tail = F.when(x["head"] == x["len"], acc["tail"] + x["len"]).otherwise(x["tail"])
        return F.struct(F.greatest(acc["best"], x["best"], acc["tail"] + x["head"]).alias("best"), tail.alias("tail"))

    return parts.groupBy(*series).agg(F.array_sort(F.collect_list(part)).alias("_parts")).select(*series, F.aggregate("_parts", start, joined)["best"].alias("longest"))


def _all_there(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def _history(df: DataFrame, series: list[str], order: list[str], y: str, levels: list[list[str]], chunk: Column | None, half_life: float | None) -> tuple[DataFrame, DataFrame]:
    """``df`` with a row's number ``_row``, and for each row and level whose keys are there (_row, _level from 1) the count ``_n`` and mean ``_q`` of y over the earlier rows of its key.

    All levels lie in one table of (row, level), so they share their shuffles.
    ``chunk`` cuts the order into stretches (it never falls along it): counts,
    sums and a row's number in its key are taken within the chunk, beside those
    of the key's chunks before, of which there is a row each; a key with many
    rows is as many tasks as it has chunks.

    Weights that halve every ``half_life`` rows of the key grow within blocks of
    60 half-lives and start again: what lies more than a block back weighs less
    than 2**-60, so a row's sums are those of its block and of the one before.
    """
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_chunk", F.lit(0) if chunk is None else chunk))
    keys = [F.when(_all_there(keys), F.to_json(F.struct(*(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate([*series, *keys])), F.lit(1).alias("x")))) for keys in levels]
    long = rows.select("_row", "_chunk", *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.col(y).cast("double").alias("_y"), F.posexplode(F.array(*keys)).alias("_level", "_key"))
    long = long.where("_key is not null").withColumn("_level", F.col("_level") + 1)
    by, order = ["_level", "_key"], [f"_o{i}" for i in range(len(order))]
    along = Window.partitionBy(*by, "_chunk").orderBy(*order)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    local = long.withColumns({"_n": F.count("_y").over(before), "_s": F.coalesce(F.sum("_y").over(before), F.lit(0.0)), "_k": F.row_number().over(along) - 1})
    chunks = long.groupBy(*by, "_chunk").agg(F.count("*").alias("_rows"), F.count("_y").alias("_cn"), F.sum("_y").alias("_cs"))
    ahead = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(*by, "_chunk", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_b{c}") for c in ("_rows", "_cn", "_cs")))
    if chunk is not None:
        local = local.join(chunks, [*by, "_chunk"]).withColumns({"_n": F.col("_n") + F.col("_b_cn"), "_s": F.col("_s") + F.col("_b_cs"), "_k": F.col("_k") + F.col("_b_rows")})
    if half_life is None:
        return rows, local.select("_row", "_level", "_n", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).alias("_q"))
    size = int(60 * half_life)
    local = local.select("_row", *by, "_n", "_k", "_y", F.floor(F.col("_k") / size).alias("_b"))
    w = F.pow(F.lit(2.0), (F.col("_k") % size) / F.lit(float(half_life)))
    local = local.withColumns({"_w": F.when(F.col("_y").isNotNull(), w), "_wy": w * F.col("_y")})
    blocks = local.groupBy(*by, (F.col("_b") + 1).alias("_b")).agg(F.sum("_w").alias("_pw"), F.sum("_wy").alias("_pwy"))
    here = Window.partitionBy(*by, "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    sums = local.withColumns({"_w": F.coalesce(F.sum("_w").over(here), F.lit(0.0)), "_wy": F.coalesce(F.sum("_wy").over(here), F.lit(0.0))}).join(blocks, [*by, "_b"], "left")
    weight, total = (F.col(c) + F.coalesce(p, F.lit(0.0)) * 2.0**-60 for c, p in (("_w", "_pw"), ("_wy", "_pwy")))
    return rows, sums.select("_row", "_level", "_n", F.when(weight > 0, total / weight).alias("_q"))


def _backed_off(df: DataFrame, history: tuple[DataFrame, DataFrame], least: int, name: str) -> DataFrame:
    """``df``'s columns with mean, support and level of the first level with ``least`` rows."""
    rows, found = history
    first = found.where(F.col("_n") >= least).groupBy("_row").agg(F.min(F.struct("_level", "_q", "_n")).alias("_x"))
    out = rows.join(first, "_row", "left")
    return out.select(*df.columns, F.col("_x._q").alias(name), F.coalesce("_x._n", F.lit(0)).alias(f"{name}_n"), F.coalesce("_x._level", F.lit(0)).alias(f"{name}_level"))


def backoff_mean(df: DataFrame, series: list[str], order: list[str], y: str, levels: list[list[str]], least: int = 10, name: str = "q", chunk: Column | None = None) -> DataFrame:
    """Mean of y over the earlier rows that share a key, from the first level with ``least`` rows; a null key shares with none.

    Adds ``name``, its support (``name``_n) and level (``name``_level, 0 if none).
    ``chunk`` cuts the order into stretches, so that a key with many rows is many tasks.
    """
    return _backed_off(df, _history(df, series, order, y, levels, chunk, None), least, name)


def ew_mean(df: DataFrame, series: list[str], order: list[str], y: str, half_life: float, name: str, chunk: Column | None = None) -> DataFrame:
    """Mean of y over a series' earlier rows, weights halving every ``half_life`` rows; adds ``name`` and ``name``_n. ``chunk`` as in backoff_mean."""
    rows, found = _history(df, series, order, y, [[]], chunk, half_life)
    return rows.join(found, "_row").select(*df.columns, F.col("_q").alias(name), F.col("_n").alias(f"{name}_n"))


def ew_backoff_mean(df: DataFrame, series: list[str], order: list[str], y: str, levels: list[list[str]], half_life: float = 20, least: int = 10, name: str = "q", chunk: Column | None = None) -> DataFrame:
    """As backoff_mean, with exponential weights among the rows that share the key."""
    return _backed_off(df, _history(df, series, order, y, levels, chunk, half_life), least, name)


def rolling_health(trades: DataFrame, series: list[str], order: list[str], pnl: str, last: int = 20, least: int = 8) -> DataFrame:
    """Mean, win rate and mean over population deviation of the last trades before each; null with fewer than ``least``."""
    before = Window.partitionBy(*series).orderBy(*order).rowsBetween(-last, -1)
    n, mean, dev = F.count(pnl).over(before), F.avg(pnl).over(before), F.stddev_pop(pnl).over(before)
    ok = n >= least
    return trades.withColumns(
        {
            "health_n": n,
            "health_mean": F.when(ok, mean),
            "health_win": F.when(ok, F.avg((F.col(pnl) > 0).cast("double")).over(before)),
            "health_sharpe": F.when(ok & (dev > 0), mean / dev),
        }
    )


def hit_rate(trades: DataFrame, series: list[str], order: list[str], won: Column, least: int = 8) -> DataFrame:
    """Share of earlier trades won, of those known; null with fewer than ``least``."""
    marked = trades.withColumns({"_one": F.lit(1), "_seen": won.isNotNull().cast("int"), "_own": F.coalesce(won, F.lit(False)).cast("int")})
    sums = running(marked, series, order, {"_n": "_one", "_known": "_seen", "_won": "_own"})
    known = F.col("_known") - F.col("_seen")
    rate = F.when((F.col("_n") > least) & (known > 0), (F.col("_won") - F.col("_own")) / known)
    return sums.withColumn("hit_rate", rate).drop("_one", "_seen", "_own", "_n", "_known", "_won")


def drawdowns(returns: DataFrame, series: list[str], order: list[str], r: str) -> DataFrame:
    """Adds wealth (from 1), its peak so far and the drawdown from it.

    Within a stretch wealth and peak start from 1; a stretch's product and peak
    are carried to those behind it, of which a series has one for each range.
    """
    rows = ranged(returns, series, order, "_i", stretch="_stretch")
    by = [*series, "_stretch"]
    so_far = Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_w", F.product(1.0 + F.col(r)).over(so_far)).withColumn("_p", F.max("_w").over(so_far))
    ends = local.groupBy(*by).agg(F.max_by("_w", "_i").alias("_all"), F.max_by("_p", "_i").alias("_top"))
    every = Window.partitionBy(*series) if series else Window.partitionBy(F.lit(0))
    before = every.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_from", F.coalesce(F.product("_all").over(before), F.lit(1.0)))
    ends = ends.withColumn("_high", F.max(F.col("_from") * F.col("_top")).over(before))
    ends = ends.select(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(series)), F.col("_stretch").alias("_in"), "_from", "_high")
    same = F.col("_stretch") == F.col("_in")
    for i, c in enumerate(series):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    out = local.join(ends, same).withColumn("wealth", F.col("_from") * F.col("_w")).withColumn("peak", F.greatest("_high", F.col("_from") * F.col("_p")))
    out = out.withColumn("drawdown", (F.col("peak") - F.col("wealth")) / F.col("peak"))
    return out.drop("_i", "_stretch", "_w", "_p", "_in", "_from", "_high", *(f"_s{i}" for i in range(len(series))))


def sliding_compound(events: DataFrame, series: list[str], order: list[str], r: str, size: int) -> DataFrame:
    """Per series: count, worst, median, shares above 0 and 10 %, and active share of the compounded returns over each full window of events.

    A series' rows fall in blocks as long as a window. A window is the end of
    one block and the beginning of the next: its product is that of the one
    from its first row on, times that of the other up to its last.
    """
    rows = ranged(events.select(*series, *order, F.col(r).cast("double").alias("_r")), series, order, "_i").withColumn("_block", F.floor(F.col("_i") / size))
    along = Window.partitionBy(*series, "_block").orderBy("_i")
    one, there = 1.0 + F.coalesce("_r", F.lit(0.0)), F.col("_r").isNotNull().cast("long")
    head, tail = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(0, Window.unboundedFollowing)
    key = F.to_json(F.struct(*(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(series)), F.lit(1).alias("x")))
    sums = rows.withColumns({"_up": F.product(one).over(head), "_a": F.sum(there).over(head), "_down": F.product(one).over(tail), "_b": F.sum(there).over(tail), "_key": key})
    # the window that begins at a row ends size - 1 rows on, in the next block unless it is a block
    begins = sums.select("_key", (F.col("_i") + size - 1).alias("_i"), F.col("_down").alias("_d"), F.col("_b").alias("_e"))
    full = sums.select(*series, "_key", "_i", "_up", "_a").join(begins, ["_key", "_i"])
    whole = F.col("_i") % size == size - 1
    c = F.when(whole, F.col("_up")).otherwise(F.col("_up") * F.col("_d")) - 1.0
    active = F.when(whole, F.col("_a")).otherwise(F.col("_a") + F.col("_e")) > 0
    full = full.withColumns({"_c": c, "_on": active})
    c = F.col("_c")
    found = full.groupBy(*series).agg(
        F.count(c).alias("n_windows"),
        F.min(c).alias("worst"),
        F.median(c).alias("median"),
        F.avg((c > 0).cast("double")).alias("share_positive"),
        F.avg((c >= 0).cast("double")).alias("share_not_negative"),
        F.avg((c > 0.10).cast("double")).alias("share_over_10"),
        F.avg(F.col("_on").cast("double")).alias("active_rate"),
    )
    return events.select(*series).distinct().join(found, series, "left").fillna(0, ["n_windows"])


def recent_tail(df: DataFrame, series: list[str], order: list[str], last: int) -> DataFrame:
    """Adds ``recent``: whether a row is among the last ``last`` of its series, if that has as many."""
    rows = ranged(df, series, order, "_n", "_total")
    return rows.withColumn("recent", (F.col("_n") >= F.col("_total") - last) & (F.col("_total") >= last)).drop("_n", "_total")


def running_total(df: DataFrame, series: list[str], order: list[str], x: str, name: str) -> DataFrame:
    """Adds the sum of x from the series' first row to this one."""
    return running(df, series, order, {name: x})


def percent_rank(x: Column, partition: list[str]) -> Column:
    """Average rank over the number of values, null for null; equal after rounding to 12 digits is a tie."""
    v = F.round(x, 12)
    each, ties = Window.partitionBy(*partition, v.isNull()), Window.partitionBy(*partition, v)
    first = F.rank().over(Window.partitionBy(*partition, v.isNull()).orderBy(v))
    return F.when(v.isNotNull(), (first + (F.count("*").over(ties) - 1) / 2.0) / F.count("*").over(each))
