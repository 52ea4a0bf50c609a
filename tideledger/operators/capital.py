"""Capital paths: ordered folds over each key's sorted trades.

A fold is an expression over the key's sorted trades (no Python), so a key is
one row of state and keys run in parallel. A key's trades are one array: keys
are (series, split, rule, sizing), and a rule trades an event once at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import drawdowns

START = 100.0
#: What a step of the path holds.
STEP = ("i", "cost", "pnl", "before", "after", "drawdown")


def capital_fold(trades: DataFrame, by: list[str], order: list[str], fraction: str = "fraction", price: str = "price", size: str = "size", unit_pnl: str = "unit_pnl", quota: Column | int | None = None, window: int = 144, cooldown: Column | int = 0, ordinal: str = "n", steps: bool = False, wide_quota: Column | int | None = None, wide_window: int = 864) -> DataFrame:
    """trades, ending, total_return, max_drawdown of each key, and with ``steps`` its path: an array of the order columns and STEP.

    A trade costs min(capital * fraction, capital, size * price). With a quota
    no more than that many trades are taken among the last ``window`` events,
    with a wide quota no more than that among the last ``wide_window``; after two losses in a row the next ``cooldown`` events are skipped
    (``ordinal`` numbers the events, also those without a trade). All may
    differ by key.
    """
    limited = quota is not None or wide_quota is not None or not isinstance(cooldown, int) or cooldown > 0
    reach = max(window, wide_window) if wide_quota is not None else window
    limits = [(F.lit(2**31 - 1) if x is None else x if isinstance(x, Column) else F.lit(x)).cast("long").alias(n) for n, x in (("q", quota), ("wq", wide_quota), ("c", cooldown))]
    row = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), *(F.col(c).cast("double").alias(n) for c, n in ((fraction, "f"), (price, "p"), (size, "s"), (unit_pnl, "u"))), (F.col(ordinal) if limited else F.lit(0)).cast("long").alias("i"), *limits)
    usable = trades.where(F.col(price).isNotNull() & (F.col(price) > 0) & F.col(size).isNotNull() & F.col(unit_pnl).isNotNull() & (F.col(fraction) > 0))
    lists = usable.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("_trades"))
    path = "array<struct<" + ", ".join([*(f"o{i}: {trades.schema[c].dataType.simpleString()}" for i, c in enumerate(order)), "i: bigint", *(f"{n}: double" for n in STEP[1:])]) + ">>"
    start = F.struct(F.lit(START).alias("b"), F.lit(START).alias("peak"), F.lit(0.0).alias("dd"), F.lit(0).alias("k"), F.lit(0).alias("losses"), F.lit(-1).cast("long").alias("until"), F.array().cast("array<long>").alias("taken"), F.array().cast(path).alias("path"))

    def since(taken: Column, after: Column) -> Column:
        return F.filter(taken, lambda i: i > after)

    def step(s, x):
        recent = F.filter(s["taken"], lambda i: i > x["i"] - reach) if limited else s["taken"]
        within = {w: recent if w == reach else since(recent, x["i"] - w) for w in (window, wide_window)}
        cost = F.least(s["b"] * x["f"], s["b"], x["s"] * x["p"])
        allowed = (cost > 0) & (x["i"] > s["until"]) & (F.size(within[window]) < x["q"]) if limited else cost > 0
        if wide_quota is not None:
            allowed = allowed & (F.size(within[wide_window]) < x["wq"])
        pnl = cost / x["p"] * x["u"]
        after = s["b"] + pnl
        peak = F.greatest(s["peak"], after)
        down = F.greatest(s["dd"], F.when(peak > 0, (peak - after) / peak).otherwise(0.0))
        lost = pnl < 0
        second = lost & (s["losses"] >= 1)
        here = F.struct(*(x[f"o{i}"].alias(f"o{i}") for i in range(len(order))), x["i"].alias("i"), *(v.alias(n) for n, v in zip(STEP[1:], (cost, pnl, s["b"], after, down), strict=True)))
        taken = F.struct(
            after.alias("b"),
            peak.alias("peak"),
            down.alias("dd"),
            (s["k"] + 1).alias("k"),
            F.when(lost & ~second, s["losses"] + 1).otherwise(0).alias("losses"),
            F.when(second, x["i"] + x["c"]).otherwise(s["until"]).alias("until"),
            (F.array_append(recent, x["i"]) if limited else recent).alias("taken"),
            (F.array_append(s["path"], here) if steps else s["path"]).alias("path"),
        )
        return F.when(allowed, taken).otherwise(s)

    folded = lists.withColumn("_state", F.aggregate("_trades", start, step))
    out = folded.select(*by, F.col("_state.k").cast("long").alias("trades"), F.col("_state.b").alias("ending"), (F.col("_state.b") / START - 1.0).alias("total_return"), F.col("_state.dd").alias("max_drawdown"), F.col("_state.path").alias("path"))
    return out if steps else out.drop("path")


def uncapped(trades: DataFrame, by: list[str], order: list[str], fraction: str = "fraction", price: str = "price", unit_pnl: str = "unit_pnl", also: tuple[Column, ...] = ()) -> DataFrame:
    """The same where no size binds: the product of 1 + f * pnl / price, with drawdown from the start or a later peak.

    ``also`` are further aggregates of the trades, taken in the same pass.
    """
    path = drawdowns(trades.withColumn("_r", F.col(fraction) * F.col(unit_pnl) / F.col(price)), by, order, "_r")
    peak = F.greatest(F.lit(1.0), F.col("peak"))
    last = F.max_by(START * F.col("wealth"), F.struct(*order))
    return path.groupBy(*by).agg(F.count("*").alias("trades"), last.alias("ending"), (last / START - 1.0).alias("total_return"), F.max((peak - F.col("wealth")) / peak).alias("max_drawdown"), *also)


def trade_log(trades: DataFrame, by: list[str], order: list[str], **fold) -> DataFrame:
    """Every trade that the fold takes, with its cost, pnl, capital before and after it and the drawdown so far."""
    path = capital_fold(trades, by, order, steps=True, **fold).select(*by, F.explode("path").alias("x"))
    return path.select(*by, *(F.col(f"x.o{i}").alias(c) for i, c in enumerate(order) if c not in by), "x.i", "x.cost", "x.pnl", "x.before", F.col("x.after").alias("capital_after"), "x.drawdown")


def path_metrics(log: DataFrame, groups: DataFrame, by: list[str], sizes: tuple[int, ...] = (48, 144, 864), recent: int = 864) -> DataFrame:
    """One row for each of ``groups`` (by, total: its number of events) from the trades of ``trade_log`` (by, i, cost, pnl, before, capital_after, drawdown).

    trades, ending, total_return, max_drawdown, win_rate, profit_factor, p10_return,
    loss_streak, recent_return, and for each size of window of events worst_N,
    share_positive_N, share_over_10_N and active_N over all full windows. A window's
    return only changes where a trade enters or leaves it, so windows are met at
    these places and count by how many events stay alike: work grows with trades,
    not with events times rules. Null where a group has too few events.
    """
    events = log.join(groups, by).select(*by, "total", F.col("i").alias("n"), "cost", "pnl", (F.col("pnl") / F.col("before")).alias("r"), F.col("capital_after").alias("after"), "drawdown")
    edges = events.select(*by, "total", F.explode(F.array(*(F.lit(s - 1).cast("long") for s in sizes), *(F.col("n") + s for s in sizes))).alias("n")).where("n < total").distinct()
    line = events.unionByName(edges, allowMissingColumns=True)
    along = Window.partitionBy(*by).orderBy("n")
    stays = F.least(F.coalesce(F.lead("n").over(along), F.col("total")), F.col("total")) - F.col("n")
    line = line.withColumn("stays", stays).withColumn("run", F.count(F.when(F.col("pnl") >= 0, 1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    line = line.withColumn("streak", F.count(F.when(F.col("pnl") < 0, 1)).over(Window.partitionBy(*by, "run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    table = []
    for s in sizes:
        frame = along.rangeBetween(-(s - 1), 0)
        line = line.withColumns({f"v{s}": F.product(1.0 + F.coalesce("r", F.lit(0.0))).over(frame) - 1.0, f"a{s}": F.count("r").over(frame)})
        full = F.when(F.col("n") >= s - 1, F.col("stays"))
        windows = F.first("total") - (s - 1)

        def share(holds: Column, full: Column = full, windows: Column = windows) -> Column:
            return F.sum(F.when(holds, full).otherwise(0)) / F.nullif(windows, F.lit(0))

        table += [
            F.min(F.when(full > 0, F.col(f"v{s}"))).alias(f"worst_{s}"), share(F.col(f"v{s}") > 0).alias(f"share_positive_{s}"), share(F.col(f"v{s}") > 0.10).alias(f"share_over_10_{s}"), share(F.col(f"a{s}") > 0).alias(f"active_{s}"),
        ]
    gains, losses = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.sum(F.when(F.col("pnl") < 0, F.col("pnl")).otherwise(0.0))
    found = line.groupBy(*by).agg(
        F.count("pnl").alias("trades"),
        F.max_by("after", F.when(F.col("pnl").isNotNull(), F.col("n"))).alias("ending"),
        F.max("drawdown").alias("max_drawdown"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.when(losses != 0, gains / F.abs(losses)).alias("profit_factor"),
        F.percentile(F.col("pnl") / F.col("cost"), F.lit(0.1)).alias("p10_return"),
        F.max("streak").alias("loss_streak"),
        (F.coalesce(F.product(F.when(F.col("n") >= F.col("total") - recent, 1.0 + F.col("r"))), F.lit(1.0)) - 1.0).alias("recent_return"),
        *table,
    )
    out = groups.join(found, by, "left").fillna({"trades": 0, "ending": START, "max_drawdown": 0.0, "loss_streak": 0})
    out = out.withColumn("total_return", F.col("ending") / START - 1.0)
    for c, s in [("recent_return", recent), *((f"{c}_{s}", s) for s in sizes for c in ("worst", "share_positive", "share_over_10", "active"))]:
        out = out.withColumn(c, F.when(F.col("total") >= s, F.coalesce(c, F.lit(0.0))))
    return out


def event_returns(events: DataFrame, trades: DataFrame, on: list[str], r: str) -> DataFrame:
    """Every event with the return of its trade; null without one."""
    return events.join(trades.select(*on, r), on, "left")
