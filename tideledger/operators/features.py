"""Per-market rollups: one shuffle by market feeds the window and every aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio

MINUTE_US = 60_000_000


def first_value(c: str, order: Column, where: Column | None = None) -> Column:
    """First value in order that isn't null."""
    ok = F.col(c).isNotNull() if where is None else F.col(c).isNotNull() & where
    return F.min_by(F.col(c), F.when(ok, order))


def last_value(c: str, order: Column, where: Column | None = None) -> Column:
    ok = F.col(c).isNotNull() if where is None else F.col(c).isNotNull() & where
    return F.max_by(F.col(c), F.when(ok, order))


def market_rollup(quotes: DataFrame, key: list[str], t: str = "t", ord_: str = "ord", mid: str = "mid_up_cents") -> DataFrame:
    """Times, counts, open/last/low/high mid, median spread, label, range and source files of each market."""
    order = F.struct(t, ord_)
    final, target = last_value("final_price", order), first_value("target_price", order)
    out = quotes.groupBy(*key).agg(
        F.min(t).alias("first_t"),
        F.max(t).alias("last_t"),
        F.count("*").alias("n_quotes"),
        first_value(mid, order).alias("open_mid"),
        last_value(mid, order).alias("last_mid"),
        F.min(mid).alias("low_mid"),
        F.max(mid).alias("high_mid"),
        F.median("spread_up_cents").alias("median_spread"),
        target.alias("target"),
        final.alias("final"),
        F.array_join(F.array_sort(F.collect_set("source_file")), ",").alias("files"),
    )
    outcome = F.when(F.col("target").isNotNull() & F.col("final").isNotNull(), F.when(F.col("final") > F.col("target"), 1.0).otherwise(0.0))
    return out.withColumn("mid_range", F.col("high_mid") - F.col("low_mid")).withColumn("outcome", outcome)


def from_start(quotes: DataFrame, key: list[str], t: str = "t") -> DataFrame:
    """Quotes with ``since``, the time since their market's first quote."""
    return quotes.withColumn("since", F.col(t) - F.min(t).over(Window.partitionBy(*key)))


#: What a checkpoint keeps of the last row at or before it: column, name.
SNAPSHOT = (
    ("move", "move"), ("mid_up_prob", "prob"), ("buy_up_cents", "up"), ("buy_down_cents", "dn"), ("sell_up_cents", "sell_up"), ("sell_down_cents", "sell_dn"),
    ("buy_up_size", "usz"), ("buy_down_size", "dsz"), ("sell_up_size", "susz"), ("sell_down_size", "sdsz"),
    ("bid_depth_up_5", "bdu"), ("ask_depth_up_5", "adu"), ("bid_depth_down_5", "bdd"), ("ask_depth_down_5", "add"),
    ("spread_up_cents", "spu"), ("spread_down_cents", "spd"),
)


def snapshot(at_us: int, t: str = "t", ord_: str = "ord") -> Column:
    """The last row at or before ``at_us`` after the market's start, taken as it is (nulls stay)."""
    row = F.struct(*(F.col(c).alias(n) for c, n in SNAPSHOT), F.lit(1).alias("there"))
    return F.max_by(row, F.when(F.col("since") <= at_us, F.struct(t, ord_)))


def checkpoints_long(quotes: DataFrame, key: list[str], minutes: list[int], minute_us: int = MINUTE_US) -> DataFrame:
    """One row for each market and minute: the snapshot's columns."""
    started = from_start(quotes, key)
    wide = started.groupBy(*key).agg(*(snapshot(m * minute_us).alias(f"s{m}") for m in minutes))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("minute"), F.col(f"s{m}").alias("s")) for m in minutes)))
    return wide.select(*key, rows.alias("x")).select(*key, "x.minute", "x.s.*").drop("there")


def market_features(quotes: DataFrame, key: list[str], minute_us: int = MINUTE_US, minutes: tuple[int, ...] = (1, 2, 3, 4), fee: float = 0.01) -> DataFrame:
    """One row for each market: label, checkpoints, medians, imbalances, path of the first two minutes, pay-offs."""
    along = Window.partitionBy(*key).orderBy("t", "ord")
    started = from_start(quotes, key).withColumn("early", F.col("since") <= 2 * minute_us)
    started = started.withColumn("step", F.when(F.col("early"), F.col("final_price") - F.lag("final_price").over(along)))
    order = F.struct("t", "ord")
    early = F.col("early")

    def of_early(c: str) -> Column:
        return F.when(early, F.col(c))

    rolled = started.groupBy(*key).agg(
        F.min("t").alias("first_t"),
        F.count("*").alias("n_quotes"),
        F.count_if(early).alias("n_early"),
        first_value("target_price", order).alias("target"),
        last_value("final_price", order).alias("final"),
        *(snapshot(m * minute_us).alias(f"s{m}") for m in minutes),
        F.min_by("mid_up_prob", order).alias("prob0"),
        F.median(of_early("spread_up_cents")).alias("spread"),
        F.median(of_early("spread_down_cents")).alias("spread_dn"),
        F.sum(of_early("trade_count_1s")).alias("trades2"),
        F.sum(of_early("trade_volume_1s")).alias("volume2"),
        F.median(of_early("overround")).alias("overround"),
        F.min(of_early("move")).alias("low_move"),
        F.max(of_early("move")).alias("high_move"),
        F.sum(F.abs("step")).alias("path"),
        F.stddev_samp("step").alias("vol"),
        (last_value("final_price", order, early) - first_value("final_price", order, early)).alias("net"),
    )
    out = {"outcome": F.when(F.col("target").isNotNull() & F.col("final").isNotNull(), F.when(F.col("final") > F.col("target"), 1.0).otherwise(0.0))}
    for m in minutes:
        out |= {f"m{m}": F.col(f"s{m}.move"), f"up{m}": F.col(f"s{m}.up") / 100.0, f"dn{m}": F.col(f"s{m}.dn") / 100.0}
        out |= {f"usz{m}": F.col(f"s{m}.usz").cast("double"), f"dsz{m}": F.col(f"s{m}.dsz").cast("double")}
        out |= {f"spu{m}": F.col(f"s{m}.spu") / 100.0, f"spd{m}": F.col(f"s{m}.spd") / 100.0}
    s2 = {n: F.col(f"s2.{n}") for _, n in SNAPSHOT}
    path = F.coalesce("path", F.lit(0.0))
    out |= {
        "spread": F.col("spread") / 100.0,
        "spread_dn": F.col("spread_dn") / 100.0,
        "imb": ratio(s2["usz"], s2["dsz"]),
        "sell_imb": ratio(s2["susz"], s2["sdsz"]),
        "dep": ratio(s2["bdu"], s2["bdd"]),
        "bpu": ratio(s2["bdu"], s2["adu"]),
        "bp": ratio(s2["bdd"], s2["add"]),
        "prob2": s2["prob"],
        "pm": s2["prob"] - F.col("prob0"),
        "path": path,
        "vol": F.coalesce("vol", F.lit(0.0)),
        "eff": F.when(path > 0, F.abs("net") / path).otherwise(1.0),
        "chop": F.when(path > 0, path / F.greatest(F.abs("net"), F.lit(1e-9))).otherwise(1.0),
        "drawdown": F.abs("low_move"),
        "bps": F.when(F.col("target") != 0, s2["move"] / F.col("target") * 1e4),
        "press": ratio(s2["dn"] * s2["dsz"], s2["up"] * s2["usz"]),
    }
    out = rolled.withColumns(out).drop(*(f"s{m}" for m in minutes))
    pay = {}
    for m in minutes:
        pay[f"pay_up{m}"] = F.col("outcome") - F.col(f"up{m}") - fee
        pay[f"pay_dn{m}"] = (1.0 - F.col("outcome")) - F.col(f"dn{m}") - fee
    return out.withColumns(pay)


#: Columns of the feature row by kind and meaning; {m} stands for each of the minutes 1 to 4 (text of this library).
_MEANINGS = (
    ("m{m}", "move", "price less target at minute {m}"), ("up{m}", "price", "price of Up at minute {m}"), ("dn{m}", "price", "price of Down at minute {m}"),
    ("usz{m}", "liquidity", "size offered of Up at minute {m}"), ("dsz{m}", "liquidity", "size offered of Down at minute {m}"),
    ("spu{m}", "cost", "spread of Up at minute {m}"), ("spd{m}", "cost", "spread of Down at minute {m}"),
    ("pay_up{m}", "pay-off", "profit of a share of Up bought at minute {m}"), ("pay_dn{m}", "pay-off", "profit of a share of Down bought at minute {m}"),
    ("spread", "cost", "median spread of Up in the first two minutes"), ("spread_dn", "cost", "median spread of Down in the first two minutes"),
    ("overround", "cost", "median of both prices less one in the first two minutes"), ("imb", "book", "size imbalance of Up against Down"),
    ("sell_imb", "book", "imbalance of the sizes bid for"), ("dep", "book", "bid depth of Up against Down"), ("bp", "book", "bid against ask depth of Down"),
    ("bpu", "book", "bid against ask depth of Up"), ("press", "book", "money offered of Down against Up"), ("eff", "path", "net over total move"),
    ("chop", "path", "total over net move"), ("vol", "path", "sample deviation of steps"), ("path", "path", "sum of absolute steps"), ("net", "path", "last less first price"),
    ("low_move", "path", "least move"), ("high_move", "path", "largest move"), ("drawdown", "path", "size of the least move"), ("pm", "belief", "change of probability"),
    ("prob0", "belief", "first mid probability"), ("prob2", "belief", "mid probability at minute 2"), ("bps", "move", "move at minute 2 over the target in basis points"),
    ("trades2", "activity", "trades in the first two minutes"), ("volume2", "activity", "volume in the first two minutes"), ("n_early", "activity", "quotes in the first two minutes"),
    ("n_quotes", "activity", "quotes of the market"), ("outcome", "label", "1 if the last price is above the target"),
)


def catalogue() -> list[tuple[str, str, str]]:
    """column, kind, meaning of every feature."""
    out = []
    for name, kind, meaning in _MEANINGS:
        for m in (1, 2, 3, 4) if "{m}" in name else (0,):
            out.append((name.format(m=m), kind, meaning.format(m=m)))
    return out
