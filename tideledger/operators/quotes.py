"""Quote preparation: coercion, derived columns, keys and keep-last duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import close_bucket, close_epoch, number

#: Numeric columns of a raw quote (fixed names).
NUMERIC = (
    "buy_up_cents", "buy_down_cents", "sell_up_cents", "sell_down_cents", "buy_up_size", "buy_down_size", "sell_up_size", "sell_down_size",
    "mid_up_cents", "mid_down_cents", "spread_up_cents", "spread_down_cents", "bid_depth_up_5", "ask_depth_up_5", "bid_depth_down_5", "ask_depth_down_5",
    "target_price", "final_price", "trade_count_1s", "trade_volume_1s",
)


def trimmed_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip() for c in df.columns))


def aliased(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns renamed to canonical names: for each, the first of its aliases that there is, whatever its case."""
    by_name = {c.lower(): c for c in reversed(df.columns)}
    for canonical, names in aliases.items():
        found = next((by_name[n.lower()] for n in [canonical, *names] if n.lower() in by_name), None)
        if found and found != canonical:
            df = df.withColumnRenamed(found, canonical)
    return df


def with_columns(df: DataFrame, names: list[str], kind: str = "double") -> DataFrame:
    """Missing columns added as typed nulls."""
    return df.withColumns({n: F.lit(None).cast(kind) for n in names if n not in df.columns})


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key under a total order."""
    last = Window.partitionBy(*key).orderBy(*(F.desc_nulls_last(c) for c in order))
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def dropped_blank(df: DataFrame) -> DataFrame:
    return df.dropna("all")


def prepared(raw: DataFrame) -> DataFrame:
    """Typed quotes with ts_utc, close time, seconds to close, filled mids, probabilities, overrounds, move and market key; the last of each market and time.

    Quotes are dealt by market first: the keep-last window and the roll-ups by market that follow share that one shuffle.
    """
    df = with_columns(raw, [c for c in NUMERIC if c not in raw.columns])
    df = df.withColumns({c: number(c) for c in NUMERIC})
    if "ts_utc" not in df.columns:
        df = df.withColumn("ts_utc", F.try_to_timestamp("ts_iso"))
    close = close_epoch(F.col("slug"))
    df = df.withColumns(
        {
            "close_ts_utc": F.timestamp_seconds(close),
            "seconds_to_close": close - F.unix_micros(F.col("ts_utc").cast("timestamp")) / 1e6,
            "mid_up_cents": F.coalesce("mid_up_cents", (F.col("buy_up_cents") + F.col("sell_up_cents")) / 2),
            "mid_down_cents": F.coalesce("mid_down_cents", (F.col("buy_down_cents") + F.col("sell_down_cents")) / 2),
            "market_id": F.concat_ws("::", "run_name", "slug") if "run_name" in df.columns else F.col("slug"),
        }
    )
    sides = [F.col(f"{a}_{b}_cents").isNotNull() for a in ("buy", "sell") for b in ("up", "down")]
    df = df.withColumns(
        {
            "close_bucket": close_bucket(F.col("seconds_to_close")),
            "overround": (F.col("buy_up_cents") + F.col("buy_down_cents")) / 100.0 - 1.0,
            "mid_up_prob": F.col("mid_up_cents") / 100.0,
            "mid_down_prob": F.col("mid_down_cents") / 100.0,
            "mid_overround_cents": F.col("mid_up_cents") + F.col("mid_down_cents") - 100.0,
            "move": F.col("final_price") - F.col("target_price"),
            "book_complete": sides[0] & sides[1] & sides[2] & sides[3],
            "can_resolve": F.col("target_price").isNotNull() & F.col("final_price").isNotNull(),
        }
    )
    time = "ts_iso" if "ts_iso" in df.columns else "ts_utc"
    order = [c for c in ("ts_utc", "source_file", "source_order", "ord") if c in df.columns]
    return keep_last(df.repartition("market_id"), ["market_id", time], order)
