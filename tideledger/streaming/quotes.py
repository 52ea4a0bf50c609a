"""The same rollups on a stream of quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def market_windows(quotes: DataFrame, key: list[str], time: str = "ts_utc", length: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """Open, last, low, high and count of each market's windows, final once the watermark has passed (append mode)."""
    order = F.col(time)
    rows = quotes.withWatermark(time, late).groupBy(*key, F.window(time, length).alias("window"))
    table = rows.agg(
        F.count("*").alias("n_quotes"), F.min_by("mid_up_cents", order).alias("open_mid"), F.max_by("mid_up_cents", order).alias("last_mid"), F.min("mid_up_cents").alias("low_mid"), F.max("mid_up_cents").alias("high_mid")
    )
    return table.select(*key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_quotes", "open_mid", "last_mid", "low_mid", "high_mid")


def first_of_each(quotes: DataFrame, key: list[str], time: str = "ts_utc", late: str = "1 minute") -> DataFrame:
    """The first quote of each key within the watermark (a batch's keep_last keeps the last)."""
    return quotes.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def last_of_each(quotes: DataFrame, key: list[str], order: list[str], time: str = "ts_utc", late: str = "1 minute") -> DataFrame:
    """The last quote of each key and time under ``order`` (nulls first), as a batch's keep_last.

    The state is the last quote so far of each key and time that the watermark
    hasn't passed; once it has, the quote goes out and the state with it.
    """
    last = F.max_by(F.struct(*quotes.columns), F.struct(*order)).alias("_last")
    return quotes.withWatermark(time, late).groupBy(*key, F.col(time).alias("_time")).agg(last).select("_last.*")
