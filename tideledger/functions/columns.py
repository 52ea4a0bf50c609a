"""Column expressions: coercion, prices, buckets, labels, gates, scores and pay-offs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bucket edges and labels (fixed values; right-closed, the first also closed below where it has an edge there).
MOVE_EDGES = (-100, -50, -30, -10, 10, 30, 50, 100)
MOVE_LABELS = ("<=-100", "-100~-50", "-50~-30", "-30~-10", "-10~10", "10~30", "30~50", "50~100", ">=100")
MOVE_1_EDGES, MOVE_1_LABELS = (-50, -20, -10, 10), ("<=-50", "-50~-20", "-20~-10", "-10~10", ">=10")
MOVE_2_EDGES, MOVE_2_LABELS = (-50, -30, -10, 10, 50), ("<=-50", "-50~-30", "-30~-10", "-10~10", "10~50", ">=50")
MOVE_4_EDGES, MOVE_4_LABELS = (-10, 10, 30, 50), ("<=-10", "-10~10", "10~30", "30~50", ">=50")
PRICE_EDGES = (0.2, 0.4, 0.6, 0.8)
PRICE_LABELS = ("0.0~0.2", "0.2~0.4", "0.4~0.6", "0.6~0.8", "0.8~1.0")
CLOSE_EDGES = (30, 60, 120, 180, 240, 300)
CLOSE_LABELS = ("00_30s", "30_60s", "01_02m", "02_03m", "03_04m", "04_05m", "gt_05m")
#: Words that mean Up and Down in label columns (fixed values).
UP_WORDS = ("up", "yes", "true", "1", "1.0", "bull", "higher", "green")
DOWN_WORDS = ("down", "no", "false", "0", "0.0", "bear", "lower", "red")


def number(c: Column | str) -> Column:
    """Double of a column of any type; what isn't a number, NaN included, is null."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x), x)


def cut(x: Column, edges: tuple, labels: tuple) -> Column:
    """Label of the right-closed bin that ``x`` falls into; null for null. The outer bins are open."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(x <= F.lit(float(edge)), label)
    return out.otherwise(labels[-1])


def price_bucket(p: Column) -> Column:
    """Five equal bins of 0..1; outside there is none."""
    return F.when((p >= 0) & (p <= 1), cut(p, PRICE_EDGES, PRICE_LABELS))


def close_bucket(seconds: Column) -> Column:
    return F.when(seconds.isNull(), "unknown").when(seconds < 0, "after_close").otherwise(cut(seconds, CLOSE_EDGES, CLOSE_LABELS))


def close_epoch(slug: Column) -> Column:
    """Seconds since 1970 in the last ten digits of a slug, or null."""
    return F.nullif(F.regexp_extract(slug, r"(\d{10})$", 1), F.lit("")).try_cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), null unless the sum is positive."""
    return F.when(a + b > 0, (a - b) / (a + b))


def three_way(x: Column, by: float = 0.1) -> Column:
    return F.when(x <= -by, "neg").when(x >= by, "pos").otherwise("neu")


def liquidity(x: Column, high: float = 300, mid: float = 120) -> Column:
    return F.when(x >= high, "high").when(x >= mid, "mid").otherwise("low")


def spread_tier(x: Column, tight: float = 0.05) -> Column:
    return F.when(x <= tight, "tight").otherwise("wide")


# thresholds of regimes, gates and quality scores are fixed values
def regime(m1: Column, m2: Column, m4: Column) -> Column:
    """First of five moves that holds, else neutral."""
    return (
        F.when(m1 <= -20, "early_drop")
        .when((m2 > -50) & (m2 <= -30), "sharp_drop_reversal")
        .when((m2 > -30) & (m2 <= -10), "mild_drop")
        .when(m2 >= 50, "extreme_up")
        .when((m4 > 30) & (m4 <= 50), "late_breakout")
        .otherwise("neutral")
    )


def path_regime(m2: Column, efficiency: Column, choppiness: Column) -> Column:
    clean = (efficiency >= 0.55) & (choppiness <= 2.0)
    return F.when((m2 <= -10) & clean, "trend_down").when((m2 >= 10) & clean, "trend_up").when(choppiness >= 2.5, "choppy").otherwise("neutral")


def session(utc: Column) -> Column:
    """Trading session of a UTC timestamp by New York minutes of the day; the two US sessions on weekdays only."""
    local = F.from_utc_timestamp(utc, "America/New_York")
    return session_of(F.hour(local) * 60 + F.minute(local), F.weekday(local))


def session_of(minute: Column, weekday: Column) -> Column:
    return (
        F.when((minute >= 1140) | (minute < 120), "asia")
        .when(minute < 570, "london")
        .when((weekday < 5) & (minute < 720), "us_open")
        .when((weekday < 5) & (minute < 960), "us_afternoon")
        .otherwise("other")
    )


def gate(spread: Column, overround: Column, size: Column, max_spread: float = 0.05, max_overround: float = 0.04, min_size: float = 150) -> Column:
    """Spread and overround small enough and size large enough; a missing value fails."""
    return (F.coalesce(spread, F.lit(1.0)) <= max_spread) & (F.coalesce(overround, F.lit(1.0)) <= max_overround) & (F.coalesce(size, F.lit(0.0)) >= min_size)


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """``x`` within lo..hi; null stays null."""
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


def quality_breakout(size4: Column, spread: Column, overround: Column, m4: Column) -> Column:
    parts = (
        clip(F.coalesce(size4, F.lit(0.0)) / 250.0),
        clip(1.0 - F.coalesce(spread, F.lit(0.2)) / 0.08),
        clip(1.0 - F.coalesce(overround, F.lit(0.2)) / 0.06),
        clip(1.0 - F.abs(F.coalesce(m4, F.lit(0.0)) - 40.0) / 20.0),
    )
    return reduce(lambda a, b: a + b, parts) / 4.0


def quality_mild_drop(size: Column, spread: Column, overround: Column, imbalance: Column, pressure: Column) -> Column:
    parts = (
        clip(F.coalesce(size, F.lit(0.0)) / 250.0),
        clip(1.0 - F.coalesce(spread, F.lit(0.2)) / 0.08),
        clip(1.0 - F.coalesce(overround, F.lit(0.2)) / 0.06),
        clip((-F.coalesce(imbalance, F.lit(1.0)) + (F.coalesce(pressure, F.lit(-1.0)) + 1.0) / 2.0) / 2.0),
    )
    return reduce(lambda a, b: a + b, parts) / 4.0


def additive_score(*conditions: Column) -> Column:
    """How many conditions hold; null counts as no."""
    return reduce(lambda a, b: a + b, (F.coalesce(c.cast("int"), F.lit(0)) for c in conditions))


def kelly(q: Column, price: Column) -> Column:
    """max((q - p) / (1 - p), 0) for 0 < p < 1, else 0."""
    return F.when((price > 0) & (price < 1) & q.isNotNull(), F.greatest((q - price) / (1.0 - price), F.lit(0.0))).otherwise(0.0)


def quality_fraction(lo: Column, hi: Column, quality: Column) -> Column:
    return lo + (hi - lo) * clip(F.coalesce(quality, F.lit(0.0)))


def payoff(side: Column, outcome: Column, price: Column, fee: float = 0.01) -> Column:
    """Profit of one share bought at ``price`` after the fee."""
    return F.when(side == "up", outcome - price - fee).when(side == "down", (1.0 - outcome) - price - fee)


def binary_label(label: Column | None, opened: Column | None = None, closed: Column | None = None) -> Column:
    """1 or 0 from mixed encodings (words, flags, numbers), else from close > open; what is neither is 0."""
    if label is not None:
        word = F.lower(F.trim(label.cast("string")))
        return F.when(word.isin(*UP_WORDS), 1).when(word.isin(*DOWN_WORDS), 0).otherwise(F.coalesce(word.try_cast("double").cast("int"), F.lit(0)))
    return F.coalesce((number(closed) > number(opened)).cast("int"), F.lit(0))


def log_loss(p: Column, y: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return -(y * F.ln(q) + (1.0 - y) * F.ln(1.0 - q))
