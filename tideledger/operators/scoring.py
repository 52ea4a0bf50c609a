"""Weighted percent-rank scores and selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .windows import running


@dataclass(frozen=True)
class Part:
    column: str
    weight: float
    better: str = "high"
    fill: float | None = None


#: Score definitions (fixed weights).
SCORES = {
    "summary": (Part("ending", 0.20), Part("win_rate", 0.20), Part("profit_factor", 0.20, fill=0), Part("max_drawdown", 0.20, "low", 999), Part("loss_streak", 0.10, "low", 999), Part("p10_return", 0.10, fill=-999)),
    "robustness": (Part("ending", 0.15), Part("win_rate", 0.20), Part("profit_factor", 0.20, fill=0), Part("max_drawdown", 0.20, "low", 999), Part("loss_streak", 0.15, "low", 999), Part("p10_return", 0.10, fill=-999)),
    "session": (Part("ending", 0.15), Part("max_drawdown", 0.20, "low", 999), Part("worst_48", 0.25, fill=-999), Part("share_positive_48", 0.20, fill=0), Part("profit_factor", 0.10, fill=0), Part("win_rate", 0.10, fill=0)),
    "mix": (Part("ending", 0.15), Part("max_drawdown", 0.20, "low", 999), Part("worst_144", 0.25, fill=-999), Part("share_over_10_144", 0.20, fill=0), Part("active_144", 0.10, fill=0), Part("profit_factor", 0.10, fill=0)),
    "refresh": (Part("ending", 0.15), Part("max_drawdown", 0.20, "low", 999), Part("worst_144", 0.20, fill=-999), Part("worst_864", 0.15, fill=-999), Part("recent_return", 0.20, fill=-999), Part("profit_factor", 0.05, fill=0), Part("win_rate", 0.05, fill=0)),
    "refresh_2": (Part("ending", 0.15), Part("max_drawdown", 0.20, "low", 999), Part("worst_144", 0.20, fill=-999), Part("worst_864", 0.15, fill=-999), Part("recent_return", 0.25, fill=-999), Part("profit_factor", 0.05, fill=0)),
    "framework": (Part("total_return", 0.35), Part("max_drawdown", 0.25, "low", 999), Part("profit_factor", 0.20, fill=0), Part("worst_144", 0.20, fill=-999)),
    "walk_forward": (Part("total_return", 0.30), Part("max_drawdown", 0.25, "low", 999), Part("profit_factor", 0.20, fill=0), Part("worst_144", 0.20, fill=-999)),
    "test": (Part("avg_return", 0.30), Part("share_positive", 0.25), Part("max_drawdown", 0.20, "low", 999), Part("profit_factor", 0.15, fill=0), Part("selected", 0.10)),
}


def rank_score(df: DataFrame, parts: tuple[Part, ...], partition: list[str], name: str = "score") -> DataFrame:
    """Adds the weighted sum of percent ranks within the partition; a missing column's fill ranks in its place."""
    return rank_scores(df, {name: parts}, partition)


def rank_scores(df: DataFrame, scores: dict[str, tuple[Part, ...]], partition: list[str]) -> DataFrame:
    """Adds each of ``scores`` (name: parts), null where one of its parts is.

    All measures lie in one table of (measure, value): equal values (after
    rounding to 12 digits) are counted, the counts are summed along each
    measure's values by ranges, and a value's mid-rank goes back to the rows
    that have it, so neither a partition nor a value has to fit in a task.
    """
    wanted = list(dict.fromkeys((p.column, p.better, p.fill) for parts in scores.values() for p in parts))
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))

    def value(column: str, better: str, fill: float | None) -> Column:
        x = F.col(column).cast("double")
        x = F.coalesce(x, F.lit(float(fill))) if fill is not None else x
        return F.round(-x if better == "low" else x, 12) + 0.0

    long = rows.select("_row", F.to_json(F.struct(*(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(partition)), F.lit(1).alias("x"))).alias("_group"), F.posexplode(F.array(*(value(*w) for w in wanted))).alias("_part", "_v"))
    long = long.where("_v is not null")
    counts = running(long.groupBy("_group", "_part", "_v").agg(F.count("*").alias("_c")), ["_group", "_part"], ["_v"], {"_upto": "_c"}, {"_all": "_c"})
    ranks = long.join(counts, ["_group", "_part", "_v"]).select("_row", "_part", ((F.col("_upto") - (F.col("_c") - 1) / 2.0) / F.col("_all")).alias("_rank"))
    place = {w: i for i, w in enumerate(wanted)}
    totals = []
    for name, parts in scores.items():
        weights = [F.when(F.col("_part") == place[p.column, p.better, p.fill], F.lit(p.weight) * F.col("_rank")) for p in parts]
        there = F.lit(True)
        total = F.lit(0.0)
        for w in weights:
            there, total = there & (F.count(w) > 0), total + F.sum(w)
        totals.append(F.when(there, total).alias(name))
    found = ranks.groupBy("_row").agg(*totals)
    return rows.drop(*scores).join(found, "_row", "left").drop("_row")


def walk_forward_score(df: DataFrame, partition: list[str], name: str = "score") -> DataFrame:
    """The walk-forward score: ranks, and 0.05 times 1.0 for three trades or more, else 0.35."""
    return rank_score(df, SCORES["walk_forward"], partition, name).withColumn(name, F.col(name) + 0.05 * F.when(F.col("trades") >= 3, 1.0).otherwise(0.35))


def best_of(df: DataFrame, partition: list[str], order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where("_r = 1").drop("_r")


def finalists(df: DataFrame, series: list[str], key: str, by: tuple[str, str], k: int) -> DataFrame:
    """The union of the top ``k`` by each of two measures, each key once."""
    first, second = (F.row_number().over(Window.partitionBy(*series).orderBy(F.desc(c), key)) for c in by)
    return df.withColumns({"_a": first, "_b": second}).where((F.col("_a") <= k) | (F.col("_b") <= k)).drop("_a", "_b")
