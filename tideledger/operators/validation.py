"""Splits, folds and walk-forward selection as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scoring import best_of
from .windows import ranged


def split_50_25_25(df: DataFrame, series: list[str], order: list[str], latest: int = 864) -> DataFrame:
    """Rows with each split they are in (train, validation, test, full, latest) and their number within it."""
    rows = ranged(df, series, order, "_i", "_n")
    i1 = F.greatest(F.lit(1), F.floor(F.col("_n") * 0.5))
    i2 = F.greatest(i1 + 1, F.floor(F.col("_n") * 0.75))
    tail = F.greatest(F.lit(0), F.col("_n") - latest)
    at = F.col("_i")
    parts = [
        F.when(at < i1, F.struct(F.lit("train").alias("split"), at.cast("long").alias("ordinal"))),
        F.when((at >= i1) & (at < i2), F.struct(F.lit("validation").alias("split"), (at - i1).cast("long").alias("ordinal"))),
        F.when(at >= i2, F.struct(F.lit("test").alias("split"), (at - i2).cast("long").alias("ordinal"))),
        F.struct(F.lit("full").alias("split"), at.cast("long").alias("ordinal")),
        F.when(at >= tail, F.struct(F.lit("latest").alias("split"), (at - tail).cast("long").alias("ordinal"))),
    ]
    out = rows.withColumn("_x", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())))
    return out.select("*", "_x.split", "_x.ordinal").drop("_n", "_i", "_x")


def time_split(df: DataFrame, series: list[str], order: list[str], share: float = 0.7, least: int = 20) -> DataFrame:
    """Adds ``train``: the first share of a series' rows; none where the series has fewer than ``least``."""
    rows = ranged(df, series, order, "_i", "_n")
    return rows.withColumn("train", (F.col("_n") >= least) & (F.col("_i") < F.floor(F.col("_n") * share))).drop("_i", "_n")


def run_coverage(rows: DataFrame, run: str, file: str) -> DataFrame:
    return rows.groupBy(F.col(run).alias("run_name")).agg(F.countDistinct(file).alias("file_count"), F.count("*").alias("row_count"))


def complete_runs(coverage: DataFrame) -> DataFrame:
    """Coverage with is_complete (the largest file count there is) and is_latest (the last complete run by name)."""
    top = coverage.agg(F.max("file_count").alias("_most"))
    marked = coverage.join(F.broadcast(top)).withColumn("is_complete", F.col("file_count") == F.col("_most")).drop("_most")
    last = marked.where("is_complete").agg(F.max("run_name").alias("_last"))
    return marked.join(F.broadcast(last)).withColumn("is_latest", F.coalesce(F.col("run_name") == F.col("_last"), F.lit(False))).drop("_last")


def run_folds(complete: DataFrame, least: int = 3) -> DataFrame:
    """fold_id, split, run_name: train on all runs before, validate on the next, test on the one after.

    Runs are a dimension: their order is one window over a row for each run.
    """
    runs = complete.select("run_name").distinct().withColumn("i", F.row_number().over(Window.orderBy("run_name")) - 1)
    folds = runs.join(F.broadcast(runs.agg(F.count("*").alias("_n")))).where((F.col("i") >= least) & (F.col("i") < F.col("_n") - 1)).select((F.col("i") - least + 1).alias("fold_id"), F.col("i").alias("at"))
    joined = folds.join(F.broadcast(runs), F.col("i") <= F.col("at") + 1)
    split = F.when(F.col("i") < F.col("at"), "train").when(F.col("i") == F.col("at"), "validation").otherwise("test")
    return joined.select(F.col("fold_id").cast("long").alias("fold_id"), split.alias("split"), "run_name")


def selected(metrics: DataFrame, score: str, fold: str = "fold_id", strategy: str = "strategy") -> DataFrame:
    """Metrics on every split of the strategy that scores best on the fold's validation rows."""
    best = best_of(metrics.where("split = 'validation'"), [fold], [F.desc(score), F.desc("total_return"), F.asc(strategy)]).select(fold, strategy)
    return metrics.join(best, [fold, strategy], "left_semi")


def test_rollup(metrics: DataFrame, chosen: DataFrame, strategy: str = "strategy", fold: str = "fold_id") -> DataFrame:
    """Per strategy over the folds' test rows: folds, mean, median, least return, share positive, drawdowns, and how often it was selected."""
    table = metrics.where("split = 'test'").groupBy(strategy).agg(
        F.countDistinct(fold).alias("folds"),
        F.avg("total_return").alias("avg_return"),
        F.median("total_return").alias("median_return"),
        F.min("total_return").alias("min_return"),
        F.avg((F.col("total_return") > 0).cast("double")).alias("share_positive"),
        F.avg("max_drawdown").alias("avg_drawdown"),
        F.max("max_drawdown").alias("max_drawdown"),
        F.avg("profit_factor").alias("profit_factor"),
    )
    counts = chosen.where("split = 'validation'").groupBy(strategy).agg(F.count("*").alias("selected"))
    return table.join(counts, strategy, "left").fillna(0, ["selected"])
