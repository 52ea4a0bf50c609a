"""Summary tables over feature rows, probabilities and trade logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, log_loss
from .joins import gridded
from .quantiles import quantiles


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, share: how much of each column is null, in one pass."""
    one = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("share")) for c in columns))).alias("x")).select("x.*")


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, median, p90 of each numeric column."""
    found = quantiles(df, columns, [0.5, 0.9])
    return df.sparkSession.createDataFrame([(c, q["n"], q["mean"], q[0.5], q[0.9]) for c, q in found.items()], "column string, n long, mean double, median double, p90 double")


def completed(table: DataFrame, bucket: str, labels: list[str], counts: list[str]) -> DataFrame:
    """Every label once, in order, with zero counts where the table has none."""
    spark = table.sparkSession
    every = spark.createDataFrame(list(enumerate(labels)), f"{bucket}_order int, {bucket} string")
    return every.join(table, bucket, "left").fillna(0, counts)


def bucket_table(df: DataFrame, bucket: Column, labels: list[str], name: str, measures: dict[str, Column]) -> DataFrame:
    """A row for each bucket with its count and means of ``measures``, empty buckets included."""
    rows = df.withColumn(name, bucket).where(F.col(name).isNotNull())
    table = rows.groupBy(name).agg(F.count("*").alias("n"), *(F.avg(m).alias(k) for k, m in measures.items()))
    return completed(table, name, labels, ["n"])


def surface(df: DataFrame, a: Column, a_labels: list[str], b: Column, b_labels: list[str], measures: dict[str, Column]) -> DataFrame:
    """Counts and means by two buckets, the whole grid included."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(x, y) for x in a_labels for y in b_labels], "a string, b string")
    table = df.select(a.alias("a"), b.alias("b"), *(m.alias(k) for k, m in measures.items())).where("a is not null and b is not null")
    table = table.groupBy("a", "b").agg(F.count("*").alias("n"), *(F.avg(k).alias(k) for k in measures))
    return grid.join(table, ["a", "b"], "left").fillna(0, ["n"])


THRESHOLDS = [10, 20, 30, 40, 50, 75, 100]


def threshold_log(df: DataFrame, move: str, p: str, y: str, fee: float) -> DataFrame:
    """Trades of four rules at seven thresholds: momentum and mean reversion, up and down, priced at the mid probability."""
    rows = gridded(df.where(F.col(y).isNotNull()), "threshold", [float(t) for t in THRESHOLDS])
    up, down = F.col(move) >= F.col("threshold"), F.col(move) <= -F.col("threshold")
    trades = [
        F.when(up, F.struct(F.lit("momentum_up").alias("rule"), F.lit("up").alias("side"))),
        F.when(up, F.struct(F.lit("mean_revert_down").alias("rule"), F.lit("down").alias("side"))),
        F.when(down, F.struct(F.lit("momentum_down").alias("rule"), F.lit("down").alias("side"))),
        F.when(down, F.struct(F.lit("mean_revert_up").alias("rule"), F.lit("up").alias("side"))),
    ]
    hit = rows.withColumn("x", F.explode(F.filter(F.array(*trades), lambda x: x.isNotNull()))).select("*", "x.rule", "x.side").drop("x")
    pnl = F.when(F.col("side") == "up", F.col(y) - F.col(p) - fee).otherwise((1.0 - F.col(y)) - (1.0 - F.col(p)) - fee)
    return hit.withColumn("pnl", pnl)


def rule_summary(log: DataFrame, by: list[str], pnl: str = "pnl") -> DataFrame:
    return log.groupBy(*by).agg(F.count("*").alias("trades"), F.avg((F.col(pnl) > 0).cast("double")).alias("win_rate"), F.avg(pnl).alias("avg_pnl"), F.sum(pnl).alias("sum_pnl"))


SWEEP = [0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7]


def probability_sweep(df: DataFrame, p: str, y: str, fee: float) -> DataFrame:
    """threshold, trades, avg_entry, win_rate, avg_pnl, sum_pnl of buying where the probability is at least the threshold."""
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(clip(F.col(p)).cast("double").alias("p"), F.col(y).alias("y"))
    taken = gridded(rows, "threshold", SWEEP).where("p >= threshold")
    pnl = F.col("y") - F.col("p") - fee
    return taken.groupBy("threshold").agg(F.count("*").alias("trades"), F.avg("p").alias("avg_entry"), F.avg("y").alias("win_rate"), F.avg(pnl).alias("avg_pnl"), F.sum(pnl).alias("sum_pnl"))


def probability_metrics(df: DataFrame, by: list[str], p: str, y: str) -> DataFrame:
    """n, brier, log_loss, accuracy of predicted probabilities."""
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    right = ((F.col(p) >= 0.5).cast("double") == F.col(y)).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(log_loss(F.col(p), F.col(y))).alias("log_loss"), F.avg(right).alias("accuracy"))


def model_trades(df: DataFrame, by: list[str], p: str, y: str, up_price: str, down_price: str, fee: float, buffer: float = 0.0) -> DataFrame:
    """Decisions of a model against executable prices: trades, ratio, PnL and win rate."""
    up = F.col(p) > F.col(up_price) + fee + buffer
    down = (1.0 - F.col(p)) > F.col(down_price) + fee + buffer
    pnl = F.when(up, F.col(y) - F.col(up_price) - fee).when(down, (1.0 - F.col(y)) - F.col(down_price) - fee)
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("pnl", pnl)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("pnl").alias("trades"), (F.count("pnl") / F.count("*")).alias("trade_ratio"), F.avg("pnl").alias("avg_pnl"), F.sum("pnl").alias("sum_pnl"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate")
    )


def log_summary(log: DataFrame, by: list[str], order: list[str], pnl: str = "pnl", cost: str = "cost") -> DataFrame:
    """Trades, mean, median and 10 % quantile of return on cost, win and loss rate, profit factor, worst trade, downside deviation, longest losing run."""
    from .windows import longest_run

    r = F.when(F.col(cost) != 0, F.col(pnl) / F.col(cost))
    wins, losses = F.sum(F.when(F.col(pnl) > 0, F.col(pnl)).otherwise(0.0)), F.sum(F.when(F.col(pnl) < 0, F.col(pnl)).otherwise(0.0))
    table = log.groupBy(*by).agg(
        F.count("*").alias("trades"),
        F.avg(r).alias("avg_return"),
        F.median(r).alias("median_return"),
        F.percentile(r, F.lit(0.1)).alias("p10_return"),
        F.avg((F.col(pnl) > 0).cast("double")).alias("win_rate"),
        F.avg((F.col(pnl) < 0).cast("double")).alias("loss_rate"),
        F.when(losses != 0, wins / F.abs(losses)).alias("profit_factor"),
        F.min(pnl).alias("worst_trade"),
        F.sqrt(F.coalesce(F.avg(F.when(r < 0, r * r)), F.lit(0.0))).alias("downside"),
    )
    return table.join(longest_run(log, by, order, F.col(pnl) < 0).withColumnRenamed("longest", "loss_streak"), by)


def drift(log: DataFrame, by: list[str], recent: str, pnl: str = "pnl") -> DataFrame:
    """All against recent trades in one pass; a part without trades has zeros."""
    old, won = F.col(recent), (F.col(pnl) > 0).cast("double")
    table = log.groupBy(*by).agg(
        F.count("*").alias("trades_all"), F.count_if(old).alias("trades_recent"), F.avg(pnl).alias("avg_all"), F.avg(F.when(old, F.col(pnl))).alias("avg_recent"), F.avg(won).alias("win_all"), F.avg(F.when(old, won)).alias("win_recent")
    )
    return table.fillna(0).withColumn("avg_drift", F.col("avg_recent") - F.col("avg_all"))
