"""Probability models in time order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles


def median_imputed(df: DataFrame, columns: list[str], train: str) -> DataFrame:
    """Nulls filled with the training rows' exact medians; columns without any training value are dropped."""
    known = {c: q[0.5] for c, q in quantiles(df.where(F.col(train)), columns, [0.5]).items()}
    empty = [c for c in columns if known[c] is None]
    return df.fillna({c: float(known[c]) for c in columns if c not in empty}).drop(*empty)


def _fitted(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float) -> np.ndarray:
    """Weighted logistic regression with an intercept that isn't penalised, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([1e-9, *[penalty] * (x.shape[1] - 1)])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-12)[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def walk_forward_logit(df: DataFrame, series: list[str], n: str, y: str, columns: list[str], every: int = 25, warm_up: int = 60, lookback: int = 1000, half_life: float = 200, penalty: float = 1.0) -> DataFrame:
    """Adds ``q``: the probability from a regression on the look-back before the row's block of ``every`` rows.

    A series is dealt in stretches as long as the look-back, each with the
    stretch before it, so every row goes to two tasks; a task slides over its
    stretch and fits each block, and the coefficients score the rows in an
    expression. A block without both outcomes, or within the warm-up, has no
    probability.
    """
    rows = df.withColumn("_start", (F.floor(F.col(n) / every) * every).cast("long"))
    stretch = -(-lookback // every) * every
    at = F.floor(F.col(n) / stretch).cast("long")
    dealt = df.select(*series, F.col(n).cast("long").alias("_n"), F.col(y).cast("double").alias("_y"), *columns, F.explode(F.array(at, at + 1)).alias("_stretch"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_n")
        number = part["_n"].to_numpy()
        starts = np.unique(number[number >= part["_stretch"].iloc[0] * stretch] // every * every)
        past = part[part["_y"].notna()]
        when, target, inputs = past["_n"].to_numpy(), past["_y"].to_numpy(float), past[columns].astype(float)
        out = []
        for start in starts[starts >= warm_up]:
            lo, hi = np.searchsorted(when, [start - lookback, start])
            if lo == hi:
                continue
            x = inputs.iloc[lo:hi]
            x = x.fillna(x.median()).fillna(0.0).to_numpy()
            center, scale = x.mean(axis=0), x.std(axis=0)
            scale[scale == 0] = 1.0
            beta = None
            if len(set(target[lo:hi])) == 2:
                age = start - 1.0 - when[lo:hi]
                beta = _fitted((x - center) / scale, target[lo:hi], 0.5 ** (age / half_life), penalty)
                beta = [beta[0] - float((beta[1:] * center / scale).sum()), *(beta[1:] / scale)]
            out.append((*part[series].iloc[0], start, beta, list(np.nan_to_num(np.median(x, axis=0)))))
        return pd.DataFrame(out, columns=[*series, "_start", "_beta", "_fill"])

    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in series)
    models = dealt.groupBy(*series, "_stretch").applyInPandas(fit, f"{keys}, _start long, _beta array<double>, _fill array<double>")
    z = F.get("_beta", F.lit(0))
    for i, c in enumerate(columns):
        z = z + F.get("_beta", F.lit(i + 1)) * F.coalesce(F.col(c).cast("double"), F.get("_fill", F.lit(i)))
    scored = rows.join(models, [*series, "_start"], "left").withColumn("q", 1.0 / (1.0 + F.exp(-z)))
    return scored.drop("_start", "_beta", "_fill")


def compared_models(df: DataFrame, train: str, y: str, columns: list[str], trees: int = 300) -> DataFrame:
    """Rows outside training with p_base, p_logit and p_forest from models of the training rows (columns without nulls)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    fit, test = df.where(F.col(train)), df.where(~F.col(train))
    n, rate = fit.agg(F.count("*"), F.avg(y)).first()
    out = test.withColumn("p_base", F.lit(rate))
    for name, model in (
        ("p_logit", LogisticRegression(labelCol=y, regParam=1.0 / max(n, 1), standardization=False)),
        ("p_forest", RandomForestClassifier(labelCol=y, numTrees=trees, minInstancesPerNode=3, seed=42)),
    ):
        model = model.setFeaturesCol("_x").setProbabilityCol("_p").setRawPredictionCol("_raw").setPredictionCol("_pred")
        fitted = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), model]).fit(fit)
        out = fitted.transform(out).withColumn(name, F.get(vector_to_array("_p"), F.lit(1))).drop("_x", "_p", "_raw", "_pred")
    return out
