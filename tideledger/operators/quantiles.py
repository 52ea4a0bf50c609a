"""Exact quantiles of whole columns by repeated histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Bins of a histogram, and values that are fetched and sorted at last; the state of a pass is these for each rank wanted.
BINS, FEW = 4096, 4096


#: The largest double; infinite values count as it.
_MOST = 1.7976931348623157e308


def _bin(x: Column, lo: float, hi: float, first: bool) -> Column:
    """Number of a value's bin between lo and hi, of equal width; at first on a scale that gives each order of magnitude its share."""

    def scaled(v: Column) -> Column:
        size = F.abs(v)
        return F.signum(v) * F.when(size < 1e100, F.log1p(size * 1e150)).otherwise(F.log(size) + 150 * math.log(10)) if first else v

    if not first and hi / 2 - lo / 2 == 0:
        return F.when(x > lo, 1).otherwise(0)
    a, b = scaled(F.lit(lo)), scaled(F.lit(hi))
    # halves, so that the difference of huge ends is finite
    return F.least(F.floor((scaled(x) / 2 - a / 2) / (b / 2 - a / 2) * BINS), F.lit(BINS - 1)).cast("int")


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, dict]:
    """For each numeric column n, mean, and the value at each share of its rank (linear between the two nearest); null without values. Nulls and NaN don't count, infinite values are the largest doubles.

    One pass finds count, mean and ends. Then each rank wanted has an interval
    that it lies in, at first the column's ends; a pass counts all intervals'
    values in bins, with each bin's ends, and the rank goes on in its bin, until
    that holds one value or few enough to fetch. No task sees more than bins.
    """
    names = {c: f"x{i}" for i, c in enumerate(columns)}
    x = {n: F.col(c).cast("double") for c, n in names.items()}
    values = cut(df.select(*(F.when(v.isNotNull() & ~F.isnan(v), F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), v))).alias(n) for n, v in x.items())))
    one = values.agg(*(f(n).alias(f"{k}_{n}") for n in names.values() for k, f in (("n", F.count), ("mean", F.avg), ("lo", F.min), ("hi", F.max)))).first()
    at: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], tuple[float, float, int, bool]] = {}
    for n in names.values():
        for share in shares:
            place = share * (one[f"n_{n}"] - 1)
            for rank in {int(place // 1), int(-(-place // 1))} if one[f"n_{n}"] else ():
                open_[n, rank] = (one[f"lo_{n}"], one[f"hi_{n}"], rank, True)
    while open_:
        for key, (lo, hi, _, _) in list(open_.items()):
            if lo == hi:
                at[key] = lo
                del open_[key]
        wanted = list(open_.items())
        if not wanted:
            break
        cases = [F.when((F.col(n) >= lo) & (F.col(n) <= hi), F.struct(F.lit(i).alias("i"), _bin(F.col(n), lo, hi, first).alias("bin"), F.col(n).alias("x"))) for i, ((n, _), (lo, hi, _, first)) in enumerate(wanted)]
        met = values.select(F.explode(F.filter(F.array(*cases), lambda s: s.isNotNull())).alias("s")).select("s.*")
        bins = met.groupBy("i", "bin").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i", "bin").collect()
        fetch: dict[int, int] = {}
        for i, (key, (_, _, rank, _)) in enumerate(wanted):
            for b in (b for b in bins if b["i"] == i):
                if rank < b["n"]:
                    open_[key] = (b["lo"], b["hi"], rank, False)
                    if b["lo"] < b["hi"] and b["n"] <= FEW:
                        fetch[i] = rank
                    break
                rank -= b["n"]
        if fetch:
            near = [F.when((F.col(wanted[i][0][0]) >= open_[wanted[i][0]][0]) & (F.col(wanted[i][0][0]) <= open_[wanted[i][0]][1]), F.struct(F.lit(i).alias("i"), F.col(wanted[i][0][0]).alias("x"))) for i in fetch]
            rows = values.select(F.explode(F.filter(F.array(*near), lambda s: s.isNotNull())).alias("s")).select("s.*").collect()
            for i, rank in fetch.items():
                at[wanted[i][0]] = sorted(r["x"] for r in rows if r["i"] == i)[rank]
                del open_[wanted[i][0]]
    out = {}
    for c, n in names.items():
        found = {"n": one[f"n_{n}"], "mean": one[f"mean_{n}"]}
        for share in shares:
            place = share * (found["n"] - 1)
            lo, hi = int(place // 1), int(-(-place // 1))
            found[share] = None if not found["n"] else at[n, lo] if at[n, lo] == at[n, hi] else (hi - place) * at[n, lo] + (place - lo) * at[n, hi]
        out[c] = found
    return out
