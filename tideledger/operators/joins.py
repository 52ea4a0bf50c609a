"""As-of, range, grid, look-back and comparison joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


#: Level of intervals without an end, which have a cell for everything.
_ENDLESS = 1100
#: Points and intervals of a cell that a task of interval_sums reads at a time.
CELL_POINTS, CELL_INTERVALS = 1 << 16, 1 << 20


def asof(left: DataFrame, right: DataFrame, by: list[str], left_t: str, right_t: str, values: list[str], tolerance: int, prefix: str, tie: str | None = None) -> DataFrame:
    """Each left row with the last right row of its series at or before it, within ``tolerance``; values are prefixed.

    Time falls into cells as wide as the tolerance, so a row's match is in its
    cell or the last right row of the cell before, which is copied over. Both
    sides are laid in one line by series and cell and a running last value is
    taken: one series alone is still as many tasks as there are cells.
    """
    width = max(int(tolerance), 1)
    row = F.struct(F.col(right_t).alias("t"), *(F.col(v).alias(v) for v in values))
    cell = F.floor(F.col("_t") / width)
    a = left.select(*by, F.col(left_t).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), F.struct(*left.columns).alias("_left")).withColumn("_cell", cell)
    b = right.select(*by, F.col(right_t).alias("_t"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"), row.alias("_right")).withColumn("_cell", cell)
    over = b.where("_t is not null").groupBy(*by, "_cell").agg(F.max_by(F.struct("_t", "_side", "_tie", "_right"), F.struct("_t", "_tie")).alias("x")).select(*by, "x.*", (F.col("_cell") + 1).alias("_cell"))
    line = a.unionByName(b, allowMissingColumns=True).unionByName(over, allowMissingColumns=True)
    along = Window.partitionBy(*by, "_cell").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    met = line.withColumn("_last", F.last("_right", ignorenulls=True).over(along)).where("_side = 1")
    near = F.col("_t") - F.col("_last.t") <= tolerance
    return met.select("_left.*", *(F.when(near, F.col(f"_last.{v}")).alias(f"{prefix}__{v}") for v in values))


def asof_many(left: DataFrame, providers: dict[str, tuple[DataFrame, list[str]]], by: list[str], left_t: str, right_t: str, tolerance: int) -> tuple[DataFrame, list[tuple[str, str]]]:
    """As-of joins one after the other; a provider without its columns is left out. Also returns (provider, status)."""
    status = []
    for name, (series, values) in providers.items():
        missing = [c for c in [*by, right_t, *values] if c not in series.columns]
        status.append((name, f"missing: {', '.join(missing)}" if missing else "merged"))
        if not missing:
            left = asof(left, series, by, left_t, right_t, values, tolerance, name)
    return left, status


def in_intervals(df: DataFrame, x: str, intervals: DataFrame, lo: str, hi: str, closed_below: bool = False) -> DataFrame:
    """Rows with every interval they lie in: (lo, hi], or [lo, hi]; an end that is null holds nothing, one that is infinite is none.

    An interval stands in the cells that it touches, two as a rule, of the power
    of two that is its length or the next above; a row stands in its cell of
    each power that there is (few: lengths that differ by a million times have
    20). Both meet by equality of power and cell, whatever the number of
    intervals, and each pair once.
    """
    a, b = F.col(lo).cast("double"), F.col(hi).cast("double")
    length = b - a
    # cells no finer than doubles of that size tell apart
    fine = F.greatest(F.lit(-1000), F.ceil(F.log2(F.greatest(F.abs(a), F.abs(b), F.lit(1e-300)))) - 50)
    level = F.when(length == float("inf"), _ENDLESS).otherwise(F.greatest(fine, F.coalesce(F.ceil(F.log2(F.when(length > 0, length))), fine)))
    placed = intervals.where((length >= 0) | (a == b)).withColumn("_level", F.when(a == b, fine).otherwise(level).cast("int"))

    def cell(v: Column) -> Column:
        return F.when(F.col("_level") == _ENDLESS, 0).otherwise(F.floor(v * F.pow(F.lit(2.0), -F.col("_level"))).cast("long"))

    cells = placed.withColumn("_cell", F.explode(F.sequence(cell(a), cell(b))))
    levels = [r["_level"] for r in placed.select("_level").distinct().collect()]
    rows = df.where(F.col(x).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    # a row far beyond the cells that a power's intervals can be in is in none of them
    v = F.col(x).cast("double")
    rows = rows.where((F.col("_level") == _ENDLESS) | (F.abs(v) * F.pow(F.lit(2.0), -F.col("_level")) < 2.0**52)).withColumn("_cell", cell(v))
    low = F.col(x) >= F.col(lo) if closed_below else F.col(x) > F.col(lo)
    return rows.join(cells, ["_level", "_cell"]).where(low & (F.col(x) <= F.col(hi))).drop("_level", "_cell")


#: What is summed along the points of a cell: rows, those without a value, infinite values by sign (one that is no number is both); and the finite ones' sum.
_COUNTS = ("rows", "missing", "above", "below")
_SUMS = (*_COUNTS, "sum")


def _sums_within(batches: Iterator[pa.RecordBatch], before: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """key, n, total of pieces of intervals, which come behind the counts (by kind) of their cell's points; ``before``: sums of all cells before each."""
    group, held, along = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        at, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_at", "_a", "_b"))
        first = batch.column("_from").fill_null(-1).to_numpy(zero_copy_only=False)
        found = {c: np.zeros(len(at), before[c].dtype) for c in _SUMS}
        starts = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
        for i, j in zip(starts, [*starts[1:], len(at)], strict=True):
            kind = at[i] & 7
            if at[i] >> 3 != group:
                group, held, along = at[i] >> 3, [], None
            if kind < len(_COUNTS):
                held.append((a[i:j], b[i:j], np.full(j - i, kind), first[i:j]))
                continue
            if along is None:
                x, total, kinds, n = (np.concatenate([np.zeros(0, t), *c]) for t, c in zip((float, before["sum"].dtype, int, int), zip(*held, strict=True) if held else [[]] * 4, strict=True))
                order = np.argsort(x, kind="stable")
                x, kinds, held = x[order], kinds[order], []
                along = {c: np.where(kinds == k, n[order], 0) for k, c in enumerate(_COUNTS)} | {"sum": total[order]}
                along = {c: np.concatenate([np.zeros(1, v.dtype), np.cumsum(v)]) for c, v in along.items()}
            to, since, cell = np.searchsorted(x, b[i:j], "right"), np.searchsorted(x, a[i:j], "right"), int(at[i] >> 32)
            far = np.where(first[i:j] < 0, cell, first[i:j])
            for c in _SUMS:
                found[c][i:j] = along[c][to] - along[c][since] + before[c][cell] - before[c][far]
        hit = found["rows"] > 0
        up, down = found["above"] > 0, found["below"] > 0
        total = np.where(up & down, np.nan, np.where(up, np.inf, np.where(down, -np.inf, found["sum"].astype(np.float64))))
        yield pa.RecordBatch.from_arrays([batch.column("_key").filter(pa.array(hit)), pa.array(found["rows"][hit]), pa.array(total[hit], mask=(found["missing"] == found["rows"])[hit])], names=["key", "n", "total"])


def interval_sums(points: DataFrame, x: str, value: str, intervals: DataFrame, lo: str, hi: str, key: str, cell_points: int = CELL_POINTS, cell_intervals: int = CELL_INTERVALS) -> DataFrame:
    """key, n, total: how many points lie in the intervals (lo, hi] of each key and the sum of their values, once for each interval; keys with none are left out.

    What ``in_intervals`` and a sum by key give, without a row for each pair: work
    grows with points and intervals, not with how many of them meet. Points are
    summed up by place and fall into cells of ``cell_points`` places at most, about. An
    interval is one piece where both ends lie in a cell; else a piece in each
    end's cell and the sums of the cells between, of which there is a row each.
    A piece is the difference of two running sums within its cell, so it isn't
    less exact where there are many points. Cells with many pieces are dealt to
    several tasks, each with the cell's points. An end that is null or not a
    number holds nothing.
    """
    spark, v = points.sparkSession, F.col(value).cast("double")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    sums = (F.count("*"), F.count(F.when(v.isNull(), 1)), F.count(F.when(odd & (v != float("-inf")), 1)), F.count(F.when(odd & (v != float("inf")), 1)), F.coalesce(F.sum(F.when(~odd, v)), F.lit(0.0)))
    # 0.0 + x: no -0.0, which sorts apart
    places = points.select((0.0 + F.col(x).cast("double")).alias("_a"), value).where("_a is not null and not isnan(_a)").groupBy("_a").agg(*(s.alias(c) for c, s in zip(_SUMS, sums, strict=True)))
    places = cut(places)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    there = places.count()
    cells = max(-(-there // cell_points), min(there, 4 * tasks))
    bounds = sorted(set(places.approxQuantile("_a", [i / cells for i in range(1, cells)], 0.25 / cells))) if cells > 1 else []
    bounds = [float("-inf"), *(b for b in bounds if abs(b) < float("inf")), float("inf")]

    def in_cells(df: DataFrame, columns: list[str]) -> DataFrame:
        if len(bounds) == 2:
            return df.withColumns({f"{c}_cell": F.lit(0).cast("long") for c in columns})
        found = Bucketizer(splitsArray=[bounds] * len(columns), inputCols=columns, outputCols=[f"{c}_cell" for c in columns]).transform(df)
        return found.withColumns({f"{c}_cell": F.col(f"{c}_cell").cast("long") for c in columns})

    places = in_cells(places, ["_a"]).withColumnRenamed("_a_cell", "_cell")
    totals = {r["_cell"]: r for r in places.groupBy("_cell").agg(*(F.sum(c).alias(c) for c in _SUMS)).collect()}
    before = {}
    for c in _SUMS:
        each = np.array([totals[i][c] if i in totals else 0 for i in range(len(bounds) - 1)], np.longdouble if c == "sum" else np.int64)
        before[c] = np.concatenate([np.zeros(1, each.dtype), np.cumsum(each)])

    ends = intervals.select(F.col(key).alias("_key"), F.col(lo).cast("double").alias("_a"), F.col(hi).cast("double").alias("_b")).where("_a < _b and not isnan(_b)")
    null, low, high = F.lit(None).cast("long"), F.lit(float("-inf")), F.lit(float("inf"))

    def piece(cell: str, a: Column, b: Column, start: Column) -> Column:
        return F.struct(F.col(cell).alias("_cell"), a.alias("_a"), b.alias("_b"), start.alias("_from"))

    one = F.array(piece("_a_cell", F.col("_a"), F.col("_b"), null))
    two = F.array(piece("_a_cell", F.col("_a"), high, null), piece("_b_cell", low, F.col("_b"), F.col("_a_cell") + 1))
    pieces = in_cells(ends, ["_a", "_b"]).select("_key", F.explode(F.when(F.col("_a_cell") == F.col("_b_cell"), one).otherwise(two)).alias("_x")).select("_key", "_x.*")
    crowded = {r["_cell"]: -(-r["count"] // cell_intervals) for r in pieces.groupBy("_cell").count().where(F.col("count") > cell_intervals).collect()}
    if crowded:
        deals = F.broadcast(spark.createDataFrame(list(crowded.items()), "_cell long, _deals long"))
        pieces = pieces.join(deals, "_cell", "left").withColumn("_deal", F.pmod(F.monotonically_increasing_id(), F.coalesce("_deals", F.lit(1))))
        places = places.join(deals, "_cell", "left").withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_deals", F.lit(1)) - 1)))
    at = F.shiftleft(F.col("_cell"), 32) + (F.shiftleft(F.col("_deal"), 3) if crowded else 0)
    # rows of few plain columns: what most places have none of stands in rows of its own
    counts = F.array(*(F.struct(F.lit(k).alias("_kind"), F.col(c).alias("_from"), (F.col("sum") if c == "rows" else F.lit(0.0)).alias("_b")) for k, c in enumerate(_COUNTS)))
    line = places.select(at.alias("_at"), "_a", F.explode(counts).alias("_x")).where("_x._from > 0").select((F.col("_at") + F.col("_x._kind")).alias("_at"), "_a", "_x._b", "_x._from")
    line = pieces.select((at + len(_COUNTS)).alias("_at"), "_a", "_b", "_from", "_key").unionByName(line, allowMissingColumns=True)
    line = line.repartition(tasks, F.shiftright("_at", 3)).sortWithinPartitions("_at")
    kind = intervals.schema[key].dataType.simpleString()
    met = line.mapInArrow(lambda batches: _sums_within(batches, before), f"key {kind}, n long, total double")
    return met.groupBy(F.col("key").alias(key)).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def gridded(df: DataFrame, name: str, values: list) -> DataFrame:
    """Rows times a fixed list of parameters, as an explode and not as a join."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def compared(left: DataFrame, right: DataFrame, on: list[str], deltas: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Left rows with the right side's columns beside them (suffixed) and right less left for ``deltas``."""
    a = left.select(*on, *(F.col(c).alias(c + suffixes[0]) for c in left.columns if c not in on))
    b = right.select(*on, *(F.col(c).alias(c + suffixes[1]) for c in right.columns if c not in on))
    out = a.join(b, on, "left")
    return out.withColumns({f"{c}_delta": F.col(c + suffixes[1]) - F.col(c + suffixes[0]) for c in deltas})


def full_outer(left: DataFrame, right: DataFrame, on: list[str], fill: float | None = None) -> DataFrame:
    out = left.join(right, on, "full")
    return out.fillna(fill) if fill is not None else out


def look_back(events: DataFrame, n: str, blocks: DataFrame, start: str, lookback: int, by: list[str]) -> DataFrame:
    """For each block (start) of a series the rows [start - lookback, start): an equi-join by chunks of ``lookback`` rows, then the range."""
    cells = blocks.withColumn("_cell", F.explode(F.array(F.floor((F.col(start) - 1) / lookback), F.floor((F.col(start) - lookback) / lookback)))).distinct()
    rows = events.withColumn("_cell", F.floor(F.col(n) / lookback))
    return rows.join(cells, [*by, "_cell"]).where((F.col(n) >= F.col(start) - lookback) & (F.col(n) < F.col(start))).drop("_cell")
