"""Projections of the driver's tables that host the market model, in Spark and in SQL.

Quotes from ``events``: a market is an hour, 12 minutes stand for one minute,
``value`` is the price and ``props.k`` the market's probability in cents.
Trades from ``lineitem``: a series is a supplier. Runs from ``orders`` by month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C

MINUTE_US = 12 * 60_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> F.Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.expr(f"extract(second from {ts})") * 1_000_000).cast("long")


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as they would come from files, before preparation, with t (microseconds) and ord."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    eid, half = F.col("event_id"), 1 + F.col("user_id") % 3
    spread = 2 * half + eid % 3
    q = e.select(
        "event_id", "event_type", "ts", micros("ts").alias("t"), k.alias("k"), half.alias("half"), spread.alias("spread_dn"), F.col("value").alias("final_price")
    ).withColumn("hs", F.floor(F.col("t") / 3_600_000_000).cast("long") * 3600)
    first = F.first("final_price").over(Window.partitionBy("hs").orderBy("t", "event_id"))
    half = F.col("half")
    rows = q.select(
        F.concat(F.lit("m-"), (F.col("hs") + 3600).cast("string")).alias("slug"),
        F.concat(F.lit("run-"), F.floor((F.day("ts") + 6) / 7).cast("string")).alias("run_name"),
        F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts_iso"),
        "t",
        eid.alias("ord"),
        F.concat("event_type", F.lit(".csv")).alias("source_file"),
        "final_price",
        F.when((F.col("hs") / 3600).cast("long") % 5 != 0, first).alias("target_price"),
        F.when(eid % 7 != 0, F.col("k").cast("double")).alias("mid_up_cents"),
        F.when(eid % 5 != 0, (100 - F.col("k")).cast("double")).alias("mid_down_cents"),
        F.least(F.lit(99), F.col("k") + half).alias("buy_up_cents"),
        F.greatest(F.lit(1), F.col("k") - half).alias("sell_up_cents"),
        F.least(F.lit(99), 100 - F.col("k") + half).alias("buy_down_cents"),
        F.greatest(F.lit(1), 100 - F.col("k") - half).alias("sell_down_cents"),
        (2 * half).alias("spread_up_cents"),
        F.col("spread_dn").alias("spread_down_cents"),
        *((40 + (eid * m) % 600).alias(c) for c, m in (("buy_up_size", 37), ("buy_down_size", 53), ("sell_down_size", 31))),
        F.when(eid % 11 == 0, F.lit("n/a")).otherwise((40 + (eid * 29) % 600).cast("string")).alias("sell_up_size"),
        (eid % 9).cast("string").alias("trade_count_1s"),
        *((200 + (eid * m) % 900).alias(c) for c, m in (("bid_depth_up_5", 17), ("ask_depth_up_5", 19), ("bid_depth_down_5", 23), ("ask_depth_down_5", 13))),
    )
    # quotes that come twice: the earlier file's must go
    again = rows.where("ord % 13 = 0").withColumns({"source_file": F.lit("aa.csv"), "final_price": F.col("final_price") + 1000})
    return rows.unionByName(again)


QUOTES = """
e AS (SELECT *, epoch_us(ts) AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k, 1 + user_id % 3 AS half,
        CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) * 3600 AS hs FROM events),
q AS (SELECT 'm-' || CAST(hs + 3600 AS VARCHAR) AS slug, 'run-' || CAST(CAST(floor((day(ts) + 6) / 7) AS INT) AS VARCHAR) AS run_name,
        t, hs, event_id AS ord, event_type || '.csv' AS source_file, value AS final_price,
        CASE WHEN CAST(hs / 3600 AS BIGINT) % 5 <> 0 THEN first_value(value) OVER (PARTITION BY hs ORDER BY t, event_id) END AS target_price,
        CASE WHEN event_id % 7 <> 0 THEN CAST(k AS DOUBLE) ELSE (least(99, k + half) + greatest(1, k - half)) / 2.0::DOUBLE END AS mid_up_cents,
        CASE WHEN event_id % 5 <> 0 THEN CAST(100 - k AS DOUBLE) ELSE (least(99, 100 - k + half) + greatest(1, 100 - k - half)) / 2.0::DOUBLE END AS mid_down_cents,
        CAST(least(99, k + half) AS DOUBLE) AS buy_up_cents, CAST(greatest(1, k - half) AS DOUBLE) AS sell_up_cents,
        CAST(least(99, 100 - k + half) AS DOUBLE) AS buy_down_cents, CAST(greatest(1, 100 - k - half) AS DOUBLE) AS sell_down_cents,
        CAST(2 * half AS DOUBLE) AS spread_up_cents, CAST(2 * half + event_id % 3 AS DOUBLE) AS spread_down_cents, CAST(event_id % 9 AS DOUBLE) AS trade_count_1s,
        CAST(40 + (event_id * 37) % 600 AS DOUBLE) AS buy_up_size, CAST(40 + (event_id * 53) % 600 AS DOUBLE) AS buy_down_size,
        CASE WHEN event_id % 11 <> 0 THEN CAST(40 + (event_id * 29) % 600 AS DOUBLE) END AS sell_up_size, CAST(40 + (event_id * 31) % 600 AS DOUBLE) AS sell_down_size,
        CAST(200 + (event_id * 17) % 900 AS DOUBLE) AS bid_depth_up_5, CAST(200 + (event_id * 19) % 900 AS DOUBLE) AS ask_depth_up_5,
        CAST(200 + (event_id * 23) % 900 AS DOUBLE) AS bid_depth_down_5, CAST(200 + (event_id * 13) % 900 AS DOUBLE) AS ask_depth_down_5
      FROM e QUALIFY row_number() OVER (PARTITION BY hs, t ORDER BY event_type DESC, event_id DESC) = 1),
p AS (SELECT *, run_name || '::' || slug AS market_id, (buy_up_cents + buy_down_cents) / 100.0::DOUBLE - 1.0::DOUBLE AS overround,
        mid_up_cents / 100.0::DOUBLE AS mid_up_prob, final_price - target_price AS move,
        hs + 3600 - t / 1e6::DOUBLE AS seconds_to_close FROM q)
"""

_SNAPSHOTS = ",\n".join(
    f"last(struct_pack(move := move, prob := mid_up_prob, u := buy_up_cents, d := buy_down_cents, us := buy_up_size, ds := buy_down_size, sus := sell_up_size, sds := sell_down_size, spu := spread_up_cents, spd := spread_down_cents, bdu := bid_depth_up_5, adu := ask_depth_up_5, bdd := bid_depth_down_5, ad := ask_depth_down_5) ORDER BY t, ord) FILTER (WHERE since <= {m * MINUTE_US}) AS s{m}"
    for m in (1, 2, 3, 4)
)


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} + {b} > 0 THEN ({a} - {b}) / ({a} + {b}) END"


_POINTS = ",\n".join(
    f"s{m}.move AS m{m}, s{m}.u / 100.0::DOUBLE AS up{m}, s{m}.d / 100.0::DOUBLE AS dn{m}, s{m}.us AS usz{m}, s{m}.ds AS dsz{m}, s{m}.spu / 100.0::DOUBLE AS spu{m}, s{m}.spd / 100.0::DOUBLE AS spd{m}, outcome - s{m}.u / 100.0::DOUBLE - 0.01::DOUBLE AS pay_up{m}, (1.0::DOUBLE - outcome) - s{m}.d / 100.0::DOUBLE - 0.01::DOUBLE AS pay_dn{m}"
    for m in (1, 2, 3, 4)
)

#: Feature rows: one for each market (CTE ``f``).
FEATURES = f"""{QUOTES},
st AS (SELECT *, t - min(t) OVER (PARTITION BY market_id) AS since FROM p),
sd AS (SELECT *, since <= {2 * MINUTE_US} AS early, CASE WHEN since <= {2 * MINUTE_US} THEN final_price - lag(final_price) OVER (PARTITION BY market_id ORDER BY t, ord) END AS step FROM st),
ag AS (SELECT market_id, run_name, min(t) AS first_t, count(*) AS n_quotes, count(*) FILTER (WHERE early) AS n_early, first(target_price ORDER BY t, ord) AS target,
        last(final_price ORDER BY t, ord) AS final, {_SNAPSHOTS},
        first(mid_up_prob ORDER BY t, ord) AS prob0, median(spread_up_cents) FILTER (WHERE early) / 100.0::DOUBLE AS spread, median(spread_down_cents) FILTER (WHERE early) / 100.0::DOUBLE AS spread_dn, sum(trade_count_1s) FILTER (WHERE early) AS trades2, median(overround) FILTER (WHERE early) AS overround,
        min(move) FILTER (WHERE early) AS low_move, max(move) FILTER (WHERE early) AS high_move, coalesce(sum(abs(step)), 0.0::DOUBLE) AS path, coalesce(stddev_samp(step), 0.0::DOUBLE) AS vol,
        last(final_price ORDER BY t, ord) FILTER (WHERE early) - first(final_price ORDER BY t, ord) FILTER (WHERE early) AS net
      FROM sd GROUP BY market_id, run_name),
oc AS (SELECT *, CASE WHEN target IS NULL OR final IS NULL THEN NULL WHEN final > target THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS outcome FROM ag),
f AS (SELECT market_id, run_name, first_t, n_quotes, n_early, target, final, outcome, {_POINTS}, spread, spread_dn, trades2, prob0, overround, low_move, high_move, path, vol, net,
        {_ratio("s2.us", "s2.ds")} AS imb, {_ratio("s2.sus", "s2.sds")} AS sell_imb, {_ratio("s2.bdu", "s2.bdd")} AS dep, {_ratio("s2.bdu", "s2.adu")} AS bpu, {_ratio("s2.bdd", "s2.ad")} AS bp,
        s2.prob AS prob2, s2.prob - prob0 AS pm, CASE WHEN path > 0 THEN abs(net) / path ELSE 1.0::DOUBLE END AS eff,
        CASE WHEN path > 0 THEN path / greatest(abs(net), 1e-9::DOUBLE) ELSE 1.0::DOUBLE END AS chop, abs(low_move) AS drawdown,
        CASE WHEN target <> 0 THEN s2.move / target * 10000.0::DOUBLE END AS bps, {_ratio("s2.d * s2.ds", "s2.u * s2.us")} AS press,
        CAST((first_t // 60000000 + 1140) % 1440 AS BIGINT) AS ny_minute, CAST(((first_t // 60000000 - 300) // 1440 + 3) % 7 AS BIGINT) AS ny_weekday FROM oc)
"""

_GATE = "coalesce({}, 1.0::DOUBLE) <= {} AND coalesce(overround, 1.0::DOUBLE) <= {} AND coalesce({}, 0.0::DOUBLE) >= {}"
_CLIP = "CASE WHEN {0} < 0 THEN 0.0::DOUBLE WHEN {0} > 1 THEN 1.0::DOUBLE ELSE {0} END"


def _mean(*parts: str) -> str:
    return "(" + " + ".join(_CLIP.format(f"({p})") for p in parts) + ") / 4.0::DOUBLE"


def cut_sql(x: str, edges: tuple, labels: tuple) -> str:
    tests = " ".join(f"WHEN {x} <= {e} THEN '{label}'" for e, label in zip(edges, labels, strict=False))
    return f"CASE WHEN {x} IS NULL THEN NULL {tests} ELSE '{labels[-1]}' END"


MOVE_CUT = cut_sql("m2", C.MOVE_EDGES, C.MOVE_LABELS)


def price_sql(x: str) -> str:
    inner = cut_sql(x, tuple(f"{e}::DOUBLE" for e in C.PRICE_EDGES), C.PRICE_LABELS)
    return f"CASE WHEN {x} >= 0 AND {x} <= 1 THEN {inner} END"


def _sum(*conditions: str) -> str:
    return " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conditions)


#: Feature rows with labels (CTE ``l``).
LABELS = f"""{FEATURES},
l0 AS (SELECT *, CASE WHEN m1 <= -20 THEN 'early_drop' WHEN m2 > -50 AND m2 <= -30 THEN 'sharp_drop_reversal' WHEN m2 > -30 AND m2 <= -10 THEN 'mild_drop' WHEN m2 >= 50 THEN 'extreme_up' WHEN m4 > 30 AND m4 <= 50 THEN 'late_breakout' ELSE 'neutral' END AS regime,
  CASE WHEN m2 <= -10 AND eff >= 0.55 AND chop <= 2.0 THEN 'trend_down' WHEN m2 >= 10 AND eff >= 0.55 AND chop <= 2.0 THEN 'trend_up' WHEN chop >= 2.5 THEN 'choppy' ELSE 'neutral' END AS path_regime,
  CASE WHEN ny_minute >= 1140 OR ny_minute < 120 THEN 'asia' WHEN ny_minute < 570 THEN 'london' WHEN ny_weekday < 5 AND ny_minute < 720 THEN 'us_open' WHEN ny_weekday < 5 AND ny_minute < 960 THEN 'us_afternoon' ELSE 'other' END AS session,
  {_GATE.format("spread_dn", 0.05, 0.04, "dsz2", 150)} AS gate_down, {_GATE.format("spread", 0.05, 0.04, "usz4", 120)} AS gate_up, {_GATE.format("spread_dn", 0.04, 0.03, "dsz2", 180)} AS strict_down, {_GATE.format("spread", 0.04, 0.03, "usz4", 150)} AS strict_up,
  {_GATE.format("spread", 0.05, 0.04, "usz2", 120)} AS gate_up_2, {_GATE.format("spread", 0.04, 0.03, "usz2", 180)} AS strict_up_2,
  {_mean("coalesce(usz4, 0) / 250.0::DOUBLE", "1.0::DOUBLE - coalesce(spread, 0.2::DOUBLE) / 0.08::DOUBLE", "1.0::DOUBLE - coalesce(overround, 0.2::DOUBLE) / 0.06::DOUBLE", "1.0::DOUBLE - abs(coalesce(m4, 0) - 40.0::DOUBLE) / 20.0::DOUBLE")} AS qb,
  {_mean("coalesce(dsz2, 0) / 250.0::DOUBLE", "1.0::DOUBLE - coalesce(spread_dn, 0.2::DOUBLE) / 0.08::DOUBLE", "1.0::DOUBLE - coalesce(overround, 0.2::DOUBLE) / 0.06::DOUBLE", "(-coalesce(imb, 1.0::DOUBLE) + (coalesce(bp, -1.0::DOUBLE) + 1.0::DOUBLE) / 2.0::DOUBLE) / 2.0::DOUBLE")} AS qm,
  {MOVE_CUT} AS move_bucket, {cut_sql("m2", C.MOVE_2_EDGES, C.MOVE_2_LABELS)} AS move_2, {cut_sql("m4", C.MOVE_4_EDGES, C.MOVE_4_LABELS)} AS move_4, {price_sql("up4")} AS up_bucket_4, {price_sql("up2")} AS up_bucket, {price_sql("dn2")} AS down_bucket,
  CASE WHEN imb <= -0.1 THEN 'neg' WHEN imb >= 0.1 THEN 'pos' ELSE 'neu' END AS imb_sign,
  CASE WHEN dsz2 >= 300 THEN 'high' WHEN dsz2 >= 120 THEN 'mid' ELSE 'low' END AS liq_down, CASE WHEN usz2 >= 300 THEN 'high' WHEN usz2 >= 120 THEN 'mid' ELSE 'low' END AS liq_up,
  CASE WHEN spread <= 0.05 THEN 'tight' ELSE 'wide' END AS spread_sign,
  {_sum("m2 <= -10", "dn2 <= 0.80", "imb <= 0", "dsz2 >= 250", "dep <= 0")} AS score_down, {_sum("m2 > 30 AND m2 <= 50", "up2 <= 0.80", "imb >= 0", "usz2 >= 250", "dep >= 0")} AS score_up,
  {_sum("m2 <= -10", "dn2 <= 0.80", "dsz2 >= 250", "imb <= 0", "press >= 0", "eff >= 0.55", "chop <= 2")} AS score_tier,
  coalesce(pm, 0) <= -0.10 AND coalesce(m2, -999) > -25 AS overshoot, coalesce(pm, 0) >= 0.10 AND coalesce(m2, 999) < 25 AS squeeze FROM f),
l AS (SELECT *, coalesce(m4 > 30 AND m4 <= 50 AND up4 <= 0.90 AND usz4 >= 100, false) AS breakout, coalesce(m2 > -30 AND m2 <= -10 AND imb <= 0 AND bp >= -0.2, false) AS milddrop,
  coalesce(m2 > -50 AND m2 <= -30 AND up2 <= 0.45 AND usz2 >= 120, false) AS sharpdrop, coalesce(m1 <= -20 AND dsz1 >= 80, false) AS earlydrop,
  coalesce(m2 > -30 AND m2 <= -10 AND imb <= -0.10 AND bp >= 0 AND trades2 >= 20, false) AS consensus_down, CASE WHEN score_tier >= 6 THEN 0.25::DOUBLE WHEN score_tier = 5 THEN 0.20::DOUBLE WHEN score_tier = 4 THEN 0.15::DOUBLE ELSE 0.10::DOUBLE END AS tier FROM l0)
"""


def local_clock(t_us: F.Column) -> tuple[F.Column, F.Column]:
    """Minute of the day and weekday (Monday 0) five hours behind UTC, which is New York in the months of the table."""
    minutes = F.floor(t_us / 60_000_000) - 300
    return F.pmod(minutes, F.lit(1440)), F.pmod(F.floor(minutes / 1440) + 3, F.lit(7))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, order columns, price, outcome, size, label, minute, unit_pnl and r of each line."""
    li = read(spark, sf_dir, "lineitem")
    price = F.least(F.lit(0.95), 0.05 + 0.9 * (F.col("l_quantity").cast("double") / 50.0))
    t = li.select(
        F.col("l_suppkey").alias("series"), F.datediff("l_shipdate", F.lit("1970-01-01").cast("date")).alias("day"), "l_orderkey", "l_linenumber", "l_partkey",
        price.alias("price"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("outcome"), (F.col("l_extendedprice").cast("double") / 100.0).alias("size"), F.col("l_linestatus").alias("label"),
        (1 + F.col("l_linenumber") % 4).alias("minute"), F.col("l_returnflag").alias("flag"),
    )
    return t.withColumn("unit_pnl", F.col("outcome") - F.col("price") - 0.01).withColumn("r", 0.05 * F.col("unit_pnl") / F.col("price"))


ORDER = ["day", "l_orderkey", "l_linenumber", "l_partkey"]
TRADES = """
t0 AS (SELECT l_suppkey AS series, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day, l_orderkey, l_linenumber, l_partkey,
        least(0.95::DOUBLE, 0.05::DOUBLE + 0.9::DOUBLE * (CAST(l_quantity AS DOUBLE) / 50.0::DOUBLE)) AS price, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS outcome,
        CAST(l_extendedprice AS DOUBLE) / 100.0::DOUBLE AS size, l_linestatus AS label, 1 + l_linenumber % 4 AS minute, l_returnflag AS flag FROM lineitem),
t AS (SELECT *, outcome - price - 0.01::DOUBLE AS unit_pnl, 0.05::DOUBLE * (outcome - price - 0.01::DOUBLE) / price AS r FROM t0)
"""
BY = "day, l_orderkey, l_linenumber, l_partkey"
