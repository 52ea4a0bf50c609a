"""Rules as data: a table of predicates over the feature row, evaluated in one projection.

A predicate is a SQL boolean over the columns of ``market_features`` and of
``labelled``. All comparisons are false on null. A mix is a list of rules of
which the first that holds gives the signal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


@dataclass(frozen=True)
class Rule:
    name: str
    family: str
    side: str
    minute: int
    predicate: str
    lo: float = 0.05
    hi: float | None = None
    quality: str | None = None
    priority: int = 0


def labelled(features: DataFrame, session_minute: str = "ny_minute", weekday: str = "ny_weekday") -> DataFrame:
    """Features with regime, path regime, session, gates, quality scores, buckets and signal scores."""
    f = F.col
    out = features.withColumns(
        {
            "regime": C.regime(f("m1"), f("m2"), f("m4")),
            "path_regime": C.path_regime(f("m2"), f("eff"), f("chop")),
            "session": C.session_of(f(session_minute), f(weekday)),
            "gate_down": C.gate(f("spread_dn"), f("overround"), f("dsz2")),
            "gate_up": C.gate(f("spread"), f("overround"), f("usz4"), min_size=120),
            "strict_down": C.gate(f("spread_dn"), f("overround"), f("dsz2"), 0.04, 0.03, 180),
            "strict_up": C.gate(f("spread"), f("overround"), f("usz4"), 0.04, 0.03, 150),
            "gate_up_2": C.gate(f("spread"), f("overround"), f("usz2"), min_size=120),
            "strict_up_2": C.gate(f("spread"), f("overround"), f("usz2"), 0.04, 0.03, 180),
            "qb": C.quality_breakout(f("usz4"), f("spread"), f("overround"), f("m4")),
            "qm": C.quality_mild_drop(f("dsz2"), f("spread_dn"), f("overround"), f("imb"), f("bp")),
            "move_bucket": C.cut(f("m2"), C.MOVE_EDGES, C.MOVE_LABELS),
            "move_2": C.cut(f("m2"), C.MOVE_2_EDGES, C.MOVE_2_LABELS),
            "move_4": C.cut(f("m4"), C.MOVE_4_EDGES, C.MOVE_4_LABELS),
            "up_bucket": C.price_bucket(f("up2")),
            "up_bucket_4": C.price_bucket(f("up4")),
            "down_bucket": C.price_bucket(f("dn2")),
            "imb_sign": C.three_way(f("imb")),
            "liq_down": C.liquidity(f("dsz2")),
            "liq_up": C.liquidity(f("usz2")),
            "spread_sign": C.spread_tier(f("spread")),
            "score_down": C.additive_score(f("m2") <= -10, f("dn2") <= 0.80, f("imb") <= 0, f("dsz2") >= 250, f("dep") <= 0),
            "score_up": C.additive_score((f("m2") > 30) & (f("m2") <= 50), f("up2") <= 0.80, f("imb") >= 0, f("usz2") >= 250, f("dep") >= 0),
            "score_tier": C.additive_score(f("m2") <= -10, f("dn2") <= 0.80, f("dsz2") >= 250, f("imb") <= 0, f("press") >= 0, f("eff") >= 0.55, f("chop") <= 2),
            "overshoot": F.coalesce((f("pm") <= -0.10) & (f("m2") > -25), F.lit(False)),
            "squeeze": F.coalesce((f("pm") >= 0.10) & (f("m2") < 25), F.lit(False)),
        }
    )
    return out.withColumns(
        {
            "breakout": F.expr("coalesce(m4 > 30 and m4 <= 50 and up4 <= 0.90 and usz4 >= 100, false)"),
            "milddrop": F.expr("coalesce(m2 > -30 and m2 <= -10 and imb <= 0 and bp >= -0.2, false)"),
            "sharpdrop": F.expr("coalesce(m2 > -50 and m2 <= -30 and up2 <= 0.45 and usz2 >= 120, false)"),
            "earlydrop": F.expr("coalesce(m1 <= -20 and dsz1 >= 80, false)"),
            "consensus_down": F.expr("coalesce(m2 > -30 and m2 <= -10 and imb <= -0.10 and bp >= 0 and trades2 >= 20, false)"),
            "tier": F.expr("case when score_tier <= 3 then 0.10D when score_tier = 4 then 0.15D when score_tier = 5 then 0.20D else 0.25D end"),
        }
    )


DROP, RISE = "m2 <= -10", "m2 > 30 and m2 <= 50"
#: Predicates that several rules share (fixed values).
BREAKOUT = "m4 > 30 and m4 <= 50 and up4 <= 0.90"
MOMENTUM_UP = "m2 >= 20 and eff >= 0.55 and pm >= 0.02 and up2 <= 0.75"
OVERSHOOT = "pm <= -0.10 and m2 > -25 and up2 <= 0.45 and usz2 >= 120"
REVERSION = "m2 >= 50 and vol >= 10 and dn2 <= 0.30"


def _filters() -> list[Rule]:
    """Filters on the base drop and rise (fixed predicates), named by what they ask for."""
    down = ["true", "m2 > -50", "m2 > -30", "m2 <= -20", "m2 <= -30", "dn2 <= 0.80", "dn2 <= 0.75", "imb <= 0", "imb <= -0.10", "dsz2 >= 250", "dsz2 >= 400", "dn2 <= 0.80 and imb <= 0", "dn2 <= 0.75 and imb <= 0", "dn2 <= 0.80 and dsz2 >= 250"]
    up = ["true", "up2 <= 0.80", "imb >= 0", "usz2 >= 250"]
    words = {" and ": "__", "true": "all", "<=": "to", ">=": "from", ">": "over", "-": "minus", ".": "p", " ": "_"}

    def named(base: str, predicate: str) -> str:
        for mark, word in words.items():
            predicate = predicate.replace(mark, word)
        return f"{base}_{predicate}"

    out = [Rule(named("drop", p), "filter", "down", 2, f"{DROP} and {p}", 0.20) for p in down]
    return out + [Rule(named("rise", p), "filter", "up", 2, f"{RISE} and {p}", 0.20) for p in up]


#: Single rules (fixed predicates).
_SINGLE = [
    Rule("classic_down", "classic", "down", 2, DROP, 0.20),
    Rule("classic_down_score3", "classic", "down", 2, f"{DROP} and score_down >= 3", 0.20),
    Rule("classic_down_score4", "classic", "down", 2, f"{DROP} and score_down >= 4", 0.20),
    Rule("classic_down_mid", "classic", "down", 2, "m2 > -50 and m2 <= -10", 0.20),
    Rule("classic_down_combo", "classic", "down", 2, f"{DROP} and dn2 <= 0.80 and imb <= 0 and dsz2 >= 250", 0.20),
    Rule("classic_up", "classic", "up", 2, RISE, 0.20),
    Rule("classic_up_score3", "classic", "up", 2, f"{RISE} and score_up >= 3", 0.20),
    Rule("classic_neutral_up", "classic", "up", 2, "m2 > -10 and m2 <= 10 and up2 <= 0.55 and imb >= 0", 0.20),
    Rule("price_60_80", "extended", "down", 2, f"{DROP} and dn2 >= 0.60 and dn2 <= 0.80", 0.20),
    Rule("price_65_80", "extended", "down", 2, f"{DROP} and dn2 >= 0.65 and dn2 <= 0.80", 0.20),
    Rule("price_55_75", "extended", "down", 2, f"{DROP} and dn2 >= 0.55 and dn2 <= 0.75", 0.20),
    Rule("price_up_45_65", "extended", "up", 2, f"{RISE} and up2 >= 0.45 and up2 <= 0.65", 0.20),
    Rule("path_down_clean", "extended", "down", 2, f"{DROP} and eff >= 0.60 and chop <= 1.8", 0.20),
    Rule("path_down_mid", "extended", "down", 2, f"{DROP} and m2 > -50 and eff >= 0.50 and chop <= 2", 0.20),
    Rule("path_up_clean", "extended", "up", 2, f"{RISE} and eff >= 0.60 and chop <= 1.8", 0.20),
    Rule("pressure_down", "extended", "down", 2, f"{DROP} and press >= 0.10 and dsz2 >= 250", 0.20),
    Rule("pressure_strong", "extended", "down", 2, f"{DROP} and press >= 0.20 and dn2 <= 0.80", 0.20),
    Rule("pressure_up", "extended", "up", 2, f"{RISE} and press <= -0.10 and usz2 >= 250", 0.20),
    Rule("trend_down", "extended", "down", 2, "path_regime = 'trend_down'", 0.20),
    Rule("trend_down_price", "extended", "down", 2, "path_regime = 'trend_down' and dn2 <= 0.80", 0.20),
    Rule("trend_up", "extended", "up", 2, f"path_regime = 'trend_up' and {RISE}", 0.20),
    Rule("path_neutral_up", "extended", "up", 2, "path_regime = 'neutral' and m2 > -10 and m2 <= 10 and up2 <= 0.55 and imb >= 0", 0.20),
    Rule("m1_drop20", "latest", "down", 1, "m1 <= -20", 0.10),
    Rule("m2_sharp_up", "latest", "up", 2, "m2 > -50 and m2 <= -30", 0.10),
    Rule("m2_mild_down", "latest", "down", 2, "m2 > -30 and m2 <= -10", 0.10),
    Rule("m2_flat_down", "latest", "down", 2, "m2 > -10 and m2 <= 10", 0.10),
    Rule("m2_extreme_fade", "latest", "down", 2, "m2 >= 50", 0.10),
    Rule("m4_breakout", "latest", "up", 4, "m4 > 30 and m4 <= 50", 0.10),
    Rule("drop10_liquid", "systematic", "down", 2, f"{DROP} and dsz2 >= 120 and spread_dn <= 0.06", 0.10),
    Rule("sharpdrop_up_liquid", "systematic", "up", 2, "m2 > -50 and m2 <= -30 and usz2 >= 120 and spread <= 0.06 and up2 <= 0.45", 0.10),
    Rule("milddrop_book", "systematic", "down", 2, "milddrop", 0.10),
    Rule("extreme_fade_cheap", "systematic", "down", 2, "m2 >= 50 and dn2 <= 0.20", 0.10),
    Rule("breakout_book", "systematic", "up", 4, "breakout", 0.10),
    Rule("gate_breakout", "session", "up", 4, "breakout and gate_up", 0.08),
    Rule("gate_milddrop", "session", "down", 2, "milddrop and gate_down", 0.08),
    Rule("tiered_down", "extended", "down", 2, DROP, 0.0, 1.0, "tier"),
    Rule("milddrop_core", "refresh", "down", 2, "milddrop and gate_down and session in ('london', 'us_afternoon')", 0.05),
    Rule("breakout_core", "refresh", "up", 4, "breakout and gate_up and session in ('asia', 'us_open')", 0.05),
    Rule("early_drop", "refresh", "down", 1, "session in ('london', 'us_afternoon') and earlydrop and spread_dn <= 0.05", 0.04),
    Rule("sharpdrop", "refresh", "up", 2, "sharpdrop and spread <= 0.06", 0.04),
    Rule("book_consensus", "refresh", "down", 2, "session in ('london', 'us_afternoon') and consensus_down and gate_down", 0.05),
    Rule("overshoot_fade", "refresh", "up", 2, f"{OVERSHOOT} and spread <= 0.05", 0.04),
    Rule("ts_momentum", "refresh", "up", 2, f"{MOMENTUM_UP} and gate_up", 0.04),
    Rule("ts_reversion", "refresh", "down", 2, f"{REVERSION} and spread_dn <= 0.06", 0.04),
    Rule("framework_milddrop", "framework", "down", 2, "milddrop and gate_down", 0.05),
    Rule("framework_breakout", "framework", "up", 4, f"{BREAKOUT} and gate_up_2", 0.05),
    Rule("framework_early_drop", "framework", "down", 1, "m1 <= -20 and spread_dn <= 0.06", 0.04),
    Rule("framework_sharpdrop", "framework", "up", 2, "m2 > -50 and m2 <= -30 and up2 <= 0.45 and spread <= 0.06", 0.04),
    Rule("framework_extreme_fade", "framework", "down", 2, "m2 >= 50 and dn2 <= 0.30 and spread_dn <= 0.06", 0.04),
    Rule("consensus_down_any", "framework", "down", 2, "session in ('london', 'us_afternoon', 'other') and consensus_down and gate_down", 0.05),
    Rule("consensus_up", "framework", "up", 2, "m2 >= 10 and imb >= 0.10 and bpu >= 0 and up2 <= 0.75 and gate_up_2 and session in ('asia', 'us_open', 'other')", 0.04),
    Rule("overshoot_fade_up", "framework", "up", 2, "overshoot and spread <= 0.05 and usz2 >= 120", 0.035),
    Rule("squeeze_fade_down", "framework", "down", 2, "squeeze and spread_dn <= 0.05 and dsz2 >= 120", 0.035),
    Rule("framework_momentum_up", "framework", "up", 2, f"{MOMENTUM_UP} and gate_up_2", 0.04),
    Rule("momentum_down", "framework", "down", 2, "m2 <= -15 and eff >= 0.50 and pm <= -0.02 and dn2 <= 0.75 and gate_down", 0.04),
    Rule("reversion_down", "framework", "down", 2, "m2 >= 50 and dn2 <= 0.30", 0.035),
]

#: Mixes: the first rule that holds (fixed predicates and sizes).
_MIXES = {
    "switch_1": [("down", 1, "m1 <= -20 and dn1 <= 0.90", 0.25, None, None), ("up", 2, "m2 > -50 and m2 <= -30 and up2 <= 0.40", 0.25, None, None), ("down", 2, "m2 > -30 and m2 <= -10 and dn2 <= 0.75", 0.25, None, None), ("down", 2, "m2 >= 50 and dn2 <= 0.20", 0.25, None, None), ("up", 4, "m4 > 30 and m4 <= 50 and up4 <= 0.90", 0.25, None, None)],
    "switch_2": [("up", 2, "m2 > -50 and m2 <= -30 and up2 <= 0.35", 0.25, None, None), ("down", 1, "m1 <= -20 and dn1 <= 0.85", 0.25, None, None), ("up", 4, "m4 > 30 and m4 <= 50 and up4 <= 0.90", 0.25, None, None), ("down", 2, "m2 >= 50 and dn2 <= 0.20", 0.25, None, None)],
    "switch_conservative": [("up", 2, "m2 > -50 and m2 <= -30 and up2 <= 0.30 and spread <= 0.05", 0.10, None, None), ("down", 1, "m1 <= -20 and dn1 <= 0.80", 0.10, None, None), ("up", 4, "m4 > 30 and m4 <= 50 and up4 <= 0.80", 0.10, None, None)],
    "mix_conservative": [("up", 4, "session = 'asia' and breakout and gate_up", 0.08, None, None), ("down", 2, "session = 'london' and milddrop and gate_down and qm >= 0.60", 0.06, None, None), ("down", 2, "session = 'us_afternoon' and milddrop and qm >= 0.58", 0.08, None, None)],
    "mix_balanced": [("up", 4, "session = 'asia' and breakout and gate_up", 0.10, None, None), ("down", 2, "session = 'london' and milddrop and gate_down", 0.08, None, None), ("down", 2, "session = 'us_afternoon' and milddrop and qm >= 0.55", 0.10, None, None), ("up", 4, "session in ('asia', 'us_open') and breakout and gate_up and qb >= 0.60", 0.06, None, None)],
    "mix_adaptive": [("up", 4, "session = 'asia' and breakout and gate_up", 0.05, 0.10, "qb"), ("down", 2, "session = 'london' and milddrop and gate_down", 0.04, 0.09, "qm"), ("down", 2, "session = 'us_afternoon' and milddrop and qm >= 0.55", 0.05, 0.10, "qm")],
    "mix_active": [("up", 4, "session = 'asia' and breakout and gate_up", 0.08, None, None), ("up", 4, "session = 'asia' and breakout", 0.05, None, None), ("down", 2, "session = 'london' and milddrop and gate_down", 0.06, None, None), ("down", 2, "session = 'london' and milddrop", 0.04, None, None), ("down", 2, "session = 'us_afternoon' and milddrop and qm >= 0.55", 0.08, None, None), ("down", 2, "session = 'us_afternoon' and milddrop", 0.05, None, None), ("up", 4, "session = 'us_open' and breakout and qb >= 0.58", 0.04, None, None)],
    "guarded": [("up", 4, "session = 'asia' and breakout and strict_up", 0.05, None, None), ("down", 2, "session = 'london' and milddrop and strict_down", 0.05, None, None), ("down", 2, "session = 'us_afternoon' and milddrop and qm >= 0.62", 0.06, None, None)],
    "guarded_adaptive": [("up", 4, "session = 'asia' and breakout and strict_up", 0.03, 0.07, "qb"), ("down", 2, "session = 'london' and milddrop and strict_down", 0.03, 0.07, "qm"), ("down", 2, "session = 'us_afternoon' and milddrop and qm >= 0.62", 0.04, 0.08, "qm")],
    "shock_absorber": [("up", 4, "session = 'asia' and breakout and gate_up and qb >= 0.62", 0.06, None, None), ("down", 2, "session = 'london' and milddrop and gate_down and qm >= 0.58", 0.05, None, None), ("down", 2, "session = 'us_afternoon' and milddrop and qm >= 0.60", 0.07, None, None), ("up", 2, "session = 'other' and sharpdrop and qb >= 0.55", 0.03, None, None)],
    "asia_london": [("up", 4, "session = 'asia' and breakout and gate_up", 0.06, None, None), ("down", 2, "session = 'london' and milddrop and gate_down", 0.05, None, None)],
    "early_and_mild": [("down", 1, "session in ('london', 'us_afternoon') and earlydrop and spread_dn <= 0.05", 0.04, None, None), ("down", 2, "session in ('london', 'us_afternoon') and milddrop and gate_down", 0.05, None, None)],
    "milddrop_core_light": [("down", 2, "session = 'london' and milddrop and gate_down", 0.05, None, None), ("down", 2, "session = 'us_afternoon' and milddrop and gate_down", 0.06, None, None)],
    "strict_session": [("up", 4, "session = 'asia' and breakout and strict_up", 0.03, 0.07, "qb"), ("down", 2, "session = 'london' and consensus_down and strict_down", 0.03, 0.07, "qm"), ("down", 2, "session = 'us_afternoon' and milddrop and qm >= 0.62", 0.05, None, None)],
    "micro_game": [("down", 2, "session in ('london', 'us_afternoon') and consensus_down", 0.05, None, None), ("up", 2, OVERSHOOT, 0.035, None, None), ("up", 4, "session = 'asia' and breakout and gate_up", 0.05, None, None)],
    "time_series": [("up", 2, f"{MOMENTUM_UP} and gate_up", 0.04, None, None), ("down", 2, REVERSION, 0.04, None, None), ("down", 2, "session in ('london', 'us_afternoon') and milddrop and qm >= 0.60", 0.04, None, None)],
    "micro_ts_mix": [("down", 2, "consensus_down and gate_down", 0.045, None, None), ("up", 2, f"{MOMENTUM_UP} and gate_up_2", 0.035, None, None), ("up", 2, "overshoot and spread <= 0.05", 0.03, None, None)],
    "conservative_2": [("up", 4, f"session = 'asia' and {BREAKOUT} and strict_up_2", 0.04, None, None), ("down", 2, "session = 'london' and consensus_down and strict_down", 0.04, None, None), ("down", 2, "session = 'us_afternoon' and milddrop and qm >= 0.62", 0.045, None, None)],
    "interval_best": [("down", 2, "m2 > -30 and m2 <= -10", 0.20, None, None), ("up", 2, RISE, 0.20, None, None)],
    "combo_guarded": [("up", 4, "session in ('us_open', 'us_afternoon') and breakout and gate_up", 0.08, None, None), ("down", 2, "session in ('asia', 'london') and milddrop and gate_down", 0.08, None, None)],
    "combo_session_mix": [("up", 4, "session = 'us_open' and breakout and gate_up", 0.08, None, None), ("down", 2, "session in ('london', 'asia') and milddrop and gate_down and qm >= 0.55", 0.08, None, None)],
    "combo_guarded_adaptive": [("up", 4, "session in ('us_open', 'us_afternoon') and breakout and gate_up", 0.04, 0.12, "qb"), ("down", 2, "session in ('asia', 'london') and milddrop and gate_down", 0.04, 0.12, "qm")],
    "combo_session_mix_adaptive": [("up", 4, "session = 'us_open' and breakout and gate_up", 0.04, 0.12, "qb"), ("down", 2, "session in ('london', 'asia') and milddrop and gate_down and qm >= 0.55", 0.04, 0.12, "qm")],
}

#: Rules over probabilities and past results of the event's series: q_up and q_down from earlier rows, health_* of the base drop (fixed predicates).
DYNAMIC = [
    *(Rule(f"value_{b:02d}", "value", side, 2, p, 0.10, None, None, i) for b in (0, 2) for i, (side, p) in enumerate((("up", f"q_up > up2 + 0.01 + {b / 100}"), ("down", f"q_down > dn2 + 0.01 + {b / 100}")))),
    Rule("drop_value_02", "value", "down", 2, f"{DROP} and q_down > dn2 + 0.02", 0.20),
    Rule("drop_value_05", "value", "down", 2, f"{DROP} and q_down > dn2 + 0.05", 0.20),
    Rule("drop_value_book", "value", "down", 2, f"{DROP} and q_down > dn2 + 0.02 and imb <= 0 and dsz2 >= 250", 0.20),
    Rule("rise_value_02", "value", "up", 2, f"{RISE} and q_up > up2 + 0.02", 0.20),
    Rule("drop_health_mean", "health", "down", 2, f"{DROP} and health_mean > 0.05", 0.20),
    Rule("drop_health_win", "health", "down", 2, f"{DROP} and health_win > 0.58", 0.20),
    Rule("drop_health_sharpe", "health", "down", 2, f"{DROP} and health_sharpe > 0.20", 0.20),
]


def _model_rules() -> list[Rule]:
    """Rules over q_up and q_down = 1 - q_up of the walk-forward regression (fixed predicates)."""
    legs = {
        "logit_overlay": [("up", 4, "session = 'asia' and breakout and gate_up and q_up - up4 > 0.08", 0.08), ("down", 2, "session = 'london' and milddrop and gate_down and q_down - dn2 > 0.08", 0.06), ("down", 2, "session = 'us_afternoon' and milddrop and q_down - dn2 > 0.10", 0.08)],
        "logit_gated_session": [("up", 4, "session = 'asia' and breakout and gate_up and q_up - up4 > 0.06", 0.05), ("down", 2, "session = 'london' and milddrop and gate_down and q_down - dn2 > 0.06", 0.05), ("down", 2, "session = 'us_afternoon' and milddrop and q_down - dn2 > 0.08", 0.06)],
        "logit_value": [("down", 2, "session in ('london', 'us_afternoon') and milddrop and q_down - dn2 > 0.06", 0.04), ("up", 4, "breakout and q_up - up4 > 0.06", 0.04)],
        "logit_edge_06": [("up", 2, "gate_up_2 and q_up - up2 > 0.06", 0.04), ("down", 2, "gate_down and q_down - dn2 > 0.06", 0.04)],
        "logit_edge_10": [("up", 2, "strict_up_2 and q_up - up2 > 0.10", 0.035), ("down", 2, "strict_down and q_down - dn2 > 0.10", 0.035)],
    }
    out = [Rule(name, "model", side, minute, p, f, None, None, i) for name, parts in legs.items() for i, (side, minute, p, f) in enumerate(parts)]
    return out


MODEL = _model_rules()


def model_value(model: str, buffer: float) -> list[Rule]:
    """Buy what a model's probability (q_up, q_down) values above its price, the fee and a buffer; Up first."""
    return [Rule(f"value_{model}_{round(100 * buffer):02d}", "value", side, 2, p, 0.10, None, None, i) for i, (side, p) in enumerate((("up", f"q_up > up2 + 0.01 + {buffer}"), ("down", f"q_down > dn2 + 0.01 + {buffer}")))]


#: Rules over the path regime's backoff means q_up and q_down (fixed predicates).
REGIME_VALUE = [
    Rule("regime_drop_value_02", "value", "down", 2, f"{DROP} and q_down > dn2 + 0.02", 0.20),
    Rule("regime_drop_value_05", "value", "down", 2, f"{DROP} and q_down > dn2 + 0.05", 0.20),
    Rule("regime_drop_value_book", "value", "down", 2, f"{DROP} and q_down > dn2 + 0.02 and imb <= 0 and dsz2 >= 250", 0.20),
    Rule("regime_rise_value_02", "value", "up", 2, f"{RISE} and q_up > up2 + 0.02", 0.20),
]

#: Sizes of the session, gate and combo rules (fixed values).
SIZES = (0.06, 0.08, 0.10, 0.12)

MOVES_AT = (1, 2, 3, 4)


def catalogue() -> list[Rule]:
    """Every rule: families that differ in one parameter are made from it."""
    out = [Rule(f"mom_up_{t}", "threshold", "up", 2, f"m2 >= {t}", 0.10) for t in (10, 20, 30, 40, 50, 75, 100)]
    out += [Rule(f"mom_down_{t}", "threshold", "down", 2, f"m2 <= -{t}", 0.10) for t in (10, 20, 30, 40, 50, 75, 100)]
    out += _filters() + _SINGLE
    for m in MOVES_AT:
        out += [Rule(f"entry{m}_drop{t}", "timing", "down", m, f"m{m} <= -{t}", 0.25) for t in (10, 20)]
        out += [Rule(f"entry{m}_mid", "timing", "down", m, f"m{m} > -50 and m{m} <= -10", 0.25), Rule(f"entry{m}_rise", "timing", "up", m, f"m{m} > 30 and m{m} <= 50", 0.25)]
    for s in ("asia", "london", "us_open", "us_afternoon"):
        out += [Rule(f"breakout_{s}", "session", "up", 4, f"session = '{s}' and breakout", 0.08), Rule(f"milddrop_{s}", "session", "down", 2, f"session = '{s}' and milddrop", 0.08)]
    for name, parts in _MIXES.items():
        out += [Rule(name, "mix", side, minute, p, lo, hi, quality, i) for i, (side, minute, p, lo, hi, quality) in enumerate(parts)]
    return out


#: The strategies of the walk-forward validation that need no model; mix_active has quota 14 and cool-down 6, the others 10 and 8 (fixed values).
REGISTRY = (
    "mix_active", "mix_conservative", "mix_balanced", "mix_adaptive", "framework_milddrop", "framework_breakout", "framework_early_drop", "framework_sharpdrop", "framework_extreme_fade",
    "consensus_down_any", "consensus_up", "overshoot_fade_up", "squeeze_fade_down", "framework_momentum_up", "momentum_down", "reversion_down", "micro_ts_mix", "conservative_2",
)
MODEL_REGISTRY = ("logit_overlay", "logit_edge_06", "logit_edge_10")


def registry() -> list[Rule]:
    return [r for r in catalogue() if r.name in REGISTRY]


#: Comparisons in a word of bits.
_WORD = 62


def comparisons(rules: list[Rule]) -> list[str]:
    """The distinct comparisons that the rules' predicates are conjunctions of."""
    return list(dict.fromkeys(c.strip() for r in rules for c in r.predicate.split(" and ")))


def signals(events: DataFrame, rules: list[Rule], key: list[str]) -> DataFrame:
    """key, rule, family, side, minute, fraction, price, size, unit_pnl: a row for each event and rule that fires.

    A predicate is a conjunction; each distinct comparison is evaluated once, as
    a bit of a word, and a rule is a mask of bits that have to be set. One
    projection finds for each rule's name the number of its part of least
    priority that holds; what doesn't fire is dropped before any shuffle. What
    a part says (side, minute, size) is a table of fixed size, met by number.
    """
    bit = {c: i for i, c in enumerate(comparisons(rules))}
    words = [[c for c in bit if bit[c] // _WORD == w] for w in range(len(bit) // _WORD + 1)]
    sums = [" | ".join(f"IF({c}, {1 << bit[c] % _WORD}L, 0L)" for c in word) or "0L" for word in words]
    by_name: dict[str, list[int]] = {}
    for i in sorted(range(len(rules)), key=lambda i: rules[i].priority):
        by_name.setdefault(rules[i].name, []).append(i)

    def holds(rule: Rule) -> str:
        masks = [0] * len(words)
        for c in rule.predicate.split(" and "):
            masks[bit[c.strip()] // _WORD] |= 1 << bit[c.strip()] % _WORD
        return " AND ".join(f"_w{w} & {m}L = {m}L" for w, m in enumerate(masks) if m)

    cases = ", ".join("CASE " + " ".join(f"WHEN {holds(rules[i])} THEN {i}" for i in parts) + " END" for parts in by_name.values())
    qualities = sorted({r.quality for r in rules if r.hi is not None})
    legs = [f"{leg}{m}" for leg in ("up", "dn") for m in MOVES_AT]
    hit = events.select(
        *key,
        F.array(*legs).alias("_price"),
        F.array(*(f"{leg}{m}" for leg in ("usz", "dsz") for m in MOVES_AT)).alias("_size"),
        F.array(*(f"pay_{leg}" for leg in legs)).alias("_pay"),
        F.array(F.lit(0.0), *(F.col(q).cast("double") for q in qualities)).alias("_quality"),
        *(F.expr(s).alias(f"_w{w}") for w, s in enumerate(sums)),
    ).selectExpr(*(f"`{k}`" for k in key), "_price", "_size", "_pay", "_quality", f"explode(filter(array({cases}), i -> i IS NOT NULL)) AS _part")
    parts = [(i, r.name, r.family, r.side, r.minute, float(r.lo), float(r.lo if r.hi is None else r.hi), 0 if r.hi is None else 1 + qualities.index(r.quality), legs.index(f"{'up' if r.side == 'up' else 'dn'}{r.minute}")) for i, r in enumerate(rules)]
    table = events.sparkSession.createDataFrame(parts, "_part int, rule string, family string, side string, minute int, _lo double, _hi double, _q int, _leg int")
    met = hit.join(F.broadcast(table), "_part")
    fraction = C.quality_fraction(F.col("_lo"), F.col("_hi"), F.get("_quality", F.col("_q")))
    return met.select(*key, "rule", "family", "side", "minute", fraction.alias("fraction"), *(F.get(c, F.col("_leg")).alias(n) for c, n in (("_price", "price"), ("_size", "size"), ("_pay", "unit_pnl"))))


#: Micro-trades an event can fire, with their price and safety margins (fixed values).
MICROS = (
    ("early_drop_down", "down", 1, "m1 <= -20"), ("sharp_drop_reversal", "up", 2, "m2 > -50 and m2 <= -30"), ("mild_drop_down", "down", 2, "m2 > -30 and m2 <= -10"),
    ("neutral_down", "down", 2, "m2 > -10 and m2 <= 10"), ("extreme_up_fade", "down", 2, "m2 >= 50"), ("late_breakout_up", "up", 4, "m4 > 30 and m4 <= 50"),
)


def micro_candidates(events: DataFrame, key: list[str]) -> DataFrame:
    """Every micro-trade an event fires: key, micro, side, minute, price, spread_at, size and unit_pnl of its side and minute."""
    items = []
    for name, side, minute, predicate in MICROS:
        leg = "up" if side == "up" else "dn"
        items.append(F.when(F.expr(predicate), F.struct(F.lit(name).alias("micro"), F.lit(side).alias("side"), F.lit(minute).alias("minute"), F.col(f"{leg}{minute}").alias("price"), F.col(f"sp{leg[0]}{minute}").alias("spread_at"), F.col(f"{leg[0]}sz{minute}").alias("size"), F.col(f"pay_{leg}{minute}").alias("unit_pnl"))))
    fired = events.withColumn("x", F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())))
    return fired.select(*key, "x.*", *[c for c in events.columns if c not in key])


def best_micro(candidates: DataFrame, key: list[str], q_up: str, n_up: str, q_down: str, n_down: str, fee: float = 0.01) -> DataFrame:
    """The candidate whose fair probability beats its price by the margin and whose score is best; events without one are left out."""
    q = F.when(F.col("side") == "up", F.col(q_up)).otherwise(F.col(q_down))
    n = F.when(F.col("side") == "up", F.col(n_up)).otherwise(F.col(n_down))
    rows = candidates.withColumns({"q": q, "support": n}).withColumn("edge", F.col("q") - F.col("price"))
    margin = (
        fee + 0.02 + F.least(F.greatest(F.coalesce("spu2", F.lit(0.0)), F.lit(0.0)), F.lit(0.05))
        + F.when(F.col("micro").isin("sharp_drop_reversal", "extreme_up_fade"), 0.01).otherwise(0.0)
        + F.when(F.col("support") < 15, 0.01).otherwise(0.0)
        + F.when((F.col("micro") == "late_breakout_up") & (F.col("price") > 0.90), 0.03).otherwise(0.0)
    )
    good = rows.where(F.col("edge") > margin).withColumn("score", F.col("edge") - 0.005 * F.greatest(F.lit(0), 20 - F.col("support")))
    best = F.max_by(F.struct("micro", "side", "minute", "price", "size", "unit_pnl", "q", "support", "edge", "score"), F.struct("score", F.col("micro")))
    return good.groupBy(*key).agg(best.alias("x")).select(*key, "x.*")


#: Levels of the switches' backoff probabilities (fixed values).
SWITCH_UP = [["regime", "move_2", "up_bucket"], ["regime", "move_4", "up_bucket_4"], ["regime", "imb_sign"], ["regime"], []]
SWITCH_DOWN = [["regime", "move_2", "down_bucket"], ["regime", "imb_sign", "liq_down"], ["regime"], []]
#: Modes of the switch: what they add to the margin (fixed values).
SWITCH_MODES = (("fair", 0.0), ("conservative", 0.02), ("robust", 0.015))


def fair_switch(candidates: DataFrame, key: list[str], q_up: str, n_up: str, q_down: str, n_down: str, fee: float = 0.01) -> DataFrame:
    """key, mode, micro, side, minute, edge, score: for each mode the candidate (of all micro-trades but neutral_down) whose probability beats its price by the mode's margin and whose score is best."""
    up = F.col("side") == "up"
    modes = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(x).alias("more")) for m, x in SWITCH_MODES))).alias("_m")
    rows = candidates.where("micro <> 'neutral_down' and price is not null").select("*", modes).select("*", "_m.mode", "_m.more").drop("_m")
    rows = rows.withColumns({"q": F.when(up, F.col(q_up)).otherwise(F.col(q_down)), "support": F.when(up, F.col(n_up)).otherwise(F.col(n_down))}).withColumn("edge", F.col("q") - F.col("price"))
    margin = (
        fee + 0.02 + F.least(F.greatest(F.coalesce("spread_at", F.lit(0.0)), F.lit(0.0)), F.lit(0.05)) + F.col("more")
        + F.when(F.col("support") < 15, 0.01).otherwise(0.0) + F.when((F.col("micro") == "late_breakout_up") & (F.col("price") > 0.85), 0.02).otherwise(0.0)
    )
    known = F.least(F.col("support"), F.lit(50))
    score = F.when(F.col("mode") == "robust", F.col("edge") + 0.002 * known - 0.05 * F.greatest(F.col("price") - 0.8, F.lit(0.0))).otherwise(F.col("edge") + 0.001 * known)
    good = rows.where(F.col("edge") > margin).withColumn("score", score)
    best = F.max_by(F.struct("micro", "side", "minute", "edge", "score"), F.struct("score", "micro"))
    return good.groupBy(*key, "mode").agg(best.alias("x")).select(*key, "mode", "x.*")


def edge_selected(candidates: DataFrame, key: list[str], q_up: str, margin: float, cap: float | None = None, fee: float = 0.01) -> DataFrame:
    """key, micro, side, minute, edge: the candidate of the largest edge after fee and spread (at minute 2, 5 cents at most) above the margin; with ``cap`` no Up dearer than that."""
    up = F.col("side") == "up"
    spread = F.when(F.col("minute") == 2, F.when(up, F.col("spread")).otherwise(F.col("spread_dn")))
    q = F.when(up, F.col(q_up)).otherwise(1.0 - F.col(q_up))
    rows = candidates.where("micro <> 'neutral_down'").withColumn("edge", q - F.col("price") - fee - F.least(F.greatest(F.coalesce(spread, F.lit(0.0)), F.lit(0.0)), F.lit(0.05)))
    good = rows.where((F.col("edge") > margin) & (F.lit(True) if cap is None else ~(up & (F.col("price") > cap))))
    best = F.max_by(F.struct("micro", "side", "minute", "edge"), F.struct("edge", "micro"))
    return good.groupBy(*key).agg(best.alias("x")).select(*key, "x.*")


def candidate_state(candidates: DataFrame) -> DataFrame:
    """Adds ``state``: regime, and at minute 2 the buckets of price and size and the spread (Up) or imbalance (Down); null where a part is."""
    two = F.when(F.col("side") == "up", F.concat_ws("|", "up_bucket", "liq_up", "spread_sign")).otherwise(F.concat_ws("|", "down_bucket", "liq_down", "imb_sign"))
    known = F.when(F.col("side") == "up", F.col("up_bucket")).otherwise(F.col("down_bucket")).isNotNull()
    return candidates.withColumn("state", F.when(F.col("minute") != 2, F.col("regime")).when(known, F.concat_ws("|", "regime", two)))


def with_base_health(events: DataFrame, series: list[str], order: list[str], last: int = 20, least: int = 8) -> DataFrame:
    """Adds to every event the health of the base drop's last trades before it: only the drop's rows count, nulls in between don't."""
    from .windows import rolling_health

    drop = F.coalesce(F.col("m2") <= -10, F.lit(False))
    base = rolling_health(events.where(drop), series, order, "pay_dn2", last, least)
    return events.where(~drop).unionByName(base, allowMissingColumns=True)


def state_selected(candidates: DataFrame, series: list[str], order: list[str], key: list[str], state: list[str], unit_pnl: str = "unit_pnl", half_life: float = 25, least: int = 12, robust: bool = False, chunk: Column | None = None) -> DataFrame:
    """Per event the candidate whose state had the best exponentially weighted profit so far, if that is above 0.

    History is the earlier candidates of the same micro-trade in the same state.
    The robust form asks for 20 of them, 55 % won and 2 cents, and rewards support.
    """
    from .windows import backoff_mean, ew_mean

    known = candidates.where(F.col(state[0]).isNotNull()).withColumn("_won", (F.col(unit_pnl) > 0).cast("double"))
    seen = ew_mean(known, [*series, "micro", *state], order, unit_pnl, half_life, "mean_pnl", chunk)
    if robust:
        seen = backoff_mean(seen, [*series, "micro", *state], order, "_won", [[]], 1, "won", chunk)
    support = F.col("mean_pnl_n")
    seen = seen.where((support >= least) & (F.col("mean_pnl") > 0)).withColumn("score", F.col("mean_pnl"))
    if robust:
        seen = seen.where((support >= 20) & (F.col("won") >= 0.55) & (F.col("mean_pnl") > 0.02)).withColumn("score", F.col("mean_pnl") + 0.01 * F.least(F.lit(20), support) / 20.0)
    best = F.max_by(F.struct("micro", "side", "minute", "mean_pnl", support.alias("support")), F.struct("score", "micro"))
    return seen.groupBy(*key).agg(best.alias("x")).select(*key, "x.*")


#: Trades allowed in 144 events and in 864, and events skipped after two losses, by set of strategies; "" holds for those not named (fixed values).
LIMITS = {
    "framework": {"": (10, None, 8), "mix_active": (14, None, 6)},
    "final": {"": (14, None, 6), "mix_conservative": (10, None, 10), "mix_adaptive": (10, None, 6), "logit_overlay": (10, None, 10)},
    "refresh": {"": (10, 18, 8), "mix_conservative": (10, 28, 10), "mix_balanced": (14, 28, 6), "mix_adaptive": (10, 28, 6), "mix_active": (14, 28, 6), "logit_overlay": (10, 28, 10)},
}
#: The strategies of a set that need no model (fixed names).
SETS = {
    "final": ("mix_conservative", "mix_balanced", "mix_adaptive", "mix_active"),
    "refresh": ("mix_conservative", "mix_balanced", "mix_adaptive", "mix_active", "guarded", "guarded_adaptive", "shock_absorber", "milddrop_core_light", "asia_london", "early_and_mild"),
}


def limit_columns(limits: dict[str, tuple], rule: str = "rule") -> list[Column]:
    """quota, wide quota (null if none has one) and wait of each row's rule."""
    out = []
    for i in range(3):
        value = F.lit(limits[""][i])
        for name, row in limits.items():
            value = F.when(F.col(rule) == name, row[i]).otherwise(value) if name else value
        out.append(value)
    return out


#: Rules of the bankroll grid: moves at minute 2, and values over the backoff probability (fixed predicates).
BANKROLL = [
    *(Rule(f"bank_drop{t}", "bank", "down", 2, f"m2 <= -{t}") for t in (10, 20, 30)),
    Rule("bank_rise", "bank", "up", 2, RISE),
    Rule("bank_interval", "bank", "down", 2, "m2 > -30 and m2 <= -10"),
    Rule("bank_interval", "bank", "up", 2, RISE, priority=1),
    *model_value("backoff", 0.0),
    *model_value("backoff", 0.02),
]
#: Sizings of the grid: a share of the capital, or a share of Kelly's fraction; what is won with where no model says (fixed values).
SIZINGS = (("fixed_10pct", 0.10, None), ("fixed_20pct", 0.20, None), ("full_kelly", None, 1.0), ("half_kelly", None, 0.5), ("quarter_kelly", None, 0.25))
CONSTANT_Q = 0.55


def sized(signals: DataFrame, q: Column, sizings: tuple = SIZINGS) -> DataFrame:
    """Signals times sizings, with column sizing and the fraction of the capital that each stakes given the probability ``q`` to win."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("sizing"), F.lit(fixed).cast("double").alias("fixed"), F.lit(share).cast("double").alias("share")) for n, fixed, share in sizings))).alias("_x")
    rows = signals.withColumn("_q", q).select("*", each)
    fraction = F.coalesce("_x.fixed", F.col("_x.share") * C.kelly(F.col("_q"), F.col("price")))
    return rows.withColumns({"sizing": F.col("_x.sizing"), "fraction": fraction}).drop("_x", "_q")
