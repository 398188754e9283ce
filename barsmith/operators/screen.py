"""Entry screens over daily bars: A (trend turn), B (pullback after A) and C (surge after B).

All rules are window expressions by code, in one plan over all codes; B's rules
look at the segment that begins with each A.  A rule that is switched off counts
as true, and so does a group of rules whose parts are all switched off.

Rows of a segment are counted from the row after its A.  A run above the long
average counts its own rows only, and no count reaches into the segment before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from barsmith.functions.dialect import BY_CODE, DATE, KEY, rows
from barsmith.plans.staged import Stage, apply, shown, to_sql
from barsmith.sources import bars as source

A_RULES = {"long": 60, "fall": 30, "shorts": (5, 10), "cross_within": 3, "require_all": True, "confirm_rows": 10, "confirm_ma": 20, "confirm_price": "high", "use_falling": True, "use_cross": True, "use_confirm": True, "use_volume": False, "eps": 0e0}
#: The volume group that A and C share: a surge over the rows before, a short above a long mean volume, volume that rises day by day.
VOLUME_RULES = {"surge_rows": 10, "surge": 2e0, "use_surge": True, "vma_short": 5, "vma_long": 10, "use_compare": False, "rising_days": 3, "use_rising": False}
A_RULES |= VOLUME_RULES | {"surge": 1e0}
#: above: "count" (days above and days below since A, today left out), "ratio" (share of days since A, today included) or "run"
#: (days in a row up to the day before).  stable: "ratio", "low" (no new low) or "atr".  Dryness is the AND of the parts that are on;
#: with dry_recent it has to have held on so many of the last dry_window days instead.
B_RULES = {"min_days": 1, "max_days": 60, "short": 5, "above": "count", "above_at_least": 1, "below_at_most": None, "above_ratio": 0.5, "touch": "low", "touch_strict": False, "bearish": False, "not_higher": False, "vr1_max": 1e0}
B_RULES |= {"dry_short": 5, "dry_long": 10, "dry_ratio": 1e0, "dry_surge_max": 1e0, "dry_falling_days": 3, "dry_window": 5, "dry_recent": 0, "use_dry_ratio": True, "use_dry_vol": False, "use_dry_means": False, "use_dry_falling": False, "use_dry_surge": False}
B_RULES |= {"stable_mode": "ratio", "stable": 0.05, "atr_rows": 14, "atr_buffer": 0.5, "use_time": True, "use_above": True, "use_touch": True, "use_vr1": True, "use_dry": True, "use_stable": True, "first_only": False}
C_RULES = {"max_days": 60, **VOLUME_RULES, "trend_price": "high", "trend_ma": 60, "trend_strict": False, "use_recent": True, "use_volume": True, "use_trend": True}


def full_mean(x: str, n: int) -> str:
    """Mean of n rows, all of which must have a value."""
    return f"CASE WHEN count({x}) OVER ({rows(n)}) = {n} THEN avg({x}) OVER ({rows(n)}) END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({BY_CODE})"


def crosses(x: str, ma: str, eps: float = 0e0, strict: bool = True) -> str:
    """x goes over its average: above today and not above on the row before.  Not strict: at or above today, below before, all known."""
    if strict:
        return f"coalesce({x} > {ma} + {eps}, FALSE) AND NOT coalesce({x}_prev > {ma}_prev + {eps}, FALSE)"
    return f"coalesce({x} >= {ma} + {eps} AND {x}_prev < {ma}_prev + {eps}, FALSE)"


def _if(on: bool, test: str) -> str:
    return f"coalesce({test}, FALSE)" if on else "TRUE"


def all_of(parts: dict[str, bool]) -> str:
    """The AND of the parts that are switched on; true if none is."""
    return " AND ".join(f"coalesce({test}, FALSE)" for test, on in parts.items() if on) or "TRUE"


def streak(test: str, days: int) -> str:
    """Whether a 0/1 column has held on so many rows in a row, up to this one; of one row or none it is true."""
    return f"sum({test}) OVER ({rows(days)}) = {days}" if days > 0 else "TRUE"


def volume_columns(r: dict, name: str) -> Stage:
    """What the volume group of A or C needs, by names that begin with its own."""
    return {f"{name}_top": f"max(vol) OVER ({rows(r['surge_rows'], end=1)})", f"{name}_vma_s": full_mean("vol", r["vma_short"]), f"{name}_vma_l": full_mean("vol", r["vma_long"]), f"{name}_up": f"CASE WHEN vol > {lag('vol')} THEN 1 ELSE 0 END"}


def volume_test(r: dict, name: str) -> str:
    return all_of({f"vol >= {r['surge']} * {name}_top": r["use_surge"], f"{name}_vma_s > {name}_vma_l": r["use_compare"], streak(f"{name}_up", r["rising_days"] - 1): r["use_rising"]})


def a_stages(rules: dict | None = None, strict: bool = True) -> list[Stage]:
    r = A_RULES | (rules or {})
    means = sorted({*r["shorts"], r["long"], r["confirm_ma"]})
    price = r["confirm_price"]
    shorts = [f"ma_{s}" for s in r["shorts"]]
    recent = lambda c: f"max(CASE WHEN {c} THEN 1 ELSE 0 END) OVER ({rows(r['cross_within'])}) = 1"
    cross = [f"cross_{s}" for s in r["shorts"]]
    if r["require_all"]:
        turn = " AND ".join([f"({' OR '.join(cross)})", *(recent(c) for c in cross), *(f"{s} > ma_{r['long']} + {r['eps']}" for s in shorts)])
    else:
        turn = " OR ".join(cross)
    return [
        {**{f"ma_{n}": full_mean("close", n) for n in means}, "row_no": f"row_number() OVER ({BY_CODE})", f"{price}_prev": lag(price), "vol_top": f"max(vol) OVER ({rows(r['surge_rows'], end=1)})", **volume_columns(r, "a_vol")},
        {**{f"ma_{n}_prev": lag(f"ma_{n}") for n in means}, f"ma_{r['long']}_then": lag(f"ma_{r['long']}", 1 + r["fall"])},
        {
            "a_falling": _if(r["use_falling"], f"ma_{r['long']}_prev + {r['eps']} < ma_{r['long']}_then"),
            **{f"cross_{s}": crosses(f"ma_{s}", f"ma_{r['long']}", r["eps"], strict) for s in r["shorts"]},
            "price_cross": crosses(price, f"ma_{r['confirm_ma']}", r["eps"], strict),
            "vr1": "vol / nullif(vol_top, 0)",
        },
        {
            "a_turn": _if(r["use_cross"], turn),
            "a_confirm": _if(r["use_confirm"], f"row_no > {r['confirm_rows']} AND sum(CASE WHEN price_cross THEN 1 ELSE 0 END) OVER ({rows(r['confirm_rows'], end=1)}) >= 1"),
            "a_volume": volume_test(r, "a_vol") if r["use_volume"] else "TRUE",
        },
        {"a_point": "a_falling AND a_turn AND a_confirm AND a_volume"},
    ]


def b_stages(rules: dict | None = None, long: int = 60) -> list[Stage]:
    """Needs the columns of a_stages.  Counts and the low before are those of the row's own segment."""
    r = B_RULES | (rules or {})
    seg = f"PARTITION BY {KEY}, segment ORDER BY {DATE}"
    before = f"{seg} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    touch = [f"{r['touch']} {'<' if r['touch_strict'] else '<='} ma_{long}"] + (["close < open"] if r["bearish"] else []) + (["close <= close_prev"] if r["not_higher"] else [])
    days = f"segment > 0 AND days_since_a >= {r['min_days']}" + (f" AND days_since_a <= {r['max_days']}" if r["max_days"] is not None else "")
    above = {
        "count": f"over_before >= {r['above_at_least']}" + (f" AND greatest(days_since_a - 1, 0) - over_before <= {r['below_at_most']}" if r["below_at_most"] is not None else ""),
        "ratio": f"(over_before + over_today) / CAST(nullif(days_since_a, 0) AS DOUBLE) >= {r['above_ratio']}",
        "run": f"run_before >= {r['above_at_least']}",
    }[r["above"]]
    dry = all_of({
        f"dry_s <= {r['dry_ratio']} * dry_l": r["use_dry_ratio"],
        "vol <= dry_l": r["use_dry_vol"],
        "dry_s <= dry_l": r["use_dry_means"],
        streak("vol_down", r["dry_falling_days"]) if r["dry_falling_days"] > 1 else "TRUE": r["use_dry_falling"],
        f"vr1 <= {r['dry_surge_max']}": r["use_dry_surge"],
    })
    stable = {"ratio": f"low >= {1 - r['stable']} * seg_low_prev", "low": "low >= seg_low_prev", "atr": f"low >= seg_low_prev - {r['atr_buffer']} * atr"}[r["stable_mode"]]
    atr = true_range_stages(r["atr_rows"]) if r["stable_mode"] == "atr" else []
    return [
        *atr,
        {"segment": f"sum(CASE WHEN a_point THEN 1 ELSE 0 END) OVER ({BY_CODE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "short_over": f"CASE WHEN ma_{r['short']} >= ma_{long} THEN 1 ELSE 0 END", "close_prev": lag("close"), "dry_s": full_mean("vol", r["dry_short"]), "dry_l": full_mean("vol", r["dry_long"]), "vol_down": f"CASE WHEN vol < {lag('vol')} THEN 1 ELSE 0 END"},
        {"days_since_a": f"row_number() OVER ({seg}) - 1", "seg_low_prev": f"lag(low) OVER ({seg})", "dry_now": dry},
        {"over_today": "CASE WHEN days_since_a > 0 THEN short_over ELSE 0 END", "last_under": f"coalesce(max(CASE WHEN short_over = 0 THEN days_since_a END) OVER ({before}), -1)"},
        {"over_before": f"coalesce(sum(over_today) OVER ({before}), 0)", "run_before": "days_since_a - 1 - last_under", "dry_days": f"sum(CASE WHEN dry_now THEN 1 ELSE 0 END) OVER ({rows(r['dry_window'])})"},
        {
            "b_time": _if(r["use_time"], days),
            "b_above": _if(r["use_above"], above),
            "b_touch": _if(r["use_touch"], " AND ".join(touch)),
            "b_vr1": _if(r["use_vr1"], f"vr1 <= {r['vr1_max']}"),
            "b_dry": _if(r["use_dry"], f"dry_days >= {r['dry_recent']}" if r["dry_recent"] else "dry_now"),
            "b_stable": _if(r["use_stable"], stable),
        },
        {"b_pre": "segment > 0 AND b_time AND b_above AND b_touch AND b_vr1 AND b_dry AND b_stable"},
        {"b_point": f"b_pre AND sum(CASE WHEN b_pre THEN 1 ELSE 0 END) OVER ({seg} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1" if r["first_only"] else "b_pre"},
    ]


def c_stages(rules: dict | None = None) -> list[Stage]:
    """Needs the columns of a_stages and b_stages."""
    r = C_RULES | (rules or {})
    return [
        {"b_row": "CASE WHEN b_point THEN row_no END", **volume_columns(r, "c_vol"), "trend_mean": full_mean("close", r["trend_ma"])},
        {"last_b": f"max(b_row) OVER ({BY_CODE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"},
        {"c_recent": _if(r["use_recent"], f"row_no - last_b BETWEEN 1 AND {r['max_days']}"), "c_volume": volume_test(r, "c_vol") if r["use_volume"] else "TRUE", "c_trend": _if(r["use_trend"], f"{r['trend_price']} {'>' if r['trend_strict'] else '>='} trend_mean")},
        {"c_point": "last_b IS NOT NULL AND c_recent AND c_volume AND c_trend"},
    ]


def points(bars: DataFrame, a: dict | None = None, b: dict | None = None, c: dict | None = None) -> DataFrame:
    """bars with all conditions and the a_point, b_point and c_point flags."""
    return apply(bars, a_stages(a) + b_stages(b, (A_RULES | (a or {}))["long"]) + c_stages(c))


EXPLAINED = {
    "a": {"a_falling": "long average falling", "a_turn": "short averages turned", "a_confirm": "price confirmed", "a_volume": "volume"},
    "b": {"b_time": "days since A", "b_above": "short average above", "b_touch": "long average touched", "b_vr1": "no surge", "b_dry": "volume dried up", "b_stable": "price stable"},
    "c": {"c_recent": "soon after B", "c_volume": "volume surge", "c_trend": "above its trend"},
}


def explain_points(marked: DataFrame, kind: str = "a", column: str = "why") -> DataFrame:
    """A text that names the conditions of A, B or C that each row met."""
    from pyspark.sql import functions as F

    return marked.withColumn(column, F.concat_ws(", ", *(F.when(F.col(c), F.lit(t)) for c, t in EXPLAINED[kind].items())))


def explain_a(marked: DataFrame) -> DataFrame:
    return explain_points(marked)


def summary(marked: DataFrame, recent_days: int = 5) -> DataFrame:
    """A row a code: counts of points, the last B and whether it is recent, the first and last C after it."""
    w = f"PARTITION BY {KEY}"
    rows_ = marked.selectExpr(KEY, DATE, "a_point", "b_point", "c_point", f"max({DATE}) OVER ({w}) AS last_day", f"max(CASE WHEN b_point THEN {DATE} END) OVER ({w}) AS last_b_day")
    return rows_.groupBy(KEY).agg(*_exprs(SUMMARY)).selectExpr(KEY, *SUMMARY, f"coalesce(datediff(last_day, last_b_day) <= {recent_days}, FALSE) AS b_is_recent").drop("last_day")


SUMMARY = {
    "n_a": "sum(CASE WHEN a_point THEN 1 ELSE 0 END)",
    "n_b": "sum(CASE WHEN b_point THEN 1 ELSE 0 END)",
    "n_c": "sum(CASE WHEN c_point THEN 1 ELSE 0 END)",
    "last_day": "max(last_day)",
    "last_b_day": "max(last_b_day)",
    "first_c_after": f"min(CASE WHEN c_point AND {DATE} > last_b_day THEN {DATE} END)",
    "last_c_after": f"max(CASE WHEN c_point AND {DATE} > last_b_day THEN {DATE} END)",
}


def _exprs(columns: dict):
    from pyspark.sql import functions as F

    return [F.expr(e).alias(n) for n, e in columns.items()]


# --- kernels that screens and indicators share -------------------------------------------------------------------


def true_range_stages(n: int) -> list[Stage]:
    """True range, on a code's first row high less low, and its plain mean."""
    return [{"close_before": lag("close")}, {"true_range": "greatest(high - low, abs(high - close_before), abs(low - close_before))"}, {"atr": full_mean("true_range", n)}]


# --- queries -----------------------------------------------------------------------------------------------------

#: Small windows, so that short panels have points as well.
SHORT = ({"long": 8, "fall": 3, "shorts": (2, 4), "confirm_rows": 4, "confirm_ma": 4, "surge_rows": 4}, {"short": 2, "dry_short": 2, "dry_long": 4, "max_days": 15, "vr1_max": 2e0, "stable": 0.5}, {"surge_rows": 3, "surge": 1.2, "trend_ma": 5, "max_days": 15})
#: Further modes of the rules, over the same small windows: every part of the volume, dryness, above and stability rules is on in one of them.
VARIANTS = {
    "run_atr": ({"use_volume": True, "use_compare": True, "vma_short": 2, "vma_long": 4, "use_surge": False}, {"above": "run", "stable_mode": "atr", "atr_rows": 3, "use_dry_ratio": False, "use_dry_vol": True, "touch_strict": True}, {"use_surge": False, "use_rising": True, "rising_days": 3}),
    "ratio_low": ({"use_volume": True, "use_surge": False, "use_rising": True, "rising_days": 2}, {"above": "ratio", "above_ratio": 0.4, "stable_mode": "low", "use_dry_ratio": False, "use_dry_means": True, "use_dry_surge": True, "dry_surge_max": 1.5, "use_vr1": False}, {"use_compare": True, "vma_short": 2, "vma_long": 3, "trend_strict": True}),
    "below_streak": ({"use_volume": True, "surge": 0.5}, {"below_at_most": 3, "max_days": None, "use_dry_ratio": False, "use_dry_falling": True, "dry_falling_days": 2, "dry_recent": 1, "dry_window": 3, "use_touch": False}, {}),
}
_FLAGS = ("a_falling", "a_turn", "a_confirm", "a_point", "b_time", "b_above", "b_touch", "b_vr1", "b_dry", "b_stable", "b_point", "c_recent", "c_volume", "c_trend", "c_point")
_COLUMNS = {KEY: KEY, DATE: DATE, **{f: f"CAST({f} AS INT)" for f in _FLAGS}, "segment": "CAST(segment AS INT)", "days_since_a": "CAST(days_since_a AS INT)"}


def _screen_query(kind: str, rules: tuple, strict: bool = True):
    stages = a_stages(rules[0], strict) + b_stages(rules[1], (A_RULES | rules[0])["long"]) + c_stages(rules[2])
    bars = source.events_bars if kind == "events" else source.lineitem_bars
    sql = to_sql(source.EVENTS_BARS if kind == "events" else source.LINEITEM_BARS, "bars", stages, _COLUMNS)
    return (lambda s, d: apply(bars(s, d), stages).selectExpr(*(f"{e} AS {n}" for n, e in _COLUMNS.items()))), sql


_LONG = _screen_query("lineitem", ({}, {}, {}))
_SHORT = _screen_query("events", SHORT)
_ATR = [*true_range_stages(5)]
_SUMMARY_SQL = f"""WITH m AS ({_SHORT[1]}), w AS (SELECT {KEY}, {DATE}, a_point = 1 AS a_point, b_point = 1 AS b_point, c_point = 1 AS c_point, max({DATE}) OVER (PARTITION BY {KEY}) AS last_day, max(CASE WHEN b_point = 1 THEN {DATE} END) OVER (PARTITION BY {KEY}) AS last_b_day FROM m),
g AS (SELECT {KEY}, {', '.join(f'{e} AS {n}' for n, e in SUMMARY.items())} FROM w GROUP BY {KEY})
SELECT {KEY}, n_a, n_b, n_c, last_b_day, first_c_after, last_c_after, coalesce(last_day - last_b_day <= 5, FALSE) AS b_is_recent FROM g"""
QUERIES = {
    "screen_long": _LONG,
    "screen_short": _SHORT,
    **{f"screen_{n}": _screen_query("events", tuple(a | b for a, b in zip(SHORT, r))) for n, r in VARIANTS.items()},
    "screen_loose_cross": _screen_query("events", SHORT, strict=False),
    "screen_summary": (lambda s, d: summary(points(source.events_bars(s, d), *SHORT)), _SUMMARY_SQL),
    "screen_atr": (lambda s, d: apply(source.events_bars(s, d), _ATR).selectExpr(KEY, DATE, f"{shown('true_range')} AS true_range", f"{shown('atr')} AS atr"), to_sql(source.EVENTS_BARS, "bars", _ATR, {KEY: KEY, DATE: DATE, "true_range": "floor(CAST(true_range AS DOUBLE) * 1000000 + 0.500001) / CAST(1000000 AS DOUBLE)", "atr": "floor(CAST(atr AS DOUBLE) * 1000000 + 0.500001) / CAST(1000000 AS DOUBLE)"})),
}
