"""Rule-based signals: every rule is a predicate, a strength, a reason and flags over one factor row.

``rule(factors, name)`` evaluates defaults; ``all_versions(factors, versions)`` gives each row bitmaps of versions, so
one scan serves every version and date.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import MAIN_BOARD, clip, flag_text, flags, holds, to_bool, zero
from tapeloom.operators.versions import DEFAULTS

SIGNALS = ["trade_date", "code", "strategy_name", "strategy_version", "signal_strength", "entry_reason", "risk_flags"]
Params = Callable[[str], Column]
c = F.col


def filter_main_board(df: DataFrame) -> DataFrame:
    """Main-board codes, no special treatment or delisting in the name, listed and not paused; each test only if its column is
    there."""
    return df.where(main_board(df.columns))


def downtrend(p: Params) -> Column:
    return ((zero("pct_chg_3d") <= p("max_down_pct_chg_3d")) & (zero("pct_chg_5d") <= p("max_down_pct_chg_5d"))) | (zero("pct_chg_10d") <= p("max_down_pct_chg_10d"))


def tradable(p: Params, drop_downtrend: bool = False) -> Column:
    """Liquid, priced, not suspended, not closed at a limit, move within 9.5 %, turnover not known to be too low."""
    move = zero("pct_chg_1d")
    keep = holds(c("amount_ma5") >= p("min_amount_ma5")) & (zero("close") > 0) & ~holds(c("is_suspended")) & ~holds(c("is_limit_up_close")) & ~holds(c("is_limit_down_close"))
    keep &= (move < 0.095) & (move > -0.095) & F.coalesce(c("turnover_rate") >= p("min_turnover_rate"), F.lit(True))
    return keep & ~downtrend(p) if drop_downtrend else keep


def tradable_universe(df: DataFrame, config: dict, drop_downtrend: bool = False) -> DataFrame:
    return filter_main_board(df).where(tradable(lambda k: F.lit(config[k]), drop_downtrend))


def _needs(p: Params, n: int) -> Column:
    return c(f"above_ma{n}") | (p(f"require_above_ma{n}") == 0)


def _count(*names: str) -> Column:
    return sum(c(n).cast("double") for n in names)


def _branch(p: Params, name: str, extra: Column) -> Column:
    """*extra* has to hold only on the branch *name*."""
    return (p("branch") != name) | holds(extra)


def _relative() -> Column:
    return c("pct_chg_5d") - c("industry_return_5d")


def _trend_pullback(p: Params):
    keep = [lambda: _needs(p, 5), lambda: _needs(p, 10), lambda: (c("pct_chg_5d") > p("min_pct_chg_5d")), lambda: (c("pct_chg_1d") < p("max_pct_chg_1d")), lambda: (c("close_position_20") >= p("min_close_position_20")), lambda: (c("volume_ratio_5") >= p("min_volume_ratio_5"))]
    strength = lambda: c("pct_chg_5d") * 100 + c("close_position_20") * 20 + clip(c("volume_ratio_5"), high=3) * 5
    return keep, strength, lambda: [(c("close_position_20") > 0.9, "near_20d_high"), (c("pct_chg_1d") > 0.05, "short_term_chase_risk")]


def _breakout_volume(p: Params):
    keep = [lambda: _needs(p, 5), lambda: (c("pct_chg_5d") > p("min_pct_chg_5d")), lambda: (c("volume_ratio_5") >= p("min_volume_ratio_5")), lambda: (c("close_position_20") >= p("min_close_position_20")), lambda: (c("pct_chg_1d") < p("max_pct_chg_1d"))]
    strength = lambda: c("pct_chg_5d") * 120 + clip(c("volume_ratio_5"), high=3) * 8 + c("close_position_20") * 20
    return keep, strength, lambda: [(c("pct_chg_1d") > 0.07, "near_limit_chase_risk"), (c("close_position_20") > 0.95, "extended_position")]


def _support_rebound(p: Params):
    keep = [lambda: _needs(p, 20), lambda: (c("pct_chg_1d") > p("min_pct_chg_1d")), lambda: (c("pct_chg_1d") < p("max_pct_chg_1d")), lambda: c("close_position_20").between(p("min_close_position_20"), p("max_close_position_20")), lambda: (c("amount_ma5") > p("min_amount_ma5"))]
    strength = lambda: F.abs("pct_chg_1d") * 80 + c("close_position_20") * 10 + clip(c("volume_ratio_5"), high=2) * 5
    return keep, strength, lambda: [(c("pct_chg_3d") < -0.06, "short_term_weakness"), (c("volume_ratio_5") > 2.5, "panic_volume_possible")]


def _industry_rotation(p: Params):
    strong = lambda: holds(c("industry_strength_score") >= p("min_industry_strength_score")) | holds(F.lower("industry_strength_level") == "strong")
    keep = [lambda: tradable(p), lambda: strong(), lambda: (c("industry_return_3d") >= p("min_industry_return_3d")), lambda: (c("industry_return_5d") >= p("min_industry_return_5d")), lambda: (c("industry_amount_ratio_5") >= p("min_industry_amount_ratio_5")), lambda: (c("pct_chg_5d") >= p("min_pct_chg_5d")), lambda: (c("close_position_20") >= p("min_close_position_20")), lambda: (zero("moneyflow_score") >= p("min_moneyflow_score"))]
    calm = lambda: (c("pct_chg_3d") <= p("max_pct_chg_3d")) & (c("pct_chg_5d") <= p("max_pct_chg_5d")) & (c("close_position_20") <= p("max_close_position_20"))
    keep += [lambda: _branch(p, "v2_no_overheat", calm()), lambda: _branch(p, "v3_industry_leader", _relative() >= p("min_relative_strength_5d"))]
    strength = lambda: clip(zero("industry_strength_score"), high=100) * 0.45 + zero("industry_return_5d") * 300 + zero("pct_chg_5d") * 120 + clip(zero("moneyflow_score"), -10, 30) * 0.5 + clip(zero(_relative()), low=0) * 120
    return keep, strength, lambda: [(c("close_position_20") > 0.9, "near_20d_high"), (c("pct_chg_3d") > 0.10, "short_term_overheat"), (zero("moneyflow_score") < 0, "moneyflow_not_confirmed")]


def _moneyflow_accumulation(p: Params):
    ratio, turnover = c("main_net_amount_ratio"), c("turnover_rate")
    keep = [lambda: tradable(p), lambda: (c("moneyflow_score") >= p("min_moneyflow_score")), lambda: (c("pct_chg_1d") <= p("max_pct_chg_1d")), lambda: (c("pct_chg_3d") <= p("max_pct_chg_3d")), lambda: c("pct_chg_5d").between(p("min_pct_chg_5d"), p("max_pct_chg_5d"))]
    keep += [lambda: _branch(p, "v1_main_inflow", (c("main_net_amount") > 0) & (ratio >= p("min_main_net_amount_ratio")))]
    keep += [lambda: _branch(p, "v2_big_order_confirm", (c("big_net_amount") > 0) & (c("net_mf_amount") > 0) & (c("main_net_amount") >= 0))]
    keep += [lambda: _branch(p, "v3_price_not_chased", (ratio >= p("min_main_net_amount_ratio")) & F.coalesce(turnover <= p("max_turnover_rate"), F.lit(True)) & (c("pct_chg_1d") >= p("min_pct_chg_1d")))]
    strength = lambda: clip(zero("moneyflow_score"), high=40) * 1.2 + clip(zero(ratio), 0, 12) * 2 + (zero("big_net_amount") > 0).cast("double") * 6 - clip(zero("pct_chg_5d"), low=0) * 80
    return keep, strength, lambda: [(c("pct_chg_5d") > 0.08, "price_chase_risk"), (zero(turnover) > p("max_turnover_rate"), "high_turnover"), (zero(ratio) < 0, "main_outflow")]


def _low_vol_trend(p: Params):
    keep = [lambda: tradable(p), lambda: _needs(p, 5), lambda: _needs(p, 10), lambda: _needs(p, 20), lambda: c("pct_chg_5d").between(p("min_pct_chg_5d"), p("max_pct_chg_5d")), lambda: (F.abs("pct_chg_3d") <= p("max_abs_pct_chg_3d")), lambda: (F.abs("pct_chg_1d") <= p("max_abs_pct_chg_1d")), lambda: c("close_position_20").between(p("min_close_position_20"), p("max_close_position_20")), lambda: c("volume_ratio_5").between(p("min_volume_ratio_5"), p("max_volume_ratio_5"))]
    steady = lambda: F.coalesce(c("turnover_rate").between(p("min_turnover_rate"), p("max_turnover_rate")), F.lit(True))
    keep += [lambda: _branch(p, "v2_low_chase", c("pct_chg_1d") <= p("max_pct_chg_1d")), lambda: _branch(p, "v3_steady_volume", steady())]
    strength = lambda: zero("pct_chg_5d") * 100 + zero("close_position_20") * 18 + clip(2 - F.abs(F.coalesce("volume_ratio_5", F.lit(1.0)) - 1), low=0) * 6 + _count("above_ma5", "above_ma10", "above_ma20") * 3
    return keep, strength, lambda: [(c("close_position_20") > 0.85, "near_20d_high"), (c("volume_ratio_5") > 1.8, "volume_expansion")]


def _oversold_rebound(p: Params):
    keep = [lambda: tradable(p, drop_downtrend=True), lambda: c("pct_chg_3d").between(p("min_pct_chg_3d"), p("max_pct_chg_3d")), lambda: (c("pct_chg_5d") >= p("min_pct_chg_5d")), lambda: (c("pct_chg_10d") >= p("min_pct_chg_10d")), lambda: c("close_position_20").between(p("min_close_position_20"), p("max_close_position_20"))]
    keep += [lambda: _branch(p, "v2_moneyflow_repair", c("moneyflow_score") >= p("min_moneyflow_score")), lambda: _branch(p, "v3_industry_repair", c("industry_strength_score") >= p("min_industry_strength_score"))]
    strength = lambda: F.abs("pct_chg_3d") * 120 + clip(1 - zero("close_position_20"), low=0) * 12 + clip(zero("moneyflow_score"), -10, 25) * 0.7 + clip(zero("industry_strength_score"), high=100) * 0.2
    return keep, strength, lambda: [(c("pct_chg_5d") < -0.12, "short_term_weakness"), (c("pct_chg_10d") < -0.20, "medium_term_weakness"), (zero("moneyflow_score") < 0, "moneyflow_not_confirmed")]


def _volume_dryup_breakout(p: Params):
    today = F.coalesce("volume_ratio_daily_basic", "volume_ratio_5")
    keep = [lambda: tradable(p), lambda: _needs(p, 5), lambda: _needs(p, 10), lambda: c("volume_ratio_5").between(p("min_volume_ratio_5"), p("max_volume_ratio_5")), lambda: today.between(p("min_volume_ratio_daily_basic"), p("max_volume_ratio_daily_basic")), lambda: c("pct_chg_1d").between(p("min_pct_chg_1d"), p("max_pct_chg_1d")), lambda: (c("pct_chg_3d") <= p("max_pct_chg_3d")), lambda: (c("close_position_20") >= p("min_close_position_20"))]
    keep += [lambda: _branch(p, "v2_breakout_confirm", c("close_position_20") >= p("confirm_min_close_position_20"))]
    strength = lambda: zero("pct_chg_1d") * 150 + zero("close_position_20") * 20 + clip(zero("volume_ratio_5"), high=2.5) * 8 + _count("above_ma5", "above_ma10") * 4
    return keep, strength, lambda: [(c("pct_chg_1d") > 0.06, "short_term_chase_risk"), (c("volume_ratio_5") > 2.0, "volume_spike"), (c("close_position_20") > 0.92, "near_20d_high")]


def _relative_strength_pullback(p: Params):
    keep = [lambda: tradable(p), lambda: _needs(p, 10), lambda: _needs(p, 20), lambda: (_relative() >= p("min_relative_strength_5d")), lambda: (c("pct_chg_10d") >= p("min_pct_chg_10d")), lambda: c("pct_chg_5d").between(p("min_pct_chg_5d"), p("max_pct_chg_5d")), lambda: c("close_position_20").between(p("min_close_position_20"), p("max_close_position_20"))]
    keep += [lambda: _branch(p, "v2_industry_strong_pullback", c("industry_strength_score") >= p("min_industry_strength_score")), lambda: _branch(p, "v3_moneyflow_confirm", c("moneyflow_score") >= p("min_moneyflow_score"))]
    strength = lambda: clip(zero(_relative()), low=0) * 180 + clip(zero("pct_chg_10d"), low=0) * 90 + clip(zero("industry_strength_score"), high=100) * 0.25 + clip(zero("moneyflow_score"), -10, 30) * 0.4
    return keep, strength, lambda: [(c("close_position_20") > 0.85, "near_20d_high"), (zero("moneyflow_score") < 0, "moneyflow_not_confirmed")]


#: Rule name: builder (conditions that all hold, strength, marks; each built when called, so that versions build only what is new), gating group (none: regime plays no part), whether only the main board counts, entry reason.
RULES: dict[str, tuple] = {
    "trend_pullback": (_trend_pullback, None, False, "uptrend above its short averages; watch for an entry on a pullback"),
    "breakout_volume": (_breakout_volume, None, False, "breakout on rising volume; watch for follow-through"),
    "support_rebound": (_support_rebound, None, False, "pullback to support above the 20-bar average; watch for a rebound"),
    "industry_rotation": (_industry_rotation, "rotation", True, "strong industry with a stock that follows or leads it"),
    "moneyflow_accumulation": (_moneyflow_accumulation, "moneyflow", True, "steady inflow of large orders before the price has moved far"),
    "low_vol_trend": (_low_vol_trend, "trend", True, "averages in order with calm moves and volume"),
    "oversold_rebound": (_oversold_rebound, "rebound", True, "mild oversold move with flow or industry repair"),
    "volume_dryup_breakout": (_volume_dryup_breakout, "breakout", True, "volume picks up after a quiet phase and price breaks upward"),
    "relative_strength_pullback": (_relative_strength_pullback, "pullback", True, "stronger than its industry, in a mild pullback"),
}
#: Fixed value: the rules that are on by default.
ENABLED = ("trend_pullback", "breakout_volume", "support_rebound")
FIRST_BRANCH = {"moneyflow_accumulation": "v1_main_inflow"}


def gated(columns: list[str], group: str | None, strength: Column) -> tuple[Column, Column]:
    """Strength scaled by market regime and the flag that says so; unchanged unless the caller joined the regime."""
    none = F.lit(None).cast("string")
    if group is None or not {"market_regime", "risk_level"} & set(columns):
        return strength, none
    say = lambda n, v: holds(F.lower(n) == v) if n in columns else F.lit(False)
    weak, strong = say("market_regime", "weak") | say("risk_level", "high"), say("market_regime", "strong") | say("risk_level", "low")
    if group in ("breakout", "rotation", "moneyflow"):
        return strength * F.when(weak, 0.75).otherwise(1.0) * F.when(strong, 1.05).otherwise(1.0), F.when(weak, "weak_market_regime")
    return strength * F.when(weak, 0.9).otherwise(1.0), F.when(weak, "weak_market_regime_conservative")


def regime_gating(df: DataFrame, group: str) -> DataFrame:
    strength, gate = gated(df.columns, group, c("signal_strength"))
    return df.withColumns({"signal_strength": strength, "_gate": gate})


def main_board(columns: list[str]) -> Column:
    """The conditions of filter_main_board, for the columns there are."""
    keep = F.substring("code", 1, 3).isin(*MAIN_BOARD)
    if "name" in columns:
        name = F.upper(F.coalesce("name", F.lit("")))
        keep &= ~name.contains("ST") & ~name.contains("退")
    if "list_status" in columns:
        keep &= holds(c("list_status") == "L")
    if "paused" in columns:
        keep &= ~to_bool("paused")
    return keep


def _all(conditions: list[Column]) -> Column:
    """Whether all conditions hold; an unknown one does not."""
    return reduce(lambda a, b: a & b, map(holds, conditions))


def _conditions(columns: list[str], name: str, p: Params) -> list[Callable[[], Column]]:
    build, _, board, _ = RULES[name]
    return [*build(p)[0], *([lambda: main_board(columns)] if board else [])]


def _text(marks: list, gate: Column) -> Column:
    return flag_text(F.array_compact(F.concat(flags(*marks), F.array(gate))))


def _signal(columns: list[str], name: str, p: Params, version: Column) -> Column:
    """The signal of a rule on a factor row as a struct, null where the rule does not hold."""
    build, group, _, reason = RULES[name]
    _, strength, marks = build(p)
    strength, gate = gated(columns, group, strength())
    return F.when(_all([x() for x in _conditions(columns, name, p)]), F.struct(F.lit(name).alias("strategy_name"), version.alias("strategy_version"), strength.alias("signal_strength"), F.lit(reason).alias("entry_reason"), _text(marks(), gate).alias("risk_flags")))


Rule = Callable[[DataFrame], DataFrame]


def enabled_rules(config: dict[str, dict] | None = None) -> list[str]:
    """Rules in use: those on by default, unless *config* says otherwise by rule: {"enabled": bool}."""
    return [n for n in RULES if (config or {}).get(n, {}).get("enabled", n in ENABLED)]


def run_strategies(factors: DataFrame, rules: list[str | Rule] | None = None, params: dict | None = None, version: str = "v1", config: dict[str, dict] | None = None) -> DataFrame:
    """Signals of several rules with their defaults and *params* on top, in one pass over the factors.

    rules: names, or functions of the factors for rules of the caller's own; without it, those that are enabled.  A caller's rule
    may leave columns out: its version is then v1, its strength 0.  A key that repeats keeps its strongest signal."""
    rules = enabled_rules(config) if rules is None else rules

    def given(name: str) -> Params:
        values = DEFAULTS[name] | (params or {}) | {"branch": FIRST_BRANCH.get(name, "")}
        return lambda k: F.lit(float(values[k]) if isinstance(values[k], bool) else values[k])

    own = [r(factors) for r in rules if callable(r)]
    names = [r for r in rules if not callable(r)]
    if names or not own:
        found = [_signal(factors.columns, n, given(n), F.lit(version)) for n in names or RULES]
        found = F.array_compact(F.array(*found)) if names else F.slice(F.array(*found), 1, 0)
        built = factors.select("trade_date", "code", F.explode(found).alias("s")).select("trade_date", "code", "s.*")
        if not own:
            return built
        own.insert(0, built)
    def aligned(df: DataFrame) -> DataFrame:
        text = {x: c(x).cast("string") if x in df.columns else F.lit(None).cast("string") for x in SIGNALS[2:]}
        text["strategy_version"] = F.coalesce(text["strategy_version"], F.lit("v1"))
        text["signal_strength"] = F.coalesce(c("signal_strength").try_cast("double"), F.lit(0.0)) if "signal_strength" in df.columns else F.lit(0.0)
        return df.select(*SIGNALS[:2], *[text[x].alias(x) for x in SIGNALS[2:]])

    both = reduce(DataFrame.unionByName, map(aligned, own))
    first = Window.partitionBy(*SIGNALS[:4]).orderBy(F.desc("signal_strength"), "entry_reason", "risk_flags")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def rule(factors: DataFrame, name: str, params: dict | None = None, version: str = "v1") -> DataFrame:
    """Signals of one rule over all dates of *factors*."""
    return run_strategies(factors, [name], params, version)


#: Versions in a word of a bitmap.
BITS = 62


def _used(x: Column) -> tuple[str, ...]:
    """Parameters that a traced expression names."""
    return tuple(sorted(set(re.findall(r"\bparam_(\w+)", str(x)))))


def _values(r: dict) -> Params:
    """Parameters of a version as literals."""
    return lambda k: F.lit(r[k]) if k == "branch" else F.lit(r[k]).cast("double")


def _tuples(traced: list[Column], rows: list[dict]) -> list[dict[tuple, list[int]]]:
    """Per expression the versions by the values of the parameters it names."""
    out: list[dict[tuple, list[int]]] = []
    for x in traced:
        keys, by = _used(x), {}
        for i, r in enumerate(rows):
            by.setdefault(tuple(r[k] for k in keys), []).append(i)
        out.append(by)
    return out


def _rule_hits(columns: list[str], name: str, rows: list[dict]) -> tuple[Column, list[int]]:
    """A struct of the versions of a rule that hold on a row, null if none does, and which of its flag texts each version takes.

    Every condition is evaluated once per distinct set of the parameter values it depends on, and yields the bitmap of the versions
    with these values; the versions that hold are the conjunction of the conditions' bitmaps."""
    trace: Params = lambda k: c(f"param_{k}")
    by_condition = _tuples([x() for x in _conditions(columns, name, trace)], rows)
    words = -(-len(rows) // BITS)
    bitmaps: list[Column | None] = [None] * words
    for at, by in enumerate(by_condition):
        parts: list[Column | None] = [None] * words
        for members in by.values():
            met = holds(_conditions(columns, name, _values(rows[members[0]]))[at]())
            for w in range(words):
                mask = sum(1 << (i % BITS) for i in members if i // BITS == w)
                if mask:
                    bits = F.when(met, F.lit(mask).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
                    parts[w] = bits if parts[w] is None else parts[w].bitwiseOR(bits)
        for w in range(words):
            bitmaps[w] = parts[w] if bitmaps[w] is None else bitmaps[w].bitwiseAND(parts[w])
    build, group, _, reason = RULES[name]
    _, strength, marks = build(trace)
    if _used(own := strength()):
        raise ValueError(f"the strength of {name} depends on parameters")
    strength, gate = gated(columns, group, own)
    (by_text,) = _tuples([F.array(*[m for m, _ in marks()])], rows)
    texts, which = [], [0] * len(rows)
    for n, members in enumerate(by_text.values()):
        texts.append(_text(build(_values(rows[members[0]]))[2](), gate))
        for i in members:
            which[i] = n
    hit = F.struct(F.lit(name).alias("strategy_name"), F.array(*bitmaps).alias("bits"), strength.alias("signal_strength"), F.lit(reason).alias("entry_reason"), F.array(*texts).alias("texts"))
    return F.when(reduce(lambda a, b: a | b, [x != 0 for x in bitmaps]), hit), which


def version_hits(factors: DataFrame, versions: DataFrame, names: list[str] | None = None, keep: tuple[str, ...] = ("trade_date", "code")) -> tuple[DataFrame, DataFrame]:
    """One row per factor row and rule of which some version holds, with the bitmap of these versions, and the table that says which
    bit is which version.  The version table is a driver-built list of a few hundred rows."""
    names = [n for n in names or list(RULES) if n in RULES]
    rows = [{k.removeprefix("p_"): v for k, v in r.asDict().items()} for r in versions.where(c("strategy_name").isin(*names)).collect()]
    hits, bits = [], []
    for n in names:
        own = [r for r in rows if r["strategy_name"] == n]
        if own:
            hit, which = _rule_hits(factors.columns, n, own)
            hits.append(hit)
            bits += [(n, r["strategy_version"], i // BITS, 1 << (i % BITS), t) for i, (r, t) in enumerate(zip(own, which))]
    table = factors.sparkSession.createDataFrame(bits, "strategy_name string, strategy_version string, word int, mask bigint, text int")
    if not hits:
        none = F.array().cast("array<struct<strategy_name:string,bits:array<bigint>,signal_strength:double,entry_reason:string,texts:array<string>>>")
        return factors.select(*keep, F.explode(none).alias("s")).select(*keep, "s.*"), table
    return factors.select(*keep, F.explode(F.array_compact(F.array(*hits))).alias("s")).select(*keep, "s.*"), table


def all_versions(factors: DataFrame, versions: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Signals of every version on every date in one scan of the factors: bitmaps of the versions that hold, then one row per bit."""
    hits, table = version_hits(factors, versions, names)
    met = hits.join(F.broadcast(table), "strategy_name").where(F.get("bits", c("word")).bitwiseAND(c("mask")) != 0)
    return met.select("trade_date", "code", "strategy_name", "strategy_version", "signal_strength", "entry_reason", F.get("texts", c("text")).alias("risk_flags"))


def latest_slice(df: DataFrame) -> DataFrame:
    """Rows of the latest date: the maximum is a one-row broadcast, not a driver round trip."""
    return df.join(F.broadcast(df.agg(F.max("trade_date").alias("trade_date"))), "trade_date", "left_semi")
