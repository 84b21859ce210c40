"""Rebalanced portfolios with costs, their metrics, and the deflated Sharpe ratio."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.expressions import bound, months_inclusive, ratio

EULER = 0.5772156649015329
YEAR = 252
FREQUENCIES = {"weekly": "week", "monthly": "month"}


def validate(signals: DataFrame, calendar: DataFrame, *, start: dt.date, end: dt.date, fee_bps: float, slippage_bps: float, turnover_cap: float, n_trials: int, frequency: str = "weekly") -> None:
    """Raises ValueError for what cannot be tested: costs and the number of trials have no defaults."""
    if start >= end:
        raise ValueError("the period ends before it starts")
    if min(fee_bps, slippage_bps) < 0 or not 0 < turnover_cap <= 1 or n_trials < 1:
        raise ValueError("costs are not negative, the turnover cap lies in (0, 1], and a trial has been made")
    if frequency not in FREQUENCIES:
        raise ValueError(f"frequency is one of {', '.join(FREQUENCIES)}")
    if not signals.limit(1).count():
        raise ValueError("there are no signals")
    if calendar.filter(F.col("session").between(F.lit(start), F.lit(end))).limit(5).count() < 5:
        raise ValueError("the period has fewer than 5 sessions")


def periods(signals: DataFrame, calendar: DataFrame, every: str = "week") -> DataFrame:
    """as_of, entry, exit: rebalance on the first signal day of each period; trade at the next session's open; leave at
    the session after the next rebalance, or the last one."""
    days = signals.select(F.col("session").alias("as_of")).distinct()
    days = days.groupBy(F.date_trunc(every, "as_of").alias("p")).agg(F.min("as_of").alias("as_of")).drop("p")
    order = Window.orderBy("session")
    ahead = calendar.select("session", F.lead("session").over(order).alias("entry"), F.max("session").over(Window.partitionBy()).alias("final"))
    days = days.join(ahead, days["as_of"] == ahead["session"]).select("as_of", "entry", "final").filter("entry IS NOT NULL")
    return days.select("as_of", "entry", F.coalesce(F.lead("entry").over(Window.orderBy("as_of")), "final").alias("exit")).filter("exit > entry")


def targets(signals: DataFrame, days: DataFrame, n: int) -> DataFrame:
    """Equal weights of the best ``n`` scores of each rebalance day."""
    s = signals.join(F.broadcast(days), signals["session"] == days["as_of"]).filter("score IS NOT NULL")
    s = s.withColumn("nth", F.row_number().over(Window.partitionBy("as_of").orderBy(F.col("score").desc(), "ticker"))).filter(F.col("nth") <= n)
    return s.select("as_of", "entry", "exit", "ticker", F.try_divide(F.lit(1.0), F.count(F.lit(1)).over(Window.partitionBy("as_of"))).alias("target"))


def position_returns(target: DataFrame, prices: DataFrame) -> DataFrame:
    """Open to open; a position without one of its prices is left out and its weight earns nothing."""
    p = lambda when: prices.select("ticker", F.col("session").alias(when), F.col("open").alias(f"{when}_price"))
    t = target.join(p("entry"), ["ticker", "entry"], "left").join(p("exit"), ["ticker", "exit"], "left")
    return t.withColumn("ret", F.when(F.col("entry_price") > 0, ratio(F.col("exit_price"), F.col("entry_price")) - 1))


def turnover_capped(target: DataFrame, cap: float, *keys: str) -> DataFrame:
    """as_of, ticker, weight, turnover: weights that move towards the targets by half the sum of changes of ``cap`` at most a
    rebalance; the first one, too. ``keys`` tell portfolios apart.

    Each step depends on the one before: a fold over a portfolio's rebalances, inside the JVM. It holds ``n`` names a
    rebalance, a few hundred a year, however large the price table is; portfolios are spread over tasks. What a step uses more
    than once is bound, so that its work is in proportion to the names held.
    """
    days = target.groupBy(*keys, "as_of").agg(F.collect_list(F.struct("ticker", "target")).alias("want"))
    rows = days.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("as_of", "want"))).alias("days"))
    kind = dict(target.dtypes)
    name = kind["ticker"]
    weights = f"map<{name},double>"
    state = f"struct<held:{weights},out:array<struct<as_of:{kind['as_of']},held:{weights},turnover:double>>>"

    def step(s: Column, d: Column) -> Column:
        both = F.map_zip_with(s["held"], F.map_from_entries(d["want"]), lambda _, a, b: F.struct(F.coalesce(a, F.lit(0.0)).alias("a"), F.coalesce(b, F.lit(0.0)).alias("b")))
        return bound(both, lambda both: bound(F.aggregate(F.map_values(both), F.lit(0.0), lambda t, x: t + F.abs(x["b"] - x["a"])) / 2, lambda moved: traded(s, d, both, moved)))

    def traded(s: Column, d: Column, both: Column, moved: Column) -> Column:
        share = F.when(moved > 0, F.least(F.lit(1.0), F.lit(cap) / moved)).otherwise(1.0)
        held = bound(share, lambda part: F.map_filter(F.transform_values(both, lambda _, x: x["a"] + part * (x["b"] - x["a"])), lambda _, w: w > 1e-12))
        entry = lambda held: F.struct(d["as_of"].alias("as_of"), held.alias("held"), (moved * share).alias("turnover"))
        return bound(held, lambda held: F.struct(held.alias("held"), F.concat(s["out"], F.array(entry(held))).alias("out"))).cast(state)

    start = F.struct(F.create_map().cast(weights).alias("held"), F.array().cast(state.split("out:", 1)[1][:-1]).alias("out")).cast(state)
    folded = rows.select(*keys, F.explode(F.aggregate("days", start, step, lambda s: s["out"])).alias("x"))
    return folded.select(*keys, "x.as_of", "x.turnover", F.explode("x.held").alias("ticker", "weight"))


def _product(x: Column) -> Column:
    """The running product of an ordered array."""
    start = F.struct(F.lit(1.0).alias("now"), F.array().cast("array<double>").alias("all"))
    return F.aggregate(x, start, lambda s, v: F.struct((s["now"] * v).alias("now"), F.concat(s["all"], F.array(s["now"] * v)).alias("all")), lambda s: s["all"])


def equity(positions: DataFrame, bps: float, *keys: str) -> DataFrame:
    """as_of, gross, turnover, cost, net, equity, gross_equity, drawdown, from as_of, weight, ret and turnover. A loss of all leaves
    nothing to compound. One row a rebalance; ``keys`` tell portfolios apart, here and below."""
    days = positions.groupBy(*keys, "as_of").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross"), F.max("turnover").alias("turnover"))
    days = days.withColumn("cost", F.col("turnover") * bps / 1e4).withColumn("net", F.col("gross") - F.col("cost"))
    one = days.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("as_of", "gross", "turnover", "cost", "net"))).alias("d"))  # a few hundred rows
    one = one.withColumns({"equity": _product(F.transform("d", lambda r: 1 + r["net"])), "gross_equity": _product(F.transform("d", lambda r: 1 + r["gross"]))})
    days = one.select(*keys, F.explode(F.arrays_zip("d", "equity", "gross_equity")).alias("x")).select(*keys, "x.d.*", "x.equity", "x.gross_equity")
    w = Window.partitionBy(*keys).orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("drawdown", F.coalesce(ratio(F.col("equity"), F.max("equity").over(w)) - 1, F.lit(0.0)))


def deepest(curve: DataFrame, *keys: str) -> DataFrame:
    """max_drawdown, its peak (the first highest point up to the trough), trough, and recovery: the first later point as high."""
    rows = curve.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("as_of", "equity", "drawdown"))).alias("_c"))
    rows = rows.withColumn("_t", F.array_min(F.transform("_c", lambda x: F.struct(x["drawdown"], x["as_of"]))))
    before = F.filter("_c", lambda x: x["as_of"] <= F.col("_t.as_of"))
    rows = rows.withColumn("_p", F.element_at(F.array_sort(F.transform(before, lambda x: F.struct((0.0 - x["equity"]).alias("e"), x["as_of"].alias("as_of")))), 1))
    again = F.array_min(F.transform(F.filter("_c", lambda x: (x["as_of"] >= F.col("_t.as_of")) & (x["equity"] >= 0.0 - F.col("_p.e"))), lambda x: x["as_of"]))
    return rows.select(*keys, F.col("_t.drawdown").alias("max_drawdown"), F.col("_p.as_of").alias("peak"), F.col("_t.as_of").alias("trough"), again.alias("recovered"))


def benchmark_returns(curve: DataFrame, levels: DataFrame, exits: DataFrame, *keys: str) -> DataFrame:
    """as_of, bench: between successive exits, 0 for the first. Null in all rows if any level is missing."""
    x = curve.select(*keys, "as_of").join(exits.select(*keys, "as_of", "exit").distinct(), [*keys, "as_of"]).join(levels.select(F.col("session").alias("exit"), "level"), "exit", "left")
    w, all_of = Window.partitionBy(*keys).orderBy("as_of"), Window.partitionBy(*keys)
    x = x.withColumns({"ret": F.coalesce(ratio(F.col("level"), F.lag("level").over(w)) - 1, F.lit(0.0)), "whole": F.count("level").over(all_of) == F.count(F.lit(1)).over(all_of)})
    return x.select(*keys, "as_of", F.when(F.col("whole"), F.col("ret")).alias("bench"))


def metrics(curve: DataFrame, trades: DataFrame, n_days: int | Column = YEAR, bench: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One row a portfolio. Deviations are of samples; hit rate and profit factor are of trades (their raw returns); a ratio whose deviation is 0
    is 0, one without losses null. Returns of rebalances are annualised by 252, as days are."""
    net = F.col("net")
    year = F.lit(float(YEAR))
    steady = lambda mean, std: F.when(std == 0, 0.0).otherwise(ratio(mean, std) * F.sqrt(year))
    annual = lambda end: F.when(end <= 0, -1.0).otherwise(F.pow(F.greatest(end, F.lit(1e-300)), year / F.col("n_days")) - 1)
    loss = F.when(net < 0, net)
    extra = curve if bench is None else curve.join(bench, [*keys, "as_of"], "left")
    over = net - F.col("bench") if bench is not None else F.lit(None).cast("double")
    days = F.lit(n_days) if isinstance(n_days, int) else n_days
    x = extra.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("equity", "as_of").alias("end"), F.max_by("gross_equity", "as_of").alias("gross_end"), F.avg("net").alias("mean"), F.stddev_samp("net").alias("std"), F.stddev_samp(loss).alias("down"),
        F.min("drawdown").alias("max_drawdown"), F.avg("turnover").alias("mean_turnover"), F.sum("cost").alias("total_cost"), F.avg(over).alias("over"), F.stddev_samp(over).alias("over_std"),
    ).withColumn("n_days", F.greatest(days, F.lit(1)).cast("double"))
    t = trades.filter("ret IS NOT NULL").groupBy(*keys).agg(F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"), F.sum(F.greatest("ret", F.lit(0.0))).alias("gains"), (0.0 - F.sum(F.least("ret", F.lit(0.0)))).alias("losses"))
    x = x.join(t, list(keys), "left") if keys else x.crossJoin(t)  # one row each
    x = x.withColumns({"cagr": annual(F.col("end")), "gross_cagr": annual(F.col("gross_end"))})
    return x.select(
        *keys, "n", (F.col("end") - 1).alias("total_return"), "cagr", "gross_cagr", (F.col("std") * F.sqrt(year)).alias("volatility"), steady(F.col("mean"), F.col("std")).alias("sharpe"), steady(F.col("mean"), F.col("down")).alias("sortino"),
        "max_drawdown", F.when(F.col("max_drawdown") != 0, F.col("cagr") / F.abs("max_drawdown")).alias("calmar"), "hit_rate", F.when(F.col("losses") > 0, F.col("gains") / F.col("losses")).alias("profit_factor"),
        "mean_turnover", "total_cost", (F.col("gross_cagr") - F.col("cagr")).alias("cost_drag"), (F.col("over") * year).alias("alpha"), steady(F.col("over"), F.col("over_std")).alias("information_ratio"),
    )


def monthly_hit_rate(curve: DataFrame) -> DataFrame:
    """Part of the calendar months, empty ones included, whose net returns add up to more than 0."""
    months = curve.groupBy(F.date_trunc("month", "as_of").cast("date").alias("m")).agg(F.sum("net").alias("net"))
    return months.agg(F.count_if(F.col("net") > 0).alias("up"), months_inclusive(F.min("m"), F.max("m")).alias("months")).select("up", "months", ratio(F.col("up"), F.col("months")).alias("hit_rate"))


def expected_max_sharpe(trials: int, variance: float) -> float:
    if trials <= 1:
        return 0.0
    z = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * z(1 - 1 / trials) + EULER * z(1 - 1 / (trials * math.e)))


def deflated_sharpe(sharpe: float, trials: int, n: int, skew: float = 0.0, kurtosis: float = 3.0, variance: float = 1.0) -> float:
    """Probability that the true ratio exceeds what ``trials`` tries give by luck; 0 with fewer than 3 observations."""
    if n < 3:
        return 0.0
    spread = max(1e-12, 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2)
    return NormalDist().cdf((sharpe - expected_max_sharpe(trials, variance)) * math.sqrt(n - 1) / math.sqrt(spread))


def deflated(curve: DataFrame, trials: int, variance: float = 1.0) -> DataFrame:
    """The same of a curve's annualised ratio, its moments corrected for bias: n, skew, kurtosis, z and dsr."""
    from plumbline.functions.expressions import bias_corrected_kurtosis, bias_corrected_skewness, normal_cdf

    n, sharpe = F.col("n"), F.col("sharpe")
    x = curve.agg(F.count("net").alias("n"), (ratio(F.avg("net"), F.stddev_samp("net")) * YEAR**0.5).alias("sharpe"), F.coalesce(bias_corrected_skewness("net"), F.lit(0.0)).alias("skew"), F.coalesce(bias_corrected_kurtosis("net") + 3, F.lit(3.0)).alias("kurtosis"))
    spread = F.greatest(1 - F.col("skew") * sharpe + (F.col("kurtosis") - 1) / 4 * sharpe * sharpe, F.lit(1e-12))
    z = (sharpe - expected_max_sharpe(trials, variance)) * F.sqrt(n - 1) / F.sqrt(spread)
    return x.withColumn("z", F.when(n >= 3, z)).withColumn("dsr", F.when(n >= 3, normal_cdf(F.col("z"))).otherwise(0.0))


def trade_rows(positions: DataFrame) -> DataFrame:
    """One row a position that could be traded."""
    return positions.filter("ret IS NOT NULL").select("as_of", "entry", "exit", "ticker", "weight", "entry_price", "exit_price", "ret", (F.col("weight") * F.col("ret")).alias("contribution"))
