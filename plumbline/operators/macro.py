"""Macro and currency series: alignment on sessions, differences, spreads, regressions and forecasts."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.expressions import normal_quantile, ratio


def by_date(date_col: str, *keys: str):
    """A series has some 250 rows a year; ``keys`` tell series apart."""
    return Window.partitionBy(*keys).orderBy(date_col)


def returns_on_own_dates(series: DataFrame, date_col: str, value: str, *keys: str) -> DataFrame:
    """Adds ret: the change against the series' own date before, to be joined with sessions afterwards."""
    return series.withColumn("ret", ratio(F.col(value), F.lag(value).over(by_date(date_col, *keys))) - 1)


def aligned(sessions: DataFrame, series: DataFrame, date_col: str, value: str, *keys: str) -> DataFrame:
    """``sessions`` with the series' value of that very date, else the last such value: values of other dates never count.
    ``keys``, which both have, tell series apart."""
    x = sessions.join(series.select(*keys, date_col, F.col(value).alias("_v")), [*keys, date_col], "left")
    return x.withColumn(value, F.last("_v", ignorenulls=True).over(by_date(date_col, *keys).rowsBetween(Window.unboundedPreceding, 0))).drop("_v")


def difference(value: str, date_col: str, *keys: str) -> Column:
    """Against the row before; 0 for the first."""
    return F.coalesce(F.col(value) - F.lag(value).over(by_date(date_col, *keys)), F.lit(0.0))


def change(value: str, date_col: str, n: int = 252, *keys: str) -> Column:
    """Relative, against n rows before."""
    return ratio(F.col(value), F.lag(value, n).over(by_date(date_col, *keys))) - 1


def spread(us: Column, other: Column) -> Column:
    """us - other, or us where the other is null."""
    return F.coalesce(us - other, us)


def exogenous(sessions: DataFrame, date_col: str, us10: DataFrame, jp10: DataFrame, us_cpi: DataFrame, jp_cpi: DataFrame, periods: int = 252) -> DataFrame:
    """rate_diff_10y, its first difference and real_rate_diff on ``sessions``; the series have ``date_col`` and value."""
    x = sessions.select(date_col)
    for name, s in (("us10", us10), ("jp10", jp10), ("us_cpi", us_cpi), ("jp_cpi", jp_cpi)):
        x = aligned(x, s.select(date_col, F.col("value").alias(name)), date_col, name)
    x = x.withColumn("rate_diff_10y", spread(F.col("us10"), F.col("jp10")))
    real = (F.col("us10") - 100 * change("us_cpi", date_col, periods)) - (F.col("jp10") - 100 * change("jp_cpi", date_col, periods))
    return x.select(date_col, "rate_diff_10y", difference("rate_diff_10y", date_col).alias("d_rate_diff_10y"), real.alias("real_rate_diff"))


def realized_volatility(value: str, date_col: str, n: int = 20, per_year: int = 252) -> tuple[Column, Column]:
    """The return of a level and, over that column named r, the deviation of the last n, null with fewer."""
    w = by_date(date_col).rowsBetween(1 - n, 0)
    return returns(value, date_col), F.when(F.count("r").over(w) >= n, F.stddev_samp("r").over(w) * per_year**0.5)


def returns(value: str, date_col: str) -> Column:
    return ratio(F.col(value), F.lag(value).over(by_date(date_col))) - 1


def volatility_regime(levels: DataFrame, date_col: str, value: str, n: int = 20, lookback: int = 1260) -> DataFrame:
    """One row: the latest realized volatility, the part of the last ``lookback`` ones at or below it, its level, and whether
    that is high. Of fewer than n + 5 levels, the level is ``unknown`` and the numbers are null."""
    r, vol = realized_volatility(value, date_col, n)
    known = levels.filter(F.col(value).isNotNull())
    enough = known.agg((F.count(F.lit(1)) >= n + 5).alias("_enough"))
    x = known.withColumn("r", r).withColumn("vol", vol).filter("vol IS NOT NULL").join(F.broadcast(enough)).filter("_enough")
    x = x.withColumn("_k", F.row_number().over(Window.orderBy(F.col(date_col).desc()))).filter(F.col("_k") <= lookback)
    x = x.agg(F.max(F.when(F.col("_k") == 1, F.col("vol"))).alias("vol"), F.collect_list("vol").alias("_all"))  # ``lookback`` numbers
    pct = ratio(F.size(F.filter("_all", lambda v: v <= F.col("vol"))).cast("double"), F.size("_all").cast("double"))
    level = F.when(F.col("percentile") >= 0.8, "high").when(F.col("percentile") >= 0.6, "elevated").when(F.col("percentile").isNotNull(), "normal").otherwise("unknown")
    return x.select("vol", pct.alias("percentile")).withColumn("level", level).withColumn("high_vol", F.col("level") == "high")


def correlation_level(mean: Column) -> Column:
    """Of the mean correlation of pairs; null where there is none."""
    return F.when(mean >= 0.5, "high").when(mean <= 0.25, "low").when(mean.isNotNull(), "normal")


def regime_snapshot(volatility: DataFrame, correlation: DataFrame, model: DataFrame, drift: DataFrame) -> DataFrame:
    """One row of what the four judgements say, each a table of one row: volatility (vol, percentile, level, high_vol),
    correlation (mean_correlation), model (ic_recent, percentile, degraded) and drift (n_drifted). Three drifted columns
    ask for a new fit."""
    v = volatility.select(F.col("vol").alias("vol"), F.col("percentile").alias("vol_percentile"), F.col("level").alias("vol_level"), "high_vol")
    c = correlation.select("mean_correlation", correlation_level(F.col("mean_correlation")).alias("correlation_level"))
    m = model.select("ic_recent", F.col("percentile").alias("ic_percentile"), "degraded")
    d = drift.select("n_drifted", (F.col("n_drifted") >= 3).alias("retrain"))
    return v.crossJoin(c).crossJoin(m).crossJoin(d)  # a row each


def degradation(ics: DataFrame, date_col: str, recent: int = 20, year: int = 252, quantile: float = 0.10) -> DataFrame:
    """One row: the mean of the ``recent`` latest rank correlations, the part of the last ``year`` at or below it, and whether
    that is at most ``quantile``; nulls with fewer than ``recent``."""
    x = ics.filter("ic IS NOT NULL").withColumn("_k", F.row_number().over(Window.orderBy(F.col(date_col).desc()))).filter(F.col("_k") <= year)
    x = x.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("_k") <= recent, F.col("ic"))).alias("ic_recent"), F.collect_list("ic").alias("_all"))
    pct = ratio(F.size(F.filter("_all", lambda v: v <= F.col("ic_recent"))).cast("double"), F.col("n").cast("double"))
    enough = F.col("n") >= recent
    return x.select(F.when(enough, F.col("ic_recent")).alias("ic_recent"), F.when(enough, pct).alias("percentile"), F.coalesce(enough & (pct <= quantile), F.lit(False)).alias("degraded"))


def arx(y: np.ndarray, x: np.ndarray | None, horizon: int, level: float = 0.95) -> tuple[float, float, float]:
    """Point and bounds of a level ``horizon`` steps on: its differences regressed on the one before and on ``x``, whose last
    value is held."""
    d = np.diff(y)
    design = [np.ones(len(d) - 1), d[:-1], *([] if x is None else [x[2:]])]
    a = np.column_stack(design)
    beta, *_ = np.linalg.lstsq(a, d[1:], rcond=None)
    left = d[1:] - a @ beta
    free = len(left) - len(beta)
    sigma = math.sqrt(float(left @ left - left.sum() ** 2 / len(left)) / free) if free > 0 else 0.0
    at, move = float(y[-1]), float(d[-1])
    for _ in range(horizon):
        move = float(beta @ np.array([1.0, move, *([] if x is None else [float(x[-1])])]))
        at += move
    half = normal_quantile(0.5 + level / 2) * sigma * math.sqrt(horizon)
    return at, at - half, at + half


def _determinant(m: Sequence[Sequence[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    out = F.lit(0.0)
    for j, x in enumerate(m[0]):
        minor = _determinant([[*row[:j], *row[j + 1 :]] for row in m[1:]])
        out = out + x * minor if j % 2 == 0 else out - x * minor
    return out


def solved(m: Sequence[Sequence[Column]], v: Sequence[Column]) -> tuple[Column, list[Column]]:
    """Determinant of a small system and its solution, null where the determinant is 0."""
    whole = _determinant(m)
    return whole, [F.try_divide(_determinant([[v[i] if k == j else x for k, x in enumerate(row)] for i, row in enumerate(m)]), whole) for j in range(len(v))]


def rolling_forecasts(series: DataFrame, date_col: str, value: str, exog: str | None, horizon: int, window: int = 60, least: int = 60, keys: Sequence[str] = ()) -> DataFrame:
    """origin, actual, walk and model at each of the last ``window`` origins with ``least`` points before and ``horizon`` after: the
    last level, and an autoregression of the logarithm's differences with ``exog``, fitted anew on all that is known then.

    An origin's normal equations are sums of products over all rows up to it: running sums, so that the work is linear in the
    length of a series and a row carries a few numbers, not its history. They are solved in closed form; where ``exog``
    never varies, without it. ``keys`` tell series apart; the last known value of ``exog`` is held, an unknown one counts as 0.
    """
    order = Window.partitionBy(*keys).orderBy(date_col)
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    held = F.coalesce(F.last(F.col(exog).cast("double"), ignorenulls=True).over(past), F.lit(0.0)) if exog else F.lit(0.0)
    x = series.filter(F.col(value).isNotNull())
    x = x.select(*keys, date_col, F.col(value).cast("double").alias("_v"), F.ln(F.col(value).cast("double")).alias("_y"), held.alias("_x"), F.row_number().over(order).alias("_n"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_all"))
    x = x.withColumns({"_d": F.col("_y") - F.lag("_y").over(order), "actual": F.lead("_v", horizon).over(order)})
    x = x.withColumn("_l", F.lag("_d").over(order))
    terms = {"1": F.lit(1.0), "l": F.col("_l"), "x": F.col("_x"), "d": F.col("_d")}
    names = list(terms)
    pair = lambda p, q: f"_s{min(p, q, key=names.index)}{max(p, q, key=names.index)}"
    ready = F.col("_l").isNotNull()
    x = x.withColumns({pair(p, q): F.sum(F.when(ready, terms[p] * terms[q])).over(past) for i, p in enumerate(names) for q in names[i:]})
    x = x.filter((F.col("_n") >= least) & (F.col("_n") > F.col("_all") - horizon - window) & F.col("actual").isNotNull())

    def fit(regressors: Sequence[str]) -> tuple[Column, list[Column]]:
        return solved([[F.col(pair(p, q)) for q in regressors] for p in regressors], [F.col(pair(p, "d")) for p in regressors])

    small, beta = fit(["1", "l"])
    c, phi, k = beta[0], beta[1], F.lit(0.0)
    if exog:
        large, with_x = fit(["1", "l", "x"])
        spread = F.col("_s11") * F.col("_sxx") - F.col("_s1x") * F.col("_s1x")
        varies = (spread > 1e-12 * F.col("_s11") * F.col("_sxx")) & (F.abs(large) > 0)
        c, phi, k = (F.when(varies, w).otherwise(o) for w, o in zip(with_x, (c, phi, k)))
    flat = small == 0  # differences that never vary go on as they are
    x = x.withColumns({"_c": F.when(flat, F.col("_s1d") / F.col("_s11")).otherwise(c), "_phi": F.when(flat, 0.0).otherwise(phi), "_k": F.when(flat, 0.0).otherwise(k)})
    drift, move, total = F.col("_c") + F.col("_k") * F.col("_x"), F.col("_d"), F.lit(0.0)
    for _ in range(horizon):
        move = drift + F.col("_phi") * move
        total = total + move
    return x.select(*keys, F.col(date_col).cast("string").alias("origin"), "actual", F.col("_v").alias("walk"), F.exp(F.col("_y") + total).alias("model"))


def directional_accuracy(errors: DataFrame) -> DataFrame:
    """Part of the forecasts whose side of the last level was right; a move of 0 counts half."""
    real, said = F.signum(F.col("actual") - F.col("walk")), F.signum(F.col("model") - F.col("walk"))
    return errors.agg(F.avg(F.when(real == 0, 0.5).otherwise((real == said).cast("double"))).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def bundle(models: Sequence[DataFrame]) -> DataFrame:
    """model_id, point, low, high: one row a model."""
    rows = [m.select("model_id", "point", "low", "high") for m in models]
    out = rows[0]
    for m in rows[1:]:
        out = out.unionByName(m)
    return out
