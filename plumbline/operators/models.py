"""Statistical models: drift, volatility, forecasts and their comparison, a ranker by least squares."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.session import ship
from plumbline.staging import stored

def ks_distance(df: DataFrame, value: str, first: str) -> DataFrame:
    """Largest distance of the two samples' distribution functions; ``first`` tells the sample. Counts of distinct values lie in
    range partitions, stored once with their numbers; running counts are made inside them and shifted by the totals of earlier
    ones, of which there is a row a partition."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(first).alias("a"), F.count_if(~F.col(first)).alias("b"))
    counts = counts.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "v")
    counts = stored(counts.select("v", "a", "b", F.spark_partition_id().alias("slice")), "ks-counts")
    inside = Window.partitionBy("slice").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy("slice").agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
    cells = cells.select("slice", *[F.coalesce(F.sum(f"c{x}").over(before), F.lit(0)).alias(f"o{x}") for x in "ab"], *[F.sum(f"c{x}").over(Window.partitionBy()).alias(f"n{x}") for x in "ab"])
    run = counts.select("slice", *[F.sum(x).over(inside).alias(f"r{x}") for x in "ab"]).join(F.broadcast(cells), "slice")
    share = lambda x: F.try_divide(F.col(f"o{x}") + F.col(f"r{x}"), F.col(f"n{x}"))
    return run.agg(F.max(F.abs(share("a") - share("b"))).alias("ks"), F.max("na").alias("n_first"), F.max("nb").alias("n_second"))


def ks_p_value(distance: float, n: int, m: int) -> float:
    e = math.sqrt(n * m / (n + m))
    x = (e + 0.12 + 0.11 / e) * distance
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0.2 else 1.0


def volatility_regime(share_below: Column) -> Column:
    return F.when(share_below >= 0.8, "high").when(share_below >= 0.6, "elevated").when(share_below.isNotNull(), "normal")


# GARCH(1,1): fixed values of the grid of the two coefficients, the history, and what is refused; the constant follows from
# the sample variance.
ALPHAS, BETAS = np.linspace(0.02, 0.30, 15), np.linspace(0.65, 0.98, 18)
LEAST, LAST, INTERIOR, PERSISTENCE, MARGIN = 500, 1000, 0.997, 0.999, 0.5
FIT = "alpha double, beta double, omega double, quality string, vol_1d double, vol_20d double, ret_20d_lo double, ret_20d_hi double"


def _path(omega: float, alpha: float, beta: float, shock: float, variance: float, horizon: int) -> np.ndarray:
    out = np.empty(horizon)
    out[0] = omega + alpha * shock + beta * variance
    for h in range(1, horizon):
        out[h] = omega + (alpha + beta) * out[h - 1]
    return out


def _outlook(omega: float, alpha: float, beta: float, shock: float, variance: float, mean: float, horizon: int = 20) -> dict:
    """Annualised volatilities of the next day and of the mean variance of ``horizon`` days, and the interval of the return over
    them; returns are in percent here."""
    path = _path(omega, alpha, beta, shock, variance, horizon)
    day, month = math.sqrt(max(path[0], 1e-12)) / 100, math.sqrt(max(float(path.mean()), 1e-12)) / 100
    half = NormalDist().inv_cdf(0.975) * month * math.sqrt(horizon)
    return {"vol_1d": day * 252**0.5, "vol_20d": month * 252**0.5, "ret_20d_lo": mean / 100 * horizon - half, "ret_20d_hi": mean / 100 * horizon + half}


def garch_fit(returns: np.ndarray) -> dict:
    """Grid maximum likelihood with variance targeting on the last 1000 of at least 500 returns, in percent. All grid points run
    through the series at once. No fit where persistence at the edge does as well, within half a unit of likelihood, as any
    inside: then, and for short series, the volatilities are those of the sample, and ``quality`` says so."""
    r = np.asarray(returns, float)
    r = r[np.isfinite(r)]
    blank = dict.fromkeys(("alpha", "beta", "omega", "vol_1d", "vol_20d", "ret_20d_lo", "ret_20d_hi"))
    if len(r) < 2:
        return blank | {"quality": "too_short"}
    plain = float(r[-60:].std(ddof=1)) * 252**0.5
    fallback = blank | {"vol_1d": plain, "vol_20d": plain, "quality": "too_short" if len(r) < LEAST else "fallback"}
    if len(r) < LEAST:
        return fallback
    x = 100 * r[-LAST:]
    mean = float(x.mean())
    square = (x - mean) ** 2
    target = float(square.mean())
    a, b = (g.ravel() for g in np.meshgrid(ALPHAS, BETAS, indexing="ij"))
    ok = a + b < PERSISTENCE
    a, b = a[ok], b[ok]
    omega = target * (1 - a - b)
    h, before, ll = np.full(len(a), target), np.full(len(a), target), np.zeros(len(a))
    for v in square:
        ll -= 0.5 * (np.log(np.maximum(h, 1e-12)) + v / np.maximum(h, 1e-12))
        before, h = h, omega + a * v + b * h
    inside = a + b < INTERIOR
    if target <= 0 or not np.isfinite(ll[inside]).any() or ll[~inside].max(initial=-np.inf) >= np.nanmax(ll[inside]) - MARGIN:
        return fallback
    k = int(np.nanargmax(np.where(inside, ll, -np.inf)))
    fit = {"alpha": float(a[k]), "beta": float(b[k]), "omega": float(omega[k]), "quality": "ok"}
    return fit | _outlook(fit["omega"], fit["alpha"], fit["beta"], float(square[-1]), float(before[k]), mean)


def _garch(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([{"ticker": rows["ticker"].iloc[0]} | garch_fit(rows.sort_values("t")["r"].to_numpy())])


def garch(returns: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """One fit a series; at most its last 1000 returns leave Spark's window, so a group is small however long it is."""
    ship(returns.sparkSession)
    w = Window.partitionBy(key).orderBy(F.col(time).desc())
    rows = returns.filter(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= LAST)
    rows = rows.select(F.col(key).cast("string").alias("ticker"), F.col(time).alias("t"), F.col(value).cast("double").alias("r"))
    return rows.groupBy("ticker").applyInPandas(_garch, f"ticker string, {FIT}")


def garch_variance(returns: DataFrame, fits: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """key and variance (of returns in percent) of the next day by parameters fitted before.

    The recurrence v <- omega + alpha r^2 + beta v is affine, so that after n returns v is beta^n v0 plus the sum of
    beta^(n-i) (omega + alpha r_i^2): a weighted sum. A return's weight hangs on how many come after it, and weights below
    1e-18 of the first change no digit: only the latest ``_reach(beta)`` returns of a series are ranked (Spark keeps so many a
    partition), however long it is; the start is the variance of all its returns.
    """
    rows = returns.filter(F.col(value).isNotNull()).select(key, F.col(time).alias("_t"), (F.col(value).cast("double") * 100).alias("_r"))
    top = fits.agg(F.max("beta")).first()[0]
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_t").desc()))
    late = rows.withColumn("_n", n).filter(F.col("_n") <= _reach(top)).join(fits.select(key, "alpha", "beta", "omega"), key)
    term = F.pow("beta", F.col("_n") - 1) * (F.col("omega") + F.col("alpha") * F.col("_r") * F.col("_r"))
    sums = late.groupBy(key).agg(F.sum(term).alias("_s"), F.max("beta").alias("_b"))
    start = rows.groupBy(key).agg(F.var_samp("_r").alias("_v"), F.count(F.lit(1)).alias("_c"))
    return sums.join(start, key).select(key, (F.col("_s") + F.pow("_b", "_c") * F.col("_v")).alias("variance"))


def _reach(beta: float | None) -> int:
    """After so many steps a weight of beta per step is below 1e-18."""
    if not beta or beta <= 0:
        return 1
    if beta >= 1:
        raise ValueError("the recurrence has beta below 1")
    return max(1, math.ceil(math.log(1e-18) / math.log(beta)))


def diebold_mariano(a: Sequence[float], b: Sequence[float], horizon: int = 1, hac: bool = True) -> dict:
    """Whether squared errors differ: Bartlett weights up to horizon - 1 lags, small-sample correction, normal p-value."""
    d = np.asarray(a, float) ** 2 - np.asarray(b, float) ** 2
    n = len(d)
    if n < 8:
        return {"statistic": None, "p_value": 1.0, "better": "none"}
    c = d - d.mean()
    var = float(c @ c) / n
    if hac:
        var += sum(2 * (1 - k / horizon) * float(c[k:] @ c[:-k]) / n for k in range(1, min(horizon, n)))
    if var <= 0:
        return {"statistic": 0.0, "p_value": 1.0, "better": "none"}
    s = d.mean() / math.sqrt(var / n)
    if hac:
        s *= math.sqrt(max(0.0, (n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n))
    p = 2 * (1 - NormalDist().cdf(abs(s)))
    return {"statistic": s, "p_value": p, "better": "none" if p >= 0.05 else ("a" if s < 0 else "b")}


def random_walk(last: Column, sigma: Column, horizon: int, level: float = 0.95) -> list[Column]:
    z = NormalDist().inv_cdf(0.5 + level / 2) * math.sqrt(horizon)
    return [last.alias("forecast"), (last - z * sigma).alias("low"), (last + z * sigma).alias("high")]


def least_squares(df: DataFrame, xs: Sequence[str], y: str, ridge: float = 1e-6) -> dict[str, float]:
    """Coefficients by normal equations: one row of sums over complete cases reaches the driver."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    complete = df.dropna(subset=[*xs, y])
    k = len(cols)
    row = complete.agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"s{i}_{j}"] or 0.0
    beta = np.linalg.solve(m[:-1, :-1] + ridge * np.eye(k - 1), m[:-1, -1])
    return dict(zip(("intercept", *xs), map(float, beta)))


def predicted(coefficients: dict[str, float]) -> Column:
    out = F.lit(coefficients["intercept"])
    for x, b in coefficients.items():
        if x != "intercept":
            out = out + F.col(x) * b
    return out


def with_interval(coefficients: dict[str, float], residuals: tuple[float, float], name: str = "pred") -> list[Column]:
    """The prediction and its ends by residual quantiles, which never lie on its wrong side."""
    mean = predicted(coefficients)
    low, high = (F.lit(r) + mean for r in residuals)
    return [mean.alias(name), F.least(low, mean).alias(f"{name}_lo"), F.greatest(high, mean).alias(f"{name}_hi")]


def fit_ranker(df: DataFrame, xs: Sequence[str], y: str, n_trials: int, least: int = 50) -> tuple[dict[str, float], tuple[float, float]]:
    """Least squares on complete cases and the 20 % and 80 % quantiles of the residuals; at least 50 cases and 1 to 50 trials."""
    if not 1 <= n_trials <= 50:
        raise ValueError("n_trials lies between 1 and 50")
    rows = df.dropna(subset=[*xs, y])
    if rows.limit(least).count() < least:
        raise ValueError(f"fewer than {least} complete cases")
    beta = least_squares(rows, xs, y)
    low, high = rows.agg(F.percentile(F.col(y) - predicted(beta), F.array(F.lit(0.2), F.lit(0.8)))).first()[0]
    return beta, (low, high)


def save_ranker(spark, path: str, beta: dict[str, float], residuals: tuple[float, float]) -> None:
    rows = [(k, v) for k, v in beta.items()] + [("residual_low", residuals[0]), ("residual_high", residuals[1])]
    spark.createDataFrame(rows, "name string, value double").coalesce(1).write.mode("overwrite").parquet(path)


def load_ranker(spark, path: str) -> tuple[dict[str, float], tuple[float, float]]:
    found = {r["name"]: r["value"] for r in spark.read.parquet(path).collect()}  # one row a coefficient
    residuals = found.pop("residual_low"), found.pop("residual_high")
    return found, residuals


def walk_forward_ic(rows: DataFrame, splits: DataFrame, xs: Sequence[str], y: str, least: int = 3) -> DataFrame:
    """split_id, session, n, ic: per split, least squares on its training sessions, then the rank correlation of predictions and
    labels of each test session. ``splits``: split_id, role, session.

    All splits are fitted at once: normal equations are sums by split; one row a split reaches the driver.
    """
    from plumbline.operators.scoring import rank_correlation

    x = rows.dropna(subset=[*xs, y]).join(F.broadcast(splits), "session")
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in xs], F.col(y).cast("double")]
    k = len(cols)
    sums = x.filter("role = 'train'").groupBy("split_id").agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).collect()
    score = F.lit(None).cast("double")
    for r in sums:
        m = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                m[i, j] = m[j, i] = r[f"s{i}_{j}"] or 0.0
        beta = np.linalg.solve(m[:-1, :-1] + 1e-6 * np.eye(k - 1), m[:-1, -1])
        score = F.when(F.col("split_id") == r["split_id"], predicted(dict(zip(("intercept", *xs), map(float, beta))))).otherwise(score)
    tests = x.filter("role = 'test'").withColumn("score", score)
    return rank_correlation(tests, "score", y, ["split_id", "session"], least)


def drifted(df: DataFrame, columns: Sequence[str], first: str, least: int = 20, p: float = 0.01) -> DataFrame:
    """One row a column: distance, sizes and whether the two samples differ; three such columns ask for a new fit."""
    out = None
    for c in columns:
        one = ks_distance(df, c, first).withColumn("feature", F.lit(c))
        out = one if out is None else out.unionByName(one)
    n, m = F.col("n_first"), F.col("n_second")
    e = F.sqrt(n * m / (n + m))
    x = (e + 0.12 + 0.11 / e) * F.col("ks")
    prob = sum((F.exp(-2 * k * k * x * x) * (2 * (-1) ** (k - 1)) for k in range(2, 30)), F.exp(-2 * x * x) * 2)
    value = F.when(x > 0.2, F.least(F.greatest(prob, F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    return out.select("feature", "ks", "n_first", "n_second", value.alias("p_value"), F.coalesce((n >= least) & (m >= least) & (value < p), F.lit(False)).alias("drifted"))


def propose_weights(rows: DataFrame, columns: dict[str, str], excess: str, current: dict[str, float], ridge: float = 1.0, least: int = 100) -> dict[str, float] | None:
    """``proposed_weights`` of a ridge regression without intercept of ``excess`` on the groups' scores; ``columns`` is group -> column.
    Unknown scores and returns count as 0, but known returns must be ``least``; one row of sums reaches the driver."""
    groups = [g for g in current if g in columns and columns[g] in rows.columns]
    if not groups:
        return None
    x = [F.coalesce(F.col(columns[g]).cast("double"), F.lit(0.0)) for g in groups]
    y = F.coalesce(F.col(excess).cast("double"), F.lit(0.0))
    k = len(groups)
    row = rows.agg(F.count(excess).alias("n"), *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(x[i] * y).alias(f"y{i}") for i in range(k)]).first()
    if row["n"] < least:
        return None
    m = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float) + ridge * np.eye(k)
    beta = np.linalg.solve(m, np.array([row[f"y{i}"] for i in range(k)], float))
    return proposed_weights(dict(zip(groups, map(float, beta))), {g: current[g] for g in groups}, row["n"], least)


def proposed_weights(coefficients: dict[str, float], current: dict[str, float], n: int, least: int = 100) -> dict[str, float] | None:
    """Non-negative and normalised, halfway to the new ones; a column that would move by over 0.10 only a fifth of the way; then
    normalised again. None with fewer than 100 cases or without a positive coefficient."""
    pos = {k: max(0.0, coefficients.get(k, 0.0)) for k in current}
    total = sum(pos.values())
    if n < least or total <= 0:
        return None
    out = {}
    for k, old in current.items():
        new = pos[k] / total
        half = 0.5 * old + 0.5 * new
        out[k] = half if abs(half - old) <= 0.10 else 0.8 * old + 0.2 * new
    s = sum(out.values()) or 1.0
    return {k: v / s for k, v in out.items()}
