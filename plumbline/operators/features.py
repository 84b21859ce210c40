"""The price features of every ticker at the last session of a dense panel, by one window and one aggregation a ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.expressions import deepest_drawdown, positive_ratio, ratio
from plumbline.operators.panel import by_session, log_return, simple_return

YEAR = 252
#: Scale of the illiquidity measure.
AMIHUD = 1e9
#: Most features that may be missing.
MOST_MISSING = 15


def _moving(alpha: float, s: Column, x: Column) -> Column:
    """One step of an exponential mean; the past fades over nulls, too."""
    w = F.when(s["mean"].isNull(), s["w"]).otherwise(s["w"] * (1 - alpha))
    mean = F.when(x.isNull(), s["mean"]).when(s["mean"].isNull(), x).otherwise((w * s["mean"] + alpha * x) / (w + alpha))
    return F.struct(mean.alias("mean"), F.when(x.isNull(), w).otherwise(1.0).alias("w"), (s["n"] + x.isNotNull().cast("int")).alias("n"))


def technicals(rows: Column, columns: tuple[str, str, str] = ("x", "move", "range")) -> Column:
    """A struct of rsi_14, macd, macd_signal, macd_hist and atr_14 from ordered rows of close, its change and the true range,
    in one fold: Wilder means of 14, exponential ones of 12, 26 and 9 sessions, null before so many values."""
    close, move, true_range = columns
    empty = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(1.0).alias("w"), F.lit(0).alias("n"))
    names = ("fast", "slow", "signal", "up", "down", "range")
    start = F.struct(*[empty.alias(c) for c in names])

    def line(s: Column) -> Column:
        return F.when((s["fast"]["n"] >= 12) & (s["slow"]["n"] >= 26), s["fast"]["mean"] - s["slow"]["mean"])

    def step(s: Column, r: Column) -> Column:
        fast, slow = _moving(2 / 13, s["fast"], r[close]), _moving(2 / 27, s["slow"], r[close])
        m = r[move]
        now = F.when((fast["n"] >= 12) & (slow["n"] >= 26), fast["mean"] - slow["mean"])
        parts = (fast, slow, _moving(2 / 10, s["signal"], now), _moving(1 / 14, s["up"], F.when(m.isNotNull(), F.greatest(m, F.lit(0.0)))), _moving(1 / 14, s["down"], F.when(m.isNotNull(), F.greatest(0.0 - m, F.lit(0.0)))), _moving(1 / 14, s["range"], r[true_range]))
        return F.struct(*[p.alias(c) for p, c in zip(parts, names)])

    def finish(s: Column) -> Column:
        mean = lambda c, n: F.when(s[c]["n"] >= n, s[c]["mean"])
        up, down, signal = mean("up", 14), mean("down", 14), mean("signal", 9)
        rsi = F.when((down == 0) & (up > 0), 100.0).when(down > 0, 100 - 100 / (1 + up / down))
        return F.struct(rsi.alias("rsi_14"), line(s).alias("macd"), signal.alias("macd_signal"), (line(s) - signal).alias("macd_hist"), mean("range", 14).alias("atr_14"))

    return F.aggregate(rows, start, step, finish)


def features_at(panel: DataFrame, bench: DataFrame | None = None, fx: DataFrame | None = None, caps: DataFrame | None = None) -> DataFrame:
    """One row a ticker, at the last session of ``panel`` (dense; open, high, low, close, turnover): returns, momentum, distance
    from the high and the mean, volatilities, drawdown, beta, range, technicals, liquidity and currency slope.

    ``bench`` and ``fx``: session and their return, x and fx; ``caps``: ticker, market_cap. Lags count sessions of the panel,
    so a missing bar is a null. A feature is null where the ticker has fewer closes than it needs.
    """
    for side, c in ((bench, "x"), (fx, "fx")):
        panel = panel.join(F.broadcast(side.select("session", c)), "session", "left") if side is not None else panel.withColumn(c, F.lit(None).cast("double"))  # a row a session
    prev = F.lag("close").over(by_session())
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    back = F.max("session_idx").over(Window.partitionBy("ticker")) - F.col("session_idx")
    rows = panel.select("ticker", "session_idx", back.alias("k"), "x", "fx", F.col("close").cast("double").alias("close"), "turnover", simple_return("close").alias("r"), log_return("close").alias("lr"), (F.col("close") - prev).alias("move"), true_range.alias("range"))
    k = F.col("k")
    at = lambda n, c="close": F.max(F.when(k == n, F.col(c)))
    last = lambda n, x: F.when(k < n, x)
    have = F.count("close")
    since = lambda n, x: F.when(have >= n, x)
    col = F.col

    def volatility(n: int) -> Column:
        x = last(n, col("lr"))
        return since(n + 1, F.when(F.count(x) >= max(2, int(0.8 * n)), F.stddev_samp(x) * YEAR**0.5))

    def slope(y: str, x: str, n: int, least: int) -> Column:
        both = (k < n) & col(x).isNotNull() & col(y).isNotNull()
        a, b = F.when(both, col(x)), F.when(both, col(y))
        return F.when(F.count(a) >= least, ratio(F.covar_pop(b, a), F.var_pop(a)))

    close20 = last(20, col("close"))
    ordered = F.array_sort(F.collect_list(F.struct("session_idx", F.col("close").alias("x"), "move", "range")))
    year = F.array_sort(F.collect_list(F.when(k < YEAR, F.struct("session_idx", F.col("close").alias("x")))))["x"]
    band = F.stddev_samp(close20)
    out = rows.groupBy("ticker").agg(
        have.alias("history"),
        *[since(n + 1, ratio(at(0), at(n)) - 1).alias(f"ret_{n}d") for n in (1, 5, 20, 60, 252)],
        since(253, ratio(at(21), at(252)) - 1).alias("mom_12_1"),
        since(127, ratio(at(21), at(126)) - 1).alias("mom_6_1"),
        since(200, ratio(at(0), F.max(last(252, col("close"))))).alias("price_to_52w_high"),
        since(200, ratio(at(0), F.avg(last(200, col("close")))) - 1).alias("dist_from_ma200"),
        volatility(20).alias("realized_vol_20d"),
        volatility(60).alias("realized_vol_60d"),
        since(61, F.stddev_samp(last(60, F.when(col("lr").isNotNull(), F.least(col("lr"), F.lit(0.0))))) * YEAR**0.5).alias("downside_dev_60d"),
        since(200, deepest_drawdown(year)).alias("max_drawdown_252d"),
        since(200, slope("lr", "x", 252, 126)).alias("beta_market_252d"),
        slope("r", "fx", 60, 40).alias("fx_sensitivity_60d"),
        since(20, F.when(F.count(last(20, col("turnover"))) >= 10, F.avg(last(20, col("turnover"))))).alias("adv_20d"),
        since(20, F.avg(last(20, positive_ratio(F.abs("r"), col("turnover")))) * AMIHUD).alias("amihud_illiq"),
        since(20, ratio(at(0) - F.avg(close20) + 2 * band, 4 * band)).alias("bb_pct_b_20"),
        at(0, "turnover").alias("turnover"),
        technicals(ordered).alias("t"),
    )
    least = {"rsi_14": 15, "macd": 35, "macd_signal": 35, "macd_hist": 35, "atr_14": 15}
    out = out.withColumns({c: F.when(col("history") >= n, col("t")[c]) for c, n in least.items()}).drop("t")
    if caps is not None:
        out = out.join(caps.select("ticker", "market_cap"), "ticker", "left").withColumn("turnover_ratio", positive_ratio(col("turnover"), col("market_cap")))
    return out.drop("turnover")


def sector_relative(features: DataFrame, value: str, sector: str) -> Column:
    """Less the sector's median; null sectors are a group of their own."""
    return F.col(value) - F.median(value).over(Window.partitionBy(sector))


def missing(df: DataFrame, features: list[str]) -> Column:
    return sum((F.col(c).isNull().cast("int") for c in features[1:]), F.col(features[0]).isNull().cast("int"))


def complete_rows(df: DataFrame, features: list[str], most: int = MOST_MISSING) -> DataFrame:
    """Rows that lack at most so many features."""
    return df.filter(missing(df, features) <= most)
