"""Queries with the windows and least counts of daily features, over the sessions at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators import features as T, macro as M, panel as P
from plumbline.plans.adapter import DENSE, SECTORS, dense, query, r6, sectors, table

FX = "fx AS (SELECT session, level / nullif(lag(level) OVER (ORDER BY session), 0) - 1 AS fx FROM (SELECT date_trunc('week', o_orderdate)::DATE AS session, avg(o_totalprice) AS level FROM orders GROUP BY 1))"


def fx(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("session")).agg(F.avg("o_totalprice").alias("level"))


ROWS = f"""{DENSE}, {FX}, {SECTORS}, rets AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS r, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close) - ln(lag(close) OVER w) END AS lr, close - lag(close) OVER w AS move,
      greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY session_idx)),
  k AS (SELECT rets.*, fx, avg(lr) OVER (PARTITION BY session) AS x, (SELECT max(session_idx) FROM cal) - session_idx AS k FROM rets LEFT JOIN fx USING (session))"""


def _at(n: int) -> str:
    return f"max(close) FILTER (k = {n})"


def _since(n: int, e: str) -> str:
    return f"CASE WHEN count(close) >= {n} THEN {e} END"


def _vol(n: int) -> str:
    return _since(n + 1, f"CASE WHEN count(lr) FILTER (k < {n}) >= {int(0.8 * n)} THEN stddev_samp(lr) FILTER (k < {n}) * sqrt(252) END")


COLUMNS = {
    **{f"ret_{n}d": _since(n + 1, f"{_at(0)} / nullif({_at(n)}, 0) - 1") for n in (1, 5, 20, 60, 252)},
    "mom_12_1": _since(253, f"{_at(21)} / nullif({_at(252)}, 0) - 1"),
    "mom_6_1": _since(127, f"{_at(21)} / nullif({_at(126)}, 0) - 1"),
    "price_to_52w_high": _since(200, f"{_at(0)} / max(close) FILTER (k < 252)"),
    "dist_from_ma200": _since(200, f"{_at(0)} / avg(close) FILTER (k < 200) - 1"),
    "realized_vol_20d": _vol(20),
    "realized_vol_60d": _vol(60),
    "downside_dev_60d": _since(61, "stddev_samp(least(lr, 0)) FILTER (k < 60 AND lr IS NOT NULL) * sqrt(252)"),
    "beta_market_252d": _since(200, "CASE WHEN count(lr) FILTER (k < 252) >= 126 THEN regr_slope(lr, x) FILTER (k < 252) END"),
    "fx_sensitivity_60d": "CASE WHEN count(*) FILTER (k < 60 AND r IS NOT NULL AND fx IS NOT NULL) >= 40 THEN regr_slope(r, fx) FILTER (k < 60) END",
    "adv_20d": _since(20, "CASE WHEN count(turnover) FILTER (k < 20) >= 10 THEN avg(turnover) FILTER (k < 20) END"),
    "amihud_illiq": _since(20, "avg(abs(r) / turnover) FILTER (k < 20 AND turnover > 0) * 1e9"),
    "bb_pct_b_20": _since(20, f"({_at(0)} - avg(close) FILTER (k < 20) + 2 * stddev_samp(close) FILTER (k < 20)) / nullif(4 * stddev_samp(close) FILTER (k < 20), 0)"),
    "turnover_ratio": "max(turnover) FILTER (k = 0) / (1e6 + ticker * 1e4)",
}


def _panel_features(spark: SparkSession, sf: str) -> DataFrame:
    p = dense(spark, sf)
    bench = p.withColumn("lr", P.log_return("close")).groupBy("session").agg(F.avg("lr").alias("x"))
    caps = p.select("ticker").distinct().withColumn("market_cap", (1e6 + F.col("ticker") * 1e4).cast("double"))
    return T.features_at(p, bench, M.returns_on_own_dates(fx(spark, sf), "session", "level").select("session", F.col("ret").alias("fx")), caps)


@query("daily_features", f"WITH {ROWS} SELECT ticker, count(close) AS history, {', '.join(f'round({e}, 6) AS {c}' for c, e in COLUMNS.items())} FROM k GROUP BY ticker")
def daily_features(spark: SparkSession, sf: str) -> DataFrame:
    return _panel_features(spark, sf).select("ticker", "history", *[r6(c).alias(c) for c in COLUMNS])


@query("yearly_drawdown", f"""WITH {ROWS}, peaks AS (SELECT *, max(close) OVER (PARTITION BY ticker ORDER BY session_idx ROWS UNBOUNDED PRECEDING) AS top FROM k WHERE k < 252)
  SELECT ticker, CASE WHEN h >= 200 THEN round(min(close / nullif(top, 0) - 1), 6) END AS max_drawdown_252d FROM peaks JOIN (SELECT ticker, count(close) AS h FROM k GROUP BY 1) USING (ticker) GROUP BY ticker, h""")
def yearly_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return _panel_features(spark, sf).select("ticker", r6("max_drawdown_252d").alias("max_drawdown_252d"))


@query("sector_relative_return", f"""WITH {ROWS}, f AS (SELECT ticker, {COLUMNS['ret_20d']} AS ret_20d FROM k GROUP BY ticker) SELECT ticker, sector, round(ret_20d - median(ret_20d) OVER (PARTITION BY sector), 6) AS sector_relative_ret_20d FROM f LEFT JOIN sectors USING (ticker)""")
def sector_relative_return(spark: SparkSession, sf: str) -> DataFrame:
    f = _panel_features(spark, sf).join(sectors(spark, sf), "ticker", "left")
    return f.select("ticker", "sector", r6(T.sector_relative(f, "ret_20d", "sector")).alias("sector_relative_ret_20d"))


@query("complete_features", f"""WITH {ROWS}, f AS (SELECT ticker, {', '.join(f'{e} AS {c}' for c, e in COLUMNS.items())} FROM k GROUP BY ticker), m AS (SELECT ticker, ({' + '.join(f'({c} IS NULL)::INT' for c in COLUMNS)})::INT AS n_missing FROM f) SELECT ticker, n_missing FROM m WHERE n_missing <= 3""")
def complete_features(spark: SparkSession, sf: str) -> DataFrame:
    f = _panel_features(spark, sf)
    return T.complete_rows(f, list(COLUMNS), 3).select("ticker", T.missing(f, list(COLUMNS)).alias("n_missing"))


def _ema(c: str, x: str, alpha: str, old: str = "e") -> str:
    """The next mean, weight and count of a series, in SQL."""
    w = f"CASE WHEN {old}.{c}_m IS NULL THEN {old}.{c}_w ELSE {old}.{c}_w * (1 - {alpha}) END"
    m = f"CASE WHEN ({x}) IS NULL THEN {old}.{c}_m WHEN {old}.{c}_m IS NULL THEN ({x}) ELSE (({w}) * {old}.{c}_m + {alpha} * ({x})) / (({w}) + {alpha}) END"
    return f"{m} AS {c}_m, CASE WHEN ({x}) IS NULL THEN {w} ELSE 1 END AS {c}_w, {old}.{c}_n + (({x}) IS NOT NULL)::INT AS {c}_n"


def _fold(name: str, source: str, series: dict[str, tuple[str, str]]) -> str:
    first = ", ".join(f"({x})::DOUBLE AS {c}_m, 1.0::DOUBLE AS {c}_w, (({x}) IS NOT NULL)::INT AS {c}_n" for c, (x, _) in series.items())
    return f"""{name} AS (SELECT r.ticker, r.session_idx, {first} FROM {source} r WHERE r.session_idx = 0 UNION ALL
    SELECT r.ticker, r.session_idx, {', '.join(_ema(c, x, a) for c, (x, a) in series.items())} FROM {name} e JOIN {source} r ON r.ticker = e.ticker AND r.session_idx = e.session_idx + 1)"""


_SERIES = {"fast": ("r.close", "(2.0 / 13)::DOUBLE"), "slow": ("r.close", "(2.0 / 27)::DOUBLE"), "up": ("CASE WHEN r.move IS NOT NULL THEN greatest(r.move, 0) END", "(1.0 / 14)::DOUBLE"), "down": ("CASE WHEN r.move IS NOT NULL THEN greatest(-r.move, 0) END", "(1.0 / 14)::DOUBLE"), "tr": ("r.tr", "(1.0 / 14)::DOUBLE")}


@query("technicals", f"""WITH RECURSIVE {ROWS}, {_fold('ema', 'rets', _SERIES)},
  lines AS (SELECT ticker, session_idx, CASE WHEN fast_n >= 12 AND slow_n >= 26 THEN fast_m - slow_m END AS line FROM ema), {_fold('sig', 'lines', {'s': ('r.line', '(2.0 / 10)::DOUBLE')})},
  h AS (SELECT ticker, count(close) AS h FROM k GROUP BY 1), fin AS (SELECT *, CASE WHEN s_n >= 9 THEN s_m END AS signal FROM ema JOIN lines USING (ticker, session_idx) JOIN sig USING (ticker, session_idx) JOIN h USING (ticker) WHERE session_idx = (SELECT max(session_idx) FROM cal))
  SELECT ticker, CASE WHEN h >= 15 AND up_n >= 14 THEN round(CASE WHEN down_m = 0 AND up_m > 0 THEN 100 WHEN down_m > 0 THEN 100 - 100 / (1 + up_m / down_m) END, 6) END AS rsi_14, CASE WHEN h >= 35 THEN round(line, 6) END AS macd,
    CASE WHEN h >= 35 THEN round(signal, 6) END AS macd_signal, CASE WHEN h >= 35 THEN round(line - signal, 6) END AS macd_hist, CASE WHEN h >= 15 AND tr_n >= 14 THEN round(tr_m, 6) END AS atr_14 FROM fin""")
def technicals(spark: SparkSession, sf: str) -> DataFrame:
    names = ("rsi_14", "macd", "macd_signal", "macd_hist", "atr_14")
    return _panel_features(spark, sf).select("ticker", *[r6(c).alias(c) for c in names])
