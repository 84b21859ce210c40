"""Queries of macro and currency series, regimes and forecasts: order values by week and priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.operators import macro as M
from plumbline.plans.adapter import DENSE, PRICES, SQL, dense, prices, query, r6, table
from plumbline.plans.daily import FX, fx
from plumbline.staging import stored
from plumbline.plans.learned import feature_drift
from plumbline.plans.market import _IC, _ics, sector_correlation


@query("fx_returns", f"WITH {PRICES}, {FX} SELECT ticker, session, round(close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY session), 0) - 1, 6) AS ret, round(fx, 6) AS fx FROM prices LEFT JOIN fx USING (session)")
def fx_returns(spark: SparkSession, sf: str) -> DataFrame:
    """The currency's return is of its own dates, then joined with the ticker's sessions."""
    p = M.returns_on_own_dates(prices(spark, sf), "session", "close", "ticker")
    x = M.returns_on_own_dates(fx(spark, sf), "session", "level").select("session", F.col("ret").alias("fx"))
    return p.join(F.broadcast(x), "session", "left").select("ticker", "session", r6("ret").alias("ret"), r6("fx").alias("fx"))


#: Priorities are series: the first has a value each day with an order, the others on some.
_SERIES = "SELECT o_orderdate::DATE AS d, avg(o_totalprice) / 1000 AS value FROM orders WHERE o_orderpriority = '{}' GROUP BY 1"
_NAMES = {"us10": "1-URGENT", "jp10": "2-HIGH", "us_cpi": "3-MEDIUM", "jp_cpi": "5-LOW"}
MACRO = "days AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), " + ", ".join(f"{n} AS ({_SERIES.format(p)})" for n, p in _NAMES.items())
_FILLED = "last_value({0}.value IGNORE NULLS) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS {0}"
ALIGNED = f"{MACRO}, al AS (SELECT d, {', '.join(_FILLED.format(n) for n in _NAMES)} FROM days {' '.join(f'LEFT JOIN {n} USING (d)' for n in _NAMES)})"


def series(spark: SparkSession, sf: str, name: str) -> DataFrame:
    o = table(spark, sf, "orders").filter(F.col("o_orderpriority") == _NAMES[name])
    return o.groupBy(F.to_date("o_orderdate").alias("d")).agg((F.avg("o_totalprice") / 1000).alias("value"))


def days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()


@query("aligned_series", f"WITH {ALIGNED} SELECT d, round(us10, 6) AS value FROM al")
def aligned_series(spark: SparkSession, sf: str) -> DataFrame:
    return M.aligned(days(spark, sf), series(spark, sf, "us10"), "d", "value").select("d", r6("value").alias("value"))


@query("exogenous", f"""WITH {ALIGNED}, r AS (SELECT *, coalesce(us10 - jp10, us10) AS diff, 100 * (us_cpi / nullif(lag(us_cpi, 252) OVER (ORDER BY d), 0) - 1) AS us_yoy, 100 * (jp_cpi / nullif(lag(jp_cpi, 252) OVER (ORDER BY d), 0) - 1) AS jp_yoy FROM al)
  SELECT d, round(diff, 6) AS rate_diff_10y, round(coalesce(diff - lag(diff) OVER (ORDER BY d), 0), 6) AS d_rate_diff_10y, round((us10 - us_yoy) - (jp10 - jp_yoy), 5) AS real_rate_diff FROM r""")
def exogenous(spark: SparkSession, sf: str) -> DataFrame:
    x = M.exogenous(days(spark, sf), "d", *[series(spark, sf, n) for n in _NAMES])
    return x.select("d", r6("rate_diff_10y").alias("rate_diff_10y"), r6("d_rate_diff_10y").alias("d_rate_diff_10y"), F.round("real_rate_diff", 5).alias("real_rate_diff"))


@query("rate_differential", f"WITH {MACRO} SELECT d, round(coalesce(u.value - j.value, u.value), 6) AS spread, round(c.value, 6) AS fx FROM us10 u JOIN us_cpi c USING (d) LEFT JOIN jp10 j USING (d)")
def rate_differential(spark: SparkSession, sf: str) -> DataFrame:
    """On dates that both the first rate and the currency have."""
    named = lambda n, c: series(spark, sf, n).withColumnRenamed("value", c)
    x = named("us10", "u").join(named("us_cpi", "fx"), "d").join(named("jp10", "j"), "d", "left")
    return x.select("d", r6(M.spread(F.col("u"), F.col("j"))).alias("spread"), r6("fx").alias("fx"))


@query("common_dates", f"WITH {MACRO} SELECT d FROM us10 INTERSECT SELECT d FROM jp10 INTERSECT SELECT d FROM us_cpi")
def common_dates(spark: SparkSession, sf: str) -> DataFrame:
    us, jp, cpi = (series(spark, sf, n).select("d") for n in ("us10", "jp10", "us_cpi"))
    return us.intersect(jp).intersect(cpi)


@query("series_side_by_side", f"WITH {MACRO} SELECT d, round(u.value, 6) AS us10, round(j.value, 6) AS jp10, round(c.value, 6) AS us_cpi FROM us10 u FULL JOIN jp10 j USING (d) FULL JOIN us_cpi c USING (d)")
def series_side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    parts = [series(spark, sf, n).select("d", r6("value").alias(n)) for n in ("us10", "jp10", "us_cpi")]
    return parts[0].join(parts[1], "d", "full_outer").join(parts[2], "d", "full_outer")


_LEVEL = f"WITH {DENSE}, lv AS (SELECT session, avg(close) AS level FROM panel GROUP BY 1)"


def level(spark: SparkSession, sf: str) -> DataFrame:
    return dense(spark, sf).groupBy("session").agg(F.avg("close").alias("level"))


@query("volatility_regime", _LEVEL + """, r AS (SELECT session, level / nullif(lag(level) OVER (ORDER BY session), 0) - 1 AS r FROM lv WHERE level IS NOT NULL), v AS (SELECT session, CASE WHEN count(r) OVER w >= 20 THEN stddev_samp(r) OVER w * sqrt(252) END AS vol FROM r WINDOW w AS (ORDER BY session ROWS 19 PRECEDING)),
  h AS (SELECT * FROM v WHERE vol IS NOT NULL ORDER BY session DESC LIMIT 1260), c AS (SELECT vol FROM h ORDER BY session DESC LIMIT 1), p AS (SELECT (SELECT vol FROM c) AS vol, avg((vol <= (SELECT vol FROM c))::INT) AS percentile FROM h)
  SELECT round(vol, 6) AS vol, round(percentile, 6) AS percentile, CASE WHEN percentile >= 0.8 THEN 'high' WHEN percentile >= 0.6 THEN 'elevated' WHEN percentile IS NOT NULL THEN 'normal' ELSE 'unknown' END AS level FROM p""")
def volatility_regime(spark: SparkSession, sf: str) -> DataFrame:
    return M.volatility_regime(level(spark, sf), "session", "level").select(r6("vol").alias("vol"), r6("percentile").alias("percentile"), "level")


@query("realized_volatility", _LEVEL + ", r AS (SELECT session, level / nullif(lag(level) OVER (ORDER BY session), 0) - 1 AS r FROM lv) SELECT session, CASE WHEN count(r) OVER w >= 20 THEN round(stddev_samp(r) OVER w * sqrt(252), 6) END AS vol FROM r WINDOW w AS (ORDER BY session ROWS 19 PRECEDING)")
def realized_volatility(spark: SparkSession, sf: str) -> DataFrame:
    r, vol = M.realized_volatility("level", "session")
    return level(spark, sf).withColumn("r", r).select("session", r6(vol).alias("vol"))


@query("model_degradation", _IC + """, k AS (SELECT ic, row_number() OVER (ORDER BY session DESC) AS k FROM ics WHERE ic IS NOT NULL), y AS (SELECT * FROM k WHERE k <= 252), m AS (SELECT count(*) AS n, avg(ic) FILTER (k <= 20) AS ic_recent FROM y), p AS (SELECT n, ic_recent, (SELECT avg((ic <= ic_recent)::INT) FROM y) AS percentile FROM m)
  SELECT CASE WHEN n >= 20 THEN round(ic_recent, 6) END AS ic_recent, CASE WHEN n >= 20 THEN round(percentile, 6) END AS percentile, coalesce(n >= 20 AND percentile <= 0.1, false) AS degraded FROM p""")
def model_degradation(spark: SparkSession, sf: str) -> DataFrame:
    return M.degradation(_ics(spark, sf), "session").select(r6("ic_recent").alias("ic_recent"), r6("percentile").alias("percentile"), "degraded")


@query("regime_snapshot", f"""SELECT v.vol, v.percentile AS vol_percentile, v.level AS vol_level, v.level = 'high' AS high_vol, c.mean_correlation, CASE WHEN c.mean_correlation >= 0.5 THEN 'high' WHEN c.mean_correlation <= 0.25 THEN 'low' WHEN c.mean_correlation IS NOT NULL THEN 'normal' END AS correlation_level,
    m.ic_recent, m.percentile AS ic_percentile, m.degraded, d.n_drifted, d.n_drifted >= 3 AS retrain
  FROM ({SQL['volatility_regime']}) v, ({SQL['sector_correlation']}) c, ({SQL['model_degradation']}) m, (SELECT count(*) FILTER (drifted) AS n_drifted FROM ({SQL['feature_drift']})) d""")
def regime_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Volatility, correlation, degradation and drift side by side: one row."""
    drift = feature_drift(spark, sf).agg(F.count_if("drifted").alias("n_drifted"))
    return M.regime_snapshot(volatility_regime(spark, sf).withColumn("high_vol", F.col("level") == "high"), sector_correlation(spark, sf), model_degradation(spark, sf), drift)


def _rolling(spark: SparkSession, sf: str) -> DataFrame:
    s = level(spark, sf)
    x = M.aligned(s, fx(spark, sf).withColumnRenamed("level", "x"), "session", "x").withColumn("dx", M.difference("x", "session"))
    return M.rolling_forecasts(x, "session", "level", "dx", 5)


_SUMS = ", ".join(f"sum({p} * {q}) FILTER (l IS NOT NULL) OVER w AS s{i}{j}" for i, p in enumerate(("1.0::DOUBLE", "l", "x", "dd")) for j, q in enumerate(("1.0::DOUBLE", "l", "x", "dd")) if i <= j)
_DET = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"


def _solved(k: int) -> str:
    """Cramer's rule for the regression of dd on 1, l and x."""
    m, v = ["s00", "s01", "s02", "s01", "s11", "s12", "s02", "s12", "s22"], ["s03", "s13", "s23"]
    return f"{_DET.format(*[v[i // 3] if i % 3 == k else c for i, c in enumerate(m)])} / {_DET.format(*m)}"


_STEPS = ["d1 AS (SELECT *, c + k * x + phi * dd AS m1 FROM b)"] + [f"d{h} AS (SELECT *, c + k * x + phi * m{h - 1} AS m{h} FROM d{h - 1})" for h in range(2, 6)]
#: The same in SQL: level, its logarithm's difference dd, the one before l, and the held difference x of the currency.
FX_LEVEL = "SELECT date_trunc('week', o_orderdate)::DATE AS session, avg(o_totalprice) AS level FROM orders GROUP BY 1"
ROLLING = _LEVEL + f""", al AS (SELECT session, level, last_value(f.fxl IGNORE NULLS) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING) AS xl FROM lv LEFT JOIN (SELECT session, level AS fxl FROM ({FX_LEVEL})) f USING (session)),
  dx AS (SELECT session, level, coalesce(xl - lag(xl) OVER (ORDER BY session), 0) AS dx FROM al), y AS (SELECT session, level, ln(level) AS y, coalesce(last_value(dx IGNORE NULLS) OVER (ORDER BY session ROWS UNBOUNDED PRECEDING), 0) AS x, row_number() OVER (ORDER BY session) AS n, count(*) OVER () AS cnt, lead(level, 5) OVER (ORDER BY session) AS actual FROM dx WHERE level IS NOT NULL),
  dd AS (SELECT *, y - lag(y) OVER (ORDER BY n) AS dd FROM y), l AS (SELECT *, lag(dd) OVER (ORDER BY n) AS l FROM dd), s AS (SELECT *, {_SUMS} FROM l WINDOW w AS (ORDER BY n ROWS UNBOUNDED PRECEDING)),
  b AS (SELECT *, {_solved(0)} AS c, {_solved(1)} AS phi, {_solved(2)} AS k FROM s WHERE n >= 60 AND n > cnt - 65 AND actual IS NOT NULL), {", ".join(_STEPS)},
  rolled AS (SELECT session::VARCHAR AS origin, actual, level AS walk, exp(y + m1 + m2 + m3 + m4 + m5) AS model FROM d5)"""


@query("rolling_forecasts", ROLLING + " SELECT origin, round(actual, 6) AS actual, round(walk, 6) AS walk, round(model, 5) AS model FROM rolled")
def rolling_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """The origins, what came, the random walk and the model."""
    return _rolling(spark, sf).select("origin", r6("actual").alias("actual"), r6("walk").alias("walk"), F.round("model", 5).alias("model"))


@query("forecast_comparison", ROLLING + " SELECT round(avg(pow(actual - model, 2)), 5) AS mse_model, round(avg(pow(actual - walk, 2)), 5) AS mse_walk, round(avg(CASE WHEN sign(actual - walk) = 0 THEN 0.5 ELSE (sign(actual - walk) = sign(model - walk))::INT END), 6) AS accuracy, count(*) AS n FROM rolled")
def forecast_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Both models' squared errors, and how often the model has the side."""
    x = stored(_rolling(spark, sf), "forecasts")
    sides = M.directional_accuracy(x)
    mse = x.agg(F.round(F.avg(F.pow(F.col("actual") - F.col("model"), 2)), 5).alias("mse_model"), F.round(F.avg(F.pow(F.col("actual") - F.col("walk"), 2)), 5).alias("mse_walk"))
    return mse.crossJoin(sides.withColumn("accuracy", r6("accuracy")))  # a row each


@query("latest_observations", f"WITH {MACRO}, f AS (SELECT 'us10' AS series, d, value FROM us10 UNION ALL SELECT 'jp10', d, value FROM jp10) SELECT series, d, round(value, 6) AS value FROM f QUALIFY row_number() OVER (PARTITION BY series ORDER BY d DESC) <= 5")
def latest_observations(spark: SparkSession, sf: str) -> DataFrame:
    x = series(spark, sf, "us10").withColumn("series", F.lit("us10")).unionByName(series(spark, sf, "jp10").withColumn("series", F.lit("jp10")))
    w = Window.partitionBy("series").orderBy(F.col("d").desc())
    return x.withColumn("n", F.row_number().over(w)).filter("n <= 5").select("series", "d", r6("value").alias("value"))
