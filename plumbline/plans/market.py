"""Queries on prices, filings and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.functions.expressions import bias_corrected_kurtosis, bias_corrected_skewness, ratio
from plumbline.operators import backtest as B, calendar as C, outcomes as O, panel as P, pit, scoring as S
from plumbline.plans.adapter import DENSE, FILINGS, PRICES, SECTORS, dense, filings, prices, query, r6, sectors, table
from plumbline.staging import stored

AS_OF = "1999-06-30"
#: Sessions that the scores' features look back at most.
LOOKBACK = 60
Z_COLS = ("ret_4w", "mom_26_4", "vol_13w", "adv_4w")
GROUPS = {"momentum": {"ret_4w": 1.0, "mom_26_4": 1.0}, "lowvol": {"vol_13w": -1.0}, "liquidity": {"adv_4w": 1.0}}
WEIGHTS = {"momentum": 0.5, "lowvol": 0.3, "liquidity": 0.2}


def features(panel: DataFrame) -> DataFrame:
    p = panel.withColumn("lr", P.log_return("close"))
    return P.trailing(
        p,
        {
            "ret_1w": P.simple_return("close"),
            "ret_4w": P.simple_return("close", 4),
            "mom_26_4": P.momentum("close", 4, 26),
            "vol_13w": P.rolling(F.stddev_samp, "lr", 13, 3) * 52**0.5,
            "high_52w": ratio(F.col("close"), P.rolling(F.max, "close", 52, 10)),
            "ma_dist_40w": ratio(F.col("close"), P.rolling(F.avg, "close", 40, 10)) - 1,
            "adv_4w": P.rolling(F.avg, "turnover", 4, 1),
            "history": P.history("close"),
        },
    )


FEATURES = (
    DENSE
    + """, lr AS (SELECT *, ln(CASE WHEN close > 0 THEN close END) - ln(CASE WHEN lag(close) OVER w > 0 THEN lag(close) OVER w END) AS lr,
      close / nullif(lag(close) OVER w, 0) - 1 AS ret_1w, close / nullif(lag(close, 4) OVER w, 0) - 1 AS ret_4w,
      lag(close, 4) OVER w / nullif(lag(close, 26) OVER w, 0) - 1 AS mom_26_4,
      CASE WHEN count(close) OVER h >= 10 THEN close / max(close) OVER h END AS high_52w,
      CASE WHEN count(close) OVER m >= 10 THEN close / avg(close) OVER m - 1 END AS ma_dist_40w,
      avg(turnover) OVER a AS adv_4w, count(close) OVER (w ROWS UNBOUNDED PRECEDING) AS history
    FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY session_idx), h AS (PARTITION BY ticker ORDER BY session_idx ROWS 51 PRECEDING),
      m AS (PARTITION BY ticker ORDER BY session_idx ROWS 39 PRECEDING), a AS (PARTITION BY ticker ORDER BY session_idx ROWS 3 PRECEDING)),
  features AS (SELECT *, CASE WHEN count(lr) OVER v >= 3 THEN stddev_samp(lr) OVER v * sqrt(52) END AS vol_13w
    FROM lr WINDOW v AS (PARTITION BY ticker ORDER BY session_idx ROWS 12 PRECEDING))"""
)
COLS = ("ret_1w", "ret_4w", "mom_26_4", "vol_13w", "high_52w", "ma_dist_40w", "adv_4w")


@query("price_features", f"WITH {FEATURES} SELECT ticker, session, history, {', '.join(f'round({c}, 6) AS {c}' for c in COLS)} FROM features")
def price_features(spark: SparkSession, sf: str) -> DataFrame:
    return features(dense(spark, sf)).select("ticker", "session", "history", *[r6(c).alias(c) for c in COLS])


def scored(spark: SparkSession, sf: str, as_of: str = AS_OF) -> DataFrame:
    """All scores of the last session known at ``as_of``; the point-in-time filter stands below every window."""
    known = pit.visible(prices(spark, sf, until=as_of), "session", as_of)
    panel = P.dense(known).withColumn("final", F.max("session_idx").over(Window.partitionBy("ticker")))
    f = features(panel.filter(F.col("session_idx") > F.col("final") - LOOKBACK)).filter("session_idx = final")
    f = f.join(sectors(spark, sf), "ticker", "left").withColumn("as_of", F.lit(as_of).cast("date"))
    f = S.winsorize(f, Z_COLS, ["as_of"])
    f = S.sector_neutral_z(f, Z_COLS, ["as_of"], "sector")
    return S.composite(S.group_scores(f, GROUPS, ["as_of"]), WEIGHTS, ["as_of"], least=2)


def _z(cols: tuple[str, ...], src: str, out: str, sector: bool) -> str:
    """SQL for robust z (and sector-neutral z) of ``cols``."""
    m = ", ".join(f"median({c}) OVER () AS m_{c}, stddev_pop({c}) OVER () AS s_{c}" + (f", median({c}) OVER (PARTITION BY sector) AS sm_{c}, count({c}) OVER (PARTITION BY sector) AS n_{c}" if sector else "") for c in cols)
    d = ", ".join(f"median(abs({c} - m_{c})) OVER () * 1.4826 AS d_{c}" + (f", median(abs({c} - sm_{c})) OVER (PARTITION BY sector) * 1.4826 AS sd_{c}" if sector else "") for c in cols)

    def z(c: str) -> str:
        market = f"CASE WHEN {c} IS NOT NULL THEN greatest(-3, least(3, ({c} - m_{c}) / CASE WHEN d_{c} > 0 THEN d_{c} WHEN s_{c} > 0 THEN s_{c} END)) END"
        if not sector:
            return f"{market} AS {c}_z"
        return f"CASE WHEN sector IS NOT NULL AND n_{c} >= 8 THEN CASE WHEN {c} IS NULL THEN NULL WHEN sd_{c} > 0 THEN greatest(-3, least(3, ({c} - sm_{c}) / sd_{c})) ELSE sign({c} - sm_{c}) * 3 END ELSE {market} END AS {c}_z"

    return f"{out}_m AS (SELECT *, {m} FROM {src}), {out}_d AS (SELECT *, {d} FROM {out}_m), {out} AS (SELECT *, {', '.join(map(z, cols))} FROM {out}_d)"


def _mean(parts: dict[str, float], least: int) -> str:
    n = " + ".join(f"({c} IS NOT NULL)::INT" for c in parts)
    top = " + ".join(f"coalesce({c} * {w}, 0)" for c, w in parts.items())
    w = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {abs(x)} ELSE 0 END" for c, x in parts.items())
    return f"CASE WHEN {n} >= {least} THEN ({top})::DOUBLE / nullif({w}, 0)::DOUBLE END"


_VISIBLE = FEATURES.replace("FROM lineitem)", f"FROM lineitem WHERE date_trunc('week', l_shipdate)::DATE <= DATE '{AS_OF}')", 1)
SCORED = (
    f"{_VISIBLE}, {SECTORS}, final AS (SELECT f.*, sector FROM features f LEFT JOIN sectors USING (ticker) WHERE session_idx = (SELECT max(session_idx) FROM features)), "
    + "win AS (SELECT * EXCLUDE (" + ", ".join(Z_COLS) + "), " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, quantile_cont({c}, 0.01) OVER ()), quantile_cont({c}, 0.99) OVER ()) END AS {c}" for c in Z_COLS) + " FROM final), "
    + _z(Z_COLS, "win", "zs", True)
    + ", groups AS (SELECT *, " + ", ".join(f"{_mean({f'{c}_z': w for c, w in m.items()}, max(1, -(-len(m) // 2)))} AS {g}" for g, m in GROUPS.items()) + " FROM zs), "
    + _z(tuple(GROUPS), "groups", "gz", False)
    + f", comp AS (SELECT *, {_mean({f'{g}_z': w for g, w in WEIGHTS.items()}, 2)} AS q FROM gz), "
    + """scored AS (SELECT *, 50 + 50 * CASE WHEN q IS NOT NULL THEN greatest(-1, least(1, q / 2.5)) END AS quant_score,
      CASE WHEN q IS NOT NULL THEN rank() OVER (ORDER BY q DESC NULLS LAST) END AS quant_rank,
      CASE WHEN q IS NOT NULL THEN (rank() OVER (ORDER BY q NULLS LAST) + (count(*) OVER (PARTITION BY q) - 1) / 2.0) / count(q) OVER () END AS quant_percentile FROM comp)"""
)


@query("factor_scores", f"WITH {SCORED} SELECT ticker, sector, {', '.join(f'round({c}_z, 6) AS {c}_z' for c in (*Z_COLS, *GROUPS))}, round(q, 6) AS quant_composite, round(quant_score, 6) AS quant_score, quant_rank, round(quant_percentile, 6) AS quant_percentile, ({' + '.join(f'({g}_z IS NOT NULL)::INT' for g in WEIGHTS)})::INT AS n_valid_groups FROM scored")
def factor_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("ticker", "sector", *[r6(f"{c}_z").alias(f"{c}_z") for c in (*Z_COLS, *GROUPS)], r6("quant_composite").alias("quant_composite"), r6("quant_score").alias("quant_score"), F.col("quant_rank").cast("long").alias("quant_rank"), r6("quant_percentile").alias("quant_percentile"), "n_valid_groups")


@query("daily_selection", f"""WITH {SCORED}, tier AS (SELECT *, CASE WHEN quant_percentile >= 0.85 AND mom_26_4 > 0 THEN 0 ELSE 1 END AS tier FROM scored WHERE q IS NOT NULL),
  capped AS (SELECT *, row_number() OVER (PARTITION BY coalesce(sector, '__UNKNOWN__') ORDER BY tier, quant_score DESC NULLS LAST, ticker) AS k FROM tier)
  SELECT ticker, sector, CASE tier WHEN 0 THEN 'core' ELSE 'fill' END AS candidate_tier, round(quant_score, 6) AS quant_score, row_number() OVER (ORDER BY tier, quant_score DESC NULLS LAST, ticker) AS position
  FROM capped WHERE k <= 3 QUALIFY row_number() OVER (ORDER BY tier, quant_score DESC NULLS LAST, ticker) <= 10""")
def daily_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: features, neutral scores, and a two-tier selection with at most three names of a sector."""
    s = scored(spark, sf).filter("quant_composite IS NOT NULL").withColumn("tier", F.when((F.col("quant_percentile") >= 0.85) & (F.col("mom_26_4") > 0), 0).otherwise(1))
    top = S.capped_top(s, ["as_of"], "sector", [F.col("tier"), F.col("quant_score").desc_nulls_last(), F.col("ticker")])
    return top.select("ticker", "sector", F.when(F.col("tier") == 0, "core").otherwise("fill").alias("candidate_tier"), r6("quant_score").alias("quant_score"), F.col("position").cast("long").alias("position"))


@query("trailing_drawdown", f"""WITH {DENSE}, peaks AS (SELECT a.ticker, a.session_idx AS a_idx, b.session_idx, b.close, max(b.close) OVER (PARTITION BY a.ticker, a.session_idx ORDER BY b.session_idx ROWS UNBOUNDED PRECEDING) AS top
    FROM panel a JOIN panel b ON a.ticker = b.ticker AND b.session_idx BETWEEN a.session_idx - 25 AND a.session_idx)
  SELECT ticker, a_idx::BIGINT AS session_idx, round(min(close / nullif(top, 0) - 1), 6) AS drawdown FROM peaks GROUP BY ALL""")
def trailing_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    x = P.trailing_drawdown(dense(spark, sf), "close", 26)
    return x.select("ticker", F.col("session_idx").cast("long").alias("session_idx"), r6("drawdown").alias("drawdown"))


@query("market_beta", f"""WITH {DENSE}, rets AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close) - ln(lag(close) OVER w) END AS y FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY session_idx)),
  x AS (SELECT *, avg(y) OVER (PARTITION BY session_idx) AS x FROM rets), b AS (SELECT *, CASE WHEN y IS NOT NULL THEN x END AS xx FROM x)
  SELECT ticker, session, CASE WHEN count(xx) OVER v >= 26 THEN round(regr_slope(y, xx) OVER v, 6) END AS beta FROM b WINDOW v AS (PARTITION BY ticker ORDER BY session_idx ROWS 51 PRECEDING)""")
def market_beta(spark: SparkSession, sf: str) -> DataFrame:
    p = dense(spark, sf).withColumn("y", P.log_return("close"))
    mean = p.groupBy("session_idx").agg(F.avg("y").alias("x"))
    return p.join(mean, "session_idx").select("ticker", "session", r6(P.beta("y", "x", 52, 26)).alias("beta"))


@query("filings_as_of", f"""WITH {FILINGS} SELECT ticker, period, filed_at, version, round(revenue, 6) AS revenue FROM filings WHERE filed_at <= DATE '{AS_OF}'
  QUALIFY row_number() OVER (PARTITION BY ticker, period ORDER BY filed_at DESC, version DESC) = 1""")
def filings_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return pit.versions_as_of(filings(spark, sf), ["ticker", "period"], "filed_at", AS_OF, [F.col("version").desc()]).withColumn("revenue", r6("revenue"))


@query("ttm_growth", f"""WITH {FILINGS}, v AS (SELECT ticker, period, revenue FROM filings WHERE filed_at <= DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY ticker, period ORDER BY filed_at DESC, version DESC) = 1),
  n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS nth FROM v),
  t AS (SELECT ticker, CASE WHEN count(revenue) FILTER (nth <= 4) = 4 THEN sum(revenue) FILTER (nth <= 4) END AS ttm, max(period) AS last_period,
        CASE WHEN count(revenue) FILTER (nth BETWEEN 5 AND 8) = 4 THEN sum(revenue) FILTER (nth BETWEEN 5 AND 8) END AS before FROM n GROUP BY ticker)
  SELECT ticker, last_period, round(ttm, 4) AS ttm, CASE WHEN before > 0 THEN round(ttm / before - 1, 6) END AS growth FROM t""")
def ttm_growth(spark: SparkSession, sf: str) -> DataFrame:
    v = pit.versions_as_of(filings(spark, sf), ["ticker", "period"], "filed_at", AS_OF, [F.col("version").desc()])
    nth = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("period").desc()))
    v = v.withColumn("nth", nth)
    total = lambda a, b: F.when(F.count(F.when(F.col("nth").between(a, b), F.col("revenue"))) == 4, F.sum(F.when(F.col("nth").between(a, b), F.col("revenue"))))
    t = v.groupBy("ticker").agg(F.max("period").alias("last_period"), total(1, 4).alias("ttm"), total(5, 8).alias("before"))
    return t.select("ticker", "last_period", F.round("ttm", 4).alias("ttm"), F.when(F.col("before") > 0, r6(F.col("ttm") / F.col("before") - 1)).alias("growth"))


@query("guidance_revisions", f"""WITH {FILINGS}, l AS (SELECT *, lag(revenue) OVER (PARTITION BY ticker ORDER BY filed_at, version) AS prev FROM filings)
  SELECT ticker, filed_at, version, (CASE WHEN prev > 0 AND revenue / prev - 1 > 0.005 THEN 1 WHEN prev > 0 AND revenue / prev - 1 < -0.005 THEN -1 ELSE 0 END)::INT AS direction, round(revenue / nullif(abs(prev), 0) - prev / nullif(abs(prev), 0), 6) AS magnitude FROM l WHERE prev IS NOT NULL""")
def guidance_revisions(spark: SparkSession, sf: str) -> DataFrame:
    f = filings(spark, sf).withColumn("prev", F.lag("revenue").over(Window.partitionBy("ticker").orderBy("filed_at", "version"))).filter("prev IS NOT NULL")
    move = F.when(F.col("prev") > 0, F.col("revenue") / F.col("prev") - 1)
    return f.select("ticker", "filed_at", "version", F.when(move > 0.005, 1).when(move < -0.005, -1).otherwise(0).alias("direction"), r6(ratio(F.col("revenue"), F.abs("prev")) - ratio(F.col("prev"), F.abs("prev"))).alias("magnitude"))


@query("latest_vintages", f"""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS observation_date, o_orderpriority AS series_id, o_orderdate::DATE AS vintage_date, o_orderkey, o_totalprice AS v FROM orders WHERE o_orderdate::DATE <= DATE '{AS_OF}'),
  l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY series_id, observation_date ORDER BY vintage_date DESC, o_orderkey DESC) = 1)
  SELECT series_id, observation_date, vintage_date, round(v, 6) AS value FROM l QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY observation_date DESC) <= 12""")
def latest_vintages(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.date_trunc("month", "o_orderdate").cast("date").alias("observation_date"), F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("vintage_date"), "o_orderkey", r6("o_totalprice").alias("value"))
    v = pit.versions_as_of(o, ["series_id", "observation_date"], "vintage_date", AS_OF, [F.col("o_orderkey").desc()])
    return pit.latest(v, ["series_id"], [F.col("observation_date").desc()], 12).drop("o_orderkey")


@query("securities_as_of", f"""SELECT s_suppkey AS ticker, valid_from, valid_to FROM (SELECT s_suppkey, DATE '1995-01-01' + (s_suppkey % 2000)::INT AS valid_from, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1995-01-01' + (s_suppkey % 2000 + 1500)::INT END AS valid_to FROM supplier)
  WHERE valid_from <= DATE '{AS_OF}' AND (valid_to IS NULL OR valid_to > DATE '{AS_OF}')""")
def securities_as_of(spark: SparkSession, sf: str) -> DataFrame:
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") % 2000).cast("int"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ticker"), start.alias("valid_from"), F.when(F.col("s_suppkey") % 3 == 0, F.date_add(start, 1500)).alias("valid_to"))
    return pit.valid_at(s, AS_OF)


@query("asof_price_of_order", f"""WITH {PRICES}, o AS (SELECT o_orderkey, (o_custkey % 100 + 1) AS ticker, o_orderdate::DATE AS session FROM orders)
  SELECT o.o_orderkey, o.ticker, o.session, round(p.close, 3) AS close FROM o ASOF LEFT JOIN prices p ON o.ticker = p.ticker AND o.session >= p.session""")
def asof_price_of_order(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 100 + 1).alias("ticker"), F.to_date("o_orderdate").alias("session"))
    return pit.asof_join_sliced(o, prices(spark, sf), ["ticker"], "session", ["close"]).withColumn("close", F.round("close", 3))


@query("forward_labels", f"""WITH {DENSE}, {SECTORS}, l AS (SELECT ticker, session, CASE WHEN lead(open, 1) OVER w > 0 THEN lead(open, 5) OVER w / lead(open, 1) OVER w - 1 END AS label FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY session_idx))
  SELECT ticker, session, round(label, 6) AS label, round(label - CASE WHEN sector IS NOT NULL THEN median(label) OVER (PARTITION BY session, sector) ELSE median(label) OVER (PARTITION BY session) END, 6) AS excess FROM l LEFT JOIN sectors USING (ticker) WHERE label IS NOT NULL""")
def forward_labels(spark: SparkSession, sf: str) -> DataFrame:
    l = O.forward_returns(dense(spark, sf), 4).filter("label IS NOT NULL").join(sectors(spark, sf), "ticker", "left")
    return l.select("ticker", "session", r6("label").alias("label"), r6(S.excess(l, "label", ["session"], "sector")).alias("excess"))


_IC = f"""WITH {FEATURES}, l AS (SELECT session, ret_4w AS a, CASE WHEN lead(open, 1) OVER w > 0 THEN lead(open, 5) OVER w / lead(open, 1) OVER w - 1 END AS b FROM features WINDOW w AS (PARTITION BY ticker ORDER BY session_idx)),
  r AS (SELECT session, (rank() OVER (PARTITION BY session ORDER BY a) + (count(*) OVER (PARTITION BY session, a) - 1) / 2.0) AS ra, (rank() OVER (PARTITION BY session ORDER BY b) + (count(*) OVER (PARTITION BY session, b) - 1) / 2.0) AS rb FROM l WHERE a IS NOT NULL AND b IS NOT NULL),
  ics AS (SELECT session, count(*) AS n, corr(ra, rb) AS ic FROM r GROUP BY session HAVING count(*) >= 3)"""


def _ics(spark: SparkSession, sf: str) -> DataFrame:
    return S.rank_correlation(O.forward_returns(features(dense(spark, sf)), 4), "ret_4w", "label", ["session"])


@query("rank_ic", _IC + " SELECT session, n, round(ic, 6) AS ic FROM ics")
def rank_ic(spark: SparkSession, sf: str) -> DataFrame:
    return _ics(spark, sf).withColumn("ic", r6("ic"))


@query("rank_ic_summary", _IC + " SELECT count(ic) AS n_dates, round(avg(ic), 6) AS ic_mean, round(avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0), 6) AS ic_t, round(avg((ic > 1e-9)::INT), 6) AS ic_positive FROM ics")
def rank_ic_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = S.rank_correlation_summary(_ics(spark, sf))
    return s.select("n_dates", *[r6(c).alias(c) for c in ("ic_mean", "ic_t", "ic_positive")])


@query("walk_forward_splits", f"""WITH {DENSE}, n AS (SELECT *, count(*) OVER () AS n FROM cal), s AS (SELECT *, n - (back + 1) * 20 AS start FROM n, (SELECT unnest(range(4)) AS back)),
  r AS (SELECT 3 - back AS split_id, session, CASE WHEN session_idx >= start AND session_idx < start + 20 THEN 'test' WHEN session_idx < start - 9 THEN 'train' END AS role FROM s WHERE start - 9 >= 60)
  SELECT split_id::INT AS split_id, min(session) FILTER (role = 'train') AS train_start, max(session) FILTER (role = 'train') AS train_end, min(session) FILTER (role = 'test') AS test_start, max(session) FILTER (role = 'test') AS test_end,
         count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test FROM r GROUP BY split_id""")
def walk_forward_splits(spark: SparkSession, sf: str) -> DataFrame:
    return C.walk_forward(C.sessions(prices(spark, sf), "session"), n_splits=4, horizon=4, embargo=5, test=20, min_train=60)


@query("quintile_returns", f"""WITH {FEATURES}, l AS (SELECT session, ret_4w AS s, CASE WHEN lead(open, 1) OVER w > 0 THEN lead(open, 5) OVER w / lead(open, 1) OVER w - 1 END AS label FROM features WINDOW w AS (PARTITION BY ticker ORDER BY session_idx)),
  e AS (SELECT *, {', '.join(f'quantile_cont(s, {i / 5}) OVER (PARTITION BY session) AS e{i}' for i in range(6))} FROM l WHERE s IS NOT NULL AND label IS NOT NULL),
  b AS (SELECT *, len(list_filter(list_distinct([e1, e2, e3, e4]), lambda x: x < s AND x > e0 AND x < e5)) + 1 AS bin FROM e)
  SELECT bin::INT AS bin, count(*) AS n, round(avg(label), 6) AS mean_return FROM b GROUP BY bin""")
def quintile_returns(spark: SparkSession, sf: str) -> DataFrame:
    l = O.forward_returns(features(dense(spark, sf)), 4).filter("ret_4w IS NOT NULL AND label IS NOT NULL")
    return S.quantile_bins(l, "ret_4w", ["session"]).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("label")).alias("mean_return"))


def _signals(p: DataFrame) -> DataFrame:
    """Scores by session, made once."""
    return stored(features(P.dense(p)).filter("ret_4w IS NOT NULL").select("session", "ticker", F.col("ret_4w").alias("score")), "signals")


def _traded(p: DataFrame, cap: float = 0.3) -> DataFrame:
    """Positions are a few hundred rows a year: they are stored, and what follows reads them alone."""
    signals = _signals(p)
    target = stored(B.targets(signals, B.periods(signals, C.sessions(p, "session"), "month"), 10), "targets")
    days = target.select("as_of", "entry", "exit").distinct()
    return stored(B.position_returns(B.turnover_capped(target, cap).join(days, "as_of"), p), "positions")


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    return _traded(stored(prices(spark, sf), "bars"))


_POS = f"""WITH {FEATURES}, sig AS (SELECT session, ticker, ret_4w AS score FROM features WHERE ret_4w IS NOT NULL), d AS (SELECT min(session) AS as_of FROM sig GROUP BY date_trunc('month', session)),
  nx AS (SELECT session, lead(session) OVER (ORDER BY session) AS entry, max(session) OVER () AS final FROM cal), e AS (SELECT as_of, entry, final FROM d JOIN nx ON as_of = session WHERE entry IS NOT NULL),
  per AS (SELECT as_of, entry, coalesce(lead(entry) OVER (ORDER BY as_of), final) AS exit FROM e QUALIFY exit > entry),
  tgt AS (SELECT as_of, entry, exit, ticker FROM sig JOIN per ON session = as_of QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY score DESC, ticker) <= 10),
  pos AS (SELECT t.*, 1.0 / count(*) OVER (PARTITION BY as_of) AS target, CASE WHEN a.open > 0 THEN b.open / a.open - 1 END AS ret FROM tgt t LEFT JOIN prices a ON a.ticker = t.ticker AND a.session = entry LEFT JOIN prices b ON b.ticker = t.ticker AND b.session = exit)"""


#: Cost of trading everything, in basis points: so high that curves have drawdowns.
COST = 1500.0
# The fold over rebalances, in SQL: weights as lists of names and numbers, carried from day to day.
CURVE = _POS.replace("WITH ", "WITH RECURSIVE ", 1) + """, dn AS (SELECT as_of, row_number() OVER (ORDER BY as_of) AS i FROM (SELECT DISTINCT as_of FROM tgt)), tg AS (SELECT i, ticker, target::DOUBLE AS target FROM pos JOIN dn USING (as_of)),
  wants AS (SELECT i, map_from_entries(list({'k': ticker, 'v': target})) AS want FROM tg GROUP BY i),
  fold AS (SELECT 0::BIGINT AS i, MAP {}::MAP(BIGINT, DOUBLE) AS held, 0.0::DOUBLE AS turnover UNION ALL
    SELECT w.i, map_from_entries(list_filter(list_transform(list_distinct(list_concat(map_keys(held), map_keys(want))), lambda t: {'k': t, 'v': coalesce(held[t], 0) + least(1, coalesce(0.3::DOUBLE / nullif(moved, 0), 1)) * (coalesce(want[t], 0) - coalesce(held[t], 0))}), lambda e: e.v > 1e-12)), moved * least(1, coalesce(0.3::DOUBLE / nullif(moved, 0), 1))
    FROM (SELECT w.i, f.held, w.want, list_sum(list_transform(list_distinct(list_concat(map_keys(f.held), map_keys(w.want))), lambda t: abs(coalesce(w.want[t], 0) - coalesce(f.held[t], 0)))) / 2 AS moved FROM fold f JOIN wants w ON w.i = f.i + 1) w),
  hw AS (SELECT i, turnover, unnest(map_keys(held)) AS ticker, unnest(map_values(held)) AS weight FROM fold WHERE i > 0),
  held AS (SELECT dn.as_of, entry, exit, ticker, weight, turnover FROM hw JOIN dn USING (i) JOIN per ON per.as_of = dn.as_of),
  hp AS (SELECT h.*, a.open AS entry_price, b.open AS exit_price, CASE WHEN a.open > 0 THEN b.open / a.open - 1 END AS ret FROM held h LEFT JOIN prices a ON a.ticker = h.ticker AND a.session = entry LEFT JOIN prices b ON b.ticker = h.ticker AND b.session = exit),
  dr AS (SELECT as_of, exit, sum(weight * coalesce(ret, 0)) AS gross, max(turnover) AS turnover, max(turnover) * 1500.0::DOUBLE / 1e4 AS cost FROM hp GROUP BY 1, 2), nt AS (SELECT *, gross - cost AS net FROM dr),
  curve AS (SELECT *, exp(sum(ln(1 + net)) OVER w) AS equity, exp(sum(ln(1 + gross)) OVER w) AS gross_equity FROM nt WINDOW w AS (ORDER BY as_of ROWS UNBOUNDED PRECEDING)),
  dd AS (SELECT *, equity / max(equity) OVER (ORDER BY as_of ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM curve)"""


@query("backtest_curve", CURVE + " SELECT as_of, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(cost, 8) AS cost, round(net, 6) AS net, round(equity, 5) AS equity, round(gross_equity, 5) AS gross_equity, round(drawdown, 5) AS drawdown FROM dd")
def backtest_curve(spark: SparkSession, sf: str) -> DataFrame:
    c = B.equity(_positions(spark, sf), COST)
    return c.select("as_of", *[F.round(x, n).alias(x) for x, n in (("gross", 6), ("turnover", 6), ("cost", 8), ("net", 6), ("equity", 5), ("gross_equity", 5), ("drawdown", 5))])


@query("backtest_trades", CURVE + " SELECT as_of, entry, exit, ticker, round(weight, 6) AS weight, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, round(ret, 6) AS ret, round(weight * ret, 6) AS contribution FROM hp WHERE ret IS NOT NULL")
def backtest_trades(spark: SparkSession, sf: str) -> DataFrame:
    t = B.trade_rows(_positions(spark, sf))
    return t.select("as_of", "entry", "exit", "ticker", *[r6(c).alias(c) for c in ("weight", "entry_price", "exit_price", "ret", "contribution")])


_STEADY = "CASE WHEN {1} = 0 THEN 0 ELSE {0} / {1} * sqrt(252) END"


@query("backtest_metrics", CURVE + f""", lv AS (SELECT session AS exit, avg(open) AS level FROM prices GROUP BY 1), bn AS (SELECT as_of, net, coalesce(level / lag(level) OVER (ORDER BY as_of) - 1, 0) AS bench FROM curve LEFT JOIN lv USING (exit)),
  m AS (SELECT count(*) AS n, arg_max(equity, as_of) AS e, arg_max(gross_equity, as_of) AS g, avg(net) AS mean, stddev_samp(net) AS std, stddev_samp(net) FILTER (net < 0) AS down, min(drawdown) AS max_drawdown, avg(turnover) AS mean_turnover, sum(cost) AS total_cost FROM dd),
  t AS (SELECT avg((ret > 0)::INT) AS hit_rate, sum(greatest(ret, 0)) / -sum(least(ret, 0)) AS profit_factor FROM hp WHERE ret IS NOT NULL), o AS (SELECT avg(net - bench) AS o, stddev_samp(net - bench) AS os FROM bn), f AS (SELECT *, pow(e, 252 / 1000.0::DOUBLE) - 1 AS cagr, pow(g, 252 / 1000.0::DOUBLE) - 1 AS gross_cagr FROM m, t, o)
  SELECT n, round(e - 1, 5) AS total_return, round(cagr, 5) AS cagr, round(gross_cagr, 5) AS gross_cagr, round(std * sqrt(252), 5) AS volatility, round({_STEADY.format('mean', 'std')}, 5) AS sharpe, round({_STEADY.format('mean', 'down')}, 5) AS sortino, round(max_drawdown, 5) AS max_drawdown,
    round(cagr / nullif(abs(max_drawdown), 0), 4) AS calmar, round(hit_rate, 5) AS hit_rate, round(profit_factor, 5) AS profit_factor, round(mean_turnover, 5) AS mean_turnover, round(total_cost, 6) AS total_cost, round(gross_cagr - cagr, 5) AS cost_drag, round(o * 252, 4) AS alpha, round({_STEADY.format('o', 'os')}, 5) AS information_ratio FROM f""")
def backtest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    p = stored(prices(spark, sf), "bars")
    pos = _traded(p)
    curve = stored(B.equity(pos, COST), "curve")
    levels = p.groupBy("session").agg(F.avg("open").alias("level"))
    m = B.metrics(curve, pos, 1000, B.benchmark_returns(curve, levels, pos))
    places = {"calmar": 4, "alpha": 4, "total_cost": 6}
    return m.select("n", *[F.round(c, places.get(c, 5)).alias(c) for c in m.columns if c != "n"])


@query("backtest_drawdown", CURVE + ", tr AS (SELECT as_of, drawdown FROM dd ORDER BY drawdown, as_of LIMIT 1), pk AS (SELECT c.as_of, c.equity FROM dd c, tr WHERE c.as_of <= tr.as_of ORDER BY equity DESC, c.as_of LIMIT 1) SELECT round(tr.drawdown, 5) AS max_drawdown, pk.as_of AS peak, tr.as_of AS trough, (SELECT min(as_of) FROM dd WHERE as_of >= tr.as_of AND equity >= pk.equity) AS recovered FROM tr, pk")
def backtest_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return B.deepest(B.equity(_positions(spark, sf), COST)).withColumn("max_drawdown", F.round("max_drawdown", 5))


@query("monthly_hit_rate", CURVE + ", mo AS (SELECT date_trunc('month', as_of)::DATE AS m, sum(net) AS net FROM nt GROUP BY 1) SELECT count(*) FILTER (net > 0) AS up, ((year(max(m)) - year(min(m))) * 12 + month(max(m)) - month(min(m)) + 1)::BIGINT AS months, round(count(*) FILTER (net > 0) / ((year(max(m)) - year(min(m))) * 12 + month(max(m)) - month(min(m)) + 1), 6) AS hit_rate FROM mo")
def monthly_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    return B.monthly_hit_rate(B.equity(_positions(spark, sf), COST)).withColumn("hit_rate", r6("hit_rate"))


@query("deflated_sharpe", CURVE + f", s AS (SELECT count(net) AS n, avg(net) / stddev_samp(net) * sqrt(252) AS sharpe, skewness(net) AS skew, kurtosis(net) + 3 AS kurt FROM nt) SELECT n, round(sharpe, 5) AS sharpe, round(skew, 5) AS skew, round(kurt, 5) AS kurtosis, round((sharpe - {B.expected_max_sharpe(10, 1.0)!r}) * sqrt(n - 1) / sqrt(greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, 1e-12)), 4) AS z FROM s")
def deflated_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    d = B.deflated(B.equity(_positions(spark, sf), COST), 10)
    return d.select("n", *[F.round(c, 5).alias(c) for c in ("sharpe", "skew", "kurtosis")], F.round("z", 4).alias("z"))


@query("position_returns", _POS + " SELECT as_of, entry, exit, ticker, round(target, 6) AS target, round(ret, 6) AS ret FROM pos")
def position_returns(spark: SparkSession, sf: str) -> DataFrame:
    p = stored(prices(spark, sf), "bars")
    signals = _signals(p)
    t = B.position_returns(B.targets(signals, B.periods(signals, C.sessions(p, "session"), "month"), 10), p)
    return t.select("as_of", "entry", "exit", "ticker", r6("target").alias("target"), r6("ret").alias("ret"))


@query("return_moments", f"WITH {FEATURES} SELECT ticker, count(lr) AS n, round(avg(lr), 6) AS mean, round(stddev_samp(lr), 6) AS std, CASE WHEN count(lr) > 2 THEN round(skewness(lr), 6) END AS skew, CASE WHEN count(lr) > 3 THEN round(kurtosis(lr), 6) END AS kurt FROM features GROUP BY ticker")
def return_moments(spark: SparkSession, sf: str) -> DataFrame:
    p = dense(spark, sf).withColumn("lr", P.log_return("close"))
    return p.groupBy("ticker").agg(F.count("lr").alias("n"), r6(F.avg("lr")).alias("mean"), r6(F.stddev_samp("lr")).alias("std"), r6(bias_corrected_skewness("lr")).alias("skew"), r6(bias_corrected_kurtosis("lr")).alias("kurt"))


@query("sector_correlation", f"""WITH {DENSE}, {SECTORS}, s AS (SELECT sector, session_idx, avg(close) AS c FROM panel JOIN sectors USING (ticker) GROUP BY ALL), r AS (SELECT *, c / nullif(lag(c) OVER (PARTITION BY sector ORDER BY session_idx), 0) - 1 AS r FROM s),
  k AS (SELECT * FROM r WHERE session_idx > (SELECT max(session_idx) FROM r) - 60), p AS (SELECT a.sector AS sa, b.sector AS sb, corr(a.r, b.r) AS c, count(*) AS n FROM k a JOIN k b ON a.session_idx = b.session_idx AND a.sector < b.sector WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL HAVING count(*) >= 20)
  SELECT count(*) AS pairs, round(avg(c), 6) AS mean_correlation, CASE WHEN avg(c) >= 0.5 THEN 'high' WHEN avg(c) <= 0.25 THEN 'low' ELSE 'normal' END AS regime FROM p""")
def sector_correlation(spark: SparkSession, sf: str) -> DataFrame:
    s = dense(spark, sf).join(sectors(spark, sf), "ticker").groupBy("sector", "session_idx").agg(F.avg("close").alias("c"))
    r = s.withColumn("r", ratio(F.col("c"), F.lag("c").over(Window.partitionBy("sector").orderBy("session_idx"))) - 1)
    r = r.withColumn("final", F.max("session_idx").over(Window.partitionBy("sector"))).filter("session_idx > final - 60 AND r IS NOT NULL").select("sector", "session_idx", "r")
    a, b = r.withColumnsRenamed({"sector": "sa", "r": "ra"}), r.withColumnsRenamed({"sector": "sb", "r": "rb"})
    p = a.join(b, "session_idx").filter("sa < sb").groupBy("sa", "sb").agg(F.corr("ra", "rb").alias("c"), F.count(F.lit(1)).alias("n")).filter("n >= 20")
    m = F.avg("c")
    return p.agg(F.count(F.lit(1)).alias("pairs"), r6(m).alias("mean_correlation"), F.when(m >= 0.5, "high").when(m <= 0.25, "low").otherwise("normal").alias("regime"))
