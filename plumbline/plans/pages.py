"""Queries that put several reads together: what a page or a job asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.operators import calendar as C, models as M, readers as R, scoring as S
from plumbline.plans.adapter import prices, query, r6, table
from plumbline.plans.daily import COLUMNS, ROWS, _panel_features
from plumbline.plans.learned import _LABELS, _labelled, walk_sql
from plumbline.staging import stored

SHOWN = {"momentum": "ret_20d", "trend": "dist_from_ma200", "volatility": "realized_vol_60d", "liquidity": "adv_20d", "size": "turnover_ratio", "high": "price_to_52w_high", "range": "bb_pct_b_20"}


@query("shown_features", f"WITH {ROWS}, f AS (SELECT ticker, {', '.join(f'round({COLUMNS[c]}, 6) AS {g}' for g, c in SHOWN.items())} FROM k GROUP BY ticker) SELECT ticker, grp, value FROM f UNPIVOT INCLUDE NULLS (value FOR grp IN ({', '.join(SHOWN)}))")
def shown_features(spark: SparkSession, sf: str) -> DataFrame:
    """Seven features as rows of group and value."""
    f = _panel_features(spark, sf).select("ticker", *[r6(c).alias(g) for g, c in SHOWN.items()])
    return f.unpivot("ticker", list(SHOWN), "grp", "value")


@query("score_status", "SELECT DATE '2005-01-01' AS asked, max(o_orderdate)::DATE AS latest, max(o_orderdate)::DATE >= DATE '2005-01-01' AS computed FROM orders")
def score_status(spark: SparkSession, sf: str) -> DataFrame:
    """Whether scores of the asked day are there, and the last day that has some."""
    asked = F.lit("2005-01-01").cast("date")
    last = R.coverage(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")), "d")
    return last.select(asked.alias("asked"), "latest", (F.col("latest") >= asked).alias("computed"))


@query("spot_rates", """WITH runs AS (SELECT o_orderpriority AS pair, o_orderdate::DATE AS as_of, o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderpriority < '3'), macro AS (SELECT o_orderpriority AS pair, o_orderdate::DATE AS as_of, o_orderkey AS id, o_totalprice / 2 AS v FROM orders),
  r AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY pair ORDER BY as_of DESC, id DESC) = 1), m AS (SELECT * FROM macro QUALIFY row_number() OVER (PARTITION BY pair ORDER BY as_of DESC, id DESC) = 1)
  SELECT m.pair, round(coalesce(r.v, m.v), 4) AS spot, r.v IS NOT NULL AS forecast FROM m LEFT JOIN r USING (pair)""")
def spot_rates(spark: SparkSession, sf: str) -> DataFrame:
    """The latest forecast run of each pair, else its latest observation."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("pair"), F.to_date("o_orderdate").alias("as_of"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    runs = R.latest_rows(o.filter("pair < '3'"), ["pair"], ["as_of", "id"]).select("pair", F.col("v").alias("run"))
    seen = R.latest_rows(o, ["pair"], ["as_of", "id"]).select("pair", (F.col("v") / 2).alias("obs"))
    return seen.join(runs, "pair", "left").select("pair", F.round(F.coalesce("run", "obs"), 4).alias("spot"), F.col("run").isNotNull().alias("forecast"))


@query("retrain_ic", _LABELS + """, d AS (SELECT DISTINCT session FROM l WHERE ret_4w IS NOT NULL AND label IS NOT NULL ORDER BY session DESC LIMIT 80), x AS (SELECT session, ret_4w AS a, label AS b FROM l JOIN d USING (session) WHERE ret_4w IS NOT NULL AND label IS NOT NULL),
  r AS (SELECT session, rank() OVER (PARTITION BY session ORDER BY a) + (count(*) OVER (PARTITION BY session, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY session ORDER BY b) + (count(*) OVER (PARTITION BY session, b) - 1) / 2.0 AS rb FROM x), i AS (SELECT session, corr(ra, rb) AS ic FROM r GROUP BY 1 HAVING count(*) >= 3)
  SELECT count(ic) AS n_dates, round(avg(ic), 6) AS ic_mean FROM i""")
def retrain_ic(spark: SparkSession, sf: str) -> DataFrame:
    """The last 80 dates that have features and labels, and the mean daily rank correlation of a feature with the label."""
    x = _labelled(spark, sf).filter("ret_4w IS NOT NULL AND label IS NOT NULL")
    days = x.select("session").distinct().orderBy(F.col("session").desc()).limit(80)
    s = S.rank_correlation_summary(S.rank_correlation(x.join(F.broadcast(days), "session"), "ret_4w", "label", ["session"]))
    return s.select("n_dates", r6("ic_mean").alias("ic_mean"))


@query("retrain_run", walk_sql(("ret_4w", "vol_13w"), 20, 5, 10, 20) + ", fo AS (SELECT split_id, avg(ic) AS ic FROM ics GROUP BY 1) SELECT split_id, round(ic, 6) AS ic, count(*) OVER () AS n_folds, round(avg(ic) OVER (), 6) AS rank_ic FROM fo")
def retrain_run(spark: SparkSession, sf: str) -> DataFrame:
    """Folds of the purged walk, their mean rank correlations, and the mean of all."""
    splits = C.purged_splits(C.sessions(prices(spark, sf), "session"), n_splits=4, horizon=20, embargo=5, test=10, min_train=20)
    ics = M.walk_forward_ic(_labelled(spark, sf), splits, ["ret_4w", "vol_13w"], "label")
    folds = ics.groupBy("split_id").agg(F.avg("ic").alias("ic"))
    folds = stored(folds, "folds")  # a row a split
    run = folds.agg(F.count(F.lit(1)).alias("n_folds"), r6(F.avg("ic")).alias("rank_ic"))
    return folds.withColumn("ic", r6("ic")).crossJoin(run)


@query("weekly_review", """SELECT date_trunc('week', o_orderdate)::DATE AS week, o_orderpriority AS conviction, count(*) AS n, round(avg((o_totalprice > 150000)::INT), 6) AS hit_rate, round(avg(o_totalprice) / 1000, 1) AS mean_excess FROM orders GROUP BY 1, 2""")
def weekly_review(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("week"), F.col("o_orderpriority").alias("conviction")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("o_totalprice") > 150000).cast("int"))).alias("hit_rate"), F.round(F.avg("o_totalprice") / 1000, 1).alias("mean_excess"))


@query("model_runs", "SELECT o_orderkey AS run_id, o_orderstatus AS status FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def model_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = R.equals(table(spark, sf, "orders"), o_orderpriority="1-URGENT")
    return R.page(runs, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 20).select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))


@query("announcement_dates", "SELECT c_custkey AS ticker, DATE '2000-01-01' + (c_custkey % 90)::INT AS announce_date FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND DATE '2000-01-01' + (c_custkey % 90)::INT >= DATE '2000-02-01'")
def announcement_dates(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("c_custkey") % 90).cast("int"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("ticker"), day.alias("announce_date"), "c_mktsegment")
    return R.cross_section(c, None, "2000-02-01", None, "announce_date", c_mktsegment=["BUILDING", "MACHINERY"]).select("ticker", "announce_date")


@query("equity_path", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w / 1e6, 6) AS level, round(sum(o_totalprice) OVER w / max(o_totalprice) OVER w, 4) AS times_peak FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
def equity_path(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", r6(F.sum("o_totalprice").over(w) / 1e6).alias("level"), F.round(F.sum("o_totalprice").over(w) / F.max("o_totalprice").over(w), 4).alias("times_peak"))
