"""Queries of vendor payloads, small expressions and what a candidate passes on its way to a card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions import expressions as X
from plumbline.operators import advice as A, calendar as C, macro as MA, models as M, pit, scoring as S
from plumbline.plans.adapter import PRICES, SECTORS, prices, query, r6, sectors, table
from plumbline.plans.cards import SC, scores
from plumbline.plans.series import _LEVEL, level
from plumbline.sources import normalizers as N, sinks as K
from plumbline.staging import stored


@query("adjusted_bars", f"""WITH {PRICES}, a AS (SELECT *, CASE WHEN volume > 30 THEN close / 2 ELSE close END AS adj_close FROM prices), f AS (SELECT *, CASE WHEN close > 0 THEN adj_close / close ELSE 1 END AS f FROM a)
  SELECT ticker, session, round(f, 6) AS adjustment_factor, round(open * f, 6) AS adj_open, round(high * f, 6) AS adj_high, round(low * f, 6) AS adj_low, round(close * volume, 4) AS turnover_value FROM f""")
def adjusted_bars(spark: SparkSession, sf: str) -> DataFrame:
    p = prices(spark, sf).withColumn("adj_close", F.when(F.col("volume") > 30, F.col("close") / 2).otherwise(F.col("close")))
    return N.adjusted(p).select("ticker", "session", *[r6(c).alias(c) for c in ("adjustment_factor", "adj_open", "adj_high", "adj_low")], F.round("turnover_value", 4).alias("turnover_value"))


@query("series_observations", """SELECT o_orderpriority AS series_id, o_orderkey AS id, o_orderdate::DATE AS observation_date, CASE WHEN o_orderkey % 3 = 0 THEN DATE '2003-05-01' ELSE DATE '2003-06-01' END AS vintage_date, CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice, 2) END AS value FROM orders""")
def series_observations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    p = table(spark, sf, "orders").select(
        F.concat_ws("|", "o_orderpriority", k).alias("series_id"), F.to_date("o_orderdate").cast("string").alias("date"), F.when(k % 3 == 0, "2003-05-01").when(k % 3 == 1, "no date").alias("realtime_start"),
        F.lit("2003-06-01").alias("fetched_at"), F.when(k % 5 == 0, ".").otherwise(F.round("o_totalprice", 2).cast("string")).alias("value"),
    )
    x = N.observations(p, revised=True)
    return x.select(F.split_part("series_id", F.lit("|"), F.lit(1)).alias("series_id"), F.split_part("series_id", F.lit("|"), F.lit(2)).cast("long").alias("id"), "observation_date", "vintage_date", F.round("value", 2).alias("value"))


@query("filing_rows", "SELECT o_custkey, o_orderkey AS accession, o_orderdate::DATE AS filed, o_orderstatus AS form FROM orders")
def filing_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Parallel arrays, as a register sends them, back to rows."""
    item = F.struct(F.col("o_orderkey").alias("accession"), F.to_date("o_orderdate").alias("filed"), F.col("o_orderstatus").alias("form"))
    p = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(item).alias("x"))
    p = p.select("o_custkey", *[F.col(f"x.{c}").alias(c) for c in ("accession", "filed", "form")])
    return N.parallel_rows(p, ["accession", "filed", "form"], ["o_custkey"])


_TAGS = {"revenue": ("A", "N"), "assets": ("R",)}


@query("company_facts", """WITH f AS (SELECT l_orderkey AS k, l_returnflag AS tag, l_extendedprice AS v, l_shipdate::DATE AS filed, CASE l_returnflag WHEN 'R' THEN 'assets' ELSE 'revenue' END AS c, CASE l_returnflag WHEN 'N' THEN 1 ELSE 0 END AS i FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')),
  o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k, c ORDER BY i, filed, v) = 1) SELECT k, round(max(v) FILTER (c = 'revenue'), 4) AS revenue, round(max(v) FILTER (c = 'assets'), 4) AS assets FROM o GROUP BY k""")
def company_facts(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("tag"), F.col("l_extendedprice").alias("value"), F.to_date("l_shipdate").alias("filed"))
    return N.facts_wide(f, _TAGS, ["k"]).select("k", F.round("revenue", 4).alias("revenue"), F.round("assets", 4).alias("assets"))


@query("content_hashes", """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || CASE WHEN c_custkey % 4 <> 0 THEN ',"c_mktsegment":"' || c_mktsegment || '"' ELSE '' END || ',"c_name":"' || c_name || '"}') AS hash FROM customer""")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_name", "c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return c.select("c_custkey", K.content_hash(c).alias("hash"))


@query("overlaid_scores", f"WITH {SC} SELECT k, round(greatest(0, least(100, quant_score + 12 * coalesce(quality_z, 0) * coalesce(CASE WHEN k % 3 <> 0 THEN conviction_score END, 0.5))), 6) AS total_score FROM sc")
def overlaid_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = scores(spark, sf).withColumn("sure", F.when(F.col("k") % 3 != 0, F.col("conviction_score")))
    return s.select("k", r6(S.overlay(F.col("quant_score"), F.col("quality_z"), F.col("sure"))).alias("total_score"))


_SUFFIXES = (("tokyo", ".T"), ("nasdaq", ""), ("london", ".L"))


@query("more_scalars", """WITH c AS (SELECT *, c_custkey AS k FROM customer) SELECT k, CASE k % 4 WHEN 0 THEN '.T' WHEN 1 THEN '' WHEN 2 THEN '.L' ELSE '?' END AS suffix, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN c_name WHEN 3 THEN NULL ELSE 'NaNo Corp' END AS name, len(list_filter(['a', k::VARCHAR], lambda x: k % 2 = 0 OR x = 'a')) AS parts, k::VARCHAR AS symbol,
    round((k * 1000 * 2.5::DOUBLE + k * 10 * 10.0::DOUBLE) / 1e6, 8) AS cost, 'https://***:***@h/x?api_key=***&n=' || k AS masked, DATE '2000-01-01' - CASE k % 4 WHEN 0 THEN 31 WHEN 1 THEN 93 WHEN 2 THEN 1825 ELSE 365 END AS start FROM c""")
def more_scalars(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    c = table(spark, sf, "customer").withColumn("k", F.col("c_custkey"))
    exchange = F.when(k % 4 == 0, "TOKYO Prime").when(k % 4 == 1, "Nasdaq GS").when(k % 4 == 2, "London").otherwise("Moon")
    name = F.when(k % 5 == 0, " NaN ").when(k % 5 == 1, F.lit("7203")).when(k % 5 == 2, F.concat(F.lit(" "), "c_name")).when(k % 5 == 3, "").otherwise("NaNo Corp")
    parts = F.when(k % 2 == 0, F.concat(F.lit("a, ,"), k.cast("string"))).otherwise("a,, ")
    url = F.concat(F.lit("https://user:pw@h/x?api_key=abc&n="), k.cast("string"))
    key = F.when(k % 4 == 0, "1m").when(k % 4 == 1, "3m").when(k % 4 == 2, "5y").otherwise("never")
    return c.select(
        "k", X.exchange_suffix(exchange, _SUFFIXES, "?").alias("suffix"), X.clean_name(name, F.lit("7203")).alias("name"), F.size(X.split_list(parts)).cast("long").alias("parts"), X.without_suffix(F.concat(k.cast("string"), F.lit(".T"))).alias("symbol"),
        F.round(X.model_cost(k * 1000, k * 10, F.lit(2.5), F.lit(10.0)), 8).alias("cost"), N.masked(url).alias("masked"), C.range_start(key, F.lit("2000-01-01").cast("date")).alias("start"),
    )


@query("sessions_as_of", """SELECT event_id, CASE WHEN hour(ts + INTERVAL 9 HOUR) * 60 + minute(ts + INTERVAL 9 HOUR) >= 1110 THEN (ts + INTERVAL 9 HOUR)::DATE ELSE (ts + INTERVAL 9 HOUR)::DATE - 1 END AS session FROM events""")
def sessions_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", C.session_as_of(F.col("ts").cast("timestamp"), "JP").alias("session"))


_Z80, _Z95 = X.normal_quantile(0.9), X.normal_quantile(0.975)


@query("forecast_bundle", _LEVEL + f""", d AS (SELECT session, level, level - lag(level) OVER (ORDER BY session) AS d FROM lv WHERE level IS NOT NULL), s AS (SELECT arg_max(level, session) AS level, stddev_samp(d) AS sigma FROM d)
  SELECT 'walk' AS model_id, round(level, 5) AS point, round(level - {_Z95!r} * sigma * sqrt(5), 5) AS low, round(level + {_Z95!r} * sigma * sqrt(5), 5) AS high FROM s
  UNION ALL SELECT 'walk_80', round(level, 5), round(level - {_Z80!r} * sigma * sqrt(5), 5), round(level + {_Z80!r} * sigma * sqrt(5), 5) FROM s""")
def forecast_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """A row a model: the last level and its interval five sessions on, and the same interval at another confidence."""
    x = level(spark, sf).filter("level IS NOT NULL").withColumn("d", F.col("level") - F.lag("level").over(MA.by_date("session")))
    s = stored(x.agg(F.max_by("level", "session").alias("level"), F.stddev_samp("d").alias("sigma")), "last-level")
    walk = s.select(F.lit("walk").alias("model_id"), *M.random_walk(F.col("level"), F.col("sigma"), 5)).withColumnRenamed("forecast", "point")
    low, high = A.rescaled_interval(F.col("point"), F.col("low"), F.col("high"))
    both = MA.bundle([walk, walk.select(F.lit("walk_80").alias("model_id"), "point", low.alias("low"), high.alias("high"))])
    return both.select("model_id", *[F.round(c, 5).alias(c) for c in ("point", "low", "high")])


@query("active_securities", f"""SELECT c_custkey::VARCHAR AS ticker, c_mktsegment AS sector FROM customer WHERE DATE '1995-01-01' + (c_custkey % 500)::INT <= DATE '1996-02-01' AND (c_custkey % 4 <> 0 OR DATE '1995-06-01' + (c_custkey % 500)::INT > DATE '1996-02-01') AND c_custkey % 3 <> 0 AND c_custkey::VARCHAR IN ({', '.join(f"'{k}'" for k in range(0, 400, 7))})""")
def active_securities(spark: SparkSession, sf: str) -> DataFrame:
    """Securities that were valid at a date, are active, and are asked for."""
    k = F.col("c_custkey")
    day = lambda d: F.date_add(F.lit(d).cast("date"), (k % 500).cast("int"))
    s = table(spark, sf, "customer").select(k.cast("string").alias("ticker"), F.col("c_mktsegment").alias("sector"), day("1995-01-01").alias("valid_from"), F.when(k % 4 == 0, day("1995-06-01")).alias("valid_to"), (k % 3 != 0).alias("is_active"))
    return pit.securities_at(s, "1996-02-01", active=True, tickers=[str(k) for k in range(0, 400, 7)]).select("ticker", "sector")


_CANDIDATES = f"""{SC}, q AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 7 < 5 THEN '011' ELSE '013' END END AS category FROM customer),
  t AS (SELECT sc.*, greatest(0, least(100, quant_score + 12 * coalesce(quality_z, 0) * coalesce(conviction_score, 0.5))) AS total, category FROM sc LEFT JOIN q USING (k)),
  u AS (SELECT * FROM t WHERE adv_20d >= 50000 AND coalesce(category = '011', true)), m AS (SELECT * FROM u UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM u)),
  g AS (SELECT *, CASE WHEN quant_percentile >= 0.85 AND ml_pred_h20 > 0 AND ml_pred_h20_lo > -0.05 THEN 0 ELSE 1 END AS tier FROM m),
  capped AS (SELECT *, row_number() OVER (PARTITION BY sector_code ORDER BY tier, total DESC, k) AS in_sector FROM g)"""


@query("candidate_pipeline", f"""WITH {_CANDIDATES} SELECT k, sector_code, CASE tier WHEN 0 THEN 'core' ELSE 'fill' END AS candidate_tier, round(total, 6) AS total_score, row_number() OVER (ORDER BY tier, total DESC, k) AS position FROM capped WHERE in_sector <= 3 QUALIFY position <= 10""")
def candidate_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """From scores to a selection: qualitative overlay, the categories of the list, the universe (or all, if it is empty), the strict
    gate as the first tier, and the fill under the sectors' caps."""
    k = F.col("c_custkey")
    listed = table(spark, sf, "customer").select(k.alias("k"), F.when(k % 7 != 0, F.when(k % 7 < 5, "011").otherwise("013")).alias("product_category"))
    s = scores(spark, sf).withColumns({"overlay_score": F.col("quality_z"), "overlay_confidence": F.col("conviction_score")}).drop("product_category")
    found = A.candidates(s, listed, ["k"], "sector_code", min_adv=50_000, tie=["k"])
    return found.select("k", "sector_code", "candidate_tier", r6("total_score").alias("total_score"), F.col("position").cast("long").alias("position"))


@query("score_cards", f"WITH {SECTORS} SELECT s.s_suppkey AS ticker, s_name AS name, sector, CASE WHEN s.s_suppkey % 5 <> 0 THEN '011' END AS product_category, round(s_acctbal, 4) AS score FROM supplier s LEFT JOIN sectors ON ticker = s.s_suppkey")
def score_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Scores with the names, sectors and categories of their securities."""
    s = table(spark, sf, "supplier")
    listed = s.select(F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 5 != 0, "011").alias("product_category")).join(sectors(spark, sf), "ticker", "left")
    return A.named_scores(s.select(F.col("s_suppkey").alias("ticker"), F.round("s_acctbal", 4).alias("score")), listed, ["ticker"]).select("ticker", "name", "sector", "product_category", "score")
