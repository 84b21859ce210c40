"""Queries of what a user keeps and opens: saved screens, securities' pages, sets of weights, watched securities, alerts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators import desk as D
from plumbline.plans.adapter import PRICES, prices, query, r6, table
from plumbline.plans.reads import _SEC, securities

_SCREENS = [
    {"id": "a", "name": "large and dear", "request": {"filters": [{"field": "p_size", "op": "gte", "value": 20}, {"field": "p_retailprice", "op": "gt", "value": 901}], "sort": [{"field": "p_retailprice", "dir": "desc"}], "limit": 25, "offset": 5}},
    {"id": "b", "name": "two brands", "request": {"filters": [{"field": "p_brand", "op": "in", "value": ["Brand#11", "Brand#23"]}], "sort": [{"field": "p_brand", "dir": "asc"}, {"field": "p_size", "dir": "desc"}]}},
    {"id": "c", "name": "nothing", "request": {"filters": [{"field": "p_size", "op": "lt", "value": 0}]}},
    {"id": "d", "name": "all", "request": {"filters": [], "sort": [], "limit": 10, "offset": 495}},
]


@query("saved_screens", """WITH s(screen_id, name, first, last) AS (VALUES ('a', 'large and dear', 5, 30), ('b', 'two brands', 0, 50), ('c', 'nothing', 0, 50), ('d', 'all', 495, 500)),
  m AS (SELECT 'a' AS screen_id, p_partkey, row_number() OVER (ORDER BY p_retailprice DESC NULLS FIRST, p_partkey) AS position FROM part WHERE p_size >= 20 AND p_retailprice > 901
    UNION ALL SELECT 'b', p_partkey, row_number() OVER (ORDER BY p_brand, p_size DESC NULLS FIRST, p_partkey) FROM part WHERE p_brand IN ('Brand#11', 'Brand#23')
    UNION ALL SELECT 'd', p_partkey, row_number() OVER (ORDER BY p_partkey) FROM part), t AS (SELECT screen_id, count(*) AS total FROM m GROUP BY 1)
  SELECT s.screen_id, name, position::INT AS position, p_partkey, coalesce(total, 0) AS total, coalesce(total, 0) > 500 AS truncated
  FROM s LEFT JOIN t USING (screen_id) LEFT JOIN m ON m.screen_id = s.screen_id AND position > first AND position <= last""")
def saved_screens(spark: SparkSession, sf: str) -> DataFrame:
    """All saved screens over all parts."""
    settings = spark.createDataFrame([("screener.saved", json.dumps(_SCREENS)), ("ui.theme", '"dark"')], "key string, value string")
    return D.run_screens(table(spark, sf, "part"), D.read_screens(settings), "p_partkey")


_CODE = "(ticker % 9000 + 1000)::VARCHAR || CASE WHEN ticker % 2 = 0 THEN '0' ELSE '' END"


@query("stock_details", f"""WITH {_SEC}, {PRICES}, quotes AS (SELECT {_CODE} AS code, session, close, close / open - 1 AS change_pct FROM prices),
  q AS (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY code ORDER BY session DESC) = 1),
  scores AS (SELECT (o_custkey % 9000 + 1000)::VARCHAR AS ticker, o_orderdate::DATE AS as_of, o_totalprice, o_orderpriority FROM orders),
  sc AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY as_of DESC, o_totalprice DESC, o_orderpriority DESC) = 1),
  km AS (SELECT (c_custkey % 9000 + 1000)::VARCHAR AS ticker, max(c_acctbal) AS c_acctbal FROM customer WHERE c_custkey % 4 = 0 GROUP BY 1)
  SELECT sec.ticker, sec.name, sec.sector, round(coalesce(a.close, b.close), 6) AS ref_price, round(CASE WHEN a.code IS NOT NULL THEN a.change_pct ELSE b.change_pct END, 6) AS ref_change_pct,
    coalesce(a.session, b.session) AS ref_as_of, round(o_totalprice, 4) AS total_score, o_orderpriority AS conviction, round(c_acctbal, 4) AS market_cap
  FROM sec LEFT JOIN q a ON a.code = sec.ticker LEFT JOIN q b ON length(sec.ticker) = 4 AND b.code = sec.ticker || '0' LEFT JOIN sc ON sc.ticker = sec.ticker LEFT JOIN km ON km.ticker = sec.ticker""")
def stock_details(spark: SparkSession, sf: str) -> DataFrame:
    """Every security with its latest quote, scores and metrics."""
    jp = F.lit("JP").alias("market")
    code = lambda c: (F.col(c) % 9000 + 1000).cast("string")
    p = prices(spark, sf)
    quotes = p.select(jp, F.concat(code("ticker"), F.when(F.col("ticker") % 2 == 0, "0").otherwise("")).alias("ticker"), F.col("session").alias("trade_date"), "close", (F.col("close") / F.col("open") - 1).alias("change_pct"), F.lit("live").alias("source"))
    o = table(spark, sf, "orders")
    scores = o.select(jp, code("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("as_of"), F.col("o_totalprice").alias("total_score"), F.col("o_totalprice").alias("quant_score"), F.col("o_orderpriority").alias("conviction"))
    metrics = table(spark, sf, "customer").filter("c_custkey % 4 = 0").select(jp, code("c_custkey").alias("ticker"), F.lit("2000-01-01").cast("date").alias("as_of"), F.col("c_acctbal").alias("market_cap"))
    found = D.stock_details(securities(spark, sf), quotes, scores, metrics)
    return found.select("ticker", "name", "sector", r6("ref_price").alias("ref_price"), r6("ref_change_pct").alias("ref_change_pct"), "ref_as_of", F.round("total_score", 4).alias("total_score"), "conviction", F.round("key_metrics.market_cap", 4).alias("market_cap"))


_SETS = "sets AS (SELECT o_orderkey AS id, o_orderpriority AS market, o_orderstatus AS horizon, o_orderdate::DATE AS created_at, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 5 = 1 END AS is_active FROM orders)"


@query("weight_roles", f"""WITH {_SETS}, n AS (SELECT *, row_number() OVER (PARTITION BY market, horizon, coalesce(is_active, false) ORDER BY created_at DESC, id DESC) AS k FROM sets)
  SELECT id, CASE WHEN k > 1 THEN 'history' WHEN coalesce(is_active, false) THEN 'active' ELSE 'proposed' END AS role FROM n""")
def weight_roles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    sets = table(spark, sf, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("market"), F.col("o_orderstatus").alias("horizon"), F.to_date("o_orderdate").alias("created_at"), F.when(k % 5 != 0, k % 5 == 1).alias("is_active"))
    return D.weight_roles(sets, id_col="id").select("id", "role")


@query("watched", """WITH c AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS ticker, CASE WHEN c_nationkey < 12 THEN 'default' ELSE c_mktsegment END AS list_name, DATE '2024-01-01' + (c_custkey % 90)::INT AS added_at FROM customer)
  SELECT ticker, list_name, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'second' WHEN k % 5 <> 0 THEN 'first' END AS note, added_at FROM c WHERE k % 5 <> 0 AND k % 7 <> 0
  UNION ALL SELECT ticker, list_name, CASE WHEN k % 2 = 0 THEN 'second' END, DATE '2024-06-01' FROM c WHERE k % 5 = 0 AND k % 3 = 0 AND k % 7 <> 0""")
def watched(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of customers: some are added again or anew, with a note or without, then some are taken off."""
    k = F.col("c_custkey")
    name = F.when(F.col("c_nationkey") < 12, "default").otherwise(F.col("c_mktsegment"))
    c = table(spark, sf, "customer").select(k.alias("k"), k.cast("string").alias("ticker"), F.lit("JP").alias("market"), name.alias("list_name"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 90).cast("int")).alias("added_at"))
    listed = c.filter("k % 5 <> 0").withColumn("note", F.lit("first"))
    asked = c.filter("k % 3 = 0").withColumns({"note": F.when(F.col("k") % 2 == 0, "second"), "list_name": F.when(F.col("list_name") != "default", F.col("list_name"))})
    found = D.unwatch(D.watch(listed, asked, F.lit("2024-06-01").cast("date")), c.filter("k % 7 = 0"))
    return found.select("ticker", "list_name", "note", "added_at")


@query("unread_alerts", """WITH e AS (SELECT event_id AS alert_id, ts AS created_at, event_id % 3 = 0 OR event_type = 'view' AS is_read FROM events)
  SELECT alert_id, (SELECT count(*) FROM e WHERE NOT is_read) AS unread_count FROM e WHERE NOT is_read ORDER BY created_at DESC, alert_id LIMIT 200""")
def unread_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as alerts: after those of one kind were read, the newest that were not."""
    e = table(spark, sf, "events")
    a = e.select(F.col("event_id").alias("alert_id"), F.col("ts").alias("created_at"), (F.col("event_id") % 3 == 0).alias("is_read"))
    return D.alerts(D.marked_read(a, e.filter("event_type = 'view'").select(F.col("event_id").alias("alert_id"))), True, 200).select("alert_id", "unread_count")
