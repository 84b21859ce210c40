"""Queries on records: screens, lists, ledgers, text and vectors, upserts, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.functions import expressions as X
from plumbline.functions.expressions import ratio
from plumbline.operators import calendar as C, models as M, outcomes as O, pit, retrieval as R, screener, scoring as S
from plumbline.plans.adapter import DENSE, PRICES, dense, prices, query, r6, table
from plumbline.sources import normalizers as N, quality as Q, sinks as K


@query("screen_parts", """WITH f AS (SELECT * FROM part WHERE p_size BETWEEN 10 AND 40 AND p_brand NOT IN ('Brand#11', 'Brand#12') AND p_retailprice >= 903 AND p_type IS NOT NULL)
  SELECT p_partkey, p_brand, p_size, round(p_retailprice, 4) AS p_retailprice FROM f ORDER BY p_size DESC NULLS FIRST, p_retailprice ASC NULLS LAST, p_partkey LIMIT 50 OFFSET 25""")
def screen_parts(spark: SparkSession, sf: str) -> DataFrame:
    filters = [{"field": "p_size", "op": "between", "value": [10, 40]}, {"field": "p_brand", "op": "not_in", "value": ["Brand#11", "Brand#12"]}, {"field": "p_retailprice", "op": "gte", "value": 903}, {"field": "p_type", "op": "is_not_null"}]
    found = screener.screen(table(spark, sf, "part"), filters, [("p_size", True), ("p_retailprice", False)], ["p_partkey", "p_brand", "p_size", "p_retailprice"], 50, 25, "p_partkey")
    return found.withColumn("p_retailprice", F.round("p_retailprice", 4))


@query("capped_customers", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS k FROM customer)
  SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS position FROM c WHERE k <= 2 QUALIFY position <= 20""")
def capped_customers(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("day", F.lit(1))
    return S.capped_top(c, ["day"], "c_nationkey", [F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey")], 2, 20).select("c_custkey", "c_nationkey", F.col("position").cast("long").alias("position"))


_FRESH = (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))


@query("freshness", " UNION ALL ".join(f"SELECT '{t}' AS source, max({c})::DATE AS latest, count(*) AS n FROM {t}" for t, c in _FRESH))
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, t).agg(F.lit(t).alias("source"), F.to_date(F.max(c)).alias("latest"), F.count(F.lit(1)).alias("n")) for t, c in _FRESH]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("cost_ledger", """SELECT event_type AS purpose, count(*) AS calls, round(sum(value), 4) AS cost, round(sum(value) FILTER (value >= 10), 4) AS cost_success, round(avg((value >= 10)::INT), 6) AS success_rate FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def cost_ledger(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    good = F.col("value") >= 10
    return e.rollup(F.col("event_type").alias("purpose")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.round(F.sum(F.when(good, F.col("value"))), 4).alias("cost_success"), r6(F.avg(good.cast("int"))).alias("success_rate"))


@query("budget_breaches", """WITH d AS (SELECT ts::DATE AS day, date_trunc('month', ts)::DATE AS month, sum(value) AS spent FROM events GROUP BY ALL), r AS (SELECT *, sum(spent) OVER (PARTITION BY month ORDER BY day ROWS UNBOUNDED PRECEDING) AS run, sum(spent) OVER (PARTITION BY month) * 0.9 AS cap FROM d)
  SELECT day, round(run, 4) AS run, CASE WHEN run >= cap THEN 'stopped' WHEN run >= 0.8 * cap THEN 'warning' ELSE 'ok' END AS state FROM r""")
def budget_breaches(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.sum("value").alias("spent"))
    w = Window.partitionBy("month")
    run, cap = F.sum("spent").over(w.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)), F.sum("spent").over(w) * 0.9
    return d.select("day", run.alias("run"), cap.alias("cap")).select("day", F.round("run", 4).alias("run"), F.when(F.col("run") >= F.col("cap"), "stopped").when(F.col("run") >= 0.8 * F.col("cap"), "warning").otherwise("ok").alias("state"))


_RECS = """recs AS (SELECT o_orderkey AS rec_id, (o_custkey % 100 + 1)::BIGINT AS ticker, date_trunc('week', o_orderdate)::DATE AS session, CASE WHEN o_orderpriority < '3' THEN 'accumulate' ELSE 'reduce' END AS action, o_orderpriority AS conviction, o_totalprice FROM orders)"""


def recs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("rec_id"), (F.col("o_custkey") % 100 + 1).alias("ticker"), F.date_trunc("week", "o_orderdate").cast("date").alias("session"),
        F.when(F.col("o_orderpriority") < "3", "accumulate").otherwise("reduce").alias("action"), F.col("o_orderpriority").alias("conviction"), "o_totalprice",
    )


_OUT = f"""WITH {DENSE}, {_RECS}, p AS (SELECT ticker, session, lead(open, 1) OVER w AS entry, CASE WHEN lead(open, 1) OVER w > 0 THEN lead(open, 5) OVER w / lead(open, 1) OVER w - 1 END AS ret, max(high) OVER h AS top, min(low) OVER h AS bottom
    FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY session_idx), h AS (PARTITION BY ticker ORDER BY session_idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
  lv AS (SELECT session, session_idx, avg(open) AS level FROM panel GROUP BY ALL), b AS (SELECT session, lead(level, 5) OVER (ORDER BY session_idx) / nullif(lead(level, 1) OVER (ORDER BY session_idx), 0) - 1 AS bench FROM lv),
  o AS (SELECT r.*, ret, coalesce(bench, 0) AS bench, ret - coalesce(bench, 0) AS excess, CASE action WHEN 'accumulate' THEN 1 ELSE -1 END AS sg, top / nullif(entry, 0) - 1 AS up, bottom / nullif(entry, 0) - 1 AS down
    FROM recs r JOIN p USING (ticker, session) LEFT JOIN b USING (session) WHERE ret IS NOT NULL)"""


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    d = dense(spark, sf)
    bench = d.groupBy("session", "session_idx").agg(F.avg("open").alias("level"))
    return O.outcomes(recs(spark, sf).select("rec_id", "ticker", "session", "action"), d, bench, 4)


@query("outcomes", _OUT + " SELECT rec_id, ticker, session, round(ret, 6) AS ret, round(bench, 6) AS bench, round(excess, 6) AS excess, excess * sg > 0 AS is_hit, round(CASE sg WHEN 1 THEN up ELSE 0 - down END, 6) AS mfe, round(CASE sg WHEN 1 THEN down ELSE 0 - up END, 6) AS mae FROM o")
def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf).select("rec_id", "ticker", "session", "is_hit", *[r6(c).alias(c) for c in ("ret", "bench", "excess", "mfe", "mae")])


@query("hit_rates", _OUT + " SELECT conviction, count(*) AS n, round(avg((excess * sg > 0)::INT), 6) AS hit_rate FROM o GROUP BY conviction")
def hit_rates(spark: SparkSession, sf: str) -> DataFrame:
    o = _outcomes(spark, sf).join(recs(spark, sf).select("rec_id", "conviction"), "rec_id")
    return O.hit_rates(o, ["conviction"]).withColumn("hit_rate", r6("hit_rate"))


_CODES = """past AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_totalprice > 150000 AS is_hit, o_totalprice / 100000 AS excess, list_sort(list_distinct(list(p_type))) AS codes FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""


def _past(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_type")).alias("codes"))
    o = table(spark, sf, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"))
    return o.select("o_orderkey", F.to_date("o_orderdate").alias("d"), (F.col("o_totalprice") > 150000).alias("is_hit"), (F.col("o_totalprice") / 100000).alias("excess"), "codes")


@query("similar_prior", f"""WITH {_CODES}, x AS (SELECT *, len(list_intersect(codes, ['ECONOMY', 'PROMO', 'STANDARD'])) >= 2 AS near FROM past WHERE d < DATE '1999-06-30')
  SELECT count(*) FILTER (near) AS n_samples, round(CASE WHEN count(*) FILTER (near) >= 20 THEN avg(is_hit::INT) FILTER (near) ELSE avg(is_hit::INT) END, 6) AS hit_rate, round(CASE WHEN count(*) FILTER (near) >= 20 THEN avg(excess) FILTER (near) ELSE avg(excess) END, 6) AS mean_excess FROM x""")
def similar_prior(spark: SparkSession, sf: str) -> DataFrame:
    p = O.similar_prior(_past(spark, sf), ["ECONOMY", "PROMO", "STANDARD"], F.col("d") < F.lit("1999-06-30").cast("date"))
    return p.select("n_samples", r6("hit_rate").alias("hit_rate"), r6("mean_excess").alias("mean_excess"))


@query("membership_effect", f"""WITH {_CODES}, m AS (SELECT DISTINCT p_type AS code FROM part)
  SELECT code, count(*) FILTER (list_contains(codes, code)) AS n_used, round(avg(is_hit::INT) FILTER (list_contains(codes, code)), 6) AS rate_used, round(avg(is_hit::INT) FILTER (NOT list_contains(codes, code)), 6) AS rate_unused FROM m, past GROUP BY code""")
def membership_effect(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "part").select(F.col("p_type").alias("code")).distinct()
    return O.membership_effect(_past(spark, sf), m, "codes", "code").select("code", "n_used", r6("rate_used").alias("rate_used"), r6("rate_unused").alias("rate_unused"))


#: Every vector whose id is divisible by 20 against all vectors.
_NEAREST = """SELECT q.vec_id AS query_id, e.vec_id, s AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id) AS nth
  FROM embeddings q, embeddings e, LATERAL (SELECT round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS s) WHERE q.vec_id % 20 = 0"""


def _nearest(spark: SparkSession, sf: str, k: int) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return R.vector_top_each(e, e.filter("vec_id % 20 = 0"), k, "vec_id", "embedding")


@query("vector_search", f"""SELECT query_id, vec_id, round(score, 6) AS score, nth FROM ({_NEAREST}) WHERE nth <= 10""")
def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf, 10).withColumn("score", r6("score"))


@query("keyword_search", """WITH d AS (SELECT * FROM documents WHERE length(text) >= 20 ORDER BY n_chars DESC, doc_id LIMIT 80), m AS (SELECT doc_id, left(text, 1200) AS snippet, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS nth FROM d WHERE contains(lower(text), 'password') OR contains(lower(text), 'license') OR contains(lower(text), 'tion'))
  SELECT doc_id, snippet, nth, round(1.0 / nth, 6) AS score FROM m WHERE nth <= 10""")
def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    found = R.keyword_top(table(spark, sf, "documents"), "password license tion", 10, "doc_id", "text", F.col("n_chars"))
    return found.select("doc_id", "snippet", F.col("nth").cast("long").alias("nth"), r6("score").alias("score"))


@query("hybrid_search", f"""WITH v AS (SELECT query_id, vec_id AS doc_id, nth FROM ({_NEAREST}) WHERE nth <= 30),
  d AS (SELECT * FROM documents WHERE length(text) >= 20 ORDER BY n_chars DESC, doc_id LIMIT 80), k AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS nth FROM d WHERE contains(lower(text), 'tion') QUALIFY nth <= 30),
  a AS (SELECT * FROM v UNION ALL SELECT vec_id AS query_id, doc_id, nth FROM embeddings, k WHERE vec_id % 20 = 0),
  f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + nth)), 9) AS s, count(*) AS n_lists FROM a GROUP BY ALL)
  SELECT query_id, doc_id, round(s, 6) AS score, n_lists, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS nth FROM f QUALIFY nth <= 10""")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    v = _nearest(spark, sf, 30).withColumnRenamed("vec_id", "doc_id")
    k = R.keyword_top(table(spark, sf, "documents"), "tion", 30, "doc_id", "text", F.col("n_chars")).select("doc_id", "nth")
    q = table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    return R.fuse_each([v, q.crossJoin(F.broadcast(k))], "doc_id", 10).withColumn("score", r6("score"))


@query("document_chunks")
def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return R.chunks(table(spark, sf, "documents"))


@query("quality_gate", f"""WITH {PRICES}, b AS (SELECT ticker, session, CASE WHEN (volume::BIGINT) % 7 = 0 THEN NULL ELSE close END AS close, CASE WHEN (volume::BIGINT) % 11 = 0 THEN low - 1 ELSE high END AS high, low, open, volume FROM prices),
  r AS (SELECT *, CASE WHEN close IS NULL THEN 'CLOSE_MISSING' WHEN high < low THEN 'HIGH_LOW_INVERTED' WHEN close > high OR close < low THEN 'CLOSE_OUT_OF_RANGE' WHEN open > high OR open < low THEN 'OPEN_OUT_OF_RANGE' WHEN close <= 0 THEN 'CLOSE_NOT_POSITIVE' WHEN close < 10 THEN 'CLOSE_TOO_LOW' END AS reject FROM b),
  p AS (SELECT *, last_value(CASE WHEN reject IS NULL THEN close END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r)
  SELECT ticker, session, reject, CASE WHEN reject IS NULL AND abs(close / nullif(prev, 0) - 1) > 0.4 THEN 'EXTREME_MOVE' END AS flag FROM p""")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    b = prices(spark, sf)
    b = b.withColumns({"close": F.when(F.col("volume").cast("long") % 7 != 0, F.col("close")), "high": F.when(F.col("volume").cast("long") % 11 == 0, F.col("low") - 1).otherwise(F.col("high")), "currency": F.lit("JPY")})
    return Q.quality_gate(b).select("ticker", "session", "reject", F.get("flags", F.lit(0)).alias("flag"))


@query("upsert_orders", """WITH inc AS (SELECT o_custkey AS c_custkey, o_totalprice AS c_acctbal FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
  SELECT coalesce(c.c_custkey, i.c_custkey) AS c_custkey, c_mktsegment, round(CASE WHEN i.c_custkey IS NOT NULL THEN i.c_acctbal ELSE c.c_acctbal END, 4) AS c_acctbal FROM customer c FULL JOIN inc i USING (c_custkey)""")
def upsert_orders(spark: SparkSession, sf: str) -> DataFrame:
    inc = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderdate", "o_orderkey")
    out = K.upsert(table(spark, sf, "customer"), inc, ["c_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return out.select("c_custkey", "c_mktsegment", F.round("c_acctbal", 4).alias("c_acctbal"))


@query("portfolio_weights", """WITH v AS (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS mv FROM orders GROUP BY ALL) SELECT o_custkey, o_orderpriority, round(100 * mv / nullif(sum(mv) OVER (PARTITION BY o_custkey), 0), 1) AS weight_pct FROM v""")
def portfolio_weights(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("mv"))
    return v.select("o_custkey", "o_orderpriority", F.round(ratio(100 * F.col("mv"), F.sum("mv").over(Window.partitionBy("o_custkey"))), 1).alias("weight_pct"))


@query("review_stats", """SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS approved, count(*) FILTER (o_orderstatus = 'P') AS revised, count(*) FILTER (o_orderstatus = 'O') AS rejected, round(count(*) FILTER (o_orderstatus = 'F') / nullif(count(*), 0), 6) AS approval_rate FROM orders""")
def review_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(s == v).alias(k) for v, k in (("F", "approved"), ("P", "revised"), ("O", "rejected"))], r6(ratio(F.count_if(s == "F"), F.count(F.lit(1)))).alias("approval_rate"))


@query("feed", """WITH s AS (SELECT c_custkey AS k, c_acctbal AS score FROM customer), r AS (SELECT o_custkey AS k, count(*) AS cards FROM orders GROUP BY 1)
  SELECT coalesce(s.k, r.k) AS k, round(score, 4) AS score, coalesce(cards, 0) AS cards, s.k IS NULL AS only_card FROM s FULL JOIN r ON s.k = r.k""")
def feed(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.round("c_acctbal", 4).alias("score"), F.lit(True).alias("scored"))
    r = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("cards"))
    return s.join(r, "k", "full_outer").select("k", "score", F.coalesce("cards", F.lit(0)).alias("cards"), F.col("scored").isNull().alias("only_card"))


@query("event_properties", """SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS k_sum, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def event_properties(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.countDistinct("user_id").alias("users"))


@query("unpivoted_prices", f"""WITH {PRICES} SELECT ticker, session, field, round(value, 6) AS value FROM (UNPIVOT (SELECT ticker, session, open, high, low, close FROM prices) ON open, high, low, close INTO NAME field VALUE value)""")
def unpivoted_prices(spark: SparkSession, sf: str) -> DataFrame:
    return prices(spark, sf).unpivot(["ticker", "session"], ["open", "high", "low", "close"], "field", "value").filter("value IS NOT NULL").withColumn("value", r6("value"))


@query("effective_dates", """WITH cal AS (SELECT DISTINCT ts::DATE AS session FROM events WHERE dayofweek(ts) BETWEEN 1 AND 5), e AS (SELECT event_id, ts + INTERVAL 9 HOUR AS local FROM events), d AS (SELECT event_id, CASE WHEN hour(local) >= 15 THEN local::DATE + 1 ELSE local::DATE END AS earliest FROM e)
  SELECT event_id, (SELECT min(session) FROM cal WHERE session >= earliest) AS available_from FROM d""")
def effective_dates(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts")
    cal = C.sessions(e.filter(F.weekday("ts") < 5), "ts")
    return C.effective_date(e, "ts", "JP", cal).select("event_id", "available_from")


@query("backup_retention", """WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events) SELECT day, row_number() OVER (ORDER BY day DESC) <= 7 AS daily, dayofweek(day) = 0 AS weekly, day = max(day) OVER (PARTITION BY date_trunc('month', day)) AS monthly FROM d""")
def backup_retention(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct()
    return d.select("day", (F.row_number().over(Window.orderBy(F.col("day").desc())) <= 7).alias("daily"), (F.weekday("day") == 6).alias("weekly"), (F.col("day") == F.max("day").over(Window.partitionBy(F.date_trunc("month", "day")))).alias("monthly"))


@query("drift", """WITH x AS (SELECT l_returnflag AS g, l_extendedprice AS v FROM lineitem WHERE l_returnflag IN ('A', 'R')), c AS (SELECT v, count(*) FILTER (g = 'A') AS a, count(*) FILTER (g = 'R') AS b FROM x GROUP BY v), k AS (SELECT sum(a) OVER w / sum(a) OVER () AS fa, sum(b) OVER w / sum(b) OVER () AS fb FROM c WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))
  SELECT round(max(abs(fa - fb)), 6) AS ks FROM k""")
def drift(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("A", "R")).select(F.col("l_extendedprice").alias("v"), (F.col("l_returnflag") == "A").alias("first"))
    return M.ks_distance(x, "v", "first").select(r6("ks").alias("ks"))


@query("lake_scan", """SELECT l_returnflag, l_shipmonth, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM (SELECT *, date_trunc('month', l_shipdate)::DATE AS l_shipmonth FROM lineitem WHERE l_quantity >= 20 AND l_returnflag IN ('A', 'R') AND l_discount <> 0.05) GROUP BY ALL""")
def lake_scan(spark: SparkSession, sf: str) -> DataFrame:
    l = K.read_lake(spark, f"{sf}/lineitem.parquet", ["l_returnflag", "l_shipdate", "l_quantity"], [("l_quantity", ">=", 20), ("l_returnflag", "in", ["A", "R"]), ("l_discount", "!=", 0.05)])
    return l.groupBy("l_returnflag", F.date_trunc("month", "l_shipdate").cast("date").alias("l_shipmonth")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


_TITLES = ("2024年3月期 決算短信〔日本基準〕（連結）", "決算補足説明資料", "業績予想の修正に関するお知らせ", "配当予想の修正に関するお知らせ", "自己株式の取得に係る事項の決定", "株式分割に関するお知らせ", "代表者の異動に関するお知らせ", "新製品発売のお知らせ", "決算短信の一部訂正と業績予想の修正")
_TITLE = "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TITLES)) + " END"


@query("title_types", f"""WITH t AS (SELECT o_orderkey AS doc_id, 'Order ' || o_orderkey || ' ' || coalesce({_TITLE}, '') AS t FROM orders)
  SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in N.TITLE_RULES)} ELSE 'other_disclosure' END AS title_type FROM t""")
def title_types(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("Order "), F.col("o_orderkey"), F.lit(" "), F.coalesce(F.expr(_TITLE), F.lit("")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), N.title_type(t).alias("title_type"))


@query("disclosures", f"""WITH t AS (SELECT o_orderkey, coalesce({_TITLE}, '') AS title FROM orders)
  SELECT 'tdnet:20240105-' || CASE WHEN o_orderkey < 1000 THEN lpad(o_orderkey::VARCHAR, 4, '0') ELSE o_orderkey::VARCHAR END AS doc_id, left((10000 + o_orderkey % 9000)::VARCHAR, 4) AS ticker, title FROM t""")
def disclosures(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.coalesce(F.expr(_TITLE), F.lit("")).alias("title"), (10000 + F.col("o_orderkey") % 9000).cast("string").alias("code"))
    return N.disclosures(p, "2024-01-05").select("doc_id", "ticker", "title")


@query("filings_list", """SELECT 'edinet:' || o_orderkey AS doc_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'annual_report' WHEN '2-HIGH' THEN 'quarterly_report' WHEN '3-MEDIUM' THEN 'current_report' ELSE 'other_disclosure' END AS doc_type, o_orderpriority IN ('2-HIGH', '3-MEDIUM') AS is_amendment,
  CASE WHEN o_orderkey % 3 = 0 THEN 'edinet:' || o_orderkey ELSE o_clerk END AS title, CASE WHEN o_orderkey % 4 = 0 THEN DATE '2024-01-05' ELSE o_orderdate::DATE END AS filed FROM (SELECT *, 'clerk ' || o_custkey AS o_clerk FROM orders)""")
def filings_list(spark: SparkSession, sf: str) -> DataFrame:
    code = F.create_map(*[F.lit(x) for kv in {"1-URGENT": "120", "2-HIGH": "150", "3-MEDIUM": "190"}.items() for x in kv])
    k = F.col("o_orderkey")
    p = table(spark, sf, "orders").select(k.alias("docID"), F.try_element_at(code, F.col("o_orderpriority")).alias("docTypeCode"), F.when(k % 3 != 0, F.concat(F.lit("clerk "), F.col("o_custkey"))).otherwise(F.lit("  ")).alias("docDescription"), F.when(k % 4 != 0, F.col("o_orderdate").cast("string")).alias("submitDateTime"))
    return N.filings_list(p, "2024-01-05").select("doc_id", "doc_type", "is_amendment", "title", F.to_date("filed_at").alias("filed"))


@query("normalized_bars", """SELECT l_partkey::VARCHAR AS ticker, l_shipdate::DATE AS session, round(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END, 4) AS close, round(CASE WHEN l_linenumber % 2 = 0 THEN coalesce(CASE WHEN l_linenumber % 4 = 0 THEN l_extendedprice / 2 END, l_extendedprice) END, 4) AS adj_close FROM lineitem WHERE l_linenumber % 5 <> 0""")
def normalized_bars(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    p = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("Code"), F.when(n % 5 != 0, F.to_date("l_shipdate").cast("string")).alias("Date"), F.when(n % 2 == 0, F.col("l_extendedprice").cast("string")).otherwise("n/a").alias("C"), F.when(n % 4 == 0, (F.col("l_extendedprice") / 2).cast("string")).alias("AdjC"))
    return N.daily_bars(p).select("ticker", "session", F.round("close", 4).alias("close"), F.round("adj_close", 4).alias("adj_close"))


@query("normalized_statements", """SELECT o_custkey::VARCHAR AS ticker, o_orderdate::DATE AS period_end, CASE o_orderpriority WHEN '1-URGENT' THEN 'Q1' WHEN '2-HIGH' THEN 'Q2' WHEN '3-MEDIUM' THEN 'FY' ELSE 'FY' END AS fiscal_period,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'quarter' WHEN '2-HIGH' THEN 'cumulative' ELSE 'annual' END AS period_type, round(o_totalprice, 4) AS revenue FROM orders WHERE o_orderkey % 7 <> 0""")
def normalized_statements(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in {"1-URGENT": "1Q", "2-HIGH": "2Q", "3-MEDIUM": "4Q", "4-NOT SPECIFIED": ""}.items() for x in kv])
    p = table(spark, sf, "orders").select(F.col("o_custkey").alias("LocalCode"), F.to_date("o_orderdate").cast("string").alias("CurPerEn"), F.when(F.col("o_orderkey") % 7 != 0, F.lit("2001-01-31")).alias("DisclosedDate"), F.try_element_at(kind, F.col("o_orderpriority")).alias("CurPerType"), F.col("o_totalprice").cast("string").alias("NetSales"))
    return N.statements(p).select("ticker", "period_end", "fiscal_period", "period_type", F.round("revenue", 4).alias("revenue"))


@query("listed_securities", "SELECT c_custkey::VARCHAR AS ticker, CASE WHEN c_custkey % 4 = 0 THEN c_custkey::VARCHAR ELSE c_name END AS name_local, c_mktsegment AS sector_name FROM customer")
def listed_securities(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("Code"), F.when(F.col("c_custkey") % 4 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("CompanyName"), F.col("c_mktsegment").alias("S33Nm"))
    return N.listed(p, "2024-01-05").select("ticker", "name_local", "sector_name")


@query("registrants", "SELECT c_name AS ticker, lpad(c_custkey::VARCHAR, 10, '0') AS cik FROM customer")
def registrants(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    p = c.select(F.create_map(F.lit("0"), F.struct(F.col("c_custkey").alias("cik_str"), F.col("c_name").alias("ticker"), F.col("c_name").alias("title"))).alias("companies"))
    return N.registrants(p, "2024-01-05").select("ticker", "cik")


@query("rejected_part", """SELECT round(avg((l_discount >= 0.05)::INT), 6) AS rejected, avg((l_discount >= 0.05)::INT) >= 0.5 AS fallback FROM lineitem""")
def rejected_part(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select(F.when(F.col("l_discount") >= 0.05, "BAD").alias("reject"))
    return K.falls_back(x).select(r6("rejected").alias("rejected"), "fallback")


@query("quality_ledger", f"""WITH {PRICES}, b AS (SELECT ticker, session, CASE WHEN (volume::BIGINT) % 7 = 0 THEN NULL ELSE close END AS close, CASE WHEN (volume::BIGINT) % 11 = 0 THEN low - 1 ELSE high END AS high, low, open FROM prices)
  SELECT ticker, session, CASE WHEN close IS NULL THEN 'CLOSE_MISSING' ELSE 'HIGH_LOW_INVERTED' END AS mark FROM b WHERE close IS NULL OR high < low""")
def quality_ledger(spark: SparkSession, sf: str) -> DataFrame:
    b = prices(spark, sf)
    b = b.withColumns({"close": F.when(F.col("volume").cast("long") % 7 != 0, F.col("close")), "high": F.when(F.col("volume").cast("long") % 11 == 0, F.col("low") - 1).otherwise(F.col("high")), "currency": F.lit("JPY")})
    return Q.quality_ledger(Q.quality_gate(b)).filter("rejected").select("ticker", "session", "mark")


@query("next_sessions", f"""WITH {PRICES}, cal AS (SELECT DISTINCT session FROM prices), d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)
  SELECT d, (SELECT min(session) FROM cal WHERE session > d) AS following, (SELECT max(session) FROM cal WHERE session < d) AS earlier FROM d WHERE d BETWEEN (SELECT min(session) FROM cal) AND (SELECT max(session) FROM cal)""")
def next_sessions(spark: SparkSession, sf: str) -> DataFrame:
    cal = C.sessions(prices(spark, sf), "session")
    d = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    ends = cal.agg(F.min("session").alias("a"), F.max("session").alias("b"))
    d = d.join(F.broadcast(ends)).filter("d BETWEEN a AND b").select("d")  # one row
    x = C.next_session(d, "d", cal).withColumnRenamed("other", "following")
    return C.next_session(x, "d", cal, -1).select("d", "following", F.col("other").alias("earlier"))


@query("sessions_between", f"""WITH {PRICES}, cal AS (SELECT DISTINCT session FROM prices) SELECT count(*) FILTER (session >= DATE '1997-01-06' AND session < DATE '1998-01-05') AS n, count(*) FILTER (session BETWEEN DATE '1997-01-06' AND DATE '1998-01-05') AS n_both FROM cal""")
def sessions_between(spark: SparkSession, sf: str) -> DataFrame:
    day = lambda d: F.lit(d).cast("date")
    return C.sessions_between(C.sessions(prices(spark, sf), "session"), day("1997-01-06"), day("1998-01-05")).select("n", F.size("sessions").cast("long").alias("n_both"))


@query("scalar_functions", """SELECT c_custkey, round(base * (1 + 3 * sqrt(greatest(c_acctbal / greatest(c_custkey * 1e3, 1), 0))), 6) AS slippage, sha256('p' || chr(30) || c_name || chr(30) || '') AS key, date_trunc('week', DATE '2000-01-01' + (c_custkey % 700)::INT)::DATE AS week, round(50 + 50 * greatest(-1, least(1, (c_acctbal / 2000 - 2) / 2.5)), 6) AS score,
    regexp_replace(trim(c_name), '[^0-9A-Za-z._-]+', '_', 'g') AS path, CASE WHEN length(c_custkey::VARCHAR) < 6 THEN lpad(c_custkey::VARCHAR, 6, '0') ELSE c_custkey::VARCHAR END AS padded, ((2000 - 1999) * 12 + month(DATE '2000-01-01' + (c_custkey % 300)::INT) - 5 + 1)::BIGINT AS months FROM (SELECT *, 5.0::DOUBLE AS base FROM customer)""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    day = lambda n: F.date_add(F.lit("2000-01-01").cast("date"), (F.col("c_custkey") % n).cast("int"))
    return table(spark, sf, "customer").select(
        "c_custkey", r6(X.slippage_bps(F.col("c_acctbal"), F.col("c_custkey") * 1e3, 5.0)).alias("slippage"), X.cache_key(F.lit("p"), F.col("c_name"), F.lit(None).cast("string")).alias("key"), X.week_start(day(700)).alias("week"),
        r6(X.score_100(F.col("c_acctbal") / 2000 - 2)).alias("score"), X.path_part(F.col("c_name")).alias("path"), X.padded(F.col("c_custkey").cast("string"), 6).alias("padded"), X.months_inclusive(F.lit("1999-05-01").cast("date"), day(300)).alias("months"),
    )
