"""Queries of the readers: prices, securities, documents, scores, recommendations, journals and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions import expressions as X
from plumbline.operators import readers as R
from plumbline.plans.adapter import PRICES, SECTORS, prices, query, r6, sectors, table
from plumbline.sources import normalizers as N

_BARS = "ticker, session, round(open, 6) AS open, round(close, 6) AS close"


def _bars(df: DataFrame) -> DataFrame:
    return df.select("ticker", "session", r6("open").alias("open"), r6("close").alias("close"))


@query("price_range", f"WITH {PRICES} SELECT * FROM (SELECT {_BARS} FROM prices WHERE ticker = 3 AND session <= DATE '2000-12-31' ORDER BY session DESC LIMIT 50)")
def price_range(spark: SparkSession, sf: str) -> DataFrame:
    return _bars(R.price_range(prices(spark, sf), 3, end="2000-12-31", latest=50))


@query("adjusted_prices", f"WITH {PRICES}, a AS (SELECT *, CASE WHEN volume > 30 THEN close / 2 END AS adj_close FROM prices) SELECT ticker, session, round(coalesce(adj_close, close), 6) AS close FROM a WHERE ticker = 5 AND session BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def adjusted_prices(spark: SparkSession, sf: str) -> DataFrame:
    p = prices(spark, sf).withColumn("adj_close", F.when(F.col("volume") > 30, F.col("close") / 2))
    return R.price_range(p, 5, "1996-01-01", "1999-12-31", adjusted=True).select("ticker", "session", r6("close").alias("close"))


@query("cross_section", f"WITH {PRICES} SELECT {_BARS} FROM prices WHERE ticker IN (1, 2, 7) AND session BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def cross_section(spark: SparkSession, sf: str) -> DataFrame:
    return _bars(R.cross_section(prices(spark, sf), [1, 2, 7], "1997-01-01", "1998-12-31"))


@query("latest_quotes", f"WITH {PRICES} SELECT {_BARS} FROM prices WHERE session <= DATE '2000-06-30' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY session DESC) = 1")
def latest_quotes(spark: SparkSession, sf: str) -> DataFrame:
    return _bars(R.latest_rows(prices(spark, sf), ["ticker"], ["session"], "2000-06-30"))


@query("coverage", "SELECT o_orderpriority, max(o_orderdate)::DATE AS latest FROM orders GROUP BY 1")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return R.coverage(table(spark, sf, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("d")), "d", "o_orderpriority")


#: Customers as securities: codes of four characters, and every third again as five with a 0 behind, without a name.
_SEC = """sec AS (SELECT (c_custkey % 9000 + 1000)::VARCHAR AS ticker, 'JP' AS market, c_name AS name, c_mktsegment AS sector, DATE '1995-01-01' + (c_custkey % 500)::INT AS valid_from FROM customer
  UNION ALL SELECT (c_custkey % 9000 + 1000)::VARCHAR || '0', 'JP', CASE WHEN c_custkey % 2 = 0 THEN c_name END, c_mktsegment, DATE '1996-01-01' FROM customer WHERE c_custkey % 3 = 0)"""


def securities(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    code = (F.col("c_custkey") % 9000 + 1000).cast("string")
    four = c.select(code.alias("ticker"), F.lit("JP").alias("market"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 500).cast("int")).alias("valid_from"))
    five = c.filter("c_custkey % 3 = 0").select(F.concat(code, F.lit("0")).alias("ticker"), F.lit("JP").alias("market"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("sector"), F.lit("1996-01-01").cast("date").alias("valid_from"))
    return four.unionByName(five)


_CANON = "CASE WHEN length(ticker) = 5 AND ticker LIKE '%0' THEN left(ticker, 4) ELSE ticker END"


@query("issuers", f"WITH {_SEC} SELECT {_CANON} AS canonical, ticker, name, valid_from FROM sec QUALIFY row_number() OVER (PARTITION BY market, canonical ORDER BY name IS NULL, length(ticker), valid_from DESC, ticker) = 1")
def issuers(spark: SparkSession, sf: str) -> DataFrame:
    """Both forms of a code are one issuer; the named, then the shorter one stands for it."""
    return R.resolve_all(securities(spark, sf)).select("canonical", "ticker", "name", "valid_from")


@query("resolve_security", f"WITH {_SEC} SELECT ticker, name FROM sec WHERE ticker IN ('10030', '1003') ORDER BY name IS NULL, length(ticker), ticker LIMIT 1")
def resolve_security(spark: SparkSession, sf: str) -> DataFrame:
    return R.resolve_security(securities(spark, sf), "10030").select("ticker", "name")


@query("text_search", f"""WITH {_SEC}, hit AS (SELECT *, {_CANON} AS canonical FROM sec WHERE contains(lower(ticker), '100') OR contains(lower(coalesce(name, '')), '100')),
  one AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY market, canonical ORDER BY name IS NULL, length(ticker), valid_from DESC, ticker) = 1) SELECT ticker, name FROM one ORDER BY ticker = '100' DESC, ticker LIMIT 20""")
def text_search(spark: SparkSession, sf: str) -> DataFrame:
    return R.search_securities(securities(spark, sf), "100", ["ticker", "name"], 20).select("ticker", "name")


@query("peers", f"WITH {SECTORS} SELECT a.ticker, b.ticker AS peer, row_number() OVER (PARTITION BY a.ticker ORDER BY b.ticker)::INT AS nth FROM sectors a JOIN sectors b ON a.sector = b.sector AND a.ticker <> b.ticker QUALIFY nth <= 8")
def peers(spark: SparkSession, sf: str) -> DataFrame:
    return R.peers(sectors(spark, sf).withColumn("market", F.lit("JP")))


#: Orders as documents.
_DOCS = "docs AS (SELECT o_orderkey AS doc_id, o_custkey % 100 AS ticker, o_orderdate::TIMESTAMP AS filed_at, o_orderpriority AS doc_type FROM orders)"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 100).alias("ticker"), F.col("o_orderdate").cast("timestamp").alias("filed_at"), F.col("o_orderpriority").alias("doc_type"))


@query("document_list", f"WITH {_DOCS} SELECT doc_id, ticker, filed_at::DATE AS filed, doc_type FROM docs WHERE ticker IN (1, 5, 9) AND doc_type IN ('1-URGENT', '2-HIGH') AND filed_at::DATE BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' ORDER BY filed_at DESC, doc_id LIMIT 40 OFFSET 10")
def document_list(spark: SparkSession, sf: str) -> DataFrame:
    found = R.documents(docs(spark, sf), "1996-01-01", "2000-12-31", 40, 10, ticker=[1, 5, 9], doc_type=["1-URGENT", "2-HIGH"])
    return found.select("doc_id", "ticker", F.to_date("filed_at").alias("filed"), "doc_type")


@query("document_count", f"WITH {_DOCS} SELECT count(*) AS n FROM docs WHERE doc_type = '3-MEDIUM' AND filed_at::DATE >= DATE '1997-01-01'")
def document_count(spark: SparkSession, sf: str) -> DataFrame:
    return R.documents(docs(spark, sf), "1997-01-01", doc_type="3-MEDIUM").agg(F.count(F.lit(1)).alias("n"))


@query("held_documents", f"WITH {_DOCS} SELECT doc_id, ticker FROM docs WHERE ticker IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def held_documents(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("ticker"))
    return R.with_membership(docs(spark, sf), held, ["ticker"]).select("doc_id", "ticker")


@query("documents_with_summary", f"WITH {_DOCS} SELECT doc_id, doc_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45) AS has_summary FROM docs")
def documents_with_summary(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "lineitem").filter("l_quantity >= 45").select(F.col("l_orderkey").alias("doc_id"))
    return R.with_membership(docs(spark, sf), done, ["doc_id"], "has_summary").select("doc_id", "has_summary")


@query("preferred_documents", f"WITH {_DOCS} SELECT doc_id FROM docs WHERE ticker IN (7, 8)")
def preferred_documents(spark: SparkSession, sf: str) -> DataFrame:
    watched = spark.createDataFrame([(7,), (8,), (-1,)], "ticker long")
    return R.preferred(docs(spark, sf), watched, ["ticker"]).select("doc_id")


@query("filings_of_week", f"WITH {_DOCS} SELECT doc_id FROM docs WHERE filed_at::DATE BETWEEN date_trunc('week', DATE '1998-07-16')::DATE AND DATE '1998-07-16'")
def filings_of_week(spark: SparkSession, sf: str) -> DataFrame:
    return R.week_of(docs(spark, sf), "1998-07-16", "filed_at").select("doc_id")


@query("cached_summaries", """WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey, l_returnflag AS prompt_hash, l_linestatus AS input_hash FROM lineitem),
  last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, prompt_hash DESC, input_hash DESC) = 1) SELECT doc_id FROM last WHERE prompt_hash = 'N' AND input_hash = 'O'""")
def cached_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Of a document's lines the last is its latest summary."""
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").alias("summary_version"), F.col("l_returnflag").alias("prompt_hash"), F.col("l_linestatus").alias("input_hash"))
    return R.cached_summary(s, "N", "O").select("doc_id")


_RECS = "recs AS (SELECT o_orderkey AS rec_id, o_custkey % 100 AS ticker, o_orderdate::DATE AS as_of, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' END AS verdict, o_totalprice / 1000 AS conviction_score, o_orderpriority AS horizon FROM orders)"


def recs(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("rec_id"), (F.col("o_custkey") % 100).alias("ticker"), F.to_date("o_orderdate").alias("as_of"), F.when(s == "F", "approved").when(s == "P", "rejected").alias("verdict"), (F.col("o_totalprice") / 1000).alias("conviction_score"), F.col("o_orderpriority").alias("horizon"))


@query("recommendation_list", f"WITH {_RECS} SELECT rec_id, ticker, as_of, verdict FROM recs WHERE coalesce(verdict, 'approved') <> 'rejected' AND ticker = 4 ORDER BY as_of DESC, conviction_score DESC NULLS LAST, rec_id LIMIT 30")
def recommendation_list(spark: SparkSession, sf: str) -> DataFrame:
    return R.recommendations(recs(spark, sf), limit=30, ticker=4).select("rec_id", "ticker", "as_of", "verdict")


@query("recommendation_counts", f"WITH {_RECS} SELECT as_of, count(*) AS n FROM recs WHERE coalesce(verdict, 'approved') <> 'rejected' GROUP BY as_of")
def recommendation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.recommendations(recs(spark, sf)).groupBy("as_of").agg(F.count(F.lit(1)).alias("n"))


@query("outcome_list", f"WITH {_RECS}, outs AS (SELECT l_orderkey AS rec_id, l_linenumber AS line, l_partkey AS part, l_shipdate::DATE AS entry_date FROM lineitem) SELECT rec_id, line, part, entry_date, ticker FROM outs JOIN recs USING (rec_id) WHERE horizon = '1-URGENT' AND entry_date >= DATE '2000-01-01'")
def outcome_list(spark: SparkSession, sf: str) -> DataFrame:
    outs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rec_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.to_date("l_shipdate").alias("entry_date"))
    return R.outcomes(outs, recs(spark, sf), "2000-01-01", horizon="1-URGENT").select("rec_id", "line", "part", "entry_date", "ticker")


@query("score_page", "SELECT c_custkey AS ticker, round(c_acctbal, 4) AS score FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 5")
def score_page(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_acctbal").alias("score"), "c_mktsegment")
    return R.scores(c, "score", True, ("score",), 20, 5, c_mktsegment="BUILDING").select("ticker", F.round("score", 4).alias("score"))


@query("feature_versions", "SELECT o_custkey AS ticker, o_orderdate::DATE AS as_of, o_orderkey AS version FROM orders WHERE o_orderdate::DATE <= DATE '1999-03-31' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) = 1")
def feature_versions(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("as_of"), F.col("o_orderkey").alias("version"))
    return R.latest_rows(f, ["ticker"], ["as_of", "version"], "1999-03-31")


@query("feature_range", "SELECT o_custkey AS ticker, o_orderdate::DATE AS as_of, o_orderkey AS version FROM orders WHERE o_custkey IN (1, 2, 4) AND o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND o_orderpriority = '5-LOW'")
def feature_range(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("as_of"), F.col("o_orderkey").alias("version"), "o_orderpriority")
    return R.cross_section(f, [1, 2, 4], "1996-01-01", "1999-12-31", "as_of", o_orderpriority="5-LOW").drop("o_orderpriority")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.row_counts(R.all_tables(spark, _TABLES, sf))


@query("visibility", "SELECT count(*) AS rows_total, count(*) FILTER (o_orderdate::DATE <= DATE '1998-01-31') AS rows_visible, max(o_orderdate::DATE) FILTER (o_orderdate::DATE <= DATE '1998-01-31') AS latest_visible FROM orders")
def visibility(spark: SparkSession, sf: str) -> DataFrame:
    return R.visibility(table(spark, sf, "orders"), "o_orderdate", "1998-01-31")


@query("changed_rows", "WITH p AS (SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'P') AS v FROM orders GROUP BY 1) SELECT c_custkey, c_mktsegment, round(coalesce(v, c_acctbal), 4) AS c_acctbal FROM customer LEFT JOIN p ON c_custkey = o_custkey")
def changed_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("c_acctbal"))
    return R.changed(table(spark, sf, "customer"), p, ["c_custkey"]).select("c_custkey", "c_mktsegment", F.round("c_acctbal", 4).alias("c_acctbal"))


@query("deleted_rows", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def deleted_rows(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return R.without(table(spark, sf, "customer"), gone, ["c_custkey"]).select("c_custkey")


@query("active_weights", "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_mktsegment = (SELECT c_mktsegment FROM customer WHERE c_custkey = 10) THEN c_custkey = 10 ELSE c_custkey % 2 = 0 END AS active FROM customer")
def active_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_mktsegment", (F.col("c_custkey") % 2 == 0).alias("active"))
    return R.single_active(w, "10", ["c_mktsegment"], "id").select("id", "active")


@query("stale_jobs", "SELECT event_id FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '2024-01-15 10:00:00' - INTERVAL 2 HOURS")
def stale_jobs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"), F.col("ts").cast("timestamp").alias("started_at"))
    return R.stale_jobs(e, "2024-01-15 10:00:00").select("event_id")


_JOURNAL = "journal AS (SELECT event_id AS trade_id, user_id AS ticker, ts AS traded_at, CASE WHEN event_id % 3 = 0 THEN event_id END AS rec_id FROM events)"


def journal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("trade_id"), F.col("user_id").alias("ticker"), F.col("ts").cast("timestamp").alias("traded_at"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("rec_id"))


@query("trade_list", f"WITH {_JOURNAL} SELECT trade_id, ticker, rec_id FROM journal WHERE ticker IN (1, 2, 3) AND traded_at >= TIMESTAMP '2024-01-05 00:00:00' AND rec_id IS NOT NULL ORDER BY traded_at DESC, trade_id LIMIT 25 OFFSET 2")
def trade_list(spark: SparkSession, sf: str) -> DataFrame:
    return R.trades(journal(spark, sf), "2024-01-05 00:00:00", linked=True, limit=25, offset=2, ticker=[1, 2, 3]).select("trade_id", "ticker", "rec_id")


@query("trade_counts", f"WITH {_JOURNAL} SELECT count(*) AS n, count(rec_id) AS linked, count(*) - count(rec_id) AS discretionary FROM journal")
def trade_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.trade_counts(journal(spark, sf))


@query("cached_results", "WITH k AS (SELECT event_id, sha256(event_type || chr(30) || user_id::VARCHAR) AS key FROM events) SELECT event_id, key, key IN (SELECT key FROM k WHERE event_id % 10 = 0) AS hit FROM k")
def cached_results(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth event has filled the cache."""
    e = table(spark, sf, "events")
    key = X.cache_key(F.col("event_type"), F.col("user_id").cast("string"))
    cache = e.filter("event_id % 10 = 0").select(key.alias("key"), F.lit("x").alias("result")).distinct()
    return R.cached_results(e.select("event_id", "event_type", "user_id"), cache, key).select("event_id", "key", "hit")


@query("cards_by_issuer", f"""WITH {_SEC}, k AS (SELECT *, market || ':' || {_CANON} AS issuer FROM sec), s AS (SELECT issuer, ticker, length(sector) AS score FROM k WHERE length(ticker) = 4 OR name IS NULL QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY length(ticker), ticker) = 1),
  c AS (SELECT issuer, ticker AS card_ticker, ticker AS rec_id FROM k WHERE length(ticker) = 5 QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY ticker) = 1)
  SELECT coalesce(s.issuer, c.issuer) AS issuer, coalesce(ticker, card_ticker) AS ticker, score, rec_id, ticker IS NULL AS only_card FROM s FULL JOIN c ON s.issuer = c.issuer""")
def cards_by_issuer(spark: SparkSession, sf: str) -> DataFrame:
    s = securities(spark, sf)
    return R.cards_by_issuer(s.filter("length(ticker) = 4 OR name IS NULL").withColumn("score", F.length("sector").cast("long")), s.filter("length(ticker) = 5").withColumn("rec_id", F.col("ticker")))


@query("live_frame", f"WITH {PRICES} SELECT ticker, session, round(close - lag(close) OVER w, 6) AS change, round(close / nullif(lag(close) OVER w, 0) - 1, 6) AS change_pct FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY session)")
def live_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Each bar's change from the ticker's bar before."""
    return N.live_frame(prices(spark, sf)).select("ticker", "session", r6("change").alias("change"), r6("change_pct").alias("change_pct"))
