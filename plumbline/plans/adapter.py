"""The concepts of the library on the tables at hand, in Spark and as SQL for the checks.

Prices: a supplier's shipped lines by week. Sectors: regions. Filings: orders by customer and quarter. Sessions: the weeks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.operators import panel as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def prices(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """``until`` bounds the scan: lines of a week that starts later are not read."""
    lines = table(spark, sf_dir, "lineitem")
    if until is not None:
        lines = lines.filter(F.col("l_shipdate") < F.date_add(F.lit(until).cast("date"), 7))
    rows = lines.select(
        F.col("l_suppkey").alias("ticker"), F.date_trunc("week", "l_shipdate").cast("date").alias("session"), F.try_divide("l_extendedprice", "l_quantity").alias("p"), "l_quantity", "l_extendedprice"
    )
    return rows.groupBy("ticker", "session").agg(
        ((F.max("p") + F.min("p")) / 2).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.avg("p").alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("turnover"),
    )


PRICES = """prices AS (SELECT l_suppkey AS ticker, date_trunc('week', l_shipdate)::DATE AS session, (max(p) + min(p)) / 2 AS open,
    max(p) AS high, min(p) AS low, avg(p) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS turnover
  FROM (SELECT *, l_extendedprice / nullif(l_quantity, 0) AS p FROM lineitem) GROUP BY ALL)"""


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dense(prices(spark, sf_dir))


DENSE = (
    PRICES
    + """, cal AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS session_idx FROM (SELECT DISTINCT session FROM prices)),
  panel AS (SELECT t.ticker, cal.session_idx, cal.session, open, high, low, close, volume, turnover
    FROM (SELECT DISTINCT ticker FROM prices) t CROSS JOIN cal LEFT JOIN prices p ON p.ticker = t.ticker AND p.session = cal.session)"""
)


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"))


SECTORS = """sectors AS (SELECT s_suppkey AS ticker, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a version of its customer's quarter, filed at its date."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("ticker"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("period"), F.to_date("o_orderdate").alias("filed_at"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("revenue"))


FILINGS = """filings AS (SELECT o_custkey AS ticker, date_trunc('quarter', o_orderdate)::DATE AS period, o_orderdate::DATE AS filed_at, o_orderkey AS version, o_totalprice AS revenue FROM orders)"""
