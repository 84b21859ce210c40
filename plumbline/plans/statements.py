"""Queries on financial statements: orders by quarter, as cumulative statements of fifty tickers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.operators import fundamentals as U, pit
from plumbline.plans.adapter import query, r6, table

AS_OF = "2000-06-30"

# Each column over revenue (rev), the number of orders (n) and that of filled ones (nf) of a quarter, in SQL that both engines read.
_FLOWS = {
    "revenue": "rev", "operating_income": "rev * 0.25 - 20000 * n", "net_income": "rev * 0.2 - 60000 * nf", "eps": "rev / 1000 - 50", "operating_cf": "rev * 0.22 - 25000 * n", "capex": "rev * -0.05",
    "ebitda": "rev * 0.3 - 20000 * n", "cogs": "rev * 0.6", "interest_expense": "n * 100.0", "tax_expense": "rev * 0.03", "pretax_income": "rev * 0.2 - 30000 * nf", "dividend_per_share": "n * 0.5",
}
_STOCKS = {"total_assets": "rev * 2 + 1000000", "total_equity": "CASE WHEN n % 7 <> 0 THEN 500000 + rev - 200000 * nf END", "total_debt": "CASE WHEN n % 5 <> 0 THEN rev * 0.4 END", "cash_and_equiv": "rev * 0.1", "forecast_op_income": "CASE WHEN n % 4 <> 0 THEN rev * 0.3 - 100000 END", "forecast_net_income": "rev * 0.25 - 50000 * nf"}
_CUMULATED = "sum({}) OVER (PARTITION BY ticker, fiscal_year ORDER BY q ROWS UNBOUNDED PRECEDING)"

STATEMENTS = f"""quarters AS (SELECT o_custkey % 50 AS ticker, year(o_orderdate)::INT AS fiscal_year, quarter(o_orderdate)::INT AS q, max(o_orderdate)::DATE AS filed_at, sum(o_totalprice) AS rev, count(*) AS n,
    count(*) FILTER (o_orderstatus = 'F') AS nf FROM orders WHERE o_orderdate::DATE <= DATE '{AS_OF}' GROUP BY ALL),
  flows AS (SELECT ticker, fiscal_year, q, filed_at, {', '.join(f'({e})::DOUBLE AS {c}' for c, e in (_FLOWS | _STOCKS).items())} FROM quarters),
  statements AS (SELECT ticker, fiscal_year, q, filed_at, {', '.join(f'{_CUMULATED.format(c)} AS {c}' for c in _FLOWS)}, {', '.join(_STOCKS)} FROM flows),
  alone AS (SELECT ticker, fiscal_year, q, filed_at, {', '.join(f'CASE WHEN q = 1 THEN {c} WHEN q - lag(q) OVER w = 1 THEN {c} - lag({c}) OVER w END AS {c}' for c in _FLOWS)}, {', '.join(_STOCKS)}
    FROM statements WINDOW w AS (PARTITION BY ticker, fiscal_year ORDER BY q))"""


def statements(spark: SparkSession, sf: str) -> DataFrame:
    o = pit.visible(table(spark, sf, "orders"), "o_orderdate", AS_OF)
    keys = [(F.col("o_custkey") % 50).alias("ticker"), F.year("o_orderdate").alias("fiscal_year"), F.quarter("o_orderdate").alias("q")]
    q = o.groupBy(*keys).agg(F.to_date(F.max("o_orderdate")).alias("filed_at"), F.sum("o_totalprice").alias("rev"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("nf"))
    q = q.select("ticker", "fiscal_year", "q", "filed_at", *[F.expr(e).cast("double").alias(c) for c, e in (_FLOWS | _STOCKS).items()])
    w = Window.partitionBy("ticker", "fiscal_year").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumns({c: F.sum(c).over(w) for c in _FLOWS})
    end = F.last_day(F.make_date("fiscal_year", F.col("q") * 3, F.lit(1)))
    return q.withColumns({"fiscal_period": F.concat(F.lit("Q"), F.col("q")), "period_type": F.lit("cumulative"), "period_end": end}).drop("q")


def _alone(spark: SparkSession, sf: str) -> DataFrame:
    return U.standalone_quarters(statements(spark, sf))


@query("standalone_quarters", f"WITH {STATEMENTS} SELECT ticker, fiscal_year, 'Q' || q AS fiscal_period, {', '.join(f'round({c}, 3) AS {c}' for c in _FLOWS)} FROM alone")
def standalone_quarters(spark: SparkSession, sf: str) -> DataFrame:
    return _alone(spark, sf).select("ticker", "fiscal_year", "fiscal_period", *[F.round(c, 3).alias(c) for c in _FLOWS])


def _sum(c: str, skip: int) -> str:
    x = f"FILTER (nth BETWEEN {skip + 1} AND {skip + 4})"
    return f"CASE WHEN count({c}) {x} = 4 THEN sum({c}) {x} END AS {c}_ttm" + (f"_{skip}" if skip else "")


TRAILING = f"""{STATEMENTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC, q DESC) AS nth FROM alone),
  ttm AS (SELECT ticker, {', '.join(_sum(c, k) for k in (0, 4, 12) for c in _FLOWS)}, {', '.join(f'max({c}) FILTER (nth = 1) AS {c}' for c in _STOCKS)},
    CASE WHEN count(total_equity) FILTER (nth <= 4) = 4 THEN avg(total_equity) FILTER (nth <= 4) END AS avg_total_equity, 100 + ticker AS close, (1e6 + ticker * 1e4)::DOUBLE AS market_cap FROM ranked GROUP BY ticker)"""


def _trailing(spark: SparkSession, sf: str) -> DataFrame:
    t = U.trailing_years(_alone(spark, sf), forecasts=("forecast_op_income", "forecast_net_income"))
    return t.withColumns({"close": 100 + F.col("ticker"), "market_cap": (1e6 + F.col("ticker") * 1e4).cast("double")})


def _pos(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) END"


_EV = "market_cap + coalesce(total_debt, 0) - coalesce(cash_and_equiv, 0)"
_TAX = "CASE WHEN tax_expense_ttm / nullif(pretax_income_ttm, 0) BETWEEN 0 AND 0.6 THEN tax_expense_ttm / nullif(pretax_income_ttm, 0) ELSE 0.3 END"
_INVESTED = "(coalesce(total_debt, 0) + total_equity - coalesce(cash_and_equiv, 0))"
VALUATION = {
    "per": _pos("market_cap", "net_income_ttm"), "per_forward": _pos("market_cap", "forecast_net_income"), "pbr": _pos("market_cap", "total_equity"), "psr": _pos("market_cap", "revenue_ttm"), "ev_ebitda": _pos(_EV, "ebitda_ttm"),
    "fcf_yield": "(operating_cf_ttm - abs(capex_ttm)) / market_cap", "dividend_yield": "dividend_per_share_ttm / close", "earnings_yield": "net_income_ttm / market_cap",
}
QUALITY = {
    "roe": _pos("net_income_ttm", "avg_total_equity"), "roic": _pos(f"operating_income_ttm * (1 - {_TAX})", _INVESTED), "gross_margin": _pos("revenue_ttm - cogs_ttm", "revenue_ttm"), "operating_margin": _pos("operating_income_ttm", "revenue_ttm"),
    "debt_to_equity": _pos("total_debt", "total_equity"), "interest_coverage": "operating_income_ttm / nullif(abs(interest_expense_ttm), 0)", "accruals_ratio": _pos("net_income_ttm - operating_cf_ttm", "total_assets"),
}
GROWTH = {
    "revenue_growth_yoy": _pos("revenue_ttm", "revenue_ttm_4") + " - 1", "eps_growth_yoy": _pos("eps_ttm", "eps_ttm_4") + " - 1", "revenue_cagr_3y": "CASE WHEN revenue_ttm_12 > 0 AND revenue_ttm > 0 THEN pow(revenue_ttm / revenue_ttm_12, 1 / 3.0::DOUBLE) - 1 END",
}


def _sql(columns: dict[str, str]) -> str:
    return f"WITH {TRAILING} SELECT ticker, {', '.join(f'round({e}, 6) AS {c}' for c, e in columns.items())} FROM ttm"


def _rounded(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select("ticker", *[r6(c).alias(c) for c in columns])


@query("valuation", _sql(VALUATION))
def valuation(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(U.valuation(_trailing(spark, sf)), VALUATION)


@query("quality_ratios", _sql(QUALITY))
def quality_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(U.quality(_trailing(spark, sf)), QUALITY)


@query("growth", _sql(GROWTH))
def growth(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(U.growth(_trailing(spark, sf)), GROWTH)


@query("trailing_years", f"WITH {TRAILING} SELECT ticker, {', '.join(f'round({c}_ttm{s}, 2) AS {c}_ttm{s}' for s in ('', '_4', '_12') for c in ('revenue', 'net_income', 'eps'))}, round(avg_total_equity, 2) AS avg_total_equity, round(total_debt, 2) AS total_debt FROM ttm")
def trailing_years(spark: SparkSession, sf: str) -> DataFrame:
    names = [f"{c}_ttm{s}" for s in ("", "_4", "_12") for c in ("revenue", "net_income", "eps")]
    return _trailing(spark, sf).select("ticker", *[F.round(c, 2).alias(c) for c in (*names, "avg_total_equity", "total_debt")])


@query("forecast_revision", f"""WITH {STATEMENTS}, f AS (SELECT ticker, forecast_op_income AS f, row_number() OVER (PARTITION BY ticker ORDER BY filed_at DESC, q DESC) AS k FROM statements WHERE forecast_op_income IS NOT NULL),
  p AS (SELECT t.ticker, max(f) FILTER (k = 1) AS new, max(f) FILTER (k = 2) AS old FROM (SELECT DISTINCT ticker FROM statements) t LEFT JOIN f USING (ticker) GROUP BY t.ticker), m AS (SELECT *, CASE WHEN old > 0 THEN new / old - 1 END AS m FROM p)
  SELECT ticker, (CASE WHEN old IS NULL THEN NULL WHEN m > 0.005 THEN 1 WHEN m < -0.005 THEN -1 ELSE 0 END)::INT AS forecast_revision_direction, round(m, 6) AS forecast_revision_magnitude FROM m""")
def forecast_revision(spark: SparkSession, sf: str) -> DataFrame:
    return U.forecast_revision(statements(spark, sf), tie="period_end").withColumn("forecast_revision_magnitude", r6("forecast_revision_magnitude"))


def latest_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Every order is a version of its customer's quarter; the last filed one of each, whatever the date."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("ticker"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("period"), F.to_date("o_orderdate").alias("filed_at"), F.col("o_orderkey").alias("version"))
    return pit.latest(o, ["ticker", "period"], [F.col("filed_at").desc(), F.col("version").desc()])


query("latest_versions", "SELECT o_custkey AS ticker, date_trunc('quarter', o_orderdate)::DATE AS period, o_orderdate::DATE AS filed_at, o_orderkey AS version FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, period ORDER BY filed_at DESC, version DESC) = 1")(latest_versions)
