"""Financial statements: standalone quarters, trailing years, valuation, quality, growth and guidance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.expressions import positive_ratio, ratio

# Columns of a statement that add up over a period, those that stand at its end, and the order of its periods.
FLOWS = ("revenue", "operating_income", "ordinary_income", "net_income", "eps", "operating_cf", "investing_cf", "financing_cf", "capex", "ebitda", "cogs", "interest_expense", "tax_expense", "pretax_income", "dividend_per_share")
STOCKS = ("total_assets", "total_equity", "total_debt", "cash_and_equiv", "bps")
QUARTERS = {"Q1": 1, "Q2": 2, "Q3": 3, "Q4": 4, "H1": 2, "FY": 4}
CUMULATIVE = ("cumulative", "annual")
#: Tax rate by market where the statement's own is not between 0 and 0.6.
TAX_RATE = {"JP": 0.30, "US": 0.21}
#: Relative change of guidance that counts as none.
DEAD_BAND = 0.005


def _lookup(values: dict, key: Column, default: object = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def standalone_quarters(statements: DataFrame, flows: Sequence[str] = FLOWS) -> DataFrame:
    """Flows of each quarter alone. A cumulative or annual row less the row of the quarter before it in the fiscal year; null
    unless that row is there; first quarters and quarterly rows as they are. Rows of unknown periods go. One row a quarter."""
    rows = statements.withColumn("_q", _lookup(QUARTERS, F.col("fiscal_period"))).filter("_q IS NOT NULL")
    w = Window.partitionBy("ticker", "fiscal_year").orderBy("_q", "filed_at")
    follows = F.col("_q") - F.lag("_q").over(w) == 1
    alone = ~F.col("period_type").isin(*CUMULATIVE) | (F.col("_q") == 1)
    flows = [c for c in flows if c in statements.columns]
    rows = rows.withColumns({c: F.when(alone, F.col(c)).otherwise(F.when(follows, F.col(c) - F.lag(c).over(w))) for c in flows})
    return rows.withColumns({"fiscal_period": F.concat(F.lit("Q"), F.col("_q")), "period_type": F.lit("quarter")}).drop("_q")


def trailing_years(quarters: DataFrame, skips: Sequence[int] = (0, 4, 12), flows: Sequence[str] = FLOWS, stocks: Sequence[str] = STOCKS, forecasts: Sequence[str] = ()) -> DataFrame:
    """One row a ticker: for each of ``skips`` the sums of the four quarters after that many latest ones (``<flow>_ttm`` for 0,
    else ``<flow>_ttm_<skip>``), null unless all four have a value; of the latest quarter its stocks and forecasts; and the
    mean equity of the latest four, null unless all have one. One shuffle by ticker."""
    flows = [c for c in flows if c in quarters.columns]
    latest = [c for c in (*stocks, *forecasts) if c in quarters.columns]
    nth = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("period_end").desc()))
    rows = quarters.withColumn("_n", nth).filter(F.col("_n") <= max(skips) + 4)

    def total(c: str, skip: int) -> Column:
        x = F.when(F.col("_n").between(skip + 1, skip + 4), F.col(c))
        return F.when(F.count(x) == 4, F.sum(x)).alias(f"{c}_ttm" if not skip else f"{c}_ttm_{skip}")

    out = [total(c, k) for k in skips for c in flows] + [F.max(F.when(F.col("_n") == 1, F.col(c))).alias(c) for c in latest]
    if "total_equity" in quarters.columns:
        equity = F.when(F.col("_n") <= 4, F.col("total_equity"))
        out.append(F.when(F.count(equity) == 4, F.avg(equity)).alias("avg_total_equity"))
    return rows.groupBy("ticker").agg(F.max("period_end").alias("period_end"), *out)


def _zero(x: str) -> Column:
    return F.coalesce(F.col(x), F.lit(0.0))


def valuation(ttm: DataFrame, cap: str = "market_cap", close: str = "close") -> DataFrame:
    """Adds per, per_forward, pbr, psr, ev_ebitda, fcf_yield, dividend_yield and earnings_yield; a loss has no price multiple
    but a negative yield. A market value or a price of 0 or less counts as unknown."""
    c, price = (F.when(F.col(x) > 0, F.col(x)) for x in (cap, close))
    return ttm.withColumns(
        {
            "per": positive_ratio(c, F.col("net_income_ttm")),
            "per_forward": positive_ratio(c, F.col("forecast_net_income")),
            "pbr": positive_ratio(c, F.col("total_equity")),
            "psr": positive_ratio(c, F.col("revenue_ttm")),
            "ev_ebitda": positive_ratio(c + _zero("total_debt") - _zero("cash_and_equiv"), F.col("ebitda_ttm")),
            "fcf_yield": ratio(F.col("operating_cf_ttm") - F.abs("capex_ttm"), c),
            "dividend_yield": ratio(F.col("dividend_per_share_ttm"), price),
            "earnings_yield": ratio(F.col("net_income_ttm"), c),
        }
    )


def quality(ttm: DataFrame, market: str = "JP") -> DataFrame:
    """Adds roe, roic, gross_margin, operating_margin, debt_to_equity, interest_coverage and accruals_ratio."""
    own = ratio(F.col("tax_expense_ttm"), F.col("pretax_income_ttm"))
    tax = F.when(own.between(0.0, 0.6), own).otherwise(TAX_RATE.get(market, 0.30))
    invested = _zero("total_debt") + F.col("total_equity") - _zero("cash_and_equiv")
    revenue, income = F.col("revenue_ttm"), F.col("operating_income_ttm")
    return ttm.withColumns(
        {
            "roe": positive_ratio(F.col("net_income_ttm"), F.col("avg_total_equity")),
            "roic": positive_ratio(income * (1 - tax), invested),
            "gross_margin": positive_ratio(revenue - F.col("cogs_ttm"), revenue),
            "operating_margin": positive_ratio(income, revenue),
            "debt_to_equity": positive_ratio(F.col("total_debt"), F.col("total_equity")),
            "interest_coverage": ratio(income, F.abs("interest_expense_ttm")),
            "accruals_ratio": positive_ratio(F.col("net_income_ttm") - F.col("operating_cf_ttm"), F.col("total_assets")),
        }
    )


def growth(ttm: DataFrame) -> DataFrame:
    """Adds revenue_growth_yoy, eps_growth_yoy and revenue_cagr_3y; null on a base of 0 or less."""
    three = positive_ratio(F.col("revenue_ttm"), F.col("revenue_ttm_12"))
    return ttm.withColumns(
        {
            "revenue_growth_yoy": positive_ratio(F.col("revenue_ttm"), F.col("revenue_ttm_4")) - 1,
            "eps_growth_yoy": positive_ratio(F.col("eps_ttm"), F.col("eps_ttm_4")) - 1,
            "revenue_cagr_3y": F.when(three > 0, F.pow(three, F.lit(1 / 3)) - 1),
        }
    )


def forecast_revision(statements: DataFrame, forecast: str = "forecast_op_income", tie: str | None = None) -> DataFrame:
    """ticker, direction and magnitude between the last two forecasts that are not null. Less than half a percent is no
    change; a base of 0 or less has no magnitude and direction 0; a ticker with one forecast has neither."""
    order = [F.col("filed_at").desc(), *([F.col(tie).desc()] if tie else [])]
    known = F.col(forecast).isNotNull()
    nth = F.row_number().over(Window.partitionBy("ticker", known).orderBy(*order))
    pick = lambda k: F.max(F.when(known & (F.col("_n") == k), F.col(forecast)))
    two = statements.withColumn("_n", nth).filter(F.col("_n") <= 2).groupBy("ticker").agg(pick(1).alias("new"), pick(2).alias("old"))
    size = positive_ratio(F.col("new"), F.col("old")) - 1
    way = F.when(F.col("old").isNull(), F.lit(None)).when(size > DEAD_BAND, 1).when(size < -DEAD_BAND, -1).otherwise(0)
    return two.select("ticker", way.cast("int").alias("forecast_revision_direction"), size.alias("forecast_revision_magnitude"))
