"""Vendor payloads to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from plumbline.functions.expressions import padded

# Title rules in order (the first that matches gives the type), codes of filings and of periods.
TITLE_RULES = (
    ("earnings_flash", "決算短信"),
    ("earnings_presentation", "決算説明|説明資料|補足説明"),
    ("guidance_revision", "業績予想の(修正|下方修正|上方修正)|業績予想の修正"),
    ("dividend_revision", "配当予想の修正"),
    ("buyback", "自己株式の取得"),
    ("stock_split", "株式分割"),
    ("management_change", "代表者の異動|役員の異動"),
)
FILING_TYPES = {"120": "annual_report", "130": "annual_report", "140": "quarterly_report", "150": "quarterly_report", "160": "semiannual_report", "170": "semiannual_report", "180": "current_report", "190": "current_report", "350": "large_holding", "360": "large_holding"}
AMENDMENTS = ("130", "150", "170", "190", "360")
PERIODS = {"1Q": "Q1", "2Q": "Q2", "3Q": "Q3", "4Q": "FY", "FY": "FY"}


def required(df: DataFrame, *groups: str | Sequence[str]) -> DataFrame:
    """``df``, if it has each field, or one of each group of alternatives; else an error that names what is missing."""
    missing = [g for g in groups if not {g} & set(df.columns) if isinstance(g, str)] + [g for g in groups if not isinstance(g, str) and not set(g) & set(df.columns)]
    if missing:
        raise ValueError(f"the payload lacks {missing}")
    return df


def first_present(df: DataFrame, names: Sequence[str], kind: str = "string") -> Column:
    """The first non-null of the fields that exist, cast with errors to null."""
    found = [F.col(n).try_cast(kind) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def daily_bars(payload: DataFrame) -> DataFrame:
    """Bars with short or long field names; adjusted prices fall back to raw ones; rows without a date go."""
    required(payload, ("Code", "code"), ("Date", "date"))
    raw = {"open": ["O", "Open"], "high": ["H", "High"], "low": ["L", "Low"], "close": ["C", "Close"], "volume": ["Vo", "Volume"], "turnover_value": ["Va", "TurnoverValue"]}
    adj = {f"adj_{k}": [f"Adj{v[0]}", f"Adjustment{v[1]}"] for k, v in raw.items() if k != "turnover_value"}
    cols = {"ticker": first_present(payload, ["Code", "code"]), "session": F.to_date(first_present(payload, ["Date", "date"]))}
    cols |= {k: first_present(payload, v, "double") for k, v in raw.items()}
    cols |= {k: F.coalesce(first_present(payload, v, "double"), cols[k.removeprefix("adj_")]) for k, v in adj.items()}
    return payload.select(*[c.alias(k) for k, c in cols.items()]).filter("session IS NOT NULL")


def _code(payload: DataFrame, *names: str) -> Column:
    return F.trim(first_present(payload, names))


def listed(payload: DataFrame, as_of: str) -> DataFrame:
    """The list of securities: name falls back to the code, one row a code, valid from the day of the list."""
    required(payload, ("Code",))
    code = _code(payload, "Code")
    name = F.nullif(F.nullif(F.trim(first_present(payload, ["CoName", "CompanyName"])), F.lit("")), F.lit("<NA>"))
    text = {"exchange": ["MktNm", "MarketCodeName"], "name_en": ["CoNameEn", "CompanyNameEnglish"], "sector_code": ["S33", "Sector33Code"], "sector_name": ["S33Nm", "Sector33CodeName"], "industry_name": ["S17Nm", "Sector17CodeName"], "product_category": ["ProdCat", "ProductCategory"]}
    return payload.select(code.alias("ticker"), F.lit("JP").alias("market"), F.coalesce(name, code).alias("name_local"), *[first_present(payload, v).alias(k) for k, v in text.items()], F.lit("JPY").alias("currency"), F.lit(as_of).cast("date").alias("valid_from"), F.lit(True).alias("is_active"))


def statements(payload: DataFrame) -> DataFrame:
    """Statements with short or long field names. Periods after the first are cumulative, the fourth is the year; rows without
    a period's end or a disclosure date go."""
    period = F.upper(F.trim(F.coalesce(F.nullif(F.trim(first_present(payload, ["CurPerType", "TypeOfCurrentPeriod"])), F.lit("")), F.lit("FY"))))
    numbers = {
        "revenue": ["Sales", "NetSales"], "operating_income": ["OP", "OperatingProfit"], "ordinary_income": ["OdP", "OrdinaryProfit"], "net_income": ["NP", "Profit"], "eps": ["EPS", "EarningsPerShare"], "total_assets": ["TA", "TotalAssets"],
        "total_equity": ["Eq", "Equity"], "operating_cf": ["CFO", "CashFlowsFromOperatingActivities"], "investing_cf": ["CFI", "CashFlowsFromInvestingActivities"], "financing_cf": ["CFF", "CashFlowsFromFinancingActivities"],
        "cash_and_equiv": ["CashEq", "CashAndEquivalents"], "dividend_per_share": ["DivAnn", "ResultDividendPerShareAnnual"], "bps": ["BPS", "BookValuePerShare"],
        "forecast_revenue": ["FSales", "ForecastNetSales"], "forecast_op_income": ["FOP", "ForecastOperatingProfit"], "forecast_net_income": ["FNP", "ForecastProfit"], "forecast_eps": ["FEPS", "ForecastEarningsPerShare"],
    }
    date = lambda *n: F.to_date(first_present(payload, n))
    mapped = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PERIODS.items() for x in kv]), period), period)
    rows = payload.select(
        _code(payload, "Code", "LocalCode").alias("ticker"), date("CurPerEn", "CurrentPeriodEndDate").alias("period_end"), date("DiscDate", "DisclosedDate").alias("filed_at"), F.year(date("CurFYEn", "CurrentFiscalYearEndDate")).alias("fiscal_year"),
        mapped.alias("fiscal_period"), F.when(period.isin("FY", "4Q"), "annual").when(period == "1Q", "quarter").otherwise("cumulative").alias("period_type"), *[first_present(payload, v, "double").alias(k) for k, v in numbers.items()],
    )
    return rows.filter("period_end IS NOT NULL AND filed_at IS NOT NULL")


def registrants(payload: DataFrame, as_of: str) -> DataFrame:
    """Companies from a map of numbered objects in column ``companies``: the central key has ten digits."""
    c = payload.select(F.explode(F.map_values("companies")).alias("c"))
    cik = F.col("c.cik_str").cast("string")
    return c.select(F.col("c.ticker").cast("string").alias("ticker"), F.lit("US").alias("market"), F.col("c.title").alias("name_en"), F.lpad(cik, 10, "0").alias("cik"), F.lit(as_of).cast("date").alias("valid_from"))


def filings_list(payload: DataFrame, batch_date: str) -> DataFrame:
    """Filings with their type, whether they amend one, a filing time (the batch's date if there is none) and a title (the
    id if it is blank)."""
    required(payload, "docID")
    code = first_present(payload, ["docTypeCode"])
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FILING_TYPES.items() for x in kv]), code), F.lit("other_disclosure"))
    doc_id = F.concat(F.lit("edinet:"), F.col("docID").cast("string"))
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    filed = F.coalesce(first_present(payload, ["submitDateTime"], "timestamp"), F.lit(batch_date).cast("timestamp"))
    security = F.left(F.trim(first_present(payload, ["secCode"])), F.lit(4))
    return payload.select(
        doc_id.alias("doc_id"), F.nullif(security, F.lit("")).alias("ticker"), blank(first_present(payload, ["filerName"])).alias("name_local"), kind.alias("doc_type"), F.coalesce(blank(first_present(payload, ["docDescription"])), doc_id).alias("title"),
        first_present(payload, ["periodEnd"], "date").alias("period_end"), filed.alias("filed_at"), F.coalesce(code.isin(*AMENDMENTS), F.lit(False)).alias("is_amendment"),
    )


def disclosures(payload: DataFrame, batch_date: str) -> DataFrame:
    """Disclosures with an id of the batch's date and a number of at least four digits, and the type of their title. A missing
    number counts as 0, a missing title as the empty one."""
    number = padded(F.coalesce(first_present(payload, ["seq"], "long"), F.lit(0)).cast("string"), 4)
    title = F.coalesce(first_present(payload, ["title"]), F.lit(""))
    return payload.select(
        F.concat(F.lit(f"tdnet:{batch_date.replace('-', '')}-"), number).alias("doc_id"), F.left(F.trim(first_present(payload, ["code"])), F.lit(4)).alias("ticker"), first_present(payload, ["company_name", "name"]).alias("name_local"),
        title_type(title).alias("doc_type"), title.alias("title"), first_present(payload, ["disclosed_at"], "timestamp").alias("filed_at"),
    )


def live_frame(bars: DataFrame) -> DataFrame:
    """Adds change and change_pct against the ticker's bar before."""
    prev = F.lag("close").over(Window.partitionBy("ticker").orderBy("session"))
    return bars.withColumns({"change": F.col("close") - prev, "change_pct": F.try_divide("close", prev) - 1})


def adjusted(bars: DataFrame) -> DataFrame:
    """Adjusted open, high and low by adj_close / close (1 where close is 0 or less), and turnover."""
    f = F.when(F.col("close") > 0, F.col("adj_close") / F.col("close")).otherwise(1.0)
    return bars.withColumns({"adjustment_factor": f, **{f"adj_{c}": F.col(c) * f for c in ("open", "high", "low")}, "turnover_value": F.col("close") * F.col("volume")})


def observations(payload: DataFrame, revised: bool) -> DataFrame:
    """series_id, observation_date, vintage_date, value; a dot is null, a series that is not revised has its own date as vintage."""
    vintage = F.coalesce(F.col("realtime_start").try_cast("date"), F.col("fetched_at").try_cast("date")) if revised else F.col("date").try_cast("date")
    return payload.select("series_id", F.col("date").try_cast("date").alias("observation_date"), vintage.alias("vintage_date"), F.nullif("value", F.lit(".")).try_cast("double").alias("value"))


def parallel_rows(payload: DataFrame, arrays: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Parallel arrays to rows, by position."""
    return payload.select(*keep, F.explode(F.arrays_zip(*arrays)).alias("_r")).select(*keep, *[F.col("_r")[a].alias(a) for a in arrays])


def facts_wide(facts: DataFrame, tags: dict[str, Sequence[str]], keys: Sequence[str], tag: str = "tag", value: str = "value", order: str = "filed") -> DataFrame:
    """Long facts to one row a key: for each column the first tag that is there, and of its values the first filed."""
    pairs = [(c, t, i) for c, ts in tags.items() for i, t in enumerate(ts)]
    lookup = F.create_map(*[x for c, t, i in pairs for x in (F.lit(t), F.struct(F.lit(c).alias("c"), F.lit(i).alias("i")))])
    rows = facts.withColumn("_t", F.try_element_at(lookup, F.col(tag))).filter("_t IS NOT NULL AND " + f"{value} IS NOT NULL")
    w = Window.partitionBy(*keys, "_t.c").orderBy("_t.i", order, value)
    rows = rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1")
    return rows.groupBy(*keys).pivot("_t.c", list(tags)).agg(F.first(value))


def title_type(title: Column) -> Column:
    out = F.lit("other_disclosure")
    for name, pattern in reversed(TITLE_RULES):
        out = F.when(F.coalesce(title, F.lit("")).rlike(pattern), name).otherwise(out)
    return out


def masked(text: Column) -> Column:
    """URL credentials and key parameters hidden."""
    text = F.regexp_replace(text, r"://[^/@\s:]+:[^/@\s]+@", "://***:***@")
    return F.regexp_replace(text, r"(?i)([?&](?:api_?key|token|access_token|subscription-key)=)[^&\s]+", "$1***")


# Keys that say what somebody owns; a part of the whole in percent is allowed.
SENSITIVE = ("quantity", "qty", "shares", "avg_cost", "average_cost", "acquisition_price", "market_value", "position_value", "total_assets", "cash", "cash_balance", "nisa", "account_type", "unrealized_pnl")


def sensitive_fields(df: DataFrame) -> list[str]:
    """Paths of fields whose whole name, in any case, is a sensitive key; structures in arrays and in maps are looked into."""
    found: list[str] = []

    def walk(kind: DataType, path: str) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                at = f"{path}.{f.name}" if path else f.name
                if f.name.lower() in SENSITIVE:
                    found.append(at)
                walk(f.dataType, at)
        elif isinstance(kind, ArrayType):
            walk(kind.elementType, f"{path}[]")
        elif isinstance(kind, MapType):
            walk(kind.valueType, f"{path}{{}}")

    walk(df.schema, "")
    return found


def sensitive_keys(json_text: Column) -> Column:
    """The sensitive keys, lower-cased and in order, that a JSON text has at any depth; a null or a text that is no JSON has none.

    Keys are strings that a colon follows; an escaped quote does not end one."""
    keys = F.transform(F.regexp_extract_all(json_text, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), 1), F.lower)
    return F.array_sort(F.array_intersect(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, SENSITIVE))))


def redacted_positions(positions: DataFrame, *keys: str) -> DataFrame:
    """Each position's part of its portfolio and its gain, both in percent with one digit: what may leave. ``keys`` tell
    portfolios apart. Missing values count as 0; a portfolio worth 0 has parts of its values themselves."""
    value = F.coalesce(F.col("market_value").cast("double"), F.lit(0.0))
    total = F.sum(value).over(Window.partitionBy(*keys)) if keys else None
    if total is None:
        whole = positions.agg(F.sum(value).alias("_total"))
        positions, total = positions.join(F.broadcast(whole)), F.col("_total")
    weight = value / F.when(total != 0, total).otherwise(1.0) * 100
    gain = F.coalesce(F.col("unrealized_pnl_pct").cast("double"), F.lit(0.0))
    return positions.select(*keys, "ticker", F.round(weight, 1).alias("weight_pct"), F.round(gain, 1).alias("unrealized_pnl_pct"))
