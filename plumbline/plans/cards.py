"""Queries of screens, gates, codes, reviews and feeds, over scores made of customers' keys and balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.operators import advice as A
from plumbline.plans.adapter import query, r6, table

# Expressions that both engines read; k is the customer's key.
SCORE = {
    "value_z": "c_acctbal / 2500e0 - 1.5e0", "momentum_z": "((k * 37) % 101) / 20e0 - 2.5e0", "quality_z": "((k * 53) % 97) / 20e0 - 2.4e0", "lowvol_z": "((k * 59) % 97) / 20e0 - 2.4e0",
    "price_to_52w_high": "((k * 11) % 101) / 100e0", "dist_from_ma200": "((k * 7) % 100 - 50) / 100e0", "roic": "CASE WHEN k % 6 <> 0 THEN ((k * 13) % 40) / 100e0 END", "debt_to_equity": "((k * 17) % 100) / 100e0",
    "accruals_ratio": "((k * 19) % 100 - 50) / 500e0", "forecast_revision_direction": "CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 0 END", "vol_percentile": "((k * 23) % 100) / 100e0",
    "fx_sensitivity_60d": "((k * 29) % 100 - 50) / 50e0", "fx_view_sign": "k % 3 - 1", "guidance_tone": "CASE WHEN k % 5 = 0 THEN 'positive' ELSE 'neutral' END", "has_new_risk": "k % 17 = 0", "growth_accelerating": "k % 8 = 0",
    "days_to_earnings": "k % 30 - 3", "data_lag_business_days": "k % 6", "model_ic_percentile": "((k * 3) % 100) / 100e0", "per_percentile_5y": "((k * 43) % 100) / 100e0", "dividend_yield": "((k * 47) % 80) / 1000e0",
    "revenue_growth_yoy": "((k * 61) % 100 - 40) / 100e0", "eps_growth_yoy": "((k * 67) % 100 - 40) / 100e0", "adv_20d": "CASE WHEN k % 9 <> 0 THEN k * 1e3 END", "market_cap": "k * 1e5", "sector_code": "c_mktsegment",
    "close": "CASE WHEN k % 10 <> 0 THEN c_acctbal END", "product_category": "CASE WHEN k % 7 = 0 THEN '013' WHEN k % 7 < 5 THEN '011' END", "n_missing": "k % 25", "total_score": "((k * 31) % 1000) / 10e0",
    "quant_score": "((k * 31) % 1000) / 10e0", "ml_pred_h20": "CASE WHEN k % 12 <> 0 THEN ((k * 41) % 100 - 45) / 500e0 END", "ml_pred_h20_lo": "CASE WHEN k % 15 <> 0 THEN ((k * 41) % 100 - 90) / 500e0 END", "ml_pred_h20_hi": "((k * 41) % 100 + 10) / 500e0",
    "quant_percentile": "((k * 71) % 100) / 100e0", "realized_vol_60d": "((k * 73) % 100) / 100e0", "held": "k % 3 = 0", "watched": "k % 2 = 0", "n_prior_samples": "CASE WHEN k % 11 <> 0 THEN (k * 5) % 60 END", "high_vol": "k % 4 = 0", "conviction_score": "((k * 79) % 110) / 100e0",
}
SC = f"c AS (SELECT *, c_custkey AS k FROM customer), sc AS (SELECT k, DATE '1999-01-01' + (k % 400)::INT AS listing_date, {', '.join(f'{e} AS {c}' for c, e in SCORE.items())} FROM c)"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("k", F.col("c_custkey"))
    listed = F.date_add(F.lit("1999-01-01").cast("date"), (F.col("k") % 400).cast("int"))
    return c.select("k", listed.alias("listing_date"), *[F.expr(e).alias(x) for x, e in SCORE.items()])


def _range(c: str, low: float | None, high: float | None) -> str:
    return " AND ".join([f"{c} IS NOT NULL", *([f"{c} >= {low}"] if low is not None else []), *([f"{c} <= {high}"] if high is not None else [])])


@query("screen_presets", f"WITH {SC} " + " UNION ALL ".join(f"(SELECT '{name}' AS preset, k FROM sc WHERE {' AND '.join(_range(c, *r) for c, r in ranges.items())} ORDER BY k LIMIT 500)" for name, ranges in A.PRESETS.items()))
def screen_presets(spark: SparkSession, sf: str) -> DataFrame:
    s, out = scores(spark, sf), None
    for name in A.PRESETS:
        one = A.preset(s, name, [F.col("k")]).select(F.lit(name).alias("preset"), "k")
        out = one if out is None else out.unionByName(one)
    return out


_UNIVERSE = "adv_20d >= 50000 AND market_cap >= 1e6 AND sector_code NOT IN ('MACHINERY') AND close <= 9000 AND coalesce(product_category = '011', true) AND n_missing <= 15 AND DATE '2000-01-01' - listing_date >= 250"


@query("universe", f"WITH {SC} SELECT k FROM sc WHERE {_UNIVERSE}")
def universe(spark: SparkSession, sf: str) -> DataFrame:
    s = scores(spark, sf)
    return s.filter(A.universe(s, 50_000, 1e6, ["MACHINERY"], 9000, as_of="2000-01-01")).select("k")


@query("masked_universe", f"WITH {SC} SELECT k FROM sc")
def masked_universe(spark: SparkSession, sf: str) -> DataFrame:
    """Nothing is worth so much: the mask does not count."""
    s = scores(spark, sf)
    return A.masked_universe(s, A.universe(s, min_cap=1e15)).select("k")


@query("strict_gate", f"WITH {SC} SELECT k FROM sc WHERE quant_percentile >= 0.85 AND ml_pred_h20 > 0 AND ml_pred_h20_lo > -0.05")
def strict_gate(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).filter(A.strict_gate()).select("k")


_CODES = {
    "VAL_CHEAP_VS_SECTOR": "value_z >= 1", "VAL_CHEAP_VS_HISTORY": "per_percentile_5y <= 0.2", "MOM_STRONG_12M": "momentum_z >= 1", "MOM_NEAR_52W_HIGH": "price_to_52w_high >= 0.95", "MOM_ABOVE_MA200": "dist_from_ma200 > 0",
    "QLT_HIGH_ROIC": "roic >= 0.12 AND quality_z >= 0.5", "QLT_LOW_LEVERAGE": "debt_to_equity <= 0.3", "QLT_CLEAN_ACCRUALS": "accruals_ratio <= 0", "GRW_ACCELERATING": "growth_accelerating", "REV_UP_GUIDANCE": "forecast_revision_direction = 1",
    "REV_DOWN_GUIDANCE": "forecast_revision_direction = -1", "VOL_LOW_REGIME": "vol_percentile <= 0.3", "FX_TAILWIND": "fx_sensitivity_60d * fx_view_sign > 0", "FX_HEADWIND": "fx_sensitivity_60d * fx_view_sign < 0",
    "LLM_POSITIVE_GUIDANCE": "guidance_tone = 'positive'", "LLM_NEW_RISK_DISCLOSED": "has_new_risk", "EVENT_EARNINGS_SOON": "days_to_earnings BETWEEN 0 AND 5", "DATA_STALE": "data_lag_business_days >= 3", "MODEL_LOW_CONFIDENCE": "model_ic_percentile <= 0.1",
}
_CODE_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _CODES.items()) + "], lambda x: x IS NOT NULL), ',')"


@query("reason_codes", f"WITH {SC} SELECT k, {_CODE_SQL} AS codes FROM sc")
def reason_codes(spark: SparkSession, sf: str) -> DataFrame:
    s = scores(spark, sf)
    return s.select("k", F.array_join(A.reason_codes(s), ",").alias("codes"))


_ACTION = "CASE WHEN held AND total_score <= 35 THEN 'reduce' WHEN total_score >= 75 AND ml_pred_h20 > 0.02 THEN CASE WHEN held THEN 'accumulate' ELSE 'watch' END WHEN NOT held AND total_score <= 25 AND watched THEN 'avoid' END"


@query("actions", f"WITH {SC} SELECT k, {_ACTION} AS action FROM sc")
def actions(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).select("k", A.action(F.col("total_score"), F.col("ml_pred_h20"), F.col("held"), F.col("watched")).alias("action"))


@query("conviction", f"""WITH {SC}, l AS (SELECT k, CASE WHEN coalesce(n_prior_samples, 0) < 20 THEN 0 WHEN conviction_score >= 0.7 THEN 2 WHEN conviction_score >= 0.45 THEN 1 ELSE 0 END AS l, (realized_vol_60d > 0.6)::INT + high_vol::INT AS d FROM sc)
  SELECT k, CASE greatest(l - d, 0) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS conviction FROM l""")
def conviction(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).select("k", A.conviction(F.col("conviction_score"), F.col("n_prior_samples"), F.col("realized_vol_60d"), F.col("high_vol")).alias("conviction"))


_BOTH = "ml_pred_h20_lo IS NOT NULL AND ml_pred_h20_hi IS NOT NULL"


@query("intervals", f"WITH {SC} SELECT k, round(CASE WHEN {_BOTH} THEN ml_pred_h20_lo ELSE coalesce(ml_pred_h20, 0) - coalesce(realized_vol_60d * sqrt(20 / 252.0), 0.2) END, 6) AS low, round(CASE WHEN {_BOTH} THEN ml_pred_h20_hi ELSE coalesce(ml_pred_h20, 0) + coalesce(realized_vol_60d * sqrt(20 / 252.0), 0.2) END, 6) AS high FROM sc")
def intervals(spark: SparkSession, sf: str) -> DataFrame:
    low, high = A.interval(F.col("ml_pred_h20"), F.col("ml_pred_h20_lo"), F.col("ml_pred_h20_hi"), F.col("realized_vol_60d"))
    return scores(spark, sf).select("k", r6(low).alias("low"), r6(high).alias("high"))


# Cards of recommendations: texts and lists of several lengths.
_CARD = {
    "bear_case": "CASE k % 5 WHEN 0 THEN 'short' WHEN 1 THEN 'リスクは限定的であり、市場環境の悪化のみが懸念されると考えられる。' WHEN 2 THEN 'リスクは限定的だが売上が12%減る恐れがあり、利益率も下がり得る。' WHEN 3 THEN 'Margins may fall if input costs rise by 10%.' END",
    "thesis": "CASE k % 6 WHEN 0 THEN '必ず上がる' WHEN 1 THEN '  ' WHEN 2 THEN 'cheap' WHEN 3 THEN '確実に伸びる' ELSE 'steady growth' END", "invalidation": "CASE WHEN k % 8 <> 0 THEN 'falls below 100' END",
    "expected_ret_lo": "CASE WHEN k % 9 <> 0 THEN -0.05e0 END", "expected_ret_hi": "CASE WHEN k % 7 = 0 THEN -0.045e0 ELSE 0.1e0 END", "conviction": "CASE k % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END",
    "n_prior_samples": "CASE WHEN k % 11 <> 0 THEN (k * 5) % 60 END", "hit_rate_prior": "CASE WHEN k % 13 <> 0 THEN 0.5e0 END", "conviction_score": "((k * 79) % 110) / 100e0", "citation_missing": "k % 19 = 0", "data_lag_days": "k % 8",
    "entry_ref_source": "CASE WHEN k % 10 = 0 THEN 'jquants' ELSE 'other' END", "revised_thesis": "CASE WHEN k % 4 = 0 THEN ' revised ' WHEN k % 4 = 1 THEN ' ' END", "revised_conviction": "CASE k % 3 WHEN 0 THEN 'medium' WHEN 1 THEN 'sure' END",
}
CARDS = f"c AS (SELECT *, c_custkey AS k FROM customer), cards AS (SELECT k, DATE '2000-01-10' AS as_of, DATE '1999-12-20' + (k % 30)::INT AS latest_cited, {', '.join(f'{e} AS {c}' for c, e in _CARD.items())} FROM c)"


def cards(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("k", F.col("c_custkey"))
    day = F.date_add(F.lit("1999-12-20").cast("date"), (F.col("k") % 30).cast("int"))
    lists = {n: F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("k") % m).cast("int")) for n, m in (("source_doc_ids", 3), ("citations", 2))}
    return c.select("k", F.lit("2000-01-10").cast("date").alias("as_of"), day.alias("latest_cited"), *[F.expr(e).alias(x) for x, e in _CARD.items()], *[e.alias(n) for n, e in lists.items()])


_VIOLATIONS = {"bear_case": "coalesce(length(bear_case) < 20, true)", "sources": "k % 3 = 0", "citations": "k % 2 = 0", "interval": "expected_ret_lo IS NULL OR expected_ret_hi IS NULL", "thesis": "trim(thesis) = ''", "invalidation": "invalidation IS NULL", "conviction": "conviction_score > 1"}


@query("invariants", f"WITH {CARDS} SELECT k, array_to_string(list_filter([{', '.join(f'CASE WHEN {e} THEN {chr(39)}{n}{chr(39)} END' for n, e in _VIOLATIONS.items())}], lambda x: x IS NOT NULL), ',') AS violations, CASE WHEN hit_rate_prior IS NULL OR coalesce(n_prior_samples < 20, true) THEN 'low' ELSE conviction END AS conviction FROM cards")
def invariants(spark: SparkSession, sf: str) -> DataFrame:
    c = cards(spark, sf).withColumn("n_prior_samples", F.coalesce("n_prior_samples", F.lit(0)))
    return A.invariants(c).select("k", F.array_join("violations", ",").alias("violations"), "conviction")


_MAJOR = ["data_lag_days > 3", "length(coalesce(bear_case, '')) >= 20 AND (" + " OR ".join(f"contains(bear_case, '{p}')" for p in A.BOILERPLATE) + ") AND NOT regexp_matches(bear_case, '[0-9]')", "conviction <> 'low' AND coalesce(n_prior_samples, 0) < 20", "expected_ret_hi - expected_ret_lo < 0.01", " OR ".join(f"contains(thesis, '{w}')" for w in A.OVERCONFIDENT)]
_CRITICAL = ["citation_missing", "entry_ref_source = 'jquants'", "length(coalesce(bear_case, '')) < 20", "expected_ret_lo IS NULL OR expected_ret_hi IS NULL", "latest_cited > as_of"]


@query("reviews", f"""WITH {CARDS}, n AS (SELECT k, {' + '.join(f'coalesce(({e})::INT, 0)' for e in _CRITICAL)} AS critical, {' + '.join(f'coalesce(({e})::INT, 0)' for e in _MAJOR)} AS major FROM cards)
  SELECT k, critical + major AS n_issues, CASE WHEN critical > 0 OR major >= 2 THEN 'rejected' WHEN major = 1 THEN 'revised' ELSE 'approved' END AS verdict FROM n""")
def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return A.review(cards(spark, sf), "free").select("k", F.size("issues").alias("n_issues"), "verdict")


@query("revised_cards", f"""WITH {CARDS} SELECT k, coalesce(nullif(trim(revised_thesis), ''), thesis) AS thesis, CASE WHEN revised_conviction = 'medium' THEN CASE WHEN coalesce(n_prior_samples, 0) < 20 THEN 'low' ELSE 'medium' END ELSE conviction END AS conviction FROM cards""")
def revised_cards(spark: SparkSession, sf: str) -> DataFrame:
    return A.revised(cards(spark, sf), ("thesis", "conviction")).select("k", "thesis", "conviction")


@query("feed_filtered", f"""WITH {SC}, f AS (SELECT *, k % 4 = 0 AS has_card, {_CODE_SQL} AS codes FROM sc) SELECT k FROM f WHERE contains(sector_code, 'BUILD') AND coalesce(total_score, quant_score) >= 40 AND (contains(codes, 'MOM_STRONG_12M') OR contains(codes, 'QLT_HIGH_ROIC')) AND sign(ml_pred_h20) = 1 AND has_card AND fx_view_sign IN (0, 1)""")
def feed_filtered(spark: SparkSession, sf: str) -> DataFrame:
    s = scores(spark, sf)
    s = s.withColumns({"reason_codes": A.reason_codes(s), "has_card": F.col("k") % 4 == 0, "sector": F.col("sector_code")})
    return s.filter(A.feed_filter("BUILD", 40, ["MOM_STRONG_12M", "QLT_HIGH_ROIC"], 1, True, {"fx_view_sign": [0, 1]})).select("k")


@query("highlights", f"""WITH {SC} SELECT k AS rec_id, row_number() OVER (ORDER BY CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END, CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, total_score DESC NULLS LAST, k) AS position FROM sc QUALIFY position <= 10""")
def highlights(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    s = scores(spark, sf).select(k.alias("rec_id"), F.when(k % 5 == 0, "core").otherwise("fill").alias("candidate_tier"), F.when(k % 3 == 0, "approved").when(k % 3 == 1, "revised").alias("verdict"), F.col("total_score").alias("score"))
    order = F.row_number().over(Window.orderBy(A.ranked(("core", "fill"), F.col("candidate_tier")), A.ranked(("approved", "revised"), F.col("verdict")), F.col("score").desc_nulls_last(), "rec_id"))
    return A.highlights(s).select("rec_id", order.cast("long").alias("position"))


@query("preferred_horizon", "SELECT o_custkey AS ticker, o_orderkey AS rec_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '3-MEDIUM' THEN 0 WHEN o_orderpriority = 'H20' THEN 1 ELSE 3 END, o_orderpriority || o_orderkey::VARCHAR) = 1")
def preferred_horizon(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("rec_id"), F.col("o_orderpriority").alias("horizon"))
    named = o.withColumn("horizon", F.when(F.col("horizon") == "3-MEDIUM", "H20").otherwise(F.col("horizon"))).withColumn("horizon", F.when(F.col("horizon") == "H20", "H20").otherwise(F.concat("horizon", F.col("rec_id").cast("string"))))
    first = named.filter("horizon = 'H20'").groupBy("ticker").agg(F.min(F.struct(F.col("rec_id").cast("string"), "rec_id")).alias("m")).select("ticker", F.col("m.rec_id").alias("rec_id"), F.lit("H20").alias("horizon"))
    return A.preferred_horizon(named.filter("horizon <> 'H20'").unionByName(first), ["ticker"], "H10").select("ticker", "rec_id")


_WEIGHTS = {"1-URGENT": 1.0, "2-HIGH": 0.9, "3-MEDIUM": 0.8}


@query("qualitative", """WITH s AS (SELECT o_custkey AS ticker, greatest(DATE '2001-12-31' - o_orderdate::DATE, 0) AS age, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.9 WHEN '3-MEDIUM' THEN 0.8 ELSE 0.3 END::DOUBLE AS tw, least((o_orderkey % 6) / 3.0::DOUBLE, 1.5) AS ew, o_totalprice / 250000 - 1 AS s FROM orders),
  w AS (SELECT ticker, s, age, pow(0.5, age / 90.0::DOUBLE) * tw * ew AS w FROM s), a AS (SELECT ticker, sum(w * s) AS ws, sum(w) AS w, avg(s) AS m, stddev_pop(s) AS sd, min(age) AS age, count(*) AS n FROM w GROUP BY 1)
  SELECT ticker, round(greatest(-1, least(1, coalesce(ws / nullif(w, 0), m))), 6) AS score, round(least(0.3 * least(n / 3.0::DOUBLE, 1) + 0.4 * pow(0.5, age / 60.0::DOUBLE) + 0.3 * (1 - least(sd / 2, 1)), 1), 6) AS confidence, n AS doc_count FROM a""")
def qualitative(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderdate").alias("filed_at"), F.col("o_orderpriority").alias("doc_type"), (F.col("o_orderkey") % 6).alias("n_citations"), (F.col("o_totalprice") / 250000 - 1).alias("qualitative_score"))
    return A.qualitative(s, "2001-12-31", _WEIGHTS).select("ticker", r6("score").alias("score"), r6("confidence").alias("confidence"), "doc_count")


@query("memories", f"""WITH {SC}, m AS (SELECT k AS memory_id, CASE k % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'market:JP' WHEN 2 THEN 'sector:' || sector_code ELSE 'ticker:' || k END AS scope, k % 5 <> 0 AS active, conviction_score AS confidence, k % 40 AS n FROM sc)
  SELECT memory_id FROM m WHERE scope IN ('global', 'market:JP', 'sector:BUILDING', 'ticker:7') AND active AND confidence >= 0.6 AND n >= 10 ORDER BY confidence DESC, memory_id LIMIT 15""")
def memories(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    scope = F.when(k % 4 == 0, "global").when(k % 4 == 1, "market:JP").when(k % 4 == 2, F.concat(F.lit("sector:"), "sector_code")).otherwise(F.concat(F.lit("ticker:"), k))
    m = scores(spark, sf).select(k.alias("memory_id"), scope.alias("scope"), (k % 5 != 0).alias("active"), F.col("conviction_score").alias("confidence"), (k % 40).alias("n"))
    return A.memories(m, "JP", "BUILDING", "7").select("memory_id")


@query("signals", f"WITH {SC} SELECT DATE '2000-01-10' AS as_of, k AS ticker, round(total_score, 6) AS score FROM sc")
def signals(spark: SparkSession, sf: str) -> DataFrame:
    s = scores(spark, sf).select(F.lit("2000-01-10").cast("date").alias("as_of"), F.col("k").alias("ticker"), "total_score", "quant_score")
    return A.signals(s).withColumn("score", r6("score"))
