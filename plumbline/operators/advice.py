"""Recommendations: gates, reason codes, actions, conviction, invariants, reviews and cards."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.expressions import clip, ratio
from plumbline.operators.scoring import capped_top, overlay

# Ranges (low, high) of the named screens; either end may be open.
PRESETS: dict[str, dict[str, tuple[float | None, float | None]]] = {
    "value_quality": {"value_z": (1.0, None), "quality_z": (0.5, None), "roic": (0.10, None)},
    "upward_revision_momentum": {"forecast_revision_direction": (1, 1), "momentum_z": (0.5, None)},
    "weak_yen_beneficiary": {"fx_sensitivity_60d": (0.3, None)},
    "strong_yen_beneficiary": {"fx_sensitivity_60d": (None, -0.3)},
    "low_vol_dividend": {"lowvol_z": (0.5, None), "dividend_yield": (0.03, None)},
    "high_growth": {"revenue_growth_yoy": (0.15, None), "eps_growth_yoy": (0.15, None)},
    "value_trap_warning": {"value_z": (1.5, None), "quality_z": (None, -0.5)},
}
MOST_ROWS = 500
COMMON_STOCK = "011"
CONVICTIONS = ("low", "medium", "high")
LEAST_PRIOR = 20
# Phrases of a review.
BOILERPLATE = ("市場環境の悪化", "予想外の事態", "リスクは限定的", "特にありません", "一般的なリスク", "マクロ環境の変化", "地政学リスク")
OVERCONFIDENT = ("必ず", "確実に", "間違いなく")


def preset(df: DataFrame, name: str, order: Sequence[Column]) -> DataFrame:
    """Rows inside all closed ranges of a named screen, the first 500 in ``order``; nulls fail; none if a column is absent."""
    ranges = PRESETS[name]
    if not set(ranges) <= set(df.columns):
        return df.limit(0)
    for c, (low, high) in ranges.items():
        df = df.filter(F.col(c).isNotNull() & (F.lit(True) if low is None else F.col(c) >= low) & (F.lit(True) if high is None else F.col(c) <= high))
    return df.orderBy(*order).limit(MOST_ROWS)


def universe(
    df: DataFrame, min_adv: float | None = None, min_cap: float | None = None, without_sectors: Sequence[str] = (), max_price: float | None = None,
    common_only: bool = True, most_missing: int | None = 15, listed_days: int = 250, as_of: dt.date | str | None = None,
) -> Column:
    """Whether a row belongs to the universe. A condition whose column is absent does not count; an unknown traded value,
    size, price or number of missing features fails; an unknown product category or listing date passes."""
    has = set(df.columns)
    tests = {
        "adv_20d": F.col("adv_20d") >= min_adv if min_adv is not None else None,
        "market_cap": F.col("market_cap") >= min_cap if min_cap is not None else None,
        "sector_code": ~F.coalesce(F.col("sector_code").isin(list(without_sectors)), F.lit(False)) if without_sectors else None,
        "close": F.col("close") <= max_price if max_price is not None else None,
        "product_category": F.coalesce(F.col("product_category") == COMMON_STOCK, F.lit(True)) if common_only else None,
        "n_missing": F.col("n_missing") <= most_missing if most_missing is not None else None,
        "listing_date": F.coalesce(F.datediff(F.lit(str(as_of)).cast("date"), "listing_date") >= listed_days, F.lit(True)) if as_of is not None and listed_days else None,
    }
    out = F.lit(True)
    for c, test in tests.items():
        if test is not None and c in has:
            out = out & F.coalesce(test, F.lit(False))
    return out


def masked_universe(df: DataFrame, mask: Column) -> DataFrame:
    """Rows of the universe, or all rows if none belongs to it. Whether any does comes from an aggregate of one row."""
    x = df.withColumn("_in", mask)
    found = x.agg(F.coalesce(F.max("_in"), F.lit(False)).alias("_any"))
    return x.join(F.broadcast(found)).filter("_in OR NOT _any").drop("_in", "_any")


def strict_gate(percentile: str = "quant_percentile", forecast: str = "ml_pred_h20", low: str = "ml_pred_h20_lo") -> Column:
    return F.coalesce((F.col(percentile) >= 0.85) & (F.col(forecast) > 0) & (F.col(low) > -0.05), F.lit(False))


def reason_codes(df: DataFrame) -> Column:
    """The codes whose conditions hold, in their order; absent columns and nulls give none."""
    has = set(df.columns)

    def code(name: str, condition: Column, *needs: str) -> Column | None:
        return F.when(condition, name) if set(needs) <= has else None

    c = F.col
    pull = c("fx_sensitivity_60d") * c("fx_view_sign")
    made = [
        code("VAL_CHEAP_VS_SECTOR", c("value_z") >= 1.0, "value_z"),
        code("VAL_CHEAP_VS_HISTORY", c("per_percentile_5y") <= 0.20, "per_percentile_5y"),
        code("MOM_STRONG_12M", c("momentum_z") >= 1.0, "momentum_z"),
        code("MOM_NEAR_52W_HIGH", c("price_to_52w_high") >= 0.95, "price_to_52w_high"),
        code("MOM_ABOVE_MA200", c("dist_from_ma200") > 0, "dist_from_ma200"),
        code("QLT_HIGH_ROIC", (c("roic") >= 0.12) & (c("quality_z") >= 0.5), "roic", "quality_z"),
        code("QLT_LOW_LEVERAGE", c("debt_to_equity") <= 0.3, "debt_to_equity"),
        code("QLT_CLEAN_ACCRUALS", c("accruals_ratio") <= 0, "accruals_ratio"),
        code("GRW_ACCELERATING", c("growth_accelerating"), "growth_accelerating"),
        code("REV_UP_GUIDANCE", c("forecast_revision_direction") == 1, "forecast_revision_direction"),
        code("REV_DOWN_GUIDANCE", c("forecast_revision_direction") == -1, "forecast_revision_direction"),
        code("VOL_LOW_REGIME", c("vol_percentile") <= 0.30, "vol_percentile"),
        code("FX_TAILWIND", pull > 0, "fx_sensitivity_60d", "fx_view_sign"),
        code("FX_HEADWIND", pull < 0, "fx_sensitivity_60d", "fx_view_sign"),
        code("LLM_POSITIVE_GUIDANCE", c("guidance_tone") == "positive", "guidance_tone"),
        code("LLM_NEW_RISK_DISCLOSED", c("has_new_risk"), "has_new_risk"),
        code("EVENT_EARNINGS_SOON", c("days_to_earnings").between(0, 5), "days_to_earnings"),
        code("DATA_STALE", c("data_lag_business_days") >= 3, "data_lag_business_days"),
        code("MODEL_LOW_CONFIDENCE", c("model_ic_percentile") <= 0.10, "model_ic_percentile"),
    ]
    return F.array_compact(F.array(*[m for m in made if m is not None]).cast("array<string>"))


def action(total: Column, forecast: Column, held: Column, watched: Column, invalidated: Column | None = None) -> Column:
    """reduce, accumulate, watch, avoid or null."""
    broken = F.lit(False) if invalidated is None else invalidated
    strong = (total >= 75) & (forecast > 0.02)
    return (
        F.when(held & broken, "reduce")
        .when(held & (total <= 35), "reduce")
        .when(strong & held, "accumulate")
        .when(strong, "watch")
        .when(~held & (total <= 25) & watched, "avoid")
    )


def conviction(score: Column, n_prior: Column, volatility: Column, high_vol_regime: Column) -> Column:
    """high from 0.70, medium from 0.45; low with fewer than 20 earlier cases; a step down for a volatility above 0.60 and
    another in a volatile market."""
    level = F.when(score >= 0.70, 2).when(score >= 0.45, 1).otherwise(0)
    level = F.when(n_prior >= LEAST_PRIOR, level).otherwise(0)
    steps = F.coalesce((volatility > 0.60).cast("int"), F.lit(0)) + F.coalesce(high_vol_regime.cast("int"), F.lit(0))
    return F.get(F.array(*map(F.lit, CONVICTIONS)), F.greatest(level - steps, F.lit(0)))


def interval(center: Column, low: Column, high: Column, volatility: Column, horizon: int = 20) -> tuple[Column, Column]:
    """The model's interval if both ends are there, else the center and the volatility over the horizon, else 0.20."""
    half = F.coalesce(volatility * (horizon / 252) ** 0.5, F.lit(0.20))
    mid, both = F.coalesce(center, F.lit(0.0)), low.isNotNull() & high.isNotNull()
    return F.when(both, low).otherwise(mid - half), F.when(both, high).otherwise(mid + half)


def rescaled_interval(point: Column, low: Column, high: Column, old: float = 0.95, new: float = 0.80) -> tuple[Column, Column]:
    from plumbline.functions.expressions import normal_quantile

    k = normal_quantile(0.5 + new / 2) / normal_quantile(0.5 + old / 2)
    return point - (point - low) * k, point + (high - point) * k


def invariants(recs: DataFrame) -> DataFrame:
    """Adds violations (array of names) and lowers the conviction to low where the prior is missing or rests on fewer than 20
    cases. A row without violations may be stored."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    empty = lambda c: F.coalesce(F.size(c) <= 0, F.lit(True))
    score = F.col("conviction_score")
    checks = {
        "bear_case": F.coalesce(F.length("bear_case") < 20, F.lit(True)),
        "sources": empty("source_doc_ids"),
        "citations": empty("citations"),
        "interval": F.col("expected_ret_lo").isNull() | F.col("expected_ret_hi").isNull(),
        "thesis": blank("thesis"),
        "invalidation": blank("invalidation"),
        "conviction": F.coalesce(~score.between(0.0, 1.0) | F.isnan(score), F.lit(True)),
    }
    weak = F.col("hit_rate_prior").isNull() | F.coalesce(F.col("n_prior_samples") < LEAST_PRIOR, F.lit(True))
    return recs.withColumn("violations", F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks.items()]))).withColumn("conviction", F.when(weak, "low").otherwise(F.col("conviction")))


def review(recs: DataFrame, plan: str = "light") -> DataFrame:
    """Adds issues (array of severity and code) and verdict: rejected with a critical issue or two major ones, revised with
    one major, else approved. ``citation_missing``, ``data_lag_days`` and ``latest_cited`` are made by joins beforehand."""
    bear, thesis = F.coalesce("bear_case", F.lit("")), F.coalesce("thesis", F.lit(""))
    has = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    width = F.col("expected_ret_hi") - F.col("expected_ret_lo")
    checks = [
        ("critical", "citation_not_found", F.col("citation_missing")),
        ("major", "stale_data", F.col("data_lag_days") > 3),
        ("critical", "delayed_price_as_current", (F.col("entry_ref_source") == "jquants") & F.lit(plan == "free")),
        ("critical", "empty_bear_case", F.length(bear) < 20),
        ("major", "boilerplate_bear_case", (F.length(bear) >= 20) & has(bear, BOILERPLATE) & ~bear.rlike("[0-9]")),
        ("major", "conviction_without_evidence", (F.col("conviction") != "low") & (F.coalesce("n_prior_samples", F.lit(0)) < LEAST_PRIOR)),
        ("critical", "missing_confidence_interval", width.isNull()),
        ("major", "suspiciously_narrow_ci", width < 0.01),
        ("critical", "future_document_cited", F.col("latest_cited") > F.col("as_of")),
        ("major", "overconfident_language", has(thesis, OVERCONFIDENT)),
    ]
    issues = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"))) for sev, code, bad in checks]))
    count = lambda sev: F.size(F.filter("issues", lambda i: i["severity"] == sev))
    verdict = F.when((count("critical") > 0) | (count("major") >= 2), "rejected").when(count("major") == 1, "revised").otherwise("approved")
    return recs.withColumn("issues", issues).withColumn("verdict", verdict)


def revised(recs: DataFrame, fields: Sequence[str] = ("thesis", "bear_case", "invalidation", "conviction")) -> DataFrame:
    """Takes over ``revised_<field>`` where it is not blank; a conviction only if it is a known one, and low without evidence."""

    def take(c: str) -> Column:
        new = F.nullif(F.trim(f"revised_{c}"), F.lit(""))
        if c == "conviction":
            new = F.when(new.isin(*CONVICTIONS), F.when(F.coalesce("n_prior_samples", F.lit(0)) < LEAST_PRIOR, "low").otherwise(new))
        return F.coalesce(new, F.col(c))

    return recs.withColumns({c: take(c) for c in fields}).drop(*[f"revised_{c}" for c in fields])


def qualitative(summaries: DataFrame, as_of: dt.date | str, weights: Mapping[str, float], other: float = 0.3, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """score, confidence and doc_count of each key: scores weighted by freshness (half in 90 days), kind of document and
    number of citations; plain mean if all weights are 0."""
    day = F.lit(str(as_of)).cast("date")
    age = F.greatest(F.datediff(day, F.coalesce(F.to_date("filed_at"), day)), F.lit(0))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.coalesce("doc_type", F.lit("other_disclosure"))), F.lit(other))
    w = F.pow(F.lit(0.5), age / 90.0) * kind * F.least(F.coalesce("n_citations", F.lit(0)) / 3.0, F.lit(1.5))
    x = summaries.select(*keys, age.alias("age"), w.alias("w"), F.coalesce("qualitative_score", F.lit(0.0)).alias("s"))
    x = x.groupBy(*keys).agg(F.sum(F.col("w") * F.col("s")).alias("ws"), F.sum("w").alias("w"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("spread"), F.min("age").alias("age"), F.count(F.lit(1)).alias("doc_count"))
    score = F.coalesce(ratio(F.col("ws"), F.nullif("w", F.lit(0.0))), F.col("mean"))
    sure = 0.3 * F.least(F.col("doc_count") / 3.0, F.lit(1.0)) + 0.4 * F.pow(F.lit(0.5), F.col("age") / 60.0) + 0.3 * (1 - F.least(F.col("spread") / 2.0, F.lit(1.0)))
    return x.select(*keys, clip(score, -1.0, 1.0).alias("score"), F.least(sure, F.lit(1.0)).alias("confidence"), "doc_count")


def feed(scores: DataFrame, cards: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Scored rows with their card if there is one, then cards of what is not scored: has_card, only_card."""
    s = scores.withColumn("_scored", F.lit(True))
    c = cards.withColumn("_card", F.lit(True))
    x = s.join(c, list(keys), "full_outer")
    return x.withColumns({"has_card": F.col("_card").isNotNull(), "only_card": F.col("_scored").isNull()}).drop("_card", "_scored")


def feed_filter(sector: str | None = None, least: float | None = None, codes: Sequence[str] = (), sign: int | None = None, has_card: bool | None = None, isin: Mapping[str, Sequence[Any]] | None = None) -> Column:
    """Conditions of the feed, each only if given: part of the sector's name, least score, any of the reason codes, sign of the
    forecast, a card, and values of columns."""
    out = F.lit(True)
    if sector is not None:
        out = out & F.contains(F.col("sector"), F.lit(sector))
    if least is not None:
        out = out & (F.coalesce("total_score", "quant_score") >= least)
    if codes:
        out = out & F.arrays_overlap("reason_codes", F.array(*map(F.lit, codes)))
    if sign is not None:
        out = out & (F.signum("ml_pred_h20") == sign)
    if has_card is not None:
        out = out & (F.col("has_card") == has_card)
    for c, values in (isin or {}).items():
        out = out & F.col(c).isin(list(values))
    return F.coalesce(out, F.lit(False))


def ranked(values: Sequence[str], c: Column) -> Column:
    """The place of a value in a list; unknown values and nulls come last."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)]), c), F.lit(len(values)))


def highlights(recs: DataFrame, k: int = 10) -> DataFrame:
    """Core candidates first, then by verdict, then by score."""
    return recs.orderBy(ranked(("core", "fill"), F.col("candidate_tier")), ranked(("approved", "revised"), F.col("verdict")), F.col("score").desc_nulls_last(), "rec_id").limit(k)


def preferred_horizon(cards: DataFrame, keys: Sequence[str], asked: str) -> DataFrame:
    """One card a key: of the horizon asked for, else H20, else H5, else the first by name."""
    order = ranked(tuple(dict.fromkeys((asked, "H20", "H5"))), F.col("horizon"))
    return cards.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "horizon"))).filter("_n = 1").drop("_n")


def signals(scores: DataFrame) -> DataFrame:
    """as_of, ticker, score: the first of total_score, ml_pred_h20 and quant_score that the table has."""
    column = next(c for c in ("total_score", "ml_pred_h20", "quant_score") if c in scores.columns)
    return scores.select("as_of", "ticker", F.col(column).alias("score")).filter("score IS NOT NULL")


def named_scores(scores: DataFrame, securities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores with name, sector and product_category of their security, as far as the list has these columns; a security without
    a row leaves them null. Of several rows of one key the first by name counts."""
    cols = [c for c in ("name", "sector", "product_category") if c in securities.columns]
    first = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in cols])
    one = securities.select(*keys, *cols).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return scores.drop(*cols).join(one, list(keys), "left")


def candidates(scores: DataFrame, securities: DataFrame, keys: Sequence[str], sector: str, *, min_adv: float | None = None, min_cap: float | None = None, cap: int = 3, k: int = 10, tie: Sequence[str] = ()) -> DataFrame:
    """From scores to at most ``k`` candidates: total_score by the qualitative overlay (overlay_score, overlay_confidence), the
    security's category, the universe or all rows where it is empty, rows that pass the strict gate before others
    (candidate_tier core and fill), and at most ``cap`` of a sector. position counts from 1."""
    x = scores.withColumn("total_score", overlay(F.col("quant_score"), F.col("overlay_score"), F.col("overlay_confidence")))
    x = named_scores(x, securities, keys)
    x = masked_universe(x, universe(x.select("adv_20d", *(["market_cap"] if min_cap is not None else []), "product_category"), min_adv, min_cap, most_missing=None))
    x = x.withColumns({"candidate_tier": F.when(strict_gate(), "core").otherwise("fill"), "_all": F.lit(1)})
    order = [ranked(("core", "fill"), F.col("candidate_tier")), F.col("total_score").desc_nulls_last(), *[F.col(c) for c in tie]]
    return capped_top(x, ["_all"], sector, order, cap, k).drop("_all")


def memories(df: DataFrame, market: str, sector: str, ticker: str, k: int = 15) -> DataFrame:
    """Active memories of this scope, with a confidence of 0.6 and ten cases or more, the surest first."""
    c = F.col("scope")
    here = (c == "global") | (c == F.concat(F.lit("market:"), F.lit(market))) | (c == F.concat(F.lit("sector:"), F.lit(sector))) | (c == F.concat(F.lit("ticker:"), F.lit(ticker)))
    return df.filter(here & F.col("active") & (F.col("confidence") >= 0.6) & (F.col("n") >= 10)).orderBy(F.col("confidence").desc(), "memory_id").limit(k)
