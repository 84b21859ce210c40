"""Cross-sectional transforms, scores and selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.expressions import clip, rank_pct, ratio, score_100, weighted_mean, whole, winsorized

MAD = 1.4826


def winsorize(df: DataFrame, cols: Sequence[str], keys: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    return df.withColumns({c: winsorized(F.col(c), whole(*keys), low, high) for c in cols})


def robust_z(df: DataFrame, cols: Sequence[str], keys: Sequence[str], limit: float = 3.0) -> DataFrame:
    """(x - median) / (1.4826 MAD), clipped; where the MAD is 0 the population deviation takes its place; null if that is 0 too."""
    w = whole(*keys)
    df = df.withColumns({f"_m_{c}": F.median(c).over(w) for c in cols})
    df = df.withColumns({f"_d_{c}": F.median(F.abs(F.col(c) - F.col(f"_m_{c}"))).over(w) * MAD for c in cols} | {f"_s_{c}": F.stddev_pop(c).over(w) for c in cols})
    scale = lambda c: F.when(F.col(f"_d_{c}") > 0, F.col(f"_d_{c}")).when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}"))
    df = df.withColumns({f"{c}_z": clip((F.col(c) - F.col(f"_m_{c}")) / scale(c), -limit, limit) for c in cols})
    return df.drop(*[f"_{k}_{c}" for k in "mds" for c in cols])


def sector_neutral_z(df: DataFrame, cols: Sequence[str], keys: Sequence[str], sector: str, least: int = 8, limit: float = 3.0) -> DataFrame:
    """Robust z within the sector; sectors of fewer than ``least`` values, and null ones, take the z of the whole group.
    Where a sector's MAD is 0 its centre is 0 and other values are at the limit."""
    market = robust_z(df, cols, keys, limit)
    w = whole(*keys, sector)
    market = market.withColumns({f"_m_{c}": F.median(c).over(w) for c in cols} | {f"_n_{c}": F.count(c).over(w) for c in cols})
    market = market.withColumns({f"_d_{c}": F.median(F.abs(F.col(c) - F.col(f"_m_{c}"))).over(w) * MAD for c in cols})

    def z(c: str) -> Column:
        off = F.col(c) - F.col(f"_m_{c}")
        own = F.when(F.col(f"_d_{c}") > 0, clip(off / F.col(f"_d_{c}"), -limit, limit)).otherwise(F.signum(off) * limit)
        return F.when(F.col(sector).isNotNull() & (F.col(f"_n_{c}") >= least), own).otherwise(F.col(f"{c}_z"))

    return market.withColumns({f"{c}_z": z(c) for c in cols}).drop(*[f"_{k}_{c}" for k in "mdn" for c in cols])


def group_scores(df: DataFrame, groups: dict[str, dict[str, float]], keys: Sequence[str]) -> DataFrame:
    """A signed mean of each group's z columns (half of them must be there), put on the robust z scale again."""
    df = df.withColumns({g: weighted_mean([(F.col(f"{c}_z"), w) for c, w in members.items()], max(1, -(-len(members) // 2))) for g, members in groups.items()})
    return robust_z(df, list(groups), keys)


def checked_weights(weights: dict[str, float]) -> dict[str, float]:
    """The weights, if they add up to 1."""
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError(f"weights add up to {sum(weights.values())}, not 1")
    return weights


def composite(df: DataFrame, weights: dict[str, float], keys: Sequence[str], least: int = 3) -> DataFrame:
    """quant_composite, quant_score (0 to 100), quant_rank (1 is best, ties share the least), quant_percentile and
    n_valid_groups. Weights add up to 1."""
    w = whole(*keys)
    checked_weights(weights)
    df = df.withColumn("quant_composite", weighted_mean([(F.col(f"{g}_z"), x) for g, x in weights.items()], least))
    x = F.col("quant_composite")
    return df.withColumns(
        {
            "quant_score": score_100(x),
            "n_valid_groups": sum((F.col(f"{g}_z").isNotNull().cast("int") for g in weights), F.lit(0)),
            "quant_rank": F.when(x.isNotNull(), F.rank().over(w.orderBy(x.desc_nulls_last()))),
            "quant_percentile": rank_pct(x, w),
        }
    )


def capped_top(df: DataFrame, keys: Sequence[str], sector: str, order: Sequence[Column], cap: int = 3, k: int = 10) -> DataFrame:
    """The first ``k`` rows in a total ``order`` with at most ``cap`` of a sector: what a greedy pass selects, as caps do not
    interact. Put a tier before the score to fill up a core selection."""
    df = df.withColumn("_in_sector", F.row_number().over(whole(*keys, F.coalesce(F.col(sector).cast("string"), F.lit("__UNKNOWN__"))).orderBy(*order)))
    df = df.filter(F.col("_in_sector") <= cap).withColumn("position", F.row_number().over(whole(*keys).orderBy(*order)))
    return df.filter(F.col("position") <= k).drop("_in_sector")


def overlay(quant: Column, quality: Column, confidence: Column) -> Column:
    return clip(quant + 12 * F.coalesce(quality, F.lit(0.0)) * F.coalesce(confidence, F.lit(0.5)), 0.0, 100.0)


def quantile_bins(df: DataFrame, score: str, keys: Sequence[str], bins: int = 5) -> DataFrame:
    """Equal-frequency bins 1..n, right-closed at linear quantiles; equal edges make one bin less."""
    edges = F.array_distinct(F.percentile(score, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).over(whole(*keys)))
    inner = F.filter(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))), lambda e: e < F.col(score))
    return df.withColumn("bin", F.when(F.col(score).isNotNull(), F.size(inner) + 1))


def rank_correlation(df: DataFrame, a: str, b: str, keys: Sequence[str], least: int = 3) -> DataFrame:
    """Spearman's correlation of each group's complete pairs; groups of fewer than ``least`` are left out."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    w = whole(*keys)
    ranked = both.select(*keys, rank_pct(F.col(a), w).alias("ra"), rank_pct(F.col(b), w).alias("rb"))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("ic")).filter(F.col("n") >= least)


def rank_correlation_summary(ics: DataFrame) -> DataFrame:
    """A correlation within 1e-9 of zero, as rounding leaves it, is not positive."""
    n, mean, std = F.count("ic"), F.avg("ic"), F.stddev_samp("ic")
    return ics.agg(n.alias("n_dates"), mean.alias("ic_mean"), ratio(mean, std / F.sqrt(n)).alias("ic_t"), F.avg((F.col("ic") > 1e-9).cast("double")).alias("ic_positive"))


def benchmark_excess(value: str, bench: str) -> Column:
    """Less the benchmark's return; null where there is none."""
    return F.col(value) - F.col(bench)


def excess(df: DataFrame, value: str, keys: Sequence[str], sector: str) -> Column:
    """Over the sector's median; over the group's where the sector is null."""
    return F.col(value) - F.when(F.col(sector).isNotNull(), F.median(value).over(whole(*keys, sector))).otherwise(F.median(value).over(whole(*keys)))
