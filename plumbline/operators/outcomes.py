"""What became of recommendations: labels, outcomes, hit rates, priors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.expressions import ratio

# Sign of an action's bet; others, and none, count as 1.
SIGNS = {"accumulate": 1, "watch": 1, "reduce": -1, "avoid": -1}


def forward_returns(panel: DataFrame, horizon: int, price: str = "open") -> DataFrame:
    """Adds ``label``: from the next session's price to the one ``horizon`` sessions later; null without both prices or if
    the first is 0 or less. ``panel`` is dense."""
    w = Window.partitionBy("ticker").orderBy("session_idx")
    enter, leave = F.lead(price, 1).over(w), F.lead(price, 1 + horizon).over(w)
    return panel.withColumn("label", F.when(enter > 0, leave / enter - 1))


def outcomes(recs: DataFrame, panel: DataFrame, bench: DataFrame, horizon: int) -> DataFrame:
    """Return, benchmark return (0 where there is none), excess, is_hit, and the best and worst excursions of the window.

    ``recs``: rec_id, ticker, session, action, and verdict if there is one: only approved ones count; ``panel``: dense, with open, high and low; ``bench``: session, session_idx, level.
    """
    if "verdict" in recs.columns:
        recs = recs.filter("verdict = 'approved'")
    w = Window.partitionBy("ticker").orderBy("session_idx")
    hold = w.rowsBetween(1, 1 + horizon)
    p = forward_returns(panel, horizon).select(
        "ticker", "session", F.col("label").alias("ret"), F.lead("open", 1).over(w).alias("entry"), F.max("high").over(hold).alias("top"), F.min("low").over(hold).alias("bottom")
    )
    b = Window.orderBy("session_idx")
    level = bench.select("session", (ratio(F.lead("level", 1 + horizon).over(b), F.lead("level", 1).over(b)) - 1).alias("bench"))
    sign = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SIGNS.items() for x in kv]), F.col("action")), F.lit(1))
    x = recs.join(p, ["ticker", "session"]).join(F.broadcast(level), "session", "left").filter("ret IS NOT NULL")
    x = x.withColumn("excess", F.col("ret") - F.coalesce("bench", F.lit(0.0))).withColumn("sign", sign)
    up, down = ratio(F.col("top"), F.col("entry")) - 1, ratio(F.col("bottom"), F.col("entry")) - 1
    return x.select(
        "rec_id", "ticker", "session", "ret", F.coalesce("bench", F.lit(0.0)).alias("bench"), "excess",
        (F.col("excess") * F.col("sign") > 0).alias("is_hit"),
        F.when(F.col("sign") >= 0, up).otherwise(0.0 - down).alias("mfe"), F.when(F.col("sign") >= 0, down).otherwise(0.0 - up).alias("mae"),
    )


def hit_rates(df: DataFrame, keys: Sequence[str], hit: str = "is_hit") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(hit).cast("double")).alias("hit_rate"))


def membership_effect(df: DataFrame, members: DataFrame, ids: str, member: str, hit: str = "is_hit") -> DataFrame:
    """For each member: hit rates of rows whose id array holds it and of the rest, from totals less the members' own."""
    used = df.select(F.explode(F.array_distinct(ids)).alias(member), F.col(hit).cast("double").alias("h")).groupBy(member).agg(F.count("h").alias("n_used"), F.sum("h").alias("s"))
    total = df.agg(F.count(hit).alias("n"), F.sum(F.col(hit).cast("double")).alias("t"))
    x = members.select(member).join(used, member, "left").join(F.broadcast(total)).fillna({"n_used": 0, "s": 0.0})
    return x.select(member, "n_used", ratio(F.col("s"), F.col("n_used")).alias("rate_used"), ratio(F.col("t") - F.col("s"), F.col("n") - F.col("n_used")).alias("rate_unused"))


def similar_prior(past: DataFrame, codes: Sequence[str], before: Column, least_overlap: int = 2, least: int = 20) -> DataFrame:
    """Mean hit and excess of earlier rows that share ``least_overlap`` codes; of all earlier rows if fewer than ``least``
    do, though n_samples stays the number of similar ones."""
    near = F.size(F.array_intersect("codes", F.array(*map(F.lit, codes)))) >= least_overlap
    s = past.filter(before).agg(
        F.count_if(near).alias("n_samples"),
        *[f(F.when(near, F.col(c).cast("double"))).alias(f"{c}_near") for c in ("is_hit", "excess") for f in (F.avg,)],
        *[F.avg(F.col(c).cast("double")).alias(f"{c}_all") for c in ("is_hit", "excess")],
    )
    pick = lambda c: F.when(F.col("n_samples") >= least, F.col(f"{c}_near")).otherwise(F.col(f"{c}_all"))
    return s.select("n_samples", pick("is_hit").alias("hit_rate"), pick("excess").alias("mean_excess"))
