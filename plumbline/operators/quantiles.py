"""Exact quantiles of groups of any size: counts of value ranges first, then ranks inside the ranges that hold them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.staging import stored

#: Different values that a range holds on average at most.
RANGE = 200_000


def exact_quantiles(df: DataFrame, value: str, ps: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """keys, n and quantiles (an array in the order of ``ps``), equal to ``percentile``: linear between the two nearest ranks.
    Nulls are left out; a group without values has no row. Null keys are a group of their own.

    Equal values are counted before anything is shuffled, so that a value that very many rows have is one row. Values lie in
    range partitions, and a rank is looked for in the one that the running counts of the partitions name: no task holds a
    group, however large, where ``percentile`` holds all its different values.
    """
    x = F.col(value).cast("double")
    counts = df.filter(x.isNotNull()).groupBy(*keys, x.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = stored(counts, "value-counts")
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // RANGE))
    counts = stored(counts.repartitionByRange(parts, *keys, "_v").withColumn("_part", F.spark_partition_id()), "value-ranges")
    whole = Window.partitionBy(*keys)
    cells = counts.groupBy(*keys, "_part").agg(F.sum("_n").alias("_c"))
    ahead = F.coalesce(F.sum("_c").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(*keys, "_part", "_c", ahead.alias("_ahead"), F.sum("_c").over(whole).alias("n"))  # a row a group and range
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(ps)])
    asked = cells.select("*", F.explode(wanted).alias("_w")).withColumn("_at", F.col("_w.p") * (F.col("n") - 1))
    asked = asked.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    asked = asked.filter((F.col("_rank") >= F.col("_ahead")) & (F.col("_rank") < F.col("_ahead") + F.col("_c")))
    run = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    held = asked.select(*keys, "_part").distinct()
    same = lambda a, b, *names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    inside = counts.alias("c").join(held.alias("h"), same("c", "h", *keys, "_part"), "left_semi").withColumn("_run", run)
    asked = asked.select(*keys, "_part", "_ahead", "n", F.col("_w.k").alias("_k"), "_at", "_rank")
    found = inside.alias("c").join(asked.alias("a"), same("c", "a", *keys, "_part")).filter("a._rank - a._ahead < c._run AND a._rank - a._ahead >= c._run - c._n")
    found = found.select(*[F.col(f"a.{c}").alias(c) for c in keys], "a.n", "a._k", "a._at", "a._rank", "c._v")
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    one = found.groupBy(*keys, "n", "_k").agg((low + (high - low) * (F.max("_at") - F.floor(F.max("_at")))).alias("q"))
    return one.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("_k", "q")))["q"].alias("quantiles")).filter("n IS NOT NULL")


def robust_cuts(df: DataFrame, value: str, keys: Sequence[str] = (), low: float = 0.01, high: float = 0.99) -> DataFrame:
    """keys, n, median, mad (the median distance from it), low and high: what robust scores and cuts of a cross-section need."""
    q = exact_quantiles(df, value, (0.5, low, high), keys)
    cuts = q.select(*keys, "n", F.col("quantiles")[0].alias("median"), F.col("quantiles")[1].alias("low"), F.col("quantiles")[2].alias("high"))
    cuts = stored(cuts, "cuts")  # a row a group
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in keys]
    away = df.alias("d").join(cuts.alias("c"), same).select(*[F.col(f"d.{c}").alias(c) for c in keys], F.abs(F.col(f"d.{value}").cast("double") - F.col("c.median")).alias("_away")) if keys else df.crossJoin(F.broadcast(cuts)).select(F.abs(F.col(value).cast("double") - F.col("median")).alias("_away"))  # one row of cuts
    mad = exact_quantiles(away, "_away", (0.5,), keys).select(*keys, F.col("quantiles")[0].alias("mad"))
    if not keys:
        return cuts.crossJoin(mad)  # a row each
    return cuts.alias("c").join(mad.alias("m"), [F.col(f"c.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]).select("c.*", "m.mad")
