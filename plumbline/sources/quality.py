"""Price quality gate: rejects and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EXTREME, LEAST_YEN = 0.4, 10.0


def reject_reason(open_: Column, high: Column, low: Column, close: Column, currency: Column) -> Column:
    """The first rule that a bar breaks; null if it breaks none."""
    return (
        F.when(close.isNull(), "CLOSE_MISSING")
        .when(high < low, "HIGH_LOW_INVERTED")
        .when((close > high) | (close < low), "CLOSE_OUT_OF_RANGE")
        .when((open_ > high) | (open_ < low), "OPEN_OUT_OF_RANGE")
        .when(close <= 0, "CLOSE_NOT_POSITIVE")
        .when((currency == "JPY") & (close < LEAST_YEN), "CLOSE_TOO_LOW")
    )


def quality_gate(bars: DataFrame) -> DataFrame:
    """Adds reject and flags. The previous close is that of the last accepted bar: rejected ones do not move it."""
    bars = bars.withColumn("reject", reject_reason(F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("currency")))
    w = Window.partitionBy("ticker").orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("reject").isNull(), F.col("close")), ignorenulls=True).over(w)
    bars = bars.withColumn("prev_close", before)
    change = F.try_divide("close", "prev_close") - 1
    flags = F.array_compact(
        F.array(F.when(F.abs(change) > EXTREME, "EXTREME_MOVE"), F.when((F.col("volume") == 0) & (change != 0), "ZERO_VOLUME_PRICE_MOVED"))
    )
    return bars.withColumn("flags", F.when(F.col("reject").isNull(), flags).otherwise(F.array().cast("array<string>")))


def quality_ledger(gated: DataFrame) -> DataFrame:
    """One row for each reject and each flag."""
    marks = F.when(F.col("reject").isNotNull(), F.array(F.col("reject"))).otherwise(F.col("flags"))
    return gated.select("ticker", "session", F.col("reject").isNotNull().alias("rejected"), F.explode(marks).alias("mark"))
