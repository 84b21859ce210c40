"""Point-in-time reads: what was known at a date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.staging import stored


def visible(df: DataFrame, time_col: str, as_of: dt.date | str) -> DataFrame:
    """Rows whose time is not null and not after ``as_of``."""
    return df.filter(F.to_date(time_col) <= F.lit(str(as_of)).cast("date"))


def leaks(df: DataFrame, time_col: str, as_of: dt.date | str) -> bool:
    """Whether any row is later than ``as_of``."""
    return bool(df.filter(F.to_date(time_col) > F.lit(str(as_of)).cast("date")).limit(1).count())


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key in ``order``, which must be total. Spark keeps k rows a key before it shuffles."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_nth") <= k).drop("_nth")


def versions_as_of(df: DataFrame, keys: Sequence[str], time_col: str, as_of: dt.date | str, tie: Sequence[Column] = ()) -> DataFrame:
    """The latest version of each key that was known at ``as_of``; the filter stands below the ranking."""
    return latest(visible(df, time_col, as_of), keys, [F.col(time_col).desc(), *tie])


def valid_at(df: DataFrame, as_of: dt.date | str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows of a slowly changing table whose half-open interval holds the date; a null end is open."""
    d = F.lit(str(as_of)).cast("date")
    return df.filter((F.col(start) <= d) & (F.col(end).isNull() | (F.col(end) > d)))


def securities_at(securities: DataFrame, as_of: dt.date | str, active: bool | None = None, tickers: Sequence[str] | None = None) -> DataFrame:
    """Rows valid at the date; of them the active ones (or those that are not) and those of a list of codes, each only if asked."""
    rows = valid_at(securities, as_of)
    if active is not None:
        rows = rows.filter(F.coalesce("is_active", F.lit(True)) == active)
    return rows if tickers is None else rows.filter(F.col("ticker").isin(list(tickers)))


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], time_col: str, values: Sequence[str], tie: str | None = None) -> DataFrame:
    """Each left row with ``values`` of the last right row of its key at or before its time, null if there is none.

    Union and one window: a single shuffle on the key. Of right rows at one time the one with the largest ``tie`` counts.
    A key's rows meet in one task: ``asof_join_sliced`` splits them.
    """
    w = Window.partitionBy(*by).orderBy(time_col, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = _both(left, right, by, time_col, values, tie).withColumn("_found", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select("_left.*", *[F.col("_found")[v].alias(v) for v in values])


def asof_join_sliced(left: DataFrame, right: DataFrame, by: Sequence[str], time_col: str, values: Sequence[str], tie: str | None = None) -> DataFrame:
    """``asof_join`` for keys of any number of rows. Rows of both sides lie in range partitions of key, time and side: a key with
    half of all rows is split by time. Within a partition the last right row is carried along; a left row before the first one of its
    partition takes the last of the key's earlier partitions, of which there is one row each."""
    order = [*by, F.col(time_col).asc_nulls_first(), "_side", "_tie"]
    spark = left.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = _both(left, right, by, time_col, values, tie).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    rows = stored(rows, "asof-rows")
    w = Window.partitionBy(*by, "_part").orderBy(F.col(time_col).asc_nulls_first(), "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("_found", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    last = rows.filter("_side = 0").groupBy(*by, "_part").agg(F.max(F.struct(F.col(time_col), "_tie", "_right"))["_right"].alias("_last"))
    cells = rows.select(*by, "_part").distinct()
    same = lambda a, b, *cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    cells = cells.alias("c").join(last.alias("l"), same("c", "l", *by, "_part"), "left").select("c.*", "l._last")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(cells.withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier)).filter("_carry IS NOT NULL").select(*by, "_part", "_carry"), "asof-carry")
    both = here.alias("h").join(cells.alias("c"), same("h", "c", *by, "_part"), "left").withColumn("_all", F.coalesce("h._found", "c._carry"))
    return both.select("h._left.*", *[F.col("_all")[v].alias(v) for v in values])


def _both(left: DataFrame, right: DataFrame, by: Sequence[str], time_col: str, values: Sequence[str], tie: str | None) -> DataFrame:
    """Rows of both sides under each other: by, time, _left, _right, _side (0 is right) and _tie."""
    packed = F.struct(*values)
    none = F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType)
    nothing = F.lit(None).cast(right.schema[tie].dataType if tie else "int")
    l = left.select(*by, time_col, F.struct(*left.columns).alias("_left"), none.alias("_right"), F.lit(1).alias("_side"), nothing.alias("_tie"))
    r = right.select(*by, time_col, F.lit(None).cast(l.schema["_left"].dataType).alias("_left"), packed.alias("_right"), F.lit(0).alias("_side"), (F.col(tie) if tie else nothing).alias("_tie"))
    return l.unionByName(r)
