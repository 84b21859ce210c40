"""Sessions: a small table of dates with consecutive numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Cutoff hours and zones by market: a disclosure at or after the cutoff counts from the next session.
CUTOFFS = {"JP": ("Asia/Tokyo", 15), "US": ("America/New_York", 16)}


def sessions(df: DataFrame, date_col: str) -> DataFrame:
    """Distinct dates, numbered from 0; a calendar has some 250 rows a year, whatever the data."""
    days = df.select(F.to_date(date_col).alias("session")).filter("session IS NOT NULL").distinct()
    return days.select("session", (F.row_number().over(Window.orderBy("session")) - 1).alias("session_idx"))


def shifted(calendar: DataFrame, n: int) -> DataFrame:
    """session, other: the session n later (earlier if negative); null beyond the ends."""
    return calendar.select("session", F.lead("session", n).over(Window.orderBy("session")).alias("other"))


def effective_date(timestamps: DataFrame, ts_col: str, market: str, calendar: DataFrame) -> DataFrame:
    """Adds ``available_from``: the local date if it is a session and the time is before the cutoff, else the next session."""
    zone, cutoff = CUTOFFS[market]
    local = F.from_utc_timestamp(ts_col, zone)
    earliest = F.when(F.hour(local) >= cutoff, F.date_add(F.to_date(local), 1)).otherwise(F.to_date(local))
    before = F.coalesce(F.date_add(F.lag("session").over(Window.orderBy("session")), 1), F.date_sub("session", 366))
    days = calendar.select("session", before.alias("_from"))
    days = days.select(F.col("session").alias("available_from"), F.explode(F.sequence("_from", "session")).alias("_day"))  # each day of the calendar, and a year before it
    return timestamps.withColumn("_day", earliest).join(F.broadcast(days), "_day", "left").drop("_day")


def next_session(days: DataFrame, day_col: str, calendar: DataFrame, n: int = 1) -> DataFrame:
    """Adds other: the n-th session after the day (before it if negative), whether or not the day is a session."""
    order = Window.orderBy("session")
    until = F.coalesce(F.date_sub(F.lead("session").over(order), 1), F.date_add("session", 366))
    if n > 0:
        spans = calendar.select("session", until.alias("_u"), F.lead("session", n).over(order).alias("other"))
        spans = spans.select(F.explode(F.sequence("session", "_u")).alias(day_col), "other")
    else:
        start = F.coalesce(F.date_add(F.lag("session").over(order), 1), F.date_sub("session", 366))
        spans = calendar.select("session", start.alias("_s"), F.lag("session", -n).over(order).alias("other")).select(F.explode(F.sequence("_s", "session")).alias(day_col), "other")
    return days.join(F.broadcast(spans), day_col, "left")


def sessions_between(calendar: DataFrame, start: Column, end: Column) -> DataFrame:
    """n: sessions from start to before end; and the list with both ends."""
    s = F.col("session")
    return calendar.agg(F.count_if((s >= start) & (s < end)).alias("n"), F.array_sort(F.collect_list(F.when((s >= start) & (s <= end), s))).alias("sessions"))


def session_as_of(now: Column, market: str) -> Column:
    """The local date, or the day before until the day's data are there (18:30 in Tokyo, 16:00 in New York)."""
    zone, minutes = {"JP": ("Asia/Tokyo", 18 * 60 + 30), "US": ("America/New_York", 16 * 60)}[market]
    local = F.from_utc_timestamp(now, zone)
    return F.when(F.hour(local) * 60 + F.minute(local) >= minutes, F.to_date(local)).otherwise(F.date_sub(F.to_date(local), 1))


def rebalance_days(calendar: DataFrame, every: str = "week") -> DataFrame:
    """The first session of each ISO week or month."""
    return calendar.groupBy(F.date_trunc(every, "session").cast("date").alias("period")).agg(F.min("session").alias("session"))


def purged_splits(calendar: DataFrame, n_splits: int, horizon: int, embargo: int, test: int, min_train: int) -> DataFrame:
    """split_id, role, session: walk-forward test windows from the end; training ends horizon + embargo sessions earlier.
    Splits with fewer than ``min_train`` training sessions are left out."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rows = calendar.withColumn("n", n).withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    start = F.col("n") - (F.col("back") + 1) * test
    train_end = start - horizon - embargo
    role = F.when((F.col("session_idx") >= start) & (F.col("session_idx") < start + test), "test").when(F.col("session_idx") < train_end, "train")
    return rows.filter(train_end >= min_train).select((n_splits - 1 - F.col("back")).alias("split_id"), role.alias("role"), "session").filter("role IS NOT NULL")


def walk_forward(calendar: DataFrame, **kw: int) -> DataFrame:
    """One row a split: its training and test windows."""
    w = lambda fn, role: fn(F.when(F.col("role") == role, F.col("session")))
    return purged_splits(calendar, **kw).groupBy("split_id").agg(
        w(F.min, "train").alias("train_start"), w(F.max, "train").alias("train_end"), w(F.min, "test").alias("test_start"), w(F.max, "test").alias("test_end"), F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test")
    )


def range_start(key: Column, end: Column) -> Column:
    """First date of a named range; a year for an unknown name."""
    days = F.create_map(*[F.lit(x) for pair in (("1m", 31), ("3m", 93), ("6m", 186), ("1y", 365), ("5y", 365 * 5), ("max", 365 * 30)) for x in pair])
    return F.date_sub(end, F.coalesce(F.try_element_at(days, key), F.lit(365)))
