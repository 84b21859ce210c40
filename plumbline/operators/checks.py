"""What may not depend on the future, and functions that SQL may call."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions import expressions as X


def with_future(df: DataFrame, time_col: str, days: int, factor: float = 3.0) -> DataFrame:
    """``df`` and, after its last date, copies of each key's rows of the last ``days`` days with numbers so many times as large."""
    last = df.agg(F.max(F.to_date(time_col)).alias("_last"))
    recent = df.join(F.broadcast(last)).filter(F.datediff("_last", F.to_date(time_col)) < days)  # one row
    numbers = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    moved = recent.withColumn(time_col, F.date_add(F.to_date(time_col), days).cast(df.schema[time_col].dataType))
    return df.unionByName(moved.withColumns({c: F.col(c) * F.lit(factor) for c in numbers}).select(*df.columns))


def unstable_rows(compute: Callable[[DataFrame], DataFrame], df: DataFrame, time_col: str, days: int = 10, digits: int = 12) -> DataFrame:
    """Rows of ``compute(df)`` that differ once extreme rows of the future are there: none, if it sees only what was known."""
    def rounded(x: DataFrame) -> DataFrame:
        return x.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in x.schema])

    return rounded(compute(df)).exceptAll(rounded(compute(with_future(df, time_col, days))))


def unstable_columns(compute: Callable[[DataFrame], DataFrame], df: DataFrame, time_col: str, keys: Sequence[str], days: int = 10, digits: int = 9) -> DataFrame:
    """feature, unstable: for each column of ``compute(df)`` but its ``keys`` whether any of its values up to the last date differs
    once extreme rows of the future are there; a row that is gone or new counts for all columns.

    Of each column both results are summed up where they are made, as ``digest`` says: nothing is stored, and what moves beside
    the columns' own work is one row a task, whatever the number of rows."""
    last = df.agg(F.max(F.to_date(time_col)).alias("_last"))

    def digests(x: DataFrame) -> DataFrame:
        known = x.join(F.broadcast(last)).filter(F.to_date(time_col) <= F.col("_last"))  # one row
        return known.agg(*[digest(x, c, keys, digits).alias(c) for c in x.columns if c not in keys])

    before, after = digests(compute(df)), digests(compute(with_future(df, time_col, days)))
    both = F.broadcast(before).alias("a").crossJoin(after.alias("b"))  # a row each
    found = both.select(*[(F.col(f"a.{c}") != F.col(f"b.{c}")).alias(c) for c in before.columns])
    return found.unpivot([], before.columns, "feature", "unstable")


def digest(df: DataFrame, column: str, keys: Sequence[str], digits: int) -> Column:
    """An aggregate: how many rows there are, and the sums of both halves of a 64-bit hash of each row's keys and value (numbers
    rounded). The same rows in whatever order have the same; others differ but for an accident of 1 in 2^64."""
    c = F.col(column)
    if df.schema[column].dataType.simpleString() in ("double", "float"):
        c = F.round(column, digits) + F.lit(0.0)  # 0 has one sign
    parts = [y for k in keys for y in (F.col(k), F.col(k).isNull())]
    h = F.xxhash64(*parts, c, c.isNull())
    return F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h.bitwiseAND(0xFFFFFFFF)), F.lit(0)).alias("low"), F.coalesce(F.sum(F.shiftrightunsigned(h, 32)), F.lit(0)).alias("high"))


def register(spark: SparkSession, functions: dict[str, tuple[Callable, str]] | None = None) -> Sequence[str]:
    """Functions for SQL: the library's vectorised ones, the table function of chunks, and those given as name -> (function of
    pandas series, type)."""
    from plumbline.operators.retrieval import _verdicts, register_chunks

    register_chunks(spark)

    made = {"citation_verdict": (_verdicts, "string"), "t_quantile": (_t_quantiles, "double")} | (functions or {})
    for name, (fn, kind) in made.items():
        spark.udf.register(name, F.pandas_udf(fn, kind))
    return list(made)


def _t_quantiles(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([X.t_quantile(a, b) for a, b in zip(p, df)])
