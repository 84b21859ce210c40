"""A dense panel of tickers and sessions, and windows over its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from plumbline.functions.expressions import deepest_drawdown, ratio
from plumbline.staging import stored


def by_session() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("session_idx")


def last(n: int) -> WindowSpec:
    return by_session().rowsBetween(-(n - 1), 0)


def dense(prices: DataFrame) -> DataFrame:
    """A row for each ticker and each session from the first to the last of all: a missing bar is a row of nulls.

    The bars are stored once, so that whatever they were made of is scanned once; calendar, tickers and rows come from the
    table of bars. The calendar (distinct sessions, a few thousand rows in decades) is numbered once and its size does not
    follow the number of rows; each ticker's row is exploded from it, so nothing is paired but tickers with sessions of the grid.
    """
    prices = prices if hasattr(prices, "stored_at") else stored(prices, "bars")
    calendar = prices.select("session").distinct().agg(F.array_sort(F.collect_set("session")).alias("sessions"))
    grid = prices.select("ticker").distinct().join(F.broadcast(calendar)).select("ticker", F.posexplode("sessions").alias("session_idx", "session"))
    return grid.join(prices, ["ticker", "session"], "left")


def simple_return(price: str, n: int = 1) -> Column:
    return ratio(F.col(price), F.lag(price, n).over(by_session())) - 1


def log_return(price: str) -> Column:
    """Null across gaps and for prices of 0 or less."""
    positive = lambda x: F.when(x > 0, x)
    return F.ln(positive(F.col(price))) - F.ln(positive(F.lag(price, 1).over(by_session())))


def momentum(price: str, near: int, far: int) -> Column:
    return ratio(F.lag(price, near).over(by_session()), F.lag(price, far).over(by_session())) - 1


def rolling(fn, col: str, n: int, least: int = 1) -> Column:
    """Over the last n rows, nulls passed over; null with fewer than ``least`` values."""
    return F.when(F.count(col).over(last(n)) >= least, fn(col).over(last(n)))


def history(price: str) -> Column:
    return F.count(price).over(by_session().rowsBetween(Window.unboundedPreceding, 0))


def drawdown(price: str, n: int) -> Column:
    """Deepest fall from the running maximum within the last n rows; the maximum starts anew with the window."""
    return deepest_drawdown(F.collect_list(F.struct(F.col(price).cast("double").alias("x"))).over(last(n))["x"])


def _joined(a: Column, b: Column) -> Column:
    """Of two summaries of neighbouring rows (highest, lowest, deepest) that of all their rows: what falls across the border
    falls from the highest of the first to the lowest of the second."""
    across = F.try_divide(b["low"], a["top"]) - 1
    return F.struct(F.greatest(a["top"], b["top"]).alias("top"), F.least(a["low"], b["low"]).alias("low"), F.least(a["deep"], b["deep"], across).alias("deep"))


def trailing_drawdown(panel: DataFrame, price: str, n: int, name: str = "drawdown") -> DataFrame:
    """Adds ``name``, the deepest fall from the running maximum within the last ``n`` rows of each ticker; nulls are passed over.

    Falls are summaries that join (highest, lowest, deepest fall). The summary of 2^k rows is that of the 2^(k-1) rows
    before and that of the last 2^(k-1); n is a sum of powers of two. So a row carries a few numbers in log2(n) lags over one
    order, where collecting each window would carry n of them.
    """
    x = F.when(F.col(price) > 0, F.col(price).cast("double"))
    kind = "struct<top:double,low:double,deep:double>"
    one = F.struct(x.alias("top"), x.alias("low"), F.when(x.isNotNull(), F.lit(0.0)).alias("deep")).cast(kind)
    none = F.struct(*[F.lit(None).cast("double").alias(c) for c in ("top", "low", "deep")])
    out, width, done, size = panel.withColumn("_p", one), 1, 0, n
    while size:
        if size & 1:  # the block of ``width`` rows that end ``done`` rows ago stands before what is joined so far
            block = F.coalesce(F.lag("_p", done).over(by_session()), none) if done else F.col("_p")
            out = out.withColumn("_w", _joined(block, F.col("_w")) if done else block)
            done += width
        size >>= 1
        if size:
            out = out.withColumn("_p", _joined(F.coalesce(F.lag("_p", width).over(by_session()), none), F.col("_p")))
            width *= 2
    return out.withColumn(name, F.col("_w.deep")).drop("_p", "_w")


def beta(own: str, bench: str, n: int, least: int) -> Column:
    """Covariance over variance of pairs without nulls in the last n rows."""
    both = F.col(own).isNotNull() & F.col(bench).isNotNull()
    x, y = F.when(both, F.col(bench)), F.when(both, F.col(own))
    w = last(n)
    k = F.count(x).over(w)
    cov = F.sum(x * y).over(w) - F.sum(x).over(w) * F.sum(y).over(w) / k
    var = F.sum(x * x).over(w) - F.sum(x).over(w) * F.sum(x).over(w) / k
    return F.when(k >= least, ratio(cov, var))


def trailing(panel: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """All columns in one pass over one shuffle by ticker."""
    return panel.select("*", *[c.alias(k) for k, c in columns.items()])
