"""Column expressions that Spark lacks as built-ins."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, Window, WindowSpec, functions as F


def whole(*keys: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it: Spark computes a repeated part of an
    expression inside a lambda anew at each place, and for each element of an inner one."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(a, b)


def positive_ratio(a: Column, b: Column) -> Column:
    """a / b; null unless b is above 0."""
    return F.when(b > 0, F.try_divide(a, b))


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def rank_pct(x: Column, by: WindowSpec) -> Column:
    """Average rank over the count of non-null values; null is not ranked."""
    lower = F.rank().over(by.orderBy(x.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(by.orderBy(x.asc_nulls_last()).rangeBetween(0, 0))
    return F.when(x.isNotNull(), (lower + (ties - 1) / 2) / F.count(x).over(by))


def winsorized(x: Column, by: WindowSpec, low: float = 0.01, high: float = 0.99) -> Column:
    """Clipped to the linear-interpolated quantiles of the group."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.percentile(x, F.lit(low)).over(by)), F.percentile(x, F.lit(high)).over(by)))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, a vector is empty or its norm is 0."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))).otherwise(0.0)


def bias_corrected_skewness(x: str) -> Column:
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def bias_corrected_kurtosis(x: str) -> Column:
    """Excess kurtosis."""
    n = F.count(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def weighted_mean(parts: Sequence[tuple[Column, float]], least: int) -> Column:
    """Mean over the non-null parts, weights renormalised; null with fewer than ``least`` of them. A negative weight
    turns the sign of its part."""
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    valid = add([x.isNotNull().cast("int") for x, _ in parts])
    total = add([F.when(x.isNotNull(), F.lit(abs(w))).otherwise(0.0) for x, w in parts])
    return F.when(valid >= least, F.try_divide(add([F.coalesce(x * w, F.lit(0.0)) for x, w in parts]), total))


def deepest_drawdown(values: Column) -> Column:
    """The least value / running maximum - 1 of an ordered array; nulls are passed over."""
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("least"))

    def step(s: Column, x: Column) -> Column:
        top = F.greatest(s["top"], x)
        return F.struct(top.alias("top"), F.least(s["least"], F.when(x.isNotNull(), F.try_divide(x, top) - 1)).alias("least"))

    return F.aggregate(values, start, step, lambda s: s["least"])


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun's 26.2.17; off by less than 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = (poly + c) * t
    upper = poly * F.exp(-x * x / 2) / (2 * math.pi) ** 0.5
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def t_quantile(p: float, df: float) -> float:
    """Cornish and Fisher's expansion of Student's t around the normal."""
    z = normal_quantile(p)
    return z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df**3)


def t_cdf(x: Column, df: int) -> Column:
    """Student's t distribution with a whole number of degrees of freedom, by its finite sums of powers of the cosine of
    arctan(x / sqrt(df)): exact up to rounding, in as many terms as half the degrees. Beyond 60 degrees the normal
    distribution of a shrunk x stands in, off by less than 1e-4."""
    if df > 60:
        return normal_cdf(x * (1 - 1 / (4 * df)) / F.sqrt(1 + x * x / (2 * df)))
    angle = F.atan(x / math.sqrt(df))
    c2, term, total = F.pow(F.cos(angle), F.lit(2)), F.lit(1.0), F.lit(0.0)
    if df % 2:
        for k in range(1, (df - 1) // 2 + 1):
            total = total + term
            term = term * c2 * (2 * k) / (2 * k + 1)
        inside = 2 / math.pi * (angle + F.sin(angle) * F.cos(angle) * total) if df > 1 else 2 / math.pi * angle
    else:
        for k in range(1, df // 2 + 1):
            total = total + term
            term = term * c2 * (2 * k - 1) / (2 * k)
        inside = F.sin(angle) * total
    return 0.5 + inside / 2


def score_100(x: Column, half: float = 2.5) -> Column:
    """50 at 0, 0 and 100 at minus and plus ``half`` and beyond."""
    return 50 + 50 * clip(x / half, -1.0, 1.0)


def slippage_bps(order_value: Column, traded: Column, base: float) -> Column:
    """Square-root impact of the order's part of the mean traded value."""
    return base * (1 + 3 * F.sqrt(F.greatest(order_value / F.greatest(traded, F.lit(1.0)), F.lit(0.0))))


def round_trip_bps(fee: float, slip: Column) -> Column:
    return 2 * fee + 2 * slip


def model_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are for a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def aliases(code: Column) -> Column:
    """The code, its canonical form, and that with a 0 behind if it has four digits."""
    short = canonical_code(code)
    return F.array_distinct(F.array_compact(F.array(code, short, F.when(short.rlike("^[0-9]{4}$"), F.concat(short, F.lit("0"))))))


def issuer_key(market: Column, code: Column) -> Column:
    m = F.upper(F.trim(market))
    return F.concat_ws(":", m, F.when(m == "JP", canonical_code(F.trim(code))).otherwise(F.trim(code)))


def padded(code: Column, n: int) -> Column:
    return F.when(F.length(code) < n, F.lpad(code, n, "0")).otherwise(code)


def without_suffix(symbol: Column) -> Column:
    return F.regexp_replace(symbol, r"\.[A-Za-z]+$", "")


def symbol_market(symbol: Column, suffixes: dict[str, str], other: str) -> Column:
    """The market of a symbol's suffix."""
    found = F.lit(other)
    for suffix, market in suffixes.items():
        found = F.when(symbol.endswith(suffix), market).otherwise(found)
    return found


def exchange_suffix(exchange: Column, rules: Sequence[tuple[str, str]], other: str = "") -> Column:
    """The suffix of the first name that the exchange contains, whatever the case."""
    found = F.lit(other)
    for name, suffix in reversed(rules):
        found = F.when(F.contains(F.lower(exchange), F.lit(name.lower())), suffix).otherwise(found)
    return found


def clean_name(name: Column, code: Column) -> Column:
    """Null for blanks, written nulls and names that are only the code."""
    n = F.trim(name)
    return F.when((n != "") & ~F.lower(n).isin("nan", "<na>", "none", "null") & (n != code) & ~n.rlike(r"^[0-9]{4}[0-9A-Z]?$"), n)


def first_name(code: Column, *names: Column) -> Column:
    return F.coalesce(*[clean_name(n, code) for n in names], code)


def split_list(text: Column) -> Column:
    """Non-blank parts of a comma-separated text."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def path_part(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"[^0-9A-Za-z._-]+", "_")


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts with a record separator between."""
    return F.sha2(F.concat_ws("\x1e", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256)


def week_start(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def months_inclusive(first: Column, last: Column) -> Column:
    return ((F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first) + 1).cast("long")


def canonical_code(code: Column) -> Column:
    """A five-character code that ends in 0 is the four-character code before it."""
    return F.when((F.length(code) == 5) & code.endswith("0"), F.left(code, F.lit(4))).otherwise(code)
