"""A filter language for screens, compiled to columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

MOST = 500


def condition(field: str, op: str, value: Any = None) -> Column:
    """A null fails every operator but ``is_null``; an unknown operator lets every row pass."""
    c = F.col(field)
    made = {
        "eq": lambda: c == value,
        "ne": lambda: c != value,
        "gt": lambda: c > value,
        "gte": lambda: c >= value,
        "lt": lambda: c < value,
        "lte": lambda: c <= value,
        "in": lambda: c.isin(list(value)),
        "not_in": lambda: ~c.isin(list(value)),
        "between": lambda: c.between(*value),
        "is_null": c.isNull,
        "is_not_null": c.isNotNull,
    }.get(op)
    if made is None:
        return F.lit(True)
    return made() if op == "is_null" else c.isNotNull() & made()


def screen(df: DataFrame, filters: Sequence[Mapping[str, Any]], sort: Sequence[tuple[str, bool]], columns: Sequence[str], limit: int = 50, offset: int = 0, tie: str | None = None) -> DataFrame:
    """All conditions hold; sorted by (field, descending): descending puts nulls first, ascending last. At most 500 rows
    are ranked, then paged; columns that do not exist are null."""
    kept = df.filter(reduce(lambda a, b: a & b, [condition(f["field"], f["op"], f.get("value")) for f in filters], F.lit(True)))
    order = [F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_last() for c, down in sort]
    kept = kept.orderBy(*order, *([F.col(tie).asc()] if tie else [])).limit(min(MOST, offset + limit)).offset(offset)
    return kept.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
