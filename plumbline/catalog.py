"""All queries of the library and the SQL that they are checked against."""

from __future__ import annotations

from plumbline.plans import cards, daily, desk, learned, market, pages, reads, records, series, statements, text, vendor  # noqa: F401  they register their queries
from plumbline.plans.adapter import QUERIES, SQL

FLAGSHIP = "daily_selection"
__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
