"""Every registered query against its SQL, and without it for rows. No comparison of nothing with nothing counts."""

import pytest

import __spark_entry__ as entry
from plumbline import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, small, duck, rows, tmp_path):
    """The result can be written: no two columns share a name."""
    catalog.QUERIES[name](spark, small).write.parquet(f"{tmp_path}/out")
    found = spark.read.parquet(f"{tmp_path}/out").toPandas()
    assert len(found)
    if name in catalog.SQL:
        assert rows(found) == rows(duck.execute(catalog.SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_rules_decide(duck):
    """Data reach the rules that a query is registered for."""
    kinds = lambda name, column: {k for (k,) in duck.execute(f"SELECT DISTINCT {column} FROM ({catalog.SQL[name]})").fetchall()}
    assert len(kinds("title_types", "title_type")) == 8
    assert len(kinds("actions", "action")) == 5 and len(kinds("conviction", "conviction")) == 3 and len(kinds("reviews", "verdict")) == 3
    assert kinds("forecast_revision", "forecast_revision_direction") >= {-1, 1}
    assert duck.execute(f"SELECT count(*) FROM ({catalog.SQL['issuers']}) WHERE length(ticker) = 5").fetchone()[0] == 0
    assert duck.execute(f"SELECT min(max_drawdown) FROM ({catalog.SQL['backtest_drawdown']})").fetchone()[0] < 0
    assert {p for (p,) in duck.execute(f"SELECT DISTINCT preset FROM ({catalog.SQL['screen_presets']})").fetchall()} >= {"high_growth", "low_vol_dividend"}
