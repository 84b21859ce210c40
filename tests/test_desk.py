"""What a user keeps and opens, on known answers."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import desk as D


def test_saved_screens(spark):
    df = spark.createDataFrame([(i, float(i % 3) if i % 4 else None) for i in range(700)], "id int, x double")
    screens = [
        {"id": "s", "name": "top", "request": {"filters": [], "sort": [{"field": "x", "dir": "desc"}], "limit": 3, "offset": 1}},
        {"id": "t", "name": "none", "request": {"filters": [{"field": "x", "op": "gt", "value": 9}]}},
        {"id": "u", "name": "past the end", "request": {"filters": [{"field": "id", "op": "lt", "value": 2}], "offset": 5}},
    ]
    settings = spark.createDataFrame([("screener.saved", json.dumps(screens))], "key string, value string")
    found = {}
    for r in D.run_screens(df, D.read_screens(settings), "id").collect():
        found.setdefault(r.screen_id, []).append((r.position, r.id, r.total, r.truncated))
    # descending puts nulls first: multiples of four
    assert sorted(found["s"]) == [(2, 4, 700, True), (3, 8, 700, True), (4, 12, 700, True)]
    assert found["t"] == [(None, None, 0, False)] and found["u"] == [(None, None, 2, False)]
    assert D.read_screens(settings.limit(0)) == [] and D.read_screens(settings.withColumn("value", F.lit('{"a": 1}'))) == []
    assert D.run_screens(df, [], "id").count() == 0


def test_stock_details_take_the_longer_code_only_without_quotes(spark):
    sec = spark.createDataFrame([("JP", "1001"), ("JP", "1002"), ("US", "ABCD"), ("JP", None)], "market string, ticker string")
    quotes = spark.createDataFrame(
        [("JP", "1001", "2024-01-02", 5.0, 0.1, "x"), ("JP", "10010", "2024-01-05", 9.0, 0.2, "x"), ("JP", "10020", "2024-01-03", 7.0, None, "y"), ("JP", "10020", None, 8.0, 0.3, "y"), ("US", "ABCD0", "2024-01-03", 1.0, 0.0, "z")],
        "market string, ticker string, trade_date string, close double, change_pct double, source string",
    )
    scores = spark.createDataFrame([("JP", "1001", "2024-01-01", 1.0, 2.0, "low"), ("JP", "1001", "2024-02-01", 3.0, None, "high")], "market string, ticker string, as_of string, total_score double, quant_score double, conviction string")
    metrics = spark.createDataFrame([("US", "ABCD", "2024-01-01", 12.0)], "market string, ticker string, as_of string, per double")
    found = {r.ticker: r for r in D.stock_details(sec, quotes, scores, metrics).collect()}
    assert len(found) == 4
    assert (found["1001"].ref_price, found["1001"].total_score, found["1001"].quant_score, found["1001"].conviction) == (5.0, 3.0, None, "high")
    assert (found["1002"].ref_price, found["1002"].ref_change_pct, found["1002"].ref_as_of) == (7.0, None, "2024-01-03")
    assert found["ABCD"].ref_price is None and found["ABCD"].key_metrics.per == 12.0 and found[None].ref_price is None


def test_weight_roles(spark):
    rows = [("a", 1, True, "JP"), ("b", 3, False, "JP"), ("c", 2, True, "JP"), ("d", 3, None, "JP"), ("e", None, None, "JP"), ("f", None, True, None), ("g", 1, False, "US")]
    sets = spark.createDataFrame(rows, "weight_set_id string, created_at int, is_active boolean, market string").withColumn("horizon", F.lit("H20"))
    found = {r.weight_set_id: r.role for r in D.weight_roles(sets).collect()}
    assert found == {"a": "history", "b": "history", "c": "active", "d": "proposed", "e": "history", "f": "active", "g": "proposed"}
    assert D.weight_roles(sets.limit(0)).columns == [*sets.columns, "role"]


def test_watched_and_alerts(spark):
    listed = spark.createDataFrame([("1", "JP", "default", "old", 1), ("2", "JP", "default", None, 2)], "ticker string, market string, list_name string, note string, added_at int")
    asked = spark.createDataFrame([("1", "JP", None, None), ("2", "JP", None, "n"), ("2", "JP", "other", "o"), ("3", "US", None, None), ("3", "US", None, "x")], "ticker string, market string, list_name string, note string")
    now = D.watch(listed, asked, F.lit(9))
    assert {tuple(r) for r in now.collect()} == {("1", "JP", "default", "old", 1), ("2", "JP", "default", "n", 2), ("2", "JP", "other", "o", 9), ("3", "US", "default", "x", 9)}
    assert {r.ticker for r in D.unwatch(now, listed).collect()} == {"2", "3"}
    a = spark.createDataFrame([(1, 5, False), (2, 7, True), (3, 7, None), (4, None, False)], "alert_id int, created_at int, is_read boolean")
    assert [(r.alert_id, r.unread_count) for r in D.alerts(a, limit=3).collect()] == [(2, 3), (3, 3), (1, 3)]
    assert [r.alert_id for r in D.alerts(D.marked_read(a, a.filter("alert_id = 3")), True).collect()] == [1, 4]
    assert D.alerts(D.marked_read(a), True).count() == 0 and D.alerts(a.limit(0)).count() == 0


def test_settings(spark):
    s = spark.createDataFrame([("ui.theme", '"dark"'), ("risk.cap", "0.2")], "key string, value string")
    kinds = {"ui.theme": str, "risk.cap": float, "jobs.on": bool, "jobs.most": int}
    found = {r.key: json.loads(r.value) for r in D.patched_settings(s, {"risk.cap": 1, "jobs.on": True, "seed.x": [1]}, kinds).collect()}
    assert found == {"ui.theme": "dark", "risk.cap": 1, "jobs.on": True, "seed.x": [1]}
    assert D.patched_settings(s, {}, kinds).count() == 2
    for bad in ({"no.such": 1}, {"jobs.on": 1}, {"jobs.most": 1.5}, {"risk.cap": "x"}):
        with pytest.raises(ValueError):
            D.patched_settings(s, bad, kinds)
