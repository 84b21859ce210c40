"""What a user keeps and opens: saved screens, a security's page, sets of weights, lists of watched securities, alerts, settings."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.operators.screener import MOST, condition

WATCH = ("ticker", "market", "list_name")


def read_screens(settings: DataFrame, key: str = "screener.saved") -> list[dict[str, Any]]:
    """The screens that a table of settings (key, value as JSON) holds under ``key``, one row; without it, or where it holds no
    list, none."""
    found = settings.filter(F.col("key") == key).select("value").first()
    made = json.loads(found[0]) if found and found[0] else []
    return made if isinstance(made, list) else []


def _matches(request: Mapping[str, Any]) -> Column:
    return reduce(lambda a, b: a & b, [condition(f["field"], f["op"], f.get("value")) for f in request.get("filters") or []], F.lit(True))


def run_screens(df: DataFrame, screens: Sequence[Mapping[str, Any]], id_col: str) -> DataFrame:
    """screen_id, name, position, ``id_col``, total, truncated: the page of each saved screen (id, name, request), ties by id.

    All totals come from one scan of ``df``; a screen's rows are the first 500 at most in its order, of which Spark keeps
    that many a partition, then its page. A screen that nothing matches has one row without position and id. Without
    screens the result is empty.
    """
    empty = df.limit(0).select(F.lit("").alias("screen_id"), F.lit("").alias("name"), F.lit(0).alias("position"), id_col, F.lit(0).cast("long").alias("total"), F.lit(False).alias("truncated"))
    if not screens:
        return empty
    totals = df.agg(*[F.count_if(_matches(s["request"])).alias(str(i)) for i, s in enumerate(screens)])
    totals = totals.select(F.posexplode(F.array(*[str(i) for i in range(len(screens))])).alias("_screen", "total"))
    pages = []
    for i, s in enumerate(screens):
        request = s["request"]
        sort = [F.col(x["field"]).desc_nulls_first() if x.get("dir") == "desc" else F.col(x["field"]).asc_nulls_last() for x in request.get("sort") or []]
        limit, offset = request.get("limit", 50), request.get("offset", 0)
        top = df.filter(_matches(request)).orderBy(*sort, F.col(id_col).asc()).limit(min(MOST, offset + limit))
        nth = F.row_number().over(Window.orderBy(*sort, F.col(id_col).asc()))  # 500 rows at most
        pages.append(top.select(F.lit(i).alias("_screen"), nth.alias("position"), F.col(id_col)).filter(F.col("position") > offset))
    names = F.array(*[F.struct(F.lit(s["id"]).alias("screen_id"), F.lit(s["name"]).alias("name")) for s in screens])
    rows = totals.join(reduce(DataFrame.unionByName, pages), "_screen", "left")
    return rows.select(names[F.col("_screen")].alias("_s"), "*").select("_s.screen_id", "_s.name", "position", id_col, "total", (F.col("total") > MOST).alias("truncated"))


def latest_by(df: DataFrame, keys: Sequence[str], time_col: str, values: Sequence[str]) -> DataFrame:
    """``values`` of each key's latest row as the struct ``latest``; one aggregate, whose partial results are a row a key and task.
    Of rows at one time that with the greatest values counts."""
    return df.filter(F.col(time_col).isNotNull()).groupBy(*keys).agg(F.max(F.struct(time_col, *values)).alias("latest"))


def stock_details(securities: DataFrame, quotes: DataFrame, scores: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every row of ``securities`` (market, ticker, ...) with its reference price (ref_price, ref_change_pct, ref_source,
    ref_as_of, ref_is_delayed), its latest total_score, quant_score and conviction, and the struct key_metrics of its latest
    metrics; null where there is none.

    ``quotes`` has market, ticker, trade_date, close, change_pct and source: the latest one counts, for a Japanese code of four
    characters without any that of its five-character form. ``scores`` and ``metrics`` have market, ticker and as_of.
    """
    on = ["market", "ticker"]
    quote = latest_by(quotes, on, "trade_date", ["close", "change_pct", "source"]).withColumnRenamed("latest", "_own")
    other = quote.select("market", F.col("ticker").alias("_five"), F.col("_own").alias("_other"))
    score = latest_by(scores, on, "as_of", ["total_score", "quant_score", "conviction"]).withColumnRenamed("latest", "_score")
    names = [c for c in metrics.columns if c not in (*on, "as_of")]
    metric = latest_by(metrics, on, "as_of", names).withColumnRenamed("latest", "key_metrics")
    five = F.when((F.col("market") == "JP") & (F.length("ticker") == 4), F.concat("ticker", F.lit("0")))
    rows = securities.withColumn("_five", five).join(quote, on, "left").join(other, ["market", "_five"], "left").join(score, on, "left").join(metric, on, "left")
    q = F.coalesce("_own", "_other")
    return rows.select(
        *securities.columns,
        q["close"].alias("ref_price"), q["change_pct"].alias("ref_change_pct"), q["source"].alias("ref_source"), q["trade_date"].alias("ref_as_of"), F.lit(True).alias("ref_is_delayed"),
        *[F.col("_score")[c].alias(c) for c in ("total_score", "quant_score", "conviction")],
        "key_metrics",
    )


def weight_roles(sets: DataFrame, keys: Sequence[str] = ("market", "horizon"), id_col: str = "weight_set_id") -> DataFrame:
    """``sets`` with role: ``active`` for the newest active one of its keys, ``proposed`` for the newest that is not active, else
    ``history``. Of those made at one time the greatest id is the newest; a null flag is not active, null keys are keys.

    The two newest of each group come from one aggregate, so that a large group is no task's.
    """
    active, made = F.coalesce("is_active", F.lit(False)), F.struct("created_at", id_col)
    newest = sets.groupBy(*keys).agg(F.max(F.when(active, made)).alias("_active"), F.max(F.when(~active, made)).alias("_proposed"))
    rows = sets.alias("s").join(newest.alias("n"), [F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    flag, own = F.coalesce("s.is_active", F.lit(False)), F.col(f"s.{id_col}")
    role = F.when(flag & (own == F.col("_active")[id_col]), "active").when(~flag & (own == F.col("_proposed")[id_col]), "proposed").otherwise("history")
    return rows.select("s.*", role.alias("role"))


def watch(listed: DataFrame, added: DataFrame, now: Column) -> DataFrame:
    """``listed`` (ticker, market, list_name, note, added_at) with ``added`` (the same without added_at; a null list is ``default``):
    new ones are added at ``now``; for one that is there a note replaces its own, nothing else changes. Of notes for one
    security the greatest counts."""
    asked = added.withColumn("list_name", F.coalesce("list_name", F.lit("default"))).groupBy(*WATCH).agg(F.max("note").alias("_note"))
    both = listed.withColumn("_here", F.lit(True)).join(asked, list(WATCH), "full_outer")
    return both.select(*WATCH, F.coalesce("_note", "note").alias("note"), F.when(F.col("_here"), F.col("added_at")).otherwise(now).alias("added_at"))


def unwatch(listed: DataFrame, gone: DataFrame) -> DataFrame:
    return listed.join(gone.select(*WATCH), list(WATCH), "left_anti")


def alerts(df: DataFrame, unread_only: bool = False, limit: int = 50) -> DataFrame:
    """The newest alerts, ties by id, each beside unread_count, the number of all that are not read; a null flag is not read."""
    unread = ~F.coalesce("is_read", F.lit(False))
    count = df.agg(F.count_if(unread).alias("unread_count"))
    rows = df.filter(unread) if unread_only else df
    return rows.orderBy(F.col("created_at").desc_nulls_last(), "alert_id").limit(limit).join(F.broadcast(count))  # one row


def marked_read(df: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """``df`` with the alerts of ``read`` (alert_id) marked as read; without it, all."""
    if read is None:
        return df.withColumn("is_read", F.lit(True))
    seen = read.select("alert_id").distinct().withColumn("_seen", F.lit(True))
    return df.join(seen, "alert_id", "left").withColumn("is_read", F.coalesce("_seen", "is_read")).select(*df.columns)


def patched_settings(settings: DataFrame, updates: Mapping[str, Any], kinds: Mapping[str, type], extra: Sequence[str] = ()) -> DataFrame:
    """``settings`` (key, value as JSON) with ``updates``. Refuses keys outside ``kinds`` and ``extra`` that do not begin with
    ``seed.``, and values that are not of their kind; a whole number is a float."""
    unknown = [k for k in updates if k not in kinds and k not in extra and not k.startswith("seed.")]
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    for k, v in updates.items():
        kind = kinds.get(k)
        if kind and not isinstance(v, (int, float) if kind is float else kind):
            raise ValueError(f"{k} must be of kind {kind.__name__}")
    if not updates:
        return settings
    new = settings.sparkSession.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in updates.items()], "key string, value string")
    return settings.join(new.select("key"), "key", "left_anti").select("key", "value").unionByName(new)
