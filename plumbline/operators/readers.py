"""Reads of stored tables: ranges, latest rows, lists, pages, memberships and ledgers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.functions.expressions import aliases, canonical_code, issuer_key

PRICE = ("open", "high", "low", "close", "volume")


def _day(d: dt.date | str) -> Column:
    return F.lit(str(d)).cast("date")


def equals(df: DataFrame, **values: Any) -> DataFrame:
    """Rows where each column has its value, or one of a list; None asks for nothing."""
    for c, v in values.items():
        if v is not None:
            df = df.filter(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df


def page(df: DataFrame, order: Sequence[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    df = df.orderBy(*order)
    if limit is not None:
        df = df.limit(offset + limit)
    return df.offset(offset) if offset else df


def price_range(prices: DataFrame, ticker: Any, start: dt.date | str | None = None, end: dt.date | str | None = None, latest: int | None = None, adjusted: bool = False, date_col: str = "session") -> DataFrame:
    """One ticker's bars in time order, both ends included; of them the ``latest``, if asked. ``adjusted`` puts adj_<c> over c
    where it is not null. A code of four digits also finds its five-digit form, if it has no bars itself."""
    rows = prices
    if start is not None:
        rows = rows.filter(F.col(date_col) >= _day(start))
    if end is not None:
        rows = rows.filter(F.col(date_col) <= _day(end))
    if isinstance(ticker, str) and len(ticker) == 4 and ticker.isdigit():
        rows = rows.filter(F.col("ticker").isin(ticker, ticker + "0")).withColumn("_own", F.max(F.col("ticker") == ticker).over(Window.partitionBy()))
        rows = rows.filter((F.col("ticker") == ticker) | ~F.col("_own")).drop("_own")
    else:
        rows = rows.filter(F.col("ticker") == ticker)
    if adjusted:
        rows = rows.withColumns({c: F.coalesce(f"adj_{c}", c) for c in PRICE if f"adj_{c}" in prices.columns})
    if latest is not None:
        rows = rows.orderBy(F.col(date_col).desc()).limit(latest)
    return rows.orderBy(date_col)


def cross_section(prices: DataFrame, tickers: Sequence[Any] | None = None, start: dt.date | str | None = None, end: dt.date | str | None = None, date_col: str = "session", **values: Any) -> DataFrame:
    rows = equals(prices, ticker=list(tickers) if tickers is not None else None, **values)
    if start is not None:
        rows = rows.filter(F.col(date_col) >= _day(start))
    if end is not None:
        rows = rows.filter(F.col(date_col) <= _day(end))
    return rows.orderBy("ticker", date_col)


def resolve_security(securities: DataFrame, code: Column | str) -> DataFrame:
    """The row of a code or one of its aliases: one with a name before one without, then the shortest code."""
    wanted = aliases(code if isinstance(code, Column) else F.lit(code))
    rows = securities.filter(F.array_contains(wanted, F.col("ticker")))
    return rows.orderBy(F.col("name").isNull(), F.length("ticker"), "ticker").limit(1)


def resolve_all(securities: DataFrame) -> DataFrame:
    """One row an issuer: canonical code, and the row that stands for it by the same preference; of rows alike in it the first by
    name, then by their other columns, so that reruns and other partitions choose the same."""
    w = Window.partitionBy("market", "canonical").orderBy(F.col("name").isNull(), F.length("ticker"), F.col("valid_from").desc(), "ticker", "name", *_rest(securities))
    return securities.withColumn("canonical", canonical_code(F.col("ticker"))).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _rest(df: DataFrame) -> list[Column]:
    """An order of rows that are alike in what decides: by a digest of all columns, equal only for rows that are alike in all."""
    return [F.xxhash64(*df.columns)]


def search_securities(securities: DataFrame, text: str, columns: Sequence[str], k: int) -> DataFrame:
    """Issuers with the text in one of the columns, whatever the case; exact codes first."""
    found = securities.filter(_any([F.contains(F.lower(c), F.lit(text.lower())) for c in columns]))
    return resolve_all(found).orderBy((F.lower("ticker") == text.lower()).desc(), "ticker").limit(k)


def _any(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def coverage(df: DataFrame, date_col: str, *keys: str) -> DataFrame:
    """The last date that the table has, of each key."""
    return df.groupBy(*keys).agg(F.max(date_col).alias("latest"))


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], as_of: dt.date | str | None = None) -> DataFrame:
    """The last row of each key by ``order``, of those whose first order column is not after ``as_of``."""
    rows = df if as_of is None else df.filter(F.to_date(order[0]) <= _day(as_of))
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def documents(docs: DataFrame, since: dt.date | str | None = None, until: dt.date | str | None = None, limit: int | None = None, offset: int = 0, time_col: str = "filed_at", id_col: str = "doc_id", **values: Any) -> DataFrame:
    """Newest first; ``until`` includes its whole day; lists of values ask for any of them."""
    rows = equals(docs, **values)
    if since is not None:
        rows = rows.filter(F.to_date(time_col) >= _day(since))
    if until is not None:
        rows = rows.filter(F.to_date(time_col) <= _day(until))
    return page(rows, [F.col(time_col).desc(), F.col(id_col)], limit, offset)


def with_membership(docs: DataFrame, members: DataFrame | None, keys: Sequence[str], flag: str | None = None) -> DataFrame:
    """Rows whose key is a member, or with ``flag`` all rows and whether it is."""
    if members is None:
        return docs
    m = members.select(*keys).distinct()
    if flag is None:
        return docs.join(m, list(keys), "left_semi")
    return docs.join(m.withColumn("_m", F.lit(True)), list(keys), "left").withColumn(flag, F.col("_m").isNotNull()).drop("_m")


def preferred(docs: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is a member; all rows if no key is. Whether any is comes from an aggregate of one row."""
    x = with_membership(docs, members, keys, "_in")
    found = x.agg(F.coalesce(F.max("_in"), F.lit(False)).alias("_any"))
    return x.join(F.broadcast(found)).filter("_in OR NOT _any").drop("_in", "_any")


def cached_summary(summaries: DataFrame, prompt_hash: str, input_hash: str) -> DataFrame:
    """Documents whose latest summary was made of this prompt and input."""
    last = latest_rows(summaries, ["doc_id"], ["summary_version"])
    return last.filter((F.col("prompt_hash") == prompt_hash) & (F.col("input_hash") == input_hash))


def recommendations(recs: DataFrame, verdict: str | None = "unset", limit: int | None = None, offset: int = 0, **values: Any) -> DataFrame:
    """Latest and surest first. Verdict "unset": all but rejected ones; None: those without a verdict; else that verdict."""
    rows = equals(recs, **values)
    v = F.col("verdict")
    rows = rows.filter(F.coalesce(v, F.lit("approved")) != "rejected" if verdict == "unset" else v.isNull() if verdict is None else v == verdict)
    return page(rows, [F.col("as_of").desc(), F.col("conviction_score").desc_nulls_last(), F.col("rec_id")], limit, offset)


def outcomes(outs: DataFrame, recs: DataFrame, since: dt.date | str | None = None, limit: int | None = None, **values: Any) -> DataFrame:
    """Outcomes with their recommendation, latest entry first."""
    rows = equals(outs.join(recs, "rec_id"), **values)
    if since is not None:
        rows = rows.filter(F.col("entry_date") >= _day(since))
    return page(rows, [F.col("entry_date").desc(), F.col("rec_id")], limit)


def scores(df: DataFrame, sort: str, down: bool, allowed: Sequence[str], limit: int, offset: int = 0, **values: Any) -> DataFrame:
    """Nulls last either way; only columns of ``allowed`` sort."""
    if sort not in allowed:
        raise ValueError(f"sort is one of {', '.join(allowed)}")
    order = F.col(sort).desc_nulls_last() if down else F.col(sort).asc_nulls_last()
    return page(equals(df, **values), [order, F.col("ticker")], limit, offset)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def peers(securities: DataFrame, k: int = 8) -> DataFrame:
    """ticker, peer, nth: the first ``k`` others of the same market and sector, by ticker.

    The first k + 1 of each sector are all that any of its members needs: they are joined, not the sector with itself.
    """
    w = Window.partitionBy("market", "sector").orderBy("ticker")
    numbered = securities.withColumn("_n", F.row_number().over(w))
    first = numbered.filter(F.col("_n") <= k + 1).select("market", "sector", F.col("ticker").alias("peer"), F.col("_n").alias("_p"))
    x = numbered.join(first, ["market", "sector"]).filter(F.col("ticker") != F.col("peer"))
    nth = F.col("_p") - (F.col("_p") > F.col("_n")).cast("int")
    return x.select("ticker", "peer", nth.alias("nth")).filter(F.col("nth") <= k)


def changed(stored: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows with the patch's values where these are not null; keys that are not stored add nothing."""
    cols = [c for c in patch.columns if c not in keys]
    p = patch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols])
    x = stored.join(p, list(keys), "left")
    return x.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in stored.columns])


def without(stored: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def single_active(weights: DataFrame, chosen: str, keys: Sequence[str], id_col: str = "weight_set_id") -> DataFrame:
    """In the groups of the chosen set it alone is active; other groups stay as they are."""
    here = F.max(F.col(id_col) == chosen).over(Window.partitionBy(*keys))
    return weights.withColumn("active", F.when(here, F.col(id_col) == chosen).otherwise(F.col("active")))


def stale_jobs(runs: DataFrame, now: str, hours: int = 2) -> DataFrame:
    """Runs that say they run and started so many hours ago or earlier."""
    return runs.filter((F.col("status") == "running") & (F.col("started_at") <= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")))


def trades(journal: DataFrame, start: str | None = None, end: str | None = None, linked: bool | None = None, limit: int = 100, offset: int = 0, **values: Any) -> DataFrame:
    rows = equals(journal, **values)
    if start is not None:
        rows = rows.filter(F.col("traded_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.filter(F.col("traded_at") < F.lit(end).cast("timestamp"))
    if linked is not None:
        rows = rows.filter(F.col("rec_id").isNotNull() if linked else F.col("rec_id").isNull())
    return page(rows, [F.col("traded_at").desc(), F.col("trade_id")], limit, offset)


def trade_counts(journal: DataFrame) -> DataFrame:
    return journal.agg(F.count(F.lit(1)).alias("n"), F.count("rec_id").alias("linked"), F.count_if(F.col("rec_id").isNull()).alias("discretionary"))


def week_of(docs: DataFrame, as_of: dt.date | str, time_col: str) -> DataFrame:
    """From Monday of the week to the day itself."""
    d = F.to_date(time_col)
    return docs.filter((d >= F.date_trunc("week", _day(as_of)).cast("date")) & (d <= _day(as_of)))


def cached_results(requests: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """Requests with the cached result of their key, and whether there is one."""
    hits = cache.select(F.col("key").alias("_key"), F.col("result"), F.lit(True).alias("_hit"))
    return requests.withColumn("key", key).join(hits, F.col("key") == F.col("_key"), "left").withColumn("hit", F.col("_hit").isNotNull()).drop("_key", "_hit")


def cards_by_issuer(scores_: DataFrame, cards: DataFrame) -> DataFrame:
    """Scores, then cards of issuers that have no score; four- and five-character codes of an issuer are one key. Of rows with one
    code the same one stays whatever the partitions."""
    key = lambda df: df.withColumn("issuer", issuer_key(F.col("market"), F.col("ticker")))
    s, c = key(scores_), key(cards)
    one = lambda df: Window.partitionBy("issuer").orderBy(F.length("ticker"), "ticker", *_rest(df))
    s = s.withColumn("_n", F.row_number().over(one(s))).filter("_n = 1").drop("_n")
    c = c.withColumn("_n", F.row_number().over(one(c))).filter("_n = 1").select("issuer", F.col("ticker").alias("card_ticker"), F.col("rec_id"))
    return s.join(c, "issuer", "full_outer").select("issuer", F.coalesce("ticker", "card_ticker").alias("ticker"), "score", "rec_id", F.col("ticker").isNull().alias("only_card"))


def inputs(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], as_of: dt.date | str) -> dict[str, DataFrame]:
    """Each table as it was known: filtered by the first of its time columns that it has; empty tables are left out."""
    out = {}
    for name, (df, times) in tables.items():
        column = next((c for c in times if c in df.columns), None)
        if column is not None:
            seen = df.filter(F.to_date(column) <= _day(as_of))
            if seen.limit(1).count():
                out[name] = seen
    return out


def visibility(df: DataFrame, time_col: str, as_of: dt.date | str) -> DataFrame:
    seen = F.to_date(time_col) <= _day(as_of)
    return df.agg(F.count(F.lit(1)).alias("rows_total"), F.count_if(seen).alias("rows_visible"), F.max(F.when(seen, F.to_date(time_col))).alias("latest_visible"))


def all_tables(spark: SparkSession, names: Sequence[str], folder: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
