"""Upserts and lake tables."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column] = (), update: bool = True) -> DataFrame:
    """``existing`` with ``incoming`` by key. Of incoming rows with one key the first in ``order`` counts, without an order the
    greatest by its columns; only columns that it supplies change, unknown ones are dropped; ``update=False`` leaves rows
    that exist. Rows with a null key are refused."""
    have = [c for c in incoming.columns if c in existing.columns]
    missing = [k for k in keys if k not in have]
    if missing:
        raise ValueError(f"incoming rows lack {missing}")
    bad = " OR ".join(f"{k} IS NULL" for k in keys)
    rows = incoming.withColumn("_bad", F.when(F.expr(bad), F.raise_error(F.lit("a key is null"))).otherwise(F.lit(False))).filter(~F.col("_bad")).drop("_bad")
    order = list(order) or [F.col(c).desc_nulls_last() for c in incoming.columns if c not in keys] or [F.lit(1)]
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1")
    new = rows.select(*[F.col(k) for k in keys], F.struct(*have).alias("_new"))
    both = existing.withColumn("_old", F.lit(True)).join(new, list(keys), "full_outer")

    def value(c: str) -> Column:
        if c in keys or c not in have:
            return F.col(c)
        take = F.col("_new").isNotNull() & (F.lit(update) | F.col("_old").isNull())
        return F.when(take, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*[value(c) for c in existing.columns])


def write_lake(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Zstandard Parquet; with partitions only those that ``df`` has are replaced."""
    w = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    w.parquet(path)


def read_lake(spark: SparkSession, path: str, columns: Sequence[str] | None = None, filters: Sequence[tuple[str, str, Any]] = ()) -> DataFrame:
    """Conjunctive filters (=, !=, >, >=, <, <=, in), which reach the scan, then the columns."""
    df = spark.read.parquet(path)
    ops = {"=": "__eq__", "!=": "__ne__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}
    for c, op, v in filters:
        df = df.filter(F.col(c).isin(list(v)) if op == "in" else getattr(F.col(c), ops[op])(v))
    return df.select(*columns) if columns else df


def content_hash(df: DataFrame) -> Column:
    """SHA-256 of a row as JSON with sorted keys; nulls are kept out."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)


def accepted(df: DataFrame, violations: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that may be stored, and the others with the names of what they violate."""
    rows = df.withColumn("violations", violations)
    return rows.filter(F.size("violations") == 0).drop("violations"), rows.filter(F.size("violations") > 0)


def with_citations(summaries: DataFrame) -> DataFrame:
    """Raises, when it runs, for a summary without citations."""
    none = F.coalesce(F.size("citations") <= 0, F.lit(True))
    return summaries.withColumn("_bad", F.when(none, F.raise_error(F.concat(F.lit("no citations: "), F.col("doc_id").cast("string")))).otherwise(F.lit(False))).filter(~F.col("_bad")).drop("_bad")


def with_run_defaults(runs: DataFrame, defaults: dict[str, Any], id_col: str = "run_id") -> DataFrame:
    """Runs with an id of their own where it is null, and defaults for fields that are absent or null."""
    rows = runs.withColumn(id_col, F.coalesce(id_col, F.expr("uuid()")) if id_col in runs.columns else F.expr("uuid()"))
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) if c in runs.columns else F.lit(v) for c, v in defaults.items()})


def export(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")


def route(frames: dict[str, DataFrame], stored: dict[str, tuple[DataFrame, Sequence[str]]]) -> dict[str, DataFrame]:
    """Each incoming frame upserted into the table of its name; frames of unknown tables are refused."""
    unknown = set(frames) - set(stored)
    if unknown:
        raise ValueError(f"no such tables: {sorted(unknown)}")
    return {name: upsert(stored[name][0], df, stored[name][1]) for name, df in frames.items()}


def write_raw(df: DataFrame, folder: str, source: str, as_of: str) -> None:
    """Payload rows as gzipped JSON lines below source and date; a day may be written again."""
    df.write.mode("overwrite").option("compression", "gzip").json(f"{folder}/source={source}/dt={as_of}")


def read_raw(spark: SparkSession, folder: str, schema: Any = None, source: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Raw rows with their source and dt, in that order; only folders of the range are read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.option("basePath", folder).json(folder)
    if source is not None:
        df = df.filter(F.col("source") == source)
    if since is not None:
        df = df.filter(F.col("dt") >= F.lit(since).cast("date"))
    if until is not None:
        df = df.filter(F.col("dt") <= F.lit(until).cast("date"))
    return df.orderBy("source", "dt")


def raw_dates(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).json(folder).select("source", "dt").distinct()


ENVELOPE = "seq long, as_of string, fetched_at string, request string, payload string"


def write_envelopes(payloads: DataFrame, folder: str, source: str, endpoint: str, as_of: str, fetched_at: str, order: Sequence[Column | str]) -> int:
    """Rows with payload and, if they have one, request as gzipped envelopes below source, endpoint and date, numbered on from those
    that are there, in ``order``; the number of the last. What was written before stays."""
    spark = payloads.sparkSession
    at = f"{folder}/source={source}/endpoint={endpoint}/dt={as_of}"
    before = spark.read.schema(ENVELOPE).json(at).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] if lake_exists(spark, at) else 0
    request = F.col("request").cast("string") if "request" in payloads.columns else F.lit(None).cast("string")
    nth = F.row_number().over(Window.orderBy(*order))  # the pages of one fetch
    rows = payloads.select((nth + before).alias("seq"), F.lit(as_of).alias("as_of"), F.lit(fetched_at).alias("fetched_at"), request.alias("request"), F.col("payload").cast("string").alias("payload"))
    rows.write.mode("append").option("compression", "gzip").json(at)
    return spark.read.schema(ENVELOPE).json(at).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]


def replay(spark: SparkSession, folder: str, source: str | None = None, endpoint: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Envelopes in the order of their folders and numbers; only folders of the range are read. None where nothing was written."""
    whole = f"{ENVELOPE}, source string, endpoint string, dt date"
    if not lake_exists(spark, folder):
        return spark.createDataFrame([], whole)
    rows = spark.read.schema(whole).option("basePath", folder).json(folder)
    for column, wanted in (("source", source), ("endpoint", endpoint)):
        rows = rows if wanted is None else rows.filter(F.col(column) == wanted)
    rows = rows if since is None else rows.filter(F.col("dt") >= F.lit(since).cast("date"))
    rows = rows if until is None else rows.filter(F.col("dt") <= F.lit(until).cast("date"))
    return rows.orderBy("source", "endpoint", "dt", "seq")


def read_csv(spark: SparkSession, path: str, schema: str, needed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of uploaded CSV files with a header: good ones, and those that do not parse or lack a needed value, with the number of
    their line (the header is line 1) and its text. Columns follow the schema; blank lines are passed over. A file is one text
    in memory, as an upload is, and a quoted value holds no line end."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "record"))
    lines = lines.filter((F.col("line") > 0) & (F.trim("record") != "")).withColumn("line", F.col("line") + 1)
    df = lines.withColumn("_row", F.from_csv("record", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).select("_row.*", "line", "record")
    lacks = F.exists(F.array(*[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in needed]), lambda v: v == "")
    rows = df.withColumn("_lacks", lacks)
    return rows.filter("_bad IS NULL AND NOT _lacks").drop("_bad", "_lacks", "line", "record"), rows.filter("_bad IS NOT NULL OR _lacks").drop("_lacks", "_bad")


def texts(docs: DataFrame, blobs: DataFrame) -> DataFrame:
    """doc_id and text: the document's own, else that of its blob."""
    return docs.join(blobs.select("doc_id", F.col("text").alias("_blob")), "doc_id", "left").select("doc_id", F.coalesce("text", "_blob").alias("text"))


def named(docs: DataFrame, raw: DataFrame) -> DataFrame:
    """Documents whose name is null take that of the raw payload; of several the last by date."""
    last = raw.filter("name IS NOT NULL").groupBy("doc_id").agg(F.max_by("name", "dt").alias("_name"))
    return docs.join(last, "doc_id", "left").withColumn("name_local", F.coalesce("name_local", "_name")).drop("_name")


def lookback_days(configured: int, latest: Any, end: Any, overlap: int = 5) -> int:
    """Days to read again: the gap since the latest date and an overlap, no more than configured."""
    if configured <= 0 or latest is None:
        return configured
    return max(0, min(configured, (end - latest).days + overlap))


def falls_back(gated: DataFrame, ratio: float = 0.5) -> DataFrame:
    """One row: whether so large a part of the rows was rejected that the second source is asked."""
    part = F.try_divide(F.count("reject").cast("double"), F.count(F.lit(1)).cast("double"))
    return gated.agg(part.alias("rejected"), F.coalesce(part >= ratio, F.lit(False)).alias("fallback"))


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # PySpark has no call of its own that asks for a folder of a store
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def lake_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return bool(fs.exists(at))


def lake_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables of a lake: its folders, in order; none where there is no lake."""
    fs, at = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def lake_drop(spark: SparkSession, path: str) -> bool:
    """Whether there was such a table; it is gone afterwards."""
    fs, at = _at(spark, path)
    return bool(fs.exists(at)) and bool(fs.delete(at, True))


def lake_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and time of each file of a lake table; none if there is no such table."""
    if not lake_exists(spark, path):
        return spark.createDataFrame([], "path string, length long, modificationTime timestamp")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", "length", "modificationTime")


def lake_usage(spark: SparkSession, path: str) -> DataFrame:
    return lake_files(spark, path).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def write_texts(docs: DataFrame, folder: str) -> None:
    """doc_id and text as compressed blobs by a digest of the id, 256 folders; ``read_texts`` finds one without reading the others."""
    shard = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 2)
    docs.filter("text IS NOT NULL").select("doc_id", "text", shard.alias("shard")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("shard").parquet(folder)


def read_texts(spark: SparkSession, folder: str, doc_id: Any = None) -> DataFrame:
    rows = spark.read.schema("doc_id string, text string, shard string").parquet(folder)
    if doc_id is not None:
        rows = rows.filter((F.col("shard") == hashlib.md5(str(doc_id).encode()).hexdigest()[:2]) & (F.col("doc_id") == str(doc_id)))
    return rows.drop("shard")


def coerced(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """``df`` with the columns of ``schema`` in its types and no others; absent ones are null. What does not parse, NaN and infinities
    become null; blank texts of other types, too; a time of day with an offset becomes the instant that it names, a date of it
    the date in UTC."""

    def value(c: str, kind: str) -> Column:
        if c not in df.columns:
            return F.lit(None).cast(kind)
        have = df.schema[c].dataType.simpleString()
        x = F.col(c)
        if have in ("double", "float"):
            x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
        elif have == "string" and kind != "string":
            x = F.nullif(F.trim(x), F.lit(""))
            if kind in ("double", "float"):
                x = x.try_cast(kind)
                return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
            if kind == "date":
                return F.to_date(x.try_cast("timestamp"))
        return x.try_cast(kind)

    return df.select(*[value(c, k).alias(c) for c, k in schema.items()])


#: Fixed values of a vendor's plans: weeks of delay, years of history, splits of the cross-validation.
PLANS = {"free": (12, 2, 6), "light": (0, 5, 12)}


def research_cutoff(as_of: Any, plan: str) -> Any:
    """The last date that research may see under a plan with delayed data."""
    import datetime as dt

    return as_of - dt.timedelta(weeks=PLANS[plan][0])
