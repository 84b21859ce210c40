"""Incremental ingestion and windows on event streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from plumbline.sources.sinks import lake_exists, upsert


def file_stream(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _windowed(events: DataFrame, time_col: str, late: str, window: Column, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    out = events.withWatermark(time_col, late).groupBy(window.alias("_w"), *keys).agg(*aggs)
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *[c for c in out.columns if c != "_w"])


def tumbling(events: DataFrame, time_col: str, width: str, late: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Sums by window and key; the state of a window goes when the watermark has passed it."""
    return _windowed(events, time_col, late, F.window(time_col, width), keys, aggs)


def sliding(events: DataFrame, time_col: str, width: str, every: str, late: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return _windowed(events, time_col, late, F.window(time_col, width, every), keys, aggs)


def sessions(events: DataFrame, time_col: str, gap: str, late: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return _windowed(events, time_col, late, F.session_window(time_col, gap), keys, aggs)


def first_seen(events: DataFrame, time_col: str, late: str, keys: Sequence[str]) -> DataFrame:
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark(list(keys))


def upsert_stream(stream: DataFrame, table: str, keys: Sequence[str], order: Sequence[Column], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Micro-batches upserted into a Parquet table of buckets: only the buckets with keys of a batch are read and written
    again, each into a version of its own (``bucket=<b>/v=<id>``), so that a batch that runs again after a failure writes the
    same versions. ``read_stream_table`` takes the last version of each bucket."""
    w = stream.writeStream.foreachBatch(_merger(table, keys, order)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


#: Buckets of a table that a stream feeds.
BUCKETS = 64


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def read_stream_table(spark: SparkSession, table: str, schema, before: int | None = None) -> DataFrame:
    """Rows of the last version of each bucket, of those before a batch if one is named."""
    rows = spark.read.schema(schema).option("basePath", table).parquet(table)
    if before is not None:
        rows = rows.filter(F.col("v") < before)
    last = rows.groupBy("bucket").agg(F.max("v").alias("v"))
    return rows.join(F.broadcast(last), ["bucket", "v"])  # BUCKETS rows


def _merger(table: str, keys: Sequence[str], order: Sequence[Column]) -> Callable[[DataFrame, int], None]:
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = [r[0] for r in batch.select(_bucket(keys).alias("b")).distinct().collect()]  # at most BUCKETS numbers
        if not touched:
            return
        if batch_id and lake_exists(spark, table):  # batches before may have had no rows
            schema = StructType([*batch.schema.fields, StructField("bucket", IntegerType()), StructField("v", IntegerType())])
            old = read_stream_table(spark, table, schema, batch_id).filter(F.col("bucket").isin(touched)).select(*batch.columns)
        else:
            old = batch.limit(0)
        out = upsert(old, batch, keys, order).withColumns({"bucket": _bucket(keys), "v": F.lit(batch_id)})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(table)

    return merge
