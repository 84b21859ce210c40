"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.session import ship
from plumbline.staging import discard, keep, scratch, stored, work_dir  # noqa: F401  operators take them from here

#: A hot key (a text, a fingerprint, a length) is dealt over so many cells at least, and rows a cell takes when it is all rows.
SALTS, SALT_ROWS = 64, 100_000
#: Bytes of input that a range partition takes on average at most.
PARTITION_BYTES = 64 << 20
#: A table that joins may be broadcast only if a count shows no more rows; the rows at hand are keys and a few numbers.
BROADCAST_ROWS = 200_000

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def range_partitions(spark: SparkSession, total_bytes: int) -> int:
    """A number of partitions that follows the data; at least one a core, and as many as the session has for shuffles."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // PARTITION_BYTES))


def running(df: DataFrame, order: Sequence[Column | str], sums: Mapping[str, Column], name: str) -> DataFrame:
    """``df`` with nth, its number from 1 in a total ``order``, and the running ``sums``, each with the row itself. Rows lie in range
    partitions; only a row of totals for each partition passes a single task."""
    rows = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    rows = stored(rows.select("*", *[x.alias(f"_s_{c}") for c, x in sums.items()], F.lit(1).cast("long").alias("_s_nth"), F.spark_partition_id().alias("_part")), name)
    names = [*sums, "nth"]
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("_part").agg(*[F.sum(f"_s_{c}").alias(f"_s_{c}") for c in names])
    cells = cells.select("_part", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in names])
    out = rows.select("*", *[F.sum(f"_s_{c}").over(here).alias(f"_r_{c}") for c in names]).join(F.broadcast(cells), "_part")  # a row a partition
    return out.select(*df.columns, *[(F.col(f"_r_{c}") + F.col(f"_b_{c}")).alias(c) for c in names])


def salts_for(rows: int) -> int:
    """Cells of a hot key: with a third of all rows on one key a cell has fewer than SALT_ROWS."""
    return max(SALTS, rows // SALT_ROWS)


def salt(*by: Column | str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for a join, broadcast only if its counted ``rows`` are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def body(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id written as text, by modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs inside (long texts and tiles of vectors else make batches of
    gigabytes), and workers that find this package. The session's own setting comes back at the end."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
