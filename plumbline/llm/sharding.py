"""Sharding by global byte-size prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm.common import body, salt, salts_for, small, stored, table

#: Groups of equal texts of up to this part of a shard's target are never cut.
WHOLE = 0.05
#: Rows that a slice of the order holds on average at most.
ROWS = 50_000


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", whole: float = WHOLE) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 1 (null: 1). Documents stand in the order of a digest of their text, then a salt
    of the id, then the id. The range of digests is cut into equal slices, which hold like numbers of texts; sums within
    slices, shifted by the totals of earlier slices, give each document its place in the whole corpus, which is cut at equal
    targets. Shards are contiguous in that order and ``slot`` counts from 0 in each. Copies of a text stand side by side; a
    group of up to ``whole`` of a shard's target goes to one shard, larger ones are cut where the target says, so that sizes
    stay near equal. Rows of one group and salt form a cell, summed before anything else: a slice sees cells, not copies.
    Only the slices' totals (one row for some 50,000 documents) pass a single task. ``grown_shard`` is null: the law is
    ``bytes``. Ids may be null or repeat; an empty table gives an empty result. Other columns are not read.
    """
    salts = salts_for(docs.count())
    text = body(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("mark"))
    rows = stored(rows.select("*", salt("id", "mark", salts=salts).alias("salt")), "shard-rows")
    slices = max(16, rows.count() // ROWS)
    part = F.floor((F.shiftright("mark", 32).cast("double") + 2.0**31) / 2.0**32 * slices).cast("long")  # by the digest's upper half

    group = ["part", "mark", "crc", "size"]
    cells = rows.select("*", part.alias("part")).groupBy(*group, "salt").agg(F.count(F.lit(1)).alias("n"))
    cells = stored(cells.select("*", (F.col("n") * F.col("size")).alias("b")), "shard-cells")
    line = Window.partitionBy("part").orderBy("mark", "crc", "size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*group)
    ahead = lambda c: F.coalesce(F.sum(c).over(line), F.lit(0))
    cells = cells.select("*", ahead("n").alias("rows_ahead"), ahead("b").alias("bytes_ahead"))
    cells = cells.select("*", F.min("bytes_ahead").over(same).alias("group_ahead"), F.sum("b").over(same).alias("group_bytes"))
    totals = stored(cells.groupBy("part").agg(F.sum("n").alias("n"), F.sum("b").alias("b")), "shard-slices")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        "part",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("bytes_before"),
        F.sum("b").over(Window.partitionBy()).alias("total"),
    )
    cells = cells.join(small(before, totals.count()), "part").select(
        *group,
        "salt",
        (F.col("rows_before") + F.col("rows_ahead")).alias("row0"),
        (F.col("bytes_before") + F.col("bytes_ahead")).alias("byte0"),
        (F.col("bytes_before") + F.col("group_ahead")).alias("group0"),
        "group_bytes",
        "total",
    )
    cell = ["mark", "crc", "size", "salt"]
    nth = F.row_number().over(Window.partitionBy(*cell).orderBy(F.col("id").asc_nulls_first())) - 1
    middle = F.when(F.col("group_bytes") * shards <= F.col("total") * whole, 2 * F.col("group0") + F.col("group_bytes")).otherwise(2 * (F.col("byte0") + F.col("nth") * F.col("size")) + F.col("size"))
    placed = (
        rows.select("*", nth.alias("nth"))
        .join(cells, cell)
        .select("id", "size", "crc", F.floor(middle.cast("double") * shards / (2 * F.col("total"))).cast("int").alias("shard"), (F.col("row0") + F.col("nth")).alias("place"))
        .withColumn("shard", F.least("shard", F.lit(shards - 1)))
    )
    placed = stored(placed, "shard-placed")
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(  # as many rows as shards
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
