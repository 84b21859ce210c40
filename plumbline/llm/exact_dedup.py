"""Exact dedup by content sort (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm.common import body, range_partitions, salt, small, stored, table

#: Part of an average range partition, by rows or bytes, beyond which a text's copies are split.
HOT = 0.25


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hot: float = HOT) -> tuple[DataFrame, DataFrame]:
    """Rows (id, sha, first, keep_id, size, split) after the neighbour comparison, and the texts (sha, keep_id, size) whose
    copies were split.

    Rows are ordered by the first 24 characters, a 64-bit digest and the whole text; splitters are sampled from the first
    two, so that samples stay small whatever the texts' lengths. Each row is compared with its neighbour by whole text:
    where it differs, a run begins, and the run's first row has the id that stays. Only texts that a count proves hot are
    split over several places of the order, and their runs meet by whole text again.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), body(text_col).alias("body")).select("*", F.xxhash64("body").alias("mark"))
    marks = rows.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("body").cast("long") + 16).alias("bytes"))
    marks = stored(marks, "exact-marks")
    n, total = marks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = range_partitions(spark, total)
    most = F.greatest(F.col("n") * parts / (hot * max(n, 1)), F.col("bytes") * parts / (hot * max(total, 1)))
    heavy = marks.filter("n > 1").select("mark", F.ceil(most).cast("int").alias("slots")).filter("slots > 1")  # some 8 a partition at most
    heavy = stored(heavy, "exact-heavy")
    heavy = small(heavy, heavy.count())

    rows = rows.join(heavy, "mark", "left").select(
        "id", "body", F.substring("body", 1, 24).alias("head"), "mark", F.col("slots").isNotNull().alias("split"), F.coalesce(F.pmod(F.xxhash64("id"), "slots"), F.lit(0)).alias("slot")
    )
    place = ["head", "mark", "slot"]
    line = Window.partitionBy(*place).orderBy("body", F.col("id").asc_nulls_last() if keep == "min" else F.col("id").desc_nulls_last())
    rows = rows.repartitionByRange(parts, *place)
    rows = rows.select("*", (~F.lag("body").over(line).eqNullSafe(F.col("body"))).alias("first"))
    since = line.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "id",
        F.sha2("body", 256).alias("sha"),
        "first",
        F.last(F.when(F.col("first"), F.struct("id")), ignorenulls=True).over(since)["id"].alias("keep_id"),
        F.count(F.lit(1)).over(Window.partitionBy(*place, "body")).alias("size"),
        "split",
        F.when(F.col("split") & F.col("first"), F.col("body")).alias("whole"),
    )
    rows = stored(rows, "exact")
    runs = rows.filter("split AND first").groupBy("whole").agg((F.min if keep == "min" else F.max)("keep_id").alias("keep_id"), F.sum("size").alias("size"))
    return rows.drop("whole"), stored(runs.select(F.sha2("whole", 256).alias("sha"), "keep_id", "size"), "exact-split")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hot: float = HOT) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the row with the smallest (``keep='max'``: largest) id stays; of rows that
    repeat id and text, one. A null id stays only if its group has no other. Other columns of ``docs`` are not read. An
    empty table gives an empty result.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    rows, split = content_sort(docs, id_col, text_col, keep, hot)
    columns = ["id", "sha", "first", "keep_id", "size"]
    halves = rows.filter("split").drop("keep_id", "size").join(small(split, split.count()), "sha")
    rows = rows.filter("NOT split").select(*columns).union(halves.select(*columns))
    return rows.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("size").alias("group_size"),
        (F.col("first") & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


SQL = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
