"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.llm.common import body, range_partitions, running, stored, table

WORD = r"[^\x20\x09-\x0D]+"
#: A partition of the shuffle order or a slice of virtual time holds about so many rows; there are at least LEAST slices.
ROWS, LEAST = 20_000, 256


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    share: float = 1.0,
    repeat: int = 3,
    seed: int = 17,
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken.

    Size is the number of words. Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of
    all sizes; a target stops at ``repeat`` times its source's size and the excess goes to the others by weight. Within a
    source the documents stand in a shuffled order (MD5 of id and seed) and are offered up to ``repeat`` times. A copy's
    virtual finish time is its source's cumulative size up to it, divided by the target; all copies in that order are
    taken until the budget is spent, the last one in part. ``taken`` counts a document's words, repeats included.

    The shuffle order lies in range partitions, whose splitters are sampled, so that a hot source or a repeated id is cut;
    virtual time is cut into slices of its own. Running sums are made within both and added to the sums of what is earlier.
    Sources, however many, are numbered and summed in the same way. Only the sums of partitions and slices (a row for some
    20,000 documents) pass a single task. Null and blank texts have size 0: they are never taken and do not queue. Ids may
    repeat or be null: the order goes on by id and a digest of the text, and rows that agree in these are interchangeable, so that
    reruns agree whatever the order or the partitions of the rows. An empty table gives an empty result.
    """
    if not 0 < share <= repeat or not weights or min(weights) <= 0:
        raise ValueError("share lies in (0, repeat]; weights are positive")
    key = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    # skey: not null, in the order of sources by code point, null last
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("a"), F.col(source_col).cast("string")), F.lit("b")).alias("skey"),
        F.regexp_count(body(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(body(text_col)).alias("mark"),
    )
    rows = stored(rows.select("*", key.alias("key"), F.monotonically_increasing_id().alias("copy")), "mix-sizes")
    n = rows.count()
    slices = max(LEAST, n // ROWS)

    # The water level is the largest of the levels found when the sources with the lowest caps are taken as capped.
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    sizes = running(rows.groupBy("skey").agg(F.sum("size").alias("source_size")), ["skey"], {}, "mix-sources")
    sizes = stored(sizes.select("skey", "source_size", w.alias("w"), (F.col("source_size") * repeat / w).alias("cap_level")), "mix-weights")
    sums = sizes.agg((F.sum("source_size") * share).alias("budget"), F.sum("w").alias("all_w"))
    levels = running(sizes, ["cap_level", "skey"], {"caps": F.col("source_size") * repeat, "ws": F.col("w")}, "mix-levels").join(F.broadcast(sums))
    level = (F.col("budget") - (F.col("caps") - F.col("source_size") * repeat)) / (F.col("all_w") - F.col("ws") + F.col("w"))
    levels = stored(levels.select("skey", "source_size", "w", "budget", level.alias("level")), "mix-found")
    top = levels.agg(F.max("level").alias("top"))  # one row
    targets = levels.join(F.broadcast(top)).select("skey", "source_size", "budget", F.least(F.col("source_size") * float(repeat), F.col("top") * F.col("w")).alias("target"))
    targets = stored(targets, "mix-targets")

    blank = rows.filter("size = 0").join(targets, "skey").select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    order = ["key", F.col("id").asc_nulls_first(), "mark", "copy"]
    rows = rows.filter("size > 0").repartitionByRange(max(range_partitions(docs.sparkSession, 0), n // ROWS), "skey", *order)
    rows = stored(rows.select("id", "skey", "size", "mark", "key", "copy", F.spark_partition_id().alias("part")), "mix-order")
    line = Window.partitionBy("skey", "part").orderBy(*order)
    rows = rows.select("*", F.row_number().over(line).alias("nth"), F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    cells = rows.groupBy("skey", "part").agg(F.sum("size").alias("cell"))
    earlier = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("skey", "part", F.coalesce(F.sum("cell").over(earlier), F.lit(0)).alias("ahead")).join(targets, "skey")
    times = F.greatest(F.lit(1), F.ceil(F.col("target") / F.col("source_size"))).cast("int")
    finish = (F.col("turn") * F.col("source_size") + F.col("ahead") + F.col("run")).cast("double") / F.col("target")
    copies = (
        rows.join(cells, ["skey", "part"])
        .select("*", F.explode(F.sequence(F.lit(0), times - 1)).alias("turn"))
        .select("id", "skey", "part", "nth", (F.col("ahead") + F.col("run")).alias("place"), "size", "source_size", "target", "budget", "turn", finish.alias("finish"))
        .select("*", _slice(F.col("finish"), slices).alias("era"))
    )
    copies = stored(copies, "mix-copies")
    eras = copies.groupBy("era").agg(F.sum("size").alias("cell"))
    eras = eras.select("era", F.coalesce(F.sum("cell").over(Window.orderBy("era").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    queue = Window.partitionBy("era").orderBy("finish", "skey", "turn", "place").rowsBetween(Window.unboundedPreceding, 0)
    left = F.floor("budget").cast("long") - F.col("ahead") - (F.col("run") - F.col("size"))
    mixed = (
        copies.select("*", F.sum("size").over(queue).alias("run"))
        .join(eras, "era")
        .select("*", F.greatest(F.lit(0), F.least(F.col("size"), left)).alias("took"))
        .groupBy("skey", "part", "nth", "id", "size", "source_size", "target")
        .agg(F.sum("took").alias("taken"))
        .select("id", "size", "source_size", "target", "taken")
    )
    return mixed.unionByName(blank).withColumnRenamed("id", id_col)


def _slice(x: Column, slices: int) -> Column:
    return F.floor(x * slices).cast("long")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = {
    "op8_mixing": r"""
        WITH sized AS (
          SELECT doc_id AS id, coalesce('a' || source, 'b') AS skey,
                 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                 md5(coalesce(doc_id::VARCHAR, '') || ':17') AS key FROM documents),
        per AS (SELECT skey, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
        weighed AS (SELECT *, ((row_number() OVER (ORDER BY encode(skey)) - 1) % 3 + 1)::BIGINT AS w FROM per),
        capped AS (SELECT *, (source_size * 3)::DOUBLE / w AS cap_level, (sum(source_size) OVER ())::DOUBLE AS budget FROM weighed),
        levels AS (SELECT *, (budget - coalesce(sum(source_size * 3) OVER (ORDER BY cap_level, encode(skey) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                      / (sum(w) OVER (ORDER BY cap_level, encode(skey) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM capped),
        targets AS (SELECT skey, source_size, budget, least(source_size * 3.0::DOUBLE, max(level) OVER () * w) AS target FROM levels),
        run AS (SELECT s.*, t.source_size, t.budget, t.target,
                       sum(size) OVER (PARTITION BY s.skey ORDER BY key, id ROWS UNBOUNDED PRECEDING) AS run,
                       greatest(1, ceil(coalesce(t.target / nullif(t.source_size, 0), 1)))::BIGINT AS times
                FROM sized s JOIN targets t USING (skey)),
        copies AS (SELECT *, coalesce((turn * source_size + run)::DOUBLE / nullif(target, 0), 0) AS finish
                   FROM (SELECT *, unnest(range(times)) AS turn FROM run)),
        queue AS (SELECT *, sum(size) OVER (ORDER BY finish, encode(skey), key, id, turn ROWS UNBOUNDED PRECEDING) - size AS ahead FROM copies)
        SELECT id AS doc_id, size, source_size, target,
               sum(greatest(0, least(size, floor(budget)::BIGINT - ahead)))::BIGINT AS taken
        FROM queue GROUP BY id, size, source_size, target
    """,
}
