"""Similarity join of texts, and lessons that are learned, repeated and forgotten."""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.session import ship
from plumbline.staging import stored

#: Texts of up to so many characters are compared by single characters: pairs of characters promise them nothing.
SHORT = 8


def fewest_common(n: int, q: int, least: float) -> int:
    """Grams that a text of ``n`` characters shares, counted with repeats, with any text whose ratio is ``least`` or more.

    The ratio is 2 m / (n + k) of m matched characters. The other length k is at least n r / (2 - r), and then m is at least
    r (n + k) / 2. Matched characters are common single ones. They stand in blocks between which some character is
    unmatched, so that there are at most n + k - 2 m + 1 blocks and at least 3 m - n - k - 1 common pairs. Both grow with k.
    """
    k = max(0, math.ceil(n * least / (2 - least) - 1e-9))
    m = math.ceil(least * (n + k) / 2 - 1e-9)
    return m if q == 1 else 3 * m - n - k - 1


def _grams(least: float) -> Callable:
    reach = math.floor(SHORT * (2 - least) / least + 1e-9)  # the longest text that a short one can resemble

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids, gram, nth, left = [], [], [], []
            for i, text in zip(x["id"].to_pylist(), x["text"].to_pylist()):
                n = len(text)
                for q in (1, 2):
                    if n > reach if q == 1 else n <= SHORT:
                        continue
                    seen: Counter = Counter()
                    grams = [text[j : j + q] for j in range(n - q + 1)] or [""]  # the empty text resembles itself
                    for g in grams:
                        seen[g] += 1
                        ids.append(i)
                        gram.append(g)
                        nth.append(seen[g])
                    left += [len(grams) - max(1, fewest_common(n, q, least)) + 1] * len(grams)
            yield pa.RecordBatch.from_arrays([pa.array(ids, x["id"].type), pa.array(gram, pa.string()), pa.array(nth, pa.int32()), pa.array([min(2, len(g)) for g in gram], pa.int32()), pa.array(left, pa.int32())], ["id", "gram", "nth", "q", "left"])

    return run


def _ratios(least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            matcher, last, out = difflib.SequenceMatcher(None), None, []
            for a, b in zip(x["a_text"].to_pylist(), x["b_text"].to_pylist()):
                if b != last:
                    matcher.set_seq2(b)  # what is learned of the second text serves all its partners
                    last = b
                matcher.set_seq1(a)
                ratio = -1.0
                if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least:
                    ratio = matcher.ratio()
                out.append(ratio if ratio >= least else None)
            yield pa.RecordBatch.from_arrays([x["a"], x["b"], pa.array(out, pa.float64())], ["a", "b", "ratio"])

    return run


def similar_texts(left: DataFrame, right: DataFrame, least: float = 0.85) -> DataFrame:
    """a, b, ratio: pairs of a row of ``left`` and one of ``right`` (id, text) whose sequence ratio is ``least`` or more.

    The ratio is that of ``difflib.SequenceMatcher(None, a, b)``. Candidates share one of their rarest grams: a text whose
    partners share at least c of its g grams has one of theirs among its g - c + 1 rarest ones, whatever the order, if all
    agree on it; and lengths must allow the ratio. So no pair is lost and most are never formed. Each candidate is compared
    once, whole texts. Ids are not null and do not repeat on a side; null texts count as empty, which resemble only each other.
    The join on grams is a plain shuffle on both sides, which adaptive execution splits where a gram is frequent.
    """
    if not 2 / 3 < least <= 1:
        raise ValueError("pairs of characters promise nothing at a ratio of 2/3 or less")
    spark = left.sparkSession
    ship(spark)
    sides = []
    for df in (left, right):
        sides.append(stored(df.select("id", F.coalesce("text", F.lit("")).alias("text")), "similar-texts"))
    grams = []
    for df in sides:
        kind = df.schema["id"].dataType.simpleString()
        grams.append(stored(df.mapInArrow(_grams(least), f"id {kind}, gram string, nth int, q int, left int"), "similar-grams"))
    counts = grams[0].select("gram", "nth").unionAll(grams[1].select("gram", "nth")).groupBy("gram", "nth").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "similar-counts")
    rare = []
    for df, texts in zip(grams, sides):
        order = Window.partitionBy("id", "q").orderBy("n", "gram", "nth")
        x = df.join(counts, ["gram", "nth"]).withColumn("place", F.row_number().over(order)).filter("place <= left")
        rare.append(stored(x.select("id", "gram", "nth").join(texts.select("id", F.length("text").alias("n")), "id"), "similar-rare"))
    a, b = rare[0].withColumnsRenamed({"id": "a", "n": "na"}), rare[1].withColumnsRenamed({"id": "b", "n": "nb"})
    alike = 2.0 * F.least("na", "nb") >= least * (F.col("na") + F.col("nb")) - 1e-9
    pairs = stored(a.join(b, ["gram", "nth"]).filter(alike).select("a", "b").distinct(), "similar-pairs")
    pairs = pairs.join(sides[0].withColumnsRenamed({"id": "a", "text": "a_text"}), "a").join(sides[1].withColumnsRenamed({"id": "b", "text": "b_text"}), "b")
    kinds = [df.schema["id"].dataType.simpleString() for df in sides]
    return pairs.select("a", "b", "a_text", "b_text").mapInArrow(_ratios(least), f"a {kinds[0]}, b {kinds[1]}, ratio double").filter("ratio IS NOT NULL")


def lesson_updates(old: DataFrame, new: DataFrame, least: float = 0.85, observations: int = 10) -> DataFrame:
    """lesson_id, decision, memory_id, ratio: what becomes of each lesson of ``new`` (lesson_id, text, n_observations).

    ``refused`` if it rests on fewer than ``observations``; else the most similar active memory of ``old`` (memory_id, text,
    n_observations, is_active) counts, of equal ones the first by id: ``superseded`` says that the lesson has more
    observations than that memory and takes its place, ``known`` that it has not; ``added`` that there is none. Lessons are not
    compared with each other. An unknown number of observations counts as 0.

    Texts are compared, not rows: of memories with one text the first by id stands for all, and what a text finds holds for all
    lessons with it. A text that a memory has itself has found its best, a ratio of 1.
    """
    n = F.coalesce("n_observations", F.lit(0))
    text = F.coalesce("text", F.lit("")).alias("text")
    lessons = new.select("lesson_id", text, n.alias("n"))
    memories = stored(old.filter("is_active").select("memory_id", text).groupBy("text").agg(F.min("memory_id").alias("id")), "lesson-memories")
    asked = lessons.filter(F.col("n") >= observations).groupBy("text").agg(F.min("lesson_id").alias("b"))
    asked = stored(asked.join(memories.select("text", F.col("id").alias("same")), "text", "left"), "lesson-texts")
    equal = F.col("same").isNotNull()
    found = similar_texts(memories, asked.filter(~equal).select(F.col("b").alias("id"), "text"), least)
    first = Window.partitionBy("b").orderBy(F.col("ratio").desc(), "a")
    best = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").join(asked, "b").select("text", F.col("a").alias("memory_id"), "ratio")
    best = best.unionByName(asked.filter(equal).select("text", F.col("same").alias("memory_id"), F.lit(1.0).alias("ratio")))
    best = best.withColumn("n", F.lit(observations))  # texts of lessons that are refused find nothing
    x = lessons.alias("l").join(best.alias("m"), (F.col("l.text") == F.col("m.text")) & (F.col("l.n") >= F.col("m.n")), "left").select("lesson_id", "l.n", "memory_id", "ratio")
    x = x.join(old.select("memory_id", n.alias("old_n")), "memory_id", "left")
    decision = F.when(F.col("n") < observations, "refused").when(F.col("memory_id").isNull(), "added").when(F.col("n") > F.col("old_n"), "superseded").otherwise("known")
    return x.select("lesson_id", decision.alias("decision"), "memory_id", "ratio")


def forgotten(old: DataFrame, fall: float = 0.05, uses: int = 20) -> DataFrame:
    """Memories used so often, after which the hit rate is lower by more than ``fall`` than without: they are deactivated."""
    return old.filter((F.col("hit_rate_after") < F.col("hit_rate_before") - fall) & (F.col("use_count") >= uses)).select("memory_id")


def updated_memories(old: DataFrame, new: DataFrame, decisions: DataFrame) -> DataFrame:
    """``old`` after the update: forgotten memories are inactive, superseded ones have the text and observations of the lesson
    with most of them (of equal ones the first by id), added lessons follow as active memories with the lesson's id."""
    take = decisions.filter("decision = 'superseded'").join(new.select("lesson_id", F.col("text").alias("_text"), F.col("n_observations").alias("_n")), "lesson_id")
    first = Window.partitionBy("memory_id").orderBy(F.col("_n").desc(), "lesson_id")
    take = take.withColumn("_k", F.row_number().over(first)).filter("_k = 1").select("memory_id", "_text", "_n")
    gone = forgotten(old).withColumn("_gone", F.lit(True))
    x = old.join(take, "memory_id", "left").join(gone, "memory_id", "left")
    x = x.withColumns({"text": F.coalesce("_text", "text"), "n_observations": F.coalesce("_n", "n_observations"), "is_active": F.col("is_active") & F.col("_gone").isNull()}).select(*old.columns)
    added = decisions.filter("decision = 'added'").select("lesson_id").join(new, "lesson_id")
    kind = old.schema["memory_id"].dataType
    return x.unionByName(added.select(F.col("lesson_id").cast(kind).alias("memory_id"), "text", "n_observations", F.lit(True).alias("is_active")), allowMissingColumns=True)
