"""Near duplicates by Jaccard similarity: SimHash proposes pairs, the shingle sets themselves confirm them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import body, discard, small, small_batches, stored
from plumbline.llm.components import components
from plumbline.llm.simhash import SEED, _matrix, distinct_shingles, radius_of, simhash_groups

#: Standard deviations that the radius lies above the number of differing bits expected at the similarity asked for.
SPREAD = 3.8
#: Shingles a tile of one candidate group holds on average at most.
TILE = 1 << 16
MEMBER = "key string, id string, group string, mark string, fp array<bigint>, shingles array<bigint>"


def wide_radius(similarity: float, bits: int) -> int:
    """Differing bits scatter around the expected number like a binomial; so many lie within SPREAD deviations above it."""
    p = radius_of(similarity, 10**6) / 10**6
    return int(bits * p + SPREAD * (bits * p * (1 - p)) ** 0.5)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct shingles."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in distinct_shingles(text, width)), "u8"))


def _sets(width: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            made = [shingle_set(t, width) for t in x["body"]]
            marks = [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in made]
            yield pd.DataFrame({"key": x["key"], "id": x["id"], "group": x["group"], "mark": marks, "fp": x["fp"], "shingles": [s.view("i8") for s in made]})

    return run


def confirmed(fa: np.ndarray, sa: list[np.ndarray], fb: np.ndarray, sb: list[np.ndarray], same: bool, radius: int, similarity: float) -> tuple[list[int], list[int]]:
    """Row numbers of a spanning forest of the pairs with this similarity or more; a pair already joined is not looked at again."""
    shift = 0 if same else len(sa)
    label, left, right = np.arange(shift + len(sb)), [], []
    nb = np.array([len(s) for s in sb])
    for r, mine in enumerate(sa):
        n = len(mine)
        near = (np.bitwise_count(fa[r] ^ fb).sum(axis=1, dtype="i4") <= radius) & (np.minimum(n, nb) >= similarity * np.maximum(n, nb) - 1e-6)
        if same:
            near[: r + 1] = False
        for j in np.flatnonzero(near):
            if label[shift + j] == label[r]:
                continue
            both = len(np.intersect1d(mine, sb[j], assume_unique=True))
            every = n + len(sb[j]) - both
            if both >= 1 and both / every >= similarity:
                left.append(r)
                right.append(int(j))
                label[label == label[shift + j]] = label[r]
    return left, right


def _links(words: int, radius: int, similarity: float) -> Callable:
    def tile(x: dict, side: str) -> tuple:
        ends = np.cumsum(np.asarray(x[f"{side}_n"]))
        return x[f"{side}_mark"], _matrix(x[f"{side}_fp"], words), np.split(np.asarray(x[f"{side}_shingles"], "i8").view("u8"), ends[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, bt = [], []
            for x in batch.to_dict("records"):
                a = tile(x, "a")
                same = x["b_mark"] is None
                b = a if same else tile(x, "b")
                left, right = confirmed(*a[1:], *b[1:], same, radius, similarity)
                at += [a[0][i] for i in left]
                bt += [b[0][j] for j in right]
            yield pd.DataFrame({"a": pd.Series(at, dtype=object), "b": pd.Series(bt, dtype=object)})

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", key_col: str = "key", text_col: str = "text", width: int = 5, similarity: float = 0.8, words: int = 3) -> DataFrame:
    """``key`` of each row that goes: of each component of confirmed near duplicates all rows but the one with the smallest id
    (null ids last, then the smallest key).

    Two texts are near duplicates if the sets of their shingles have this Jaccard similarity or more. Fingerprints of the
    sets, of sets whose sizes allow that similarity, give candidate groups at ``wide_radius``; within a group, all pairs in
    that radius are compared by their whole sets, in tiles, but for pairs that confirmed links join already. No link is
    taken from fingerprints. Sets are compared by the 64-bit hashes of their shingles. Equal sets are one node; texts
    without words are equal.

    ``key_col``: a string, another one in each row. Null texts are empty; an empty table gives an empty result. What grows
    faster than the input: a candidate group's tiles are replicated once for each other tile of the group.
    """
    spark = docs.sparkSession
    radius = wide_radius(similarity, 64 * words)
    found = simhash_groups(docs, width, words=words, radius=radius, id_col=key_col, text_col=text_col, repeats=False, sizes_alike=similarity).withColumnRenamed(key_col, "key")
    found = stored(found, "near-candidates")
    groups = stored(found.filter("key <> component_id").select(F.col("component_id").alias("group")).distinct(), "near-groups")
    members = found.join(small(groups, groups.count()), F.col("component_id") == F.col("group"), "left_semi").select("key", "fp", F.col("component_id").alias("group"))
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(key_col).alias("key"), F.col(id_col).cast("string").alias("id"), body(text_col).alias("body")).join(stored(members, "near-members"), "key")
    with small_batches(spark):
        sets = stored(texts.select("key", "id", "group", "fp", "body").mapInPandas(_sets(width), MEMBER), "near-sets")
    nodes = sets.groupBy("mark").agg(F.first("group").alias("group"), F.first("fp").alias("fp"), F.first("shingles").alias("shingles"))
    nodes = stored(nodes.select("*", F.size("shingles").alias("n")), "near-nodes")
    sizes = nodes.groupBy("group").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("tiles"), F.count(F.lit(1)).alias("nodes")).filter("nodes > 1")
    sizes = stored(sizes, "near-sizes")
    tiles = (
        nodes.join(small(sizes, sizes.count()), "group")
        .select("*", F.pmod(F.xxhash64("mark"), F.greatest("tiles", F.lit(1))).alias("tile"))
        .groupBy("group", "tiles", "tile")
        .agg(F.collect_list(F.struct("mark", "fp", "n", "shingles")).alias("x"))
        .select("group", "tiles", "tile", F.struct(F.col("x.mark").alias("mark"), F.flatten("x.fp").alias("fp"), F.col("x.n").alias("n"), F.flatten("x.shingles").alias("shingles")).alias("x"))
    )
    pairs = tiles.select("*", F.explode(F.sequence(F.lit(0), F.greatest("tiles", F.lit(1)) - 1)).alias("other"))
    pairs = pairs.groupBy("group", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two")).agg(F.collect_list("x").alias("x"))
    pairs = pairs.filter((F.col("one") == F.col("two")) | (F.size("x") == 2))  # a tile whose partner is empty
    sides = [F.get("x", F.lit(k))[c].alias(f"{side}_{c}") for k, side in enumerate("ab") for c in ("mark", "fp", "n", "shingles")]
    with small_batches(spark, 32):  # rows of up to two tiles
        links = stored(pairs.select(*sides).mapInPandas(_links(words, radius, similarity), "a string, b string"), "near-links")
    discard(nodes, found, groups)
    roots = stored(components(links), "near-roots").withColumnRenamed("node", "mark")
    verdicts = stored(sets.select("key", "id", "mark").join(roots, "mark", "left").select("key", F.col("id").cast(kind).alias("id"), F.coalesce("root", "mark").alias("root")), "near-verdicts")
    first = stored(verdicts.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")), "near-first")
    discard(sets)
    return verdicts.join(first, "root").filter("key <> first.key").select("key")
