"""SimHash near-dedup by tiled exact comparison."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.common import body, discard, salt, small_batches, stored, table
from plumbline.llm.components import components

SEED = 42
#: Fingerprints a tile holds on average at most.
TILE = 2048
#: Pairs that are compared at once: their numbers of differing bits stay in a core's cache.
PAIRS = 1 << 18
#: Words after the first come in pairs from a 128-bit hash.
CHUNK = 1 << 15


def radius_of(similarity: float, bits: int) -> int:
    """The number of differing bits expected of two sets with this Jaccard similarity."""
    return int(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower: A-Z only; bytes.split: space and \x09-\x0D


def _shingles(w: list[bytes], width: int) -> list[bytes]:
    return [b" ".join(x) for x in zip(*(w[i:] for i in range(width)))] if len(w) >= width else [b" ".join(w)]


def distinct_shingles(text: str, width: int) -> list[bytes]:
    w = _words(text)
    return list(dict.fromkeys(_shingles(w, width))) if w else []


def fingerprint(text: str, width: int, words: int = 1, repeats: bool = True) -> list[int]:
    """Signed 64-bit words; a bit is 1 if it is set in over half the hashes of the text's shingles, repeats included or each once."""
    w = _words(text)
    if not w:
        return [0] * words
    once = None if repeats else distinct_shingles(text, width)
    n = max(1, len(w) - width + 1) if repeats else len(once)
    counts = np.zeros(64 * words, "int64")
    for at in range(0, n, CHUNK):
        s = _shingles(w[at : min(at + CHUNK, n) + width - 1], width) if repeats else once[at : at + CHUNK]
        cols = [np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in s), "u8", len(s)).byteswap().view("u1").reshape(-1, 8)]
        for k in range(1, words, 2):
            cols.append(np.frombuffer(b"".join(xxhash.xxh3_128_digest(x, SEED + k) for x in s), "u1").reshape(-1, 16)[:, : 8 * min(2, words - k)])
        bits = np.unpackbits(cols[0] if len(cols) == 1 else np.concatenate(cols, axis=1), axis=1)
        counts += bits.sum(axis=0, dtype="int64")
    return np.packbits(2 * counts > n).view(">i8").astype("i8").tolist()


def _fingerprints(width: int, words: int, repeats: bool) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            made = np.array([fingerprint(t, width, words, repeats) for t in x["body"]], "i8").reshape(-1, words)
            sizes = [0] * len(x) if repeats else [len(distinct_shingles(t, width)) for t in x["body"]]
            yield pd.DataFrame({"id": x["id"], **{f"w{k}": made[:, k] for k in range(words)}, "n": sizes})

    return run


def _matrix(packed: list[list[int]] | np.ndarray, words: int) -> np.ndarray:
    return np.asarray(packed, dtype="i8").view("u8").reshape(-1, words)


def linked(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[list[int], list[int]]:
    """Row numbers of a spanning forest of the links between two tiles; ``same``: b is a.

    All pairs are compared in the first two words; the few that are still within the radius, in the others.
    """
    na = len(a)
    label, left, right = np.arange(na if same else na + len(b)), [], []
    shift = 0 if same else na
    columns = np.ascontiguousarray(b.T[:2])
    step = max(1, PAIRS // max(1, len(b)))
    size = (min(step, na), len(b))
    bits, ones, differ, near = np.empty(size, "u8"), np.empty(size, "u1"), np.empty(size, "u1"), np.empty(size, bool)
    for at in range(0, na, step):
        n = min(step, na - at)
        for k, column in enumerate(columns):
            np.bitwise_xor(a[at : at + n, k, None], column, out=bits[:n])
            np.bitwise_count(bits[:n], out=ones[:n] if k else differ[:n])
            if k:
                np.add(differ[:n], ones[:n], out=differ[:n])
        np.less_equal(differ[:n], radius, out=near[:n])
        if not near[:n].any():
            continue
        i, j = np.divmod(np.flatnonzero(near[:n]), len(b))
        if a.shape[1] > 2:
            ok = np.bitwise_count(a[i + at] ^ b[j]).sum(axis=1, dtype="i4") <= radius
            i, j = i[ok], j[ok]
        if same:
            i, j = i[i + at < j], j[i + at < j]
        if not len(i):
            continue
        rows, starts = np.unique(i, return_index=True)
        for r, js in zip(rows, np.split(j, starts[1:])):
            mine, theirs = label[r + at], label[js + shift]
            other, where = np.unique(theirs, return_index=True)
            where = where[other != mine]
            if len(where):
                left += [int(r + at)] * len(where)
                right += js[where].tolist()
                every = np.append(other, mine)
                label[np.isin(label, every)] = every.min()
    return left, right


def _links(words: int, radius: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            at, bt = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
            for a, pa, b, pb, same in zip(x["a"], x["pa"], x["b"], x["pb"], x["same"]):
                i, j = linked(_matrix(pa, words), _matrix(pb, words), same, radius)
                at.append(np.asarray(a, "i8")[i])
                bt.append(np.asarray(b, "i8")[j])
            yield pd.DataFrame({"a": np.concatenate(at), "b": np.concatenate(bt)})

    return run


def _ones(word: str, parts: int) -> list[Column]:
    """Population counts of the word's parts, equal but for a bit."""
    cuts = [64 * k // parts for k in range(parts + 1)]
    return [F.bit_count(F.shiftrightunsigned(word, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1))) for a, b in zip(cuts, cuts[1:])]


def parts_for(nodes: int) -> int:
    """More parts skip more pairs and make more cells: enough that a cell has no more than some tiles."""
    return 1 + (nodes > 20_000) + (nodes > 1_000_000) + (nodes > 30_000_000)


def simhash_groups(
    docs: DataFrame, width: int = 5, similarity: float = 0.8, words: int = 3, radius: int | None = None, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True, sizes_alike: float | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, fp (array of ``words`` longs), component_id (smallest id reachable over links).

    A fingerprint has ``words`` of 64 bits over shingles of ``width`` words. Two link if they differ in ``radius`` bits or
    fewer, by default the number expected at ``similarity``. One word at radius 3 links as SimHash is mostly used; three
    words keep unrelated documents apart at similarity 0.8, where one word would not. ``repeats=False`` counts each shingle
    once; then ``sizes_alike`` asks, besides, for numbers of distinct shingles whose ratio is at least that or little below.

    Equal fingerprints are one node. Nodes are dealt to cells by the population counts of parts of the first word (or, with
    ``sizes_alike``, where a radius of that width excludes nothing, by the logarithm of their number of shingles), cells to
    tiles by hash. Differing counts bound the distance from below, so only tiles of cells whose counts differ by the radius
    or less are compared, all pairs in numpy. A pair of tiles gives a spanning forest of its links, not all of them: a large
    group of near copies gives as many rows as it has members, and components stay the same.

    Null, empty and blank texts have fingerprint zero and link like any other; a text with fewer words than ``width`` is
    one shingle. Ids may repeat; null ids are never a component's id unless it has no other. Other columns are not read. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    radius = radius_of(similarity, 64 * words) if radius is None else radius
    kind = docs.schema[id_col].dataType.simpleString()
    w = [f"w{k}" for k in range(words)]
    rows = docs.select(F.col(id_col).cast("string").alias("id"), body(text_col).alias("body"))
    with small_batches(spark):
        rows = rows.mapInPandas(_fingerprints(width, words, repeats), f"id string, {', '.join(f'{c} long' for c in w)}, n long")
        grain = -math.log(sizes_alike) / 4 * (1 + 1e-9) if sizes_alike else None  # four steps of it make the ratio
        log = F.floor(F.ln(F.greatest("n", F.lit(1))) / grain).cast("int") if grain else F.lit(0)
        rows = stored(rows.select(F.col("id").cast(kind).alias("id"), *w, log.alias("log"), salt(F.monotonically_increasing_id()).alias("salt")), "simhash")

    node = [*w, "log"]
    nodes = rows.groupBy(*node, "salt").agg(F.min("id").alias("least")).groupBy(*node).agg(F.min("least").alias("least"), F.collect_set("salt").alias("salts"))
    nodes = stored(nodes.select("*", F.monotonically_increasing_id().alias("node")), "simhash-nodes")
    parts = parts_for(nodes.count())
    cell = F.array("log") if grain else F.array(*_ones("w0", parts))
    placed = nodes.select("node", F.array(*w).alias("fp"), cell.alias("cell"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    sizes = F.broadcast(stored(sizes, "simhash-cells"))  # at most 17^4 rows, or one for each quarter of a ratio of sizes
    tiles = placed.join(sizes, "cell").groupBy("cell", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile")).agg(F.collect_list(F.struct("node", "fp")).alias("x"))
    tiles = stored(tiles.select("cell", "tile", F.col("x.node").alias("node"), F.flatten("x.fp").alias("packed")), "simhash-tiles")
    steps = [(d,) for d in range(5)] if grain else [d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius and d >= (0,) * parts]
    steps = F.array(*[F.array(*[F.lit(v) for v in d]) for d in steps])
    a = tiles.select(F.col("cell").alias("cell_a"), F.col("tile").alias("tile_a"), F.col("node").alias("a"), F.col("packed").alias("pa"), F.explode(steps).alias("step"))
    a = a.withColumn("cell", F.zip_with("cell_a", "step", lambda x, y: x + y)).drop("step").join(sizes.select("cell"), "cell", "left_semi")
    pairs = a.join(tiles.withColumnsRenamed({"node": "b", "packed": "pb"}), "cell").filter("cell_a <> cell OR tile_a <= tile")
    pairs = pairs.select("a", "pa", "b", "pb", ((F.col("cell_a") == F.col("cell")) & (F.col("tile_a") == F.col("tile"))).alias("same"))
    with small_batches(spark):
        edges = stored(pairs.mapInPandas(_links(words, radius), "a long, b long"), "simhash-links")
    discard(tiles)
    roots = components(edges)
    least = roots.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
    least = stored(least, "simhash-least")  # adaptive execution can split the join with it at the root of a large group
    roots = roots.join(least, "root").select("node", "component_id")
    nodes = nodes.join(roots, "node", "left").select(*node, F.coalesce("component_id", "least").alias("component_id"), F.explode("salts").alias("salt"))
    return rows.join(nodes, [*node, "salt"]).select(F.col("id").alias(id_col), F.array(*w).alias("fp"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"), width=3, words=1, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


SQL: dict[str, str] = {}
