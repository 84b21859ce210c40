"""Embedding near-dedup by PCA-ordered tiled comparison."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import discard, salt, salts_for, small, small_batches, stored, table
from plumbline.llm.components import components

#: Vectors a tile holds on average at most, leading dimensions added before the bound is looked at again, and leading ones
#: whose ranges a tile has.
TILE, STEP, LEADING = 2048, 16, 4
#: Vectors of a dimension count that its axes are fitted on, about; tiles that begin in one bucket of the first coordinate, about.
SAMPLE, CELL_TILES = 8192, 256
BLOCK, SLACK = 256, 1e-9


def _unit(vectors: list) -> np.ndarray:
    """Vectors of one length as rows of norm 1."""
    x = np.array([np.asarray(v, float) for v in vectors])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _axes(rows: pd.DataFrame) -> pd.DataFrame:
    x = _unit(list(rows["vector"]))
    return pd.DataFrame({"dim": [x.shape[1]], "axes": [np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1]).tobytes()]})


def axes(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Principal axes, strongest first, by dimension count, of about ``sample`` vectors of each (node, dim, vector; nodes differ).

    The axes of a sample are as orthogonal as those of all, and any orthogonal axes give the same links: how well they fit
    decides only how early a comparison stops. A dimension count's sample is one task's; the driver gets dim^2 numbers.
    """
    sizes = stored(vectors.groupBy("dim").agg((sample / F.count(F.lit(1))).alias("share")), "vector-sizes")
    some = vectors.join(small(sizes, sizes.count()), "dim").filter(F.pmod(F.xxhash64("node", F.lit("axes")), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    found = some.select("dim", "vector").groupBy("dim").applyInPandas(_axes, "dim int, axes binary").collect()  # a row a dimension count
    made = {r["dim"]: np.frombuffer(r["axes"]).reshape(r["dim"], -1) for r in found}
    for r in sizes.select("dim").collect():
        made.setdefault(r["dim"], np.eye(r["dim"]))  # a sample may miss what is rare
    discard(sizes)
    return made


class _Tile:
    def __init__(self, row: pd.Series, basis: np.ndarray) -> None:
        self.node, self.weight = np.asarray(row["node"], "i8"), np.asarray(row["weight"], "i8")
        self.raw = np.asarray(row["packed"], float).reshape(len(self.node), -1)
        self.norm = np.sqrt((self.raw * self.raw).sum(axis=1))
        self.x = self.raw / self.norm[:, None] @ basis
        squares = np.cumsum((self.x * self.x)[:, ::-1], axis=1)[:, ::-1]
        self.suffix = np.sqrt(np.maximum(np.column_stack([squares, np.zeros(len(self.x))]), 0))


def _hits(a: _Tile, b: _Tile, rows: slice, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) with a cosine of ``least`` or more."""
    dim = a.x.shape[1]
    k = min(STEP, dim)
    dots = a.x[rows, :k] @ b.x[:, :k].T
    i, j = np.nonzero(dots + np.outer(a.suffix[rows, k], b.suffix[:, k]) >= least - SLACK)
    dots, i = dots[i, j], i + rows.start
    while k < dim and len(i):
        end = min(k + STEP, dim)
        dots = dots + np.einsum("ij,ij->i", a.x[i, k:end], b.x[j, k:end])
        k = end
        ok = dots + a.suffix[i, k] * b.suffix[j, k] >= least - SLACK
        i, j, dots = i[ok], j[ok], dots[ok]
    ok = np.einsum("ij,ij->i", a.raw[i], b.raw[j]) / (a.norm[i] * b.norm[j]) >= least
    return i[ok], j[ok]


def compare(a: _Tile, b: _Tile, same: bool, least: float) -> pd.DataFrame:
    """Links of each vector, by the weight of its partners, and a spanning forest of the links; ``same``: b is a."""
    na, shift = len(a.node), 0 if same else len(a.node)
    label, left, right = np.arange(na if same else na + len(b.node)), [], []
    count = np.zeros(len(label), "i8")
    for at in range(0, na, BLOCK):
        i, j = _hits(a, b, slice(at, min(at + BLOCK, na)), least)
        if same:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        np.add.at(count, i, b.weight[j])
        np.add.at(count, j + shift, a.weight[i])
        rows, starts = np.unique(i, return_index=True)
        for r, js in zip(rows, np.split(j, starts[1:])):
            other, where = np.unique(label[js + shift], return_index=True)
            where = where[other != label[r]]
            if len(where):
                left += [int(r)] * len(where)
                right += js[where].tolist()
                every = np.append(other, label[r])
                label[np.isin(label, every)] = every.min()
    node = a.node if same else np.concatenate([a.node, b.node])
    some = np.flatnonzero(count)
    return pd.DataFrame(
        {
            "a": np.concatenate([node[some], a.node[left] if left else np.zeros(0, "i8")]).astype("i8"),
            "b": pd.array(np.concatenate([np.zeros(len(some), "i8"), b.node[right] if right else np.zeros(0, "i8")]).astype("i8"), "Int64"),
            "links": np.concatenate([count[some], np.full(len(left), -1)]).astype("i8"),
        }
    )


def _leading(basis: dict[int, np.ndarray]) -> Callable:
    """The leading coordinates of unit vectors; 0 for dimensions that a vector lacks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            lead, size = np.zeros((len(x), LEADING)), x["vector"].map(len).to_numpy()
            for dim in np.unique(size):
                at, k = np.flatnonzero(size == dim), min(LEADING, dim)
                lead[at, :k] = _unit([x["vector"].iat[i] for i in at]) @ basis[int(dim)][:, :k]
            yield pd.DataFrame({"node": x["node"], **{f"c{k}": lead[:, k] for k in range(LEADING)}})

    return run


def _pair(basis: dict[int, np.ndarray], least: float) -> Callable:
    def run(tiles: pd.DataFrame) -> pd.DataFrame:
        tiles = tiles.sort_values("tile")
        made = [_Tile(r, basis[int(r["dim"])]) for _, r in tiles.iterrows()]
        return compare(made[0], made[-1], len(made) == 1, least)

    return run


def tile_pairs(tiles: DataFrame, least: float) -> DataFrame:
    """(part, dim, one, two): the pairs of tiles of which some vectors may reach ``least``, from their ``box`` alone.

    Unit vectors with that cosine are at most the square root of 2 - 2 ``least`` apart; the gaps between the ranges of the
    leading coordinates are a lower bound of the distance. The first coordinate orders the tiles: one is joined with those
    that begin between its own beginning and that distance beyond its end, by buckets of the coordinate that are finer the
    more tiles there are, and never with all.
    """
    square = 2 - 2 * least + 1e-6
    reach = math.sqrt(max(square, 1e-6))
    first = lambda end: F.col("box")[end][0]
    cells = tiles.groupBy("part", "dim").agg((reach / F.greatest(F.lit(4), F.ceil(F.count(F.lit(1)) / CELL_TILES))).alias("width"))
    rows = tiles.join(cells, ["part", "dim"])
    bucket = lambda x: F.floor(x / F.col("width"))
    a = rows.select("part", "dim", F.col("tile").alias("a"), F.col("box").alias("x"), F.explode(F.sequence(bucket(first("low")), bucket(first("high") + reach + 1e-9))).alias("bucket"))
    b = rows.select("part", "dim", F.col("tile").alias("b"), F.col("box").alias("y"), bucket(first("low")).alias("bucket"))
    gap = lambda k: F.greatest(F.col("x.low")[k] - F.col("y.high")[k], F.col("y.low")[k] - F.col("x.high")[k], F.lit(0.0))
    distance = sum((gap(k) * gap(k) for k in range(1, LEADING)), gap(0) * gap(0))
    later = F.struct(F.col("x.low")[0], "a") <= F.struct(F.col("y.low")[0], "b")
    return a.join(b, ["part", "dim", "bucket"]).filter(later & (distance <= square)).select("part", "dim", F.least("a", "b").alias("one"), F.greatest("a", "b").alias("two"))


def embedding_groups(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors of one non-null group and one dimension count are compared by cosine in double precision. They are turned to
    principal axes of unit vectors (fitted on a sample) and dealt to tiles in the order of the first coordinate; pairs of tiles whose
    leading coordinates lie too far apart are skipped; in the others a pair of vectors adds up leading dimensions first and
    stops where the dot product so far and the norms of the rest cannot reach ``least``; what remains is decided on the
    vectors as given. Equal vectors are one node, with a number of its own and a weight, and are dealt to cells by a salt. A
    pair of tiles gives each vector's number of links and a spanning forest, so a large group costs rows in proportion to
    its members.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do those whose group
    is null: they are kept, with 0 links and their own id. Ids may repeat. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    x = F.col("vector")
    good = F.col("part").isNotNull() & (F.coalesce(F.size(x), F.lit(0)) > 0) & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    # normal numbers only: a norm that under- or overflows in double precision has no cosine
    norm = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(group_col).alias("part"))
    rows = rows.select("*", F.coalesce(good, F.lit(False)).alias("good"))
    rows = rows.select("id", F.when(F.col("good") & F.coalesce((norm > 0) & (norm < float("inf")), F.lit(False)), F.struct("part", "vector")).alias("key"), salt(F.monotonically_increasing_id(), salts=salts_for(vectors.count())).alias("salt"))
    rows = stored(rows, "vector-rows")
    nodes = rows.filter("key IS NOT NULL").groupBy("key", "salt").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    nodes = nodes.groupBy("key").agg(F.min("least").alias("least"), F.sum("n").alias("weight"), F.collect_set("salt").alias("salts"))
    nodes = stored(nodes.select("*", F.monotonically_increasing_id().alias("node"), F.size("key.vector").alias("dim")), "vectors")
    flat = nodes.select("node", "dim", "weight", F.col("key.part").alias("part"), F.col("key.vector").alias("vector"))
    c = [f"c{k}" for k in range(LEADING)]
    with small_batches(spark, 2048):
        basis = axes(flat.select("node", "dim", "vector"))
        lead = stored(flat.select("node", "vector").mapInPandas(_leading(basis), f"node long, {', '.join(f'{k} double' for k in c)}"), "vector-leads")
    place = ["part", "dim"]
    spots = flat.select("node", *place).join(lead, "node")
    sizes = spots.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"), F.percentile_approx("c0", [i / 256 for i in range(257)], 2560).alias("cuts"))
    sizes = stored(sizes.filter("part IS NOT NULL"), "vector-cells")
    # tiles are ranges of the first coordinate: its 256 quantiles, and within one, where it has several tiles, a digest
    rank = F.size(F.filter("cuts", lambda e: e < F.col("c0"))).cast("double") / 257 * F.col("tiles")
    fine = F.when(F.col("tiles") > 256, F.pmod(F.xxhash64("node"), F.ceil(F.col("tiles") / 256).cast("long"))).otherwise(0)
    spots = spots.join(small(sizes, sizes.count()), place).select("node", *c, F.concat_ws(":", F.floor(rank), fine).alias("tile"))
    tiles = (
        flat.join(spots, "node")
        .groupBy(*place, "tile")
        .agg(F.collect_list(F.struct("node", "weight", "vector")).alias("x"), F.struct(F.array(*[F.min(k) for k in c]).alias("low"), F.array(*[F.max(k) for k in c]).alias("high")).alias("box"))
        .select(*place, "tile", "box", F.col("x.node").alias("node"), F.col("x.weight").alias("weight"), F.flatten("x.vector").alias("packed"))
    )
    tiles = stored(tiles, "vector-tiles")
    pairs = stored(tile_pairs(tiles.select(*place, "tile", "box"), least), "vector-pairs")
    ends = pairs.withColumn("tile", F.explode(F.array_distinct(F.array("one", "two"))))
    shipped = ends.join(tiles.drop("box"), [*place, "tile"])
    found = stored(shipped.groupBy(*place, "one", "two").applyInPandas(_pair(basis, least), "a long, b long, links long"), "vector-links")
    discard(tiles, pairs, lead)
    links = found.filter("links >= 0").groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.filter("links < 0").select("a", "b"))
    smallest = stored(roots.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component_id")), "vector-least")
    roots = roots.join(smallest, "root").select("node", "component_id")
    nodes = (
        nodes.join(roots, "node", "left")
        .join(links, nodes["node"] == links["a"], "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"), F.explode("salts").alias("salt"))
    )
    return (
        rows.join(nodes, ["key", "salt"], "left")
        .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


SQL = {
    "op6_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
                  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.93),
        reach AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
        least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN least ON node = vec_id LEFT JOIN n ON a = vec_id
    """,
}
