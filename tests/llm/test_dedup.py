"""Exact, SimHash and embedding dedup against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash

from plumbline.llm import embedding_dedup, exact_dedup, mixing, simhash
from plumbline.llm.components import components
from plumbline.llm.registry import QUERIES, SQL


def reach(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, spark, small, duck, rows):
    assert rows(QUERIES[name](spark, small).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)]
    want = reach(200, links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(want[k] == v for k, v in got.items()) and {i for a, b in links if a != b for i in (a, b)} == set(got)


def _slow_fingerprint(text, width):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").toPandas()
    got = QUERIES["op3_simhash"](spark, small).orderBy("doc_id").toPandas()
    want = [_slow_fingerprint(t, 3) for t in docs["text"]]
    assert got["fingerprint"].tolist() == [f"{x:016x}" for x in want]
    ids = docs["doc_id"].tolist()
    roots = reach(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (want[i] ^ want[j]).bit_count() <= 3])
    assert got["component_id"].tolist() == [ids[r] for r in roots]


@pytest.mark.parametrize("words, radius", [(1, 3), (2, 19), (3, 29)])
def test_linked_tiles_keep_components(words, radius):
    """Links whose differing bits lie in any word, all in one of them too."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (40, words), dtype="u8")
    flip = np.zeros((3, words), "u8")
    flip[0, 0], flip[1, -1], flip[2, words // 2] = (1 << radius) - 1, (1 << radius) - 1, (1 << radius + 1) - 1
    x = np.concatenate([base, *(base ^ f for f in flip)])
    bits = np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2)
    near = [(a, b) for a in range(len(x)) for b in range(a) if bits[a, b] <= radius]
    i, j = simhash.linked(x, x, True, radius)
    assert reach(len(x), zip(i, j)) == reach(len(x), near)
    i, j = simhash.linked(x[:70], x[70:], False, radius)
    across = [(a, b) for a in range(70) for b in range(70, len(x)) if bits[a, b] <= radius]
    assert reach(len(x), ((a, b + 70) for a, b in zip(i, j))) == reach(len(x), across)


def test_embeddings(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").toPandas()
    got = QUERIES["op6_embedding_dedup"](spark, small).orderBy("vec_id").toPandas()
    x = [None if v is None or any(c is None or not math.isfinite(c) for c in v) or not np.any(v) else np.asarray(v, float) for v in rows["embedding"]]
    label = [None if v != v else v for v in rows["label"]]
    links = [(i, j) for i in range(len(x)) for j in range(i) if x[i] is not None and x[j] is not None and label[i] is not None and label[i] == label[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.93]
    count = np.zeros(len(x), int)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    assert got["n_links"].tolist() == count.tolist()
    ids = rows["vec_id"].tolist()
    assert got["component_id"].tolist() == [ids[r] for r in reach(len(ids), links)]
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()


def test_bound_never_loses_a_link():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 64))
    x[30:] = x[:30] + 0.25 * rng.normal(size=(30, 64))
    basis = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    tile = embedding_dedup._Tile({"node": np.arange(60), "weight": np.ones(60), "packed": x.ravel()}, basis)
    got = set(zip(*map(list, embedding_dedup._hits(tile, tile, slice(0, 60), 0.93))))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert got == set(zip(*np.nonzero(unit @ unit.T >= 0.93)))


def test_arguments(odd):
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(odd, keep="some")
    with pytest.raises(ValueError):
        mixing.mix_sources(odd, weights=())


def test_neighbours_find_every_copy(spark):
    """Runs of the content sort, those of split texts joined, are the distinct texts; a text with a third of the rows is split."""
    rng = random.Random(11)
    texts = ["hot " * 50] * 1000 + [f"text {rng.randrange(700)} " * rng.randrange(1, 4) for _ in range(2000)] + [None, "", "same head of many characters, a", "same head of many characters, b"]
    ids = [None if i % 97 == 0 else i // 2 for i in range(len(texts))]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    rows, split = exact_dedup.content_sort(docs, hot=0.1)
    rows = rows.collect()
    assert [r.size for r in split.collect()] == [1000] and sum(r.first and r.split for r in rows) > 1
    assert sum(r.first and not r.split for r in rows) + 1 == len({t or "" for t in texts})
    want = {}
    for i, t in zip(ids, texts):
        want.setdefault(t or "", []).append(i)
    for keep, best in (("min", min), ("max", max)):
        found = exact_dedup.exact_dedup(docs, keep=keep, hot=0.1).collect()
        assert len(found) == len(texts)
        by = {}
        for r in found:
            by.setdefault(r.text_sha256, []).append(r)
        assert len(by) == len(want)
        for text, group in want.items():
            got = by[hashlib.sha256(text.encode()).hexdigest()]
            known = [i for i in group if i is not None]
            assert {r.group_size for r in got} == {len(group)} and {r.keep_id for r in got} == {best(known) if known else None}
            assert sum(r.kept for r in got) == 1 and sorted(str(r.doc_id) for r in got) == sorted(map(str, group))


def test_vectors_of_all_kinds(spark):
    """Ties, repeated vectors and rows, two dimension counts, several groups, and vectors that link with nothing."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(30, 8))
    vectors = [v.tolist() for v in base] + [(v + 0.1 * rng.normal(size=8)).tolist() for v in base for _ in range(3)] + [base[0].tolist()] * 5 + [(2 * base[1]).tolist()]
    vectors += [rng.normal(size=3).tolist() for _ in range(10)] + [[1.0, 0.0, 0.0]] * 2 + [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] + [1.0] * 7]
    rows = [(i, v, i % 2 if i % 11 else None) for i, v in enumerate(vectors)]
    rows += [rows[3], (None, base[0].tolist(), 0), (None, None, None)]
    got = embedding_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = [np.array(v) / np.linalg.norm(v) if fine(v) and g is not None else None for _, v, g in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and np.array(rows[i][1]) @ np.array(rows[j][1]) / np.linalg.norm(rows[i][1]) / np.linalg.norm(rows[j][1]) >= 0.93]
    roots, n = reach(len(rows), links), [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    members = {}
    for i, r in enumerate(roots):
        members.setdefault(r, []).append(rows[i][0])
    least = [min((m for m in members[r] if m is not None), default=None) for r in roots]
    key = lambda t: tuple(map(str, t))
    assert sorted((key((r.vec_id, r.n_links, r.component_id)) for r in got)) == sorted(key((rows[i][0], n[i], least[i])) for i in range(len(rows)))


def test_far_tiles_are_skipped(spark):
    box = lambda t, a, b: (0, 4, t, ([a, 0.0, 0.0, 0.0], [b, 0.0, 0.0, 0.0]))
    tiles = spark.createDataFrame([box("a", -0.9, -0.8), box("b", -0.5, 0.0), box("c", 0.7, 0.9)], "part int, dim int, tile string, box struct<low:array<double>,high:array<double>>")
    assert {(r.one, r.two) for r in embedding_dedup.tile_pairs(tiles, 0.93).collect()} == {("a", "a"), ("b", "b"), ("c", "c"), ("a", "b")}


def test_pairs_of_tiles_are_those_within_reach(spark, monkeypatch):
    """Against all pairs of boxes: wide, narrow, equal and single-point ones, and buckets of every width."""
    rng = np.random.default_rng(5)
    low = rng.uniform(-1, 0.9, (90, 4))
    high = np.minimum(low + rng.choice([0.0, 0.01, 0.3, 1.5], (90, 4)), 1.0)
    low[:5], high[:5] = low[0], high[0]
    rows = [(i % 3 and 1, 4, f"t{i}", (low[i].tolist(), high[i].tolist())) for i in range(90)]
    tiles = spark.createDataFrame(rows, "part int, dim int, tile string, box struct<low:array<double>,high:array<double>>")
    for least in (0.93, 0.999, 0.2):
        gap = np.maximum(np.maximum(low[:, None] - high[None], low[None] - high[:, None]), 0.0)
        near = (gap**2).sum(axis=2) <= 2 - 2 * least + 1e-6
        want = {tuple(sorted((rows[i][2], rows[j][2]))) for i in range(90) for j in range(i + 1) if near[i, j] and rows[i][0] == rows[j][0]}
        for cell in (256, 4):
            monkeypatch.setattr(embedding_dedup, "CELL_TILES", cell)
            found = [(r.one, r.two) for r in embedding_dedup.tile_pairs(tiles, least).collect()]
            assert len(found) == len(set(found)) and set(found) == want


def test_axes_are_orthogonal(spark):
    """Of a sample, of fewer vectors than dimensions, and of a dimension count that the sample misses."""
    rng = np.random.default_rng(6)
    rows = [(i, 8, rng.normal(size=8).tolist()) for i in range(300)] + [(1000, 5, [1.0, 2.0, 0.0, 0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "node long, dim int, vector array<double>")
    for sample in (100, 1, 0):
        found = embedding_dedup.axes(vectors, sample)
        assert set(found) == {5, 8} and all(np.allclose(x @ x.T, np.eye(d)) for d, x in found.items())
