"""The prefix trie, the fill-in-the-middle transformation and line dedup against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import fill_middle, line_dedup, prefix_trie

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


# Fill in the middle


def brute_middle(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def random_text(r):
    return "".join(r.choice(["a", "é", "漢", "😀", " ", "\t", "\n", "\r", "\x0b", "\x85", " ", "word", "  "]) for _ in range(r.randrange(60)))


def test_bits():
    r = random.Random(5)
    for _ in range(300):
        data = random_text(r).encode()
        found = [m.end() - 1 for m in re.finditer(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", data)]
        ends = fill_middle.token_ends(data)
        assert [i for i in range(len(data)) if ends >> i & 1] == found
        assert [fill_middle.ranked(ends, len(data), k) for k in range(len(found))] == found


def test_middle_is_brute_force(spark):
    r = random.Random(7)
    texts = [random_text(r) for _ in range(400)] + ["has <P> in it", "<M>", None, "", " ", "\n\n", "x" * 200_000, " long text" * 50_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b c"), (3, "again 3"), (3, "again 3")], "doc_id long, text string")
    found = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    given = defaultdict(list)
    for row in docs.collect():
        given[row.doc_id].append((*brute_middle(*row), row.text or ""))
    got = defaultdict(list)
    for x in found:
        got[x.doc_id].append((x.n, x.form, x.prefix_chars, x.middle_chars, x.output, x.back))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in given.items()}
    assert {x.form for x in found} == {"plain", "spm", "psm"}


def test_middle_on_odd_rows(odd, none):
    found = fill_middle.fill_in_middle(odd)
    assert found.count() == odd.count() and fill_middle.fill_in_middle(none).collect() == []
    back = found.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("t"))
    key = lambda rows: sorted((str(a), b or "") for a, b in rows)
    assert key(back.collect()) == key(odd.select("doc_id", "text").collect())
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(none, sentinels=("<P>", "<P>", "<M>"))


# Line dedup


def brute_lines(rows, least_docs=3):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holds = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                holds[k].append(i)
    rank = lambda i: (i is not None, i or 0)
    stays = {k: max(v, key=rank) for k, v in holds.items() if len(v) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in stays or stays[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    r = random.Random(3)
    pool = [f"This line number {k} stands in many documents" for k in range(30)] + ["short", "", "  ", "Ümlaut line that is ünique or not", "漢字" * 9, "漢字" * 10, "x" * 20, "x" * 19]
    vary = lambda x: r.choice([x, x.upper(), f"  {x}\t", f"{x}\r", x])
    rows = [(i, "\n".join(vary(r.choice(pool)) if r.random() < 0.7 else f"only here {i} {k} and nowhere else" for k in range(r.randrange(12)))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, "\n"), (203, "y" * 300_000), (204, "y" * 300_000 + "\n" + "y" * 300_000), (205, "y" * 300_000), (None, pool[0]), (7, "twice the same row, twice"), (7, "twice the same row, twice"), (1, "twice the same row, twice")]


@pytest.mark.parametrize("filter_bytes", [line_dedup.FILTER_BYTES, 64])
def test_lines_are_brute_force(spark, filter_bytes):
    """Also with filters so small that nearly every line is suspected."""
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = line_dedup.dedup_lines(docs, filter_bytes=filter_bytes).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(key, found)) == sorted(map(key, brute_lines(rows)))
    assert sum(x.n_dropped for x in found) > 100


def test_filters_let_few_lines_pass(spark):
    """Lines that stand in one document hardly ever reach the exact step."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line of document number "), "id", F.lit("\na line that all documents hold")).alias("text"))
    kept = []
    real = line_dedup.stored
    try:
        line_dedup.stored = lambda df, name: kept.append((name, out := real(df, name), out.count())) or out
        assert line_dedup.dedup_lines(docs).agg(F.sum("n_dropped")).first()[0] == 2999
    finally:
        line_dedup.stored = real
    passed = next(n for name, _, n in kept if name == "line-suspects")
    assert 3000 <= passed <= 3000 + 3000 * 0.03


def test_lines_on_odd_rows(odd, none):
    found = line_dedup.dedup_lines(odd, least_chars=4, least_docs=2).collect()
    assert len(found) == odd.count() and line_dedup.dedup_lines(none).collect() == []
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(none, least_docs=1)


# The trie


def brute_trie(convs):
    """convs: {id: [(role, text), ...]}"""
    at = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            at[tuple(turns[:d])].append(c)
    out = {}
    children = defaultdict(set)
    for seq in at:
        if seq:
            children[seq[:-1]].add(seq)
    own = {seq: (len(m) - 1) * len(seq[-1][1]) if seq else 0 for seq, m in at.items()}
    for seq, m in at.items():
        below = [s for s in at if s[: len(seq)] == seq]
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(seq))))
        out[min(m), len(seq)] = (min(at[seq[:-1]]) if seq else None, len(m), len(children[seq]), sum(not children[s] for s in below), sum(own[s] for s in below), sha(ends))
    return out


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def as_dict(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(seed, n, lengths, variety):
    r = random.Random(seed)
    return {c: [(r.choice(["user", "bot", ""]), r.choice(["", "é", "hello", "ab", "漢字"][:variety])) for _ in range(r.choice(lengths))] for c in sorted(r.sample(range(4 * n), n))}


def table_of(spark, convs, r):
    rows = [(c, k if k or r.random() < 0.5 else None, role or None, text or None) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)


@pytest.mark.parametrize("seed, n, lengths, variety", [(1, 60, [1, 2, 3, 5, 8], 2), (2, 25, [1, 7, 16, 17, 33], 1), (3, 150, [1, 2, 3], 5)])
def test_trie_is_brute_force(spark, seed, n, lengths, variety):
    convs = conversations(seed, n, lengths, variety)
    turns = table_of(spark, convs, random.Random(seed))
    rows = prefix_trie.stored(prefix_trie.ordered_turns(turns), "test")
    sizes = prefix_trie.lengths(rows)
    assert as_dict(prefix_trie.prefix_trie(rows, sizes)) == brute_trie(convs)


def test_trie_of_rebuilt_conversations(spark, tmp_path):
    convs = conversations(4, 240, [1, 1, 2, 3, 4, 6, 9], 2)
    table_of(spark, convs, random.Random(4)).write.parquet(f"{tmp_path}/conversations.parquet")
    want = rebuilt(convs)
    assert any(not v for v in want.values())  # some lose all their turns
    assert as_dict(prefix_trie.op11_prefix_trie(spark, str(tmp_path))) == brute_trie(want)


def test_trie_slices_and_long_paths(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 3)
    convs = {1: [("u", "ab")] * 20, 2: [("u", "ab")] * 11 + [("u", "z")] * 9, 5: [("u", "ab")] * 20, 9: [("u", "ab")] * 7, -3: [("x", "q")]}
    rows = prefix_trie.stored(prefix_trie.ordered_turns(table_of(spark, convs, random.Random(1))), "test")
    assert as_dict(prefix_trie.prefix_trie(rows, prefix_trie.lengths(rows))) == brute_trie(convs)


def test_trie_on_odd_rows(spark, odd, none):
    """Ties in turn stand in the order of their digest; rows without an id belong to no conversation."""
    turns = odd.select(F.col("doc_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.col("source").alias("role"), "text", "id", F.col("size").alias("i"), F.col("salt").alias("mark"))
    rows = prefix_trie.stored(prefix_trie.ordered_turns(turns), "test")
    assert rows.count() == odd.filter("doc_id IS NOT NULL").count()
    assert rows.filter("conv_id = 4").select("i").distinct().count() == 3
    found = as_dict(prefix_trie.prefix_trie(rows, prefix_trie.lengths(rows)))
    assert found[0, 0][1] == odd.select("doc_id").dropna().distinct().count()
    empty = prefix_trie.ordered_turns(turns.limit(0))
    assert prefix_trie.prefix_trie(empty, prefix_trie.lengths(empty)).collect() == []


def test_ids_in_the_queries(spark, small):
    """No opN query returns less than a row a document, and each names its document."""
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    for query in (fill_middle.op12_fill_in_middle, line_dedup.op13_line_dedup):
        found = query(spark, small)
        assert found.select("doc_id").distinct().count() == found.count() == docs
