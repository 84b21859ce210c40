"""Language, secrets, toxicity, HTML, packing, sharding and the pipeline against brute force, round trips and held-out rows."""

import hashlib
import html as html_entities
import re
import time
import zlib

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import html_text, language_id, packing, secret_scan, toxicity
from plumbline.llm.registry import QUERIES


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").toPandas().set_index("doc_id")


def test_viterbi_in_segments_is_one_pass():
    rng = np.random.default_rng(4)
    lengths, switch = [0, 1, 700, 256, 257], 2.0
    scores = rng.normal(size=(sum(lengths), 3)).astype("f4")
    total = lambda s, p: sum(s[t, k] for t, k in enumerate(p)) - switch * np.count_nonzero(np.diff(p.astype(int)))
    at = 0
    for n, path in zip(lengths, language_id.best_paths(scores, lengths, switch)):
        s, at = scores[at : at + n].astype(float), at + n
        best = np.zeros(3)
        for t in range(n):
            best = np.maximum(best, best.max() - switch) + s[t] if t else s[t].copy()
        assert len(path) == n and (n == 0 or abs(total(s, path) - best.max()) < 1e-2)


def test_languages_held_out(spark):
    found = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    both = found.merge(known, on="doc_id").query("held_out and lang_pred != 'und'").dropna(subset=["lang"])
    assert (both["lang"] == both["lang_pred"]).mean() > 0.97 and found["score"].between(0, 1).all()
    assert (found["held_out"] == found["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()


def test_mixed_text_has_spans(spark):
    rows = [(i, text * 30, lang) for i in range(40) for text, lang in (("the house and the garden were there ", "en"), ("το σπίτι και ο κήπος ήταν εκεί ", "el"))]
    model = language_id.learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), __import__("pyspark").sql.functions.lit(True))
    text = "the house and the garden. το σπίτι και ο κήπος."
    r = language_id.identify_languages(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s.lang for s in r.spans] == ["en", "el"] and r.spans[0].end == r.spans[1].start == text.index("το")


def _slow_spans(text):
    found = [(m.start(), m.end(), 0, "assign") for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if m[0].isascii() and len(m[2]) >= 6]
    found += [(m.start(), m.end(), 1, "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), 2, "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, b, _, k in sorted(found, key=lambda x: (x[0], x[2]))]


def test_secrets(spark, small, docs):
    found = QUERIES["op5_secrets"](spark, small).toPandas()
    for r in found.itertuples():
        want = _slow_spans(docs.at[r.doc_id, "text"] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert [s for s in r.spans.split(",") if s and not s.startswith("like")] == want


def test_inferred_formats_generalise():
    rng = np.random.default_rng(5)
    made = lambda n: "".join(rng.choice(list("0123456789abcdef"), n)).translate(secret_scan._CLASS)
    a = secret_scan.infer([(made(40), 1) for _ in range(200)])
    assert a.likelihood(made(40)) > a.likelihood("internationalisation-of-the-same-programs".translate(secret_scan._CLASS)) + 20


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    found = QUERIES["op10_toxicity"](spark, sf).toPandas()
    both = found.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id").query("held_out").dropna(subset=["toxic"])
    rank, y = both["score"].rank(), both["toxic"] > 0
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.95 and (found["predicted"] == (found["score"] >= 0.3)).all() and found["score"].between(0, 1).all()


def test_html():
    page = "<title>T</title><style>p{}</style><h1>Head</h1><p>one <b>two</b><p>three<ul><li>a<li>b</ul><table><tr><td>x<td>yy<tr><td>long<td>z</table><div style='display:none'>gone</div><script>no()</script>"
    lines = html_text.render(page).split("\n")
    assert lines[0] == "Head" and "one two" in lines and "three" in lines and "- a" in lines and "- b" in lines
    assert next(x for x in lines if "yy" in x).index("yy") == next(x for x in lines if "long" in x).index("z")
    assert not any(w in x for x in lines for w in ("gone", "no()", "p{}")) and html_text.render(None) == html_text.render("") == ""


def test_pages(spark, small):
    found = QUERIES["op7_html_text"](spark, small).toPandas()
    pages = spark.read.parquet(f"{small}/pages.parquet").toPandas().set_index("page_id")
    assert len(found) == len(pages) and all(r.text == html_text.render(pages.at[r.page_id, "html"]) for r in found.itertuples())


def test_packing_round_trip(spark, small, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    found = QUERIES["op4_packing"](spark, small).toPandas().sort_values(["doc_id", "piece"])
    for doc_id, pieces in found.groupby("doc_id"):
        ids, at = np.array([*encode(docs.at[doc_id, "text"] or "", add_special_tokens=False).ids, 0], "<u4"), 0
        assert pieces["length"].sum() == len(ids) and (pieces["length"].iloc[:-1] == 2048).all()
        for p in pieces.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
    for _, s in found.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 2048
    assert found["sequence_id"].nunique() <= 1.03 * -(-found["length"].sum() // 2048) + 1


def test_plan_uses_up_any_histogram():
    rng = np.random.default_rng(6)
    for counts in (np.zeros(2049, int), np.bincount(rng.integers(1, 2049, 3000), minlength=2049), np.bincount([7] * 5000 + [2048] * 3, minlength=2049)):
        used = np.zeros(2049, int)
        for p, n in packing.plan(counts):
            assert sum(p) <= 2048 and n > 0
            for v in p:
                used[v] += n
        assert (used == counts).all()


def test_shards(spark, small, docs):
    found = QUERIES["op9_sharding"](spark, small).toPandas()
    raw = found["doc_id"].map(lambda i: (docs.at[i, "text"] or "").encode())
    assert (found["size"] == raw.map(len) + 1).all() and (found["text_crc32"] == raw.map(zlib.crc32)).all()
    for _, s in found.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    sizes = found.groupby("shard")["size"].sum().reindex(range(16), fill_value=0)
    assert found["shard"].between(0, 15).all() and sizes.max() - sizes.min() <= 2 * max(found["size"].max(), 0.05 * sizes.mean())


def test_pipeline(spark, small, docs):
    kept = spark.read.parquet(f"{small}/documents.parquet")
    seen = [kept.toPandas()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stored(stage(spark, kept, small), name)
        seen.append(kept.toPandas())
        assert list(kept.columns) == list(corpus_pipeline.DOCUMENT_COLUMNS)
    start, language, exact, near, mixed = seen
    letters = start["text"].fillna("").map(lambda t: any(c.isalpha() for c in t))
    assert set(language["doc_id"]) <= set(start["doc_id"][letters]) and len(language) > 0.97 * letters.sum()
    assert sorted(exact["doc_id"]) == sorted(language.groupby("text")["doc_id"].min())
    assert set(near["doc_id"]) <= set(exact["doc_id"]) and near["text"].is_unique
    assert set(mixed["doc_id"]) <= set(near["doc_id"]) and mixed.groupby("doc_id").size().max() <= 3
    words = lambda d: d["text"].map(lambda t: len(t.split())).sum()
    assert abs(words(mixed) - words(near)) <= near["text"].map(lambda t: len(t.split())).max() * 2
    packed = corpus_pipeline.run(spark, small).toPandas()
    assert (packed["piece"] == 0).sum() == len(mixed) and packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_margin_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(8)
    m = toxicity.FactorizationMachine(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    found = [[0, 3, 8], [], [5], list(range(9))]
    at = np.array([b for f in found for b in f], int)
    got = m.margin(np.repeat(np.arange(4), [len(f) for f in found]), at, 4)
    want = [m.bias + sum(m.weights[b] for b in f) + sum(float(m.factors[a] @ m.factors[b]) for i, a in enumerate(f) for b in f[:i]) for f in found]
    assert np.allclose(got, want)


def test_pairs_that_weights_alone_miss():
    """A text is toxic if it has both or neither of two terms: each alone says nothing."""
    rng = np.random.default_rng(9)
    found, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        found.append(np.array(sorted({*rng.choice(np.arange(10, 200), 12, replace=False).tolist(), *([1] if a else [2]), *([3] if b else [4])})))
        y.append(float(a == b))
    y = np.array(y)
    m = toxicity.fit_machine(found[:2400], y[:2400], np.ones(2400))
    place = {b: i for i, b in enumerate(m.buckets.tolist())}
    rest = [[place[b] for b in f.tolist()] for f in found[2400:]]
    row, at = np.repeat(np.arange(len(rest)), [len(f) for f in rest]), np.array([b for f in rest for b in f])
    right = lambda machine: ((machine.probability(row, at, len(rest)) > 0.5) == (y[2400:] > 0)).mean()
    alone = toxicity.FactorizationMachine(m.buckets, m.bias, m.weights, 0 * m.factors)
    assert right(m) > 0.95 and right(alone) < 0.65


def _slow_words(page):
    """Visible words, by another way than the renderer's: a scan of tags that counts how deep a hidden element is open."""
    out, hidden, raw = [], [], None
    for m in re.finditer(r"<!--.*?-->|<![^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", page or "", re.S):
        close, tag, attrs = m[1], (m[2] or "").lower(), m[3] or ""
        if raw:
            if tag == raw and close:
                raw = None
            continue
        if m[2] is None:
            if not m[0].startswith("<!") and not hidden:
                out.append(m[0])
            continue
        if tag in ("script", "style", "title", "noscript", "template", "svg") and not close:
            raw = tag
            continue
        out.append(" " if tag in html_text.BLOCKS or tag in ("br", "img") else "")
        if tag in html_text.VOID:
            alt = re.search(r"alt\s*=\s*\"([^\"]*)\"", attrs)
            if tag == "img" and alt and not hidden and "hidden" not in attrs:
                out.append(alt[1])
            continue
        if close:
            if hidden and hidden[-1][0] == tag:
                hidden[-1][1] -= 1
                if not hidden[-1][1]:
                    hidden.pop()
        elif hidden and hidden[-1][0] == tag:
            hidden[-1][1] += 1
        elif not hidden and (re.search(r"(?:^|\s)hidden(?:\s|=|$)", attrs) or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs)):
            hidden.append([tag, 1])
    return html_entities.unescape("".join(out)).split()


def test_pages_have_all_visible_words(spark, small):
    """Words of all pages against a scan without a tree; list marks are the renderer's own."""
    found = QUERIES["op7_html_text"](spark, small).toPandas()
    pages = spark.read.parquet(f"{small}/pages.parquet").toPandas().set_index("page_id")
    bare = lambda words: sorted(w for w in words if not re.fullmatch(r"-|\d+\.", w))
    same = [bare(_slow_words(pages.at[r.page_id, "html"])) == bare(r.text.split()) for r in found.itertuples()]
    assert np.mean(same) > 0.98


def test_layout_of_tables():
    spans = html_text.render("<table><tr><td rowspan=2>left<td>aa<td>b<tr><td>c<td>dd<tr><td>x<td colspan=2>wide<tr><td>p<td>q<td>end</table>").split("\n")
    assert spans[0].index("aa") == spans[1].index("c") == spans[2].index("wide") == spans[3].index("q") and spans[0].index("b", 6) == spans[1].index("dd") == spans[3].index("end")
    inner = html_text.render("<table><tr><td>out<td><table><tr><td>1<td>22<tr><td>333<td>4</table><tr><td>z<td>w</table>").split("\n")
    assert inner[0].index("22") == inner[1].index("4") and inner[0].index("1") == inner[2].index("w")
    assert html_text.render("<div hidden><p>a<b>b</b></div><p>c").strip() == "c"
    long = html_text.render("<table><tr><td>" + "x" * 20_000 + "<td>y" + "<tr><td>a<td>b" * 2000 + "</table>")
    assert len(long) < 5 * 31_000 and {x.index("b") for x in long.split("\n")[1:]} == {62} and long.count("b") == 2000
    mixed = html_text.render("<table>" + "".join(f"<tr><td>{'k' * k}<td>v{k}" for k in range(1, 7)) + "<tr><td>" + "long words " * 40 + "<td>end</table>").split("\n")
    assert len({x.index("v") for x in mixed[:6]}) == 1 and mixed[6].index("end") == mixed[0].index("v1") and " ".join(mixed).count("long words") + " ".join(mixed).count("long  end words") >= 39
    wide = html_text.render("<table>" + ("<tr>" + "<td>" * 60 + "x") * 300 + "<tr>" + "<td>wide cell text" * 60 + "</table>")
    assert wide.count("x") == 360 and len(wide) < 300 * (html_text.LINE + 10) + 60 * 20
    deep = html_text.render("<ul><li>item" * 250)
    assert deep.count("- item") == 250 and len(deep) < 30_000 and html_text.render("<ul><li>item" * 5000).count("item") == 5000


def test_many_spans_take_little_time():
    began = time.time()
    for page in ("<table><tr>" + "<td colspan=1000 rowspan=65534>x" * 10_000, "<table>" + "<tr><td colspan=1000 rowspan=65534>x" * 10_000):
        assert html_text.render(page).count("x") == 10_000
    assert time.time() - began < 4
    down = html_text.render("<table><tr><td rowspan=3>a<td>b<td rowspan=2>c<tr><td>d<tr><td>e<td>f<tr><td>g<td>h<td>i</table>").split("\n")
    assert down[0].index("b") == down[1].index("d") == down[2].index("e") == down[3].index("h") and down[2].index("f") == down[0].index("c") == down[3].index("i")


def test_visibility_is_inherited():
    page = '<div style="visibility:hidden">no<i style="color:red; visibility: visible">yes<b style="visibility:inherit">too</b></i><img alt="no"><p style="visibility:collapse">no</p></div><p>end'
    assert html_text.render(page).split() == ["yestoo", "end"]
    assert html_text.render('<p style="display:none">no<i style="visibility:visible;display:inline">no</i></p><p style="display:none;display:block">yes') == "yes"


def test_marks_and_long_runs_are_words():
    words = language_id.find_words("हिन्दी ภาษาไทยดี e\u0301te\u0301 x²y9z " + "漢" * 60 + " a_b")[1]
    assert words == ["हिन्दी", "ภาษาไทยดี", "e\u0301te\u0301", "x", "y", "z", "漢" * 60, "a", "b"]


def test_shards_one_after_the_other(spark, small, docs):
    """Shard and slot of each document, by a walk over all of them in order."""
    import struct

    import xxhash

    found = QUERIES["op9_sharding"](spark, small).toPandas().set_index("doc_id")
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows = []
    for i, text in docs["text"].fillna("").items():
        raw = text.encode()
        h = xxhash.xxh64_intdigest(raw, 42)
        place = xxhash.xxh64_intdigest(struct.pack("<q", signed(h)), xxhash.xxh64_intdigest(struct.pack("<q", i), 42))
        rows.append((signed(h), zlib.crc32(raw), len(raw) + 1, signed(place) % 64, i))
    rows.sort()
    total, group, at, place, first = sum(r[2] for r in rows), {}, 0, 0, {}
    for r in rows:
        group[r[:3]] = group.get(r[:3], 0) + r[2]
    starts, want = {}, {}
    for place, r in enumerate(rows):
        starts.setdefault(r[:3], at)
        whole = group[r[:3]] * 16 <= total * 0.05
        middle = 2 * starts[r[:3]] + group[r[:3]] if whole else 2 * at + r[2]
        shard = min(15, int(middle * 16 / (2 * total)))
        first.setdefault(shard, place)
        want[r[4]] = (shard, place - first[shard])
        at += r[2]
    assert {i: (r.shard, r.slot) for i, r in found.iterrows()} == want


def test_no_letter_is_no_language(spark):
    rows = [(i, "the house and the garden " * 20, "en") for i in range(20)] + [(50 + i, "das haus und der garten " * 20, "de") for i in range(20)]
    model = language_id.learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), __import__("pyspark").sql.functions.lit(True))
    texts = ["½ ² ① Ⅷ", "123 ... !", "", None, "²the house", "漢"]
    found = language_id.identify_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in found] == [not any(c.isalpha() for c in t or "") for t in texts]


def test_candidates_touch_no_base_span():
    rng = np.random.default_rng(13)
    for _ in range(200):
        text = "".join(rng.choice(["token=abcdef123 ", "AKIA" + "A" * 20, "0f" * 14, "x" * 18, " ", "word ", "Zm9vYmFyYmF6cXV4MTIz", "/"], 30))
        base = secret_scan.base_spans(text)
        want = [m.span() for m in secret_scan._CANDIDATE.finditer(text) if not any(a < m.end() and m.start() < b for a, b, *_ in base)]
        assert secret_scan.candidates(text, base) == want


def test_added_spans_are_the_likelier_candidates(spark, small, docs):
    model = secret_scan.learn_secrets(spark.read.parquet(f"{small}/documents.parquet"))
    found = QUERIES["op5_secrets"](spark, small).toPandas()
    for r in found.itertuples():
        text = docs.at[r.doc_id, "text"] or ""
        want = []
        for a, b in secret_scan.candidates(text, secret_scan.base_spans(text)):
            w = text[a:b].translate(secret_scan._CLASS)
            plain = max(model.plain.likelihood(w), model.plain.likelihood(text[a:b].lower().translate(secret_scan._CLASS)))
            scores = {k: a_.likelihood(w) - plain for k, a_ in model.automata.items()}
            if scores and max(scores.values()) >= secret_scan.RATIO:
                want.append(f"like_{max(scores, key=scores.get)}:{a}:{b}")
        assert [x for x in r.spans.split(",") if x.startswith("like")] == want


def test_null_ids_spread_over_cells(spark):
    found = packing.pack(spark.createDataFrame([(None, "a b c")] * 3000 + [(1, "a b c")], "doc_id long, text string")).toPandas()
    assert len(found) == 3001 and not found.duplicated(["sequence_id", "offset"]).any()
    for _, s in found.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]]


def test_samples_are_bounded_whatever_repeats(spark, monkeypatch):
    """One id with most rows, null ids, rows that repeat: each text of an id counts once, rows and bytes keep their bounds."""
    seen = {}
    monkeypatch.setattr(toxicity, "fit_machine", lambda found, y, w: seen.update(n=[int((y == k).sum()) for k in (0, 1)], bytes=sum(4 * len(f) for f in found), weight=sorted(set(w.tolist()))))
    rows = [(1, f"bad words {k % 500} of one id") for k in range(3000)] + [(None, "no id")] * 500 + [(i, f"some text {i} of its own") for i in range(2, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(i, 0) for i in range(2, 400)] + [(None, 1)], "doc_id long, toxic int")
    lit = __import__("pyspark").sql.functions.lit(True)
    toxicity.learn_toxicity(docs, labels, lit)
    assert seen["n"] == [398, 500]
    toxicity.learn_toxicity(docs, labels, lit, sample=60)
    assert seen["n"][1] <= 60 and 0 < seen["n"][0] <= 60
    toxicity.learn_toxicity(docs, labels, lit, term_bytes=1000)
    assert 0 < seen["bytes"] <= 2000 and all(n > 0 for n in seen["n"])


def test_shorter_candidates_on_demand(spark):
    text = "word abcdefgh12 " + "Zm9vYmFyYmF6cXV4MTIz"
    assert [text[a:b] for a, b in secret_scan.candidates(text, [], 10)] == ["abcdefgh12", "Zm9vYmFyYmF6cXV4MTIz"]
    assert [text[a:b] for a, b in secret_scan.candidates(text, [])] == ["Zm9vYmFyYmF6cXV4MTIz"]
    docs = spark.createDataFrame([(None, "token=abc12345 plainword")] * 40 + [(1, None)], "doc_id long, text string")
    model = secret_scan.learn_secrets(docs, shortest=8)
    assert model.shortest == 8 and model == secret_scan.learn_secrets(docs.distinct(), shortest=8)  # rows that repeat count once
    assert len(secret_scan.find_secrets(docs, model).collect()) == 41
