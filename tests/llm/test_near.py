"""The pipeline's near stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline
from test_dedup import reach


def _set(text, width=5):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_stage_is_brute_force_jaccard(spark, small):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    texts = []
    for n in [rng.randrange(80, 400) for _ in range(60)]:
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for change in (0.015, 0.02, 0.022, 0.025, 0.03, 0.04):
            texts.append(" ".join(word() if rng.random() < change else w for w in base))
    texts = list(dict.fromkeys(texts))
    line = " ".join(word() for _ in range(60))
    texts += [line, "\n".join([line] * 30 + [word()]), line + " " + " ".join(word() for _ in range(40))]  # a repeated line counts once
    sets = [_set(t) for t in texts]
    found = {(i, j): s for i in range(len(sets)) for j in range(i) if (s := _jaccard(sets[i], sets[j])) > 0.5}
    assert sum(0.8 <= s < 0.85 for s in found.values()) > 50 and sum(0.7 < s < 0.8 for s in found.values()) > 50
    roots = reach(len(texts), [p for p, s in found.items() if s >= 0.8])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, small).select("doc_id").collect())
    assert kept == sorted(set(roots))


def test_rows_that_share_an_id_have_their_own_fate(spark, small):
    rng = random.Random(6)
    text = lambda n=120: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, "123 ..."), (7, b), (7, c), (3, b), (9, d), (9, d + " one more"), (None, e), (None, e + " one more"), (5, text()), (5, text()), (5, text())]
    rows.append(rows[-1])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    took = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, small), name)
        took[name] = [(r.doc_id, r.text) for r in docs.collect()]
    assert set(took["language_id"]) == set(rows) - {rows[1]} and len(took["language_id"]) == len(rows) - 1
    assert sorted(map(str, took["exact_dedup"])) == sorted(map(str, set(rows) - {rows[1], rows[2]}))
    near = took["simhash"]
    assert len(near) == len(took["exact_dedup"]) - 2 and len({x for x in near if x[0] == 9}) == 1 and len([x for x in near if x[0] is None]) == 2
    assert sorted(map(str, took["mixing"])) == sorted(map(str, near))  # one source: each row once
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).filter("piece = 0").count() == len(near)
