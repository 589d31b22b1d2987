"""What corpus operators and stages owe to all rows of a corpus, whatever the ids."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
from millwright.llm import suffix, toxicity


def test_toxicity_model_is_the_same_under_any_ids(spark):
    r = random.Random(16)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in ("an", "el", "or") for c in ("ta", "mi", "su", "ko")]
    texts, marks = [], []
    for k in range(200):
        words, bad = r.choices(vocabulary, k=40), k % 4 == 0
        for _ in range(3):
            words.insert(r.randrange(40), r.choice(("vile", "qrux") if bad else ("plain", "quiet")))
        if bad or k % 2:
            words[r.randrange(40)] = "common"  # in texts of both kinds, after many words
        texts.append(" ".join(words))
        marks.append(int(bad))
    orders = [list(range(200)), sorted(range(200), key=lambda k: marks[k]), sorted(range(200), key=lambda k: -marks[k]), r.sample(range(200), 200)]
    found = [toxicity.offending_features([texts[k] for k in o], [marks[k] for k in o]) for o in orders]
    assert all(f == found[0] for f in found) and {"=vile", "=qrux"} <= set(found[0]) and "=common" not in found[0]
    models = []
    for o in orders:  # the ids follow the order; the sample holds all documents
        table = spark.createDataFrame([(i, texts[k], marks[k]) for i, k in enumerate(o)], "doc_id long, text string, toxic int")
        models.append(toxicity.fit_toxicity(table, table, held_out_fold=None))
    assert all(m == models[0] for m in models)


def brute_kept(texts: list[str], least: int, words: int) -> list[bytes]:
    """Without repeated strings of ``least`` bytes, and without repeated ones of ``words`` words."""
    raw = [t.encode() for t in texts]
    at = []
    for t, r in zip(texts, raw):
        w = [(len(t[: m.start()].encode()), len(t[: m.end()].encode())) for m in re.finditer(r"\S+", t)]
        at.append([(k, k + least) for k in range(len(r) - least + 1)] + [(a, b) for (a, _), (_, b) in zip(w, w[words - 1 :]) if b - a < least])
    times = Counter(r[a:b] for r, spans in zip(raw, at) for a, b in spans)
    out = []
    for r, spans in zip(raw, at):
        gone = {k for a, b in spans if times[r[a:b]] > 1 for k in range(a, b)}
        out.append(bytes(x for k, x in enumerate(r) if k not in gone))
    return out


def test_repeated_passages_of_few_bytes(spark):
    r = random.Random(9)
    part = lambda n: "".join(r.choice(("a", "é", "bc", "longer", "x")) + r.choice((" ", "\n", "\xa0", "  ")) for _ in range(n))
    shared = [part(k) for k in (4, 5, 6, 7, 9, 12, 20)]
    texts = [part(r.randrange(12)) + r.choice(shared) + part(r.randrange(9)) + r.choice(shared) for _ in range(50)] + ["z " * 90, "", shared[3]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({}, {"hot_times": 3}, {"hot_times": 3, "sent_passages": 0}):
        found = {x["doc_id"]: bytes(x["kept"]) for x in suffix.repeated_spans(table, min_bytes=40, gram=12, min_words=6, **options).collect()}
        assert [found[k] for k in range(len(texts))] == brute_kept(texts, 40, 6)


def test_pipeline_cuts_passages_of_over_fifty_words(spark, sf_dir):
    r = random.Random(10)
    word = lambda: "".join(r.choices("abcdefgh", k=2))
    long, short = (" ".join(word() for _ in range(n)) for n in (51, 50))
    assert len(long) < corpus_pipeline.REPEATED_BYTES
    own = [f"{k}number" for k in range(4)]
    table = spark.createDataFrame([(0, f"{own[0]} {long} {own[0]}"), (1, f"{own[1]} {long} {own[1]}"), (2, f"{own[2]}\n{short} {own[2]}"), (3, f"{own[3]} {short}\n{own[3]}"), (4, None)], "doc_id long, text string")
    found = dict(map(tuple, corpus_pipeline.cut_repeats(spark, table, sf_dir).select("doc_id", "text").collect()))
    assert found == {0: f"{own[0]}  {own[0]}", 1: f"{own[1]}  {own[1]}", 2: f"{own[2]}\n{short} {own[2]}", 3: f"{own[3]} {short}\n{own[3]}", 4: None}
