"""Pipeline stages and whole operators on rows that are null, repeated, very long or oddly named."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millwright.llm import jaccard, suffix

RNG = random.Random(17)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(4000)]


def _text(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


SHARED, COPY, OWN = _text(80), _text(60), [_text(60), _text(60)]
SECRET = 'token = "' + "0123456789abcdef" * 3 + '"'
#: (doc_id, text): null and empty ones, rows that repeat whole, one id with two texts, null ids with and without copies.
ROWS = [
    (1, None), (1, None), (2, ""), (3, COPY), (3, COPY), (4, COPY + " end"), (5, _text(50)), (5, _text(50)),
    (None, COPY), (None, "a text without an id"), (None, None), (6, f"{OWN[0]}.{SHARED}.one"), (7, f"{OWN[1]};{SHARED};two"), (8, f"with {SECRET} inside"), (8, f"with {SECRET} inside"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """The rows with columns named as the operators' own."""
    table = spark.createDataFrame(ROWS, "doc_id long, text string")
    return table.select("*", *[F.lit(7).alias(c) for c in ("component_id", "n_shingles", "n_removed", "n_spans", "spans", "n_chars", "toxicity", "row", "th", "cell", "gid", "key", "ctx")])


def _pairs(df) -> list[tuple]:
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_near_copies(spark, sf_dir, odd):
    kept = corpus_pipeline.drop_near_copies(spark, odd, sf_dir)
    assert kept.columns == odd.columns
    gone = [(1, None), (3, COPY), (4, COPY + " end"), (8, f"with {SECRET} inside")]  # of each repeated row one stays, of near copies the smallest id
    expected = list(ROWS)
    for row in gone:
        expected.remove(row)
    assert _pairs(kept) == sorted(expected, key=repr)
    assert kept.filter("component_id <> 7 or gid <> 7").count() == 0
    assert corpus_pipeline.drop_near_copies(spark, odd.limit(0), sf_dir).collect() == []


def test_repeats(spark, sf_dir, odd):
    cut = corpus_pipeline.cut_repeats(spark, odd, sf_dir)
    assert cut.columns == odd.columns and cut.count() == len(ROWS)
    found = _pairs(cut)
    assert [r for r in found if r[0] in (6, 7)] == [(6, f"{OWN[0]}..one"), (7, f"{OWN[1]};;two")]
    assert [r for r in found if r[0] in (1, 2, 8)] == [(1, None), (1, None), (2, ""), (8, f"with {SECRET} inside"), (8, f"with {SECRET} inside")]
    assert [r for r in found if r[0] in (3, 4)] == [(3, ""), (3, ""), (4, " end")]
    assert sorted(r[1] or "" for r in found if r[0] is None) == ["", "", "a text without an id"]
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cut.collect())
    assert corpus_pipeline.cut_repeats(spark, odd.limit(0), sf_dir).collect() == []


def test_secrets(spark, sf_dir, odd):
    out = corpus_pipeline.redact(spark, odd, sf_dir)
    assert out.columns == odd.columns
    clean = [r for r in ROWS if r[0] != 8]
    assert _pairs(out.filter("doc_id is null or doc_id <> 8")) == sorted(clean, key=repr)
    assert {r["text"].replace("[SECRET]", "") for r in out.filter("doc_id = 8").collect()} & {r[1] for r in ROWS} == set()
    assert out.filter("text like '%0123456789abcdef%'").count() == 0
    assert corpus_pipeline.redact(spark, odd.limit(0), sf_dir).collect() == []


def test_texts_over_a_megabyte(spark):
    """Longer than a slice: links and removed strings are those of the whole text."""
    base = _text(170_000)
    words = base.split(" ")
    near = words.copy()
    near[::400] = ["changed"] * len(near[::400])
    half = " ".join(words[: len(words) // 2])
    assert len(base) > 1 << 20
    table = spark.createDataFrame([(1, base), (2, " ".join(near)), (3, half), (4, _text(40))], "doc_id long, text string")

    def shingles(t: str) -> set:
        w = t.split(" ")
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}

    a, b, c = shingles(base), shingles(" ".join(near)), shingles(half)
    assert 100 * len(a & b) >= 85 * len(a | b) and 100 * len(a & c) < 85 * len(a | c)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table, shingle_words=4, percent=85).collect()}
    assert found == {1: (len(a), 1), 2: (len(b), 1), 3: (len(c), 3), 4: (37, 4)}

    whole = {r["doc_id"]: bytes(r["kept"]) for r in suffix.repeated_spans(spark.createDataFrame([(1, base), (2, "front " + base[: 1 << 20] + "\n")], "doc_id long, text string")).collect()}
    assert whole == {1: base[1 << 20 :].encode(), 2: b"front \n"}
