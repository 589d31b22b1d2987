"""Operators 11 to 13: contract columns against brute force, and odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from millwright.llm import periods, recompression, spelling
from millwright.llm.queries import QUERIES, with_periods

SPACE = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def texts(sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}


def sha(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def brute_runs(words):
    """All periods, one after the other; of equal stretches the least period counts."""
    ids = np.unique(words, return_inverse=True)[1] if words else np.zeros(0, int)
    found = {}
    for p in range(1, len(words) // 3 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids[p:] == ids[:-p], [False]]).astype(int)))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if j - i + p >= max(24, 3 * p) and not any((ids[i : j + p - q] == ids[i + q : j + p]).all() for q in range(1, p)):
                found[i, j - i + p, p] = True
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_op13(spark, sf_dir, texts):
    found = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    assert found.keys() == texts.keys()
    total = 0
    for i, text in texts.items():
        words = SPACE.findall(text)
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute_runs(words)
        total += len(runs)
        gone = {k for s, size, p in runs for k in range(s + p, s + size)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        r = found[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{size},{p}\n" for s, size, p in runs))
        assert r["collapsed_sha256"] == sha(" ".join(w for k, w in enumerate(words) if k not in gone))
    assert total > 10


def test_runs_of_made_up_words():
    rng = random.Random(5)
    for _ in range(120):
        parts = []
        while len(parts) < rng.randint(0, 250):
            parts += [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 20))] * rng.choice([1, 1, 2, 3, 5])
        (n, runs), = periods.text_runs([" ".join(parts)])
        assert (n, runs) == (len(parts), brute_runs(parts))


def test_lyndon_array():
    rng = random.Random(6)
    for _ in range(400):
        codes = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 30))]
        codes = [sorted(set(codes)).index(c) for c in codes]
        longest = [max(k for k in range(1, len(codes) - i + 1) if all(codes[i : i + k] < codes[j : i + k] for j in range(i + 1, i + k))) for i in range(len(codes))]
        assert periods.lyndon_array(codes) == longest


def test_periodic_runs_of_odd_rows(spark):
    text = "x y z " * 40
    rows = [(1, None, "a"), (2, "", "b"), (2, " \t\n", "b"), (None, text, "c"), (None, text, "c"), (4, "é w " * 60, "d"), (5, "long " * 300_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, RUNS string")
    found = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.periodic_runs(docs).collect()), key=str)
    expected = [(0, 120, [(0, 120, 3)], "x y z")] * 2 + [(1, 0, [], "")] + [(2, 0, [], "")] * 2 + [(4, 60, [(0, 60, 1)], "é w"), (5, 300_000, [(0, 300_000, 1)], "long")]
    assert found == sorted(expected, key=str)
    assert periods.periodic_runs(docs.limit(0)).collect() == []
    assert with_periods(docs.select("doc_id", "text")).count() == 7


def brute_variants(texts, least_letters=6, least_times=5):
    counts = Counter()
    for i, text in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_times}
    near, shorter = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            shorter[w[:k] + w[k + 1 :], k].add(w)  # words that differ at k only, or by the letter at k
            if (less := w[:k] + w[k + 1 :]) in words:
                near[w].add(less)
                near[less].add(w)
    for group in shorter.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def test_op12(spark, sf_dir, texts):
    found = {r["word"]: tuple(r)[1:] for r in QUERIES["op12_spelling_variants"](spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert found == brute_variants(texts)


def test_spelling_variants_in_small_blocks(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 8))) for _ in range(60)]
    texts = {}
    for i in range(40):
        texts[i] = " ".join(w if rng.random() < 0.7 else w[: (k := rng.randrange(len(w)))] + rng.choice(["", "a", "ß"]) + w[k + 1 :] for w in rng.choices(base, k=300))
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(77, None, "x"), (78, "", "x")], "doc_id long, text string, word string")
    for block_words, sent in ((7, 1 << 16), (10_000, 0)):
        found = {r["word"]: tuple(r)[1:] for r in spelling.spelling_variants(docs, slip=199, block_words=block_words, sent_units=sent).collect()}
        assert found == brute_variants(texts) and any(x[0] for x in found.values())
    assert spelling.spelling_variants(docs.limit(0)).collect() == []
    twice = spark.createDataFrame([(None, "Straße Straße straße", 1)] * 2, "doc_id long, text string, n int")
    assert [tuple(r) for r in spelling.spelling_variants(twice).collect()] == [("straße", None, "straße", 6, 0, None)]


def brute_passages(texts, window):
    """Numbers of the words that go, for each (id, text)."""
    first = {}
    for i, words in texts:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            first[w] = min(first.get(w, i), i)
    gone = []
    for i, words in texts:
        gone.append({k + j for k in range(len(words) - window + 1) if first[tuple(words[k : k + window])] < i for j in range(window)})
    return gone


def test_op11(spark, sf_dir, texts):
    found = {r["doc_id"]: tuple(r) for r in QUERIES["op11_substring_dedup"](spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    listed = [(i, SPACE.findall(t)) for i, t in texts.items()]
    expected = {i: (i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))) for (i, w), gone in zip(listed, brute_passages(listed, 50))}
    assert found == expected and sum(r[2] > 0 for r in expected.values()) > 5


@pytest.mark.parametrize(("window", "rounds", "hot", "sent"), [(8, 0, 64, 1 << 17), (13, 2, 3, 1 << 17), (8, 3, 3, 0), (8, 2, 3, 2)])
def test_passages_of_made_up_words(spark, monkeypatch, window, rounds, hot, sent):
    monkeypatch.setattr(recompression, "HOT_TIMES", hot)
    monkeypatch.setattr(recompression, "_STEP", 37)
    rng = random.Random(11)
    shared = [[rng.choice("abcdefgh") for _ in range(rng.randint(window, 40))] for _ in range(5)] + [["a"] * 30, ["b", "c"] * 20]
    texts = []
    for i in range(70):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts += rng.choice(shared) if rng.random() < 0.5 else [f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 30))]
        texts.append((i % 60, parts))
    docs = spark.createDataFrame([(i, " \t".join(w), k) for k, (i, w) in enumerate(texts)], "doc_id long, text string, row int")
    found = {r["row"]: r for r in recompression.repeated_passages(docs, window=window, rounds=rounds, sent_hot=sent).collect()}
    for k, ((_, words), gone) in enumerate(zip(texts, brute_passages(texts, window))):
        spans = {j for s in found[k]["spans"] for j in range(s["start"], s["end"])}
        assert (found[k]["n_words"], spans, found[k]["kept"]) == (len(words), gone, " ".join(w for j, w in enumerate(words) if j not in gone))


def test_passages_of_odd_rows(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(None, passage, "n"), (3, passage, "c"), (3, passage, "c"), (2, f"x {passage} é", "b"), (9, None, "d"), (10, "", "e"), (11, "few words", "f"), (12, "z " * 400_000 + passage, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SPANS string")
    found = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(s) for s in r["spans"]], len(r["kept"])) for r in recompression.repeated_passages(docs).collect()), key=str)
    expected = [(0, 60, [], len(passage)), (3, 60, [(0, 60)], 0), (3, 60, [(0, 60)], 0), (2, 62, [], len(passage) + 4), (9, 0, [], 0), (10, 0, [], 0), (11, 2, [], 9), (12, 400_060, [(400_000, 400_060)], 799_999)]
    assert found == sorted(expected, key=str)
    assert recompression.repeated_passages(docs.limit(0)).collect() == []
