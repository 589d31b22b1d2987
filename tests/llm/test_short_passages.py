"""op10's last column: repeated passages of whole words that take fewer bytes than a repeated string."""

from __future__ import annotations

import random
from collections import Counter

import __spark_entry__

from millwright.llm import passages, suffix


def covered(texts: list[str], least: int, words: int) -> list[int]:
    """Brute force: bytes of each text in strings of ``least`` bytes or passages of ``words`` words that start twice."""
    raw = [t.encode() for t in texts]
    found = []
    for b in raw:
        places, at = [], 0
        for w in b.decode().split():
            at = b.index(w.encode(), at)
            places.append((at, at + len(w.encode())))
            at += len(w.encode())
        found.append([(x[0], y[1]) for x, y in zip(places, places[words - 1 :])] + [(k, k + least) for k in range(len(b) - least + 1)])
    times = Counter((hash(raw[i][a:b]), b - a) for i, x in enumerate(found) for a, b in sorted(set(x)))
    out = []
    for b, x in zip(raw, found):
        gone = bytearray(len(b))
        for lo, hi in x:
            if times[hash(b[lo:hi]), hi - lo] > 1:
                gone[lo:hi] = b"\x01" * (hi - lo)
        out.append(sum(gone))
    return out


def test_op10_tells_short_passages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in __spark_entry__.queries()["op10_suffix_array_dedup"](spark, sf_dir).collect()}
    want = covered([r["text"] or "" for r in docs], 400, 51)
    assert [found[r["doc_id"]]["n_repeated"] for r in docs] == want
    assert sum(found[r["doc_id"]]["n_removed"] for r in docs) < sum(want)  # the contract's columns leave them


def test_short_passages_by_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "be", "sea", "ñu", "été", "longer", "x" * 30, "y" * 70]
    shared = [" ".join(rng.choices(vocabulary[:6], k=n)) for n in (5, 6, 7, 9, 14, 30)]
    gaps = [" ", "\n", " ", " ", "  "]
    made = ["".join(rng.choice([*shared, *vocabulary]) + rng.choice(gaps) for _ in range(rng.randint(1, 25))) for _ in range(120)]
    texts = [*made, "", "one", shared[3], shared[3], made[0], *["common " + shared[4]] * 70]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in suffix.repeated_spans(table, min_bytes=60, gram=12, passage_words=6).collect()}
    plain = {r["doc_id"]: r for r in suffix.repeated_spans(table, min_bytes=60, gram=12).collect()}
    assert [sum(s["end"] - s["start"] for s in found[i]["repeated"]) for i in range(len(texts))] == covered(texts, 60, 6)
    assert all((r["spans"], r["kept"]) == (found[i]["spans"], found[i]["kept"]) for i, r in plain.items())


def test_entries_hold_every_short_passage_once(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["a", "bc", "def", "z" * 20], k=rng.randint(0, 60))).encode() for _ in range(30)]

    def listed():
        out = []
        for owner, lo, hi, key in passages.list_anchors(texts, 6, 40, 3):
            for i, a, b, k in zip(owner.tolist(), lo.tolist(), hi.tolist(), key.tolist()):
                starts, ends = passages.word_places(texts[i][a:b])
                out += [(i, a + x, a + y, k) for x, y in zip(starts.tolist(), ends[5:].tolist())]
        return sorted(out)

    want = []
    for i, t in enumerate(texts):
        starts, ends = passages.word_places(t)
        want += [(i, x, y) for x, y in zip(starts.tolist(), ends[5:].tolist()) if y - x < 40]
    whole = listed()
    assert [x[:3] for x in whole] == sorted(want)
    keys: dict[bytes, set[int]] = {}
    for i, a, b, k in whole:
        keys.setdefault(b" ".join(texts[i][a:b].split()), set()).add(k)
    assert all(len(x) == 1 for x in keys.values())  # equal passages have one key
    monkeypatch.setattr(passages, "_BLOCK", 7)
    assert listed() == whole


def test_short_passages_of_odd_rows(spark):
    words = "one two three four five six"
    rows = [(None, words + " x"), (None, None), (3, "y " + words), (4, "z"), (4, "z"), (5, "")]
    found = suffix.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), min_bytes=60, passage_words=6).collect()
    assert sorted((r["text"] or "", sum(s["end"] - s["start"] for s in r["repeated"])) for r in found) == sorted((t or "", len(words) if words in (t or "") else 0) for _, t in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.repeated_spans(empty, passage_words=6).count() == 0
