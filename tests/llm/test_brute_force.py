"""Parsing, likeness, transform and peak pairs against plain versions; rows that are null, empty, repeated, very long or oddly named."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.llm import bpe, fingerprints, media, secrets, token_counts
from millwright.llm.shingles import mix

STEP, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _mixed(x: int) -> int:
    return int(mix(np.array([x & MASK], np.uint64))[0])


def _parsed(names: list[int]) -> list[int]:
    """Phrase names of one text, symbol by symbol."""
    symbols, i = [], 0
    while i < len(names):
        j = i
        while j < len(names) and names[j] == names[i]:
            j += 1
        symbols.append(names[i] if j == i + 1 else _mixed(names[i] + (j - i) * STEP))
        i = j
    labels = symbols
    for _ in range(4):
        tossed = []
        for i, own in enumerate(labels):
            left = labels[i - 1] if i else own ^ 1
            place = next((b for b in range(64) if (own ^ left) >> b & 1), 0)
            tossed.append(2 * place + (own >> place & 1))
        labels = tossed
    starts = [i for i in range(len(symbols)) if i == 0 or (i + 1 < len(symbols) and labels[i] > labels[i - 1] and labels[i] > labels[i + 1])]
    ends = [*starts[1:], len(symbols)]
    return [_mixed(sum(_mixed(symbols[k] + (k - a) * STEP) for k in range(a, b))) for a, b in zip(starts, ends) if symbols]


def _fingerprint(text: str, levels: int, slots: int) -> list[int | None]:
    names = [_mixed(ord(c) + 1) for c in text]
    for _ in range(levels):
        names = _parsed(names)
    out: list[int | None] = [None] * slots
    for name in sorted(set(names), reverse=True):
        out[name % slots] = min(name >> 20 & 0xFFFF, 0xFFFE)
    return out


def _texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    return ["", "a", "aa", "ab", "aaaaaaaaaab", "é𝄞é𝄞", "x" * 5000, *[" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(25)]]


@pytest.mark.parametrize("levels,slots", ((1, 8), (2, 128), (3, 32)))
def test_parsing_is_the_plain_one(levels, slots):
    texts = _texts(1)
    expected = [_fingerprint(t, levels, slots) for t in texts]
    found = fingerprints.fingerprints(texts, levels, slots)
    assert found == ["".join(f"{0xFFFF if c is None else c:04x}" for c in e) for e in expected]
    assert found == [fingerprints.fingerprints([t], levels, slots)[0] for t in texts]  # alone as among others
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
    plain = []
    for i, j in pairs:
        used = [(a, b) for a, b in zip(expected[i], expected[j]) if a is not None or b is not None]
        plain.append(sum(a == b for a, b in used) / len(used) if used else 1.0)
    assert fingerprints.likeness([found[i] for i, _ in pairs], [found[j] for _, j in pairs]).tolist() == pytest.approx(plain)


@pytest.mark.parametrize("size", (64, 1024, 1088, 1536, 5056))
def test_peaks_are_those_of_the_plain_transform(size):
    rng = random.Random(size)
    samples = np.frombuffer("".join(rng.choice("etaoin shrdlu é") for _ in range(size)).encode()[:size], np.uint8)
    frame, hop = media.FRAME, media.HOP
    signal = [int(s) - 128 for s in samples]
    count = 1 if len(signal) <= frame else math.ceil((len(signal) - frame) / hop) + 1
    signal += [0] * ((count - 1) * hop + frame - len(signal))
    at = np.arange(frame)
    hann = 0.5 - 0.5 * np.cos(2 * math.pi * at / frame)
    strongest = []
    for f in range(count):
        x = np.array(signal[f * hop : f * hop + frame]) * hann
        power = [round(float(np.hypot((x * np.cos(2 * math.pi * k * at / frame)).sum(), (x * np.sin(2 * math.pi * k * at / frame)).sum())), 6) for k in range(frame // 2)]
        strongest.append([max(range(a, b), key=lambda k: (power[k], -k)) for a, b in media.BANDS])
    assert media.peaks(samples).tolist() == strongest
    gaps = range(1, media.REACH + 1) if count > 1 else (0,)
    plain = sorted((f, (strongest[f][k] << 10 | strongest[f + g][k]) << 4 | g) for g in gaps for f in range(count - g) for k in range(len(media.BANDS)))
    time, pair = media.peak_pairs(samples)
    assert list(zip(time.tolist(), pair.tolist())) == plain


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, repeated and very long texts (over 1 MB: more than one slice), with columns named like those to come."""
    secret = "password = hunter2hunter2 " + "word " * 10
    rows = [(1, None), (1, None), (2, ""), (3, secret), (3, secret), (None, "plain é text"), (4, "long text of words " * 80_000), (5, secret * 3)]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(7).alias(c) for c in ("n_tokens", "media", "payload", "marks", "fingerprint", "spans", "row", "t", "s")])


def test_odd_rows(odd):
    texts = [r["text"] for r in odd.collect()]
    small = [i for i, t in enumerate(texts) if t is None or len(t) < 10_000]

    counted = token_counts.token_counts(odd)
    assert [r["text"] for r in counted.collect()] == texts and set(counted.columns) == set(odd.columns)
    counts = [r["n_tokens"] for r in counted.collect()]
    assert counts[:3] == [0, 0, 0] and counts[3] == counts[4] and counts[6] > 80_000

    stored = media.read_media(media.store_media(odd)).collect()
    for r in stored:
        raw = (r["text"] or "").encode()
        assert bytes(r["payload"]) == raw + bytes(-len(raw) % 64 or (0 if raw else 64)) and r["row"] == 7
    assert stored[3]["marks"] == stored[4]["marks"] and stored[0]["marks"] == stored[2]["marks"]

    marked = [r["fingerprint"] for r in fingerprints.document_fingerprints(odd).collect()]
    assert marked == fingerprints.fingerprints([t or "" for t in texts])
    assert [marked[i] for i in small] == ["".join(f"{0xFFFF if c is None else c:04x}" for c in _fingerprint(texts[i] or "", 2, 128)) for i in small]

    redacted = secrets.redact_secrets(odd)
    out = [r["text"] for r in redacted.collect()]
    assert redacted.columns == odd.columns
    assert out[:3] == [None, None, ""] and out[3] == out[4] and "hunter2" not in out[3] + out[7] and out[5:7] == texts[5:7]

    coded = bpe.bpe_encode(odd)
    decoded = sorted((r["doc_id"] or 0, r["text"]) for r in bpe.bpe_decode(coded).collect())
    assert decoded == sorted((r["doc_id"] or 0, r["text"] or "") for r in odd.collect())


def test_empty_tables(odd):
    none = odd.limit(0)
    for found in (token_counts.token_counts(none), media.read_media(media.store_media(none)), fingerprints.document_fingerprints(none), secrets.redact_secrets(none), bpe.bpe_decode(bpe.bpe_encode(none))):
        assert found.collect() == []
