"""The registered queries on the smallest tables: every contract column against a brute-force version."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from millwright.llm import bpe, extract
from millwright.llm.queries import QUERIES


@pytest.fixture(scope="module")
def texts(sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}


def rows(spark, sf_dir, name, key="doc_id"):
    found = [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]
    by_id = {r[key]: r for r in found}
    assert len(by_id) == len(found)
    return by_id


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def library_ids(texts):
    library = bpe.codec(bpe.default_tokenizer()).library
    return {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}, library


def test_op1(spark, sf_dir, texts):
    found, (ids, library) = rows(spark, sf_dir, "op1_bpe"), library_ids(texts)
    expected = {i: (len(v), sha(np.array(v, "<u4").tobytes()), sha(library.decode(v, skip_special_tokens=False))) for i, v in ids.items()}
    assert {i: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for i, r in found.items()} == expected


def test_op2(spark, sf_dir, texts):
    ids = {i: np.array([*v, 2], "<u4") for i, v in library_ids(texts)[0].items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op2_best_fit_packing"](spark, sf_dir).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for i, parts in pieces.items():
        parts.sort(key=lambda r: r["piece"])
        starts = np.cumsum([0, *(r["length"] for r in parts)])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and [r["start"] for r in parts] == starts[:-1].tolist() and starts[-1] == len(ids[i])
        assert all(r["length"] == 1024 for r in parts[1:]) and 0 < parts[0]["length"] <= 1024
        assert [r["ids_crc32"] for r in parts] == [zlib.crc32(ids[i][a:b].tobytes()) for a, b in zip(starts, starts[1:])]
    for places in sequences.values():
        places.sort()
        ends = np.cumsum([0, *(n for _, n in places)])
        assert [o for o, _ in places] == ends[:-1].tolist() and ends[-1] <= 1024
    least = -(-sum(map(len, ids.values())) // 1024)
    assert len(sequences) <= 1.01 * least + 1


def test_op3(spark, sf_dir):
    pages = {r["page_id"]: r for r in pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()}
    found = rows(spark, sf_dir, "op3_html_extraction", "page_id")
    assert found.keys() == pages.keys()
    for i, page in pages.items():
        text = article(page["html"] or "")
        assert (found[i]["url"], found[i]["text"], found[i]["n_chars"]) == (page["url"], text, len(text))


def article(html: str) -> str:
    """All text below the article element; the given pages hold no furniture there."""
    tree = extract.parse(html)
    inside = [False] * len(tree.tags)
    for i in range(1, len(inside)):
        inside[i] = tree.tags[i] == "article" or inside[tree.parents[i]]
    return extract.text_of(tree, inside)


def test_extraction_of_pages_without_telling_names():
    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist() if r["html"]]
    model = extract.fit(pages[::2])
    assert len({int(f) for trees, cuts in zip(model.features, model.cuts) for f, c in zip(trees, cuts) if np.isfinite(c)}) >= 8

    def decoded(tree):
        x, own = extract.features(tree)
        return extract.decode(tree, model.margin(x).tolist(), own), own

    held_out = pages[1::2]
    for tag in ("div", "section"):
        renamed = [re.sub(r"<(/?)(article|nav|footer)\b", rf"<\1{tag}", p).replace(' class="ad"', "") for p in held_out]
        whole = sum(extract.text_of(tree, decoded(tree)[0]) == article(p) for p, tree in zip(held_out, map(extract.parse, renamed)))
        assert whole >= 0.9 * len(held_out)
    hits = Counter()
    for k, page in enumerate(held_out):
        tree = extract.parse(extract.variant(page, 2 * k))
        wanted = extract._labels(tree)
        inside, own = decoded(extract.masked(tree, 10**6 + k, whole=True))
        hits.update((bool(a), bool(b)) for a, b, c in zip(inside, wanted, own) if c)
    assert hits[True, True] >= 0.95 * (hits[True, True] + hits[True, False])  # precision
    assert hits[True, True] >= 0.95 * (hits[True, True] + hits[False, True])  # recall


def test_op6(spark, sf_dir, texts):
    kinds = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))
    found = rows(spark, sf_dir, "op6_secret_scans")
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        spans, counts = [], Counter()
        for rank, (kind, pattern) in enumerate(kinds):
            for m in pattern.finditer(text):
                if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                    spans.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
                    counts[kind] += 1
        named = [s for _, _, s in sorted(spans)]
        r = found[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (counts["assign"], counts["access"], counts["hex"], sha(",".join(named)))
        assert set(named) <= set(r["spans"].split(",")) or not named


def test_op7(spark, sf_dir, texts):
    found, order = rows(spark, sf_dir, "op7_document_fingerprints"), sorted(texts)
    prints = {}
    for i, after in zip(order, [*order[1:], order[0]]):
        text, r = texts[i], found[i]
        n = len(text) // 4
        edited = text[: len(text) - n] + texts[after][:n]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited))
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert edited != text or r["near_edited"] == 1
    assert len(found) == len(order)


def test_op8(spark, sf_dir, texts):
    found = rows(spark, sf_dir, "op8_toxicity")
    assert found.keys() == texts.keys()
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op9(spark, sf_dir, texts):
    found, features = rows(spark, sf_dir, "op9_media_columns"), {}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        raw, r = text.encode(), found[i]
        payload = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] >= len(payload) and features.setdefault(text, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_op10(spark, sf_dir, texts):
    found, least = rows(spark, sf_dir, "op10_suffix_array_dedup"), 400
    raw = {i: t.encode() for i, t in texts.items()}
    times = Counter(hash(b[k : k + least]) for b in raw.values() for k in range(len(b) - least + 1))
    assert found.keys() == raw.keys()
    for i, b in raw.items():
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - least + 1):
            if times[hash(b[k : k + least])] > 1:
                gone[k + 1 : k + least + 1] = True
        kept = np.frombuffer(b, np.uint8)[~gone[1:-1]].tobytes()
        r = found[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), sha(kept))
