"""BPE encoding and decoding by tree concatenation.

Texts up to ``leaf_chars`` are encoded where they lie.  A longer one is halved again and again; the leaves are dealt out,
encoded in parallel and joined pairwise up the tree.  Halves are cut where the tokenizer splits anyway (before white
space, or between two pieces of its pattern); there, joining is laying end to end.  Only a piece that the pattern leaves
unsplit over more than a leaf is cut inside: then a window around the join is encoded anew and grows until its first and
its last token are tokens of the left and right side, which makes every adjacent pair of tokens valid and so the result exact.

Within a leaf, the pattern is applied by array operations, and its distinct pieces are merged side by side (see ``merges``).
Texts outside its table (see ``words``), or holding an added token's string, go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm import words
from millwright.llm.common import SLICE_BYTES, binaries, pick, text_slices, tidy
from millwright.llm.merges import LONGEST, Merges

#: Texts of more code points than this are halved until no part is longer.
LEAF_CHARS = 32_768
#: White space as the tokenizer's pattern knows it (Python's own \\s has four controls more).
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORD_END = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
_GAP_END = re.compile(f"(?<=[{_WHITE}])(?=[^{_WHITE}])")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The printable stand-in for each byte value in byte-level vocabularies: itself if printable, else the next from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b if b in keep else next(extra)) for b in range(256)]


class Codec:
    """Encodes and decodes with one byte-level tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = spec.get("added_tokens") or []
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        pre = spec.get("pre_tokenizer") or {}
        self.tabled = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        self.path = path
        self.letters = _byte_letters()
        value = {c: b for b, c in enumerate(self.letters)}
        size = self.library.get_vocab_size(with_added_tokens=True)
        spelled = [b""] * size
        for piece, i in self.library.get_vocab(with_added_tokens=True).items():
            spelled[i] = bytes(value[c] for c in piece) if all(c in value for c in piece) else piece.encode()
        for t in added:
            spelled[t["id"]] = t["content"].encode()
        self.spelled = spelled
        self.spelled_flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int64)
        model = spec["model"]
        self.tabled = self.tabled and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if self.tabled:
            ids = model["vocab"]
            parts = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            self.merges = Merges(np.array([ids[c] for c in self.letters]), [(ids[a], ids[b], ids[a + b]) for a, b in parts])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids begin (one more at the end)."""
        whole = [not (self.tabled and words.in_table(t)) or bool(self.added and self.added.search(t)) for t in texts]
        data = words.joined(["" if w else t for w, t in zip(whole, texts)])
        starts, ends, text_no = words.bpe_pieces(data)
        ids, size = self._pieces(data, starts, ends)
        per_text = np.bincount(text_no, weights=size, minlength=len(texts)).astype(np.int64) if len(text_no) else np.zeros(len(texts), np.int64)
        offsets = np.concatenate([[0], np.cumsum(per_text)])
        if any(whole):
            parts = [ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            rows = [i for i, w in enumerate(whole) if w]
            for i, e in zip(rows, self.library.encode_batch_fast([texts[i] for i in rows], add_special_tokens=False)):
                parts[i] = np.array(e.ids, np.int32)
            ids = np.concatenate(parts)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offsets

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these pieces end to end, and how many each has; a piece that comes again is encoded once."""
        head, index = words.distinct(data, starts, ends)
        starts, ends = starts[head], ends[head]
        long = ends - starts > LONGEST
        flat, at = self.merges.encode(data, starts[~long], ends[~long])
        if long.any():
            parts = [self.library.encode(data[a:b].tobytes().decode(), add_special_tokens=False).ids for a, b in zip(starts[long].tolist(), ends[long].tolist())]
            flat = np.concatenate([flat, *(np.array(p, np.int32) for p in parts)])
            at = np.concatenate([at, at[-1] + np.cumsum([len(p) for p in parts])])
            place = np.empty(len(long), np.int64)
            place[np.concatenate([np.flatnonzero(~long), np.flatnonzero(long)])] = np.arange(len(long))
            index = place[index]
        return words.gather(flat, at, index)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts that these ranges of ids spell; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary nothing."""
        ids = np.where((ids >= 0) & (ids < len(self.spelled)), ids, -1)
        out, size = words.gather(self.spelled_flat, np.append(self.spelled_at, self.spelled_at[-1]), ids % (len(self.spelled) + 1))
        at = np.concatenate([[0], np.cumsum(size)])[offsets]
        raw = out.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    # The parts of long texts.

    def leaves(self, text: str, leaf_chars: int) -> Iterator[tuple[str, bool, bool]]:
        """(part, it is of an unsplit piece, it goes on from the part before inside that piece), in order."""
        todo = [(0, len(text), False, False)]
        while todo:
            lo, hi, bare, inner = todo.pop()
            if hi - lo <= leaf_chars:
                yield text[lo:hi], bare, inner
                continue
            mid = (lo + hi) // 2
            if not bare:
                cut = self._split_near(text, lo, mid, hi)
                if cut:
                    todo += [(cut, hi, False, False), (lo, cut, False, False)]
                    continue
                if self.added and self.added.fullmatch(text, lo, hi):
                    yield text[lo:hi], False, False
                    continue
            todo += [(mid, hi, True, True), (lo, mid, True, inner)]

    def _split_near(self, text: str, lo: int, mid: int, hi: int) -> int:
        """A place in (lo, hi) where the tokenizer splits in any case, or 0."""
        found = _WORD_END.search(text, mid, hi)
        if found and lo < found.start() < hi:
            return found.start()
        back = max(lo, mid - 4096)
        while True:
            place = max((m.start() for m in _WORD_END.finditer(text[back:mid])), default=0)
            if place:
                return back + place
            if back == lo:
                break
            back = max(lo, back - 8 * (mid - back))
        cuts, at = [], lo
        spans = [m.span() for m in self.added.finditer(text, lo, hi)] if self.added else []
        edges = {edge for span in spans for edge in span}
        for a, b in [*spans, (hi, hi)]:
            if a > at:
                cuts += [at + s for _, (s, _) in self.library.pre_tokenizer.pre_tokenize_str(text[at:a])]
            cuts += [a, b]
            at = b
        fit = (c for c in cuts if lo < c < hi and (c == lo + 1 or c in edges or not _GAP_END.match(text, c)))  # else a gap's end would depend on what follows it
        return min(fit, key=lambda c: abs(c - mid), default=0)

    def encode_part(self, part: str, bare: bool) -> np.ndarray:
        if not bare:
            return self.encode([part])[0]
        return self._bare(part.encode("utf-8", "replace"))

    @cached_property
    def bare(self):
        """The tokenizer without its pattern."""
        from tokenizers import Tokenizer

        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        return Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "post_processor": None, "added_tokens": []}))

    def _bare(self, raw: bytes) -> np.ndarray:
        return np.array(self.bare.encode("".join(self.letters[b] for b in raw), add_special_tokens=False).ids, np.int32)

    def join(self, left: np.ndarray, right: np.ndarray, inner: bool) -> np.ndarray:
        """The ids of both sides' text; ``inner``: the join lies inside an unsplit piece."""
        if not inner or not len(left) or not len(right):
            return np.concatenate([left, right])
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            window = self._bare(b"".join(self.spelled[i] for i in [*a.tolist(), *b.tolist()]))
            left_agrees = k >= len(left) or window[0] == a[0]
            right_agrees = k >= len(right) or window[-1] == b[-1]
            if left_agrees and right_agrees and (len(window) > 1 or k >= max(len(left), len(right))):
                return np.concatenate([left[: len(left) - len(a)], window, right[len(b) :]])
            k *= 2


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _tree(parts: list[tuple[np.ndarray, bool, bool]], coder: Codec) -> np.ndarray:
    """Joins neighbours, level by level.  A join inside a piece only looks at tokens of that piece."""
    runs = [[part] for part in parts]
    while len(runs) > 1:
        paired = []
        for i in range(0, len(runs), 2):
            both = runs[i] if i + 1 == len(runs) else [*runs[i], *runs[i + 1]]
            merged: list[tuple[np.ndarray, bool, bool]] = []
            for ids, bare, inner in both:
                if merged and inner:
                    merged[-1] = (coder.join(merged[-1][0], ids, True), True, merged[-1][2])
                elif merged and not bare and not merged[-1][1]:
                    merged[-1] = (coder.join(merged[-1][0], ids, False), False, merged[-1][2])
                else:
                    merged.append((ids, bare, inner))
            paired.append(merged)
        runs = paired
    return np.concatenate([ids for ids, _, _ in runs[0]]) if runs else np.zeros(0, np.int32)


def encoded(docs: DataFrame, schema: str, emit, *, id_col: str, text_col: str, tokenizer: str | None, leaf_chars: int) -> DataFrame:
    """What ``emit`` makes of every text's ids: it gets the row ids, all ids end to end, where each text's begin, and how many rows its task, or its text, has had before."""
    path = tokenizer or default_tokenizer()
    rows = pick(docs, id_col, text_col)
    long = F.length("text") > leaf_chars

    def encode(batches):
        coder, before = codec(path), 0
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for lo, hi in text_slices(column):
                flat, offsets = coder.encode(column.slice(lo, hi - lo).to_pylist())
                yield emit(ids.slice(lo, hi - lo), flat, offsets, before)
                before += hi - lo

    def cut(batches):
        coder = codec(path)
        for batch in batches:
            for key, copies, text in zip(batch.column("key").to_pylist(), batch.column("copies").to_pylist(), batch.column("text").to_pylist()):
                parts = list(coder.leaves(text, leaf_chars))
                yield pa.record_batch([pa.array([key] * len(parts)), pa.array([copies] * len(parts)), pa.array(range(len(parts)), pa.int32()), *(pa.array(c) for c in zip(*parts))], ["key", "copies", "leaf", "part", "bare", "inner"])

    def encode_leaves(batches):
        coder = codec(path)
        names = ["key", "copies", "leaf", "bare", "inner"]
        for batch in batches:
            column, bare = batch.column("part"), batch.column("bare").to_pylist()
            for lo, hi in text_slices(column):
                parts = column.slice(lo, hi - lo).to_pylist()
                flat, at = coder.encode(["" if b else p for p, b in zip(parts, bare[lo:hi])])
                ids = [(coder.encode_part(p, True) if b else flat[x:y]).astype("<u4").tobytes() for p, b, x, y in zip(parts, bare[lo:hi], at[:-1].tolist(), at[1:].tolist())]
                yield pa.record_batch([batch.column(c).slice(lo, hi - lo) for c in names] + [pa.array(ids, pa.binary())], [*names, "ids"])

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("leaf")
        parts = [(np.frombuffer(i, "<i4"), b, n) for i, b, n in zip(group["ids"].to_pylist(), group["bare"].to_pylist(), group["inner"].to_pylist())]
        ids = _tree(parts, codec(path))
        doc_id = pa.array([group["key"][0].as_py()["doc_id"]], pa.int64())
        return pa.Table.from_batches([emit(doc_id, ids, np.array([0, len(ids)]), k) for k in range(group["copies"][0].as_py())])

    short_ids = rows.filter(~long).mapInArrow(tidy(encode), schema)
    copies = rows.filter(long).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    keyed = copies.select(F.struct("doc_id", F.sha2("text", 256).alias("sha")).alias("key"), "copies", "text")
    key = "key struct<doc_id: long, sha: string>, copies long, leaf int"
    leaves = keyed.mapInArrow(tidy(cut), f"{key}, part string, bare boolean, inner boolean").repartition("key", "leaf")
    coded = leaves.mapInArrow(tidy(encode_leaves), f"{key}, bare boolean, inner boolean, ids binary")
    return short_ids.unionByName(coded.groupBy("key").applyInArrow(join, schema))


def bpe_encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Ids of every whole text, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Returns doc_id long, ids binary (little-endian 32-bit ids), one row for each row of ``docs``.  A null or empty text
    has no ids (empty binary), a null id stays null, repeated rows are repeated, an empty table gives an empty one;
    other columns are left aside, so their names do not matter.
    """

    def emit(ids, flat, offsets, before):
        return pa.record_batch([ids, binaries(flat.astype("<u4"), offsets * 4)], ["doc_id", "ids"])

    return encoded(docs, "doc_id long, ids binary", emit, id_col=id_col, text_col=text_col, tokenizer=tokenizer, leaf_chars=leaf_chars)


def bpe_decode(coded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """The text that the ids of each row spell, as ``Tokenizer.decode(ids, skip_special_tokens=False)`` gives it.

    Returns doc_id, ids, text.  Null ids count as none and give an empty text; bytes that are no UTF-8 become U+FFFD.  Repeated rows
    stay, very long ones are decoded whole, other columns are left out, and an empty table gives an empty one.
    """
    path = tokenizer or default_tokenizer()

    def decode(batches):
        coder = codec(path)
        for batch in (whole.slice(lo, hi - lo) for whole in batches for lo, hi in text_slices(whole.column("ids"), 4 * SLICE_BYTES)):
            col = batch.column("ids")
            packed = [b or b"" for b in col.to_pylist()]
            lo = 0
            for hi in [*range(256, len(packed), 256), len(packed)]:
                part = packed[lo:hi]
                offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in part])]).astype(np.int64)
                texts = coder.decode(np.frombuffer(b"".join(part), "<i4"), offsets)
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), col.slice(lo, hi - lo), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
                lo = hi

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("binary").alias("ids")).mapInArrow(tidy(decode), "doc_id long, ids binary, text string")
