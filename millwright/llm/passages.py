"""Repeated passages of whole words that take fewer bytes than a repeated string must have.

Passages are sampled by content, as byte strings are in ``suffix``: of all ``gram`` words in a row inside a passage, those with
the least hash are its anchor, so equal passages have equal anchors; consecutive passages with one anchor are an entry (about
one in (words - gram) / 2 words).  Only entries whose anchor stands in a second place, and at least once outside the spans
found before, are taken apart into passages, which are counted by 128-bit hashes.  Nothing is capped.

What stands twice in one batch of a task is settled there and sent on once, so that what is common does not meet in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm.common import MARKS, SLICE_BYTES, tidy, written
from millwright.llm.shingles import mix, word_hashes

#: Words in a row that make an anchor, and passages that one step of array operations takes.
GRAM, _BLOCK = 8, 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: What parts words, as in str.split(): bytes of ASCII, and longer characters.
_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end."""
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    if not raw.isascii():
        for m in _WIDE_SPACE.finditer(raw):
            space[m.start() : m.end()] = True
    turns = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    return turns[::2], turns[1::2]


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """Of each ``width`` numbers in a row, the place of the least (of up to 2^24 numbers, compared without their last 24 bits)."""
    low, n = np.uint64((1 << 24) - 1), len(hashes) - width + 1
    keyed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    blocks = np.full(-(-len(keyed) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(keyed)] = keyed
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)


def list_anchors(texts: list[bytes], words: int, below: int, gram: int = GRAM):
    """(text numbers, where the first passage begins, where the last one ends, keys) of the entries of short passages, a step at a time."""
    gram = min(gram, words)
    i = 0
    while i < len(texts):
        first, size = i, 0
        while i < len(texts) and (i == first or size + len(texts[i]) < SLICE_BYTES):
            size += len(texts[i]) + 1
            i += 1
        raw = b" ".join(texts[first:i])
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts[first:i])])
        all_starts, all_ends = word_places(raw)
        for w in range(0, len(all_starts) - words + 1, _BLOCK):
            starts, ends = all_starts[w : w + _BLOCK + words - 1], all_ends[w : w + _BLOCK + words - 1]
            m = len(starts) - words + 1
            owner = np.searchsorted(bounds, starts, side="right") - 1
            short = (ends[words - 1 :] - starts[:m] < below) & (owner[:m] == owner[words - 1 :])
            if not short.any():
                continue
            named = word_hashes(np.frombuffer(raw, np.uint8)[starts[0] : ends[-1]], starts - starts[0], ends - starts[0])
            hashes = np.zeros(len(named) - gram + 1, np.uint64)
            for k in range(gram):
                hashes = hashes * _FACTOR + named[k : k + len(hashes)]
            hashes = mix(hashes)
            anchor = least_places(hashes, words - gram + 1)
            new = np.ones(m, bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:m] != owner[: m - 1]) | ~short[:-1]
            begin = np.flatnonzero(new & short)
            stop = np.flatnonzero(np.append(new[1:] | ~short[1:], True) & short)
            base = bounds[owner[begin]]
            yield owner[begin] + first, starts[begin] - base, ends[stop + words - 1] - base, hashes[anchor[begin]].view(np.int64)


def merged(runs: Iterable[tuple[int, int]]) -> list[list[int]]:
    """The maximal runs that ranges cover together."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def inside_spans(spans: pa.ListArray, owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of the ranges [lo, hi) of text number ``owner`` lie in one of that text's spans."""
    of = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy()) << 32
    start, end = (of + spans.flatten().field(k).to_numpy() for k in (0, 1))
    order = np.argsort(start)
    far = np.append(np.maximum.accumulate(end[order]), -1)  # what begins in earlier texts ends in them
    return far[np.searchsorted(start[order], (owner << 32) + lo, side="right") - 1] >= (owner << 32) + hi


def repeated_short_passages(texts: DataFrame, cover: DataFrame, folder: str, *, words: int, below: int, mark: str) -> DataFrame:
    """(uid, th, passages): the runs of bytes that passages of ``words`` words cover which take fewer than ``below`` bytes and stand in two places or more.

    ``texts``: uid, th, text and its mark; ``cover``: uid, th and the spans (cover) found before.  Passages of which every
    copy lies inside one of these spans may be left out.
    """

    def beside(table: DataFrame, columns: list[str], outer: bool) -> DataFrame:
        marks = F.broadcast(table.select(F.pmod(F.xxhash64("uid"), F.lit(MARKS)).alias(mark)).distinct())
        found = texts.join(marks, mark, "left_semi").join(table, ["uid", "th"], "left" if outer else "inner").select("uid", "th", "text", *columns)
        none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in columns]
        return found.unionByName(texts.join(marks, mark, "left_anti").select("uid", "th", "text", *none)) if outer else found

    def raw_texts(batch) -> list[bytes]:
        return [t.encode("utf-8", "replace") for t in batch.column("text").to_pylist()]

    def list_places(parts):
        for batch in parts:
            raw, uid, th = raw_texts(batch), batch.column("uid").to_numpy(), batch.column("th").to_numpy()
            listed = list(list_anchors(raw, words, below))
            if not listed:
                continue
            owner, lo, hi, key = (np.concatenate(x) for x in zip(*listed))
            held = inside_spans(batch.column("cover"), owner, lo, hi)
            keys, group, count = np.unique(key, return_inverse=True, return_counts=True)
            outside = np.zeros(len(keys), bool)
            outside[group[~held]] = True
            settled = (count > 1) & outside
            salt = np.where(settled[group], np.arange(1, len(key) + 1), 0)
            wanted = np.ones(len(key), bool)
            seen = set()
            for k in np.flatnonzero((count[group] > 1) & ~settled[group]).tolist():  # all inside spans: of equal entries one is enough
                kind = key[k], xxhash.xxh3_64_intdigest(raw[owner[k]][lo[k] : hi[k]])
                wanted[k] = kind not in seen
                seen.add(kind)
            owner, lo, hi, key, salt, held, n = owner[wanted], lo[wanted], hi[wanted], key[wanted], salt[wanted], held[wanted], int(settled.sum())
            place = lambda x: pa.concat_arrays([pa.array(x), pa.nulls(n, pa.int64())])
            votes = np.concatenate([key, keys[settled]]), np.concatenate([salt, np.zeros(n, np.int64)]), np.concatenate([~held, np.ones(n, bool)])
            yield pa.record_batch([pa.array(votes[0]), pa.array(votes[1]), place(uid[owner]), place(th[owner]), place(lo), place(hi), pa.array(votes[2])], ["key", "salt", "uid", "th", "lo", "hi", "outside"])

    places = beside(cover, ["cover"], True).mapInArrow(tidy(list_places), "key long, salt long, uid long, th long, lo long, hi long, outside boolean")
    alike = Window.partitionBy("key", "salt")
    contested = places.withColumn("n", F.count("*").over(alike)).withColumn("outside", F.max("outside").over(alike)).filter("uid is not null and (salt > 0 or n > 1 and outside)")
    per_text = written(contested.groupBy("uid", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")).join(cover.select("uid", "th", "cover"), ["uid", "th"], "left"), folder=f"{folder}/ranges")

    def list_windows(parts):
        for batch in parts:
            uid, th = batch.column("uid").to_pylist(), batch.column("th").to_pylist()
            raw, listed = raw_texts(batch), []
            for i, ranges in enumerate(batch.column("ranges")):
                starts, ends = word_places(raw[i])
                lo, hi = (ranges.values.field(k).to_numpy() for k in (0, 1))
                inside = np.zeros(len(starts) + 1, np.int64)
                np.add.at(inside, np.searchsorted(starts, lo), 1)
                np.add.at(inside, np.searchsorted(ends, hi) - words + 2, -1)
                at = np.flatnonzero(np.cumsum(inside)[: len(starts) - words + 1] > 0)
                at = at[ends[at + words - 1] - starts[at] < below]
                listed.append((np.full(len(at), i), starts[at], ends[at + words - 1]))
            if not listed:
                continue
            owner, start, end = (np.concatenate(x) for x in zip(*listed))
            held = inside_spans(batch.column("cover"), owner, start, end)
            found: dict[bytes, list] = {}
            for i, a, b, h in zip(owner.tolist(), start.tolist(), end.tolist(), held.tolist()):
                found.setdefault(xxhash.xxh3_128_digest(raw[i][a:b]), []).append(None if h else (i, a, b))
            # a passage inside a span is only counted
            single = [(w, *x[0]) for w, x in found.items() if len(x) == 1 and x[0]]
            twice = {w: [p for p in x if p] for w, x in found.items() if len(x) > 1 or not x[0]}
            runs: dict[int, list[tuple[int, int]]] = {}
            for x in twice.values():
                for i, a, b in x:
                    runs.setdefault(i, []).append((a, b))
            settled = [(i, a, b) for i, x in runs.items() for a, b in merged(x)]
            named = np.frombuffer(b"".join([*(x[0] for x in single), *twice, bytes(16 * len(settled))]), np.int64).reshape(-1, 2)
            salt = np.concatenate([np.zeros(len(single) + len(twice), np.int64), np.arange(1, len(settled) + 1)])
            where = [*(x[1:] for x in single), *[None] * len(twice), *settled]
            column = lambda f: pa.array([None if x is None else f(x) for x in where], pa.int64())
            yield pa.record_batch([pa.array(named[:, 0]), pa.array(named[:, 1]), pa.array(salt), column(lambda x: uid[x[0]]), column(lambda x: th[x[0]]), column(lambda x: x[1]), column(lambda x: x[2])], ["w1", "w2", "salt", "uid", "th", "start", "end"])

    windows = beside(per_text, ["ranges", "cover"], False).mapInArrow(tidy(list_windows), "w1 long, w2 long, salt long, uid long, th long, start long, end long")
    again = windows.withColumn("n", F.count("*").over(Window.partitionBy("w1", "w2", "salt"))).filter("uid is not null and (salt > 0 or n > 1)")
    return written(again.groupBy("uid", "th").agg(F.collect_list(F.struct("start", "end")).alias("passages")), folder=f"{folder}/short")
