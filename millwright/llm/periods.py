"""Periodic runs in word sequences: Lyndon arrays from the first phase of Baier's suffix sorter, roots extended to runs.

A run has a Lyndon root that is the longest Lyndon word from its place under one of two orders of the words, the given one and
the opposite one.  The first phase of Baier's sorter groups suffixes by just those words, and the length that a group stands for
is their entry in the Lyndon array.  Both arrays together name all roots; each is extended left and right as far as words a period
apart agree (longest common extension), which gives the run.

A run of at least 24 words and three periods repeats each eight words of its own within a third of its length, so stretches
without such repeats are left out before.  This loses no run, and equal words are told by their bytes, not by hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm import words
from millwright.llm.common import extended, text_slices
from millwright.llm.shingles import mix

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the strings that must repeat within a run; with the two numbers above, at most a third of LEAST_WORDS.
_GRAM = 8
_C = np.uint64(0x9E3779B97F4A7C15)


def lyndon_array(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word from each place; ``codes`` are the letters' ranks, the end is less than any.

    Groups are taken from the greatest down.  Each member's nearest smaller place before it gets the group's word behind its own,
    as often as members point to it, and moves to a new group just above its old one.
    """
    n = len(codes)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    top = max(codes) + 1 if n else 0
    members: list[list[int]] = [[] for _ in range(top)]
    for i, c in enumerate(codes):
        members[c].append(i)
    group, size = list(codes), [1] * top
    below, above = list(range(-1, top - 1)), list(range(1, top)) + [-1]
    g = top - 1
    while g >= 0:
        times: dict[int, int] = {}
        for i in members[g]:
            if group[i] != g:
                continue
            left, right = before[i], after[i]
            if left >= 0:
                after[left] = right
                times[left] = times.get(left, 0) + 1
            if right < n:
                before[right] = left
        moved: dict[tuple[int, int], list[int]] = {}
        for i, k in times.items():  # in ascending order, as the members
            moved.setdefault((k, group[i]), []).append(i)
        for (k, old), places in sorted(moved.items(), reverse=True):
            new = len(size)
            size.append(size[old] + k * size[g])
            members.append(places)
            for i in places:
                group[i] = new
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
        g = below[g]
    return [size[g] for g in group]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal."""
    step, at, n = 32, 0, min(len(a), len(b))
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at += step
        step *= 2
    return n


def runs_of(codes: np.ndarray, grams: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a stretch, by start and period; ``grams`` names the eight words from each place, but the last seven."""
    _, ranks = np.unique(codes, return_inverse=True)
    found: set[tuple[int, int, int]] = set()
    for order in (ranks, ranks.max() - ranks):
        period = np.array(lyndon_array(order.tolist()), np.int64)
        place = np.arange(len(codes))
        second = place + period
        root = second < len(grams)
        root[root] = grams[place[root]] == grams[second[root]]
        last = None  # the repetition of the root before this one
        for p, i in sorted(zip(period[root].tolist(), place[root].tolist())):
            if last and last[0] == p and last[1] <= i and i + p <= last[2]:
                continue
            end = i + p + _agree(codes[i:], codes[i + p :])
            start = i - _agree(codes[:i][::-1], codes[: i + p][::-1])
            last = p, start, end
            if end - start >= max(LEAST_WORDS, LEAST_PERIODS * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, no: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where all runs are: first place and place after the last of each stretch of words; and the names of all eight-word strings.  ``no``: the text of each word."""
    n = len(ids) - _GRAM + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, np.zeros(0, np.uint64)
    gram = mix(ids.astype(np.uint64) + _C)
    for k in (1, 2, 4):
        gram = mix(gram[:-k] * _C + gram[k:])
    key = gram + mix(no[:n].astype(np.uint64))
    whole = no[:n] == no[_GRAM - 1 :]
    order = np.argsort(key, kind="stable")
    apart = np.diff(order)
    apart[key[order[1:]] != key[order[:-1]]] = n
    near = np.full(n, n, np.int64)
    near[order[1:]] = apart
    near[order[:-1]] = np.minimum(near[order[:-1]], apart)
    open_ = whole & (near < n)
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
        first, stop = edges[::2], edges[1::2]
        width = stop - first + _GRAM - 1
        enough = width >= LEAST_WORDS
        inside = np.zeros(n, np.int64)
        for a, b, w in zip(first[enough].tolist(), stop[enough].tolist(), width[enough].tolist()):
            inside[a:b] = w
        kept = open_ & (near * LEAST_PERIODS <= inside)
        if (kept == open_).all():
            return first, stop + _GRAM - 1, gram
        open_ = kept


def text_runs(texts: list[str]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Number of words and runs of each text."""
    data = words.joined(texts)
    starts, ends, no = words.space_words(data)
    _, ids = words.distinct(data, starts, ends)
    count = np.bincount(no, minlength=len(texts))
    base = np.cumsum(count) - count
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    first, stop, gram = stretches(ids, no)
    for a, b in zip(first.tolist(), stop.tolist()):
        text = no[a]
        shift = int(a - base[text])
        found[text] += [(s + shift, length, p) for s, length, p in runs_of(ids[a:b], gram[a : b - _GRAM + 1])]
    return list(zip(count.tolist(), found))


def collapsed(text: str, runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, with one space between."""
    parts = text.encode("utf-8", "replace").split()  # of bytes: at spaces and the controls 9 to 13 only
    if runs:
        kept = np.ones(len(parts), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        parts = [parts[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(parts).decode()


def periodic_runs(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words long, runs array<struct<start, length, period>> and collapsed string, replacing columns so named.

    A run is a stretch of consecutive words (between spaces and the controls 9 to 13) with smallest period p, of at least
    24 words and three periods, that no neighbouring word extends keeping the period; start counts words from 0.  Runs come
    by start, then period.  ``collapsed``: the text's words, one space between, without those that any run holds after its
    first period.

    A null text counts as empty: no words, no runs, an empty ``collapsed``; so does one of white space.  Very long texts are
    searched whole.  Each row is worked on by itself, so repeated rows and null or repeated ids are rows like others; other
    columns are kept as they are; an empty table gives an empty one.
    """
    run = [("start", "long"), ("length", "long"), ("period", "long")]
    kind = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n, _ in run]))
    fields = T.StructType().add("n_words", "long").add("runs", kind).add("collapsed", "string")
    listed = pa.list_(pa.struct([(n, pa.int64()) for n, _ in run]))

    def work(batch):
        count, runs, text = [], [], []
        for lo, hi in text_slices(batch.column(1)):
            part = batch.column(1).slice(lo, hi - lo).to_pylist()
            for t, (n, found) in zip(part, text_runs(part)):
                count.append(n)
                runs.append([{"start": s, "length": size, "period": p} for s, size, p in found])
                text.append(collapsed(t, found))
        return [pa.array(count, pa.int64()), pa.array(runs, listed), pa.array(text, pa.string())]

    return extended(docs, {"_text": F.coalesce(F.col(text_col).cast("string"), F.lit(""))}, fields, work)
