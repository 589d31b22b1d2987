"""Splitting many texts at once with array operations: word pieces of byte-level BPE, and white-space words.

Texts are laid end to end in one byte buffer with an 0xFF byte (never part of UTF-8) after each.  Pieces come back as
byte ranges, and equal pieces share an index, so that costly work is done once for each distinct piece.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Code points below this are classed by table; their classes are the same in all Unicode versions in use.
TABLE_END = 0x0500
_OUTSIDE = re.compile(r"[^\x00-ӿ]")
LETTER, NUMBER, OTHER, SPACE, END = range(5)


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = np.full(TABLE_END + 1, OTHER, np.uint8)
    for cp in range(TABLE_END):
        major = unicodedata.category(chr(cp))[0]
        if major in "LN":
            kinds[cp] = LETTER if major == "L" else NUMBER
    kinds[[*range(9, 14), 32, 0x85, 0xA0]] = SPACE
    kinds[TABLE_END] = END
    return kinds


def in_table(text: str) -> bool:
    return text.isascii() or not _OUTSIDE.search(text)


def joined(texts: list[str]) -> np.ndarray:
    """All texts as one byte buffer, 0xFF after each."""
    return np.frombuffer(b"\xff".join([t.encode("utf-8", "replace") for t in texts]) + b"\xff", np.uint8)


def bpe_pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and text numbers of the pieces that the byte-level pattern makes of in-table texts.

    The pattern: contractions; letters, numbers or other signs, each with one space before them; white space up to the
    one before a word; other white space.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    cp = lead.astype(np.int16)
    two = np.flatnonzero((lead >= 0xC2) & (lead != 0xFF))
    cp[two] = ((lead[two].astype(np.int16) & 31) << 6) | (data[at[two] + 1] & 63)
    cp[lead == 0xFF] = TABLE_END
    kind = _classes()[cp]
    n = len(kind)
    first = np.ones(n, bool)
    first[1:] = kind[1:] != kind[:-1]
    first |= kind == END
    cut = first.copy()
    word = np.flatnonzero(first & (kind < SPACE))
    word = word[word > 0]
    word = word[kind[word - 1] == SPACE]
    cut[word - 1] = True  # the last of a run of white space stands alone or goes with the word
    cut[word] = cp[word - 1] != 32
    quote = np.flatnonzero((cp == 39) & first)
    quote = quote[quote + 2 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ((quote == 0) | (cp[np.maximum(quote - 1, 0)] != 32))]
    if len(quote):
        a, b = cp[quote + 1], cp[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        pair = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        size = np.where(one, 1, np.where(pair, 2, 0))
        quote, size = quote[size > 0], size[size > 0]
        cut[quote + 1] = False
        after = quote + 1 + size
        cut[after[kind[after] == LETTER]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    stop = kind[starts] == END
    text_no = (np.cumsum(stop) - stop)[~stop]
    bounds = np.append(at, len(data))
    return bounds[starts[~stop]], bounds[ends[~stop]], text_no


def space_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and text numbers of the words between spaces and the controls 9 to 13; any UTF-8."""
    gap = (data == 32) | ((data >= 9) & (data <= 13)) | (data == 0xFF)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~gap
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return starts, ends, np.searchsorted(np.flatnonzero(data == 0xFF), starts)


_MASK = np.array([0, *((1 << (8 * k)) - 1 for k in range(1, 8)), (1 << 64) - 1], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (in ``starts``) of the distinct pieces and, for each piece, the index of its distinct one.  Pieces are compared whole, not by hash."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(32, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 24,), (1,))
    size = ends - starts
    keys = [eight[starts + 8 * k] & _MASK[np.clip(size - 8 * k, 0, 8)] for k in range(3)]
    mixed = size.astype(np.uint64)
    for k, m in zip(keys, _MIX):
        mixed = (mixed ^ k) * m
        mixed ^= mixed >> np.uint64(29)
    short = size <= 24
    rows = np.arange(len(starts)) if short.all() else np.flatnonzero(short)
    order = np.argsort(mixed[rows])
    new = np.ones(len(order), bool)
    new[1:] = mixed[rows[order[1:]]] != mixed[rows[order[:-1]]]
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(new) - 1
    head = rows[order[new]]
    same = head[index]
    out = np.zeros(len(starts), np.int64)
    if all((k[same] == k[rows]).all() for k in keys) and (size[same] == size[rows]).all():
        out[rows] = index
        heads, rest = [head], np.flatnonzero(~short)
    else:  # two pieces with one mixed key
        heads, rest = [], np.arange(len(starts))
    known: dict[bytes, int] = {}
    count, more = sum(map(len, heads)), []
    for i in rest.tolist():
        piece = data[starts[i] : ends[i]].tobytes()
        if (at := known.get(piece)) is None:
            at = known[piece] = count + len(more)
            more.append(i)
        out[i] = at
    return np.concatenate([*heads, np.array(more, np.int64)]), out


def gather(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists flat[offsets[i]:offsets[i+1]] for i of ``index`` laid end to end, and the length of each."""
    size = (offsets[1:] - offsets[:-1])[index]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return flat[np.repeat(offsets[:-1][index] - (end - size), size) + np.arange(total)], size
