"""Sets of word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

from millwright.llm import words

_C = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from its bytes alone."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    raw = data.tobytes()
    padded = np.frombuffer(raw + bytes(32), np.uint8)
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 24,), (1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) + _C[3])
    for k in range(3):
        out = mix(out ^ (eight[starts + 8 * k] & words._MASK[np.clip(size - 8 * k, 0, 8)]) * _C[k])
    for i in np.flatnonzero(size > 24).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return out


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, end to end, and where each text's begin.

    A-Z count as a-z; words lie between spaces and the controls 9 to 13; a text of fewer than ``width`` words, but one
    at least, has its whole sequence as its only shingle.
    """
    data = words.joined(texts)
    data = data + 32 * ((data >= 65) & (data <= 90)).astype(np.uint8)
    starts, ends, no = words.space_words(data)
    hashes = word_hashes(data, starts, ends)
    count = np.bincount(no, minlength=len(texts))
    first = np.cumsum(count) - count
    whole = max(0, len(hashes) - width + 1)
    out = np.full(whole, width, np.uint64)
    for k in range(width):
        out = mix(out * _C[0] + hashes[k : k + whole])
    inside = no[:whole] == no[width - 1 :] if whole else np.zeros(0, bool)
    owner, out = no[:whole][inside], out[inside]
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        extra = count[few].astype(np.uint64)
        for k in range(width - 1):
            more = k < count[few]
            extra[more] = mix(extra[more] * _C[0] + hashes[first[few[more]] + k])
        owner, out = np.concatenate([owner, few]), np.concatenate([out, extra])
    order = np.lexsort((out, owner))
    owner, out = owner[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    owner, out = owner[new], out[new]
    return out, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int64)
