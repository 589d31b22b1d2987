"""Byte-pair merging of many pieces at once with array operations.

A tokenizer merges, in a piece, the leftmost pair of least rank, again and again.  Here all pieces of like length stand side by
side as the columns of a matrix, and each step merges one pair in every column that still has one.
"""

from __future__ import annotations

import numpy as np

_NONE = np.int32(np.iinfo(np.int32).max)
#: Pieces of more bytes are left to the tokenizers library; so many bits hold a place in a piece.
LONGEST, _PLACE = 60, 6
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Merges:
    """The ranks and results of all mergeable pairs of token ids, in a table with open addressing."""

    def __init__(self, byte_ids: np.ndarray, pairs: list[tuple[int, int, int]]):
        """byte_ids: the id of each byte value; pairs: (left id, right id, merged id) by rank."""
        self.byte_ids = byte_ids.astype(np.int32)
        self.result = np.array([p[2] for p in pairs], np.int32)
        keys = np.array([p[:2] for p in pairs], np.uint64).reshape(-1, 2)
        keys = keys[:, 0] << np.uint64(32) | keys[:, 1]
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(1 << bits, _NONE, np.int32)
        todo, at, self.probes = np.arange(len(keys)), (keys * _SPREAD >> self.shift).astype(np.int64), 0
        while len(todo):
            free = self.ranks[at] == _NONE
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.ranks[at[won]] = keys[todo[won]], todo[won]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, at = todo[left], (at[left] + 1) % len(self.keys)
            self.probes += 1

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a number above all ranks."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = (key * _SPREAD >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == key, self.ranks[at], _NONE)
        miss = np.flatnonzero((out == _NONE) & (self.ranks[at] != _NONE))
        for _ in range(1, self.probes):
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) % len(self.keys)
            out[miss] = np.where(self.keys[at[miss]] == key[miss], self.ranks[at[miss]], _NONE)
            miss = miss[(out[miss] == _NONE) & (self.ranks[at[miss]] != _NONE)]
        return out

    def _columns(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the columns of ``ids``, the first ``size`` rows of each; gives the ids of all pieces end to end and their counts."""
        height, m = ids.shape
        row = np.arange(height, dtype=np.int32)[:, None]
        alive = row < size
        nxt, prv = np.repeat(row + 1, m, axis=1), np.repeat(row - 1, m, axis=1)
        waiting = np.full((height, m), _NONE, np.int32)
        if height > 1:
            both = alive[1:]
            r = self.rank(ids[:-1][both], ids[1:][both])
            waiting[:-1][both] = np.where(r == _NONE, _NONE, r << _PLACE | np.broadcast_to(row[:-1], both.shape)[both])
        cols = np.arange(m)  # what the columns of waiting are
        while True:
            best = waiting.min(axis=0)
            here = np.flatnonzero(best != _NONE)
            if not len(here):
                break
            if len(here) < 0.7 * len(best):
                waiting, cols, best = waiting[:, here], cols[here], best[here]
                here = np.arange(len(best))
            else:
                best = best[here]
            col = cols[here]
            j, rank = best & ((1 << _PLACE) - 1), best >> _PLACE
            gone = nxt[j, col]
            after, before = nxt[gone, col], prv[j, col]
            ids[j, col] = self.result[rank]
            alive[gone, col] = False
            nxt[j, col] = after
            waiting[gone, here] = _NONE
            waiting[j, here] = _NONE
            some = np.flatnonzero(after < size[col])
            prv[after[some], col[some]] = j[some]
            back = np.flatnonzero(before >= 0)
            left, right = np.concatenate([j[some], before[back]]), np.concatenate([after[some], j[back]])
            which = np.concatenate([some, back])
            r = self.rank(ids[left, col[which]], ids[right, col[which]])
            waiting[left, here[which]] = np.where(r == _NONE, _NONE, r << _PLACE | left)
        return ids.T[alive.T], alive.sum(axis=0)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these pieces of ``data`` end to end, and where each piece's begin (one more at the end); none is over ``LONGEST`` bytes."""
        size = ends - starts
        counts = np.zeros(len(size), np.int64)
        order = np.argsort(size, kind="stable")
        found = []
        cuts = np.searchsorted(size[order], [0, 3, 5, 7, 9, 12, 16, 24, 36, LONGEST + 1])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if lo < hi:
                some = order[lo:hi]
                at = starts[some] + np.arange(int(size[order[hi - 1]]))[:, None]
                got, n = self._columns(self.byte_ids[data[np.minimum(at, len(data) - 1)]], size[some])
                counts[some] = n
                found.append(got)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(offsets[-1], np.int32)
        laid = np.concatenate(found) if found else out
        n = counts[order]
        out[np.repeat(offsets[:-1][order] - (np.cumsum(n) - n), n) + np.arange(len(laid))] = laid
        return out, offsets
