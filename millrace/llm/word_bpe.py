"""Byte-level BPE of many distinct words at once: in each round every word makes its next merge.

A round finds the pair of lowest rank in each word that still has one, the leftmost if it occurs more than once, and
merges it: the tiktoken library's own order, so that results are those of MergeReplay.replay(). Ranks of pairs are looked
up in one hashed table. Words of more than LONG bytes, which would ask for as many rounds, go through replay().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .byte_bpe import MergeReplay

LONG = 64
NONE = np.iinfo(np.int32).max

_workers: dict[str, "WordMerges"] = {}


class WordMerges:
    """The encoder of one rank file, for words with a space before each."""

    def __init__(self, own: MergeReplay):
        self.own, ranks = own, own.ranks
        pairs = {ranks[t[:i]] << 16 | ranks[t[i:]]: rank for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        if ranks and max(ranks.values()) >= 1 << 16:
            raise ValueError("ids of more than 16 bits")
        keys, found = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # each key goes to the first free slot from its own on
            free = left[self.keys[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[at[placed]], self.ranks[at[placed]] = keys[placed], found[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = np.where(self.keys[at[left]] >= 0, (at[left] + 1) & ((1 << self.bits) - 1), at[left])
        single = own.single
        self.first = self._rank((single[:, None] << 16 | single[None, :]).ravel()).astype(np.int32)

    @classmethod
    def of(cls, path: str) -> "WordMerges":
        """The worker's own, made once."""
        if path not in _workers:
            _workers[path] = cls(MergeReplay.of(path, ""))
        return _workers[path]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * 2654435769) & 0xFFFFFFFF) >> (32 - self.bits)

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair (two ids in one number), NONE where it has none."""
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.ranks[at], NONE)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[left]]
            same = held == keys[left]
            out[left[same]] = self.ranks[at[left[same]]]
            left = left[~same & (held >= 0)]
        return out

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (binary), one after another, and how many each has."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        sizes = np.diff(offsets) + 1
        data = np.full(int(sizes.sum()), 32, np.uint8)
        letter = np.ones(len(data), bool)
        letter[np.cumsum(sizes) - sizes] = False
        data[letter] = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        whole, done = np.zeros(len(words), np.int64), []
        long = sizes > LONG
        if long.any():
            which = np.flatnonzero(long)
            ids = self.own.replay([b" " + w for w in words.take(pa.array(which)).to_pylist()])
            whole[which] = [len(x) for x in ids]
            done.append((which, np.concatenate([np.array(x, np.int32) for x in ids])))
            data, which = data[~np.repeat(long, sizes)], np.flatnonzero(~long)
            sizes = sizes[which]
        else:
            which = np.arange(len(words))
        ids = self.own.single[data].astype(np.int32)
        ranks = np.full(len(ids), NONE, np.int32)  # of the pair that a place begins
        ranks[:-1] = self.first[data[:-1].astype(np.int64) << 8 | data[1:]]
        ranks[np.cumsum(sizes) - 1] = NONE
        while len(which):
            lowest = np.minimum.reduceat(ranks, np.cumsum(sizes) - sizes)
            more = lowest < NONE
            if not more.all():
                here = np.repeat(more, sizes)
                whole[which[~more]] = sizes[~more]
                done.append((which[~more], ids[~here]))
                which, sizes, lowest, ids, ranks = which[more], sizes[more], lowest[more], ids[here], ranks[here]
            if not len(which):
                break
            hits = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            ends = np.cumsum(sizes)
            at = hits[np.searchsorted(hits, ends - sizes)]  # the first of each word: there is one
            ids[at] = lowest
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, ranks, sizes = ids[stay], ranks[stay], sizes - 1
            at -= np.arange(len(at))
            ends = np.cumsum(sizes)
            right = at + 1 < ends
            ranks[at] = NONE
            ranks[at[right]] = self._rank(ids[at[right]].astype(np.int64) << 16 | ids[at[right] + 1])
            left = at[at > ends - sizes]
            ranks[left - 1] = self._rank(ids[left - 1].astype(np.int64) << 16 | ids[left])
        out, starts = np.empty(int(whole.sum()), np.int32), np.cumsum(whole) - whole
        for which, flat in done:
            n = whole[which]
            out[np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
        return out, whole
