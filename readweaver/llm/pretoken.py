"""Vectorised pre-tokenisation: cuts texts into the matches of a tokenizer's pattern with numpy and numbers the distinct ones."""
from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from .textkit import range_hashes

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
_WHITE = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
_CLASS = np.full(0x110000, UNKNOWN, np.uint8)


def classes(cp: np.ndarray) -> np.ndarray:
    """Class of each code point: white space, letter (L*), number (N*) or other; the table is filled as code points are met."""
    got = _CLASS[cp]
    if (got == UNKNOWN).any():
        for c in np.unique(cp[got == UNKNOWN]).tolist():
            kind = unicodedata.category(chr(c))[0]
            _CLASS[c] = SPACE if c in _WHITE else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
        got = _CLASS[cp]
    return got


def contraction_ends(cp: np.ndarray, at: np.ndarray, last: np.ndarray) -> np.ndarray:
    """End of the contraction 's 't 're 've 'm 'll 'd that starts at each apostrophe position, or -1; `last` is its text's end."""
    n = len(cp)
    one = np.where(at + 1 < last, cp[np.minimum(at + 1, n - 1)], 0)
    two = np.where(at + 2 < last, cp[np.minimum(at + 2, n - 1)], 0)
    end = np.full(len(at), -1, np.int64)
    for a, b in (("r", "e"), ("v", "e"), ("l", "l")):
        end = np.where((one == ord(a)) & (two == ord(b)), at + 3, end)
    for a in "stmd":
        end = np.where(one == ord(a), at + 2, end)
    return end


def cut_spaced(cp: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the matches of the space-keeping pattern: contractions, runs of letters, numbers or others with one blank before, runs of white space.

    ``edges`` are the texts' starts and the total length.  The matches cover everything.
    """
    n = len(cp)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z
    kind = classes(cp)
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new[edges[(edges > 0) & (edges < n)]] = True
    runs = np.flatnonzero(new)
    ends = np.append(runs[1:], n)
    inner = np.isin(ends, edges, invert=True)  # the run doesn't end its text
    white = (kind[runs] == SPACE) & inner
    tail = ends[white] - 1
    new[tail] = True
    new[ends[white][cp[tail] == 32]] = False
    at = np.flatnonzero(new & (cp == 39))
    if len(at):
        last = edges[np.searchsorted(edges, at, "right")]
        end = contraction_ends(cp, at, last)
        at, end, last = at[end > 0], end[end > 0], last[end > 0]
        new[at + 1] = False
        new[end[end < n]] = True
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)


def cut_bare(cp: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the matches of the pattern that drops white space: contractions, runs of letters, single numbers, runs of others."""
    n = len(cp)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z
    kind = classes(cp)
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    new[edges[(edges > 0) & (edges < n)]] = True
    at = np.flatnonzero(new & (cp == 39))
    if len(at):
        last = edges[np.searchsorted(edges, at, "right")]
        end = contraction_ends(cp, at, last)
        at, end = at[end > 0], end[end > 0]
        new[at + 1] = False
        new[end[end < n]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    solid = kind[starts] != SPACE
    return starts[solid], ends[solid]


class Lexicon:
    """Distinct tokens met by one worker process, each with its ids; emptied when it holds more than `most` tokens.

    A token is known by a 64-bit hash and checked by a second one; tokens that share the first and differ in the second are kept by their bytes.
    """

    def __init__(self, encode: Callable[[list[bytes]], list], most: int = 1_000_000) -> None:
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes
        self.checks = np.zeros(0, np.uint64)
        self.index = np.zeros(0, np.int32)
        self.odd: dict[bytes, int] = {}
        self.size = 0
        self.pending: list[bytes] = []
        self.ids = np.zeros(0, np.int32)
        self.offs = np.zeros(1, np.int64)

    def make_room(self) -> None:
        if self.size > self.most:
            self.clear()

    def _queue(self, tokens: list[bytes]) -> np.ndarray:
        self.pending += tokens
        self.size += len(tokens)
        return np.arange(self.size - len(tokens), self.size, dtype=np.int32)

    def number(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each token (byte ranges of data); unseen ones are queued for `learn`."""
        h, check = range_hashes(data, starts, ends), range_hashes(data, starts, ends, 1)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        numbers, checks = np.empty(len(keys), np.int32), check[first]
        numbers[known] = self.index[at[known]]
        checks[known] = self.checks[at[known]]
        fresh = np.flatnonzero(~known)
        raw = data.tobytes()
        if len(fresh):
            numbers[fresh] = self._queue([raw[s:e] for s, e in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist())])
            self.index = np.insert(self.index, at[fresh], numbers[fresh])
            self.checks = np.insert(self.checks, at[fresh], checks[fresh])
            self.keys = np.insert(self.keys, at[fresh], keys[fresh])
        out = numbers[back]
        for i in np.flatnonzero(check != checks[back]).tolist():
            token = raw[starts[i] : ends[i]]
            if token not in self.odd:
                self.odd[token] = int(self._queue([token])[0])
            out[i] = self.odd[token]
        return out

    def learn(self) -> None:
        if self.pending:
            ids, lengths = self.encode(self.pending)
            self.ids = np.concatenate([self.ids, ids])
            self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(lengths)])
            self.pending = []

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the tokens one after the other, number of ids before each token and in all)."""
        size = self.offs[numbers + 1] - self.offs[numbers]
        before = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.offs[numbers] - before[:-1], size)
        at += np.arange(before[-1])
        return self.ids[at], before
