"""A run-compressed Burrows-Wheeler index of short strings, and matching statistics that stream through it.

The strings are sorted by the least document that has each, their suffixes by content, and equal suffixes by string. Of the
transform only runs are kept: a run's symbol, where its first row goes when the symbol is put in front, and the suffixes
at its first and last row. Runs also end where the first `span` symbols change, so that the rows that begin with one
string of span symbols are whole runs, and each run tells the least document of those rows.

A pattern streams from its end to its beginning. While the run at hand has the next symbol, one step extends the match;
else the match goes on from the nearest run with that symbol above or below, whose sampled end tells by comparison how much
of the match is left. So each place of a pattern gets the length of its longest match in the index and, from span symbols
on, the least document that has the next span symbols. All comparisons are of symbols, none of hashes.
"""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).max


def _ahead(a: np.ndarray, by: int) -> np.ndarray:
    """What stands `by` columns further right, 0 beyond."""
    out = np.zeros_like(a)
    if by < a.shape[1]:
        out[:, : a.shape[1] - by] = a[:, by:]
    return out


def _ordered(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys of so many bits, equal ones by place, and the keys in it; places are packed behind the keys if they fit."""
    room = np.uint64(len(keys).bit_length())
    if bits + int(room) > 64:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    packed = np.sort(keys << room | np.arange(len(keys), dtype=np.uint64))
    return (packed & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64), packed >> room


class RunIndex:
    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, documents: np.ndarray, span: int):
        """symbols: a row for each string, from 1, and 0 beyond its length; documents: of each string, in rising order."""
        n, width = symbols.shape
        self.n, self.stride, self.span = n, width + 1, span
        text = np.zeros((n, self.stride), np.uint8)
        text[:, :width] = symbols
        self.text = text.ravel()
        places = np.flatnonzero((np.arange(self.stride) <= lengths[:, None]).ravel())
        suffixes, same = self._sorted(text, places)
        row, at = suffixes // self.stride, suffixes % self.stride
        before = np.where(at > 0, self.text[np.maximum(suffixes - 1, 0)], 0).astype(np.int64)
        long = lengths[row] - at >= span
        new = np.append(True, (same[suffixes][1:] != same[suffixes][:-1]) | (long[1:] != long[:-1])) if len(suffixes) else np.zeros(0, bool)
        new[1:] &= long[1:] | long[:-1]
        groups = np.flatnonzero(new)
        of_group = np.where(long[groups], np.minimum.reduceat(documents[row], groups), NONE) if len(groups) else np.zeros(0, np.int64)
        cut = new.copy()
        cut[1:] |= before[1:] != before[:-1]
        self.starts = np.flatnonzero(cut)
        ends = np.append(self.starts[1:], len(suffixes))[: len(self.starts)]
        self.sizes = ends - self.starts
        self.symbol = before[self.starts]
        self.least = of_group[np.searchsorted(groups, self.starts, "right") - 1] if len(groups) else of_group
        self.first, self.last = suffixes[self.starts], suffixes[ends - 1]
        by_symbol = np.argsort(self.symbol, kind="stable")
        self.goes = np.empty(len(self.starts), np.int64)
        self.goes[by_symbol] = np.cumsum(self.sizes[by_symbol]) - self.sizes[by_symbol]
        self.order = self.symbol[by_symbol] * len(self.starts) + by_symbol
        self.bounds = np.searchsorted(self.order, np.arange(257) * len(self.starts))
        # the run where each run's first row goes; its other rows go to that run or to one soon after
        self.into = np.searchsorted(self.starts, self.goes, "right") - 1
        self.until = np.append(self.starts[1:], len(suffixes))

    def _sorted(self, text: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, equal ones by place (that is by string), and a number for each place that is equal where span symbols are."""
        used = np.flatnonzero(np.bincount(self.text, minlength=256)[1:]) + 1
        code = np.zeros(256, np.uint64)
        code[used] = np.arange(1, len(used) + 1)
        each, room = len(used).bit_length() or 1, len(places).bit_length()
        symbols = code[text]
        known, key = max(1, min((64 - room) // each, self.span, self.stride)), np.zeros_like(symbols)
        for k in range(known):
            key = key << np.uint64(each) | _ahead(symbols, k)
        bits, whole = known * each, len(places) == text.size
        half = of_half = None
        while True:
            order, keys = _ordered(key.ravel() if whole else key.ravel()[places], bits)
            rank = np.zeros(text.size, np.uint64)
            rank[order if whole else places[order]] = np.cumsum(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            rank = rank.reshape(text.shape)
            if known <= self.span:
                half, of_half = rank, known
            if known >= self.stride:
                break
            key = rank << np.uint64(room) | _ahead(rank, known)
            known, bits = 2 * known, 2 * room
        # the longest ranked length is above half of span, so that two ranks cover it
        same = half << np.uint64(32) | _ahead(half, self.span - of_half)
        return places[order], same.ravel()

    def _common(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many symbols from places a and b on are equal, up to limit."""
        out, left = limit.copy(), np.flatnonzero(limit > 0)
        for k in range(int(limit.max(initial=0))):
            left = left[limit[left] > k]
            unlike = self.text[a[left] + k] != self.text[b[left] + k]
            out[left[unlike]] = k
            left = left[~unlike]
            if not len(left):
                break
        return out

    def matches(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of each pattern: the length of the longest match that begins there, and the least document of its first span symbols."""
        m, width = symbols.shape
        found, least = np.zeros((m, width), np.int32), np.full((m, width), NONE)
        if not self.n or not m:
            return found, least
        row, size, run, place = *(np.zeros(m, np.int64) for _ in range(3)), np.full(m, self.first[0])
        runs = len(self.starts)
        for k in range(width - 1, -1, -1):
            own = np.flatnonzero(lengths > k)
            whole = len(own) == m
            take = lambda a: a if whole else a[own]  # noqa: E731, B023
            c, r = take(symbols[:, k]).astype(np.int64), take(run)
            fits = self.symbol[r] == c
            to, at, p, s = r.copy(), take(row) - self.starts[r], take(place) - 1, take(size) + 1
            if (jump := np.flatnonzero(~fits)).size:
                want, base, limit = c[jump], take(place)[jump], take(size)[jump]
                after = np.searchsorted(self.order, want * runs + r[jump])
                has_up, has_down = after > self.bounds[want], after < self.bounds[want + 1]
                up, down = self.order[np.maximum(after - 1, 0)] % runs, self.order[np.minimum(after, runs - 1)] % runs
                of_up = np.where(has_up, self._common(base, self.last[up], np.where(has_up, limit, 0)), -1)
                of_down = np.where(has_down, self._common(base, self.first[down], np.where(has_down, limit, 0)), -1)
                above, best = of_up >= of_down, np.maximum(of_up, of_down)
                to[jump] = np.where(above, up, down)
                at[jump] = np.where(above, self.sizes[to[jump]] - 1, 0)
                p[jump], s[jump] = np.where(above, self.last[to[jump]], self.first[to[jump]]) - 1, best + 1
            at, r = at + self.goes[to], self.into[to]
            if (lost := np.flatnonzero(s == 0)).size:  # a symbol that the index doesn't have
                at[lost], r[lost], p[lost] = 0, 0, self.first[0]
            far = np.flatnonzero(at >= self.until[r])
            while far.size:
                r[far] += 1
                far = far[at[far] >= self.until[r[far]]]
            if whole:
                row, run, place, size = at, r, p, s
            else:
                row[own], run[own], place[own], size[own] = at, r, p, s
            found[own, k] = s
            enough = np.flatnonzero(s >= self.span)
            least[own[enough], k] = self.least[r[enough]]
        return found, least
