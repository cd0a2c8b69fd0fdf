"""A compressed full-text index of word sequences: Burrows-Wheeler transform in a wavelet matrix.

The index holds short texts over integer symbols, end to end with a separator (symbol 0) after each.
Suffixes are sorted to ``depth`` symbols, which is all that patterns of up to ``depth`` symbols need. The
transform is stored as one packed bit plane per bit of a symbol with running counts (a wavelet tree laid out level by
level); rank queries walk the planes. All searches run on arrays of queries at once.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank over a sequence of integers below ``sigma``: one bit plane per bit, a running count per 64 bits."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n = len(symbols)
        self.planes = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((symbols >> shift) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view(np.uint64)
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.planes.append((shift, packed, counts.astype(np.uint32), int(self.n - bit.sum())))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the border before ``place`` lies among equal symbols on the last plane."""
        for shift, packed, counts, zeros in self.planes:
            word = place >> 6
            mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[word].astype(np.int64) + np.bitwise_count(packed[word] & mask)
            place = np.where((symbol >> shift) & 1, zeros + ones, place - ones)
        return place


def _ranks(*parts: np.ndarray) -> np.ndarray:
    """Dense ranks of the tuples that these columns form."""
    key = parts[0].astype(np.int64)
    for p in parts[1:]:
        base = int(p.max(initial=0)) + 1
        if int(key.max(initial=0)) >= (1 << 62) // base:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + p
    return np.unique(key, return_inverse=True)[1]


def _ahead(values: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate((values[by:], np.zeros(min(by, len(values)), values.dtype)))


class FMIndex:
    """Index of texts over symbols 1..sigma-1, each followed by a separator 0, for patterns of ``depth`` symbols.

    ``depth - 1`` must be a product of 2s and 3s, as suffixes are ranked by doubling and trebling.
    """

    def __init__(self, tokens: np.ndarray, depth: int):
        sigma = int(tokens.max(initial=0)) + 1
        rank, known = tokens.astype(np.int64), 1
        while known < depth - 1:
            step = 3 if (depth - 1) // known % 3 == 0 else 2
            rank = _ranks(*(_ahead(rank, known * j) for j in range(step)))
            known *= step
        if known != depth - 1:
            raise ValueError("depth - 1 must be a product of 2s and 3s")
        last = _ahead(tokens, known).astype(np.int64)
        #: Text position of each suffix in sorted order.
        self.places = np.argsort(rank * sigma + last, kind="stable")
        shorter = rank[self.places]
        # the class of suffixes that share depth - 1 symbols: what is left of a match when its last symbol is dropped
        self.cls = np.cumsum(np.concatenate(([True], shorter[1:] != shorter[:-1]))) - 1 if len(tokens) else shorter
        self.border = np.append(np.flatnonzero(np.concatenate(([True], shorter[1:] != shorter[:-1]))), len(tokens))
        self.less = np.concatenate(([0], np.cumsum(np.bincount(tokens, minlength=sigma))))
        self.bwt = WaveletMatrix(tokens[self.places - 1] if len(tokens) else tokens, sigma)
        symbols = np.arange(sigma)
        self._origin = self.less[:-1] - self.bwt.down(symbols, np.zeros(sigma, np.int64))
        self.n = len(tokens)

    def prepend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes that begin with ``symbol`` and go on as those of [lo, hi)."""
        both = self.bwt.down(np.concatenate((symbol, symbol)), np.concatenate((lo, hi))) + np.tile(self._origin[symbol], 2)
        return both[: len(lo)], both[len(lo):]

    def shorten(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that share the first ``depth - 1`` symbols of those from ``lo`` on."""
        cls = self.cls[lo]
        return self.border[cls], self.border[cls + 1]

    def first_places(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least text position in each interval; intervals are of one length of match, so equal or disjoint."""
        at, back = np.unique(lo, return_inverse=True)
        ends = np.zeros(len(at), np.int64)
        ends[back] = hi
        cuts = np.stack((at, ends), axis=1).ravel()
        padded = np.append(self.places, self.n)
        return np.minimum.reduceat(padded, cuts)[::2][back] if len(at) else at


def stream(index: FMIndex, tokens: np.ndarray, start: np.ndarray, windows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Matching statistics of streamed texts, each of ``windows + depth - 1`` symbols from ``start``, cut off at ``depth``.

    Every text is read from its end. A match is taken to ``depth`` symbols by backward search; from then on each
    symbol drops the last one of the match and prepends itself. The texts are among those of the index, so a match never
    breaks off. Returns, text after text and window after window, the interval of suffixes that match the whole window.
    """
    first = np.cumsum(windows) - windows
    los, his = np.zeros(int(windows.sum()), np.int64), np.zeros(int(windows.sum()), np.int64)
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), index.n)
    for step in range(int(windows.max(initial=0)) + depth - 1 if len(windows) else 0):
        on = np.flatnonzero(step < windows + depth - 1)
        at = start[on] + windows[on] + depth - 2 - step
        l, h = index.shorten(lo[on]) if step >= depth else (lo[on], hi[on])
        lo[on], hi[on] = index.prepend(tokens[at], l, h)
        if step >= depth - 1:
            nth = first[on] + windows[on] - 1 - (step - depth + 1)
            los[nth], his[nth] = lo[on], hi[on]
    return los, his
