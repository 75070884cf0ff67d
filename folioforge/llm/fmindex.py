"""An FM-index over the words of a shard: suffix order, Burrows-Wheeler transform in a wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

#: Bits of a rank in a sort key of three; a shard has fewer symbols than this allows.
_BITS = 21
MOST_SYMBOLS = (1 << _BITS) - 1
#: Every so many places of the text keep their position.
SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order. symbols: 0 ends a text, and the last one is 0; each end is a letter of its own.

    Ranks by three symbols are refined by ranks 3, 9, 27 and more places on;
    only suffixes that still share their rank are sorted again.
    """
    n = len(symbols)
    if n > MOST_SYMBOLS:
        raise ValueError(f"a shard holds at most {MOST_SYMBOLS} symbols")
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols + (int(ends.sum()) - 1)).astype(np.int64)
    if int(rank.max(initial=0)) > MOST_SYMBOLS:
        raise ValueError("symbols are to be numbered without gaps")
    at, slots, step = np.arange(n), np.arange(n), 1
    order = np.empty(n, dtype=np.int64)
    while len(at):
        key = (rank[at] << (2 * _BITS)) | (rank[np.minimum(at + step, n - 1)] << _BITS) | rank[np.minimum(at + 2 * step, n - 1)]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(starts) - 1
        rank[at] = slots[starts][group]
        shared = np.bincount(group)[group] > 1
        at, slots = at[shared], slots[shared]
        step *= 3
    return order


class Bits:
    """A row of bits with the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class FMIndex:
    """Counts and finds phrases among texts of words numbered from 1; 0 ends a text and stands last."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        symbols = np.asarray(symbols, dtype=np.int64)
        self.n = n = len(symbols)
        order = suffix_order(symbols)
        last = symbols[order - 1]  # before the first place stands the last symbol, an end
        counts = np.bincount(symbols, minlength=1)
        #: Rows of each symbol's suffixes are those from first[c] to first[c + 1].
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.levels: list[tuple[Bits, int]] = []
        kept = last
        for k in reversed(range(max(1, int(len(counts) - 1).bit_length()))):
            bit = ((kept >> k) & 1).astype(bool)
            self.levels.append((Bits(bit), n - int(bit.sum())))
            kept = np.concatenate([kept[~bit], kept[bit]])
        starts = np.flatnonzero(np.concatenate([[True], kept[1:] != kept[:-1]])) if n else np.zeros(0, dtype=np.int64)
        #: Added to a symbol's place on the lowest level, gives its row.
        self.shift = self.first[:-1].copy()
        self.shift[kept[starts]] -= starts
        # a text's first place is sampled too, so that no walk crosses an end
        told = (order % sample == 0) | (last == 0)
        self.sampled, self.position = Bits(told), order[told].astype(np.int32)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The row that follows each (symbol, row) in backward search."""
        top = len(self.levels) - 1
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.ones(at)
            at = np.where((symbol >> (top - k)) & 1, zeros + ones, at - ones)
        return at + self.shift[symbol]

    def _back(self, at: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one place earlier."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for bits, zeros in self.levels:
            bit, ones = bits.get(at), bits.ones(at)
            at = np.where(bit, zeros + ones, at - ones)
            symbol = (symbol << 1) | bit
        return at + self.shift[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and row after the last of each phrase's suffixes. phrases: word numbers, flush right; a word of number 0 is nowhere."""
        m, width = phrases.shape
        lo, hi = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        alive = np.flatnonzero(((phrases > 0) | (np.arange(width) < (width - lengths)[:, None])).all(axis=1) & (lengths > 0))
        last = phrases[alive, width - 1]
        a, b = self.first[last], self.first[last + 1]
        for k in range(width - 2, -1, -1):
            done = lengths[alive] < width - k
            lo[alive[done]], hi[alive[done]] = a[done], b[done]
            alive, a, b = alive[~done], a[~done], b[~done]
            if not len(alive):
                break
            symbol = phrases[alive, k]
            both = self._down(np.concatenate([symbol, symbol]), np.concatenate([a, b]))
            a, b = both[: len(alive)], both[len(alive) :]
            there = a < b
            alive, a, b = alive[there], a[there], b[there]
        lo[alive], hi[alive] = a, b
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each row: steps back to a sampled place, and as many forward."""
        out, left, at, steps = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows)), rows, 0
        while len(left):
            told = self.sampled.get(at).astype(bool)
            out[left[told]] = self.position[self.sampled.ones(at[told])] + steps
            left, at = left[~told], at[~told]
            if len(left):
                at, steps = self._back(at), steps + 1
        return out
