"""A compressed FM-index over words, and matching statistics of documents that stream through it.

The Burrows-Wheeler transform is kept in a wavelet matrix: one bit vector a level, with a running
count for every 64 bits, so that a rank is a few lookups a level. Neither the text nor its suffix
array is kept. Suffixes are sorted by their first `depth` words, all that matches of that length
need; their common prefixes are kept as small numbers (a byte each up to a depth of 255) and, for every depth, one bit that marks
where a group of suffixes with that many equal words starts. Of the suffix array one sample a group
of `depth` equal words stays: the earliest place, which answers "where first" at once.

Matching statistics: a document is read from right to left; at each place the interval of the longest
match that starts there (up to `depth`) is found by a backward step. Where the step fails, the match
is cut to the next shorter one that has more occurrences, and the step is tried again. Documents go
through the levels together, one lane each.
"""

from __future__ import annotations

import numpy as np

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, with at least one bit to spare."""
    padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view(np.uint64)


class WaveletMatrix:
    """Ranks of symbols in a sequence of numbers below 2 ** levels."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        n = len(symbols)
        self.bits, self.before, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            words = _packed(bit)
            self.bits.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1].astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def bottom(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` of the sequence stands among the symbols' places on the lowest level."""
        at = at.astype(np.int64)
        for k in range(self.levels):
            word = at >> 6
            ones = self.before[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbols >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at


class Marks:
    """A bit vector that knows the marked place before and after any place. Places 0 and n are marked."""

    def __init__(self, marked: np.ndarray):
        self.bits = _packed(marked)
        some = np.flatnonzero(self.bits)
        words = np.arange(len(self.bits))
        self.earlier = some[np.searchsorted(some, words, "right") - 1].astype(np.int32)  # nearest word with a mark, itself included
        self.later = some[np.minimum(np.searchsorted(some, words), len(some) - 1)].astype(np.int32)

    def at_or_before(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        held = self.bits[word] & (FULL >> (63 - (at & 63)).astype(np.uint64))
        none = held == 0
        word = np.where(none, self.earlier[np.maximum(word - 1, 0)], word)
        held = np.where(none, self.bits[word], held)
        for shift in (1, 2, 4, 8, 16, 32):
            held |= held >> np.uint64(shift)
        return word * 64 + np.bitwise_count(held).astype(np.int64) - 1

    def at_or_after(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        held = self.bits[word] & (FULL << (at & 63).astype(np.uint64))
        none = held == 0
        word = np.where(none, self.later[np.minimum(word + 1, len(self.later) - 1)], word)
        held = np.where(none, self.bits[word], held)
        return word * 64 + np.bitwise_count((held & (~held + np.uint64(1))) - np.uint64(1)).astype(np.int64)


def _ranked(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the rows of parallel arrays of small numbers in lexicographic order, and the order."""
    key, most = parts[0].astype(np.int64), int(parts[0].max(initial=0))
    for p in parts[1:]:
        wide = int(p.max(initial=0)) + 1
        if (most + 1) * wide >= 1 << 62:
            key, _ = _ranked([key])
            most = int(key.max(initial=0))
        key, most = key * wide + p, (most + 1) * wide - 1
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])) if len(key) else 0
    return out, order


def _ahead(ranks: np.ndarray, shift: int) -> np.ndarray:
    """Ranks `shift` places on, from 1; 0 beyond the end."""
    out = np.zeros_like(ranks)
    if shift < len(ranks):
        out[: len(ranks) - shift] = ranks[shift:] + 1
    return out


def length_type(depth: int) -> type:
    """Of numbers that hold lengths up to depth."""
    return np.uint8 if depth < 1 << 8 else np.uint16 if depth < 1 << 16 else np.int32


class Suffixes:
    """The suffixes of a text in the order of their first `depth` words, and the common prefixes of neighbours."""

    def __init__(self, text: np.ndarray, depth: int):
        ranks = {1: text.astype(np.int64)}
        size = 1
        while size * 3 <= depth:
            own = ranks[size]
            ranks[size * 3] = _ranked([own, _ahead(own, size), _ahead(own, 2 * size)])[0]
            size *= 3
        own = ranks[size]
        parts = [own] + [_ahead(own, size)] * (depth > 2 * size) + [_ahead(own, depth - size)] * (depth > size)
        full, self.order = _ranked(parts)
        n = len(text)
        common = np.zeros(n, np.int64)
        a, b = self.order[:-1], self.order[1:]
        for size in sorted(ranks, reverse=True):
            own = np.append(ranks[size], -1 - np.arange(depth + 1))  # nothing beyond the end is equal
            for _ in range(2 + (size == max(ranks))):
                so_far = common[1:]
                can = np.flatnonzero(so_far + size <= depth)
                same = own[a[can] + so_far[can]] == own[b[can] + so_far[can]]
                common[1 + can[same & (a[can] != b[can])]] += size
        self.common = common.astype(length_type(depth))
        self.first = np.concatenate([[True], full[self.order][1:] != full[self.order][:-1]]) if n else np.empty(0, bool)

    def groups(self) -> np.ndarray:
        """The group of `depth` equal words that each suffix, in order, belongs to."""
        return np.cumsum(self.first) - 1


def least_of_groups(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of each group of neighbours (first: where one starts) the least value."""
    starts = np.flatnonzero(first)
    return np.minimum.reduceat(values, starts) if len(starts) else values


class FmIndex:
    """Over a sequence of word numbers, 0 between documents. samples: places in the text, one a group of equal words."""

    def __init__(self, text: np.ndarray, depth: int, rank: np.ndarray | None = None, suffixes: Suffixes | None = None):
        self.depth, self.size = depth, len(text)
        if len(text) >= 1 << 31:
            raise ValueError("a shard's block is indexed up to 2 ** 31 words")
        own = suffixes or Suffixes(text, depth)
        top = int(text.max(initial=0))
        self.top = top
        self.bwt = WaveletMatrix(text[own.order - 1].astype(np.int64), top)
        smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])[:-1]
        self.base = smaller - self.bwt.bottom(np.arange(top + 1), np.zeros(top + 1, np.int64))
        self.common = np.append(own.common, 0).astype(length_type(depth))
        self.common[0] = 0
        self.starts = [None]  # by depth
        for d in range(1, depth + 1):
            marked = np.append(own.common < d, True)
            marked[0] = True
            self.starts.append(Marks(marked))
        first = np.append(own.first, False)
        self.group_bits = _packed(first)
        self.group_before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.group_bits), dtype=np.int64)])[:-1].astype(np.int32)
        # Of each group the place of least rank.
        place = own.order if rank is None else rank[own.order]
        is_least = np.flatnonzero(place == least_of_groups(own.first, place)[own.groups()])
        of = own.groups()[is_least]
        self.samples = own.order[is_least[np.flatnonzero(np.diff(of, prepend=-1))]].astype(np.int32)

    def first_place(self, low: np.ndarray) -> np.ndarray:
        """The sampled place of the group that starts at `low`."""
        word = low >> 6
        upto = self.group_before[word] + np.bitwise_count(self.group_bits[word] & (FULL >> (63 - (low & 63)).astype(np.uint64)))
        return self.samples[upto - 1]

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the intervals of symbol + pattern from the intervals of the patterns."""
        both = self.bwt.bottom(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        base = self.base[symbols]
        return base + both[: len(low)], base + both[len(low) :]

    def _cut(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first `length` words of the patterns."""
        low, high = low.copy(), high.copy()
        for d in np.unique(length).tolist():
            own = np.flatnonzero(length == d)
            if d:
                low[own], high[own] = self.starts[d].at_or_before(low[own]), self.starts[d].at_or_after(high[own])
            else:
                low[own], high[own] = 0, self.size
        return low, high

    def matching_statistics(self, text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word of the documents text[begin:end]: the length of the longest match that starts there, up to
        `depth`, and where the interval of that match starts. Words that the index lacks are numbers above its own."""
        lengths, lows = np.zeros(len(text), length_type(self.depth)), np.zeros(len(text), np.int64)
        order = np.argsort(begins - ends, kind="stable")
        begins, ends = begins[order], ends[order]
        sizes = ends - begins
        low, high = np.zeros(len(begins), np.int64), np.full(len(begins), self.size, np.int64)
        length = np.zeros(len(begins), np.int64)
        for t in range(1, int(sizes.max(initial=0)) + 1):
            n = int(np.searchsorted(-sizes, -t, "right"))  # documents of at least t words come first
            low, high, length = low[:n], high[:n], length[:n]
            place = ends[:n] - t
            symbol = text[place]
            full = np.flatnonzero(length == self.depth)
            if len(full):
                marks = self.starts[self.depth - 1] if self.depth > 1 else None
                low[full], high[full] = (marks.at_or_before(low[full]), marks.at_or_after(high[full])) if marks else (0, self.size)
                length[full] -= 1
            known = (symbol > 0) & (symbol <= self.top)
            lost = np.flatnonzero(~known)
            low[lost], high[lost], length[lost] = 0, self.size, 0
            todo = np.flatnonzero(known)
            while len(todo):
                a, b = self.extend(symbol[todo], low[todo], high[todo])
                found = a < b
                hit, miss = todo[found], todo[~found]
                low[hit], high[hit] = a[found], b[found]
                length[hit] += 1
                todo = miss[length[miss] > 0]  # a known word alone is always found; its match is cut and tried again
                if len(todo):
                    shorter = np.maximum(self.common[low[todo]], self.common[high[todo]]).astype(np.int64)
                    shorter = np.minimum(shorter, length[todo] - 1)
                    low[todo], high[todo] = self._cut(low[todo], high[todo], shorter)
                    length[todo] = shorter
            lengths[place], lows[place] = length, low
        return lengths, lows

    def find(self, pattern: np.ndarray) -> tuple[int, int]:
        """Interval of one pattern of at most `depth` words; empty if it does not occur."""
        low, high = np.array([0]), np.array([self.size])
        for c in pattern[::-1]:
            if not 0 < c <= self.top or low[0] >= high[0]:
                return 0, 0
            low, high = self.extend(np.array([c]), low, high)
        return int(low[0]), int(high[0])
