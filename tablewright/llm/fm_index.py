"""An index of delimited words by suffix ranks, and search with one error beyond a half that matches exactly."""

from __future__ import annotations

import numpy as np

from tablewright.llm.suffix_arrays import suffix_array

#: Queries that are searched together.
TOGETHER = 1 << 14


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and the offset of each word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    return codes, np.append(0, np.cumsum([len(w) for w in words], dtype=np.int64))


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class WordIndex:
    """Different words, each between two delimiters, with the symbol before every suffix in suffix order.

    An interval of suffix ranks stands for all places where a string occurs; extending the string to the left takes two
    binary searches among the ranks of one symbol. ``leftward=False`` holds the words mirrored, so that the same steps
    extend to the right: both directions together let either half of a word match first.
    """

    def __init__(self, words: list[str], leftward: bool = True):
        codes, at = code_points([w if leftward else w[::-1] for w in words])
        self.alphabet, symbols = np.unique(codes, return_inverse=True)
        self.width = len(self.alphabet) + 1
        text = np.zeros(len(codes) + len(words) + 1, dtype=np.int64)
        text[np.delete(np.arange(len(text)), at + np.arange(len(at)))] = symbols + 1
        self.delimiters = at + np.arange(len(at))
        self.order = suffix_array(text, self.width)
        self.before = text[self.order - 1]
        by_symbol = np.argsort(self.before, kind="stable")
        self.size = len(text)
        self.ranks = self.before[by_symbol] * self.size + by_symbol

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of code points; those that no word has get one that never occurs."""
        at = np.searchsorted(self.alphabet, codes)
        known = at < len(self.alphabet)
        known[known] = self.alphabet[at[known]] == codes[known]
        return np.where(known, at + 1, self.width)

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the strings with one more symbol in front."""
        return np.searchsorted(self.ranks, symbol * self.size + low), np.searchsorted(self.ranks, symbol * self.size + high)

    def choices(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval number, symbol) of the symbols in front of each interval, delimiters left out: read from a narrow
        interval, all symbols for a wide one."""
        sizes = high - low
        wide = sizes > self.width
        narrow = np.flatnonzero(~wide)
        owner = np.repeat(narrow, sizes[narrow])
        found = self.before[_ranges(low[narrow], sizes[narrow])]
        every = np.arange(1, self.width)
        key = np.append(owner * self.width + found, (np.flatnonzero(wide)[:, None] * self.width + every).ravel())
        key = np.unique(key[key % self.width > 0])
        return key // self.width, key % self.width

    def word_at(self, low: np.ndarray) -> np.ndarray:
        """The word whose delimiter in front stands at a suffix rank."""
        return np.searchsorted(self.delimiters, self.order[low])

    def one_error(self, codes: np.ndarray, at: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of all words that differ from a query by one code point inserted, deleted or replaced in front of
        its last ``exact`` ones. Queries are given as code points and offsets, mirrored like the words."""
        found = [self._one_error(codes, at[i : i + TOGETHER + 1], exact[i : i + TOGETHER], i) for i in range(0, len(exact), TOGETHER)]
        query, word = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return query, word

    def _one_error(self, codes: np.ndarray, at: np.ndarray, exact: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        symbols = self.symbols(codes[at[0] : at[-1]])
        start, length = at[:-1] - at[0], np.diff(at)
        high = np.full(len(length), len(self.delimiters), dtype=np.int64)
        low, left, query = np.zeros_like(high), length.copy(), np.arange(len(length))

        def keep(state: tuple[np.ndarray, ...], which: np.ndarray) -> tuple[np.ndarray, ...]:
            return tuple(x[which] for x in state)

        def matched(state: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
            """States with something left to match, one symbol further."""
            q, n, lo, hi = state
            lo, hi = self.extend(lo, hi, symbols[start[q] + n - 1])
            return keep((q, n - 1, lo, hi), hi > lo)

        clean = (query, left, low, high)
        ready: list[tuple[np.ndarray, ...]] = []
        for step in range(int(exact.max(initial=0)) + 1):
            done = exact[clean[0]] == step
            ready.append(keep(clean, done))
            clean = matched(keep(clean, ~done))
        clean = tuple(np.concatenate(x) for x in zip(*ready))
        wrong = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
        pairs: list[np.ndarray] = []
        while len(clean[0]) or len(wrong[0]):
            q, n, lo, hi = clean
            owner, symbol = self.choices(lo, hi)
            next_lo, next_hi = self.extend(lo[owner], hi[owner], symbol)
            some = next_hi > next_lo
            owner, symbol, next_lo, next_hi = owner[some], symbol[some], next_lo[some], next_hi[some]
            inserted = (q[owner], n[owner], next_lo, next_hi)
            other = n[owner] > 0
            other[other] = symbols[start[q[owner[other]]] + n[owner[other]] - 1] != symbol[other]
            replaced = (q[owner[other]], n[owner[other]] - 1, next_lo[other], next_hi[other])
            more = n > 0
            deleted = (q[more], n[more] - 1, lo[more], hi[more])
            wrong = matched(keep(wrong, wrong[1] > 0))
            clean = matched(keep(clean, more))
            wrong = tuple(np.concatenate(x) for x in zip(wrong, inserted, replaced, deleted))
            ended = wrong[1] == 0
            q, _, lo, hi = keep(wrong, ended)
            lo, hi = self.extend(lo, hi, np.zeros_like(lo))
            pairs.append(np.stack([q, lo])[:, hi > lo])
            wrong = keep(wrong, ~ended)
        both = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
        word = self.word_at(both[1])
        real = word < len(self.delimiters) - 1  # the text is a circle, on which nothing stands between its end and start
        key = np.unique(both[0, real] * (len(self.delimiters) + 1) + word[real])
        return key // (len(self.delimiters) + 1) + first, key % (len(self.delimiters) + 1)
