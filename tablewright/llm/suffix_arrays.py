"""Suffix arrays by induced sorting and permuted common prefixes, in whole-array steps."""

from __future__ import annotations

import numpy as np

#: A reduced text with more different names than this is sorted by doubling instead of another round of induction,
#: whose steps go bucket by bucket.
MOST_BUCKETS = 4096


def _is_smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one; an end smaller than all symbols follows the text."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    less = np.append(text[:-1] < text[1:], False)
    following = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    return less[following]


def _deal(symbols: np.ndarray, values: np.ndarray, array: np.ndarray, at: np.ndarray, step: int) -> None:
    """Append values to their symbols' buckets, in order: forwards from ``at`` (step 1) or backwards (step -1)."""
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    heads = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    sizes = np.diff(np.append(heads, len(symbols)))
    rank = np.arange(len(symbols)) - np.repeat(heads, sizes)
    array[at[symbols] + step * rank] = values[order]
    at[symbols[heads]] += step * sizes


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the seeds, leftmost smaller suffixes in order, imply.

    Larger suffixes follow from the suffix behind them, front to back and bucket by bucket; then smaller ones, back to
    front. Within a bucket, a wave takes what the wave before has added.
    """
    array = np.full(len(text), -1, dtype=np.int64)
    narrow = text.astype(np.uint16) if ends.size <= 1 << 16 else text
    tail = ends - 1
    if len(seeds):
        _deal(narrow[seeds[::-1]], seeds[::-1], array, tail, -1)
    seeded = tail + 1
    head = starts.copy()
    array[head[text[-1]]] = len(text) - 1
    head[text[-1]] += 1
    used = np.flatnonzero(ends > starts)
    for c in used:
        low = starts[c]
        while True:
            high = head[c]
            block = array[low:high] if low < high else array[seeded[c] : ends[c]]
            before = block - 1
            before = before[before >= 0]
            before = before[~smaller[before]]
            if len(before):
                _deal(narrow[before], before, array, head, 1)
            if low >= high:
                break
            low = high
    tail = ends - 1
    for c in used[::-1]:
        high = ends[c]
        while True:
            low = tail[c] + 1
            block = array[low:high][::-1] if low < high else array[starts[c] : head[c]][::-1]
            before = block - 1
            before = before[before >= 0]
            before = before[smaller[before]]
            if len(before):
                _deal(narrow[before], before, array, tail, -1)
            if low >= high:
                break
            high = low
    return array


def _by_doubling(text: np.ndarray) -> np.ndarray:
    """The suffix array of any integers, by ranks of ever longer prefixes."""
    n = len(text)
    rank, reach = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        later = np.zeros(n, dtype=np.int64)
        later[: max(0, n - reach)] = rank[reach:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        new = np.append(False, key[order[1:]] != key[order[:-1]])
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1:
            return order
        reach *= 2


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` (integers below ``size``) in order.

    Induced sorting: classify suffixes as smaller or larger than the next; sort the substrings between leftmost smaller
    ones by one induction and name them; sort the text of names, recursively unless all differ; induce all suffixes
    from that order.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    smaller = _is_smaller_than_next(text)
    seeds = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    ends = np.cumsum(np.bincount(text, minlength=size))
    starts = np.append(0, ends[:-1])
    first = _induce(text, smaller, seeds, starts, ends)
    if len(seeds) > 1:
        is_seed = np.zeros(n, dtype=bool)
        is_seed[seeds] = True
        found = first[is_seed[first]]
        length = np.zeros(n, dtype=np.int64)
        length[seeds[:-1]] = np.diff(seeds) + 1
        length[seeds[-1]] = n  # the last one reaches the end: like no other
        a, b = found[:-1], found[1:]
        open_ = np.flatnonzero(length[a] == length[b])
        same = np.zeros(len(a), dtype=bool)
        k = 0
        while len(open_):
            done = length[a[open_]] == k
            same[open_[done]] = True
            open_ = open_[~done]
            open_ = open_[text[a[open_] + k] == text[b[open_] + k]]
            k += 1
        name = np.zeros(n, dtype=np.int64)
        name[found] = np.append(0, np.cumsum(~same))
        names = int(name[found[-1]]) + 1
        if names < len(seeds):
            reduced = name[seeds]
            found = seeds[suffix_array(reduced, names) if names <= MOST_BUCKETS else _by_doubling(reduced)]
        seeds = found
    return _induce(text, smaller, seeds, starts, ends)


def common_prefixes(text: np.ndarray, array: np.ndarray, most: int, lane: int = 256) -> np.ndarray:
    """For each position, how many symbols its suffix shares with the one before it in the suffix array, up to ``most``.

    Permuted order: the prefix of the next position is at least one symbol shorter, so a scan in text order compares
    every symbol once. The text is cut into lanes of positions that scan side by side.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[array[1:]] = array[:-1]
    padded = np.concatenate([text.astype(np.int32), np.full(most + 1, -1, dtype=np.int32)])
    out = np.zeros(n, dtype=np.int32)
    lanes = np.arange(0, n, lane)
    shared = np.zeros(len(lanes), dtype=np.int64)
    for step in range(min(lane, n)):
        at = lanes + step
        if at[-1] >= n:
            at, shared = at[:-1], shared[:-1]
            lanes = lanes[:-1]
        other = before[at]
        shared = np.maximum(shared - 1, 0)
        shared[other < 0] = 0
        open_ = np.flatnonzero((other >= 0) & (shared < most))
        while len(open_):
            x, y, s = at[open_], other[open_], shared[open_]
            # the later of both must not run off the text: the padding equals no symbol, and differs in place
            equal = (padded[x + s] == padded[y + s]) & (np.maximum(x, y) + s < n)
            open_ = open_[equal]
            shared[open_] += 1
            open_ = open_[shared[open_] < most]
        out[at] = shared
    return out
