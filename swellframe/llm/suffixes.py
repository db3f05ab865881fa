"""Suffix arrays by induced sorting, as whole-array steps in numpy."""

from __future__ import annotations

import numpy as np


def suffix_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one. The last symbol must be smallest."""
    ends = np.append(np.flatnonzero(text[:-1] != text[1:]), len(text) - 1)
    smaller = np.append(text[ends[:-1]] < text[ends[:-1] + 1], True)
    return np.repeat(smaller, np.diff(np.append(-1, ends)))


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by key, and each sorted element's place among those of its key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    sizes = np.diff(np.append(first, len(keys)))
    return order, np.arange(len(keys)) - np.repeat(first, sizes)


def induced(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes sorted, given the leftmost-smaller ones in order.

    Buckets of first symbols are passed in order; the suffixes before those of a bucket are
    put into theirs. What lands in the bucket itself is the bucket's next wave.
    """
    counts = np.bincount(text)
    tails = np.cumsum(counts)
    heads = tails - counts
    array = np.full(len(text), -1, np.int64)
    order, place = _grouped(text[leftmost])
    seeds, symbols = leftmost[order], text[leftmost[order]]
    sizes = np.bincount(symbols, minlength=len(counts))
    array[(tails - sizes)[symbols] + place] = seeds

    def put(found: np.ndarray, pointers: np.ndarray, step: int, bucket: int) -> np.ndarray:
        """Puts suffixes into their buckets; gives back those of the bucket that is passed."""
        if not len(found):
            return found
        keys = text[found]
        order, place = _grouped(keys)
        found, keys = found[order], keys[order]
        array[pointers[keys] + (place if step > 0 else -1 - place)] = found
        pointers += step * np.bincount(keys, minlength=len(pointers))
        return found[keys == bucket]

    def before(wave: np.ndarray, kind: bool) -> np.ndarray:
        wave = wave[wave > 0] - 1
        return wave[smaller[wave] == kind]

    used = np.flatnonzero(counts)
    free = heads.copy()
    for bucket in used:
        start = heads[bucket]
        wave = array[start : free[bucket]]
        while len(wave):
            wave = put(before(wave, False), free, 1, bucket)
        put(before(array[tails[bucket] - sizes[bucket] : tails[bucket]], False), free, 1, bucket)
    free_tails = tails.copy()
    last = array[0]
    for bucket in used[::-1]:
        larger = array[heads[bucket] : free[bucket]][::-1].copy()
        wave = array[free_tails[bucket] : tails[bucket]][::-1]
        while len(wave):
            wave = put(before(wave, True), free_tails, -1, bucket)
        put(before(larger, True), free_tails, -1, bucket)
    array[0] = last
    return array


def _ranks(names: np.ndarray, ahead: int, depth: int) -> np.ndarray:
    """Ranks of the sequences of ``depth`` names from each place on, by recursion on pairs."""
    if ahead >= depth or len(names) and names.max() + 1 == len(names):
        return names
    following = np.zeros(len(names), np.int64)
    following[: len(names) - ahead] = names[ahead:] + 1
    pairs = names * (len(names) + 2) + following
    return _ranks(np.unique(pairs, return_inverse=True)[1], 2 * ahead, depth)


def _same_pieces(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the pieces of a length at places a and b are equal."""
    same = np.ones(len(a), bool)
    active = np.arange(len(a))
    for i in range(int(length.max(initial=0))):
        active = active[length[active] > i]
        equal = text[a[active] + i] == text[b[active] + i]
        same[active[~equal]] = False
        active = active[equal]
        if not len(active):
            break
    return same


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Places of the suffixes in sorted order; the last symbol must be the only smallest.

    With ``depth`` suffixes that agree in so many symbols may come in any order.
    """
    smaller = suffix_types(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(leftmost):
        return np.argsort(text, kind="stable") if len(text) < 2 else induced(text, smaller, np.array([len(text) - 1]))
    is_leftmost = np.zeros(len(text), bool)
    is_leftmost[leftmost] = True
    # Sorted by the substrings from one leftmost-smaller place to the next.
    array = induced(text, smaller, leftmost)
    ordered = array[is_leftmost[array]]
    length = np.ones(len(text), np.int64)
    length[leftmost[:-1]] = np.diff(leftmost) + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    same[same] = _same_pieces(text, a[same], b[same], length[a][same])
    names = np.zeros(len(text), np.int64)
    names[ordered] = np.append(0, np.cumsum(~same))
    # Each such substring holds two symbols at least.
    ranks = _ranks(names[leftmost], 1, len(leftmost) if depth is None else depth // 2 + 2)
    return induced(text, smaller, leftmost[np.argsort(ranks, kind="stable")])


def permuted_prefixes(text: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """Length of the prefix that each suffix, in text order, shares with the one sorted before
    it, at least up to ``most``.

    Where the symbols before both suffixes agree and stand in the same order, the length is
    one less than that of the place before; only the other places are compared.
    """
    n = len(text)
    earlier = np.full(n, -1, np.int64)
    earlier[array[1:]] = array[:-1]
    place = np.arange(1, n)
    follows = np.zeros(n, bool)
    follows[1:] = (earlier[1:] > 0) & (earlier[1:] - 1 == earlier[:-1]) & (text[place - 1] == text[np.maximum(earlier[1:] - 1, 0)])
    start = np.flatnonzero(~follows)
    length = np.zeros(len(start), np.int64)
    active = np.flatnonzero(earlier[start] >= 0)
    # Chains go on to lose one symbol per place, so they may need more than ``most`` at first.
    chain = np.diff(np.append(start, n))
    while len(active):
        a, b = start[active] + length[active], earlier[start[active]] + length[active]
        inside = np.maximum(a, b) < n
        equal = inside & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
        active = active[equal]
        length[active] += 1
        active = active[length[active] < most + chain[active]]
    out = np.repeat(length + start, chain) - np.arange(n)
    return np.maximum(out, 0)
