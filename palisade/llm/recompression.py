"""Recompression: rounds that name runs and pairs of tokens, alike wherever the same tokens stand.

A name is a 64-bit hash of what it stands for, so all tasks give equal substrings equal names without exchanging a
dictionary. Beside its place every symbol carries the interval of words that its being a symbol there depends on:
wherever those words occur, in whatever surroundings, the same symbol arises at the same offset.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import mix

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ODD = np.uint64(0xD1342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@dataclass
class Level:
    """Symbols in text order: name, first word, and the first and last word that each depends on (both non-decreasing)."""

    name: np.ndarray
    start: np.ndarray
    left: np.ndarray
    right: np.ndarray
    wall: np.ndarray

    def merged(self, pair: np.ndarray, left: np.ndarray, right: np.ndarray, name: np.ndarray) -> Level:
        """pair: symbols that take in their successor; left, right, name: the values for every symbol that stays."""
        stays = np.ones(len(pair), bool)
        stays[1:] = ~pair[:-1]
        return Level(name[stays], self.start[stays], left[stays], right[stays], self.wall[stays])


def words(h: np.ndarray, wall: np.ndarray) -> Level:
    at = np.arange(len(h))
    return Level(h, at, at, at, wall)


def runs(level: Level) -> Level:
    """Names neighbours in runs of one symbol two by two, counted from the run's start."""
    n = len(level.name)
    if n < 2:
        return level
    new = np.ones(n + 1, bool)
    new[1:n] = (level.name[1:] != level.name[:-1]) | level.wall[1:] | level.wall[:-1]
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(new[:n], at, 0))
    pair = ((at - first) % 2 == 0) & ~new[1:]
    # where a run starts depends on the symbol before it; that its last symbol stays alone depends on the next
    left = np.where(level.wall, level.left, level.left[np.maximum(first - 1, 0)])
    after = np.minimum(at + 1, n - 1)
    right = np.where(level.wall, level.right, level.right[after])
    name = np.where(pair, mix(level.name * _A + _B), level.name)
    return level.merged(pair, left, right, name)


def pairs(level: Level, round_: int) -> Level:
    """Names neighbours of which the first has colour 0 and the second colour 1; colours are bits of names, anew in each round."""
    n = len(level.name)
    if n < 2:
        return level
    one = (mix(level.name + mix(np.array([round_], np.uint64))) >> np.uint64(63)).astype(bool)
    ok = ~level.wall
    pair = np.zeros(n, bool)
    pair[:-1] = ~one[:-1] & one[1:] & ok[:-1] & ok[1:]
    at = np.arange(n)
    before, after = np.maximum(at - 1, 0), np.minimum(at + 1, n - 1)
    # a pair depends on its two symbols; one alone on the neighbour that it might have joined
    left = np.where(~pair & one & ok, level.left[before], level.left)
    right = np.where(level.wall, level.right, np.where(pair | ~one, level.right[after], level.right))
    name = level.name.copy()
    name[:-1][pair[:-1]] = mix(level.name[:-1][pair[:-1]] * _A + mix(level.name[1:][pair[:-1]]))
    return level.merged(pair, left, right, name)


def parse(h: np.ndarray, wall: np.ndarray, rounds: int) -> list[Level]:
    """All levels above the words, lowest first."""
    out, level = [], runs(words(h, wall))
    for r in range(rounds):
        level = pairs(level, r + 1)
        out.append(level)
    return out


def prefix_sums(h: np.ndarray, odd: np.uint64 = _ODD) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial prefix sums modulo 2^64 of the words' hashes, and the inverse powers that make ranges comparable."""
    n = len(h)
    key = int(odd)
    if key not in _POWERS or len(_POWERS[key][0]) < n:
        m = max(n, 1 << 16)
        up, down = np.full(m, odd), np.full(m, np.uint64(pow(key, -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS[key] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = _POWERS[key]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)]), down


def range_hash(sums: tuple[np.ndarray, np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the words first..last (inclusive); equal for equal words, wherever they stand."""
    s, down = sums
    return mix((s[last + 1] - s[first]) * down[first] + mix(last - first))


def anchors(h: np.ndarray, wall: np.ndarray, window: int, rounds: int = 7, lowest: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(places of whole windows, key of each one's anchor).

    A window's anchor is the first symbol, of the highest level that has any, whose dependence lies inside the window;
    its key is the hash of the words depended on. Windows without one are their own anchors. So equal windows have
    equal keys, whatever surrounds them.
    """
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # walls at both ends: what depends on where a text starts or stops depends on more than its words
    h, wall = np.concatenate([[np.uint64(0)], h, [np.uint64(0)]]), np.concatenate([[True], wall, [True]])
    n = len(h)
    walls = np.concatenate([[0], np.cumsum(wall)])
    at = np.flatnonzero(walls[window:] == walls[: n - window + 1])
    sums = prefix_sums(h)
    key, open_ = np.zeros(len(at), np.uint64), np.arange(len(at))
    for level in reversed(parse(h, wall, rounds)[lowest - 1 :]):
        if not len(open_):
            break
        k = np.searchsorted(level.left, at[open_])
        k[k == len(level.left)] = 0
        good = (level.left[k] >= at[open_]) & (level.right[k] < at[open_] + window)
        k, done = k[good], open_[good]
        if len(k):
            used, back = np.unique(k, return_inverse=True)
            key[done] = range_hash(sums, level.left[used], level.right[used])[back]
        open_ = open_[~good]
    if len(open_):
        key[open_] = range_hash(sums, at[open_], at[open_] + window - 1)
    return at - 1, key
