"""Texts as arrays of characters and of word-shingle hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Ends a text inside a batch; no character has this number.
END = np.uint32(0xFFFFFFFF)
SPACE = np.uint32(32)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Lower case and white space of the first 65,536 characters, one for one."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for number in range(1 << 16):
        character = chr(number)
        if character.isspace():
            table[number] = SPACE
        elif len(low := character.lower()) == 1:
            table[number] = ord(low)
    return table


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' characters in lower case, white space runs as one space, each text ended by END; and their old places."""
    joined = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = joined < 1 << 16
    folded = _fold()[np.where(low, joined, 0)] if low.all() else np.where(low, _fold()[np.where(low, joined, 0)], joined)
    folded = folded.copy()
    folded[np.cumsum([len(t) + 1 for t in texts]) - 1] = END
    blank = folded == SPACE
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    places = np.flatnonzero(keep)
    return folded[places], places


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) for x in (_BASE, _BASE_INVERSE))


def word_hashes(characters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of folded texts (each ended by END): a hash of every word and where it starts."""
    gap = (characters == SPACE) | (characters == END)
    before = np.r_[True, gap[:-1]]
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(gap & ~before)
    size = 1 << max(16, int(len(characters)).bit_length())
    powers, inverse = _powers(size)
    sums = np.r_[np.uint64(0), np.cumsum((characters.astype(np.uint64) + np.uint64(1)) * powers[: len(characters)])]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``words`` neighbouring words (lower case, cut at white space).

    A shorter text has one shingle of all its words, a text without words none.
    """
    characters, _ = fold(texts)
    hashes, starts = word_hashes(characters)
    stops = np.flatnonzero(characters == END)
    bounds = np.searchsorted(starts, np.r_[0, stops])
    n = max(len(hashes) - words + 1, 0)
    joined = np.zeros(n, np.uint64)
    for k in range(words):
        joined = joined * np.uint64(_BASE) + hashes[k : k + n]
    joined = mix(joined)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            sets.append(np.unique(joined[a : b - words + 1]))
        else:
            one = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for value in hashes[a:b]:
                    one = one * np.uint64(_BASE) + value
            sets.append(mix(np.array([one] if b > a else [], np.uint64)))
    return sets
