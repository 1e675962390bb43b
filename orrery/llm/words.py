"""Words of many texts at once as numpy arrays: places, owners and 64-bit hashes."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
LETTERS = np.random.Generator(np.random.PCG64(20240131)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OTHER_LETTERS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of words: everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: ASCII letters and digits.
ALNUM = np.zeros(256, bool)
ALNUM[np.r_[48:58, 65:91, 97:123]] = True
#: A-Z to a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i below n, modulo 2^64; kept for later calls."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(max(n, 1 << 19), b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s] = BASE^s times the polynomial hash of data[s:e]."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * powers(len(data))[0], out=h[1:])
    return h


def second_prefix_hashes(data: np.ndarray) -> np.ndarray:
    """The same with other letters: two spans that agree in both hashes are equal but for a chance of 2^-120 or so."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(OTHER_LETTERS[data] * powers(len(data))[0], out=h[1:])
    return h


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((h[ends] - h[starts]) * powers(len(h))[1][starts])


@lru_cache(1 << 16)
def _in_word(code: int) -> bool:
    return unicodedata.category(chr(code))[0] in "LNM" if code < 0x110000 and not 0xD800 <= code < 0xE000 else False


def alnum(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to letters, digits or marks, by Unicode category."""
    out = ALNUM[data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return out
    b = np.concatenate([data, np.zeros(3, np.uint8)])
    size = np.where(data[lead] < 0xE0, 2, np.where(data[lead] < 0xF0, 3, 4))
    code = data[lead].astype(np.int64) & np.array([0, 0, 31, 15, 7])[size]
    for i in range(1, 4):
        code = np.where(size > i, code << 6 | b[lead + i] & 63, code)
    uniq, inverse = np.unique(code, return_inverse=True)
    good = np.array([_in_word(int(c)) for c in uniq], bool)[inverse]
    for i in range(4):
        at = lead[good & (size > i)] + i
        out[at[at < len(data)]] = True
    return out


def tokens(data: np.ndarray, offs: np.ndarray, inside: np.ndarray | None = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, first): words are maximal runs of inside bytes (None: of letters, digits and
    marks) that no text border cuts; the words of text i are first[i]:first[i + 1]. A-Z count as a-z."""
    n = len(data)
    if not n:
        return (*(np.zeros(0, np.int64),) * 2, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64))
    low = FOLD[data]
    m = alnum(data) if inside is None else inside[low]
    begin = m.copy()
    begin[1:] &= ~m[:-1]
    borders = offs[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    begin[borders] = m[borders]
    stop = m.copy()
    stop[:-1] &= ~m[1:]
    stop[borders - 1] = m[borders - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, span_hashes(prefix_hashes(low), starts, ends), np.searchsorted(starts, offs)
