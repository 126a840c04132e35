"""Word shingles of whole texts as 64-bit hashes, in numpy over many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Words of a shingle.
SHINGLE = 5
_TOP = 0x323B0
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_M = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M[0]
    x = (x ^ (x >> np.uint64(27))) * _M[1]
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: a 64-bit value of the lower-cased character, and whether it belongs to a word."""
    lower, word = np.arange(_TOP, dtype=np.uint64), np.zeros(_TOP, bool)
    for c in range(_TOP):
        ch = chr(c)
        if ch.isalnum():
            word[c] = True
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return mix(lower + np.uint64(1)), word


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        up, down = np.full(n, _P, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of letters and digits, case folded) and the number of words before each text, plus all."""
    values, is_word = _characters()
    codes = np.frombuffer("\n".join(texts).join("\n\n").encode("utf-32-le", "replace"), "<u4")
    codes = np.where(codes < _TOP, codes, 0xFFFD)
    word = is_word[codes]
    edge = np.diff(word.view(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    up, down = _powers(1 << max(16, int(len(codes)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(word, values[codes], np.uint64(0)) * up[:len(codes)], dtype=np.uint64)])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = 1 + np.concatenate([[0], np.cumsum(lengths + 1)])
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    hashes, at = word_hashes(texts)
    n = len(hashes)
    out = []
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, np.uint64)
        for j in range(min(size, n)):
            rolled[:n - j] += hashes[j:] * _M[j % len(_M)] * np.uint64(2 * (j // len(_M)) + 1)
        rolled = mix(rolled)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(rolled[a:b - size + 1]))
            elif b > a:
                out.append(mix(np.array([sum(int(h) * int(_M[j]) for j, h in enumerate(hashes[a:b].tolist())) + (b - a) & (1 << 64) - 1], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
