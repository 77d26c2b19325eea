"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A word's hash is a polynomial over its bytes modulo 2**64, read off one running sum for all texts of a slice,
then mixed. It doesn't depend on where the word stands, so equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C55 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Letters, digits and all bytes beyond ASCII: words without their punctuation.
BARE = np.zeros(256, bool)
BARE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 21)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits after which every bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of symbols (small unsigned integers)."""
    total = np.empty(len(symbols) + 1, np.uint64)
    total[0] = 0
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(symbols)), out=total[1:])
    spans = (total[ends] - total[starts]) * powers(_INVERSE, len(symbols) + 1)[starts]
    return mix(spans ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _cuts(data: np.ndarray, is_word: np.ndarray, limit: int) -> list[int]:
    """Where a slice can be cut without cutting a word: whole when it is short."""
    cuts, at = [0], 0
    while len(data) - at > 2 * limit:
        gap = np.flatnonzero(~is_word[data[at + limit : at + 2 * limit]])
        if not len(gap):
            far = np.flatnonzero(~is_word[data[at + limit :]])
            if not len(far):
                break
            gap = far
        at += limit + int(gap[0])
        cuts.append(at)
    return [*cuts, len(data)]


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The words of the texts, window by window: the window's start, its bytes, the words' starts and ends in it."""
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    cuts = _cuts(data, is_word, limit)
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = data[a:b]
        inside = is_word[part]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        yield a, part, np.flatnonzero(inside & (~before | first[a:b])), np.flatnonzero(inside & (~after | first[a + 1 : b + 1])) + 1


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words (runs of word bytes, by default of all but ASCII white space; A-Z in lower case) of the texts, and where each text's words start (one more than texts)."""
    found, heads = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, part, starts, ends in spans(data, offsets, is_word, limit):
        found.append(span_hashes(_LOWER[part], starts, ends))
        heads.append(starts + a)
    return np.concatenate(found), np.searchsorted(np.concatenate(heads), offsets)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes of one text's k-word shingles in order; of fewer words, the whole sequence as one."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    total = hashes[: n - width + 1].copy()
    for i in range(1, width):
        total = total * np.uint64(0xD1342543DE82EF95) + hashes[i : n - width + 1 + i]
    return mix(total + np.uint64(width))
