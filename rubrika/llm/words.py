"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than space and 0x09-0x0D. These are ASCII, so working on bytes
splits UTF-8 text correctly. Hashes have 64 bits: two different words or shingles of one pair of
documents share one with a chance below 1e-13. Bytes are worked on in ranges of ``RANGE``, so memory
beside the results does not grow with the length of a text or word.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_random = np.random.default_rng(20240117)
_EXACT = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _EXACT[LOWER]
_BASE = 0x9E3779B97F4A7C15
_SHINGLE = _random.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
RANGE = 1 << 17


def _steps(base: int) -> np.ndarray:
    steps = np.full(RANGE, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _steps(_BASE), _steps(pow(_BASE, -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def find(
    data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words of each document. ``gap`` marks the bytes
    that are in no word."""
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    n = len(data)
    for low in range(0, n, RANGE):
        high = min(low + RANGE, n)
        # Whether bytes low-1 to high are in a word; the text is taken to lie between gaps.
        word = np.zeros(high - low + 2, bool)
        word[1:-1] = ~gap[data[low:high]]
        word[0] = low > 0 and not gap[data[low - 1]]
        word[-1] = high < n and not gap[data[high]]
        first, last = np.searchsorted(offsets, (low, high + 1))
        edges = offsets[first:last] - low
        begin, end = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
        inner = edges[edges < high - low]
        begin[inner] = word[1 + inner]
        inner = edges[edges > 0]
        end[inner - 1] = word[inner]
        starts.append(np.flatnonzero(begin) + low)
        ends.append(np.flatnonzero(end) + (low + 1))
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A hash for each word: polynomials from running sums over the bytes. ``fold`` takes A-Z as a-z.
    Words are in order and do not overlap."""
    values = _BYTE if fold else _EXACT
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = int(np.searchsorted(ends, low + RANGE, side="right"))
        if j <= i:  # one word that is longer than a range
            total, power, step = 0, 1, pow(_BASE, RANGE, 2**64)
            for at in range(low, int(ends[i]), RANGE):
                part = data[at : min(at + RANGE, int(ends[i]))]
                total += int(np.sum(values[part] * _UP[: len(part)], dtype=np.uint64)) * power
                power = power * step % 2**64
            out[i] = total % 2**64
            i += 1
            continue
        high = int(ends[j - 1])
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * _UP[: high - low], dtype=np.uint64, out=total[1:])
        begin = starts[i:j] - low
        out[i:j] = (total[ends[i:j] - low] - total[begin]) * _DOWN[np.minimum(begin, RANGE - 1)]
        i = j
    return mix(out) if len(out) else out


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words of one document; fewer words make one run."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total += words[k : n - width + 1 + k] * _SHINGLE[k]
    return mix(total)


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def cores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word from its first to its last letter; an empty range where it has none."""
    at = np.flatnonzero(LETTER[data])
    if not len(at):
        return starts, starts
    first, last = np.searchsorted(at, starts), np.searchsorted(at, ends) - 1
    some = last >= first
    begin = np.where(some, at[np.minimum(first, len(at) - 1)], starts)
    end = np.where(some, at[np.maximum(last, 0)] + 1, starts)
    return begin, end


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, 0 for empty ones."""
    out = np.zeros(len(starts), np.uint64)
    some = ends > starts
    out[some] = hashes(data, starts[some], ends[some])
    return out
