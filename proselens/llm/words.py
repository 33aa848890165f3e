"""Vectorised 64-bit word and word n-gram hashes of UTF-8 text.

A word's hash is a polynomial in its bytes modulo 2**64, read off one running sum over the text, then mixed. Work goes in
segments of about ``SEGMENT`` bytes cut at separators, so memory stays bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEGMENT = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = [np.uint64(pow(0xD1342543DE82EF95, i, 1 << 64)) for i in range(32)]

_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space only separates words: [^\x20\x09-\x0D]+
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but digits and letters separates words: after lower-casing, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
for _b in range(65, 91):
    NOT_ALNUM[_b] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        m = max(n, 2 * SEGMENT)
        have = np.full(m, np.uint64(base), np.uint64)
        have[0] = 1
        _powers[key] = have = np.multiply.accumulate(have)
    return have


def _segment_words(part: np.ndarray, starts: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``part``, and where each begins. ``starts``: offsets at which a new text begins."""
    gap = blank[part]
    begin = np.empty(len(part) + 1, bool)
    begin[0] = True
    begin[1:-1] = gap[:-1]
    begin[-1] = True
    begin[starts] = True
    first = np.flatnonzero(begin[:-1] & ~gap)
    if not len(first):
        return np.empty(0, np.uint64), first
    gap_or_start = np.append(gap, True)
    gap_or_start[starts[starts < len(part)]] = True
    stop = np.flatnonzero(gap_or_start)
    # the word ends at the first separator or text start after its first byte
    last = stop[np.searchsorted(stop, first, side="right")]
    total = np.empty(len(part) + 1, np.uint64)
    total[0] = 0
    np.cumsum((LOWER[part].astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(part))[: len(part)], out=total[1:])
    return mix((total[last] - total[first]) * _power(_INVERSE, len(part))[first]), first


def word_hashes(texts: list[bytes | memoryview], blank: np.ndarray) -> Iterator[np.ndarray]:
    """For each text, the hashes of its words in order (ASCII letters lower-cased)."""
    group: list[np.ndarray] = []
    size = 0
    for text in texts:
        raw = np.frombuffer(text, np.uint8)
        if len(raw) > SEGMENT:
            yield from _flush(group, blank)
            group, size = [], 0
            yield _long(raw, blank)
            continue
        group.append(raw)
        size += len(raw)
        if size > SEGMENT:
            yield from _flush(group, blank)
            group, size = [], 0
    yield from _flush(group, blank)


def _flush(group: list[np.ndarray], blank: np.ndarray) -> Iterator[np.ndarray]:
    if not group:
        return
    ends = np.cumsum([len(x) for x in group])
    starts = np.concatenate(([0], ends[:-1]))
    part = np.concatenate(group) if len(group) > 1 else group[0]
    hashes, first = _segment_words(part, starts, blank)
    cut = np.searchsorted(first, np.concatenate((starts, ends[-1:])))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield hashes[a:b]


def _long(raw: np.ndarray, blank: np.ndarray) -> np.ndarray:
    found, at = [], 0
    while at < len(raw):
        to = min(len(raw), at + SEGMENT)
        while to < len(raw):
            gaps = np.flatnonzero(blank[raw[to : to + SEGMENT]])
            if len(gaps):
                to += int(gaps[0])
                break
            to = min(len(raw), to + SEGMENT)
        found.append(_segment_words(raw[at:to], np.zeros(1, np.int64), blank)[0])
        at = to
    return np.concatenate(found)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; none if there are fewer words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:m] * _GRAM[1]
    for i in range(1, n):
        total = total + hashes[i : m + i] * _GRAM[i + 1]
    return mix(total + np.uint64(n))


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes; fewer words than ``n`` make one shingle of the whole sequence, no words none."""
    if 0 < len(hashes) < n:
        return grams(hashes, len(hashes))
    return np.unique(grams(hashes, n))
