"""Simple-8b: unsigned integers packed into 64-bit words, encoded and decoded with numpy.

The top four bits of a word, the selector, say how many values share its other 60 bits and how
wide each is. A value of over 60 bits is an escape: its word holds its place in a list of whole
64-bit values. Which values share a word follows from the widest of the next k values, for all
places and all k at once; only the chain of words is followed one by one.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: how many values a word of each selector holds, and of how many bits. Selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 240], np.int64)
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0], np.uint64)
ESCAPE = 0
#: Widths from narrow to wide; the class of a value is the first that holds it, one beyond the last if none does.
ASCENDING = np.sort(WIDTHS[1:])
LIMITS = (np.uint64(1) << ASCENDING) - np.uint64(1)
SHIFT = np.uint64(60)
PAYLOAD = (np.uint64(1) << SHIFT) - np.uint64(1)
#: Words between two entries of the offset table of a block.
STRIDE = 64


SMALL = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64)).astype(np.uint8)


def _classes(ids: np.ndarray) -> np.ndarray:
    if ids.max(initial=0) < len(SMALL):
        return SMALL[ids]
    return np.searchsorted(LIMITS, ids).astype(np.uint8)


def _selectors(classes: np.ndarray) -> np.ndarray:
    """For each place the selector of a word that starts there: the one that holds most values."""
    longest = int(COUNTS.max())
    n = len(classes)
    padded = np.concatenate([classes, np.zeros(longest, np.uint8)])
    ranked = np.array([ESCAPE, *sorted(range(1, 16), key=lambda s: COUNTS[s])], np.uint8)
    best = np.zeros(n, np.uint8)
    spans = {1: padded}  # widest class among the next 2 ** i values
    while 2 * max(spans) <= longest:
        w = max(spans)
        spans[2 * w] = np.maximum(spans[w][:-w], spans[w][w:])
    for rank, selector in enumerate(ranked[1:], 1):
        k = int(COUNTS[selector])
        w = 1 << k.bit_length() - 1
        widest = np.maximum(spans[w][:n], spans[w][k - w : k - w + n])
        fits = widest <= np.uint8(np.searchsorted(ASCENDING, WIDTHS[selector]))
        np.maximum(best, fits.view(np.uint8) * np.uint8(rank), out=best)
    return ranked[best]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escaped values) of unsigned 64-bit integers."""
    ids = np.asarray(ids, np.uint64)
    selectors = _selectors(_classes(ids))
    jumps, n = COUNTS[selectors].tolist(), len(ids)
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += jumps[at]
    starts = np.array(starts, np.int64)
    chosen = selectors[starts]
    words = chosen.astype(np.uint64) << SHIFT
    padded = np.concatenate([ids, np.zeros(int(COUNTS.max()), np.uint64)])
    for selector in np.unique(chosen):
        rows = np.flatnonzero(chosen == selector)
        if selector == ESCAPE:
            words[rows] |= np.arange(len(rows), dtype=np.uint64)
            continue
        k, width = int(COUNTS[selector]), WIDTHS[selector]
        if width:
            place = np.arange(k)
            words[rows] |= np.bitwise_or.reduce(padded[starts[rows][:, None] + place] << (place.astype(np.uint64) * width), axis=1)
    return words, ids[starts[chosen == ESCAPE]]


def offsets(words: np.ndarray) -> np.ndarray:
    """Values before each STRIDE-th word."""
    counts = COUNTS[(words >> SHIFT).astype(np.int64)]
    return (np.cumsum(counts) - counts)[::STRIDE].astype(np.uint64)


def unpack(words: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """All values of the words; the last word may give zeros beyond the values that were packed."""
    selectors = (words >> SHIFT).astype(np.int64)
    counts = COUNTS[selectors]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for selector in np.unique(selectors):
        rows = np.flatnonzero(selectors == selector)
        first, payload = ends[rows] - counts[rows], words[rows] & PAYLOAD
        if selector == ESCAPE:
            out[first] = escaped[payload.astype(np.int64)]
            continue
        k, width = int(COUNTS[selector]), WIDTHS[selector]
        if width:
            place = np.arange(k)
            out[first[:, None] + place] = payload[:, None] >> (place.astype(np.uint64) * width) & ((np.uint64(1) << width) - np.uint64(1))
    return out


def unpack_range(words: np.ndarray, escaped: np.ndarray, starts: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Values lo to hi (exclusive), decoding only the words between two entries of the offset table."""
    if hi <= lo:
        return np.empty(0, np.uint64)
    first = int(np.searchsorted(starts, lo, "right")) - 1
    last = int(np.searchsorted(starts, hi, "left"))
    part = unpack(words[first * STRIDE : last * STRIDE], escaped)
    skip = int(starts[first])
    return part[lo - skip : hi - skip]
