"""Alignments of word sequences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def banded_distance(a: Sequence[int], b: Sequence[int], band: int) -> int:
    """The edit distance of a and b if it is `band` or less, else band + 1.

    Only cells within `band` of the diagonal are computed: their vertical differences along a row are the bits of two
    integers, and one row takes a dozen operations on them (Myers 1999, in the banded form of Hyyro 2003).
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > band:
        return band + 1
    if not m:
        return n
    t = min(band, n)
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    mask, top = (1 << (2 * t + 1)) - 1, 1 << (2 * t)
    vp, vn, now = mask & ~((1 << t) - 1), 0, t
    for j in range(1, m + 1):
        x, by = places.get(b[j - 1], 0), j - t - 1
        x = (x >> by if by >= 0 else x << -by) & mask
        d = ((((x & vp) + vp) ^ vp) | x | vn) & mask
        hp, hn = (vn | ~(d | vp)) & mask, d & vp
        if j + t <= n:
            now += not d & top
        else:
            bit = 1 << (n - j + t)
            now += bool(hp & bit) - bool(hn & bit)
        d >>= 1
        vp, vn = (hn | ~(d | hp)) & mask, d & hp
    return min(now, band + 1)


def edit_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """1 - edit distance / length of the longer, if that is `least` or more, else 0. Two empty sequences are the same.

    Common ends are cut off, then the band widens until the distance lies within it or `least` is out of reach.
    """
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    most = int((1 - least) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return 0.0
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    a, b = a[head:], b[head:]
    if k := min(len(a), len(b)):
        differ = np.flatnonzero(a[::-1][:k] != b[::-1][:k])
        tail = int(differ[0]) if len(differ) else k
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    x, y, band = a.tolist(), b.tolist(), 8
    while True:
        band = min(band, most)
        d = banded_distance(x, y, band)
        if d <= band:
            return 1 - d / longest
        if band == most:
            return 0.0
        band *= 4
