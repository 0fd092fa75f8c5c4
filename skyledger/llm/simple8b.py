"""Simple-8b: 64-bit words of a 4-bit selector and 60 bits of payload that hold 1 to 60 equally wide integers.

Selector s packs ``COUNTS[s]`` integers of ``WIDTHS[s]`` bits.  Selector 0 is the escape: its payload is an index into a table of
raw 64-bit integers, for values of more than 60 bits.  The last word may hold fewer integers than its selector says; the
reader is told how many there are.
"""

from __future__ import annotations

import numpy as np

# fixed values: integers and bits of the selectors, from 1; selector 0 is the escape
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)

_LIMITS = np.uint64(1) << WIDTHS[1:].astype(np.uint64)  # the first value that selector s + 1 can't hold
_PAYLOAD = np.uint64((1 << 60) - 1)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escaped values) of an array of unsigned integers; every word takes as many as fit."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    ids = ids.astype(np.uint64, copy=False)
    # the narrowest selector that holds each id; beyond the last: an escape
    least = (np.searchsorted(_LIMITS, ids, side="right") + 1).astype(np.uint8)
    escapes = np.flatnonzero(least == len(WIDTHS))
    top = np.concatenate([least, np.zeros(60, np.uint8)])  # what follows the end fits anywhere
    choice = np.full(n, len(WIDTHS) - 1, np.uint8)
    choice[escapes] = 0
    # sliding maxima over 2, 3, ... ids; wider windows overwrite the choice of narrower ones
    lowest, window = int(least.min()), top.copy()
    by_count = {int(c): s for s, c in enumerate(COUNTS) if s}
    for count in range(2, int(COUNTS[lowest] if lowest < len(WIDTHS) else 1) + 1):
        window = np.maximum(window[:-1], top[count - 1 :])
        if count in by_count:
            fits = window[:n] <= by_count[count]
            if n > 60 and not fits[: n - 60].any():
                break  # no larger group fits either, but for the end of the block
            choice[fits] = by_count[count]
    step = COUNTS[choice].tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += step[i]
    starts = np.array(at, np.int64)
    chosen = choice[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s in np.unique(chosen):
        here = np.flatnonzero(chosen == s)
        if s == 0:
            words[here] |= np.searchsorted(escapes, starts[here]).astype(np.uint64)
            continue
        for k in range(int(COUNTS[s])):
            words[here] |= padded[starts[here] + k] << np.uint64(k * int(WIDTHS[s]))
    return words, ids[escapes]


def decode(words: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` integers of ``words``."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - counts
    for s in np.unique(selector):
        here = np.flatnonzero(selector == s)
        if s == 0:
            out[starts[here]] = escaped[(words[here] & _PAYLOAD).astype(np.int64)]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(int(COUNTS[s])):
            out[starts[here] + k] = (words[here] >> np.uint64(k * int(WIDTHS[s]))) & mask
    return out[:n]
