"""Suffix arrays by two-stage sorting, and the repeated windows that they show.

Only suffixes that are smaller than their successor (type B) are sorted directly. All others are
induced: going through the suffixes in order, bucket by bucket of their first byte, the suffix
one byte to the left of each belongs next in its own bucket if it is larger than its successor
(type A). In a bucket, type A comes before type B.

Orders are right to ``depth`` bytes, which is all that windows of that length need: suffixes that
agree that far stand side by side, in any order.
"""

from __future__ import annotations

import numpy as np

#: Divides texts in one suffix array; no UTF-8 text holds it.
BARRIER = b"\xff"


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``text`` in the order of their first ``depth`` bytes."""
    a = np.frombuffer(text, dtype=np.uint8)
    n = len(a)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    smaller = smaller_than_next(a)
    chosen = np.flatnonzero(smaller).tolist()
    direct = np.array(sorted(chosen, key=lambda i: text[i : i + depth]), dtype=np.int64)
    first_bytes = a[direct]

    waiting: dict[int, list[np.ndarray]] = {int(a[-1]): [np.array([n - 1])]}

    def put_left_of(places: np.ndarray, byte: int) -> np.ndarray:
        """Queue the type A neighbours in their buckets; those of this bucket are returned."""
        left = places[places > 0] - 1
        left = left[~smaller[left]]
        bytes_ = a[left]
        same = left[bytes_ == byte]
        others = bytes_ != byte
        left, bytes_ = left[others], bytes_[others]
        order = np.argsort(bytes_, kind="stable")
        left, bytes_ = left[order], bytes_[order]
        cuts = np.flatnonzero(np.diff(bytes_)) + 1
        for part in np.split(left, cuts) if len(left) else ():
            waiting.setdefault(int(a[part[0]]), []).append(part)
        return same

    result = []
    for byte in np.unique(a).tolist():
        queued = waiting.pop(byte, [])
        induced = np.concatenate(queued) if queued else np.zeros(0, dtype=np.int64)
        while len(induced):
            result.append(induced)
            induced = put_left_of(induced, byte)
        begin, end = np.searchsorted(first_bytes, [byte, byte + 1])
        if begin < end:
            result.append(direct[begin:end])
            put_left_of(direct[begin:end], byte)
    return np.concatenate(result)


def smaller_than_next(a: np.ndarray) -> np.ndarray:
    """Of every suffix whether it is smaller than the one that starts a byte later."""
    n = len(a)
    less = np.zeros(n, dtype=bool)
    less[:-1] = a[:-1] < a[1:]
    differs = np.full(n, n - 1)
    apart = np.flatnonzero(a[:-1] != a[1:])
    differs[apart] = apart
    # Within a run of one byte, what follows the run decides.
    return less[np.minimum.accumulate(differs[::-1])[::-1]]


def repeated_windows(texts: list[bytes], windows: list[int], length: int) -> list[np.ndarray]:
    """Of every text the starts, below its number of ``windows``, of windows of ``length`` bytes
    that start at another place of any of the texts too."""
    held = BARRIER.join(texts) + BARRIER
    a = np.frombuffer(held, dtype=np.uint8)
    bases = np.cumsum([0, *(len(x) + 1 for x in texts)])[:-1]
    starts = np.zeros(len(a), dtype=bool)
    for base, n in zip(bases, windows):
        starts[base : base + n] = True
    order = suffix_array(held, length)
    order = order[starts[order]]
    # Neighbours in the array whose common prefix is a whole window.
    repeated = np.zeros(len(a), dtype=bool)
    views = np.lib.stride_tricks.sliding_window_view(a, length) if len(a) >= length else None
    for begin in range(0, len(order) - 1, 1 << 14):
        part = views[order[begin : begin + (1 << 14) + 1]]
        same = np.flatnonzero((part[1:] == part[:-1]).all(axis=1)) + begin
        repeated[order[same]] = True
        repeated[order[same + 1]] = True
    return [np.flatnonzero(repeated[base : base + n]) for base, n in zip(bases, windows)]
