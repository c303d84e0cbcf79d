"""Array work inside tasks of the suffix-array deduplication: anchors, hashes and suffix order."""

from __future__ import annotations

import numpy as np

#: Bytes of the substring whose hash picks a window's anchor.
GRAM = 100
#: Bytes that one pass over an array takes; texts beyond it are read in overlapping pieces.
CHUNK = 1 << 21
_PLACE = (1 << 24) - 1
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240501).integers(0, 2**64, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, size: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < size:
        least = CHUNK // 4 if size <= CHUNK // 4 + 4096 else CHUNK
        steps = np.full(max(size, least + 4096), base, np.uint64)
        steps[0] = 1
        known = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return known[:size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any substrings of an array of bytes: a polynomial modulo 2^64 over random byte values."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * _power("up", _BASE, n), out=self.sums[1:])
        self.back = _power("down", pow(_BASE, -1, 2**64), n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def each(self, size: int) -> np.ndarray:
        """Of every substring of this size."""
        count = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:count]) * self.back[:count])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def pieces(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """``(text, begin, end)`` in groups of about CHUNK bytes; pieces of a text overlap by ``window`` - 1 bytes."""
    groups, own, size = [], [], 0
    for text, length in enumerate(lengths):
        for begin in range(0, max(length - window + 1, 0), CHUNK):
            end = min(begin + CHUNK + window - 1, length)
            if own and size + end - begin > CHUNK:
                groups.append(own)
                own, size = [], 0
            own.append((text, begin, end))
            size += end - begin
    return [*groups, own] if own else groups


def anchors(data: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor: ``first, last, anchor, hash of the gram, hash of all their bytes``.

    The anchor of a window is the leftmost of its grams with the least hash, so equal
    windows have theirs at the same offset. ``bounds`` are the ends of the pieces in ``data``.
    """
    hashes = Hashes(data)
    grams = hashes.each(GRAM)
    keys = (grams & np.uint64(~_PLACE & (2**64 - 1))) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_minimum(keys, window - GRAM + 1)
    valid = np.ones(len(least), bool)
    for end in bounds[:-1]:
        valid[max(end - window + 1, 0) : end] = False
    starts = np.flatnonzero(valid)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    anchor = (least[starts] & np.uint64(_PLACE)).astype(np.int64)
    new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    heads = np.concatenate([[0], new])
    tails = np.concatenate([new, [len(starts)]]) - 1
    first, last, at = starts[heads], starts[tails], anchor[heads]
    return first, last, at, grams[at].view(np.int64), hashes.of(first, last + window).view(np.int64)


def _ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def suffix_ranks(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at ``starts`` in suffix order to ``depth`` bytes, equal ones alike, by prefix doubling."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    head = np.zeros(n, np.uint64)
    for i in range(8):
        head = (head << np.uint64(8)) | padded[i : n + i]
    rank, known = _ranked(head), 8
    while known * 2 <= depth:
        later = np.zeros(n, np.int64)
        later[: n - known] = rank[known:] + 1
        rank, known = _ranked(rank * (n + 2) + later), known * 2
    if known == depth:
        return rank[starts]
    return _ranked(rank[starts] * (n + 2) + rank[starts + depth - known])


def factors(ranks: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a suffix's longest earlier factor, and its longest later one, reach the depth of the ranks.

    In suffix order to that depth, ties by place, suffixes that share ``depth`` bytes
    are neighbours with rising places. The previous smaller place of a suffix is then
    the one before it; if both are of one rank, the earlier match is long enough. With
    next larger places it is the same for later matches.
    """
    order = np.lexsort((places, ranks))
    together = ranks[order][1:] == ranks[order][:-1]
    earlier, later = np.zeros(len(ranks), bool), np.zeros(len(ranks), bool)
    earlier[order[1:]] = together
    later[order[:-1]] = together
    return earlier, later
