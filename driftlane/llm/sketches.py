"""Array work inside tasks of the near-duplicate search: shingles, order sketches, banded alignment."""

from __future__ import annotations

import hashlib

import numpy as np

from driftlane.llm.suffixes import Hashes

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_random = np.random.default_rng(731)
_STEPS = _random.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _random.integers(0, 2**64, 64, dtype=np.uint64)
_PLACE = (1 << 24) - 1
_MOST = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many each text has."""
    data = _FOLD[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    inside = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    ending = np.cumsum([len(t) + 1 for t in texts])
    return Hashes(data).of(starts, ends), np.diff(np.searchsorted(starts, ending), prepend=0)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of each text (of all, if it has fewer), and how many each has."""
    made = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    begins = np.cumsum(counts) - counts
    at = np.repeat(begins, made) + np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
    left = np.repeat(begins + counts, made) - at
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    for i in range(size):
        total += np.where(left > i, padded[at + i], np.uint64(0)) * _STEPS[i]
    return _mixed(total), made


def occurrence_labelled(shingles: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, how often the text had it before), so that repeats differ."""
    order = np.lexsort((shingles, owner))
    new = np.ones(len(order), bool)
    new[1:] = (shingles[order][1:] != shingles[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    heads = np.flatnonzero(new)
    number = np.empty(len(order), np.uint64)
    number[order] = (np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))).astype(np.uint64)
    return _mixed(shingles + number * np.uint64(0x9E3779B97F4A7C15))


def order_sketches(labelled: np.ndarray, made: np.ndarray, count: int) -> np.ndarray:
    """``count`` sketches of each text with shingles: its two least ones by a random order, as they stand in the text."""
    begins = np.cumsum(made) - made
    begins = begins[made > 0]
    place = np.arange(len(labelled), dtype=np.uint64)
    result = np.empty((len(begins), count), np.int64)
    for j in range(count):
        keys = (_mixed(labelled ^ _SEEDS[j]) & ~np.uint64(_PLACE)) | place
        first = np.minimum.reduceat(keys, begins) & np.uint64(_PLACE)
        keys[first.astype(np.int64)] = _MOST
        least = np.minimum.reduceat(keys, begins)
        second = np.where(least == _MOST, first, least & np.uint64(_PLACE))
        before, after = np.minimum(first, second).astype(np.int64), np.maximum(first, second).astype(np.int64)
        result[:, j] = _mixed(labelled[before] * _STEPS[40] + labelled[after] * _STEPS[41]).view(np.int64)
    return result


def parity_bits(labelled: np.ndarray, owner: np.ndarray, n_texts: int, bits: int) -> np.ndarray:
    """A map per text: for each of ``bits`` hash values whether an odd number of its shingles has it; 64 in a number.

    Two maps differ in no more bits than there are shingles that only one of the texts has.
    """
    result = np.zeros((n_texts, bits // 64), np.int64)
    step = max(1, (1 << 22) // bits)  # texts at a time, for memory
    edges = np.searchsorted(owner, np.arange(0, n_texts + step, step))
    for number, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        begin = number * step
        place = (owner[low:high] - begin) * bits + (labelled[low:high] & np.uint64(bits - 1)).astype(np.int64)
        here = min(step, n_texts - begin)
        odd = (np.bincount(place, minlength=here * bits) & 1).astype(np.uint8)
        result[begin : begin + here] = np.packbits(odd).view(">i8").reshape(here, bits // 64)
    return result


def content_key(words: np.ndarray) -> bytes:
    """128 bits for a sequence of words."""
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def shared_in_order(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Shingles that two texts share in the same order, as a share of all; 0 if it is below ``least``.

    A banded alignment: what isn't shared is inserted or deleted, so with similarity
    ``least`` at most ``(n + m) * (1 - least) / (1 + least)`` shingles are, and paths
    beyond as many diagonals needn't be followed. Per number of edits the furthest
    point on each diagonal is kept.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    if min(n, m) < least * max(n, m):
        return 0.0
    # Order aside, no more can be shared than this.
    values, x = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = x[:n], x[n:]
    common = int(np.minimum(np.bincount(a, minlength=len(values)), np.bincount(b, minlength=len(values))).sum())
    if common < least * (n + m - common):
        return 0.0
    band = int((n + m) * (1 - least) / (1 + least) + 1e-9)
    differ: dict[int, np.ndarray] = {}

    ones, others = a.tolist(), b.tolist()

    def slide(k: int, x: int) -> int:
        """From (x, x - k) along equal shingles to the next difference."""
        if x >= n or x - k >= m or ones[x] != others[x - k]:
            return x
        found = differ.get(k)
        if found is None:
            low, high = max(0, k), min(n, m + k)
            found = differ[k] = np.append(np.flatnonzero(a[low:high] != b[low - k : high - k]) + low, max(high, low))
        at = int(np.searchsorted(found, x))
        return int(found[at]) if at < len(found) else x

    furthest = {1: 0}
    for edits in range(band + 1):
        for k in range(-edits, edits + 1, 2):
            if k > n or -k > m:
                continue
            down, right = furthest.get(k + 1, -1), furthest.get(k - 1, -1) + 1
            x = down if k == -edits or (k != edits and right <= down) else right
            if x < max(0, k) or x > n or x - k > m:
                continue
            x = slide(k, x)
            furthest[k] = x
            if x >= n and x - k >= m:
                common = (n + m - edits) // 2
                return common / (n + m - common)
    return 0.0
