"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
from collections import defaultdict


def repeated_bytes(rows: list[tuple], window: int, keep: str) -> list[tuple]:
    """``doc_id, n_bytes, n_removed, n_spans, sha256`` of each row: every window of every text in a dictionary."""
    data = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    starts = defaultdict(list)
    for number, (doc_id, text) in enumerate(data):
        order = (doc_id is not None, doc_id or 0, text)
        for s in range(len(text) - window + 1):
            starts[text[s : s + window]].append((order, s, number))
    removed = [set() for _ in data]
    for found in starts.values():
        if len(found) > 1:
            first = min((order, s) for order, s, _ in found)
            for order, s, number in found:
                if keep == "none" or (order, s) != first:
                    removed[number].update(range(s, s + window))
    result = []
    for (doc_id, text), gone in zip(data, removed):
        kept = bytes(b for i, b in enumerate(text) if i not in gone)
        spans = sum(1 for i in gone if i - 1 not in gone)
        result.append((doc_id, len(text), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return result


def plain_words(text: str | None) -> list[str]:
    """Maximal runs of word characters, A-Z lower-cased."""
    words, own = [], []
    for c in [*(text or ""), " "]:
        c = c.lower() if c.isascii() else c
        if c >= "\x80" or "0" <= c <= "9" or "a" <= c <= "z":
            own.append(c)
        elif own:
            words.append("".join(own))
            own = []
    return words


def _shingles(words: list[str], size: int) -> list[tuple]:
    return [tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))] if words else []


def _longest_common(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def near_classes(rows: list[tuple], size: int = 5, least: float = 0.8) -> dict[int, int]:
    """The least id of each document's class: all pairs of different texts, aligned in full."""
    from collections import Counter

    texts = defaultdict(list)
    for doc_id, text in rows:
        texts[tuple(plain_words(text))].append(doc_id)
    shingles = {words: _shingles(list(words), size) for words in texts}
    counts = {words: Counter(s) for words, s in shingles.items()}
    keys = sorted(texts, key=lambda w: len(shingles[w]))
    parent = {words: words for words in keys}

    def root(words):
        while parent[words] != words:
            words = parent[words]
        return words

    for i, a in enumerate(keys):
        n = len(shingles[a])
        for b in keys[i + 1 :]:
            m = len(shingles[b])
            if n < least * m:
                break
            shared = sum((counts[a] & counts[b]).values())
            if n and shared >= least * (n + m - shared):
                shared = _longest_common(shingles[a], shingles[b])
                if shared >= least * (n + m - shared):
                    parent[root(b)] = root(a)
    classes = defaultdict(list)
    for words, ids in texts.items():
        classes[root(words)] += ids
    return {doc_id: min(ids) for ids in classes.values() for doc_id in ids}
