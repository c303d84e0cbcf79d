import random

import numpy as np
from pyspark.sql import functions as F

from driftlane.llm import suffix_dedup, suffixes


def result(docs, window, keep):
    cut = suffix_dedup.remove_repeats(docs, window, keep)
    rows = cut.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def given(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_odd_rows(spark, odd_documents, brute):
    got = result(odd_documents, 400, "none")
    assert got == sorted(brute.repeated_bytes(given(odd_documents), 400, "none"), key=repr)


def test_no_rows(no_documents):
    assert result(no_documents, 400, "none") == []


def test_random_texts_of_few_letters(spark, brute):
    """Many partial repeats, at every kind of offset; the first stays or none does."""
    draw = random.Random(5)
    parts = ["".join(draw.choice("abc") for _ in range(draw.randint(90, 300))) for _ in range(12)]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 6))) for _ in range(60)] + ["ab" * 700, "x" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for keep in ("none", "first"):
        assert result(docs, 200, keep) == sorted(brute.repeated_bytes(given(docs), 200, keep), key=repr)


def test_frequent_passage_is_counted_not_gathered(spark, brute, monkeypatch):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(60))
    passage, short = "".join(word() for _ in range(9)), "".join(word() for _ in range(6))[:390]
    docs = spark.createDataFrame(
        [(i, word() * (i % 3) + (passage if i % 2 else short) + word()) for i in range(40)], "doc_id bigint, text string"
    )
    monkeypatch.setattr(suffix_dedup, "BUCKET", 2)
    for keep in ("none", "first"):
        assert result(docs, 400, keep) == sorted(brute.repeated_bytes(given(docs), 400, keep), key=repr)


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    groups = suffixes.pieces([2500, 10, 400], 400)
    assert [p for g in groups for p in g] == [(0, 0, 1399), (0, 1000, 2399), (0, 2000, 2500), (2, 0, 400)]


def test_suffix_ranks_are_the_order_of_the_suffixes():
    data = np.frombuffer(b"abracadabraabracadabra" * 2, np.uint8)
    starts = np.arange(len(data) - 20)
    ranks = suffixes.suffix_ranks(data, starts, 20)
    pieces = [data[s : s + 20].tobytes() for s in starts]
    assert all((ranks[i] < ranks[j]) == (pieces[i] < pieces[j]) for i in starts for j in starts)
    earlier, later = suffixes.factors(ranks, starts)
    assert earlier.tolist() == [p in pieces[:i] for i, p in enumerate(pieces)]
    assert later.tolist() == [p in pieces[i + 1 :] for i, p in enumerate(pieces)]
