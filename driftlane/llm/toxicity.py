"""Toxicity scores from a factorization machine over hashed terms.

Terms are the words of a text and the beginnings of its longer words, hashed; a
beginning counts again if several words have it, as families of words do. Besides a
weight each term has a vector, and each pair of terms adds the product of theirs, so
that two terms can count for more together than the sum of what they say alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.llm.common import LOWER, UPPER, WORD
from driftlane.session import materialise

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
#: One word in so many makes a family of words a frequent one.
MANY = 60
_WORDS = re.compile(WORD)
_LOWERED = str.maketrans(UPPER, LOWER)
#: Beginnings of words whose terms a worker remembers, and words; twice as many of these at most.
REMEMBERED = 50_000
#: Texts whose terms a worker lists at once.
LISTED = 500
#: What is known of a word that the model doesn't use.
_NOTHING: tuple[None, tuple] = (None, ())


@dataclass(frozen=True)
class Limits:
    """Bounds of the fit: labelled rows, chosen by a hash of their id, and terms, chosen by how far they depart.

    A term must depart by ``departure`` standard deviations; the further, the more it is trusted.
    """

    rows: int = 20_000
    terms: int = 8_192
    departure: float = 3.0
    factors: int = 4
    steps: int = 200


@dataclass(frozen=True)
class Machine:
    """A fitted model; ``position`` maps a hashed term to its row of ``weights`` and ``vectors``."""

    position: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, terms: list[int]) -> float:
        """The chance of label 1; the pairs' sum comes from (sum of vectors)^2 - sum of squares."""
        vectors = self.vectors[terms]
        pairs = ((vectors.sum(axis=0) ** 2).sum() - (vectors**2).sum()) / 2
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[terms].sum() + pairs, -30, 30))))


def _hashed(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


@lru_cache(maxsize=REMEMBERED)
def _family(start: str) -> tuple[int, ...]:
    return tuple(_hashed(f"{mark}{start}") for mark in ("^", "2^", "4^", "%^"))


def word_terms(word: str) -> tuple[int, list[tuple[int, ...]]]:
    """The word's term, and for each of its beginnings the terms of one, two, four and relatively many words with it."""
    return _hashed(word), [_family(word[:n]) for n in PREFIXES if len(word) > n]


def text_terms(words: set[str]) -> set[int]:
    terms, families = set(), Counter()
    for word in words:
        own, starts = word_terms(word)
        terms.add(own)
        families.update(starts)
    for family, count in families.items():
        terms.update(_family_terms(family, count, len(words)))
    return terms


def _family_terms(family: tuple[int, ...], count: int, n_words: int) -> tuple[int, ...]:
    one, two, four, many = family
    return (one, *(two,) * (count >= 2), *(four,) * (count >= 4), *(many,) * (count >= 2 and count * MANY >= n_words))


def text_words(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.translate(_LOWERED) if not text.isascii() else text.lower())) if text else set()


def _term_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for begin in range(0, len(frame), LISTED):
            part = frame.iloc[begin : begin + LISTED]
            terms = [np.array(sorted(text_terms(text_words(text))), np.int32) for text in part["text"]]
            yield pd.DataFrame({"toxic": part["toxic"].to_numpy(), "terms": terms})


def labelled_sample(docs: DataFrame, labels: DataFrame, limits: Limits) -> DataFrame:
    """``toxic, terms`` of the rows to learn from: ids whose checksum isn't divisible by 5, up to the bound.

    An id with several labels counts as toxic if one says so; rows without a label or
    an id are not learned from. The ids chosen are at most ``limits.rows``, which is
    what lets Spark send them to all tasks.
    """
    learned = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    by_id = learned.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = materialise(by_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limits.rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # A repeated id takes part once, however many rows have it.
    once = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return materialise(once.select("text", "toxic").mapInPandas(_term_rows, "toxic int, terms array<int>"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> Machine:
    """Learn from a bounded sample; which terms count is decided in Spark, the descent runs on the driver.

    Of the terms those are kept whose share of toxic rows departs most from the
    overall share, in standard deviations. Without rows of both labels there is nothing
    to learn from, and every text scores (next to) 0.
    """
    sample = labelled_sample(docs, labels, limits)
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    share = (total["toxic"] + 1) / (total["n"] + 2)
    bias = float(np.log(share / (1 - share)))
    if not 0 < total["toxic"] < total["n"]:
        return Machine({}, -30.0, np.zeros(0), np.zeros((0, limits.factors)))
    counts = sample.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("toxic")
    )
    departure = F.abs(F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
    measured = counts.withColumn("departure", departure).where(F.col("departure") > limits.departure)
    kept = materialise(measured.orderBy(F.desc("departure"), "term").limit(limits.terms).select("term", "departure"))
    chosen = kept.orderBy("term").collect()  # at most limits.terms
    position = {row["term"]: number for number, row in enumerate(chosen)}
    if not chosen:
        return Machine({}, -30.0, np.zeros(0), np.zeros((0, limits.factors)))
    trust = np.array([1 - (limits.departure / row["departure"]) ** 2 for row in chosen])
    numbers = F.broadcast(kept.select("term"))
    rows = sample.withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows)
    known = rows.select("row", F.explode("terms").alias("term")).join(numbers, "term").groupBy("row").agg(
        F.sort_array(F.collect_list("term")).alias("terms")
    )
    read = rows.select("row", "toxic").join(known, "row", "left").orderBy("row").collect()  # at most limits.rows
    toxic = np.array([row["toxic"] for row in read], dtype=float)
    terms = [[position[t] for t in row["terms"] or ()] for row in read]
    return Machine(position, *_descend(toxic, terms, trust, bias, limits))


def _descend(
    toxic: np.ndarray, terms: list[list[int]], trust: np.ndarray, bias: float, limits: Limits, pull: float = 1e-4
) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the logistic loss of a factorization machine; a term that is there has its ``trust`` as input."""
    n_terms = len(trust)
    row = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    term = np.array([t for own in terms for t in own], dtype=np.int64)
    given = trust[term]
    random = np.random.default_rng(7)
    values = [np.array([bias]), np.zeros(n_terms), random.normal(0, 0.01, (n_terms, limits.factors))]
    means, squares = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]

    def per(index: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(index, weight, size)

    for step in range(1, limits.steps + 1):
        base, weights, vectors = values
        drawn = vectors[term] * given[:, None]
        sums = np.stack([per(row, drawn[:, f], len(terms)) for f in range(limits.factors)], axis=1)
        pairs = ((sums**2).sum(axis=1) - per(row, (drawn**2).sum(axis=1), len(terms))) / 2
        level = np.clip(base[0] + per(row, weights[term] * given, len(terms)) + pairs, -30, 30)
        error = (1 / (1 + np.exp(-level)) - toxic) / len(terms)
        spread = error[row] * given
        slope = np.stack(
            [per(term, spread * (sums[row, f] - drawn[:, f]), n_terms) for f in range(limits.factors)], axis=1
        )
        slopes = [np.array([error.sum()]), per(term, spread, n_terms) + pull * weights, slope + pull * vectors]
        for i, gradient in enumerate(slopes):
            means[i] = 0.9 * means[i] + 0.1 * gradient
            squares[i] = 0.999 * squares[i] + 0.001 * gradient**2
            values[i] = values[i] - 0.05 * (means[i] / (1 - 0.9**step)) / (np.sqrt(squares[i] / (1 - 0.999**step)) + 1e-8)
    return float(values[0][0]), values[1] * trust, values[2] * trust[:, None]


def score_texts(machine: Machine) -> Column:
    """A column expression: the score of ``text``, read as a whole. Equal texts score the same, empty ones the bias."""

    def known_terms(word: str) -> tuple[int | None, tuple[tuple[int, ...], ...]]:
        """The word's row, and those of its families of which a term has a row."""
        own, families = word_terms(word)
        rows = machine.position
        found = rows.get(own), tuple(f for f in families if any(t in rows for t in f))
        return _NOTHING if found == _NOTHING else found

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int | None, tuple[tuple[int, ...], ...]]] = {}
        before: dict[str, tuple[int | None, tuple[tuple[int, ...], ...]]] = {}
        rows = machine.position
        for batch in batches:
            found = []
            for text in batch:
                terms: set[int] = set()
                families: Counter = Counter()
                words = text_words(text)
                for word in words:
                    own = known.get(word)
                    if own is None:
                        # Words that weren't met again since the last change go; frequent ones stay.
                        if len(known) >= REMEMBERED:
                            before, known = known, {}
                        own = known[word] = before.get(word) or known_terms(word)
                    if own[0] is not None:
                        terms.add(own[0])
                    for family in own[1]:
                        families[family] += 1
                for family, count in families.items():
                    terms.update(rows[t] for t in _family_terms(family, count, len(words)) if t in rows)
                found.append(machine.score(sorted(terms)))
            yield pd.Series(found, dtype=float)

    return F.pandas_udf(scores, "double")(F.col("text"))


def toxicity(docs: DataFrame, model: Machine, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, ``doc_id, held_out, score, predicted`` for every document.

    Only the text makes the score. Null text is the empty text. A null id is scored and
    not held out. Repeated rows each get the same score. An empty table gives an empty
    result. No shuffle: every text is scored where it is read.
    """
    scored = docs.select(
        *[F.col(c) for c in keep if c != "doc_id"], F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        score_texts(model).alias("score"),
    )
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
