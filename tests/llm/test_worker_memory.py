"""Memory that a Python worker takes for its tasks: it must not grow with the words met nor with the size of a batch."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa

from driftlane.llm import order_minhash, suffixes, toxicity


def _peak_mb(work) -> tuple[float, list]:
    tracemalloc.start()
    try:
        result = work()
        return tracemalloc.get_traced_memory()[1] / 1e6, result
    finally:
        tracemalloc.stop()


def test_words_met_once_do_not_pile_up(spark, monkeypatch):
    monkeypatch.setattr(toxicity.F, "pandas_udf", lambda scores, kind: lambda text: scores)
    toxicity._family.cache_clear()
    model = toxicity.Machine({toxicity._hashed("bad"): 0}, -2.0, np.array([4.0]), np.zeros((1, 4)))
    scores = toxicity.score_texts(model)
    texts = ["bad " * (i % 2) + " ".join(f"{j * 2654435761 % 2**32:08x}" for j in range(500 * i, 500 * i + 500)) for i in range(400)]
    peak, found = _peak_mb(lambda: list(scores(pd.Series(texts[i : i + 50]) for i in range(0, 400, 50))))
    assert [s > 0.5 for s in pd.concat(found)] == [i % 2 == 1 for i in range(400)]
    assert peak < 60


def test_terms_of_a_large_batch_are_listed_in_parts():
    toxicity._family.cache_clear()
    choice = random.Random(3)
    words = [f"{i * 40503 % 65536:04x}" * 2 for i in range(3000)]
    frame = pd.DataFrame({"text": [" ".join(choice.sample(words, 600)) for _ in range(1500)], "toxic": [i % 2 for i in range(1500)]})
    peak, found = _peak_mb(lambda: [(len(part), part["toxic"].tolist(), part["terms"].iloc[-1].__len__()) for part in toxicity._term_rows([frame])])
    assert [t for _, part, _ in found for t in part] == frame["toxic"].tolist()
    assert found[-1][2] == len(toxicity.text_terms(toxicity.text_words(frame["text"].iloc[-1])))
    assert peak < 25


def test_a_large_batch_is_sketched_in_parts(monkeypatch):
    monkeypatch.setattr(suffixes, "_powers", {})
    choice = random.Random(5)
    words = [f"w{i:05d}" for i in range(2000)]
    texts = ["", "one two", *(" ".join(choice.choices(words, k=300)) for _ in range(4000))]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array(map(str, range(n))), pa.array(range(n), pa.int64()), pa.array([t.encode() for t in texts], pa.binary())],
        names=["doc_id", "key", "th", "text"],
    )
    peak, found = _peak_mb(lambda: [(b["doc_id"].to_pylist(), b["sketch"].value_lengths().to_pylist(), b["bits"].value_lengths().to_pylist())
                                    for b in order_minhash._sketched(5)([batch])])
    assert [i for ids, _, _ in found for i in ids] == list(range(n))
    assert [k for _, sizes, _ in found for k in sizes] == [0] + [order_minhash.COUNT] * (n - 1)
    assert {k for _, _, sizes in found for k in sizes} == {order_minhash.BITS // 64}
    assert peak < 60
