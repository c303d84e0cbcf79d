import numpy as np
import pytest

from driftlane.functions.ranks import exact_quantiles
from driftlane.operators.splits import id_at_rank, ordered_holdout, stratified_split

GROUPS = {
    "uniform": lambda g: g.uniform(0, 1, 3000),
    "normal": lambda g: g.normal(30, 5, 3000),
    "heavy": lambda g: np.exp(g.normal(0, 20, 2000)),
    "ties": lambda g: g.integers(-3, 4, 2000).astype(float),
    "narrow": lambda g: 1e6 + g.uniform(0, 1e-7, 1500),
    "tiny": lambda g: g.normal(0, 1e-9, 1000),
    "hot": lambda g: np.concatenate([np.full(5000, 7.25), g.normal(7.25, 1e-12, 500)]),
    "single": lambda g: np.array([42.0]),
    "pair": lambda g: np.array([-1.0, 5.0]),
}


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    data = {name: make(rng) for name, make in GROUPS.items()}
    rows = [(name, float(v)) for name, values in data.items() for v in values]
    rows += [("ties", None), ("uniform", float("nan"))]
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]
    df = spark.createDataFrame(rows, "k string, v double")
    result = {r.k: r for r in exact_quantiles(df, ["k"], "v", probabilities).collect()}
    assert set(result) == set(data)
    for name, values in data.items():
        assert result[name].n == len(values)
        expected = np.percentile(values, [100 * p for p in probabilities])
        np.testing.assert_allclose(result[name].quantiles, expected, rtol=1e-12, atol=1e-21)


def test_id_at_rank_of_texts(spark):
    rng = np.random.default_rng(2)
    ids = sorted(
        {"Customer#" + str(i).zfill(9) for i in range(300)}
        | {"".join(rng.choice(list("abéß€-0"), size=rng.integers(1, 16))) for _ in range(200)}
        | {"", "a", "ab", "abcdef", "abcdefg", "abcdefghijklm"},
        key=lambda s: s.encode(),
    )
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    for rank in (0, 1, len(ids) // 2, len(ids) - 1):
        assert id_at_rank(df, "id", rank) == ids[rank]


@pytest.mark.parametrize("fraction", [0.15, 0.5])
def test_ordered_holdout(spark, fraction):
    ids = [f"{(i * 7919) % 1000:04d}-X" for i in range(400)]
    out = ordered_holdout(spark.createDataFrame([(i,) for i in ids], "id string"), "id", fraction).collect()
    cut = int(400 * (1 - fraction))
    assert {r.id for r in out if r.held_out} == set(sorted(ids)[cut:])


def test_stratified_split_keeps_shares(spark):
    rows = [(i, 1 if i % 10 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, label int")
    first = {(r.id, r.is_test) for r in stratified_split(df, "label", "id").collect()}
    again = {(r.id, r.is_test) for r in stratified_split(df.repartition(7), "label", "id").collect()}
    assert first == again
    assert sum(1 for i, t in first if t and i % 10 == 0) == 20
    assert sum(1 for i, t in first if t and i % 10) == 180
