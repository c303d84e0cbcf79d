import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from driftlane.llm import order_minhash, sketches


def classes(docs):
    return sorted((tuple(r) for r in order_minhash.near_duplicates(docs).select("doc_id", "class_id").collect()), key=repr)


def test_odd_rows(odd_documents):
    found = order_minhash.near_duplicates(odd_documents).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert len(found) == odd_documents.count()
    assert {r["class_id"] for i in (1, 2, 3) for r in by_id[i]} == {1}
    # Null and empty texts are one text; the passage without an id joins its copies.
    assert sorted(str(r["class_id"]) for r in by_id[None]) == ["1", "4"]
    assert by_id[5][0]["class_id"] == 4
    assert {r["class_id"] for i in (7, 8) for r in by_id[i]} == {7} and len(by_id[7]) == 2
    assert by_id[9][0]["class_id"] == 9 and by_id[10][0]["class_id"] == 10  # only A-Z are lower-cased
    assert by_id[11][0]["n_class"] == 2 and by_id[11][0]["n_links"] == 0
    assert {r["class_id"] for r in by_id[13]} == {13}


def test_no_rows(no_documents):
    assert classes(no_documents) == []


def edited(draw, words, changes):
    words = list(words)
    for _ in range(changes):
        at = draw.randrange(len(words))
        words[at : at + draw.randint(0, 1)] = [f"new{draw.random()}"]
    return words


def test_against_all_pairs(spark, brute):
    """A large group around one text, chains, reordered copies and texts that share half."""
    draw = random.Random(11)
    make = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    base = make(200)
    texts = [edited(draw, base, draw.randint(1, 3)) for _ in range(60)]
    chain = make(150)
    for _ in range(10):
        chain = edited(draw, chain, 2)
        texts.append(chain)
    texts += [base[100:] + base[:100], base[:100] + make(100), make(3), make(3), [], make(6)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    want = brute.near_classes([(i, " ".join(t)) for i, t in enumerate(texts)])
    assert dict(classes(docs)) == want


def test_pairs_inside_one_hot_bucket(spark, monkeypatch):
    """All texts share all buckets, one leader of them is near one text only, and yet each pair is found."""
    def alike(size):
        def rows(batches):
            for batch in batches:
                made = order_minhash._sketch_rows(batch, batch["text"].to_pylist(), size)
                at = made.schema.get_field_index("sketch")
                yield made.set_column(at, "sketch", pa.array([[7] * order_minhash.COUNT] * len(made), pa.list_(pa.int64())))

        return rows

    monkeypatch.setattr(order_minhash, "_sketched", alike)
    draw = random.Random(23)
    texts = []
    for _ in range(300):
        text = [f"w{draw.randrange(10**6)}" for _ in range(60)]
        texts += [text, text + ["more"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert dict(classes(docs)) == {i: i // 2 * 2 for i in range(len(texts))}


def test_one_document_of_each_class_stays(spark):
    """Null ids beside a class without ids, an id of two texts, near copies under one id, a repeated row."""
    draw = random.Random(5)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(60)) for _ in range(6)]
    near = [t + " more" for t in texts]
    docs = spark.createDataFrame([
        (1, texts[0]), (None, near[0]), (None, texts[1]), (None, near[1]), (4, texts[2]), (5, near[2]), (5, texts[3]),
        (9, texts[4]), (9, near[4]), (11, texts[5]), (11, texts[5]),
    ], "doc_id bigint, text string")
    rows = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted((r for r in rows if r[0] in (1, 4, 5, 11))) == [(1, texts[0]), (4, texts[2]), (5, texts[3]), (11, texts[5])]
    assert len(rows) == 6
    assert [t in (texts[1], near[1]) for i, t in rows if i is None] == [True]
    assert [t in (texts[4], near[4]) for i, t in rows if i == 9] == [True]


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_alignment_against_the_full_table(brute, least):
    draw = random.Random(3)
    for _ in range(200):
        a = [draw.randrange(30) for _ in range(draw.randint(1, 40))]
        b = list(a)
        for _ in range(draw.randint(0, 6)):
            b[(at := draw.randrange(len(b) + 1)) : at + draw.randint(0, 2)] = [draw.randrange(30)] * draw.randint(0, 2)
        shared = brute._longest_common(a, b)
        want = shared / (len(a) + len(b) - shared) if len(a) + len(b) > shared else 1.0
        got = sketches.shared_in_order(np.array(a), np.array(b, dtype=np.int64), least)
        assert got == pytest.approx(want if want >= least and b else 0.0)


def test_components(spark):
    draw = random.Random(9)
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(100, n) for n in range(101, 140)]
    draw.shuffle(edges)
    frame = spark.createDataFrame([(a, b) if draw.random() < 0.5 else (b, a) for a, b in edges], "a bigint, b bigint")
    got = dict(tuple(r) for r in order_minhash.components(frame).collect())
    assert got == {**{n: n // 20 * 20 for n in range(60)}, **{n: 100 for n in range(100, 140)}}


def test_maps_never_rule_out_similar_texts(spark):
    """Bits that differ are at most the shingles that only one text has, repeats counted."""
    draw = random.Random(31)
    for _ in range(60):
        a = [draw.randrange(40) for _ in range(draw.randint(1, 400))]
        b = list(a)
        for _ in range(draw.randint(0, 12)):
            b[(at := draw.randrange(len(b) + 1)) : at + draw.randint(0, 2)] = [draw.randrange(40)] * draw.randint(0, 2)
        made = [len(a), len(b)]
        owner = np.repeat([0, 1], made)
        labelled = sketches.occurrence_labelled(np.array(a + b, dtype=np.uint64), owner)
        maps = sketches.parity_bits(labelled, owner, 2, order_minhash.BITS)
        differing = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(*maps.tolist()))
        one, other = set(labelled[: made[0]].tolist()), set(labelled[made[0] :].tolist())
        assert differing <= len(one ^ other) and (len(one ^ other) > 300 or differing >= 0.5 * len(one ^ other) - 8)
    none = sketches.parity_bits(np.zeros(0, np.uint64), np.zeros(0, np.int64), 3, order_minhash.BITS)
    assert none.shape == (3, 16) and not none.any()


def test_few_rows_are_not_shuffled(spark, monkeypatch):
    """Stages of 61 tasks would be those behind a shuffle; the result is that of the dealt out form."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (92, 91)], "a bigint, b bigint").coalesce(2)
    held = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    context = spark.sparkContext

    def run(group):
        context.setJobGroup(group, group)
        try:
            rows = sorted(tuple(r) for r in order_minhash.components(edges).collect())
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        tracker = context.statusTracker()
        stages = [tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds]
        return rows, max(s.numTasks for s in stages if s)

    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        together, few = run("together")
        monkeypatch.setattr(order_minhash, "FEW", -1)
        dealt_out, many = run("dealt out")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert together == dealt_out == [(i, 0) for i in range(41)] + [(90, 90), (91, 90), (92, 90)]
    assert few <= 4 and many >= 61


def test_few_rows_find_the_same_classes(spark, monkeypatch):
    draw = random.Random(5)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    texts = [" ".join(edited(draw, base, draw.randint(1, 30))) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = classes(docs)
    monkeypatch.setattr(order_minhash, "FEW", -1)
    assert found == classes(docs)
