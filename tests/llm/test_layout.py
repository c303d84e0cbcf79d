"""Shards, prefix trie and manifest against plain versions on small, odd tables."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlane.functions.positions import SALT, positions, salted
from driftlane.llm import list_ranking
from driftlane.llm import prefix_trie as trie
from driftlane.llm.list_ranking import list_ranks
from driftlane.llm.merkle import manifest
from driftlane.llm.sharding import pack, shard_documents


@pytest.fixture(autouse=True)
def several_lots(spark):
    """Small tables are dealt into as many lots as large ones."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def crc(number):
    return zlib.crc32(str(number).encode())


# --- positions and list ranks ---------------------------------------------------------


def test_positions_of_a_hot_group_with_repeated_rows(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 5 > 0, F.lit("hot")).when(F.col("id") % 10 == 5, F.lit("b")).alias("g"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("k"),
    )
    got = positions(salted(rows), ["g"], ["k", SALT], "n")
    assert got.select("lot").distinct().count() > 1
    placed = defaultdict(list)
    for r in got.collect():
        placed[r["g"]].append((r["n"], -1 if r["k"] is None else r["k"]))
    assert set(placed) == {None, "b", "hot"}
    for found in placed.values():
        found.sort()
        assert [n for n, _ in found] == list(range(len(found)))
        assert [k for _, k in found] == sorted(k for _, k in found)


@pytest.mark.parametrize("walked", [8192, 16])
def test_list_ranks_of_several_lists(spark, monkeypatch, walked):
    monkeypatch.setattr(list_ranking, "WALKED", walked)
    order = np.random.default_rng(5).permutation(9000).tolist()
    lists = [order[:1], order[1:40], order[40:]]
    links, want = [], {}
    for one in lists:
        links += zip(one, [*one[1:], None])
        want.update({e: len(one) - i for i, e in enumerate(one)})
    got = list_ranks(spark.createDataFrame(links, "element bigint, to bigint"))
    assert {r["element"]: r["rank"] for r in got.collect()} == want


# --- prefix trie ----------------------------------------------------------------------


def plain_trie(rows, group=5, turns=9):
    """Every node in a dictionary, subtrees by walking up from every node."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        convs[conv].append((turn is not None, turn or 0, digest, role, text))
    original = {c: [t[3:] for t in sorted(found)] for c, found in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in original.items():
        h = 0 if c is None else crc(c) % turns
        sequence = original.get(None if c is None else c - c % group, [])[:h] + own[h:] if h else own
        for d in range(len(sequence) + 1):
            members[tuple(sequence[:d])].append(c)
        ends[tuple(sequence)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, found in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(found) - 1) * len(node[-1][1].encode()) if node else 0
    least = {n: min((c for c in found if c is not None), default=None) for n, found in members.items()}

    def listed(found):
        return ",".join("" if c is None else str(c) for c in sorted(found, key=lambda c: (c is not None, c or 0)))

    return sorted(
        (
            (
                least[n], len(n), least[n[:-1]] if n else None, len(members[n]), children[n], leaves[n], saved[n],
                hashlib.sha256(listed(ends[n]).encode()).hexdigest(),
            )
            for n in members
        ),
        key=repr,
    )


def trie_rows(spark, rows):
    table = spark.createDataFrame(
        [(*r, "v", 1, 2, "n") for r in rows], "conv_id bigint, turn bigint, role string, text string, v string, lot int, depth int, x1 string"
    )
    found = trie.prefix_trie(table)
    return found, sorted((tuple(r)[:8] for r in found.collect()), key=repr)


def odd_conversations():
    rows = [
        (c, t, "user" if t % 2 == 0 else "bot", f"Grüße {'x' * (t % 4)} {c // 25 if t > 5 else 0}")
        for c in range(120) for t in range(c % 11)
    ]
    rows += [(500, None, "user", "null first"), (500, -3, None, "minus"), (500, 0, "user", None), (500, 0, "bot", "tie"), (500, 0, "bot", "tie")]
    rows += [(501, 0, "", ""), (501, 1, None, None), (501, 1, None, None)]
    rows += [(None, 1, "user", "no id"), (None, None, "user", "Grüße  0"), (None, 1, "user", "no id")]
    rows += [(c, t, "user", "copy") for c in range(700, 730) for t in range(3)]
    return rows


def test_trie_of_odd_conversations(spark):
    rows = odd_conversations()
    found, got = trie_rows(spark, rows)
    assert got == plain_trie(rows)
    # The tour enters a node before its subtree and leaves it after.
    tour = found.select("enter_at", "exit_at").collect()
    assert sorted(x for r in tour for x in r) == list(range(2 * len(tour)))


def test_trie_of_a_long_conversation(spark, monkeypatch):
    """Small blocks in place of a long conversation: the plain version climbs from every node."""
    monkeypatch.setattr(trie, "BLOCK", 16)
    monkeypatch.setattr(trie, "ARCS", 64)
    monkeypatch.setattr(list_ranking, "WALKED", 32)
    rows = [(10, t, "user", "same" if t > 90 else f"t{t}") for t in range(120)] + [(10, 200, "user", "same")] * 30
    rows += [(13, t, "user", f"t{t}") for t in range(60)] + [(c, 0, "bot", "hi") for c in range(20, 60)]
    _, got = trie_rows(spark, rows)
    assert got == plain_trie(rows)


def test_trie_of_no_conversation(spark):
    assert trie_rows(spark, [])[1] == []


# --- manifest -------------------------------------------------------------------------


def digest_of(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """Trees as lists of lists, each proof found by climbing from its leaf."""
    def leaf(values):
        return digest_of(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def lowered(text):
        return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)

    def climb(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            level = levels[-1]
            levels.append([digest_of(*level[i : i + 16]) for i in range(0, len(level), 16)])
        return levels

    def path(levels, pos):
        for level in levels[:-1]:
            start = pos // 16 * 16
            yield level[start:pos], level[pos + 1 : start + 16]
            pos //= 16

    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        shown = lowered(text) if doc_id is not None and crc(doc_id) % 5 == 0 else text
        trees[source].append((
            (doc_id is not None, doc_id or 0, leaf((doc_id, source, lang, n_chars, text))), doc_id, leaf((doc_id, source, lang, n_chars, shown))
        ))
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: climb([key[2] for key, _, _ in sorted(trees[s])]) for s in sources}
    top = climb([levels[s][-1][0] for s in sources])
    result = []
    for number, s in enumerate(sources):
        for pos, (key, doc_id, shown) in enumerate(sorted(trees[s])):
            steps = [*path(levels[s], pos), *path(top, number)]
            folded = shown
            for left, right in steps:
                folded = digest_of(*left, folded, *right)
            proof = digest_of(*[d for left, right in steps for d in (*left, *right)])
            root = top[-1][0]
            result.append((doc_id, key[2], levels[s][-1][0], root, proof, folded, folded == root))
    return sorted(result, key=repr)


def manifest_rows(docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return sorted(
        (tuple(r) for r in manifest(docs, tampered).select(
            "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", "verified"
        ).collect()),
        key=repr,
    )


def test_manifest_of_odd_documents(spark, odd_documents):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert manifest_rows(odd_documents) == plain_manifest([tuple(r) for r in odd_documents.select(columns).collect()])


def test_manifest_of_many_sources_and_one_large_one(spark):
    rows = [(i, f"Text {i % 40}", "en", "hot" if i % 3 else f"s{i % 61}", None if i % 4 else i) for i in range(1200)]
    rows += [(i, "other", None, None, 5) for i in range(3)] + [(0, "Text", "en", "hot", 1)] * 300 + [(9, "", "", "ü", 0), (9, None, "", "é", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = manifest_rows(docs)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_and_no_document(spark, no_documents):
    assert manifest_rows(no_documents) == []
    one = [(3, "Text", "en", "a", 4)]
    docs = spark.createDataFrame(one, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert manifest_rows(docs) == plain_manifest(one)


# --- shards ---------------------------------------------------------------------------


def test_pack_takes_the_highest_dot_product():
    rng = np.random.default_rng(3)
    vectors = rng.random((60, 3)) / 8
    left = np.ones((5, 3))
    chosen = pack(vectors, left.copy())
    rest, order = left.copy(), sorted(range(60), key=lambda i: (-vectors[i].max(), vectors[i][2], vectors[i][1], vectors[i][0]))
    for n in order:
        fits = [s for s in range(5) if (rest[s] >= vectors[n]).all()] or range(5)
        best = max(fits, key=lambda s: (round(float(rest[s] @ vectors[n]), 12), -s))
        assert chosen[n] == best
        rest[best] -= vectors[n]


def sharded(docs, shards):
    rows = [r.asDict() for r in shard_documents(docs, shards).collect()]
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return rows


def test_shards_of_odd_documents(spark, odd_documents):
    rows = sharded(odd_documents, 3)
    texts = [r["text"] or "" for r in odd_documents.select("text").collect()]
    assert sorted((r["size"], r["text_crc32"], r["tokens"]) for r in rows) == sorted(
        (len(t.encode()) + 16, zlib.crc32(t.encode()), len(t.split())) for t in texts
    )


def test_shards_are_even_and_groups_whole(spark):
    rows = [(i, f"word {'x' * (i % 90)} " * (1 + i % 13) + f"{i // 3}") for i in range(3000)]
    rows += [(None, "hot"), (7, "hot")] * 800
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sharded(docs, 8)
    assert len(got) == len(rows)
    for measure, within in (("size", 0.02), ("tokens", 0.05)):
        totals = defaultdict(int)
        for r in got:
            totals[r["shard"]] += r[measure]
        mean = sum(totals.values()) / 8
        assert max(abs(t - mean) for t in totals.values()) < within * mean, measure
    shards = defaultdict(set)
    for r in got:
        shards[r["text_crc32"], r["size"]].add(r["shard"])
    hot = shards.pop((zlib.crc32(b"hot"), 19))
    assert len(hot) > 1 and all(len(s) == 1 for s in shards.values())
    assert sorted(map(repr, got)) == sorted(map(repr, sharded(docs, 8)))


def test_shards_of_no_document(spark, no_documents):
    assert sharded(no_documents, 4) == []
