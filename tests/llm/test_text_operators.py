"""Mixing, decontamination, chat, fingerprints and licenses on small tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from driftlane.llm.chat import chat_texts
from driftlane.llm.decontamination import decontaminate
from driftlane.llm.fingerprints import fingerprint_pairs
from driftlane.llm.licenses import FAMILIES, NOTICES, rules, scan_licenses
from driftlane.llm.mixing import fair_queue, training_order


# Mixing

def test_mix_of_odd_rows(odd_documents):
    mixed = fair_queue(odd_documents).collect()
    assert len(mixed) == odd_documents.count()
    by_source = {}
    for r in mixed:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (size, target), taken in by_source.items():
        assert sum(taken) == int(target) and target <= 2 * size


def test_mix_targets(spark):
    docs = spark.createDataFrame(
        [(i, "w " * 10, s) for i, s in enumerate("a" * 10 + "b" * 10 + "c" * 10)] + [(99, "w " * 7, None)],
        "doc_id bigint, text string, source string",
    )
    mixed = fair_queue(docs)
    targets = {r["source_size"]: r["target"] for r in mixed.where("doc_id = 99 or doc_id = 15").collect()}
    # 307 words, so 460.5 wanted; a is full at 200, the last at 14, b and c share the rest one to two.
    assert targets == pytest.approx({100: (460.5 - 14 - 200) / 3, 7: 14})
    order = training_order(mixed, 3).collect()
    assert sum(r["words"] for r in order) == 200 + 14 + 82 + 164
    again = fair_queue(docs.repartition(5)).select("doc_id", "taken")
    assert sorted(again.collect()) == sorted(mixed.select("doc_id", "taken").collect())


def test_mix_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (1 + i % 4), "a", -i, f"bin{i}", i * 10, "place") for i in range(30)],
        "doc_id bigint, text string, source string, size int, bin string, start int, place string",
    )
    mixed = fair_queue(docs, keep=("text", "source", "size", "bin", "start", "place")).collect()
    assert len(mixed) == 30
    for r in mixed:
        i = r["doc_id"]
        assert (r["size_given"], r["bin"], r["start"], r["place"], r["size"]) == (-i, f"bin{i}", i * 10, "place", 1 + i % 4)


def test_mix_of_nothing(no_documents):
    assert fair_queue(no_documents).collect() == []


# Decontamination

def brute_hits(words, items, window=10):
    hit, names = set(), set()
    for name, item in items:
        need = min(window, len(item))
        for s in range(len(item) - need + 1 if need else 0):
            for at in range(len(words) - need + 1):
                if words[at : at + need] == item[s : s + need]:
                    hit.update(range(at, at + need))
                    names.add(name)
    return len(hit), sorted(names)


def test_leaks_against_brute_force(spark, brute):
    item = [f"i{n}" for n in range(30)]
    common = "the of and to the of in the of a".split()
    benchmark = [(1, " ".join(item)), (2, " ".join(common)), (3, "Two words"), (4, None), (5, "!!"), (6, "one"),
                 (7, " ".join(item[5:25])), (1, " ".join(item)), (None, "null item here"), (10, "x " * 14)]
    texts = [
        " ".join(item[:10]), " ".join(item[3:12]), "a, b: " + "-".join(item[8:20]).upper() + " c", " ".join(common * 3),
        "two WORDS and one", None, "", "x " * 40, " ".join(item[:15] + ["gap"] + item[15:]), "null item here",
    ]
    docs = spark.createDataFrame(
        [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 2), (None, texts[2], 3)], "doc_id bigint, text string, item int"
    )
    found = decontaminate(docs, spark.createDataFrame(benchmark, "item_id bigint, text string")).collect()
    items = [("" if i is None else str(i), brute.plain_words(t)) for i, t in benchmark]
    want = []
    for doc_id, text in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        words = brute.plain_words(text)
        hit, names = brute_hits(words, items)
        want.append((doc_id, len(words), hit, names))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found), key=repr) == sorted(want, key=repr)


def test_leaks_in_nothing(spark, no_documents, odd_documents):
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate(no_documents, nothing).collect() == []
    assert not any(r["contaminated"] for r in decontaminate(odd_documents, nothing).collect())


# Chat

def test_snapshots_collapse(spark):
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    rows = [(1, i, *t) for i, t in enumerate(turns[:1])] + [(2, i, *t) for i, t in enumerate(turns)]
    rows += [(3, i, *t) for i, t in enumerate(turns)] + [(4, 0, "user", "a"), (4, 1, "assistant", "other")]
    rows += [(5, None, None, None), (6, 7, "user", "a"), (None, 0, "user", "alone"), (7, 0, "user", "long")]
    rows += [(8, i, "user", f"t{i}") for i in range(2500)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, n int")
    got = {(r["conv_id"], r["part"]): r for r in chat_texts(frame).collect()}
    assert set(got) == {(2, 0), (4, 0), (5, 0), (None, 0), (7, 0), (8, 0), (8, 1), (8, 2)}
    assert got[2, 0]["n_copies"] == 2 and got[2, 0]["n_turns"] == 3
    assert got[2, 0]["text"] == "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n<|user|>\nc\n<|end|>\n"
    assert "".join(got[8, p]["text"] for p in range(3)).count("<|end|>") == 2500
    assert chat_texts(frame.limit(0)).collect() == []


# Fingerprints

def test_fingerprints_of_odd_rows(odd_documents, no_documents):
    got = fingerprint_pairs(odd_documents).collect()
    rows = sorted(
        ((r["doc_id"], r["text"] or "") for r in odd_documents.collect()),
        key=lambda r: (r[0] is not None, r[0] or 0),
    )
    assert len(got) == len(rows)
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    for r in got:
        texts = [t for i, t in rows if i == r["doc_id"] and len(t) == r["n_chars"]]
        if len(set(texts)) == 1:
            assert prints.setdefault(texts[0], r["fingerprint"]) == r["fingerprint"]
    edited = {r["doc_id"]: r["edited_sha256"] for r in got}
    by_id = [(i, t) for i, t in rows if i is not None]
    for (i, text), (_, after) in zip(by_id, by_id[1:]):
        if i in (1, 2, 3, 9, 10):
            swapped = len(text) // 4
            want = text[: len(text) - swapped] + after[:swapped]
            assert edited[i] == hashlib.sha256(want.encode()).hexdigest()
    assert fingerprint_pairs(no_documents).collect() == []


def test_next_text_over_many_ranges(spark):
    docs = spark.createDataFrame([(i * i, f"text {i} " * 9) for i in range(3000)], "doc_id bigint, text string").repartition(7)
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint_pairs(docs).collect()}
    for i in range(3000):
        text, after = f"text {i} " * 9, f"text {(i + 1) % 3000} " * 9
        want = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert got[i * i] == hashlib.sha256(want.encode()).hexdigest()


# Licenses

def test_rules_are_hundreds():
    families, notices = FAMILIES.strip().splitlines(), NOTICES.strip().splitlines()
    identified = sum(bool(row.split("|")[-1].strip()) for row in families)
    assert len(rules()) == 3 * len(families) + identified + len(notices) > 250


CASES = [
    ("This work is licensed under the GNU General Public License, version 3.", 1, 7, 7, "gpl", "gpl,gpl-3"),
    ("CC BY cc-by; (CC) by", 3, 0, 4, "cc-by", "cc-by"),
    ("Licensed under CC BY-NC-SA 4.0.", 1, 2, 2, "cc-by", "cc-by,cc-by-nc-sa"),
    ("All  rights\nRESERVED. All rights reserved", 2, 0, 3, "reserved", "reserved"),
    ("Released under the MIT License.", 0, None, None, "", "mit"),
    ("SPDX-License-Identifier: Apache-2.0", 0, None, None, "", "apache-2.0"),
    ("the GNU Lesser General Public License v2.1", 1, 3, 3, "gpl", "gpl,lgpl-2.1"),
    ("submit a permit to commit", 0, None, None, "", ""),
    ("rights reserved; public licenses", 0, None, None, "", ""),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", 0, None, None, "", "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", 0, None, None, "", "isc"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted. Neither the name of the copyright holder "
     "nor the names of its contributors may be used to endorse or promote products derived from this software", 0, None, None, "", "bsd,bsd-3"),
    ("All advertising materials mentioning features or use of this software must display the following", 0, None, None, "", "bsd-4"),
    ("In no event will the authors be held liable for any damages arising from the use of this software.", 0, None, None, "", "zlib"),
    ("This is free and unencumbered software released into the public domain.", 0, None, None, "", "unlicense"),
    ("The software is provided as is, without warranty of any kind, express or implied", 0, None, None, "", "disclaimer"),
    ("GPLv3", 0, None, None, "", "gpl-3"), ("Licensed under GPL v2 or later", 0, None, None, "", "gpl-2"),
    ("LGPL-2.1+ and the AGPL", 0, None, None, "", "agpl,lgpl-2.1"), ("it is hereby noted, held liable, no warranty", 0, None, None, "", ""),
    (None, 0, None, None, "", ""), ("", 0, None, None, "", ""),
    ("x " * 20000 + "cc by", 1, 20000, 20000, "cc-by", "cc-by"),
]


def test_null_turns_come_before_negative_ones(spark):
    turns = [(1, -5, "a", "second"), (1, None, "b", "first"), (1, 3, "c", "third"), (2, None, "x", "only")]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r["text"] for r in chat_texts(frame).collect()}
    assert [got[1].index(w) for w in ("first", "second", "third")] == sorted(got[1].index(w) for w in ("first", "second", "third"))
    assert "only" in got[2]


def test_licenses(spark):
    frame = spark.createDataFrame([(i, c[0], 3) for i, c in enumerate(CASES)], "doc_id bigint, text string, words int")
    got = {r["doc_id"]: r for r in scan_licenses(frame).collect()}
    for i, (_, n, first, last, base, labels) in enumerate(CASES):
        r = got[i]
        assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == (n, first, last, base, labels), i
        assert (r["score"] > 0) == (labels != "") and r["score"] <= 1
    assert scan_licenses(frame.limit(0)).collect() == []


def test_contained_detections_go(spark):
    text = "Licensed under the GNU Lesser General Public License version 3, see the MIT License"
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [(d["label"], d["start"], d["end"]) for d in row["detections"]] == [("lgpl-3", 0, 10), ("mit", 10, 14)]


def test_odd_documents_are_scanned(odd_documents):
    assert scan_licenses(odd_documents).agg(F.count("*"), F.sum("n_base")).first()[1] == 1
