import importlib.util
from pathlib import Path

import pytest

LONG = "word " * 3


@pytest.fixture(scope="session")
def brute():
    spec = importlib.util.spec_from_file_location("brute", Path(__file__).with_name("brute.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, node string, size int, id int"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with names used inside."""
    passage = " ".join(f"w{i}x" for i in range(120))
    long_text = " ".join(f"t{i % 977}q{i // 50}" for i in range(30_000))
    rows = [
        (1, passage, "en", "a"), (2, passage + " end", "en", "a"), (3, "intro " + passage, "en", "b"),
        (4, "", "en", "b"), (5, None, "en", None), (None, passage, None, None), (None, None, None, None),
        (7, long_text, "de", "b"), (7, long_text, "de", "b"), (8, long_text + " more", "de", "a"),
        (9, "Grüße, naïve ÄRGER! " * 30, "de", "c"), (10, "Grüße, naïve ärger! " * 30, "de", "c"),
        (11, "short", "en", "c"), (11, "short", "en", "c"), (12, "all rights reserved", "en", "c"),
        (13, " ".join(f"u{i}" for i in range(90)), "en", "a"), (13, " ".join(f"v{i}" for i in range(90)), "en", "a"),
    ]
    return spark.createDataFrame(
        [(i, t, lang, s, None if t is None else len(t), "k", "n", 1, 2) for i, t, lang, s in rows], DOCUMENTS
    )


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
