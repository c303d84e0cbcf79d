"""Removal of long repeated byte strings by longest-previous-factor arrays.

Which windows of ``window`` bytes start elsewhere too is decided without shuffling
texts position by position:

1. Every window has an anchor, a substring picked by its content alone. Windows that
   share an anchor are consecutive; such a run is a row (hash of the anchor, hash of
   all bytes of the run, place). Equal windows have equal anchors at equal offsets.
2. Anchors that occur once can't repeat. Runs that are equal as a whole are counted;
   of the different runs of an anchor one copy each is compared further.
3. The runs of an anchor form a bucket. In it suffix order and the longest previous
   and next factors tell which windows have an earlier or a later match.
4. An anchor with very many different runs isn't gathered: its windows are counted by
   hash, those first that share all but the last bytes with another run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlane.llm import suffixes
from driftlane.llm.common import one_per_key
from driftlane.session import materialise

#: Different runs of one anchor that a task gathers; beyond it windows are counted instead.
BUCKET = 256
#: Windows of a block whose common bytes are looked up first.
BLOCK = 32
#: Bytes of runs that are put in suffix order at once.
SORTED = 1 << 20

_RUNS = "id bigint, th bigint, first int, last int, anchor int, gram bigint, run bigint"
_CONTENTS = "gram bigint, run bigint, id bigint, th bigint, first int, bytes binary"
_MATCHES = "gram bigint, run bigint, low int, high int, earlier boolean"
_BLOCKS = "gram bigint, run bigint, id bigint, th bigint, first int, block int, core bigint, whole bigint, low int, windows array<bigint>"


def _bytes(column: pa.Array, row: int) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), np.uint8)


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    fields = [part.split(" ") for part in schema.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def _runs_of(window: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = batch.column(2)
            lengths = [len(texts[i].as_buffer()) for i in range(len(texts))]
            for group in suffixes.pieces(lengths, window):
                data = np.concatenate([_bytes(texts, t)[b:e] for t, b, e in group])
                bounds = np.cumsum([e - b for _, b, e in group])
                first, last, anchor, gram, run = suffixes.anchors(data, bounds, window)
                piece = np.searchsorted(bounds, first, side="right")
                base = np.concatenate([[0], bounds[:-1]]) - np.array([b for _, b, _ in group])
                text = np.array([t for t, _, _ in group])[piece]
                shift = base[piece]
                yield _batch(_RUNS, [
                    ids[text], hashes[text], (first - shift).astype(np.int32), (last - shift).astype(np.int32),
                    (anchor - shift).astype(np.int32), gram, run,
                ])

    return runs


def _contents_of(window: int):
    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut the runs asked for out of their texts."""
        for batch in batches:
            rows = []
            for text, asked, id_, th in zip(batch["text"], batch["asked"], batch["id"], batch["th"]):
                data = text.as_buffer()
                for r in asked.as_py():
                    rows.append((r["gram"], r["run"], id_.as_py(), th.as_py(), r["first"],
                                 data.slice(r["first"], r["last"] - r["first"] + window).to_pybytes()))
            if rows:
                yield _batch(_CONTENTS, list(zip(*rows)))

    return contents


def _blocks_of(window: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the runs asked for: blocks of windows by offset from the anchor, with the hash of what all of a block share."""
        for batch in batches:
            rows = []
            for text, asked, id_, th in zip(batch["text"], batch["asked"], batch["id"], batch["th"]):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for r in asked.as_py():
                    first, last, anchor = r["first"], r["last"], r["anchor"]
                    # Offsets count from the anchor backwards, so equal windows are in equal blocks.
                    for block in range((anchor - last) // BLOCK, (anchor - first) // BLOCK + 1):
                        high = anchor - block * BLOCK  # the block's last start
                        low = high - BLOCK + 1
                        begin, end = max(low, first), min(high, last)
                        piece = data[begin : end + window]
                        hashes = suffixes.Hashes(piece)
                        # All windows of the block contain high .. low + window; a run's edge is inside its text.
                        core = data[high : low + window]
                        rows.append((
                            r["gram"], r["run"], id_.as_py(), th.as_py(), first, block,
                            int(suffixes.Hashes(core).of(np.array([0]), np.array([len(core)])).view(np.int64)[0]),
                            int(hashes.of(np.array([0]), np.array([len(piece)])).view(np.int64)[0]) ^ (begin - low), begin - first,
                            hashes.each(window).view(np.int64).tolist(),
                        ))
            if rows:
                yield _batch(_BLOCKS, list(zip(*rows)))

    return blocks


def _matches_of(window: int):
    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by gram; buckets are put in suffix order some at a time."""
        waiting, size, gram = [], 0, None
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if size > SORTED and row[0] != gram:
                    yield _in_suffix_order(waiting, window)
                    waiting, size = [], 0
                gram = row[0]
                waiting.append(row)
                size += len(row[5])
        if waiting:
            yield _in_suffix_order(waiting, window)

    return matches


def _in_suffix_order(rows: list[tuple], window: int) -> pa.RecordBatch:
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    lengths = np.array([len(r[5]) for r in rows])
    counts = lengths - window + 1
    begins = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(rows)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    texts = {key: number for number, key in enumerate(sorted({(r[2], r[3]) for r in rows}))}
    first = np.array([(texts[r[2], r[3]] << 32) + r[4] for r in rows])
    ranks = suffixes.suffix_ranks(data, begins[owner] + offset, window)
    earlier, later = suffixes.factors(ranks, first[owner] + offset)
    found = np.flatnonzero(earlier | later)
    if not len(found):
        return _batch(_MATCHES, [[]] * 5)
    own, off, seen = owner[found], offset[found], earlier[found]
    new = np.flatnonzero((own[1:] != own[:-1]) | (off[1:] != off[:-1] + 1) | (seen[1:] != seen[:-1])) + 1
    heads, tails = np.concatenate([[0], new]), np.concatenate([new, [len(found)]]) - 1
    grams, runs = (np.array([r[i] for r in rows])[own[heads]] for i in (0, 1))
    return _batch(_MATCHES, [grams, runs, off[heads].astype(np.int32), off[tails].astype(np.int32), seen[heads]])


def repeated_spans(docs: DataFrame, window: int, keep: str, id_column: str) -> DataFrame:
    """``doc_id, text, spans``: every row of ``docs`` with the byte ranges to remove, unmerged (null: none)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("doc_id"), text.cast("binary").alias("text"),
        F.coalesce(F.col(id_column).cast("bigint"), F.lit(-(2**63)).cast("bigint")).alias("id"), F.xxhash64(text).alias("th"),
    )
    runs = materialise(
        rows.where(F.octet_length("text") >= window).select("id", "th", "text").mapInArrow(_runs_of(window), _RUNS)
    )
    # Written first: a join with stored keys can be split where an anchor is hot.
    recurring = materialise(runs.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    repeated = materialise(runs.join(recurring, "gram", "left_semi"))
    contents = repeated.groupBy("gram", "run").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "th", "first", "last", "anchor")).alias("at")
    )
    contents = materialise(contents)
    kinds = contents.groupBy("gram").agg(F.count("*").alias("n_runs"), F.min("n").alias("rarest")).where("n_runs > 1")
    if keep == "none":  # runs that all have copies are known to repeat already
        kinds = kinds.where("rarest = 1")
    compared = materialise(contents.join(kinds, "gram").select("gram", "run", "at.*", "n_runs"))

    single = one_per_key(rows, "id", "th")
    matches = _bucket_matches(single, compared.where(F.col("n_runs") <= BUCKET), window)
    if compared.where(F.col("n_runs") > BUCKET).limit(1).count():
        matches = matches.unionByName(_counted_matches(single, compared.where(F.col("n_runs") > BUCKET), window))
    whole = contents.where("n > 1").select(
        "gram", "run", F.lit(0).alias("low"), (F.col("at.last") - F.col("at.first")).alias("high"),
        F.lit(False).alias("earlier"), F.struct("at.id", "at.th", "at.first").alias("kept"),
    )
    matched = whole.unionByName(matches.withColumn("kept", F.lit(None).cast(whole.schema["kept"].dataType)))
    places = repeated.join(matched, ["gram", "run"])
    if keep == "first":
        # A copy goes if it isn't the first of its run, or if an earlier run has the window.
        is_first = F.struct("id", "th", "first") == F.col("kept")
        places = places.where(F.col("earlier") | ~F.coalesce(is_first, F.lit(True)))
    spans = places.groupBy("id", "th").agg(F.collect_set(F.struct(
        (F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high") + window).alias("end")
    )).alias("spans"))
    return rows.join(spans, ["id", "th"], "left").select("doc_id", "text", "spans")


def _asked(rows: DataFrame, compared: DataFrame) -> DataFrame:
    fields = [F.col(c) for c in ("gram", "run", "first", "last", "anchor")]
    asked = compared.groupBy("id", "th").agg(F.collect_list(F.struct(*fields)).alias("asked"))
    return rows.join(asked, ["id", "th"]).select("id", "th", "text", "asked")


def _bucket_matches(rows: DataFrame, compared: DataFrame, window: int) -> DataFrame:
    contents = _asked(rows, compared).mapInArrow(_contents_of(window), _CONTENTS)
    return contents.repartition("gram").sortWithinPartitions("gram").mapInArrow(_matches_of(window), _MATCHES)


def _counted_matches(rows: DataFrame, compared: DataFrame, window: int) -> DataFrame:
    blocks = materialise(_asked(rows, compared).mapInArrow(_blocks_of(window), _BLOCKS))
    key = ["gram", "block", "core", "whole"]
    place = F.struct("id", "th", (F.col("first") + F.col("low")).alias("at"))
    # Of equal blocks the first stands for all.
    wholes = materialise(blocks.groupBy(*key).agg(
        F.count("*").alias("n"), F.min(F.struct(place.alias("place"), "run", "low", "windows")).alias("head")
    ))
    copies = blocks.join(wholes.where("n > 1").select(*key, F.col("head.place").alias("kept")), key).select(
        "gram", "run", "low", (F.col("low") + F.size("windows") - 1).alias("high"), (place != F.col("kept")).alias("earlier")
    )
    shared = wholes.groupBy("gram", "block", "core").agg(F.count("*").alias("n")).where("n > 1").select("gram", "block", "core")
    windows = wholes.join(shared, ["gram", "block", "core"]).select(
        "gram", "block", "head.place", "head.run", "head.low", F.posexplode("head.windows").alias("i", "hash")
    )
    own = F.struct("place.id", "place.th", (F.col("place.at") + F.col("i")).alias("at"))
    groups = windows.groupBy("gram", "block", "hash").agg(F.count("*").alias("n"), F.min(own).alias("kept")).where("n > 1")
    single = windows.join(groups, ["gram", "block", "hash"]).select(
        "gram", "run", (F.col("low") + F.col("i")).alias("low"), (F.col("low") + F.col("i")).alias("high"),
        (own != F.col("kept")).alias("earlier"),
    )
    return copies.unionByName(single)


def remove_repeats(docs: DataFrame, window: int = 400, keep: str = "first", id_column: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, spans, kept``.

    Removed is every byte covered by a string of ``window`` bytes that also starts
    elsewhere in the input, in the same or another document. With ``keep="first"`` the
    first occurrence, by id, stays; with ``keep="none"`` all go. ``spans`` are the
    maximal removed ranges of UTF-8 bytes, ``kept`` the other bytes.

    Null text is the empty text; texts below ``window`` bytes keep everything. A null
    id comes first in the order. Repeated rows repeat each other: both are cut alike,
    also with ``keep="first"`` if they share id and text, as neither is earlier. Very
    long texts are read in overlapping pieces. Other columns are not read.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, merged, kept = [], [], [], []
            for text, spans in zip(batch["text"], batch["spans"]):
                data, out, own, at = text.as_py(), [], [], 0
                for s in sorted((s["start"], s["end"]) for s in spans.as_py() or ()):
                    if own and s[0] <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], s[1])
                    else:
                        own.append({"start": s[0], "end": s[1]})
                for s in own:
                    out.append(data[at : s["start"]])
                    at = s["end"]
                out.append(data[at:])
                sizes.append(len(data))
                removed.append(sum(s["end"] - s["start"] for s in own))
                merged.append(own)
                kept.append(b"".join(out))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(merged, span), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    spans = repeated_spans(docs, window, keep, id_column)
    kind = dict(spans.dtypes)["doc_id"]
    return spans.mapInArrow(
        cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start: int, end: int>>, kept binary"
    )
