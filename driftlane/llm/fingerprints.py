"""Document fingerprints by I-Match with randomised lexicons.

Of a text count only the distinct terms whose inverse document frequency lies in a
band. Each of several random parts of that lexicon gives one hash of the document's
terms in it. The parts differ in density, from a quarter of the lexicon downwards, so
that for a text of any length some hold a few of its terms only and outlast an edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.llm.common import words
from driftlane.session import materialise

#: Parts per density, and densities 2^-2 .. 2^-9.
PARTS, DENSITIES = 4, tuple(range(2, 10))
SLOTS = [(d, p) for d in DENSITIES for p in range(PARTS)]
#: Ranges that the documents are cut into by id; each is sorted and read by one task.
RANGES = 1024


def band_lexicon(docs: DataFrame, rarest: float, most_common: float) -> DataFrame:
    """``term, id, parts``: terms that between these shares of all documents hold; parts is a bit mask.

    A document adds one to each of its terms, so at most (mean distinct terms of a
    document / ``rarest``) terms reach the lower bound, at any number of documents.
    """
    terms = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("n_docs"))
    total = docs.agg(F.count("*").alias("n")).first()["n"]
    mask = F.lit(0).cast("bigint")
    for number, (density, part) in enumerate(SLOTS):
        chosen = F.pmod(F.xxhash64("term", F.lit(number)), F.lit(1 << density)) == 0
        mask = mask.bitwiseOR(F.when(chosen, F.lit(1 << number)).otherwise(F.lit(0)).cast("bigint"))
    kept = counts.where((F.col("n_docs") >= rarest * total) & (F.col("n_docs") <= F.greatest(F.lit(most_common * total), F.lit(1.0))))
    return materialise(kept.select("term", F.xxhash64("term").alias("id"), mask.alias("parts")))


def with_next(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, text, range, place, following, extra``: each text with the next one by id, after the last the first.

    Documents are cut into ranges by ids that occur, so the first document of a range
    is known; a copy of it, marked ``extra``, ends the range before. One shuffle.
    """
    lowest = F.lit(-(2**63)).cast("bigint")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("order", F.coalesce(F.col("doc_id").cast("bigint"), lowest))
    ids = keyed.select(F.col("order").cast("double").alias("order"))
    cuts = ids.approxQuantile("order", [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))
    first = keyed.agg(F.min("order").alias("first")).first()["first"]
    # Cuts go through doubles; the smallest id at or above each is one that occurs.
    bounds = _occurring(keyed, sorted(set(cuts)), first)
    limits = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    number = F.size(F.filter(limits, lambda b: b <= F.col("order")))
    before = F.when(number == 1, F.lit(len(bounds))).otherwise(number - 1)
    copies = F.when(
        F.array_contains(limits, F.col("order")),
        F.array(F.struct(number.alias("range"), F.lit(False).alias("extra")), F.struct(before.alias("range"), F.lit(True).alias("extra"))),
    ).otherwise(F.array(F.struct(number.alias("range"), F.lit(False).alias("extra"))))
    spread = keyed.withColumn("copy", F.explode(copies)).select("doc_id", "text", "order", "copy.range", "copy.extra")
    line = Window.partitionBy("range").orderBy("extra", "order", F.xxhash64("text"), "text")
    return spread.select(
        "doc_id", "text", "range", "extra", F.row_number().over(line).alias("place"),
        F.lead("text").over(line).alias("following"),
    )


def _occurring(keyed: DataFrame, cuts: list[float], first: int | None) -> list[int]:
    """For each cut the smallest id at or above it, and the smallest of all; at most RANGES numbers."""
    if first is None:
        return [0]
    limits = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    number = F.size(F.filter(limits, lambda c: c <= F.col("order").cast("double")))
    smallest = keyed.groupBy(number.alias("range")).agg(F.min("order").alias("id"))
    return sorted({first, *(row["id"] for row in smallest.collect())})


def fingerprint_pairs(
    docs: DataFrame, rarest: float = 0.005, most_common: float = 0.05, id_column: str = "doc_id"
) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and likenesses.

    Columns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. A fingerprint is 32 hashes of 8 digits, in order of
    density; a part of the lexicon without terms of the text has zeros. A likeness is
    the share of equal hashes among the parts that hold terms of either text, over the
    two sparsest densities at which most parts hold some.

    A text without lexicon terms has the hash of the whole text in all places, so equal
    texts always agree. Null text is the empty text; a null id comes first; equal ids
    are ordered by text; a single document is its own next. Other columns are not read.
    An empty table gives an empty result.
    """
    lexicon = band_lexicon(docs, rarest, most_common)
    lined = with_next(docs, id_column)
    length = F.length("text")
    swapped = F.floor(length / 4).cast("int")
    follower = F.coalesce("following", F.lit(""))
    edited = lined.select(
        "doc_id", "range", "place", "extra", "text", length.cast("bigint").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), length - swapped), F.substring(follower, F.lit(1), swapped)).alias("edited"),
    ).withColumn("edited_sha256", F.sha2("edited", 256))
    versions = edited.select(
        "doc_id", "range", "place", "extra", "n_chars", "edited_sha256",
        F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("body")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("body")))).alias("v"),
    ).select("*", "v.version", F.xxhash64("v.body").alias("whole"), F.array_distinct(words(F.col("v.body"))).alias("terms")).drop("v")
    keys = ["doc_id", "range", "place", "extra", "n_chars", "edited_sha256", "version", "whole"]
    # The lexicon's size is bounded whatever the input, see band_lexicon.
    # No exchange is needed for the sums: a document's terms are where its range is.
    matched = versions.select(*keys, F.explode_outer("terms").alias("term")).join(F.broadcast(lexicon), "term", "left")
    # The terms are distinct, so the exclusive or of their hashes stands for the sorted list.
    sums = [
        F.bit_xor(F.when(F.col("parts").bitwiseAND(F.lit(1 << n)) != 0, F.col("id")).otherwise(F.lit(0))).alias(f"s{n}")
        for n in range(len(SLOTS))
    ]
    hashed = matched.groupBy(*keys).agg(F.count("id").alias("n_terms"), *sums)
    slots = F.array(*[
        F.when(F.col("n_terms") == 0, F.col("whole")).otherwise(F.col(f"s{n}")) for n in range(len(SLOTS))
    ])
    printed = hashed.select(*keys, slots.alias("slots"))
    both = Window.partitionBy("range", "place").orderBy("version")
    pairs = printed.withColumn("edited_slots", F.lead("slots").over(both)).where("version = 0")
    line = Window.partitionBy("range").orderBy("place")
    lone = F.coalesce(F.lead("slots").over(line), F.col("slots"))
    nexts = pairs.withColumn("next_slots", lone).where(~F.col("extra"))
    compared = nexts.withColumns({"to_edited": _compared("slots", "edited_slots"), "to_next": _compared("slots", "next_slots")})
    return compared.select(
        "doc_id", "n_chars", "edited_sha256", _printed("slots").alias("fingerprint"),
        _printed("edited_slots").alias("edited_fingerprint"), _likeness("to_edited").alias("near_edited"),
        _likeness("to_next").alias("near_next"),
    )


def _printed(slots: str) -> Column:
    digits = F.transform(slots, lambda s: F.lpad(F.lower(F.hex(F.shiftrightunsigned(s, 32))), 8, "0"))
    return F.array_join(digits, "")


def _compared(left: str, right: str) -> Column:
    """Per density, how many parts either text uses and in how many of them the hashes are equal."""
    pairs = F.zip_with(left, right, lambda a, b: F.struct(
        F.when((a != 0) | (b != 0), 1).otherwise(0).alias("used"), F.when((a != 0) & (a == b), 1).otherwise(0).alias("equal")
    ))
    levels = F.array(*[F.lit(level) for level in range(len(DENSITIES))])

    def at(level: Column) -> Column:
        part = F.slice(pairs, level * PARTS + 1, F.lit(PARTS))
        return F.struct(*[
            F.aggregate(part, F.lit(0), lambda t, p: t + p[field]).alias(field) for field in ("used", "equal")
        ])

    return F.transform(levels, at)


def _likeness(levels: str) -> Column:
    """Share of equal hashes among the parts used by either text, at the densities that tell most."""
    def share(first: int, count: int) -> Column:
        used, equal = (
            sum((F.get(levels, F.lit(i))[field] for i in range(first + 1, first + count)), F.get(levels, F.lit(first))[field])
            for field in ("used", "equal")
        )
        return equal / F.nullif(used, F.lit(0))

    chosen = share(0, len(DENSITIES))
    for level in range(1, len(DENSITIES)):
        chosen = F.when(F.get(levels, F.lit(level))["used"] >= PARTS - 1, share(level - 1, 2)).otherwise(chosen)
    return F.coalesce(chosen, F.lit(0.0))
