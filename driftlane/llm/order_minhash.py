"""Near-duplicate documents by order MinHash.

A sketch takes the two least shingles of a text by a random order, repeats told apart
by their number, and keeps which came first; so it is sensitive to order, as edits are,
where a plain minimum isn't. Texts that agree in three sketches of a band become
candidates of the leader of their bucket, not of each other, and candidates are
verified by banded alignment. Texts of buckets that aren't all connected then meet by
their rarest shingles, of which similar texts must share one, until no such bucket holds
a pair that is neither connected nor looked at. Linked texts form classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.llm import sketches
from driftlane.llm.common import one_per_key, row_key
from driftlane.llm.suffixes import CHUNK
from driftlane.session import materialise

#: Sketches lie in a square; half rows and half columns of it are the bands.
SIDE = 6
COUNT = SIDE * SIDE
BANDS = [
    cells for i in range(SIDE) for half in (range(3), range(3, 6))
    for cells in (tuple(SIDE * i + j for j in half), tuple(SIDE * j + i for j in half))
]
#: Rounds in which a bucket that isn't all connected gets a leader of its own, before its texts meet by rare shingles.
ROUNDS = 0
#: Bits of a text's map: each says whether an odd number of its shingles has that hash.
BITS = 1024

#: Bytes of text that a task makes shingles of at once; a text beyond it is taken alone.
PART = CHUNK // 4
#: Ratio of the longest to the shortest text of a range of lengths.
LENGTHS = 1.03
#: Rows of hashes and labels that one task groups and joins without a shuffle; tables of more rows are dealt out.
FEW = 100_000

_SKETCHED = "doc_id bigint, key string, th bigint, node binary, sketch array<bigint>, made bigint, bits array<bigint>"


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of about ``PART`` bytes of text, with their texts."""
    lengths = pc.binary_length(batch["text"]).to_pylist()
    begin = 0
    while begin < len(lengths):
        end, total = begin, 0
        while end < len(lengths) and (end == begin or total + lengths[end] < PART):
            total += lengths[end] + 1
            end += 1
        part = batch.slice(begin, end - begin)
        yield part, part["text"].to_pylist()
        begin = end


def _lists(rows: np.ndarray, of: np.ndarray) -> pa.Array:
    """A list for each of ``of``: the next of ``rows`` where it is true, else an empty one."""
    ends = np.cumsum(np.where(of, rows.shape[1], 0))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(rows.ravel(), pa.int64()))


def _sketched(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _chunks(batch):
                yield _sketch_rows(part, texts, size)

    return rows


def _sketch_rows(batch: pa.RecordBatch, texts: list[bytes], size: int) -> pa.RecordBatch:
    words, counts = sketches.word_hashes(texts)
    shingles, made = sketches.shingle_hashes(words, counts, size)
    owner = np.repeat(np.arange(len(texts)), made)
    labelled = sketches.occurrence_labelled(shingles, owner)
    found = sketches.order_sketches(labelled, made, COUNT) if len(shingles) else np.zeros((0, COUNT), np.int64)
    ends = np.cumsum(counts)
    nodes = [sketches.content_key(words[e - c : e]) for e, c in zip(ends, counts)]
    bits = _lists(sketches.parity_bits(labelled, owner, len(texts), BITS), np.ones(len(texts), bool))
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"], batch["key"], batch["th"], pa.array(nodes, pa.binary()), _lists(found, made > 0),
         pa.array(made, pa.int64()), bits],
        names=["doc_id", "key", "th", "node", "sketch", "made", "bits"],
    )


def _labelled_shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles with repeats told apart, their texts, and how many each text has."""
    shingles, made = sketches.shingle_hashes(*sketches.word_hashes(texts), size)
    owner = np.repeat(np.arange(len(texts)), made)
    return sketches.occurrence_labelled(shingles, owner), owner, made


def _shingled(size: int):
    """``node, shingle, made``: every shingle of a text, and how many it has."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _chunks(batch):
                labelled, owner, made = _labelled_shingles(texts, size)
                yield pa.RecordBatch.from_arrays(
                    [part["node"].take(pa.array(owner)), pa.array(labelled.view(np.int64)), pa.array(made[owner])],
                    names=["node", "shingle", "made"],
                )

    return rows


def _verified(size: int, least: float):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for one, other in zip(batch["text"], batch["other_text"]):
                words, counts = sketches.word_hashes([one.as_py(), other.as_py()])
                shingles, made = sketches.shingle_hashes(words, counts, size)
                scores.append(sketches.shared_in_order(shingles[: made[0]], shingles[made[0] :], least))
            yield pa.RecordBatch.from_arrays(
                [batch["a"], batch["b"], pa.array(scores, pa.float64())], names=["a", "b", "similarity"]
            )

    return pairs


def _may_be_similar(one: str, other: str, least: float) -> Column:
    """Whether two texts can be similar, by their maps: it is never false for texts that are.

    Of n and m shingles similar texts share ``least / (1 + least) * (n + m)`` at least, which
    bounds how many only one of them has. Each bit that differs takes one of those.
    """
    differing = F.lit(0)
    for i in range(BITS // 64):
        differing = differing + F.bit_count(F.get(f"{one}.bits", F.lit(i)).bitwiseXOR(F.get(f"{other}.bits", F.lit(i))))
    return differing <= (F.col(f"{one}.made") + F.col(f"{other}.made")) * ((1 - least) / (1 + least)) + 1e-6


def _pairs(members: DataFrame, maps: DataFrame, least: float, seed: int, leaders: int, own_of_bucket: bool) -> tuple[DataFrame, DataFrame]:
    """Members of open buckets with leaders they aren't connected with and may be similar to, ``a < b``, and the members that don't lead.

    ``members`` has ``bucket, node, label``, ``maps`` each node's ``made`` and ``bits``. ``leaders`` rows per member, about, however
    large the bucket. The first leader has the least hash of the node, the same in all
    buckets of a group, or of (bucket, node), so that buckets of the same members have
    different ones. A leader has met all of its bucket and need not stay.
    """
    mark = F.xxhash64("bucket", "node", F.lit(seed)) if own_of_bucket else F.xxhash64("node", F.lit(seed))
    n = members.count()
    marked = _together(members, n).withColumn("mark", mark)
    first = _together(_few(marked.groupBy("bucket").agg(F.count("*").alias("n"), F.min("mark").alias("least")), n), n)
    leads = (F.col("mark") == F.col("least")) | (F.pmod("mark", "n") < leaders - 1)
    shared = _few(marked.join(first, "bucket").select("bucket", "node", "label", leads.alias("leads")).join(maps, "node"), n, 5_000)
    one, other = shared.alias("s"), shared.where("leads").alias("c")
    apart = (F.col("s.bucket") == F.col("c.bucket")) & (F.col("s.label") != F.col("c.label")) & _may_be_similar("s", "c", least)
    pairs = one.join(other, apart).select(
        F.least("s.node", "c.node").alias("a"), F.greatest("s.node", "c.node").alias("b")
    ).distinct()
    return pairs, shared.where("not leads").select("bucket", "node")


def _few(df: DataFrame, rows: int, per_file: int = 50_000) -> DataFrame:
    """Stored in as many files as ``rows``, the most that it can have, ask for: late rounds are small and shouldn't fill folders."""
    return materialise(df.coalesce(1 + rows // per_file))


def _together(stored: DataFrame, rows: int) -> DataFrame:
    """As one partition if there are ``FEW`` rows at most: late rounds are small and shouldn't be shuffled."""
    return stored.coalesce(1) if rows <= FEW else stored


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``a, b`` edges: the least node it is connected with.

    Large and small stars in turn: each node's neighbours are hung onto its least
    neighbour, until nothing changes. The number of rounds grows with the logarithm of
    the longest path. Edges stay distributed and are counted by sums.
    """
    n = edges.count()
    turned = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = _few(_together(turned, n).distinct(), n)
    seen = None
    while True:
        current = _together(current, n)
        mark = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        both = _together(current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b"))), n)
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = _together(_few(large, 2 * n), n)
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        hung = large.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        current = _few(_together(hung.unionByName(least.withColumnRenamed("least", "b")), n).distinct(), 2 * n)
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.withColumn("label", F.col("node")))


def _open(members: DataFrame, n: int) -> DataFrame:
    """The members, ``n`` rows, of buckets that hold several classes; of buckets with the same members, those of one."""
    several = members.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("label").alias("one"), F.max("label").alias("other"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    ).where(F.col("one") != F.col("other"))
    different = several.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    return members.join(_together(_few(different.select("bucket"), n), n), "bucket", "left_semi")


def _merged(members: DataFrame, seed: int) -> DataFrame:
    """Buckets with nearly the same members as one: a pair is looked at once, not once in each.

    Buckets are put together if three members of least hash are the same, which has the
    chance of their overlap to the third. What is put together only adds candidates.
    """
    n = members.count()
    members = _together(members, n)
    least = members.groupBy("bucket").agg(
        *[F.min(F.xxhash64("node", F.lit(seed), F.lit(i))).alias(f"m{i}") for i in range(3)]
    ).select("bucket", F.xxhash64("m0", "m1", "m2").alias("merged"))
    return _few(members.join(_together(_few(least, n), n), "bucket").select(F.col("merged").alias("bucket"), "node", "label").distinct(), n)


class _Search:
    """What is known of the texts, their tested pairs and their links so far."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, size: int, least: float) -> None:
        self.rows, self.nodes, self.size, self.least = rows, nodes, size, least
        #: Texts and maps of the nodes in buckets of several: later rounds read these, not the corpus.
        self.texts: DataFrame | None = None
        self.tested: DataFrame | None = None
        self.labels: DataFrame | None = None

    def labelled(self, members: DataFrame, n: int) -> DataFrame:
        """The members, ``n`` rows, with the label of each node's class so far; at first a node is its own."""
        members = _together(members, n)
        if self.labels is None:
            return members.withColumn("label", F.col("node"))
        labels = _together(self.labels, max(n, self.labels.count()))
        return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def opened(self, members: DataFrame) -> DataFrame:
        """The members of buckets that are still open, with their labels."""
        n = members.count()
        return _few(_open(self.labelled(members, n), n), n)

    def links(self) -> DataFrame:
        return self.tested.where(F.col("similarity") >= self.least)

    def examine(self, pairs: DataFrame, most: int) -> None:
        """Align the texts of candidates, about ``most`` rows at most, and connect those that are similar enough."""
        if self.tested is not None:
            pairs = pairs.join(self.tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = _few(pairs, most)
        if pairs.isEmpty():
            if self.tested is None:
                self.connect_none()
            return
        # Candidates grow with the corpus: always merged with the texts, never broadcast.
        texts = self.texts.select("node", "text").hint("merge")
        placed = pairs.join(texts.withColumnRenamed("node", "a"), "a").join(
            texts.select(F.col("node").alias("b"), F.col("text").alias("other_text")).hint("merge"), "b"
        )
        scored = placed.select("a", "b", "text", "other_text").mapInArrow(
            _verified(self.size, self.least), "a binary, b binary, similarity double"
        )
        # Aligning is the work of the tasks that write: few pairs each.
        scored = _few(scored.dropDuplicates(["a", "b"]), pairs.count(), 500)
        n = scored.count()
        found = _together(scored.where(F.col("similarity") >= self.least).select("a", "b"), n)
        if self.labels is None:
            self.tested, self.labels = scored, _few(components(found), 2 * n)
            return
        # Later links connect whole classes: only their labels take part.
        ends = found.withColumn("pair", F.struct("a", "b")).select("pair", F.explode(F.array("a", "b")).alias("node"))
        joined = self.labelled(ends, 2 * n).groupBy("pair").agg(F.min("label").alias("a"), F.max("label").alias("b"))
        n_nodes = self.labels.count() + 2 * n
        labels, merged = (_together(x, n_nodes) for x in (self.labels, _few(components(joined.select("a", "b")), 2 * n)))
        nodes = _together(labels.unionByName(found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(
            labels, "node", "left_anti").withColumn("label", F.col("node"))), n_nodes)
        renamed = merged.select(F.col("node").alias("label"), F.col("label").alias("new_label"))
        self.labels = _few(nodes.join(renamed, "label", "left").select(
            "node", F.coalesce("new_label", "label").alias("label")
        ), n_nodes)
        self.tested = self.tested.unionByName(scored)

    def connect_none(self) -> None:
        """Nothing was a candidate: no pair is tested, every node is a class of its own."""
        spark = self.nodes.sparkSession
        self.tested = spark.createDataFrame([], "a binary, b binary, similarity double")
        self.labels = spark.createDataFrame([], "node binary, label binary")

    def meet(self, members: DataFrame, seed: int, leaders: int = 1, own_of_bucket: bool = True) -> DataFrame | None:
        """One round of leaders in buckets that are still open; the members left, or None if there is no such bucket."""
        held = _merged(self.opened(members), seed)
        if held.isEmpty():
            return None
        if self.texts is None:
            open_nodes = held.select("node").distinct()
            places = self.nodes.join(open_nodes, "node", "left_semi").select("node", "made", "bits", "id", "th").hint("merge")
            self.texts = materialise(places.join(self.rows, ["id", "th"]).select("node", "made", "bits", "text"))
        pairs, rest = _pairs(held, self.texts.select("node", "made", "bits"), self.least, seed, leaders, own_of_bucket)
        self.examine(pairs, leaders * held.count())
        return rest

    def rare_members(self, open_nodes: DataFrame) -> DataFrame:
        """``bucket, node`` of the rarest shingles of some nodes' texts, per range of lengths of the other text.

        Similar texts of n and m shingles share ``least / (1 + least) * (n + m)`` at least, t say.
        So in one order for all texts the first ``n - t + 1`` of the one and ``m - t + 1`` of
        the other can't all be different. The order is by the number of texts that have
        a shingle. Those that no other text has come first and make no bucket: a text
        that has enough of them meets nobody. The lengths that m may have are cut into
        narrow ranges, because t for texts of like length is nearly n: for each range a
        text enters the buckets of its first shingles, and a bucket is of a shingle and
        two ranges, both of which must have texts.
        """
        texts = self.texts.select("node", "text").join(open_nodes, "node", "left_semi")
        rows = materialise(texts.mapInArrow(_shingled(self.size), "node binary, shingle bigint, made bigint"))
        held = materialise(rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"))
        own = Window.partitionBy("node")
        ranked = rows.join(held, "shingle").withColumns({
            "rank": F.row_number().over(own.orderBy("n", "shingle")), "shared": F.count("*").over(own),
        })

        def range_of(length: Column) -> Column:
            return F.floor(F.log(length) / F.log(F.lit(LENGTHS)) + 1e-9)

        made = F.col("made")
        other = F.explode(F.sequence(range_of(made * self.least), range_of(made / self.least))).alias("other")
        placed = ranked.select("node", "shingle", "made", range_of(made).alias("mine"), (made - F.col("shared") + F.col("rank")).alias("place"), other)
        shortest = F.greatest(F.floor(F.pow(F.lit(LENGTHS), F.col("other")) * (1 - 1e-9)), F.ceil(made * self.least - 1e-6))
        needed = F.ceil((made + shortest) * (self.least / (1 + self.least)) - 1e-6)
        low, high = F.least("mine", "other"), F.greatest("mine", "other")
        entered = placed.where(F.col("place") <= made - needed + 1).select(
            F.xxhash64("shingle", low, high).alias("bucket"), "node", F.when(F.col("mine") != F.col("other"), F.col("mine")).alias("side")
        )
        entered = materialise(entered)
        both = entered.groupBy("bucket").agg(F.min("side").alias("one"), F.max("side").alias("two"), F.count("*").alias("n")).where(
            "n > 1 AND (one IS NULL OR one != two)"
        )
        return materialise(entered.join(both.select("bucket"), "bucket", "left_semi").select("bucket", "node"))


def near_duplicates(docs: DataFrame, size: int = 5, least: float = 0.8, id_column: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, class_id, n_class, n_links, key, kept_key``.

    Two texts are linked if the ``size``-word shingles that an alignment matches in
    order are ``least`` of all their shingles at least; classes are what is connected.
    ``class_id`` is the least id of the class, ``n_class`` its documents, and
    ``n_links`` counts the verified links of the document's text to other texts.
    ``key`` is the ``row_key`` of id and text, and ``kept_key`` that of one document of
    the class: of the least id, then the least key; one without id if none has one.

    Words are lower-cased; texts of the same words are one text from the start, texts
    without words too. Texts of fewer words than a shingle are one shingle. Null ids
    are kept, and are the class id only of classes without another. Repeated rows share a class. Very long texts are
    sketched as a whole, in memory of their size. Other columns are not read. An empty
    table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col(id_column).cast("bigint")
    rows = docs.select(
        doc_id.alias("doc_id"), row_key(doc_id, F.col("text")).alias("key"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text")
    )
    sketched = materialise(rows.mapInArrow(_sketched(size), _SKETCHED))
    lowest = F.lit(-(2**63)).cast("bigint")
    nodes = sketched.groupBy("node").agg(
        F.min(F.struct(F.coalesce("doc_id", lowest).alias("id"), "th", "sketch", "made", "bits")).alias("head")
    ).select("node", "head.*")
    nodes = materialise(nodes)
    own = rows.select(F.coalesce("doc_id", lowest).alias("id"), "th", "text")
    search = _Search(one_per_key(own, "id", "th"), nodes, size, least)
    filled = nodes.where(F.size("sketch") > 0)
    members = filled.select("node", F.explode(F.array(*[
        F.xxhash64(F.lit(number), *[F.get("sketch", F.lit(c)) for c in cells]) for number, cells in enumerate(BANDS)
    ])).alias("bucket"))
    members = materialise(members)
    # One leader first: in a group of copies it is the same one in nearly all buckets.
    left = search.meet(members, 0, own_of_bucket=False)
    # Then one of each bucket's own, for members that aren't connected with it.
    for seed in range(1, ROUNDS + 1):
        left = None if left is None else search.meet(left, seed)
    if left is not None:
        # Texts of buckets that are still open meet by rare shingles, with four times the leaders each round, until none is.
        left = search.rare_members(search.opened(left).select("node").distinct())
        leaders, seed = 1, ROUNDS + 1
        while left is not None:
            left = search.meet(left, seed, leaders)
            leaders, seed = 4 * leaders, seed + 1
    if search.tested is None:
        search.connect_none()

    links = search.links()
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(
        F.count("*").alias("n_links")
    )
    placed = sketched.select("doc_id", "key", "node").join(search.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = placed.groupBy("label").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("n_class"),
        F.min(F.struct(F.isnull("doc_id").alias("without"), "doc_id", "key"))["key"].alias("kept_key"),
    )
    return placed.join(classes, "label").join(degree, "node", "left").select(
        "doc_id", "class_id", "n_class", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        "key", "kept_key",
    )
