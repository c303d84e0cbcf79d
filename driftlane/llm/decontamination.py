"""Benchmark decontamination by a distributed positional inverted index.

Postings of the training text are (word, neighbours, document, position). Per window of
a benchmark item only the postings of its rarest phrase are read; each gives the place
where the item would have to lie in the document ("offset-adjusted"). There, the
postings of all the window's words are intersected, by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlane.llm.common import row_key, word_count, words
from driftlane.session import materialise

#: Words of the phrase by which postings are looked up.
PHRASE = 3


def _positions(rows: DataFrame, key: str, neighbours: int = 0) -> DataFrame:
    """``key, pos, w0, w1, ..``: each word with the words after it (null past the end)."""
    columns = [F.col("words").alias("w0")] + [
        F.slice("words", F.lit(i + 1), F.greatest(F.size("words") - i, F.lit(0))).alias(f"w{i}")
        for i in range(1, neighbours + 1)
    ]
    zipped = F.arrays_zip(*columns) if neighbours else F.transform("words", lambda w: F.struct(w.alias("w0")))
    return rows.select(key, F.posexplode(zipped).alias("pos", "at")).select(key, "pos", "at.*")


def _length(item_words: Column | str, window: int) -> Column:
    return F.least(F.size(item_words), F.lit(window))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id", item_column: str = "item_id"
) -> DataFrame:
    """One row per document: ``doc_id, key, n_words, n_hit, n_items, items, contaminated``.

    ``items`` are the ids of the items of which a window occurs, sorted as text.
    A window is ``window`` consecutive words of an item, or a shorter item as a whole.

    Null or empty text has no words, is never hit and as an item never occurs. A null
    item id counts as the empty text. Repeated documents each get the same row,
    repeated items count once. Other columns are not read. Empty tables give no hits.
    """
    key = row_key(F.col(id_column), F.col("text"))
    sizes = docs.select(F.col(id_column).alias("doc_id"), key.alias("key"), word_count(F.col("text")).alias("n_words"))
    items = materialise(benchmark.select(
        F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words")
    ).where(F.size("words") > 0).groupBy("words").agg(F.collect_set("item").alias("ids"))
        .withColumn("item", F.xxhash64("words")))
    texts = docs.select(key.alias("key"), "text")
    tokens = texts.select("key", words(F.col("text")).alias("words"))

    item_words = _positions(items, "item").withColumnRenamed("pos", "q")
    counted = _positions(tokens, "key").join(item_words.select("w0").distinct(), "w0").groupBy("w0").agg(
        F.count("*").alias("frequency")
    )
    frequency = materialise(counted)
    found = materialise(_candidates(tokens, items, item_words, frequency, window))
    hits = materialise(_verified(texts, items, item_words, found, window))

    places = hits.select("key", F.explode(F.sequence("first", "last")).alias("pos")).distinct()
    by_document = places.groupBy("key").agg(F.count("*").alias("n_hit"))
    named = hits.select("key", "item").distinct().join(items.select("item", F.explode("ids").alias("id")), "item")
    by_item = named.groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("items"))
    return sizes.join(by_document.join(by_item, "key"), "key", "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _candidates(
    tokens: DataFrame, items: DataFrame, item_words: DataFrame, frequency: DataFrame, window: int
) -> DataFrame:
    """``key, item, shift, q``: where the rarest phrase of a window lies, item position + shift in the document."""
    sized = items.select("item", _length("words", window).alias("need"), F.size("words").alias("n_item"))
    rated = item_words.join(frequency, "w0", "left").join(sized, "item")
    # Words of a phrase: up to three, within the window.
    span = F.least(F.lit(PHRASE), F.col("need"))
    onward = Window.partitionBy("item").orderBy("q")
    phrase = rated.withColumns({
        "w1": F.when(span > 1, F.lead("w0", 1).over(onward)), "w2": F.when(span > 2, F.lead("w0", 2).over(onward)),
        "span": span,
        "rarity": F.min(F.coalesce("frequency", F.lit(0))).over(onward.rowsBetween(0, PHRASE - 1)),
    }).where(F.col("q") + F.col("span") <= F.col("n_item"))
    # The rarest phrase within each window that begins at q; it may begin at q .. q + need - span.
    reach = window - PHRASE
    best = phrase.withColumn(
        "seed", F.min(F.struct("rarity", "q", "w0", "w1", "w2")).over(onward.rowsBetween(0, reach))
    ).where(F.col("q") + F.col("need") <= F.col("n_item"))
    seeds = best.where(F.col("seed.rarity") > 0).select(
        "item", "span", F.col("seed.q").alias("q"), "seed.w0", "seed.w1", "seed.w2"
    ).distinct()
    seeds = materialise(seeds)
    postings = _positions(tokens, "key", PHRASE - 1)
    found = postings.join(seeds.where("span = 3"), ["w0", "w1", "w2"])
    shorter = {
        size: postings.join(seeds.where(F.col("span") == size).drop(*["w1", "w2"][size - 1 :]), ["w0", "w1"][:size])
        for size in (1, 2)
    }
    wanted = ["key", "item", "q", (F.col("pos") - F.col("q")).alias("shift")]
    result = found.select(*wanted)
    for row in seeds.where("span < 3").select("span").distinct().collect():  # at most two rows
        result = result.unionByName(shorter[row["span"]].select(*wanted))
    return result.distinct()


def _verified(
    texts: DataFrame, items: DataFrame, item_words: DataFrame, found: DataFrame, window: int
) -> DataFrame:
    """``key, item, first, last``: runs of document words equal to item words, a window long at least."""
    around = F.sequence(F.greatest(F.col("q") - (window - 1), F.lit(0)), F.col("q") + (window - 1))
    expected = found.select("key", "item", "shift", F.explode(around).alias("q")).distinct().join(
        item_words, ["item", "q"]
    ).withColumn("pos", F.col("q") + F.col("shift"))
    # Documents with a candidate grow with the corpus: always merged, never broadcast.
    holders = found.select("key").distinct().hint("merge")
    held = texts.join(holders, "key", "left_semi").dropDuplicates(["key"])
    postings = _positions(held.select("key", words(F.col("text")).alias("words")), "key")
    met = postings.join(expected, ["key", "pos", "w0"]).select("key", "item", "shift", "pos")
    order = Window.partitionBy("key", "item", "shift").orderBy("pos")
    runs = met.withColumn("run", F.col("pos") - F.row_number().over(order)).groupBy("key", "item", "shift", "run").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    need = items.select("item", _length("words", window).alias("need"))
    return runs.join(need, "item").where(F.col("last") - F.col("first") + 1 >= F.col("need")).select(
        "key", "item", "first", "last"
    )
