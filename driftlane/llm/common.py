"""What the operators of this subpackage share: words, row keys and table schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TABLES = {
    "documents": DOCUMENTS,
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of lower-cased text, and a word of text as it is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z, other letters stay; text without other letters takes the quick way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The lower-cased words in order; null text has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(ANY_CASE_WORD)).cast("bigint")


def row_key(id_column: Column, text: Column) -> Column:
    """Same id and same text, same key: repeated rows share it, and so share their result."""
    return F.concat_ws(":", id_column.cast("string"), F.hex(F.xxhash64(text)), F.hex(F.xxhash64(text, F.lit(1))))


def one_per_key(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows, without repeated keys if there are any, so that a join by the keys doesn't multiply.

    Where all keys are different, as ids are made to be, texts needn't be moved for it.
    """
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return rows if repeated.isEmpty() else rows.dropDuplicates(list(keys))
