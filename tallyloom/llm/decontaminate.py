"""Benchmark decontamination by size-partitioned MinHash containment search. DataFrame functions only.

Items are partitioned by their number of shingles. An item's sketch is the bottom of its shingles' hash values, as many as a
document may lack without falling under the containment threshold, and one more: a document that contains the item has
one of them (no item is missed, however long the document is). Documents are looked up by the hashes of their
shingles; each (document, item) found is verified by counting the item's shingles in the document, word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import materialise

SHINGLE = 5
#: Percentage of an item's distinct shingles that a document must have.
CONTAINMENT = 80
#: Sizes of items double from partition to partition.
SIZE_CLASSES = 40
#: Up to so many hashes or shingles (of 8 to some 100 bytes) are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 200_000

#: ASCII but letters and digits.
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text in lower case: what stands between ASCII white space, punctuation and symbols."""
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _BREAK, " "))
    return F.when(F.length(bare) > 0, F.split(bare, " ")).otherwise(F.array().cast("array<string>"))


def _shifted(words: Column) -> Column:
    """An element for each shingle: its words as a structure. Fewer words than a shingle: the whole sequence, with nulls."""
    count = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))
    return F.arrays_zip(*[F.slice(words, k + 1, count) for k in range(SHINGLE)])


def _each_shingle(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each shingle of each row's ``words``: the kept columns and ``w0`` to ``w4``."""
    shingles = df.where(F.size("words") > 0).select(*keep, F.inline(_shifted(F.col("words"))))
    return shingles.toDF(*keep, *[f"w{k}" for k in range(SHINGLE)])


def _hash() -> Column:
    return F.xxhash64(*[f"w{k}" for k in range(SHINGLE)])


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_sketches(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All distinct shingles of the items (``item``, ``n_shingles``, words) and the hashes of their sketches (``hash``, ``item``)."""
    shingles = _each_shingle(items, "item").distinct()
    sizes = shingles.groupBy("item").agg(F.count(F.lit(1)).alias("n_shingles"))
    shingles = materialise(shingles.join(sizes, "item"), "benchmark-shingles")
    # The largest size of the item's partition sets the depth of the sketch.
    hashes = shingles.select("item", "n_shingles", _hash().alias("hash"))
    upper = F.lit(1).cast("long")
    for k in range(1, SIZE_CLASSES):
        upper = F.when(F.col("n_shingles") >= (1 << k), F.lit((1 << (k + 1)) - 1)).otherwise(upper)
    depth = F.floor(upper * (100 - CONTAINMENT) / 100) + 1
    bottom = hashes.groupBy("item").agg(
        F.slice(F.array_sort(F.collect_set("hash")), F.lit(1), F.first(depth).cast("int")).alias("sketch")
    )
    return shingles, bottom.select("item", F.explode("sketch").alias("hash"))


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``id``, ``item``, ``n_found`` and ``n_shingles`` for each document that contains an item.

    * A document contains an item when it has ``CONTAINMENT`` per cent of the item's distinct shingles of ``SHINGLE``
      words, or more, anywhere. A text of fewer words is one shingle of all its words.
    * Items and documents without a word match nothing. Rows under one id count as one document or item. Rows without an
      id match nothing. Other columns are ignored; an empty side gives an empty result.
    """
    items = benchmark.where(F.col(item_col).isNotNull())
    items = items.select(F.col(item_col).alias("item"), words_of(F.col(item_text_col)).alias("words"))
    shingles, sketches = item_sketches(items)
    docs = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))

    hashes = _each_shingle(docs, "id").select("id", _hash().alias("hash"))
    candidates = hashes.join(_sent(sketches), "hash").select("id", "item").distinct()
    candidates = materialise(candidates, "benchmark-candidates")

    # Only documents with a candidate are cut up again; here words are compared, not hashes.
    words = [f"w{k}" for k in range(SHINGLE)]
    again = _each_shingle(docs.join(candidates.select("id").distinct(), "id", "left_semi"), "id")
    same = [again[w].eqNullSafe(shingles[w]) for w in words]
    on = _hash_of(again) == _hash_of(shingles)
    for condition in same:
        on = on & condition
    found = again.join(_sent(shingles), on).select("id", "item", "n_shingles", *[again[w] for w in words])
    counted = found.distinct().groupBy("id", "item").agg(
        F.count(F.lit(1)).alias("n_found"), F.first("n_shingles").alias("n_shingles")
    )
    confirmed = counted.where(F.col("n_found") * 100 >= F.col("n_shingles") * CONTAINMENT)
    return confirmed.join(candidates, ["id", "item"], "left_semi")


def _hash_of(df: DataFrame) -> Column:
    return F.xxhash64(*[df[f"w{k}"] for k in range(SHINGLE)])


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that contain no item, all columns unchanged. Rows without an id stay."""
    gone = contaminated(documents, benchmark, id_col, text_col).select(F.col("id").alias(id_col)).distinct()
    return documents.join(gone, id_col, "left_anti").select([f"`{c}`" for c in documents.columns])
