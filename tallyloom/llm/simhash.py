"""SimHash near-duplicates, found by fuzzy hashing with the Golay code.

A fingerprint of 64 bits is cut into three segments. Of two fingerprints that differ in two bits or fewer, some segment is
equal (pigeonhole), and the segment after it differs in two bits or fewer. So each fingerprint gets the keys (equal
segment, Golay index of the next): fingerprints that link share a key of about 34 bits, and chance meetings are rare.
Fingerprints that share a key are joined and verified bit by bit.

A group of near copies can put very many fingerprints under one key. Beyond ``PAIR_BUCKET`` members a bucket isn't paired
up: its members are joined through the words that lie within one bit of them. Two fingerprints differ in two bits or fewer
exactly when they have such a word in common, and a word has at most 65 members, so this is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import golay
from tallyloom.llm.components import connected_components
from tallyloom.session import materialise

BITS, DISTANCE, SEED = 64, 2, 42
#: Members up to which a bucket is joined with itself.
PAIR_BUCKET = 16
#: Lowest bit and width of each segment.
SEGMENTS = [(0, 22), (22, 21), (43, 21)]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a whole text: bit i is set if it is set in over half of the hashes of its shingles.

    Words are runs of anything but ASCII white space, A-Z in lower case. Repeated shingles count each time; a text of fewer
    words is one shingle; no word gives zero. Works through the text in blocks of shingles, so a very long text needs no
    more memory than its words.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    span = min(shingle, len(words))
    first, last = starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist()
    digest, block, counts = xxhash.xxh64_intdigest, 1 << 14, np.zeros(BITS, np.int64)
    for at in range(0, len(first), block):
        hashes = [digest(flat[a:b], SEED) for a, b in zip(first[at : at + block], last[at : at + block])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    over = np.packbits((2 * counts > len(first)).astype(np.uint8), bitorder="little")
    return int(over.view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint as a signed long) for each row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            prints = np.array([fingerprint(texts[i].as_py(), shingle) for i in range(len(texts))], dtype=np.uint64)
            yield pa.record_batch({"id": batch.column(0), "fp": pa.array(prints.view(np.int64))})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def bucket_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every key of each fingerprint: segment number, its bits, and a Golay index of the segment that follows."""
    for batch in batches:
        signed = batch.column(0).to_numpy(zero_copy_only=False)
        prints = signed.view(np.uint64)
        parts = [((prints >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
        for k, part in enumerate(parts):
            near = golay.shared_keys(parts[(k + 1) % len(parts)])
            row, column = np.nonzero(near >= 0)
            keys = (k << 40) | (part[row] << 12) | near[row, column]
            yield pa.record_batch({"key": pa.array(keys), "fp": pa.array(signed[row])})


def links_between(nodes: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that connect all fingerprints (column ``fp``, distinct) within ``DISTANCE`` bits of each other.

    Every link is verified. Each such pair is linked itself or, in a large bucket, through the smallest member of a word
    that both have in common.
    """
    keys = nodes.select("fp").mapInArrow(bucket_keys, "key bigint, fp bigint")
    keys = materialise(keys, "simhash-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = materialise(keys.join(sizes, "key"), "simhash-buckets")

    small = members.where(F.col("members") <= PAIR_BUCKET)
    left = small.select("key", F.col("fp").alias("a"))
    right = small.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, "key").where("a > b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)

    large = members.where(F.col("members") > PAIR_BUCKET).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(BITS)])
    near = large.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("word"), "fp")
    stars = near.groupBy("word").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("around")).where(F.size("around") > 1)
    stars = stars.select(F.explode("around").alias("a"), "b").where("a > b")
    return pairs.select("a", "b").unionByName(stars).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id``, ``fp`` (signed long) and ``component_id`` for each row of ``df``.

    Rows link when their fingerprints differ in ``DISTANCE`` bits or fewer; ``component_id`` is the smallest id that can be
    reached over links, the row's own included. Equal fingerprints become one node before anything is joined. Empty and null
    texts have fingerprint zero and link like any other. Repeated rows each give a row. A null id never is the
    smallest, unless the component has no other. Other columns are ignored.
    """
    prints = materialise(fingerprints(df, id_col, text_col, shingle), "simhash-prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-nodes")
    parts = connected_components(links_between(nodes), "simhash-links")
    labelled = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labelled = labelled.join(least, "component").select("fp", "component_id")
    return prints.join(labelled, "fp").select("id", "fp", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``df`` without those that have a smaller id in their component; all columns.

    Rows under one id stay or go together; rows without an id stay.
    """
    found = near_duplicates(df, id_col, text_col, shingle).where(F.col("id") != F.col("component_id"))
    gone = found.select(F.col("id").alias(id_col)).distinct()
    return df.join(gone, id_col, "left_anti").select([f"`{c}`" for c in df.columns])
