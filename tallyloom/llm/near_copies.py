"""Near copies by the Jaccard similarity of word shingles: Golay-code keys find candidates, whole shingle sets confirm them.

Two fingerprints of 64 majority bits differ in some ten bits at a similarity of 0.8, too many for keys of two-bit errors. So
the fingerprint here is longer and its bits are steadier: ``SEGMENTS`` segments of 23 bits, each bit taken from the smallest of
the set's hashes under one permutation, so that a bit differs with a probability of (1 - similarity) / 2. Decoding a segment
and its neighbours at one bit gives six codeword indices; segments that differ in two bits or fewer share one. By the pigeonhole
principle the errors can't be many in every segment: at 0.8 one segment has at most two with a probability of 0.59. An index has
12 bits only, so each key adds anchors, the whole minima of two permutations of other segments. Tests and README have the
measured recall: above 0.99 at a similarity of exactly 0.8, and higher above it.

Texts with equal shingle sets become one node. Buckets of up to ``PAIR_BUCKET`` nodes are paired up; pairs whose fingerprints
differ in far more bits than a similarity of 0.8 explains are passed over. In a larger bucket all nodes are first compared with a
few leaders, which settles groups of true copies. What this has not put into one component is joined exactly by the rarest
shingles of each set (``rare_pairs``), never all with all: sets with a similarity of 0.8 have one of their few rarest shingles
in common, and texts that merely share a frame don't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import golay
from tallyloom.llm.components import connected_components
from tallyloom.session import materialise

#: Words of a shingle, and the percentage of shingles in common from which two texts are near copies.
SHINGLE, SIMILARITY = 5, 80
SEGMENTS, SEED = 11, 42
BITS = SEGMENTS * golay.LENGTH
#: Bits in which pairs may differ: the mean at 0.8 and six standard deviations (missed with a probability below 1e-6).
MOST_BITS = 54
#: Nodes up to which a bucket is joined with itself, and leaders of a larger one.
PAIR_BUCKET, LEADERS = 16, 4
#: Shingles that are sent to every worker with their frequencies (16 bytes each): each holds more than this part of all places.
FREQUENT = 1_000_000
#: Hashes that are permuted at a time, and documents that are worked on and leave Python at a time.
BLOCK, DOCUMENTS_OUT = 1 << 10, 256

_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (3, BITS, 1), dtype=np.uint64)
_FLIP, _FACTOR = _MIX[0], _MIX[1] | np.uint64(1)
_STIR = _MIX[2, : SEGMENTS + 2, 0] | np.uint64(1)
_WORDS = ["f0", "f1", "f2", "f3"]


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted.

    Words are runs of anything but ASCII white space, A-Z in lower case. A text of fewer words is one shingle; no word, no shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    span, digest = min(SHINGLE, len(words)), xxhash.xxh64_intdigest
    hashes = [digest(flat[a:b], SEED) for a, b in zip(starts, ends[span - 1 :].tolist())]
    return np.unique(np.array(hashes, np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest of a set's hashes under each permutation."""
    least = np.full(BITS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, ((hashes[None, at : at + BLOCK] ^ _FLIP) * _FACTOR).min(axis=1), out=least)
    return least


def golay_keys(least: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For rows of minima: the different keys of each, as signed numbers, and the fingerprints as four signed longs.

    A bit of the fingerprint is one from the upper half of the minimum, stirred, as products leave the lowest bits weak.
    """
    n = len(least)
    bits = ((least * _STIR[0]) >> np.uint64(63)).astype(np.uint8)
    segments = (bits.reshape(n, SEGMENTS, golay.LENGTH) * (1 << np.arange(golay.LENGTH))).sum(axis=2)
    near = golay.shared_keys(segments.reshape(-1)).reshape(n, SEGMENTS, -1)
    whole = least.reshape(n, SEGMENTS, golay.LENGTH)[:, :, 0]
    anchors = np.roll(whole, -1, axis=1) * _STIR[3] ^ np.roll(whole, -2, axis=1)
    stirred = (anchors[:, :, None] ^ _STIR[2:, None]) * _STIR[1] + near.astype(np.uint64) * _STIR[0]
    keys = ((stirred ^ (stirred >> np.uint64(31))) * _STIR[2]).view(np.int64)
    padded = np.zeros((n, 256), np.uint8)
    padded[:, :BITS] = bits
    return [keys[i][near[i] >= 0] for i in range(n)], np.packbits(padded, axis=1).view(np.int64)


def _prints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``version`` (hash of the text), ``node`` (hash of the shingle set), ``keys`` and the fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS_OUT):
                batch = whole.slice(at, DOCUMENTS_OUT)
                texts, nodes, least, empty = batch.column(2), [], [], []
                for i in range(len(texts)):
                    hashes = shingle_set(texts[i].as_py())
                    nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                    least.append(minima(hashes))
                    empty.append(not len(hashes))
                keys, prints = golay_keys(np.stack(least))
                columns = {
                    "id": batch.column(0),
                    "version": batch.column(1),
                    "node": pa.array(np.array(nodes, np.uint64).view(np.int64)),
                    "keys": pa.array([k[:0] if none else k for k, none in zip(keys, empty)], pa.list_(pa.int64())),
                }
                yield pa.record_batch(columns | {w: pa.array(prints[:, k]) for k, w in enumerate(_WORDS)})
        pa.default_memory_pool().release_unused()

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("version"), F.col(text_col).alias("text"))
    words = ", ".join(f"{w} bigint" for w in _WORDS)
    return rows.mapInArrow(run, f"id {kind}, version bigint, node bigint, keys array<bigint>, {words}")


def _sets(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """``node`` and ``hashes`` (its sorted shingle set) of the wanted nodes (``node``, ``id``, ``version``)."""
    rows = df.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("of"), F.col(text_col).alias("text"))
    rows = rows.join(wanted, rows.doc.eqNullSafe(wanted.id) & (rows.of == wanted.version)).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS_OUT):
                batch = whole.slice(at, DOCUMENTS_OUT)
                sets = [shingle_set(x.as_py()).view(np.int64) for x in batch.column(1)]
                yield pa.record_batch({"node": batch.column(0), "hashes": pa.array(sets, pa.list_(pa.int64()))})
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, "node bigint, hashes array<bigint>").dropDuplicates(["node"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` whose shingle sets reach ``SIMILARITY``."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    x, y, both = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
    # Sets too unequal in size can't reach it.
    fits = F.least(x, y) * 100 >= F.greatest(x, y) * SIMILARITY
    alike = both.cast("bigint") * 100 >= (x + y - both).cast("bigint") * SIMILARITY
    return pairs.join(left, "a").join(right, "b").where(fits).where(alike).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _rows_of(nodes: DataFrame, wanted: DataFrame, *names: str) -> DataFrame:
    """``node``, ``id`` and ``version`` of the nodes in the named columns."""
    listed = wanted.select(F.explode(F.array(*names)).alias("node")).distinct()
    return nodes.join(listed, "node", "left_semi").select("node", "row.*")


def _side(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (key, node, fingerprint) as one side of a join: the node as ``name``, the words of the fingerprint likewise."""
    return rows.select("key", F.col("node").alias(name), *[F.col(w).alias(f"{name}_{w}") for w in _WORDS])


def _close(a: str, b: str) -> Column:
    """Whether the fingerprints of two sides leave a similarity of ``SIMILARITY`` possible."""
    differ = sum((F.bit_count(F.col(f"{a}_{w}").bitwiseXOR(F.col(f"{b}_{w}"))) for w in _WORDS), F.lit(0))
    return differ <= MOST_BITS


def rare_pairs(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` of different ``part`` that may have a similarity of ``SIMILARITY``, none missed, few too many.

    Shingles are ordered by how many of the sets hold them, the most frequent ones, at most ``FREQUENT``, behind all others; any
    order is right, this one has short lists. A set of n shingles that reaches the similarity t with one no
    larger has one of its first n - ceil(t n) + 1 shingles in common with it, and that is one of the first
    m - ceil(2 t m / (1 + t)) + 1 of the smaller set. Sizes and the places of the common shingle bound the overlap further. Under
    a shingle whose holders are of one part nothing is joined; under others, those outside its largest part meet all.
    """
    spark, t = sets.sparkSession, SIMILARITY
    held = sets.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    held = materialise(held.where("df > 1"), "copies-held")
    total = held.agg(F.sum("df").alias("n")).head()["n"] or 0
    frequent = held.where(F.col("df") * FREQUENT > total).orderBy("h").toPandas()
    known = spark.sparkContext.broadcast((frequent["h"].to_numpy(np.int64), frequent["df"].to_numpy(np.int64)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, df = known.value
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS_OUT):
                batch = whole.slice(at, DOCUMENTS_OUT)
                out: list[tuple[int, int, np.ndarray]] = []
                for k in range(batch.num_rows):
                    hashes = np.asarray(batch.column(2)[k].values.to_numpy(zero_copy_only=False))
                    n = len(hashes)
                    place = np.minimum(np.searchsorted(listed, hashes), max(len(listed) - 1, 0))
                    often = np.where(listed[place] == hashes, df[place], 0) if len(listed) else np.zeros(n, np.int64)
                    probe = n - -(-t * n // 100) + 1
                    out.append((k, n, hashes[np.lexsort([hashes, often])][:probe]))
                rows = np.repeat([k for k, _, _ in out], [len(h) for _, _, h in out])
                n = np.repeat([n for _, n, _ in out], [len(h) for _, _, h in out])
                i = np.concatenate([np.arange(len(h)) for _, _, h in out])
                taken = pa.array(rows, pa.int64())
                yield pa.record_batch(
                    {
                        "node": batch.column(0).take(taken),
                        "part": batch.column(1).take(taken),
                        "n": pa.array(n, pa.int64()),
                        "i": pa.array(i, pa.int64()),
                        "indexed": pa.array(i < n - -(-2 * t * n // (100 + t)) + 1),
                        "h": pa.array(np.concatenate([h for _, _, h in out]), pa.int64()),
                    }
                )

    posts = sets.join(parts, "node").select("node", "part", "hashes")
    posts = materialise(posts.mapInArrow(first, "node bigint, part bigint, n bigint, i bigint, indexed boolean, h bigint"), "copies-posts")
    sizes = posts.groupBy("h", "part").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("h").agg(F.max_by("part", F.struct("c", "part")).alias("most"), F.count(F.lit(1)).alias("n_parts"))
    posts = materialise(posts.join(sizes.where("n_parts > 1"), "h"), "copies-mixed")

    def side(name: str, test: str) -> DataFrame:
        return posts.where(test).select("h", *[F.col(c).alias(f"{name}_{c}") for c in ("node", "part", "n", "i")])

    need = F.expr(f"({t} * (a_n + b_n) + {99 + t}) div {100 + t}")
    fits = (
        (F.col("a_part") != F.col("b_part"))
        & (F.struct("b_n", "b_node") < F.struct("a_n", "a_node"))
        & (F.col("b_n") * 100 >= F.col("a_n") * t)
        & (F.least(F.col("a_n") - F.col("a_i"), F.col("b_n") - F.col("b_i")) >= need)
    )
    from_a = side("a", "part <> most").join(side("b", "indexed"), "h").where(fits)
    from_b = side("a", "part = most").join(side("b", "indexed AND part <> most"), "h").where(fits)
    return _ordered(from_a.unionByName(from_b).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``node`` and ``component_id`` for each row of ``df``.

    Rows link when their shingle sets have a Jaccard similarity of ``SIMILARITY`` per cent or more; ``component_id`` is the
    smallest id that can be reached over links, the row's own included. Empty and null texts link with each other only. Repeated
    rows each give a row. A null id never is the smallest, unless the component has no other. Other columns are ignored.
    """
    prints = materialise(_prints(df, id_col, text_col), "copies-prints")
    nodes = prints.groupBy("node").agg(
        F.min("id").alias("first_id"),
        F.min(F.struct("id", "version")).alias("row"),
        F.first(F.struct("keys", *_WORDS)).alias("print"),
    )
    nodes = materialise(nodes.select("node", "first_id", "row", "print.*"), "copies-nodes")
    keys = nodes.select("node", *_WORDS, F.explode("keys").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = materialise(keys.join(sizes, "key"), "copies-buckets")

    small = members.where(F.col("members") <= PAIR_BUCKET)
    pairs = _side(small, "a").join(_side(small, "b"), "key").where(F.col("a") > F.col("b")).where(_close("a", "b"))
    large = members.where(F.col("members") > PAIR_BUCKET)
    leaders = large.groupBy("key", F.pmod("node", F.lit(LEADERS)).alias("slot")).agg(F.min(F.struct("node", *_WORDS)).alias("lead"))
    led = _side(large, "a").join(_side(leaders.select("key", "lead.*"), "b"), "key").where(_close("a", "b"))
    pairs = materialise(_ordered(pairs.select("a", "b").unionByName(led.select("a", "b"))), "copies-pairs")
    links = materialise(_similar(pairs, _sets(df, id_col, text_col, _rows_of(nodes, pairs, "a", "b"))), "copies-links")
    parts = materialise(connected_components(links, "copies-first"), "copies-parts")

    # Nodes of large buckets that hold more than one part.
    known = large.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    mixed = known.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    known = materialise(known.join(mixed, "key", "left_semi").select("node", "part").distinct(), "copies-known")
    if not known.isEmpty():
        sets = materialise(_sets(df, id_col, text_col, _rows_of(nodes, known, "node")), "copies-sets")
        more = materialise(_similar(rare_pairs(sets, known), sets), "copies-more")
        if not more.isEmpty():
            parts = connected_components(links.unionByName(more), "copies-second")

    labelled = nodes.join(parts, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labelled = labelled.join(least, "component").select("node", "component_id")
    return prints.join(labelled, "node").select("id", "node", "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without those that have a smaller id in their component; all columns.

    Rows under one id stay or go together; rows without an id stay.
    """
    found = near_copies(df, id_col, text_col).where(F.col("id") != F.col("component_id"))
    gone = found.select(F.col("id").alias(id_col)).distinct()
    return df.join(gone, id_col, "left_anti").select([f"`{c}`" for c in df.columns])
