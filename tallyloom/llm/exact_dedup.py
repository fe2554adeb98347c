"""Exact deduplication by content sort.

Texts are normalised (each run of ASCII white space becomes one space), range-partitioned at sampled splitters, sorted
inside their range, and compared with their neighbour in full. The sort key is a short byte prefix, the SHA-256 of the
normalised text and the id: equal texts lie side by side in the order of their ids, the splitters that Spark samples stay
about 100 bytes however long the texts are, and a text that a third of all rows share is cut into many ranges by id.
Each range holds its own runs; a run that goes on in the next range is joined up through at most two rows a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import materialise

#: Characters of the normalised text that lead the sort key.
PREFIX = 24

_ID, _TEXT, _SHA = "_id", "_text", "_sha"


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as empty. Single spaces are left alone, which changes nothing."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def content_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of equal neighbours in one sorted range.

    Holds the ids of one run of this range at a time. The first and the last run carry the range's number, and their
    first row carries the text, so that runs can be joined across ranges.
    """
    part = TaskContext.get().partitionId()
    state: dict = {"ids": [], "text": None, "sha": None, "runs": 0}
    id_type: pa.DataType | None = None

    def flush(last: bool) -> pa.RecordBatch:
        ids, first = state["ids"], state["runs"] == 0
        n, edge = len(ids), first or last
        state["runs"] += 1
        return pa.record_batch(
            {
                "id": pa.array(ids, id_type),
                "keep": pa.array([ids[0]] * n, id_type),
                "size": pa.array([n] * n, pa.int64()),
                "head": pa.array([True] + [False] * (n - 1)),
                "sha": pa.array([state["sha"]] * n, pa.string()),
                "part": pa.array([part if edge else None] * n, pa.int32()),
                "run": pa.array([(0 if first else 1) if edge else None] * n, pa.int32()),
                "edge_text": pa.array([state["text"] if edge else None] + [None] * (n - 1), pa.string()),
            }
        )

    ready: list[pa.RecordBatch] = []
    for batch in batches:
        id_type = batch.schema.field(_ID).type
        shas = batch.column(_SHA).to_pylist()
        texts = batch.column(_TEXT)
        for i, key in enumerate(batch.column(_ID).to_pylist()):
            text = texts[i].as_py()
            if state["ids"] and (shas[i] != state["sha"] or text != state["text"]):
                ready.append(flush(last=False))
                state["ids"] = []
            if not state["ids"]:
                state["text"], state["sha"] = text, shas[i]
            state["ids"].append(key)
        if len(ready) >= 1000:
            yield from _combined(ready)
            ready = []
    if state["ids"]:
        ready.append(flush(last=True))
    yield from _combined(ready)


def _combined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if parts:
        yield from pa.Table.from_batches(parts).combine_chunks().to_batches()


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    * Texts are equal when they are identical after normalising; a null text is an empty one.
    * The row with the smallest id of a group stays (``kept``); a null id comes last. Of rows that also share the id,
      exactly one stays.
    * No row is dropped. Other columns of ``df`` are ignored, whatever their names. An empty table gives an empty one.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias(_ID), normalised(F.col(text_col)).alias(_TEXT))
    rows = rows.withColumn(_SHA, F.sha2(_TEXT, 256))
    key = [F.substring(_TEXT, 1, PREFIX), F.col(_SHA), F.col(_ID).asc_nulls_last()]
    kind = df.schema[id_col].dataType
    out = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("keep", kind),
            T.StructField("size", T.LongType()),
            T.StructField("head", T.BooleanType()),
            T.StructField("sha", T.StringType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("run", T.IntegerType()),
            T.StructField("edge_text", T.StringType()),
        ]
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *key).sortWithinPartitions(*key).select(_ID, _TEXT, _SHA)
    runs = materialise(ranged.mapInArrow(content_runs, out), "content-runs")

    # At most two rows a range: its first and its last run, in the order of the sort.
    edges = runs.where(F.col("edge_text").isNotNull()).select("part", "run", "edge_text", "keep", "size")
    order = Window.orderBy("part", "run")
    edges = edges.withColumn("opens", F.coalesce(F.lag("edge_text").over(order) != F.col("edge_text"), F.lit(True)))
    edges = edges.withColumn("chain", F.sum(F.col("opens").cast("int")).over(order))
    chain = Window.partitionBy("chain")
    joined = edges.select(
        "part",
        "run",
        F.col("opens").alias("chain_opens"),
        F.first("keep").over(chain.orderBy("part", "run")).alias("chain_keep"),
        F.sum("size").over(chain).alias("chain_size"),
    )
    return runs.join(F.broadcast(joined), ["part", "run"], "left").select(
        "id",
        F.when(F.col("chain_size").isNull(), F.col("keep")).otherwise(F.col("chain_keep")).alias("keep_id"),
        F.coalesce("chain_size", "size").alias("group_size"),
        (F.col("head") & F.coalesce("chain_opens", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
