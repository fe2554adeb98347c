"""Reading files: CSV, Parquet, previews, content hashes, storage use."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.columns import is_integral, is_numeric, is_temporal, trim_names
from tallyloom.functions.exprs import quoted
from tallyloom.functions.running_sha import RunningSha256
from tallyloom.session import materialise, scratch_path

MEGABYTE = 1024 * 1024
#: Bytes of a file that one task hashes.
HASH_STEP = 128 * MEGABYTE
CELL = 16 * 1024
PIECE = {"file": pa.string(), "block": pa.int64(), "place": pa.int64(), "size": pa.int64(), "body": pa.binary(), "step": pa.int64()}


def csv_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8, or Latin-1 if any line of the files is not valid UTF-8."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if broken else "UTF-8"


def csv_scan(
    spark: SparkSession, path: str, schema: T.StructType | None = None, encoding: str | None = None
) -> DataFrame:
    """CSV with a header; types inferred unless a schema is given; names trimmed."""
    reader = spark.read.option("header", True).option("encoding", encoding or csv_encoding(spark, path))
    reader = reader.option("quote", '"').option("escape", '"')
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return trim_names(reader.csv(path))


def parquet_scan(spark: SparkSession, path: str) -> DataFrame:
    return trim_names(spark.read.parquet(path))


def dataset_scan(spark: SparkSession, parquet_path: str | None, csv_path: str | None) -> DataFrame:
    """The Parquet form of a dataset where it exists, else its CSV form."""
    if parquet_path and _exists(spark, parquet_path):
        return parquet_scan(spark, parquet_path)
    if csv_path is None:
        raise FileNotFoundError("the dataset has neither a Parquet nor a CSV file")
    return csv_scan(spark, csv_path)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).select("path").limit(1).count()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    return True


def head_preview(df: DataFrame, limit: int = 20, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(first rows, column notes): a type tag and five samples per column.

    Only the head is read. With ``order`` the head is the smallest keys.
    """
    head = (df.orderBy(order) if order else df).limit(limit)
    notes = []
    for i, field in enumerate(df.schema.fields):
        value = F.col(quoted(field.name))
        listed = F.filter(F.collect_list(value.cast("string")), lambda v: v.isNotNull())
        if order:
            pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order), value.cast("string").alias("v")))))
            listed = F.transform(pairs, lambda p: p["v"])
        notes.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("column_name"),
                _type_tag(field, F.count(value)).alias("data_type"),
                F.slice(listed, 1, 5).alias("sample_values"),
            )
        )
    return head, head.agg(F.array(*notes).alias("n")).select(F.inline("n"))


def _type_tag(field: T.StructField, present):
    kind = field.dataType
    if isinstance(kind, T.BooleanType):
        return F.lit("boolean")
    if is_integral(kind):
        return F.lit("integer")
    if is_numeric(kind):
        return F.lit("float")
    if is_temporal(kind):
        return F.lit("datetime")
    return F.when((present > 0) & (present <= 5), "categorical").otherwise("text")


def preview_json(df: DataFrame, order: str, limit: int = 20) -> DataFrame:
    """(key, json): the first rows as JSON objects. NaN and infinity become null,
    floats keep four decimals, dates become text."""
    cells = []
    for field in df.schema.fields:
        name, kind = quoted(field.name), field.dataType
        value = F.col(name)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
            value = F.when(finite, F.round(value, 4))
        elif isinstance(kind, T.DecimalType):
            value = F.round(value.cast("double"), 4)
        elif not (is_integral(kind) or isinstance(kind, T.BooleanType)):
            value = value.cast("string")
        cells.append(value.alias(field.name))
    whole = F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})
    return df.orderBy(order).limit(limit).select(F.col(order).alias("key"), whole.alias("json"))


def file_hashes(spark: SparkSession, path: str, step: int = HASH_STEP) -> DataFrame:
    """(path, length, hash): SHA-256 of the content of every file.

    The digest runs through a file in order. A file of more than ``step`` bytes is cut up, and its digest goes from step to step, so
    that no task holds or reads much more than that of it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    short = files.where(F.col("length") <= step).select("path", "length", F.sha2("content", 256).alias("hash"))
    long = files.where(F.col("length") > step).select("path", "length", F.col("_metadata.file_path").alias("file"))
    count, longest = long.agg(F.count(F.lit(1)), F.max("length")).head()
    return short.unionByName(_hashed_in_steps(spark, path, long, count, longest, step)) if count else short


def _hashed_in_steps(spark: SparkSession, path: str, long: DataFrame, count: int, longest: int, step: int) -> DataFrame:
    """Hashes of the ``long`` files, of which there are ``count``. Each step is a job that takes every open file one step on."""
    cut = _pieces(spark, path, step)
    at = scratch_path(spark, "pieces")
    cut.write.partitionBy("step").parquet(at)
    pieces = spark.read.schema(cut.schema).parquet(at)
    # The line reader leaves out a byte order mark at the start, and tells not if the last line has an end.
    surplus = F.col("size") - F.col("length")
    whole = F.when(surplus.isin(-3, -2, 0, 1), F.col("length")).otherwise(
        F.raise_error(F.format_string("%s changed while it was read", "file")).cast("bigint")
    )
    sizes = pieces.groupBy("file").agg(F.sum("size").alias("size"))
    heads = materialise(long.join(sizes, "file", "left").withColumns({"length": whole, "marked": surplus < 0}), "heads")
    begun = heads.select("file", F.lit(-2).alias("block"), F.lit(0).alias("place"), F.lit(None).cast("binary").alias("body"), F.col("length").alias("left"))
    marks = heads.where("marked").select("file", F.lit(-1), F.lit(0), F.lit(bytearray(b"\xef\xbb\xbf")), F.lit(None))
    rows, found, last = begun.union(marks), [], longest // step
    for k in range(last + 1):
        parts = pieces.where(F.col("step") == k).select("file", "block", "place", "body", F.lit(None).alias("left"))
        spread = parts.union(rows).repartition(2 * count, "file").sortWithinPartitions("file", "block", "place")
        states = materialise(spread.mapInArrow(_digested, "file string, body binary, left bigint, hash string"), "hashed")
        found.append(states if k == last else states.where("left = 0"))
        rows = states.where("left > 0").select("file", F.lit(-2), F.lit(0), "body", "left")
    done = F.when(F.col("left") == 0, F.col("hash")).otherwise(F.raise_error(F.format_string("%s was not read to its end", "file")))
    hashes = reduce(DataFrame.union, found).select("file", done.alias("hash"))
    return heads.join(hashes, "file").select("path", "length", "hash")


def _pieces(spark: SparkSession, path: str, step: int) -> DataFrame:
    """(file, block, place, size, body, step): the bytes of the files of more than ``step`` bytes, in the order of block and place.

    They are read as lines, which Spark can begin anywhere in a file, and get their line ends back. Names that stand for a
    codec are read as they are as well, but Spark begins those at their start only.
    """
    compress = spark.sparkContext._jvm.org.apache.hadoop.io.compress
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    made = spark.sparkContext._jvm.org.apache.hadoop.util.ReflectionUtils.newInstance
    suffixes = [made(codec, conf).getDefaultExtension() for codec in compress.CompressionCodecFactory.getCodecClasses(conf)]
    name = F.col("_metadata.file_name")
    coded = reduce(lambda a, b: a | b, [name.endswith(s) for s in suffixes], F.lit(False))
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    reads = [reader.text(path).where(~coded)]
    for suffix in suffixes:
        plain = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
        plain = plain.option("io.compression.codecs", "org.apache.hadoop.io.compress.PassthroughCodec")
        reads.append(plain.option(compress.PassthroughCodec.OPT_EXTENSION, suffix).text(path).where(name.endswith(suffix)))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, place, read = None, 0, 0
        for batch in batches:
            cells = zip(*(column.to_pylist() for column in batch.columns))
            for (file, block), run in groupby(cells, key=itemgetter(0, 1)):
                if (file, block) != before:
                    before, place, read = (file, block), 0, 0
                body = b"".join(cell for _, _, cell in run)
                row = [file, block, place, len(body), body, (block + read) // step]
                yield pa.record_batch([pa.array([v], t) for v, t in zip(row, PIECE.values())], list(PIECE))
                place, read = place + 1, read + len(body)

    long = [r.where(F.col("_metadata.file_size") > step) for r in reads]
    lines = [r.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("line")) for r in long]
    # Long lines go to Python in cells, as a batch has a fixed number of rows.
    cell = f"substring(line, i * {CELL} + 1, {CELL}) || IF(i = octet_length(line) div {CELL}, X'0A', X'')"
    cells = F.expr(f"explode(transform(sequence(0, cast(octet_length(line) div {CELL} AS int)), i -> {cell}))")
    return reduce(DataFrame.union, lines).select("file_path", "file_block_start", cells).mapInArrow(
        joined, "file string, block bigint, place bigint, size bigint, body binary, step bigint"
    )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest's state after the rows of each file, of which the first holds the state before and the bytes to come."""
    file, left, running = None, 0, None

    def state() -> pa.RecordBatch:
        digest = running.hexdigest() if left == 0 else None
        return pa.record_batch([pa.array([file]), pa.array([running.state()]), pa.array([left]), pa.array([digest], pa.string())], ["file", "body", "left", "hash"])

    for batch in batches:
        for name, block, _, body, to_come in zip(*(column.to_pylist() for column in batch.columns)):
            if block == -2:
                if running:
                    yield state()
                file, left, running = name, to_come, RunningSha256(body)
            elif name == file:  # else it came after the files were listed
                running.update(body[:left])
                left -= len(body[:left])
    if running:
        yield state()


def flag_duplicates(df: DataFrame, workspace: str, content_hash: str, key: str) -> DataFrame:
    """Add ``first_key`` and ``is_duplicate``: the first key in the workspace with the
    same hash. Only hashes that occur twice are looked up."""
    first = (
        df.groupBy(workspace, content_hash)
        .agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )
    joined = df.join(first, [workspace, content_hash], "left")
    first_key = F.coalesce("first_key", F.col(key))
    return joined.select(
        *df.columns,
        F.coalesce("copies", F.lit(1)).alias("copies"),
        (F.col(key) != first_key).alias("is_duplicate"),
        first_key.alias("first_key"),
    )


def already_stored(uploads: DataFrame, stored: DataFrame, workspace: str, content_hash: str) -> DataFrame:
    """Uploads whose hash the workspace holds already."""
    return uploads.join(stored, [workspace, content_hash], "left_semi")


def storage_usage(spark: SparkSession, path: str, quota_bytes: int) -> DataFrame:
    """Bytes, megabytes, share of the quota and file count per folder. The content
    column is pruned, so only file metadata is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    return (
        files.select(folder.alias("folder"), "length")
        .groupBy("folder")
        .agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))
        .withColumns(
            {"megabytes": F.col("bytes") / MEGABYTE, "quota_pct": F.col("bytes") * 100.0 / F.lit(quota_bytes)}
        )
    )
