"""WARC archives: written by Spark's text writer, read back by boundary chains.

A record ends with two line breaks, which is what the writer puts after each row. The reader cuts files at the magic line
wherever it stands, also inside payloads: every piece behind one is a candidate. Tasks learn the byte offset of each piece in
its split, short sums a split make that an offset in the file, and a candidate's own length says where the next record must
begin. Starting at the head of the file, pointer jumping marks the candidates that the chain of records reaches; each round
doubles the length of the jumps, so a file of a million records takes twenty. The others are payload and go back to the
record that they are part of.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import materialise

MAGIC, BREAK = "WARC/1.1\r\n", "\r\n"
GAP = BREAK * 2
#: Payloads from this many bytes on are stored once.
LEAST_SHARED = 100
#: Parts into which the rows of one payload are split when they look up its first.
SALTS = 16
#: Bytes of a cell; a record that holds magic is looked up in the cells that it covers.
CELL = 1 << 20


# --- writing ---------------------------------------------------------------


def tagged(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``id``, ``url``, ``payload``, ``digest``, ``bytes`` of every row, ``revisit``, and ``first`` (the id that a revisit refers to).

    Of rows with equal payloads of ``LEAST_SHARED`` bytes or more, the one with the smallest id (nulls last, then by url) is
    stored; the others revisit it, and their payload is null here. Rows that are alike in all of this count as ordered: one is
    stored. A null payload is an empty one.
    """
    content = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), content.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("bigint")})
    place = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("url").alias("url"))
    shared = rows.where(F.col("bytes") >= LEAST_SHARED).groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c"))
    shared = materialise(shared.where("c > 1").drop("c"), "warc-shared")
    spread = shared.select(F.col("digest").alias("d"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salt = F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")
    joined = rows.withColumn("salt", salt).join(spread, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    leads = place.eqNullSafe(F.col("first"))
    plain = joined.where(F.col("first").isNull() | ~leads)
    plain = plain.select(
        "id",
        "url",
        F.when(F.col("first").isNull(), F.col("payload")).alias("payload"),
        "digest",
        "bytes",
        F.col("first").isNotNull().alias("revisit"),
        F.col("first.id").alias("first"),
    )
    # One row a shared payload, and as many again as there are rows alike; only here is a payload shuffled.
    heads = joined.where(F.col("first").isNotNull() & leads).groupBy("digest", "id", "url", "bytes")
    heads = heads.agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("c"))
    heads = heads.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("c"))))
    again = F.col("k") > 1
    heads = heads.select(
        "id",
        "url",
        F.when(~again, F.col("payload")).alias("payload"),
        "digest",
        "bytes",
        again.alias("revisit"),
        F.when(again, F.col("id")).alias("first"),
    )
    return plain.unionByName(heads)


def _urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:row:"), F.coalesce(F.url_encode(key.cast("string")), F.lit("")), F.lit(">"))


def record(date: str) -> Column:
    """The text of a record of ``tagged`` columns, without the two line breaks at its end.

    The block is an HTTP response; that of a revisit has its head only. Line breaks in a url are percent-encoded.
    """
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("bytes").cast("string"), F.lit(GAP)
    )
    block = F.concat(head, F.coalesce("payload", F.lit("")))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat_ws(
        BREAK,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        F.lit(""),
        block,
    )


def write_archive(df: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", **columns: str) -> None:
    """Write a record for each row of ``df`` below ``path``, a file a task. ``columns`` as for ``tagged``; an empty table writes no record."""
    tagged(df, **columns).select(record(date).alias("value")).write.option("lineSep", GAP).text(path)


# --- reading ---------------------------------------------------------------

#: What a record has besides its place.
FIELDS = ["record_type", "id", "url", "refers_to", "payload_bytes", "payload_digest", "intact"]


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``at``: the bytes of the same split before each piece. A task reads its splits one after the other, in file order."""
    here, at = None, 0
    for batch in batches:
        offsets = []
        for file, start, size in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "size")), strict=True):
            if (file, start) != here:
                here, at = (file, start), 0
            offsets.append(at)
            at += size + len(MAGIC)
        yield batch.append_column("at", pa.array(offsets, pa.int64()))


def _located(rows: DataFrame) -> DataFrame:
    """Rows of a scan with ``file``, ``start`` and ``size`` get ``at``. Nothing may have shuffled them."""
    return rows.mapInArrow(_running, T.StructType([*rows.schema.fields, T.StructField("at", T.LongType())]))


def _header(name: str, head: str) -> Column:
    """A named field of a head, null if it has none."""
    found = F.regexp_extract(F.concat(F.lit("\n"), F.col(head)), rf"(?i)\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.nullif(F.trim(found), F.lit(""))


def _row_of(name: str) -> Column:
    return F.url_decode(F.nullif(F.regexp_extract(_header(name, "head"), "^<urn:row:(.+)>$", 1), F.lit("")))


def _parsed(rows: DataFrame) -> DataFrame:
    """Add the fields of a record to rows with ``content``, its bytes behind the magic line, and ``span``.

    ``span`` is the length that the record has by its own account: null if there is no head or it names no length. ``payload``
    is what follows the head of an HTTP block, else the block; null for a revisit, whose HTTP head states the full length.
    """
    rows = rows.withColumn("head", F.substring_index(F.col("content").cast("string"), GAP, 1))
    rows = rows.withColumns(
        {
            "kind": F.lower(_header("WARC-Type", "head")),
            "http": F.coalesce(F.lower(_header("Content-Type", "head")).startswith("application/http"), F.lit(False)),
            "named": F.nullif(F.regexp_extract(_header("WARC-Payload-Digest", "head"), "(?i)^sha256:([0-9a-f]+)$", 1), F.lit("")),
            "length": _header("Content-Length", "head").try_cast("bigint"),
            "skip": F.octet_length("head").cast("bigint") + len(GAP),
        }
    )
    sound = (F.col("length") >= 0) & (F.col("skip") <= F.octet_length("content"))
    rows = rows.withColumn("span", F.when(sound, F.col("skip") + F.col("length") + len(GAP)))
    inside = F.least("length", F.octet_length("content").cast("bigint")).cast("int")
    rows = rows.withColumn("block", F.substring("content", (F.col("skip") + 1).cast("int"), inside))
    rows = rows.withColumn("http_head", F.when(F.col("http"), F.substring_index(F.col("block").cast("string"), GAP, 1)))
    revisit = F.col("kind") == "revisit"
    body = F.substring("block", F.octet_length("http_head") + len(GAP) + 1, F.octet_length("block"))
    rows = rows.withColumn("payload", F.when(~revisit, F.when(F.col("http"), body).otherwise(F.col("block"))))
    seen = F.sha2("payload", 256)
    ends = F.substring("content", (F.col("skip") + inside + 1).cast("int"), F.lit(len(GAP))) == F.lit(GAP).cast("binary")
    rows = rows.withColumns(
        {
            "record_type": F.col("kind"),
            "id": _row_of("WARC-Record-ID"),
            "url": _header("WARC-Target-URI", "head"),
            "refers_to": _row_of("WARC-Refers-To"),
            "payload_bytes": F.when(revisit, _header("Content-Length", "http_head").try_cast("bigint")).otherwise(
                F.octet_length("payload").cast("bigint")
            ),
            "payload_digest": F.when(revisit, F.lower("named")).otherwise(seen),
            "intact": F.coalesce(ends & (revisit | F.coalesce(F.lower("named") == seen, F.lit(True))), F.lit(False)),
        }
    )
    return rows.drop("content", "head", "kind", "http", "named", "length", "skip", "block", "http_head")


def _splits(pieces: DataFrame) -> DataFrame:
    """A row a split: the number of its file, the offset of its first piece there, and the length of the file."""
    sizes = pieces.groupBy("file", "start").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    files = materialise(sizes.select("file").distinct().withColumn("no", F.monotonically_increasing_id()), "warc-files")
    file = W.partitionBy("file")
    base = F.coalesce(F.sum("bytes").over(file.orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("file", "start", base.alias("base"), F.sum("bytes").over(file).alias("total"))
    return materialise(sizes.join(files, "file"), "warc-splits")


def reachable(links: DataFrame) -> DataFrame:
    """The links (no, pos, next) on the chain from each file's head, by pointer jumping.

    ``far`` starts as the next record and is replaced by the far of the far: 1, 2, 4, ... records ahead. What is reached
    doubles each round, until no jump from it lands on a candidate.
    """
    jumps = links.select("no", "pos", F.col("next").alias("far"))
    reached = materialise(jumps.where(F.col("pos") == len(MAGIC)).select("no", "pos"), "warc-reached")
    while True:
        ahead = reached.join(jumps, ["no", "pos"]).select("no", F.col("far").alias("pos"))
        found = materialise(ahead.join(links.select("no", "pos"), ["no", "pos"], "left_semi"), "warc-reached")
        if found.isEmpty():
            return links.join(reached, ["no", "pos"], "left_semi")
        reached = reached.unionByName(found)
        beyond = jumps.select("no", F.col("pos").alias("far"), F.col("far").alias("farther"))
        jumps = materialise(jumps.join(beyond, ["no", "far"]).select("no", "pos", F.col("farther").alias("far")), "warc-jumps")


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all files below ``path``: ``file``, ``offset`` and ``FIELDS``; with ``payloads`` also ``payload`` (bytes).

    * Ids are what the writer put there, as strings; null if the row had none. ``refers_to`` and the digest of a revisit are
      what it states, all others are computed from the bytes.
    * ``intact``: the record ends where it says, and its payload has the SHA-256 that it names, if it names one.
    * Magic inside payloads is payload. The chain ends at a record whose successor isn't where it should be; what follows it in
      the file isn't read. A file that does not begin with a record gives none, nor does an empty one.
    """
    lines = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.octet_length("value").cast("bigint").alias("size"),
        F.col("value").cast("binary").alias("content"),
    )
    # Payloads are digested where they are read; only heads' fields go through Arrow and into the table.
    pieces = materialise(_located(_parsed(lines).drop("payload")), "warc-pieces")
    splits = _splits(pieces)
    placed = pieces.join(splits, ["file", "start"]).withColumn("pos", F.col("base") + F.col("at"))
    links = placed.where(F.col("span").isNotNull()).select(
        "no", "pos", (F.col("pos") + F.col("span") + len(MAGIC)).alias("next"), "size", "span", "total"
    )
    chain = materialise(reachable(materialise(links, "warc-links")), "warc-chain")

    alone = chain.where(F.col("span") <= F.col("size")).select("no", "pos")
    out = ["file", (F.col("pos") - len(MAGIC)).alias("offset"), *FIELDS, *(["payload"] if payloads else [])]
    if payloads:
        own = _located(_parsed(lines)).join(splits, ["file", "start"]).withColumn("pos", F.col("base") + F.col("at"))
    else:
        own = placed
    whole = own.join(alone, ["no", "pos"]).select(*out)

    # Records with magic in them: all pieces that lie in the cells they cover and before their end.
    first, last = F.col("pos"), F.least("next", "total") - 1
    cells = F.explode(F.sequence(F.floor(first / CELL), F.floor(last / CELL)))
    cut = chain.where(F.col("span") > F.col("size")).select("no", F.col("pos").alias("head_pos"), "next", cells.alias("cell"))
    # Stored, so that its size is known when the join is planned: few such records need no shuffle of the bytes, none no scan.
    cut = materialise(cut, "warc-cut")
    if cut.isEmpty():
        return whole
    bytes_of = _located(lines).join(splits, ["file", "start"]).withColumn("pos", F.col("base") + F.col("at"))
    bytes_of = bytes_of.withColumn("cell", F.floor(F.col("pos") / CELL)).select("no", "cell", "file", "pos", "content")
    parts = bytes_of.join(cut, ["no", "cell"]).where((F.col("pos") >= F.col("head_pos")) & (F.col("pos") < F.col("next")))
    joined = parts.groupBy("file", F.col("head_pos").alias("pos")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), "content"))).alias("parts")
    )
    magic = F.lit(MAGIC).cast("binary")
    content = F.aggregate(
        F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0)).content, lambda s, p: F.concat(s, magic, p.content)
    )
    return whole.unionByName(_parsed(joined.select("file", "pos", content.alias("content"))).select(*out))
