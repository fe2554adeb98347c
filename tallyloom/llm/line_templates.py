"""Line deduplication by a tree of log templates.

A line's path in the tree has a fixed depth: its number of tokens, then its leading tokens, where a token with a digit is a
variable. In a leaf, a token is a variable field where the rest of the line also stands with other values at its place, and where
no other line has it at its place. How often a line is repeated says nothing of its fields, so only different lines count. A line
whose tokens are constant in ``SIMILARITY`` per cent of its positions or more stands for its template, any other for itself. A
template that occurs in several documents stays in the one with the smallest id and is dropped from the others.

Long lines of few words, as in scripts without spaces, are cut into characters. Shorter lines, and lines of numbers, are compared
as they are and have no fields.

Everything is aggregated by hashes of lines; only lines in leaves that hold different lines are cut into tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import materialise

#: Leading tokens on the path to a leaf.
DEPTH = 3
#: Percentage of a template's positions that must be constant.
SIMILARITY = 80
#: Tokens without a digit that a line must have to be parsed by tokens, and characters to be parsed by characters.
MIN_WORDS, MIN_CHARACTERS = 3, 20
#: Up to so many leaves with different lines (8 bytes each) are sent to every worker; more are joined by a shuffle of all lines.
BROADCAST_LEAVES = 500_000

_DIGIT = re.compile(rb"[0-9]")
_VARIABLE = b"<*>"
#: Lines that leave Python at a time.
LINES_OUT = 20_000


def parsed_lines(text: str) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """Number (from 0), kind and tokens of each line that isn't blank.

    Kind ``w``: tokens, those with a digit as ``<*>``. Kind ``c``: characters, digits as ``<*>``. Kind ``s``: the line as one token,
    white space collapsed.
    """
    for number, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        words = line.split()
        if not words:
            continue
        tokens = [_VARIABLE if _DIGIT.search(t) else t for t in words] if _DIGIT.search(line) else words
        if len(tokens) - tokens.count(_VARIABLE) >= MIN_WORDS:
            yield number, b"w", tokens
            continue
        whole = b"".join(words)
        if len(whole) >= MIN_CHARACTERS:
            characters = [_VARIABLE if "0" <= x <= "9" else x.encode("utf-8", "surrogatepass") for x in whole.decode("utf-8", "surrogatepass")]
            if len(characters) - characters.count(_VARIABLE) >= MIN_CHARACTERS:
                yield number, b"c", characters
                continue
        yield number, b"s", [b" ".join(words)]


def _lines(df: DataFrame, id_col: str, text_col: str, leaves: Broadcast | None = None, whole: bool = False) -> DataFrame:
    """Each line that isn't blank: ``id``, ``version`` (hash of the text), ``line_no``, ``leaf``, ``hash`` and, for ``whole``
    lines, ``line`` and ``tokens``. Only lines in ``leaves`` (sorted numbers), if given."""
    docs = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("version"), F.col(text_col).alias("text"))
    digest = xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if leaves is None else leaves.value
        for batch in batches:
            texts, at, numbers, paths, hashes, lines, counts = batch.column(2), [], [], [], [], [], []

            def ready() -> pa.RecordBatch:
                taken = pa.array(at, pa.int64())
                columns = {
                    "id": batch.column(0).take(taken),
                    "version": batch.column(1).take(taken),
                    "line_no": pa.array(numbers, pa.int32()),
                    "leaf": pa.array(np.array(paths, np.uint64).view(np.int64)),
                    "hash": pa.array(np.array(hashes, np.uint64).view(np.int64)),
                }
                if whole:
                    columns |= {"line": pa.array(lines, pa.string()), "tokens": pa.array(counts, pa.int32())}
                for column in (at, numbers, paths, hashes, lines, counts):
                    column.clear()
                return pa.record_batch(columns)

            for i in range(batch.num_rows):
                found = list(parsed_lines(texts[i].as_py()))
                mine = [digest(b"%b %d %b" % (kind, len(tokens), b" ".join(tokens[:DEPTH]))) for _, kind, tokens in found]
                for k in range(len(found)) if asked is None else _among(mine, asked):
                    number, _, tokens = found[k]
                    joined = b" ".join(tokens)
                    at.append(i)
                    numbers.append(number)
                    paths.append(mine[k])
                    hashes.append(digest(joined))
                    if whole:
                        lines.append(joined.decode("utf-8", "surrogatepass"))
                        counts.append(len(tokens))
                if len(at) >= LINES_OUT:
                    yield ready()
            if at:
                yield ready()

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, version bigint, line_no int, leaf bigint, hash bigint" + (", line string, tokens int" if whole else "")
    return docs.mapInArrow(run, schema)


def _among(paths: list[int], asked: np.ndarray) -> list[int]:
    """Positions of the paths that are among the sorted numbers."""
    mine = np.array(paths, np.uint64).view(np.int64)
    place = np.searchsorted(asked, mine)
    place[place == len(asked)] = 0
    return np.flatnonzero(asked[place] == mine).tolist() if len(asked) else []


def _templates(df: DataFrame, id_col: str, text_col: str, open_leaves: DataFrame) -> DataFrame:
    """``leaf``, ``hash`` and ``template`` for each different line of the open leaves that stands for a template."""
    spark = df.sparkSession
    if open_leaves.count() <= BROADCAST_LEAVES:
        known = np.sort(open_leaves.toPandas()["leaf"].to_numpy(np.int64))
        inside = _lines(df, id_col, text_col, spark.sparkContext.broadcast(known), whole=True)
    else:
        inside = _lines(df, id_col, text_col, whole=True).join(open_leaves, "leaf", "left_semi")
    different = inside.groupBy("leaf", "hash", "line", "tokens").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    different = materialise(different, "template-lines")
    token_of = F.split("line", " ")
    own = F.xxhash64("position", "token")
    cells = different.select("leaf", "hash", "tokens", "low", "high", F.posexplode(token_of).alias("position", "token"))
    # The line without this token: all tokens combined, and this one taken out again.
    line = F.aggregate(
        F.transform(token_of, lambda t, i: F.xxhash64(i, t)), F.lit(0).cast("bigint"), lambda s, h: s.bitwiseXOR(h)
    )
    lines = different.select("leaf", "hash", line.alias("all"))
    cells = cells.where(F.col("position") >= DEPTH).join(lines, ["leaf", "hash"]).withColumn("rest", F.col("all").bitwiseXOR(own)).drop("all")
    cells = materialise(cells, "template-cells")
    several = [F.count(F.lit(1)).alias("n"), F.min("low").alias("least"), F.max("high").alias("most")]
    shared = cells.groupBy("leaf", "position", "token").agg(*several).where("n > 1 AND least <> most").drop("n", "least", "most")
    fields = cells.groupBy("leaf", "position", "rest").agg(*several).where("n > 1 AND least <> most").drop("n", "least", "most")
    constant = cells.join(shared, ["leaf", "position", "token"]).join(fields, ["leaf", "position", "rest"], "left_anti")
    found = constant.groupBy("leaf", "hash", "tokens").agg(
        F.count(F.lit(1)).alias("constant"), F.bit_xor(own).alias("template")
    )
    enough = (F.col("constant") + DEPTH) * 100 >= F.col("tokens") * SIMILARITY
    return found.where(enough).select("leaf", "hash", "template", F.lit(True).alias("general"))


def recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``version`` (hash of the text) and ``line_no`` (from 0) of each line whose template stays in another document."""
    keys = materialise(_lines(df, id_col, text_col), "line-keys")
    different = keys.groupBy("leaf", "hash").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    different = materialise(different, "line-hashes")
    several = different.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    # Lines of one document alone can't recur from another.
    several = materialise(several.where("n > 1 AND low <> high").select("leaf"), "open-leaves")
    templates = materialise(_templates(df, id_col, text_col, several), "line-templates")
    known = different.join(templates, ["leaf", "hash"], "left").withColumns(
        {"template": F.coalesce("template", "hash"), "general": F.coalesce("general", F.lit(False))}
    )
    recurring = known.groupBy("leaf", "general", "template").agg(F.min("low").alias("keeper"), F.max("high").alias("most"))
    recurring = recurring.where("keeper <> most").drop("most")
    stays = known.join(recurring, ["leaf", "general", "template"]).select("leaf", "hash", "keeper")
    return keys.join(stays, ["leaf", "hash"]).where("id <> keeper").select("id", "version", "line_no")


def drop_recurring_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    count_col: str | None = "n_lines_dropped",
    drop_emptied: bool = False,
) -> DataFrame:
    """``df`` without the lines that recur from another document: all columns, the text replaced, and ``count_col`` if named.

    * Lines end at ``\\n``; a line counts with its white space collapsed and its variable fields open. Lines of fewer than
      ``MIN_WORDS`` words that are shorter than ``MIN_CHARACTERS`` recur only as they are. Blank lines stay, and so do lines that
      recur only inside their own document.
    * Of the documents that share a template, the one with the smallest id keeps its lines.
    * Null texts stay null. Rows without an id are left alone. Rows that repeat an id with equal text are one document and
      change together.
    * ``drop_emptied``: documents from which lines were dropped and of which only white space is left go.
    * A column of ``df`` named like ``count_col`` is replaced; without ``count_col`` the columns are those of ``df``.
    """
    gone = recurring_lines(df, id_col, text_col).groupBy("id", "version").agg(F.collect_list("line_no").alias("numbers"))
    kept = df.drop(count_col) if count_col else df
    on = (kept[id_col] == gone["id"]) & (F.xxhash64(kept[text_col]) == gone["version"])
    # By reference, not by name: the table may have columns of these names.
    joined = kept.join(gone, on, "left").select([kept[f"`{c}`"] for c in kept.columns] + [gone["numbers"]])
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = batch.column(at), batch.column(batch.num_columns - 1)
            new, counts, stay = [], [], []
            for i in range(batch.num_rows):
                text, numbers = texts[i].as_py(), set(drops[i].as_py() or ())
                if numbers:
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in numbers)
                new.append(text)
                counts.append(len(numbers))
                stay.append(not (drop_emptied and numbers and not text.split()))
            columns, names = batch.columns[:-1], batch.schema.names[:-1]
            columns[at] = pa.array(new, texts.type)
            if count_col:
                columns, names = [*columns, pa.array(counts, pa.int64())], [*names, count_col]
            yield pa.record_batch(columns, names=names).filter(pa.array(stay, pa.bool_()))

    schema = kept.withColumn(count_col, F.lit(0).cast("long")).schema if count_col else kept.schema
    return joined.mapInArrow(run, schema)
