"""Language identification of mixed text: script ranges, scores of words, and Viterbi spans with a switching penalty.

A word's script narrows the languages that it can be in. Its score in each of them is a naive Bayes sum over its character
n-grams. The best sequence of languages over a text, where each change costs a penalty, labels spans; the language with
the most letters labels the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About so many labelled documents of each language train the model (all if there are fewer); chosen by a hash of the id.
TRAIN_DOCUMENTS = 3_000
#: N-grams are hashed into so many slots; the model has a number for each slot and language.
SLOT_BITS = 17
GRAM_LENGTHS = 4
#: Weight of an n-gram's log probability: n-grams of a word overlap.
GRAM_WEIGHT = 0.4
#: What a change of language costs, in log units.
SWITCH_PENALTY = 8.0
#: A language is a candidate for a script that holds this share of its letters.
SCRIPT_SHARE = 0.01
#: What a word outside a language's scripts scores in it.
OTHER_SCRIPT = -20.0
#: Characters that are scored at a time; a longer text keeps only its words' scores.
PIECE = 1 << 18
UNKNOWN = "und"

#: First and last code point of the letter blocks of each script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x531, 0x58F)],
    "hebrew": [(0x591, 0x5F4)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "ethiopic": [(0x1200, 0x139F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}

#: Code points with properties of their own; those above are letters up to the last range of ``han``.
_LISTED = 0x20000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each listed code point: its lower case (of one character), whether it is a letter, whether it continues a word, and
    the number of its script (0: none of them)."""
    chars = [chr(c) for c in range(_LISTED)]
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.uint64)
    kinds = [unicodedata.category(c)[0] for c in chars]
    letter = np.array([k == "L" for k in kinds])
    script = np.zeros(_LISTED, np.int64)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            script[first : last + 1] = number
    return lower, letter, letter | np.array([k == "M" for k in kinds]), script


@dataclass
class Words:
    """The runs of letters of a piece of text: first and last character of each, its script, and for every n-gram the slot and
    the word."""

    starts: np.ndarray
    ends: np.ndarray
    scripts: np.ndarray
    slots: np.ndarray
    owners: np.ndarray


def words_of(points: np.ndarray) -> Words:
    """Cut code points into words and hash the n-grams of each; a word's n-grams see one character of space on either side."""
    lower, letter, joins, script = _characters()
    listed = points < _LISTED
    at = np.where(listed, points, 0)
    high = ~listed & (points <= SCRIPTS["han"][-1][1])
    within = np.where(listed, joins[at], high)
    begins = np.where(listed, letter[at], high)
    # A mark with no letter before it begins nothing.
    opened = np.maximum.accumulate(np.where(begins, 2, 0) * np.arange(1, len(points) + 1))
    closed = np.maximum.accumulate(np.where(within, 0, 2) * np.arange(1, len(points) + 1))
    inside = within & (opened > closed)
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    numbers = np.where(listed[starts], script[at[starts]], len(SCRIPTS))

    text = np.concatenate([[32], np.where(inside, np.where(listed, lower[at], points), 32), [32]]).astype(np.uint64)
    is_word = np.concatenate([[False], inside, [False]])
    owner = np.cumsum(np.concatenate([[0], edges == 1])) - 1
    rolled, slots, owners = np.zeros(len(text), np.uint64), [], []
    whole = np.ones(len(text), bool)
    for n in range(1, GRAM_LENGTHS + 1):
        size = len(text) - n + 1
        if size <= 0:
            break
        rolled = rolled[:size] * _MIX + text[n - 1 :] + np.uint64(n)
        first, last = is_word[:size], is_word[n - 1 :]
        if n > 2:
            # All but the first and the last character must be letters.
            whole = whole[:size] & is_word[n - 2 : n - 2 + size]
            good = whole
        else:
            good = first | last
        hits = np.flatnonzero(good)
        mixed = (rolled[hits] ^ (rolled[hits] >> np.uint64(29))) * _MIX
        slots.append((mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
        owners.append(owner[np.where(first[hits], hits, hits + 1)])
    return Words(starts, ends, numbers, np.concatenate(slots), np.concatenate(owners))


def pieces_of(text: str) -> Iterator[tuple[int, Words]]:
    """First character and words of each piece of a text. Pieces end between words, unless a word is longer than a piece."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    at = 0
    while at < len(points):
        end = min(at + PIECE, len(points))
        if end < len(points):
            spaces = np.flatnonzero(points[at:end] <= 32)
            end = at + int(spaces[-1]) + 1 if len(spaces) else end
        yield at, words_of(points[at:end])
        at = end


def held_out(id_col: Column) -> Column:
    """The test fold: a fifth of the ids by their CRC-32. A null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


@dataclass
class Model:
    """Languages, the score of each slot in each of them, and which of them use each script."""

    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray
    share: np.ndarray

    def emissions(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of a text: first character, length, and its score in each language."""
        starts, lengths, rows = [], [], []
        for at, words in pieces_of(text):
            n = len(words.starts)
            if n:
                table = self.scores[words.slots]
                row = np.stack([np.bincount(words.owners, table[:, k], n) for k in range(len(self.languages))], axis=1)
                allowed = self.allowed[words.scripts]
                if not allowed.all():
                    # Outside its scripts a language is out; a script that no language uses says nothing.
                    row = np.where(allowed, row, OTHER_SCRIPT)
                    row[~allowed.any(axis=1)] = 0.0
                rows.append(row)
                starts.append(words.starts + at)
                lengths.append(words.ends - words.starts)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(self.languages)))
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(rows)

    def label(self, text: str | None) -> tuple[str, float, list[tuple[str, int, int]]]:
        """Language, score and spans (language, first character, end) of a whole text.

        Null or no letter: ``und``, 0 and no span. The score is the share of letters in spans of the language, times the
        probability of the language over these spans. Letters of scripts that no language uses say nothing, so that
        alone they give the most frequent language and its share.
        """
        if not text or not self.languages:
            return UNKNOWN, 0.0, []
        starts, letters, emitted = self.emissions(text)
        if not len(starts):
            return UNKNOWN, 0.0, []
        path = best_path(emitted, SWITCH_PENALTY)
        weight = np.bincount(path, letters, len(self.languages))
        if not emitted.any():
            weight = self.share
        best = int(weight.argmax())
        own = emitted[path == best].sum(axis=0) + np.log(self.share)
        chance = 1.0 / np.exp(np.minimum(own - own[best], 700)).sum()
        return self.languages[best], float(weight[best] / weight.sum() * chance), self._spans(text, starts, path)

    def _spans(self, text: str, starts: np.ndarray, path: np.ndarray) -> list[tuple[str, int, int]]:
        cuts = np.flatnonzero(np.diff(path)) + 1
        borders = [0, *starts[cuts].tolist(), len(text)]
        return [(self.languages[path[i]], a, b) for i, a, b in zip([0, *cuts.tolist()], borders, borders[1:])]


def best_path(emitted: np.ndarray, penalty: float) -> np.ndarray:
    """The sequence of columns with the greatest sum, where each change costs ``penalty``.

    The best path leaves the best single column only for stretches that gain more than the penalty. A word that lies in no
    stretch whose largest possible gain exceeds it therefore stays in that column, which sums over stretches show at
    once; the search runs over the rest, from and to that column.
    """
    n, width = emitted.shape
    single = int(emitted.sum(axis=0).argmax())
    path = np.full(n, single)
    if width == 1:
        return path
    lead = emitted - emitted[:, [single]]
    lead[:, single] = -np.inf
    gain = lead.max(axis=1)
    sums = np.concatenate([[0.0], np.cumsum(gain)])
    up_to = sums[1:] - np.minimum.accumulate(sums[:-1])
    onward = np.maximum.accumulate(sums[:0:-1])[::-1] - sums[:-1]
    edges = np.diff(np.concatenate([[False], up_to + onward - gain > penalty, [False]]).astype(np.int8))
    for first, end in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
        path[first:end] = _searched(emitted[first:end], penalty, single if first else None, single if end < n else None)
    return path


def _searched(emitted: np.ndarray, penalty: float, before: int | None, after: int | None) -> np.ndarray:
    """The best path over some words, between words whose columns are given (or none)."""
    n, width = emitted.shape
    away = np.full(width, -penalty)
    value = emitted[0].copy()
    if before is not None:
        value += np.where(np.arange(width) == before, 0.0, away)
    came, stay = np.empty((n, width), np.int64), np.arange(width)
    for i in range(1, n):
        top = int(value.argmax())
        bar = value[top] - penalty
        came[i] = np.where(value >= bar, stay, top)
        value = np.maximum(value, bar) + emitted[i]
    if after is not None:
        value += np.where(np.arange(width) == after, 0.0, away)
    found = np.empty(n, np.int64)
    found[-1] = value.argmax()
    for i in range(n - 1, 0, -1):
        found[i - 1] = came[i, found[i]]
    return found


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learn from the rows of ``df`` that have a text and a language; leave out a test fold before calling.

    Tasks count hashed n-grams and Spark adds the counts up; the driver receives a number for each slot and language. Without
    labelled rows the model has no language and labels everything ``und``.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0), bool), np.zeros(0))
    languages = sorted(sizes)
    rate = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, TRAIN_DOCUMENTS / sizes[k]))])
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(draw < rate[F.col("lang")]).select("lang", "text")
    slots, scripts = 1 << SLOT_BITS, len(SCRIPTS) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The counts of the scripts' letters follow those of the slots.
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                mine = found.setdefault(lang, np.zeros(slots + scripts, np.int64))
                for _, words in pieces_of(text.as_py()):
                    mine[:slots] += np.bincount(words.slots, minlength=slots)
                    letters = np.bincount(words.scripts, words.ends - words.starts, scripts)
                    mine[slots:] += letters.astype(np.int64)
        for lang, mine in found.items():
            at = np.flatnonzero(mine)
            yield pa.record_batch({"lang": pa.array([lang] * len(at)), "at": pa.array(at), "n": pa.array(mine[at])})

    counts = sample.mapInArrow(count, "lang string, at bigint, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    kept = counts.toPandas()
    table = np.zeros((slots + scripts, len(languages)))
    table[kept["at"].to_numpy(np.int64), kept["lang"].map(languages.index).to_numpy(np.int64)] = kept["n"].to_numpy(np.float64)
    grams, letters = table[:slots], table[slots:]
    logs = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * slots))
    centred = (logs - logs.mean(axis=1, keepdims=True)) * GRAM_WEIGHT
    centred[~grams.any(axis=1)] = 0.0
    allowed = letters >= SCRIPT_SHARE * np.maximum(1, letters.sum(axis=0))
    share = np.array([sizes[k] for k in languages], dtype=np.float64)
    return Model(languages, centred.astype(np.float32), allowed, share / share.sum())


def label_languages(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``lang_pred``, ``score`` and ``spans`` for each row of ``df``; see ``Model.label``. Other columns are ignored."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.label(text.as_py()) for text in batch.column(1)]
            spans = [[{"lang": a, "start": b, "end": c} for a, b, c in s] for _, _, s in found]
            yield pa.record_batch(
                {
                    "id": batch.column(0),
                    "lang_pred": pa.array([f[0] for f in found], pa.string()),
                    "score": pa.array([f[1] for f in found], pa.float64()),
                    "spans": pa.array(spans, span),
                }
            )

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, lang_pred string, score double, spans array<struct<lang:string,start:bigint,end:bigint>>"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def keep_identified(df: DataFrame, model: Model, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose language is known with ``min_score`` at least, all columns unchanged."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            labels = (known.label(text.as_py()) for text in batch.column(at))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score, _ in labels], pa.bool_()))

    return df.mapInArrow(run, df.schema)
