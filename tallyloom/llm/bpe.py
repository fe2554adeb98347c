"""Byte-pair encoding and decoding by dynamic programming over prefixes.

A word is a string of symbols: its bytes, the last one marked as the end of the word. For every prefix of the word exactly
one token can be the last one of the prefix's encoding. An Aho-Corasick automaton of the vocabulary names all tokens that
are suffixes of the prefix; a token that starts at position i is the one if the last token of the prefix up to i may stand
before it, that is if merging the pair's text gives just this pair. Following the tokens back from the whole word gives the
ids that merging by rank gives, in time linear in the word's length.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and token pairs that a worker remembers; when full, it starts anew.
REMEMBERED_WORDS, REMEMBERED_PAIRS = 300_000, 300_000
#: Longer words are encoded each time they occur.
LONG_WORD = 200
#: Rows that leave Python at a time.
ROWS_OUT = 500
#: Added to a symbol at the end of a word.
_END = 0x2000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Words(dict):
    """Packed ids by word, computed when first asked for; a bounded number is kept."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.codec.word_ids(word), dtype="<u4").tobytes()
        if len(word) <= LONG_WORD:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = ids
        return ids


def token_names(spec: dict) -> list[str]:
    """The token of each id, special ones included; empty where there is none."""
    tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
    return [tokens.get(i, "") for i in range(max(tokens) + 1)]


def decoded(ids: bytes | None, names: list[str]) -> str:
    """The tokens of packed ids, with a space between; word ends stay visible, as this vocabulary has no decoder."""
    return " ".join(map(names.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))


class Codec:
    """Encoder and decoder for a vocabulary file with end-of-word symbols, given as its JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.symbol = byte_symbols()
        spelled: dict[str, str] = {}
        for one in self.symbol:
            spelled[one] = one
            spelled[one + suffix] = chr(ord(one) + _END)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            whole = vocab[left + right]
            spelled.setdefault(left + right, spelled[left] + spelled[right])
            self.parts.setdefault(whole, (vocab[left], vocab[right]))
            self.rank.setdefault(whole, rank)
            self.merged[vocab[left], vocab[right]] = (rank, whole)
        self.automaton = ahocorasick.Automaton()
        for name, symbols in spelled.items():
            self.automaton.add_word(symbols, (vocab[name], len(symbols)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern, regex.V1).findall
        self.names = token_names(spec)
        self.words = _Words(self)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the text of the two tokens gives the two tokens.

        It doesn't if some pair across their border would have merged while both its parts stood there: parts of the left
        token that end at the border live until the merge that took them in, those of the right token likewise. The two
        are taken apart step by step, latest merge first. At equal rank the pair further left merges first.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is not None:
            return known
        never = len(self.merged)
        ends_left = ends_right = never
        good = True
        while True:
            rank = self.merged.get((left, right), (never, 0))[0]
            if rank < ends_left and rank <= ends_right and rank < never:
                good = False
                break
            born_left, born_right = self.rank.get(left, -1), self.rank.get(right, -1)
            if born_left < 0 and born_right < 0:
                break
            if born_left > born_right:
                ends_left, left = born_left, self.parts[left][1]
            else:
                ends_right, right = born_right, self.parts[right][0]
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def word_ids(self, word: str) -> list[int]:
        """The ids of one word, by the last token of each of its prefixes."""
        symbol = self.symbol
        symbols = "".join([symbol[b] for b in word.encode("utf-8", "surrogatepass")])
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + _END)
        last, starts, done = [0] * len(symbols), [0] * len(symbols), -1
        pairs, may_follow = self.pairs, self.may_follow
        for end, (token, length) in self.automaton.iter(symbols):
            if end == done:
                continue
            start = end - length + 1
            if start:
                before = last[start - 1]
                good = pairs.get((before, token))
                if good is None:
                    good = may_follow(before, token)
                if not good:
                    continue
            last[end], starts[end], done = token, start, end
        ids, at = [], len(symbols) - 1
        while at >= 0:
            ids.append(last[at])
            at = starts[at] - 1
        return ids[::-1]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special tokens in the text become their ids; null is empty."""
        if not text:
            return b""
        out = []
        for k, piece in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(self.special[piece].to_bytes(4, "little"))
            elif piece:
                out.extend(map(self.words.__getitem__, self.pieces(_folded(piece))))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        return decoded(ids, self.names)


def _folded(text: str) -> str:
    """Composed characters in lower case, character by character."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


@lru_cache(maxsize=2)
def _codec(text: str) -> Codec:
    return Codec(text)


@lru_cache(maxsize=2)
def _names(text: str) -> list[str]:
    return token_names(json.loads(text))


def _in_slices(columns: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for row in columns:
        rows.append(row)
        if len(rows) == ROWS_OUT:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
            rows = []
    if rows:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def encode_documents(df: DataFrame, vocabulary: str | Path, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``ids`` (packed little-endian unsigned 32-bit integers) for each row of ``df``.

    The vocabulary file is read once on the driver and sent to the workers as text of a few MB. Null and empty texts give
    no ids. Repeated rows each give a row; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            found = ((keys[i].as_py(), codec.encode(texts[i].as_py())) for i in range(len(keys)))
            yield from _in_slices(found, ["id", "ids"], [keys.type, pa.binary()])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary")


def decode_documents(df: DataFrame, vocabulary: str | Path) -> DataFrame:
    """``id``, ``ids`` and ``decoded`` for each row of ``encode_documents``; no ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Names are enough to decode: no automaton, no pairs.
        names = _names(shared.value)
        for batch in batches:
            keys, packed = batch.column(0), batch.column(1)
            found = ((keys[i].as_py(), ids := packed[i].as_py(), decoded(ids, names)) for i in range(len(keys)))
            yield from _in_slices(found, ["id", "ids", "decoded"], [keys.type, pa.binary(), pa.string()])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "ids").mapInArrow(run, f"id {kind}, ids binary, decoded string")
