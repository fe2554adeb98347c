from __future__ import annotations

import random
import struct
from pathlib import Path

import public_tokenizers
import pytest
from llm_fixtures import awkward, documents, sentence  # noqa: F401
from tokenizers import Tokenizer

from tallyloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(Path(PATH).read_text(encoding="utf-8"))


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def agree(codec, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    packed = codec.encode(text)
    assert packed == struct.pack(f"<{len(ids)}I", *ids), repr(text[:80])
    assert codec.decode(packed) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize(
    "text",
    [
        "",
        " ",
        "Hello, World's best — ÉTAGE 12³!",
        "<|endoftext|>a<|startoftext|> b <|endoftext|><|endoftext|>",
        "<|endoftext",
        "ΣΑΣ Σ İstanbul ǅ ﬁ",
        "日本語のテキスト 한국어 हिन्दी العربية",
        "é́ ẛ̣ Å",
        "a\x00b\x1cc\x85d e　f",
        "\U0001f468‍\U0001f469‍\U0001f467",
        "it's they'll I'D we'Re",
        "</w> w</w>",
    ],
)
def test_equals_the_library(codec, library, text):
    agree(codec, library, text)


def test_random_texts(codec, library):
    draw = random.Random(4)
    alphabet = ["a", "aa", "b", "the", "ing", "É", "ß", "1", "'s", "!", "--", " ", "\n", "中", "ا", "́", "😀", "<|", "zz", "er", "tion"]
    for _ in range(2000):
        agree(codec, library, "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 30))))


def test_very_long_words(codec, library):
    for text in ["a" * 50_000, "ab" * 20_000, "é" * 20_000, "!" * 30_000, "1" * 30_000, sentence(1, 20_000).replace(" ", "")]:
        agree(codec, library, text)


def test_memories_may_overflow(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 5)
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 5)
    agree(codec, library, sentence(2, 300))


def test_documents(spark, library, awkward):  # noqa: F811
    texts = {}
    for r in awkward.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    got = bpe.decode_documents(bpe.encode_documents(awkward, PATH), PATH).collect()
    assert len(got) == awkward.count()
    for r in got:
        options = [library.encode(t, add_special_tokens=False).ids for t in texts[r.id]]
        ids = list(struct.unpack(f"<{len(r.ids) // 4}I", bytes(r.ids)))
        assert ids in options
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(awkward.limit(0), PATH).count() == 0
