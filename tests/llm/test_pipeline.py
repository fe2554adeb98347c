from __future__ import annotations

import struct
import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pytest
from llm_fixtures import components_of
from pyspark.sql import functions as F
from test_decontaminate import shingles
from test_line_templates import expected as without_recurring_lines
from test_near_copies import alike
from test_near_copies import shingles as five_words
from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm import language_id

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def near_copies_gone(pairs):
    sets = {i: five_words(t) for i, t in pairs}
    links = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    root = components_of(sets, links)
    return [(i, t) for i, t in pairs if root[i] == i]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables and copies of documents with a word changed here and there, from one to many."""
    folder = str(tmp_path_factory.mktemp("copies"))
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows, made = documents.collect(), []
    for k, r in enumerate(sorted(rows, key=lambda r: r.doc_id)[:40]):
        words = (r.text or "").split(" ")
        for n in (1, 2, 4, 8):
            changed = list(words)
            for at in range(0, len(words), max(len(words) // n, 1)):
                changed[at] = f"other{k}"
            made.append((10_000_000 + 10 * k + n, " ".join(changed), r.lang, r.source, r.n_chars))
    spark.createDataFrame([tuple(r) for r in rows] + made, documents.schema).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_run_equals_plain_python(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    model = language_id.train(documents.where(~language_id.held_out(F.col("doc_id"))))
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    labelled = {i: model.label(t) for i, t in rows}
    rows = [(i, t) for i, t in rows if labelled[i][0] != "und" and labelled[i][1] >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    before = dict(rows)
    rows = [(i, t) for i, t in without_recurring_lines(rows) if t == before[i] or t.split()]
    n_before = len(rows)
    rows = near_copies_gone(rows)
    assert n_before - len(rows) >= 10
    items = [shingles(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(s and len(s & shingles(t)) * 100 >= 80 * len(s) for s in items)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    tokenizer.no_truncation()
    want = {}
    for i, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), struct.pack(f"<{len(ids)}I", *ids))
    got = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """Documents with nulls, repeated rows, a null id and an extra column, and an empty benchmark."""
    folder = str(tmp_path_factory.mktemp("odd"))
    text = "the first line of a document in some words\nand the second line of it in other words"
    rows = [(1, text, "en", "s", 3, "x"), (2, text, "en", None, None, None), (3, None, None, None, None, None), (3, "", "en", "s", 0, "x")]
    rows += [(4, "one more text in the same language of some words", "en", "s", 1, "y")] * 2
    rows += [(None, "words of the language of a row that has no id", "en", "s", 1, "z"), (6, "12 34", "en", "s", 5, "z")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_keep_the_columns(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, odd_folder)
        empty = stage(spark, docs.limit(0), odd_folder)
        assert empty.count() == 0, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and empty.columns == docs.columns, name
            assert [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        docs = out
    assert sorted([r.doc_id for r in docs.collect()], key=str) == [1, 4, 4, None]


def test_line_dedup_takes_effect(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.dedup_lines(spark, docs, odd_folder).collect()}
    assert 2 not in out and out[1].n_chars == len(out[1].text)


def test_the_library_works_without_this_part(tmp_path):
    """Nothing outside the subpackage imports it, and the entry point does without."""
    import shutil

    for name in ("tallyloom", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
