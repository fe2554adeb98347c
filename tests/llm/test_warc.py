"""Archives: round trips, magic inside payloads, cut files."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pytest
from llm_fixtures import with_clashes

from tallyloom.llm import warc

SCHEMA = "page_id bigint, url string, html string"
RECORD = (
    "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:row:99>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"
    "Content-Type: text/plain\r\nContent-Length: 5\r\n\r\ninner\r\n\r\n"
)
LONG = "x" * 99 + "é"
ROWS = [
    (1, "http://a/", "plain"),
    (2, None, None),
    (3, "http://b/\r\nWARC/1.1\r\n", ""),
    (4, "u", RECORD),
    (5, "u", "WARC/1.1\r\n" * 50),
    (6, "u", "before\r\n\r\nWARC/1.1\r\n" + RECORD + RECORD + "\r\n\r\n"),
    (7, "u", "WARC/1.1\r\nContent-Length: 999999999\r\n\r\n"),
    (8, "é", LONG),
    (9, "u", LONG),
    (10, "a", LONG),
    (8, "é", LONG),
    (None, "u", LONG),
    (11, "u", "x" * 99),
    (12, "u", "x" * 99),
    (13, "u", "WARC/1.1\r\n" + "long " * 500_000 + RECORD),
    (14, "u", "\x00\x1c  ퟿\n\r"),
]


def written(spark, rows, path, parts=3):
    warc.write_archive(with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(parts), path)
    return path


def expected(rows):
    """Plain version: (id, type, refers_to, bytes, digest) in order."""
    first, out = {}, []
    for key, _url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        data = (html or "").encode()
        again = len(data) >= 100 and data in first
        out.append((key, "revisit" if again else "response", first[data] if again else None, len(data), hashlib.sha256(data).hexdigest()))
        first.setdefault(data, key)
    return sorted(out, key=str)


def found(df):
    number = lambda v: None if v is None else int(v)
    return sorted(
        [(number(r.id), r.record_type, number(r.refers_to), r.payload_bytes, r.payload_digest) for r in df.collect()], key=str
    )


@pytest.mark.parametrize("split", ["128m", "1m", "200"])
def test_round_trip(spark, tmp_path, split):
    """Splits of any size, also inside records and magic lines."""
    rows = ROWS if split != "200" else [r for r in ROWS if r[0] != 13]
    path = written(spark, rows, f"{tmp_path}/a")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        records = warc.read_archive(spark, path, payloads=True)
        assert found(records) == expected(rows)
        texts = {(r.id, bytes(r.payload)) for r in records.collect() if r.record_type == "response"}
        assert {(str(i), (t or "").encode()) for i, _, t in rows if i in (1, 2, 3, 4, 5, 6, 7, 14)} <= texts
        assert all(r.intact for r in records.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_without_payloads(spark, tmp_path):
    records = warc.read_archive(spark, written(spark, ROWS, f"{tmp_path}/a", 1))
    assert found(records) == expected(ROWS) and "payload" not in records.columns
    assert records.where("url = 'http://b/%0D%0AWARC/1.1%0D%0A'").count() == 1


def test_offsets_point_at_records(spark, tmp_path):
    for r in warc.read_archive(spark, written(spark, ROWS, f"{tmp_path}/a")).collect():
        data = Path(r.file.removeprefix("file:")).read_bytes()
        assert data[r.offset :].startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())


def test_empty(spark, tmp_path):
    assert warc.read_archive(spark, written(spark, [], f"{tmp_path}/a")).collect() == []


def test_foreign_and_cut_files(spark, tmp_path):
    block = b"\xff\xfe raw \x00 bytes \r\n\r\nWARC/1.1\r\n tail"
    head = b"WARC/1.1\r\nWARC-Type: resource\r\ncontent-length:  %d\r\n\r\n" % len(block)
    whole = head + block + b"\r\n\r\n"
    files = {"two": whole * 2, "cut": whole + whole[:-20], "gap": whole + b"junk" + whole, "headless": b"junk" + whole, "none": b""}
    for name, data in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "f").write_bytes(data)
    got = {n: sorted((r.offset, r.intact, bytes(r.payload)) for r in warc.read_archive(spark, f"{tmp_path}/{n}", True).collect()) for n in files}
    assert got["two"] == [(0, True, block), (len(whole), True, block)]
    assert [g[:2] for g in got["cut"]] == [(0, True), (len(whole), False)]
    assert got["headless"] == got["none"] == []
    assert [g[0] for g in got["gap"]] == [0]
