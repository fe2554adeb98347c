from __future__ import annotations

import hashlib
import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.functions.running_sha import RunningSha256
from tallyloom.operators import profile
from tallyloom.session import materialise, shared_folder
from tallyloom.sources import files, sinks
from tallyloom.streaming import jobs


def test_csv_with_quotes_and_blanks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id , note\n1,"a, ""b"""\n2,\n', encoding="utf-8")
    df = files.csv_scan(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["id", "note"]
    assert rows(df, "id") == [{"id": 1, "note": 'a, "b"'}, {"id": 2, "note": None}]


def test_latin1_is_recognised(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("name\nZoë\n".encode("latin-1"))
    (tmp_path / "u.csv").write_bytes("name\nZoë\n".encode())
    assert files.csv_encoding(spark, str(tmp_path / "t.csv")) == "ISO-8859-1"
    assert files.csv_encoding(spark, str(tmp_path / "u.csv")) == "UTF-8"
    for name in ("t.csv", "u.csv"):
        assert files.csv_scan(spark, str(tmp_path / name)).first()["name"] == "Zoë"


def test_parquet_is_preferred(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a\n1\n")
    target = str(tmp_path / "t.parquet")
    assert rows(files.dataset_scan(spark, target, str(tmp_path / "t.csv"))) == [{"a": 1}]
    sinks.write_parquet(spark.range(1).select(F.lit(5).alias(" a "), F.lit(None).alias("v")), target)
    got = files.dataset_scan(spark, target, str(tmp_path / "t.csv"))
    assert rows(got) == [{"a": 5, "v": None}] and got.schema["v"].dataType.simpleString() == "string"
    with pytest.raises(FileNotFoundError):
        files.dataset_scan(spark, str(tmp_path / "none"), None)


def test_results_replace_their_own_dataset_only(spark, tmp_path):
    path = str(tmp_path / "results")
    sinks.write_results(spark.range(3), path, "a")
    sinks.write_results(spark.range(2), path, "b")
    sinks.write_results(spark.range(1), path, "a")
    got = rows(sinks.read_results(spark, path), "dataset_id", "id")
    assert [(r["dataset_id"], r["id"]) for r in got] == [("a", 0), ("b", 0), ("b", 1)]


def test_preview_json(spark):
    df = spark.createDataFrame([(2, float("nan"), "x"), (1, 1.23456, None), (3, float("inf"), "y")], "k int, v double, s string")
    got = [json.loads(r.json) for r in files.preview_json(df, "k", 2).orderBy("key").collect()]
    assert got == [{"k": 1, "v": 1.2346, "s": None}, {"k": 2, "v": None, "s": "x"}]


def test_head_notes(spark):
    df = spark.createDataFrame([(i, True, "w" if i < 3 else None) for i in range(30)], "k int, b boolean, s string")
    head, notes = files.head_preview(df, 20, "k")
    got = {r["column_name"]: r for r in rows(notes)}
    assert head.count() == 20
    assert {c: r["data_type"] for c, r in got.items()} == {"k": "integer", "b": "boolean", "s": "categorical"}
    assert got["k"]["sample_values"] == ["0", "1", "2", "3", "4"] and got["s"]["sample_values"] == ["w"] * 3


def test_duplicates_stay_inside_a_workspace(spark):
    df = spark.createDataFrame([("w", "h", 2), ("w", "h", 1), ("v", "h", 3), ("w", "g", 4)], "w string, h string, k int")
    got = {r["k"]: r for r in rows(files.flag_duplicates(df, "w", "h", "k"))}
    assert {k: r["is_duplicate"] for k, r in got.items()} == {1: False, 2: True, 3: False, 4: False}
    assert got[2]["first_key"] == 1 and got[3]["copies"] == 1


def test_hashes_and_storage(spark, tmp_path):
    for folder, name in (("a", "1"), ("a", "2"), ("b", "1")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(b"same" if name == "1" else b"other!")
    hashes = rows(files.file_hashes(spark, str(tmp_path)), "path")
    assert hashes[0]["hash"] == hashes[2]["hash"] != hashes[1]["hash"] and len(hashes[0]["hash"]) == 64
    used = rows(files.storage_usage(spark, str(tmp_path), 100), "folder")
    assert [(u["bytes"], u["files"], u["quota_pct"]) for u in used] == [(10, 2, 10.0), (4, 1, 4.0)]


def test_long_files_are_hashed_in_steps(spark, tmp_path):
    """Any bytes, lines, names and step; no task reads a long file whole."""
    rng = random.Random(5)
    noise, lines = rng.randbytes(30_000), b"".join(b"x" * rng.randrange(60) + b"\n" for _ in range(900))
    contents = {
        "noise": noise, "lines": lines, "open": lines + b"end", "marked": b"\xef\xbb\xbf" + lines, "marked open": b"\xef\xbb\xbf" + lines + b"\r",
        "ends": b"\n" * 50_000, "one line": b"y" * 90_000, "crlf": lines.replace(b"\n", b"\r\n"), "é %41.gz": noise, "x.bz2": b"\xef\xbb\xbf" + noise[::-1],
        "short": b"s", "step": b"z" * 16384, "deep/same": noise,
    }
    (tmp_path / "deep").mkdir()
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    want = {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in contents.items()}
    whole = {r["path"]: r for r in rows(files.file_hashes(spark, str(tmp_path)))}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("9000", "70000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = {r["path"]: r for r in rows(files.file_hashes(spark, str(tmp_path), step=16384))}
            assert found == whole
            assert {k.split(f"{tmp_path}/")[1]: (r["length"], r["hash"]) for k, r in found.items()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_digest_goes_on_elsewhere():
    data = random.Random(7).randbytes(1000)
    for cut in (0, 1, 63, 64, 65, 999, 1000):
        first = RunningSha256()
        first.update(data[:cut])
        second = RunningSha256(first.state())
        second.update(data[cut:])
        assert second.hexdigest() == hashlib.sha256(data).hexdigest() and first.hexdigest() == hashlib.sha256(data[:cut]).hexdigest()


def test_shared_folder_comes_from_the_session(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert folder and (before is None or folder == before)
    assert shared_folder(spark) == folder
    assert rows(materialise(spark.range(2), "test"), "id") == [{"id": 0}, {"id": 1}]


class Settings:
    """Stands in for a session with the given settings."""

    def __init__(self, **values):
        self.values = {k.replace("_", "."): v for k, v in values.items()}
        self.conf = self

    def get(self, name, default=None):
        return self.values.get(name, default)


def test_only_a_local_session_may_use_its_own_folder():
    local = Settings(spark_master="local[2]")
    assert shared_folder(local) == shared_folder(local)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Settings(spark_master="yarn"))
    assert shared_folder(Settings(spark_master="yarn", spark_checkpoint_dir="hdfs:/shared")) == "hdfs:/shared"


def test_intermediates_go_with_their_scope(spark):
    from pathlib import Path

    from tallyloom.session import materialise, scratch_scope

    def stored(df):
        return Path(df.inputFiles()[0].removeprefix("file:")).parent

    kept = stored(materialise(spark.range(3), "kept"))
    with scratch_scope(spark):
        inner = materialise(spark.range(3), "inner")
        folder = stored(inner)
        assert inner.count() == 3 and folder.exists()
    assert kept.exists() and not folder.exists()


def test_streamed_profile_equals_the_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(100).select("id", F.when(F.col("id") % 4 > 0, F.col("id") / 2).alias("v"), F.lit("x").alias("s"))
    df.repartition(5).write.parquet(source)
    jobs.profile_stream(spark, source, df.schema, target).awaitTermination()
    got = {r["column_name"]: r for r in rows(spark.read.parquet(target))}
    want = {r["column_name"]: r for r in rows(profile.profile_light(df, "t"))}
    for name in df.columns:
        assert all(got[name][m] == want[name][m] for m in ("row_count", "missing_count", "min", "max"))
    assert got["v"]["mean"] == pytest.approx(want["v"]["mean"])


def test_daily_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(48).select(F.timestamp_seconds(F.col("id") * 3600).alias("at"), F.lit(1.5).alias("v"), (F.col("id") % 2).alias("g"))
    df.write.parquet(source)
    for _ in range(2):  # a second run over the same files changes nothing
        jobs.daily_stream(spark, source, df.schema, target, "at", "v", "g").awaitTermination()
    got = rows(jobs.daily_table(spark, target, "g"), "day", "g")
    assert [(r["rows"], r["amount"]) for r in got] == [(12, 18.0)] * 4


def test_streams_go_on_where_they_ended(spark, tmp_path):
    """New files of a second start are added to the first one's; each file is read once, and later batches win."""
    source, totals, profiled = str(tmp_path / "in"), str(tmp_path / "totals"), str(tmp_path / "profile")
    at = F.timestamp_seconds(F.lit(0)).alias("at")
    parts = [[1e-9, 3e-9], [1e33], [0.0, 2.0, 4.0]]
    seen: list[float] = []
    for k, values in enumerate(parts):
        df = spark.createDataFrame([(v,) for v in values], "v double").select(at, "v", F.lit("g").alias("g")).coalesce(1)
        df.write.mode("append").parquet(source)
        seen += values
        jobs.daily_stream(spark, source, df.schema, totals, "at", "v", "g", late="9 days").awaitTermination()
        jobs.profile_stream(spark, source, df.schema, profiled).awaitTermination()
        (day,) = rows(jobs.daily_table(spark, totals, "g"))
        assert day["rows"] == len(seen) and day["amount"] == pytest.approx(sum(seen))
        (v,) = [r for r in rows(spark.read.parquet(profiled)) if r["column_name"] == "v"]
        assert v["row_count"] == len(seen) and v["mean"] == pytest.approx(sum(seen) / len(seen))
    # All but the last batch of the runs before are merged; what is read doesn't grow with the runs.
    bases, batches = (sorted(p.name for p in (tmp_path / name).glob("*=*")) for name in ("totals-base", "totals"))
    assert len(bases) == 1 and len(batches) <= 3


def test_daily_stream_over_several_triggers(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(48).select(F.timestamp_seconds(F.col("id") * 3600).alias("at"), F.lit(1.0).alias("v"), F.lit("g").alias("g"))
    df.repartition(6).write.parquet(source)
    totals = jobs.daily_totals(jobs.file_stream(spark, source, df.schema, files_per_trigger=1), "at", "v", "g", "9 days")
    jobs._updates(totals.select(F.col("day.start").alias("day"), "g", "rows", "amount"), target).awaitTermination()
    assert spark.read.parquet(target).select("batch").distinct().count() >= 6
    assert [(r["rows"], r["amount"]) for r in rows(jobs.daily_table(spark, target, "g"), "day")] == [(24, 24.0)] * 2


def test_merging_updates_survives_an_end_at_any_point(spark, tmp_path, monkeypatch):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(48).select(F.timestamp_seconds(F.col("id") * 3600).alias("at"), F.lit(1.0).alias("v"), F.lit("g").alias("g"))
    df.repartition(6).write.parquet(source)
    totals = jobs.daily_totals(jobs.file_stream(spark, source, df.schema, files_per_trigger=1), "at", "v", "g", "9 days")
    jobs._updates(totals.select(F.col("day.start").alias("day"), "g", "rows", "amount"), target).awaitTermination()
    want = rows(jobs.daily_table(spark, target, "g"), "day")
    (tmp_path / "out-base/upto=3").mkdir(parents=True)  # begun, never finished
    assert rows(jobs.daily_table(spark, target, "g"), "day") == want
    with monkeypatch.context() as patch:
        patch.setattr(jobs, "_delete", lambda *_: None)  # ended before anything was deleted
        jobs.merge_updates(spark, target, "g")
        assert rows(jobs.daily_table(spark, target, "g"), "day") == want
    for _ in range(2):
        jobs.merge_updates(spark, target, "g")
        assert rows(jobs.daily_table(spark, target, "g"), "day") == want
    assert len(list((tmp_path / "out").glob("batch=*"))) == 1 and len(list((tmp_path / "out-base").glob("upto=*"))) == 1


def test_sessions_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    """Over two starts, with a session that goes on from one to the other; open ones come once they close."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")

    def part(seconds):
        return spark.createDataFrame([(k, s, 1.0) for k in ("a", "b") for s in seconds], "k string, s long, v double").select(
            "k", F.timestamp_seconds("s").alias("at"), "v"
        )

    everything = None
    for seconds in ([0, 100, 5000], [5200, 9000], [500_000]):
        df = part(seconds)
        df.coalesce(1).write.mode("append").parquet(source)
        everything = df if everything is None else everything.unionByName(df)
        jobs.session_stream(spark, source, df.schema, target, "at", "k", "v", "10 minutes", late="1 hour").awaitTermination()
    got = rows(spark.read.parquet(target), "k", "start")
    want = [r for r in rows(jobs.sessions(everything, "at", "k", "v", "10 minutes"), "k", "start") if r["rows"] and r["start"].timestamp() < 400_000]
    assert got == want and sorted(r["rows"] for r in got) == [1, 1, 2, 2, 2, 2]
