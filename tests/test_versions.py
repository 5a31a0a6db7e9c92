"""Committed versions and references: write, read back, and what a broken write leaves."""

import datetime as dt
import os

import pytest

from sparkclin.sources import versions as V


def test_versions_are_listed_newest_first(spark, tmp_path):
    data, root = str(tmp_path / "data.parquet"), str(tmp_path / "root")
    spark.range(100).repartition(3).write.parquet(data)
    first = V.version_data(spark, data, root, "d", "initial", version_ts=dt.datetime(2026, 1, 1)).first()
    on_disk = {f: os.path.getsize(os.path.join(data, f)) for f in os.listdir(data) if f.endswith(".parquet")}
    assert (first.n_rows, first.message, first.path, first.n_columns, first.column_names) == (100, "initial", data, 1, ["id"])
    assert (first.n_files, first.size_bytes) == (len(on_disk), sum(on_disk.values()))
    files = {os.path.basename(r.path): r for r in V.version_files(spark, root, first.version).collect()}
    assert {f: r.size_bytes for f, r in files.items()} == on_disk and sum(r.n_rows for r in files.values()) == 100

    spark.range(100, 150).coalesce(1).write.mode("append").parquet(data)
    second = V.version_data(spark, data, root, "d", "more", version_ts=dt.datetime(2026, 1, 2)).first()
    V.version_data(spark, data, root, "other", version_ts=dt.datetime(2026, 1, 3))
    assert [r.message for r in V.version_records(spark, root, "d").collect()] == ["more", "initial"]
    assert second.n_rows == 150 and second.fingerprint != first.fingerprint
    changed = V.changed_files(spark, root, first.version, second.version).collect()
    assert [r.change for r in changed] == ["added"]


def test_a_version_without_a_record_is_not_there(spark, tmp_path):
    data, root = str(tmp_path / "data.parquet"), str(tmp_path / "root")
    spark.range(5).write.parquet(data)
    V.version_data(spark, data, root, "d")
    V.file_list(spark.read.parquet(data)).write.parquet(f"{root}/files/version=broken")  # a job that died before its record
    assert V.version_records(spark, root).count() == 1


def test_references_keep_their_statistics(spark, tmp_path):
    path = str(tmp_path / "ref")
    old = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "c")], "x double, s string")
    v1 = V.write_reference(old, path, "first")
    V.write_reference(old.where("x = 3"), path, "second")
    V.write_reference(old, path, "of another name", name="b")
    assert [r.x for r in V.read_reference(spark, path).collect()] == [3.0]
    assert V.read_reference(spark, path, version=v1).count() == 3
    s = V.read_reference_statistics(spark, path, version=v1).first()
    assert (s.col_name, s["count"], s["mean"], s["min"], s.p50, s["max"]) == ("x", 2, 2.0, 1.0, 2.0, 3.0)
    records = {r.description: r for r in spark.read.parquet(f"{path}/commits").collect()}
    assert records["first"].n_rows == 3 and records["first"].column_names == ["x", "s"]
    with pytest.raises(FileNotFoundError):
        V.read_reference(spark, path, "missing")
