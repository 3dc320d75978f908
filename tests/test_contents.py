"""The content store: each content once, in chunks, whole or not at all, in bounded memory."""

import hashlib
import subprocess
import sys

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracemill.sources import contents


def whole(spark, target):
    rows = contents.chunks(spark, target).groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("number", "bytes"))).alias("c")).collect()
    return {r["sha256"]: b"".join(bytes(c["bytes"]) for c in r["c"]) for r in rows}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_contents_are_stored_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "kept")
    source.mkdir()
    for name, text in (("a", "x"), ("b", "x"), ("c", "y")):
        (source / name).write_text(text)
    first = contents.store_by_content(spark, str(source), target).collect()
    assert all(r["is_new"] for r in first) and contents.contents(spark, target).count() == 2
    (source / "d").write_text("z")
    again = {r["path"][-1]: r["is_new"] for r in contents.store_by_content(spark, str(source), target).collect()}
    assert again == {"a": False, "b": False, "c": False, "d": True} and whole(spark, target) == {sha(x): x for x in (b"x", b"y", b"z")}
    runs = spark.createDataFrame([(r["sha256"], i) for i, r in enumerate(first)], "sha256 string, run_id int")
    known = contents.known_uploads(contents.content_hash(spark, str(source)), contents.contents(spark, target), runs)
    assert {r["path"][-1]: len(r["previous_runs"]) for r in known.collect()} == {"a": 2, "b": 2, "c": 1, "d": 0}


def test_chunks_give_back_every_length(spark, tmp_path):
    """Lengths around the bounds of chunks, and names with a blank and a per cent sign; an empty file is not there."""
    source, target, chunk = tmp_path / "in", str(tmp_path / "kept"), 1000
    source.mkdir()
    data = {f"n {n}%20x": bytes(i * 7 % 251 for i in range(n)) for n in (0, 1, 999, 1000, 1001, 2000, 45_003)}
    for name, x in data.items():
        (source / name).write_bytes(x)
    data = {name: x for name, x in data.items() if x}
    told = contents.store_by_content(spark, str(source), target, chunk=chunk).collect()
    assert {(r["size"], r["sha256"]) for r in told} == {(len(x), sha(x)) for x in data.values()}
    assert whole(spark, target) == {sha(x): x for x in data.values()}
    assert {r["sha256"]: r["chunks"] for r in contents.contents(spark, target).collect()} == {sha(x): -(-len(x) // chunk) for x in data.values()}
    assert contents.chunks(spark, target).agg(F.max(F.length("bytes"))).first()[0] == chunk


def test_large_files_are_refused_unread(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"12345")
    with pytest.raises(PySparkException, match="too large"):
        contents.content_hash(spark, str(tmp_path), max_bytes=4).collect()
    assert contents.content_hash(spark, str(tmp_path), max_bytes=5).count() == 1


def test_a_broken_upload_is_never_seen(spark, tmp_path, monkeypatch):
    """A failure after the chunks, before the contents, leaves chunks that no reader meets; the repetition is whole."""
    source, target = tmp_path / "in", str(tmp_path / "kept")
    source.mkdir()
    (source / "a").write_bytes(b"abc" * 1000)
    from pyspark.sql.classic.dataframe import DataFrameWriter  # the writer that the store ends with

    real = DataFrameWriter.parquet

    def broken(self, path, *args, **more):
        if path.endswith("/content"):
            raise OSError("lost")
        return real(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(OSError):
        contents.store_by_content(spark, str(source), target, chunk=1000)
    monkeypatch.undo()
    assert spark.read.parquet(f"{target}/chunk").count() == 3
    assert contents.contents(spark, target).count() == 0 and contents.chunks(spark, target).count() == 0
    assert contents.store_by_content(spark, str(source), target, chunk=1000).first()["is_new"]
    assert whole(spark, target) == {sha(b"abc" * 1000): b"abc" * 1000}


def test_a_file_that_changes_fails(tmp_path):
    import pyarrow as pa

    (tmp_path / "a").write_bytes(b"new")
    ask = pa.RecordBatch.from_pylist([{"path": str(tmp_path / "a"), "sha256": "s", "number": 0, "sum": 1}])
    with pytest.raises(ValueError, match="changed"):
        list(contents._chunking(1000, "u")(iter([ask])))


def test_half_a_gigabyte_in_few_chunks(tmp_path):
    """Hashing and cutting 512 MB takes under 300 MB in a process, most of it the libraries."""
    with open(tmp_path / "large", "wb") as f:
        f.truncate(512 << 20)
    code = """
import resource, sys
import pyarrow as pa
from tracemill.sources import contents
size, sha256, sums = contents.hashed(sys.argv[1])
ask = pa.RecordBatch.from_pylist([{"path": sys.argv[1], "sha256": sha256, "number": i, "sum": s} for i, s in enumerate(sums)])
read = sum(len(b.column("bytes")[0].as_py()) for b in contents._chunking(contents.CHUNK, "u")(iter([ask])))
print(size, read, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    size, read, peak = map(int, subprocess.run([sys.executable, "-c", code, str(tmp_path / "large")], capture_output=True, text=True, check=True, cwd=str(contents.__file__).rsplit("/tracemill/", 1)[0]).stdout.split())
    assert size == read == 512 << 20 and peak < 300
