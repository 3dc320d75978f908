"""Content store: files under the hash of their bytes, each content once, as rows of (sha256, number, bytes).

A file is never held whole. Its hash runs over ranged reads of CHUNK bytes, and its chunks are read again by range,
many tasks to a file, each against the checksum that the hashing pass took of it. So memory is a few chunks a task,
however large a file is; only the running hash itself is one task a file.

``target/chunk`` holds the chunks and ``target/content`` a row for each whole content (sha256, size, chunks, upload),
written last: chunks of an upload that broke off have no content row and are never seen.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.sources.readers import settled

MAX_BYTES = 512 << 20
CHUNK = 1 << 20
#: Chunks that a writing task takes of one file in a row.
RUN = 64
#: A row group holds a few chunks and is looked at after each, so that neither writers nor readers hold more.
PARQUET = {
    "parquet.block.size": 8 * CHUNK, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1,
    "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled#bytes": "false",
}
CONTENT = "sha256 string, size long, chunks long, upload string"
STORED = "sha256 string, upload string, number long, bytes binary"


def opened(path: str):
    """A file that can be read by range, in any store that Arrow reaches; paths are as Spark names them."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/") if colon else path)
    store, own = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(own)


def hashed(path: str, chunk: int = CHUNK) -> tuple[int, str, list[int]]:
    """(size, sha256 in hexadecimal, crc32 of each chunk) of a file, one chunk in memory at a time."""
    whole, size, sums = hashlib.sha256(), 0, []
    with opened(path) as f:
        while part := f.read(chunk):
            whole.update(part)
            sums.append(zlib.crc32(part))
            size += len(part)
    return size, whole.hexdigest(), sums


def _hashing(chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                size, sha256, sums = hashed(path, chunk)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([sha256]), pa.array([sums], pa.list_(pa.int64()))], ["path", "size", "sha256", "sums"])

    return run


def _chunking(chunk: int, upload: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks asked for as (path, sha256, number, sum), in the order of paths, as rows of STORED; one leaves at a time."""

    def run(batches):
        f, at = None, None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["path"] != at:
                        if f is not None:
                            f.close()
                        f, at = opened(row["path"]), row["path"]
                    f.seek(row["number"] * chunk)
                    part = f.read(chunk)
                    if zlib.crc32(part) != row["sum"]:
                        raise ValueError(f"{at} changed while it was stored")
                    yield pa.RecordBatch.from_arrays([pa.array([row["sha256"]]), pa.array([upload]), pa.array([row["number"]], pa.int64()), pa.array([part], pa.binary())], ["sha256", "upload", "number", "bytes"])
        finally:
            if f is not None:
                f.close()

    return run


def content_hash(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, chunk: int = CHUNK) -> DataFrame:
    """(path, size, sha256, sums) of files up to max_bytes; larger ones fail before they are read. sums: crc32 by chunk."""
    files = spark.read.format("binaryFile").load(path)  # no content is asked for, so none is read here
    large = F.raise_error(F.concat(F.lit("the file is too large: "), "path")).cast("string")
    fit = files.select(F.when(F.col("length") <= max_bytes, F.col("path")).otherwise(large).alias("path"))
    return fit.mapInArrow(_hashing(chunk), "path string, size long, sha256 string, sums array<long>")


def known_uploads(new: DataFrame, stored: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Files whose content is already stored; with ``runs`` (sha256, run_id) their earlier runs as well, in order."""
    known = new.join(stored.select("sha256"), "sha256", "left_semi")
    if runs is None:
        return known
    earlier = runs.groupBy("sha256").agg(F.sort_array(F.collect_set("run_id")).alias("previous_runs"))  # runs of one content
    return known.join(earlier, "sha256", "left").withColumn("previous_runs", F.coalesce("previous_runs", F.array().cast(earlier.schema["previous_runs"].dataType)))


def contents(spark: SparkSession, target: str) -> DataFrame:
    """(sha256, size, chunks, upload) of every whole content; of two uploads of one at a time, one counts."""
    try:
        rows = spark.read.schema(CONTENT).parquet(f"{target}/content")
    except AnalysisException as e:  # nothing was stored yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CONTENT)
    return rows.groupBy("sha256").agg(F.min(F.struct("upload", "size", "chunks")).alias("c")).select("sha256", "c.size", "c.chunks", "c.upload")


def chunks(spark: SparkSession, target: str) -> DataFrame:
    """(sha256, number, bytes) of whole contents, numbers from 0. The chunks stay where they are if the contents fit a broadcast."""
    return spark.read.schema(STORED).parquet(f"{target}/chunk").join(contents(spark, target).select("sha256", "upload"), ["sha256", "upload"], "left_semi").select("sha256", "number", "bytes")


def store_by_content(spark: SparkSession, path: str, target: str, max_bytes: int = MAX_BYTES, chunk: int = CHUNK) -> DataFrame:
    """Store the files of ``path``, each content once: (path, size, sha256, is_new).

    Empty files are not there for Spark's file sources, so they are not stored (see empty_records()). Only contents
    that are new are read a second time. A failure leaves the store as it was; files that change between the two
    reads fail the upload.
    """
    known = contents(spark, target).select("sha256", F.lit(True).alias("known"))
    new = settled(content_hash(spark, path, max_bytes, chunk).join(known, "sha256", "left").withColumn("is_new", F.col("known").isNull()).drop("known"))
    first = new.filter("is_new").groupBy("sha256").agg(F.min(F.struct("path", "size", "sums")).alias("f")).select("sha256", "f.*")
    upload = uuid.uuid4().hex
    count = first.agg(F.coalesce(F.sum(F.size("sums")), F.lit(0))).first()[0]
    if count:
        asked = first.select("path", "sha256", F.posexplode("sums").alias("number", "sum"))
        dealt = asked.repartition(min(count // RUN + 1, 10_000), "path", F.floor(F.col("number") / RUN)).sortWithinPartitions("path", "number")
        stored = dealt.select("path", "sha256", F.col("number").cast("long").alias("number"), "sum").mapInArrow(_chunking(chunk, upload), STORED)
        stored.write.options(**PARQUET).mode("append").parquet(f"{target}/chunk")
    whole = first.select("sha256", "size", F.size("sums").cast("long").alias("chunks"), F.lit(upload).alias("upload"))
    whole.write.mode("append").parquet(f"{target}/content")
    return new.select("path", "size", "sha256", "is_new")
