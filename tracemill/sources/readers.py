"""Sources: JSON lines (strict or explained), CSV and Parquet, their formats and line numbers."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File name endings of each format.
SUFFIXES = {".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv", ".parquet": "parquet", ".pq": "parquet"}
PARQUET_MAGIC = b"PAR1"


def infer_format(name: str) -> str:
    suffix = PurePosixPath(name).suffix.lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"no format for {suffix!r}")
    return SUFFIXES[suffix]


def scan_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Schema over the whole input."""
    return spark.read.option("samplingRatio", 1.0).json(path)


def scan_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header and inferred types over the whole input; blank cells are null."""
    return spark.read.option("header", True).option("inferSchema", True).option("multiLine", False).csv(path)


def scan_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One path under its own schema, several under that of them all."""
    return spark.read.parquet(path) if isinstance(path, str) else spark.read.option("mergeSchema", True).parquet(*path)


def scan_file(spark: SparkSession, path: str | list[str], fmt: str | None = None) -> DataFrame:
    readers = {"jsonl": scan_jsonl, "csv": scan_csv, "parquet": scan_parquet}
    fmt = fmt or infer_format(path if isinstance(path, str) else path[0])
    if fmt not in readers:
        raise ValueError(f"unsupported format {fmt!r}")
    return readers[fmt](spark, path)


def read_head(spark: SparkSession, path: str, fmt: str | None = None, limit: int = 20) -> DataFrame:
    """First rows under the schema of the whole input, so head and import agree."""
    return scan_file(spark, path, fmt).limit(limit)


def settled(df: DataFrame) -> DataFrame:
    """df written once to the checkpoint folder as a table, so that every later read sees the same rows in the same files."""
    session, context = df.sparkSession, df.sparkSession.sparkContext
    root = session.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tracemill-")
        session.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return session.read.schema(df.schema).parquet(path)


def numbered(lines: DataFrame, to: str = "line") -> DataFrame:
    """Dense line numbers from 1 in input order.

    The rows are read twice and must come in the same partitions both times: files do, other frames need
    settled(). No global sort and no single task: the starts of the partitions, one row for each, are joined
    by broadcast, so they grow with the number of partitions only.
    """
    tagged = lines.withColumn("__id", F.monotonically_increasing_id())
    return _started(tagged, {to: F.lit(True)}).withColumn(to, F.col(to) + F.col("__id").bitwiseAND(_WITHIN) + 1).drop("__id")


_WITHIN = (1 << 33) - 1


def _started(tagged: DataFrame, counted: dict[str, Column]) -> DataFrame:
    """Add for each name how many rows of the partitions before that of __id meet its condition."""
    part = F.shiftright("__id", 33).alias("__part")
    counts = tagged.groupBy(part).agg(*[F.count_if(c).alias(n) for n, c in counted.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in counted])
    return tagged.withColumn("__part", part).join(F.broadcast(starts), "__part").drop("__part")


#: A record of one of several files is known by its file's number in the upper bits and its line there in the lower ones.
LINE_BITS = 40


def line_in_file(line: Column) -> Column:
    return line.bitwiseAND((1 << LINE_BITS) - 1)


def file_number(line: Column) -> Column:
    return F.shiftright(line, LINE_BITS).cast("int")


def text_lines(reader, path: str) -> DataFrame:
    """Lines of text files (value, file, block) by a reader, batch or stream; block is where the split begins."""
    meta = F.col("_metadata")
    return reader.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"))


def _blank(value: str) -> Column:
    return F.btrim(value, F.lit(" \t\r\n\x0b\x0c")) == ""


def _judged(rows: DataFrame, others: list[str]) -> DataFrame:
    """Parse the kept lines and say what is wrong with those that hold no JSON object."""
    rows = rows.withColumn("v", F.try_parse_json("value")).withColumn("type", F.schema_of_variant("v"))
    broken = F.when(F.col("v").isNull(), "INVALID_JSON").when(~F.col("type").startswith("OBJECT"), "NOT_AN_OBJECT")
    rows = rows.withColumn("broken", broken).withColumn("v", F.when(F.col("broken").isNull(), F.col("v")))
    return rows.select("line", "physical", F.col("value").alias("raw"), "v", "broken", *others)


def explained(lines: DataFrame) -> DataFrame:
    """Lines (value, and other columns) as (line, physical, raw, v, broken): blank lines are neither kept nor counted.

    ``line`` counts the kept lines and ``physical`` all, both from 1. ``broken`` says that a line holds no JSON
    (INVALID_JSON) or none that is an object (NOT_AN_OBJECT); its v is null.
    """
    kept = ~_blank("value")
    tagged = _started(lines.withColumn("__id", F.monotonically_increasing_id()), {"physical": F.lit(True), "line": kept})
    rows = tagged.withColumn("physical", F.col("physical") + F.col("__id").bitwiseAND(_WITHIN) + 1).filter(kept)
    # of the rows that the filter leaves, a partition's ids are dense again
    rows = rows.withColumn("line", F.col("line") + F.monotonically_increasing_id().bitwiseAND(_WITHIN) + 1)
    return _judged(rows, [c for c in lines.columns if c != "value"])


def explained_by_file(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines as explained() has them, with numbers that count within their own file; files).

    lines: see text_lines(). ``line`` holds the number of the file above LINE_BITS and the kept lines of the file below,
    so it still tells all lines apart; ``physical`` counts all lines of the file. files: (number, file).

    A split counts its own lines. Its lines follow each other in one partition, so what a line adds to the start of its
    split is its place there; starts are sums over the splits before, in the file and in the partition. One row a split.
    """
    kept = ~_blank("value")
    tagged = lines.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    splits = tagged.groupBy("__part", "file", "block").agg(F.min("__id").alias("__from"), F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("k"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    in_file, in_part = before(Window.partitionBy("file").orderBy("block")), before(Window.partitionBy("__part").orderBy("__from"))
    starts = splits.select(
        "file", "block", "__from",
        F.coalesce(F.sum("n").over(in_file), F.lit(0)).alias("__lines"),
        (F.coalesce(F.sum("k").over(in_file), F.lit(0)) - F.coalesce(F.sum("k").over(in_part), F.lit(0))).alias("__kept"),
    )
    files = splits.select("file").distinct().withColumn("number", F.row_number().over(Window.orderBy("file"))).select("number", "file")  # one row a file
    rows = tagged.filter(kept).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(_WITHIN) + 1)
    rows = rows.join(starts.join(files, "file"), ["file", "block"])
    line = F.shiftleft(F.col("number").cast("long"), LINE_BITS) + F.col("__kept") + F.col("__at")
    rows = rows.withColumn("physical", F.col("__lines") + F.col("__id") - F.col("__from") + 1).withColumn("line", line)
    return _judged(rows, [c for c in lines.columns if c not in ("value", "block")]), files


def read_records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """JSON lines as (line, raw, v): blank lines are neither kept nor counted.

    A line that holds no JSON object fails the read with its physical number where ``strict``; otherwise its
    v is null and the caller explains it (see explained()).
    """
    rows, v = explained(spark.read.text(path)), F.col("v")
    if strict:
        told = F.concat(F.lit("line "), F.col("physical").cast("string"), F.lit(": not a JSON object"))
        v = F.when(F.col("broken").isNotNull(), F.try_parse_json(F.raise_error(told).cast("string"))).otherwise(v)
    return rows.select("line", "raw", v.alias("v"))


def as_records(df: DataFrame, line: str = "line") -> DataFrame:
    """Rows of a typed source as (line, raw, v); null columns become absent members."""
    data = [c for c in df.columns if c != line]
    own = df if line in df.columns else numbered(df, line)
    raw = F.to_json(F.struct(*data))
    return own.select(F.col(line).alias("line"), raw.alias("raw"), F.try_parse_json(raw).alias("v"))


def sniff(head: bytes, name: str) -> str:
    """Format of a file from its first bytes; evidence beats the name. Raises ValueError for none."""
    if head.startswith(PARQUET_MAGIC):
        return "parquet"
    try:
        text = head.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < len(head) - 4:  # more than a cut-off last character
            raise ValueError("neither Parquet nor UTF-8 text") from e
        text = head[: e.start].decode("utf-8")
    first = next((x for x in text.splitlines() if x.strip()), "")
    if first.lstrip().startswith("{"):
        return "jsonl"
    named = infer_format(name)
    if named != "csv":
        raise ValueError(f"the content is not {named}")
    return "csv"


def empty_records(spark: SparkSession) -> DataFrame:
    """What a file without content holds."""
    return spark.createDataFrame([], "line long, raw string").withColumn("v", F.try_parse_json("raw"))
