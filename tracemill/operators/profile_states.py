"""Profiles that are kept by file and merged: a new file costs a scan of its own and no other file is read again.

A state is a row for each file and leaf: counts, smallest and largest value, first examples and a sketch of the
distinct values (HyperLogLog, 2^LOG_K registers: a standard error of 1.04 / 2^(LOG_K / 2), 0.8 %). Its size does not
depend on the file's. Only states are shuffled: values are counted where they are read. For exact distinct counts
there is profile.profile(), which shuffles every different value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.redact import sanitized
from tracemill.operators.metrics import ratio
from tracemill.operators.profile import EXAMPLES, entries_of, leaves, type_name
from tracemill.sources.readers import infer_format, scan_file

LOG_K = 14
#: Values of a leaf are dealt to so many lanes to find how far its first examples reach.
LANES = 61
RANK = "struct<near:double,whole:long>"
STATE = f"file string, path string, kind string, rows long, total long, present long, distinct binary, low struct<rank:{RANK},value:string>, high struct<rank:{RANK},value:string>, examples array<struct<at:long,value:string>>"
#: The path of a file's own row, which it has even if it has no leaf; ``rows`` is the number of the file's rows in each.
ROWS = "$"


def states(df: DataFrame, file: str = "file", order: str | None = None) -> DataFrame:
    """The states of rows that carry the name of their file, and their order within it (the order read, if none).

    Three scans: one for what is counted, one for how far the first examples reach at most, one for them. A window sorts
    all rows of its task before it keeps the first, so it is only given those up to that bound; without an order, whose
    numbers need not be the same in two scans, it sorts all. The order column is not profiled. Null file names count as one file.
    """
    at = F.col(f"`{order}`") if order else F.monotonically_increasing_id()
    data = T.StructType([f for f in df.schema.fields if f.name not in (file, order)])
    found = list(leaves(data))
    record = F.struct(*[F.col(f"`{f.name}`") for f in data.fields]) if data.fields else F.lit(None)
    entries = [F.array(F.struct(F.lit(-1).alias("leaf"), F.lit(None).cast("string").alias("value")))]
    entries += [entries_of(i, g(record)) for i, (_, _, g) in enumerate(found)]
    own = df.select(F.col(f"`{file}`").cast("string").alias("file"), at.alias("at"), F.explode(F.concat(*entries)).alias("e")).select("file", "at", "e.*")

    of = lambda *kinds: F.col("leaf").isin(*[i for i, (_, k, _) in enumerate(found) if isinstance(k, kinds)])
    # whole numbers above 2^53 are told apart by the second part; others have none
    rank = F.when(of(T.NumericType) & F.col("value").isNotNull(), F.struct(F.col("value").try_cast("double").alias("near"), F.when(of(T.IntegralType), F.col("value").try_cast("long")).alias("whole")))
    bound = F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("value")))
    # sketches leave out empty strings, so values are sketched by their hash
    counted = own.groupBy("file", "leaf").agg(
        F.count(F.lit(1)).alias("total"), F.count("value").alias("present"),
        F.hll_sketch_agg(F.when(F.col("value").isNotNull(), F.xxhash64("value")), LOG_K).alias("distinct"), F.min(bound).alias("low"), F.max(bound).alias("high"),
    )
    # bounds always come with the sketch: beside it they are kept in a hash of objects, alone all rows would be sorted for them
    counted = counted.withColumns({c: F.when(F.length("distinct") > 0, F.col(c)) for c in ("low", "high")})
    first = F.row_number().over(Window.partitionBy("file", "leaf").orderBy("at"))
    some = own.filter(F.col("value").isNotNull())
    few = (_early(some) if order else some).withColumn("k", first).filter(F.col("k") <= EXAMPLES)
    shown = F.when(of(T.BinaryType), F.concat(F.lit("[BINARY:"), (F.length("value") / 2).cast("long").cast("string"), F.lit(" bytes]"))).otherwise(sanitized(F.col("value")))
    examples = few.groupBy("file", "leaf").agg(F.sort_array(F.collect_list(F.struct(F.col("k").cast("long").alias("at"), shown.alias("value")))).alias("examples"))
    names = df.sparkSession.createDataFrame([(-1, ROWS, "record"), *[(i, path, type_name(k)) for i, (path, k, _) in enumerate(found)]], "leaf int, path string, kind string")
    met = counted["file"].eqNullSafe(examples["file"]) & (counted["leaf"] == examples["leaf"])
    out = counted.join(examples, met, "left").select(*[counted[c] for c in counted.columns], "examples").join(F.broadcast(names), "leaf")
    in_file = F.max(F.when(F.col("path") == ROWS, F.col("total"))).over(Window.partitionBy("file"))  # a row a leaf
    made = {"rows": in_file, "examples": F.coalesce("examples", F.array().cast("array<struct<at:bigint,value:string>>"))}
    return out.withColumns(made).select(*T._parse_datatype_string(STATE).names)


def _early(values: DataFrame) -> DataFrame:
    """The values of each file and leaf that come first, EXAMPLES at least where there are as many, and few more.

    The values of a leaf are dealt to LANES lanes. The smallest ``at`` of EXAMPLES lanes are of as many different values,
    so no example comes after the EXAMPLES-th smallest of them. Where fewer lanes hold values, all values are kept.
    """
    lanes = values.withColumn("lane", F.monotonically_increasing_id() % LANES).groupBy("file", "leaf", "lane").agg(F.min("at").alias("at"))
    reach = lanes.groupBy("file", "leaf").agg(F.get(F.sort_array(F.collect_list("at")), F.lit(EXAMPLES - 1)).alias("reach"))  # a value a lane
    reach = reach.select(F.col("file").alias("own_file"), F.col("leaf").alias("own_leaf"), "reach")
    met = values["file"].eqNullSafe(reach["own_file"]) & (values["leaf"] == reach["own_leaf"])
    return values.join(F.broadcast(reach), met).filter(F.col("reach").isNull() | (F.col("at") <= F.col("reach"))).select(*values.columns)


def merged(kept: DataFrame) -> DataFrame:
    """The profile over all files of the states: path, types, null_ratio, examples, min, max, distinct_ratio (estimated).

    Merging is associative and does not depend on the order of files; examples are the first of the files by name. A leaf
    that has several types lists them all. A leaf that a file lacks is missing once in each of its rows.
    """
    of_files, of_leaves = kept.filter(F.col("path") == ROWS), kept.filter(F.col("path") != ROWS)
    rows = of_files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).scalar()
    whole = of_leaves.groupBy("path").agg(
        F.sum("rows").alias("met"), F.sum("total").alias("total"), F.sum("present").alias("present"), F.array_sort(F.collect_set(F.when(F.col("present") > 0, F.col("kind")))).alias("kinds"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    told = of_leaves.select("path", "file", F.explode("examples").alias("e"))
    first = told.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("file", "e.at"))).filter(F.col("k") <= EXAMPLES)
    examples = first.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("k", "e.value"))).alias("examples"))
    missing, present = F.col("total") - F.col("present") + rows - F.col("met"), F.col("present")
    return whole.join(examples, "path", "left").select(
        "path",
        F.when(missing > 0, F.concat("kinds", F.array(F.lit("null")))).otherwise(F.col("kinds")).alias("types"),
        F.coalesce(ratio(missing, missing + present), F.lit(0.0)).alias("null_ratio"),
        F.coalesce(F.transform("examples", lambda e: e["value"]), F.array().cast("array<string>")).alias("examples"),
        F.col("low.value").alias("min"),
        F.col("high.value").alias("max"),
        F.when(present > 0, F.least(F.col("distinct") / present, F.lit(1.0))).alias("distinct_ratio"),
    )


def kept_states(spark: SparkSession, target: str) -> DataFrame:
    """The states under ``target``, none where nothing was kept yet."""
    try:
        return spark.read.schema(STATE).parquet(target)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE)


def profile_files(spark: SparkSession, path: str, target: str, fmt: str | None = None) -> DataFrame:
    """The profile of all files of ``path`` and of those seen before, whose states are kept under ``target``.

    Only files that have no state are read, each format under one schema; their states appear whole or not at all. A file
    is known by its path: one that is written anew under the same path is not read again. One writer at a time.
    """
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "path")
    new = listed.join(kept_states(spark, target).filter(F.col("path") == ROWS).select("file"), "file", "left_anti").collect()  # names of files, as a file index holds them
    by_format: dict[str, list[str]] = {}
    for r in sorted(new):
        by_format.setdefault(fmt or infer_format(r["path"]), []).append(r["path"])
    parts = []
    for own, files in by_format.items():
        df = scan_file(spark, files, own)
        at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
        parts.append(states(df.withColumns({"__file": F.col("_metadata.file_path"), "__at": at}), "__file", "__at"))
    if parts:
        reduce(DataFrame.unionByName, parts).write.mode("append").parquet(target)
    return merged(kept_states(spark, target))
