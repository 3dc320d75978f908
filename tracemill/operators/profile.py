"""Profiles of a source: for every leaf its types, null share, examples, bounds and distinct share.

Every row becomes one list of (leaf, value) pairs, list elements included, which is counted by leaf and value.
Examples and counts are exact over the rows given; a sample is the caller's choice (``rows.limit(n)``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.paths import quote
from tracemill.functions.redact import sanitized
from tracemill.operators.metrics import ratio

EXAMPLES, SAMPLE = 3, 500


def type_name(t: T.DataType) -> str:
    """Profile name of a type."""
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "float"
    names = {T.BooleanType: "boolean", T.DateType: "date", T.DecimalType: "decimal", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.DayTimeIntervalType: "duration", T.NullType: "null"}
    return next((n for k, n in names.items() if isinstance(t, k)), "time" if "time" in t.simpleString() else "unknown")


Opened = Callable[[Column], Column]


def leaves(t: T.DataType, path: str = "$") -> Iterator[tuple[str, T.DataType, Opened]]:
    """(path, type, value -> its leaf values as text) of every leaf: structs are walked, lists are opened.

    A list that is null or empty has one value, null. Binary values are told by their hexadecimal digits.
    """
    if isinstance(t, T.StructType):
        for f in t.fields:
            for own, kind, inner in leaves(f.dataType, path + quote(f.name)):
                yield own, kind, lambda x, n=f.name, g=inner: g(x.getField(n))
    elif isinstance(t, T.ArrayType):
        nothing = F.array(F.lit(None).cast(t.elementType))
        for own, kind, inner in leaves(t.elementType, path + "[]"):
            yield own, kind, lambda x, g=inner, e=nothing: F.flatten(F.transform(F.when(F.size(x) > 0, x).otherwise(e), lambda y: g(y)))
    else:
        yield path, t, lambda x, binary=isinstance(t, T.BinaryType): F.array(F.hex(x) if binary else x.cast("string"))


def entries_of(number: int, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(number).alias("leaf"), v.alias("value")))


def profile(df: DataFrame, order: str | None = None) -> DataFrame:
    """One row per leaf: path, types, null_ratio, examples, min, max, distinct_ratio.

    Two scans, however many leaves there are: one counts the values of all leaves, one takes the first examples.
    """
    at = F.col(order) if order else F.monotonically_increasing_id()
    data = T.StructType([f for f in df.schema.fields if f.name != order])
    found = [(path, kind, g(F.struct(*[F.col(f"`{f.name}`") for f in data.fields]))) for path, kind, g in leaves(data)]
    if not found:
        return empty_profile(df.sparkSession)
    own = df.select(at.alias("at"), F.explode(F.concat(*[entries_of(i, c) for i, (_, _, c) in enumerate(found)])).alias("e")).select("at", "e.*")

    of = lambda *kinds: F.col("leaf").isin(*[i for i, (_, k, _) in enumerate(found) if isinstance(k, kinds)])
    number = F.struct(F.when(of(T.IntegralType), F.col("value").try_cast("long")), F.when(of(T.FractionalType, T.DecimalType), F.col("value").try_cast("double")))
    rank = F.when(of(T.NumericType) & F.col("value").isNotNull(), number)
    counts = own.groupBy("leaf", "value").agg(F.count("*").alias("n"))
    measured = counts.groupBy("leaf").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("present"), F.count("value").alias("distinct"),
        F.min_by("value", rank).alias("min"), F.max_by("value", rank).alias("max"),
    )

    first = F.row_number().over(Window.partitionBy("leaf").orderBy("at"))
    few = own.filter(F.col("value").isNotNull()).withColumn("k", first).filter(F.col("k") <= EXAMPLES)
    shown = F.when(of(T.BinaryType), F.concat(F.lit("[BINARY:"), (F.length("value") / 2).cast("long").cast("string"), F.lit(" bytes]"))).otherwise(sanitized(F.col("value")))
    examples = few.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("k", shown.alias("x")))).alias("examples"))

    names = df.sparkSession.createDataFrame([(i, path, type_name(k)) for i, (path, k, _) in enumerate(found)], "leaf int, path string, kind string")
    out = names.join(measured, "leaf", "left").join(examples, "leaf", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "present", "distinct")})
    missing, present = F.col("total") - F.col("present"), F.col("present")
    types = F.when((present == 0) & (missing > 0), F.array(F.lit("null"))).when(missing > 0, F.array("kind", F.lit("null"))).otherwise(F.array("kind"))
    return out.select(
        "path",
        types.alias("types"),
        F.coalesce(ratio(missing, F.col("total")), F.lit(0.0)).alias("null_ratio"),
        F.coalesce(F.transform("examples", lambda e: e["x"]), F.array().cast("array<string>")).alias("examples"),
        "min",
        "max",
        ratio(F.col("distinct"), present).alias("distinct_ratio"),
    )


def record_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("record_count"))


def empty_profile(spark: SparkSession) -> DataFrame:
    """The profile of a file without content."""
    return spark.createDataFrame([], "path string, types array<string>, null_ratio double, examples array<string>, min string, max string, distinct_ratio double")
