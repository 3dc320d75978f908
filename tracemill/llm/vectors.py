"""What the operators on vectors share: which rows take part, and how long their vectors are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector as array<double>) of the rows whose vector is there, not empty, and finite in every entry."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~odd)


def common_length(rows: DataFrame) -> tuple[int, int]:
    """The length that most vectors have (ties: the longer one), and how many have it; (0, 0) without rows."""
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.agg(F.max(F.struct("n", "d")).alias("most")).first()["most"]
    return (most["d"], most["n"]) if most else (0, 0)
