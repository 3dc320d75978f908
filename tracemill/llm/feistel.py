"""Reproducible shuffle into shards by a Feistel permutation with cycle walking (DataFrame functions only).

Every row gets a global row number (its rank by doc_id, gapless from 0). A balanced Feistel network
over the square a*a >= n, a = ceil(sqrt(n)), permutes the numbers; a number that leaves [0, n) is
permuted again until it is back inside (cycle walking). Shard and slot follow by arithmetic:
``shard = p mod k``, ``slot = p div k``, so shard sizes differ by one row at most and anyone who knows
(n, seed, k) can compute where a row lies.

Only (id, size, checksum) are shuffled, never the texts. The rank needs one range exchange; per-partition
counts (one number a partition) go to the driver.

Defined results: null text counts as empty; null ids rank first; repeated ids are ranked by checksum and
size, fully equal rows are interchangeable and each gets its own slot; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import stored

ROUNDS = 6


def _round(value: Column, seed: int, i: int, a: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(seed), F.lit(i)), F.lit(a))


def permute_once(x: Column, a: int, seed: int, rounds: int = ROUNDS) -> Column:
    """One pass of the network over [0, a*a), as one expression (used by the rare walkers)."""
    left, right = F.floor(x / F.lit(a)).cast("long"), x % F.lit(a)
    for i in range(rounds):
        left, right = right, (left + _round(right, seed, i, a)) % F.lit(a)
    return left * F.lit(a) + right


def permuted(df: DataFrame, number: str, n: int, seed: int, to: str = "position", rounds: int = ROUNDS) -> DataFrame:
    """Add column ``to``: the image of ``number`` under the permutation of [0, n)."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    cols = ["__f0", "__f1"]
    out = df.withColumn("__f0", F.floor(F.col(number) / F.lit(a)).cast("long")).withColumn("__f1", F.col(number) % F.lit(a))
    for i in range(rounds):  # one column a round, so that no half is computed twice
        out = out.withColumn(f"__f{i + 2}", (F.col(f"__f{i}") + _round(F.col(f"__f{i + 1}"), seed, i, a)) % F.lit(a))
        cols.append(f"__f{i + 2}")
    first = out.withColumn("__p", F.col(cols[-2]) * F.lit(a) + F.col(cols[-1])).drop(*cols)
    # A walk meets each of the a*a - n numbers outside once at most, so it ends within that many steps.
    outside = a * a - n
    if outside:
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(outside)), F.col("__p"), lambda p, _: F.when(p < n, p).otherwise(permute_once(p, a, seed, rounds)))
        first = first.withColumn("__p", F.when(F.col("__p") < n, F.col("__p")).otherwise(walk))
    return first.withColumnRenamed("__p", to)


def numbered(df: DataFrame, order: list[str], to: str = "row_number") -> tuple[DataFrame, int]:
    """(df with gapless numbers from 0 in the given order, row count). df must be narrow: it is stored once."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    kept = stored(
        ranged.withColumn("__part", F.spark_partition_id()).withColumn("__in_part", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
        "numbered",
    )
    counts = {r["__part"]: r["n"] for r in kept.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for i in range(max(counts, default=0) + 1):
        offsets.append(total)
        total += counts.get(i, 0)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("__part") + 1)
    return kept.withColumn(to, start + F.col("__in_part")).drop("__part", "__in_part"), total


def feistel_shards(docs: DataFrame, shards: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, position, shard, slot for every row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    digest = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows, n = numbered(digest, ["doc_id", "text_crc32", "size"])
    placed = permuted(rows, "row_number", n, seed)
    return placed.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn("slot", F.floor(F.col("position") / F.lit(shards)).cast("long"))
