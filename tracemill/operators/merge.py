"""Idempotent loads: facts are stored once by natural key, first wins, and repeats are accounted for.

Identities: (data_source_id, external_id) of a session, (session_id, sequence_index) of a call. A load keeps
the first row of each key in line order, joins what is stored already by key, and numbers new rows after the
largest stored id. Stored tables are only read by key columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.sources.readers import numbered, settled


def first_of_key(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first row of each key in order, the repeats)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = df.withColumn("__rank", rank)
    return ranked.filter("__rank = 1").drop("__rank"), ranked.filter("__rank > 1").drop("__rank")


def with_ids(new: DataFrame, stored: DataFrame, to: str = "id", written: bool = False) -> DataFrame:
    """Number rows after the largest stored id, without a global sort. written: the rows are those of a settled table
    already, filtered or projected at most, and need not be written again."""
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    return numbered(new if written else settled(new), to).withColumn(to, F.col(to) + F.lit(top))


def merge(incoming: DataFrame, stored: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new rows without ids, rows that are stored already with their id, repeats within the load)."""
    first, repeats = first_of_key(incoming, keys, order)
    known = stored.select(*keys, F.col("id").alias("stored_id"))
    new = first.join(known, keys, "left_anti")
    existing = first.join(known, keys)
    return new, existing, repeats


def link_calls(calls: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls with session_id, calls whose session key is not stored). sessions: (external_id, id)."""
    ids = sessions.select(F.col("external_id").alias("session_key"), F.col("id").alias("session_id"))
    linked = calls.join(ids, "session_key", "left")
    return linked.filter("session_id IS NOT NULL"), linked.filter("session_id IS NULL")


def get_or_create(names: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The dimension with a row for every name asked for; nulls in keys are equal to each other."""
    asked = names.select(*keys).distinct()
    same = None
    for k in keys:
        own = asked[k].eqNullSafe(stored[k])
        same = own if same is None else same & own
    new = asked.join(stored, same, "left_anti")
    return stored.select("id", *keys).unionByName(with_ids(new, stored).select("id", *keys))


def unstored_lines(records: DataFrame, raw_record: DataFrame) -> DataFrame:
    """Lines of a run that a retry still has to store."""
    return records.join(raw_record.select(F.col("line_number").alias("line")), "line", "left_anti")


def outcome_counts(incoming: DataFrame, stored: DataFrame, keys: list[str], order: list[str], repeats_count: bool, sessions: DataFrame | None = None) -> DataFrame:
    """(outcome, n): new, existing, duplicate and unlinked rows of a load, in one pass over it.

    A session repeated within a run is no duplicate, a call is. With ``sessions`` (external_id, id) the rows whose
    session_key is not stored are unlinked and nothing else.
    """
    linked = incoming.withColumn("__linked", F.lit(True))
    if sessions is not None:
        ids = sessions.select(F.col("external_id").alias("session_key"), F.lit(True).alias("__linked"))
        linked = incoming.join(ids, "session_key", "left").withColumn("__linked", F.coalesce("__linked", F.lit(False)))
    known = stored.select(*keys, F.lit(True).alias("__known"))
    rank = F.row_number().over(Window.partitionBy("__linked", *keys).orderBy(*order))
    rows = linked.withColumn("__rank", rank).join(known, keys, "left").withColumn("__known", F.coalesce("__known", F.lit(False)))
    own, first, old = F.col("__linked"), F.col("__rank") == 1, F.col("__known")
    counted = {"new": own & first & ~old, "existing": own & first & old, "duplicate": own & ((first & old) | (F.lit(repeats_count) & ~first)), "unlinked": ~own}
    if sessions is None:
        del counted["unlinked"]
    sums = rows.agg(*[F.count_if(c).alias(n) for n, c in counted.items()])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("outcome"), F.col(n).alias("n")) for n in counted])))
