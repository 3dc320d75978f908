"""Rollups of the dashboard client, as DataFrame operations."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.metrics import ratio


def daily_series(activity: DataFrame) -> DataFrame:
    """One row for each day from first to last. Counts are 0 on empty days and so are tokens; on days with
    sessions but no known token, tokens stay null; a missing half counts 0."""
    by = activity.groupBy("day").agg(
        F.sum("session_count").alias("session_count"),
        F.sum(F.coalesce("model_call_count", F.lit(0))).alias("model_call_count"),
        F.sum(F.coalesce("tool_call_count", F.lit(0))).alias("tool_call_count"),
        F.sum(F.when(F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull(), F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))).alias("tokens"),
    )
    days = by.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    out = days.join(by, "day", "left")
    empty = F.col("session_count").isNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("day", F.when(empty, 0).otherwise(F.col("tokens")).alias("tokens"), *[zero(c) for c in ("session_count", "model_call_count", "tool_call_count")]).orderBy("day")


def call_tokens(model_call: DataFrame) -> DataFrame:
    """Tokens of each call; null if either half is unknown."""
    return model_call.select("id", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


def client_session_tokens(model_call: DataFrame) -> DataFrame:
    """Tokens of a session over the calls that report either half, a missing half as 0; null if none reports."""
    known = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    own = F.when(known, F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))
    return model_call.groupBy("session_id").agg(F.sum(own).alias("tokens"), F.count_if(known).alias("calls_reporting"))


def quality_summary(runs: DataFrame) -> DataFrame:
    """Totals over import runs with success and rejection ratios; all null without runs."""
    t = runs.agg(*[F.sum(c).alias(c) for c in ("records_read", "records_imported", "records_duplicate", "records_rejected")])
    return t.withColumns({"success_rate": ratio(F.col("records_imported"), F.col("records_read")), "rejection_ratio": ratio(F.col("records_rejected"), F.col("records_read"))})


def visible_totals(runs: DataFrame, visible: int = 20) -> DataFrame:
    """Imported, duplicate and rejected records of the newest runs on the page."""
    newest = runs.orderBy(F.desc("created_at"), F.desc("id")).limit(visible)
    return newest.agg(*[F.sum(c).alias(c) for c in ("records_imported", "records_duplicate", "records_rejected")])


def top_tools(usage: DataFrame, n: int = 6) -> DataFrame:
    by = usage.groupBy("tool_name").agg(F.sum("call_count").alias("call_count"))
    return by.orderBy(F.desc("call_count"), "tool_name").limit(n)


def models_by_count(usage: DataFrame) -> DataFrame:
    by = usage.groupBy(F.coalesce("model_name", F.lit("unknown")).alias("model_name")).agg(F.sum("call_count").alias("call_count"))
    return by.orderBy(F.desc("call_count"), "model_name")


def recent_activity(activity: DataFrame, n: int = 5) -> DataFrame:
    return activity.orderBy(F.desc("day"), "data_source_id").limit(n)


def since(df: DataFrame, period: str, now: datetime, column: str = "started_at") -> DataFrame:
    """Rows of the last 7d, 30d or 90d; any other period keeps all."""
    days = {"7d": 7, "30d": 30, "90d": 90}.get(period)
    return df if days is None else df.filter(F.col(column) >= F.lit(now - timedelta(days=days)))


def map_total(df: DataFrame, column: str, to: str = "total") -> DataFrame:
    return df.withColumn(to, F.aggregate(F.map_values(column), F.lit(0).cast("long"), lambda a, x: a + x))


def distinct_warnings(df: DataFrame, column: str) -> DataFrame:
    """All warnings of a list column once, in order within their row."""
    return df.select(F.array_distinct(F.flatten(column)).alias("warnings"))


def row_keys(rows: DataFrame, column: str = "row", order: str = "line") -> DataFrame:
    """All member names of JSON rows, in the order in which they are first seen (a preview: bounded rows)."""
    keys = rows.select(order, F.posexplode(F.json_object_keys(column)).alias("at", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct(order, "at")).alias("first"))
    return first.agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "key"))), lambda x: x["key"]).alias("keys"))
