"""The trace model over the driver's order tables: orders are sessions, their lines are calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.metrics import Tables


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_id() -> Column:
    """A number for a line, which has no key of its own."""
    return F.col("l_orderkey") * 100_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    status = F.col("o_orderstatus")
    return o.join(c.select("c_custkey", "c_nationkey"), o["o_custkey"] == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"),
        F.col("c_nationkey").cast("long").alias("data_source_id"),
        F.col("o_custkey").alias("agent_id"),
        (F.col("o_orderkey") % 7 + 1).alias("import_run_id"),
        F.col("o_orderkey").cast("string").alias("external_id"),
        F.col("o_orderdate").alias("started_at"),
        F.when(status != "O", F.floor("o_totalprice")).alias("duration_ms"),
        F.when(status == "F", "completed").when(status == "P", "aborted").alias("outcome"),
    )


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return read(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(
        line_id().alias("id"),
        F.col("l_orderkey").alias("session_id"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey")).alias("model_id"),
        F.col("l_linenumber").alias("sequence_index"),
        F.when(flag != "N", F.floor("l_quantity")).alias("input_tokens"),
        F.when(flag != "N", F.floor(F.col("l_extendedprice") / 100)).alias("output_tokens"),
        F.when(F.col("l_linenumber") % 3 != 0, F.floor("l_quantity")).alias("cache_read_tokens"),
        F.col("l_shipdate").alias("started_at"),
        F.lit("ok").alias("status"),
    )


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return read(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").select(
        line_id().alias("id"),
        F.col("l_orderkey").alias("session_id"),
        F.col("l_partkey").alias("tool_id"),
        F.col("l_linenumber").alias("sequence_index"),
        F.when(F.col("l_linenumber") % 4 != 0, F.col("l_shipdate")).alias("started_at"),
        F.when(flag == "A", "ok").when(flag == "R", "error").otherwise("unknown").alias("status"),
    )


def import_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each customer: its balance decides how the run went."""
    n = F.floor(F.abs("c_acctbal"))
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").cast("long").alias("data_source_id"),
        F.when(F.col("c_acctbal") < 0, "partial").when(F.col("c_custkey") % 5 == 0, "pending").otherwise("succeeded").alias("status"),
        n.alias("records_read"),
        (n - F.floor(n / 10)).alias("records_imported"),
        F.floor(n / 20).alias("records_duplicate"),
        (F.floor(n / 10) - F.floor(n / 20)).alias("records_rejected"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 50 as int))").alias("created_at"),
    )


def import_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An issue for each urgent order, about the line of the same number in every second case."""
    o = read(spark, sf_dir, "orders").filter("o_orderpriority LIKE '1%'")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("import_run_id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("raw_record_id"),
        F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("warning").alias("severity"),
        F.lit("CAST_FAILED").alias("code"),
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    named = lambda t, i, n, **more: read(spark, sf_dir, t).select(F.col(i).cast("long").alias("id"), F.col(n).alias("name"), *[F.col(c).cast("long").alias(a) for a, c in more.items()])
    return Tables(
        session=sessions(spark, sf_dir),
        model_call=model_calls(spark, sf_dir),
        tool_call=tool_calls(spark, sf_dir),
        tool=named("part", "p_partkey", "p_type"),
        model=named("supplier", "s_suppkey", "s_name", provider_id="s_nationkey"),
        provider=named("nation", "n_nationkey", "n_name"),
        import_run=import_runs(spark, sf_dir),
        import_issue=import_issues(spark, sf_dir),
    )


#: The same tables for DuckDB.
SQL = """
WITH session AS (
  SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS data_source_id, o_custkey AS agent_id, o_orderkey % 7 + 1 AS import_run_id,
         CAST(o_orderkey AS VARCHAR) AS external_id, o_orderdate AS started_at,
         CASE WHEN o_orderstatus <> 'O' THEN CAST(floor(o_totalprice) AS BIGINT) END AS duration_ms,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'aborted' END AS outcome
  FROM orders JOIN customer ON o_custkey = c_custkey),
model_call AS (
  SELECT l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS id, l_orderkey AS session_id, CASE WHEN l_suppkey % 10 <> 0 THEN l_suppkey END AS model_id,
         l_linenumber AS sequence_index,
         CASE WHEN l_returnflag <> 'N' THEN CAST(floor(l_quantity) AS BIGINT) END AS input_tokens,
         CASE WHEN l_returnflag <> 'N' THEN CAST(floor(l_extendedprice / 100) AS BIGINT) END AS output_tokens,
         CASE WHEN l_linenumber % 3 <> 0 THEN CAST(floor(l_quantity) AS BIGINT) END AS cache_read_tokens,
         l_shipdate AS started_at, 'ok' AS status
  FROM lineitem WHERE l_linestatus = 'F'),
tool_call AS (
  SELECT l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS id, l_orderkey AS session_id, l_partkey AS tool_id, l_linenumber AS sequence_index,
         CASE WHEN l_linenumber % 4 <> 0 THEN l_shipdate END AS started_at,
         CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'R' THEN 'error' ELSE 'unknown' END AS status
  FROM lineitem WHERE l_linestatus = 'O'),
tool AS (SELECT p_partkey AS id, p_type AS name FROM part),
model AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS provider_id FROM supplier),
provider AS (SELECT n_nationkey AS id, n_name AS name FROM nation),
import_run AS (
  SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS data_source_id,
         CASE WHEN c_acctbal < 0 THEN 'partial' WHEN c_custkey % 5 = 0 THEN 'pending' ELSE 'succeeded' END AS status,
         n AS records_read, n - n // 10 AS records_imported, n // 20 AS records_duplicate, n // 10 - n // 20 AS records_rejected,
         TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 50 AS INTEGER)) AS created_at
  FROM (SELECT *, CAST(floor(abs(c_acctbal)) AS BIGINT) AS n FROM customer)),
import_issue AS (
  SELECT o_orderkey AS id, o_custkey AS import_run_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS raw_record_id,
         CASE WHEN o_orderstatus = 'F' THEN 'rejected' ELSE 'warning' END AS severity, 'CAST_FAILED' AS code
  FROM orders WHERE o_orderpriority LIKE '1%'),
session_metrics AS (
  SELECT s.id AS session_id, s.data_source_id, s.agent_id, s.import_run_id, s.started_at, s.duration_ms,
         coalesce(m.n, 0) AS model_call_count, m.i AS input_tokens, m.o AS output_tokens, m.c AS cache_read_tokens,
         coalesce(m.ip, 0) AS token_records_present, coalesce(m.n, 0) AS token_records_total, coalesce(m.cp, 0) AS cache_records_present,
         coalesce(t.n, 0) AS tool_call_count, coalesce(t.e, 0) AS tool_error_count, coalesce(t.k, 0) AS tool_status_known_count
  FROM session s
  LEFT JOIN (SELECT session_id, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o,
                    CAST(sum(cache_read_tokens) AS BIGINT) AS c, count(input_tokens) AS ip, count(cache_read_tokens) AS cp
             FROM model_call GROUP BY 1) m ON m.session_id = s.id
  LEFT JOIN (SELECT session_id, count(*) AS n, count(*) FILTER (status = 'error') AS e, count(*) FILTER (status IN ('ok', 'error')) AS k
             FROM tool_call GROUP BY 1) t ON t.session_id = s.id)
"""
