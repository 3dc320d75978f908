"""Reads behind the session list, the timeline, the issue list and the import list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.metrics import Filters, Tables, filtered_sessions, session_metrics

PAGE, MAX_PAGE = 50, 200


def page(df: DataFrame, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A window of an ordered frame."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1 to {MAX_PAGE} and offset at least 0")
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def sessions(t: Tables, f: Filters = Filters(), limit: int = PAGE, offset: int = 0) -> DataFrame:  # noqa: B008
    """A page of sessions, latest first, undated last.

    The page's ids (at most MAX_PAGE) are fetched first; the children are then read with an id filter that
    reaches their scans, instead of being aggregated or joined whole.
    """
    order = [F.desc_nulls_last("started_at"), F.desc("id")]
    ids = [r["id"] for r in page(filtered_sessions(t, f).select("id", "started_at").orderBy(*order), limit, offset).collect()]
    chosen = lambda c: F.col(c).isin(ids) if ids else F.lit(False)
    own = t.session.filter(chosen("id"))
    few = Tables(own, t.model_call.filter(chosen("session_id")), t.tool_call.filter(chosen("session_id")))
    named = own.select(F.col("id").alias("session_id"), "external_id", "outcome")
    return session_metrics(few).join(named, "session_id").orderBy(F.desc_nulls_last("started_at"), F.desc("session_id"))


def session_total(t: Tables, f: Filters = Filters()) -> DataFrame:  # noqa: B008
    return filtered_sessions(t, f).agg(F.count("*").alias("total"))


def calls(children: DataFrame, session_id: int) -> DataFrame:
    return children.filter(F.col("session_id") == session_id).orderBy("sequence_index", "id")


def session_detail(t: Tables, session_id: int) -> DataFrame:
    """One session with its model and tool calls in order; no row where there is none. The filters reach the scans."""
    out = t.session.filter(F.col("id") == session_id)
    for name, children in (("model_calls", t.model_call), ("tool_calls", t.tool_call)):
        row = F.struct("sequence_index", "id", *[c for c in children.columns if c not in ("sequence_index", "id")])
        own = children.filter(F.col("session_id") == session_id).groupBy(F.col("session_id").alias("id")).agg(F.sort_array(F.collect_list(row)).alias(name))
        out = out.join(own, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    return out


def record_detail(raw_record: DataFrame, record_id: int) -> DataFrame:
    """One stored record; no row where there is none."""
    return raw_record.filter(F.col("id") == record_id)


def timeline(t: Tables, session_id: int | None = None) -> DataFrame:
    """Model and tool calls as one list: undated last, then time, sequence, type, id."""
    sides = []
    for kind, df in (("model_call", t.model_call), ("tool_call", t.tool_call)):
        own = df if session_id is None else df.filter(F.col("session_id") == session_id)
        keep = [c for c in ("id", "session_id", "sequence_index", "started_at", "status", "model_id", "tool_id", "input_tokens", "output_tokens") if c in own.columns]
        sides.append(own.select(F.lit(kind).alias("type"), *keep))
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    return both.orderBy("session_id", F.col("started_at").isNull(), "started_at", "sequence_index", "type", "id")


def issues(import_issue: DataFrame, raw_record: DataFrame, run_id: int | None = None, severity: str | None = None) -> DataFrame:
    """Issues with the line they come from, null where an issue concerns no line."""
    own = import_issue
    if run_id is not None:
        own = own.filter(F.col("import_run_id") == run_id)
    if severity is not None:
        own = own.filter(F.col("severity") == severity)
    lines = raw_record.select(F.col("id").alias("raw_record_id"), "line_number")
    return own.join(lines, "raw_record_id", "left").orderBy("id")


def import_runs(import_run: DataFrame, data_source: DataFrame, statuses: tuple[str, ...] = (), file_upload: DataFrame | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """Runs with the names of their source, file and mapping (with its version), newest first."""
    own = import_run.filter(F.col("status").isin(*statuses)) if statuses else import_run
    own = own.join(data_source.select(F.col("id").alias("data_source_id"), F.col("name").alias("source_name")), "data_source_id", "left")
    if file_upload is not None:
        own = own.join(file_upload.select(F.col("id").alias("file_upload_id"), F.col("original_name").alias("file_name")), "file_upload_id", "left")
    if mapping is not None:
        own = own.join(mapping.select(F.col("id").alias("mapping_id"), F.col("name").alias("mapping_name"), F.col("version").alias("mapping_version")), "mapping_id", "left")
    return own.orderBy(F.desc("created_at"), F.desc("id"))


def latest_versions(mapping: DataFrame) -> DataFrame:
    """The next version number of each mapping name."""
    return mapping.groupBy("name").agg((F.max("version") + 1).alias("next_version"))


def next_turns(messages: DataFrame, key: str, order: str) -> DataFrame:
    """The index that the next message of each conversation gets."""
    return messages.groupBy(key).agg((F.coalesce(F.max(order), F.lit(-1)) + 1).alias("next_turn"))


def last_turns(messages: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n messages of each conversation, in ascending order."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("__n", F.row_number().over(last)).filter(F.col("__n") <= n).drop("__n").orderBy(key, order)


def oldest_pending(import_run: DataFrame) -> DataFrame:
    return import_run.filter(F.col("status") == "pending").orderBy("created_at", "id").limit(1)


def survivors(agents: DataFrame) -> DataFrame:
    """Agents of one name and version (null versions are one) reduced to their smallest id: duplicate id to survivor id."""
    same = Window.partitionBy("name", "version")
    return agents.withColumn("survivor_id", F.min("id").over(same)).filter(F.col("id") > F.col("survivor_id")).select("id", "survivor_id")


def live_sessions(user_session: DataFrame, now) -> DataFrame:
    """Rows without an expiry or whose expiry lies ahead."""
    return user_session.filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now)))
