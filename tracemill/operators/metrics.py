"""Dashboard aggregates. Every nullable aggregate travels with how many rows contributed.

Children are aggregated by session before they meet it, so a session with several model and tool calls is
never multiplied. Counts of nothing are 0; measures of nothing stay null. ``status = 'unknown'`` is in no
error rate. Days are UTC calendar days.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tables:
    """The trace tables a query reads; dimensions have id and name."""

    session: DataFrame
    model_call: DataFrame
    tool_call: DataFrame
    tool: DataFrame | None = None
    model: DataFrame | None = None
    provider: DataFrame | None = None
    import_run: DataFrame | None = None
    import_issue: DataFrame | None = None


@dataclass(frozen=True)
class Filters:
    """The shared dashboard filters; None means any. Both dates are inclusive."""

    data_source_id: int | None = None
    agent_id: int | None = None
    import_run_id: int | None = None
    status: str | None = None
    date_from: datetime | str | None = None
    date_to: datetime | str | None = None
    model_id: int | None = None
    tool_id: int | None = None

    def chosen(self) -> dict[str, object]:
        return {f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None}


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, null where whole is 0 or either is unknown."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def coverage(present: Column, total: Column) -> Column:
    return F.struct(present.cast("long").alias("present"), total.cast("long").alias("total"), ratio(present, total).alias("ratio"))


# -- sessions ----------------------------------------------------------------------------------------


def filtered_sessions(t: Tables, f: Filters) -> DataFrame:
    """Sessions that pass all filters; model and tool mean 'used by the session'."""
    s = t.session
    for name in ("data_source_id", "agent_id", "import_run_id"):
        if (value := getattr(f, name)) is not None:
            s = s.filter(F.col(name) == value)
    if f.status is not None:
        s = s.filter(F.col("outcome") == f.status)
    if f.date_from is not None:
        s = s.filter(F.col("started_at") >= F.lit(f.date_from).cast("timestamp_ntz"))
    if f.date_to is not None:
        s = s.filter(F.col("started_at") <= F.lit(f.date_to).cast("timestamp_ntz"))
    for calls, name in ((t.model_call, "model_id"), (t.tool_call, "tool_id")):
        if (value := getattr(f, name)) is not None:
            used = calls.filter(F.col(name) == value).select(F.col("session_id").alias("id"))
            s = s.join(used, "id", "left_semi")
    return s


def model_side(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session_id").agg(
        F.count("*").alias("model_call_count"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cache_read_tokens").alias("cache_read_tokens"),
        F.count("input_tokens").alias("token_records_present"),
        F.count("*").alias("token_records_total"),
        F.count("cache_read_tokens").alias("cache_records_present"),
    )


def tool_side(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session_id").agg(
        F.count("*").alias("tool_call_count"),
        F.count_if(F.col("status") == "error").alias("tool_error_count"),
        F.count_if(F.col("status").isin("ok", "error")).alias("tool_status_known_count"),
    )


_COUNTS = ("model_call_count", "token_records_present", "token_records_total", "cache_records_present", "tool_call_count", "tool_error_count", "tool_status_known_count")


def session_metrics(t: Tables, f: Filters = Filters()) -> DataFrame:  # noqa: B008
    """One row per session with both children's aggregates."""
    s = filtered_sessions(t, f)
    model, tool = t.model_call, t.tool_call
    if f.chosen():  # the children of few sessions: drop the others before they are aggregated
        ids = s.select(F.col("id").alias("session_id"))
        model, tool = model.join(ids, "session_id", "left_semi"), tool.join(ids, "session_id", "left_semi")
    joined = s.join(model_side(model), s["id"] == F.col("session_id"), "left").drop("session_id")
    joined = joined.join(tool_side(tool), joined["id"] == F.col("session_id"), "left").drop("session_id")
    return joined.select(
        F.col("id").alias("session_id"),
        "data_source_id",
        "agent_id",
        "import_run_id",
        "started_at",
        "duration_ms",
        F.coalesce("model_call_count", F.lit(0)).alias("model_call_count"),
        "input_tokens",
        "output_tokens",
        "cache_read_tokens",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS[1:]],
    )


# -- charts ------------------------------------------------------------------------------------------


def overview(t: Tables, f: Filters = Filters()) -> DataFrame:  # noqa: B008
    """One row, also when no session passes."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return session_metrics(t, f).agg(
        F.count("*").alias("session_count"),
        zero("model_call_count"),
        zero("tool_call_count"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.count_if(F.col("token_records_present") > 0).alias("token_sessions_present"),
        F.avg(F.col("input_tokens") + F.col("output_tokens")).alias("avg_tokens_per_session"),
        F.avg("duration_ms").alias("avg_session_duration_ms"),
        F.count("duration_ms").alias("duration_present"),
        zero("tool_error_count"),
        zero("tool_status_known_count"),
    )


def headline(t: Tables, f: Filters = Filters()) -> DataFrame:  # noqa: B008
    """The headline metrics as rows: key, value, present, total, ratio."""
    o = overview(t, f)
    value = {
        "session_count": (F.col("session_count").cast("double"), F.col("session_count"), F.col("session_count")),
        "avg_tokens_per_session": (F.col("avg_tokens_per_session"), F.col("token_sessions_present"), F.col("session_count")),
        "avg_session_duration_ms": (F.col("avg_session_duration_ms"), F.col("duration_present"), F.col("session_count")),
        "tool_error_rate": (ratio(F.col("tool_error_count"), F.col("tool_status_known_count")), F.col("tool_status_known_count"), F.col("tool_call_count")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value"), p.cast("long").alias("present"), n.cast("long").alias("total"), ratio(p, n).alias("ratio")) for k, (v, p, n) in value.items()])
    return o.select(F.inline(rows))


def activity(t: Tables, f: Filters = Filters()) -> DataFrame:  # noqa: B008
    """By UTC day and source; sessions without a start are left out."""
    day = F.to_date("started_at").alias("day")
    return (
        session_metrics(t, f)
        .filter(F.col("started_at").isNotNull())
        .groupBy(day, "data_source_id")
        .agg(
            F.count("*").alias("session_count"),
            F.sum("model_call_count").alias("model_call_count"),
            F.sum("tool_call_count").alias("tool_call_count"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum("token_records_present").alias("token_records_present"),
            F.sum("token_records_total").alias("token_records_total"),
        )
        .orderBy("day", "data_source_id")
    )


def tool_usage(t: Tables, f: Filters = Filters()) -> DataFrame:  # noqa: B008
    """By tool and source. Only the sessions' keys are needed, so their metrics are not computed."""
    calls = t.tool_call if f.tool_id is None else t.tool_call.filter(F.col("tool_id") == f.tool_id)
    kept = filtered_sessions(t, f).select(F.col("id").alias("session_id"), "data_source_id")
    counted = calls.join(kept, "session_id").groupBy("tool_id", "data_source_id").agg(
        F.count("*").alias("call_count"),
        F.count_if(F.col("status") == "error").alias("error_count"),
        F.count_if(F.col("status").isin("ok", "error")).alias("status_known_count"),
    )
    names = t.tool.select(F.col("id").alias("tool_id"), F.col("name").alias("tool_name"))
    named = counted.join((names), "tool_id")
    return named.select("tool_id", "tool_name", "data_source_id", "call_count", "error_count", "status_known_count").orderBy(F.desc("call_count"), "tool_name", "tool_id", "data_source_id")


def model_usage(t: Tables, f: Filters = Filters()) -> DataFrame:  # noqa: B008
    """By model and source; calls whose model is unknown form a group of their own."""
    calls = t.model_call if f.model_id is None else t.model_call.filter(F.col("model_id") == f.model_id)
    kept = filtered_sessions(t, f).select(F.col("id").alias("session_id"), "data_source_id")
    counted = calls.join(kept, "session_id").groupBy("model_id", "data_source_id").agg(
        F.count("*").alias("call_count"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count("input_tokens").alias("token_records_present"),
        F.count("*").alias("token_records_total"),
        F.sum("cache_read_tokens").alias("cache_read_tokens"),
        F.count("cache_read_tokens").alias("cache_records_present"),
    )
    names = t.model.select(F.col("id").alias("model_id"), F.col("name").alias("model_name"), "provider_id")
    makers = t.provider.select(F.col("id").alias("provider_id"), F.col("name").alias("provider_name"))
    named = counted.join((names), "model_id", "left").join((makers), "provider_id", "left")
    order = [F.desc("call_count"), F.asc_nulls_last("model_name"), F.asc_nulls_last("model_id"), F.asc("data_source_id")]
    return named.select("model_id", "model_name", "provider_name", *[c for c in counted.columns if c != "model_id"]).orderBy(*order)


def import_quality(t: Tables, f: Filters = Filters()) -> DataFrame:  # noqa: B008
    """Import runs with their issue counts, newest first. Session filters keep runs that imported such a session."""
    runs = t.import_run
    if f.data_source_id is not None:
        runs = runs.filter(F.col("data_source_id") == f.data_source_id)
    if f.import_run_id is not None:
        runs = runs.filter(F.col("id") == f.import_run_id)
    if any(getattr(f, n) is not None for n in ("agent_id", "model_id", "tool_id", "date_from", "date_to", "status")):
        used = filtered_sessions(t, f).select(F.col("import_run_id").alias("id")).distinct()
        runs = runs.join(used, "id", "left_semi")
    issues = t.import_issue.groupBy(F.col("import_run_id").alias("id")).agg(F.count("*").alias("issue_count"))
    out = runs.join(issues, "id", "left").withColumn("issue_count", F.coalesce("issue_count", F.lit(0)))
    columns = ["data_source_id", "status", "records_read", "records_imported", "records_duplicate", "records_rejected", "fields_missing", "created_at", "issue_count"]
    kept = [c for c in columns if c in out.columns]
    return out.select(F.col("id").alias("import_run_id"), *kept).orderBy(F.desc("created_at"), F.desc("import_run_id"))


# -- registry ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Metric:
    key: str
    unit: str
    formula: str
    missing: str
    comparability: str


METRICS = (
    Metric("session_count", "sessions", "number of sessions", "always fully covered", "cross_source"),
    Metric("avg_tokens_per_session", "tokens", "mean over sessions of summed input plus output tokens", "sessions without token data leave numerator and denominator", "cross_source"),
    Metric("avg_session_duration_ms", "ms", "mean of duration_ms", "sessions without duration are left out", "cross_source"),
    Metric("tool_error_rate", "ratio", "error calls / calls of known status", "null when no status is known; coverage is known / all calls", "cross_source"),
    Metric("cache_read_tokens", "tokens", "sum of cache_read_tokens", "null with coverage 0 when the source has none", "per_source_only"),
    Metric("import_rejection_ratio", "ratio", "rejected records / read records", "null when nothing was read", "cross_source"),
)
HEADLINE = METRICS[:4]


def cache_warning(points: DataFrame) -> DataFrame:
    """One row (warn): whether one source reports cache tokens and another none, so they do not compare."""
    by = points.groupBy("data_source_id").agg(F.sum("cache_records_present").alias("n"))
    return by.agg(F.coalesce((F.count_if(F.col("n") > 0) > 0) & (F.count_if(F.col("n") == 0) > 0), F.lit(False)).alias("warn"))


def day_filter(f: Filters, day: Column, source: Column) -> Column:
    """The filters that replay a chart point of one day on the session list (the end is inclusive)."""
    own = {k: F.lit(str(v)) for k, v in f.chosen().items()}
    own |= {"data_source_id": source.cast("string"), "date_from": day.cast("timestamp_ntz").cast("string"), "date_to": F.date_add(day, 1).cast("timestamp_ntz").cast("string")}
    return F.map_from_arrays(F.array(*[F.lit(k) for k in own]), F.array(*own.values()))


def point_filter(f: Filters, **of: Column) -> Column:
    """The filters that replay a chart point; null keys restrict nothing."""
    own = {k: F.lit(str(v)) for k, v in f.chosen().items()} | {k: v.cast("string") for k, v in of.items()}
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in own.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
