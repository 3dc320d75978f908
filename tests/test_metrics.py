"""The fan-out fixture: two sources, four sessions, expected figures worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tracemill.operators import explore, metrics, rollups
from tracemill.operators.metrics import Filters, Tables


@pytest.fixture(scope="module")
def t(spark):
    session = spark.createDataFrame(
        [(1, 1, 9, 1, "a", "2026-08-01 10:00:00", 5000, "completed"), (2, 1, 9, 1, "b", "2026-08-01 11:00:00", 7000, "error"), (3, 1, None, 1, "c", "2026-08-02 00:00:00", None, None), (4, 2, None, 2, "d", "2026-08-02 12:00:00", 1000, "completed")],
        "id long, data_source_id long, agent_id long, import_run_id long, external_id string, at string, duration_ms long, outcome string",
    ).withColumn("started_at", F.col("at").cast("timestamp_ntz")).drop("at")
    model_call = spark.createDataFrame(
        [(1, 1, 1, 0, 100, 10, 5), (2, 1, 1, 1, 200, 20, 5), (3, 1, 2, 2, 300, 30, 5), (4, 2, 1, 0, None, None, None), (5, 3, None, 0, 50, 5, None), (6, 4, 2, 0, 40, 4, None)],
        "id long, session_id long, model_id long, sequence_index int, input_tokens long, output_tokens long, cache_read_tokens long",
    ).withColumn("started_at", F.lit(None).cast("timestamp_ntz")).withColumn("status", F.lit("ok"))
    tool_call = spark.createDataFrame(
        [(1, 1, 1, 0, "ok"), (2, 1, 2, 1, "ok"), (3, 1, 1, 2, "error"), (4, 1, 2, 3, "unknown"), (5, 1, 1, 4, "ok"), (6, 4, 1, 0, "ok")],
        "id long, session_id long, tool_id long, sequence_index int, status string",
    ).withColumn("started_at", F.lit(None).cast("timestamp_ntz"))
    named = lambda rows: spark.createDataFrame(rows, "id long, name string")
    model = spark.createDataFrame([(1, "m1", 1), (2, "m2", 1)], "id long, name string, provider_id long")
    return Tables(session, model_call, tool_call, named([(1, "Bash"), (2, "Read")]), model, named([(1, "p")]))


def test_children_do_not_multiply_each_other(t):
    o = metrics.overview(t).first()
    assert (o["total_input_tokens"], o["model_call_count"], o["tool_call_count"]) == (690, 6, 6)
    joint = t.session.join(t.model_call, t.session["id"] == t.model_call["session_id"]).join(t.tool_call.select("session_id", "tool_id"), "session_id")
    assert joint.agg(F.sum("input_tokens")).first()[0] != 690


def test_coverage_and_ratios_by_source(t):
    o = metrics.overview(t, Filters(data_source_id=1)).first()
    assert (o["token_sessions_present"], o["session_count"]) == (2, 3)
    assert (o["avg_session_duration_ms"], o["duration_present"]) == (6000.0, 2)
    assert (o["tool_error_count"], o["tool_status_known_count"], o["tool_call_count"]) == (1, 4, 5)
    h = {r["key"]: r for r in metrics.headline(t, Filters(data_source_id=1)).collect()}
    assert h["tool_error_rate"]["value"] == 0.25 and h["tool_error_rate"]["ratio"] == 0.8


def test_unknown_stays_unknown(t):
    m = {(r["model_id"], r["data_source_id"]): r for r in metrics.model_usage(t).collect()}
    assert m[2, 2]["cache_read_tokens"] is None and m[2, 2]["cache_records_present"] == 0
    assert m[None, 1]["call_count"] == 1
    s = {r["session_id"]: r for r in metrics.session_metrics(t).collect()}
    assert s[2]["input_tokens"] is None and s[2]["tool_call_count"] == 0
    assert metrics.overview(t, Filters(data_source_id=99)).first()["avg_tokens_per_session"] is None


def test_ratio_is_null_without_a_whole(spark):
    assert spark.range(1).select(metrics.ratio(F.lit(1), F.lit(0))).first()[0] is None
    c = spark.range(1).select(metrics.coverage(F.lit(0), F.lit(0)).alias("c")).first()["c"]
    assert (c["present"], c["total"], c["ratio"]) == (0, 0, None)


def test_drill_down_replays_the_point(t):
    for p in metrics.activity(t).collect():
        f = Filters(data_source_id=p["data_source_id"], date_from=f"{p['day']} 00:00:00", date_to=f"{p['day']} 23:59:59")
        assert explore.session_total(t, f).first()["total"] == p["session_count"]


def test_cache_warning_needs_two_kinds_of_sources(t):
    assert metrics.cache_warning(metrics.model_usage(t)).first()["warn"] is True
    assert metrics.cache_warning(metrics.model_usage(t, Filters(data_source_id=1))).first()["warn"] is False


def test_session_page_and_timeline(t):
    assert [r["session_id"] for r in explore.sessions(t, limit=2, offset=1).collect()] == [3, 2]
    with pytest.raises(ValueError):
        explore.sessions(t, limit=201)
    kinds = [(r["type"], r["sequence_index"]) for r in explore.timeline(t, 1).collect()]
    assert len(kinds) == 8 and kinds[0] == ("model_call", 0)


def test_client_rollups(spark, t):
    series = [(str(r["day"]), r["session_count"], r["tokens"]) for r in rollups.daily_series(metrics.activity(t)).collect()]
    assert series == [("2026-08-01", 2, 660), ("2026-08-02", 2, 99)]
    tokens = {r["session_id"]: r["tokens"] for r in rollups.client_session_tokens(t.model_call).collect()}
    assert tokens[2] is None and tokens[1] == 660
    m = spark.createDataFrame([({"a": 1, "b": 2},), ({},)], "m map<string,long>")
    assert [r["total"] for r in rollups.map_total(m, "m").collect()] == [3, 0]
    w = spark.createDataFrame([([["x", "y"], ["x"]],)], "w array<array<string>>")
    assert rollups.distinct_warnings(w, "w").first()["warnings"] == ["x", "y"]
    none = spark.createDataFrame([], "records_read long, records_imported long, records_duplicate long, records_rejected long")
    assert rollups.quality_summary(none).first()["success_rate"] is None


def test_survivors_treat_missing_versions_as_one(spark):
    agents = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "x", "1")], "id long, name string, version string")
    assert [(r["id"], r["survivor_id"]) for r in explore.survivors(agents).collect()] == [(2, 1)]


def test_views_and_preview_keys(spark, t):
    from tracemill.plans import views

    names = views.register(t)
    assert names == ["v_session_metrics", "v_daily_activity", "v_tool_usage", "v_model_usage"]
    assert spark.sql("SELECT sum(call_count) FROM v_tool_usage").first()[0] == 6
    rows = spark.createDataFrame([(1, '{"b":1,"a":2}'), (2, '{"c":1,"a":2}')], "line long, row string")
    assert rollups.row_keys(rows).first()["keys"] == ["b", "a", "c"]
