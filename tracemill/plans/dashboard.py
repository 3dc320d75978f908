"""Dashboard, exploration and client-rollup queries over the order tables, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tracemill import bindings
from tracemill.bindings import SQL, tables
from tracemill.operators import explore, metrics, profile, rollups
from tracemill.operators.metrics import Filters
from tracemill.plans import views

WINDOW = Filters(date_from="1995-01-01 00:00:00", date_to="1996-12-31 00:00:00")
SOURCE = Filters(data_source_id=7, status="completed")
USED = Filters(model_id=3, tool_id=5)
AGENT = Filters(agent_id=11)
RUN = Filters(import_run_id=4)
MODEL = Filters(model_id=3)
TOOL = Filters(tool_id=5, date_from="1994-01-01 00:00:00")

#: SQL conditions on alias sm of session_metrics for the filters above.
_WHERE = {
    "window": "sm.started_at >= TIMESTAMP '1995-01-01' AND sm.started_at <= TIMESTAMP '1996-12-31'",
    "source": "sm.data_source_id = 7 AND EXISTS (SELECT 1 FROM session s WHERE s.id = sm.session_id AND s.outcome = 'completed')",
    "used": "EXISTS (SELECT 1 FROM model_call mc WHERE mc.session_id = sm.session_id AND mc.model_id = 3) AND EXISTS (SELECT 1 FROM tool_call tc WHERE tc.session_id = sm.session_id AND tc.tool_id = 5)",
    "model": "EXISTS (SELECT 1 FROM model_call mc WHERE mc.session_id = sm.session_id AND mc.model_id = 3)",
    "tool": "sm.started_at >= TIMESTAMP '1994-01-01' AND EXISTS (SELECT 1 FROM tool_call tc WHERE tc.session_id = sm.session_id AND tc.tool_id = 5)",
    "agent": "sm.agent_id = 11",
    "run": "sm.import_run_id = 4",
    "all": "TRUE",
}

_OVERVIEW = """SELECT count(*) AS session_count, CAST(coalesce(sum(model_call_count), 0) AS BIGINT) AS model_call_count,
  CAST(coalesce(sum(tool_call_count), 0) AS BIGINT) AS tool_call_count, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens, count(*) FILTER (token_records_present > 0) AS token_sessions_present,
  avg(input_tokens + output_tokens) AS avg_tokens_per_session, avg(duration_ms) AS avg_session_duration_ms, count(duration_ms) AS duration_present,
  CAST(coalesce(sum(tool_error_count), 0) AS BIGINT) AS tool_error_count, CAST(coalesce(sum(tool_status_known_count), 0) AS BIGINT) AS tool_status_known_count
  FROM session_metrics sm WHERE {where}"""
_ACTIVITY = """SELECT CAST(started_at AS DATE) AS day, data_source_id, count(*) AS session_count, CAST(sum(model_call_count) AS BIGINT) AS model_call_count,
  CAST(sum(tool_call_count) AS BIGINT) AS tool_call_count, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(token_records_present) AS BIGINT) AS token_records_present, CAST(sum(token_records_total) AS BIGINT) AS token_records_total
  FROM session_metrics sm WHERE {where} AND started_at IS NOT NULL GROUP BY 1, 2"""
_TOOLS = """SELECT tc.tool_id, t.name AS tool_name, sm.data_source_id, count(*) AS call_count, count(*) FILTER (tc.status = 'error') AS error_count,
  count(*) FILTER (tc.status IN ('ok', 'error')) AS status_known_count
  FROM tool_call tc JOIN tool t ON t.id = tc.tool_id JOIN session_metrics sm ON sm.session_id = tc.session_id WHERE {where} {more} GROUP BY 1, 2, 3"""
_MODELS = """SELECT mc.model_id, m.name AS model_name, p.name AS provider_name, sm.data_source_id, count(*) AS call_count,
  CAST(sum(mc.input_tokens) AS BIGINT) AS input_tokens, CAST(sum(mc.output_tokens) AS BIGINT) AS output_tokens, count(mc.input_tokens) AS token_records_present,
  count(*) AS token_records_total, CAST(sum(mc.cache_read_tokens) AS BIGINT) AS cache_read_tokens, count(mc.cache_read_tokens) AS cache_records_present
  FROM model_call mc JOIN session_metrics sm ON sm.session_id = mc.session_id LEFT JOIN model m ON m.id = mc.model_id LEFT JOIN provider p ON p.id = m.provider_id
  WHERE {where} {more} GROUP BY 1, 2, 3, 4"""
_QUALITY = """SELECT r.id AS import_run_id, r.data_source_id, r.status, r.records_read, r.records_imported, r.records_duplicate, r.records_rejected, r.created_at,
  coalesce(i.n, 0) AS issue_count FROM import_run r LEFT JOIN (SELECT import_run_id, count(*) AS n FROM import_issue GROUP BY 1) i ON i.import_run_id = r.id WHERE {where}"""


def _sql(template: str, where: str = "all", more: str = "") -> str:
    return SQL + template.format(where=_WHERE.get(where, where), more=more)


def _on(make):
    return lambda spark, sf_dir: make(tables(spark, sf_dir))


def _headline(t):
    return metrics.headline(t, Filters())


def _session_page(t):
    return explore.sessions(t, WINDOW, limit=50, offset=25)


def _drill_down(t):
    """Every day and source of the chart with the filters that replay it, and how many sessions those give."""
    points = metrics.activity(t).select("day", "data_source_id", "session_count")
    replay = metrics.day_filter(Filters(), F.col("day"), F.col("data_source_id"))
    return points.select("*", replay["date_from"].alias("date_from"), replay["date_to"].alias("date_to"))


def _session_detail(spark, sf_dir):
    """The look at one session, its calls by their ids in order."""
    t = explore.session_detail(tables(spark, sf_dir), 7)
    ids = lambda c: F.transform(c, lambda x: x["id"]).alias(c)
    return t.select("id", "external_id", "outcome", ids("model_calls"), ids("tool_calls"))


def _record_detail(spark, sf_dir):
    raw = bindings.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("line_number"), F.col("o_orderstatus").alias("raw"))
    return explore.record_detail(raw, 7)


def _runs_decorated(spark, sf_dir):
    read = bindings.read
    sources = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    files = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("original_name"))
    mappings = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.col("p_size").alias("version"))
    runs = bindings.import_runs(spark, sf_dir).withColumns({"file_upload_id": F.col("id") % 7 + 1, "mapping_id": F.col("id") % 5 * 1_000_000_000 + 1})
    return explore.import_runs(runs, sources, (), files, mappings).select("id", "source_name", "file_name", "mapping_name", "mapping_version")


def _issue_lines(spark, sf_dir):
    raw = bindings.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("line_number"))
    return explore.issues(bindings.import_issues(spark, sf_dir), raw, severity="warning")


def _run_list(spark, sf_dir):
    sources = bindings.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return explore.import_runs(bindings.import_runs(spark, sf_dir), sources, ("partial", "succeeded")).select("id", "status", "source_name", "created_at")


def _orders(make):
    return lambda spark, sf_dir: make(bindings.read(spark, sf_dir, "orders"))


def _live(orders):
    ends = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
    rows = orders.select(F.col("o_orderkey").alias("id"), ends.alias("expires_at"))
    return explore.live_sessions(rows, datetime(1995, 6, 15)).select("id")


def _preview_keys(spark, sf_dir):
    k = F.col("n_nationkey")
    row = F.to_json(F.struct(F.when(k >= 4, k).alias("c"), F.col("n_name").alias("a"), F.when(k % 2 == 1, k).alias("b")))
    return rollups.row_keys(bindings.read(spark, sf_dir, "nation").select(k.alias("line"), row.alias("row")))


def _map_totals(orders):
    counts = F.create_map(F.lit("session"), F.col("o_orderkey"), F.lit("tool_call"), F.lit(2).cast("long"))
    return rollups.map_total(orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, counts).otherwise(F.create_map().cast("map<string,bigint>")).alias("counts")), "counts").select("o_orderkey", "total")


def _warnings(orders):
    lists = F.array(F.array(F.lit("x"), F.col("o_orderstatus")), F.array(F.lit("y"), F.lit("x"), F.col("o_orderstatus")))
    return rollups.distinct_warnings(orders.select(lists.alias("w")), "w")


def _view(name):
    return _on(lambda t: views.views(t)[name])


def _survivors(spark, sf_dir):
    agents = bindings.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).cast("string").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("v1")).alias("version"))
    return explore.survivors(agents)


def _last_turns(spark, sf_dir):
    return explore.last_turns(bindings.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 3)


def _cache_points(t):
    return metrics.cache_warning(metrics.model_usage(t))


def _point_filters(t):
    usage = metrics.model_usage(t, SOURCE)
    own = metrics.point_filter(SOURCE, model_id=F.col("model_id"), data_source_id=F.col("data_source_id"))
    return usage.select("model_id", "data_source_id", "call_count", F.map_keys(own).alias("keys"), own["model_id"].alias("model_filter"))


QUERIES = {
    "live_sessions": _orders(_live),
    "latest_versions": lambda spark, sf_dir: explore.latest_versions(bindings.read(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("version"))),
    "next_turns": lambda spark, sf_dir: explore.next_turns(bindings.read(spark, sf_dir, "conversations"), "conv_id", "turn"),
    "record_count": _orders(profile.record_count),
    "preview_keys": _preview_keys,
    "map_totals": _orders(_map_totals),
    "warnings_once": _orders(_warnings),
    "call_total_tokens": _on(lambda t: rollups.call_tokens(t.model_call)),
    "view_daily_activity": _view("v_daily_activity"),
    "view_tool_usage": _view("v_tool_usage"),
    "view_model_usage": _view("v_model_usage"),
    "session_metrics": _on(metrics.session_metrics),
    "overview": _on(metrics.overview),
    "overview_window": _on(lambda t: metrics.overview(t, WINDOW)),
    "overview_source_status": _on(lambda t: metrics.overview(t, SOURCE)),
    "overview_used_model_and_tool": _on(lambda t: metrics.overview(t, USED)),
    "overview_agent": _on(lambda t: metrics.overview(t, AGENT)),
    "overview_run": _on(lambda t: metrics.overview(t, RUN)),
    "overview_nothing": _on(lambda t: metrics.overview(t, Filters(data_source_id=-1))),
    "headline_metrics": _on(_headline),
    "activity": _on(metrics.activity),
    "activity_window": _on(lambda t: metrics.activity(t, WINDOW)),
    "tool_usage": _on(metrics.tool_usage),
    "tool_usage_filtered": _on(lambda t: metrics.tool_usage(t, TOOL)),
    "model_usage": _on(metrics.model_usage),
    "model_usage_filtered": _on(lambda t: metrics.model_usage(t, MODEL)),
    "import_quality": _on(metrics.import_quality),
    "import_quality_filtered": _on(lambda t: metrics.import_quality(t, Filters(status="completed"))),
    "cache_warning": _on(_cache_points),
    "point_filters": _on(_point_filters),
    "drill_down": _on(_drill_down),
    "sessions_page": _on(_session_page),
    "sessions_total": _on(lambda t: explore.session_total(t, WINDOW)),
    "timeline": _on(explore.timeline),
    "timeline_all": _on(explore.timeline),
    "session_calls": _on(lambda t: explore.calls(t.model_call, 7)),
    "issues_with_lines": _issue_lines,
    "session_detail": _session_detail,
    "record_detail": _record_detail,
    "import_runs_decorated": _runs_decorated,
    "import_run_list": _run_list,
    "oldest_pending": _on(lambda t: explore.oldest_pending(t.import_run)),
    "agent_survivors": _survivors,
    "last_turns": _last_turns,
    "daily_series": _on(lambda t: rollups.daily_series(metrics.activity(t, SOURCE))),
    "client_session_tokens": _on(lambda t: rollups.client_session_tokens(t.model_call)),
    "quality_summary": _on(lambda t: rollups.quality_summary(t.import_run)),
    "quality_visible_totals": _on(lambda t: rollups.visible_totals(t.import_run)),
    "top_tools": _on(lambda t: rollups.top_tools(metrics.tool_usage(t))),
    "models_by_count": _on(lambda t: rollups.models_by_count(metrics.model_usage(t))),
    "recent_activity": _on(lambda t: rollups.recent_activity(metrics.activity(t)).select("day", "data_source_id", "session_count")),
    "period_90d": _on(lambda t: rollups.since(t.session, "90d", datetime(1998, 8, 2)).select("id", "started_at")),
}

ORACLES = {
    "live_sessions": "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' OR o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1995-06-15'",
    "latest_versions": "SELECT p_brand AS name, max(p_size) + 1 AS next_version FROM part GROUP BY 1",
    "next_turns": "SELECT conv_id, max(turn) + 1 AS next_turn FROM conversations GROUP BY 1",
    "record_count": "SELECT count(*) AS record_count FROM orders",
    "preview_keys": "SELECT ['a', 'b', 'c'] AS keys",
    "map_totals": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 2 ELSE 0 END AS total FROM orders",
    "warnings_once": "SELECT ['x', o_orderstatus, 'y'] AS warnings FROM orders",
    "call_total_tokens": SQL + "SELECT id, input_tokens + output_tokens AS total_tokens FROM model_call",
    "session_metrics": SQL + "SELECT * FROM session_metrics",
    "overview": _sql(_OVERVIEW),
    "overview_window": _sql(_OVERVIEW, "window"),
    "overview_source_status": _sql(_OVERVIEW, "source"),
    "overview_used_model_and_tool": _sql(_OVERVIEW, "used"),
    "overview_agent": _sql(_OVERVIEW, "agent"),
    "overview_run": _sql(_OVERVIEW, "run"),
    "overview_nothing": _sql(_OVERVIEW, "sm.data_source_id = -1"),
    "headline_metrics": SQL
    + """, o AS (SELECT count(*) AS n, count(*) FILTER (token_records_present > 0) AS tp, avg(input_tokens + output_tokens) AS ta, avg(duration_ms) AS da,
  count(duration_ms) AS dp, CAST(sum(tool_error_count) AS BIGINT) AS e, CAST(sum(tool_status_known_count) AS BIGINT) AS k, CAST(sum(tool_call_count) AS BIGINT) AS c FROM session_metrics)
  SELECT 'session_count' AS key, CAST(n AS DOUBLE) AS value, n AS present, n AS total, n / nullif(n, 0) AS ratio FROM o
  UNION ALL SELECT 'avg_tokens_per_session', ta, tp, n, tp / nullif(n, 0) FROM o UNION ALL SELECT 'avg_session_duration_ms', da, dp, n, dp / nullif(n, 0) FROM o
  UNION ALL SELECT 'tool_error_rate', e / nullif(k, 0), k, c, k / nullif(c, 0) FROM o""",
    "activity": _sql(_ACTIVITY),
    "activity_window": _sql(_ACTIVITY, "window"),
    "tool_usage": _sql(_TOOLS),
    "tool_usage_filtered": _sql(_TOOLS, "tool", "AND tc.tool_id = 5"),
    "model_usage": _sql(_MODELS),
    "model_usage_filtered": _sql(_MODELS, "model", "AND mc.model_id = 3"),
    "import_quality": _sql(_QUALITY),
    "import_quality_filtered": _sql(_QUALITY, "EXISTS (SELECT 1 FROM session s WHERE s.import_run_id = r.id AND s.outcome = 'completed')"),
    "cache_warning": SQL + "SELECT (count(*) FILTER (n > 0) > 0) AND (count(*) FILTER (n = 0) > 0) AS warn FROM (SELECT data_source_id, count(cache_read_tokens) AS n FROM model_call mc JOIN session s ON s.id = mc.session_id GROUP BY 1)",
    "point_filters": SQL
    + """SELECT mc.model_id, s.data_source_id, count(*) AS call_count, CASE WHEN mc.model_id IS NULL THEN ['data_source_id', 'status'] ELSE ['data_source_id', 'status', 'model_id'] END AS keys,
  CAST(mc.model_id AS VARCHAR) AS model_filter FROM model_call mc JOIN session s ON s.id = mc.session_id WHERE s.data_source_id = 7 AND s.outcome = 'completed' GROUP BY 1, 2""",
    "drill_down": SQL
    + """SELECT CAST(started_at AS DATE) AS day, data_source_id, count(*) AS session_count, strftime(CAST(started_at AS DATE), '%Y-%m-%d 00:00:00') AS date_from,
  strftime(CAST(started_at AS DATE) + 1, '%Y-%m-%d 00:00:00') AS date_to FROM session_metrics WHERE started_at IS NOT NULL GROUP BY 1, 2, 4, 5""",
    "sessions_page": _sql("SELECT sm.*, s.external_id, s.outcome FROM session_metrics sm JOIN session s ON s.id = sm.session_id WHERE {where} ORDER BY sm.started_at DESC NULLS LAST, sm.session_id DESC LIMIT 50 OFFSET 25", "window"),
    "sessions_total": _sql("SELECT count(*) AS total FROM session_metrics sm WHERE {where}", "window"),
    "timeline": SQL
    + """SELECT 'model_call' AS type, id, session_id, sequence_index, started_at, status, model_id, CAST(NULL AS BIGINT) AS tool_id, input_tokens, output_tokens FROM model_call
  UNION ALL SELECT 'tool_call', id, session_id, sequence_index, started_at, status, NULL, tool_id, NULL, NULL FROM tool_call""",
    "timeline_all": SQL
    + """SELECT 'model_call' AS type, id, session_id, sequence_index, started_at, status, model_id, CAST(NULL AS BIGINT) AS tool_id, input_tokens, output_tokens FROM model_call
  UNION ALL SELECT 'tool_call', id, session_id, sequence_index, started_at, status, NULL, tool_id, NULL, NULL FROM tool_call""",
    "session_calls": SQL + "SELECT * FROM model_call WHERE session_id = 7",
    "issues_with_lines": SQL + "SELECT i.*, o_orderkey AS line_number FROM import_issue i LEFT JOIN orders ON o_orderkey = raw_record_id WHERE severity = 'warning'",
    "session_detail": SQL + "SELECT id, external_id, outcome, coalesce((SELECT list(m.id ORDER BY sequence_index, m.id) FROM model_call m WHERE m.session_id = 7), []) AS model_calls, coalesce((SELECT list(c.id ORDER BY sequence_index, c.id) FROM tool_call c WHERE c.session_id = 7), []) AS tool_calls FROM session WHERE id = 7",
    "record_detail": "SELECT o_orderkey AS id, o_custkey AS line_number, o_orderstatus AS raw FROM orders WHERE o_orderkey = 7",
    "import_runs_decorated": SQL + "SELECT r.id, p.name AS source_name, s_name AS file_name, p_brand AS mapping_name, p_size AS mapping_version FROM import_run r LEFT JOIN provider p ON p.id = r.data_source_id LEFT JOIN supplier ON s_suppkey = r.id % 7 + 1 LEFT JOIN part ON p_partkey = r.id % 5 * 1000000000 + 1",
    "import_run_list": SQL + "SELECT r.id, status, p.name AS source_name, created_at FROM import_run r LEFT JOIN provider p ON p.id = r.data_source_id WHERE status IN ('partial', 'succeeded')",
    "oldest_pending": SQL + "SELECT * FROM import_run WHERE status = 'pending' ORDER BY created_at, id LIMIT 1",
    "agent_survivors": """WITH a AS (SELECT s_suppkey AS id, CAST(s_nationkey % 3 AS VARCHAR) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'v1' END AS version FROM supplier)
  SELECT id, survivor_id FROM (SELECT id, min(id) OVER (PARTITION BY name, version) AS survivor_id FROM a) WHERE id > survivor_id""",
    "last_turns": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3",
    "daily_series": SQL
    + """, a AS (SELECT CAST(started_at AS DATE) AS day, data_source_id, count(*) AS n, sum(model_call_count) AS m, sum(tool_call_count) AS t, sum(input_tokens) AS i, sum(output_tokens) AS o
    FROM session_metrics sm WHERE data_source_id = 7 AND EXISTS (SELECT 1 FROM session s WHERE s.id = sm.session_id AND s.outcome = 'completed') AND started_at IS NOT NULL GROUP BY 1, 2),
  b AS (SELECT day, sum(n) AS n, sum(m) AS m, sum(t) AS t, sum(CASE WHEN i IS NOT NULL OR o IS NOT NULL THEN coalesce(i, 0) + coalesce(o, 0) END) AS k FROM a GROUP BY 1),
  d AS (SELECT CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM b)
  SELECT d.day, CAST(CASE WHEN b.day IS NULL THEN 0 ELSE k END AS BIGINT) AS tokens, CAST(coalesce(n, 0) AS BIGINT) AS session_count, CAST(coalesce(m, 0) AS BIGINT) AS model_call_count,
  CAST(coalesce(t, 0) AS BIGINT) AS tool_call_count FROM d LEFT JOIN b ON b.day = d.day""",
    "client_session_tokens": SQL
    + """SELECT session_id, CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) FILTER (input_tokens IS NOT NULL OR output_tokens IS NOT NULL) AS BIGINT) AS tokens,
  count(*) FILTER (input_tokens IS NOT NULL OR output_tokens IS NOT NULL) AS calls_reporting FROM model_call GROUP BY 1""",
    "quality_summary": SQL
    + """, q AS (SELECT CAST(sum(records_read) AS BIGINT) AS records_read, CAST(sum(records_imported) AS BIGINT) AS records_imported, CAST(sum(records_duplicate) AS BIGINT) AS records_duplicate,
  CAST(sum(records_rejected) AS BIGINT) AS records_rejected FROM import_run) SELECT *, records_imported / nullif(records_read, 0) AS success_rate, records_rejected / nullif(records_read, 0) AS rejection_ratio FROM q""",
    "quality_visible_totals": SQL
    + """SELECT CAST(sum(records_imported) AS BIGINT) AS records_imported, CAST(sum(records_duplicate) AS BIGINT) AS records_duplicate, CAST(sum(records_rejected) AS BIGINT) AS records_rejected
  FROM (SELECT * FROM import_run ORDER BY created_at DESC, id DESC LIMIT 20)""",
    "top_tools": SQL + "SELECT t.name AS tool_name, count(*) AS call_count FROM tool_call c JOIN tool t ON t.id = c.tool_id JOIN session s ON s.id = c.session_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6",
    "models_by_count": SQL + "SELECT coalesce(m.name, 'unknown') AS model_name, count(*) AS call_count FROM model_call c JOIN session s ON s.id = c.session_id LEFT JOIN model m ON m.id = c.model_id GROUP BY 1",
    "recent_activity": SQL + "SELECT CAST(started_at AS DATE) AS day, data_source_id, count(*) AS session_count FROM session_metrics WHERE started_at IS NOT NULL GROUP BY 1, 2 ORDER BY 1 DESC, 2 LIMIT 5",
    "period_90d": SQL + "SELECT id, started_at FROM session WHERE started_at >= TIMESTAMP '1998-05-04'",
}
ORACLES |= {"view_daily_activity": ORACLES["activity"], "view_tool_usage": ORACLES["tool_usage"], "view_model_usage": ORACLES["model_usage"]}
