"""Paths, value operators, validation, normalisation and loads on small records."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tracemill.functions import paths, redact, values
from tracemill.functions.values import Value
from tracemill.operators import merge, normalize, profile
from tracemill.plans import mapping as m
from tracemill.plans import traces
from tracemill.sources import readers
from tracemill.streaming.ingest import daily_counts, ingest


def records(spark, *rows):
    df = spark.createDataFrame([(i + 1, json.dumps(r)) for i, r in enumerate(rows)], "line long, raw string")
    return df.withColumn("v", F.try_parse_json("raw"))


def run(spark, make, *rows):
    made = make(Value("variant", paths.resolve(F.col("v"), ("x",))))
    error = made.error if made.error is not None else F.lit(None)
    column = values.text(made) if made.kind == "variant" else made.column
    return [(r[0], r[1]) for r in records(spark, *[{"x": x} for x in rows]).orderBy("line").select(column, error).collect()]


@pytest.mark.parametrize("bad", ["a", "$.a[0]", "$..a", "$.*", "$.a[?(@.b)]", "$['a']", "$.", "$.a["])
def test_paths_outside_the_grammar(bad):
    with pytest.raises(paths.UnsupportedPath):
        paths.parse(bad)


def test_paths_inside_the_grammar():
    assert paths.parse('$.a["b.c"][].d').groups == (("a", "b.c"), ("d",))
    assert paths.iterate_path("$.a").groups == (("a",), ())
    assert paths.strip_prefix("$.a[].b", paths.iterate_path("$.a")).groups == (("b",),)
    assert paths.quote("in ner") == '["in ner"]' and paths.quote("x") == ".x"


def test_iterate_explains_wrong_types_and_keeps_the_rest(spark):
    r = records(spark, {"t": [{"k": [1, 2]}, {"k": "no"}, {"k": [3]}]}, {"t": None}, {"t": 5}, {})
    rows, wrong = paths.iterate(F.col("v"), paths.iterate_path("$.t[].k"))
    got = r.orderBy("line").select(F.transform(rows, lambda x: x.cast("long")), wrong).collect()
    assert [tuple(x) for x in got] == [([1, 2, 3], True), ([], False), ([], True), ([], False)]


def test_casts(spark):
    assert run(spark, lambda v: values.cast(v, "integer"), 2.9, -2.9, " 7 ", "1.5", True, "", None, {"a": 1}) == [(2, None), (-2, None), (7, None), (None, "CAST_FAILED"), (1, None), (None, None), (None, None), (None, "CAST_FAILED")]
    assert run(spark, lambda v: values.cast(v, "boolean"), "YES", 0, False, "x") == [(True, None), (False, None), (False, None), (None, "CAST_FAILED")]
    assert run(spark, lambda v: values.cast(v, "float", "null"), "1e3", "x", 2) == [(1000.0, None), (None, None), (2.0, None)]
    assert run(spark, lambda v: values.cast(v, "string"), True, 5, "  ", "a") == [("True", None), ("5", None), (None, None), ("a", None)]


def test_other_operators(spark):
    assert run(spark, lambda v: values.unit_convert(v, "s", "ms"), 1.005, "2", 0.0005, "x") == [(1005, None), (2000, None), (0, None), (None, "OPERATOR_FAILED")]
    assert run(spark, lambda v: values.map_values(v, {"True": "on", "null": "none", "gone": None}, "passthrough"), True, None, "gone", "other") == [("on", None), ("none", None), (None, None), ("other", None)]
    assert run(spark, lambda v: values.regex_extract(v, r"(a+)(b)?", 1), "xaab", "zzz", None) == [("aa", None), (None, None), (None, None)]
    assert run(spark, values.trim, "\t a \n", 5) == [("a", None), ("5", None)]
    got = run(spark, lambda v: values.parse_datetime(v, "iso8601"), "2024-01-02T03:04:05Z", "2024-01-02", "soon")
    assert got[2] == (None, "DATETIME_PARSE_FAILED") and got[0][1] is None and got[1][1] is None
    assert values.java_pattern("%d/%m/%Y at %H:%M") == "dd/MM/yyyy' at 'HH:mm"


def test_linear_time_expression(spark):
    assert run(spark, lambda v: values.regex_extract(v, r"(?P<y>\d+)-(\d+)", 1), "2024-05") == [("2024", None)]
    assert run(spark, lambda v: values.regex_extract(v, r"(?P<g>\d+)-(?P<m>\d+)", 2), "2024-05") == [("05", None)]
    assert run(spark, lambda v: values.regex_extract(v, r"[](]x(\d)", 1), "]x7", "(x8") == [("7", None), ("8", None)]
    assert run(spark, lambda v: values.regex_extract(v, r"[^]a](?:b)(c)", 1), "]bc", "zbc") == [(None, None), ("c", None)]
    assert run(spark, lambda v: values.regex_extract(v, r"(a+)+$"), "a" * 5000 + "!") == [(None, None)]


def test_type_gate(spark):
    def gate(kind):
        def make(v):
            fitted, bad = values.gate(v, kind)
            return Value(fitted.kind, fitted.column, F.when(bad, "BAD"))

        return make

    assert run(spark, gate("long"), 7, 2.5, "7", True, None) == [(7, None), (2, None), (None, "BAD"), (None, "BAD"), (None, None)]
    assert run(spark, gate("string"), 7, "x", True, [1]) == [("7", None), ("x", None), (None, "BAD"), (None, "BAD")]


DOC = {
    "name": "acceptance",
    "source_format": "jsonl",
    "entities": [
        {"target": "session", "natural_key": ["external_id"], "fields": [{"target": "external_id", "source": "$.sid", "required": True}, {"target": "outcome", "source": "$.outcome"}]},
        {
            "target": "model_call",
            "natural_key": ["sequence_index"],
            "fields": [
                {"target": "sequence_index", "source": "$.seq", "required": True},
                {"target": "model_name", "source": "$.model"},
                {"target": "input_tokens", "source": "$.in_tokens"},
                {"target": "output_tokens", "source": "$.out_tokens"},
            ],
        },
        {
            "target": "tool_call",
            "natural_key": ["sequence_index"],
            "iterate": "$.tools[]",
            "fields": [{"target": "tool_name", "source": "$.name", "required": True}, {"target": "status", "source": "$.status"}, {"target": "sequence_index", "source": "$.i"}],
        },
    ],
}
MAPPING = m.from_json(json.dumps(DOC))
GOOD = [
    {"sid": "s-1", "model": "m", "in_tokens": 300, "out_tokens": 40, "seq": 0, "tools": [{"name": "Bash", "i": 0, "status": "ok"}, {"name": "Read", "i": 1, "status": "error"}]},
    {"sid": "s-2", "model": "m", "in_tokens": 100, "out_tokens": 20, "seq": 0, "tools": [{"name": "Bash", "i": 0, "status": "ok"}]},
]


def test_mapping_round_trip_and_versions():
    assert m.from_json(m.to_json(MAPPING)) == MAPPING
    assert m.validate(MAPPING) == []
    assert m.next_version([MAPPING], MAPPING).version == 2


def test_validation_collects_every_problem():
    bad = json.loads(json.dumps(DOC))
    bad["entities"][0]["natural_key"] = ["nope"]
    bad["entities"][0]["fields"][0]["source"] = "$.a[0]"
    bad["entities"][0]["fields"][1]["operators"] = [{"op": "eval"}, {"op": "cast"}, {"op": "regex_extract", "pattern": "(?=x)"}]
    bad["entities"][1]["fields"] = bad["entities"][1]["fields"][1:]
    bad["entities"].append({"target": "thing", "natural_key": [], "fields": []})
    codes = [p.code for p in m.validate(m.from_json(json.dumps(bad)))]
    for code in ("INVALID_NATURAL_KEY_FIELD", "MAPPING_UNSUPPORTED_PATH", "UNSUPPORTED_OPERATOR", "INVALID_OPERATOR_PARAM", "MISSING_SEQUENCE_INDEX", "UNKNOWN_ENTITY"):
        assert code in codes
    assert codes.count("INVALID_OPERATOR_PARAM") == 2


def test_acceptance_figures(spark):
    n = normalize.normalise(records(spark, *GOOD), MAPPING)
    assert (n.session.count(), n.model_call.count(), n.tool_call.count()) == (2, 2, 3)
    assert tuple(n.model_call.agg(F.sum("input_tokens"), F.sum("output_tokens")).first()) == (400, 60)
    assert n.issues.count() == 0


def test_bad_rows_are_explained_and_the_rest_goes_on(spark):
    rows = [*GOOD, {"sid": None, "seq": 0, "tools": [{"name": "x"}, {"name": "y"}]}, {"sid": "s-3", "outcome": "great"}, {"sid": "s-4", "seq": "7"}, {"sid": "s-5", "seq": 1, "tools": "oops"}, {"sid": "s-6", "seq": 1, "tools": [{"name": " "}, {}, {"name": "z", "status": "fine"}, {"name": "ok"}]}]
    r = records(spark, *rows)
    n = normalize.normalise(r, MAPPING)
    got = {(i["line"], i["target"], i["code"]) for i in n.issues.collect()}
    assert {(3, "session", "MISSING_REQUIRED_FIELD"), (3, "tool_call", "PARENT_SESSION_MISSING"), (3, "model_call", "PARENT_SESSION_MISSING")} <= got
    assert (4, "session", "ENTITY_CONSTRUCTION_FAILED") in got and (5, "model_call", "TYPE_MISMATCH") in got and (6, "tool_call", "ITERATE_NOT_A_LIST") in got
    assert {(7, "tool_call", "REFERENCE_NAME_INVALID"), (7, "tool_call", "MISSING_REQUIRED_FIELD"), (7, "tool_call", "ENTITY_CONSTRUCTION_FAILED")} <= got
    last = n.tool_call.filter("line = 7").collect()
    assert [(x["tool_name"], x["sequence_index"], x["status"]) for x in last] == [("ok", 3, "unknown")]
    report = normalize.report(r, n).first()
    assert (report["records_read"], report["records_rejected"], report["status"]) == (7, 5, "partial")


def test_several_sessions_in_one_record(spark):
    doc = {"name": "x", "source_format": "jsonl", "entities": [{"target": "session", "natural_key": ["external_id"], "iterate": "$.s", "fields": [{"target": "external_id", "source": "$"}]}]}
    n = normalize.normalise(records(spark, {"s": ["a", "b"]}, {"s": []}), m.from_json(json.dumps(doc)))
    assert [r["external_id"] for r in n.session.collect()] == ["a"]
    assert [(i["severity"], i["code"], i["rows"]) for i in n.issues.collect()] == [("warning", "MULTIPLE_SESSIONS_IGNORED", 2)]


def test_loading_twice_adds_nothing(spark):
    calls = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (2, 0, "c")], "session_id long, sequence_index int, x string")
    none = spark.createDataFrame([], "session_id long, sequence_index int, id long")
    new, existing, repeats = merge.merge(calls, none, ["session_id", "sequence_index"], ["x"])
    assert sorted(r["x"] for r in new.collect()) == ["a", "c"] and existing.count() == 0 and repeats.count() == 1
    stored = merge.with_ids(new, none)
    assert sorted(r["id"] for r in stored.collect()) == [1, 2]
    again, existing, _ = merge.merge(calls, stored, ["session_id", "sequence_index"], ["x"])
    assert again.count() == 0 and existing.count() == 2


def test_strict_json_lines(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    assert [r["line"] for r in readers.read_records(spark, str(f)).orderBy("line").collect()] == [1, 2]
    for bad in ("[1]", '{"a": NaN}', '{"a": '):
        f.write_text('{"a": 1}\n\n' + bad + "\n")
        with pytest.raises(Exception, match="line 3"):
            readers.read_records(spark, str(f)).collect()
        assert readers.read_records(spark, str(f), strict=False).filter("v IS NULL").count() == 1


def test_formats(spark, tmp_path):
    assert readers.infer_format("x.NDJSON") == "jsonl" and readers.sniff(b"PAR1..", "x.csv") == "parquet" and readers.sniff(b'{"a":1}', "x.csv") == "jsonl"
    with pytest.raises(ValueError):
        readers.scan_file(spark, "x", "orc")
    f = tmp_path / "a.csv"
    f.write_text("id,name,score\n" + "".join(f"{i},n{i},{i / 2}\n" for i in range(3000)) + "x,,\n")
    df = readers.scan_file(spark, str(f))
    assert dict(df.dtypes)["id"] == "string" and df.filter("name IS NULL").count() == 1
    numbered = readers.numbered(spark.range(100).repartition(7))
    assert sorted(r["line"] for r in numbered.collect()) == list(range(1, 101))


def test_profile_of_nested_rows(spark):
    df = spark.createDataFrame([(1, None, [1, 2], ("a",)), (2, 2.5, [], ("b",)), (3, 3.5, None, ("a",))], "id long, score double, tags array<int>, o struct<`x y`:string>")
    p = {r["path"]: r for r in profile.profile(df).collect()}
    assert set(p) == {"$.id", "$.score", "$.tags[]", '$.o["x y"]'}
    assert p["$.score"]["types"] == ["float", "null"] and p["$.score"]["min"] == "2.5" and p["$.id"]["distinct_ratio"] == 1.0
    assert p["$.tags[]"]["null_ratio"] == 0.5 and p['$.o["x y"]']["examples"] == ["a", "b", "a"]


def test_redaction(spark):
    cases = {
        "mail a.b@example.com now": "mail [REDACTED_EMAIL] now",
        "git@example.com:acme/api.git": "git@example.com:acme/api.git",
        "postgres://u:pw1@h/db": "postgres://u:[REDACTED_PASSWORD]@h/db",
        "API_KEY=abcdefgh12": "API_KEY=[REDACTED_SECRET]",
        "bearer authentication": "bearer authentication",
        "Bearer abc123def456": "Bearer [REDACTED]",
        "sk-abcdefghij": "[REDACTED_API_KEY]",
        "/home/ann/x /Users/bob/y": "/home/[USER]/x /Users/[USER]/y",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(redact.redacted(F.col("t"))).collect()] == list(cases.values())
    assert [redact.redact_text(k) for k in cases] == list(cases.values())
    long = spark.createDataFrame([("x" * 500,)], "t string").select(redact.sanitized(F.col("t"))).first()[0]
    assert len(long) == 200 and long.endswith(redact.MARKER)
    got = spark.createDataFrame([(json.dumps({"a@x.org": 1, "b@x.org": 2, "l": list(range(30))}),)], "t string").select(redact.sanitized_json("t")).first()[0]
    assert json.loads(got) == {"[REDACTED_EMAIL]": 1, "[REDACTED_EMAIL]#2": 2, "l": list(range(20))}


def test_stream_loads_each_file_once(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "1.jsonl").write_text("\n".join(map(json.dumps, GOOD)))
    ingest(spark, str(source), str(target), MAPPING).awaitTermination()
    (source / "2.jsonl").write_text("\n".join(map(json.dumps, [GOOD[0], {**GOOD[0], "seq": 1}])))
    ingest(spark, str(source), str(target), MAPPING).awaitTermination()
    ingest(spark, str(source), str(target), MAPPING).awaitTermination()
    count = lambda t: spark.read.parquet(str(target / t)).count()
    assert (count("session"), count("model_call"), count("tool_call")) == (2, 3, 3)


def test_stream_keeps_lines_that_are_no_json(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "1.jsonl").write_text("\n".join([json.dumps(GOOD[0]), '{"cut": ', "", json.dumps(GOOD[1]), "no json"]))
    ingest(spark, str(source), str(target), MAPPING).awaitTermination()
    ingest(spark, str(source), str(target), MAPPING).awaitTermination()
    bad = spark.read.parquet(str(target / "issue")).filter("code = 'INVALID_JSON'").collect()
    assert sorted(r["raw"] for r in bad) == ["no json", '{"cut": '] and {r["severity"] for r in bad} == {"rejected"}
    assert all(r["file"].endswith("1.jsonl") for r in bad)
    assert spark.read.parquet(str(target / "session")).count() == 2


def test_stream_numbers_and_explains_every_broken_line(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    lines = [json.dumps(GOOD[0]), '{"cut": ', "", "[1]", "NaN", json.dumps(GOOD[1]), "7"]
    (source / "1.jsonl").write_text("\n".join(lines))
    ingest(spark, str(source), str(target), MAPPING).awaitTermination()
    bad = {r["raw"]: (r["line"], r["code"]) for r in spark.read.parquet(str(target / "issue")).filter("target = 'record'").collect()}
    assert bad == {'{"cut": ': (2, "INVALID_JSON"), "[1]": (3, "NOT_AN_OBJECT"), "NaN": (4, "INVALID_JSON"), "7": (6, "NOT_AN_OBJECT")}
    assert sorted(r["line"] for r in spark.read.parquet(str(target / "session")).collect()) == [1, 5]


def test_lines_are_numbered_over_many_partitions(spark, tmp_path):
    path = tmp_path / "many"
    texts = [json.dumps({"i": i}) if i % 3 else "" for i in range(300)]
    spark.createDataFrame([(t,) for t in texts], "value string").repartition(1).coalesce(1).write.text(str(path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 256)
    try:
        got = readers.explained(spark.read.text(str(path))).collect()
        assert len({r["physical"] for r in got}) == 200 and spark.read.text(str(path)).rdd.getNumPartitions() > 3
        assert [(r["line"], texts[r["physical"] - 1]) for r in sorted(got, key=lambda r: r["line"])] == [(k + 1, t) for k, t in enumerate(t for t in texts if t)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_scan_of_the_records(spark):
    from tests.test_catalog import SF
    from tracemill.plans import traces

    for name, scans in (("odd_records_issues", 1), ("normalisation_issues", 2), ("import_report", 2), ("fields_missing", 2), ("file_profile", 2), ("merge_accounting", 2), ("reference_requests", 2), ("import_preview_rejected", 2)):
        text = traces.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Relation [") == scans, name  # records are made of two tables


def test_bytes_are_never_decoded():
    assert redact.sanitize([b"secret", "a@b.org"]) == ["[BINARY:6 bytes]", "[REDACTED_EMAIL]"]


def test_stream_counts_days(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "e"))
    schema = spark.read.parquet(str(tmp_path / "e")).schema
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "e")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = daily_counts(events).writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM days").first()[0] == 1000


def test_values_of_a_record_are_read_once(spark):
    """No filter reads them a second time below the projections, and no value carries its record's names along."""
    sf = "/root/testdata/sf0.001"
    n = normalize.normalise(traces.order_records(spark, sf), traces.ORDER_MAPPING)
    for df in (n.session, n.model_call, n.tool_call, n.issues, n._pass):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.splitlines() if "Filter " in line]
        assert not [line for line in filters if "variant_get" in line]
        assert not re.search(r"AS __[rp]\d", plan)


def test_rows_are_read_by_one_walk(spark):
    """Lists hold what the fields ask for, calls of all targets share their layers, and odd names and rows are read as before."""
    n = normalize.normalise(traces.order_records(spark, "/root/testdata/sf0.001"), traces.ORDER_MAPPING)
    plan = n._pass._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrayType(VariantType" not in plan and "array<variant>" not in plan
    assert sum("Project " in line for line in plan.splitlines()) <= 16
    assert paths.shape([("a",), ("b", "c"), ("b", "d e")]).type == "struct<`a`:variant,`b`:struct<`c`:variant,`d e`:variant>>"
    assert paths.shape([("a",), ("a", "b"), ("A",)]).type == "variant"  # no struct tells a from A
    fields = tuple(m.Field(t, p) for t, p in (("stop_reason", "$.x.a"), ("error_code", "$.x.A"), ("model_name", "$.y.z"), ("provider_name", '$["two words"]'), ("input_tokens", "$.t")))
    own = m.Mapping("m", "jsonl", (m.Entity("session", ("external_id",), (m.Field("external_id", "$.id", True),)), m.Entity("model_call", ("sequence_index",), fields, iterate="$.o[].m[]")))
    raw = '{"id":"s","o":[{"m":[{"x":{"a":"low","A":"up"},"y":{"z":"n"},"two words":"w","t":3},7,null]},{"m":[{"x":"no object","y":[1],"t":{"k":1}}]},{"m":5}]}'
    records = spark.createDataFrame([(1, raw)], "line long, raw string").select("line", F.try_parse_json("raw").alias("v"))
    n = normalize.normalise(records, own)
    names = [f.target for f in fields]
    want = [(0, "low", "up", "n", "w", 3), (1, *[None] * 5), (2, *[None] * 5)]
    assert sorted(tuple(r) for r in n.model_call.select("source_index", *names).collect()) == want
    assert sorted(tuple(r) for r in n.kept.filter("target = 'model_call'").select("source_index", *[f"model_call.{f}" for f in names]).collect()) == want
    told = {(r["code"], r["field_path"].split("=")[-1].strip("]")) for r in n.issues.collect()}
    assert told == {("TYPE_MISMATCH", "input_tokens"), ("ITERATE_NOT_A_LIST", "model_call].iterate")}


def test_values_are_read_as_their_own_type_only(spark):
    """No variant is made of a default or a mapped value to be read again, and a number is not read as text to be cast."""
    n = normalize.normalise(traces.order_records(spark, "/root/testdata/sf0.001"), traces.ORDER_MAPPING)
    plan = n.issues._jdf.queryExecution().optimizedPlan().toString()
    assert "schemaOfVariant(__v" not in plan and "array_position" not in plan
    assert "AS __stringmodel_call_2#" not in plan and "AS __doublemodel_call_2#" not in plan
    raw = ",".join(f'{{"x":{v}}}' for v in ("7", '"x"', "true", "null", "1.50", "[1]"))
    own = (m.Field("error_code", "$.x", False, ({"op": "default", "value": "ok"}, {"op": "map_values", "table": {"9": "nine"}, "on_unknown": "passthrough"})), m.Field("input_tokens", "$.x", False, ({"op": "cast", "to": "integer"},)))
    mapping = m.Mapping("m", "jsonl", (m.Entity("session", ("external_id",), (m.Field("external_id", "$.id", True),)), m.Entity("model_call", ("sequence_index",), own, iterate="$.m[]")))
    records = spark.createDataFrame([(1, f'{{"id":"s","m":[{raw}]}}')], "line long, raw string").select("line", F.try_parse_json("raw").alias("v"))
    n = normalize.normalise(records, mapping)
    got = {r["source_index"]: (r["error_code"], r["input_tokens"]) for r in n.model_call.collect()}
    assert got == {0: ("7", 7), 1: ("x", None), 3: ("ok", None), 4: ("1.5", 1)}  # no boolean or list is text
    told = {(r["code"], r["field_path"].split("=")[-1].strip("]")) for r in n.issues.collect()}
    assert told == {("CAST_FAILED", "input_tokens"), ("TYPE_MISMATCH", "error_code")}
