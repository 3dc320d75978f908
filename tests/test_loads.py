"""Loads as a whole and incremental loads: references, repeats, line numbers, failures between writes, level reads."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_language import GOOD, MAPPING, records
from tracemill.operators import load
from tracemill.plans import mapping as m
from tracemill.sources import readers
from tracemill.streaming import ingest as streams

NOTHING = {"session": "id long, external_id string", "model_call": "id long, session_id long, sequence_index long", "tool_call": "id long, session_id long, sequence_index long", "dimension": "kind string, name string, context string, id long"}
ROUNDS = m.Mapping(
    "rounds",
    "jsonl",
    (
        m.Entity("session", ("external_id",), (m.Field("external_id", "$.s", True), m.Field("agent_name", "$.a"))),
        m.Entity("model_call", ("sequence_index",), (m.Field("sequence_index", "$.i", True), m.Field("model_name", "$.m"), m.Field("provider_name", "$.p"))),
        m.Entity("tool_call", ("sequence_index",), (m.Field("sequence_index", "$.i", True), m.Field("tool_name", "$.t"))),
    ),
)


def stored(spark, **frames):
    return load.Stored(**{k: frames.get(k) or spark.createDataFrame([], v) for k, v in NOTHING.items()})


def after(spark, stored_before, out):
    """What is stored once a load is written."""
    keep = {"session": ["id", "external_id"], "model_call": ["id", "session_id", "sequence_index"], "tool_call": ["id", "session_id", "sequence_index"]}
    grown = {k: getattr(stored_before, k).select(*c).unionByName(getattr(out, k).select(*c)) for k, c in keep.items()}
    return load.Stored(**grown, dimension=out.dimension)


def rounds(spark, session, numbers, **more):
    return records(spark, *[{"s": session, "a": "ann", "i": i, "m": "x", "p": None, "t": "bash"} | more for i in numbers])


def test_a_load_that_extends_a_session_adds_its_calls(spark):
    first = load.load(rounds(spark, "s1", range(2)), ROUNDS, stored(spark))
    # one session though two lines hold it, two calls of each kind
    assert first.report.collect()[0].asDict() == {"records_read": 2, "records_imported": 5, "records_duplicate": 0, "records_rejected": 0, "status": "succeeded"}
    assert first.issues.count() == 0
    second = load.load(rounds(spark, "s1", range(1, 4)), ROUNDS, after(spark, stored(spark), first))
    assert second.session.count() == 0 and [r["sequence_index"] for r in second.tool_call.orderBy("sequence_index").collect()] == [2, 3]
    assert {r["session_id"] for r in second.tool_call.collect()} == {first.session.first()["id"]}
    row = second.report.first()
    assert (row["records_imported"], row["records_duplicate"]) == (4, 3)  # the session, and a call of each kind
    told = [(r["severity"], r["code"], r["rows"]) for r in second.issues.collect()]
    assert told == [("duplicate", "ALREADY_IMPORTED", 3)]
    assert second.dimension.count() == first.dimension.count() == 4  # agent, provider, model, tool


def test_models_are_told_apart_by_their_provider(spark):
    rows = records(spark, {"s": "1", "i": 0, "m": "x", "p": "one"}, {"s": "2", "i": 0, "m": "x", "p": "two"}, {"s": "3", "i": 0, "m": "x"}, {"s": "4", "i": 0, "p": "lone"})
    out = load.load(rows, ROUNDS, stored(spark))
    entries = {(r["kind"], r["name"], r["context"]): r["id"] for r in out.dimension.collect()}
    assert set(entries) == {("model", "x", "one"), ("model", "x", "two"), ("model", "x", "unknown"), ("provider", "one", None), ("provider", "two", None), ("provider", "unknown", None), ("provider", "lone", None)}
    assert sorted(v for k, v in entries.items() if k[0] == "model") == [1, 2, 3] and sorted(v for k, v in entries.items() if k[0] == "provider") == [1, 2, 3, 4]
    by_line = {r["line"]: r["model_id"] for r in out.model_call.collect()}
    assert by_line == {1: entries["model", "x", "one"], 2: entries["model", "x", "two"], 3: entries["model", "x", "unknown"], 4: None}
    again = load.load(rows, ROUNDS, stored(spark))
    assert {(r["kind"], r["name"], r["context"]): r["id"] for r in again.dimension.collect()} == entries


def test_names_without_an_entry_are_told(spark):
    known = spark.createDataFrame([("tool", "bash", None, 7), ("agent", "ann", None, 3)], NOTHING["dimension"])
    rows = records(spark, {"s": "1", "a": "ann", "i": 0, "t": "bash", "m": "x"}, {"s": "2", "a": "bob", "i": 0, "t": "grep"}, {"s": "3", "i": 0, "t": "bash"})
    out = load.load(rows, ROUNDS, stored(spark, dimension=known), create=False)
    told = sorted((r["line"], r["target"], r["severity"], r["code"]) for r in out.issues.filter("code = 'REFERENCE_UNRESOLVED'").collect())
    assert told == [(1, "model_call", "warning", "REFERENCE_UNRESOLVED"), (2, "session", "warning", "REFERENCE_UNRESOLVED"), (2, "tool_call", "rejected", "REFERENCE_UNRESOLVED")]
    assert {r["line"]: r["agent_id"] for r in out.session.collect()} == {1: 3, 2: None, 3: None}
    assert {r["line"]: r["tool_id"] for r in out.tool_call.collect()} == {1: 7, 3: 7}
    report = out.report.first()
    assert (report["records_rejected"], report["status"]) == (1, "partial")


def test_hot_names_and_rare_ones_get_the_same_ids(spark):
    """A name that most facts have is joined apart; so is a hot name without an entry. No fact is lost or doubled."""
    rows = spark.range(3000).select(F.lit("tool_call").alias("target"), F.col("id").alias("line"), F.lit("tool").alias("kind"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "lost").otherwise(F.col("id").cast("string")).alias("name"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("string").alias("provider"))
    names = load.requested(rows)
    entries = load.grow(spark.createDataFrame([], NOTHING["dimension"]), names.filter("name <> 'lost'"))
    assert sorted(r["id"] for r in entries.collect()) == list(range(1, 1002))
    ids = {r["name"]: r["id"] for r in entries.collect()}
    found = load.resolve(rows, entries, names).collect()
    assert len(found) == 3000 and all(r["ref_id"] == ids.get(r["name"]) for r in found)


def test_empty_loads(spark):
    out = load.load(records(spark, {"s": "1"}).limit(0), ROUNDS, stored(spark))
    assert out.report.first()["records_read"] == 0 and out.session.count() == 0 and out.dimension.count() == 0


def test_several_sessions_in_a_record(spark):
    both = m.Mapping("b", "jsonl", (m.Entity("session", ("external_id",), (m.Field("external_id", "$.s[].id", True),), iterate="$.s[]"), m.Entity("tool_call", ("sequence_index",), (m.Field("tool_name", "$.t[].n"),), iterate="$.t[]")))
    out = load.load(records(spark, {"s": [{"id": "a"}, {"id": "b"}], "t": [{"n": "x"}, {"n": "y"}]}), both, stored(spark))
    assert (out.session.count(), out.tool_call.count()) == (1, 2)
    assert [r["code"] for r in out.issues.collect()] == ["MULTIPLE_SESSIONS_IGNORED"]


def test_lines_are_numbered_within_their_file(spark, tmp_path):
    """Three files split over many partitions, each broken line found by its own numbers."""
    want, folder = {}, tmp_path / "in"
    folder.mkdir()
    for f, n in (("a.jsonl", 150), ("b.jsonl", 90), ("c.jsonl", 1)):
        lines, kept = [], 0
        for i in range(n):
            text = "" if i % 4 == 1 else f"broken {f} {i}" if i % 7 == 0 else json.dumps({"i": i, "pad": "y" * (i % 13)})
            kept += bool(text)
            lines.append(text)
            if text.startswith("broken"):
                want[text] = (f, i + 1, kept)
        (folder / f).write_text("\n".join(lines) + ("\n" if f == "b.jsonl" else ""))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 512)
    spark.conf.set("spark.sql.files.openCostInBytes", 64)
    try:
        lines = readers.text_lines(spark.read, str(folder))
        assert lines.rdd.getNumPartitions() > 6
        rows, files = readers.explained_by_file(lines)
        names = {r["number"]: r["file"].rsplit("/", 1)[1] for r in files.collect()}
        got = rows.select("*", readers.line_in_file(F.col("line")).alias("own"), readers.file_number(F.col("line")).alias("no")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r["raw"]: (names[r["no"]], r["physical"], r["own"]) for r in got if r["broken"]} == want
    assert len({r["line"] for r in got}) == len(got)


def put(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def take(spark, source, target, mapping=ROUNDS, **how):
    streams.ingest(spark, str(source), str(target), mapping, **how).awaitTermination()


def round_of(s, i):
    return {"s": s, "a": "ann", "i": i, "m": "x", "t": "bash"}


def test_repeats_make_one_issue_a_batch_and_rows_know_their_file(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    put(source, "1.jsonl", round_of("a", 0), "", round_of("a", 1))
    put(source, "2.jsonl", round_of("b", 0), "no json", round_of("b", 0))
    take(spark, source, target)
    put(source, "3.jsonl", round_of("a", 1), round_of("a", 2), round_of("c", 0))
    take(spark, source, target)
    calls = {(r["session_key"], r["sequence_index"]): (r["file"].rsplit("/", 1)[1], r["line"]) for r in streams.loaded(spark, str(target), "tool_call").collect()}
    assert calls == {("a", 0): ("1.jsonl", 1), ("a", 1): ("1.jsonl", 2), ("b", 0): ("2.jsonl", 1), ("a", 2): ("3.jsonl", 2), ("c", 0): ("3.jsonl", 3)}
    issues = streams.loaded(spark, str(target), "issue").orderBy("batch", "code").collect()
    assert [(r["batch"], r["code"], r["rows"]) for r in issues] == [(0, "ALREADY_IMPORTED", 2), (0, "INVALID_JSON", 1), (1, "ALREADY_IMPORTED", 3)]
    broken = issues[1]
    assert (broken["file"].rsplit("/", 1)[1], broken["line"], broken["physical"], broken["raw"]) == ("2.jsonl", 2, 2, "no json")


@pytest.mark.parametrize("at", ["model_call", "issue", "manifest"])
def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch, at):
    """The second load dies before one of its writes; nothing of it shows, and the next one completes it."""
    source, target = tmp_path / "in", tmp_path / "out"
    put(source, "1.jsonl", round_of("a", 0))
    take(spark, source, target)
    put(source, "2.jsonl", round_of("a", 0), round_of("b", 0), round_of("b", 1))
    whole = streams._write

    def dies(df, path):
        if f"/{at}/batch=1" in path and "_staged" not in path:
            raise RuntimeError("lost")
        whole(df, path)

    monkeypatch.setattr(streams, "_write", dies)
    with pytest.raises(Exception, match="lost"):
        take(spark, source, target)
    count = lambda t: streams.loaded(spark, str(target), t).count()
    assert (count("session"), count("model_call"), count("tool_call"), count("issue")) == (1, 1, 1, 0)
    monkeypatch.setattr(streams, "_write", whole)
    take(spark, source, target)
    assert (count("session"), count("model_call"), count("tool_call"), count("issue")) == (2, 3, 3, 1)


def test_a_filled_target_without_its_checkpoint_is_refused(spark, tmp_path):
    import shutil

    source, target = tmp_path / "in", tmp_path / "out"
    put(source, "1.jsonl", round_of("a", 0))
    take(spark, source, target)
    shutil.rmtree(target / "_checkpoint")
    with pytest.raises(ValueError, match="checkpoint"):
        take(spark, source, target)


def test_reads_stay_level_over_many_batches_of_random_keys(spark, tmp_path):
    """Eight loads of random keys: what a load reads does not follow what is stored."""
    import uuid

    source, target, read = tmp_path / "in", tmp_path / "out", []
    total = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalInputBytes()
    for i in range(8):
        put(source, f"{i}.jsonl", *[round_of(uuid.uuid4().hex, 0) for _ in range(400)])
        before = total()
        take(spark, source, target)
        read.append(total() - before)
    assert streams.loaded(spark, str(target), "session").count() == 3200
    assert read[0] > 0 and max(read[4:]) < 1.3 * max(read[1:4])


def test_good_records_of_the_language_tests_load_as_before(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    put(source, "1.jsonl", *GOOD)
    take(spark, source, target, MAPPING)
    assert streams.loaded(spark, str(target), "session").count() == 2


def test_a_load_writes_each_fact_few_times(spark, monkeypatch):
    """The pass, the resolved facts and what is told of each entity are written, and nothing twice."""
    from tracemill.operators import merge as merging
    from tracemill.operators import normalize as normalizing
    from tracemill.plans import traces

    sf, wide = "/root/testdata/sf0.001", []

    def counted(df, own=load.settled):
        facts = any(c in df.columns for c in ("session_key", "sequence_index", "external_id"))
        wide.append(df.columns) if facts else None
        return own(df)

    for module in (load, merging, normalizing):
        monkeypatch.setattr(module, "settled", counted)
    out = traces._load(spark, sf)
    assert len(wide) == 6, wide
    ids = [r["id"] for r in out.session.select("id").collect()]
    assert len(set(ids)) == len(ids) > 0
