"""Profiles kept by file and merged: equal to one pass, each file read once."""

import pytest
from pyspark.sql import functions as F

from tracemill.operators import profile, profile_states


def by_path(df):
    return {r["path"]: r.asDict(recursive=True) for r in df.collect()}


def close(states, whole):
    assert set(states) == set(whole)
    for path, want in whole.items():
        got = states[path]
        assert {k: v for k, v in got.items() if k != "distinct_ratio"} == {k: v for k, v in want.items() if k != "distinct_ratio"}, path
        assert (got["distinct_ratio"] is None) == (want["distinct_ratio"] is None)
        assert got["distinct_ratio"] is None or got["distinct_ratio"] == pytest.approx(want["distinct_ratio"], rel=0.03), path


def test_merged_states_equal_one_pass(spark):
    """However the rows are cut into files, null names among them; 60,000 distinct values are estimated within 3 %."""
    rows = spark.range(60_000).select(
        F.col("id").alias("at"), (F.col("id") * 7).alias("n"), F.when(F.col("id") % 10 == 0, F.lit("")).otherwise(F.col("id").cast("string")).alias("s"),
        F.when(F.col("id") % 3 > 0, F.array(F.col("id") % 100, F.lit(None).cast("long"))).alias("l"), F.struct((F.col("id") / 8).alias("d")).alias("o"), F.lit(None).cast("int").alias("z"),
    )
    whole = by_path(profile.profile(rows, "at"))
    cuts = {"one": F.lit("f"), "rows": F.format_string("%03d", F.floor(F.col("at") / 7000)), "null": F.when(F.col("at") >= 20_000, F.lit("b"))}
    for cut in cuts.values():
        states = profile_states.states(rows.withColumn("file", cut), order="at")
        close(by_path(profile_states.merged(states)), whole)
        assert states.agg(F.max(F.length("distinct"))).first()[0] < 20_000  # a state does not grow with its rows


def test_clashing_names_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None)], "`the.file` string, leaf int, file string")
    got = by_path(profile_states.merged(profile_states.states(df, "the.file")))
    assert got["$.leaf"]["max"] == "2" and got["$.file"]["types"] == ["string", "null"] and len(got) == 2
    none = profile_states.states(df.limit(0), "the.file")
    assert none.count() == 0 and profile_states.merged(none).count() == 0


def test_new_files_alone_are_read(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "states")
    source.mkdir()
    (source / "a 1.jsonl").write_text("".join(f'{{"k":{i},"t":"a"}}\n' for i in range(50)))
    (source / "b.jsonl").write_text("".join(f'{{"k":{i},"t":null}}\n' for i in range(50, 70)))
    first = by_path(profile_states.profile_files(spark, str(source), target))
    assert first["$.k"]["max"] == "69" and first["$.t"]["types"] == ["string", "null"] and first["$.t"]["null_ratio"] == pytest.approx(20 / 70)
    close(first, by_path(profile.profile(spark.read.json([str(source / n) for n in ("a 1.jsonl", "b.jsonl")]))))
    # a later file of another format, without t and with k as text; an earlier one that is gone counts on
    (source / "a 1.jsonl").unlink()
    (source / "c.csv").write_text("k,u\nx,1.5\ny,2\n")
    second = by_path(profile_states.profile_files(spark, str(source), target))
    assert second["$.k"]["types"] == ["integer", "string"] and second["$.k"]["examples"] == ["0", "1", "2"] and second["$.k"]["distinct_ratio"] == pytest.approx(1.0)
    assert second["$.t"]["null_ratio"] == pytest.approx(22 / 72) and second["$.u"]["null_ratio"] == pytest.approx(70 / 72) and second["$.u"]["max"] == "2.0"
    kept = spark.read.parquet(target)
    assert kept.filter("path = '$'").count() == 3 and kept.agg(F.sum(F.when(F.col("path") == "$", F.col("rows")))).first()[0] == 72
    assert by_path(profile_states.profile_files(spark, str(source), target)) == second and spark.read.parquet(target).count() == kept.count()


def test_no_sort_of_all_values(spark):
    """Bounds are kept in a hash, and the window that takes the examples is given the first values alone; equal places lose none."""
    from tracemill.plans import traces

    plan = traces.QUERIES["file_profile_states"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate(keys=[file" in plan
    some = spark.range(20_000, numPartitions=3).select(F.lit("f").alias("file"), (F.col("id") % 2).alias("leaf"), (20_000 - F.col("id")).alias("at"), F.col("id").cast("string").alias("value"))
    few = profile_states._early(some)
    assert few.count() < 200
    for leaf, want in ((0, ["2", "4", "6"]), (1, ["1", "3", "5"])):
        assert [str(r["at"]) for r in few.filter(F.col("leaf") == leaf).orderBy("at").limit(3).collect()] == want
    two = spark.createDataFrame([(None, 0, 5, "a"), (None, 0, 5, "b")], "file string, leaf int, at long, value string")
    assert profile_states._early(two).count() == 2
    assert profile_states._early(two.union(two)).count() == 4
