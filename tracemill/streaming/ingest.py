"""Incremental loads: new files of a folder, merged by natural key exactly once, seen by readers as whole batches.

Two streams follow each other. The first takes new files, numbers their lines by file, judges each record once and
stages the rows with their natural keys, one row a key and batch. The second puts the keys against a state store that
holds every key ever loaded, so what it reads follows the new keys and not the history; it then writes the new rows of
all tables and last of all the batch's row in the manifest. Readers see the batches that the manifest names: after a
failure between two writes nothing of the batch shows, and its repetition overwrites what was left.

Spark's checkpoints hold what was taken and the state. A target whose checkpoint is gone is refused, since a stream
from the start would overwrite it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracemill.operators.load import facts
from tracemill.operators.normalize import normalise
from tracemill.plans.mapping import Mapping
from tracemill.schema import TARGET_FIELDS
from tracemill.sources.readers import explained_by_file, file_number, line_in_file, text_lines

TABLES = ("session", "model_call", "tool_call", "issue")
STATE_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STAGED = "target string, session_key string, sequence_index long, line long, source_index int, repeats long"
VERDICT = "batch long, target string, line long, source_index int, repeats long, stored boolean"
#: The row by which a staged batch is known even if it holds no fact.
BATCH = "batch"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _stage(spark: SparkSession, staged: str, mapping: Mapping, batch: DataFrame, number: int) -> None:
    """Judge a batch of lines; what is staged last, the keys, is what the second stream follows."""
    records, files = explained_by_file(batch)
    told = F.array(F.struct(F.lit("rejected").alias("severity"), F.col("broken").alias("code"), F.lit(None).cast("string").alias("field_path")))
    broken = records.filter("broken IS NOT NULL").select("line", "physical", "raw", told.alias("issues"), F.lit("record").alias("target"), F.lit(0).alias("source_index"))
    here = lambda name: f"{staged}/{name}/batch={number}"
    n = normalise(records.filter("broken IS NULL").select("line", "v"), mapping)
    _write(n._pass, here("judged"))  # judged once, read from here on
    n._pass = spark.read.schema(n._pass.schema).parquet(here("judged"))
    n.kept = n._pass.filter("kept")
    rows = facts(n)
    _write(rows.drop("kind", "name", "context", "provider"), here("row"))
    _write(n.issues.drop("source_index").unionByName(broken.select("line", "physical", "raw", "target", F.inline("issues")).withColumn("rows", F.lit(1).cast("long")), allowMissingColumns=True), here("issue"))
    _write(files, here("file"))
    rows = spark.read.schema(rows.drop("kind", "name", "context", "provider").schema).parquet(here("row"))
    index = F.coalesce(*[F.when(F.col("target") == t, F.col(f"{t}.sequence_index")) for t in TABLES[1:3] if t in rows.columns], F.lit(-1).cast("long"))
    first = F.min(F.struct("line", "source_index"))
    keyed = rows.withColumn("key", F.coalesce(F.when(F.col("target") == "session", F.col("session.external_id")) if "session" in rows.columns else F.lit(None), "session_key"))
    keys = keyed.groupBy("target", F.col("key").alias("session_key"), index.alias("sequence_index")).agg(first.alias("first"), (F.count(F.lit(1)) - 1).alias("repeats"))
    keys = keys.select("target", "session_key", "sequence_index", "first.line", "first.source_index", "repeats")
    mark = spark.range(1).select(F.lit(BATCH).alias("target"), F.lit(str(number)).alias("session_key"), F.lit(-1).cast("long").alias("sequence_index"), F.lit(0).cast("long").alias("line"), F.lit(0).alias("source_index"), F.lit(0).cast("long").alias("repeats"))
    _write(keys.unionByName(mark), here("key"))


def _seen(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A key's rows, one a staged batch: whether it was stored before; the first of the earliest batch is not."""
    known = state.exists
    rows = pd.concat(list(frames)).sort_values("batch", kind="stable")
    rows["stored"] = [known or i > 0 for i in range(len(rows))]
    if not known:
        state.update((True,))
    yield rows[["batch", "target", "line", "source_index", "repeats", "stored"]]


def _commit(spark: SparkSession, staged: str, target: str, verdict: DataFrame, number: int) -> None:
    """Write what is new of the staged batches that the verdicts are about, the manifest last."""
    here = lambda name: f"{target}/{name}/batch={number}"
    _write(verdict, here("_verdict"))
    verdict = spark.read.schema(verdict.schema).parquet(here("_verdict"))
    batches = verdict.filter(F.col("target") == BATCH).select("batch")
    low, high = batches.agg(F.min("batch"), F.max("batch")).first()
    if low is None:  # all of these batches were committed before
        return
    part = lambda name: spark.read.option("mergeSchema", True).option("basePath", f"{staged}/{name}").parquet(f"{staged}/{name}").filter(F.col("batch").between(low, high)).join(batches, "batch", "left_semi")
    files = part("file").select("batch", F.col("number").alias("file_no"), "file")
    named = lambda df: df.withColumn("file_no", file_number(F.col("line"))).join(files, ["batch", "file_no"], "left").withColumn("line", line_in_file(F.col("line"))).drop("batch", "file_no")
    new = part("row").join(verdict.filter("NOT stored").select("batch", "target", "line", "source_index"), ["batch", "target", "line", "source_index"], "left_semi")
    for name in TABLES[:3]:
        key = ["session_key"] if name != "session" else []
        own = new.filter(F.col("target") == name)
        fields = [F.col(f"{name}.{f}").alias(f) for f in TARGET_FIELDS[name]] if name in new.columns else [F.lit(None).cast({"long": "bigint"}.get(k, k)).alias(f) for f, k in TARGET_FIELDS[name].items()]
        _write(named(own.select("batch", "line", "source_index", *key, *fields)), here(name))
    again = F.sum(F.when(F.col("target") == BATCH, 0).when(F.col("target") == "session", F.col("stored").cast("long")).otherwise(F.col("repeats") + F.col("stored").cast("long")))
    told = {"line": F.lit(None).cast("long"), "target": F.lit(None).cast("string"), "severity": F.lit("duplicate"), "code": F.lit("ALREADY_IMPORTED"), "field_path": F.lit(None).cast("string"), "rows": F.col("rows")}
    repeated = verdict.agg(again.alias("rows")).filter("rows > 0").select(*[c.alias(k) for k, c in told.items()])
    _write(named(part("issue")).unionByName(repeated, allowMissingColumns=True), here("issue"))
    _write(batches.withColumnRenamed("batch", "staged"), here("manifest"))


def loaded(spark: SparkSession, target: str, table: str) -> DataFrame:
    """A table of a target: the rows of whole batches only."""
    whole = spark.read.parquet(f"{target}/manifest").select("batch").distinct()
    return spark.read.parquet(f"{target}/{table}").join(whole, "batch", "left_semi")


def _sweep(spark: SparkSession, staged: str, target: str) -> None:
    """Remove staged batches that are committed."""
    if not _exists(spark, f"{target}/manifest"):
        return
    for (number,) in spark.read.parquet(f"{target}/manifest").select("staged").distinct().collect():  # numbers of batches
        for name in ("judged", "row", "issue", "file", "key"):
            if _exists(spark, at := f"{staged}/{name}/batch={number}"):
                _remove(spark, at)


def ingest(spark: SparkSession, source: str, target: str, mapping: Mapping, files_per_batch: int = 16) -> StreamingQuery:
    """Load all files of ``source`` (JSON lines) that were not loaded yet into Parquet folders under ``target``.

    Tables carry file and line of every row (see loaded()). Lines that hold no JSON object are rejected issues with
    their text and both their numbers; stored rows that come again make one ALREADY_IMPORTED issue a batch.
    """
    staged = f"{target}/_staged"
    for made, checkpoint in ((f"{staged}/key", f"{staged}/_checkpoint"), (f"{target}/manifest", f"{target}/_checkpoint")):
        if _exists(spark, made) and not _exists(spark, checkpoint):
            raise ValueError(f"{made} is filled but {checkpoint} is gone; a load from the start would overwrite it")
    _sweep(spark, staged, target)
    lines = text_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch), source)
    stage = lines.writeStream.foreachBatch(lambda batch, n: _stage(spark, staged, mapping, batch, n))
    stage.option("checkpointLocation", f"{staged}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark.conf.set(STATE_KEY, ROCKS)  # keys on disk, point look-ups
    keys = spark.readStream.schema(f"{STAGED}, batch long").option("basePath", f"{staged}/key").parquet(f"{staged}/key")
    told = keys.groupBy("target", "session_key", "sequence_index").applyInPandasWithState(_seen, VERDICT, "stored boolean", "update", GroupStateTimeout.NoTimeout)
    commit = told.writeStream.outputMode("update").foreachBatch(lambda batch, n: _commit(spark, staged, target, batch, n))
    return commit.option("checkpointLocation", f"{target}/_checkpoint").trigger(availableNow=True).start()


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows and errors by UTC day and type of a stream; days close when the watermark has passed them."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("day_start"), "event_type", "n", "value")
    )
