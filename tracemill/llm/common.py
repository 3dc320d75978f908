"""What the operators of this subpackage share: table access and durable scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Empty what stored() wrote for these frames, once all that was made of them is stored itself.

    Every folder is overwritten by an empty table, so any store that Spark reaches will do.
    """
    for df in frames:
        nothing = df.sparkSession.createDataFrame([], df.schema)
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            nothing.coalesce(1).write.mode("overwrite").parquet(folder)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text (null: empty) under fixed names, so other columns cannot clash."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


#: Bytes of texts that an operator works on at a time, and rows that Spark hands to Python at a time.
PIECE_BYTES, BATCH_ROWS = 4 << 20, 1_000
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches cut to BATCH_ROWS rows where they were longer.

    Ten thousand long texts in a batch are held several times over, in the JVM and in Python.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_KEY)) <= BATCH_ROWS:
        conf.set(BATCH_KEY, BATCH_ROWS)
    return df


def pieces(batches: Iterator[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again in batches of about ``limit`` bytes, one row at least."""
    held: list[pa.RecordBatch] = []

    def cut() -> Iterator[pa.RecordBatch]:
        for b in pa.Table.from_batches(held).combine_chunks().to_batches() if len(held) > 1 else list(held):
            step = max(1, int(b.num_rows * limit / max(b.nbytes, 1)))
            for at in range(0, b.num_rows, step):
                yield b.slice(at, step)
        held.clear()

    for b in batches:
        if b.num_rows:
            held.append(b)
            if sum(x.nbytes for x in held) >= limit:
                yield from cut()
    if held:
        yield from cut()
    pa.default_memory_pool().release_unused()


def derive(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], fields: str, keep: list[str], limit: int = PIECE_BYTES) -> DataFrame:
    """Columns ``keep`` of df as they are, and ``fields`` (a DDL string) computed batch by batch.

    ``make`` is called once a task and returns the function from a record batch to lists by name, so
    tables and caches live as long as the task. Kept columns stay Arrow: nulls and 64-bit ids survive.
    """
    added = T.StructType.fromDDL(fields)
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in pieces(batches, limit):
            made = work(batch)
            columns = [batch.column(c).cast(arrow.field(c).type) for c in keep]
            columns += [x if isinstance(x := made[f.name], pa.Array) else pa.array(x, arrow.field(f.name).type) for f in added]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return bound_batches(df).mapInArrow(run, schema)
