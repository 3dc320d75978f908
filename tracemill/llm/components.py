"""Connected components of a graph given as edges, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id in edges (a, b): label is the smallest id that can be reached.

    Each round takes the smallest label among a vertex, its neighbours and its label's own label, stored in
    the shared folder; it ends when nothing changes. Null ends are ignored; no edges give no rows.
    """
    both = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = stored(both.select("a", "b").union(both.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        own = labels.withColumnRenamed("label", "old")
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("id").alias("of"), F.col("label").alias("far"))
        step = own.join(near, own["id"] == near["a"], "left").join(jump, F.col("old") == F.col("of"), "left")
        step = step.select("id", "old", F.least("old", F.coalesce("near", "old"), F.coalesce("far", "old")).alias("label"))
        step = stored(step, "labels")
        dropped(labels)
        labels = step.select("id", "label")
        if step.filter(F.col("old") != F.col("label")).isEmpty():
            dropped(both)
            return labels
