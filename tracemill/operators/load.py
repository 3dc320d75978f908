"""One load as a whole: normalise, resolve references, merge by natural key, link calls, explain and report.

A fact names at most one entry of a dimension: a session its agent, a model call its model (within a provider), a
tool call its tool. All facts of a load are rows of one frame, so they are put against all dimensions in one pass.
New names are numbered by hash bucket, without a single task and the same each time a load is repeated.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.merge import unstored_lines, with_ids
from tracemill.operators.normalize import Normalised, normalise
from tracemill.plans.mapping import Mapping
from tracemill.schema import TARGET_FIELDS
from tracemill.sources.readers import settled

# What each fact refers to, as (kind, field, how grave it is if the name has no entry).
REFERS = {"session": ("agent", "agent_name", "warning"), "model_call": ("model", "model_name", "warning"), "tool_call": ("tool", "tool_name", "rejected")}
# Fixed value: the provider of models that come without one.
NO_PROVIDER = "unknown"
KEY = ["kind", "name", "context"]
#: New names of a kind are numbered within this many buckets; names of at least 1 / HOT of all facts are joined apart.
BUCKETS, HOT = 64, 256


def facts(n: Normalised) -> DataFrame:
    """Every entity that was kept as (target, line, source_index, session_key, kind, name, context, provider, and the
    fields in a struct named by target). context is the provider of a model, provider also that of an unnamed one."""
    have = [t for t in REFERS if t in n.entities]
    rows = n.kept.select("target", "line", "source_index", "session_key", *have)
    of_target = lambda pick: F.coalesce(*[F.when(F.col("target") == t, pick(t)) for t in have], F.lit(None).cast("string"))
    rows = rows.withColumns({"kind": of_target(lambda t: F.lit(REFERS[t][0])), "name": of_target(lambda t: F.col(f"{t}.{REFERS[t][1]}"))})
    provider: Column = F.lit(None).cast("string")
    if "model_call" in have:
        provider = F.when(F.col("kind") == "model", F.coalesce("model_call.provider_name", F.when(F.col("name").isNotNull(), F.lit(NO_PROVIDER))))
    return rows.withColumn("provider", provider).withColumn("context", F.when(F.col("name").isNotNull(), F.col("provider")))


def requested(rows: DataFrame) -> DataFrame:
    """(kind, name, context, n): each name that the facts refer to, and how many do. A model's provider counts as well."""
    own = F.struct("kind", "name", "context")
    provider = F.struct(F.lit("provider").alias("kind"), F.col("provider").alias("name"), F.lit(None).cast("string").alias("context"))
    return rows.select(F.inline(F.array(own, provider))).filter("name IS NOT NULL").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["kind"] == b["kind"]) & (a["name"] == b["name"]) & a["context"].eqNullSafe(b["context"])


def grow(dimension: DataFrame, names: DataFrame) -> DataFrame:
    """The dimension (kind, name, context, id) with an entry for every name; ids go on from the largest of the kind.

    A name's number depends on its bucket and its place there alone, so a repeated load gives the same ids. What is
    broadcast has a row for each kind and bucket at most.
    """
    new = names.select(*KEY).distinct().join(dimension, _same(names, dimension), "left_anti")
    new = new.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)))
    sizes = new.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = dimension.groupBy("kind").agg(F.max("id").alias("top"))
    starts = sizes.select("kind", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")).join(tops, "kind", "left")
    at = F.row_number().over(Window.partitionBy("kind", "bucket").orderBy("name", "context"))
    placed = new.withColumn("at", at).join(F.broadcast(starts), ["kind", "bucket"])
    return dimension.select(*KEY, "id").unionByName(placed.select(*KEY, (F.coalesce("top", F.lit(0)) + F.col("start") + F.col("at")).alias("id")))


def resolve(rows: DataFrame, dimension: DataFrame, names: DataFrame) -> DataFrame:
    """The facts with ref_id, null where there is no name or no entry for it.

    Names that at least 1 / HOT of the facts have, HOT at most, are broadcast with their entries, so that no task
    holds all facts of one name; the others meet their entries by an ordinary join. names: requested(rows).
    """
    total = names.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    often = names.filter(F.col("n") * HOT >= max(total, 1)).select(*KEY)
    hot = often.join(dimension, _same(often, dimension), "left").select(*[often[k].alias(f"hot_{k}") for k in KEY], F.col("id").alias("ref_id"), F.lit(True).alias("hot"))
    met = (rows["kind"] == hot["hot_kind"]) & (rows["name"] == hot["hot_name"]) & rows["context"].eqNullSafe(hot["hot_context"])
    marked = rows.join(F.broadcast(hot), met, "left").drop("hot_kind", "hot_name", "hot_context")
    done = F.col("hot").isNotNull() | F.col("name").isNull()
    rest = marked.filter(~done).drop("ref_id")
    rest = rest.join(dimension.select(*[F.col(k).alias(f"own_{k}") for k in KEY], F.col("id").alias("ref_id")), (F.col("kind") == F.col("own_kind")) & (F.col("name") == F.col("own_name")) & F.col("context").eqNullSafe(F.col("own_context")), "left")
    return marked.filter(done).select(*rows.columns, "ref_id").unionByName(rest.select(*rows.columns, "ref_id"))


def unresolved(rows: DataFrame) -> DataFrame:
    """Issues of resolved facts whose name has no entry: (line, target, severity, code, field_path, rows)."""
    of = lambda pick: F.coalesce(*[F.when(F.col("target") == t, F.lit(pick(t))) for t in REFERS])
    lost = rows.filter("name IS NOT NULL AND ref_id IS NULL")
    return lost.select("line", "target", of(lambda t: REFERS[t][2]).alias("severity"), F.lit("REFERENCE_UNRESOLVED").alias("code"), of(lambda t: f"entities[target={t}].fields[target={REFERS[t][1]}]").alias("field_path"), F.lit(1).cast("long").alias("rows"))


def outcomes(incoming: DataFrame, stored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with outcome: existing where the key is stored, repeat where an earlier row of the load has it, else new.

    A repeat of a stored key is a repeat; nulls in keys never match. One window and one join.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    known = stored.select(*keys).distinct().withColumn("__known", F.lit(True))
    rows = incoming.withColumn("__rank", rank).join(known, keys, "left")
    return rows.withColumn("outcome", F.when(F.col("__rank") > 1, "repeat").when(F.col("__known"), "existing").otherwise("new")).drop("__rank", "__known")


class Stored(NamedTuple):
    """What earlier loads left: sessions (id, external_id), calls (id, session_id, sequence_index), the dimension."""

    session: DataFrame
    model_call: DataFrame
    tool_call: DataFrame
    dimension: DataFrame


class Loaded(NamedTuple):
    """New rows with ids (sessions with agent_id, calls with session_id and model_id or tool_id), the dimension with all
    its entries, issues (line, target, severity, code, field_path, rows) and the report (one row)."""

    session: DataFrame
    model_call: DataFrame
    tool_call: DataFrame
    dimension: DataFrame
    issues: DataFrame
    report: DataFrame


def load(records: DataFrame, mapping: Mapping, stored: Stored, create: bool = True, done: DataFrame | None = None) -> Loaded:
    """Load records (line, v) against what is stored; nothing is written but the scratch that later steps read.

    With ``create`` every name asked for gets an entry, otherwise only known names have one. A tool call without its
    tool is not stored, sessions and model calls are, without the link. Sessions are stored once by external_id, calls
    once by session and sequence_index, first wins. Stored rows that come again are duplicates, and so are repeated
    calls; a session repeated within a load is none. Duplicates and calls without a session make one issue a load each.
    Records whose line an earlier attempt of the same run has stored (done: line_number) are left out.
    """
    if done is not None:
        records = settled(unstored_lines(records, done).select("line", "v"))
    n = normalise(records, mapping)
    rows = facts(n)  # read from the pass, which is written
    names = settled(requested(rows))
    dimension = settled(grow(stored.dimension, names)) if create else stored.dimension
    resolved = settled(resolve(rows, dimension, names))
    fit = resolved.filter("target <> 'tool_call' OR ref_id IS NOT NULL")

    own = fit.filter("target = 'session'").select("line", "session.*", F.col("ref_id").alias("agent_id"))
    sessions = settled(outcomes(own, stored.session, ["external_id"], ["line"]))
    new_sessions = settled(with_ids(sessions.filter("outcome = 'new'").drop("outcome"), stored.session, written=True))
    ids = stored.session.select(F.col("external_id").alias("session_key"), F.col("id").alias("session_id"))
    ids = ids.unionByName(new_sessions.select(F.col("external_id").alias("session_key"), F.col("id").alias("session_id")))
    made, counts = {}, sessions.select(F.lit("session").alias("target"), "outcome")
    for target, link in (("model_call", "model_id"), ("tool_call", "tool_id")):
        calls = fit.filter(F.col("target") == target)
        calls = calls.select("line", "source_index", "session_key", f"{target}.*", F.col("ref_id").alias(link)) if target in calls.columns else calls.select("line", "source_index", "session_key", F.lit(0).cast("long").alias("sequence_index"), F.col("ref_id").alias(link)).limit(0)
        told = settled(outcomes(calls.join(ids, "session_key"), getattr(stored, target), ["session_id", "sequence_index"], ["line", "source_index"]))
        counts = counts.unionByName(told.select(F.lit(target).alias("target"), "outcome"))
        unlinked = calls.select("session_key").join(ids, "session_key", "left_anti")
        counts = counts.unionByName(unlinked.select(F.lit(target).alias("target"), F.lit("unlinked").alias("outcome")))
        made[target] = with_ids(told.filter("outcome = 'new'").drop("outcome", "session_key"), getattr(stored, target), written=True)

    told = F.col("outcome")
    again = (told == "existing") | ((told == "repeat") & (F.col("target") != "session"))
    sums = settled(counts.agg(F.count_if(told == "new").alias("imported"), F.count_if(again).alias("duplicate"), F.count_if(told == "unlinked").alias("unlinked")))
    whole = lambda severity, code, rows: sums.filter(F.col(rows) > 0).select(F.lit(None).cast(rows_of["line"].dataType).alias("line"), F.lit(None).cast("string").alias("target"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(None).cast("string").alias("field_path"), F.col(rows).alias("rows"))
    rows_of = n.issues.schema
    issues = n.issues.select("line", "target", "severity", "code", "field_path", "rows").unionByName(unresolved(resolved))
    issues = settled(issues.unionByName(whole("duplicate", "ALREADY_IMPORTED", "duplicate")).unionByName(whole("warning", "PARENT_SESSION_MISSING", "unlinked")))
    own_count = lambda name, df, n: df.agg(n.alias("n")).select(F.lit(name).alias("name"), "n")
    parts = own_count("records_read", records, F.count(F.lit(1)))
    parts = parts.unionByName(own_count("records_rejected", issues, F.count_distinct(F.when(F.col("severity") == "rejected", F.col("line")))))
    parts = parts.unionByName(sums.select(F.inline(F.array(F.struct(F.lit("records_imported").alias("name"), F.col("imported").alias("n")), F.struct(F.lit("records_duplicate").alias("name"), F.col("duplicate").alias("n"))))))
    columns = ("records_read", "records_imported", "records_duplicate", "records_rejected")
    report = parts.agg(*[F.sum(F.when(F.col("name") == c, F.col("n"))).alias(c) for c in columns])
    report = report.withColumn("status", F.when(F.col("records_rejected") > 0, "partial").otherwise("succeeded"))
    return Loaded(new_sessions, made["model_call"], made["tool_call"], dimension, issues, report)
