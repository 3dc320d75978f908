"""Records to sessions, model calls and tool calls, with an explanation for every row that is turned away.

All of it is projection over a record's own row, except that a record's several sessions are gathered again once
they are judged, and that calls whose session was rejected make one issue a record and entity. Sessions are ranked
within their record's own list. Issues, report, missing fields and previews come from one pass over the records, in
which a record's sessions and calls are rows of one exploded list.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import paths
from tracemill.plans.compile import ISSUE, entity_frame, entity_rows, entity_steps, issue, shape_of
from tracemill.plans.mapping import Entity, Mapping, validate
from tracemill.schema import OUTCOMES, STATUSES, TARGET_FIELDS
from tracemill.sources.readers import settled


# The names that each entity asks for, as (kind, field, field of the provider they belong to).
ASKS = (
    ("session", ("agent", "agent_name", None)),
    ("model_call", ("provider", "provider_name", None)),
    ("model_call", ("model", "model_name", "provider_name")),
    ("tool_call", ("tool", "tool_name", None)),
)

# The fields of each entity that hold names.
NAMES = {"session": ["agent_name"], "model_call": ["model_name", "provider_name"], "tool_call": ["tool_name"]}
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
#: Methods of more bytecode than this are never compiled by the JVM (-XX:HugeMethodLimit).
COMPILED_BYTES = 8000


def _flag(when: Column, code: str, at: str | None = None) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), issue("rejected", code, at))


def _where(rows: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet the condition, which is read where it stands.

    A filter over projections moves below them and computes all that it asks for a second time, unless they number rows.
    """
    return rows.withColumn("__at", F.monotonically_increasing_id()).filter(condition & (F.col("__at") >= 0)).drop("__at")


def _refusal(entity: Entity, of: Callable[[str], Column]) -> Column:
    """Why a row is refused, in order of judgement: natural key, names, vocabulary; only the first kind applies."""
    keys = [of(k).isNull() for k in entity.natural_key]
    no_key = F.greatest(*keys, F.lit(False)) if keys else F.lit(False)
    at = lambda f: f"entities[target={entity.target}].fields[target={f}]"
    bad_name = F.lit(False)
    if entity.target == "tool_call":
        blank = of("tool_name").isNotNull() & (F.btrim(of("tool_name")) == "")
        bad_name = F.coalesce(blank, F.lit(False))
    vocabulary = ~of("outcome").isin(*OUTCOMES) if entity.target == "session" else ~of("status").isin(*STATUSES)
    unbuilt = F.coalesce(vocabulary, F.lit(False))
    if entity.target == "tool_call":
        unbuilt = unbuilt | of("tool_name").isNull()
    return F.coalesce(_flag(no_key, "MAPPING_MISSING_NATURAL_KEY"), _flag(bad_name, "REFERENCE_NAME_INVALID", at(NAMES[entity.target][0])), _flag(unbuilt, "ENTITY_CONSTRUCTION_FAILED"))


def _tidy(target: str, of: Callable[[str], Column]) -> dict[str, Column]:
    return {n: F.when(F.btrim(of(n)) != "", of(n)) for n in NAMES[target]}


def _judged(rows: DataFrame, entity: Entity) -> DataFrame:
    """Add refusals, and names without blank ones."""
    return rows.withColumn("refusal", _refusal(entity, F.col)).withColumns(_tidy(entity.target, F.col))


def _with_refusal(issues: Column, rejected: Column, refusal: Column) -> Column:
    """Issues of the fields, and the refusal of a row that its fields did not reject."""
    return F.when(~rejected & refusal.isNotNull(), F.concat(issues, F.array(refusal))).otherwise(issues)


def _defaults(target: str, of: Callable[[str], Column]) -> dict[str, Column]:
    if target == "session":
        return {}
    return {"sequence_index": F.coalesce(of("sequence_index"), F.col("source_index").cast("long")), "status": F.coalesce(of("status"), F.lit("unknown"))}


class _Items:
    """Rows of the exploded list of a record: each target's row stands in a column of its own, under the entity's shape."""

    def __init__(self, shapes: dict[str, paths.Shape]):
        self.rows = {t: (f"row_{t}", s.type) for t, s in shapes.items()}

    def of(self, target: str, odd: bool = False):
        """``odd`` stands for something that is no list where one should be."""

        def made(row: Column | None, at: Column) -> Column:
            own = [(row if t == target and row is not None else F.lit(None).cast(kind)).alias(name) for t, (name, kind) in self.rows.items()]
            return F.struct(F.lit(target).alias("target"), at.cast("int").alias("source_index"), *own, F.lit(odd).alias("odd"))

        return made

    def wrong(self, target: str, when: Column) -> Column:
        """The list of the odd item of a target where the condition holds, else an empty one."""
        return F.filter(F.array(F.when(when, self.of(target, odd=True)(None, F.lit(0)))), lambda x: x.isNotNull())


class Normalised:
    """Entities by line, and issues of (line, target, severity, code, field_path, rows); each is built when asked for."""

    def __init__(self, records: DataFrame, mapping: Mapping):
        self.records = records
        self.entities = {e.target: e for e in mapping.entities}

    def _nothing(self, target: str) -> DataFrame:
        fields = [F.lit(None).cast({"long": "bigint"}.get(k, k)).alias(f) for f, k in TARGET_FIELDS[target].items()]
        return self.records.select("line", F.lit(0).alias("source_index"), *fields).limit(0)

    @cached_property
    def _sessions(self) -> DataFrame:
        """Session rows with their verdict and the record, of mappings with one session a record."""
        session = self.entities["session"]
        return _judged(entity_rows(self.records, session, ("line", "v"))[0], session)

    @cached_property
    def _gathered(self) -> DataFrame:
        """(line, v, all, odd) of mappings with several sessions a record: its judged sessions, those that their fields did
        not reject first, in order; whether its path holds something that is no list. The only shuffle: by record."""
        session = self.entities["session"]
        prefix = paths.iterate_path(session.iterate)
        own = shape_of(session)
        rows, wrong = paths.iterate(F.col("v"), prefix, element=own.type)
        item = _Items({"session": own})
        items = F.concat(F.transform(rows, item.of("session")), item.wrong("session", wrong))
        opened = self.records.select("line", "v", F.explode_outer(items).alias("i")).select("line", "v", "i.source_index", F.col("i.row_session").alias("__row"), "i.odd")
        judged = _judged(entity_frame(opened, session, "__row", prefix, ("line", "v", "source_index", "odd")), session)
        verdict = F.struct("rejected", "source_index", "refusal", "issues", F.struct(*TARGET_FIELDS["session"]).alias("session"))
        whole = judged.groupBy("line").agg(F.first("v").alias("v"), F.collect_list(F.when(~F.col("odd"), verdict)).alias("all"), F.coalesce(F.bool_or("odd"), F.lit(False)).alias("odd"))
        return whole.withColumn("all", F.sort_array("all"))  # one record's sessions

    @cached_property
    def session(self) -> DataFrame:
        if "session" not in self.entities:
            return self._nothing("session")
        if self.entities["session"].iterate:
            return self.kept.filter("target = 'session'").select("line", "source_index", "session.*")
        return _where(self._sessions, ~F.col("rejected") & F.col("refusal").isNull()).drop("issues", "rejected", "refusal", "v")

    @cached_property
    def _whole(self) -> DataFrame:
        """Records with has_session, session_key, and session, the fields of the one that counts; ``all`` and ``all_odd``
        of records with several, session_issues of those with one."""
        session, fields = self.entities.get("session"), F.struct(*TARGET_FIELDS["session"])
        if session is None:
            none = F.lit(None).cast("struct<" + ",".join(f"{f}:{ {'long': 'bigint'}.get(k, k)}" for f, k in TARGET_FIELDS["session"].items()) + ">")
            return self.records.select("line", "v", F.lit(False).alias("has_session"), F.lit(None).cast("string").alias("session_key"), none.alias("session"))
        if session.iterate:
            first = F.get("all", F.lit(0))
            fine = F.coalesce(~first["rejected"] & first["refusal"].isNull(), F.lit(False))
            return self._gathered.select("line", "v", "all", F.col("odd").alias("all_odd"), fine.alias("has_session"), first["session"]["external_id"].alias("session_key"), F.when(fine, first["session"]).alias("session"))
        fine = ~F.col("rejected") & F.col("refusal").isNull()
        return self._sessions.select("line", "v", fine.alias("has_session"), F.col("external_id").alias("session_key"), F.when(fine, fields).alias("session"), _with_refusal(F.col("issues"), F.col("rejected"), F.col("refusal")).alias("session_issues"))

    def _calls(self, target: str) -> tuple[DataFrame, DataFrame]:
        entity = self.entities[target]
        rows, odd = entity_rows(self._whole.select("line", "v", "has_session", "session_key"), entity, ("line", "has_session", "session_key"))
        judged = _judged(rows.withColumns(_defaults(target, F.col)), entity)
        return judged.withColumn("refusal", F.when(F.col("has_session"), F.col("refusal"))), odd

    @cached_property
    def _judged_calls(self) -> dict[str, tuple[DataFrame, DataFrame]]:
        return {}

    def _call(self, target: str) -> tuple[DataFrame, DataFrame]:
        if target not in self._judged_calls:
            self._judged_calls[target] = self._calls(target)
        return self._judged_calls[target]

    def _kept(self, target: str) -> DataFrame:
        if target not in self.entities:
            return self._nothing(target).withColumn("session_key", F.lit(None).cast("string"))
        return _where(self._call(target)[0], ~F.col("rejected") & F.col("has_session") & F.col("refusal").isNull()).drop("issues", "rejected", "has_session", "refusal")

    @cached_property
    def model_call(self) -> DataFrame:
        return self._kept("model_call")

    @cached_property
    def tool_call(self) -> DataFrame:
        return self._kept("tool_call")

    @cached_property
    def _pass(self) -> DataFrame:
        """Everything about the records in one pass: a row for each record (``lead``; target ``record`` or the one session),
        each of several sessions and each call, with ``kept``, ``issues``, ``orphan`` and the fields in a struct named by target."""
        session = self.entities.get("session")
        several = session is not None and session.iterate is not None
        fields = lambda t: F.struct(*TARGET_FIELDS[t])
        whole = self._whole
        own = [c for c in whole.columns if c != "v"]
        shapes = {t: shape_of(e) for t, e in self.entities.items() if t != "session"}
        prefixes = {t: paths.iterate_path(e.iterate) for t, e in self.entities.items() if t != "session" and e.iterate}
        if prefixes:  # each list is read once, though rows and what is wrong ask for it
            whole = whole.withColumns({f"__list_{t}": paths.listed(F.col("v"), p.groups[0], paths.outer(p, shapes[t].type)) for t, p in prefixes.items()})
        item = _Items(shapes)
        items = [F.array(item.of("record" if several or session is None else "session")(None, F.lit(0)))]
        if several:
            items.append(F.transform("all", lambda x, i: item.of("session")(None, i)))
        for target in (t for t in self.entities if t != "session"):
            entity = self.entities[target]
            if entity.iterate:
                rows, wrong = paths.iterate(F.col("v"), prefixes[target], F.col(f"__list_{target}"), shapes[target].type)
                items.append(F.transform(rows, item.of(target)))
                items.append(item.wrong(target, wrong))
            else:
                items.append(F.array(item.of(target)(shapes[target].read(F.col("v")), F.lit(0))))
        df = whole.select(*own, F.explode(F.concat(*items)).alias("i")).select("*", "i.*").drop("i")
        nothing = F.array().cast(f"array<{ISSUE}>")
        is_session = F.col("target") == "session"
        if several:
            this, first = F.get("all", F.col("source_index")), is_session & (F.col("source_index") == 0)
            n = F.size(F.filter("all", lambda x: ~x["rejected"]))
            refused = F.when(first & ~this["rejected"] & this["refusal"].isNotNull(), F.array(this["refusal"])).otherwise(nothing)
            ignored = F.when(first & (n > 1), F.array_repeat(issue("warning", "MULTIPLE_SESSIONS_IGNORED", None), n)).otherwise(nothing)  # one for each row
            no_list = F.when((F.col("target") == "record") & F.col("all_odd"), F.array(issue("rejected", "ITERATE_NOT_A_LIST", "entities[target=session].iterate"))).otherwise(nothing)
            told = F.concat(F.when(is_session, this["issues"]).otherwise(nothing), refused, ignored, no_list)
            df = df.withColumns({"session_issues": told, "lead": F.col("target") == "record", "kept_session": first & F.col("has_session"), "source_index": F.when(is_session, this["source_index"]).otherwise(F.col("source_index"))})
            df = df.drop("all", "all_odd")
        else:
            issues_of = F.when(is_session, F.col("session_issues")).otherwise(nothing) if session is not None else nothing
            df = df.withColumns({"session_issues": issues_of, "lead": F.col("target") == ("record" if session is None else "session"), "kept_session": is_session & F.col("has_session")})
        if session is not None:  # calls do not carry it along
            df = df.withColumn("session", F.when(is_session, F.col("session")))
        issues, kept, orphan = F.col("session_issues"), F.col("kept_session"), F.lit(False)
        # the calls of all targets take their steps in the same layers; a row of another target is null in them
        calls = {t: e for t, e in self.entities.items() if t != "session"}
        steps = {t: entity_steps(e, F.col(f"row_{t}"), prefixes.get(t), f"{t}_") for t, e in calls.items()}
        carry = [c for c in df.columns if not c.startswith("row_")]
        for together in zip_longest(*[s.layers for s in steps.values()], fillvalue={}):
            if made := {k: c for layer in together for k, c in layer.items()}:
                df = df.withColumns(made)
        mine = {t: (F.col("target") == t) & ~F.col("odd") for t in calls}
        made = {}
        for t, entity in calls.items():
            given = steps[t].fields | _defaults(t, steps[t].fields.__getitem__)
            made |= {f"__mine_{t}": mine[t], f"__rejected_{t}": steps[t].rejected}
            made[f"__refusal_{t}"] = F.when(mine[t] & F.col("has_session"), _refusal(entity, given.__getitem__))
        df = df.withColumns(made) if made else df
        out = []
        for t in calls:
            own, rejected, refusal = F.col(f"__mine_{t}"), F.col(f"__rejected_{t}"), F.col(f"__refusal_{t}")
            given = steps[t].fields | _defaults(t, steps[t].fields.__getitem__)
            given |= _tidy(t, given.__getitem__)
            good = own & ~rejected & F.col("has_session") & refusal.isNull()
            out.append(F.when(good, F.struct(*[given[f].alias(f) for f in TARGET_FIELDS[t]])).alias(t))
            odd = (F.col("target") == t) & F.col("odd")
            no_list = F.array(issue("rejected", "ITERATE_NOT_A_LIST", f"entities[target={t}].iterate"))
            issues = F.when(own, _with_refusal(steps[t].issues, rejected, refusal)).when(odd, no_list).otherwise(issues)  # a row has one target
            orphan, kept = orphan | (own & ~rejected & ~F.col("has_session")), kept | F.coalesce(good, F.lit(False))
        df = df.select(*[c for c in carry if c not in ("session_issues", "kept_session")], *out, issues.alias("issues"), orphan.alias("orphan"), kept.alias("kept"))
        target = F.when(F.col("lead"), "session").otherwise(F.col("target"))  # a record's own issues are about its sessions
        return df.select("line", "session_key", target.alias("target"), "source_index", "lead", *self.entities, "issues", "orphan", "kept")

    @cached_property
    def kept(self) -> DataFrame:
        """The rows of the pass that are entities, from the checkpoint folder: the pass is written once and read from then on.

        A filter on ``kept`` over the pass itself would move below its projections and take all that they compute along,
        and what is generated from that is too large to be compiled.
        """
        self._pass = settled(self._pass)
        return self._pass.filter("kept")

    @cached_property
    def issues(self) -> DataFrame:
        missing = F.when(F.col("orphan"), F.array(issue("rejected", "PARENT_SESSION_MISSING", None))).otherwise(F.array().cast(f"array<{ISSUE}>"))
        told = _where(self._pass.select("line", "target", "source_index", F.concat("issues", missing).alias("told")), F.size("told") > 0)
        found = told.select("line", "target", "source_index", F.explode("told").alias("i")).select("line", "target", "source_index", "i.*")
        # calls without a session are told once a record, everything else row by row
        place = F.when(F.col("code") != "PARENT_SESSION_MISSING", F.col("source_index"))
        return found.groupBy("line", "target", "severity", "code", "field_path", place.alias("at")).agg(F.count("*").alias("rows")).drop("at")


def _compilable(spark: SparkSession) -> None:
    """Let stages whose generated method is larger than the JVM compiles run operator by operator, whose code Spark cuts up.

    A mapping is many projections in a row. As one method they pass Spark's own limit and stay interpreted for good.
    """
    if int(spark.conf.get(METHOD_LIMIT)) > COMPILED_BYTES:
        spark.conf.set(METHOD_LIMIT, COMPILED_BYTES)


def normalise(records: DataFrame, mapping: Mapping) -> Normalised:
    """records: (line, v). The mapping must be valid. Lowers METHOD_LIMIT in the session to what the JVM compiles."""
    if problems := validate(mapping):
        raise ValueError(f"invalid mapping: {problems}")
    _compilable(records.sparkSession)
    return Normalised(records, mapping)


def reference_requests(n: Normalised) -> DataFrame:
    """Distinct names that the facts refer to: (kind, name, provider_name). One pass over the records."""
    own = lambda target, field: F.when(F.col("kept") & (F.col("target") == target), F.col(f"{target}.{field}"))
    asked = [(target, *a) for target, a in ASKS if target in n.entities]
    if not asked:
        return n.records.sparkSession.createDataFrame([], "kind string, name string, provider_name string")
    names = [F.struct(F.lit(kind).alias("kind"), own(target, field).alias("name"), (own(target, context) if context else F.lit(None).cast("string")).alias("provider_name")) for target, kind, field, context in asked]
    return n._pass.select(F.inline(F.array(*names))).filter("name IS NOT NULL").distinct()


def report(records: DataFrame, n: Normalised, imported: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """One row: records read, imported, duplicate and rejected (distinct lines), status."""
    lines = F.count_distinct("line")
    columns = ("records_read", "records_imported", "records_duplicate", "records_rejected")
    if imported is None and duplicates is None:
        bad = F.col("orphan") | F.exists("issues", lambda i: i["severity"] == "rejected")
        out = n._pass.agg(
            F.count_if("lead").alias(columns[0]), F.count_if(F.col("kept") & (F.col("target") == "session")).alias(columns[1]), F.lit(0).cast("long").alias(columns[2]),
            F.count_distinct(F.when(bad, F.col("line"))).alias(columns[3]),
        )
    else:
        named = lambda df, what, name: df.agg(what.alias("n")).select(F.lit(name).alias("name"), "n")
        counts = named(records, F.count("*"), "records_read")
        counts = counts.unionByName(named(n.issues.filter("severity = 'rejected'"), lines, "records_rejected"))
        counts = counts.unionByName(named(imported if imported is not None else n.session, lines, "records_imported"))
        if duplicates is not None:
            counts = counts.unionByName(named(duplicates, lines, "records_duplicate"))
        out = counts.agg(*[F.coalesce(F.sum(F.when(F.col("name") == c, F.col("n"))), F.lit(0)).alias(c) for c in columns])
    return out.withColumn("status", F.when(F.col("records_rejected") > 0, "partial").otherwise("succeeded"))


def fields_missing(n: Normalised) -> DataFrame:
    """(field, n): how often each field of an imported entity is unknown."""
    pairs = lambda target, at: F.array(*[F.struct(F.lit(f"{target}.{f}").alias("field"), at(f).alias("n")) for f in TARGET_FIELDS[target]])
    none = lambda t, f: F.count_if(F.col("kept") & (F.col("target") == t) & F.col(t)[f].isNull()).alias(f"{t}_{f}")
    counts = n._pass.agg(*[none(t, f) for t in n.entities for f in TARGET_FIELDS[t]])
    parts = counts.select(F.inline(F.concat(*[pairs(t, lambda f, t=t: F.col(f"{t}_{f}")) for t in n.entities])))
    return parts.filter("n > 0")


def preview_rejected(records: DataFrame, mapping: Mapping, limit: int = 20) -> DataFrame:
    """(line, codes) of the first records that a load would turn away, whole or in part."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1 to 500")
    n = normalise(records.orderBy("line").limit(limit), mapping)
    return n.issues.filter("severity = 'rejected'").groupBy("line").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def preview(records: DataFrame, mapping: Mapping, limit: int = 20, shown: int = 5) -> tuple[DataFrame, DataFrame]:
    """(counts by entity, first rows of each entity as JSON) of the first records; nothing is written."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1 to 500")
    n = normalise(records.orderBy("line").limit(limit), mapping)
    shown_as = F.coalesce(*[F.when(F.col("target") == t, F.to_json(t)) for t in n.entities])
    rows = n.kept.select("target", "line", "source_index", shown_as.alias("row"))
    counts = rows.groupBy("target").agg(F.count("*").alias("n"))
    first = Window.partitionBy("target").orderBy("line", "source_index")
    return counts, rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= shown).drop("rank")
