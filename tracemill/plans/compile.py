"""Mapping documents compiled to column expressions: one projection over the records, no shuffle.

Records are (line, v): the line number and the record as a variant. An entity becomes rows of
(line, source_index, data columns, issues, rejected); ``issues`` explains every field that failed.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import paths, values
from tracemill.functions.values import Value
from tracemill.plans.mapping import Entity
from tracemill.schema import TARGET_FIELDS

ISSUE = "struct<severity:string,code:string,field_path:string>"


def issue(severity: str | Column, code: str | Column, field_path: str | None) -> Column:
    own = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(own(severity).alias("severity"), own(code).alias("code"), F.lit(field_path).cast("string").alias("field_path"))


def collected(*pairs: tuple[Column, Column]) -> Column:
    """The issues whose condition holds, in order. Most rows have none, for which no list is made."""
    none = F.array().cast(f"array<{ISSUE}>")
    if not pairs:
        return none
    made = F.filter(F.array(*[F.when(when, what) for when, what in pairs]), lambda x: x.isNotNull())
    return F.when(reduce(lambda a, b: a | b, [F.coalesce(when, F.lit(False)) for when, _ in pairs]), made).otherwise(none)


def apply_operator(op: dict, value: Value, lookup) -> Value:
    name = op["op"]
    if name == "cast":
        return values.cast(value, op["to"], op.get("on_error", "reject"))
    if name == "default":
        return values.default(value, op["value"])
    if name in ("trim", "lower", "upper"):
        return getattr(values, name)(value)
    if name == "unit_convert":
        return values.unit_convert(value, op["from"], op["to"])
    if name == "map_values":
        return values.map_values(value, op["table"], op["on_unknown"], op.get("constant"))
    if name == "json_passthrough":
        return value
    if name == "parse_datetime":
        return values.parse_datetime(value, op["format"])
    if name == "regex_extract":
        return values.regex_extract(value, op["pattern"], op.get("group", 0))
    if name == "coalesce":
        made = values.first_of([lookup(s) for s in op["sources"]])
    elif name == "concat":
        made = values.concat([lookup(s) for s in op["sources"]], op.get("separator", ""))
    elif name == "hash":
        made = values.sha256_of({s: lookup(s) for s in op["sources"]})
    else:
        raise ValueError(f"unknown operator {name!r}")
    return Value(made.kind, made.column, value.error)


def _sql_type(kind: str) -> str:
    return "bigint" if kind == "long" else kind


def _sources(entity: Entity) -> list[str]:
    """Every path that the entity reads."""
    found = [f.source for f in entity.fields]
    found += [s for f in entity.fields for op in f.operators for s in op.get("sources", ())]
    return list(dict.fromkeys(found))


def shape_of(entity: Entity) -> paths.Shape:
    """The type under which a row of the entity is read: all that its fields ask for, and nothing else."""
    prefix = paths.iterate_path(entity.iterate) if entity.iterate else None
    return paths.shape(paths.strip_prefix(p, prefix).groups[0] for p in _sources(entity))


class Steps(NamedTuple):
    """What a row of an entity takes: columns made one layer after the other, and from the last of them the fields, the
    issues and whether the row is rejected."""

    layers: list[dict[str, Column]]
    fields: dict[str, Column]
    issues: Column
    rejected: Column


def entity_steps(entity: Entity, row: Column, prefix: paths.Path | None, tag: str = "") -> Steps:
    """row: under the entity's shape. The names of all columns made hold the tag, so that entities can share layers.

    Types of the sources, what is asked of them, each round of operators and the type gate are layers of their own,
    so no value is computed twice however often the next layer refers to it.
    """
    sources = {p: i for i, p in enumerate(_sources(entity))}
    own = shape_of(entity)
    views = {i: values.Asked(f"{tag}{i}", *own.at(row, paths.strip_prefix(p, prefix).groups[0])) for p, i in sources.items()}
    rounds: list[dict[str, Column]] = []

    def lookup(path: str) -> Value:
        own = views[sources[path]]
        return Value("variant", paths.resolve(own.row, own.names), held=own)

    states = [lookup(f.source) for f in entity.fields]
    eithers: list[tuple[dict[str, Column], values.Either]] = []
    for depth in range(max((len(f.operators) for f in entity.fields), default=0)):
        made = {}
        for i, f in enumerate(entity.fields):
            if depth < len(f.operators):
                v = apply_operator(f.operators[depth], states[i], lookup)
                made[f"__v{tag}{i}_{depth}"] = v.column
                if v.error is not None:
                    made[f"__e{tag}{i}_{depth}"] = v.error
                held = None
                if v.either is not None:
                    held = values.Either(f"{tag}{i}_{depth}", *v.either)
                    eithers.append((made, held))
                states[i] = Value(v.kind, F.col(f"__v{tag}{i}_{depth}"), F.col(f"__e{tag}{i}_{depth}") if v.error is not None else None, held)
        rounds.append(made)
    fitted, held = {}, [v.there for v in states]
    for i, f in enumerate(entity.fields):
        v, mismatch = values.gate(states[i], TARGET_FIELDS[entity.target][f.target])
        fitted[f"__g{tag}{i}"] = v.column.cast(_sql_type(TARGET_FIELDS[entity.target][f.target]))
        fitted[f"__m{tag}{i}"] = F.coalesce(mismatch, F.lit(False))
    # only now is it known which views are asked for; those of later rounds ask for those of earlier ones
    for made, own in reversed(eithers):
        made.update(own.made())
    typed = {f"__type{v.number}": v.known_type() for v in views.values() if v.used}
    made = {k: c for v in views.values() for k, c in v.made().items()}
    out = {name: F.lit(None).cast(_sql_type(kind)) for name, kind in TARGET_FIELDS[entity.target].items()}
    issues, rejected = [], F.lit(False)
    for i, f in enumerate(entity.fields):
        out[f.target] = F.col(f"__g{tag}{i}")
        here = f"entities[target={entity.target}].fields[target={f.target}]"
        error, mismatch = states[i].error, F.col(f"__m{tag}{i}")
        failed = error.isNotNull() if error is not None else F.lit(False)
        if error is not None:
            issues.append((failed, issue("rejected" if f.required else "warning", error, here)))
        issues.append((mismatch, issue("rejected", "TYPE_MISMATCH", here)))
        rejected = rejected | mismatch
        if f.required:
            absent = ~held[i]
            issues.append((absent & ~failed, issue("rejected", "MISSING_REQUIRED_FIELD", here)))
            rejected = rejected | absent
    return Steps([typed, made, *rounds, fitted], out, collected(*issues), rejected)


def entity_frame(rows: DataFrame, entity: Entity, row: str, prefix: paths.Path | None, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns with all data fields of the entity, issues and rejected. row: a column under the entity's shape."""
    steps, df = entity_steps(entity, F.col(row), prefix), rows
    for made in filter(None, steps.layers):
        df = df.withColumns(made)
    return df.select(*keep, *[c.alias(k) for k, c in steps.fields.items()], steps.issues.alias("issues"), steps.rejected.alias("rejected"))


def entity_rows(records: DataFrame, entity: Entity, carry: tuple[str, ...] = ("line",)) -> tuple[DataFrame, DataFrame]:
    """(rows of the entity, records whose iterate path holds no list): both carry the named columns."""
    own = shape_of(entity)
    if entity.iterate is None:
        rows = records.withColumns({"source_index": F.lit(0), "__row": own.read(F.col("v"))})
        return entity_frame(rows, entity, "__row", None, (*carry, "source_index")), records.select(*carry).limit(0)
    prefix = paths.iterate_path(entity.iterate)
    rows, wrong = paths.iterate(F.col("v"), prefix, element=own.type)
    opened = records.select(*carry, F.posexplode(rows).alias("source_index", "__row"))
    return entity_frame(opened, entity, "__row", prefix, (*carry, "source_index")), records.filter(wrong).select(*carry)
