"""The thirteen value operators of the mapping language as column expressions.

A value is typed as far as the plan knows: ``variant`` (what the record holds) or a plain type. Every operator
returns a value and, row by row, an error code instead of raising. Rendering to text follows the reference
language: booleans are ``True`` and ``False``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions import paths

#: White space that trim removes.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
_BLANK = r"^[\s\x{85}\x{A0}]*$"

# Unit factors; results in ms and bytes are whole numbers.
UNITS = {("s", "ms"): 1e3, ("min", "ms"): 6e4, ("ns", "ms"): 1e-6, ("ms", "s"): 1e-3, ("kb", "b"): 1024.0, ("mb", "b"): 1048576.0}
WHOLE_UNITS = ("ms", "b")
# Strptime directives and the pattern letters that read the same text.
STRPTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "z": "xx", "Z": "z", "b": "MMM", "B": "MMMM", "j": "DDD", "y": "yy", "a": "E", "A": "EEEE", "%": "%"}


NUMBERS = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT")
#: What a variant may hold, known by its place from 1: numbers are cheaper to compare than names. Other types are 0.
KINDS = (*NUMBERS, "STRING", "BOOLEAN", "OBJECT", "ARRAY")
# What follows the name of a type that tells more.
_OPENED = {"DECIMAL": "(", "OBJECT": "<", "ARRAY": "<"}


@dataclass(frozen=True)
class Views:
    """What is asked of a variant again and again, best held in columns of their own."""

    type: Column  # the place in KINDS
    string: Column  # of what is no object or list
    word: Column  # of strings and booleans only
    double: Column  # of numbers
    fraction: Column  # of numbers that are no whole ones by type
    long: Column  # of whole numbers


VIEWS = tuple(Views.__dataclass_fields__)
#: What each view is read as, and where.
READ_AS = {"word": ("string", ("STRING", "BOOLEAN")), "double": ("double", NUMBERS), "fraction": ("double", NUMBERS[4:]), "long": ("long", NUMBERS[:4])}


def type_of(v: Column) -> Column:
    """The place of the type in KINDS, whatever is in it; null of null and of JSON null."""
    name = F.schema_of_variant(v)
    out = F.when(name.isNull() | (name == "VOID"), F.lit(None).cast("int"))
    for kind in ("STRING", "BIGINT", "DOUBLE", *[k for k in KINDS if k not in ("STRING", "BIGINT", "DOUBLE")]):  # most frequent first
        out = out.when(name.startswith(f"{kind}{_OPENED[kind]}") if kind in _OPENED else name == kind, KINDS.index(kind) + 1)
    return out.otherwise(0)


def _among(kind: Column, *names: str) -> Column:
    return kind.isin(*[KINDS.index(n) + 1 for n in names])


def views_of(v: Column, kind: Column | None = None, path: str = "$") -> Views:
    """The views of what is at the path; ``kind`` is a column that holds its type already. Numbers are only read where numbers are held."""
    own = type_of(v) if kind is None else kind
    plain = F.when(~_among(own, "OBJECT", "ARRAY"), F.try_variant_get(v, path, "string"))
    return Views(type=own, string=plain, **{k: F.when(_among(own, *names), F.try_variant_get(v, path, to)) for k, (to, names) in READ_AS.items()})


class Held(Views):
    """Views in columns of their own, of which only those asked for need be made: names them in ``used``."""

    def __init__(self, number: str, **more):
        for k, v in {"number": number, "used": set(), **more}.items():
            object.__setattr__(self, k, v)

    def __getattribute__(self, name: str):
        if name in VIEWS:
            self.used.update((name, "type"))
            return F.col(f"__{name}{self.number}")
        return object.__getattribute__(self, name)


class Asked(Held):
    """Views of what is at names in a row. They are read from the row: a variant of each value would carry all names of
    its record along."""

    def __init__(self, number: str, row: Column, names: tuple[str, ...]):
        super().__init__(number, row=row, names=names)

    def known_type(self) -> Column:
        """The type column: null where the value is absent or JSON null."""
        return type_of(paths.at(self.row, self.names))

    def made(self) -> dict[str, Column]:
        """The columns asked for but the type, which they need."""
        own = vars(views_of(self.row, F.col(f"__type{self.number}"), paths._variant_path(self.names)))
        return {f"__{k}{self.number}": c for k, c in own.items() if k in self.used and k != "type"}


class Either(Held):
    """Views of one of two values, the first where ``first`` holds: no variant of it is made and none is read again."""

    def __init__(self, number: str, first: Column, values: tuple[Value, Value]):
        super().__init__(number, first=first, values=values)

    def made(self) -> dict[str, Column]:
        """The columns asked for, from the views of the two values."""
        own = [v.views if v.kind == "variant" else typed_views(v) for v in self.values]
        return {f"__{k}{self.number}": F.when(self.first, getattr(own[0], k)).otherwise(getattr(own[1], k)) for k in VIEWS if k in self.used}


@dataclass(frozen=True)
class Value:
    kind: str  # variant, string, long, double, boolean, timestamp
    column: Column
    error: Column | None = None  # code of the first failure, null if none
    held: Views | None = None  # of a variant
    either: tuple[Column, tuple[Value, Value]] | None = None  # a variant that is the first of two values where a condition holds, else the second

    @property
    def views(self) -> Views:
        return self.held or views_of(self.column)

    @property
    def there(self) -> Column:
        """Whether there is a value."""
        return self.column.isNotNull() if self.held is None else self.held.type.isNotNull()

    def failed(self, when: Column, code: str) -> Value:
        """With a code where ``when`` holds, of a value that is null there; null where an earlier step has failed."""
        own = F.when(when, F.lit(code))
        if self.error is None:
            return replace(self, error=own, held=None, either=None)
        return replace(self, error=F.coalesce(self.error, own), column=F.when(self.error.isNull(), self.column), held=None, either=None)

    def then(self, kind: str, column: Column) -> Value:
        return Value(kind, column, self.error)


#: Kinds of plain values and the place that a variant of them has in KINDS.
_PLACES = {kind: KINDS.index(name) + 1 for kind, name in {"string": "STRING", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}.items()}


def typed_views(value: Value) -> Views:
    """The views that a variant of a plain value would have."""
    c = value.column
    of = lambda to, *kinds: c.cast(to) if value.kind in kinds else F.lit(None).cast(to)
    return Views(type=F.when(c.isNotNull(), F.lit(_PLACES[value.kind])), string=c.cast("string"), word=of("string", "string", "boolean"), double=of("double", "long", "double"), fraction=of("double", "double"), long=of("long", "long"))


def _is(views: Views, *names: str) -> Column:
    return F.coalesce(_among(views.type, *names), F.lit(False))


def text(value: Value) -> Column:
    """The value as text, null for null."""
    c = value.column
    if value.kind == "string":
        return c
    if value.kind == "boolean":
        return F.initcap(c.cast("string"))
    if value.kind == "variant":
        v = value.views
        return F.when(_is(v, "BOOLEAN"), F.initcap(v.string)).when(_is(v, "OBJECT", "ARRAY"), F.to_json(c)).otherwise(v.string)
    return c.cast("string")


def is_blank(value: Value) -> Column:
    """Whether the value is a string of white space only."""
    if value.kind == "string":
        return value.column.rlike(_BLANK)
    if value.kind == "variant":
        return _is(value.views, "STRING") & F.coalesce(value.views.word.rlike(_BLANK), F.lit(False))
    return F.lit(False)


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def _of_boolean(v: Views) -> Column:
    return F.when(_is(v, "BOOLEAN"), (v.word == "true").cast("double"))


def _number(value: Value) -> Column:
    """As double: numbers, booleans and numeric strings."""
    if value.kind == "variant":
        v = value.views
        return F.when(_is(v, *NUMBERS), v.double).when(_is(v, "STRING"), _trimmed(v.word).try_cast("double")).otherwise(_of_boolean(v))
    if value.kind == "string":
        return _trimmed(value.column).try_cast("double")
    if value.kind == "timestamp":
        return F.lit(None).cast("double")
    return value.column.cast("double")


def cast(value: Value, to: str, on_error: str = "reject") -> Value:
    """Blank strings are unknown for every target."""
    if to == "string":
        return value.then("string", F.when(~is_blank(value), text(value)))
    v, there = value, value.there & ~is_blank(value)
    if to == "integer":
        whole = lambda spelt: F.when(spelt.rlike(r"^[+-]?[0-9]+$"), spelt.try_cast("long"))
        cut = lambda number: F.when(F.abs(number) < 9.3e18, number.cast("long"))  # noqa: E731  # toward zero
        if v.kind == "variant":  # no value is read but as its own type
            own = v.views
            out = F.when(_is(own, "STRING"), whole(_trimmed(own.word))).when(_is(own, *NUMBERS[:4]), own.long)
            out = out.when(_is(own, *NUMBERS[4:]), cut(own.fraction)).otherwise(cut(_of_boolean(own)))
        else:
            out = whole(_trimmed(v.column)) if v.kind == "string" else v.column if v.kind == "long" else cut(_number(v))
        made = v.then("long", out)
    elif to == "float":
        made = v.then("double", _number(v))
    elif to == "boolean":
        word = F.lower(_trimmed(text(v)))
        made = v.then("boolean", F.when(word.isin("true", "1", "yes"), True).when(word.isin("false", "0", "no"), False))
    else:
        raise ValueError(f"unknown cast target {to!r}")
    if on_error == "null":
        return made
    return made.failed(there & made.column.isNull(), "CAST_FAILED")


def java_pattern(fmt: str) -> str:
    """A strptime pattern as a datetime pattern."""
    out, literal = [], ""

    def flush() -> None:
        nonlocal literal
        if literal:
            out.append("'" + literal.replace("'", "''") + "'" if re.search("[A-Za-z]", literal) else literal.replace("'", "''"))
            literal = ""

    parts = iter(re.findall(r"%.|[^%]", fmt, re.S))
    for p in parts:
        if p[0] == "%" and len(p) == 2:
            if p[1] not in STRPTIME:
                raise ValueError(f"unsupported directive {p}")
            if p == "%%":
                literal += "%"
                continue
            flush()
            out.append(STRPTIME[p[1]])
        else:
            literal += p
    flush()
    return "".join(out)


def parse_datetime(value: Value, fmt: str) -> Value:
    """A UTC timestamp; times without zone are UTC."""
    if fmt in ("unix_seconds", "unix_millis"):
        seconds = _number(value) / (1000 if fmt == "unix_millis" else 1)
        out = F.when(F.abs(seconds) < 2.5e11, F.timestamp_seconds(seconds))
    elif fmt == "iso8601":
        spelt = text(value)
        out = F.when(spelt.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?)?\s?(Z|[+-]\d{2}(:?\d{2})?)?$"), F.try_to_timestamp(spelt))
    else:
        out = F.try_to_timestamp(text(value), F.lit(java_pattern(fmt)))
    return value.then("timestamp", out).failed(value.there & out.isNull(), "DATETIME_PARSE_FAILED")


def literal(v: object) -> Value:
    if v is None:
        return Value("string", F.lit(None).cast("string"))
    if isinstance(v, bool):
        return Value("boolean", F.lit(v))
    if isinstance(v, int):
        return Value("long", F.lit(v).cast("long"))
    if isinstance(v, float):
        return Value("double", F.lit(v))
    return Value("string", F.lit(str(v)))


def variant(value: Value) -> Column:
    """The value as a variant, for lists of values of several types."""
    return value.column if value.kind == "variant" else value.column.cast("variant")


def _joined(first: Value, second: Value, when: Column | None = None) -> Value:
    """The first of two values where the condition holds (where there is one, if none is given), else the second; typed
    if both are of one type."""
    own = first.there if when is None else when
    if first.kind == second.kind != "variant":
        return first.then(first.kind, F.when(own, first.column).otherwise(second.column))
    made = first.then("variant", F.when(own, variant(first)).otherwise(variant(second)))
    return replace(made, either=(own, (first, second))) if {first.kind, second.kind} <= {"variant", *_PLACES} else made


def default(value: Value, v: object) -> Value:
    return _joined(value, literal(v))


def trim(value: Value) -> Value:
    return value.then("string", _trimmed(text(value)))


def lower(value: Value) -> Value:
    return value.then("string", F.lower(text(value)))


def upper(value: Value) -> Value:
    return value.then("string", F.upper(text(value)))


def unit_convert(value: Value, source: str, to: str) -> Value:
    """Whole target units are rounded half to even; what is no number fails."""
    factor = UNITS.get((source.lower(), to.lower()))
    if factor is None:
        raise ValueError(f"unknown conversion {source!r} to {to!r}")
    number = _number(value) * factor
    whole = to.lower() in WHOLE_UNITS
    sane = F.when(F.abs(number) < 9.2e18, F.rint(number).cast("long")) if whole else number
    return value.then("long" if whole else "double", sane).failed(value.there & sane.isNull(), "OPERATOR_FAILED")


def map_values(value: Value, table: dict[str, object], on_unknown: str, constant: object = None) -> Value:
    """Null is looked up as 'null', booleans as 'True' and 'False'; a table value may be null."""
    key = F.coalesce(text(value), F.lit("null"))
    targets = [literal(v) for v in table.values()]
    kinds = {t.kind for v, t in zip(table.values(), targets, strict=True) if v is not None} or {"string"}
    kind = kinds.pop() if len(kinds) == 1 else "variant"
    as_kind = lambda t: variant(t) if kind == "variant" else t.column.cast(kind)
    mapped = F.lit(None).cast(kind)
    if table:
        mapped = F.element_at(F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*map(as_kind, targets))), key)
    known = key.isin(*table) if table else F.lit(False)
    hit = Value(kind, mapped, value.error)
    if on_unknown == "null":
        return hit
    if on_unknown == "reject":
        return hit.failed(~known, "OPERATOR_FAILED")
    other = literal(constant) if on_unknown == "constant" else value
    return replace(_joined(hit, other, known), error=value.error)


def first_of(sources: list[Value]) -> Value:
    """The first known value."""
    out = sources[0]
    for s in sources[1:]:
        out = _joined(out, s)
    return out


def concat(sources: list[Value], separator: str = "") -> Value:
    """Known values in a row; null if none is known."""
    parts = [text(s) for s in sources]
    return Value("string", F.when(F.coalesce(*parts).isNotNull(), F.concat_ws(separator, *parts)))


def json_text(value: Value) -> Column:
    """The value as JSON; null is ``null``, objects and lists with a space after ``,`` and ``:``."""
    c = value.column
    if value.kind in ("long", "double"):
        own = c.cast("string")
    elif value.kind == "boolean":
        own = c.cast("string")
    elif value.kind == "variant":
        own = F.when(_is(value.views, "OBJECT", "ARRAY"), spaced_json(F.to_json(c))).otherwise(F.to_json(c))
    else:
        own = F.concat(F.lit('"'), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.coalesce(own, F.lit("null"))


def spaced_json(c: Column) -> Column:
    """Compact JSON with a space after each separator outside strings."""
    return F.regexp_replace(c, r'\G((?:"(?:[^"\\]|\\.)*+"|[^,:"]++)*+)([,:])', "$1$2 ")


def sha256_of(sources: dict[str, Value]) -> Value:
    """SHA-256 of the canonical JSON of the sources by path; null if none is known."""
    parts: list[Column] = []
    for i, path in enumerate(sorted(sources)):
        head = ("{" if i == 0 else ", ") + '"' + path.replace("\\", "\\\\").replace('"', '\\"') + '": '
        parts += [F.lit(head), json_text(sources[path])]
    whole = F.concat(*parts, F.lit("}"))
    known = F.coalesce(*[text(s) for s in sources.values()]).isNotNull()
    return Value("string", F.when(known, F.sha2(whole.cast("binary"), 256)))


@F.pandas_udf(T.StringType())
def _first_group(values: pd.Series, pattern: pd.Series) -> pd.Series:
    """The group named g of the first match, by a linear-time engine."""
    if not len(values):
        return values
    found = pc.extract_regex(pa.array(values, pa.string()), pattern.iloc[0])
    return found.field("g").to_pandas().where(pc.is_valid(found).to_pandas(), None) if len(found) else values


#: The head of a group that captures.
_GROUP = re.compile(r"\((?:\?P<\w+>|(?!\?))")


def named_group(pattern: str, group: int) -> str:
    """The pattern with the wanted group named g and no other group captured; named groups count as the others do."""
    seen, out, at, in_class = 0, [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            first = re.compile(r"\[\^?\]?").match(pattern, at)[0]  # a bracket that comes first is a member
            out.append(first.replace("]", r"\]"))
            at += len(first)
            continue
        elif c == "(" and (head := _GROUP.match(pattern, at)):
            seen += 1
            out.append("(?P<g>" if seen == group else "(?:")
            at = head.end()
            continue
        out.append(c)
        at += 1
    return "".join(out) if group else f"(?P<g>{''.join(out)})"


def regex_extract(value: Value, pattern: str, group: int = 0) -> Value:
    """First match, null if there is none. User patterns run in a linear-time engine, in Arrow batches."""
    return value.then("string", _first_group(text(value), F.lit(named_group(pattern, group))))


def gate(value: Value, target: str | None) -> tuple[Value, Column]:
    """(the value in the target's type, whether it does not fit).

    Only numbers on text fields and finite fractions on whole fields are narrowed (half to even).
    """
    c, none = value.column, F.lit(None)
    if target is None or value.kind == target:
        return value, F.lit(False)
    if target == "string":
        if value.kind in ("long", "double"):
            return value.then("string", c.cast("string")), F.lit(False)
        if value.kind == "variant":
            fits = _is(value.views, "STRING", *NUMBERS)
            return value.then("string", F.when(fits, value.views.string)), value.there & ~fits
    elif target == "long":
        if value.kind == "double":
            fits = F.abs(c) < 9.2e18
            return value.then("long", F.when(fits, F.rint(c).cast("long"))), c.isNotNull() & ~F.coalesce(fits, F.lit(False))
        if value.kind == "variant":
            v = value.views
            whole = _is(v, *NUMBERS[:4])
            fraction = _is(v, *NUMBERS[4:]) & F.coalesce(F.abs(v.fraction) < 9.2e18, F.lit(False))
            return value.then("long", F.when(whole, v.long).when(fraction, F.rint(v.fraction).cast("long"))), value.there & ~(whole | fraction)
    return value.then(target, none.cast(target)), value.there
