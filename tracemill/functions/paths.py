"""Paths into semi-structured records: ``$``, ``.name``, ``["name"]`` and ``[]`` for every list element."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r'\.(?P<plain>[A-Za-z_][A-Za-z0-9_]*)|(?P<each>\[\])|\["(?P<quoted>(?:[^"\\]|\\["\\])*)"\]')
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


class UnsupportedPath(ValueError):
    """A path outside the grammar: filters, wildcards, indexes, '..' and single quotes are refused."""


@dataclass(frozen=True)
class Path:
    """Names split at each ``[]``: ``$.a[].b`` has groups (("a",), ("b",))."""

    groups: tuple[tuple[str, ...], ...]

    @property
    def iterates(self) -> bool:
        return len(self.groups) > 1


def parse(path: str) -> Path:
    if not path.startswith("$"):
        raise UnsupportedPath(f"{path!r}: a path starts with '$'")
    groups: list[list[str]] = [[]]
    at = 1
    while at < len(path):
        step = _STEP.match(path, at)
        if step is None:
            raise UnsupportedPath(f"{path!r}: unsupported at position {at}")
        if step["each"]:
            groups.append([])
        else:
            groups[-1].append(step["plain"] or re.sub(r"\\(.)", r"\1", step["quoted"] or ""))
        at = step.end()
    return Path(tuple(map(tuple, groups)))


def iterate_path(path: str) -> Path:
    """The path of a list of rows; a trailing ``[]`` may be left out."""
    own = parse(path)
    return own if own.iterates and not own.groups[-1] else Path((*own.groups, ()))


def strip_prefix(path: str, prefix: Path | None) -> Path:
    """A source path relative to the row; it may repeat the iterate path that leads to the row."""
    own = parse(path)
    if own.iterates:
        head = own.groups[: len(prefix.groups)] if prefix else ()
        if prefix and len(own.groups) == len(prefix.groups) and head[:-1] == prefix.groups[:-1]:
            return Path((own.groups[-1],))
        raise UnsupportedPath(f"{path!r}: only the iterate path of the entity may hold '[]'")
    return own


def quote(name: str) -> str:
    """One step as text: ``.name`` or ``["name"]``."""
    return f".{name}" if _PLAIN.match(name) else '["' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def _variant_path(names: tuple[str, ...]) -> str:
    if any("'" in n or '"' in n or "]" in n for n in names):
        raise UnsupportedPath(f"{names!r}: a name holds quotes or brackets")
    return "$" + "".join(f".{n}" if _PLAIN.match(n) else f'["{n}"]' for n in names)


def at(row: Column, names: tuple[str, ...]) -> Column:
    """The variant at a path, JSON null included; null where a step is absent or no object."""
    return F.try_variant_get(row, _variant_path(names), "variant") if names else row


def known(value: Column) -> Column:
    """The variant, null for JSON null."""
    return F.when(~F.is_variant_null(value), value)


def resolve(row: Column, names: tuple[str, ...]) -> Column:
    """The variant at a path; absent, JSON null and steps into non-objects are all null."""
    return known(at(row, names))


@dataclass(frozen=True)
class Shape:
    """The paths that are asked of a row, as a type under which one walk over the row reads them all.

    Each get of its own would look through the names of the row again. A path that others go on from is a variant, and
    so is an object with names that differ by case only, which no struct tells apart; what is asked within is read from it.
    """

    inner: dict[str, Shape] | None  # None: a variant

    @property
    def type(self) -> str:
        return "variant" if self.inner is None else "struct<" + ",".join(f"`{n.replace('`', '``')}`:{s.type}" for n, s in self.inner.items()) + ">"

    def read(self, variant: Column) -> Column:
        """A variant under the type: null where it is no object."""
        return variant if self.inner is None else F.try_variant_get(variant, "$", self.type)

    def at(self, row: Column, names: tuple[str, ...]) -> tuple[Column, tuple[str, ...]]:
        """(the variant on the way to names in a row of the type, the names that go on from there)."""
        return (row, names) if self.inner is None else self.inner[names[0]].at(row.getField(names[0]), names[1:])


def shape(asked: Iterable[tuple[str, ...]]) -> Shape:
    asked = list(dict.fromkeys(asked))
    for names in asked:
        _variant_path(names)  # refuses names outside the grammar
    heads = list(dict.fromkeys(names[0] for names in asked if names))
    if not heads or () in asked or len({h.lower() for h in heads}) < len(heads):
        return Shape(None)
    return Shape({h: shape(names[1:] for names in asked if names[0] == h) for h in heads})


def listed(row: Column, names: tuple[str, ...], element: str = "variant") -> Column:
    """The list at a path, null if there is none; elements that do not fit their type are null."""
    # only a list can be read as one, whatever it holds; to ask for its schema would walk all its elements
    return F.try_variant_get(row, _variant_path(names), f"array<{element}>")


def _elements(row: Column, names: tuple[str, ...], found: Column | None = None, element: str = "variant") -> tuple[Column, Column]:
    """(the list at names, empty if there is none; whether something else stands there). found: listed(row, names, element)."""
    found = listed(row, names, element) if found is None else found
    wrong = resolve(row, names).isNotNull()
    # a step into something that is no object is a wrong type as well
    for i in range(1, len(names)):
        inner = resolve(row, names[:i])
        wrong = wrong | (inner.isNotNull() & ~F.schema_of_variant(inner).startswith("OBJECT"))
    # where there is a list, nothing wrong stands on the way to it
    return F.coalesce(found, F.array().cast(f"array<{element}>")), F.when(found.isNull(), wrong).otherwise(False)


def outer(path: Path, element: str) -> str:
    """The type of what the first list of an iterate path holds, if the last one holds elements of the given type."""
    return element if len(path.groups) == 2 else "variant"


def iterate(row: Column, path: Path, found: Column | None = None, element: str = "variant") -> tuple[Column, Column]:
    """(all rows at the path in order, as elements of the given type; whether a wrong type stood where a list should be).

    found: a column that holds listed() of the path's first part already, under the type of outer().
    """
    rows, wrong = _elements(row, path.groups[0], found, outer(path, element))
    inner = path.groups[1:-1]
    for i, names in enumerate(inner, 1):
        found, odd = _inside(names, element if i == len(inner) else "variant")
        wrong = wrong | F.exists(rows, odd)
        rows = F.flatten(F.transform(rows, found))
    return rows, wrong


def _inside(names: tuple[str, ...], element: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    return (lambda r: _elements(r, names, element=element)[0]), (lambda r: _elements(r, names)[1])
