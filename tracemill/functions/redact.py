"""Redaction of secrets and personal marks in text, and bounding of its length.

Ordered rules of fixed, bounded patterns. As columns they run inside the JVM; strings within JSON, which have no
columns of their own, go through Arrow's linear-time engine, all strings of a batch at once. Both take time linear
in the text: the only unbounded rule, from a key's header to its end, is tried only as far as the last end.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marker and limits.
MARKER = "…[truncated]"
MAX_LENGTH, MAX_DEPTH, MAX_ITEMS, MAX_RECORDS = 200, 20, 20, 50

# The rules in their order, as (pattern, replacement).
RULES = (
    (r"(?s)-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----.*?-----END [A-Z ]{0,32}PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"([a-zA-Z][a-zA-Z0-9+.\-]{1,20}://)([^:@/\s]{1,64}):[^@/\s]{1,128}@", "$1$2:[REDACTED_PASSWORD]@"),
    (r"((?i:api[_-]?key|secret[a-z_]{0,12}|passwo?rd|passwd|pwd|access[_-]?key|auth[_-]?token|token))(\s{0,4}[=:]\s{0,4})[\"']?[^\s\"',;]{8,512}", "$1$2[REDACTED_SECRET]"),
    (r"eyJ[A-Za-z0-9_-]{10,512}\.[A-Za-z0-9_-]{10,512}\.[A-Za-z0-9_-]{10,512}", "[REDACTED_JWT]"),
    (r"sk-[A-Za-z0-9_-]{8,256}", "[REDACTED_API_KEY]"),
    (r"gh[pousr]_[A-Za-z0-9]{16,256}", "[REDACTED_TOKEN]"),
    (r"github_pat_[A-Za-z0-9_]{20,256}", "[REDACTED_TOKEN]"),
    (r"(?:AKIA|ASIA)[A-Z0-9]{16}", "[REDACTED_AWS_KEY]"),
    (r"AIza[A-Za-z0-9_-]{35}", "[REDACTED_API_KEY]"),
    (r"xox[abprs]-[A-Za-z0-9-]{10,256}", "[REDACTED_TOKEN]"),
    (r"(?i:bearer)\s{1,4}(?=[A-Za-z0-9._-]{24}|[A-Za-z._-]{0,512}[0-9])[A-Za-z0-9._-]{8,512}", "Bearer [REDACTED]"),
    (r"(?i:basic)\s{1,4}(?=[A-Za-z0-9+/=]{24}|[A-Za-z+/=]{0,512}[0-9])[A-Za-z0-9+/=]{12,512}", "Basic [REDACTED]"),
    (r"(/(?:home|Users)/)[^/\s\"']{1,64}", "$1[USER]"),
    (r"([A-Za-z]:\\Users\\)[^\\\s\"']{1,64}", "$1[USER]"),
)
# A mail address, or an address with the path of a git remote, which stays.
_REMOTE = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,24}[:/][A-Za-z0-9._/~-]{1,200}\.git"
_MAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,24}"
_MAIL_AT = 13  # the mail rule runs before the home paths


#: For each rule a cheap pattern without which its own cannot match.
HINTS = ("PRIVATE KEY-----", "PRIVATE KEY-----", "://", r"[=:]\s{0,4}[\"']?[^\s\"',;]{8}", "eyJ", "sk-", "gh[pousr]_", "github_pat_", "A[KS]IA", "AIza", "xox[abprs]-", r"(?i)bearer\s", r"(?i)basic\s", "/home/|/Users/", r":\\Users\\")


#: All up to the last end of a key. Beyond it no header has an end, and up to it each one meets its end, so
#: a header's search never runs over text that is searched again.
_TO_LAST_END = r"(?s)^(.*-----END [A-Z ]{0,32}PRIVATE KEY-----)"


def _without_keys(c: Column) -> Column:
    head = F.regexp_extract(c, _TO_LAST_END, 1)
    return F.concat(F.regexp_replace(head, *RULES[0]), F.substr(c, F.char_length(head) + 1))


def _once(pattern: str) -> str:
    """The pattern for the JVM's engine: a run before a dot, which no run holds, is never tried again shorter."""
    return pattern.replace(r"{10,512}\.", r"{10,512}+\.")


def _where(c: Column, hint: str, change: Callable[[Column], Column]) -> Column:
    """c changed where the hint is found; c is bound once, however often the change refers to it."""
    return F.get(F.transform(F.array(c), lambda x: F.when(x.rlike(hint), change(x)).otherwise(x)), 0)


def _without_mail(c: Column) -> Column:
    """An alternation keeps a remote as it is: group 1 holds it, else the address goes."""
    c = F.regexp_replace(c, f"({_REMOTE})|{_MAIL}", "$1\u0001")
    c = F.regexp_replace(c, r"(?<=\.git)\x01", "")
    return F.replace(c, F.lit("\u0001"), F.lit("[REDACTED_EMAIL]"))


def redacted(c: Column) -> Column:
    """The text with every secret replaced."""
    for i, ((pattern, to), hint) in enumerate(zip(RULES, HINTS, strict=True)):
        if i == _MAIL_AT:
            c = _where(c, "@", _without_mail)
        c = _where(c, hint, _without_keys if i == 0 else lambda x, p=_once(pattern), t=to: F.regexp_replace(x, p, t))
    return c


def bounded(c: Column, most: int = MAX_LENGTH) -> Column:
    """At most ``most`` characters, a marker at the end of what was cut."""
    if most < 1:
        raise ValueError("the length must be at least 1")
    cut = F.left(c, F.lit(most)) if most <= len(MARKER) else F.concat(F.left(c, F.lit(most - len(MARKER))), F.lit(MARKER))
    return F.when(F.char_length(c) <= most, c).otherwise(cut)


def sanitized(c: Column, most: int = MAX_LENGTH) -> Column:
    """Redacted first, then bounded: a secret is never kept by being cut."""
    return bounded(redacted(c), most)


def _token(scheme: str, own: str, letters: str, least: int) -> str:
    """A rule's look-ahead spelt out: 24 characters or more, or at least ``least`` of which one is a digit."""
    short = [f"{letters}{{{k}}}[0-9]{own}{{{least - 1 - k},512}}" for k in range(least - 1)]
    return f"(?i:{scheme})\\s{{1,4}}(?:{own}{{24,512}}|{'|'.join(short)}|{letters}{{{least - 1},22}}[0-9]{own}{{0,512}})"


#: The rules for an engine without look-ahead.
_LINEAR = [(_token("bearer", "[A-Za-z0-9._-]", "[A-Za-z._-]", 8) if "(?i:bearer)" in p else _token("basic", "[A-Za-z0-9+/=]", "[A-Za-z+/=]", 12) if "(?i:basic)" in p else p, to.replace("$", "\\")) for p, to in RULES]


def redact_all(texts: pa.Array) -> pa.Array:
    """The same rules for an array of strings; nulls stay."""
    for i, (pattern, to) in enumerate(_LINEAR):
        if i == _MAIL_AT:
            texts = pc.replace_substring_regex(texts, f"({_REMOTE})|{_MAIL}", "\\1\x01")
            texts = pc.replace_substring(pc.replace_substring(texts, ".git\x01", ".git"), "\x01", "[REDACTED_EMAIL]")
        texts = pc.replace_substring_regex(texts, pattern, to)
    return texts


def redact_text(text: str) -> str:
    """The same rules for one string."""
    return redact_all(pa.array([text], pa.string()))[0].as_py()


def _strings(node: object, depth: int = 0) -> Iterator[str]:
    """Names and strings of a JSON value that sanitizing keeps, in order."""
    if depth > MAX_DEPTH:
        return
    if isinstance(node, str):
        yield node
    elif isinstance(node, list):
        for x in node[:MAX_ITEMS]:
            yield from _strings(x, depth + 1)
    elif isinstance(node, dict):
        for key, value in node.items():
            yield key
            yield from _strings(value, depth + 1)


def _rebuilt(node: object, clean: Iterator[str], depth: int = 0) -> object:
    """The value with its strings replaced in the order of _strings(); names made equal are numbered."""
    if depth > MAX_DEPTH:
        return "[REDACTED_TOO_DEEP]"
    if isinstance(node, str):
        text = next(clean)
        return text if len(text) <= MAX_LENGTH else text[: MAX_LENGTH - len(MARKER)] + MARKER
    if isinstance(node, (bytes, bytearray, memoryview)):  # never decoded
        return f"[BINARY:{len(bytes(node))} bytes]"
    if isinstance(node, list):
        return [_rebuilt(x, clean, depth + 1) for x in node[:MAX_ITEMS]]
    if not isinstance(node, dict):
        return node
    out: dict[str, object] = {}
    count: dict[str, int] = {}
    for value in node.values():
        own = name = next(clean)
        while name in out:
            count[own] = count.get(own, 1) + 1
            name = f"{own}#{count[own]}"
        out[name] = _rebuilt(value, clean, depth + 1)
    return out


def sanitize_all(nodes: list[object]) -> list[object]:
    """JSON values with redacted and bounded strings, depth and list lengths; all their strings go through at once."""
    clean = iter(redact_all(pa.array([s for node in nodes for s in _strings(node)], pa.large_string())).to_pylist())
    return [_rebuilt(node, clean) for node in nodes]


def sanitize(node: object) -> object:
    return sanitize_all([node])[0]


@F.pandas_udf(T.StringType())
def sanitized_json(values: pd.Series) -> pd.Series:
    """JSON text with every string in it sanitized; null stays null."""
    made = sanitize_all([None if t is None else json.loads(t) for t in values])
    return pd.Series([None if t is None else json.dumps(m, ensure_ascii=False) for t, m in zip(values, made, strict=True)], dtype=object)
