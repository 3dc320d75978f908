"""Words of a text as bytes: A-Z lowered, cut at every other ASCII character or at white space only."""

from __future__ import annotations

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Only 0-9, a-z and bytes of characters beyond ASCII stay; all else becomes a space.
_WORDS_ONLY = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in _LOWER)
#: White space of the shingle contract: U+0020 and U+0009 to U+000D, which is what bytes.split() cuts at.


def plain_words(text: str) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS_ONLY).split()


def spaced_words(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def plain_spans(text: str) -> list[tuple[int, int]]:
    """Byte spans of plain_words() in the UTF-8 text."""
    raw = text.encode("utf-8", "surrogatepass").translate(_WORDS_ONLY)
    spans, at = [], 0
    for w in raw.split():
        at = raw.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    return spans
