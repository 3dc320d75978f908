"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

The model is serialised directly, without training: every token's bytes are mapped to one character a
byte and become a piece whose score is its negative rank, so that sentencepiece merges the pair of
lowest rank first, as byte-level BPE does; normalisation is the identity. Texts are cut into pre-tokens
by the given pattern, each pre-token is encoded on its own, and ids are decoded by the inverse mapping.
A pre-token that is itself in the vocabulary is that token.

Defined results: a null or empty text has no ids; an empty table gives no rows; repeated rows are encoded
each; lone surrogates cannot occur in Spark strings; other columns are ignored. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from tracemill.llm.common import derive

#: Distinct pre-tokens kept by a task before its cache starts anew.
CACHE_ENTRIES = 200_000


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where printable, else U+0100 and on in order."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _field(number: int, payload: bytes) -> bytes:
    """A length-delimited protobuf field."""
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto (BPE) whose piece i is the token of rank i; <unk> comes last."""
    chars = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be gapless from 0")
    pieces = []
    for token, rank in by_rank:
        text = "".join(chars[b] for b in token).encode()
        pieces.append(_field(1, _field(1, text) + b"\x15" + struct.pack("<f", -float(rank))))
    pieces.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + b"\x18\x02"))
    # trainer_spec: model_type (3) = BPE (2), vocab_size (4), unk_id (40), no bos, eos, pad (41 to 43 = -1)
    none = (1 << 64) - 1
    trainer = _varint(3 << 3) + b"\x02" + _varint(4 << 3) + _varint(len(pieces)) + _varint(40 << 3) + _varint(len(by_rank))
    trainer += b"".join(_varint(k << 3) + _varint(none) for k in (41, 42, 43))
    # normalizer_spec: name (1), add_dummy_prefix (3), remove_extra_whitespaces (4), escape_whitespaces (5) = false
    normalizer = _field(1, b"identity") + b"".join(_varint(k << 3) + b"\x00" for k in (3, 4, 5))
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class PieceBPE:
    """Encoder and decoder; ids travel as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.cut = regex.compile(pattern).findall
        self.chars = byte_characters()
        self.map = {b: c for b, c in enumerate(self.chars)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.vocab = {}
        for token, rank in ranks.items():
            try:
                self.vocab[token.decode()] = struct.pack("<I", rank)
            except UnicodeDecodeError:
                continue  # part of a character: only merges reach it
        self.bytes_of = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.cache = dict(self.vocab)

    def _learn(self, missing: list[str]) -> None:
        if len(self.cache) > len(self.vocab) + CACHE_ENTRIES:
            self.cache = dict(self.vocab)
        mapped = [x.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.map) for x in missing]
        for x, ids in zip(missing, self.model.encode(mapped, num_threads=1), strict=True):
            self.cache[x] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        pieces = self.cut(text)
        found = list(map(self.cache.get, pieces))
        if None in found:
            self._learn(list({p for p, x in zip(pieces, found, strict=True) if x is None}))
            found = [x or self.cache[p] for p, x in zip(pieces, found, strict=True)]
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))) if ids else b""


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, and ids (binary), n_tokens, decoded (binary: the UTF-8 text again)."""

    def make():
        bpe = PieceBPE(read_ranks(vocabulary), pattern)

        def work(batch: pa.RecordBatch) -> dict:
            ids = [bpe.encode(t.as_py() or "") for t in batch.column(text_col)]
            return {"ids": ids, "n_tokens": [len(x) // 4 for x in ids], "decoded": [bpe.decode(x) for x in ids]}

        return work

    return derive(docs, make, "ids binary, n_tokens long, decoded binary", keep or ["doc_id"])


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the digests of its ids and of what they decode to; ids never leave the task."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def make():
        bpe = PieceBPE(read_ranks(vocabulary), pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def work(batch: pa.RecordBatch) -> dict:
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in batch.column("text"):
                ids = bpe.encode(t.as_py() or "")
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(sha(ids))
                out["decoded_sha256"].append(sha(bpe.decode(ids)))
            return out

        return work

    return derive(source, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id"])
