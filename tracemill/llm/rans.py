"""Token ids in a binary format coded by a static range asymmetric numeral system (rANS).

encode: texts -> ids of a given tokenizer, in ascending document order -> one frequency table shared by
the whole corpus -> chunks. A chunk holds whole documents, about CHUNK_IDS ids, as independent blocks of
at most BLOCK_IDS ids. A block interleaves up to LANES coder states over one word stream, so a decoder
steps all lanes at once; the chunk's directory gives for every block its checkpoint (byte offset, ids
before it) and two checksums, so blocks can be decoded alone, in any order and in parallel.

Chunk layout, little-endian: b"RANS", version u32, blocks u32, then per block: offset u64, first id u64,
ids u32, lanes u32, words u32, crc32 of the coded bytes u32, crc32 of the ids as u32 values u32; then per
block its lane states (u64) and its words (u32). The table file has one row a symbol (symbol, freq), the
frequencies summing to 2**SCALE. Chunks are rows of Parquet files written by Spark's commit protocol, so
a lost executor or a repeated task leaves no torn file.

Defined results: a null or empty text has the end id only; an empty table gives empty files; repeated ids
are ordered by their ids' bytes; null document ids come first; other columns are ignored. One document
must fit in one row. Ids are range-shuffled once, compressed; texts are not shuffled.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import bound_batches, derive, dropped, id_and_text, pieces, scratch_path, stored
from tracemill.llm.piece_bpe import byte_characters

#: Bytes of text that a part of the corpus has at most, about.
PART_BYTES = 256 << 20
SCALE = 20
LOW = 1 << 31
LANES, BLOCK_IDS, CHUNK_IDS = 2048, 1 << 18, 1 << 20
#: Distinct words a worker remembers before it starts anew (about 200 bytes each).
CACHE_ENTRIES = 200_000
DIRECTORY = struct.Struct("<QQIIIII")
#: Every 16-bit id as bytes.
SHORT = [struct.pack("<H", i) for i in range(1 << 16)]


class WordTokenizer:
    """Encodes by a tokenizers file, word by word, each distinct word of a batch once.

    Only for byte-level tokenizers that lower-case, compose (NFC), drop white space, let no token cross it
    and cut letters from all else, so that a text's ids are its words' ids in a row. With ``marks`` the file's
    added tokens are found as the library finds them: texts that hold one are its own affair, whole. Without,
    they are plain text.
    """

    shared: dict[str, WordTokenizer] = {}

    def __init__(self, path: str, marks: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not marks
        added = {t.content for t in self.library.get_added_tokens_decoder().values()} if marks else set()
        self.added = "|".join(sorted(map(re.escape, added))) or None
        self.tokenize = self.library.model.tokenize
        self.map = dict(enumerate(byte_characters()))
        self.cache: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """One a worker process, so that what it has learnt serves the next task too."""
        if path not in cls.shared:
            cls.shared[path] = cls(path, marks=True)
        return cls.shared[path]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids end)."""
        if self.added is None:
            return self._by_words(texts)
        # Normalised added tokens match in any case, so a wider search is made than the library's own.
        whole = np.flatnonzero(pc.match_substring_regex(texts, self.added, ignore_case=True).to_numpy(zero_copy_only=False))
        if not len(whole):
            return self._by_words(texts)
        ids, ends = self._by_words(pc.if_else(pc.match_substring_regex(texts, self.added, ignore_case=True), "", texts))
        parts = np.split(ids, ends[:-1])
        for i in whole:
            parts[i] = np.array(self.library.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, "<u2")
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = texts.cast(pa.binary())
        if not any(pc.any(pc.match_substring(raw, mark)).as_py() for mark in (b"\xcc", b"\xcd")):
            texts = pc.ascii_lower(texts)  # no combining mark that composes with a small letter only
        # A run of punctuation without apostrophe between a letter or digit and white space is cut off
        # there by the tokenizer too; without it there are fewer distinct words.
        texts = pc.replace_substring_regex(texts, r"([0-9A-Za-z])([!-&(-/:-@\[-`{-~]+)([ \n])", r"\1 \2 ")
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary.to_pylist()
        found = list(map(self.cache.get, distinct))
        missing = [i for i, x in enumerate(found) if x is None]
        room = len(self.cache) < CACHE_ENTRIES
        if len(self.cache) > 2 * CACHE_ENTRIES:
            self.cache.clear()
        often = np.bincount(code, minlength=len(distinct)) > 1
        rest = []
        for i in missing:
            w = distinct[i]
            if w.isascii():
                plain = w.isalpha() and w.islower()
            elif plain := w.isalpha() and w == w.lower() and is_normalized("NFC", w):
                w = w.encode().decode("latin-1").translate(self.map)
            if plain:  # one pre-token that normalisation leaves alone: the model alone decides
                found[i] = b"".join([SHORT[t.id] for t in self.tokenize(w)])
            else:
                rest.append(i)
        for at in range(0, len(rest), 10_000):
            some = rest[at : at + 10_000]
            for i, e in zip(some, self.library.encode_batch_fast([distinct[i] for i in some], add_special_tokens=False), strict=True):
                found[i] = b"".join([SHORT[t] for t in e.ids])
        self.cache.update((distinct[i], found[i]) for i in missing if room or often[i])
        flat = np.frombuffer(b"".join(found), "<u2")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 2
        start = np.concatenate(([0], np.cumsum(size)))[:-1]
        n = size[code]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(start[code] - ends[:-1], n) + np.arange(ends[-1])] if len(code) else flat
        return ids, ends[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]


def quantise(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale, at least 1 for each symbol that occurs."""
    total = counts.sum()
    if total == 0:
        return counts.astype(np.int64)
    freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * (1 << scale) / total).astype(np.int64), 0)
    over = int(freq.sum()) - (1 << scale)
    order = np.argsort(-freq, kind="stable")
    if over <= 0:
        freq[order[0]] -= over
        return freq
    for s in order:  # take the excess from the most frequent ones
        take = min(over, max(0, int(freq[s]) // 2))
        freq[s] -= take
        over -= take
        if not over:
            return freq
    raise ValueError("more symbols than the scale can hold")


class Coder:
    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale = scale
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)))[:-1].astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode_block(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lane states, words). Id i is coded by lane i mod lanes."""
        lanes = max(1, min(LANES, len(ids) // 64))
        steps = -(-len(ids) // lanes)
        state, words = np.full(lanes, LOW, np.uint64), []
        freq, start = self.freq[ids], self.start[ids]
        limit = freq << np.uint64(63 - self.scale)
        shift, wide, low = np.uint64(self.scale), np.uint64(32), np.uint64(0xFFFFFFFF)
        for t in range(steps - 1, -1, -1):
            f, s, m = (a[t * lanes : (t + 1) * lanes] for a in (freq, start, limit))
            x = state[: len(f)]
            full = x >= m
            words.append((x[full] & low).astype(np.uint32))
            x = np.where(full, x >> wide, x)
            q = x // f
            state[: len(f)] = (q << shift) + (x - q * f) + s
        return state, np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)

    def decode_block(self, state: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        lanes, out, at = len(state), np.empty(n, np.uint32), 0
        state, words = state.copy(), words.astype(np.uint64)
        mask, shift, wide, low = np.uint64((1 << self.scale) - 1), np.uint64(self.scale), np.uint64(32), np.uint64(LOW)
        for t in range(0, n, lanes):
            x = state[: min(lanes, n - t)]
            slot = x & mask
            s = self.symbol[slot]
            out[t : t + len(x)] = s
            x = self.freq[s] * (x >> shift) + slot - self.start[s]
            need = np.flatnonzero(x < low)
            x[need] = x[need] << wide | words[at : at + len(need)]
            at += len(need)
            state[: len(x)] = x
        if at != len(words) or not (state == low).all():
            raise ValueError("the block does not end where it should")
        return out

    def encode_chunk(self, ids: np.ndarray) -> bytes:
        directory, bodies, offset = [], [], 12 + DIRECTORY.size * -(-len(ids) // BLOCK_IDS)
        for at in range(0, len(ids), BLOCK_IDS):
            part = ids[at : at + BLOCK_IDS]
            state, words = self.encode_block(part)
            body = state.astype("<u8").tobytes() + words.astype("<u4").tobytes()
            directory.append(DIRECTORY.pack(offset, at, len(part), len(state), len(words), zlib.crc32(body), zlib.crc32(part.astype("<u4").tobytes())))
            bodies.append(body)
            offset += len(body)
        return struct.pack("<4sII", b"RANS", 1, len(bodies)) + b"".join(directory) + b"".join(bodies)

    def decode_chunk(self, chunk: bytes, blocks: range | None = None) -> np.ndarray:
        """The ids of all blocks, or of some."""
        magic, version, n = struct.unpack_from("<4sII", chunk)
        if magic != b"RANS" or version != 1:
            raise ValueError("not a chunk of this format")
        out = [np.empty(0, np.uint32)]
        for b in blocks if blocks is not None else range(n):
            offset, _, ids, lanes, words, coded, plain = DIRECTORY.unpack_from(chunk, 12 + DIRECTORY.size * b)
            body = memoryview(chunk)[offset : offset + 8 * lanes + 4 * words]
            if zlib.crc32(body) != coded:
                raise ValueError(f"block {b} is damaged")
            out.append(self.decode_block(np.frombuffer(body[: 8 * lanes], "<u8"), np.frombuffer(body[8 * lanes :], "<u4"), ids))
            if zlib.crc32(out[-1].astype("<u4").tobytes()) != plain:
                raise ValueError(f"block {b} decodes to other ids")
        return np.concatenate(out)


def tokenised(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, packed (zstd of 16-bit ids with the end id), part, in_part, stored by (part, in_part).

    Parts are ranges of doc_id, cut at quantiles of the ids alone, so that nothing is tokenised twice; there are
    as many as the bytes of the texts ask for.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(4 * parts, -(-size // PART_BYTES))
    parts = max(parts, ranges // 4)
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []))

    def make():
        import zstandard

        tokenizer, pack, end = WordTokenizer.of(vocabulary), zstandard.ZstdCompressor(level=3), struct.pack("<H", end_id)

        def work(batch: pa.RecordBatch) -> dict:
            ids, ends = tokenizer.encode(batch.column("text"))
            own = [x.tobytes() + end for x in np.split(ids, ends[:-1])] if len(batch) else []
            buckets = np.array([-1 if d is None else bisect_right(cuts, d) for d in batch.column("doc_id").to_pylist()])
            return {"n_tokens": [len(x) // 2 for x in own], "packed": [pack.compress(x) for x in own], "part": (buckets + 1).tolist()}

        return work

    rows = derive(docs, make, "n_tokens long, packed binary, part int", ["doc_id"])
    order = ["part", F.col("doc_id").asc_nulls_first(), "n_tokens", "packed"]
    dealt = rows.repartition(parts, "part").sortWithinPartitions(*order)
    return stored(dealt.withColumn("in_part", F.monotonically_increasing_id()), "tokens")


def symbol_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs; the driver gets one number a symbol."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, total = zstandard.ZstdDecompressor(), np.zeros(size, np.int64)
        for b in pieces(batches):
            joined = b"".join(unpack.decompress(x.as_py()) for x in b.column("packed"))
            total += np.bincount(np.frombuffer(joined, "<u2"), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"symbol": seen, "n": total[seen]})

    counts = np.zeros(size, np.int64)
    for r in bound_batches(tokens.select("packed")).mapInArrow(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        counts[r["symbol"]] = r["n"]
    return counts


def write_chunks(tokens: DataFrame, freq: np.ndarray, path: str) -> None:
    """Code stored tokens into chunk rows (part, first, doc_ids, lengths, chunk) under path."""
    schema = T.StructType.fromDDL("part int, first long, doc_ids array<long>, lengths array<int>, chunk binary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, coder = zstandard.ZstdDecompressor(), Coder(freq)
        arrow = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("chunk", pa.binary())])
        held: list[tuple[int, int, int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x[3] for x in held), "<u2").astype(np.int64)
            row = {"part": held[0][0], "first": held[0][1], "doc_ids": [x[2] for x in held], "lengths": [len(x[3]) // 2 for x in held], "chunk": coder.encode_chunk(ids)}
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for b in batches:
            for part, at, doc, packed in zip(*(b.column(c).to_pylist() for c in ("part", "in_part", "doc_id", "packed")), strict=True):
                if held and (size >= CHUNK_IDS or part != held[-1][0] or at != held[-1][1] + 1):
                    yield flush()
                    size = 0
                held.append((part, at, doc, unpack.decompress(packed)))
                size += len(held[-1][3]) // 2
        if held:
            yield flush()

    bound_batches(tokens.select("part", "in_part", "doc_id", "packed")).mapInArrow(encode, schema).write.option("compression", "none").parquet(f"{path}/chunks")
    spark = tokens.sparkSession
    spark.createDataFrame([(int(s), int(freq[s])) for s in np.flatnonzero(freq)], "symbol int, freq int").coalesce(1).write.parquet(f"{path}/table")


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/table").collect()
    freq = np.zeros(max((r["symbol"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        freq[r["symbol"]] = r["freq"]
    return freq


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: part, first, index, doc_id, n_tokens, ids_crc32 for every document."""
    freq = read_table(spark, path)
    schema = "part int, first long, index int, doc_id long, n_tokens long, ids_crc32 long"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for b in batches:
            for part, first, docs, lengths, chunk in zip(*(b.column(c) for c in ("part", "first", "doc_ids", "lengths", "chunk")), strict=True):
                raw, at, crc = memoryview(coder.decode_chunk(chunk.as_py()).astype("<u4").tobytes()), 0, []
                for n in (lengths := lengths.as_py()):
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    at += n
                k = len(lengths)
                columns = [pa.array([part.as_py()] * k, pa.int32()), pa.array([first.as_py()] * k, pa.int64()), pa.array(range(k), pa.int32()), docs.values, pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "first", "index", "doc_id", "n_tokens", "ids_crc32"])

    return spark.read.parquet(f"{path}/chunks").mapInArrow(decode, schema)


def with_starts(found: DataFrame) -> DataFrame:
    """Add start, the ids of all documents before: a running sum in each part after the parts before it."""
    found = stored(found, "decoded")
    rows = found.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    ends = list(accumulate(r["n"] for r in rows))
    bases = found.sparkSession.createDataFrame([(r["part"], e - r["n"]) for r, e in zip(rows, ends, strict=True)], "part int, base long")
    before = Window.partitionBy("part").orderBy("first", "index").rowsBetween(Window.unboundedPreceding, -1)
    return found.join(bases, "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).drop("base")


def encode_corpus(docs: DataFrame, vocabulary: str, end_id: int, vocab_size: int, path: str | None = None, id_col="doc_id", text_col="text") -> str:
    """Write the corpus in this format and return the folder."""
    path = path or scratch_path(docs.sparkSession, "rans")
    tokens = tokenised(id_and_text(docs, id_col, text_col), vocabulary, end_id)
    write_chunks(tokens, quantise(symbol_counts(tokens, vocab_size)), path)
    dropped(tokens)
    return path
