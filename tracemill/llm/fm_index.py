"""Benchmark decontamination by one FM-index per training shard.

A shard is the run of documents, SHARD_BYTES in all, that a task holds at a time. Its words become symbols: each word of
the test phrases has its own, all other words cannot match and cut the shard into runs. Runs shorter
than the shortest phrase cannot hold one and are left out; what remains is indexed: suffix array by
prefix doubling, Burrows-Wheeler transform in a wavelet matrix with rank tables, and the suffix
positions sampled every SAMPLE symbols. All phrases are searched backward at once, occurrences are
located by walking to the next sample, and their spans are merged per document.

Phrases go to the executors in blocks of at most BLOCK_BYTES; each further block is one more scan of the
documents, which stores only the spans of the rows it hits; these are merged and joined to the rows at last.
Nothing else is broadcast, and texts are not shuffled while there is one block: a hot source or a large group
of copies is only more rows of a scan.

Defined results: null or wordless texts have no words, no hits; empty tables give empty results or no
hits; items without words are no phrases; repeated items count once per item id; repeated rows are
answered each; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import derive, dropped, stored
from tracemill.llm.words import plain_spans, plain_words

WINDOW = 10
SAMPLE = 8
#: Words of phrases per block, as bytes; symbols indexed at once.
BLOCK_BYTES = 8 << 20
SHARD_SYMBOLS = 1 << 20
#: Texts of one shard, as bytes.
SHARD_BYTES = 16 << 20

SPANS = "array<struct<start:long,end:long>>"
FIELDS = "n_words long, spans array<struct<start:long,end:long>>, item_ids array<long>"


class FMIndex:
    """Over runs of symbols >= 1. Symbol 0 ends every run."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.n = n = len(text)
        order = self._suffix_array(text.astype(np.int64), sigma)
        self.bits = max(1, int(sigma).bit_length())
        bwt = text[order - 1]  # text[-1] is 0: it ends the last run
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 2))))
        self.levels: list[np.ndarray] = []
        self.zeros: list[int] = []
        at = bwt
        for level in range(self.bits - 1, -1, -1):
            bit = (at >> level) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(int(n - ones[-1]))
            at = np.concatenate((at[bit == 0], at[bit == 1]))
        starts = np.concatenate(([True], text[:-1] == 0))  # a walk never crosses the start of a run
        keep = (order % SAMPLE == 0) | starts[order]
        self.sampled = keep
        self.sample_rank = np.concatenate(([0], np.cumsum(keep)))
        self.samples = order[keep]
        self.bwt_first = bwt

    @staticmethod
    def _suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
        """Prefix doubling; run ends get ranks of their own, so comparisons stop there."""
        n = len(text)
        ends = np.flatnonzero(text == 0)
        rank = text + len(ends) - 1
        rank[ends] = np.arange(len(ends))
        width = 1
        while True:
            other = np.zeros(n, np.int64)
            if width < n:
                other[: n - width] = rank[width:] + 1
            key = rank * (n + sigma + 2) + other
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                return order
            width *= 2

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often symbol stands in the transform before row."""
        at, start = row.astype(np.int64), np.zeros(len(row), np.int64)
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            ones, zeros = self.levels[i], self.zeros[i]
            at = np.where(one, zeros + ones[at], at - ones[at])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return at - start

    def search(self, symbols: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [low, high) of all phrases, the ``lengths`` symbols before ``ends``."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            on = np.flatnonzero((lengths > step) & (low < high))
            if not len(on):
                break
            c = symbols[ends[on] - 1 - step].astype(np.int64)
            low[on] = self.first[c] + self.rank(c, low[on])
            high[on] = self.first[c] + self.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes at rows."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[at[left]]
            hit = left[done]
            out[hit] = self.samples[self.sample_rank[at[hit]]] + steps[hit]
            left = left[~done]
            c = self.bwt_first[at[left]]
            at[left] = self.first[c] + self.rank(c, at[left])
            steps[left] += 1
        return out


class Phrases:
    """Windows of test items as places in one array of symbols, equal windows once, with the items that have them.

    ``symbols`` holds all items one after another; window i is its ``lengths[i]`` symbols before ``ends[i]``, and its
    items are ids[k] for k in owners[offsets[i] : offsets[i + 1]]. No window is an object of its own.
    """

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.ids, symbols, counts = [i for i, _ in items], array("i"), np.zeros(len(items), np.int64)
        for k, (_, text) in enumerate(items):
            words = plain_words(text or "")
            symbols.extend(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words)
            counts[k] = len(words)
        self.symbols = np.array(symbols, np.int32)
        each = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
        owners = np.repeat(np.arange(len(items), dtype=np.int32), each)
        begin = np.repeat(np.cumsum(counts) - counts, each) + np.arange(len(owners)) - np.repeat(np.cumsum(each) - each, each)
        lengths = np.minimum(counts, window)[owners]
        code = (lengths.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        for j in range(int(lengths.max(initial=0))):
            on = np.flatnonzero(lengths > j)
            code[on] = (code[on] ^ self.symbols[begin[on] + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code[on] ^= code[on] >> np.uint64(29)
        order = np.argsort(code, kind="stable")
        code, begin, lengths, owners = code[order], begin[order], lengths[order], owners[order]
        same = np.flatnonzero((code[1:] == code[:-1]) & (lengths[1:] == lengths[:-1]))
        for j in range(int(lengths.max(initial=0))):  # the windows themselves decide, whatever their codes
            on = lengths[same] > j
            same = same[~on | (self.symbols[np.minimum(begin[same] + j, len(self.symbols) - 1)] == self.symbols[np.minimum(begin[same + 1] + j, len(self.symbols) - 1)])]
        new = np.ones(len(order), bool)
        new[same + 1] = False
        first = np.flatnonzero(new)
        self.offsets = np.append(first, len(order))
        self.lengths, self.ends, self.owners = lengths[first], (begin + lengths)[first], owners
        self.shortest = int(self.lengths.min()) if len(first) else 0

    def items(self, which: int) -> set[int]:
        """The ids of the items that have a window."""
        return {self.ids[k] for k in self.owners[self.offsets[which] : self.offsets[which + 1]].tolist()}


def _runs(symbols: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of the runs, each ended by 0; their positions) without runs that are too short."""
    inside = np.concatenate(([0], (symbols > 0).astype(np.int8), [0]))
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= shortest
    starts, ends = starts[long], ends[long]
    lengths = ends - starts + 1
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    text = symbols[np.minimum(at, len(symbols) - 1)]
    text[np.cumsum(lengths) - 1] = 0
    return text, at


def _hits(index_text: np.ndarray, at: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word position, phrase, length) of every occurrence."""
    index = FMIndex(index_text, len(phrases.vocab))
    low, high = index.search(phrases.symbols, phrases.ends, phrases.lengths)
    count = high - low
    which = np.repeat(np.arange(len(low)), count)
    rows = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    return at[index.locate(rows)], which, phrases.lengths[which]


def _symbols(text: str, vocab: dict[bytes, int]) -> np.ndarray:
    words = plain_words(text)
    return np.fromiter(map(vocab.get, words, repeat(0)), np.int32, len(words))


def scan_shard(texts: list[str], phrases: Phrases) -> Iterator[tuple[int, list[tuple[int, int]], list[int]]]:
    """(number of words, merged word spans, sorted item ids) for each text."""
    own = [_symbols(t, phrases.vocab) for t in texts]  # the words of one text at a time
    counts = np.array([len(s) for s in own], np.int64)
    base = np.concatenate(([0], np.cumsum(counts + 1)))  # one gap after each document keeps runs apart
    symbols = np.zeros(int(base[-1]), np.int32)
    for s, b in zip(own, base, strict=False):
        symbols[b : b + len(s)] = s
    del own
    spans: dict[int, list[tuple[int, int]]] = {}
    found: dict[int, set[int]] = {}
    if phrases.shortest:
        text, at = _runs(symbols.astype(np.int64), phrases.shortest)
        ends = np.flatnonzero(text == 0) + 1
        cut = 0
        while cut < len(text):  # index at most SHARD_SYMBOLS at a time, whole runs
            k = int(np.searchsorted(ends, cut + SHARD_SYMBOLS, "right")) - 1
            to = int(ends[k]) if k >= 0 and ends[k] > cut else int(ends[np.searchsorted(ends, cut, "right")])
            place, which, length = _hits(text[cut:to], at[cut:to], phrases)
            order = np.argsort(place, kind="stable")
            docs = np.searchsorted(base, place, "right") - 1
            for i in order:
                d, s = int(docs[i]), int(place[i] - base[docs[i]])
                e, own = s + int(length[i]), spans.setdefault(d, [])
                if own and s <= own[-1][1]:
                    own[-1] = (own[-1][0], max(own[-1][1], e))
                else:
                    own.append((s, e))
                found.setdefault(d, set()).update(phrases.items(int(which[i])))
            cut = to
    for d, n in enumerate(counts.tolist()):
        yield n, spans.get(d, []), sorted(found.get(d, ()))


def merged_spans(spans: Column) -> Column:
    """Spans in order, those that touch or overlap made one."""
    one = lambda s, e: F.struct(s.alias("start"), e.alias("end"))

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(one(last["start"], F.greatest(last["end"], s["end"]))))
        return F.when(last["end"] >= s["start"], longer).otherwise(F.concat(done, F.array(one(s["start"], s["end"])))).cast(SPANS)

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), step)


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one block on the driver at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"].encode("utf-8", "surrogatepass"))
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: str | None = None) -> DataFrame:
    """doc_id, n_words, spans (merged word spans that are hit), item_ids; ``carry`` names a column to keep, with the text."""
    kept = ["doc_id", "text", *([carry] if carry else [])]
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *kept[2:])

    def scanned(rows: DataFrame, items: list[tuple[int, str]], keep: list[str]) -> DataFrame:
        def scanner():
            phrases = Phrases(items, window)

            def scan(batch: pa.RecordBatch) -> dict:
                found = list(scan_shard([t or "" for t in batch.column("text").to_pylist()], phrases))
                return {"n_words": [r[0] for r in found], "spans": [[{"start": s, "end": e} for s, e in r[1]] for r in found], "item_ids": [r[2] for r in found]}

            return scan

        return derive(rows, scanner, FIELDS, keep, SHARD_BYTES)

    blocks = item_blocks(benchmark)
    out = scanned(source, next(blocks, []), kept)
    marked = source.withColumn("mark", F.xxhash64("doc_id", "text"))
    more = [stored(scanned(marked, items, ["doc_id", "mark"]).filter(F.size("spans") > 0).drop("n_words"), "spans") for items in blocks]
    if more:
        hits = reduce(DataFrame.unionByName, more).distinct()  # equal rows have equal spans
        flat = lambda c: F.flatten(F.collect_list(c)).alias(f"more_{c}")
        hits = stored(hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark")).agg(flat("spans"), flat("item_ids")), "spans")
        dropped(*more)
        both = out.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("doc_id", "text") == F.col("hit_mark")), "left")
        spans = F.when(F.col("hit_mark").isNull(), F.col("spans")).otherwise(merged_spans(F.concat("spans", F.coalesce("more_spans", F.array().cast(SPANS)))))
        ids = F.array_sort(F.array_distinct(F.concat("item_ids", F.coalesce("more_item_ids", F.array().cast("array<long>")))))
        out = both.withColumns({"spans": spans, "item_ids": ids}).drop("hit_id", "hit_mark", "more_spans", "more_item_ids")
    return out if carry else out.drop("text")


def digests(found: DataFrame) -> DataFrame:
    """The contract's digest columns of find_contamination()."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    names = F.array_sort(F.col("item_ids").cast("array<string>"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    at = plain_spans(text)
    raw, out, last = text.encode("utf-8", "surrogatepass"), [], 0
    for s, e in spans:
        out.append(raw[last : at[s][0]])
        last = at[e - 1][1]
    out.append(raw[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def without_passages(found: DataFrame, keep: list[str], most: float = 0.5) -> DataFrame:
    """The columns ``keep`` and clean_text of the documents that keep more than ``most`` of their words once their spans are cut."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    kept = found.filter((hit == 0) | (hit < most * F.col("n_words")))

    def work(batch: pa.RecordBatch) -> dict:
        rows = zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)
        return {"clean_text": [cut_spans(t, [(x["start"], x["end"]) for x in s]) if s else t for t, s in rows]}

    return derive(kept, lambda: work, "clean_text string", keep)
