"""N-gram Jaccard self-join with adaptive multi-match prefixes, as connected components.

A document is the set of its distinct five-word shingles. Documents with equal sets form a class; classes
are joined. All sets are put in one global order, rare shingles first (by a counting sketch over all
documents; any order is right, a good one is fast). If two sets are similar, they share l of the first
|x| - ceil(t |x|) + l shingles of each, for every l; so each document chooses its own l, lengthening its
prefix as long as the estimated cost of postings and verifications falls, and a pair must share at least
the smaller l of both before it is verified.

Steps: (1) one pass gives set sizes, class keys and the sketch; (2) prefix shingles are grouped and classes
that share none with another class are done; (3) for the others, sizes and bitmaps are stored;
(4) every shingle links its classes to the smallest one, verified exactly, which gives first components;
(5) pairs of classes in different components that meet at prefix shingles are counted, under the length
bound, the position bound and the bitmap bound on overlap; those that meet often enough are verified exactly.
Pairs inside a component need no test for the result, so a large group of near copies costs a star, not all
its pairs.

Position bound: of n shingles, the i-th in the global order (from 0) can be one of the first l common ones only if the
overlap is at most n - i + l - 1, which limits the partner's size. A pair has to meet at its first common shingles, as
many as the smaller l of both, so each document may use its own l. A passage that many
documents share among rare shingles of their own stands late in each of them, so its postings fit nobody and
are dropped with their group, before any pair is made.

Verification fetches only the sets of the pairs at hand, in a scan that skips other ids. Skew: classes take
exact copies; a shingle found in many documents is not grouped in (2), it counts as shared; in (5) the most common component of a shingle is only met by the others, and Spark
splits hot keys of these joins. Nothing grows with the corpus on the driver but the sketch's frequent
buckets (at most 2**SKETCH_BITS numbers) and the filter of ids (FILTER_BITS bits at most; where more ids are
wanted than it can tell apart, texts are joined with the ids). Tables in between are emptied once they are used.

Classes have 128-bit keys: where two 64-bit keys (sums of mixed shingle hashes) are equal and the other 64 bits
are not, the others are the keys. Shingles are 64-bit hashes. Defined results: null or
wordless texts have no set and are linked with nothing; fewer than five words are one shingle; rows with a
null id are compared with nothing and have a null component; repeated rows are equal sets; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import bound_batches, dropped, pieces, stored
from tracemill.llm.components import components

WORDS, PERCENT = 5, 80
MAX_MATCH = 4
#: Cost of a verification in units of a posting.
VERIFY_COST = 20.0
SKETCH_BITS = 20
#: From this sketch count on, a prefix shingle is not grouped: its documents are candidates at once.
FREQUENT = 1_000
#: The filter has 16 bits an id, but no more than this.
FILTER_BITS = 1 << 26
#: Bits of a posting's place in its prefix, which is a fifth of the document's shingles and a few more.
PLACE_BITS = 24
#: Bitmaps: a short one that travels with postings, a wide one for pairs.
BITMAP_LONGS, WIDE_LONGS = 4, 32
#: Classes that a task remembers having posted.
SEEN_CLASSES = 300_000
#: Odd multipliers of the shingle hash, one for each word place.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
OFFSETS = PLACES * np.arange(1, 6, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of k word hashes."""
    n = len(words) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out += mix(words[i : i + n] + OFFSETS[i % 5]) * PLACES[(i + 1) % 5]
    return mix(out)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; each distinct word of the batch is hashed once."""
    from xxhash import xxh64_intdigest

    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = parts.flatten().dictionary_encode()
    code, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    hashes = np.array([xxh64_intdigest(w) for w in distinct], np.uint64)
    real = np.array([bool(w) for w in distinct], bool)[code] if len(code) else np.empty(0, bool)
    doc = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    lengths = np.bincount(doc[real], minlength=len(texts))
    flat = hashes[code[real]] if len(code) else np.empty(0, np.uint64)
    runs = _hash(flat, words) if len(flat) >= words else np.empty(0, np.uint64)
    out, at = [], 0
    for n in lengths.tolist():
        if n >= words:
            out.append(np.unique(runs[at : at + n - words + 1]))
        else:
            out.append(_hash(flat[at : at + n], n) if n else np.empty(0, np.uint64))
        at += n
    return out


def other_key(shingles: np.ndarray) -> int:
    return int(mix(mix(shingles) * PLACES[1] ^ PLACES[3]).sum(dtype=np.uint64).astype(np.int64))


class Keys:
    """64-bit class keys of shingle sets, other ones where the first are known to collide; ``bits`` makes them collide in tests."""

    def __init__(self, bits: int = 64, collided: frozenset[int] = frozenset()):
        self.bits, self.collided = bits, collided

    def first(self, shingles: np.ndarray) -> int:
        whole = mix(shingles ^ PLACES[0]).sum(dtype=np.uint64)
        return int(whole.astype(np.int64)) if self.bits == 64 else int(whole & np.uint64((1 << self.bits) - 1))

    def __call__(self, shingles: np.ndarray) -> int:
        key = self.first(shingles)
        return other_key(shingles) if key in self.collided else key


def need(n: int, percent: int) -> int:
    """Least overlap that a set of n can have with a similar one."""
    return -(-n * percent // 100)


def prefix_of(shingles: np.ndarray, counts: Callable[[np.ndarray], np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, int]:
    """(prefix in global order, its sketch counts, required matches) of the cheapest multi-match prefix."""
    n, f = len(shingles), counts(shingles)
    order = np.lexsort((shingles, f))
    base = n - need(n, percent)
    top = min(MAX_MATCH, n - base)
    postings = np.cumsum(f[order[: base + top]] + 1.0)[base:]
    cost = postings * (1 + VERIFY_COST / np.arange(1, top + 1))
    matches = int(np.argmin(cost)) + 1
    chosen = order[: base + matches]
    return shingles[chosen], f[chosen], matches


def largest_partner(n: int, places: np.ndarray, matches: int, percent: int = PERCENT) -> np.ndarray:
    """Size up to which a set can be similar to one of n shingles, if a common shingle at this place of the global order
    is one of the first ``matches`` common ones."""
    return (n - places + matches - 1) * (100 + percent) // percent - n


def bitmap(shingles: np.ndarray, longs: int) -> list[int]:
    """Parity of the shingles in 64 * longs cells: cells that differ bound the symmetric difference."""
    cells = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % (64 * longs), minlength=64 * longs) & 1
    return np.packbits(cells.astype(np.uint8)).view(">i8").tolist()


def _mapped(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], ddl: str) -> DataFrame:
    schema = T.StructType.fromDDL(ddl)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, work = to_arrow_schema(schema), make()
        for b in pieces(batches):
            for columns in work(b):
                yield pa.RecordBatch.from_arrays([pa.array(columns[c], arrow.field(c).type) for c in names], schema=arrow)
        for columns in getattr(work, "last", list)():
            yield pa.RecordBatch.from_arrays([pa.array(columns[c], arrow.field(c).type) for c in names], schema=arrow)

    return bound_batches(df).mapInArrow(run, schema)


class _Describe:
    """Pass 1: (doc_id, n, key, other) rows, and at the end the sketch cells that stand out in this task."""

    def __init__(self, words: int, keys: Keys):
        self.words, self.keys, self.cells = words, keys, np.zeros(1 << SKETCH_BITS, np.int32)

    def __call__(self, batch: pa.RecordBatch) -> Iterator[dict]:
        n, keys, others = [], [], []
        for s in shingle_sets(batch.column("text"), self.words):
            n.append(len(s))
            keys.append(self.keys.first(s) if len(s) else None)
            others.append(other_key(s) if len(s) else None)
            if len(s):
                self.cells[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)] += 1  # documents, not shingles
        yield {"doc_id": batch.column("doc_id"), "n": n, "key": keys, "other": others, "mark": batch.column("mark"), "cell": [None] * len(n), "count": [None] * len(n)}

    def last(self) -> Iterator[dict]:
        mean = self.cells.mean()  # cells of rare shingles only are about Poisson
        out = np.flatnonzero(self.cells >= mean + 6 * np.sqrt(mean) + 6)
        if len(out):
            none = [None] * len(out)
            yield {"doc_id": none, "n": none, "key": none, "other": none, "mark": none, "cell": out, "count": self.cells[out]}


def _counter(table: dict[int, int]) -> Callable[[np.ndarray], np.ndarray]:
    dense = np.zeros(1 << SKETCH_BITS, np.int64)
    if table:
        dense[list(table)] = list(table.values())
    return lambda s: dense[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]


def _postings(docs: DataFrame, table: dict[int, int], words: int, percent: int, key_of: Keys, frequent: int) -> DataFrame:
    """Pass 2: (shingle, key, size, alone) for each prefix shingle; size holds n, the required matches and the place in the
    prefix in one number (see _unpacked), alone marks a frequent shingle by the key."""

    def make():
        counts, seen = _counter(table), set()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            shingles, keys, sizes, alone = [], [], [], []
            for s in shingle_sets(batch.column("text"), words):
                if not len(s):
                    continue
                key = key_of(s)
                if key in seen:  # a copy in the same task has the same postings
                    continue
                if len(seen) > SEEN_CLASSES:
                    seen.clear()
                seen.add(key)
                p, f, matches = prefix_of(s, counts, percent)
                places = np.arange(len(p))
                k = int(np.searchsorted(-largest_partner(len(s), places, matches, percent) * 100, -percent * len(s), "right"))  # later places fit nobody
                shingles.append(p[:k])
                keys.append(np.full(k, key, np.int64))
                sizes.append((8 * len(s) + matches << PLACE_BITS) + places[:k])
                alone.append(np.where(f[:k] >= frequent, key, 0))
            if keys:
                yield {"shingle": np.concatenate(shingles).view(np.int64), "key": np.concatenate(keys), "size": np.concatenate(sizes), "alone": np.concatenate(alone)}

        return work

    return _mapped(docs.select("text"), make, "shingle long, key long, size long, alone long")


def _unpacked(size: Column) -> tuple[Column, Column, Column]:
    """(n, matches, place) of a posting; they take least room in a shuffle as one number, which also sorts by n."""
    return F.shiftright(size, PLACE_BITS + 3), F.shiftright(size, PLACE_BITS) % 8, size.bitwiseAND((1 << PLACE_BITS) - 1)


def _shared(posts: DataFrame, percent: int) -> DataFrame:
    """(shingle, key, matches, most) for the prefix shingles that a class has in common with another one of fitting size,
    of classes that have enough of them.

    In the order of sizes, a class has a fitting partner only if the next or the previous one fits, and only if it is
    no larger than the group's largest ``most`` and its own is no smaller than the group's least size. Frequent shingles are not grouped: each posting of one stands for
    itself and counts as shared.
    """
    same = Window.partitionBy("shingle", "alone")
    by_size = same.orderBy("size", "key")
    n = lambda c: _unpacked(c)[0]
    own, matches, place = _unpacked(F.col("size"))
    most = F.floor((own - place + matches - 1) * (100 + percent) / percent) - own
    # dealt out before the derived columns are made, which would travel with the rows otherwise
    seen = posts.repartition("shingle", "alone").select(
        "*",
        matches.cast("int").alias("matches"),
        most.alias("most"),
        F.min("key").over(same).alias("low"),
        F.max("key").over(same).alias("high"),
        F.min(matches.cast("int")).over(same).alias("least"),
        F.max(most).over(same).alias("top"),
        F.min("size").over(same).alias("lightest"),
        F.lag("size").over(by_size).alias("smaller"),
        F.lead("size").over(by_size).alias("larger"),
    )
    fits = (n(F.col("smaller")) * 100 >= n(F.col("size")) * percent) | (n(F.col("size")) * 100 >= n(F.col("larger")) * percent)
    fits = fits & (F.col("top") >= n(F.col("size"))) & (F.col("most") >= n(F.col("lightest")))
    kept = seen.filter((F.col("alone") != 0) | ((F.col("low") != F.col("high")) & F.coalesce(fits, F.lit(False))))
    often = F.col("alone") != 0
    kept = kept.select("shingle", "key", "matches", "most", F.when(often, 1).otherwise(F.col("least")).alias("least"), F.when(often, n(F.col("size"))).alias("n"))
    kept = kept.groupBy("shingle", "key").agg(F.min("matches").alias("matches"), F.max("most").alias("most"), F.min("least").alias("least"), F.min("n").alias("n"))
    whole = stored(kept, "shared")
    limits = whole.filter("n IS NOT NULL").groupBy("shingle").agg(F.min("n").alias("lightest"), F.max("most").alias("top"))
    fit = whole.filter("n IS NOT NULL").join(limits, "shingle").filter("most >= lightest AND top >= n")
    kept = whole.filter("n IS NULL").drop("n").unionByName(fit.drop("n", "lightest", "top"))
    enough = kept.groupBy("key").agg(F.count("*").alias("n"), F.min("least").alias("least")).filter("n >= least").select("key")
    found = stored(kept.select("shingle", "key", "matches", "most").join(enough, "key", "left_semi"), "postings")
    dropped(whole)
    return found


def _id_filter(ids: DataFrame) -> tuple[np.ndarray, bool]:
    """(bits as 64-bit words: which remainders the doc_ids have, whether there are too many ids for it)."""
    n = ids.count()
    size = min(FILTER_BITS, 1 << max(16, (16 * n).bit_length()))
    bit = F.pmod("doc_id", F.lit(size))
    words = ids.select(F.floor(bit / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out, 4 * n > size


def _of_some(docs: DataFrame, classes: DataFrame, keys: DataFrame, words: int, key_of: Keys, fields: str, values: Callable[[np.ndarray], tuple]) -> DataFrame:
    """key and values for the first documents of the classes in keys; a few others come along.

    One scan of the texts; a task computes shingles only for ids that the filter lets through.
    """
    ids = stored(classes.join(keys, "key", "left_semi").select(F.col("first").alias("doc_id")), "ids")
    bits, many = _id_filter(ids)
    names = ["key", *[f.split()[0] for f in fields.split(", ")]]

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            own = batch.column("doc_id").to_numpy(zero_copy_only=False) % (64 * len(bits))
            keep = np.flatnonzero((bits[own // 64] >> (own % 64)) & 1)
            found = shingle_sets(batch.column("text").take(pa.array(keep)), words)
            rows = [(key_of(s), *values(s)) for s in found if len(s)]
            if rows:
                yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

        return work

    source = docs.filter(F.col("doc_id").isNotNull())
    return _mapped(source.join(ids, "doc_id", "left_semi") if many else source, make, f"key long, {fields}")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int, key_of: Keys) -> DataFrame:
    """The pairs (a, b) whose sets are similar, tested exactly."""
    pairs = stored(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    sets = _of_some(docs, classes, ends, words, key_of, "shingles binary", lambda s: (s.tobytes(),)).join(ends, "key", "left_semi").dropDuplicates(["key"])
    sets = stored(sets, "sets")
    one, two = (sets.select(F.col("key").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b")

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            out = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(np.flatnonzero(out))
            yield {"a": batch.column("a").take(keep), "b": batch.column("b").take(keep)}

        return work

    links = stored(_mapped(both.select("a", "b", "set_a", "set_b"), make, "a long, b long"), "links")
    dropped(pairs, sets)
    return links


def _most_different(percent: int) -> Column:
    """How many shingles the symmetric difference of similar sets x_* and y_* can have at most."""
    total = F.col("x_n") + F.col("y_n")
    return total - 2 * F.ceil(total * percent / (100 + percent))


def _may_be_similar(percent: int) -> Column:
    """Whether columns x_* and y_* pass the length bound and the short bitmap's bound."""
    differ: Column = sum((F.bit_count(F.col(f"x_b{i}").bitwiseXOR(F.col(f"y_b{i}"))) for i in range(BITMAP_LONGS)), F.lit(0))
    return (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent) & (differ <= _most_different(percent))


def _narrowed(pairs: DataFrame, meta: DataFrame, percent: int) -> DataFrame:
    """The pairs (x_key, y_key) that pass the length bound and the wide bitmap's bound, as (a, b)."""
    own = meta.select("key", "n", "wide")
    known = pairs.join(_sided(own, "x"), "x_key").join(_sided(own, "y"), "y_key")
    differ = F.aggregate(F.zip_with("x_wide", "y_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, c: t + c)
    close = (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent) & (differ <= _most_different(percent))
    return known.filter(close).select(F.col("x_key").alias("a"), F.col("y_key").alias("b"))


def _sided(df: DataFrame, side: str, but: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*but, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in but])


def _first_pairs(posts: DataFrame, meta: DataFrame, percent: int) -> DataFrame:
    """Each shingle's classes with the smallest of them, where the bounds hold."""
    hubs = posts.groupBy("shingle").agg(F.min("key").alias("x_key"), F.max("key").alias("top")).filter("x_key <> top").drop("top")
    pairs = posts.select("shingle", F.col("key").alias("y_key")).join(hubs, "shingle").filter("x_key <> y_key").select("x_key", "y_key").distinct()
    return _narrowed(pairs, meta, percent)


def _cross_pairs(posts: DataFrame, labels: DataFrame, meta: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that pass the bounds and share enough prefix shingles."""
    placed = posts.join(labels.select(F.col("id").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    placed = stored(placed, "placed")
    shares = placed.groupBy("shingle", "label").agg(F.count("*").alias("c"))
    mixed = shares.groupBy("shingle").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1").drop("labels")
    of = stored(placed.join(mixed, "shingle").join(meta.drop("wide"), "key"), "mixed")
    # A pair meets at each common prefix shingle, from the side that is outside its main component.
    left = _sided(of, "x", ("shingle", "main")).filter("x_label <> main")
    right = _sided(of.drop("main"), "y", ("shingle",))
    match = (
        (left["shingle"] == right["shingle"])
        & (F.col("x_label") != F.col("y_label"))
        & ((F.col("y_label") == F.col("main")) | (F.col("x_key") < F.col("y_key")))
        & (F.col("y_n") <= F.col("x_most"))
        & (F.col("x_n") <= F.col("y_most"))
        & _may_be_similar(percent)
    )
    met = left.join(right, match).select(F.least("x_key", "y_key").alias("x"), F.greatest("x_key", "y_key").alias("y"), F.least("x_matches", "y_matches").alias("needed"))
    often = met.groupBy(F.col("x").alias("x_key"), F.col("y").alias("y_key")).agg(F.count("*").alias("n"), F.min("needed").alias("needed"))
    return _narrowed(often.filter("n >= needed").select("x_key", "y_key"), meta, percent)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, key_bits: int = 64, frequent: int = FREQUENT, mark: str | None = None
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) for every row of docs.

    ``mark`` names a long column that is carried along, with class_key: equal for rows of one set.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.col(mark) if mark else F.lit(None)).cast("long").alias("mark"))
    fields = "doc_id long, n long, key long, other long, mark long, cell int, count long"
    described = stored(_mapped(source, lambda: _Describe(words, Keys(key_bits)), fields), "described")
    cells = described.filter("cell IS NOT NULL").groupBy("cell").agg(F.sum("count").alias("count")).collect()
    table = {r["cell"]: r["count"] for r in cells}
    rows = described.filter("cell IS NULL").select("doc_id", "n", "key", "other", "mark")
    known = rows.filter("key IS NOT NULL AND doc_id IS NOT NULL")
    sums = lambda df: stored(df.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("other").alias("low"), F.max("other").alias("high")), "classes")
    classes = sums(known)
    key_of = Keys(key_bits, frozenset(r["key"] for r in classes.filter("low <> high").select("key").collect()))  # n * n / 2**65 of n classes
    if key_of.collided:
        both = F.when(F.col("key").isin(*key_of.collided), F.col("other")).otherwise(F.col("key"))
        rows = rows.withColumn("key", both)
        classes = sums(known.withColumn("key", both))

    posts = _shared(_postings(source, table, words, percent, key_of, frequent), percent)
    longs = [f"b{i}" for i in range(BITMAP_LONGS)]
    meta = _of_some(source, classes, posts.select("key").distinct(), words, key_of, "n int, wide array<long>, " + ", ".join(f"{c} long" for c in longs), lambda s: (len(s), bitmap(s, WIDE_LONGS), *bitmap(s, BITMAP_LONGS)))
    meta = stored(meta.dropDuplicates(["key"]), "bitmaps")
    first = _verified(_first_pairs(posts, meta, percent), source, classes, words, percent, key_of)
    labels = components(first)
    cross = _verified(_cross_pairs(posts, labels, meta, percent), source, classes, words, percent, key_of)
    dropped(posts, meta)
    ends = [cross.join(labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")), c, "left").select("a", "b", F.coalesce(f"l{c}", c).alias(c + c)) for c in "ab"]
    joined = components(ends[0].join(ends[1], ["a", "b"]).select(F.col("aa").alias("a"), F.col("bb").alias("b")))
    last = labels.select("id", "label").union(cross.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("label")))
    last = last.join(joined.select(F.col("id").alias("label"), F.col("label").alias("final")), "label", "left").select(F.col("id").alias("key"), F.coalesce("final", "label").alias("label"))

    last = stored(last, "last")
    smallest = stored(last.join(classes, "key").groupBy("label").agg(F.min("first").alias("component_id")), "smallest")
    linked = last.join(smallest, "label").select("key", "component_id")
    named = stored(classes.join(linked, "key", "left").select("key", F.coalesce("component_id", "first").alias("component_id")), "named")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    carried = [F.col("mark").alias(mark), F.col("key").alias("class_key")] if mark else []
    return rows.join(named, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), component, *carried)
