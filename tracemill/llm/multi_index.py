"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

A bounded sample of the vectors fixes the code: centred unit vectors are turned onto their principal axes and then by
the rotation whose signs lose least (iterative quantization); the signs are the bits. The sample also fixes the
Hamming radius: the one within which TARGET of the sample's own nearest neighbours lie.

Codes are split into substrings. By the pigeonhole principle two codes within radius r differ by at most r // m in
one of the m substrings, by less in most, so a query probes each substring's index with all values that near and
retrieves every code within the radius; these are ranked by cosine over the original vectors, in double precision.

All vectors are dealt into shards of bounded size. A shard's index lives in one task: its rows come first, then all
queries stream past it in batches, so memory holds a shard and a batch. Queries for which fewer than k candidates
lie within the radius are asked again with a radius that takes in every code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import bound_batches, stored
from tracemill.llm.vectors import common_length, finite_vectors

#: Vectors that the code and the radius are learned on, and those of them whose neighbours are looked up for it.
SAMPLE_ROWS, SAMPLE_QUERIES = 8_192, 512
#: Share of the sample's nearest neighbours within the radius; among more vectors the nearest are nearer.
TARGET = 0.97
BITS, SUBSTRINGS, TURNS = 64, 4, 40
#: A shard's vectors in memory, and the least rows of a shard where there are enough for several.
SHARD_BYTES, SHARD_ROWS = 64 << 20, 4_096
FOUND = "query_id long, vec_id long, score double"


class Code(NamedTuple):
    """bits of x: signs of (unit(x) - mean) @ axes; substrings: bit positions from and to; radius: that of a search."""

    mean: np.ndarray
    axes: np.ndarray
    cuts: tuple[int, ...]
    radius: int


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def bits(code: Code, x: np.ndarray) -> np.ndarray:
    """(rows, bits) of booleans."""
    return (x / norms(x)[:, None] - code.mean) @ code.axes > 0


def substrings(code: Code, of: np.ndarray) -> np.ndarray:
    """(rows, substrings) of the values of each row's substrings."""
    return np.stack([of[:, a:b] @ (1 << np.arange(b - a)) for a, b in zip(code.cuts, code.cuts[1:], strict=False)], axis=1).astype(np.int64)


def learn(sample: np.ndarray, k: int, target: float = TARGET, seed: int = 7) -> Code:
    """The code of a sample (scaled rows), and the radius that holds ``target`` of its k nearest neighbours each."""
    rng = np.random.default_rng(seed)
    unit = sample / norms(sample)[:, None]
    mean = unit.mean(axis=0)
    centred = unit - mean
    width = min(BITS, sample.shape[1])
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :width]
    flat = centred @ axes
    turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
    for _ in range(TURNS):
        left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (left @ right).T
    cuts = tuple(int(c) for c in np.linspace(0, width, min(SUBSTRINGS, width) + 1).round())
    code = Code(mean, axes @ turn, cuts, width)
    if len(sample) > 1:
        signs = bits(code, sample)
        ask = rng.permutation(len(sample))[:SAMPLE_QUERIES]
        near = unit[ask] @ unit.T
        near[np.arange(len(ask)), ask] = -np.inf
        best = np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]
        away = (signs[ask][:, None, :] != signs[best]).sum(axis=2)
        code = code._replace(radius=int(np.quantile(away, target, method="higher")))
    return code


def radii(radius: int, m: int) -> list[int]:
    """How far to probe in each of m substrings (-1: not at all) to retrieve every code within the radius.

    With radius = m * t + a, codes that differ by more than t in the first a + 1 substrings and by more than t - 1, so
    by t at least, in the others differ by (a + 1) * (t + 1) + (m - a - 1) * t = radius + 1 at least.
    """
    t, a = divmod(radius, m)
    return [t if s <= a else t - 1 for s in range(m)]


def values_within(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``radius`` ones."""
    every = np.arange(1 << width, dtype=np.int64)
    return every[np.bitwise_count(every) <= radius]


class Shard:
    """The index of a shard: for each substring, its rows sorted by value and where each value begins."""

    def __init__(self, code: Code, ids: np.ndarray, x: np.ndarray):
        """ids: integers by which ties are broken; x: scaled rows."""
        self.code, self.ids, self.x, self.norms = code, ids, x, norms(x)
        self.parts = substrings(code, bits(code, x))
        self.index, self.masks = [], []
        for s, (a, b) in enumerate(zip(code.cuts, code.cuts[1:], strict=False)):
            order = np.argsort(self.parts[:, s], kind="stable")
            self.index.append((order, np.searchsorted(self.parts[order, s], np.arange((1 << (b - a)) + 1))))
            self.masks.append(values_within(b - a, radii(code.radius, len(code.cuts) - 1)[s]))

    def within(self, parts: np.ndarray) -> np.ndarray:
        """The rows whose codes lie within the radius of a query's."""
        hit = np.zeros(len(self.ids), bool)
        for s, ((order, starts), masks) in enumerate(zip(self.index, self.masks, strict=True)):
            values = masks ^ parts[s]
            begin, count = starts[values], starts[values + 1] - starts[values]
            begin, count = begin[count > 0], count[count > 0]
            hit[order[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.parts[rows] ^ parts).sum(axis=1) <= self.code.radius]

    def nearest(self, own: int, q: np.ndarray, parts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest rows within the radius, but for those with the query's own id."""
        rows = self.within(parts)
        rows = rows[self.ids[rows] != own]
        score = (self.x[rows] * q).sum(axis=1) / (self.norms[rows] * norms(q[None])[0])
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return scaled(flat.reshape(batch.num_rows, -1))


def _searcher(model: Callable[[], Code], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by shard, and within it candidates before queries: what each query finds in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, at, held, shard = model(), None, [], None
        for batch in batches:
            group = batch.column("shard").to_numpy() * 2 + batch.column("query").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                ids = piece.column("vec_id").to_numpy()
                if group[a] // 2 != at:
                    at, held, shard = group[a] // 2, [], None
                if group[a] % 2 == 0:
                    held.append((ids, _matrix(piece)))
                    continue
                if shard is None:
                    if not held:  # a shard without candidates
                        continue
                    shard, held = Shard(code, np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held])), held[:1]
                x = _matrix(piece)
                found = [shard.nearest(i, q, p, k) for i, q, p in zip(ids, x, substrings(code, bits(code, x)), strict=True)]
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(ids, [len(i) for i, _ in found]), "vec_id": np.concatenate([i for i, _ in found]), "score": np.concatenate([s for _, s in found])})

    return run


def _search(candidates: DataFrame, queries: DataFrame, code: Code, k: int, shards: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of the candidates within the code's radius, for each query."""
    shared = candidates.sparkSession.sparkContext.broadcast(code)  # 64 numbers a dimension
    every = queries.select("vec_id", "vector", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    rows = candidates.select("vec_id", "vector", F.lit(False).alias("query"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"))
    dealt = rows.unionByName(every).repartition(shards, "shard").sortWithinPartitions("shard", "query")
    found = bound_batches(dealt).mapInArrow(_searcher(lambda: shared.value, k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(df: DataFrame, asks, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row for which ``asks`` (a column of vec_id) holds.

    Candidates are all rows with another id than the query's. Nearness is the cosine; ties go to the smaller id. Null,
    empty and zero vectors, those with null or non-finite entries, rows without an id and vectors of another length than
    most have take no part. Rows with an id and a vector that came before count once; of an id with several vectors each
    is a candidate, and the smallest vector is the query. A query has fewer than k rows only if there are fewer
    candidates. Of equal vectors only the k + 1 smallest ids can be among anyone's nearest, so the others are set aside.
    """
    rows = finite_vectors(df, id_col, vector_col).filter(F.col("vec_id").isNotNull() & F.exists("vector", lambda c: c != 0))
    d, _ = common_length(rows)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").filter(F.size("vector") == d)
    rows = stored(rows.withColumn("hash", F.xxhash64("vector")).select("vec_id", "hash", "vector").distinct(), "vectors")
    equal = F.row_number().over(Window.partitionBy("hash", "vector").orderBy("vec_id"))
    candidates = stored(rows.withColumn("copy", equal).filter(F.col("copy") <= k + 1).select("vec_id", "vector"), "candidates")
    queries = rows.filter(asks).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    sample = candidates.orderBy(F.xxhash64("vec_id"), "vector").limit(SAMPLE_ROWS).select("vector").toArrow()  # SAMPLE_ROWS vectors at most
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample.num_rows:
        return empty
    code = learn(scaled(sample.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)), k, target)
    n = candidates.count()
    tasks = df.sparkSession.sparkContext.defaultParallelism
    shards = max(-(-n * d * 8 // SHARD_BYTES), min(2 * tasks, -(-n // SHARD_ROWS)))
    found = stored(_search(candidates, queries, code, k, shards), "found")
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = stored(queries.join(full, "vec_id", "left_anti"), "short")
    if not short.isEmpty():
        enough = found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi")
        found = enough.unionByName(_search(candidates, short, code._replace(radius=code.cuts[-1]), k, shards))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
