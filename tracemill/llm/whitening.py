"""Whitening of embeddings: exact integer means, MLlib's Gramian of exactly centred rows, eigenvectors, projection.

Entries become integers x = floor(64 * entry) + 1,000,000, so counts and sums are exact. With S the sum over all n
rows of a dimension, S = q * n + r, a centred entry is (x - q) - r / n: the integer part is exact, and no large number
is ever squared, however far the mean lies from zero. The covariance is the Gramian of these rows divided by n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import bound_batches, stored
from tracemill.llm.vectors import common_length, finite_vectors

SCALE, OFFSET = 64, 1_000_000
#: Scaled entries beyond this size count as this size, so that sums stay within 64 bits.
LARGEST = float(1 << 40)
SCHEMA = "vec_id string, deviation long, whitened array<double>"


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of every dimension; each task sends d partial sums."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, np.int64)
        for b in batches:
            n += b.num_rows
            total += b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": np.arange(d, dtype=np.int32), "n": np.full(d, n, np.int64), "s": total})

    parts = bound_batches(rows.select("x")).mapInArrow(partial, "dim int, n long, s long")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim").collect()  # d rows
    return (found[0]["n"], [r["s"] for r in found]) if found else (0, [])


def _covariance(rows: DataFrame, n: int) -> np.ndarray:
    """X'X / n of the rows' arrays ``v``, which have a mean of zero."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("v").alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray() / n


def principal(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` eigenvalues, falling, and their unit eigenvectors as columns, largest entry positive."""
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return values, axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)


def deviations(x: np.ndarray, q: np.ndarray, r: np.ndarray, n: int) -> list[int | None]:
    """Sum of (n * x - S) ** 2 over each row of x, exactly; None where it does not fit in a long.

    64-bit arithmetic is exact modulo 2 ** 64, so its result holds wherever the true sum is below 2 ** 63; doubles tell
    where that is, and the few rows too near to that bound to tell are summed in Python's integers.
    """
    away = x - q
    wrapped = ((away * np.int64(n) - r) ** 2).sum(axis=1)
    about = ((away.astype(float) * n - r) ** 2).sum(axis=1) / 2.0**63
    out: list[int | None] = [int(v) if fits else None for v, fits in zip(wrapped, about < 1 - 1e-9, strict=True)]
    for i in np.flatnonzero((about >= 1 - 1e-9) & (about <= 1 + 1e-9)):
        exact = sum((int(a) * n - int(b)) ** 2 for a, b in zip(away[i], r, strict=True))
        out[i] = exact if exact < 1 << 63 else None
    return out


def whiten(df: DataFrame, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Null and empty vectors, and those with null or non-finite entries, take no part, nor do vectors of another length
    than most have. Null and repeated ids stay: each row is whitened by itself. Components without variance (fewer
    independent dimensions than components, equal rows, a single row) have null as whitened, and 0 as explained (null if
    nothing varies); identity_error is over the others (null if there are none). deviation is null where it exceeds a
    long. Without vectors there are no rows. Scaled entries beyond LARGEST count as LARGEST.
    """
    kind = df.schema[id_col].dataType
    rows = finite_vectors(df, id_col, vector_col)
    d, n = common_length(rows)
    scaled = F.transform("vector", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))).cast("long") + OFFSET)
    x = rows.filter(F.size("vector") == d).select(F.col("vec_id").cast("string").alias("vec_id"), scaled.alias("x"))
    empty = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return df.sparkSession.createDataFrame([], empty.format(kind.simpleString()))
    n, sums = _sums(x, d)
    q, r = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    whole, part = F.array(*[F.lit(int(v)) for v in q]), F.array(*[F.lit(float(v) / n) for v in r])
    centred = x.select(F.transform("x", lambda c, i: (c - whole[i]).cast("double") - part[i]).alias("v"))
    covariance = _covariance(centred, n)
    values, axes = principal(covariance, min(most, d))
    trace, k = float(np.trace(covariance)), len(values)
    real = values > max(values[0], 0.0) * d * np.finfo(float).eps * 4
    shared = df.sparkSession.sparkContext.broadcast((axes / np.sqrt(np.where(real, values, 1.0)), q, r, n))  # d x most doubles

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, q, r, n = shared.value
        for frame in frames:
            x = np.stack(frame["x"].to_numpy()).astype(np.int64) if len(frame) else np.zeros((0, len(q)), np.int64)
            white = ((x - q) - r / n) @ turn
            yield pd.DataFrame({"vec_id": frame["vec_id"], "deviation": pd.Series(deviations(x, q, r, n), dtype="Int64"), "whitened": list(white)})

    white = stored(bound_batches(x).mapInPandas(project, SCHEMA), "whitened")
    some = [int(i) for i in np.flatnonzero(real)]
    error = None
    if some:
        kept = white.select(F.array(*[F.col("whitened")[i] for i in some]).alias("v"))
        error = float(np.abs(_covariance(kept, n) - np.eye(len(some))).max())
    shares = F.array(*[F.lit(float(v) / trace if trace > 0 and ok else 0.0 if trace > 0 else None).cast("double") for v, ok in zip(values, real, strict=True)])
    varies = F.array(*[F.lit(bool(v)) for v in real])
    out = white.select("vec_id", "deviation", F.posexplode(F.slice("whitened", 1, k)).alias("i", "value"))
    return out.select(
        F.col("vec_id").cast(kind).alias("vec_id"),
        (F.col("i") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(varies[F.col("i")], F.col("value")).alias("whitened"),
        shares[F.col("i")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
