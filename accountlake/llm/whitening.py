"""Whitening of vectors by shifted CholeskyQR over distributed Gram passes.

Vectors become integers, are centred exactly and scaled once. Every pass reads the table anew: tasks solve
their centred rows against the triangular factors found so far, add up the products of what
comes out, and the sums of all tasks meet in a tree. The Cholesky factor of that Gram matrix (shifted while the
matrix is not safely positive) is the next factor. After a few passes the rows are orthonormal
to double precision, although the Gram matrix of the rows themselves would lose half of the digits. The product of
the factors is R; its singular vectors are the components, its squared singular values over n the eigenvalues.

What reaches the driver are sums of one row per dimension and at most ``FAN`` Gram matrices: it is bounded by the
square of the dimension, whatever the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accountlake.llm.common import pick, saved, shipped

SCALE, OFFSET = 1024, 100_000  # a vector's entries become whole numbers: floor(SCALE * entry) + OFFSET
LIMIT = 1 << 62  # larger entries count as this
PASSES = 6  # Gram passes at most
FAN = 16  # partial sums that one task, or the driver, adds up
EPS = np.finfo(np.float64).eps
NOTHING = 1e-20  # a variance below this share of the whole is none


@dataclass
class Whitening:
    """Rows, exact sums per dimension, unit components in rows by falling eigenvalue, the trace, and the error found."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def scales(self) -> np.ndarray:
        """What a projection is multiplied by; NaN for a component without variance."""
        live = self.eigenvalues > NOTHING * self.trace
        return np.where(live, 1 / np.sqrt(np.where(live, self.eigenvalues, 1)), np.nan)

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) if self.trace > 0 else 0.0 for e in self.eigenvalues]


def _numbers(df: DataFrame) -> DataFrame:
    """``df`` with its column ``vector`` as an array of floats or doubles."""
    kind = df.schema["vector"].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        return df
    return df.withColumn("vector", F.col("vector").cast("array<double>"))


def _usable(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries as doubles, where each row begins, its length (-1: null, or an entry is null or not finite)."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    there = column.is_valid().to_numpy(zero_copy_only=False)
    good = there & (wrong[offsets[1:]] == wrong[offsets[:-1]])
    return values, offsets[:-1], np.where(good, np.diff(offsets), -1)


def _whole(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable rows of ``size`` entries, and their entries as whole numbers."""
    values, starts, lengths = _usable(column)
    at = np.flatnonzero(lengths == size)
    entries = values[starts[at][:, None] + np.arange(size)]
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(entries * SCALE), -float(LIMIT), float(LIMIT))
    return at, np.minimum(x, np.nextafter(float(LIMIT), 0)).astype(np.int64) + OFFSET


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exactly: long where that is wide enough, else Python's whole numbers."""
    most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums), default=0)
    if most < 1 << 63:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _deviation(y: np.ndarray) -> list[int | None]:
    """Sums of squares of whole numbers, exactly; null beyond a long."""
    about = (y.astype(np.float64) ** 2).sum(axis=1)
    if y.dtype != object and about.max(initial=0) < 2.0**62:
        return (y * y).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in y.tolist()]
    return [s if s < 1 << 63 else None for s in exact]


def _solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows @ inverse(factor)`` for an upper triangular factor, column by column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _added(parts: DataFrame) -> np.ndarray | None:
    """The sum of equally long rows of doubles (``flat``), by a tree of ``FAN`` rows a task."""
    def run(batches):
        total = None
        for batch in batches:
            for flat in batch.column(0).to_pylist():
                x = np.frombuffer(flat)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["flat"])

    parts = saved(parts, "sums")
    count = parts.count()
    while count > FAN:
        parts = saved(parts.repartition(math.ceil(count / FAN)).mapInArrow(run, "flat binary"), "sums")
        count = parts.count()
    rows = parts.collect()
    return sum(np.frombuffer(r["flat"]) for r in rows) if rows else None


def _products(vectors: DataFrame, size: int, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Column sums, then the Gram matrix, of ``made`` (whole numbers) over all usable rows."""
    def run(batches: Iterator[pa.RecordBatch]):
        total = None
        for batch in batches:
            _, x = _whole(batch.column(0), size)
            if len(x):
                rows = made(x)
                part = np.concatenate([rows.sum(axis=0)[None], rows.T @ rows])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["flat"])

    flat = _added(vectors.mapInArrow(run, "flat binary"))
    if flat is None:
        return None
    width = int((math.isqrt(1 + 4 * len(flat)) - 1) // 2)  # width + width ** 2 numbers
    return flat.reshape(width + 1, width)


def common_size(vectors: DataFrame) -> int:
    """The length most of the usable vectors have (of several, the largest); 0 without vectors."""
    def run(batches):
        total: dict[int, int] = {}
        for batch in batches:
            for size, k in zip(*np.unique(_usable(batch.column(0))[2], return_counts=True), strict=True):
                total[int(size)] = total.get(int(size), 0) + int(k)
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["size", "k"])

    top = vectors.mapInArrow(run, "size long, k long").where("size > 0").groupBy("size").agg(F.sum("k").alias("k")).orderBy(
        F.desc("k"), F.desc("size")).first()
    return top["size"] if top else 0


def _sums(vectors: DataFrame, size: int) -> tuple[int, list[int]]:
    """Usable rows, and exact sums per dimension."""
    def run(batches):
        n, total = 0, np.zeros(size, object)
        for batch in batches:
            _, x = _whole(batch.column(0), size)
            n += len(x)
            for s in range(0, len(x), 2048):
                part = x[s : s + 2048]
                wide = max(int(part.max()), -int(part.min())) >= 1 << 51
                total = total + (part.astype(object) if wide else part).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()),
                 pa.array([int(t) for t in total], pa.decimal128(38, 0))], names=["i", "n", "s"])

    rows = vectors.mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").cast("string").alias("s")).orderBy("i").collect()
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


def _factor(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """An upper triangular factor of a Gram matrix, shifted in the first pass and where it is not safely positive."""
    size, norm = len(gram), float(np.linalg.norm(gram, 2))
    if not first:
        try:
            lower = np.linalg.cholesky(gram)
            if lower.diagonal().min() > math.sqrt(EPS) * lower.diagonal().max():
                return lower.T
        except np.linalg.LinAlgError:
            pass
    # The first shift is that of the method's analysis; later ones only have to cover rounding.
    shift = min(11 * (n * size + size * (size + 1)) * (EPS / 2), 1e-3) * norm if first else 10 * size * EPS * norm
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(size)).T
        except np.linalg.LinAlgError:
            shift *= 100


def fit(df: DataFrame, vector: str = "embedding", components: int = 8) -> Whitening:
    """Mean, components and eigenvalues of the covariance over all usable rows of ``df``.

    A row without usable vector (null; an entry null or not finite; a length that is not the table's most frequent one)
    takes no part. Repeated rows count each. Without rows the result has no components; with one row, or equal
    ones, all variances are 0. Directions without variance come last, in any order.
    """
    vectors = _numbers(pick(df, vector).toDF("vector"))
    size = common_size(vectors)
    n, sums = _sums(vectors, size) if size else (0, [])
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    factors: list[np.ndarray] = []
    for turn in range(PASSES):
        sent = shipped(df.sparkSession, factors)

        def made(x, sent=sent):
            rows = _centred(x, n, sums).astype(np.float64) / n
            for f in sent():
                rows = _solved(rows, f)
            return rows

        gram = _products(vectors, size, made)[1:]
        if turn == 0:
            trace = float(np.trace(gram)) / n
            if not trace:
                break
        elif np.abs(gram - np.eye(size)).max() < 16 * size * EPS:
            break
        factors.append(_factor(gram, n, turn == 0))
    if not factors:
        return Whitening(n, sums, np.eye(size)[:components], np.zeros(min(size, components)), 0.0)
    r = np.eye(size)
    for f in factors:
        r = f @ r
    _, sigma, right = np.linalg.svd(r)
    k = min(size, components)
    signs = np.sign(right[np.arange(size), np.abs(right).argmax(axis=1)])  # the largest entry is positive
    got = Whitening(n, sums, (right * signs[:, None])[:k], (sigma**2 / n)[:k], trace)
    live = int((~np.isnan(got.scales)).sum())
    flat = _products(vectors, size, lambda x: _projected(_centred(x, n, sums), got)[:, :live])
    mean = flat[0] / n
    got.identity_error = float(np.abs(flat[1:] / n - np.outer(mean, mean) - np.eye(live)).max()) if live else 0.0
    return got


def _projected(y: np.ndarray, fitted: Whitening) -> np.ndarray:
    """Whitened entries of centred rows times n."""
    return (y.astype(np.float64) / fitted.n) @ fitted.components.T * fitted.scales


def whitened(df: DataFrame, fitted: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, ``deviation`` (long) and ``whitened`` (an entry per component) of every usable row of ``df``.

    ``deviation`` is the exact sum of ``(n * x - S) ** 2`` over the dimensions, null beyond a long. An entry is null
    where the component has no variance. Null and repeated keys are kept; other columns are not read.
    """
    ids = pick(df, key).schema[0].dataType
    plain = pick(df, key, vector).toDF("key", "vector")
    sent = shipped(df.sparkSession, fitted)

    def run(batches):
        f = sent()
        for batch in batches:
            at, x = _whole(batch.column(1), len(f.sums))
            if len(at) and f.n:
                y = _centred(x, f.n, f.sums)
                w = _projected(y, f)
                k = w.shape[1]
                entries = pa.array(w.ravel(), pa.float64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at)), pa.array(_deviation(y), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * k + 1, k), pa.int32()), entries),
                ], names=["key", "deviation", "whitened"])

    rows = _numbers(plain).mapInArrow(run, f"key {ids.simpleString()}, deviation long, whitened array<double>")
    return rows.toDF(key, "deviation", "whitened")


def report(df: DataFrame, components: int = 8) -> DataFrame:
    """One row per usable vector and component, numbered from 1: its whitened entry beside what holds for all rows."""
    fitted = fit(df, components=components)
    explained = F.array(*[F.lit(x) for x in fitted.explained] or [F.lit(0.0)])
    return whitened(df, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("i")).alias("explained"), F.lit(fitted.identity_error).alias("identity_error"))
