"""Whitening of vectors by shifted CholeskyQR.

The distinct vectors, in whole steps and centred exactly, are a tall matrix that stays where Spark put it. Every pass sums
the small Gram matrix of its rows over all tasks, factors it, and turns the rows by a triangular solve; the first passes
add a shift that keeps the factor defined however alike the columns are, and the last ones make the rows orthonormal to
double precision. The product of the factors is the matrix's R, whose singular values and vectors give the components.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import stored

STEPS, BASE = 64, 1_000_000        # an entry c counts as floor(STEPS * c) + BASE
FAR = float(1 << 61)               # larger entries count as this many steps
PASSES = 12                        # CholeskyQR passes at most; three are usual
NOTHING = 1e-12                    # components below this share of the largest singular value have no direction of their own
EPS = np.finfo(float).eps / 2


def usable(vec_col: str) -> Column:
    """Whether a vector has entries and none of them is null or not finite."""
    vec = F.col(vec_col).cast("array<double>")
    broken = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~broken


def in_steps(vec_col: str) -> Column:
    def step(c: Column) -> Column:
        return F.least(F.greatest(F.floor(F.lit(float(STEPS)) * c.cast("double")).cast("double"), F.lit(-FAR)), F.lit(FAR)).cast("long") + F.lit(BASE)
    return F.transform(vec_col, step)


def _rows(batch: pa.RecordBatch, i: int) -> np.ndarray:
    column = batch.column(i)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exactly: in 64 bits where they suffice, else as Python integers."""
    if x.size and (int(np.abs(x).max()) + 1) * n + max(map(abs, sums)) >= 1 << 62:
        return n * x.astype(object) - np.array(sums, object)
    return n * x - np.array(sums, np.int64)


def squares(moved: np.ndarray) -> list[int | None]:
    """Exact sums of squares; null where one does not fit a long."""
    if moved.dtype == object or (moved.size and int(np.abs(moved).max()) ** 2 * moved.shape[1] >= 1 << 63):
        return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in moved)]
    return (moved * moved).sum(axis=1).tolist()


def gram(fit: DataFrame, turn: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over all rows ``v`` of ``turn(v) turn(v)'``; a task sends ``width`` rows of ``width`` numbers, added by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                q = turn(_rows(batch, 0))
                total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array([r.tobytes() for r in total])], ["i", "row"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for r in batch.column(1).to_pylist():
                total += np.frombuffer(r)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], ["i", "row"])

    summed = fit.select("x").mapInArrow(run, "i int, row binary").groupBy("i").applyInArrow(add, "i int, row binary")
    out = np.zeros((width, width))
    for r in summed.collect():       # as many rows as a vector has entries
        out[r["i"]] = np.frombuffer(r["row"])
    return (out + out.T) / 2


class Turn:
    """Centred rows, turned by triangular solves with the factors found so far."""

    def __init__(self, n: int, sums: list[int], factors: list[np.ndarray]):
        self.n, self.sums, self.factors = n, sums, factors

    def __call__(self, x: np.ndarray) -> np.ndarray:
        q = deviations(x, self.n, self.sums).astype(float) / self.n
        for r in self.factors:
            q = np.linalg.solve(r.T, q.T).T
        return q


def triangular(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """``R`` with ``R'R`` the Gram matrix of the centred rows, composed of the factors of all passes."""
    d = len(sums)
    factors: list[np.ndarray] = []
    whole = np.eye(d)
    for turn in range(PASSES):
        g = gram(fit, Turn(n, sums, factors), d)
        size = np.linalg.eigvalsh(g)
        if size[-1] <= 0:
            return np.zeros((d, d))
        rough = turn == 0 or size[0] < 0.5           # not orthonormal yet, or columns that depend on others
        if rough and turn and np.all((size < 1e-6) | (np.abs(size - 1) < 1e-6)):
            # dependent columns have been turned to nothing, the others are orthonormal but for the shift
            value, vector = np.linalg.eigh(g)
            return (np.sqrt(np.maximum(value, 0))[:, None] * vector.T) @ whole
        shift = 11 * (n * d + d * (d + 1)) * EPS * size[-1] if rough else 0.0
        # beyond some billion rows the bound on rounding says more than what pairwise sums do
        r = np.linalg.cholesky(g + min(shift, 1e-4 * size[-1]) * np.eye(d)).T
        whole = r @ whole
        if not rough and np.abs(g - np.eye(d)).max() < 1e-12:
            break
        factors.append(r)
    return whole


def components(fit: DataFrame, n: int, sums: list[int], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors (as columns), their variances and their shares of the whole variance, largest first."""
    _, sigma, vt = np.linalg.svd(triangular(fit, n, sums))
    some = sigma > (sigma[0] if len(sigma) else 0) * NOTHING
    keep = int(some[:most].sum())
    variance = sigma ** 2 / n
    return vt[:keep].T, variance[:keep], variance[:keep] / max(variance.sum(), np.finfo(float).tiny)


def whitened(df: DataFrame, most: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``, a row for each row of ``df`` and component.

    Entries count as whole steps (see ``STEPS``). The components are fitted on each distinct vector once: ``n`` vectors. Rows
    with a null or empty vector, or null or non-finite entries, have no result; all others have one, repeated rows and null ids
    included. Vectors of different lengths are fitted apart. Directions without variance are no components: a table of one
    vector or none gives no rows. Entries beyond 2**61 steps count as 2**61; a deviation beyond a long is null. Other columns
    are ignored."""
    rows = df.filter(usable(vec_col)).select(F.col(id_col).alias("id"), in_steps(vec_col).alias("x"))
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = stored(rows.select("x").distinct())
    # one row for each length of vectors and place in them
    places = (fit.select(F.size("x").alias("d"), F.posexplode("x")).groupBy("d", "pos")
              .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).orderBy("d", "pos").collect())
    out = None
    for d in sorted({r["d"] for r in places}):
        n, sums = next(r["n"] for r in places if r["d"] == d), [int(r["s"]) for r in places if r["d"] == d]
        own = fit.filter(F.size("x") == d)
        part = _applied(rows.filter(F.size("x") == d), n, sums, *_checked(own, n, sums, most), names, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], schema)


def _checked(fit: DataFrame, n: int, sums: list[int], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The map from centred rows to whitened ones, shares of variance, and how far the fit list's covariance is from identity."""
    vectors, variance, share = components(fit, n, sums, most)
    into = vectors / np.sqrt(variance)
    if not into.shape[1]:
        return into, share, 0.0
    centred = Turn(n, sums, [])
    got = gram(fit, lambda x: centred(x) @ into, into.shape[1]) / n
    return into, share, float(np.abs(got - np.eye(len(got))).max())


def _applied(rows: DataFrame, n: int, sums: list[int], into: np.ndarray, share: np.ndarray, error: float, names: list[str], schema: str) -> DataFrame:
    k = into.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m or not k:
                continue
            moved = deviations(_rows(batch, 1), n, sums)
            made = moved.astype(float) / n @ into
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array(squares(moved), pa.int64()).take(pa.array(each)), pa.array(made.ravel()), pa.array(np.tile(share, m)),
                pa.array(np.full(m * k, error))], names)

    return rows.mapInArrow(run, schema)
