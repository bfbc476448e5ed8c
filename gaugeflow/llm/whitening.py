"""Embedding whitening by FEAST: principal components from contour integrals.

Vectors are read as whole numbers, floor(scale * entry). The fit list holds each distinct vector once.
Its covariance (dimension x dimension, centred before multiplying) is summed up from one matrix a task.

The intervals of the spectrum come from inertia counts: a symmetric indefinite factorisation of the
covariance minus a shift tells how many eigenvalues lie above it, so the wanted ones are known to be
in the intervals before any is computed. For each interval a Spark task per quadrature node solves the
complex shifted covariance against the interval's block of vectors; the weighed sum over the nodes
projects the block on the interval's eigenvectors, Rayleigh-Ritz extracts them, and the step repeats
until the residuals are at rounding. As many must come out as the counts say, else it is an error.

What the driver holds is of the dimension squared, never of the rows. Result: one row per vector and component.

Nulls: a row whose vector is null, empty, or holds null or non-finite entries is left out, and so is one
whose length is not the commonest (of equally common ones the longest). A null id is kept, repeated rows
are rows of their own and count once in the fit list. Components without variance (beyond the rank) are left
out; with one distinct vector or an empty table there is no row. Other columns are ignored. ``deviation`` is
null where it does not fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import on_arrow, require, written

#: Quadrature nodes on the upper half circle, and rounds of projection at most.
NODES, ROUNDS = 8, 20


def whole_vectors(rows: DataFrame, key: str, column: str, scale: int = 256) -> DataFrame:
    """``key`` and x, the vectors as longs; rows without a full finite vector of the commonest length are left out."""
    entry = F.transform(F.col("c"), lambda v: v.cast("double"))
    finite = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    read = require(rows, key, column).select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("c")).select("key", entry.alias("c"))
    read = read.where("c IS NOT NULL AND size(c) > 0").where(finite)
    sizes = read.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    read = read.where(F.size("c") == (sizes["d"] if sizes else 0))
    return read.select("key", F.transform("c", lambda v: F.floor(v * float(scale)).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def _summed(rows: DataFrame, fn, name: str) -> np.ndarray | None:
    """The sum over all batches of ``fn(matrix)``; a task sends one matrix, rows of it are added up by number."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = fn(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield [np.arange(len(total), dtype=np.int32), pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * total.shape[1], pa.int32()), pa.array(total.reshape(-1), pa.float64()))]

    parts = on_arrow(rows.select(name), run, "i int, v array<double>")
    added = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not added:
        return None
    out = np.zeros((max(r["i"] for r in added) + 1, max(r["j"] for r in added) + 1))
    for r in added:
        out[r["i"], r["j"]] = r["v"]
    return out


def column_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""
    n = fit.count()
    sums = fit.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("j").collect()
    return n, [int(r["s"]) for r in sums]


def covariance(rows: DataFrame, name: str, mean: np.ndarray, n: int) -> np.ndarray:
    """Covariance with divisor n around the given mean."""

    def products(x):
        y = x - mean
        return y.T @ y

    return _summed(rows, products, name) / n


def inertia_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``: the positive pivots of a symmetric factorisation with 1x1 and 2x2 pivots of full size."""
    a = matrix - shift * np.eye(len(matrix))
    above, bound = 0, (1 + np.sqrt(17)) / 8
    while len(a):
        diagonal = np.abs(np.diag(a))
        k = int(diagonal.argmax())
        off = np.abs(np.triu(a, 1))
        r, s = divmod(int(off.argmax()), len(a))
        if not diagonal[k] and not off[r, s]:
            break
        pair = [k] if diagonal[k] >= bound * off[r, s] else [r, s]
        rest = np.delete(np.arange(len(a)), pair)
        pivot, side = a[np.ix_(pair, pair)], a[np.ix_(rest, pair)]
        # a 2x2 pivot has a negative determinant, hence one eigenvalue of each sign
        above += 1 if len(pair) == 2 else int(pivot[0, 0] > 0)
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(pivot, side.T)
        a = (a + a.T) / 2
    return above


def intervals(matrix: np.ndarray, wanted: int, apart: float = 1e-6) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), from the top down, around the ``wanted`` largest ones.

    Eigenvalues nearer to each other than ``apart`` times the norm share an interval. A border lies half the smaller gap
    to the neighbours off, so whatever is outside is at least twice as far away, however wide the spectrum is.
    """
    size = float(np.abs(matrix).sum(axis=1).max()) or 1.0
    d = len(matrix)
    tried: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in tried:
            tried[shift] = inertia_above(matrix, shift)
        return tried[shift]

    def located(k: int) -> float:
        """The k-th largest eigenvalue to a tenth of ``apart``."""
        low = max([s for s, n in tried.items() if n >= k], default=-1.01 * size)
        high = min([s for s, n in tried.items() if n < k], default=1.01 * size)
        while high - low > apart * size / 10:
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= k else (low, middle)
        return (low + high) / 2

    out: list[tuple[float, float, int]] = []
    done, gap = 0, size
    while done < min(wanted, d):
        first = last = located(done + 1)
        count = done + 1
        while (more := above(last - apart * size)) > count:
            count, last = more, located(more)
        below = last - located(count + 1) if count < d else size
        margin = min(gap, below) / 2
        low, high = last - margin, first + margin
        out.append((low, high, above(low) - above(high)))
        done, gap = count, below
    return out


def _project(matrix: np.ndarray, block: np.ndarray, low: float, high: float, node: int, nodes: int) -> np.ndarray:
    """One node's share of the contour integral around [low, high]; the lower half circle is its conjugate."""
    points, weights = np.polynomial.legendre.leggauss(nodes)
    angle = np.pi / 2 * (1 - points[node])
    step = (high - low) / 2 * np.exp(1j * angle)
    solved = np.linalg.solve(((high + low) / 2 + step) * np.eye(len(matrix)) - matrix, block.astype(complex))
    return weights[node] / 2 * (step * solved).real


def feast(spark, matrix: np.ndarray, wanted: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    d = len(matrix)
    wanted = min(wanted, d)
    held = intervals(matrix, wanted)
    rng = np.random.default_rng(0)
    blocks = [rng.standard_normal((d, min(d, count + count // 2 + 4))) for _, _, count in held]
    known = [None] * len(held)
    norm = float(np.abs(matrix).sum(axis=1).max()) or 1.0
    shared = spark.sparkContext.broadcast(matrix)
    for _ in range(ROUNDS):
        open_ = [k for k, v in enumerate(known) if v is None]
        if not open_:
            break
        sent = spark.sparkContext.broadcast({k: blocks[k] for k in open_})

        def run(batches, sent=sent):
            for batch in batches:
                for k, node in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
                    low, high, _ = held[k]
                    got = _project(shared.value, sent.value[k], low, high, node, nodes)
                    yield [[k], [node], [got.reshape(-1)]]

        todo = spark.createDataFrame([(k, e) for k in open_ for e in range(nodes)], "k int, node int").repartition(len(open_) * nodes, "k", "node")
        shares: dict[int, np.ndarray] = {}
        for r in sorted(on_arrow(todo, run, "k int, node int, v array<double>").collect(), key=lambda r: (r["k"], r["node"])):
            shares[r["k"]] = shares.get(r["k"], 0) + np.array(r["v"]).reshape(blocks[r["k"]].shape)
        sent.unpersist()
        for k in open_:
            low, high, count = held[k]
            basis = np.linalg.qr(shares[k])[0]
            values, small = np.linalg.eigh(basis.T @ matrix @ basis)
            vectors = basis @ small
            inside = (values > low) & (values < high)
            residual = np.linalg.norm(matrix @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0)
            if inside.sum() == count and (residual <= 1e-13 * norm * np.sqrt(d)).all():
                known[k] = values[inside], vectors[:, inside]
            blocks[k] = vectors
    shared.unpersist()
    if any(v is None for v in known):
        raise ArithmeticError(f"projection did not find the eigenvalues that inertia counts tell: {held}")
    values, vectors = np.concatenate([v for v, _ in known]), np.concatenate([w for _, w in known], axis=1)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)


def whiten(rows: DataFrame, key: str, column: str, components: int = 4, scale: int = 256) -> DataFrame:
    """Per row and component: key, component (from 1), n (distinct vectors), deviation, whitened, explained, identity_error.

    ``whitened`` is the vector minus the mean on the component, over the root of its eigenvalue; ``explained`` the
    eigenvalue over the trace; ``deviation`` the exact sum over the dimensions of (n*x - S)^2; ``identity_error`` the
    largest entry of |covariance of whitened over the fit list - identity|, measured on the rows.
    """
    spark = rows.sparkSession
    vectors = written(whole_vectors(rows, key, column, scale), "whole-vectors")
    fit = written(vectors.select("x").distinct(), "fit-list")
    n, sums = column_sums(fit)
    result = f"key {vectors.schema['key'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    mean = np.array([s // n + (s % n) / n for s in sums]) if n else np.zeros(0)
    spread = covariance(fit, "x", mean, n) if n else np.zeros((0, 0))
    spread = (spread + spread.T) / 2
    total = float(np.trace(spread))
    if total <= 0:
        return spark.createDataFrame([], result)
    values, axes = feast(spark, spread, components)
    real = values > 1e-12 * len(spread) * total
    values, axes = values[real], axes[:, real]
    map_ = axes / np.sqrt(values)
    middle = _summed(fit, lambda x: ((x - mean) @ map_).sum(axis=0, keepdims=True), "x")[0] / n

    def again(x):
        w = (x - mean) @ map_ - middle
        return w.T @ w

    error = float(np.abs(_summed(fit, again, "x") / n - np.eye(len(values))).max())
    k, share = len(values), values / total
    exact = np.array(sums, object)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column(1))
                off = n * (x - mean)
                if len(x) and np.abs(off).max() ** 2 * x.shape[1] < 2.0**62:
                    far = n * x - exact.astype(np.int64)
                    deviation = (far * far).sum(axis=1).tolist()
                else:
                    deviation = [v if v < 1 << 63 else None for v in ((n * x.astype(object) - exact) ** 2).sum(axis=1).tolist()]
                m = len(x)
                keys = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                yield [keys, np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                       ((x - mean) @ map_).reshape(-1), np.tile(share, m), np.full(m * k, error)]

    return on_arrow(vectors, run, result)
