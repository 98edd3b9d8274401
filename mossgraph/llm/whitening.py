"""Whitening of embeddings by their leading principal components, found by a Jacobi-Davidson iteration.

The covariance is never formed. Where the iteration needs it, it multiplies a block of vectors: every task centres
its rows, multiplies them by the block and back, and sends one sum of the size of the block. The search subspace
lives on the driver, as dimension times at most ``SUBSPACE`` numbers; the rows never come there. Each round solves the projected
correction equations of all pairs that have not converged by a few steps of MINRES side by side, so a step is one pass over the
rows however many pairs there are. Pairs whose residual is down to rounding are locked.

A vector's entries become whole numbers x = floor(SCALE * c) + SHIFT, so that sums are exact. Rows whose vector is null, or holds null or
non-finite entries, are left out; so are empty ones and those not of the commonest dimension (the least, if several are). Repeated vectors
count as often as they are there; rows of a null id stay. Components whose eigenvalue is zero, up to rounding, don't
exist: n equal vectors have none, and an empty table gives no rows. Of equal eigenvalues any orthogonal vectors may
come. A deviation beyond a long is null and stands in deviation_exact. Other columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Steps of MINRES for a correction; vectors that the search goes on with beyond those asked for; the largest search subspace, in multiples of what it starts with.
STEPS, SPARE, SUBSPACE = 4, 4, 8
#: A pair has converged when its residual is so small a part of the largest eigenvalue.
RESIDUAL = 64 * np.finfo(float).eps
ROUNDS = 200
#: Eigenvalues below this part of the trace are zero.
ZERO = 1e-13

Product = Callable[[np.ndarray], np.ndarray]


# the iteration


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to ``against`` (orthonormal); columns that add nothing but rounding go."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    out = u[:, s > 1e-9]
    for _ in range(2):
        out = out - against @ (against.T @ out)
        out = np.linalg.qr(out)[0] if out.shape[1] else out
    return out


def minres(product: Product, shift: np.ndarray, right: np.ndarray, against: np.ndarray, steps: int) -> np.ndarray:
    """For every column: (P (A - shift) P) t = P right by MINRES, P the projection off ``against``; one product a step for all columns."""

    def off(b: np.ndarray) -> np.ndarray:
        return b - against @ (against.T @ b)

    right = off(right)
    beta = np.linalg.norm(right, axis=0)
    live = beta > 0
    v_old, v = np.zeros_like(right), np.divide(right, beta, out=np.zeros_like(right), where=live)
    w_old, w, t = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    eta, c, c_old, s, s_old, b = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        av = off(product(v) - shift * v)
        alpha = np.einsum("ij,ij->j", v, av)
        nxt = off(av - alpha * v - b * v_old)
        b_next = np.linalg.norm(nxt, axis=0)
        rho_0, rho_2, rho_3 = c * alpha - c_old * s * b, s * alpha + c_old * c * b, s_old * b
        rho_1 = np.hypot(rho_0, b_next)
        live &= rho_1 > 1e-14 * np.maximum(np.abs(shift), 1e-300)
        safe = np.where(live, rho_1, 1.0)
        c_old, c, s_old, s = c, np.where(live, rho_0 / safe, 1.0), s, np.where(live, b_next / safe, 0.0)
        w_old, w = w, np.where(live, (v - rho_3 * w_old - rho_2 * w) / safe, 0.0)
        t += np.where(live, c * eta, 0.0) * w
        eta = -s * eta
        live &= b_next > 1e-14 * np.maximum(np.abs(shift), 1e-300)
        v_old, v, b = v, np.divide(nxt, b_next, out=np.zeros_like(nxt), where=live), b_next
    return off(t)


def jacobi_davidson(product: Product, dimension: int, wanted: int, trace: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors (columns) of the symmetric positive operator behind ``product``."""
    wanted = min(wanted, dimension)
    width = min(dimension, wanted + SPARE)
    if not wanted or trace <= 0:
        return np.zeros(0), np.zeros((dimension, 0))
    locked, values = np.zeros((dimension, 0)), np.zeros(0)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, width)))[0]
    image = product(basis)
    for _ in range(ROUNDS):
        h = basis.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, mapped = basis @ y[:, :width], image @ y[:, :width]
        residual = mapped - theta[:width] * ritz
        residual -= locked @ (locked.T @ residual)
        small = np.linalg.norm(residual, axis=0) <= RESIDUAL * max(theta[0], *values, trace / dimension)
        need = wanted - len(values)
        full = basis.shape[1] + len(values) >= dimension  # nothing is left to search
        done = need if full else next((k for k in range(need) if not small[k]), need)  # those before an open one
        if done:
            locked, values = np.hstack([locked, ritz[:, :done]]), np.append(values, theta[:done])
            basis, image = basis @ y[:, done:], image @ y[:, done:]
            ritz, residual, theta = ritz[:, done:], residual[:, done:], theta[done:]
        need -= done
        if not need:
            break
        if basis.shape[1] > SUBSPACE * width:  # again from the best pairs and some beside them
            keep = basis if done else basis @ y
            basis, image = keep[:, : 2 * width], (image if done else image @ y)[:, : 2 * width]
        open_ = slice(0, min(need + SPARE, ritz.shape[1]))
        near = np.linalg.qr(np.hstack([locked, ritz[:, open_]]))[0]
        more = minres(product, theta[: ritz.shape[1]][open_], -residual[:, open_], near, STEPS)
        new = _orthonormal(more, np.hstack([locked, basis]))
        if not new.shape[1]:
            new = _orthonormal(residual[:, open_], np.hstack([locked, basis]))
        if not new.shape[1]:  # an invariant subspace: on with anything beside it
            new = _orthonormal(np.random.default_rng(seed + basis.shape[1]).standard_normal((dimension, width)), np.hstack([locked, basis]))
        basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
    else:
        raise RuntimeError(f"no {wanted} components after {ROUNDS} rounds")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order]


# rows


@dataclass(frozen=True)
class Fit:
    n: int
    sums: list[int]  #: of x, by dimension
    trace: float
    values: np.ndarray  #: eigenvalues, falling
    vectors: np.ndarray  #: columns


def vectors_of(rows: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and x of the rows that take part, x as whole numbers."""
    v = F.col(vector)
    fit = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.where(F.coalesce(fit, F.lit(False))).select(F.col(id).alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _added(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over tasks of ``of`` (a flat array per batch of x), which each task adds up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

    found = rows.select("x").mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).collect()  # an entry of a vector each
    out = np.zeros(len(found), np.int64 if kind == "long" else np.float64)
    for i, v in found:
        out[i] = v
    return out


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less the mean; exact before the one division."""
    return (n * x - sums) / n


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Fit:
    """The components of ``rows`` (x, all of one dimension)."""
    n = rows.count()
    if not n:
        return Fit(0, [], 0.0, np.zeros(0), np.zeros((0, 0)))
    sums = _added(rows, lambda x: x.sum(axis=0), "long")
    trace = float(_added(rows, lambda x: np.array([(centred(x, n, sums) ** 2).sum()]), "double")[0]) / n
    d = len(sums)

    def product(block: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            z = centred(x, n, sums)
            return (z.T @ (z @ block)).ravel()

        return _added(rows, of, "double").reshape(d, block.shape[1]) / n

    values, vectors = jacobi_davidson(product, d, components, trace)
    real = values > ZERO * trace
    return Fit(n, sums.tolist(), trace, values[real], vectors[:, real])


def whitened(rows: DataFrame, fit: Fit) -> DataFrame:
    """``rows`` (id, x) with deviation_exact, the sum of (n x - S)^2, and whitened, by component."""
    schema = T.StructType([rows.schema["id"], T.StructField("deviation_exact", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType(), False))])
    n, sums, scaled = fit.n, np.array(fit.sums, np.int64), fit.vectors / np.sqrt(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = n * _matrix(batch.column(1)) - sums
            if float(np.abs(d).max()) ** 2 * d.shape[1] >= 2.0**62:
                d = d.astype(object)  # whole numbers of any size
            deviation = (d * d).sum(axis=1)
            w = (d.astype(np.float64) / n) @ scaled
            offsets = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(v) for v in deviation], pa.decimal128(38, 0)), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], schema.fieldNames())

    return rows.select("id", "x").mapInArrow(run, schema)


def identity_error(white: DataFrame, k: int) -> float:
    """The largest entry of the covariance of ``white`` (whitened) less the identity; rows are centred before they are multiplied."""
    rows = white.select(F.col("whitened").alias("x"))
    n = rows.count()
    mean = _added(rows, lambda w: w.sum(axis=0), "double") / n
    products = _added(rows, lambda w: ((w - mean).T @ (w - mean)).ravel(), "double").reshape(k, k) / n
    return float(np.abs(products - np.eye(k)).max())


def per_component(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error and deviation_exact: a row for each vector and component."""
    spark = rows.sparkSession
    kind = rows.schema["vec_id"].dataType.simpleString()
    with Scratch(spark) as scratch:
        all_ = scratch.written(vectors_of(rows))
        sizes = all_.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        x = all_.where(F.size("x") == (sizes["d"] if sizes else 0))
        fit = fitted(x, components)
        k = len(fit.values)
        if not k:
            return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
        white = written(whitened(x, fit))
        error = identity_error(white, k)
    shares = F.array(*(F.lit(float(v / fit.trace)) for v in fit.values))
    placed = white.select("id", "deviation_exact", F.posexplode("whitened").alias("_at", "whitened"))
    return placed.select(F.col("id").alias("vec_id"), (F.col("_at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), _long(F.col("deviation_exact")).alias("deviation"), "whitened", F.element_at(shares, F.col("_at") + 1).alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact")


def _long(value: Column) -> Column:
    return F.when(value <= F.lit((1 << 63) - 1).cast("decimal(38,0)"), value).try_cast("long")
