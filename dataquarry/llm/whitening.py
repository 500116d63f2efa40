"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The rows are the distinct vectors, centred.  A step multiplies the centred rows with a
right vector, ``X v``, takes the result out of the left vectors found so far, and multiplies
back, ``X'u``.  Both products, and the inner products with all earlier left vectors, are one
pass over the rows: a task sends sums of the width of a vector, and Spark adds them up.

Left vectors have as many entries as there are rows.  They are never stored: each is ``X z``
for a short ``z`` that the driver keeps, so a pass computes all of them for a block of rows
at once and a lost executor costs nothing but its blocks.  Right vectors are short and are
orthogonalised twice on the driver.  The driver holds width x steps numbers.

The recurrence leaves a small upper bidiagonal matrix whose singular values and vectors
give those of X.  Steps go on until the residuals of the wanted components are at rounding
level or the right vectors span everything.  If they stop earlier, a second process,
orthogonal to all components found, looks for one that a single starting vector cannot see
(equal eigenvalues), and takes it in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataquarry.llm.common import remove, written

SEED = 20_011
#: Residual, relative to the largest singular value, at which a component is final.
TIGHT = 1e-15
#: Singular values below this share of the largest are rounding noise and no components.
NOISE = 1e-10
#: Rows whose products are held at once.
BLOCK = 4096
LONG = 2**63 - 1
#: Entries beyond this, either side, count as this: larger doubles are no exact integers.
LARGEST = 2.0**50


@dataclass(frozen=True)
class Whitening:
    """Means as exact sums, components as columns, eigenvalues of the covariance (divisor n)."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def usable(vector: Column) -> Column:
    """Neither null nor with a null, infinite or undefined entry."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, fine), F.lit(False))


def lattice(vector: Column, unit: int = 64, origin: int = 1_000_000) -> Column:
    """``floor(unit * entry) + origin`` for every entry."""
    within = lambda c: F.greatest(F.least(c.cast("double") * unit, F.lit(LARGEST)), F.lit(-LARGEST))
    return F.transform(vector, lambda c: F.floor(within(c)).cast("bigint") + origin)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """``x - sums / n``; integers that fit are subtracted before the only rounding."""
    if n * max(1, int(np.abs(x).max(initial=0))) < LONG:
        return (n * x - sums) / n
    return ((n * x.astype(object) - sums.astype(object)) / n).astype(float)


def _sum_pass(points: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
    """The sum over all rows of what ``part`` gives for a block of them."""
    number = "bigint" if exact else "double"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _rows(batch.column(0), width)
            for at in range(0, len(x), BLOCK):
                found = part(x[at : at + BLOCK])
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total, pa.int64() if exact else pa.float64())], ["at", "value"]
            )

    added = points.mapInArrow(sums, f"at int, value {number}").groupBy("at").agg(F.sum("value").alias("value")).collect()
    return np.array([r["value"] for r in sorted(added, key=lambda r: r["at"])])


def _products(x: np.ndarray, *, sums: np.ndarray, n: int, v: np.ndarray, beta: float, left: np.ndarray) -> np.ndarray:
    """For a block: inner products of ``Xv - beta u`` with earlier left vectors, its square, and ``X'`` of it."""
    c = _centred(x, sums, n)
    u = c @ left
    raw = c @ v - (beta * u[:, -1] if beta else 0.0)
    return np.concatenate([u.T @ raw, [raw @ raw], c.T @ raw])


def _out_of(w: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            w = w - (b @ w) * b
    return w


def _bidiagonalise(
    product: Callable, width: int, wanted: int, scale: float, locked: list[tuple[float, np.ndarray]], enough: float | None, rng: np.random.Generator
) -> tuple[list[tuple[float, np.ndarray]], bool]:
    """Singular values and right vectors orthogonal to the ``locked`` ones, and whether nothing is left.

    Stops when the first ``wanted`` are final or, with ``enough``, when the largest is known
    to be above or below that value.
    """
    right = [v for _, v in locked]
    left = [v / s for s, v in locked]
    images = [s * v for s, v in locked]
    start = len(locked)
    alphas, betas = [], []
    v, beta = _out_of(rng.standard_normal(width), right), 0.0
    v /= np.linalg.norm(v)
    while True:
        z_all = np.column_stack(left) if left else np.zeros((width, 0))
        found = product(v=v, beta=beta, left=z_all if left else np.zeros((width, 1)))
        k = max(1, len(left))
        h, square, image = found[:k][: len(left)], found[k], found[k + 1 :]
        alpha = float(np.sqrt(max(0.0, square - h @ h)))
        right.append(v)
        if alpha <= NOISE * scale:
            # X maps v into the span of earlier left vectors: a zero on the diagonal.
            alphas.append(0.0)
            left.append(np.zeros(width))
            images.append(np.zeros(width))
            w = np.zeros(width)
        else:
            z = (v - (beta * left[-1] if beta else 0.0) - (z_all @ h if left else 0.0)) / alpha
            p = (image - (np.column_stack(images) @ h if images else 0.0)) / alpha
            alphas.append(alpha)
            left.append(z)
            images.append(p)
            w = _out_of(p - alpha * v, right)
        beta = float(np.linalg.norm(w))
        b = np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1) if len(alphas) > 1 else np.array([[alphas[0]]])
        u_small, sigma, v_small = np.linalg.svd(b)
        size = len(alphas)
        if beta <= TIGHT * scale:
            beta = 0.0
        residual = beta * np.abs(u_small[-1, :])
        all_found = len(right) >= width
        done = size >= wanted and beta > 0 and bool((residual[:wanted] <= TIGHT * max(scale, sigma[0])).all())
        if enough is not None and size > 1:
            done = done or sigma[0] > enough * (1 + 1e-12) or bool(sigma[0] + residual[0] < enough)
        if all_found or done:
            basis = np.column_stack(right[start:])
            return [(float(s), basis @ v_small[i]) for i, s in enumerate(sigma)], all_found
        if beta == 0.0:
            w = _out_of(rng.standard_normal(width), right)
            betas.append(0.0)
        else:
            betas.append(beta)
        v = w / np.linalg.norm(w)


def fit(points: DataFrame, vector: str, components: int = 16) -> Whitening | None:
    """Means, components and eigenvalues over the distinct vectors of a column of integer arrays.

    All arrays must be of one length, without nulls.  Directions without variance are no
    components, so there may be fewer than asked for; no rows give ``None``.
    """
    # Distinct vectors, written once: every pass reads this table.
    x = written(points.select(F.col(vector).alias("x")).distinct(), "whitening-rows")
    head = x.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = head["n"], head["width"] or 0
    if not n or not width:
        remove(x)
        return None
    sums = _sum_pass(x, width, lambda b: b.sum(axis=0), exact=True)
    spread = float(_sum_pass(x, width, partial(_square, sums=sums, n=n))[0])
    scale = np.sqrt(spread)
    found: list[tuple[float, np.ndarray]] = []
    if spread > 0:
        rng = np.random.default_rng(SEED)
        product = lambda **k: _sum_pass(x, width, partial(_products, sums=sums, n=n, **k))
        wanted = min(components, width)
        found, complete = _bidiagonalise(product, width, wanted, scale, [], None, rng)
        found = found[:wanted]
        while not complete and len(found) == wanted:
            more, _ = _bidiagonalise(product, width, 1, scale, found, found[-1][0], rng)
            if more[0][0] <= found[-1][0] * (1 + 1e-12):
                break
            # A direction the first process could not see; made final, then taken in.
            more, _ = _bidiagonalise(product, width, 1, scale, found, None, rng)
            found = sorted([*found, more[0]], key=lambda f: -f[0])[:wanted]
        found = [f for f in found if f[0] > NOISE * scale]
    if not found:
        remove(x)
        return Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), spread / n, 0.0)
    basis = np.column_stack([v if v[np.abs(v).argmax()] > 0 else -v for _, v in found])
    values = np.array([s * s / n for s, _ in found])
    moments = _sum_pass(x, width, partial(_moments, sums=sums, n=n, basis=basis / np.sqrt(values)))
    remove(x)
    c = len(values)
    mean = moments[:c] / n
    covariance = moments[c:].reshape(c, c) / n - np.outer(mean, mean)
    return Whitening(n, sums, basis, values, spread / n, float(np.abs(covariance - np.eye(c)).max()))


def _square(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    return np.array([(_centred(x, sums, n) ** 2).sum()])


def _moments(x: np.ndarray, sums: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    w = _centred(x, sums, n) @ basis
    return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])


def _deviation(x: np.ndarray, sums: np.ndarray, n: int) -> list[int | None]:
    """Exact sums of ``(n x - sums)^2``; null where a long cannot hold one."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * most + int(np.abs(sums).max(initial=0)) < LONG:
        d = n * x - sums
        if int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < LONG:
            return (d * d).sum(axis=1).tolist()
    d = n * x.astype(object) - sums.astype(object)
    return [s if s <= LONG else None for s in (d * d).sum(axis=1).tolist()]


def whiten(rows: DataFrame, model: Whitening, key: str, vector: str) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)``: a row for every row and component."""
    width, c = model.components.shape
    basis = model.components / np.sqrt(model.values) if c else model.components
    share = model.values / model.trace if c else model.values

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(1), width)
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK]
                repeat = np.repeat(np.arange(len(part)), c)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)).take(pa.array(repeat)), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(part))),
                        pa.array(_deviation(part, model.sums, model.n), pa.int64()).take(pa.array(repeat)),
                        pa.array((_centred(part, model.sums, model.n) @ basis).ravel(), pa.float64()), pa.array(np.tile(share, len(part)), pa.float64()),
                    ],
                    ["key", "component", "deviation", "whitened", "explained"],
                )

    kind = rows.schema[key].dataType.simpleString()
    done = rows.select(F.col(key).alias("key"), F.col(vector).alias("x")).mapInArrow(
        project, f"key {kind}, component int, deviation bigint, whitened double, explained double"
    )
    return done.select(
        F.col("key").alias(key), "component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", "explained",
        F.lit(model.identity_error).alias("identity_error"),
    )


def whitened_embeddings(rows: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Whitened coordinates of every row whose vector is complete and finite, on the grid of 1/64.

    Rows with a null vector or a null or non-finite entry are left out, and so are rows of
    another length than most (of equally many the longer one counts).  Repeated vectors
    count once for means and components, but every row is returned; so are rows with null or
    repeated keys.  Without rows, or without any variance, the result is empty.  Entries
    beyond 2^50 in 64ths count as 2^50; ``deviation`` is null where a long cannot hold it.
    """
    grid = rows.where(usable(F.col(vector))).select(F.col(key).alias("_key"), lattice(F.col(vector)).alias("_x"))
    width = grid.groupBy(F.size("_x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    grid = grid.where(F.size("_x") == (width["w"] if width else 0))
    model = fit(grid, "_x", components)
    if model is None:
        model = Whitening(0, np.zeros(0), np.zeros((1, 0)), np.zeros(0), 0.0, 0.0)
        grid = grid.where(F.lit(False))
    return whiten(grid.withColumnRenamed("_key", key), model, key, "_x")
