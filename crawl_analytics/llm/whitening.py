"""Embedding whitening: leading eigenpairs of the covariance by a block Jacobi-Davidson method, products taken in Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 40)  # a larger entry has no exact whole number here and counts as not finite
EPS = float(np.finfo(np.float64).eps)
RESIDUAL = 64 * EPS  # of the largest eigenvalue
FLAT = 1e-12  # an eigenvalue below this share of the largest is rounding: there is nothing to divide by
OUTER, INNER = 60, 8
BASIS = 6  # blocks that the search space holds before it is restarted
ROWS = 4096  # vectors multiplied at once
GROUPS = 64  # tasks that add up the partial sums of all others; the driver adds the last so many


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the rows whose entries are all finite, each entry c as floor(64 * c) + 1000000."""
    good = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) <= LARGEST, F.lit(False)) & ~F.isnan(c))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return vectors.where("embedding is not null").where(good & (F.size("embedding") > 0)).select("vec_id", x.alias("x"))


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield _matrix(batch.slice(at, ROWS), size)


class Fit:
    """The distinct vectors of one length: how many, their sums, and products with their covariance.

    The mean is S / n = base + rest / n with whole ``base`` and 0 <= ``rest`` < n, so x - S / n is (x - base) - rest / n: small
    numbers, centred before anything is multiplied.
    """

    def __init__(self, rows: DataFrame, size: int):
        self.rows, self.size = rows, size
        totals = self._gathered(lambda x: x.sum(axis=0), size, "long", "decimal(38,0)")
        self.n = rows.count()
        sums = [int(v) for v in totals]
        self.base = np.array([s // self.n for s in sums], dtype=np.int64)
        self.rest = [s % self.n for s in sums]

    def _gathered(self, part: Callable[[np.ndarray], np.ndarray], cells: int, kind: str, total: str) -> list:
        """The cells of ``part`` summed over all slices of all tasks: a task sends one array, ``GROUPS`` tasks add them up."""
        size = self.size
        numbers = np.int64 if kind == "long" else np.float64

        def add(batches: Iterator) -> Iterator:
            from pyspark import TaskContext

            mine = np.zeros(cells, dtype=numbers)
            for x in _slices(batches, size):
                mine += part(x).ravel()
            task = pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32())
            yield pa.RecordBatch.from_arrays([task, pa.array([mine])], names=["task", "cells"])

        sums = self.rows.mapInArrow(add, f"task int, cells array<{kind}>")
        none = F.array_repeat(F.lit(0).cast(total), cells)
        added = F.aggregate(F.collect_list("cells"), none, lambda a, b: F.zip_with(a, b, lambda x, y: (x + y.cast(total)).cast(total)))
        parts = [r["cells"] for r in sums.groupBy("task").agg(added.alias("cells")).collect()]
        return [sum(p[i] for p in parts) for i in range(cells)]

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        base, share = self.base, np.array([r / self.n for r in self.rest])
        return lambda x: (x - base) - share

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times the columns of ``block``: one Spark job, the matrix itself is never formed."""
        centre = self.centred()

        def part(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return c.T @ (c @ block)

        return np.array(self._gathered(part, block.size, "double", "double")).reshape(block.shape) / self.n

    def trace(self) -> float:
        centre = self.centred()
        return self._gathered(lambda x: (centre(x) ** 2).sum(), 1, "double", "double")[0] / self.n

    def covariance(self, project: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
        """Covariance of the projected fit list, the projections' own means taken off."""

        def part(x: np.ndarray) -> np.ndarray:
            w = project(x)
            return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

        sums = np.array(self._gathered(part, width * (width + 1), "double", "double")) / self.n
        return sums[width:].reshape(width, width) - np.outer(sums[:width], sums[:width])


def _orthonormal(new: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns that span what ``new`` adds to the orthonormal columns of ``against``."""
    norms = np.linalg.norm(new, axis=0)
    new = new[:, norms > 0] / norms[norms > 0]
    kept = against
    for column in new.T:
        for _ in range(2):
            column = column - kept @ (kept.T @ column)
            if (length := np.linalg.norm(column)) < 1e-10:
                break
            column = column / length
        else:
            kept = np.column_stack([kept, column])
    return kept[:, against.shape[1] :]


def _minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Minimal residual solutions of apply(t) = right, the columns side by side so that a step is one product."""
    first = np.linalg.norm(right, axis=0)
    v = right / np.where(first > 0, first, 1.0)
    x, before, w, w_before = (np.zeros_like(right) for _ in range(4))
    beta, eta = first.copy(), first.copy()
    c, c_before, s, s_before = np.ones_like(first), np.ones_like(first), np.zeros_like(first), np.zeros_like(first)
    for _ in range(steps):
        av = apply(v)
        alpha = (v * av).sum(axis=0)
        following = av - alpha * v - beta * before
        beta_next = np.linalg.norm(following, axis=0)
        delta = c * alpha - c_before * s * beta
        rho = np.hypot(delta, beta_next)
        live = rho > 0
        safe = np.where(live, rho, 1.0)
        direction = np.where(live, (v - s_before * beta * w_before - (s * alpha + c_before * c * beta) * w) / safe, 0.0)
        c_next, s_next = np.where(live, delta / safe, 1.0), np.where(live, beta_next / safe, 0.0)
        x = x + c_next * eta * direction
        eta = -s_next * eta
        before, v = v, np.where(beta_next > 0, following / np.where(beta_next > 0, beta_next, 1.0), 0.0)
        w_before, w, beta = w, direction, beta_next
        c_before, c, s_before, s = c, c_next, s, s_next
        if (np.abs(eta) <= enough * first).all():
            break
    return x


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, vectors as columns) of a symmetric matrix that is only known by its products, largest values first.

    Block Jacobi-Davidson: Rayleigh-Ritz on the search space gives a Ritz pair for each open target; leading targets whose
    residual is at double precision are locked and projected out; for the others the correction equation
    (I - QQ')(A - theta I)(I - QQ') t = -r, Q the locked and the current vectors, is solved roughly by MINRES and
    the corrections join the search space. The driver holds a few blocks of ``wanted`` columns.
    """
    wanted = min(wanted, size)
    random = np.random.default_rng(seed)
    locked, values = np.zeros((size, 0)), []
    space = _orthonormal(random.normal(size=(size, min(size, 2 * wanted))), locked)
    image = product(space)
    largest, best, stalled = 0.0, np.inf, 0
    for outer in range(OUTER):
        inner = space.T @ image
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        open_ = min(wanted - len(values), len(theta))
        u, au = space @ turn[:, :open_], image @ turn[:, :open_]
        largest = max(largest, *values[:1], float(theta[0]), 0.0)
        r = au - u * theta[:open_]
        r -= locked @ (locked.T @ r)
        norms = np.linalg.norm(r, axis=0)
        worst = float(norms.max())
        # rounding of the sums sets the floor: three rounds without gain at a residual of that order end the search
        stalled = stalled + 1 if worst > best / 2 else 0
        best = min(best, worst)
        done = norms <= RESIDUAL * largest
        if stalled >= 3 and worst <= 64 * RESIDUAL * largest:
            done[:] = True
        ready = open_ if done.all() else int(np.argmin(done))
        if ready:
            locked = np.column_stack([locked, u[:, :ready]])
            values += [float(t) for t in theta[:ready]]
            space, image = space @ turn[:, ready:], image @ turn[:, ready:]
            u, theta, r = u[:, ready:], theta[ready:], r[:, ready:]
            if len(values) >= wanted:
                break
            best, stalled = np.inf, 0
        shift = theta[: u.shape[1]]
        full = space.shape[1] + locked.shape[1] >= size
        if not full:
            near = np.column_stack([locked, u])
            off = lambda t: t - near @ (near.T @ t)  # noqa: B023, E731
            correction = _minres(lambda t: off(product(off(t)) - off(t) * shift), off(-r), INNER, 2.0 ** -(outer + 2))  # noqa: B023
            if space.shape[1] > BASIS * wanted:  # restart: two blocks of Ritz vectors stay
                keep = 2 * wanted
                space, image = (space, image) if ready else (space @ turn, image @ turn)
                space, image = space[:, :keep], image[:, :keep]
            new = _orthonormal(correction, np.column_stack([locked, space]))
            if not new.shape[1]:
                new = _orthonormal(random.normal(size=(size, 1)), np.column_stack([locked, space]))
            space, image = np.column_stack([space, new]), np.column_stack([image, product(new)])
        else:  # everything is spanned: what is left is rounding in the stored products, so these are taken again
            space = _orthonormal(space, locked)
            image = product(space)
    else:
        raise RuntimeError(f"residual {worst:.3g} of {largest:.3g} after {OUTER} rounds")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order]


def _written(fit: Fit, rows: DataFrame, most: int, numbers: str) -> DataFrame:
    size, n, base, rest = fit.size, fit.n, fit.base, fit.rest
    values, basis = leading_pairs(fit.product, size, most)
    real = values > FLAT * max(values[0], 0.0)
    values, basis = values[real], basis[:, real]
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)  # one sign for all
    width = len(values)
    centre, unit = fit.centred(), basis / np.sqrt(values)
    explained = values / fit.trace() if width else values
    error = float(np.abs(fit.covariance(lambda x: centre(x) @ unit, width) - np.eye(width)).max()) if width else 0.0

    def deviations(x: np.ndarray) -> list[int | None]:
        y = x - base
        top = int(np.abs(y).max(initial=0)) * n + n
        if top * top * size < 1 << 62:
            return ((n * y - np.array(rest)) ** 2).sum(axis=1).tolist()
        exact = [sum((n * a - b) ** 2 for a, b in zip(row, rest, strict=True)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in exact]

    def write(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part, size)
                each = np.repeat(np.arange(len(x)), width)
                component = np.tile(np.arange(width), len(x))
                columns = [
                    part.column("vec_id").take(pa.array(each)),
                    pa.array((component + 1).astype(np.int32)),
                    pa.array(np.full(len(each), n)),
                    pa.array(deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array((centre(x) @ unit).ravel()),
                    pa.array(explained[component]),
                    pa.array(np.full(len(each), error)),
                ]
                names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = f"vec_id {numbers}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(write, kinds)


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component.

    Rows without a vector or with an entry that is NULL, not finite or beyond 2^40 are dropped; all others are projected,
    repeated rows and rows without a vec_id too. The fit list holds every different vector once (map-side combined), so copies
    do not weigh. Vectors of different lengths have no common covariance: each length is fitted for itself. Products with the
    covariance are Spark jobs in which a task sends one block of sums; the driver holds a few blocks of
    ``most`` columns, whatever the number of vectors. Fewer components than ``most`` come back where the covariance has no
    more (short vectors, few different ones): an eigenvalue of zero cannot be divided by, so equal vectors alone, an empty
    table and empty vectors give no rows. ``deviation`` is NULL if it is beyond a long. Other columns are ignored.
    """
    rows = stored(whole_numbers(vectors), "whole-vectors")
    numbers = vectors.schema["vec_id"].dataType.simpleString()
    fit = stored(rows.select("x").distinct(), "fit-list")
    sizes = sorted(r["size"] for r in fit.select(F.size("x").alias("size")).distinct().collect())
    parts = [_written(Fit(fit.where(F.size("x") == s), s), rows.where(F.size("x") == s), most, numbers) for s in sizes]
    if not parts:
        empty = f"vec_id {numbers}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, parts)
