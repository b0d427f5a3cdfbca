"""Whitening of embeddings by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

No covariance matrix is ever formed. Its product with a few vectors is one
distributed pass: each task centres its rows, multiplies them with the block and
back, and adds up its part; parts are summed by dimension. A search space
grows by corrections: for each wanted Ritz pair that has not converged, the
correction equation, projected against that pair, its companions and the
locked vectors, is solved by a few steps of MINRES, all pairs in step so that
they share their passes. Rayleigh-Ritz on the space gives the next pairs;
those whose residual has reached double precision are locked and leave the
space. The driver holds vectors of the embeddings' length only.

The fit list is each distinct integer vector once, so copies, however many,
weigh as one. Its sums are exact, in integers of any size.

Defined results: vectors that are null, empty, of another length than most
(ties: the shortest) or hold null, NaN, infinite or, in size, over 2^52
entries take no part; a null or repeated vec_id is a row like others; a component without
variance has a null whitened, and all have a null explained where there is no variance
at all; a deviation beyond a long is null; with fewer dimensions than
components there are as many as dimensions; an empty table gives an empty
result; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import ROWS, materialize

COMPONENTS = 4
#: Whole numbers are floor(SCALE * entry).
SCALE = 256
#: Ritz pairs beyond the wanted ones that are corrected too, so that none of those is missed.
GUARD = 4
#: Random vectors that the search begins with.
START = 24
#: MINRES steps for each correction, and the share of its residual that ends them early. A few steps are enough, as
#: each round's one further pass also joins the space: more steps need more passes in all.
INNER, INNER_SHARE = 4, 1e-3
#: Vectors in the search space before it shrinks to the best Ritz vectors.
SPACE = 48
OUTER = 500
SEED = 11

SCORED = "vec_id long, component int, deviation long, whitened double"


@dataclass
class Whitening:
    """Eigenvectors as columns, eigenvalues falling, exact sums and number of the fit list, trace and how far from the identity."""

    vectors: np.ndarray
    values: np.ndarray
    sums: list[int]
    n: int
    trace: float
    identity_error: float
    products: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(e), NaN for components without variance."""
        fine = self.values > np.finfo(float).eps * len(self.sums) * max(self.trace, 0.0)
        return np.where(fine, 1 / np.sqrt(np.where(fine, self.values, 1.0)), np.nan)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the whole numbers of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    size = F.size("embedding")
    fine = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= 2.0**52 / SCALE), F.lit(False)))
    rows = vectors.filter(F.col("embedding").isNotNull() & (size > 0) & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * SCALE)).alias("x"))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("x") == common.d) if common else rows


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(name)).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _blocks(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 8 * ROWS):
            yield whole.slice(at, 8 * ROWS)


def exact_sums(fit: DataFrame) -> list[int]:
    """Sums of each dimension, in integers that never overflow."""
    def add(batches):
        total: list[int] | None = None
        for batch in _blocks(batches):
            x = _matrix(batch)
            # below 2^52 each, so halves of 26 bits add up in longs
            part = [int(h) * 2**26 + int(r) for h, r in zip((x >> 26).sum(0), (x & (2**26 - 1)).sum(0))]
            total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(map(str, total)))], ["dim", "part"])

    parts = fit.select("x").mapInArrow(add, "dim int, part string")
    rows = parts.groupBy("dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    return [int(r.s) for r in rows]


class Centred:
    """The fit list about its mean, for passes over it."""

    def __init__(self, fit: DataFrame, mean: np.ndarray, n: int):
        self.fit, self.mean, self.n, self.products = fit.select("x"), mean, n, 0

    def _sum(self, part, width: int, rows: int) -> np.ndarray:
        """part(centred rows), a (rows, width) matrix for each batch, summed over all of them."""
        mean, names = self.mean, [f"c{i}" for i in range(width)]

        def add(batches):
            total = np.zeros((rows, width))
            for batch in _blocks(batches):
                total += part(_matrix(batch) - mean)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), *(pa.array(total[:, i]) for i in range(width))], ["dim", *names])

        parts = self.fit.mapInArrow(add, "dim int, " + ", ".join(f"{c} double" for c in names))
        found = parts.groupBy("dim").agg(*(F.sum(c).alias(c) for c in names)).orderBy("dim").collect()
        return np.array([[r[c] for c in names] for r in found])

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of vectors."""
        self.products += 1
        return self._sum(lambda x: x.T @ (x @ block), block.shape[1], len(self.mean)) / self.n

    def trace(self) -> float:
        return float(self._sum(lambda x: (x * x).sum(0)[:, None], 1, len(self.mean)).sum() / self.n)

    def distance(self, axes: np.ndarray) -> float:
        """Largest entry of the covariance of the rows on these axes less the identity, itself centred first."""
        if not axes.shape[1]:
            return 0.0
        k = axes.shape[1]
        off = self._sum(lambda x: (x @ axes).sum(0)[:, None], 1, k)[:, 0] / self.n

        def part(x):
            w = x @ axes - off
            return w.T @ w

        return float(np.abs(self._sum(part, k, k) / self.n - np.eye(k)).max())


def minres(times, rhs: np.ndarray, steps: int, share: float) -> np.ndarray:
    """Solutions of times(x) = rhs, column by column but in step; each ends at the share of its first residual."""
    x, w, w_old, v_old = (np.zeros_like(rhs) for _ in range(4))
    gamma = np.linalg.norm(rhs, axis=0)
    first, eta = gamma.copy(), gamma.copy()
    live = gamma > 0
    v = rhs / np.where(live, gamma, 1.0)
    k = rhs.shape[1]
    c_old, c, s_old, s = np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    for _ in range(steps):
        if not live.any():
            break
        av = times(v)
        delta = (av * v).sum(0)
        after = av - delta * v - gamma * v_old
        after_gamma = np.linalg.norm(after, axis=0)
        a0 = c * delta - c_old * s * gamma
        a1 = np.hypot(a0, after_gamma)
        a2 = s * delta + c_old * c * gamma
        a3 = s_old * gamma
        live &= a1 > 0
        safe = np.where(live, a1, 1.0)
        c_old, s_old = c, s
        c, s = np.where(live, a0 / safe, 1.0), np.where(live, after_gamma / safe, 0.0)
        w_old, w = w, (v - a3 * w_old - a2 * w) / safe
        x = x + np.where(live, c * eta, 0.0) * w
        eta = -s * eta
        live &= (np.abs(eta) > share * first) & (after_gamma > 0)
        v_old, v, gamma = v, after / np.where(after_gamma > 0, after_gamma, 1.0), after_gamma
    return x


def _without(block: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """block orthogonal to orthonormal spaces, twice for good measure."""
    for _ in range(2):
        for space in spaces:
            block = block - space @ (space.T @ block)
    return block


def _fresh(block: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what block adds to the spaces."""
    kept: list[np.ndarray] = []
    for column in block.T:
        size = np.linalg.norm(column)
        if not np.isfinite(size) or size == 0:
            continue
        rest = _without((column / size)[:, None], *spaces, *([np.stack(kept, 1)] if kept else []))[:, 0]
        if np.linalg.norm(rest) > 1e-10:
            kept.append(rest / np.linalg.norm(rest))
    return np.stack(kept, 1) if kept else np.zeros((len(block), 0))


def jacobi_davidson(times, d: int, k: int, trace: float) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvectors, as columns, and eigenvalues of a positive semidefinite d x d operator."""
    eps = np.finfo(float).eps
    rng = np.random.default_rng(SEED)
    locked, values = np.zeros((d, 0)), []
    space = _fresh(rng.normal(size=(d, min(d, START))))
    image = times(space)
    for _ in range(OUTER):
        theta, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        residual = _without(image - space * theta, locked)
        size = np.linalg.norm(residual, axis=0)
        tolerance = 4 * (d + 16) * eps * max([*values[:1], theta[0]])
        done = 0
        while done < len(theta) and len(values) < k and (size[done] <= tolerance or trace <= 0):
            locked = np.concatenate([locked, _without(space[:, done:done + 1], locked)], 1)
            locked[:, -1] /= np.linalg.norm(locked[:, -1])
            values.append(max(0.0, float(theta[done])))
            done += 1
        if len(values) == k:
            break
        space, image, theta, residual = space[:, done:], image[:, done:], theta[done:], residual[:, done:]
        active = min(k - len(values) + GUARD, len(theta))
        if active:
            ritz, shift = space[:, :active], theta[:active]
            project = lambda t: _without(t, locked, ritz)  # noqa: E731, B023
            corrections = minres(lambda t: project(times(project(t)) - project(t) * shift), -project(residual[:, :active]), INNER, INNER_SHARE)  # noqa: B023
        else:
            corrections = rng.normal(size=(d, 1))
        if space.shape[1] + corrections.shape[1] > SPACE:
            keep = 2 * (k + GUARD)
            space, image = space[:, :keep], image[:, :keep]
        fresh = _fresh(project(corrections) if active else corrections, locked, space)
        if not fresh.shape[1]:
            fresh = _fresh(rng.normal(size=(d, 2)), locked, space)
        if fresh.shape[1]:
            space, image = np.concatenate([space, fresh], 1), np.concatenate([image, times(fresh)], 1)
        else:  # the whole space is searched; what is left is rounding in the images
            image = times(space)
    else:
        raise RuntimeError(f"{len(values)} of {k} eigenvectors reached double precision in {OUTER} rounds")
    order = np.argsort(values)[::-1]
    return locked[:, order], np.array(values)[order]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors x of rows; None without rows."""
    once = materialize(rows.select("x").distinct(), "whitening-fit")
    n = once.count()
    if not n:
        return None
    sums = exact_sums(once)
    centred = Centred(once, np.array([s / n for s in sums]), n)
    trace = centred.trace()
    vectors, values = jacobi_davidson(centred.times, len(sums), min(components, len(sums)), trace)
    out = Whitening(vectors, values, sums, n, trace, 0.0, centred.products)
    fine = ~np.isnan(out.scales)
    out.identity_error = centred.distance(vectors[:, fine] * out.scales[fine])
    return out


def _deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """Exact sums of (n * x - S)^2; null where they are beyond a long."""
    widest = n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, sums))
    if len(sums) * widest**2 < 2**63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < 2**63 else None for e in exact]


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component, deviation and whitened: each row (vec_id, x) on each component."""
    mean, axes, sums, n = model.mean, model.vectors * model.scales, model.sums, model.n
    k = axes.shape[1]

    def run(batches):
        for batch in _blocks(batches):
            x = _matrix(batch)
            if not len(x):
                continue
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
            deviations = np.repeat(np.array(_deviations(x, sums, n), object), k)
            white = ((x - mean) @ axes).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(deviations.tolist(), pa.int64()),
                 pa.array(white, mask=np.isnan(white))], ["vec_id", "component", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(run, SCORED)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Each row's vec_id, component, n, deviation, whitened, explained and identity_error."""
    rows = whole_numbers(vectors)
    model = fit(rows, components)
    if model is None:
        empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], empty)
    shares = F.array(*(F.lit(float(v / model.trace) if model.trace > 0 else None).cast("double") for v in model.values))
    return transform(rows, model).select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                                         F.element_at(shares, F.col("component")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
