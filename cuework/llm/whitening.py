"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

``X`` has a row for each embedding, the mean taken off. From a start vector ``v`` the products ``X v`` and ``X' u``
alternate: ``X v_k = a_k u_k + b_(k-1) u_(k-1)`` and ``X' u_k = a_k v_k + b_k v_(k+1)``, so that ``X V = U B`` with a
small bidiagonal ``B``, whose singular values and vectors give those of ``X``. One pass over the rows makes both
products of a step: a task works out ``u`` of its own rows and adds ``X' u`` and ``u'u`` up. ``u`` is never stored: it
is ``X p`` for a ``p`` as long as a row, so both bases are held as short vectors and each new vector is
reorthogonalised against all before it (``u_j' u = p_j' X' u``).

Steps go on until the wanted singular values have converged and the part of ``X`` outside the basis is too small to
hide a larger one (``|X|^2 - |B|^2`` bounds it), or until the basis spans all dimensions. An invariant subspace
(``b_k = 0``) is left with a new start vector, so repeated singular values come out as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuework.llm.scratch import stored
from cuework.llm.vectors import in_blocks, matrices, whole_numbers

SHIFT = 1_000_000
TINY = 1e-13  # of |X|: a norm below counts as zero
FLAT = 1e-11  # of the largest singular value: a component below has no variance
SETTLED = 1e-14  # of the largest singular value: residual of a settled one
ROWS_AT_ONCE = 1 << 16  # of the result, in one batch
RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def total(blocks: DataFrame, measure: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum over all blocks of what ``measure`` gives for the integers of one, always as many numbers."""
    def run(batches):
        out = None
        for b in batches:
            for _, _, x in matrices(b):
                part = measure(x)
                out = part if out is None else out + part
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["i", "v"])

    rows = blocks.mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()
    return rows["v"].to_numpy()


class Centre:
    """Takes the mean ``S / n`` off integer rows, rounding once at the end."""

    def __init__(self, sums: np.ndarray, n: int):
        self.n = n
        self.whole = np.array([int(s) // n for s in sums], np.int64)
        self.rest = np.array([int(s) % n for s in sums], np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of ``(n x - S)^2``, exact."""
        d = x - self.whole
        if float(np.abs(d).max(initial=0) + 1) ** 2 * self.n ** 2 * x.shape[1] < 2.0 ** 62:
            return ((self.n * d - self.rest) ** 2).sum(axis=1)
        wide = ((self.n * d.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        if wide.max() >= 1 << 63:
            raise OverflowError("a deviation does not fit in 64 bits")
        return wide.astype(np.int64)


def bidiagonalise(step: Callable[[np.ndarray], tuple[np.ndarray, float]], dim: int, energy: float, wanted: int
                  ) -> tuple[np.ndarray, np.ndarray]:
    """(singular values falling, right singular vectors as columns) of ``X``, at least the first ``wanted``.

    ``step(w)`` gives ``X' X w`` and ``|X w|^2``; ``energy`` is ``|X|^2``, the sum of all squared entries.
    """
    rng = np.random.default_rng(20)
    size = np.sqrt(energy)

    def off(y: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):  # twice is enough
            if basis:
                q = np.array(basis)
                y = y - q.T @ (q @ y)
        return y

    def fresh(basis: list[np.ndarray]) -> np.ndarray:
        y = off(rng.standard_normal(dim), basis)
        return y / np.linalg.norm(y)

    v = [fresh([])]
    p, xu, a, b = [], [], [], []
    while True:
        w = v[-1] - b[-1] * p[-1] if p else v[-1]
        z, square = step(w)
        if p:
            c = np.array(p) @ z  # u_j' u of all vectors before
            w, z = w - c @ np.array(p), z - c @ np.array(xu)
            square -= c @ c
        alpha = float(np.sqrt(max(square, 0.0)))
        if alpha <= TINY * size:
            alpha, w, z = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            w, z = w / alpha, z / alpha
        a.append(alpha)
        p.append(w)
        xu.append(z)
        k = len(a)
        y = off(z - alpha * v[-1], v)
        beta = float(np.linalg.norm(y)) if alpha else 0.0
        small = np.diag(a) + np.diag(b, 1)
        left, s, right = np.linalg.svd(small)
        if k == dim:
            break
        if k >= wanted:
            held = s[:wanted]
            outside = energy - float((small ** 2).sum())
            if (beta * np.abs(left[-1, :wanted])).max() <= SETTLED * s[0] and outside <= held[-1] ** 2:
                break
        if beta <= TINY * size:
            beta, y = 0.0, fresh(v)
        else:
            y = y / beta
        b.append(beta)
        v.append(y)
    return s, np.array(v).T @ right.T


def whiten(rows: DataFrame, components: int = 32, ident: str = "vec_id", vector: str = "embedding", scale: int = 64
           ) -> DataFrame:
    """Whitened coordinates: a row for each embedding and component, up to ``components`` of them.

    Components become the integers ``floor(scale * c) + 1000000``. ``deviation`` is the squared distance from the mean
    times the squared number of rows, exact; ``whitened`` the centred row projected on a unit eigenvector of the
    covariance over the root of its eigenvalue; ``explained`` that eigenvalue's share of all variance;
    ``identity_error`` how far the covariance of the whitened rows is from the identity, measured over all rows.

    Which vectors take no part is said in :func:`whole_numbers`. A null id stays, as do repeated rows and ids: each row
    counts. Equal eigenvalues (ties) have some orthonormal choice of components, the same for all rows. Directions
    without variance are no components: with fewer than two distinct rows, or none, the result is empty. Further
    columns are not read, whatever their names. A deviation beyond 64 bits raises OverflowError.
    """
    spark = rows.sparkSession
    blocks = stored(in_blocks(whole_numbers(rows.select(F.col(ident).alias("_id"), F.col(vector).alias("_v")), "_v", scale)
                              .select("_id", F.transform("_x", lambda c: c + SHIFT).alias("_x")), "_id"), "vectors")
    sums = total(blocks, lambda x: np.concatenate([x.sum(axis=0), [len(x)]]), "long")
    if not len(sums):
        return spark.createDataFrame([], RESULT)
    n, dim = int(sums[-1]), len(sums) - 1
    centre = Centre(sums[:-1], n)
    energy = float(total(blocks, lambda x: np.array([(centre.rows(x) ** 2).sum()]), "double")[0])
    if energy == 0:
        return spark.createDataFrame([], RESULT)

    def step(w: np.ndarray) -> tuple[np.ndarray, float]:
        def products(x: np.ndarray) -> np.ndarray:
            c = centre.rows(x)
            u = c @ w
            return np.append(c.T @ u, u @ u)
        out = total(blocks, products, "double")
        return out[:-1], float(out[-1])

    s, vectors = bidiagonalise(step, dim, energy, min(components, dim))
    r = int((s[:components] > FLAT * s[0]).sum())
    project = vectors[:, :r] * (np.sqrt(n) / s[:r])
    explained = s[:r] ** 2 / energy

    def moments(x: np.ndarray) -> np.ndarray:
        y = centre.rows(x) @ project
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])
    m = total(blocks, moments, "double")
    mean = m[:r] / n
    error = float(np.abs(m[r:].reshape(r, r) / n - np.outer(mean, mean) - np.eye(r)).max())

    def run(batches):
        for b in batches:
            for ids, _, x in matrices(b):
                for i in range(0, len(x), max(1, ROWS_AT_ONCE // r)):
                    part = x[i:i + max(1, ROWS_AT_ONCE // r)]
                    k = len(part)
                    each = lambda values: pa.array(np.repeat(values, r))
                    yield pa.RecordBatch.from_arrays([
                        ids.slice(i, k).take(each(np.arange(k))), pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), k)),
                        each(np.full(k, n)), each(centre.deviation(part)), pa.array((centre.rows(part) @ project).ravel()),
                        pa.array(np.tile(explained, k)), each(np.full(k, error))],
                        [c.split()[0] for c in RESULT.split(", ")])

    return blocks.mapInArrow(run, RESULT)
