"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers x = floor(scale * entry) + shift; each distinct x vector is
one row of the fit list, so copies weigh nothing. The centred fit list X (n rows, d
columns, row i is x_i less the mean) is never gathered: a step makes the distributed
product y = Xv, orthogonalises it against all earlier left vectors, and makes the product
of its transpose with the result, which is orthogonalised against all earlier right
vectors. The right vectors (d numbers each) and the bidiagonal's entries are all that the
driver holds. A left vector has a number a row; it is never stored: it is X times a
known combination of the right vectors, which tasks work out again from their rows.
The small bidiagonal's singular vectors give the components, its singular values
the deviations.

All d steps are made, and a step that finds nothing new starts from a fresh direction, so
equal eigenvalues and constant or dependent dimensions cost no component. Sums of whole
numbers are exact; a task adds 2d doubles, and at most ``TASKS_BYTES`` of such sums reach
the driver a product.

A null vector, and one with a null or non-finite entry, is dropped, as is one whose entry
is beyond the whole numbers that a double can hold, or whose length is not the commonest
(of equally common ones the longest). Repeated rows each give their result; a null vec_id
stays null; directions without any deviation give no rows, so one distinct vector, or none,
gives none. ``deviation`` is null where it exceeds a long. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stage

#: Rows of a block of the fit list; bytes of all tasks' sums that the driver takes at once.
BLOCK_ROWS, TASKS_BYTES = 4096, 64 << 20
EXACT = float(1 << 52)


def whole_vectors(rows: DataFrame, column: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, x) of the rows that have a usable vector of the commonest length."""
    v = F.transform(F.col(column), lambda e: e.cast("double") * scale)
    good = F.coalesce(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < EXACT)), F.lit(False))
    sized = rows.select("vec_id", F.when(good, v).alias("v")).filter(F.size("v") > 0).withColumn("d", F.size("v"))
    most = sized.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    x = F.transform("v", lambda e: F.floor(e) + shift)
    return sized.filter(F.col("d") == (most["d"] if most else 0)).select("vec_id", x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def pack(batches):
    """Rows of vectors as blocks of whole numbers."""
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK_ROWS):
            x = np.ascontiguousarray(matrix(b.column(0).slice(lo, BLOCK_ROWS)), "<i8")
            yield pa.record_batch([pa.array([len(x)]), pa.array([x.tobytes()], pa.binary())], ["rows", "x"])


class FitList:
    """The distinct vectors in blocks, with their number and sums: distributed sums over the centred rows."""

    def __init__(self, vectors: DataFrame, folder: str):
        self.spark = vectors.sparkSession
        self.blocks = stage(vectors.select("x").distinct().mapInArrow(pack, "rows bigint, x binary"), folder)
        self.n = self.blocks.agg(F.sum("rows")).first()[0] or 0
        first = self.blocks.select("rows", "x").first()
        self.d = len(first["x"]) // 8 // first["rows"] if first else 0
        if self.n:
            self.blocks = self.blocks.coalesce(max(64, TASKS_BYTES // (16 * self.d + 64)))
            self.sums = self._whole_sums()

    def _whole_sums(self) -> list[int]:
        d = self.d

        def add(batches):
            s = np.zeros(d, object)
            for b in batches:
                for x in b.column("x"):
                    s += np.frombuffer(x.as_buffer(), "<i8").reshape(-1, d).sum(0)
            yield pa.record_batch([pa.array([[str(v) for v in s]])], ["s"])

        return [sum(int(r["s"][i]) for r in self.rows(add, "s array<string>")) for i in range(d)]

    def rows(self, add: Callable, schema: str) -> list:
        return self.blocks.mapInArrow(add, schema).collect()

    def total(self, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of part(centred block) over all blocks; tasks add in the blocks' order, the driver the tasks' sums."""
        d, n, sums = self.d, self.n, self.sums

        def add(batches):
            s = None
            for b in batches:
                for x in b.column("x"):
                    own = part(centred(np.frombuffer(x.as_buffer(), "<i8").reshape(-1, d), n, sums))
                    s = own if s is None else s + own
            if s is not None:
                yield pa.record_batch([pa.array([s.tolist()], pa.list_(pa.float64()))], ["s"])

        return np.sum([r["s"] for r in self.rows(add, "s array<double>")], axis=0)


def scaled_offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: whole numbers of 64 bits where they fit, Python's else."""
    base = [s // n for s in sums]
    rest = np.array([s - n * b for s, b in zip(sums, base)], np.int64)
    off = x - np.array(base, np.int64)
    if n * (float(np.abs(off).max(initial=0)) + 1) < 2.0**62:
        return off * n - rest
    return off.astype(object) * n - rest.astype(object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return scaled_offsets(x, n, sums).astype(float) / n


def against(basis: np.ndarray, v: np.ndarray) -> np.ndarray:
    """v without its part in the basis (rows), taken out twice."""
    for _ in range(2):
        v = v - basis.T @ (basis @ v)
    return v


def bidiagonalise(fit: FitList, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Right vectors (rows), diagonal and upper diagonal of the centred fit list's bidiagonal form."""
    d, random = fit.d, np.random.Generator(np.random.PCG64(seed))
    # Left vector k is X times combos[k], and its transposed product is products[k].
    right, combos, products = np.zeros((0, d)), np.zeros((0, d)), np.zeros((0, d))
    alpha, beta = [], []
    v = random.standard_normal(d)
    v /= np.linalg.norm(v)
    for k in range(d):
        own = combos.copy()
        # y = Xv against the earlier left vectors: the coefficients, and the length of y.
        first = fit.total(lambda x: np.append((x @ own.T).T @ (y := x @ v), y @ y))
        coef, size = first[:-1], np.sqrt(first[-1])
        p = v - own.T @ coef
        # Once more, with the transposed product of what is left.
        second = fit.total(lambda x: np.concatenate([(x @ own.T).T @ (y := x @ p), [y @ y], x.T @ y]))
        coef, left, z = second[: len(own)], second[len(own)], second[len(own) + 1 :]
        p, z = p - own.T @ coef, z - products.T @ coef
        a = float(np.sqrt(max(left - coef @ coef, 0.0)))
        right = np.vstack([right, v])
        if a > 1e-13 * max([size, *alpha]) and a > 0:
            p, z = p / a, z / a
        else:  # y adds no left vector
            a, p, z = 0.0, np.zeros(d), np.zeros(d)
        combos, products = np.vstack([combos, p]), np.vstack([products, z])
        alpha.append(a)
        if k == d - 1:
            break
        z = against(right, z - a * v)
        b = float(np.linalg.norm(z))
        if b > 1e-13 * max(alpha) and b > 0:
            v = z / b
        else:  # the directions so far are closed under X: go on from a new one
            b = 0.0
            v = against(right, random.standard_normal(d))
            v /= np.linalg.norm(v)
        v = against(right, v)
        v /= np.linalg.norm(v)
        beta.append(b)
    return right, np.array(alpha), np.array(beta)


def components(fit: FitList, most: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors (rows) and eigenvalues of the fit list's covariance, by falling value; none of deviation 0."""
    if fit.n < 2:
        return np.zeros((0, fit.d)), np.zeros(0)
    right, alpha, beta = bidiagonalise(fit)
    _, sigma, turn = np.linalg.svd(np.diag(alpha) + np.diag(beta, 1))
    sure = sigma > 1e-12 * max(sigma[0], 1e-300)
    own = np.linalg.qr((turn @ right)[sure][:most].T)[0].T if sure.any() else np.zeros((0, fit.d))
    return own, sigma[sure][:most] ** 2 / fit.n


def whiten(rows: DataFrame, column: str = "embedding", most: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component."""
    spark = rows.sparkSession
    folder = shared_dir(spark)
    vectors = stage(whole_vectors(rows, column, scale, shift), f"{folder}/vectors")
    fit = FitList(vectors, f"{folder}/fit")
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not fit.n:
        return spark.createDataFrame([], schema)
    axes, values = components(fit, most)
    if not len(values):
        return spark.createDataFrame([], schema)
    n, sums, k = fit.n, fit.sums, len(values)
    trace = float(fit.total(lambda x: np.array([np.sum(x * x)]))[0]) / n
    to_white = axes.T / np.sqrt(values)
    mean = fit.total(lambda x: (x @ to_white).sum(0)) / n
    second = fit.total(lambda x: ((y := x @ to_white - mean).T @ y).ravel()).reshape(k, k) / n
    error = float(np.abs(second - np.eye(k)).max())
    explained = values / trace

    def project(batches):
        for b in batches:
            off = scaled_offsets(matrix(b.column("x")), n, sums)
            fits = off.dtype != object and off.shape[1] * float(np.abs(off).max(initial=0)) ** 2 < 2.0**62
            exact = (off**2).sum(1) if fits else [v if (v := sum(int(e) ** 2 for e in r)) < 2**63 else None for r in off]
            white = off.astype(float) / n @ to_white
            m = len(white)
            ids = pa.array(np.repeat(np.arange(m), k))
            yield pa.record_batch([
                b.column("vec_id").take(ids), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(exact, pa.int64()).take(ids),
                pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], [c.split()[0] for c in schema.split(", ")])

    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "x").mapInArrow(project, schema)
