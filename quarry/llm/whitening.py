"""Whitening of embeddings on their leading components, by Chebyshev-filtered subspace iteration.

Entries become integers, so means and deviations are exact. The covariance V is never formed: a
pass over the written vectors computes the product V Q = Xc' (Xc Q) / n of centred rows with a block Q of a few
dozen columns, summed per dimension by Spark. A filter applies a Chebyshev polynomial of V to the
block by its three-term recurrence, one pass a degree; it damps the spectrum below the block's
least Ritz value. QR and Rayleigh-Ritz follow, and this repeats until the residuals of all wanted
components certify them. A Lanczos column that travels with the first filter tells where the
spectrum ends below.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, table
from quarry.llm.embedding_dedup import lists

#: Columns of the block for each wanted component; the further ones speed up the filter.
GUARD = 4
#: Greatest degree of a filter, and greatest ratio of its values (its logarithm) within a block.
MOST_DEGREE, MOST_RATIO = 10, 20.0
#: Residuals, as shares of the greatest eigenvalue: aimed at, and the least that certifies.
AIM, CERTAIN = 5e-15, 1e-11
MOST_ROUNDS = 500
EXACT = 2.0**53


def integers(df: DataFrame, scale: int, shift: int, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """vec_id, x (packed int64): floor(scale * c) + shift; vectors that take no part are left out. Entries beyond 2**53 are an error."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), *[F.col(c).alias(f"m{i}") for i, c in enumerate(more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for c in lists(batch.column(1)):
                if c is None or not np.isfinite(c).all():
                    found.append(None)
                    continue
                x = np.floor(scale * c) + shift
                if np.abs(x).max(initial=0.0) >= EXACT:
                    raise ValueError("an entry is too large for exact integers")
                found.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), *batch.columns[2:]], ["vec_id", "x", *batch.schema.names[2:]])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "v"]
    return rows.mapInArrow(run, ", ".join([fields[0], "x binary", *fields[1:]])).where("x is not null")


def matrix(column: pa.Array, width: int, fill: int) -> np.ndarray:
    """Rows of packed integers; shorter vectors are filled up with ``fill``. Rows of one length are read in place."""
    ends = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view("<i8") if len(column) else np.empty(0, "<i8")
    sizes = np.diff(ends) // 8
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.full((len(column), width), fill, dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Fit:
    """The vectors with their exact count and sums; ``product`` is a pass over them."""

    def __init__(self, rows: DataFrame, shift: int):
        self.rows, self.shift, self.n = rows, shift, rows.count()
        own = self.per_dimension(lambda: _Sums(), "n long, s long")
        self.width = len(own)
        self.sums = [s + (self.n - n) * shift for n, s in own]
        self.whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.part = np.array([s % self.n / self.n for s in self.sums])

    def per_dimension(self, make: Callable[[], object], fields: str) -> list[tuple]:
        """Sums over all tasks of what ``make()`` adds up in each, one row per dimension (few; the driver holds them)."""
        names = [f.split(" ")[0] for f in fields.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            work = make()
            for batch in batches:
                if batch.num_rows:
                    work.add(batch.column(0))
            columns = work.columns()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(columns[0]), dtype=np.int32)), *map(pa.array, columns)], ["i", *names])

        parts = self.rows.select("x").mapInArrow(run, f"i int, {fields}")
        return [tuple(r)[1:] for r in sorted(parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect())]

    def centred(self) -> Callable[[pa.Array], np.ndarray]:
        width, shift, whole, part = self.width, self.shift, self.whole, self.part
        return lambda column: (matrix(column, width, shift) - whole).astype(np.float64) - part  # x - S/n, rounded once

    def gram(self, q: np.ndarray) -> np.ndarray:
        """V Q, a pass over all rows."""
        centred = self.centred()
        fields = ", ".join(f"y{j} double" for j in range(q.shape[1]))
        return np.array(self.per_dimension(lambda: _Product(centred, q), fields)) / self.n

    def whitened(self, p: np.ndarray) -> tuple[np.ndarray, float]:
        """(covariance of the whitened rows, trace of V), a pass over all rows."""
        centred, k = self.centred(), p.shape[1]
        fields = ", ".join(f"y{j} double" for j in range(k + 2))
        found = np.array(self.per_dimension(lambda: _Moments(centred, p), fields)) / self.n
        return found[:, :k] - np.outer(found[:, k], found[:, k]), float(found[0, k + 1] if k else 0.0)


class _Sums:
    def __init__(self) -> None:
        self.n = self.s = np.zeros(0, dtype=np.int64)

    def add(self, column: pa.Array) -> None:
        sizes = np.array([len(b) // 8 for b in column.to_pylist()])
        width = max(int(sizes.max()), len(self.n))
        x, has = matrix(column, width, 0), np.arange(width) < sizes[:, None]
        pad = [np.pad(a, (0, width - len(a))) for a in (self.n, self.s)]
        if np.abs(x).max(initial=0) * float(len(x)) + np.abs(pad[1]).max(initial=0) >= 2.0**62:
            raise OverflowError("sums beyond 64 bits")
        self.n, self.s = pad[0] + has.sum(0), pad[1] + x.sum(0)

    def columns(self) -> list[np.ndarray]:
        return [self.n, self.s]


class _Product:
    def __init__(self, centred: Callable, q: np.ndarray):
        self.centred, self.q, self.y = centred, q, np.zeros(q.shape)

    def add(self, column: pa.Array) -> None:
        x = self.centred(column)
        self.y += x.T @ (x @ self.q)

    def columns(self) -> list[np.ndarray]:
        return list(self.y.T)


class _Moments:
    def __init__(self, centred: Callable, p: np.ndarray):
        k = p.shape[1]
        self.centred, self.p, self.y = centred, p, np.zeros((k, k + 2))

    def add(self, column: pa.Array) -> None:
        x = self.centred(column)
        w = x @ self.p
        self.y[:, :-2] += w.T @ w
        self.y[:, -2] += w.sum(0)
        self.y[0, -1] += np.einsum("ij,ij->", x, x)

    def columns(self) -> list[np.ndarray]:
        return list(self.y.T)


class Lanczos:
    """A Krylov sequence of single vectors, fed one product a pass; bounds the spectrum from below."""

    def __init__(self, width: int, seed: int):
        v = np.random.default_rng([seed, width]).standard_normal(width)
        self.basis, self.alpha, self.beta = [v / np.linalg.norm(v)], [], []

    def take(self, product: np.ndarray) -> None:
        v = self.basis[-1]
        self.alpha.append(float(v @ product))
        f = product.copy()
        for _ in range(2):  # in full against all before: there are few
            for b in self.basis:
                f -= (b @ f) * b
        self.beta.append(float(np.linalg.norm(f)))
        self.basis.append(f / self.beta[-1] if self.beta[-1] > 0 else np.zeros_like(f))

    def least(self) -> float:
        """The least Ritz value less its residual, at least zero (V has no negative eigenvalue)."""
        m = len(self.alpha)
        t = np.diag(self.alpha) + np.diag(self.beta[: m - 1], 1) + np.diag(self.beta[: m - 1], -1)
        values, vectors = np.linalg.eigh(t)
        return max(0.0, float(values[0] - abs(self.beta[-1] * vectors[-1, 0])))


def degree_for(values: np.ndarray, low: float, high: float) -> int:
    """As high a degree as keeps the filter's values within a block comparable."""
    half = (high - low) / 2
    growth = math.acosh(max(1.0, (values[0] - (high + low) / 2) / half)) if half > 0 else math.inf
    return int(max(2, min(MOST_DEGREE, MOST_RATIO // growth))) if growth > 0 else MOST_DEGREE


def leading(gram: Callable[[np.ndarray], np.ndarray], width: int, k: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns): the ``k`` greatest of the matrix that ``gram`` multiplies with, certified."""
    m = min(width, GUARD * k)
    q = np.linalg.qr(np.random.default_rng([seed, width, m]).standard_normal((width, m)))[0]
    krylov: Lanczos | None = Lanczos(width, seed)
    low, last = 0.0, math.inf

    def travelling(y: np.ndarray) -> np.ndarray:
        """A pass for the block and, in the first rounds, for the Lanczos column."""
        if krylov is None:
            return gram(y)
        both = gram(np.column_stack([y, krylov.basis[-1]]))
        krylov.take(both[:, -1])
        return both[:, :-1]

    for turn in range(MOST_ROUNDS):
        product = travelling(q)
        h = q.T @ product
        values, turned = np.linalg.eigh((h + h.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        q, product = q @ turned, product @ turned
        top = max(float(values[0]), 0.0)
        residual = float(np.linalg.norm(product[:, :k] - q[:, :k] * values[:k], axis=0).max(initial=0.0))
        if residual <= AIM * top or m == width or (residual <= CERTAIN * top and residual > last / 2):
            break  # certain, or certain and as good as double precision lets it become
        last = residual
        if turn == 1 and krylov is not None:
            low, krylov = krylov.least(), None
        high = float(values[-1])
        low = min(low, high * (1 - 1e-6))
        centre, half = (high + low) / 2, (high - low) / 2
        sigma = first = half / (top - centre)
        before, y = q, (product - centre * q) * (sigma / half)
        for _ in range(degree_for(values, low, high) - 1):
            new = 1 / (2 / first - sigma)
            before, y = y, (travelling(y) - centre * y) * (2 * new / half) - (sigma * new) * before
            sigma = new
        q = np.linalg.qr(y)[0]
    if m < width and residual > CERTAIN * top:
        raise ArithmeticError(f"components not certified: residual {residual} of {top}")
    return values[:k], q[:, :k]


def whiten(df: DataFrame, k: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: ``k`` rows a vector (fewer if vectors are shorter).

    Null vectors and those with null or non-finite entries are dropped; shorter vectors count as
    filled up with zeros; null and repeated ids stay, each row by itself; other columns are ignored,
    whatever their names. A component whose eigenvalue is numerically zero (a constant or repeated
    direction) has null as ``whitened`` and no part in identity_error. No vectors, or only empty
    ones: no rows. Equal eigenvalues: any basis of theirs, the same for all rows. Entries beyond
    2**53 and deviations beyond 64 bits are an error.
    """
    rows = cut(integers(df, scale, shift, id_col, vector_col))
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = Fit(rows, shift) if rows.take(1) else None
    if fit is None or not fit.width:
        return df.sparkSession.createDataFrame([], schema)
    values, vectors = leading(fit.gram, fit.width, min(k, fit.width))
    k = len(values)
    alive = values > values[0] * 1e-12 if values[0] > 0 else np.zeros(k, bool)
    p = vectors / np.sqrt(np.where(alive, values, 1.0))
    covariance, trace = fit.whitened(p)
    off = np.abs(covariance - np.eye(k))[np.ix_(alive, alive)].max(initial=0.0)
    explained = np.where(alive, values, np.maximum(values, 0.0)) / trace if trace > 0 else np.zeros(k)
    centred, n, width, sums = fit.centred(), fit.n, fit.width, fit.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x, c = matrix(part.column(1), width, shift), centred(part.column(1))
                size, deviation = len(x), exact_deviation(x, n, sums)
                white = np.where(alive, c @ p, np.nan)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(size), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                        pa.array(np.full(size * k, n, dtype=np.int64)),
                        pa.array(np.repeat(np.array(deviation, dtype=np.int64), k)),
                        pa.array(white.ravel(), from_pandas=True),
                        pa.array(np.tile(explained, size)),
                        pa.array(np.full(size * k, off)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)


def exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n*x - S)**2 for each row, in 64 bits where a bound shows that it fits, else in whole numbers."""
    most = max([abs(n * e - s) for e, s in [*zip(x.min(0).tolist(), sums, strict=True), *zip(x.max(0).tolist(), sums, strict=True)]], default=0) if len(x) else 0
    if n * int(np.abs(x).max(initial=0)) < 2**62 and most * most * x.shape[1] < 2**63:
        away = n * x - np.array(sums, dtype=np.int64)
        return np.einsum("ij,ij->i", away, away).tolist()
    found = [sum((n * e - s) ** 2 for e, s in zip(row, sums, strict=True)) for row in x.tolist()]
    if max(found) >= 2**63:
        raise OverflowError("a deviation is beyond 64 bits")
    return found


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the eight leading components of all."""
    return whiten(table(spark, sf_dir, "embeddings"))
