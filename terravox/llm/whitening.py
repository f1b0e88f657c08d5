"""Whitening of embeddings along leading eigenvectors found by spectrum slicing.

1. A vector's entries c become integers x = floor(1024 c) + 100000. Two passes over the vectors give the exact sums S of each
   dimension and then, centred first, the exact products; the covariance V is their correctly rounded quotient.
2. V - s I is factored as L D L^T with pivots of order 1 and 2. By Sylvester's law the positive pivots count the eigenvalues
   above s, so halving an interval isolates each of the leading eigenvalues in turn.
3. Rayleigh quotient iteration, free of the vectors found before, converges cubically inside the interval; one that leaves it
   starts again in a narrower one. Counts on both sides of what it found certify its number. Equal eigenvalues leave an interval as
   narrow as rounding; each takes one more vector of their common space.
4. Vectors are projected in tasks. The covariance of the result, aggregated by Spark, gives its distance from the identity.

Vectors of each length are a group of their own, fitted apart. The driver holds one covariance per length that occurs, and tasks
send one row per pair of dimensions: both are bounded by the vectors' lengths, not by their number.

Edge cases: vectors that are null or hold null or non-finite entries have no rows, nor have empty ones; a null id is kept and repeated
rows count each. Directions without spread (an eigenvalue of at most 1e-12 of the trace) are no components, so equal vectors have
no rows. Entries beyond 2^53 / 1024 count as that. ``vectors`` is read three times: pass a written table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.llm.common import written
from terravox.ship import ship

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Eigenvalues of at most this share of the trace are no spread.
FLAT = 1e-12
_MOST = 2.0**53
_EXACT = pa.decimal128(38, 0)


def inertia(matrix: np.ndarray) -> tuple[int, int, int]:
    """How many eigenvalues of a symmetric matrix are negative, zero and positive, from the pivots of its factors L D L^T.

    A pivot that is small beside its column is exchanged, or joined by a second one to a block that has one eigenvalue of each sign.
    """
    a = np.array(matrix, float)
    n, k, counts = len(a), 0, [0, 0, 0]
    bound = (1 + np.sqrt(17)) / 8

    def exchange(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        pivot, column = a[k, k], np.abs(a[k + 1 :, k])
        top = column.max() if len(column) else 0.0
        single = abs(pivot) >= bound * top
        if not single:
            r = k + 1 + int(column.argmax())
            beside = np.abs(a[r, k:]).copy()
            beside[r - k] = 0.0
            widest = beside.max()
            if abs(pivot) * widest >= bound * top * top:
                single = True
            elif abs(a[r, r]) >= bound * widest:
                exchange(k, r)
                single = True
            else:
                exchange(k + 1, r)
        if single:
            pivot = a[k, k]
            counts[int(np.sign(pivot)) + 1] += 1
            if pivot:
                below = a[k + 1 :, k].copy()
                a[k + 1 :, k + 1 :] -= np.outer(below / pivot, below)
            k += 1
        else:
            counts[0] += 1
            counts[2] += 1
            below = a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= below @ np.linalg.solve(a[k : k + 2, k : k + 2], below.T)
            k += 2
    return counts[0], counts[1], counts[2]


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns): the ``most`` largest of a covariance, without those that are flat.

    A vector's largest entry is positive.
    """
    n, trace = len(v), float(np.trace(v))
    values, vectors = np.empty(0), np.empty((n, 0))
    if not trace > 0:
        return values, vectors
    eye, fine = np.eye(n), 8 * np.finfo(float).eps * trace
    known: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in known:
            known[shift] = inertia(v - shift * eye)[2]
        return known[shift]

    rng = np.random.default_rng(0)
    flat = FLAT * trace
    while len(values) < min(most, n) and above(flat) > len(values):
        k = len(values) + 1
        above(trace * (1 + 1e-9))
        lo = max(s for s, c in known.items() if c >= k)
        hi = min(s for s, c in known.items() if c < k)
        while True:
            isolated = above(lo) == k and above(hi) == k - 1
            if not isolated and hi - lo > fine:
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if above(mid) >= k else (lo, mid)
                continue
            found = _iterated(v, (lo + hi) / 2, vectors, rng, fine)
            if found is not None:
                value, vector = found
                slack = max(fine, 4 * fine * n**0.5 if hi - lo <= fine else fine)
                if lo - slack <= value <= hi + slack and above(value - slack) >= k and above(value + slack) < k:
                    break
            if hi - lo <= fine:
                if found is None:
                    raise ArithmeticError("an eigenvalue was isolated, but its vector was not found")
                break
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if above(mid) >= k else (lo, mid)
        values, vectors = np.append(values, value), np.column_stack([vectors, vector])
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])


def _iterated(v: np.ndarray, shift: float, others: np.ndarray, rng: np.random.Generator, fine: float):
    """(value, unit vector) that Rayleigh quotient iteration reaches from a shift, at right angles to others; None if it does not settle."""
    eye = np.eye(len(v))

    def free(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - others @ (others.T @ x)
        return x / np.sqrt(x @ x)

    def step(x: np.ndarray, s: float) -> np.ndarray:
        try:
            y = np.linalg.solve(v - s * eye, x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(v - (s + fine / 8) * eye, x)
        return free(y / np.abs(y).max())

    x = step(step(free(rng.standard_normal(len(v))), shift), shift)
    best = None
    for _ in range(12):
        value = float(x @ v @ x)
        gap = v @ x - value * x
        size = float(np.sqrt(gap @ gap))
        if best is not None and size >= best[0] / 2 and best[0] <= fine:
            break
        if best is None or size < best[0]:
            best = (size, value, x)
        x = step(x, value)
    return (best[1], best[2]) if best[0] <= fine else None


def _whole(batch: pa.RecordBatch):
    """(rows, x) for each length of vectors in an Arrow batch (id, vector): places of usable vectors, and their integers."""
    column = batch.column(1)
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    lengths = np.diff(ends)
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0) & (bad[ends[1:]] == bad[ends[:-1]])
    for n in np.unique(lengths[usable]).tolist():
        rows = np.flatnonzero(usable & (lengths == n))
        c = flat[ends[rows][:, None] + np.arange(n)]
        yield rows, np.clip(np.floor(c * SCALE), -_MOST, _MOST).astype(np.int64) + SHIFT


def _span(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min())))


class _Totals:
    """Exact sums of int64 arrays: in 64 bits while those surely hold them, as Python's integers beyond."""

    def __init__(self):
        self.short, self.bound, self.long = None, 0, None

    def add(self, values: np.ndarray, bound: int) -> None:
        if values.dtype == object or self.bound + bound >= 2**62:
            self.spill()
        if values.dtype == object:
            self.long = values if self.long is None else self.long + values
        else:
            self.short, self.bound = (values.copy() if self.short is None else self.short + values), self.bound + bound

    def spill(self) -> None:
        if self.short is not None:
            self.long = self.short.astype(object) + (0 if self.long is None else self.long)
        self.short, self.bound = None, 0

    def value(self) -> list[int]:
        self.spill()
        return [int(v) for v in self.long.ravel()]


def _emitted(totals: dict[int, _Totals]) -> pa.RecordBatch:
    dims, at, total = [], [], []
    for dim, t in totals.items():
        row = t.value()
        dims += [dim] * len(row)
        at += range(len(row))
        total += row
    from decimal import Decimal

    return pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(at, pa.int64()), pa.array([Decimal(v) for v in total], _EXACT)], names=["dim", "at", "total"])


def _sums(batches):
    """Per length of vectors, at each place the sum of that dimension, and behind them the number of vectors."""
    totals: dict[int, _Totals] = {}
    for batch in batches:
        for rows, x in _whole(batch):
            bound = _span(x) * len(x)
            row = x.sum(axis=0) if bound < 2**62 else x.astype(object).sum(axis=0)
            totals.setdefault(x.shape[1], _Totals()).add(np.append(row, len(rows)), bound)
    yield _emitted(totals)


def _products(y: np.ndarray) -> tuple[np.ndarray, int]:
    """Exact sums of the products of all columns, as the upper triangle; and a bound of them."""
    bound, upper = _span(y) ** 2 * len(y), np.triu_indices(y.shape[1])
    if bound < 2**53:
        return (y.T.astype(float) @ y.astype(float))[upper].astype(np.int64), bound
    if bound < 2**62:
        return (y.T @ y)[upper], bound
    return y.T.astype(object).dot(y.astype(object))[upper], bound


def _covariance(n: int, rest: list[int], products: dict[int, int]) -> np.ndarray:
    """Correctly rounded, from the exact sums of products of integers centred up to rest / n."""
    dim = len(rest)
    out = np.empty((dim, dim))
    for at, (i, j) in enumerate(zip(*np.triu_indices(dim))):
        out[i, j] = out[j, i] = (n * products[at] - rest[i] * rest[j]) / (n * n)
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> dict[int, dict]:
    """Per length of vectors: n, base and rest (S = n * base + rest), values, vectors and trace."""
    spark = ship(vectors.sparkSession)
    rows = _read(vectors, id_col, vector_col)
    kinds = "dim int, at long, total decimal(38,0)"
    models: dict[int, dict] = {}
    summed = rows.mapInArrow(_sums, kinds).groupBy("dim", "at").agg(F.sum("total").alias("total")).orderBy("dim", "at")
    for r in summed.toLocalIterator():
        models.setdefault(r["dim"], {"sums": []})["sums"].append(int(r["total"]))
    for m in models.values():
        m["n"] = n = m["sums"].pop()
        m["base"], m["rest"] = [s // n for s in m["sums"]], [s % n for s in m["sums"]]
    bases = spark.sparkContext.broadcast({dim: np.array(m["base"]) for dim, m in models.items()})

    def moments(batches):
        totals: dict[int, _Totals] = {}
        for batch in batches:
            for _, x in _whole(batch):
                for lo in range(0, len(x), 4096):
                    totals.setdefault(x.shape[1], _Totals()).add(*_products(x[lo : lo + 4096] - bases.value[x.shape[1]]))
        yield _emitted(totals)

    products: dict[int, dict[int, int]] = {dim: {} for dim in models}
    for r in rows.mapInArrow(moments, kinds).groupBy("dim", "at").agg(F.sum("total").alias("total")).toLocalIterator():
        products[r["dim"]][r["at"]] = int(r["total"])
    for dim, m in models.items():
        v = _covariance(m["n"], m["rest"], products.pop(dim))
        m["trace"] = float(np.trace(v))
        m["values"], m["vectors"] = leading(v, components)
    return models


def _read(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def project(vectors: DataFrame, models: dict[int, dict], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, dim, n, deviation, w): the exact deviation, as a decimal, and the whitened values of a vector's components."""
    sent = ship(vectors.sparkSession).sparkContext.broadcast(models)

    def run(batches):
        from decimal import Decimal

        for batch in batches:
            for rows, x in _whole(batch):
                dim = x.shape[1]
                m = sent.value[dim]
                n, rest = m["n"], np.array(m["rest"])
                y = x - np.array(m["base"])
                span = _span(y)
                short = span * span * dim < 2**62 and span * n * dim < 2**62
                y_, r_ = (y, rest) if short else (y.astype(object), rest.astype(object))
                squares, mixed, last = (y_ * y_).sum(axis=1), (y_ * r_).sum(axis=1), sum(r * r for r in m["rest"])
                deviation = [Decimal(n * n * int(a) - 2 * n * int(b) + last) for a, b in zip(squares, mixed)]
                w = (y - rest / n) @ (m["vectors"] / np.sqrt(m["values"]))
                many = w.shape[1]
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(w) * many + 1, many) if many else np.zeros(len(w) + 1), pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([dim] * len(rows), pa.int32()), pa.array([n] * len(rows), pa.int64()), pa.array(deviation, _EXACT), values], names=["id", "dim", "n", "deviation", "w"])

    return _read(vectors, id_col, vector_col).mapInArrow(run, "id long, dim int, n long, deviation decimal(38,0), w array<double>")


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, dim, component, n, deviation, whitened, explained, identity_error), one row per usable vector and component."""
    spark = vectors.sparkSession
    models = fit(vectors, components, id_col, vector_col)
    wide = written(project(vectors, models, id_col, vector_col), "whitened")
    w = [F.get("w", F.lit(i)) for i in range(components)]
    errors = [F.abs(F.covar_pop(w[i], w[j]) - float(i == j)) for i in range(components) for j in range(i, components)]
    # Components that a length does not have give nulls, which count for nothing.
    error = wide.groupBy("dim").agg(F.greatest(*errors, F.lit(0.0)).alias("identity_error"))
    shares = spark.createDataFrame([(dim, [float(e / m["trace"]) for e in m["values"]]) for dim, m in models.items()], "dim int, shares array<double>")
    rows = wide.join(F.broadcast(error), "dim").join(F.broadcast(shares), "dim").select("*", F.posexplode("w").alias("at", "whitened"))
    return rows.select("id", "dim", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("shares", "at").alias("explained"), "identity_error")
