"""Embedding near-duplicates by product quantisation.

1. Vectors are checked and copies become one class, so only distinct vectors are compared.
2. On a bounded sample (``fit_rows``) coarse centres and, for the residuals, one codebook per subspace are fitted.
3. Every vector lies in the inverted list of its nearest centre, as codes with the norm of what they leave out.
   It is also compared in every other list whose plane it is near. If u lies nearer to centre b and v nearer to centre a, and
   they are at most the largest distance r apart, then their distances to the plane between a and b add up to at most r, so
   one of the two is within r / 2 of it. Each vector therefore probes, among all lists, those whose plane is within r / 2;
   a pair that both probes find counts in the list of the larger number. This is sufficient whatever the data.
   ``margin`` below 1 narrows the probes and can lose links.
4. In a list, table look-ups give the distance from a query to each decoded vector. If it exceeds r by more than the
   part that the codes leave out, the vectors cannot be linked; all others are ranked by exact cosine in double precision.
5. Counts per vector and a spanning forest of the links leave a task, never all pairs. Long lists are split by a salt.

Vectors of each dimension are a group of their own. Vectors that are null, zero, hold null or
non-finite components link with nothing. Rows that share an id count as one vector's
links; vectors with a null id keep their own component and are never its name unless all ids in it are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.llm.common import written
from terravox.operators.graph import components
from terravox.ship import ship

FIT_ROWS, SUBSPACES, CODES, LIST_ROWS, QUERY_ROWS = 16_384, 8, 256, 8192, 256


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        centres[used] = sums / np.diff(np.append(first, len(x)))[:, None]
    return centres


class Quantiser:
    """Coarse centres and residual codebooks for unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = _kmeans(sample, lists, 8, 1)
        residual = sample - self.centres[self.nearest(sample)]
        dim = sample.shape[1]
        cuts = [dim * m // SUBSPACES for m in range(SUBSPACES + 1)]
        self.spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
        self.books = [_kmeans(residual[:, a:b], CODES, 6, 2 + m) for m, (a, b) in enumerate(self.spans)]
        gaps = ((self.centres[:, None, :] - self.centres[None, :, :]) ** 2).sum(axis=2) if len(self.centres) <= 512 else self._gaps()
        self.gaps = np.sqrt(gaps)

    def _gaps(self) -> np.ndarray:
        norms = (self.centres**2).sum(axis=1)
        return np.maximum(norms[:, None] + norms[None, :] - 2 * self.centres @ self.centres.T, 0)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the centres, but for each vector's own norm."""
        return (self.centres**2).sum(axis=1)[None, :] - 2 * x @ self.centres.T

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x).argmin(axis=1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the norm of what they leave out."""
        residual = x - self.centres[lists]
        codes = np.empty((len(x), len(self.spans)), np.uint8)
        rest = np.zeros(len(x))
        for m, ((a, b), book) in enumerate(zip(self.spans, self.books)):
            part = residual[:, a:b]
            codes[:, m] = (part @ book.T - 0.5 * (book**2).sum(axis=1)).argmax(axis=1)
            rest += ((part - book[codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(rest)

    def probes(self, x: np.ndarray, home: np.ndarray, reach: float) -> list[np.ndarray]:
        """Per vector its home list and each other one whose plane to the home list is within reach."""
        d = self.distances(x)
        slack = d - d[np.arange(len(x)), home][:, None] - 2 * reach * self.gaps[home]
        ok = slack <= 1e-9
        ok[np.arange(len(x)), home] = True
        return [np.flatnonzero(row) for row in ok]

    def lookup(self, queries: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances, squared: each query to each coded vector of one list."""
        residual = queries - self.centres[number]
        out = np.zeros((len(queries), len(codes)))
        for m, ((a, b), book) in enumerate(zip(self.spans, self.books)):
            part = residual[:, a:b]
            table = (part**2).sum(axis=1)[:, None] + (book**2).sum(axis=1)[None, :] - 2 * part @ book.T
            out += table[:, codes[:, m]]
        return out


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.array([np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8") for v in raw], "<f8").reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The values of a binary column without nulls, each of ``width`` numbers."""
    if not len(column):
        return np.empty((0, width), kind)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, width)


def _unit_column(column: pa.Array, dim: int) -> np.ndarray:
    """As ``_unit``, for a whole column at a time."""
    x = np.empty((len(column), dim))
    short = pc.equal(pc.binary_length(column), 4 * dim)
    x[short.to_numpy(zero_copy_only=False)] = _matrix(column.filter(short), "<f4", dim)
    x[~short.to_numpy(zero_copy_only=False)] = _matrix(column.filter(pc.invert(short)), "<f8", dim)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _checked(batches):
    """(id, vec, dim): vec is null for vectors that link with nothing; single precision where that holds it exactly."""
    for batch in batches:
        vecs, dims = [], []
        for v in batch.column(1).to_pylist():
            x = None
            if v is not None and len(v) and None not in v:
                x = np.array(v, "<f8")
                top = np.abs(x).max()
                x = np.ldexp(x, -int(np.frexp(top)[1])) + 0.0 if np.isfinite(top) and top > 0 else None
            short = None if x is None else x.astype("<f4")
            vecs.append(None if x is None else short.tobytes() if (short == x).all() else x.tobytes())
            dims.append(0 if x is None else len(x))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vecs, pa.binary()), pa.array(dims, pa.int32())], names=["id", "vec", "dim"])


def _forest_task(quantiser, least_cosine: float, reach: float, dim: int):
    """Compares the queries of each (list, salt) with its stored vectors; stored rows come first."""

    def run(batches):
        q = quantiser.value
        at, stored = None, None

        def load(parts):
            node, copies, vec, codes, rest, probes = (pa.concat_arrays(c) for c in zip(*(p.columns[3:] for p in parts)))
            return {"node": node.to_numpy(), "copies": copies.to_numpy(), "x": _unit_column(vec, dim), "codes": _matrix(codes, "u1", len(q.spans)), "rest": rest.to_numpy(), "root": np.arange(len(node)), "probes": [frozenset(p) for p in probes.to_pylist()]}

        def compare(number: int, rows):
            node, copies, origin = rows.column("node").to_numpy(), rows.column("copies").to_numpy(), rows.column("rest").to_numpy().astype(np.int64)
            x = _unit_column(rows.column("vec"), dim)
            home = origin == number
            near = q.lookup(x, number, stored["codes"]) <= ((reach + stored["rest"]) ** 2 + 1e-9)[None, :]
            near &= node[:, None] != stored["node"][None, :]
            a, b = np.nonzero(near)
            linked = np.zeros(len(a), bool)
            for lo in range(0, len(a), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                linked[part] = np.einsum("ij,ij->i", x[a[part]], stored["x"][b[part]]) >= least_cosine
            # The list of the larger number counts a pair that both probes find.
            for i in np.flatnonzero(linked & (origin[a] > number)).tolist():
                linked[i] = int(origin[a[i]]) not in stored["probes"][b[i]]
            a, b = a[linked], b[linked]
            out = [(int(node[i]), int(n), None) for i, n in enumerate(np.bincount(a, stored["copies"][b], len(node))) if n]
            cross = ~home[a]
            out += [(int(stored["node"][i]), int(n), None) for i, n in enumerate(np.bincount(b[cross], copies[a[cross]], len(stored["node"]))) if n]
            cuts = np.searchsorted(a, np.arange(len(node) + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                partners = b[cuts[i] : cuts[i + 1]]
                roots, first = np.unique(stored["root"][partners], return_index=True)
                out += [(int(node[i]), 0, int(stored["node"][partners[j]])) for j in first.tolist()]
                if len(roots) > 1:
                    stored["root"][np.isin(stored["root"], roots)] = roots[0]
            return out

        def emit(out):
            cols = list(zip(*out)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["node", "links", "other"])

        fresh: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("list", "salt", "kind")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                number, salt, kind = keys[:, lo].tolist()
                if (number, salt) != at:
                    at, stored, fresh = (number, salt), None, []
                if kind == 0:
                    fresh.append(batch.slice(lo, hi - lo))
                    continue
                if fresh:
                    stored, fresh = load(fresh), []
                for some in range(lo, hi, QUERY_ROWS) if stored is not None else ():
                    yield emit(compare(number, batch.slice(some, min(QUERY_ROWS, hi - some))))

    return run


def near_vectors(vectors: DataFrame, least_cosine: float = 0.95, fit_rows: int = FIT_ROWS, lists: int | None = None, margin: float = 1.0,
                 id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept), one row per vector."""
    spark = ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = written(rows.mapInArrow(_checked, "id long, vec binary, dim int"), "vectors")
    sizes = {r["dim"]: r["count"] for r in rows.filter("dim > 0").groupBy("dim").count().collect()}
    dims = sorted(d for d, n in sizes.items() if n > 1)
    out = rows.filter(~F.col("dim").isin(dims)).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    for dim in dims:
        out = out.unionByName(_linked(rows.filter(F.col("dim") == dim), dim, least_cosine, fit_rows, lists, margin))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def _linked(rows: DataFrame, dim: int, least_cosine: float, fit_rows: int, lists: int | None, margin: float) -> DataFrame:
    """(id, n_links, component_id) for vectors of one dimension."""
    spark = rows.sparkSession
    reach = float(np.sqrt(max(0.0, 2 - 2 * least_cosine)))
    nameless = -F.shiftrightunsigned(F.xxhash64("vec"), 1) - 1
    classes = rows.groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = written(classes.select("vec", "copies", F.coalesce("least", nameless).alias("node")), "classes")
    n = classes.count()
    sample = classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(fit_rows).collect()
    lists = max(1, min(lists or int(n**0.5), 4096, len(sample) // 4 or 1))
    quantiser = spark.sparkContext.broadcast(Quantiser(_unit([r["vec"] for r in sample], dim), lists))

    def assign(batches):
        q = quantiser.value
        for batch in batches:
            if not len(batch):
                continue
            vec, copies, node = (batch.column(c).to_pylist() for c in ("vec", "copies", "node"))
            x = _unit(vec, dim)
            home = q.nearest(x)
            codes, rest = q.encode(x, home)
            probes = [p.tolist() for p in q.probes(x, home, margin * reach / 2)]
            cols = [pa.array(node, pa.int64()), pa.array(copies, pa.int64()), pa.array(vec, pa.binary()), pa.array(home, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest), pa.array(probes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "copies", "vec", "home", "codes", "rest", "probes"])

    listed = written(classes.mapInArrow(assign, "node long, copies long, vec binary, home int, codes binary, rest double, probes array<int>"), "lists")
    salts = listed.groupBy("home").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("salts"))
    stored = listed.join(F.broadcast(salts), "home").select(F.col("home").alias("list"), F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), F.lit(0).alias("kind"), "node", "copies", "vec", "codes", "rest", "probes")
    asked = listed.select("node", "copies", "vec", "home", F.explode("probes").alias("list")).join(F.broadcast(salts.withColumnRenamed("home", "list")), "list")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("kind"), "node", "copies", "vec", F.lit(None).cast("binary").alias("codes"), F.col("home").cast("double").alias("rest"), F.lit(None).cast("array<int>").alias("probes"))
    dealt = stored.unionByName(asked).repartition("list", "salt").sortWithinPartitions("list", "salt", "kind", "node")
    found = written(dealt.mapInArrow(_forest_task(quantiser, least_cosine, reach, dim), "node long, links long, other long"), "links")
    counts = found.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.filter("other IS NOT NULL").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    named = joined.groupBy("component").agg(F.min(F.when(F.col("node") >= 0, F.col("node"))).alias("least"))
    label = joined.join(named, "component").select("node", "least")
    per_class = classes.join(counts, "node", "left").join(label, "node", "left").select(
        "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", F.when(F.col("node") >= 0, F.col("node"))).alias("component_id"))
    return rows.join(per_class, "vec").select("id", "n_links", "component_id")
