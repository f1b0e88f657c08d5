"""Ensemble of shape functions: ten histograms of 64 bins per segment over triples of its points.

The original draws triples at random; here each point opens three of them with points at fixed steps behind it in a fixed order, so
that every engine and every run agrees and the work grows with the points. Points that lie on a line between two points of a
triple tell whether it runs inside the segment, outside of it or both.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravox.functions.geometry import AXES
from terravox.ship import ship
from terravox.sources.tables import PTS_LI, lineitem_points

BINS, GRID, SAMPLES = 64, 16, 6
TURNS = ((1, 2), (1, 3), (2, 7))
#: The edges of a triple, by the numbers of its points; the angle of a corner goes with the edge opposite to it.
EDGES = ((1, 2), (0, 2), (0, 1))
SIDE = "sqrt((x{0} - x{1}) * (x{0} - x{1}) + (y{0} - y{1}) * (y{0} - y{1}) + (z{0} - z{1}) * (z{0} - z{1}))"
CELL = "CAST(floor(x) * 256 + floor(y) * 16 + floor(z) AS BIGINT)"


def _clamped(value: str) -> str:
    """A coordinate inside the grid; its far border belongs to the last cell."""
    return f"least(greatest(round({value}, 6), 0), 15.999)"


def _binned(share: str) -> str:
    """The bin of a value in [0, 1]."""
    return f"CAST(least(floor(round({share}, 6) * {BINS}), {BINS - 1}) AS BIGINT)"


def _kind(hits: str) -> str:
    return f"CASE WHEN {hits} = {SAMPLES} THEN 'in' WHEN {hits} = 0 THEN 'out' ELSE 'mixed' END"


def _corner(i: int) -> str:
    """The angle at a corner as a share of a half turn; 0 where a side has no length."""
    a, (b, c) = f"d{i}", (f"d{k}" for k in range(3) if k != i)
    cosine = f"({b} * {b} + {c} * {c} - {a} * {a}) / (2 * {b} * {c})"
    return f"CASE WHEN {b} > 0 AND {c} > 0 THEN acos(least(1.0, greatest(-1.0, {cosine}))) / 3.141592653589793 ELSE 0.0 END"


AREA = "sqrt(sqrt(greatest((d0 + d1 + d2) * (d1 + d2 - d0) * (d0 + d2 - d1) * (d0 + d1 - d2), 0.0)) / 4)"
#: (histogram's family, what its class is read from, its value in [0, 1]).
VALUES = [
    *[("a3", _kind(f"h{i}"), _corner(i)) for i in range(3)],
    ("d3", f"CASE WHEN h0 + h1 + h2 = {3 * SAMPLES} THEN 'in' WHEN h0 + h1 + h2 = 0 THEN 'out' ELSE 'mixed' END", f"{AREA} / {GRID}"),
    *[("d2", _kind(f"h{i}"), f"d{i} / {GRID * 1.7320508075688772}") for i in range(3)],
    *[("ratio", "'all'", f"CAST(h{i} AS DOUBLE) / {SAMPLES}") for i in range(3)],
]


#: The kinds of the histograms in the order of their numbers; a place is a histogram's number times BINS, plus the bin.
KINDS = [f"{family}_{kind}" for family in ("a3", "d3", "d2") for kind in ("in", "out", "mixed")] + ["ratio_all"]
STEPS = sorted({s for t in TURNS for s in t})
#: Rows of an Arrow batch that are worked on at a time.
ROWS = 8192


def _rounded(value: float) -> float:
    return float(Decimal(repr(value)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def _floored(values: np.ndarray, times: int = 1) -> np.ndarray:
    """floor(round(value, 6) * times): values that all but lie on a limit are rounded as SQL rounds them, the others need not be."""
    moved = (values + 5e-7) * times
    out = np.floor(moved)
    for at in zip(*np.nonzero(np.abs(moved - np.rint(moved)) < 1e-9 * times)):
        out[at] = np.floor(_rounded(float(values[at])) * times)
    return out


def _bins(share: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """As _binned; least() passes over what is null."""
    return np.where(lost, BINS - 1, np.fmin(_floored(share, BINS), BINS - 1)).astype("i8")


def _kinds(hits: np.ndarray, most: int) -> np.ndarray:
    return np.where(hits == most, 0, np.where(hits == 0, 1, 2))


def _places(at: np.ndarray, lost: np.ndarray, occupied: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places (triple, value) in the histograms. at, lost: (triple, point, axis), lost where null; occupied: (segment, cell); of: the segments."""
    sides, hits = [], []
    steps = np.arange(1, SAMPLES + 1)[None, :, None]
    for p, q in EDGES:
        gap = at[:, p] - at[:, q]
        sides.append(np.sqrt(gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2]))
        on = _floored(at[:, p, None] + (at[:, q] - at[:, p])[:, None] * steps / (SAMPLES + 1))
        on = np.fmin(np.maximum(on, 0), GRID - 1)
        on[np.broadcast_to((lost[:, p] | lost[:, q])[:, None], on.shape)] = 0
        cell = (on @ np.array([GRID * GRID, GRID, 1.0])).astype("i8")
        hits.append(occupied[of[:, None], cell].sum(axis=1))
    d, h = np.stack(sides, axis=1), np.stack(hits, axis=1)
    gone = np.stack([(lost[:, p] | lost[:, q]).any(axis=1) for p, q in EDGES], axis=1)
    out = []
    # As in Spark, what is not a number is above all numbers.
    long = ~gone & ((d > 0) | np.isnan(d))
    for i, (j, k) in enumerate(EDGES):
        a, b, c = d[:, i], d[:, j], d[:, k]
        cosine = np.where(gone[:, i], -1.0, np.fmin(np.maximum((b * b + c * c - a * a) / (2 * b * c), -1.0), 1.0))
        angle = np.where(long[:, j] & long[:, k], np.arccos(cosine) / 3.141592653589793, 0.0)
        out.append(_kinds(h[:, i], SAMPLES) * BINS + _bins(angle, np.zeros(len(d), bool)))
    d0, d1, d2 = d.T
    area = np.sqrt(np.sqrt(np.where(gone.any(axis=1), 0.0, np.maximum((d0 + d1 + d2) * (d1 + d2 - d0) * (d0 + d2 - d1) * (d0 + d1 - d2), 0.0))) / 4)
    out.append((3 + _kinds(h.sum(axis=1), 3 * SAMPLES)) * BINS + _bins(area / GRID, np.zeros(len(d), bool)))
    out += [(6 + _kinds(h[:, i], SAMPLES)) * BINS + _bins(d[:, i] / (GRID * 1.7320508075688772), gone[:, i]) for i in range(3)]
    out += [9 * BINS + _bins(h[:, i] / SAMPLES, np.zeros(len(d), bool)) for i in range(3)]
    return np.stack(out, axis=1)


def _counted(batches):
    """(segment, place, n, total) of rows that come segment by segment, in a segment's first row the bits of its occupied cells."""
    most = len(KINDS) * BINS
    held, occupied, counts = None, np.zeros((0, GRID**3), "u1"), np.zeros((0, most), "i8")

    def rows(ids, counts):
        of, place = np.nonzero(counts)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(place), pa.array(counts[of, place]), pa.array(counts.sum(axis=1)[of])], names=["segment", "place", "n", "total"])

    def numbers(batch, names):
        found = [batch.column(c) for c in names]
        return np.stack([c.to_numpy(zero_copy_only=False).astype("f8") for c in found], axis=1), np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in found], axis=1)

    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            bits = batch.column("bits")
            starts = np.flatnonzero(bits.is_valid().to_numpy(zero_copy_only=False))
            fresh = np.unpackbits(np.frombuffer(b"".join(b.as_py() for b in bits.take(pa.array(starts))), "u1").reshape(len(starts), GRID**3 // 8), axis=1, bitorder="little")
            # The last segment of the rows before may go on.
            occupied, before = np.concatenate([occupied[-1:], fresh]), len(counts)
            ids = batch.column("segment").take(pa.array(starts))
            ids = pa.concat_arrays([held, ids]) if before else ids
            begun = np.zeros(batch.num_rows, "i8")
            begun[starts] = 1
            of = np.cumsum(begun) - (0 if before else 1)
            (low, no_low), (size, _) = numbers(batch, [f"low_{a}" for a in AXES]), numbers(batch, ["size"])
            at, lost = zip(*[numbers(batch, [f"{a}_{s}" for a in AXES]) for s in (0, *STEPS)])
            with np.errstate(divide="ignore", invalid="ignore"):
                scaled = dict(zip((0, *STEPS), [(x - low) / size * GRID for x in at]))
                lost = dict(zip((0, *STEPS), [n | no_low for n in lost]))
                found = np.zeros(len(ids) * most, "i8")
                for first, second in TURNS:
                    ok = ~lost[second][:, 0]
                    three = lambda of_step: np.stack([of_step[s][ok] for s in (0, first, second)], axis=1)
                    places = _places(three(scaled), three(lost), occupied, of[ok])
                    found += np.bincount((of[ok][:, None] * most + places).ravel(), minlength=len(found))
            found = found.reshape(len(ids), most)
            found[:before] += counts
            yield rows(ids[:-1], found[:-1])
            held, occupied, counts = ids[-1:], occupied[-1:], found[-1:]
    if held is not None:
        yield rows(held, counts)


def ensemble(points: DataFrame, order: list[str]) -> DataFrame:
    """(segment, histogram, bin, n, share) of points (segment, x, y, z, and the columns of order); empty bins have no row.

    share is n over all values of the segment. Segments of fewer than three points have no row; those without extent fall into one cell.
    """
    ship(points.sparkSession)
    # One shuffle and one sort by segment: all windows share them, and what follows takes the rows as they come.
    w, whole = Window.partitionBy("segment").orderBy(*order), Window.partitionBy("segment")
    ahead = [F.lead(a, s).over(w).alias(f"{a}_{s}") for s in STEPS for a in AXES]
    all_of = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    extent = [f(a).over(all_of).alias(f"{n}_{a}") for n, f in (("low", F.min), ("high", F.max)) for a in AXES]
    boxed = points.filter("segment IS NOT NULL").select("segment", *AXES, F.row_number().over(w).alias("r"), *ahead, *extent)
    size = F.greatest(*[F.col(f"high_{a}") - F.col(f"low_{a}") for a in AXES])
    boxed = boxed.withColumn("size", F.when(size > 0, size).otherwise(F.lit(1.0)))
    grid = {a: F.expr(_clamped(f"(({a} - low_{a}) / size * {GRID})")) for a in AXES}
    cell = sum(F.floor(grid[a]) * step for a, step in zip(AXES, (GRID * GRID, GRID, 1))).cast("long")
    bits = F.substring(F.bitmap_construct_agg("cell").over(whole), 1, GRID**3 // 8)
    known = boxed.withColumn("cell", cell).withColumn("bits", F.when(F.col("r") == 1, bits))
    known = known.select("segment", *[F.col(a).alias(f"{a}_0") for a in AXES], *[f"{a}_{s}" for s in STEPS for a in AXES], *[f"low_{a}" for a in AXES], "size", "bits")
    filled = known.mapInArrow(_counted, f"segment {points.schema['segment'].dataType.simpleString()}, place long, n long, total long")
    histogram = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.expr(f"CAST(place DIV {BINS} + 1 AS INT)"))
    return filled.select("segment", histogram.alias("histogram"), (F.col("place") % BINS).alias("bin"), "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def shape_ensemble(spark, sf_dir):
    return ensemble(lineitem_points(spark, sf_dir), ["batch", "view", *AXES])


def _sql() -> str:
    lows = ", ".join(f"min({a}) low_{a}" for a in AXES)
    scaled = ", ".join(f"({a} - low_{a}) / (CASE WHEN size > 0 THEN size ELSE 1.0 END) * {GRID} {a}0" for a in AXES)
    turns = " UNION ALL ".join(
        f"SELECT segment, r, {t} turn, x0, y0, z0, " + ", ".join(f"lead({a}0, {s}) OVER (PARTITION BY segment ORDER BY r) {a}{k}" for k, s in ((1, first), (2, second)) for a in AXES) + " FROM s"
        for t, (first, second) in enumerate(TURNS)
    )
    sides = ", ".join(f"{SIDE.format(*e)} d{i}" for i, e in enumerate(EDGES))
    lines = " UNION ALL ".join(f"SELECT segment, r, turn, {i} edge, " + ", ".join(f"{_clamped(f'{a}{p} + ({a}{q} - {a}{p}) * k / {SAMPLES + 1}')} {a}" for a in AXES) + " FROM t, k" for i, (p, q) in enumerate(EDGES))
    hits = ", ".join(f"CAST(count(o.cell) FILTER (edge = {i}) AS BIGINT) h{i}" for i in range(3))
    values = " UNION ALL ".join(f"SELECT segment, concat('{family}_', {kind}) histogram, {_binned(value)} bin FROM c" for family, kind, value in VALUES)
    return f"""
WITH {PTS_LI}, b AS (SELECT segment, {lows}, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) size FROM pts GROUP BY 1),
s AS (SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY batch, view, x, y, z) r, {scaled} FROM pts JOIN b USING (segment)),
t AS (SELECT *, {sides} FROM ({turns}) WHERE x2 IS NOT NULL),
o AS (SELECT DISTINCT segment, {CELL} cell FROM (SELECT segment, {', '.join(f'{_clamped(f"{a}0")} {a}' for a in AXES)} FROM s)),
k AS (SELECT unnest(range(1, {SAMPLES + 1})) k), l AS (SELECT segment, r, turn, edge, {CELL} cell FROM ({lines})),
h AS (SELECT l.segment, r, turn, {hits} FROM l LEFT JOIN o USING (segment, cell) GROUP BY 1, 2, 3),
c AS (SELECT * FROM t JOIN h USING (segment, r, turn)), v AS ({values}), n AS (SELECT segment, histogram, bin, count(*) n FROM v GROUP BY 1, 2, 3)
SELECT segment, histogram, bin, n, round(n / sum(n) OVER (PARTITION BY segment), 6) share FROM n
"""


PACK = {"shape_ensemble": (shape_ensemble, _sql())}
