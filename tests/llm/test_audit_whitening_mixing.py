"""Filter audit, whitening and mixing against plain Python, with the awkward rows of each contract."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.llm import filter_audit, mixing, whitening

DOCS = "doc_id long, text string, lang string, source string, id string, part string, size int, digest string, n int, dim int"


def documents(spark, rows):
    """Documents (id, text, lang, source) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y", 1, "z", 2, 3) for r in rows], DOCS)


def texts(seed, n):
    r = random.Random(seed)
    some = [" ".join(f"w{r.randrange(60)}" for _ in range(r.choice((3, 120, 150)))) for _ in range(n)]
    some += [" ".join(f"w{i}" for i in range(130)), "A B" * 300, "a | b", "", None, "ÄÖ é\x0b" * 120, " ".join(f"{i}$" for i in range(101)), "A" * 5 + "b" * 45]
    return some


def brute_audit(rows, labels):
    fails = []
    for i, text, lang, _ in rows:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        key = math.inf if i is None else i
        e = any((text or "") == (u or "") and (math.inf if j is None else j) < key for j, u, *_ in rows)
        bad = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": e}
        good, toxic = (any(x[k] == 1 for x in labels if i is not None and x[0] == i) for k in (1, 2))
        fails.append((lang or "", {f for f, x in bad.items() if x}, good, toxic))
    out = []
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        found = []
        for order in permutations("ABCDE"):
            for k, name in enumerate(order):
                gone = [f for f in mine if f[1] & set(order[:k])]
                left = [f for f in mine if not f[1] & set(order[:k])]
                removed = [f for f in left if name in f[1]]
                found.append(["".join(order), k + 1, len(left) - len(removed), len(removed), sum(name in f[1] for f in gone), sum(f[1] == {name} for f in mine), sum(f[2] for f in removed), sum(f[3] for f in removed)])
        for row in found:
            out.append((part, *row, sum(o[3] for o in found if o[0][o[1] - 1] == row[0][row[1] - 1])))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_retracts_over_batches(spark, tmp_path, seed):
    """Files come in any order of ids: masks counted early are taken back once a smaller id brings the same text."""
    r = random.Random(seed)
    some = texts(seed, 6)
    rows = [(r.choice([*range(25), None]), r.choice(some), r.choice(["en", "de", "", None]), None) for _ in range(70)]
    rows += [(40 - i, some[0], "en", None) for i in range(30)] + [rows[0], rows[0], (2**40, None, None, None), (-5, some[1], "fr", None)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(30)] + [(3, 1, 1), (None, 1, 1), (999, 1, 1)]
    path = str(tmp_path / "documents.parquet")
    for lo in range(0, len(rows), 20):
        documents(spark, rows[lo : lo + 20]).coalesce(1).write.mode("append").parquet(path)
    flags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, filter_audit.audit(spark, path, flags, batches=50).collect()))
    assert got == brute_audit(rows, labels)


def test_audit_of_nothing(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    documents(spark, []).write.parquet(path)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark, path, labels).count() == 0


def test_mask_of_a_very_long_text():
    """Words are cut some bytes at a time, and a word across the cut is one."""
    text = b"a" * (filter_audit.CHUNK - 1) + b"bc de " + b"de " * 300_000 + b"x" * (3 * filter_audit.CHUNK)
    words = text.split()
    assert filter_audit.mask(text) == filter_audit.BITS["B"] and len(words) > 100
    assert filter_audit.mask(b" \t".join(b"%d" % i for i in range(200_000))) == 0


def brute_whitening(rows):
    groups = {}
    for i, v in rows:
        if v and None not in v and all(map(math.isfinite, v)):
            groups.setdefault(len(v), []).append((i, [math.floor(1024 * c) + 100_000 for c in v]))
    out = {}
    for dim, mine in groups.items():
        n, s = len(mine), [sum(x[k] for _, x in mine) for k in range(dim)]
        x = np.array([[n * a - b for a, b in zip(v, s)] for _, v in mine], float) / n
        e, q = np.linalg.eigh(x.T @ x / n)
        deviation = [sum((n * a - b) ** 2 for a, b in zip(v, s)) for _, v in mine]
        out[dim] = (mine, n, deviation, x, e[::-1][:8], q[:, ::-1][:, :8], e.sum())
    return out


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, 2, "w") for i, v in rows], f"vec_id long, embedding array<{kind}>, dim int, component int, w string")


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whitening_equals_dense_eigenvectors(spark, kind):
    r = np.random.default_rng(4)
    rows = [(i, (r.standard_normal(12) * np.arange(1, 13) ** 0.7 / 10).astype("f4").tolist()) for i in range(150)]
    rows += [(200 + i, (r.standard_normal(3) * (5, 2, 1)).astype("f4").tolist()) for i in range(20)]
    rows += [rows[0], (None, rows[1][1]), (300, None), (301, []), (302, [1.0, None] + [0.0] * 10), (303, [float("nan")] * 12), (304, [float("inf")] + [1.0] * 11)]
    got = whitening.whitened(vectors(spark, rows, kind).repartition(5)).collect()
    for dim, (mine, n, deviation, x, e, q, trace) in brute_whitening(rows).items():
        found = [g for g in got if g["dim"] == dim]
        many = min(8, dim)
        assert len(found) == n * many and {g["component"] for g in found} == set(range(1, many + 1)) and {g["n"] for g in found} == {n}
        for k in range(many):
            want = x @ q[:, k] / e[k] ** 0.5
            of = sorted((-1 if g["id"] is None else g["id"], int(g["deviation"]), g["whitened"]) for g in found if g["component"] == k + 1)
            rough = sorted((-1 if i is None else i, d, w) for (i, _), d, w in zip(mine, deviation, want))
            assert [o[:2] for o in of] == [w[:2] for w in rough]
            a, b = np.array([o[2] for o in of]), np.array([w[2] for w in rough])
            assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
            assert {g["explained"] for g in found if g["component"] == k + 1}.pop() == pytest.approx(e[k] / trace, rel=1e-10)
        assert max(g["identity_error"] for g in found) < 1e-9


def test_whitening_of_odd_tables(spark):
    """No spread at all, fewer directions than dimensions, entries beyond 64-bit products, nothing."""
    assert whitening.whitened(vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    assert whitening.whitened(vectors(spark, [])).count() == 0
    flat = whitening.whitened(vectors(spark, [(i, [float(i % 7), 2.0 * (i % 7), 1.0]) for i in range(20)])).collect()
    assert {f["component"] for f in flat} == {1} and flat[0]["explained"] == pytest.approx(1)
    wide = [(i, [(-1.0) ** i * 2.0**40, float(i)]) for i in range(6)]
    got = whitening.whitened(vectors(spark, wide, "double")).filter("component = 1").collect()
    s = sum(int(v[0] * 1024) + 100_000 for _, v in wide)
    t = sum(int(v[1] * 1024) + 100_000 for _, v in wide)
    assert {g["id"]: int(g["deviation"]) for g in got} == {i: (6 * (int(v[0] * 1024) + 100_000) - s) ** 2 + (6 * (int(v[1] * 1024) + 100_000) - t) ** 2 for i, v in wide}


@pytest.mark.parametrize("seed", range(6))
def test_pivots_count_eigenvalues(seed):
    r = np.random.default_rng(seed)
    for _ in range(40):
        n = int(r.integers(1, 14))
        q, _ = np.linalg.qr(r.standard_normal((n, n)))
        e = r.choice([-3, -1, 0.5, 2, 2, 1e-3], n)
        negative, zero, positive = whitening.inertia((q * e) @ q.T)
        assert (negative, zero, positive) == ((e < 0).sum(), 0, (e > 0).sum())
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 0, 1) and whitening.inertia(np.zeros((3, 3))) == (0, 3, 0)


@pytest.mark.parametrize("seed", range(6))
def test_slices_find_close_and_equal_eigenvalues(seed):
    r = np.random.default_rng(seed)
    for _ in range(20):
        n = int(r.integers(1, 30))
        q, _ = np.linalg.qr(r.standard_normal((n, n)))
        e = np.sort(r.choice([1, 1, 2, 3.0, 5, 1e-5, 7.000001, 7.0], n))[::-1]
        v = (q * e) @ q.T
        v = (v + v.T) / 2
        values, found = whitening.leading(v, 8)
        assert np.allclose(values, e[:8], rtol=0, atol=1e-12 * e.sum())
        assert np.abs(found.T @ found - np.eye(len(values))).max() < 1e-12 and np.abs(v @ found - found * values).max() < 1e-12 * e.sum()


def brute_mix(rows, share=1.5, most=2, weights=(5, 2, 1)):
    docs = [(i, s, len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]), int(hashlib.md5(" ".join(str(x) for x in (i, t) if x is not None).encode()).hexdigest()[:15], 16)) for i, t, _, s in rows]
    names = sorted({d[1] for d in docs if d[1] is not None}) + [None] * any(d[1] is None for d in docs)
    size = {s: sum(d[2] for d in docs if d[1] == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, target = share * sum(size.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * size[s]}
        for s in over or free:
            target[s] = float(most * size[s]) if over else level * weight[s]
        if not over:
            break
        free -= over
        left -= sum(most * size[s] for s in over)
    out = []
    for s in names:
        passes = math.floor(target[s] / size[s]) if size[s] else 0
        rest = math.floor(target[s] + 0.5) - passes * size[s]
        mine = [d for d in docs if d[1] == s]
        for i, _, n, key in mine:
            before, tied = sum(d[2] for d in mine if d[3] < key), sum(d[2] for d in mine if d[3] == key)
            part = n if before + tied <= rest else n * (rest - before) // tied if before < rest else 0
            out.append((i, s, n, size[s], target[s], passes * n + part))
    return sorted(out, key=str)


def same_mix(got, want):
    assert [g[:4] + g[5:] for g in got] == [w[:4] + w[5:] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], rel=1e-12)


@pytest.mark.parametrize("seed", range(3))
def test_mix_equals_sorting(spark, seed):
    r = random.Random(seed)
    names = ["a", "b", "B", "ä", "\U0001f600", "￿", "", None, "only empty"]
    rows = [(r.choice([i, None, 7]), r.choice(["x y", "", None, "one\ttwo\x0bthree", "w " * r.randrange(40), "a\xa0b"]), None, r.choice(names[: r.randrange(1, 9)])) for i in range(150)]
    rows += [(900, None, None, "only empty"), (901, "w " * 5000, None, "b")] + [(7, "x y", None, "a")] * 9 + [(800 + i, "half of all rows " * 3, None, "a") for i in range(200)]
    got = sorted(map(tuple, mixing.mix(documents(spark, rows).repartition(6)).collect()), key=str)
    same_mix(got, brute_mix(rows))
    assert all(g[5] <= 2 * g[2] for g in got)


def test_mix_meets_targets_beyond_one_level(spark):
    """Many documents of one source: the threshold is looked for in several levels, and the words taken are the target."""
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), F.col("id") % 50)).otherwise("hot").alias("source"))
    found = mixing.mix(rows).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"), F.first("source_size").alias("source_size")).collect()
    assert len(found) == 51 and all(f["taken"] == math.floor(f["target"] + 0.5) and f["size"] == f["source_size"] for f in found)
    assert sum(f["target"] for f in found) == pytest.approx(1.5 * 90_000)


def test_mix_of_nothing(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(documents(spark, [(1, None, None, None)])).collect()] == [0]
